"""Secret scans with one deterministic automaton for all rules.

The rules' regexes are compiled together: syntax tree, nondeterministic automaton,
subset construction over byte classes, minimisation, transition array. One pass
over the UTF-8 bytes then tells which rules match where. Bytes that lead every
state back to the start (line ends, most punctuation, all non-ASCII bytes) cut a
batch of texts into independent pieces, so that numpy advances all pieces of the
batch by one byte at a time. Pieces in which a rule fired, and only those, are
walked with that rule's own automaton for exact bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A regex over ASCII (classes, groups, ``|``, ``?``, ``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}``).

    Matches are the leftmost, longest ones that don't overlap; those whose value is shorter than ``least``
    characters are then dropped. The value is the whole match or, if ``tail`` is set, what the regex's last
    part (a class with ``+``) matches.
    """

    kind: str
    regex: str
    least: int = 1
    tail: bool = False
    any_case: bool = False


# The three base rules.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, tail=True, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
]
# Published token formats.
MORE_RULES = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]+", 80),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", 26),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", 20),
    Rule("stripe", r"(sk|rk)_(live|test)_[A-Za-z0-9]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("npm", r"npm_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJhbGci[A-Za-z0-9_.-]+", 36),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/=-]+", 27, any_case=True),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_.-]+", 60),
    Rule("adobe", r"p8e-[a-z0-9]+", 36),
    Rule("age", r"AGE-SECRET-KEY-1[A-Z0-9]+", 74),
    Rule("alibaba", r"LTAI[A-Za-z0-9]+", 20),
    Rule("artifactory", r"AKCp[A-Za-z0-9]+", 60),
    Rule("atlassian", r"ATATT3[A-Za-z0-9_=-]+", 100),
    Rule("aws_session", r"(ASIA|ABIA|ACCA)[A-Z0-9]+", 20),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/=]+", 80),
    Rule("buildkite", r"bkua_[a-z0-9]+", 45),
    Rule("clojars", r"CLOJARS_[a-z0-9]+", 68),
    Rule("contentful", r"CFPAT-[A-Za-z0-9_-]+", 49),
    Rule("databricks", r"dapi[0-9a-f]+", 36),
    Rule("digitalocean", r"do[oprt]_v1_[0-9a-f]+", 71),
    Rule("docker", r"dckr_pat_[A-Za-z0-9_-]+", 36),
    Rule("doppler", r"dp\.pt\.[A-Za-z0-9]+", 46),
    Rule("duffel", r"duffel_(test|live)_[A-Za-z0-9_=-]+", 50),
    Rule("dynatrace", r"dt0c01\.[A-Z0-9.]+", 90),
    Rule("easypost", r"EZ[AT]K[A-Za-z0-9]+", 58),
    Rule("figma", r"figd_[A-Za-z0-9_-]+", 45),
    Rule("flutterwave", r"FLWSECK(_TEST)?-[0-9a-z]+", 20),
    Rule("frameio", r"fio-u-[A-Za-z0-9_=-]+", 70),
    Rule("google_client", r"GOCSPX-[A-Za-z0-9_-]+", 35),
    Rule("google_access", r"ya29\.[A-Za-z0-9_-]+", 40),
    Rule("grafana", r"glsa_[A-Za-z0-9_]+", 46),
    Rule("huggingface", r"hf_[A-Za-z0-9]+", 37),
    Rule("linear", r"lin_api_[A-Za-z0-9]+", 48),
    Rule("mailgun", r"(pub)?key-[0-9a-f]+", 36),
    Rule("newrelic", r"NRAK-[A-Z0-9]+", 32),
    Rule("notion", r"ntn_[A-Za-z0-9]+", 46),
    Rule("openai", r"sk-[A-Za-z0-9_-]+", 51),
    Rule("planetscale", r"pscale_(tkn|pw|oauth)_[A-Za-z0-9=._-]+", 43),
    Rule("postman", r"PMAK-[0-9a-f-]+", 60),
    Rule("prefect", r"pnu_[a-z0-9]+", 40),
    Rule("pulumi", r"pul-[0-9a-f]+", 44),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]+", 70),
    Rule("readme", r"rdme_[a-z0-9]+", 75),
    Rule("replicate", r"r8_[A-Za-z0-9]+", 40),
    Rule("rubygems", r"rubygems_[0-9a-f]+", 57),
    Rule("sendinblue", r"xkeysib-[0-9A-Za-z-]+", 80),
    Rule("sentry", r"sntry[su]_[A-Za-z0-9+/=_]+", 64),
    Rule("shippo", r"shippo_(live|test)_[0-9a-f]+", 52),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9A-Fa-f]+", 38),
    Rule("slack_hook", r"hooks\.slack\.com/(services|workflows)/[A-Za-z0-9+/]+", 60),
    Rule("square", r"sq0(atp|csp|idp)-[A-Za-z0-9_-]+", 29),
    Rule("supabase", r"sbp_[0-9a-f]+", 44),
    Rule("tailscale", r"tskey-(auth|api|client)-[A-Za-z0-9-]+", 30),
    Rule("typeform", r"tfp_[A-Za-z0-9_.=-]+", 50),
    Rule("vault", r"hv[bs]\.[A-Za-z0-9_-]+", 90),
]
RULES = BASE_RULES + MORE_RULES


class _Parser:
    """Builds a nondeterministic automaton: ``eps[s]`` and ``moves[s]`` (a byte set and a state)."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append(None)
        return len(self.eps) - 1

    def build(self, regex: str, any_case: bool, shortest: bool) -> tuple[int, int]:
        self.text, self.at, self.any_case = regex, 0, any_case
        tree = self.choice()
        if self.at != len(regex):
            raise ValueError(f"cannot read {regex!r} at {self.at}")
        return self.wire(self.without_tail(tree) if shortest else tree)

    def without_tail(self, tree):
        """The tree without what a match may go on with at its end."""
        if tree[0] == "and" and tree[1]:
            return ("and", [*tree[1][:-1], self.without_tail(tree[1][-1])])
        if tree[0] == "rep" and tree[3] is None and tree[2]:
            return ("rep", tree[1], int(tree[2]), int(tree[2]))
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("and", parts)

    def repeat(self, tree):
        c = self.peek()
        if c and c in "?*+":
            self.at += 1
            return ("rep", tree, c == "+", 1 if c == "?" else None)
        if c == "{":
            end = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return ("rep", tree, int(low), int(high) if high else None if comma else int(low))
        return tree

    def byte(self) -> int:
        c = self.peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.at += 1
            tree = self.choice()
            self.at += 1
            return tree
        found = set()
        if self.peek() == "[":
            self.at += 1
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self.byte()
                found |= set(range(low, high + 1))
            self.at += 1
        else:
            found = {self.byte()}
        if self.any_case:
            found |= {ord(f(chr(b))) for b in found if chr(b).isalpha() for f in (str.lower, str.upper)}
        return ("set", frozenset(found))

    def wire(self, tree) -> tuple[int, int]:
        start, end = self.state(), self.state()
        if tree[0] == "set":
            self.moves[start] = (tree[1], end)
        elif tree[0] == "or":
            for x in tree[1]:
                a, b = self.wire(x)
                self.eps[start].append(a)
                self.eps[b].append(end)
        else:
            low, high = (0, 0) if tree[0] == "and" else (int(tree[2]), tree[3])
            parts = tree[1] if tree[0] == "and" else [tree[1]] * (low if high is None else high)
            here = start
            for i, x in enumerate(parts):
                a, b = self.wire(x)
                self.eps[here].append(a)
                if tree[0] == "rep" and i >= low:
                    self.eps[here].append(end)
                here = b
            if tree[0] == "rep" and high is None:
                a, b = self.wire(tree[1])
                self.eps[here].append(a)
                self.eps[b] += [a, end]
            self.eps[here].append(end)
        return start, end


@dataclass
class Automaton:
    """``step[state * classes + class_of[byte]]`` is the next state, ``accepts[state]`` the rules' bits; state 0 starts."""

    step: np.ndarray
    class_of: np.ndarray
    classes: int
    accepts: np.ndarray


def compile_rules(rules: list[Rule], anywhere: bool) -> Automaton:
    """The minimal automaton of all rules.

    ``anywhere``: it accepts where a shortest match ends, wherever it began; without the tails no rule's state
    outlasts its match, which keeps the product of the rules small. Otherwise matches begin at the first byte.
    """
    nfa, starts, ends = _Parser(), [], {}
    for i, r in enumerate(rules):
        a, b = nfa.build(r.regex, r.any_case, shortest=anywhere)
        starts.append(a)
        ends[b] = 1 << i

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in ends)

    sets = {m[0] for m in nfa.moves if m}
    kinds: dict[tuple, int] = {}
    class_of = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], dtype=np.int64)
    sample = [int(np.argmax(class_of == k)) for k in range(len(kinds))]

    first = closure(set(starts))
    after = [closure({m[1]}) if m else frozenset() for m in nfa.moves]
    takes = [[k for k, b in enumerate(sample) if m and b in m[0]] for m in nfa.moves]
    number, order, table = {first: 0}, [first], []
    for here in order:
        to: list[set[int]] = [set() for _ in sample]
        for s in here:
            for k in takes[s]:
                to[k] |= after[s]
        row = []
        for states in to:
            nxt = (first | states if states else first) if anywhere else frozenset(states)
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        table.append(row)
    step = np.array(table, dtype=np.int64)
    accepts = np.array([sum(ends[s] for s in x if s in ends) for x in order], dtype=np.int64)

    # States are the same if they accept the same rules and step to the same groups; refine until nothing splits.
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    _, at = np.unique(group, return_index=True)
    rank = np.argsort(np.argsort(at))  # groups by their first state: the start stays 0
    first_of = np.sort(at)
    return Automaton(rank[group[step[first_of]]].reshape(-1), class_of, len(kinds), accepts[first_of])


class Scanner:
    """Finds all rules' matches in texts. Built on the driver, sent with the tasks."""

    def __init__(self, rules: list[Rule]) -> None:
        if len(rules) > 63:
            raise ValueError("an automaton has a bit of 63 for each rule; scan in turns for more")
        self.rules = rules
        self.all = compile_rules(rules, anywhere=True)
        self.own = [compile_rules([r], anywhere=False) for r in rules]
        to = self.all.step.reshape(-1, self.all.classes)
        self.cuts = (to == 0).all(axis=0)[self.all.class_of]

    def fired(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rules' bits) of the pieces of ``data`` in which a rule fired."""
        inside = np.concatenate(([0], ~self.cuts[data], [0])).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        classes = self.all.class_of.astype(np.uint8)[data]
        step, accepts, width = self.all.step.astype(np.int32), self.all.accepts, self.all.classes
        state, bits = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        left = np.searchsorted(-sizes, -np.arange(longest), side="left")  # the number of pieces longer than k
        for k in range(longest):
            n = left[k]
            if n < 16:  # few long pieces are left: one at a time
                steps, accept = step.tolist(), accepts.tolist()
                for i in range(n):
                    s, hit = int(state[i]), int(bits[i])
                    for c in classes[starts[i] + k : starts[i] + sizes[i]].tolist():
                        s = steps[s * width + c]
                        hit |= accept[s]
                    bits[i] = hit
                break
            state[:n] = step[state[:n] * width + classes[starts[:n] + k]]
            bits[:n] |= accepts[state[:n]]
        return [(int(starts[i]), int(starts[i] + sizes[i]), int(bits[i])) for i in np.flatnonzero(bits)]

    def walk(self, piece: bytes, r: int) -> list[tuple[int, int, int]]:
        """(start, end, value's start) of the matches of rule ``r`` in one piece."""
        auto, rule = self.own[r], self.rules[r]
        step, class_of, accepts, width = auto.step.tolist(), auto.class_of.tolist(), auto.accepts.tolist(), auto.classes
        dead = {s for s in range(len(accepts)) if not accepts[s] and all(step[s * width + c] == s for c in range(width))}
        codes = [class_of[b] for b in piece]
        found, i = [], 0
        while i < len(codes):
            s, k, first, last = 0, i, -1, -1
            while k < len(codes):
                s = step[s * width + codes[k]]
                k += 1
                if s in dead:
                    break
                if accepts[s]:
                    first, last = k if first < 0 else first, k
            if last < 0:
                i += 1
                continue
            value = first - 1 if rule.tail else i
            if last - value >= rule.least:
                found.append((i, last, value))
            i = last
        return found

    def scan(self, texts: list[str | None], block: int = 1 << 23) -> list[list[tuple[str, int, int, int]]]:
        """Per text the matches (kind, start, end, value's start) in code points, by start and then the rules' order."""
        out: list[list] = [[] for _ in texts]
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        at = 0
        while at < len(raw):
            to, n = at, 0
            while to < len(raw) and (to == at or n + len(raw[to]) < block):
                n += len(raw[to]) + 1
                to += 1
            data = np.frombuffer(b"\n".join(raw[at:to]), dtype=np.uint8)
            begins = np.cumsum([0] + [len(x) + 1 for x in raw[at:to]])
            found: dict[int, list] = {}
            for start, end, bits in self.fired(data):
                doc = int(np.searchsorted(begins, start, side="right")) - 1
                for r in range(len(self.rules)):
                    if bits >> r & 1:
                        off = start - int(begins[doc])
                        found.setdefault(doc, []).extend((off + a, r, off + b, off + v) for a, b, v in self.walk(data[start:end].tobytes(), r))
            for doc, spans in found.items():
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw[at + doc], dtype=np.uint8) & 0xC0) != 0x80)))
                out[at + doc] = [(self.rules[r].kind, int(chars[a]), int(chars[b]), int(chars[v])) for a, r, b, v in sorted(spans)]
            at = to
        return out


SPANS = "array<struct<kind:string,start:int,end:int,value:int>>"


def secret_spans(text: Column, rules: list[Rule] | None = None) -> Column:
    """The secrets in a text column: kind, start, end and the value's start, in code points, ends exclusive.

    Ordered by start and then the rules' order. Null and empty texts give an empty array.
    """
    scanner = Scanner(RULES if rules is None else rules)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(kind=k, start=a, end=b, value=v) for k, a, b, v in x] for x in scanner.scan([t if isinstance(t, str) else None for t in texts])], dtype=object)

    return find(text)


def scan_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets", rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with the column ``out``: see ``secret_spans``.

    Rows stay as they are, repeated ones too, whole texts of any length are read in one pass, an empty table gives an
    empty one, and a column named ``out`` is replaced.
    """
    return df.withColumn(out, secret_spans(F.col(f"`{text_col}`"), rules))


def masked(text: str, values: list[int], ends: list[int], mark: str) -> str:
    """``text`` with ``mark`` in place of each stretch from a value's start to its end, in linear time; stretches that overlap become one."""
    out, at = [], 0
    for value, end in sorted(zip(values, ends)):
        if value >= at:
            out += [text[at:value], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(df: DataFrame, text_col: str = "text", spans_col: str = "secrets", mark: str = "[secret]") -> DataFrame:
    """Replaces each span's value by ``mark``; values that overlap are replaced together.

    Null texts stay null, texts without a span stay as they are, whole texts of any length are read. Rows stay
    as they are, repeated ones too, and so do other columns. An empty table gives an empty result.
    """
    text, spans = F.col(f"`{text_col}`"), F.col(f"`{spans_col}`")

    @F.pandas_udf("string")
    def mask(texts: pd.Series, values: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([masked(t, v, e, mark) if isinstance(t, str) else None for t, v, e in zip(texts, values, ends)], dtype=object)

    found = F.size(spans) > 0  # other texts needn't go to Python
    new = mask(F.when(found, text), F.transform(spans, lambda s: s["value"]), F.transform(spans, lambda s: s["end"]))
    return df.withColumn(text_col, F.when(found, new).otherwise(text))
