"""Personal data replaced by keyed, type-consistent surrogates.

Detected entities are e-mail addresses, phone, card, social security, IBAN and IPv4
numbers, and names after a title or with a known given name, with all later mentions
of their parts in the same text. A surrogate keeps type,
length, punctuation and letter case; card numbers keep their check digit's validity,
IBANs stay valid, octets stay octets, given names keep gender and script and family
names script. The same entity gets the same surrogate in every document and format
(coreference), whoever runs the job, as long as the key is the same.

Numbers and addresses are mapped by a keyed permutation, without fixed points, of all
values of their format, so that different ones stay different and none stays itself,
even where a corpus has all of them; phone numbers keep their country code. Names have no
such enumeration: they are hashed to syllables, as many as keep collisions few, and a check over all
distinct names of the corpus finds surrogates that two share, or that a real name
has. All but one of those move on to the next attempt until none is shared. The
entities that moved are few by construction and go to the tasks as a table.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import durable, fresh

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Camille Carla Charlotte Clara Elena Elizabeth Emma Greta Hannah Helena Ingrid Isabel Julia Laura Linda Lucia Maria Marta Nadine Patricia Sophie Aisha Fatima Mei Priya Yuki".split(),
    ("latin", "m"): "Albert Antonio Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henri Jacques James Jorge Karl Luis Martin Michael Pedro Robert Thomas William Ahmed Amit Hiroshi Mohammed Omar Rajesh Wei".split(),
    ("cyrillic", "f"): "Анна Вера Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
}
# Titles and their gender ("" if it tells none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f"}
# Syllables of family names by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве га да до ка ко ла ле ма мо на но па ра ро са со та то".split(),
    "greek": "βα γα δα δο κα κο λα λε μα μο να νο πα ρα ρο σα σο τα το".split(),
}
# Endings of given names that are in no list, by script and gender.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "rt", ("cyrillic", "f"): "на", ("cyrillic", "m"): "р", ("greek", "f"): "να", ("greek", "m"): "ς"}
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_WHO = {name: key for key, names in GIVEN.items() for name in names}
_UP = "A-ZÀ-ÖØ-ÞΆΈ-ΫА-ЯЁ"
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d.])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)")),
]
_PART = rf"[{_UP}](?:[^\W\d_]+|(?=['’-][^\W\d_]))(?:['’-][^\W\d_]+)*"
_NAME = re.compile(rf"(?<!\w)(?:({'|'.join(TITLES)})\.? )?({_PART})(?: ({_PART}))?")
_JOINTS = re.compile("['’-]")
_HINTS = re.compile(r"[@\d]")


@dataclass(frozen=True)
class Entity:
    """What is replaced: ``kind`` and ``group`` (what format, script or gender ask for) and the entity's canonical form."""

    kind: str
    group: str
    canon: str
    start: int
    end: int


def _luhn(digits: str) -> int:
    """The check digit that would follow ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def country_code(digits: str) -> int:
    """The number of digits of an international number's country code."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def detect(text: str | None) -> list[Entity]:
    """The entities of a text in order, without overlaps; what stands earlier in PATTERNS wins.

    A run of 13 to 19 digits is a card if its check digit holds; four groups of four are one anyway. Names found
    by a title or given name are then found wherever else the text has them, in upper case too.
    """
    text = text or ""
    found: list[Entity] = []
    taken = bytearray(len(text))

    def add(kind: str, group: str, canon: str, a: int, b: int) -> None:
        if taken.find(1, a, b) < 0:
            found.append(Entity(kind, group, canon, a, b))
            taken[a:b] = b"\1" * (b - a)

    for kind, pattern in PATTERNS if _HINTS.search(text) else []:
        for m in pattern.finditer(text):
            a, b = m.span()
            canon = "".join(c for c in m.group() if c.isalnum()).upper() if kind != "email" else m.group().lower()
            if kind == "ip" and any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in m.group().split(".")):
                continue
            if kind == "iban" and _mod97(canon) != 1:
                continue
            if kind == "phone" and not 7 <= len(canon) <= 15:
                continue
            if kind == "card" and b - a == len(canon) and _luhn(canon[:-1]) != int(canon[-1]):
                continue
            shape = m.group().split("@")[1].rsplit(".", 1)[1].lower() if kind == "email" else canon[:2] if kind == "iban" else ""
            if kind == "phone" and m.group()[0] == "+":
                shape = "+" + canon[: country_code(canon)]
            add(kind, shape, m.group() if kind == "ip" else canon, a, b)
    before = len(found)
    for m in _NAME.finditer(text):
        title, first, second = m.groups()
        gender = TITLES.get(title or "", "")
        if first in _WHO and (second or title):
            script, g = _WHO[first]
            add("given", f"{script} {g}", first, *m.span(2))
            if second:
                add("family", _script(second), second.lower(), *m.span(3))
        elif title and second:
            add("given", f"{_script(first)} {gender or 'u'}", first, *m.span(2))  # u: not known
            add("family", _script(second), second.lower(), *m.span(3))
        elif title:
            add("family", _script(first), first.lower(), *m.span(2))
    known: dict[str, Entity] = {}
    for e in found[before:]:
        known.setdefault(text[e.start : e.end].lower(), e)
    for m in re.finditer(_PART, text) if known else []:
        e = known.get(m.group().lower())
        if e is not None and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")):
            add(e.kind, e.group, e.canon, *m.span())
    return sorted(found, key=lambda e: e.start)


@dataclass
class Surrogates:
    """The keyed mapping. ``moved`` holds the attempt of those entities that a collision check moved on."""

    key: bytes
    syllables: int = 3
    moved: dict[tuple[str, str, str], int] = field(default_factory=dict)
    alphabet: dict[str, list[str]] = field(default_factory=lambda: SYLLABLES)

    def _hash(self, tweak: str, value: int, size: int) -> int:
        data = hashlib.blake2b(f"{tweak}|{value}".encode(), key=self.key[:64], digest_size=32).digest()
        while len(data) < size:
            data += hashlib.blake2b(data, key=self.key[:64], digest_size=32).digest()
        return int.from_bytes(data[:size], "big")

    def _mixed(self, value: int, count: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of 0 to count - 1, or its inverse: eight Feistel rounds, walked until the result is in range."""
        half = ((count - 1).bit_length() + 1) // 2
        mask, size = (1 << half) - 1, half // 8 + 9
        while True:
            left, right = value >> half, value & mask
            for r in reversed(range(8)) if back else range(8):
                if back:
                    left, right = right ^ (self._hash(f"{tweak}|{r}", left, size) & mask), left
                else:
                    left, right = right, left ^ (self._hash(f"{tweak}|{r}", right, size) & mask)
            value = left << half | right
            if value < count:
                return value

    def permute(self, value: int, count: int, tweak: str) -> int:
        """A keyed permutation of 0 to count - 1 without a fixed point: a step round the circle, seen through a permutation.

        So no value is its own surrogate and no two share one, even if all values of a format are in use.
        """
        if count < 2:
            return value
        step = 1 + self._hash(f"{tweak}|step", 0, 16) % (count - 1)
        return self._mixed((self._mixed(value, count, tweak) + step) % count, count, tweak, back=True)

    def _radix(self, places: list[tuple[int, int]], tweak: str) -> list[int]:
        """Permutes all values of mixed-radix digits (digit, base) at once."""
        value, count = 0, 1
        for digit, base in places:
            value, count = value * base + digit, count * base
        value = self.permute(value, count, tweak)
        out = []
        for _, base in reversed(places):
            value, digit = divmod(value, base)
            out.append(digit)
        return out[::-1]

    def _letters(self, text: str, tweak: str) -> str:
        """Permutes letters among letters and digits among digits; all else stays."""
        at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
        shape = "".join("9" if c.isdigit() else "a" if c.isascii() and c.isalnum() else c for c in text)
        new = self._radix([(int(text[i]), 10) if text[i].isdigit() else (ord(text[i].lower()) - 97, 26) for i in at], f"{tweak}|{shape}")
        out = list(text)
        for i, d in zip(at, new):
            out[i] = str(d) if text[i].isdigit() else chr((65 if text[i].isupper() else 97) + d)
        return "".join(out)

    def of(self, kind: str, group: str, canon: str, attempt: int | None = None) -> str:
        """The surrogate of an entity in canonical form."""
        attempt = self.moved.get((kind, group, canon), 0) if attempt is None else attempt
        tweak = f"{kind}|{group}|{attempt}"
        if kind == "email":
            body, tld = canon.rsplit(".", 1)
            return self._letters(body, tweak) + "." + tld
        if kind in ("phone", "ssn"):
            code = len(group.removeprefix("+"))  # the country's, which stays
            return canon[:code] + self._letters(canon[code:], tweak)
        if kind == "card":
            off = (int(canon[-1]) - _luhn(canon[:-1])) % 10
            body = self._letters(canon[:-1], f"{tweak}|{off}")
            return body + str((_luhn(body) + off) % 10)
        if kind == "iban":
            body = self._letters(canon[4:], tweak)
            return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + body):02d}{body}"
        if kind == "ip":
            octets = canon.split(".")
            lows, sizes = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
            new = self._radix([(int(o) - lows[len(o)], sizes[len(o)]) for o in octets], f"{tweak}|{'.'.join(str(len(o)) for o in octets)}")
            return ".".join(str(d + lows[len(o)]) for d, o in zip(new, octets))
        if kind == "given":
            names = GIVEN.get(tuple(group.split(" ")), [])
            if canon in names:  # the next one on a keyed cycle through the list: none is its own
                cycle = sorted(names, key=lambda n: self._hash(f"given|{group}|{n}", 0, 16))
                return cycle[(cycle.index(canon) + 1) % len(cycle)]
        script, _, gender = group.partition(" ")
        parts = self.alphabet[script]
        n = self._hash(f"{tweak}|{canon}", 0, 16)
        return "".join(parts[n // len(parts) ** i % len(parts)] for i in range(self.syllables)) + ENDINGS.get((script, gender), "")

    def render(self, mention: str, surrogate: str, kind: str) -> str:
        """The surrogate in the mention's format: its punctuation, spaces and letter case."""
        if kind in ("given", "family"):
            parts = _JOINTS.split(mention)
            size = max(2, len(surrogate) // len(parts) // 2 * 2)  # whole syllables
            cuts = [surrogate[i * size : (i + 1) * size if i < len(parts) - 1 else None] for i in range(len(parts))] if len(parts) * 2 <= len(surrogate) else [surrogate]
            joints = [*_JOINTS.findall(mention), ""]
            new = "".join(c[:1].upper() + c[1:] + j for c, j in zip(cuts, joints if len(cuts) > 1 else [""]))
            return new.upper() if mention.isupper() and len(mention) > 1 else new
        new = iter(c for c in surrogate if c.isalnum())
        out = []
        for c in mention:
            n = next(new) if c.isalnum() else c
            out.append(n.lower() if c.islower() else n.upper())
        return "".join(out)

    def replace(self, text: str | None) -> tuple[str | None, list[dict]]:
        if not text:
            return text, []
        out, spans, at, size = [], [], 0, 0
        for e in detect(text):
            new = self.render(text[e.start : e.end], self.of(e.kind, e.group, e.canon), e.kind)
            out += [text[at : e.start], new]
            size += e.start - at
            spans.append(dict(kind=e.kind, start=e.start, end=e.end, new_start=size, new_end=size + len(new)))
            size += len(new)
            at = e.end
        return "".join(out) + text[at:], spans


def fit_surrogates(df: DataFrame, key: bytes, text_col: str = "text", max_moved: int = 100_000, max_rounds: int = 20, alphabet: dict[str, list[str]] | None = None) -> Surrogates:
    """The mapping for all texts of ``df``, with its collision checks done over all distinct entities.

    Numbers, addresses and given names of a list are permuted and can't collide; all other names take part in the check. The
    number of a name's syllables follows the count of distinct names, so that fewer than about a thousand
    collide; ``max_moved`` is the bound of what is sent to the tasks, beyond which names get longer. Rounds
    after the first look at the entities that clashed only. If names of twelve syllables more don't settle either (with an
    alphabet of one syllable, say), it raises an error. Null and empty texts have no entities; texts and
    entities may repeat, and an empty table gives a mapping in which nothing moved.
    """

    @F.pandas_udf("array<struct<kind:string,group:string,canon:string>>")
    def entities(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({(e.kind, e.group, e.canon) for e in detect(t if isinstance(t, str) else None) if e.kind in ("given", "family") and e.canon not in _WHO}) for t in texts], dtype=object)

    atoms = df.select(F.explode(entities(F.col(f"`{text_col}`"))).alias("e")).select("e.*").distinct()
    atoms = durable(atoms, "entities")
    names = atoms.groupBy("group").count().collect()  # a row for each script and gender
    mapping = Surrogates(key, alphabet=alphabet or SYLLABLES)
    while any(r["count"] ** 2 > 2000 * len(mapping.alphabet[r["group"].split(" ")[0]]) ** mapping.syllables for r in names):
        mapping.syllables += 1
    real = atoms.select("kind", "group", F.col("canon").alias("new"))
    form = ["kind", "group", "new"]
    longest = mapping.syllables + 12
    while mapping.syllables <= longest:
        now = Surrogates(key, mapping.syllables, alphabet=mapping.alphabet)

        @F.pandas_udf("string")
        def surrogate(kind: pd.Series, group: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
            return pd.Series([now.of(*x) for x in zip(kind, group, canon, attempt.tolist())])

        def tried(entities: DataFrame, attempt: int) -> DataFrame:
            """Surrogates of this attempt; of those that share one the first entity may keep it."""
            new = durable(entities.withColumn("new", surrogate("kind", "group", "canon", F.lit(attempt))), "surrogates")
            first = new.groupBy(*form).agg(F.min("canon").alias("first"))
            return new.join(first, form).withColumn("ok", (F.col("canon") == F.col("first")) & (F.col("new") != F.lower("canon")) & (F.col("new") != F.col("canon"))).drop("first")

        def clashes(entities: DataFrame, held: list[DataFrame]) -> DataFrame:
            for other in held:
                entities = entities.join(other.select(*form, F.lit(True).alias("__held")).distinct(), form, "left").withColumn("ok", F.col("ok") & F.col("__held").isNull()).drop("__held")
            return durable(entities, "tried")

        start = clashes(tried(atoms, 0), [real])
        settled = [start.select(*form), real]
        open_ = start.where("not ok").select("kind", "group", "canon")
        moved: dict[tuple[str, str, str], int] = {}
        for attempt in range(1, max_rounds + 1):
            n_open = open_.count()
            if not n_open or n_open > max_moved:
                break
            now_tried = clashes(tried(open_, attempt), settled)
            moved |= {(r["kind"], r["group"], r["canon"]): attempt for r in now_tried.where("ok").collect()}  # max_moved rows at most
            settled.append(now_tried.where("ok").select(*form))
            open_ = now_tried.where("not ok").select("kind", "group", "canon")
        if open_.isEmpty():
            mapping.moved = moved
            return mapping
        mapping.syllables += 1
    raise RuntimeError(f"names of {longest} syllables still collide after {max_rounds} rounds")


def replace_entities(df: DataFrame, mapping: Surrogates, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """``df`` with each entity of ``text_col`` replaced, and the spans (kind, old and new bounds) in ``spans_col``.

    Null and empty texts stay as they are, with no spans. Rows stay as they are, repeated ones too; whole texts
    of any length are read, in time in proportion to them. A column named ``spans_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(mapping)  # bounded: see fit_surrogates

    @F.pandas_udf("struct<text:string,spans:array<struct<kind:string,start:int,end:int,new_start:int,new_end:int>>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.replace(t if isinstance(t, str) else None) for t in texts], columns=["text", "spans"])

    new = fresh([*df.columns, spans_col], "new")[0]
    done = df.withColumn(new, run(F.col(f"`{text_col}`")))
    kept = [F.col(new)["text"].alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns if c != spans_col]
    return done.select(*kept, F.col(new)["spans"].alias(spans_col))
