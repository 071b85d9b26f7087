"""BPE encoding and decoding with content-defined chunk reuse.

1. Every text is cut where a rolling hash of the last 16 bytes hits a pattern, so
   equal passages give equal chunks wherever they stand.
2. Chunks that occur in two or more different texts are shared; the first text (by
   digest) owns one. Only digests, places and lengths are grouped for this.
3. Each shared chunk is encoded once, by its owner, and its ids are sent to the
   texts that borrow it. Text between shared chunks is encoded where it lies.
4. At both ends of a shared chunk the ids are repaired: the stretch between the
   nearest safe places is encoded again, and the ids dropped from the chunk must
   equal those that encoding the dropped stretch gives; else the next safe place is
   tried, up to the whole chunk. A safe place is a blank or line end after a
   character that isn't white space: the byte-level pattern never matches across it.

Equal texts are encoded once as well: rows meet their ids by the text's digest, so
null, repeated or clashing ids of rows don't matter. Texts travel compressed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import durable

#: The pattern by which byte-level BPE of this family splits text before the merges: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAFE = re.compile(r"(?<=\S)[ \n]")
#: A long run of the pattern's white space. The splitter would recurse over it, so it is taken out beforehand.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")


class Encoder:
    """Encodes as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does, truncation and padding unused.

    The file must be byte-level BPE whose ids are the merges' ranks; the merges then run on ranks, several times
    faster. For this vocabulary both ways agree on every text: they split all code points alike, and each token's
    own bytes are merged along the file's merges only.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE can be cut into chunks")
        specials = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials):
            raise ValueError(f"{path}: special tokens that look at their surroundings can't be cut out")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in specials}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError(f"{path}: ids aren't the merges' ranks")
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for k, v in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes_of[v] = k
        self.ranks = {base64.b64encode(k): v for k, v in ranks.items()}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._mergers = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_mergers": {}}

    def _merge(self, text: str, pattern: str) -> list[int]:
        if pattern not in self._mergers:
            import tiktoken

            self._mergers[pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(k): v for k, v in self.ranks.items()}, special_tokens={})
        return self._mergers[pattern].encode_ordinary(text)

    def plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens.

        The pattern takes a run of white space as one piece, but for its last character if text follows.
        Long runs are merged as such a piece by themselves, which gives the same ids for runs of any length.
        """
        ids: list[int] = []
        at = 0
        for run in LONG_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._merge(text[at : run.start()], PATTERN)
            ids += self._merge(text[run.start() : end], r"[\s\S]+")
            at = end
        return ids + self._merge(text[at:], PATTERN) if at else self._merge(text, PATTERN)

    def encode(self, text: str) -> list[int]:
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        return [i for part in self.cut_special.split(text) for i in ([self.special[part]] if part in self.special else self.plain(part))]

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_RANDOM = np.random.default_rng(16).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, least: int = 256, mean: int = 1024, most: int = 8192) -> list[int]:
    """Byte positions that cut ``data`` into chunks: 0, ..., len(data). Cuts never split a UTF-8 character.

    A cut follows a place where the polynomial hash of the last 16 bytes is 0 in its upper bits, at least
    ``least`` bytes after the one before; after ``most`` bytes without such a place there is one anyway.
    """
    n = len(data)
    if n <= least:
        return [0, n] if n else [0]
    raw = np.frombuffer(data, dtype=np.uint8)
    h, factor = _RANDOM[raw], np.uint32(2654435769)
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] * factor
        factor = np.uint32(int(factor) * int(factor) & 0xFFFFFFFF)
    hits = (np.flatnonzero(h < np.uint32((1 << 32) // max(1, mean - least))) + 1).tolist()
    cuts = [0]
    for c in [*hits, n]:
        while c - cuts[-1] > most:
            cuts.append(_start(raw, cuts[-1] + most))
        if c - cuts[-1] >= least and c < n:
            c = _start(raw, c)
            if c < n:
                cuts.append(c)
    return [*cuts, n]


def _start(raw: np.ndarray, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _chunks(text: str, encoder: Encoder) -> Iterator[tuple[int, int, bytes]]:
    """(start, length, digest) of a text's chunks, in code points; special tokens lie between chunks."""
    at = 0
    for part in encoder.cut_special.split(text) if encoder.cut_special else [text]:
        if part not in encoder.special:
            data = part.encode("utf-8", "replace")
            cuts, start = cut_points(data), at
            for a, b in zip(cuts, cuts[1:]):
                piece = data[a:b]
                size = len(piece) if piece.isascii() else len(piece.decode("utf-8"))
                yield start, size, xxhash.xxh3_128_digest(piece)
                start += size
        at += len(part)


def _safe_before(text: str, at: int, low: int) -> int:
    """The last safe place in (low, at], or ``low``."""
    reach = 64
    while True:
        floor = max(low, at - reach)
        found = [m.start() for m in SAFE.finditer(text, floor, min(len(text), at + 1)) if m.start() > low]
        if found:
            return found[-1]
        if floor == low:
            return low
        reach *= 8


def _safe_after(text: str, at: int, high: int) -> int:
    """The first safe place in [at, high), or ``high``."""
    found = SAFE.search(text, at, high) if at else None
    return found.start() if found else high


def assemble(text: str, shared: list[tuple[int, int, list[int]]], encoder: Encoder) -> list[int]:
    """The ids of ``text``, taking those of shared chunks (start, length, ids) where they are known."""
    out: list[int] = []
    done = 0  # ids of text[:done] are final, and done is a safe place
    for start, size, ids in sorted(shared, key=lambda s: s[0]):
        end = start + size
        head = start if start == 0 and done == 0 else _safe_after(text, max(start, done), end)
        while head < end:
            front = encoder.plain(text[start:head])
            if ids[: len(front)] == front:
                break
            head = _safe_after(text, head + 1, end)
        tail = end if end == len(text) else _safe_before(text, end, head)
        while tail > head:
            back = encoder.plain(text[tail:end])
            if not back or ids[-len(back) :] == back:
                break
            tail = _safe_before(text, tail - 1, head)
        if head >= end or tail <= head or len(front) + len(back if tail < end else []) > len(ids):
            continue
        if tail == end:
            back = []
        out += encoder.encode(text[done:head])
        out += ids[len(front) : len(ids) - len(back)]
        done = tail
    return out + encoder.encode(text[done:])


def _pack(ids: list[int]) -> bytes:
    return zstandard.compress(np.array(ids, dtype="<u4").tobytes(), 1)


def _unpack(data: bytes) -> list[int]:
    return np.frombuffer(zstandard.decompress(data), dtype="<u4").tolist()


def _finisher(mode: str, encoder: Encoder):
    if mode == "ids":
        return {"ids": "array<int>"}, lambda ids: {"ids": ids}
    if mode == "digest":

        def digest(ids: list[int]) -> dict:
            decoded = encoder.decode(ids).encode("utf-8", "replace")
            return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}

        return {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, digest
    raise ValueError(f"mode {mode!r}: 'ids' or 'digest'")


class _Rows:
    """Gathers rows and hands them out as frames of a bounded size."""

    def __init__(self, columns: list[str]) -> None:
        self.columns, self.rows, self.weight = columns, [], 0

    def add(self, weight: int, **row: object) -> None:
        self.rows.append([row.get(c) for c in self.columns])
        self.weight += weight + 64

    def frames(self, least: int) -> Iterator[pd.DataFrame]:
        if self.weight >= least and self.rows:
            yield pd.DataFrame(self.rows, columns=self.columns, dtype=object)
            self.rows, self.weight = [], 0


def encode_texts(df: DataFrame, tokenizer_path: str, text_col: str = "text", mode: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if not given) and each text's encoding.

    ``mode`` "ids" adds ``ids`` (array<int>); "digest" adds n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit numbers) and decoded_sha256 (of the decoded text in UTF-8). A null text counts as empty: no
    ids. Every row comes back once, repeated rows included; an empty table gives an empty result. Texts are
    encoded whole, however long (runs of blanks or line ends too, see ``Encoder.plain``), one text at a time
    in memory. Columns of ``df`` with the results' names are replaced. Decode ids with ``decode_ids``.
    ``tokenizer_path`` is read on the driver.
    """
    encoder = Encoder(tokenizer_path)
    columns, finish = _finisher(mode, encoder)
    keep = df.columns if keep is None else keep
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = df.select(F.unhex(F.md5(text.cast("binary"))).alias("__key"), text.alias("__text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, a, n, h) for k, t in zip(pdf["__key"], pdf["__text"]) for a, n, h in _chunks(t, encoder)]
            yield pd.DataFrame(found, columns=["key", "start", "size", "chunk"])

    places = durable(keyed.mapInPandas(cut, "key binary, start int, size int, chunk binary").distinct(), "places")
    owners = places.groupBy("chunk").agg(F.min(F.struct("key", "start")).alias("owner"), F.max("key").alias("last")).where("owner.key <> last")
    owners = durable(owners, "owners")  # a table of its own, so that AQE may split a chunk that most texts share
    plan = places.join(owners, "chunk").select("key", F.struct("start", "size", "chunk", ((F.col("key") == F.col("owner.key")) & (F.col("start") == F.col("owner.start"))).alias("own")).alias("place"))
    plan = plan.groupBy("key").agg(F.collect_list("place").alias("plan"))

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        squeezer = zstandard.ZstdCompressor(3)
        return texts.map(lambda t: squeezer.compress(t.encode("utf-8", "replace")))

    texts = keyed.select(F.col("__key").alias("key"), squeeze("__text").alias("packed")).groupBy("key").agg(F.first("packed").alias("packed"))
    rest = ", ".join(f"{c} {t}" for c, t in columns.items())
    names = ["kind", "key", "chunk", "ids_packed", "packed", "plan", *columns]

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener, rows = zstandard.ZstdDecompressor(), _Rows(names)
        for pdf in batches:
            for key, packed, places in zip(pdf["key"], pdf["packed"], pdf["plan"]):
                text = opener.decompress(packed).decode("utf-8")
                places = [] if places is None else list(places)
                mine = [(p["start"], p["size"], encoder.plain(text[p["start"] : p["start"] + p["size"]]), p["chunk"]) for p in places if p["own"]]
                for _, _, ids, chunk in mine:
                    rows.add(4 * len(ids), kind="chunk", chunk=chunk, ids_packed=_pack(ids))
                if len(mine) == len(places):
                    ids = assemble(text, [m[:3] for m in mine], encoder)
                    rows.add(8 * len(ids), kind="done", key=key, **finish(ids))
                else:
                    rows.add(len(packed), kind="wait", key=key, packed=packed, plan=[{k: p[k] for k in ("start", "size", "chunk")} for p in places])
                yield from rows.frames(1 << 23)
        yield from rows.frames(0)

    schema = f"kind string, key binary, chunk binary, ids_packed binary, packed binary, plan array<struct<start:int,size:int,chunk:binary>>, {rest}"
    first = durable(texts.join(plan, "key", "left").mapInPandas(first_pass, schema), "first")

    waiting = first.where("kind = 'wait'")
    borrowed = waiting.select("key", F.explode("plan").alias("p")).select("key", "p.*").join(first.where("kind = 'chunk'").select("chunk", "ids_packed"), "chunk")
    borrowed = borrowed.groupBy("key").agg(F.collect_list(F.struct("start", "size", "ids_packed")).alias("chunks"))

    def second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener, rows = zstandard.ZstdDecompressor(), _Rows(["key", *columns])
        for pdf in batches:
            for key, packed, chunks in zip(pdf["key"], pdf["packed"], pdf["chunks"]):
                text = opener.decompress(packed).decode("utf-8")
                ids = assemble(text, [(c["start"], c["size"], _unpack(c["ids_packed"])) for c in chunks], encoder)
                rows.add(8 * len(ids), key=key, **finish(ids))
                yield from rows.frames(1 << 23)
        yield from rows.frames(0)

    finished = waiting.select("key", "packed").join(borrowed, "key").mapInPandas(second_pass, f"key binary, {rest}")
    results = first.where("kind = 'done'").select("key", *columns).unionAll(finished)
    rows = df.select(*[F.col(f"`{c}`") for c in keep if c not in columns], F.unhex(F.md5(text.cast("binary"))).alias("__key"))
    return rows.join(results.withColumnRenamed("key", "__key"), "__key").drop("__key")


def decode_ids(ids: Column, tokenizer_path: str) -> Column:
    """The text of a column of ids, as ``decode(ids, skip_special_tokens=False)`` gives it; null ids give null."""
    encoder = Encoder(tokenizer_path)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else encoder.decode(list(r)))

    return run(ids)
