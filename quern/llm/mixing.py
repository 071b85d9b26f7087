"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, made to
sum to one: 1 keeps the shares, 0 makes all sources equal. The exponent is found by
bisection: the largest whose weights reach a target entropy, or the smallest that
keeps every source's passes over its documents within a repetition limit. A source's
budget is its weight times the whole budget. It is realised in passes: each pass is
a permutation of the source's blocks, and of the documents within a block, by keyed
hashes; full passes take all, and the last takes documents in that order until the
budget is met.

Documents fall into blocks by a hash, so a source of any size is spread over many
tasks. Only token sums of blocks are ordered, and only the one block in which a
budget ends is ordered document by document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import durable, fresh


def temperature_weights(shares: dict[object, float], exponent: float) -> dict[object, float]:
    powers = {s: p**exponent for s, p in shares.items()}
    whole = sum(powers.values())
    return {s: p / whole for s, p in powers.items()}


def entropy(weights: dict[object, float]) -> float:
    """As a part of the largest entropy that so many sources can have: 0 to 1; one source has 1."""
    if len(weights) < 2:
        return 1.0
    return -sum(w * math.log(w) for w in weights.values() if w > 0) / math.log(len(weights))


def solve_exponent(shares: dict[object, float], target_entropy: float | None = None, max_repeats: float | None = None, rounds: int = 60) -> float:
    """The exponent in [0, 1] found by bisection, for one of the two targets.

    The budget covers every source at least once: it is the largest share-to-weight ratio of all sources times
    all tokens, so a source's passes are (weight / share) over the smallest such ratio.
    """

    def fits(x: float) -> bool:
        w = temperature_weights(shares, x)
        if target_entropy is not None:
            return entropy(w) >= target_entropy
        ratios = [w[s] / shares[s] for s in shares]
        return max(ratios) / min(ratios) <= max_repeats

    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    if not shares:
        return 1.0
    good, bad = (0.0, 1.0) if target_entropy is not None else (1.0, 0.0)
    if fits(bad):
        return bad
    for _ in range(rounds):
        middle = (good + bad) / 2
        good, bad = (middle, bad) if fits(middle) else (good, middle)
    return good


def count_tokens(text: Column) -> Column:
    """Words between white space; null counts as none. Every document weighs one token at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))).cast("long")


def plan_weights(tokens: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, max_sources: int = 100_000) -> DataFrame:
    """(source, tokens, share, weight, budget) from (source, tokens, n_docs): one row a source.

    Sources are few (``max_sources`` at most, else an error): their sums go to the driver for the bisection.
    Without ``budget`` every source is covered at least once. A null source is a source.
    """
    sums = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    whole = sum(r["tokens"] for r in sums)
    shares = {r["source"]: r["tokens"] / whole for r in sums}
    weights = temperature_weights(shares, solve_exponent(shares, target_entropy, max_repeats)) if shares else {}
    total = budget if budget is not None else max((whole * shares[s] / weights[s] for s in shares), default=0)
    rows = [(r["source"], r["tokens"], shares[r["source"]], weights[r["source"]], max(r["tokens"] if budget is None else 0, round(weights[r["source"]] * total))) for r in sums]
    kind = tokens.schema["source"].dataType.simpleString()
    return tokens.sparkSession.createDataFrame(rows, f"source {kind}, tokens long, share double, weight double, budget long")


def repeated(df: DataFrame, times: str, out: str, part: int = 1 << 16) -> DataFrame:
    """Each row of ``df`` ``times`` times (none, if 0 or less), with ``out`` counting from 0.

    No task makes more than ``part`` rows of one row: beyond it a row is sent on as ranges, which are dealt over tasks.
    """
    n = F.col(times)
    few = df.where((n > 0) & (n <= part)).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    (first,) = fresh([*df.columns, out], "first")
    many = df.where(n > part).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(part).cast("long"))))
    many = many.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), times, first)  # by number, so that AQE doesn't join them again
    many = many.withColumn(out, F.explode(F.sequence(F.col(first), F.least(n.cast("long"), F.col(first) + part) - 1))).drop(first)
    return few.unionByName(many)


def _row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a whole row, in which column a null stands included."""
    values = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.array(*[v.isNull() for v in values])
    return F.xxhash64(F.lit("row"), nulls, *values), F.xxhash64(F.lit("check"), nulls, *values)


def _mixture(
    df: DataFrame, source_col: str, id_col: str, text_col: str, target_entropy: float | None, max_repeats: float | None, budget: int | None, block_tokens: int, seed: str, part: int
) -> tuple[DataFrame, DataFrame]:
    """The distinct rows (row_hash, row_check, id, source, tokens, and their number n), and what ``mix_sources`` gives."""
    whole, check = _row_hashes(df)
    own = ["row_hash", "row_check", "id", "source", "tokens"]
    rows = df.select(whole.alias("row_hash"), check.alias("row_check"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), count_tokens(F.col(f"`{text_col}`")).alias("tokens"))
    grouped = durable(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    sums = grouped.select("source", (F.col("tokens") * F.col("n")).alias("tokens"))
    plan = durable(plan_weights(sums, target_entropy, max_repeats, budget).withColumn("passes", F.floor(F.col("budget") / F.col("tokens"))), "mix-plan")
    known = plan.select(F.col("source").alias("__s"), F.col("tokens").alias("source_tokens"), "weight", "budget", "passes")
    plan_join = F.col("source").eqNullSafe(F.col("__s"))
    # A plan has a row for each source, of which max_sources is the bound.
    docs = repeated(grouped, "n", "copies", part).drop("n").join(F.broadcast(known), plan_join).drop("__s")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_tokens") / block_tokens)).cast("long")
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row_hash", "row_check", "copies"), blocks))
    docs = docs.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes")))

    keys = ["source", "pass", "block"]
    sizes = docs.groupBy(*keys).agg(F.sum("tokens").alias("block_tokens"), F.first("budget").alias("budget"), F.first("source_tokens").alias("source_tokens"))
    turn = F.xxhash64(F.lit(seed), F.lit("block"), "source", "pass", "block")
    # A source may have millions of blocks: they are summed in 4,096 slices of the order of turns, and ordered inside a slice.
    sizes = durable(sizes.withColumn("turn", turn).withColumn("slice", F.shiftright("turn", 52).cast("int")), "mix-sizes")
    slices = sizes.groupBy("source", "pass", "slice").agg(F.sum("block_tokens").alias("tokens"))
    earlier = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("__s"), F.col("pass").alias("__p"), F.col("slice").alias("__t"), F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("sliced"))
    sizes = sizes.join(slices, F.col("source").eqNullSafe(F.col("__s")) & (F.col("pass") == F.col("__p")) & (F.col("slice") == F.col("__t"))).drop("__s", "__p", "__t")
    before = Window.partitionBy("source", "pass", "slice").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)) + F.col("sliced") + F.col("pass") * F.col("source_tokens"))
    sizes = sizes.where(F.col("before") < F.col("budget")).select(F.col("source").alias("__s"), F.col("pass").alias("__p"), F.col("block").alias("__b"), "before", "block_tokens")
    sizes = durable(sizes, "mix-blocks")
    met = docs.join(sizes, F.col("source").eqNullSafe(F.col("__s")) & (F.col("pass") == F.col("__p")) & (F.col("block") == F.col("__b"))).drop("__s", "__p", "__b")
    order = F.xxhash64(F.lit(seed), F.lit("doc"), "pass", "row_hash", "row_check", "copies")
    inner = Window.partitionBy(*keys).orderBy(order, "row_hash", "row_check", "id", "copies").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where(F.col("at") < F.col("budget"))
    return grouped, met.select(*own, "copies", "weight", "pass", (F.col("at") / F.col("budget")).alias("position"))


def mix_sources(
    df: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1_000_000,
    seed: str = "mix",
    part: int = 1 << 16,
) -> DataFrame:
    """(row_hash, row_check, id, source, tokens, copies, weight, pass, position) of the mixed corpus: a row for each time a document is taken.

    ``position`` in [0, 1) interleaves the sources: the part of its source's budget that lies before the
    document. Order by it to read the mixture. ``copies`` numbers wholly equal rows from 0; they are taken
    like others, and no task makes more than ``part`` of them from one row. ``row_hash`` and ``row_check`` are
    128 bits of the whole row. Full passes take every document of a source; the last pass goes past the budget
    by less than one document. Null sources are a source of their own; null texts weigh one token. An empty
    table gives an empty result. Extra columns of any name only count in the hashes.
    """
    return _mixture(df, source_col, id_col, text_col, target_entropy, max_repeats, budget, block_tokens, seed, part)[1]


def mixed_documents(
    df: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1_000_000,
    seed: str = "mix",
    part: int = 1 << 16,
) -> DataFrame:
    """The rows of ``df``, each as often as the mixture takes it; options and odd rows as of ``mix_sources``.

    Wholly equal rows share the times that all of them are taken: each is read equally often, and what is left
    over is read from one of them. So no group of copies is gathered in one task. Columns come back as they are, whatever their names.
    """
    grouped, mixed = _mixture(df, source_col, id_col, text_col, target_entropy, max_repeats, budget, block_tokens, seed, part)
    names = ["row_hash", "row_check"]
    times = mixed.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    held = grouped.groupBy(*names).agg(F.sum("n").alias("n"))
    own, check, taken_own, taken_check, each, left, i = fresh(df.columns, "own", "check", "taken_own", "taken_check", "each", "left", "i")
    taken = times.join(held, names).select(F.col("row_hash").alias(taken_own), F.col("row_check").alias(taken_check), F.expr("times div n").alias(each), F.expr("times % n").alias(left))
    taken = durable(taken, "mix-times")

    whole, second = _row_hashes(df)
    rows = df.withColumns({own: whole, check: second})
    plain = [F.col(f"`{c}`") for c in df.columns]
    same = (F.col(own) == F.col(taken_own)) & (F.col(check) == F.col(taken_check))

    def read(rows: DataFrame, taken: DataFrame, times: str) -> DataFrame:
        return repeated(rows.join(taken.where(F.col(times) > 0), same), times, i, part).select(*plain)

    over = taken.where(F.col(left) > 0)
    one = rows.join(over, same, "left_semi").dropDuplicates([own, check])
    return read(rows, taken, each).unionByName(read(one, over, left))
