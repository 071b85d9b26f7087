"""Windows, ranks and exact percentiles without a task that holds a whole key.

Spark's window functions bring all rows of a key to one task. Where few keys hold the table, use these: rows are
range-partitioned by (key, order), so that a key spans as many partitions as it needs, each partition is scanned by
itself, and what a partition needs of those before it is carried over a table of one row for each partition and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.scratch import fresh, stored

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


class Ordered:
    """``df`` in the order of ``by``, ``order`` and then all columns, cut into partitions of any keys.

    ``rows`` has the partition (``part``) and the place in it (``at``). It is a written table, so that every step
    sees the same cuts even if executors are lost. Rows are shuffled twice: to be cut, and by partition and key for the windows
    within it, neither of which brings a key together. Rows that are the same in every column are interchangeable.
    Nulls come first, as in Spark's ascending order.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> None:
        self.columns, self.by, self.order = df.columns, by, order
        self.part, self.at = fresh(df.columns, "part", "at")
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rest = [c for c in df.columns if c not in by and c not in order and not isinstance(df.schema[c].dataType, _unsortable())]
        keys = [F.col(f"`{c}`") for c in [*by, *order, *rest]]
        ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        numbered = ranged.withColumn(self.at, F.monotonically_increasing_id())
        numbered = numbered.withColumn(self.part, F.shiftright(self.at, 33)).withColumn(self.at, F.col(self.at).bitwiseAND(F.lit((1 << 33) - 1)))
        self.rows = stored(numbered, "ordered")

    def here(self) -> Window:
        """A window over the rows of one key in one partition, in order."""
        return Window.partitionBy(self.part, *[F.col(f"`{b}`") for b in self.by]).orderBy(self.at)

    def carried(self, totals: DataFrame, names: list[str]) -> DataFrame:
        """``rows`` with columns of ``totals``, which has a row for each partition and key."""
        own = fresh([*self.columns, self.part, self.at, *names], *[f"key{i}" for i in range(len(self.by) + 1)])
        side = totals.select(F.col(self.part).alias(own[0]), *[F.col(f"`{b}`").alias(k) for b, k in zip(self.by, own[1:])], *names)
        same = F.col(self.part) == F.col(own[0])
        for b, k in zip(self.by, own[1:]):
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(k))
        # Every row meets the one row of its partition and key: no more rows, and a hot partition can't arise, as the
        # partitions were cut to equal sizes.
        return self.rows.join(side, same, "left").drop(*own)

    def totals(self, **made: Column) -> DataFrame:
        """Aggregates for each partition and key."""
        return self.rows.groupBy(self.part, *[F.col(f"`{b}`") for b in self.by]).agg(*[v.alias(k) for k, v in made.items()])

    def before(self) -> Window:
        """Over ``totals``: the partitions of a key before a row's own. It sorts one row for each partition and key."""
        return Window.partitionBy(*[F.col(f"`{b}`") for b in self.by]).orderBy(self.part).rowsBetween(_FIRST, -1)


def _unsortable() -> tuple:
    from pyspark.sql.types import MapType, VariantType

    return MapType, VariantType


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str, offsets: dict[str, int], default: object = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``value`` of the row ``offset`` places on in its key (negative: before), for each named offset.

    What ``lag`` and ``lead`` give, without a task that holds a key: a partition's first and last rows of a key, as many as
    the largest offset, are carried to the partitions beside it (through short ones to those beyond). Where there is no
    such row it is ``default``. Ties in ``order`` are broken by all other columns. A column of a new name is replaced.
    """
    o = Ordered(df, by, order, partitions)
    reach = max([1, *map(abs, offsets.values())])
    v = F.col(f"`{value}`")
    n, head, tail, past, next_ = fresh([*o.columns, o.part, o.at, *offsets], "n", "head", "tail", "past", "next")
    w = Window.partitionBy(o.part, *[F.col(f"`{b}`") for b in by])
    place, size = fresh([*o.columns, o.part, o.at, n, head, tail, past, next_, *offsets], "place", "size")
    rows = o.rows.withColumn(place, F.row_number().over(o.here())).withColumn(size, F.count(F.lit(1)).over(w))
    edge = rows.where((F.col(place) <= reach) | (F.col(place) > F.col(size) - reach))
    cell = F.struct(F.col(place).alias("i"), v.alias("v"))
    ends = edge.groupBy(o.part, *[F.col(f"`{b}`") for b in by]).agg(
        F.array_sort(F.collect_list(F.when(F.col(place) <= reach, cell))).alias(head), F.array_sort(F.collect_list(F.when(F.col(place) > F.col(size) - reach, cell))).alias(tail))
    # reach cells for each partition and key: those of the reach partitions before hold all that is needed.
    near = lambda c, a, z: F.flatten(F.collect_list(c).over(Window.partitionBy(*[F.col(f"`{b}`") for b in by]).orderBy(o.part).rowsBetween(a, z)))
    ends = ends.select(o.part, *[F.col(f"`{b}`") for b in by], F.reverse(near(F.col(tail), -reach, -1)).alias(past), near(F.col(head), 1, reach).alias(next_))
    met = o.carried(ends, [past, next_])
    here = o.here()
    found = {}
    for name, k in offsets.items():
        at = F.row_number().over(here)
        left = F.count(F.lit(1)).over(w) - at
        # Cells as structs, so that a null value isn't taken for no row.
        own = F.lag(F.struct(v.alias("v")), -k).over(here) if k else F.struct(v.alias("v"))
        beyond = F.try_element_at(F.col(past), F.greatest(F.lit(-k) - at + 1, F.lit(1)).cast("int")) if k < 0 else F.try_element_at(F.col(next_), F.greatest(F.lit(k) - left, F.lit(1)).cast("int"))
        inside = (at > -k) if k < 0 else (left >= k)
        cell = F.when(inside, own["v"]).when(beyond.isNotNull(), beyond["v"])
        found[name] = cell if default is None else F.when(inside, own["v"]).when(beyond.isNotNull(), beyond["v"]).otherwise(F.lit(default))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in offsets], *[c.alias(name) for name, c in found.items()])


def versions(df: DataFrame, key: list[str], time: str, watched: list[str], partitions: int | None = None) -> DataFrame:
    """Type-2 history of hot keys: a row for each run of equal ``watched`` values, with valid_from and valid_to (null: open).

    Rows are compared with the one before in their key and only those that begin a run are ordered again, so no task holds a
    key. Rows of one time are ordered by what is watched. Null keys, times and values are values like others.
    """
    state, before = fresh([*key, time, *watched], "state", "before")
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*key, time, *watched])]).withColumn(state, F.struct(*[F.col(f"`{c}`") for c in watched]))
    found = neighbours(rows, key, [time, *watched], state, {before: -1}, partitions=partitions)
    starts = found.where(~F.col(before).eqNullSafe(F.col(state))).drop(state, before)
    (until,) = fresh(starts.columns, "valid_to")
    ended = neighbours(starts, key, [time, *watched], time, {until: 1}, partitions=partitions)
    return ended.select(*[F.col(f"`{c}`") for c in [*key, *watched]], F.col(f"`{time}`").alias("valid_from"), F.col(until).alias("valid_to"))


def nth_values(df: DataFrame, by: list[str], order: list[str], value: str, places: dict[str, int], partitions: int | None = None) -> DataFrame:
    """``df`` with ``value`` of the n-th row of its key (from 1; negative: from the end) for each named place, null if the key is shorter."""
    o = Ordered(df, by, order, partitions)
    if not all(places.values()):
        raise ValueError("places count from 1 or from -1")
    deep = max(map(abs, places.values()))
    w = Window.partitionBy(o.part, *[F.col(f"`{b}`") for b in by])
    place, size = fresh([*o.columns, o.part, o.at, *places], "place", "size")
    rows = o.rows.withColumn(place, F.row_number().over(o.here())).withColumn(size, F.count(F.lit(1)).over(w))
    edge = rows.where((F.col(place) <= deep) | (F.col(place) > F.col(size) - deep))
    keys = fresh([*df.columns, *places, o.part], *[f"key{i}" for i in range(len(by))])
    here = [F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)]
    cells = F.array_sort(F.collect_list(F.struct(F.col(o.at).alias("a"), F.col(f"`{value}`").alias("v")))).alias("cells")
    ends = edge.groupBy(F.col(o.part).alias("part"), *here).agg(cells)
    # Of a key the outermost partitions hold all that is asked for, so its list is short however many it spans.
    chain = Window.partitionBy(*keys).orderBy("part")
    back = Window.partitionBy(*keys).orderBy(F.desc("part"))
    ends = ends.withColumn("i", F.row_number().over(chain)).withColumn("j", F.row_number().over(back)).where((F.col("i") <= deep) | (F.col("j") <= deep))
    cells = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "cells"))), lambda x: x["cells"]))
    ends = ends.groupBy(*keys).agg(cells.alias("cells"))
    named = [F.when(F.size("cells") >= abs(k), F.try_element_at("cells", F.lit(k))["v"]).alias(name) for name, k in places.items()]
    ends = stored(ends.select(*keys, *named), "ends")
    same = F.lit(True)
    for b, k in zip(by, keys):
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(k))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in places]).join(ends, same, "left").drop(*keys)


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], last: int | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with running sums of columns over a key: from its first row to each row, or over the ``last`` rows to it.

    What ``sum(...) OVER (ROWS ...)`` gives, without a task that holds a key: partitions are scanned by themselves and
    begin with the sum of the key's partitions before (prefix sums). A sum over the last rows is a difference of two
    running sums only for exact types; here the edge rows of earlier partitions are carried instead, so that doubles
    are added up as Spark would. Null values don't count; with none so far the sum is null.
    """
    o = Ordered(df, by, order, partitions)
    names = [*sums]
    if last is not None:
        return _last_rows(o, df, by, sums, last)
    start = fresh([*o.columns, o.part, o.at, *names], *[f"from{i}" for i in range(len(names))])
    totals = o.totals(**{s: F.sum(F.col(f"`{c}`")) for s, c in zip(start, sums.values())})
    totals = totals.select(o.part, *[F.col(f"`{b}`") for b in by], *[F.sum(s).over(o.before()).alias(s) for s in start])
    met = o.carried(totals, start)
    here = o.here().rowsBetween(_FIRST, Window.currentRow)
    found = []
    for (name, c), s in zip(sums.items(), start):
        own = F.sum(F.col(f"`{c}`")).over(here)
        found.append(F.when(F.col(s).isNull(), own).otherwise(F.col(s) + F.coalesce(own, F.lit(0))).alias(name))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *found)


def _last_rows(o: Ordered, df: DataFrame, by: list[str], sums: dict[str, str], last: int) -> DataFrame:
    reach = last - 1
    w = Window.partitionBy(o.part, *[F.col(f"`{b}`") for b in by])
    names = [*sums]
    place, size, past = fresh([*o.columns, o.part, o.at, *names], "place", "size", "past")
    rows = o.rows.withColumn(place, F.row_number().over(o.here())).withColumn(size, F.count(F.lit(1)).over(w))
    cell = F.struct(F.col(place).alias("i"), *[F.col(f"`{c}`").alias(f"v{j}") for j, c in enumerate(sums.values())])
    tails = rows.where(F.col(place) > F.col(size) - reach).groupBy(o.part, *[F.col(f"`{b}`") for b in by]).agg(F.array_sort(F.collect_list(cell)).alias(past))
    span = Window.partitionBy(*[F.col(f"`{b}`") for b in by]).orderBy(o.part).rowsBetween(-max(1, reach), -1)
    tails = tails.select(o.part, *[F.col(f"`{b}`") for b in by], F.flatten(F.collect_list(past).over(span)).alias(past))
    met = o.carried(tails, [past])
    here = o.here()
    at = F.row_number().over(here)
    found = []
    for j, (name, c) in enumerate(sums.items()):
        own = F.sum(F.col(f"`{c}`")).over(here.rowsBetween(-reach, Window.currentRow))
        missing = F.greatest(F.lit(reach) - at + 1, F.lit(0))  # rows that stand in earlier partitions
        n = F.least(missing, F.size(past))
        cells = F.transform(F.slice(F.col(past), (F.size(past) - n + 1).cast("int"), n.cast("int")), lambda x: x[f"v{j}"])
        cells = F.filter(cells, lambda x: x.isNotNull())
        zero = F.lit(0).cast(df.select(F.sum(F.col(f"`{c}`"))).schema[0].dataType)
        early = F.when((F.coalesce(n, F.lit(0)) > 0) & (F.size(cells) > 0), F.aggregate(cells, zero, lambda a, x: a + x))
        found.append(F.when(early.isNull(), own).otherwise(early + F.coalesce(own, F.lit(0))).alias(name))
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in sums], *found)


def ranks(df: DataFrame, by: list[str], order: list[str], tiles: int = 4, partitions: int | None = None) -> DataFrame:
    """``df`` with row_number, rank, dense_rank, ntile (of ``tiles``), percent_rank and cume_dist in its key's ``order``.

    Ranks come from one range sort: places within a partition plus the counts of the key's partitions before. A tie that
    stands over a cut is carried: a partition's first value is compared with the last one of the key before it, and the place
    where such a value begins or ends is handed on, through partitions that hold nothing else. row_number and ntile break ties by
    all other columns; Spark's break them at random. Columns of those names are replaced.
    """
    o = Ordered(df, by, order, partitions)
    made = ["row_number", "rank", "dense_rank", "ntile", "percent_rank", "cume_dist"]
    keys = [F.col(f"`{b}`") for b in by]
    row, rank, dense, peers, value = fresh([*o.columns, o.part, o.at, *made], "row", "rank", "dense", "peers", "value")
    ordered = Window.partitionBy(o.part, *keys).orderBy(*[F.col(f"`{c}`") for c in order])
    tied = Window.partitionBy(o.part, *keys, *[F.col(f"`{c}`") for c in order])
    # Places within a partition; what is carried sets them right.
    o.rows = stored(o.rows.withColumns({
        row: F.row_number().over(Window.partitionBy(o.part, *keys).orderBy(o.at)), rank: F.rank().over(ordered), dense: F.dense_rank().over(ordered),
        peers: F.count(F.lit(1)).over(tied), value: F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])}), "placed")
    names = "n distinct first last first_n last_n start all on to one skipped begins ends".split()
    n, distinct, first, last, first_n, last_n, start, all_, on, to, one, skipped, begins, ends = fresh(o.rows.columns, *names)
    t = o.rows.groupBy(o.part, *keys).agg(
        F.count(F.lit(1)).alias(n), F.max(dense).alias(distinct), F.min_by(value, o.at).alias(first), F.max_by(value, o.at).alias(last), F.min_by(peers, o.at).alias(first_n), F.max_by(peers, o.at).alias(last_n))
    chain = Window.partitionBy(*keys).orderBy(o.part)  # a row for each partition of a key
    t = t.withColumns({
        start: F.coalesce(F.sum(n).over(chain.rowsBetween(_FIRST, -1)), F.lit(0)), all_: F.sum(n).over(Window.partitionBy(*keys)),
        on: F.coalesce(F.lag(last).over(chain).eqNullSafe(F.col(first)) & F.lag(n).over(chain).isNotNull(), F.lit(False)),  # its first value began before
        to: F.coalesce(F.lead(first).over(chain).eqNullSafe(F.col(last)) & F.lead(n).over(chain).isNotNull(), F.lit(False)),  # its last value goes on
        one: F.col(first).eqNullSafe(F.col(last))})
    # Where the value that reaches into a partition begins, and where the one that leaves it ends; a partition within one value passes both on.
    t = t.withColumns({
        skipped: F.coalesce(F.sum(distinct).over(chain.rowsBetween(_FIRST, -1)), F.lit(0)) - F.sum(F.col(on).cast("long")).over(chain.rowsBetween(_FIRST, Window.currentRow)),
        begins: F.when(~(F.col(one) & F.col(on)), F.when(F.col(one), F.col(start)).otherwise(F.col(start) + F.col(n) - F.col(last_n))),
        ends: F.when(~(F.col(one) & F.col(to)), F.col(start) + F.col(first_n))})
    t = t.withColumns({
        begins: F.when(F.col(on), F.last(begins, ignorenulls=True).over(chain.rowsBetween(_FIRST, -1))), ends: F.when(F.col(to), F.first(ends, ignorenulls=True).over(chain.rowsBetween(1, _LAST)))})
    carried = [start, all_, skipped, begins, ends, first, last]
    met = o.carried(stored(t.select(o.part, *keys, *carried), "ends"), carried)
    head, tail = F.col(begins).isNotNull() & F.col(value).eqNullSafe(F.col(first)), F.col(ends).isNotNull() & F.col(value).eqNullSafe(F.col(last))
    total, long, short = F.col(all_), F.expr(f"`{all_}` % {tiles}"), F.expr(f"`{all_}` div {tiles}")
    zero = F.col(start) + F.col(row) - 1
    tile = F.when(zero < long * (short + 1), F.floor(zero / (short + 1))).otherwise(long + F.floor((zero - long * (short + 1)) / F.greatest(short, F.lit(1)))) + 1
    ranked = F.when(head, F.col(begins) + 1).otherwise(F.col(start) + F.col(rank))
    last_peer = F.when(tail, F.col(ends)).otherwise(F.col(start) + F.col(rank) - 1 + F.col(peers))
    found = {"row_number": (zero + 1).cast("long"), "rank": ranked.cast("long"), "dense_rank": (F.col(skipped) + F.col(dense)).cast("long"), "ntile": tile.cast("long"),
             "percent_rank": F.when(total > 1, (ranked - 1) / F.greatest(total - 1, F.lit(1))).otherwise(0.0), "cume_dist": last_peer / total}
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(name) for name, c in found.items()])


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of the same names, in which nulls match; the columns come once."""
    other = fresh([*left.columns, *right.columns], *[f"on{i}" for i in range(len(on))])
    side = right.withColumnsRenamed(dict(zip(on, other)))
    same = F.lit(True)
    for a, b in zip(on, other):
        same = same & F.col(f"`{a}`").eqNullSafe(F.col(b))
    return left.join(side, same, how).drop(*other)


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 1024, small: int = 10_000, rounds: int = 40) -> DataFrame:
    """The exact percentile of ``value`` in each key for each share, by narrowing histograms: (key columns, p0, p1, ...).

    What ``percentile`` gives (linear between the two rows around the place), without a group in one task. Each round counts
    rows for each key and bin, combined before the shuffle, and keeps for each place the bin that holds it, which is cut
    again. Once the bins of a place hold ``small`` rows or fewer (or one value), they are sorted. Null and NaN values don't
    count; a key without others has nulls. Only bounds of bins, a few rows for each key, are joined back to the rows.
    """
    key_names = [f"key{i}" for i in range(len(by))]
    number = F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None))
    rows = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, key_names)], number.alias("x"))
    keys = rows.groupBy(*key_names).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(s)) * (F.col("n") - 1)).alias("place")) for i, s in enumerate(shares)])
    keys = stored(keys, "keys")
    # A row for each key and needed place (the rows below and above): how many rows lie below ``low``, and the bin's size.
    wanted = keys.where("n > 0").select(*key_names, "n", "low", "high", F.explode(places).alias("s"))
    wanted = wanted.select(*key_names, "low", "high", F.explode(F.array_distinct(F.array(F.floor("s.place"), F.ceil("s.place")))).alias("at"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size"))
    wanted = stored(wanted.distinct(), "wanted")
    done = wanted.where("low = high").select(*key_names, "at", F.col("low").alias("x"))
    settled = [done]
    open_ = wanted.where("low < high")
    for _ in range(rounds):
        if open_.where(F.col("size") > small).isEmpty():
            break
        spans = open_.select(*key_names, "low", "high", "size").distinct()
        in_span = _null_safe_join(rows, spans, key_names).where("x >= low and x <= high")
        # Halves, as a difference may overflow; infinite bounds are bins of their own; the bounds of a bin never fall in one.
        share = F.try_divide(F.col("x") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        even = F.when(F.col("x") == F.col("high"), bins - 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)))
        far = float("inf")
        bin_ = F.when(F.col("low") == -far, (F.col("x") > -far).cast("int")).when(F.col("high") == far, (F.col("x") == far).cast("int")).otherwise(even).cast("int")
        counted = in_span.groupBy(*key_names, "low", "high", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("z"))
        order = Window.partitionBy(*key_names, "low", "high").orderBy("bin").rowsBetween(_FIRST, -1)
        counted = counted.withColumn("under", F.coalesce(F.sum("c").over(order), F.lit(0)))
        met = _null_safe_join(open_, counted, [*key_names, "low", "high"]).where("at - below >= under and at - below < under + c")
        open_ = stored(met.select(*key_names, F.col("a").alias("low"), F.col("z").alias("high"), "at", (F.col("below") + F.col("under")).alias("below"), F.col("c").alias("size")), "wanted")
        settled.append(open_.where("low = high").select(*key_names, "at", F.col("low").alias("x")))
        open_ = open_.where("low < high")
    else:
        raise RuntimeError(f"bins did not become small in {rounds} rounds")
    # What is left: ``small`` rows at most for each place, sorted in the group of its bin.
    spans = open_.select(*key_names, "low", "high", "below").distinct()
    few = _null_safe_join(rows, spans, key_names).where("x >= low and x <= high").groupBy(*key_names, "low", "high", "below").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    settled.append(_null_safe_join(open_.select(*key_names, "low", "high", "below", "at"), few, [*key_names, "low", "high", "below"]).select(*key_names, "at", F.element_at("xs", (F.col("at") - F.col("below") + 1).cast("int")).alias("x")))
    found = settled[0]
    for s in settled[1:]:
        found = found.unionByName(s)
    found = stored(found.groupBy(*key_names).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("xs")), "found")  # two a share
    out = _null_safe_join(keys.select(*key_names, "n"), found, key_names, "left")
    results = []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("n") - 1)
        low, high = F.element_at("xs", F.floor(place)), F.element_at("xs", F.ceil(place))
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        results.append(F.when(F.floor(place) == F.ceil(place), low).otherwise(between).alias(f"p{i}"))
    return out.select(*[F.col(k).alias(b) for k, b in zip(key_names, by)], *results)

