"""Streams that come in many batches: arrival order, late rows, repeats, and sessions closed by timers."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.session import shared_dir


class Arrivals:
    """A folder into which rows come batch by batch, and streams that are run after each.

    ``batches`` holds the rows with a column ``batch``; they are written once, in a folder for each batch, and a stream
    sees a batch as files that have come. A run takes up what is new from its checkpoint, as a job that starts again
    after a failure does, so that all state and the watermark live through the restarts.
    """

    def __init__(self, batches: DataFrame) -> None:
        self.spark = batches.sparkSession
        self.folder = f"{shared_dir(self.spark)}/arrivals/{uuid.uuid4().hex}"
        batches.write.partitionBy("batch").parquet(f"{self.folder}/all")
        self.schema = batches.drop("batch").schema
        self.numbers = [r["batch"] for r in batches.select("batch").distinct().orderBy("batch").collect()]
        self.progress: list[dict] = []

    def run(self, build: Callable[[DataFrame], DataFrame], mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
        """What the stream that ``build`` makes of the rows gives over all batches, as a table.

        ``each`` may turn a batch of rows, with its number, into others before ``build``'s result is written.
        """
        run = uuid.uuid4().hex
        out, state, source = (f"{self.folder}/{x}-{run}" for x in ("out", "state", "in"))
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(self.spark._jsc.hadoopConfiguration())
        path = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        fs.mkdirs(path(source))
        result: DataFrame | None = None
        for number in self.numbers:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/all/batch={number}")
            rows.write.parquet(f"{source}-staged/{number}")
            for f in fs.listStatus(path(f"{source}-staged/{number}")):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), path(f"{source}/{number}-{f.getPath().getName()}"))  # a batch is seen whole files at a time
            result = build(self.spark.readStream.schema(self.schema).parquet(source))

            def put(batch: DataFrame, n: int) -> None:
                batch.write.mode("overwrite").parquet(f"{out}/n={n}")  # under its number: once, even if it runs twice

            query = result.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start()
            query.awaitTermination()
            self.progress += [p if isinstance(p, dict) else p.json for p in query.recentProgress]
        if result is None:
            raise ValueError("there are no batches")
        return self.spark.read.schema(result.schema).parquet(f"{out}/n=*")

    def dropped(self) -> int:
        """Rows (after the partial aggregation before the state) that the watermark dropped in all runs so far."""
        import json

        found = [json.loads(p) if isinstance(p, str) else p for p in self.progress]
        return sum(op.get("numRowsDroppedByWatermark", 0) for p in found for op in p.get("stateOperators", []))

    def late_rows(self, time: str, width: str, late: str) -> DataFrame:
        """The side table of rows that came after their window had closed: those that the streams drop.

        The watermark of a batch is the newest time of all batches before, less ``late``; a row is late if the end of
        its ``width``-wide window isn't after it. Only the newest time of each batch is carried over, a row a batch.
        """
        rows = self.spark.read.parquet(f"{self.folder}/all")
        newest = rows.groupBy("batch").agg(F.max(time).alias("newest")).collect()  # a row for each batch
        marks, before = [], None
        for r in sorted(newest, key=lambda r: r["batch"]):
            marks.append((r["batch"], before))
            before = r["newest"] if before is None else max(before, r["newest"])
        marks = self.spark.createDataFrame(marks, "batch long, newest timestamp")
        met = rows.join(F.broadcast(marks), rows["batch"].cast("long") == marks["batch"]).drop(marks["batch"])
        mark = F.date_trunc("MILLISECOND", F.col("newest")) - F.expr(f"INTERVAL {late}")
        return met.where(F.window(time, width)["end"] <= mark).drop("newest")


def in_batches(rows: DataFrame, time: str, delay: str, width_s: int) -> DataFrame:
    """``rows`` with ``batch``, the ``width_s``-wide stretch of the time at which a row arrives: its own plus ``delay`` seconds (an expression)."""
    return rows.withColumn("batch", F.floor((F.unix_micros(F.col(time).cast("timestamp")) + F.expr(delay).cast("long") * 1_000_000) / F.lit(width_s * 1_000_000)).cast("long"))


class ClosedSessions(StatefulProcessor):
    """Sessions of a slice's keys, sent on once the watermark has passed their last row by the gap.

    The state of a slice is one value: its open sessions, a row for each session and kind. An event-time timer stands at the
    next close. State is deleted with the last open session, so keys that end leave nothing. All keys of a slice are
    worked on at once, so that calls and timers are as many as slices, however many keys there are.
    """

    COLUMNS = ["unknown", "key", "kind", "start", "end", "n"]

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _held(self) -> list[pd.DataFrame]:
        return [pd.read_parquet(io.BytesIO(self.open.get()[0]))] if self.open.exists() else []

    def _joined(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """Rows and sessions whose distance is below the gap as sessions, a row for each kind."""
        rows = pd.concat(parts, ignore_index=True).sort_values(["unknown", "key", "start"], kind="stable", ignore_index=True)
        by = rows.groupby(["unknown", "key"], sort=False)
        before = by["end"].cummax().groupby([rows["unknown"], rows["key"]], sort=False).shift(1, fill_value=-(1 << 62))
        number = (rows["start"] - before >= self.gap).cumsum()
        rows["start"] = rows["start"].groupby(number).transform("min")
        rows["end"] = rows["end"].groupby(number).transform("max")
        return rows.groupby(["unknown", "key", "start", "end", "kind"], sort=False, dropna=False, as_index=False)["n"].sum()[self.COLUMNS]

    def _closed(self, rows: pd.DataFrame, mark: int) -> Iterator[pd.DataFrame]:
        over = rows["end"] + self.gap <= mark
        still = rows[~over]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(still):
            packed = io.BytesIO()
            still.to_parquet(packed, index=False)
            self.open.update((packed.getvalue(),))
            self.handle.registerTimer(int(still["end"].min()) + self.gap)
        else:
            self.open.clear()
        if over.any():
            out = rows[over].groupby(["unknown", "key", "start", "end"], sort=False, as_index=False).agg(n=("n", "sum"), kinds=("kind", "nunique"))
            key = out["key"].astype("Int64").mask(out["unknown"])
            yield pd.DataFrame({"key": key, "start_ms": out["start"], "end_ms": out["end"], "n": out["n"], "kinds": out["kinds"]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        parts, new = self._held(), 0
        for pdf in rows:
            parts.append(pd.DataFrame({"unknown": pdf["unknown"], "key": pdf["key"], "kind": pdf["kind"], "start": pdf["ms"], "end": pdf["ms"], "n": 1}))
            new += len(pdf)
            if new > max(1 << 16, len(parts[0])):  # sessions instead of rows, when these are more
                parts, new = [self._joined(parts)], 0
        yield from self._closed(self._joined(parts), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        for rows in self._held():
            yield from self._closed(rows, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, key: str, time: str, kind: str, gap_s: int, late: str, slices: int = 256) -> DataFrame:
    """(key, start_ms, end_ms, n, kinds) of each session once it is over by the watermark; rows later than ``late`` may be missing from theirs.

    Keys are dealt to ``slices`` by a hash; a task holds the open sessions of one slice at a time. Null keys are one
    key, null kinds are no kind. A checkpoint goes on with the number of slices that it began with.
    """
    known = F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key")
    part = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(slices)).alias("slice")
    rows = stream.withWatermark(time, late).select(part, F.col(key).isNull().alias("unknown"), known, F.unix_millis(time).alias("ms"), F.col(kind).alias("kind"), F.col(time))
    return rows.groupBy("slice").transformWithStateInPandas(ClosedSessions(gap_s * 1000), "key long, start_ms long, end_ms long, n long, kinds long", "Append", "EventTime")


def rocksdb(spark: SparkSession) -> tuple[str, str | None]:
    """Sets the state store that ``transformWithState`` needs; returns what to set back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return name, before
