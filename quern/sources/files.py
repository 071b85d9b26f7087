"""A Python data source over Parquet tables: one partition for some row groups, pruned columns, pushed filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType


class _Groups(InputPartition):
    """Row groups of one file."""

    def __init__(self, path: str, groups: list[int]) -> None:
        super().__init__((path, groups))
        self.path, self.groups = path, groups


class RowGroupSource(DataSource):
    """``spark.read.format("row_groups").option("path", ...)``: a Parquet file or folder in any store that Arrow reads.

    Options: ``columns`` (comma-separated; only those are read) and ``rows`` (about so many for each partition; 100,000).
    Comparisons of a column with values, IN, IS NOT NULL and prefixes are pushed: they rule out row groups by their
    statistics before there are partitions, and then rows as they are read. All other filters are left to Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def _dataset(self) -> ds.Dataset:
        return ds.dataset(self.options["path"].removeprefix("file://"), format="parquet")

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = self._dataset().schema
        named = self.options.get("columns")
        return from_arrow_schema(pa.schema([found.field(c.strip()) for c in named.split(",")]) if named else found, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(self.options, schema.fieldNames())


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rows", 100_000))
        self.columns, self.pushed = columns, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def _where(self) -> pc.Expression | None:
        found = None
        for f in self.pushed:
            found = expression(f) if found is None else found & expression(f)
        return found

    def partitions(self) -> list[InputPartition]:
        where, found = self._where(), []
        for piece in ds.dataset(self.path, format="parquet").get_fragments():
            held, n = [], 0
            for group in piece.split_by_row_group(where):  # by statistics
                info = group.row_groups[0]
                held.append(info.id)
                n += info.num_rows
                if n >= self.rows:
                    found.append(_Groups(piece.path, held))
                    held, n = [], 0
            if held:
                found.append(_Groups(piece.path, held))
        return found or [_Groups("", [])]

    def read(self, partition: _Groups) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        whole = ds.dataset(partition.path, format="parquet")
        piece = next(iter(whole.get_fragments())).subset(row_group_ids=partition.groups)
        yield from piece.to_batches(schema=whole.schema, columns=self.columns, filter=self._where())


def expression(f: Filter) -> pc.Expression | None:
    """Arrow's form of a filter on a top column, None if it has none here."""
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = ds.field(f.attribute[0])
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, In):
        return column.isin(list(f.value))
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, f.value)
    for kind, made in ((EqualTo, lambda c, v: c == v), (GreaterThan, lambda c, v: c > v), (GreaterThanOrEqual, lambda c, v: c >= v), (LessThan, lambda c, v: c < v), (LessThanOrEqual, lambda c, v: c <= v)):
        if isinstance(f, kind) and f.value is not None:
            return made(column, f.value)
    return None
