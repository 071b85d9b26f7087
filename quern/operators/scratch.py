"""Intermediate tables of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

from quern.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: every later step sees the same rows, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/operators/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` for further columns, lengthened until no column of ``taken`` has one of them in any letter case."""
    held = {c.lower() for c in taken}
    found = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        found.append(name)
    return found
