"""Sessions and tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's results rely on; the rest is the cluster's."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.master(master) if master else builder
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL in which ``{name}`` stands for a table; no view is registered."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-quern-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """From now on the session sends at most so many rows, and some so many bytes of them, to Python at once; lower settings stay.

    For Python over whole texts: an executor holds a batch several times, as Arrow buffers outside its heap and in each worker.
    No result depends on it. It isn't set back, as Spark plans a frame only when its caller reads it.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they find it where the driver's environment says."""
    root = Path(__file__).resolve().parent.parent
    named = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if "site-packages" in root.parts or any(p and Path(p).resolve() == root for p in named):
        return
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        packed = Path(tempfile.mkdtemp(prefix="spark-quern-")) / "quern.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in (root / "quern").rglob("*.py"):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(str(packed))
        _SHIPPED.add(app)
