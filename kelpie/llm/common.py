"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space of the contracts: space and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\f\r"


#: Identifiers or keys (8 to 60 bytes each) that may be broadcast.
SMALL_IDS = 1_000_000


class _Made(threading.local):
    """Folders of the tables that a thread of the driver has written so far, oldest first."""

    def __init__(self):
        self.folders: list[str] = []


_made = _Made()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; with a local master and none named, a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/kelpie-scratch"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    folder = f"{scratch_root(spark)}/kelpie-{uuid.uuid4().hex}"
    _made.folders.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


class Tables:
    """The tables of one run, in a shared folder of their own; a table that has served can be deleted before the run ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{scratch_root(spark)}/kelpie-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """A table whose files are dealt by ``by``: joins and groups on it move the other side only."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entry = f"kelpie_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, by).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(entry)
        out = self.spark.table(entry)
        out.schema  # noqa: B018  resolved while the catalog has the entry; the files stay
        self.spark.sql(f"DROP TABLE {entry}")
        return out

    def delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """Names the present moment for ``settled``."""
    return len(_made.folders)


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """``written``, and the tables written from ``since`` on, which only led to this one, are deleted."""
    out = written(df, name)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in _made.folders[since:-1]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    del _made.folders[since:-1]
    return out


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], counted: DataFrame | None = None, hot_at: int = 20_000) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key; the rows of a hot key meet copies of its one row.

    ``counted`` (``many`` itself if None) is a table with at least the keys of ``many``. A key is hot above ``hot_at`` rows
    and above a share of 1 / SMALL_IDS of all rows, so at most SMALL_IDS keys are broadcast. Tables of few rows are joined as
    they are: no task can get more than all of them.
    """
    counted = many if counted is None else counted
    n_rows = counted.count()
    if n_rows <= 50 * hot_at:
        return many.join(one, keys)
    copies, copy = fresh(many, "copies", "copy")
    least = max(hot_at, n_rows // SMALL_IDS)
    hot = written(counted.groupBy(*keys).count().filter(F.col("count") > least).select(*keys, F.ceil(F.col("count") / least).cast("int").alias(copies)), "hot")
    if hot.isEmpty():
        return many.join(one, keys)
    n = F.coalesce(F.col(copies), F.lit(1))
    many = many.join(F.broadcast(hot), keys, "left").withColumn(copy, F.pmod(F.xxhash64(*many.columns), n).cast("int")).drop(copies)
    one = one.join(F.broadcast(hot), keys, "left").withColumn(copy, F.explode(F.sequence(F.lit(0), n - 1))).drop(copies)
    return many.join(one, [*keys, copy]).drop(copy)


def prefix_totals(counts: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Running total of ``value`` before each row. ``counts`` has a row per partition, not per record."""
    w = Window.orderBy(*order) if not by else Window.partitionBy(*by).orderBy(*order)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def text_of(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names of our own that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
