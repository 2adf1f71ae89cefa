"""Stores of scopes, vectors, observations and placements as versioned tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_scope(docs: DataFrame) -> DataFrame:
    """``docs``, failing at run time on a repeated id or position, or an unknown tier."""
    from pyspark.sql.window import Window

    by_id, by_place = Window.partitionBy("scope", "id"), Window.partitionBy("scope", "session", "ord")
    ok = (F.count("*").over(by_id) == 1) & (F.count("*").over(by_place) == 1) & F.col("tier").isin("T0", "T1", "T2", "T3")
    marked = docs.withColumn("__ok", ok)
    return marked.filter(F.assert_true("__ok", F.lit("duplicate id or position, or unknown tier")).isNull()).drop("__ok")


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.sha2(F.concat_ws("\0", "text", "speaker", "timestamp", "source"), 256))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(scope, fingerprint, n): a hash of each scope's documents that doesn't depend on their order."""
    h = F.xxhash64("id", "session", "ord", "text", "speaker", "timestamp", "source", "tier")
    return docs.groupBy("scope").agg(F.sum(h.cast("decimal(20,0)")).cast("string").alias("fingerprint"), F.count("*").alias("n"))


def replace_scope(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after the scopes of ``new`` are replaced by it."""
    return old.join(new.select("scope").distinct(), "scope", "left_anti").unionByName(new)


def sync_kind(old: DataFrame, new: DataFrame, prefix: str) -> DataFrame:
    """The table after rows whose source starts with ``prefix`` are replaced by ``new``."""
    return old.filter(~F.col("source").startswith(prefix)).unionByName(new)


def write_scopes(docs: DataFrame, path: str) -> None:
    """Replaces exactly the scopes present in ``docs``; others stay."""
    checked_scope(docs).write.partitionBy("scope").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def commit(spark, path: str, state: DataFrame, expected_revision: int) -> int:
    """Makes ``state`` the next revision of a placement if the newest is still ``expected_revision``; the new revision.

    The state is written to a folder of its own; then the file ``commits/<revision>``, which names it, is created, and only one
    of several writers can create it. Readers see committed folders alone.
    """
    at = latest_revision(spark, path)
    if at != expected_revision:
        raise ValueError(f"revision is {at}, not {expected_revision}")
    name = uuid.uuid4().hex
    state.write.parquet(f"{path}/states/{name}")
    if not _created(spark, f"{path}/commits/{at + 1}", name):
        raise ValueError(f"another writer has committed revision {at + 1}")
    return at + 1


def _created(spark, path: str, content: str) -> bool:
    """Creates a file that must not exist; False if it does. The content is there before the name is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place.getParent())
    if fs.getUri().getScheme() == "file":  # whose Hadoop client doesn't create exclusively
        folder = jvm.java.io.File(place.getParent().toUri().getPath())
        try:
            os.link(_plain(folder, content), os.path.join(folder.getPath(), place.getName()))
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(place, False)
    except Exception as e:  # noqa: BLE001  whatever the file system throws for a file that exists
        if fs.exists(place):
            return False
        raise e
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _plain(folder, content: str) -> str:
    name = os.path.join(folder.getPath(), f".{content}")
    with open(name, "w") as f:
        f.write(content)
    return name


def commits(spark, path: str) -> DataFrame:
    """(revision, folder) of the committed revisions."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{path}/commits/*").select(F.regexp_extract("_metadata.file_path", r"([0-9]+)$", 1).alias("r"), F.col("value").alias("folder"))
        return rows.filter("r <> ''").select(F.col("r").cast("int").alias("revision"), "folder")
    except AnalysisException:
        return spark.createDataFrame([], "revision int, folder string")


def latest_revision(spark, path: str) -> int:
    return commits(spark, path).agg(F.max("revision")).first()[0] or 0


def revision(spark, path: str, number: int) -> DataFrame:
    found = commits(spark, path).filter(F.col("revision") == number).first()
    if found is None:
        raise ValueError(f"there is no revision {number}")
    return spark.read.parquet(f"{path}/states/{found.folder}").withColumn("revision", F.lit(number))


def rollback(spark, path: str, number: int) -> int:
    """Makes an earlier revision the newest again, as a further revision."""
    return commit(spark, path, revision(spark, path, number).drop("revision"), latest_revision(spark, path))


def propose(placed: DataFrame, wanted: DataFrame, cooldown_s: int = 60, min_gain: float = 1.0) -> DataFrame:
    """(id, move, reason): what a placement would change, and why a move is held back. Nothing is applied."""
    j = placed.select("id", "tier", "moved_s_ago").join(wanted.select("id", F.col("tier").alias("want"), "gain"), "id", "full_outer")
    move = F.when(F.col("tier").isNull(), "unknown_entry").when(F.col("want").isNull() | (F.col("want") == F.col("tier")), "keep").when(F.col("want") == "T0", "admit").otherwise("evict")
    reason = F.when(move.isin("keep", "unknown_entry"), None).when(F.col("moved_s_ago") < cooldown_s, "cooldown").when(F.col("gain") < min_gain, "gain_below_minimum")
    return j.select("id", move.alias("move"), reason.alias("held_by"))
