"""Live scopes kept in step with a stream of messages, exactly once.

Each micro-batch rewrites the scopes that it changes, whole, as a new version below ``data/batch=<id>``, and then writes a
commit for its number. A scope's present content is that of its newest committed version, so readers never see half a batch; a
batch that Spark delivers again after a failure overwrites what it had not committed and is skipped once it had. A message
that comes twice or late changes nothing: of one message the highest revision stays. A scope whose documents come out as they
were is not rewritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

DOCS = "scope string, id string, session string, ord bigint, text string, speaker string, timestamp string, source string, tier string, revision bigint"
# Roles whose messages become documents.
ROLES = ["user", "assistant"]


def documents(messages: DataFrame, scope: str = "live") -> DataFrame:
    """Messages (session, ord, role, text, timestamp, revision, summary) as documents of a scope for each session."""
    kept = messages.filter(F.col("role").isin(*ROLES) & ~F.coalesce("summary", F.lit(False)) & (F.coalesce("text", F.lit("")) != ""))
    number = F.col("ord").cast("string")
    return kept.select(
        F.concat_ws("::", F.lit(scope), "session").alias("scope"),
        F.concat_ws("-", F.lit("h"), "session", number, "role").alias("id"),
        "session",
        F.col("ord").cast("long").alias("ord"),
        "text",
        F.col("role").alias("speaker"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.concat_ws(":", F.lit("harness-turn"), "session", number, "role").alias("source"),
        F.lit("T2").alias("tier"),
        F.col("revision").cast("long").alias("revision"),
    )


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the committed batches."""
    try:
        return spark.read.schema("batch bigint").json(f"{path}/commits/*")
    except AnalysisException:
        return spark.createDataFrame([], "batch bigint")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The documents of every scope's newest committed version, with ``batch``."""
    done = committed(spark, path)
    if done.isEmpty():
        return spark.createDataFrame([], f"{DOCS}, batch bigint")
    rows = spark.read.schema(f"{DOCS}, batch bigint").parquet(f"{path}/data").join(F.broadcast(done), "batch", "left_semi")  # a row a batch
    newest = rows.groupBy("scope").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["scope", "batch"]).select(*[f.strip().split()[0] for f in DOCS.split(",")], "batch")


def apply(batch: DataFrame, number: int, path: str) -> None:
    """Writes the versions of the scopes that ``batch`` (documents) changes; a committed number does nothing."""
    spark = batch.sparkSession
    if not committed(spark, path).filter(F.col("batch") == number).isEmpty():
        return
    names = [f.strip().split()[0] for f in DOCS.split(",")]
    old = current(spark, path).select(*names).join(batch.select("scope").distinct(), "scope", "left_semi")
    rest = [F.struct(*(F.col(c) for c in ("revision", *names) if c not in ("scope", "id") and c != "revision")).alias("rest")]
    newest = old.unionByName(batch.select(*names)).select("scope", "id", "revision", *rest).groupBy("scope", "id").agg(F.max(F.struct("revision", "rest")).alias("m"))
    new = newest.select("scope", "id", "m.rest.*", "m.revision").select(*names)
    changed = store.fingerprint(new).join(store.fingerprint(old), ["scope", "fingerprint", "n"], "left_anti").select("scope")
    new.join(changed, "scope", "left_semi").write.mode("overwrite").parquet(f"{path}/data/batch={number}")
    spark.range(number, number + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("overwrite").json(f"{path}/commits/{number}")


def started(messages: DataFrame, path: str, checkpoint: str, scope: str = "live"):
    """A running query that keeps the scopes below ``path`` in step with a stream of messages."""
    rows = documents(messages, scope)
    return rows.writeStream.foreachBatch(lambda batch, number: apply(batch.persist(), number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
