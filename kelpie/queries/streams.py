"""Queries that run streams over the given tables, delivered in shuffled and repeated micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import driver as D
from ..sources import scratch
from ..streaming import replay, sync
from .retrieval import TURNS

QUERIES, SQL = {}, {}
CHUNKS, LATE = 6, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def delivered(rows: DataFrame, folder: str, chunk, last: DataFrame | None = None) -> DataFrame:
    """A stream of ``rows`` in micro-batches: those of a number come in the batch of it or of the next ones, some twice."""
    spark = rows.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("__hash", F.xxhash64(*rows.columns)).withColumn("__chunk", chunk)
    late = F.pmod("__hash", F.lit(LATE + 1)).cast("int")
    again = F.when(F.pmod(F.shiftright("__hash", 8), F.lit(5)) == 0, F.array(late, F.lit(LATE))).otherwise(F.array(late))
    dealt = scratch.written(spread.withColumn("__late", F.explode(again)).withColumn("__chunk", F.col("__chunk") + F.col("__late")).drop("__hash", "__late"), "dealt", folder)
    for k in range(CHUNKS + LATE):  # one after the other, so that the files' times tell their order
        dealt.filter(F.col("__chunk") == k).drop("__chunk").repartition(files).write.mode("append").parquet(f"{folder}/in")
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return e.select(F.concat(F.lit("item"), F.get_json_object("props", "$.k")).alias("entry_id"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH u AS (SELECT 'item' || (props->>'$.k') AS entry_id, event_id::VARCHAR AS event_id, ts, ts::DATE AS day FROM events WHERE event_type IN ('click', 'purchase')),
    r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY ts, event_id) - 1 AS ordinal, row_number() OVER (PARTITION BY entry_id, day ORDER BY ts, event_id) - 1 AS today FROM u),
    d AS (SELECT entry_id, day, count(*) AS n FROM u GROUP BY ALL),
    p AS (SELECT a.entry_id, a.day, sum(least(2.0 * b.n, 2.0) * pow(1 + (a.day - b.day) / 10.0, -0.5)) AS past FROM d a JOIN d b ON a.entry_id = b.entry_id AND b.day < a.day AND a.day - b.day <= 180 GROUP BY ALL)
    SELECT entry_id, event_id, epoch_us(ts) AS us, ordinal, round(coalesce(past, 0) + least(2.0 * today, 2.0), 9) AS activity_before FROM r LEFT JOIN p USING (entry_id, day)""")
def replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use in order of its time with the activity before it, from a stream of late and repeated deliveries."""
    uses, folder = _uses(spark, sf_dir), scratch.folder(spark)
    span = uses.agg(F.min("ts").alias("least"), F.max("ts").alias("most")).first()
    if span.least is None:
        return replay.replayed_batch(uses).select("entry_id", "event_id", F.unix_micros("ts").alias("us"), "ordinal", "activity_before")
    width = (span.most - span.least).total_seconds() / CHUNKS + 1
    chunk = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span.least))) / (width * 1e6)).cast("int")
    end = spark.createDataFrame([("", "end", span.most)], "entry_id string, event_id string, ts timestamp").withColumn("ts", F.col("ts") + F.expr("INTERVAL 3650 DAYS"))
    stream = replay.replayed(delivered(uses, folder, chunk, end), f"{int(width * (LATE + 2))} seconds")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    out = spark.read.schema(replay.OUT).parquet(f"{folder}/out")
    return out.select("entry_id", "event_id", F.unix_micros("ts").alias("us"), "ordinal", F.round("activity_before", 9).alias("activity_before"))


@query(f"""WITH {TURNS} SELECT 'live::' || session AS scope, 'h-' || session || '-' || ord || '-' || speaker AS id, ord, 'harness-turn:' || session || ':' || ord || ':' || speaker AS source, md5(text) AS text_md5, 1::BIGINT AS revision
    FROM turns WHERE speaker IN ('user', 'assistant') AND text <> ''""")
def scope_sync_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live scopes after a stream in which every third turn first comes as a draft, some turns twice and all in disorder."""
    t, folder = D.turns(spark, sf_dir), scratch.folder(spark)
    final = t.select("session", "ord", F.col("speaker").alias("role"), "text", "timestamp", F.lit(1).cast("long").alias("revision"), F.lit(False).alias("summary"))
    draft = final.filter("ord % 3 = 0").withColumn("text", F.left("text", F.floor(F.char_length("text") / 2).cast("int"))).withColumn("revision", F.lit(0).cast("long"))
    rows = delivered(final.unionByName(draft), folder, F.pmod(F.xxhash64("session", F.floor(F.col("ord") / 4)), F.lit(CHUNKS)).cast("int"))
    sync.started(rows, f"{folder}/scopes", f"{folder}/checkpoint").awaitTermination()
    return sync.current(spark, f"{folder}/scopes").select("scope", "id", "ord", "source", F.md5("text").alias("text_md5"), "revision")
