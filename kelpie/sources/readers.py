"""Scans of documents, messages, entries and benchmark files into the engine's entities. Schemas are always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DOCUMENT = "id string, scope string, session string, ord int, text string, speaker string, timestamp string, source string, tier string"
TELEMETRY = (
    "event_id string, task_id string, kind string, item_id string, extra_tokens bigint, extra_tool_calls bigint, extra_latency_ms double, extra_cost_usd double, avoidable boolean, "
    "used boolean, mode string, confidence double, avoided_miss boolean, avoided_extra_tokens bigint, avoided_extra_tool_calls bigint, avoided_extra_latency_ms double, avoided_extra_cost_usd double"
)
ENTRY = (
    "id string, tier string, store string, `key` string, summary string, created date, cost_class string, pinned boolean, status string, valid_from date, valid_until date, "
    "events array<struct<event_id:string,type:string,t:date,evidence:string,legacy_unverified:boolean>>"
)
MAX_BYTES = 2_000_000
# Fixed value: sections begin at a heading or after a line with a section sign.
SECTION = r"\n(?=#{1,6} )|\n§\n"


def checked(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, failing at run time on the first row that isn't ``ok``."""
    return df.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull())


def jsonl_documents(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """One document per line; a broken line, another scope or an unknown tier is an error."""
    d = spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path)
    return checked(d, (F.col("scope") == scope) & F.col("tier").isin("T0", "T1", "T2", "T3") & (F.col("ord") >= 0) & (F.octet_length("text") <= MAX_BYTES), "invalid document")


def markdown_documents(spark: SparkSession, root: str, scope: str, tier: str = "T1") -> DataFrame:
    """Sections of all ``*.md`` files below ``root``: split at headings and section-sign lines; numbers count blank parts too."""
    if tier not in ("T0", "T1", "T3"):
        raise ValueError("sections are T0, T1 or T3")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    name = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/"), F.concat(F.lit(r"^\Q"), base, F.lit(r"\E/*")), F.lit(""))
    parts = raw.select(name.alias("rel"), F.posexplode(F.split("value", SECTION)).alias("n", "text"))
    kept = parts.filter(F.col("text").rlike(r"\S"))
    return kept.select(
        F.format_string("file:%s#%d", "rel", "n").alias("id"), F.lit(scope).alias("scope"), F.col("rel").alias("session"), F.col("n").alias("ord"),
        F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), F.lit("").alias("speaker"), F.lit("").alias("timestamp"), F.concat(F.lit("file:"), "rel").alias("source"), F.lit(tier).alias("tier"),
    )


def chat_messages(messages: DataFrame, sessions: DataFrame, now: Column, since: Column | None = None, max_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Visible messages in time order, at most ``max_rows`` (the scan's limit), and one row telling whether more exist."""
    m = messages.filter((F.col("active") == 1) & (F.coalesce("_compressed_summary", F.lit(0)) == 0) & F.col("role").isin("user", "assistant"))
    j = m.join(sessions.filter("hidden = 0").select(F.col("id").alias("session_id"), "source", "profile_name"), "session_id").filter(F.timestamp_seconds("timestamp") <= now)
    if since is not None:
        j = j.filter(F.timestamp_seconds("timestamp") >= since)
    page = j.orderBy("timestamp", "id").limit(max_rows + 1)
    return page.orderBy("timestamp", "id").limit(max_rows), page.agg((F.count("*") > max_rows).alias("partial"), F.count_distinct("profile_name").alias("profiles"))


def message_documents(messages: DataFrame, scope: str) -> DataFrame:
    """Messages as documents with their running place in the session."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")
    return messages.select(
        F.concat(F.lit("msg:"), F.col("id").cast("string")).alias("id"), F.lit(scope).alias("scope"), F.col("session_id").alias("session"), (F.row_number().over(w) - 1).alias("ord"),
        F.col("content").alias("text"), F.col("role").alias("speaker"), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.col("source"), F.lit("T1").alias("tier"),
    )


def store_entries(texts: DataFrame) -> DataFrame:
    """(store, line, text) of stores whose entries are separated by lines with a section sign; ``texts`` has (store, text)."""
    lines = texts.select("store", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("store").orderBy("i")
    cut = F.sum((F.trim("line") == "§").cast("int")).over(w)
    body = lines.withColumn("part", cut).filter((F.trim("line") != "§") & (F.trim("line") != ""))
    g = body.groupBy("store", "part").agg(F.min("i").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return g.select("store", (F.col("line") + 1).alias("line"), "text")


def telemetry_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The events of ``telemetry_log``; an error names the first line that is none."""
    events, errors = telemetry_log(spark, path)
    first = errors.orderBy("file", "line").first()
    if first:
        raise ValueError(f"{first.file}:{first.line}: {first.error}")
    return events.drop("file", "line")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The overlay ``{"entries": {id: fields}}`` as rows."""
    fields = "struct<resident_units:int,miss_penalty_tokens:double,locator:string,scope:string,project:string,profile:string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"entries map<string,{fields}>", {"mode": "FAILFAST"}).alias("c"))
    return raw.select(F.explode("c.entries").alias("id", "f")).select("id", "f.*")


def overlaid(entries: DataFrame, overlay: DataFrame) -> DataFrame:
    """Entries with the overlay's fields; an overlay row without its entry is an error."""
    o = overlay.select("id", *(F.col(c).alias(f"o_{c}") for c in ("resident_units", "miss_penalty_tokens", "locator", "scope")), F.lit(True).alias("o_has"))
    j = checked(entries.withColumn("e_has", F.lit(True)).join(o, "id", "full_outer"), F.col("e_has").isNotNull(), "the catalog names an unknown entry")
    pick = {c: F.coalesce(f"o_{c}", c) if c in entries.columns else F.col(f"o_{c}") for c in ("resident_units", "miss_penalty_tokens", "locator", "scope")}
    return j.withColumns(pick).drop("e_has", "o_has", *(f"o_{c}" for c in pick))


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a version-2 index file, with the file's revision."""
    raw = spark.read.schema(f"version int, revision bigint, entries array<struct<{_struct(ENTRY)}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return checked(raw, F.col("version") == 2, "not a version 2 index").select("revision", F.explode("entries").alias("e")).select("revision", "e.*")


def _struct(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">").replace("key:", "`key`:", 1)


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes, first): each file's size and first line that isn't blank, up to 100 characters."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(root)
    lines = F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "")
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.left(F.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), F.lit(100)).alias("first"))


def _turn_list(col: str) -> Column:
    return F.from_json(col, "array<struct<dia_id:string,speaker:string,text:string>>")


def sessions_file(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """Turns of a conversation file whose sessions are the keys ``session_<n>``; questions and answers are never read."""
    raw = spark.read.schema("sample_id string, conversation string").option("multiLine", True).json(path)
    pairs = raw.select("sample_id", F.explode(F.from_json("conversation", "map<string,string>")).alias("k", "v"))
    dates = pairs.filter(F.col("k").rlike(r"^session_\d+_date_time$")).select("sample_id", F.regexp_extract("k", r"^(session_\d+)", 1).alias("session"), F.col("v").alias("timestamp"))
    turns = pairs.filter(F.col("k").rlike(r"^session_\d+$")).select("sample_id", F.col("k").alias("session"), F.posexplode(_turn_list("v")).alias("ord", "t"))
    return turns.join(dates, ["sample_id", "session"], "left").select(
        F.concat_ws("/", "sample_id", "t.dia_id").alias("id"), F.lit(scope).alias("scope"), F.concat_ws("/", "sample_id", "session").alias("session"), "ord", F.col("t.text").alias("text"),
        F.col("t.speaker").alias("speaker"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("sample_id").alias("source"), F.lit("T1").alias("tier"),
    )


def session_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(id, scope, question, gold, malformed, category, diagnostic) of a conversation file: gold are the turns it names as evidence."""
    from ..functions.text import evidence_ids

    raw = spark.read.schema("sample_id string, qa array<struct<question:string,evidence:array<string>,category:int,answer:string>>").option("multiLine", True).json(path)
    q = raw.select("sample_id", F.posexplode("qa").alias("n", "q")).withColumn("e", evidence_ids(F.array_join("q.evidence", " ")))
    gold = F.transform("e.ids", lambda x: F.concat_ws("/", "sample_id", x))
    return q.select(
        F.concat_ws("?", "sample_id", F.col("n").cast("string")).alias("id"), F.col("sample_id").alias("scope"), F.col("q.question").alias("question"), gold.alias("gold"),
        F.col("e.malformed").alias("malformed"), F.col("q.category").alias("category"), (F.col("q.category") == 5).alias("diagnostic"),
    )


def haystack_file(spark: SparkSession, path: str, own_sessions: bool = False) -> DataFrame:
    """Turns of session haystacks, one scope per question; a session listed twice gets its place in its name.

    With ``own_sessions`` every turn is a session of its own, so that none has a neighbour.
    """
    schema = "question_id string, question string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    s = raw.select("question_id", F.posexplode(F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_sessions").alias("turns"))).alias("i", "z"))
    seen = Window.partitionBy("question_id", "z.sid").orderBy("i")
    s = s.withColumn("again", F.row_number().over(seen) - 1).withColumn("session", F.when(F.col("again") > 0, F.format_string("%s~%d#%d", "z.sid", "i", "again")).otherwise(F.col("z.sid")))
    t = s.select("question_id", "session", F.posexplode("z.turns").alias("ord", "t"))
    name = F.concat_ws("#", "session", F.col("ord").cast("string"))
    place, ord_ = (name, F.lit(0)) if own_sessions else (F.col("session"), F.col("ord"))
    return t.select(
        name.alias("id"), F.col("question_id").alias("scope"), place.alias("session"), ord_.alias("ord"), F.concat_ws(": ", "t.role", "t.content").alias("text"),
        F.col("t.role").alias("speaker"), F.lit("").alias("timestamp"), F.col("session").alias("source"), F.lit("T1").alias("tier"),
    )


def trajectories_file(spark: SparkSession, path: str) -> DataFrame:
    """States of trajectories: address, page text and action as one document each."""
    schema = "id string, trajectories array<struct<id:string,goal:string,start_url:string,states:array<struct<url:string,accessibility_tree:string,action:string>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("id").alias("scope"), F.explode("trajectories").alias("j"))
    s = raw.select("scope", "j.id", F.posexplode("j.states").alias("ord", "s"))
    text = F.concat_ws("\n", "s.url", "s.accessibility_tree", "s.action")
    return s.select(F.concat_ws("#", "id", F.col("ord").cast("string")).alias("id"), "scope", F.col("id").alias("session"), "ord", text.alias("text"), F.lit("").alias("speaker"), F.lit("").alias("timestamp"), F.col("s.url").alias("source"), F.lit("T1").alias("tier"))


def batched_chat_file(spark: SparkSession, path: str) -> DataFrame:
    """Turns of batched chats in one running order."""
    raw = spark.read.schema("id string, chat array<struct<turns:array<array<struct<role:string,content:string>>>>>").option("multiLine", True).json(path)
    t = raw.select("id", F.posexplode(F.flatten(F.flatten(F.transform("chat", lambda c: c["turns"])))).alias("ord", "t"))
    return t.select(F.concat_ws(":", "id", F.col("ord").cast("string")).alias("id"), F.col("id").alias("scope"), F.col("id").alias("session"), "ord", F.concat_ws(": ", "t.role", "t.content").alias("text"), F.col("t.role").alias("speaker"), F.lit("").alias("timestamp"), F.col("id").alias("source"), F.lit("T1").alias("tier"))


def subtasks_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, n, question, answer, background) of multi-session subtasks, in order."""
    raw = spark.read.schema("id string, questions array<string>, answers array<string>, backgrounds array<string>").option("multiLine", True).json(path)
    z = F.arrays_zip(F.col("questions").alias("question"), F.col("answers").alias("answer"), F.col("backgrounds").alias("background"))
    return raw.select("id", F.posexplode(z).alias("n", "z")).select("id", "n", "z.question", "z.answer", "z.background")


def use_chronology(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, event_id, id): hits of active entries whose text is known, in order; a repeated event id is an error."""
    hits = entries.filter("status = 'active'").join(texts.select("id").distinct(), "id", "left_semi").select("id", F.explode("events").alias("e")).filter("e.type = 'hit'").select("e.t", "e.event_id", "id")
    once = F.count("*").over(Window.partitionBy("event_id")) == 1
    return checked(hits.withColumn("once", once), F.col("once"), "duplicate event id").select("t", "event_id", "id").orderBy("t", "event_id")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1, however the files are split.

    A split counts its own lines where it is read; the lines of the splits before it are added, a row for each split.
    """
    from . import scratch

    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = scratch.written(raw, "lines")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("file", "block", "first", before.alias("before"))
    return rows.join(placed, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


_COMMON = ["event_id", "task_id", "kind", "item_id", "extra_tokens", "extra_tool_calls", "extra_latency_ms", "extra_cost_usd", "avoidable"]
# The ways of a prefetch.
PREFETCH_MODES = ["locator", "tiny_excerpt"]


def telemetry_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a log with one JSON object a line (with file and line), and (file, line, error) of all lines that are none.

    Blank lines are skipped. An error is broken JSON, a field that its kind doesn't have or that has another type, a missing or
    negative value, an unknown kind or mode, and each event whose id an earlier line has already.
    """
    from ..operators.telemetry import KINDS

    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    kinds = T.StructType.fromDDL(TELEMETRY)
    parsed = lines.withColumn("keys", F.json_object_keys("value")).withColumn("e", F.from_json("value", TELEMETRY, {"mode": "PERMISSIVE"}))
    prefetch = F.col("e.kind") == "prefetch"
    allowed = F.when(prefetch, F.array(*map(F.lit, kinds.names))).otherwise(F.array(*map(F.lit, _COMMON)))
    given = {f.name: F.coalesce(F.get_json_object("value", f"$.{f.name}"), F.lit("null")) != "null" for f in kinds.fields}
    # A value that isn't of its field's type is read as null; a number or truth value in quotes counts as text.
    quoted = [F.col("value").rlike(rf'"{f.name}"\s*:\s*"') for f in kinds.fields if f.dataType.simpleString() != "string"]
    bare = [F.col("value").rlike(rf'"{f.name}"\s*:\s*[^"\sn]') for f in kinds.fields if f.dataType.simpleString() == "string"]
    mistyped = [given[f.name] & F.col(f"e.{f.name}").isNull() for f in kinds.fields] + quoted + bare
    numbers = [f.name for f in kinds.fields if f.dataType.simpleString() in ("bigint", "double") and f.name != "confidence"]
    blank = lambda c: F.trim(F.coalesce(F.col(f"e.{c}"), F.lit(""))) == ""

    def any_of(conditions: list[Column]) -> Column:
        out = F.lit(False)
        for c in conditions:
            out |= F.coalesce(c, F.lit(False))
        return out

    error = (
        F.when(F.col("keys").isNull(), "expected object")
        .when(F.size(F.array_except("keys", allowed)) > 0, F.concat(F.lit("unsupported field "), F.array_min(F.array_except("keys", allowed))))
        .when(any_of(mistyped), "a field has another type")
        .when(blank("event_id") | blank("task_id") | blank("kind"), "event_id, task_id and kind are needed")
        .when(~F.col("e.kind").isin(*KINDS), "unsupported kind")
        .when(blank("item_id") & ~((F.col("e.kind") == "stale_resident_failure") & F.col("e.item_id").isNull()), "item_id is needed")
        .when(any_of([F.col(f"e.{c}") < 0 for c in numbers]), "a cost is negative")
        .when(prefetch & F.col("e.used").isNull(), "prefetch events need used")
        .when(prefetch & ~F.coalesce("e.mode", F.lit("locator")).isin(*PREFETCH_MODES), "unsupported mode")
        .when(any_of([~F.col("e.confidence").between(0.0, 1.0)]), "confidence is a share")
    )
    from . import scratch

    judged = scratch.written(parsed.select("file", "line", "e", error.alias("error")), "judged")
    # Ids are rarely repeated: only those that are meet their lines again.
    again = judged.filter("error IS NULL").groupBy(F.col("e.event_id").alias("event_id")).agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("first")).filter("n > 1")
    marked = judged.withColumn("event_id", F.col("e.event_id")).join(again.select("event_id", "first"), "event_id", "left")
    late = F.col("error").isNull() & (F.struct("file", "line") > F.col("first"))
    marked = marked.withColumn("error", F.when(late, F.concat(F.lit("duplicate event_id "), F.col("event_id"))).otherwise(F.col("error")))
    zero = {c: F.coalesce(c, F.lit(0)) for c in numbers if not c.startswith("avoided")} | {"avoidable": F.coalesce("avoidable", F.lit(False))}
    zero |= {c: F.when(F.col("kind") == "prefetch", F.coalesce(c, F.lit(0))) for c in numbers if c.startswith("avoided")} | {"mode": F.when(F.col("kind") == "prefetch", F.coalesce("mode", F.lit("locator")))}
    events = marked.filter("error IS NULL").select("file", "line", "e.*").withColumns(zero)
    return events, marked.filter("error IS NOT NULL").select("file", "line", "error")
