"""Queries over JSON as it is stored in the tables, and over files of lines that are written from them, broken ones included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.operators import evaluation
from stratiform.registry import query
from stratiform.sources import files, lines, payload
from stratiform.sources.roles import shown, table
from stratiform.streaming.runs import scratch


@query("SELECT event_id, json_extract(props, '$.k')::INT AS k, json_extract_string(props, '$.weather[0].main') AS weather_main, coalesce(json_extract(props, '$.rain.1h')::DOUBLE, 0) AS rain_1h, CASE WHEN json_valid(props) THEN 'json' ELSE 'broken' END AS status FROM events")
def js_parse_payload(spark, sf_dir):
    """Fields of each event's payload by path and type; those that it lacks are null, or 0 for rain."""
    v = payload.document("props")
    got = lambda path, kind: F.try_variant_get(v, path, kind)
    status = F.when(v.isNotNull(), "json").otherwise("broken")
    return table(spark, sf_dir, "events").select("event_id", got("$.k", "int").alias("k"), got("$.weather[0].main", "string").alias("weather_main"), F.coalesce(got("$.rain['1h']", "double"), F.lit(0.0)).alias("rain_1h"), status.alias("status"))


@query("SELECT 'OBJECT<' || (SELECT string_agg(k || ': BIGINT', ', ' ORDER BY k) FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events)) || '>' AS schema, count(*) FILTER (WHERE json_valid(props)) AS n, count(*) FILTER (WHERE NOT json_valid(props)) AS n_broken FROM events")
def js_payload_shape(spark, sf_dir):
    """The schema that all payloads fit, found in one aggregate."""
    return payload.shape(table(spark, sf_dir, "events"), "props")


@query("SELECT event_id, greatest(least(json_extract(props, '$.k')::INT / 100.0::DOUBLE, 0.99), 0.01)::DOUBLE AS conf FROM events")
def js_conf_from_raw(spark, sf_dir):
    """A confidence from the first object in a text, 0.9 where there is none, held within 0.01 and 0.99."""
    raw = F.try_variant_get(payload.document(payload.first_object(F.col("props"))), "$.k", "double") / 100
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.least(F.coalesce(raw, F.lit(0.9)), F.lit(0.99)), F.lit(0.01)).alias("conf"))


@query("""SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY role <> 'system', turn) AS roles, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY role <> 'system', turn)) AS content_sha256 FROM conversations GROUP BY conv_id""")
def js_messages(spark, sf_dir):
    """The messages of each conversation, the system's first and the others in order of turns."""
    message = F.struct((F.col("role") != "system").alias("later"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))  # a conversation's messages
    return packed.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join("m.role", ",").alias("roles"), F.sha2(F.array_join("m.text", "\n"), 256).alias("content_sha256"))


_FOUND = r"regexp_extract(text, '(\{[^{}]*\})', 1)"
_SCORE = f"CASE WHEN json_valid({_FOUND}) THEN TRY_CAST(json_extract_string({_FOUND}, '$.score') AS INT) END"


@query(f"""SELECT conv_id, turn, CASE WHEN s BETWEEN 1 AND 5 THEN s END AS score, CASE WHEN s BETWEEN 1 AND 5 THEN 'scored' WHEN f = '' THEN 'no_json' ELSE 'unusable' END AS status FROM (SELECT conv_id, turn, {_SCORE} AS s, {_FOUND} AS f FROM conversations WHERE role = 'assistant')""")
def js_parse_judge(spark, sf_dir):
    """A judge's score in each answer as it is stored: free text without an object has none."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    found = payload.first_object(F.col("text"))
    score = F.try_variant_get(payload.document(found), "$.score", "int")
    good = score.between(1, 5)
    return rows.select("conv_id", "turn", F.when(good, score).alias("score"), F.when(good, "scored").when(found.isNull(), "no_json").otherwise("unusable").alias("status"))


@query("""SELECT conv_id, count(*) AS n_texts, count(*) FILTER (WHERE json_type(CASE WHEN json_valid(text) THEN text END) = 'ARRAY') AS n_lists, coalesce(sum(len(json_extract_string(CASE WHEN json_valid(text) THEN text END, '$[*].tool_calls[*].name'))), 0)::BIGINT AS n_calls FROM conversations GROUP BY conv_id""")
def js_extract_tool_calls(spark, sf_dir):
    """The calls in each conversation's stored texts: those that are lists of messages are read, others have none."""
    rows = table(spark, sf_dir, "conversations")
    listed = F.try_variant_get(payload.document("text"), "$", "array<variant>").isNotNull()
    calls = payload.tool_calls(rows, "text", ("conv_id",)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_calls"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(listed).alias("n_lists")).join(calls, "conv_id", "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0)))


def _tally(reads: dict[str, lines.Read]) -> DataFrame:
    """(file, status, n): what each kind of file has of good, blank and broken lines."""
    parts = [r.rows.select(F.lit(name).alias("file"), F.lit("good").alias("status")).union(r.rejects.select(F.lit(name), "status")) for name, r in reads.items()]
    return reduce(DataFrame.union, parts).groupBy("file", "status").agg(F.count(F.lit(1)).alias("n"))


_BROKEN = "CASE WHEN event_id % 50 = 0 THEN 'broken' WHEN event_id % 75 = 1 THEN 'blank' ELSE 'good' END"


@query(f"SELECT 'events' AS file, {_BROKEN} AS status, count(*) AS n FROM events GROUP BY 2")
def src_jsonl_tolerant(spark, sf_dir):
    """The events as JSON lines, some cut off and some blank, read with a reject channel: nothing is lost."""
    out = f"{scratch(spark)}/lines"
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    cut = F.when(F.col("event_id") % 50 == 0, F.left(line, F.length(line) - 3)).when(F.col("event_id") % 75 == 1, "  ").otherwise(line)
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(out)
    return _tally({"events": lines.json_lines(spark, out, "event_id long, user_id long, event_type string, value double")})


@query(f"""SELECT 'conversations' AS file, {_BROKEN} AS status, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 2
UNION ALL SELECT 'tool_calls', {_BROKEN}, count(*) FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 2""")
def src_telemetry_read(spark, sf_dir):
    """Two logs as CSV written from the events, with lines that lack columns or hold what does not fit."""
    out = scratch(spark)
    events = table(spark, sf_dir, "events").withColumn("at", shown("ts")).withColumn("who", F.concat(F.lit('"user, '), F.col("user_id").cast("string"), F.lit('"')))
    n = F.col("event_id")
    for name, where, rest in (("conversations", "event_type IN ('click', 'view')", F.concat_ws(",", "who", F.lit('"said ""yes"""'), "event_type", "value")), ("tool_calls", "event_type NOT IN ('click', 'view')", F.concat_ws(",", "who", "event_type", (n % 2 == 0).cast("string"), "value"))):
        line = F.concat_ws(",", F.when(n % 100 == 0, "long ago").otherwise(F.col("at")), rest)
        line = F.when(n % 100 == 50, F.col("at")).when(n % 75 == 1, " ").otherwise(line)
        events.where(where).select(line.alias("value")).write.text(f"{out}/{name}")
    logs = [lines.csv_lines(spark, f"{out}/{name}", schema) for name, schema in (("conversations", lines.CONVERSATION_LOG), ("tool_calls", lines.TOOL_LOG))]
    return _tally(dict(zip(("conversations", "tool_calls"), logs, strict=True)))


@query(evaluation._ROWS + """, r AS (SELECT config, count(*) AS n, avg(score) AS mean_score FROM rows GROUP BY config)
SELECT unnest(['# Scores', '', '| config | n | mean_score |', '|---|---|---|']) AS line UNION ALL SELECT '| ' || config || ' | ' || n || ' | ' || printf('%.4f', round(mean_score + 1e-9, 4)) || ' |' FROM r""")
def sink_json_md_report(spark, sf_dir):
    """The lines of a written report."""
    scores = evaluation.agg_eval_config(spark, sf_dir).select("config", "n", "mean_score").orderBy("config")
    out = f"{scratch(spark)}/report"
    files.report(scores, out, "Scores")
    return spark.read.text(f"{out}-markdown").withColumnRenamed("value", "line")


@query("SELECT event_type AS model, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS n_ok, round(avg(CASE WHEN event_id % 10 = 0 THEN 0 ELSE json_extract(props, '$.k')::INT / 100.0::DOUBLE END), 6) AS mean_conf FROM events GROUP BY event_type")
def src_calib_csv(spark, sf_dir):
    """A classifier's samples written from the events as CSV and read: an empty confidence is 0."""
    out, n = f"{scratch(spark)}/samples", F.col("event_id")
    conf = F.when(n % 10 == 0, "").otherwise((F.get_json_object("props", "$.k").cast("int") / 100).cast("string"))
    line = F.concat_ws(",", "event_type", F.lit("a"), F.lit("b"), conf, F.when(n % 3 == 0, F.when(n % 2 == 0, "True").otherwise("true")).otherwise("False"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(out)
    return lines.samples(spark, out).rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.round(F.avg("conf"), 6).alias("mean_conf"))
