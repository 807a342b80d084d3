"""Stored JSON as rows: nested forecast payloads, messages with their tool calls, routers' and judges' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Readings of an hour in a forecast payload: name, path, type.
_READINGS = (
    ("temp", "$.temp", "double"), ("humidity", "$.humidity", "int"), ("dew_point", "$.dew_point", "double"), ("pressure", "$.pressure", "int"), ("clouds", "$.clouds", "int"), ("wind_deg", "$.wind_deg", "int"),
    ("wind_speed", "$.wind_speed", "double"), ("wind_gust", "$.wind_gust", "double"), ("visibility", "$.visibility", "int"), ("pop", "$.pop", "double"), ("uvi", "$.uvi", "double"), ("rain_1h", "$.rain['1h']", "double"), ("weather_main", "$.weather[0].main", "string"),
)


def document(text: str | Column) -> Column:
    """A text as a VARIANT, null where it is no JSON: fields are then taken by path and type, so a payload that gains, loses or
    retypes fields needs no new schema."""
    return F.try_parse_json(text)


def shape(df: DataFrame, text_col: str) -> DataFrame:
    """The one schema that all documents of a column fit, and how many texts are none: (schema, n, n_broken)."""
    parsed = df.select(F.col(text_col).isNotNull().alias("there"), document(text_col).alias("v"))
    return parsed.agg(F.schema_of_variant_agg("v").alias("schema"), F.count("v").alias("n"), F.count_if(F.col("there") & F.col("v").isNull()).alias("n_broken"))


def hours(payloads: DataFrame, text_col: str = "payload", keep: tuple[str, ...] = ("ward_id",)) -> DataFrame:
    """(keep, data_kind, ts_utc, readings) of the current and hourly parts of each payload.

    Absent parts and readings, and values that do not fit, are null or missing, absent rain is 0, an empty list of conditions gives
    none, and a text that is no JSON gives no rows.
    """
    parsed = payloads.select(*keep, document(text_col).alias("v"))
    part = lambda v, path, kind: F.try_variant_get(v, path, kind)
    current, hourly = part("v", "$.current", "variant"), part("v", "$.hourly", "array<variant>")
    tagged = F.concat(
        F.when(current.isNotNull(), F.array(F.struct(F.lit("current").alias("kind"), current.alias("h")))).otherwise(F.array()),
        F.transform(F.coalesce(hourly, F.array().cast("array<variant>")), lambda h: F.struct(F.lit("forecast").alias("kind"), h.alias("h"))),
    )
    rows = parsed.select(*keep, F.explode(tagged).alias("r")).withColumn("dt", part("r.h", "$.dt", "bigint")).where("dt IS NOT NULL")
    readings = {name: part("r.h", path, kind) for name, path, kind in _READINGS}
    readings["rain_1h"] = F.coalesce(readings["rain_1h"], F.lit(0.0))
    return rows.select(*keep, F.col("r.kind").alias("data_kind"), F.timestamp_seconds("dt").alias("ts_utc"), *[value.alias(name) for name, value in readings.items()])


def tool_calls(answers: DataFrame, text_col: str = "messages", keep: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """(keep, place, id, name, args, output, success) of each call in stored messages, in order.

    A call is a part of an assistant's message; its output is the tool message with its id, and a call without one, or
    whose output says `error`, has not succeeded. A text that is no list of messages has no calls.
    """
    part = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    parsed = answers.select(*keep, part(document(text_col), "$", "array<variant>").alias("m"))
    calls = F.flatten(F.transform("m", lambda m: F.coalesce(part(m, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))))
    said = F.filter("m", lambda m: (part(m, "$.role") == "tool") & part(m, "$.tool_call_id").isNotNull())
    outputs = F.map_from_entries(F.transform(said, lambda m: F.struct(part(m, "$.tool_call_id"), part(m, "$.content"))))
    rows = parsed.withColumn("o", outputs).select(*keep, "o", F.posexplode(calls).alias("place", "c"))
    output = F.element_at("o", part("c", "$.id"))
    return rows.select(*keep, "place", part("c", "$.id").alias("id"), part("c", "$.name").alias("name"), part("c", "$.args", "map<string,string>").alias("args"), output.alias("output"), F.coalesce(~F.lower(output).contains("error"), F.lit(False)).alias("success"))


def first_object(text: Column) -> Column:
    """The first {...} in a text without inner braces, else null."""
    found = F.regexp_extract(text, r"(\{[^{}]*\})", 1)
    return F.when(found != "", found)


def routed(answers: DataFrame, text_col: str = "raw") -> DataFrame:
    """`answers` with the router's intent, scope and confidence: the text as JSON, else the first object in it; confidence from 0.01 to 0.99, 0.9 where none is given."""
    shape = "intent STRING, scope STRING, confidence DOUBLE"
    bare = F.regexp_replace(F.regexp_replace(text_col, r"(?s)<think>.*?</think>", ""), "```(json)?", "")
    parsed = F.coalesce(*[F.when(F.from_json(t, shape)["intent"].isNotNull(), F.from_json(t, shape)) for t in (bare, first_object(bare))])
    sure = F.greatest(F.least(F.coalesce(F.col("__r.confidence"), F.lit(0.9)), F.lit(0.99)), F.lit(0.01))
    out = answers.withColumn("__r", parsed)
    return out.withColumns({"intent": F.col("__r.intent"), "scope": F.col("__r.scope"), "confidence": F.when(F.col("__r.intent").isNotNull(), sure)}).drop("__r")


def judged(answers: DataFrame, text_col: str = "raw") -> DataFrame:
    """`answers` with a judge's score of 1 to 5 from JSON, fenced or in a sentence; any other is null."""
    bare = F.regexp_replace(text_col, "```(json)?", "")
    score = F.coalesce(F.from_json(bare, "score INT")["score"], F.from_json(first_object(bare), "score INT")["score"])
    return answers.withColumn("score", F.when(score.between(1, 5), score))
