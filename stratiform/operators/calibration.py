"""Calibration of a classifier of fifteen intents from what it said and how sure it was: temperature, errors, thresholds, gate.

A prediction is `pred` with a confidence, and `gt` is right. Logits are approximated from the confidence: the predicted class has
its log odds, the others share the rest. All that depends on the temperature depends on few numbers of a row, so rows are
counted by these once, and every later step works on the counts.

The temperature is fitted by bracketing. The slope of the likelihood changes its sign once between the bounds; a round is one
aggregate over the counts that takes the slope's sign at `POINTS` places within the bracket, and the two places between which it
changes are the next bracket. After `ROUNDS` rounds it is narrower than 1e-7.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.registry import query
from stratiform.sources.roles import table

# The classes in order, the bounds of the temperature, bins, and what thresholds are clamped to.
INTENTS = (
    "current_weather", "hourly_forecast", "daily_forecast", "weather_overview", "rain_query", "temperature_query", "wind_query", "humidity_fog_query", "historical_weather",
    "location_comparison", "activity_weather", "expert_weather_param", "weather_alert", "seasonal_context", "smalltalk_weather",
)
BOUNDS, BINS, TARGET = (0.1, 10.0), 15, 0.9
DEFAULT, LEAST, LEAST_OF, MOST = 0.65, 0.45, {"weather_alert": 0.30}, 0.85
LEAST_ROWS, LEAST_CUT = 5, 3
POINTS, ROUNDS = 15, 7
N = len(INTENTS)


def clipped(confidence: Column) -> Column:
    return F.greatest(F.least(confidence, F.lit(0.99)), F.lit(0.01))


def _odds(c: Column) -> tuple[Column, Column]:
    """The logits of the predicted class and of any other."""
    rest = (1 - c) / (N - 1)
    return F.log(c / (1 - c)), F.log(rest / (1 - rest + 1e-8))


def logits(rows: DataFrame) -> DataFrame:
    """`rows` (pred, conf) with `logits`, one of each class in order; an unknown class has none of its own."""
    own, other = _odds(clipped(F.col("conf")))
    return rows.withColumn("logits", F.transform(F.array(*map(F.lit, INTENTS)), lambda c: F.when(c == F.col("pred"), own).otherwise(other)))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits, which are taken down by their greatest first."""
    top = F.array_max(values)
    powers = F.transform(values, lambda z: F.exp((z - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def counted(rows: DataFrame) -> DataFrame:
    """(pred, own, other, known, hit, top, conf, n): rows (gt, pred, conf) of a known right class, counted by what matters.

    `hit` tells whether the prediction is right, `top` whether the class of the greatest logit is: for a very low confidence that
    is the first of the other classes.
    """
    own, other = _odds(F.col("conf"))
    known = F.col("pred").isin(*INTENTS)
    first = F.when(known & (own >= other), F.col("pred")).when(F.col("pred") == INTENTS[0], INTENTS[1]).otherwise(INTENTS[0])
    good = rows.where(F.col("gt").isin(*INTENTS)).select("gt", F.coalesce("pred", F.lit("")).alias("pred"), clipped(F.coalesce("conf", F.lit(0.9))).alias("conf"))
    each = good.withColumns({"known": known, "hit": F.col("pred") == F.col("gt"), "top": first == F.col("gt")})
    return each.groupBy("pred", "conf", "known", "hit", "top").agg(F.count(F.lit(1)).alias("n")).withColumns({"own": F.when(F.col("known"), own).otherwise(other), "other": other})


def _shares(t: Column) -> tuple[Column, Column, Column]:
    """(power of the predicted class, of any other, their sum over all classes) at temperature t."""
    top = F.greatest("own", "other")
    own, other = F.exp((F.col("own") - top) / t), F.exp((F.col("other") - top) / t)
    return own, other, own + (N - 1) * other


def slope(t: Column) -> Column:
    """The sum over rows of the right class's logit less the expected one; it grows with t, and where it is 0 the likelihood is
    greatest."""
    own, other, total = _shares(t)
    right = F.when(F.col("hit"), F.col("own")).otherwise(F.col("other"))
    return F.sum(F.col("n") * (right - (own * F.col("own") + (N - 1) * other * F.col("other")) / total))


def fit(counts: DataFrame) -> float:
    """The temperature within BOUNDS of greatest likelihood; 1 where there are no rows."""
    lo, hi = BOUNDS
    for _ in range(ROUNDS):
        at = [lo + (hi - lo) * i / (POINTS + 1) for i in range(POINTS + 2)]
        signs = counts.agg(*[slope(F.lit(t)).alias(f"s{i}") for i, t in enumerate(at)]).first()
        if signs[0] is None:
            return 1.0
        below = [i for i, s in enumerate(signs) if s < 0]
        if not below or len(below) == len(at):
            return BOUNDS[0] if not below else BOUNDS[1]
        lo, hi = at[below[-1]], at[below[-1] + 1]
    return (lo + hi) / 2


def nll(t: float) -> Column:
    """The mean negative log likelihood at temperature t, of counts."""
    own, other, total = _shares(F.lit(t))
    return F.sum(-F.col("n") * F.log(F.greatest(F.when(F.col("hit"), own).otherwise(other) / total, F.lit(1e-10)))) / F.sum("n")


def bins(counts: DataFrame, t: float) -> DataFrame:
    """(bin, n, conf, accuracy): the greatest probability and how often its class is right, in BINS bins of equal width."""
    own, other, total = _shares(F.lit(t))
    rows = counts.withColumn("p", F.greatest(own, other) / total)
    return rows.groupBy(F.floor(F.col("p") * BINS + 1e-9).cast("int").alias("bin")).agg(
        F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("conf"), (F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )


def ece(found: DataFrame) -> Column:
    """The expected error of bins, as an aggregate over them."""
    return F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("conf"))) / F.sum("n")


def calibrated(confidence: Column, t: float) -> Column:
    """A confidence at temperature t; 0 and 1 stay."""
    inside = (confidence > 0) & (confidence < 1)
    return confidence if abs(t - 1) < 1e-3 else F.when(inside, 1 / (1 + F.exp(-F.log(confidence / (1 - confidence)) / t))).otherwise(confidence)


def thresholds(counts: DataFrame, t: float, target: float = TARGET) -> DataFrame:
    """(intent, threshold): for each class the least calibrated confidence from which its predictions are right often enough.

    Predictions of equal confidence are taken together. Too few predictions have the default; where no cut is good enough the
    greatest confidence counts; the result is clamped and cut to two digits downwards.
    """
    cells = counts.where("known").groupBy(F.col("pred").alias("intent"), calibrated(F.col("conf"), t).alias("c")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("k"))
    down = Window.partitionBy("intent").orderBy(F.desc("c"))
    seen = cells.withColumns({"upto": F.sum("n").over(down), "right": F.sum("k").over(down)})
    good = (F.col("right") >= target * F.col("upto") - 1e-9) & (F.col("upto") >= LEAST_CUT)
    cut = seen.groupBy("intent").agg(F.sum("n").alias("n"), F.coalesce(F.min(F.when(good, F.col("c"))), F.max("c")).alias("c"))
    least = F.coalesce(*[F.when(F.col("intent") == i, x) for i, x in LEAST_OF.items()], F.lit(LEAST))
    held = F.floor(F.least(F.greatest("c", least), F.lit(MOST)) * 100 + 1e-9) / 100
    every = counts.sparkSession.createDataFrame([(i,) for i in INTENTS], "intent string")
    return every.join(F.broadcast(cut), "intent", "left").select("intent", F.when(F.col("n") >= LEAST_ROWS, held).otherwise(DEFAULT).alias("threshold"))  # fifteen rows


def gate(rows: DataFrame, limits: DataFrame, t: float = 1.0, default: float = DEFAULT) -> DataFrame:
    """`rows` (pred, conf) with `route` (`routed` or `fallback`) and `reason`: whether the calibrated confidence reaches the class's
    threshold. A confidence that is missing counts as 0."""
    own = rows.join(F.broadcast(limits.withColumnRenamed("intent", "pred")), "pred", "left").withColumn("sure", calibrated(F.coalesce("conf", F.lit(0.0)), t))
    low = F.col("sure") < F.coalesce("threshold", F.lit(default))
    reason = F.when(~F.coalesce(F.col("pred").isin(*INTENTS), F.lit(False)), F.concat(F.lit("invalid_intent: "), F.coalesce("pred", F.lit("")))).when(low, F.concat(F.lit("low_confidence: "), F.format_string("%.2f", F.round("sure", 2))))
    return own.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNull(), "routed").otherwise("fallback")).drop("threshold")


def calibrate(rows: DataFrame, target: float = TARGET) -> tuple[float, DataFrame, DataFrame]:
    """(temperature, report, thresholds) of rows (gt, pred, conf). The report holds (section, name, value): the summary with the
    errors before and after, the thresholds, and both reliability diagrams."""
    counts = counted(rows).persist()
    t = fit(counts)
    limits = thresholds(counts, t, target)
    value = lambda df, section, **of: df.select(F.lit(section).alias("section"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in of.items()])).alias("x")).select("section", "x.*")
    parts = [value(counts.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"), nll(1.0).alias("b"), nll(t).alias("c")), "summary", temperature=F.lit(t), rows=F.col("n"), accuracy=F.col("a"), nll_before=F.col("b"), nll_after=F.col("c"))]
    for when, at in (("before", 1.0), ("after", t)):
        found = bins(counts, at)
        parts.append(value(found.agg(ece(found).alias("e")), "summary", **{f"ece_{when}": F.col("e")}))
        parts.append(found.select(F.lit(f"reliability_{when}").alias("section"), F.col("bin").cast("string").alias("name"), F.col("accuracy").alias("value")))
    parts.append(limits.select(F.lit("threshold").alias("section"), F.col("intent").alias("name"), F.col("threshold").alias("value")))
    return t, reduce(DataFrame.unionByName, parts), limits


# ---------------------------------------------------------------- the driver's events as predictions


def predictions(spark, sf_dir) -> DataFrame:
    """(event_id, gt, pred, conf): a prediction for each event. The more sure it is, the likelier it is right; some are of no class."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    names = F.array(*map(F.lit, INTENTS))
    own = (F.col("user_id") % N).cast("int")
    right = (n * 37) % 100 < 20 + k * 0.7
    gt = F.when(right, own).otherwise(((own + 1 + n % (N - 1)) % N).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.get(names, gt).alias("gt"), F.when(n % 97 == 0, "no_such_intent").otherwise(F.get(names, own)).alias("pred"), (k / F.lit(100.0)).alias("conf"))


_NAMES_SQL = "[" + ", ".join(f"'{i}'" for i in INTENTS) + "]"
_PREDICTIONS_SQL = f"""WITH p AS (SELECT event_id, {_NAMES_SQL}[CASE WHEN (event_id * 37) % 100 < 20 + k * 0.7::DOUBLE THEN user_id % {N} ELSE (user_id % {N} + 1 + event_id % {N - 1}) % {N} END + 1] AS gt,
  CASE WHEN event_id % 97 = 0 THEN 'no_such_intent' ELSE {_NAMES_SQL}[user_id % {N} + 1] END AS pred, k / 100.0::DOUBLE AS conf FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events)),
c AS (SELECT *, greatest(least(conf, 0.99::DOUBLE), 0.01::DOUBLE) AS q, (1 - greatest(least(conf, 0.99::DOUBLE), 0.01::DOUBLE)) / {N - 1} AS r FROM p),
z AS MATERIALIZED (SELECT event_id, gt, pred, q, list_contains({_NAMES_SQL}, pred) AS known, CASE WHEN list_contains({_NAMES_SQL}, pred) THEN ln(q / (1 - q)) ELSE ln(r / (1 - r + 1e-8)) END AS own, ln(r / (1 - r + 1e-8)) AS other FROM c)
"""
_EXPECTED = f"((exp((own - greatest(own, other)) / t) * own + {N - 1} * exp((other - greatest(own, other)) / t) * other) / (exp((own - greatest(own, other)) / t) + {N - 1} * exp((other - greatest(own, other)) / t)))"


def _fit_sql() -> str:
    """Bisection of the slope's sign, forty times."""
    parts = [f"cells AS MATERIALIZED (SELECT own, other, pred = gt AS hit, count(*) AS n FROM z GROUP BY ALL), b0 AS (SELECT {BOUNDS[0]}::DOUBLE AS lo, {BOUNDS[1]}::DOUBLE AS hi)"]
    for i in range(40):
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT CASE WHEN s < 0 THEN t ELSE lo END AS lo, CASE WHEN s < 0 THEN hi ELSE t END AS hi FROM (SELECT lo, hi, t, sum(n * (CASE WHEN hit THEN own ELSE other END - {_EXPECTED})) AS s FROM cells, (SELECT lo, hi, (lo + hi) / 2 AS t FROM b{i}) GROUP BY ALL))")
    return ", ".join(parts) + ", fitted AS MATERIALIZED (SELECT (lo + hi) / 2 AS t FROM b40)\n"


_FITTED_SQL = _PREDICTIONS_SQL + ", " + _fit_sql()
_TOTAL = f"(exp((own - greatest(own, other)) / t) + {N - 1} * exp((other - greatest(own, other)) / t))"
_NLL_SQL = f"avg(-ln(exp((CASE WHEN pred = gt THEN own ELSE other END - greatest(own, other)) / t) / {_TOTAL}))"
_TOP_SQL = f"(CASE WHEN known AND own >= other THEN pred WHEN pred = '{INTENTS[0]}' THEN '{INTENTS[1]}' ELSE '{INTENTS[0]}' END = gt)"
_REPORT_SQL = _FITTED_SQL + f""", ts AS (SELECT 'before' AS phase, 1.0::DOUBLE AS t UNION ALL SELECT 'after', t FROM fitted),
bin AS MATERIALIZED (SELECT phase, floor(p * {BINS} + 1e-9)::INT AS bin, count(*) AS n, avg(p) AS conf, avg(top::INT) AS accuracy FROM (SELECT phase, 1 / {_TOTAL} AS p, {_TOP_SQL} AS top FROM z, ts) GROUP BY ALL),
sure AS MATERIALIZED (SELECT event_id, pred, gt, known, CASE WHEN abs(t - 1) < 1e-3 THEN q ELSE 1 / (1 + exp(-ln(q / (1 - q)) / t)) END AS c FROM z, fitted),
cuts AS (SELECT pred, c, sum(count(*)) OVER w AS upto, sum(count(*) FILTER (WHERE pred = gt)) OVER w AS k FROM sure WHERE known GROUP BY pred, c WINDOW w AS (PARTITION BY pred ORDER BY c DESC)),
cut AS (SELECT pred, max(upto) AS n, coalesce(min(c) FILTER (WHERE k >= {TARGET} * upto - 1e-9 AND upto >= {LEAST_CUT}), max(c)) AS c FROM cuts GROUP BY pred),
limits AS MATERIALIZED (SELECT i AS intent, CASE WHEN n >= {LEAST_ROWS} THEN floor(least(greatest(c, CASE i WHEN 'weather_alert' THEN 0.30::DOUBLE ELSE 0.45::DOUBLE END), 0.85::DOUBLE) * 100 + 1e-9) / 100 ELSE 0.65::DOUBLE END AS threshold FROM (SELECT unnest({_NAMES_SQL}) AS i) LEFT JOIN cut ON pred = i)
"""


@query(_PREDICTIONS_SQL + f"SELECT event_id, round(own, 6) AS own_logit, round(other, 6) AS other_logit, round(CASE WHEN known THEN exp(own) / (exp(own) + {N - 1} * exp(other)) END, 6) AS p_own, CASE WHEN known AND own >= other THEN pred WHEN pred = '{INTENTS[0]}' THEN '{INTENTS[1]}' ELSE '{INTENTS[0]}' END AS likeliest FROM z")
def fn_softmax_logits(spark, sf_dir):
    """Fifteen logits and probabilities of each prediction, of which the row shows its own, another's and the likeliest class."""
    rows = logits(predictions(spark, sf_dir)).withColumn("p", softmax(F.col("logits")))
    at = F.array_position(F.array(*map(F.lit, INTENTS)), F.col("pred")).cast("int")
    known = at > 0
    other = F.get("logits", F.when(at == 1, 1).otherwise(0))
    own = F.when(known, F.get("logits", at - 1)).otherwise(other)
    likeliest = F.get(F.array(*map(F.lit, INTENTS)), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return rows.select("event_id", F.round(own, 6).alias("own_logit"), F.round(other, 6).alias("other_logit"), F.round(F.when(known, F.get("p", at - 1)), 6).alias("p_own"), likeliest.alias("likeliest"))


@query(_FITTED_SQL + f"SELECT round(t, 5) AS temperature, round({_NLL_SQL}, 7) AS nll FROM z, fitted GROUP BY t")
def fn_fit_temperature(spark, sf_dir):
    """The temperature of least negative log likelihood, within 1e-7."""
    counts = counted(predictions(spark, sf_dir)).persist()
    t = fit(counts)
    return counts.agg(F.round(F.lit(t), 5).alias("temperature"), F.round(nll(t), 7).alias("nll"))


@query(_REPORT_SQL + f"""SELECT 'summary' AS section, 'temperature' AS name, round(t, 5) AS value FROM fitted UNION ALL SELECT 'summary', 'rows', count(*) FROM z UNION ALL SELECT 'summary', 'accuracy', round(avg((pred = gt)::INT), 5) FROM z
UNION ALL SELECT 'summary', 'nll_' || phase, round({_NLL_SQL}, 5) FROM z, ts GROUP BY phase UNION ALL SELECT 'summary', 'ece_' || phase, round(sum(n * abs(accuracy - conf)) / sum(n), 5) FROM bin GROUP BY phase
UNION ALL SELECT 'threshold', intent, threshold FROM limits UNION ALL SELECT 'reliability_' || phase, bin::VARCHAR, round(accuracy, 5) FROM bin""")
def orch_calibration(spark, sf_dir):
    """The whole calibration of the events' predictions."""
    return calibrate(predictions(spark, sf_dir))[1].withColumn("value", F.round("value", 5))


@query(_REPORT_SQL + f"""SELECT s.event_id, CASE WHEN NOT s.known THEN 'invalid_intent: ' || s.pred WHEN s.c < threshold THEN 'low_confidence: ' || printf('%.2f', round(s.c, 2)) END AS reason,
CASE WHEN s.known AND s.c >= threshold THEN 'routed' ELSE 'fallback' END AS route FROM sure s LEFT JOIN limits ON intent = s.pred""")
def fn_route_gate(spark, sf_dir):
    """Each prediction against its class's threshold, both on the calibrated confidence."""
    rows = predictions(spark, sf_dir).withColumn("conf", clipped(F.col("conf")))
    t, _, limits = calibrate(rows)
    return gate(rows, limits, t).select("event_id", "reason", "route")
