"""Evaluation analytics over prediction rows: accuracy, calibration, thresholds, paired tests and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratiform.functions import stats
from stratiform.registry import query
from stratiform.sources.roles import rounded, table

#: A prediction row for each labelled document: what was wanted, what was said, and how sure.
_ROWS = """WITH rows AS (SELECT l.doc_id, d.lang AS intent, d.source AS config, l.quality = 1 AS ok, CASE WHEN l.quality = 1 THEN d.lang ELSE 'xx' END AS predicted,
  (50 + d.n_chars % 50) / 100.0::DOUBLE AS conf, (1 + d.n_chars % 5)::INT AS score, d.n_chars AS latency, CASE WHEN d.n_chars < 500 THEN 'easy' WHEN d.n_chars < 2000 THEN 'medium' ELSE 'hard' END AS difficulty
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
"""


def rows(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    n, ok = F.col("n_chars"), F.col("quality") == 1
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", F.col("lang").alias("intent"), F.col("source").alias("config"), ok.alias("ok"), F.when(ok, F.col("lang")).otherwise("xx").alias("predicted"),
        ((50 + n % 50) / F.lit(100.0)).alias("conf"), (1 + n % 5).cast("int").alias("score"), n.alias("latency"), F.when(n < 500, "easy").when(n < 2000, "medium").otherwise("hard").alias("difficulty"),
    )


_WILSON = """CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, (k / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) * 100 + 1e-9, 1) END AS low,
  CASE WHEN n = 0 THEN 0.0 ELSE round(least(1.0, (k / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) * 100 + 1e-9, 1) END AS high"""


@query(_ROWS + f"SELECT intent, n, k, {_WILSON} FROM (SELECT intent, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM rows GROUP BY intent)")
def fn_wilson_ci(spark, sf_dir):
    counts = rows(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("intent", "n", "k", low.alias("low"), high.alias("high"))


@query(_ROWS + """, h AS (SELECT config, string_agg(score || ':' || n, ',' ORDER BY score) AS distribution FROM (SELECT config, score, count(*) AS n FROM rows GROUP BY ALL) GROUP BY config)
SELECT config, count(*) AS n, round(avg(score) + 1e-9, 4) AS mean_score, list_sort(list(score))[count(*) // 2 + 1] AS median_score, count(*) FILTER (WHERE score = 5) AS n_five, any_value(distribution) AS distribution,
  round(avg(latency % 4000) + 1e-9, 1) AS avg_input_tokens, round(avg(latency % 250) + 1e-9, 1) AS avg_output_tokens, round(avg(latency) + 1e-9, 1) AS mean_latency FROM rows JOIN h USING (config) GROUP BY config""")
def agg_eval_config(spark, sf_dir):
    """Scores have five values: their distribution is a counted map, and the upper median comes from running counts of it. Tokens,
    which the tables do not have, are read off the length."""
    by = rows(spark, sf_dir).groupBy("config", "score").agg(F.count(F.lit(1)).alias("c"), F.sum("latency").alias("l"), F.sum(F.col("latency") % 4000).alias("i"), F.sum(F.col("latency") % 250).alias("o"))
    running = F.sum("c").over(Window.partitionBy("config").orderBy("score"))
    total = F.sum("c").over(Window.partitionBy("config"))
    seen = by.withColumns({"upto": running, "total": total})
    cell = F.struct("score", F.concat_ws(":", F.col("score").cast("string"), F.col("c").cast("string")).alias("cell"))
    mean = lambda c: rounded(F.sum(c) / F.sum("c"), 1)
    return seen.groupBy("config").agg(
        F.sum("c").alias("n"), rounded(F.sum(F.col("score") * F.col("c")) / F.sum("c"), 4).alias("mean_score"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("score"))).alias("median_score"),
        F.coalesce(F.sum(F.when(F.col("score") == 5, F.col("c"))), F.lit(0)).alias("n_five"), F.array_join(F.sort_array(F.collect_list(cell))["cell"], ",").alias("distribution"),
        mean("i").alias("avg_input_tokens"), mean("o").alias("avg_output_tokens"), mean("l").alias("mean_latency"),
    )


_GROUPED = _ROWS + ", g AS (SELECT unnest(['all', 'intent', 'difficulty']) AS dimension, unnest(['all', intent, difficulty]) AS value, * FROM rows)\n"


@query(_GROUPED + f"""SELECT dimension, value, n, round(k * 100.0::DOUBLE / n + 1e-9, 1) AS accuracy, {_WILSON}, mean_latency, s[(floor(len(s) * 0.5) + 1)::INT] AS p50, s[(floor(len(s) * 0.9) + 1)::INT] AS p90, s[(floor(len(s) * 0.95) + 1)::INT] AS p95, faithfulness, n_judged
FROM (SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE ok) AS k, round(avg(latency) + 1e-9, 0) AS mean_latency, list_sort(list(latency)) AS s, round(avg(score) FILTER (WHERE intent <> 'en') + 1e-9, 2) AS faithfulness, count(score) FILTER (WHERE intent <> 'en') AS n_judged FROM g GROUP BY dimension, value)""")
def agg_eval_metrics(spark, sf_dir):
    """Accuracy with its interval, latency and its percentiles by index, and judged scores: of all rows, by intent and by difficulty.

    Small talk, for which one language stands here, is not judged. Rows are counted by latency first; percentiles come from running counts.
    """
    pair = lambda name: F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value"))
    groups = F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), pair("intent"), pair("difficulty"))).alias("g")
    judged = F.when(F.col("intent") != "en", F.col("score"))
    by = rows(spark, sf_dir).select("ok", "latency", judged.alias("judged"), groups).groupBy("g.dimension", "g.value", "latency").agg(F.count(F.lit(1)).alias("c"), F.count_if("ok").alias("h"), F.sum("judged").alias("s"), F.count("judged").alias("j"))
    own = Window.partitionBy("dimension", "value")
    seen = by.withColumns({"upto": F.sum("c").over(own.orderBy("latency")), "total": F.sum("c").over(own)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("latency")))
    n, k = F.sum("c"), F.sum("h")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    sums = seen.groupBy("dimension", "value").agg(
        n.alias("n"), k.alias("k"), rounded(F.sum(F.col("latency") * F.col("c")) / n, 0).alias("mean_latency"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"),
        rounded(F.sum("s") / F.sum("j"), 2).alias("faithfulness"), F.sum("j").alias("n_judged"),
    )
    return sums.select("dimension", "value", "n", rounded(F.col("k") * 100.0 / F.col("n"), 1).alias("accuracy"), low.alias("low"), high.alias("high"), "mean_latency", "p50", "p90", "p95", "faithfulness", "n_judged")


@query(_ROWS + "SELECT intent, s[(floor(len(s) * 0.5) + 1)::INT] AS p50, s[(floor(len(s) * 0.9) + 1)::INT] AS p90, s[(floor(len(s) * 0.95) + 1)::INT] AS p95 FROM (SELECT intent, list_sort(list(latency)) AS s FROM rows GROUP BY intent)")
def fn_percentile_idx(spark, sf_dir):
    """Percentiles by index. Equal latencies are counted first; positions come from running counts, no list is gathered."""
    by = rows(spark, sf_dir).groupBy("intent", "latency").agg(F.count(F.lit(1)).alias("c"))
    window = Window.partitionBy("intent")
    seen = by.withColumns({"upto": F.sum("c").over(window.orderBy("latency")), "total": F.sum("c").over(window)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("latency")))
    return seen.groupBy("intent").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"))


@query(_ROWS + "SELECT difficulty, count(*) AS n, round(avg(ok::INT) + 1e-9, 4) AS accuracy, round(avg((score >= 4)::INT) + 1e-9, 4) AS pass_rate FROM rows GROUP BY difficulty")
def agg_per_difficulty(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("ok").cast("int")), 4).alias("accuracy"), rounded(F.avg((F.col("score") >= 4).cast("int")), 4).alias("pass_rate"))


@query(_ROWS + "SELECT difficulty, count(*) AS n, round(avg(ok::INT) + 1e-9, 4) AS accuracy FROM rows GROUP BY ROLLUP (difficulty)")
def agg_rewrite_pattern(spark, sf_dir):
    return rows(spark, sf_dir).rollup("difficulty").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("ok").cast("int")), 4).alias("accuracy"))


@query(_ROWS + "SELECT intent, count(*) AS n FROM rows GROUP BY intent")
def agg_distribution(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query(_ROWS + """, i AS (SELECT DISTINCT intent FROM rows), d AS (SELECT DISTINCT difficulty FROM rows)
SELECT intent, difficulty, coalesce(n, 0) AS n, 50 - coalesce(n, 0) AS gap FROM i CROSS JOIN d LEFT JOIN (SELECT intent, difficulty, count(*) AS n FROM rows GROUP BY ALL) USING (intent, difficulty)""")
def agg_cell_coverage(spark, sf_dir):
    """Every intent in every difficulty, with its count and gap: the three difficulties are columns, then rows."""
    levels = ["easy", "medium", "hard"]
    wide = rows(spark, sf_dir).groupBy("intent").agg(*[F.count_if(F.col("difficulty") == d).alias(d) for d in levels])
    return wide.unpivot("intent", levels, "difficulty", "n").withColumn("gap", 50 - F.col("n"))


@query(_ROWS + "SELECT intent, predicted, count(*) AS n FROM rows WHERE intent <> predicted GROUP BY ALL ORDER BY n DESC, intent, predicted LIMIT 10")
def agg_confusion(spark, sf_dir):
    return rows(spark, sf_dir).where("intent <> predicted").groupBy("intent", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent", "predicted").limit(10)


_CONDITIONS = {"tier": ("conf", "conf::VARCHAR"), "turn": ("doc_id % 3 + 1", "(doc_id % 3 + 1)::VARCHAR"), "intent": ("intent", "intent"), "rewritten": ("score > 3", "(score > 3)::VARCHAR")}


@query(_ROWS + f""", g AS (SELECT unnest([{', '.join(f"'{d}'" for d in _CONDITIONS)}]) AS condition, unnest([{', '.join(sql for _, sql in _CONDITIONS.values())}]) AS value, ok FROM rows)
SELECT condition, value, n, k, round(k / n + 1e-9, 4) AS accuracy, {_WILSON} FROM (SELECT condition, value, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM g GROUP BY ALL)""")
def agg_conditional_accuracy(spark, sf_dir):
    """Accuracy with its interval by tier of confidence, by turn, by intent and by whether the question was rewritten, in one pass.
    Turns and rewrites, which the tables do not have, are read off ids and scores."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("condition"), F.expr(c).cast("string").alias("value")) for d, (c, _) in _CONDITIONS.items()])).alias("x")
    counts = rows(spark, sf_dir).select("ok", each).groupBy("x.condition", "x.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.withColumns({"accuracy": rounded(F.col("k") / F.col("n"), 4), "low": low, "high": high})


@query(_ROWS + """, t AS (SELECT intent AS label, count(*) AS wanted, count(*) FILTER (WHERE ok) AS hit FROM rows GROUP BY intent), s AS (SELECT predicted AS label, count(*) AS said FROM rows GROUP BY predicted)
SELECT label, round(hit / said + 1e-9, 4) AS precision, round(hit / wanted + 1e-9, 4) AS recall, round(2.0::DOUBLE * hit / (said + wanted) + 1e-9, 4) AS f1 FROM t JOIN s USING (label)""")
def agg_intent_f1(spark, sf_dir):
    both = F.explode(F.array(F.struct(F.col("intent").alias("label"), F.lit(1).alias("w"), F.lit(0).alias("s")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("w"), F.lit(1).alias("s")))).alias("x")
    sums = rows(spark, sf_dir).select("ok", both).groupBy("x.label").agg(F.sum("x.w").alias("wanted"), F.sum("x.s").alias("said"), F.sum(F.when(F.col("ok"), F.col("x.w")).otherwise(0)).alias("hit")).where("wanted > 0 AND said > 0")
    hit, said, wanted = F.col("hit"), F.col("said"), F.col("wanted")
    return sums.select("label", rounded(hit / said, 4).alias("precision"), rounded(hit / wanted, 4).alias("recall"), rounded(2.0 * hit / (said + wanted), 4).alias("f1"))


@query(_ROWS + """, t AS (SELECT intent AS label, count(*) AS wanted, count(*) FILTER (WHERE ok) AS hit FROM rows GROUP BY intent), s AS (SELECT predicted AS label, count(*) AS said FROM rows GROUP BY predicted)
SELECT round(avg(coalesce(2.0::DOUBLE * hit / (coalesce(said, 0) + wanted), 0)) + 1e-9, 4) AS macro_f1, count(*) AS n_labels FROM t LEFT JOIN s USING (label)""")
def agg_macro_f1(spark, sf_dir):
    """The mean F1 of all wanted labels; one that is never said counts as 0."""
    both = F.explode(F.array(F.struct(F.col("intent").alias("label"), F.lit(1).alias("w"), F.lit(0).alias("s")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("w"), F.lit(1).alias("s")))).alias("x")
    sums = rows(spark, sf_dir).select("ok", both).groupBy("x.label").agg(F.sum("x.w").alias("wanted"), F.sum("x.s").alias("said"), F.sum(F.when(F.col("ok"), F.col("x.w")).otherwise(0)).alias("hit")).where("wanted > 0")
    return sums.agg(rounded(F.avg(2.0 * F.col("hit") / (F.col("said") + F.col("wanted"))), 4).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


# Model, dollars for a million tokens in and out.
RATES = (("small", 0.15, 0.6), ("large", 2.5, 10.0), ("judge", 0.4, 1.6))
#: Tokens in and out of a judge's call for each of the two scores, the share of questions that only get the second, and the model.
JUDGED, SMALL_TALK, JUDGE = ((1200, 80), (800, 60)), 0.1, "judge"


@query(_ROWS + """, u AS (SELECT config, CASE WHEN length(config) % 2 = 0 THEN 'small' ELSE 'large' END AS model, count(*) AS n, sum(latency) AS tokens_in, sum(score) AS tokens_out FROM rows GROUP BY ALL),
c AS (SELECT config, model, n, (tokens_in * r_in + tokens_out * r_out) / 1e6 AS cost, (round_even(n * 0.9::DOUBLE, 0) * (1200 * 0.4::DOUBLE + 80 * 1.6::DOUBLE) + n * (800 * 0.4::DOUBLE + 60 * 1.6::DOUBLE)) / 1e6 AS judge_cost
  FROM u JOIN (VALUES ('small', 0.15::DOUBLE, 0.6::DOUBLE), ('large', 2.5::DOUBLE, 10.0::DOUBLE)) AS r(model, r_in, r_out) USING (model))
SELECT config, model, n, round(cost + 1e-9, 6) AS cost, round(judge_cost + 1e-9, 6) AS judge_cost, round(cost + judge_cost + 1e-9, 6) AS total FROM c""")
def agg_cost(spark, sf_dir):
    """What each configuration costs by the rate of its model, and what judging it costs."""
    model = F.when(F.length("config") % 2 == 0, "small").otherwise("large")
    used = rows(spark, sf_dir).groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum("latency").alias("tokens_in"), F.sum("score").alias("tokens_out")).withColumn("model", model)
    return cost(used, spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")).select("config", "model", "n", "cost", "judge_cost", "total")


def cost(used: DataFrame, rates: DataFrame) -> DataFrame:
    """`used` (model, n questions, tokens_in, tokens_out) with its cost by `rates`; a model without a rate has no row."""
    (first_in, first_out), (second_in, second_out) = JUDGED
    judge = rates.where(F.col("model") == JUDGE).select("rate_in", "rate_out").first()  # one row
    if judge is None:
        raise ValueError(f"no rate for {JUDGE}")
    priced = used.join(F.broadcast(rates), "model")  # rates number a few dozen
    own = (F.col("tokens_in") * F.col("rate_in") + F.col("tokens_out") * F.col("rate_out")) / 1e6
    gated = F.bround(F.col("n") * (1 - SMALL_TALK))
    judged = (gated * (first_in * judge["rate_in"] + first_out * judge["rate_out"]) + F.col("n") * (second_in * judge["rate_in"] + second_out * judge["rate_out"])) / 1e6
    return priced.withColumns({"cost": rounded(own, 6), "judge_cost": rounded(judged, 6), "total": rounded(own + judged, 6)}).drop("rate_in", "rate_out")


_ECE = _ROWS + ", b AS (SELECT least(floor(conf * 10 + 1e-9), 9)::INT AS bin, count(*) AS n, avg(ok::INT) AS acc, avg(conf) AS conf FROM rows GROUP BY ALL)\n"


def bins(spark, sf_dir) -> DataFrame:
    key = F.least(F.floor(F.col("conf") * 10 + 1e-9), F.lit(9)).cast("int")
    return rows(spark, sf_dir).groupBy(key.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("int")).alias("acc"), F.avg("conf").alias("conf"))


@query(_ECE + "SELECT round(sum(n * abs(acc - conf)) / sum(n) + 1e-9, 4) AS ece FROM b")
def fn_ece(spark, sf_dir):
    return bins(spark, sf_dir).agg(rounded(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 4).alias("ece"))


@query(_ECE + "SELECT bin, n, round(acc + 1e-9, 4) AS acc, round(conf + 1e-9, 4) AS conf FROM b")
def fn_reliability_diagram(spark, sf_dir):
    return bins(spark, sf_dir).select("bin", "n", rounded(F.col("acc"), 4).alias("acc"), rounded(F.col("conf"), 4).alias("conf"))


@query(_ROWS + "SELECT conf AS tier, count(*) AS n, round(avg(ok::INT) + 1e-9, 4) AS accuracy, round(abs(avg(ok::INT) - conf) + 1e-9, 4) AS gap FROM rows GROUP BY conf")
def fn_tier_calibration(spark, sf_dir):
    accuracy = F.avg(F.col("ok").cast("int"))
    by = rows(spark, sf_dir).groupBy(F.col("conf").alias("tier")).agg(F.count(F.lit(1)).alias("n"), accuracy.alias("__accuracy"))
    return by.select("tier", "n", rounded(F.col("__accuracy"), 4).alias("accuracy"), rounded(F.abs(F.col("__accuracy") - F.col("tier")), 4).alias("gap"))


_SWEEP = _ROWS + """, t AS (SELECT intent, tau, count(*) FILTER (WHERE ok AND conf >= tau - 1e-9) AS tp, count(*) FILTER (WHERE conf >= tau - 1e-9) AS said, count(*) AS wanted
  FROM rows, (SELECT i / 100.0::DOUBLE AS tau FROM range(50, 96) AS r(i)) GROUP BY ALL)
"""


def sweep(spark, sf_dir) -> DataFrame:
    """Counts at each of 46 thresholds: rows are counted by confidence first, so only those few hundred counts are spread."""
    counts = rows(spark, sf_dir).groupBy("intent", "conf").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    tau = F.explode(F.transform(F.sequence(F.lit(50), F.lit(95)), lambda i: i / F.lit(100.0))).alias("tau")
    over = F.col("conf") >= F.col("tau") - 1e-9
    return counts.select("*", tau).groupBy("intent", "tau").agg(F.sum(F.when(over, F.col("k")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("said"), F.sum("n").alias("wanted"))


@query(_SWEEP + "SELECT intent, tau, tp, said, wanted FROM t")
def fn_threshold_sweep(spark, sf_dir):
    return sweep(spark, sf_dir)


@query(_SWEEP + "SELECT intent, arg_min(tau, (-round(2.0::DOUBLE * tp / (said + wanted), 9), tau)) AS tau FROM t WHERE wanted >= 10 GROUP BY intent")
def fn_best_threshold(spark, sf_dir):
    f1 = F.round(2.0 * F.col("tp") / (F.col("said") + F.col("wanted")), 9)
    return sweep(spark, sf_dir).where("wanted >= 10").groupBy("intent").agg(F.min_by("tau", F.struct((-f1).alias("f"), "tau")).alias("tau"))


@query(_ROWS + """, c AS (SELECT intent, conf, sum(count(*)) OVER w AS n, sum(count(*) FILTER (WHERE ok)) OVER w AS k FROM rows GROUP BY intent, conf WINDOW w AS (PARTITION BY intent ORDER BY conf DESC))
SELECT intent, min(conf) AS threshold FROM c WHERE n >= 3 AND k / n >= 0.8 GROUP BY intent""")
def win_precision_cutoff(spark, sf_dir):
    window = Window.partitionBy("intent").orderBy(F.desc("conf"))
    counts = rows(spark, sf_dir).groupBy("intent", "conf").agg(F.count(F.lit(1)).alias("c"), F.count_if("ok").alias("h"))
    seen = counts.withColumns({"n": F.sum("c").over(window), "k": F.sum("h").over(window)})
    return seen.where((F.col("n") >= 3) & (F.col("k") / F.col("n") >= 0.8)).groupBy("intent").agg(F.min("conf").alias("threshold"))


@query(_ROWS + "SELECT intent, round(avg(1 / (1 + exp(-ln(greatest(least(conf, 0.99), 0.01) / (1 - greatest(least(conf, 0.99), 0.01))) / 1.5))) + 1e-9, 4) AS mean_scaled FROM rows GROUP BY intent")
def fn_temperature_scale(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("intent").agg(rounded(F.avg(stats.scaled(F.col("conf"), 1.5)), 4).alias("mean_scaled"))


_PAIRS = _ROWS + """, p AS (SELECT a.doc_id // 2 AS k, a.ok AS a_ok, b.ok AS b_ok, a.score AS a_score, b.score AS b_score FROM rows a JOIN rows b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0)
"""


def pairs(spark, sf_dir) -> DataFrame:
    """Rows of neighbouring ids, paired."""
    r = rows(spark, sf_dir).select("doc_id", "ok", "score")
    a = r.where("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 2).alias("k"), F.col("ok").alias("a_ok"), F.col("score").alias("a_score"))
    b = r.where("doc_id % 2 = 1").select(F.floor(F.col("doc_id") / 2).alias("k"), F.col("ok").alias("b_ok"), F.col("score").alias("b_score"))
    return a.join(b, "k")


_ERFC = "(1 / (1 + {x} / 2)) * exp(-({x}) * ({x}) - 1.26551223::DOUBLE + (1 / (1 + {x} / 2)) * (1.00002368::DOUBLE + (1 / (1 + {x} / 2)) * (0.37409196::DOUBLE + (1 / (1 + {x} / 2)) * (0.09678418::DOUBLE + (1 / (1 + {x} / 2)) * (-0.18628806::DOUBLE + (1 / (1 + {x} / 2)) * (0.27886807::DOUBLE + (1 / (1 + {x} / 2)) * (-1.13520398::DOUBLE + (1 / (1 + {x} / 2)) * (1.48851587::DOUBLE + (1 / (1 + {x} / 2)) * (-0.82215223::DOUBLE + (1 / (1 + {x} / 2)) * 0.17087277::DOUBLE)))))))))"


@query(_PAIRS + f"""SELECT n, b, c, round(chi2, 4) AS chi2, round({_ERFC.format(x="sqrt(chi2 / 2)")}, 6) AS p_value, {_ERFC.format(x="sqrt(chi2 / 2)")} < 0.05 AS significant
FROM (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c)::DOUBLE END AS chi2 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE a_ok AND NOT b_ok) AS b, count(*) FILTER (WHERE b_ok AND NOT a_ok) AS c FROM p))""")
def fn_mcnemar(spark, sf_dir):
    return mcnemar(pairs(spark, sf_dir))


def mcnemar(paired: DataFrame) -> DataFrame:
    """The discordant counts, the statistic with continuity correction, and its p by the normal tail; without discordant pairs 0 and 1."""
    counts = paired.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a_ok AND NOT b_ok")).alias("b"), F.count_if(F.expr("b_ok AND NOT a_ok")).alias("c"))
    b, c = F.col("b"), F.col("c")
    chi2 = F.when(b + c == 0, 0.0).otherwise((F.abs(b - c) - 1) * (F.abs(b - c) - 1) / (b + c))
    p = stats.erfc(F.sqrt(F.col("__chi2") / 2))
    return counts.withColumn("__chi2", chi2).select("n", "b", "c", F.round("__chi2", 4).alias("chi2"), F.round(p, 6).alias("p_value"), (p < 0.05).alias("significant"))


@query(_PAIRS + "SELECT count(*) AS n, round(avg(a_score - b_score) + 1e-9, 4) AS mean_delta FROM p")
def join_paired_intersect(spark, sf_dir):
    return pairs(spark, sf_dir).dropna().agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("a_score") - F.col("b_score")), 4).alias("mean_delta"))


@query(_PAIRS + f""", d AS (SELECT a_score - b_score AS d FROM p WHERE a_score <> b_score), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
w AS (SELECT count(*)::DOUBLE AS m, coalesce(sum(r) FILTER (WHERE d > 0), 0.0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0.0)::DOUBLE AS w_minus FROM r),
t AS (SELECT coalesce(sum(k * k * k - k), 0)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS k FROM d GROUP BY abs(d))), a AS (SELECT count(*) AS n, round(avg(a_score) + 1e-9, 3) AS mean_a, round(avg(b_score) + 1e-9, 3) AS mean_b FROM p),
z AS (SELECT *, CASE WHEN m = 0 THEN 0.0 ELSE abs(least(w_plus, w_minus) - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24) END AS z FROM w, t, a)
SELECT n, m::BIGINT AS n_different, w_plus, w_minus, mean_a, mean_b, CASE WHEN n >= 20 THEN round({_ERFC.format(x="(z / sqrt(2.0::DOUBLE))")}, 6) END AS p_value FROM z""")
def fn_wilcoxon(spark, sf_dir):
    return wilcoxon(pairs(spark, sf_dir))


def wilcoxon(paired: DataFrame) -> DataFrame:
    """Signed-rank sums with average ranks, and the two-sided p by the normal approximation with the correction for ties.

    Pairs without a score do not count; equal scores give no rank; under 20 pairs there is no p, without differences it
    is 1. Ranks come from counts of the few different magnitudes, not from sorting rows.
    """
    d = F.col("a_score") - F.col("b_score")
    by = paired.where(d.isNotNull()).groupBy(F.abs(d).alias("m")).agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"), F.count(F.lit(1)).alias("c"), F.sum("a_score").alias("a"), F.sum("b_score").alias("b"))
    k = F.when(F.col("m") > 0, F.col("c")).otherwise(0).cast("double")
    rank = F.sum(k).over(Window.partitionBy(F.lit(0)).orderBy("m")) - (k - 1) / 2  # at most as many rows as magnitudes
    ranked = by.withColumns({"k": k, "rank": rank})
    sums = ranked.agg(
        F.sum("c").alias("n"), F.sum("k").alias("k"), F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).cast("double").alias("w_plus"), F.coalesce(F.sum(F.col("rank") * F.col("down")), F.lit(0.0)).cast("double").alias("w_minus"),
        F.coalesce(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")), F.lit(0.0)).alias("ties"), rounded(F.sum("a") / F.sum("c"), 3).alias("mean_a"), rounded(F.sum("b") / F.sum("c"), 3).alias("mean_b"),
    )
    m = F.col("k")
    z = F.when(m == 0, 0.0).otherwise(F.abs(F.least("w_plus", "w_minus") - m * (m + 1) / 4) / F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24))
    return sums.withColumn("z", z).select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(m, F.lit(0.0)).cast("long").alias("n_different"), "w_plus", "w_minus", "mean_a", "mean_b", F.when(F.col("n") >= 20, F.round(stats.two_sided(F.col("z")), 6)).alias("p_value"))


@query(_ROWS + "SELECT r.doc_id, r.intent, j.quality AS judged FROM rows r JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) j ON j.doc_id = r.doc_id")
def join_hash_qid(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("judged"))
    return rows(spark, sf_dir).select("doc_id", "intent").join(judged, "doc_id")


#: Tools wanted by intent and scope; a scope that an intent does not name is asked for as the city, `poi` as the district.
WANTED = {("en", "city"): ("t1", "t2"), ("en", "ward"): ("t2",), ("fr", "city"): ("t0", "t3"), ("fr", "district"): ("t3", "t4"), ("es", "city"): ("t5",)}
#: The intent for which calling nothing is right, and the helper that is never wrong.
SMALL, HELPER = "es", "resolve_location"
_CALLED = _ROWS + """, called AS (SELECT doc_id, intent, ['city', 'district', 'ward', 'poi'][(latency % 4 + 1)::INT] AS scope,
  list_transform(range(latency % 3), lambda i: 't' || ((latency + i * 7) % 6)::VARCHAR) || CASE WHEN latency % 5 = 0 THEN ['resolve_location'] ELSE [] END AS tools FROM rows),
wanted AS (SELECT *, CASE WHEN intent = 'en' THEN CASE WHEN scope = 'ward' THEN ['t2'] ELSE ['t1', 't2'] END WHEN intent = 'fr' THEN CASE WHEN scope IN ('district', 'poi') THEN ['t3', 't4'] ELSE ['t0', 't3'] END WHEN intent = 'es' THEN ['t5'] ELSE []::VARCHAR[] END AS expected FROM called),
relevant AS (SELECT *, list_filter(tools, lambda t: t <> 'resolve_location') AS own FROM wanted)
"""


def called(spark, sf_dir) -> DataFrame:
    """A row for each answer: intent, scope and the tools that it called."""
    n = F.col("latency")
    scope = F.element_at(F.array(*map(F.lit, ("city", "district", "ward", "poi"))), (n % 4 + 1).cast("int"))
    tools = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < n % 3, F.concat(F.lit("t"), ((n + i * 7) % 6).cast("string"))))
    helper = F.when(n % 5 == 0, F.lit(HELPER))
    return rows(spark, sf_dir).select("doc_id", "intent", scope.alias("scope"), F.array_compact(F.concat(tools, F.array(helper))).alias("tools"))


def expected() -> Column:
    """The tools wanted for `intent` and `scope`; none for an unknown intent."""
    scope = F.when(F.col("scope") == "poi", "district").otherwise(F.col("scope"))
    table = F.create_map(*[x for (intent, place), tools in WANTED.items() for x in (F.lit(f"{intent} {place}"), F.array(*map(F.lit, tools)))])
    return F.coalesce(F.element_at(table, F.concat_ws(" ", F.col("intent"), scope)), F.element_at(table, F.concat_ws(" ", F.col("intent"), F.lit("city"))), F.array().cast("array<string>"))


def tool_scores(answers: DataFrame) -> DataFrame:
    """`answers` (intent, scope, tools) with accuracy (boolean), precision and recall.

    An answer is accurate, and its recall 1, if any call is wanted: wanted tools are alternatives. With an unknown intent
    both hold. Precision is the wanted share of calls, the helper left out, and 1 where only that was called. Small talk
    that calls nothing has all three.
    """
    quiet = (F.col("intent") == SMALL) & (F.size("tools") == 0)
    own = F.filter("tools", lambda t: t != HELPER)
    hit = (F.size("__wanted") == 0) | quiet | F.arrays_overlap("tools", "__wanted")
    share = F.size(F.filter(own, lambda t: F.array_contains(F.col("__wanted"), t))) / F.size(own)
    precision = F.when(F.size("tools") == 0, F.when(F.col("intent") == SMALL, 1.0).otherwise(0.0)).when(F.size(own) == 0, 1.0).otherwise(F.bround(share, 2))
    return answers.withColumn("__wanted", expected()).withColumns({"accurate": hit, "precision": precision, "recall": F.when(hit, 1.0).otherwise(0.0)}).drop("__wanted")


_HIT = "len(expected) = 0 OR (intent = 'es' AND len(tools) = 0) OR list_has_any(tools, expected)"


_STARS_Z = "abs(k - n / 2.0::DOUBLE) / sqrt(n / 4.0::DOUBLE)"


@query(_ROWS + f"""SELECT intent, n, round(p, 6) AS p_value, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars
FROM (SELECT intent, n, {_ERFC.format(x=f"({_STARS_Z} / sqrt(2::DOUBLE))")} AS p FROM (SELECT intent, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM rows GROUP BY intent))""")
def fn_sig_stars(spark, sf_dir):
    """Whether each intent's share of right answers differs from one half, as stars."""
    counts = rows(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    p = stats.two_sided((F.col("k") - F.col("n") / 2) / F.sqrt(F.col("n") / 4))
    return counts.select("intent", "n", F.round(p, 6).alias("p_value"), stats.stars(p).alias("stars"))


@query(_CALLED + "SELECT doc_id, list_sort(list_intersect(tools, expected)) <> [] AS hit, array_to_string(list_sort(list_intersect(tools, expected)), ',') AS common FROM relevant")
def set_intersect_tools(spark, sf_dir):
    """The called tools that are wanted."""
    common = F.array_sort(F.array_intersect("tools", "wanted"))
    return called(spark, sf_dir).withColumn("wanted", expected()).select("doc_id", (F.size(common) > 0).alias("hit"), F.array_join(common, ",").alias("common"))


@query(_CALLED + f"SELECT doc_id, {_HIT} AS accurate FROM relevant")
def fn_tool_accuracy(spark, sf_dir):
    return tool_scores(called(spark, sf_dir)).select("doc_id", "accurate")


@query(_CALLED + "SELECT doc_id, CASE WHEN len(tools) = 0 THEN CASE WHEN intent = 'es' THEN 1.0 ELSE 0.0 END WHEN len(own) = 0 THEN 1.0 ELSE round_even(len(list_filter(own, lambda t: list_contains(expected, t))) / len(own)::DOUBLE, 2) END::DOUBLE AS precision FROM relevant")
def precision(spark, sf_dir):
    return tool_scores(called(spark, sf_dir)).select("doc_id", "precision")


@query(_CALLED + f"SELECT doc_id, CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END::DOUBLE AS recall FROM relevant")
def recall(spark, sf_dir):
    return tool_scores(called(spark, sf_dir)).select("doc_id", "recall")


@query("""SELECT count(*) AS turns, count(DISTINCT conv_id) AS sessions, round(avg(length(text)) + 1e-9, 2) AS mean_latency, round(avg((role = 'system')::INT) * 100 + 1e-9, 2) AS error_rate,
  round(coalesce(avg((length(text) % 5 <> 0)::INT) FILTER (WHERE role = 'assistant'), 0) * 100 + 1e-9, 2) AS tool_success_rate, count(*) FILTER (WHERE role = 'assistant') AS tool_calls FROM conversations""")
def agg_telemetry(spark, sf_dir):
    """Turns, threads, latency (the text's length stands for it), errors (system turns) and success of tool calls (assistant turns)."""
    said, share = F.col("role") == "assistant", lambda c: rounded(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)) * 100, 2)
    return table(spark, sf_dir, "conversations").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("sessions"), rounded(F.avg(F.length("text")), 2).alias("mean_latency"), share(F.col("role") == "system").alias("error_rate"),
        share(F.when(said, F.length("text") % 5 != 0)).alias("tool_success_rate"), F.count_if(said).alias("tool_calls"),
    )


_TURNS = """WITH turns AS (SELECT conv_id, turn, length(text) % 5 <> 0 AS correct, turn > 0 AS in_context, length(text) % 3 <> 0 AS resolved, CASE WHEN conv_id % 3 = 0 THEN 'follow_up' WHEN conv_id % 3 = 1 THEN 'switch' ELSE 'refine' END AS pattern FROM conversations),
threads AS (SELECT conv_id, pattern, bool_and(correct) AS success, count(*) AS n, count(*) FILTER (WHERE correct) AS k, coalesce(count(*) FILTER (WHERE turn < first_wrong), 0) AS kept, count(*) FILTER (WHERE in_context) AS c, count(*) FILTER (WHERE in_context AND resolved) AS r
  FROM (SELECT *, coalesce(min(turn) FILTER (WHERE NOT correct) OVER (PARTITION BY conv_id), 9999999) AS first_wrong FROM turns) GROUP BY conv_id, pattern)
"""


@query(_TURNS + """SELECT coalesce(pattern, 'all') AS pattern, count(*) AS n_threads, round(avg(success::INT) * 100 + 1e-9, 1) AS csr, round(CASE WHEN sum(c) > 0 THEN sum(r) * 100.0::DOUBLE / sum(c) ELSE 0 END + 1e-9, 1) AS era,
  round(avg(kept) + 1e-9, 2) AS mean_crr, round(sum(k) * 100.0::DOUBLE / sum(n) + 1e-9, 1) AS turn_accuracy FROM threads GROUP BY ROLLUP (pattern)""")
def agg_multi_turn(spark, sf_dir):
    """By pattern and over all threads; what turn is correct, resolved or in context is read off the text's length and place."""
    size, k = F.length("text"), F.col("conv_id") % 3
    pattern = F.when(k == 0, "follow_up").when(k == 1, "switch").otherwise("refine")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (size % 5 != 0).alias("correct"), (F.col("turn") > 0).alias("in_context"), (size % 3 != 0).alias("resolved"), pattern.alias("pattern"))
    return multi_turn(turns)


def multi_turn(turns: DataFrame) -> DataFrame:
    """Success of whole threads (CSR), entities resolved in turns that need their context (ERA), mean length of the
    correct beginning (CRR) and correct turns, from (conv_id, turn, correct, in_context, resolved, pattern) rows."""
    wrong = F.min(F.when(~F.col("correct"), F.col("turn"))).over(Window.partitionBy("conv_id"))
    threads = turns.withColumn("wrong", wrong).groupBy("conv_id", "pattern").agg(
        F.every("correct").alias("success"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), F.count_if(F.col("wrong").isNull() | (F.col("turn") < F.col("wrong"))).alias("kept"),
        F.count_if("in_context").alias("c"), F.count_if(F.col("in_context") & F.col("resolved")).alias("r"),
    )
    return threads.rollup("pattern").agg(
        F.count(F.lit(1)).alias("n_threads"), rounded(F.avg(F.col("success").cast("int")) * 100, 1).alias("csr"), rounded(F.when(F.sum("c") > 0, F.sum("r") * 100.0 / F.sum("c")).otherwise(0.0), 1).alias("era"),
        rounded(F.avg("kept"), 2).alias("mean_crr"), rounded(F.sum("k") * 100.0 / F.sum("n"), 1).alias("turn_accuracy"),
    ).withColumn("pattern", F.coalesce("pattern", F.lit("all")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def arr_counter(spark, sf_dir):
    """A histogram: counted, put in a map, and read out of it again."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # a handful of types
    return packed.select(F.explode("m").alias("event_type", "n"))


# ---------------------------------------------------------------- dates


@query("SELECT o_orderkey, ['Thứ Hai', 'Thứ Ba', 'Thứ Tư', 'Thứ Năm', 'Thứ Sáu', 'Thứ Bảy', 'Chủ Nhật'][isodow(o_orderdate)] AS weekday FROM orders")
def dt_weekday_vi(spark, sf_dir):
    """The weekday by name."""
    names = F.array(*map(F.lit, ("Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy", "Chủ Nhật")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(names, F.weekday("o_orderdate") + 1).alias("weekday"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 HOUR, '%H:%M ') || ['Thứ Hai', 'Thứ Ba', 'Thứ Tư', 'Thứ Năm', 'Thứ Sáu', 'Thứ Bảy', 'Chủ Nhật'][isodow(o_orderdate + INTERVAL 7 HOUR)] || strftime(o_orderdate + INTERVAL 7 HOUR, ' %d/%m/%Y') AS shown FROM orders")
def dt_format_ict(spark, sf_dir):
    local = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 7 HOURS")
    days = F.array(*map(F.lit, ("Thứ Hai", "Thứ Ba", "Thứ Tư", "Thứ Năm", "Thứ Sáu", "Thứ Bảy", "Chủ Nhật")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.date_format(local, "HH:mm "), F.element_at(days, F.weekday(local) + 1), F.date_format(local, " dd/MM/yyyy")).alias("shown"))


@query("SELECT o_orderkey, sat::VARCHAR AS saturday, (sat + 1)::VARCHAR AS sunday, (d - (isodow(d) - 1)::INT)::VARCHAR AS monday FROM (SELECT o_orderkey, d, d + (CASE isodow(d) WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1 WHEN 6 THEN 0 ELSE 6 END)::INT AS sat FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders))")
def dt_next_weekend(spark, sf_dir):
    """The coming Saturday and Sunday: on a Saturday today and tomorrow, on a Sunday those six and seven days on."""
    d = F.to_date("o_orderdate")
    ahead = F.when(F.weekday(d) <= 5, 5 - F.weekday(d)).otherwise(6)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(d, ahead).cast("string").alias("saturday"), F.date_add(d, ahead + 1).cast("string").alias("sunday"), F.date_sub(d, F.weekday(d)).cast("string").alias("monday"))


@query("SELECT o_orderkey, CASE WHEN g = 0 THEN 'hôm nay' WHEN g = 1 THEN 'ngày mai' WHEN g = -1 THEN 'hôm qua' WHEN g = 2 THEN 'ngày kia' WHEN g = -2 THEN 'hôm kia' WHEN g > 0 THEN g || ' ngày tới' ELSE -g || ' ngày trước' END AS day, floor(date_diff('second', TIMESTAMP '1998-01-01', o_orderdate) / 60)::BIGINT AS age_minutes FROM (SELECT *, datediff('day', DATE '1998-01-01', o_orderdate::DATE) AS g FROM orders)")
def dt_relative_day(spark, sf_dir):
    gap = F.datediff(F.to_date("o_orderdate"), F.lit("1998-01-01").cast("date"))
    age = F.floor((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.unix_timestamp(F.lit("1998-01-01 00:00:00").cast("timestamp"))) / 60)
    names = {0: "hôm nay", 1: "ngày mai", -1: "hôm qua", 2: "ngày kia", -2: "hôm kia"}
    day = F.coalesce(*[F.when(gap == n, name) for n, name in names.items()], F.when(gap > 0, F.concat(gap.cast("string"), F.lit(" ngày tới"))), F.concat((-gap).cast("string"), F.lit(" ngày trước")))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), age.cast("long").alias("age_minutes"))
