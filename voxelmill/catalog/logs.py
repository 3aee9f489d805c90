"""Training logs, cross-validation and trial tables, read from embeddings and events.

Each embedding vector is one run: position = epoch, element = score; its label = fold.
"""

from pyspark.sql import functions as F

from voxelmill.catalog import query
from voxelmill.operators import logs as lg

LOG_SQL = """WITH log AS (
  SELECT vec_id AS run, label AS fold, CAST(pos - 1 AS INTEGER) AS epoch, CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1000) AS DOUBLE) / 8 AS score
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)),
l2 AS (SELECT *, CASE WHEN (epoch + run) % 5 = 2 THEN NULL ELSE 500 - score END AS val_loss FROM log)
"""


def log(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("run"), F.col("label").alias("fold"),
        F.posexplode("embedding").alias("epoch", "e"))
    d = d.withColumn("score", F.floor(F.col("e").cast("double") * 1000).cast("double") / 8).drop("e")
    return d.withColumn("val_loss", F.when((F.col("epoch") + F.col("run")) % 5 == 2, None)
                        .otherwise(500 - F.col("score")))


@query("win_running_best", LOG_SQL + """
SELECT run, epoch, greatest(-1.0::DOUBLE, max(score) OVER w) AS best,
  score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new_best
FROM l2 WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)""")
def win_running_best(spark, sf):
    return lg.running_best(log(spark, sf), ["run"]).select("run", "epoch", "best", "new_best")


def _stop_sql(mult, limit):
    return LOG_SQL + f""", a AS (SELECT run, epoch, score, row_number() OVER w AS i,
    score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new_best
  FROM l2 WINDOW w AS (PARTITION BY run ORDER BY epoch)),
b AS (SELECT *, i - coalesce(max(CASE WHEN new_best THEN i END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS evals FROM a),
c AS (SELECT *, evals * {mult} >= {limit} AS stop, min(CASE WHEN evals * {mult} >= {limit} THEN epoch END) OVER (PARTITION BY run) AS first_stop FROM b)
SELECT run, epoch, CAST(evals * {mult} AS BIGINT) AS wait, stop FROM c WHERE first_stop IS NULL OR epoch <= first_stop"""


@query("win_early_stop", _stop_sql(5, 40))
def win_early_stop(spark, sf):
    return lg.early_stop(log(spark, sf), ["run"], 40, 5, "epochs").select("run", "epoch", "wait", "stop")


@query("win_early_stop_evaluations", _stop_sql(1, 10))
def win_early_stop_evaluations(spark, sf):
    return lg.early_stop(log(spark, sf), ["run"], 10).select("run", "epoch", "wait", "stop")


@query("win_early_stop_scaled", _stop_sql(1, 6))
def win_early_stop_scaled(spark, sf):
    return lg.early_stop(log(spark, sf), ["run"], 30, 5, "scaled").select("run", "epoch", "wait", "stop")


@query("win_best_epoch", LOG_SQL + """
SELECT run, epoch AS best_epoch, val_loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS rn FROM l2 WHERE val_loss IS NOT NULL) WHERE rn = 1""")
def win_best_epoch(spark, sf):
    return lg.best_epoch(log(spark, sf), ["run"])


@query("win_best_fold_model", LOG_SQL + "SELECT run, fold, max(score) AS best FROM l2 GROUP BY 1, 2")
def win_best_fold_model(spark, sf):
    return lg.fold_best(log(spark, sf))


GROUPS = ", b AS (SELECT run % 25 AS run, fold, max(score) AS best FROM l2 GROUP BY 1, 2)\n"


def grouped(spark, sf):
    return lg.fold_best(log(spark, sf).withColumn("run", F.col("run") % 25))


@query("agg_fold_summary", LOG_SQL + GROUPS + "SELECT run, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS std FROM b GROUP BY 1")
def agg_fold_summary(spark, sf):
    return lg.fold_summary(grouped(spark, sf)).select(
        "run", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("snk_run_summary", LOG_SQL + GROUPS + """
SELECT run, round(avg(best), 6) AS mean_best, array_to_string(list(CAST(best AS INTEGER) ORDER BY fold), ',') AS scores
FROM (SELECT run, fold, floor(best) AS best FROM b) GROUP BY 1""")
def snk_run_summary(spark, sf):
    b = grouped(spark, sf).withColumn("best", F.floor("best").cast("double"))
    return lg.run_summary(b).select("run", F.round("mean_best", 6).alias("mean_best"), F.array_join(
        F.col("scores").cast("array<int>").cast("array<string>"), ",").alias("scores"))


@query("fn_subset_series", LOG_SQL + "SELECT run, epoch, val_loss FROM l2 WHERE val_loss IS NOT NULL")
def fn_subset_series(spark, sf):
    return lg.valid_points(log(spark, sf), "val_loss")


EVENT_SQL = """WITH ev AS (SELECT user_id AS run, event_id AS epoch, ts, value AS score, 100 - value AS val_loss FROM events)
"""


@query("snk_run_report", EVENT_SQL + """
SELECT run, min(ts) AS started, max(ts) AS ended, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds,
  min(val_loss) AS best_loss, max(score) AS best_score, arg_max(val_loss, epoch) AS last_loss, arg_max(score, epoch) AS last_score, count(*) AS epochs
FROM ev GROUP BY 1""")
def snk_run_report(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), "ts",
        F.col("value").alias("score"), (100 - F.col("value")).alias("val_loss"))
    return lg.training_report(e).withColumn("seconds", F.round("seconds", 3))


@query("agg_log_means", """
SELECT run, epoch, round(avg(loss), 6) AS mean_loss, round(avg(infer_s), 3) AS mean_infer_s, max(t) - min(t) AS epoch_s
FROM (SELECT user_id AS run, event_id // 100 AS epoch, floor(value * 64) / 64 AS loss, floor(value * 8) / 64 AS infer_s, event_id * 2 AS t FROM events) GROUP BY 1, 2""")
def agg_log_means(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("run"), F.floor(F.col("event_id") / 100).alias("epoch"),
        (F.floor(F.col("value") * 64) / 64).alias("loss"), (F.floor(F.col("value") * 8) / 64).alias("infer_s"),
        (F.col("event_id") * 2).alias("t"))
    return lg.epoch_means(e).withColumn("mean_loss", F.round("mean_loss", 6))


TRIALS = """, t AS (SELECT run AS trial, epoch AS step, score AS value, CASE WHEN run % 4 = 3 THEN 'RUNNING' ELSE 'COMPLETE' END AS state FROM l2)
"""


def trials(spark, sf):
    return log(spark, sf).select(
        F.col("run").alias("trial"), F.col("epoch").alias("step"), F.col("score").alias("value"),
        F.when(F.col("run") % 4 == 3, "RUNNING").otherwise("COMPLETE").alias("state"))


@query("win_median_prune", LOG_SQL + TRIALS + """, m AS (SELECT step, quantile_cont(value, 0.5) AS median FROM t WHERE state = 'COMPLETE' GROUP BY 1),
b AS (SELECT trial, step, max(value) OVER (PARTITION BY trial ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM t WHERE state = 'RUNNING')
SELECT trial, b.step, best, round(median, 6) AS median, coalesce((SELECT count(DISTINCT trial) FROM t WHERE state = 'COMPLETE') >= 5 AND b.step >= 4 AND best < median, false) AS prune
FROM b LEFT JOIN m ON b.step = m.step""")
def win_median_prune(spark, sf):
    return lg.median_prune(trials(spark, sf)).withColumn("median", F.round("median", 6))


@query("top_best_trial", LOG_SQL + """
SELECT run AS trial, value, fold AS params FROM (SELECT run, max(score) AS value, max(fold) AS fold FROM l2 GROUP BY 1) ORDER BY value DESC, run LIMIT 1""")
def top_best_trial(spark, sf):
    t = log(spark, sf).groupBy(F.col("run").alias("trial")).agg(
        F.max("score").alias("value"), F.max("fold").alias("params"))
    return lg.best_trial(t)
