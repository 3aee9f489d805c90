"""Training logs, cross-validation results and trial tables."""

from pyspark.sql import DataFrame, functions as F

from voxelmill.model import attach, exact_quantiles, running


def running_best(log: DataFrame, by, order="epoch", value="score", mode="max", more=None) -> DataFrame:
    """Best value before and including each row, and whether the row is a new best
    (strictly better; scores start at -1, losses at infinity). ``more``: further running aggregates of
    the same pass; they may use _one, which is 1 in every row."""
    out = running(log.withColumn("_one", F.lit(1)), by, order, {
        "_prior": (mode, value, False), "best": (mode, value, True), **(more or {})}).drop("_one")
    start = -1.0 if mode == "max" else float("inf")
    prior = F.coalesce("_prior", F.lit(start))
    new = F.col(value) > prior if mode == "max" else F.col(value) < prior
    best = (F.greatest if mode == "max" else F.least)(F.lit(start), F.col("best"))
    return out.withColumn("new_best", new).withColumn("best", best).drop("_prior")


def early_stop(log: DataFrame, by, patience, interval=1, unit="evaluations", order="epoch",
               value="score", mode="max") -> DataFrame:
    """Log with the wait since the last best, cut after the first stopping row.

    Units: "epochs" adds ``interval`` per evaluation and stops at ``patience``;
    "evaluations" counts evaluations; "scaled" compares them with patience // interval.
    """
    by = list(by)
    d = running_best(log, by, order, value, mode, {"_idx": ("sum", "_one", True)})
    d = d.withColumn("_hit", F.when(F.col("new_best"), F.col("_idx")))
    d = running(d, by, order, {"_last": ("max", "_hit", True)}).drop("_hit")
    evals = F.col("_idx") - F.coalesce("_last", F.lit(0))
    limit = patience // interval if unit == "scaled" else patience
    wait = evals * (interval if unit == "epochs" else 1)
    d = d.withColumn("wait", wait.cast("long")).drop("_idx", "_last")
    d = d.withColumn("stop", F.col("wait") >= limit)
    first = d.filter("stop").groupBy(*by).agg(F.min(order).alias("_stop_at"))
    d = d.join(first, by, "left")
    return d.filter(F.col("_stop_at").isNull() | (F.col(order) <= F.col("_stop_at"))).drop("_stop_at")


def best_epoch(log: DataFrame, by, loss="val_loss", order="epoch") -> DataFrame:
    return log.filter(F.col(loss).isNotNull()).groupBy(*by).agg(
        F.min_by(order, F.struct(loss, order)).alias("best_epoch"), F.min(loss).alias(loss))


def fold_best(log: DataFrame, by=("run", "fold"), value="score") -> DataFrame:
    return log.groupBy(*by).agg(F.max(value).alias("best"))


def fold_summary(best: DataFrame, by=("run",)) -> DataFrame:
    return best.groupBy(*by).agg(F.avg("best").alias("mean"), F.stddev_pop("best").alias("std"))


def run_summary(best: DataFrame) -> DataFrame:
    """Mean best score and the scores in fold order (one entry per fold)."""
    pairs = F.sort_array(F.collect_list(F.struct("fold", "best")))
    return best.groupBy("run").agg(F.avg("best").alias("mean_best"),
                                   F.transform(pairs, lambda p: p["best"]).alias("scores"))


def training_report(log: DataFrame, by=("run",)) -> DataFrame:
    """Start, end, duration, best and last loss and score, number of epochs."""
    sec = sum((s * F.unix_micros(f("ts").cast("timestamp")) for f, s in ((F.max, 1), (F.min, -1))), F.lit(0))
    return log.groupBy(*by).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), (sec / 1e6).alias("seconds"),
        F.min("val_loss").alias("best_loss"), F.max("score").alias("best_score"),
        F.max_by("val_loss", "epoch").alias("last_loss"), F.max_by("score", "epoch").alias("last_score"),
        F.count("*").alias("epochs"))


def epoch_means(batches: DataFrame, by=("run", "epoch")) -> DataFrame:
    return batches.groupBy(*by).agg(
        F.avg("loss").alias("mean_loss"), F.round(F.avg("infer_s"), 3).alias("mean_infer_s"),
        (F.max("t") - F.min("t")).alias("epoch_s"))


def valid_points(log: DataFrame, col: str, by=("run", "epoch")) -> DataFrame:
    return log.filter(F.col(col).isNotNull()).select(*by, col)


def median_prune(trials: DataFrame, startup=5, warmup=4, interval=1) -> DataFrame:
    """Prune decision per step of a running trial (public median-pruner rule, maximising):
    best value so far below the median of the completed trials at that step, once
    ``startup`` trials are complete and ``warmup`` steps have passed."""
    done = trials.filter("state = 'COMPLETE'")
    med = exact_quantiles(done, ["step"], "value", [0.5]).select("step", F.col("q").alias("median"))
    n_done = done.agg(F.count_distinct("trial").alias("_done"))  # one row
    live = running(trials.filter("state = 'RUNNING'"), ["trial"], "step",
                   {"best": ("max", "value", True)})
    live = attach(live, med, how="left", on=["step"]).join(F.broadcast(n_done))
    due = ((F.col("_done") >= startup) & (F.col("step") >= warmup)
           & ((F.col("step") - warmup) % interval == 0))
    return live.select("trial", "step", "best", "median",
                       F.coalesce(due & (F.col("best") < F.col("median")), F.lit(False)).alias("prune"))


def best_trial(trials: DataFrame) -> DataFrame:
    """Highest value wins, first trial on ties."""
    return trials.agg(F.max_by(F.struct("trial", "value", "params"),
                               F.struct("value", (-F.col("trial")).alias("t"))).alias("b")).select("b.*")


def head_features(features: DataFrame, contains="glcm", n=3) -> DataFrame:
    """First n feature names holding a text, with their values (one map per case)."""
    names = F.slice(F.sort_array(F.filter(F.map_keys("features"), lambda k: k.contains(contains))), 1, n)
    return features.select("case_id", F.explode(names).alias("feature"), "features").select(
        "case_id", "feature", F.col("features")[F.col("feature")].alias("value"))
