"""Quality of predictions p (0 to 100) against outcomes y (0 or 1): one row each, by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranked import average_rank, running_total

EPSILON = 1e-6


def brier(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") / 100 - F.col("y"), F.lit(2))).alias("brier"))


def log_loss(df: DataFrame, *by: str) -> DataFrame:
    p = F.least(F.greatest(F.col("p") / 100, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.groupBy(*by).agg(F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("log_loss"))


def auc(df: DataFrame, *by: str) -> DataFrame:
    """From average ranks; null where there is one class only."""
    ranked = average_rank(df, "p", "_r", list(by))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("_r") * F.col("y")) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def pr_auc(df: DataFrame, id_col: str) -> DataFrame:
    """Average precision; rows of equal p in the order of their ids."""
    ordered = df.select(F.struct((-F.col("p")).alias("p"), F.col(id_col).alias("i")).alias("o"), "y").withColumn("one", F.lit(1))
    hits = running_total(running_total(ordered, [], "o", "one", "rank"), [], "o", "y", "tp")
    return hits.agg(F.when((F.sum("y") > 0) & (F.sum("y") < F.count("*")), F.sum(F.col("y") * F.col("tp") / F.col("rank")) / F.sum("y")).alias("pr_auc"))


def binned(df: DataFrame, bins: int) -> DataFrame:
    """Adds bin: equal widths over 0 to 100, the last one closed."""
    return df.withColumn("bin", F.least(F.floor(F.col("p") * bins / 100), F.lit(bins - 1)).cast("int"))


def calibration(df: DataFrame, bins: int = 5) -> DataFrame:
    return binned(df, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), (F.avg("y") * 100).alias("actual"))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    per = calibration(df, bins)
    return per.agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual")) / 100) / F.sum("n")).alias("ece"))


def spearman(df: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    ranked = average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.when(F.count("*") >= least, F.corr("_rx", "_ry")).alias("spearman"))


def top_share_mean(df: DataFrame, score: str, id_col: str, value: str, share: int = 10) -> DataFrame:
    """The mean of value over the best tenth by score (one row at least). Scores are counted and summed first, so whole
    scores never meet in a task; of the score at the border only, the least ids fill what is left."""
    per = df.groupBy((-F.col(score)).alias("_o")).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.count(value).alias("_c"))
    upto = running_total(per, [], "_o", "_n", "_upto").persist()
    try:
        n = upto.agg(F.sum("_n")).first()[0] or 0
        most = max(1, n // share)
        border = upto.filter(F.col("_upto") > most).agg(F.min(F.struct("_o", F.lit(most) - (F.col("_upto") - F.col("_n"))))).first()[0]
        taken = upto.filter(F.col("_upto") <= most).agg(F.sum("_n"), F.sum("_s"), F.sum("_c")).first()
    finally:
        upto.unpersist()
    rest = df.filter(F.lit(False)) if border is None else df.filter(-F.col(score) == F.lit(border[0])).orderBy(F.asc(id_col)).limit(border[1])
    total, seen, known = (x or 0 for x in taken)
    return rest.agg((F.count("*") + F.lit(total)).alias("n"), F.try_divide(F.coalesce(F.sum(value), F.lit(0)) + F.lit(float(seen)), F.count(value) + F.lit(known)).alias("mean"))


def bootstrap_auc(df: DataFrame, id_col: str, rounds: int = 200, seed: int = 7, least: int = 20) -> DataFrame:
    """low and high: a 95 percent interval of AUC. Each row is drawn a Poisson(1) number of times per round; rows of equal p
    and y are counted first, since what they are drawn together is a Poisson number of their count. The generator starts
    from p, y and seed, so reruns agree however the rows are partitioned."""

    def draw(frames):
        for pdf in frames:
            out = []
            for p, y, n in pdf.itertuples(index=False):
                times = np.random.default_rng([seed, int(np.float64(p).view(np.uint64)), int(y)]).poisson(n, rounds)
                out.append(pd.DataFrame({"round": np.arange(1, rounds + 1, dtype=np.int32), "p": p, "pos": times * int(y), "neg": times * (1 - int(y))}))
            yield pd.concat(out) if out else pd.DataFrame({"round": [], "p": [], "pos": [], "neg": []})

    drawn = df.filter("p is not null and y is not null").groupBy(F.col("p").cast("double").alias("p"), "y").agg(F.count("*").alias("n")).mapInPandas(draw, "round int, p double, pos long, neg long")
    per = drawn.groupBy("round", "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = running_total(per, ["round"], "p", "neg", "upto")
    each = below.groupBy("round").agg(F.try_divide(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc")).filter("auc is not null")
    at = lambda q: F.element_at(F.sort_array(F.collect_list("auc")), F.least(F.floor(F.count("*") * q).cast("int") + 1, F.count("*").cast("int")))
    enough = df.count() >= least
    return each.agg(F.when(F.lit(enough) & (F.count("*") * 2 >= rounds), at(0.025)).alias("low"), F.when(F.lit(enough) & (F.count("*") * 2 >= rounds), at(0.975)).alias("high"))


# Fixed thresholds of the release gate.
GATE = {"screening": {"n": 100, "auc": 0.58, "stable": 0.6}, "production": {"n": 300, "auc": 0.60, "stable": 0.7, "folds": 3, "gain": 0.02, "gap": 0.10}, "probability": {"ece": 0.05, "graded": 50}}


def release_gate(model: dict, base_brier: float | None, fold_aucs: list[float | None], *, ci_low: float | None = None, segment_stable: bool | None = None, graded: int = 0, leakage_free: bool = True) -> dict:
    """Three tiers of what a model may be used for, from metrics that have been aggregated already."""
    scored = [a for a in fold_aucs if a is not None]
    stable = sum(a > 0.5 for a in scored) / len(scored) if scored else 0.0
    auc_, b = model.get("auc") or 0.0, model.get("brier")
    gain = (base_brier - b) / base_brier if b is not None and base_brier and b < base_brier else 0.0
    s, p, q = GATE["screening"], GATE["production"], GATE["probability"]
    screening = model.get("n", 0) >= s["n"] and auc_ >= s["auc"] and gain > 0 and stable >= s["stable"]
    told = auc_ >= p["auc"] or (ci_low is not None and ci_low > 0.5)
    production = leakage_free and model.get("n", 0) >= p["n"] and told and gain >= p["gain"] and stable >= p["stable"] and len(scored) >= p["folds"] and segment_stable is not False
    probability = production and model.get("ece") is not None and model["ece"] <= q["ece"] and graded >= q["graded"]
    return {"screening": screening, "production": production, "probability": probability, "stable_share": stable, "brier_gain": gain}
