"""Walk-forward evaluation of a ridge logistic model: each year is predicted from the years before it.

Rows are summed up, not gathered: a Newton step needs the gradient and the Hessian, whose few numbers are aggregated over
all rows in one job. Only these meet the driver, so training takes any number of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.basic import ratio
from tidemark.functions.text import spac_name

#: Fixed: least training rows, known values a feature needs, the ridge, Newton steps, and where a logit is clipped.
MIN_TRAIN, LEAST_VALUES, RIDGE, STEPS, CLIP = 60, 5, 1.0, 25, 30.0


def features(df: DataFrame) -> DataFrame:
    """The model's inputs from an issue's fields: logs, shares, margins and flags; null where undefined."""
    log = lambda c: F.ln(F.when(F.col(c) > 0, F.col(c)))
    per = lambda c: ratio(F.col(c), F.col("revenue_m")) * 100
    return df.withColumns(
        {
            "f_log_size": log("issue_size_m"), "f_log_price": log("final_price"), "f_fresh": F.col("fresh_issue_pct"), "f_ofs": F.col("ofs_pct"),
            "f_sme": (F.coalesce("board", F.lit("")) == "SME").cast("double"), "f_spac": spac_name(F.col("company")).cast("double"), "f_log_shares": log("shares_offered_m"),
            "f_log_revenue": log("revenue_m"), "f_growth": (ratio(F.col("revenue_m"), F.col("revenue_prev_m")) - 1) * 100, "f_net_margin": per("net_income_m"), "f_cfo_margin": per("cfo_m"),
        }
    )


def relative_target(relative: Column, own: Column, benchmark: Column) -> Column:
    return (F.coalesce(relative, own - benchmark) > 0).cast("int")


def _design(df: DataFrame, train: DataFrame, names: list[str]) -> tuple[list[Column], int]:
    """Columns of the design, the constant first, from what training rows alone say; missing values get their own columns."""
    stats = train.agg(*[x for n in names for x in (F.count(n).alias(f"n_{n}"), F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"), F.min(n).alias(f"a_{n}"), F.max(n).alias(f"b_{n}"))]).first()
    used = [n for n in names if stats[f"n_{n}"] >= LEAST_VALUES and stats[f"a_{n}"] != stats[f"b_{n}"]]
    gaps = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in used]).first() if used else {}
    cols = [F.lit(1.0)] + [F.coalesce((F.col(n) - F.lit(stats[f"m_{n}"])) / F.lit(stats[f"s_{n}"] or 1.0), F.lit(0.0)) for n in used]
    return cols + [F.col(n).isNull().cast("double") for n in used if gaps[n]], len(used)


def _logit(w: np.ndarray) -> Column:
    """The clipped logit of the design in x. Weights ride along as one array literal, so each step runs the same code."""
    z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP))


def fit(train: DataFrame, cols: list[Column], y: str) -> np.ndarray:
    """Ridge logistic weights by Newton's method; the constant isn't penalised."""
    d = len(cols)
    # read once per step; a lost part is computed again
    rows = train.select(F.col(y).cast("double").alias("y"), F.array(*cols).alias("x")).persist()
    w, penalty = np.zeros(d), np.append(0.0, np.full(d - 1, RIDGE))
    x = [F.col("x")[i] for i in range(d)]
    try:
        for _ in range(STEPS):
            p = rows.select("x", "y", (1 / (1 + F.exp(-_logit(w)))).alias("p"))
            sums = p.agg(*[F.sum((F.col("p") - F.col("y")) * c) for c in x], *[F.sum(F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i in range(d) for j in range(i, d)]).first()
            g, h = np.array(sums[:d], float), np.zeros((d, d))
            h[np.triu_indices(d)] = sums[d:]
            h = h + np.triu(h, 1).T
            step = np.linalg.solve(h + np.diag(penalty) + 1e-12 * np.eye(d), g + penalty * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
    finally:
        rows.unpersist()
    return w


def walk_forward(rows: DataFrame, names: list[str], y: str, year: str, min_train: int = MIN_TRAIN) -> tuple[DataFrame | None, list[dict]]:
    """Out-of-sample rows with p (0 to 100) and base (the training rate), and what each fold had. Years number a few."""
    usable = rows.filter(F.col(y).isNotNull())
    sizes = {r[year]: (r["n"], r["pos"]) for r in usable.groupBy(year).agg(F.count("*").alias("n"), F.sum(y).alias("pos")).collect()}
    out, folds = None, []
    for yr in sorted(sizes):
        n = sum(c for k, (c, _) in sizes.items() if k < yr)
        pos = sum(p for k, (_, p) in sizes.items() if k < yr)
        fold = {"year": yr, "n_train": n, "n_test": sizes[yr][0], "fitted": n >= min_train and 0 < pos < n}
        folds.append(fold)
        if not fold["fitted"]:
            continue
        train, test = usable.filter(F.col(year) < yr), usable.filter(F.col(year) == yr)
        cols, _ = _design(usable.filter(F.col(year) <= yr), train, names)
        w = fit(train, cols, y)
        made = test.withColumn("x", F.array(*cols)).withColumns({"p": 100 / (1 + F.exp(-_logit(w))), "base": F.lit(100.0 * pos / n)}).drop("x")
        out = made if out is None else out.unionByName(made)
    return out, folds
