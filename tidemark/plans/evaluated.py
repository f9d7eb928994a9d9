"""Queries of model quality, neighbours and walk-forward training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.basic import steady
from tidemark.operators import metrics, neighbours, walkforward
from tidemark.plans.base import ISSUES_SQL, PAIRS_SQL, issues, pairs, query, r4, table


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: steady(F.col(c), 4) for c in cols})


@query(f"WITH {PAIRS_SQL} SELECT count(*) AS n, {r4('avg(power(p / 100 - y, 2))')} AS brier FROM pairs")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.brier(pairs(spark, d)), "brier")


@query(f"WITH {PAIRS_SQL}, c AS (SELECT least(greatest(p / 100, 1e-6), 1 - 1e-6) AS q, y FROM pairs) SELECT {r4('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))')} AS log_loss FROM c")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.log_loss(pairs(spark, d)), "log_loss")


@query(f"WITH {PAIRS_SQL} SELECT {r4('(sum(CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END)) / count(*)')} AS auc FROM pairs a, pairs b WHERE a.y = 1 AND b.y = 0")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auc(pairs(spark, d)), "auc")


@query(f"WITH {PAIRS_SQL} SELECT toxic, {r4('(sum(CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END)) / count(*)')} AS auc FROM pairs a JOIN pairs b USING (toxic) WHERE a.y = 1 AND b.y = 0 GROUP BY 1")
def auc_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auc(pairs(spark, d), "toxic"), "auc")


@query(f"WITH {PAIRS_SQL}, r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS i, sum(y) OVER (ORDER BY p DESC, id) AS tp FROM pairs) SELECT {r4('sum(y * tp / CAST(i AS DOUBLE)) / sum(y)')} AS pr_auc FROM r")
def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.pr_auc(pairs(spark, d), "id"), "pr_auc")


_BINS = "SELECT CAST(least(floor(p * {0} / 100), {0} - 1) AS INT) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) * 100 AS actual FROM pairs GROUP BY 1"


@query(f"WITH {PAIRS_SQL}, b AS ({_BINS.format(10)}) SELECT {r4('sum(n * abs(predicted - actual) / 100) / sum(n)')} AS ece FROM b")
def ece_10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ece(pairs(spark, d)), "ece")


@query(f"WITH {PAIRS_SQL}, b AS ({_BINS.format(5)}) SELECT bin, n, {r4('predicted')} AS predicted, {r4('actual')} AS actual FROM b")
def calibration_5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.calibration(pairs(spark, d)), "predicted", "actual")


@query(f"WITH {PAIRS_SQL}, r AS (SELECT rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0e0 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS b FROM pairs) SELECT {r4('corr(a, b)')} AS spearman FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.spearman(pairs(spark, d), "size", "p"), "spearman")


@query(f"WITH {PAIRS_SQL}, r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS i, count(*) OVER () AS n FROM pairs) SELECT count(*) AS n, {r4('avg(y)')} AS mean FROM r WHERE i <= greatest(1, n // 10)")
def top_decile_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.top_share_mean(pairs(spark, d), "p", "id", "y"), "mean")


@query()
def bootstrap_auc_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_auc(pairs(spark, d), "id")


def _model_rows(spark: SparkSession, d: str) -> DataFrame:
    i = walkforward.features(issues(spark, d))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 150_000).cast("int").alias("y"))
    return o.join(i.select("id", *[c for c in i.columns if c.startswith("f_")]), F.col("o_custkey") == F.col("id"))


@query()
def walk_forward_logistic(spark: SparkSession, d: str) -> DataFrame:
    names = ["f_log_size", "f_fresh", "f_ofs", "f_sme", "f_growth"]
    out, _ = walkforward.walk_forward(_model_rows(spark, d), names, "y", "year")
    return out.groupBy("year").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("base").alias("base"), F.avg(F.pow(F.col("p") / 100 - F.col("y"), F.lit(2))).alias("brier"))


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT a.toxic, sum(CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM pairs a JOIN pairs b USING (toxic) WHERE a.y = 1 AND b.y = 0 GROUP BY 1),
    w AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END) / count(*) AS auc FROM pairs a, pairs b WHERE a.y = 1 AND b.y = 0),
    e AS (SELECT sum(n * abs(predicted - actual) / 100) / sum(n) AS ece FROM (SELECT least(floor(p / 10), 9) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) * 100 AS actual FROM pairs GROUP BY 1)),
    m AS (SELECT count(*) AS n, avg(power(p / 100 - y, 2)) AS brier, avg(y) * (1 - avg(y)) AS base FROM pairs), s AS (SELECT avg(CASE WHEN auc > 0.5 THEN 1.0e0 ELSE 0 END) AS stable, count(*) AS folds FROM x),
    g AS (SELECT n, auc, ece, stable, folds, CASE WHEN base > 0 AND brier < base THEN (base - brier) / base ELSE 0 END AS gain FROM m, w, e, s),
    t AS (SELECT *, n >= 100 AND auc >= 0.58 AND gain > 0 AND stable >= 0.6 AS screening, n >= 300 AND auc >= 0.60 AND gain >= 0.02 AND stable >= 0.7 AND folds >= 3 AS production FROM g)
    SELECT unnest(['screening', 'production', 'probability', 'stable_share', 'brier_gain']) AS tier, unnest([CAST(screening AS DOUBLE), CAST(production AS DOUBLE), 0.0e0, stable, {r4("gain")}]) AS "value" FROM t""")
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    per = {r["toxic"]: r["auc"] for r in metrics.auc(p, "toxic").collect()}
    b, rate = metrics.brier(p).first(), p.agg(F.avg("y")).first()[0]
    got = metrics.release_gate({"n": b["n"], "brier": b["brier"], "auc": metrics.auc(p).first()["auc"], "ece": metrics.ece(p).first()["ece"]}, rate * (1 - rate), list(per.values()))
    return _rounded(spark.createDataFrame([(k, float(v)) for k, v in got.items()], "tier string, value double"), "value")


_F = ["issue_size_m", "cash_m", "total_sub", "ofs_pct"]


_KNN = f"""WITH {ISSUES_SQL}, s AS (SELECT country, {", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}, count({f}) AS n_{f}" for f in _F)} FROM issues GROUP BY 1),
    z AS (SELECT id, country, {", ".join(f"CASE WHEN n_{f} >= 5 THEN ({f} - m_{f}) / s_{f} END AS z_{f}" for f in _F)} FROM issues JOIN s USING (country)),
    p AS (SELECT t.id AS target, c.id AS neighbour, {" + ".join(f"(CASE WHEN t.z_{f} IS NOT NULL AND c.z_{f} IS NOT NULL THEN 1 ELSE 0 END)" for f in _F)} AS dims, {" + ".join(f"(CASE WHEN t.z_{f} IS NOT NULL THEN 1 ELSE 0 END)" for f in _F)} AS usable, {" + ".join(f"coalesce(power(t.z_{f} - c.z_{f}, 2), 0)" for f in _F)} AS sq FROM z t JOIN z c ON t.country = c.country AND t.id <> c.id WHERE t.id % 20 = 0),
    d AS (SELECT *, sqrt(sq / dims) AS distance, sqrt(sq / dims) * (1 + 0.25e0 * (usable - dims)) AS adjusted FROM p WHERE dims >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(adjusted, 9), dims DESC, neighbour) AS nth FROM d WHERE adjusted <= 2)"""


@query(f"""{_KNN}
    SELECT target, neighbour, CAST(dims AS INT) AS dims, {r4("adjusted")} AS adjusted FROM r WHERE nth <= 8""")
def zscore_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id", "country", *_F)
    return neighbours.nearest(i.filter("id % 20 = 0"), i, _F, ["country"], "id").select("target", "neighbour", "dims", steady(F.col("adjusted"), 4).alias("adjusted"))


@query(f"""{_KNN}, j AS (SELECT r.target, i.gmp_pct AS v FROM r JOIN issues i ON i.id = r.neighbour WHERE nth <= 8 AND i.gmp_pct IS NOT NULL)
    SELECT target, count(*) AS n, {r4("avg(v)")} AS mean, {r4("list_sort(list(v))[count(*) // 2 + 1]")} AS median, {r4("avg(CASE WHEN v > 0 THEN 1.0e0 ELSE 0 END) * 100")} AS success FROM j GROUP BY 1""")
def similarity_aggregate(spark: SparkSession, d: str) -> DataFrame:
    i = issues(spark, d).select("id", "country", "gmp_pct", *_F)
    return _rounded(neighbours.summary(neighbours.nearest(i.filter("id % 20 = 0"), i, _F, ["country"], "id"), i, "id", "gmp_pct"), "mean", "median", "success")


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS nth FROM p) SELECT query, neighbour, {r4("score")} AS score FROM r WHERE nth <= 5""")
def embedding_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_vectors(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").select("query", "neighbour", steady(F.col("score"), 4).alias("score"))
