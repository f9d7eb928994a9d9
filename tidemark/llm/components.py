"""Connected components of a graph of longs, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fitted, reliable


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): each node's least neighbour or itself. Aggregated before the shuffle, so a node of many edges is no load."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _ends(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(u, v) for each pair of columns in ends, from one reading of rows."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])))


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) for undirected edges (u, v): v is the least node of u's component; least nodes themselves have no row.

    Self-loops and repeated edges are allowed. The number of rounds is logarithmic in practice; reaching the limit raises."""
    now = reliable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _state(now)
    if not seen[0]:
        return now
    now = fitted(now, seen[0])
    for _ in range(rounds):
        both = _ends(now, ("u", "v"), ("v", "u"))
        large = both.join(_least(both), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large), "u")
        # no more than two for each edge
        now = reliable(fitted(_ends(small, ("v", "m"), ("u", "m")).filter("u <> v").distinct(), 2 * seen[0]))
        last, seen = seen, _state(now)
        if seen == last:
            return now
    raise RuntimeError("components did not settle")
