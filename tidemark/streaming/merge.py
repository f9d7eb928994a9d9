"""A sink that merges batches into a table: repeated batches change nothing, and readers see whole batches only.

The table lies in buckets of its entities. A batch rewrites only the buckets that it touches, each as a new version under
the batch's number; a row in the ledger, written last, makes these versions the current ones. A batch that failed half-way
leaves versions that no ledger names, and runs again over the versions before it; one that the ledger names is done, and does
nothing when it comes again. One pass over a bucket gives the observations, who said what (provenance) and where sources disagree."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: two sources disagree if their values are further apart than this share of the greater.
TOLERANCE = 0.04
#: What an observation is of, and what else it has. ``seq`` orders observations of one key; the greater is the later.
KEYS = ("id", "field", "period_end", "source")
OBSERVED = "id string, field string, period_end string, source string, tier int, value double, seq long"


class MergedTable:
    """Observations by id, field, period_end and source, in ``buckets`` buckets of ids under ``path``, a folder that the
    cluster shares. ``buckets`` must stay as it was when the table began; it bounds what a batch rewrites at once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _ledger(self) -> DataFrame:
        kind = "batch long, bucket int"
        try:
            return self.spark.read.schema(kind).parquet(f"{self.path}/ledger")
        except AnalysisException:
            return self.spark.createDataFrame([], kind)

    def _versions(self, before: int | None = None) -> list[tuple[int, int]]:
        """(batch, bucket) of the current version of each bucket, as of before a batch; as many rows as buckets."""
        ledger = self._ledger() if before is None else self._ledger().filter(F.col("batch") < before)
        return [(r["batch"], r["bucket"]) for r in ledger.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()]

    def _read(self, versions: list[tuple[int, int]]) -> DataFrame:
        kind = f"{OBSERVED}, first_seq long, bucket int"
        out = self.spark.createDataFrame([], kind)
        for batch in sorted({b for b, _ in versions}):  # at most as many as there are buckets
            base = f"{self.path}/rows/batch={batch}"
            out = out.unionByName(self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/bucket={k}" for b, k in versions if b == batch]))
        return out

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """Merges rows of OBSERVED: of one key the greatest seq stays, of equal ones the greatest value; blank values and
        null keys write nothing. For foreachBatch; may be called again with the same batch and rows, at any time."""
        if not self._ledger().filter(F.col("batch") == batch).isEmpty():
            return
        new = rows.filter(F.col("value").isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEYS]))
        new = new.select(*[c.split()[0] for c in OBSERVED.split(", ")], F.col("seq").alias("first_seq"), F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("bucket"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        old = self._read([v for v in self._versions(batch) if v[1] in touched])
        latest = F.max_by(F.struct("tier", "value", "seq"), F.struct("seq", "value", "tier")).alias("last")
        merged = old.unionByName(new).groupBy("bucket", *KEYS).agg(latest, F.min("first_seq").alias("first_seq")).select("bucket", *KEYS, "last.*", "first_seq")
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={batch}")
        # the commit: from here on these versions are the current ones
        done = self.spark.createDataFrame([(k,) for k in sorted(touched)], "bucket int").coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def observations(self) -> DataFrame:
        """Current rows: the keys, tier, value, seq, and first_seq, the first that the key was seen with."""
        return self._read(self._versions()).drop("bucket")

    def provenance(self) -> DataFrame:
        """(id, field, source, tier, value, conflict): what each source last said of a field, and whether another source says
        otherwise. Recomputed from all that is there, so it doesn't depend on the order of arrival."""
        last = F.max_by(F.struct("tier", "value"), F.struct("period_end", "seq")).alias("last")
        said = self.observations().groupBy("id", "field", "source").agg(last).select("id", "field", "source", "last.*")
        return said.withColumn("conflict", disagrees())

    def filled(self, entities: DataFrame, fields: list[str]) -> DataFrame:
        """entities (id, a column per field) with nulls filled from the newest period that the best tier's sources tell; what
        is there stays."""
        best = F.max_by("value", F.struct(-F.col("tier"), "period_end", "seq", "source"))
        told = self.observations().filter(F.col("field").isin(*fields)).groupBy("id").pivot("field", fields).agg(best)
        told = told.select("id", *[F.col(f).alias(f"_told_{f}") for f in fields])
        return entities.join(told, "id", "left").select(*[F.coalesce(c, f"_told_{c}").alias(c) if c in fields else F.col(c) for c in entities.columns])


def disagrees() -> Column:
    """Whether some other source's value of the same id and field is further than TOLERANCE away. A source's least and greatest
    opponents are the ends of the group, or the next to them if it is at an end itself; it has one row, so they suffice."""
    own = Window.partitionBy("id", "field")
    after = own.orderBy("value", "source").rowsBetween(1, Window.unboundedFollowing)
    before = own.orderBy("value", "source").rowsBetween(Window.unboundedPreceding, -1)
    gap = lambda other: F.coalesce(F.abs(other - F.col("value")) / F.greatest(F.abs(other), F.abs("value"), F.lit(1e-9)) > TOLERANCE, F.lit(False))
    return gap(F.max("value").over(after)) | gap(F.min("value").over(before))


def merge_stream(observed: DataFrame, table: MergedTable, checkpoint: str, name: str = "merge") -> None:
    """Merges all that a stream of OBSERVED has; with the same checkpoint a later call goes on where this one ended."""
    observed.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: table.write_batch(df, batch)).start().awaitTermination()
