"""Postings kept at write: batches of new, changed and deleted documents are added as deltas to what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import postings
from .upserts import bucket_of

DOCUMENTS = "doc_id long, version long, deleted boolean, updated_at timestamp, bucket int"
POSTINGS = "term string, doc_id long, tf long, positions array<int>, version long, bucket int"
TOTALS = "term string, df long, cf long, version long"


class KeptPostings:
    """Three tables under one path, each only ever appended to, a folder a version: which version of a document counts, and
    since when; the postings of each version, in buckets of documents; and what each batch adds to a term's totals.

    A batch reads its own documents and, of what is stored, the buckets and versions of those it changes; nothing else. The
    table of documents is appended last, so a batch that fails half-way leaves nothing that counts, and its next try
    overwrites it. One writer at a time. compact() makes one version of all."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        for name, schema in (("documents", DOCUMENTS), ("postings", POSTINGS), ("totals", TOTALS)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}/start=0")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        """The version of each document that counts: doc_id, version, updated_at. Deleted ones are left out."""
        latest = self._table("documents", DOCUMENTS).groupBy("doc_id").agg(F.max_by(F.struct("version", "deleted", "updated_at"), "version").alias("x"))
        return latest.select("doc_id", "x.*").where("not deleted").drop("deleted")

    def postings(self) -> DataFrame:
        """term, doc_id, tf, positions of all documents as they are now."""
        return self._stored(self.documents()).select("term", "doc_id", "tf", "positions")

    def totals(self) -> DataFrame:
        """term, df, cf: the sums of the batches' deltas."""
        return self._settled().groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def _settled(self) -> DataFrame:
        known = self._table("documents", DOCUMENTS).select("version").distinct()
        return self._table("totals", TOTALS).join(F.broadcast(known), "version", "left_semi")  # a row a batch

    def _stored(self, current: DataFrame) -> DataFrame:
        return self._table("postings", POSTINGS).join(current.select("doc_id", "version"), ["doc_id", "version"])

    def write(self, docs: DataFrame, deleted: DataFrame | None = None) -> int:
        """Add docs(doc_id, text), new or changed, and take out deleted(doc_id); returns the version. Of a doc_id that comes
        twice one row counts, a deletion before any other; a null text has no postings, a null doc_id is left out."""
        version = (self._table("documents", DOCUMENTS).agg(F.max("version")).first()[0] or 0) + 1
        docs = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("text").alias("text"))
        gone = self.spark.createDataFrame([], "doc_id long") if deleted is None else deleted.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
        docs = docs.join(gone, "doc_id", "left_anti")
        change = docs.select("doc_id", F.lit(False).alias("deleted")).unionByName(gone.withColumn("deleted", F.lit(True)))
        change = change.select("doc_id", F.lit(version).cast("long").alias("version"), "deleted", F.current_timestamp().alias("updated_at"), bucket_of("doc_id", self.buckets).alias("bucket"))
        touched = [r.bucket for r in change.select("bucket").distinct().collect()]  # a number a bucket at most
        new = postings.postings(docs).select("term", "doc_id", "tf", F.col("positions").cast("array<int>"), F.lit(version).cast("long").alias("version"), bucket_of("doc_id", self.buckets).alias("bucket"))
        new.repartition("bucket").write.mode("overwrite").parquet(f"{self.path}/postings/version={version}")
        before = self.documents().join(change.select("doc_id"), "doc_id", "left_semi")
        old = self._table("postings", POSTINGS).where(F.col("bucket").isin(touched)).join(before.select("doc_id", "version"), ["doc_id", "version"])
        fresh = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings/version={version}")
        deltas = fresh.select("term", F.lit(1).alias("d"), "tf").unionByName(old.select("term", F.lit(-1).alias("d"), (-F.col("tf")).alias("tf")))
        deltas = deltas.groupBy("term").agg(F.sum("d").alias("df"), F.sum("tf").alias("cf")).where("df <> 0 or cf <> 0")
        deltas.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{self.path}/totals/version={version}")
        change.write.mode("overwrite").parquet(f"{self.path}/documents/version={version}")
        return version

    def compact(self, path: str) -> KeptPostings:
        """The same contents as one version under a new path."""
        made = KeptPostings(self.spark, path, self.buckets)
        one = F.lit(1).cast("long").alias("version")
        self.postings().select("term", "doc_id", "tf", "positions", one, bucket_of("doc_id", self.buckets).alias("bucket")).repartition("bucket").write.mode("overwrite").parquet(f"{made.path}/postings/version=1")
        self.totals().select("term", "df", "cf", one).write.mode("overwrite").parquet(f"{made.path}/totals/version=1")
        self.documents().select("doc_id", one, F.lit(False).alias("deleted"), "updated_at", bucket_of("doc_id", self.buckets).alias("bucket")).write.mode("overwrite").parquet(f"{made.path}/documents/version=1")
        return made
