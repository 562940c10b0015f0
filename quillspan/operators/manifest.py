"""The table of processed inputs, keyed by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``content_sha``, the SHA-256 of the content's bytes."""
    return files.withColumn("content_sha", F.sha2(F.col(content).cast("binary"), 256))


def entries(manifest: DataFrame) -> DataFrame:
    """The entries of saved manifests as rows; NULL entries are left out."""
    return manifest.select("manifest_id", "saved_at", F.explode("processed").alias("e")).where("e IS NOT NULL").select("manifest_id", "saved_at", "e.*")


def pending(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Files whose hash is not known (all with ``force``). Two equal new files are both pending."""
    return files if force else files.join(known.select("content_sha").where("content_sha IS NOT NULL").distinct(), "content_sha", "left_anti")


def skipped(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select("content_sha").where("content_sha IS NOT NULL").distinct(), "content_sha", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "content_sha") -> DataFrame:
    """Old rows without those whose key comes anew, and the new rows. Write the result to a new version."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def status(rows: DataFrame) -> DataFrame:
    """One row: entries, notes, last processing."""
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum("notes_generated"), F.lit(0)).alias("notes"), F.max("processed_date").alias("last_processed"))


def usage(rows: DataFrame, by: str) -> DataFrame:
    """Token totals by ``by``; missing counts as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(by).agg(F.count("*").alias("calls"), total("token_usage.input").alias("input_tokens"), total("token_usage.output").alias("output_tokens"))
