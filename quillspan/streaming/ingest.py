"""Files arriving in a folder, each content taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.operators.manifest import pending, with_hash


def stream(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """The files of a folder as a stream; of a single file's path its folder is watched for files of that name."""
    reader = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).load(p.getParent().toString())
    return reader.load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ingest(source: DataFrame, manifest_path: str, checkpoint: str, content: str = "content", on_batch=None):
    """Runs the stream to its end (available now). Each micro-batch is held against the manifest table by hash, the new
    rows (one per hash) are handed to ``on_batch`` and appended to the manifest; no state is kept in the stream, so
    identity lasts without a watermark. One checkpoint belongs to one manifest. A batch that runs again appends to its own folder and so changes nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = with_hash(batch, content).dropDuplicates(["content_sha"])
        if _exists(spark, manifest_path):
            known = spark.read.schema("content_sha string, batch_id bigint").option("basePath", manifest_path).parquet(manifest_path).where(F.col("batch_id") < batch_id)
            hashed = pending(hashed, known)
        target = f"{manifest_path.rstrip('/')}/batch_id={batch_id}"
        hashed.write.mode("overwrite").parquet(target)
        if on_batch is not None:
            on_batch(spark.read.parquet(target), batch_id)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
