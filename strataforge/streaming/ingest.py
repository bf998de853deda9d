"""Structured Streaming variants: new blocks, repeated deliveries, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.functions.normal import key


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a growing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_blocks(refs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every block hash once within ``delay`` of its first reference.

    The watermark bounds the state; across longer times :func:`append_missing`
    keeps the store free of repeats.
    """
    rows = refs.select(key(F.col("hash")).alias("hash"), "size", "recorded_at").where(F.col("hash").isNotNull())
    return rows.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["hash"])


def counts(refs: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """References and bytes per branch and window; late rows within ``delay`` count."""
    return refs.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", window), "branch").agg(F.count(F.lit(1)).alias("n_refs"), F.sum("size").alias("n_bytes")).select(F.col("window.start").alias("from_time"), "branch", "n_refs", "n_bytes")


def verify(blocks: DataFrame, content_hash=F.md5) -> DataFrame:
    """``hash, status`` (OK or Damaged) of stored blocks (``hash, content``) as they arrive.

    Stateless, so it holds no memory however many blocks there are; which blocks are
    missing only a finished store shows (``operators.blocks.verify``).
    """
    good = F.coalesce(content_hash(F.col("content")) == F.col("hash"), F.lit(False))
    return blocks.select("hash", F.when(good, "OK").otherwise("Damaged").alias("status"))


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Everything there is of a stream, appended to a parquet table at ``path``; restartable."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_missing(store_path: str, keys: list[str]):
    """A ``foreachBatch`` sink that appends rows whose keys the store lacks.

    A batch that is run again after a failure adds nothing twice.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store_path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.parquet(store_path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(store_path)

    return run
