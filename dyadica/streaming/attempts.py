"""The attempt log as a stream: an extension, with the batch operator's results.

New files of the log folder are read as they arrive. Each micro-batch is reduced to one row
per cell and merged with the kept state, so a late success supersedes earlier failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.attempts import latest_success, succeeded


def read_log_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 64, kind: str = "parquet") -> DataFrame:
    """A stream of attempt files of a folder, parquet or ``json`` lines, by the schema given."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def canonical_stream(stream: DataFrame, state: str, checkpoint: str, key: str = "cell_key", seq: str = "seq") -> StreamingQuery:
    """Keep the latest success per key under ``state``, in the folder of the newest finished batch.

    A batch that is replayed after a failure writes the same folder again, so the result is
    exactly that of the batch operator over all files read so far. The folder before is kept
    for such a replay and older ones are deleted.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{state}/{number - 1}").unionByName(batch)
        latest_success(rows, key, seq, succeeded(F.col("error"), F.col("raw"))).write.mode("overwrite").parquet(f"{state}/{number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, group: str) -> DataFrame:
    """Events per window and group, late rows up to ``delay`` included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"))
