"""New files of a folder, parsed as they come. The kernel keeps no state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperlake.sources.reader import parse_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def parsed_stream(spark: SparkSession, folder: str, pattern: str = "*.pdf", images: bool = True, files_per_batch: int = 1000) -> DataFrame:
    """The nested rows of parse_files(), as a stream."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parse_files(files, images)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends what is new in `folder` to the parquet table; Corpus reads it back. Each file is taken once."""
    return parsed_stream(spark, folder, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
