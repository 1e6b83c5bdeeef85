"""Landing new files once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def load_new_files(
    spark: SparkSession, source: str, schema: StructType, destination: str, checkpoint: str, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> None:
    """Append files not loaded before, then stop. A re-run or a retry adds nothing twice.

    The checkpoint remembers the files taken and the file sink commits each batch once.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.load(source)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(destination)
    )
    query.awaitTermination()
