"""Extension: genotype files as a stream, joined to a static catalogue; each batch's samples are scored anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..sources import schemas


def call_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Calls of files as they arrive in ``folder``; the sample is the file's name without its ending."""
    read = spark.readStream.schema(schemas.CALLS).option("sep", "\t").option("comment", "#").option("maxFilesPerTrigger", max_files).csv(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return read.filter(~F.coalesce(F.lower("rsid") == "rsid", F.lit(False))).select(name.alias("sample_id"), "*")


def score_stream(calls: DataFrame, gwas: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes trait scores of each batch under ``target``, a folder a batch, so that a batch that runs again replaces
    its own."""

    def write(batch: DataFrame, number: int) -> None:
        scoring.trait_scores(scoring.full_scores(gwas, batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
