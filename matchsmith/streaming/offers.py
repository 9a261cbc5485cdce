"""Row-local cleaning of an offer stream (the batch column expressions, unchanged)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.functions import text as T


def clean_offer_stream(stream: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Cleaned title, token count and the title+description word count of each offer."""
    s = T.clean_column(stream, "title", "title", stop_words)
    return s.withColumn("title_words", T.word_count(F.col("title"))) \
        .withColumn("words", T.word_count(T.combine([F.col("title"), F.col("description")])))


def write_batches(stream: DataFrame, path: str, checkpoint_location: str):
    """Write each micro-batch to its own ``epoch=`` folder of the parquet table under ``path``,
    with a streaming checkpoint in a shared folder so a restarted query resumes where it
    stopped. A batch that is replayed overwrites its folder, so no row is there twice."""
    def land(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return (stream.writeStream.foreachBatch(land)
            .option("checkpointLocation", checkpoint_location).start())
