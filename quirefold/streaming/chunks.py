"""The dry run as a stream: new chapters in, chunks out, each chapter once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.timeline import latest, pending
from ..plans.pipeline import chunked, spoken
from ..sources.settings import Settings


def chunk_stream(chapters: DataFrame, settings: Settings = Settings(), late: str = "60 days") -> DataFrame:
    """Chunks of a stream of chapters; a chapter loaded again within the watermark on loaded_at counts once."""
    stamped = chapters.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    return chunked(spoken(stamped.dropDuplicatesWithinWatermark(["book_id", "chapter_idx"]), settings), size=settings.chunk_size)


def resume_into(chapters: DataFrame, target: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Writes each batch's chunks to `target`/chunks, and then which chapters are done to `target`/done.

    Chapters that are done, or whose chunks are there, are left out, so that a batch run again adds
    nothing; a chapter without a chunk is done too. Of several rows of a chapter in a batch the latest counts.
    """

    def there(spark: SparkSession, part: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{target}/{part}").select("book_id", "chapter_idx")
        except AnalysisException:  # nothing written yet
            return None

    def add(batch: DataFrame, number: int) -> None:
        rows = latest(batch, ["book_id", "chapter_idx"], ["loaded_at", "text"])
        for part in ("chunks", "done"):
            if (done := there(batch.sparkSession, part)) is not None:
                rows = pending(rows, done)
        rows = rows.persist()
        chunked(spoken(rows, settings), size=settings.chunk_size).write.mode("append").parquet(f"{target}/chunks")
        rows.select("book_id", "chapter_idx").write.mode("append").parquet(f"{target}/done")
        rows.unpersist()

    return chapters.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
