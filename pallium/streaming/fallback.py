"""Detector fallback as a stream.

Documents and detector results arrive as two streams. A document waits for
its result: a left outer stream-stream join within a time range, with
watermarks on both sides, so that state is dropped and documents without a
result in time come out alone. Those take the pattern cascade; the others take
the span path, also with an empty result (the detector ran and found nothing).
Each micro-batch of the join goes through ``tokenize_with_fallback``, so the
stream gives what the batch operator gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pallium.operators.spans import tokenize_with_fallback
from pallium.session import pinned, release


def await_detections(docs: DataFrame, detections: DataFrame, doc: str = "doc_id", time_col: str = "ts",
                     spans_col: str = "spans", wait: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """Streams of documents and of detector results (one row per document:
    ``doc, spans, time``) to the documents with ``spans``: null if no result
    came within ``wait`` of the document's time.

    ``lateness`` is how far rows of either stream may come out of order; later
    ones are dropped by the watermark. Of several results for a document the
    first counts. A null result is that of a detector that failed, and a
    document with a null key gets no result: both come out with null spans.
    """
    waiting = docs.withWatermark(time_col, lateness)
    came = (detections.select(F.col(doc).alias("__doc"), F.col(spans_col).alias(spans_col), F.col(time_col).alias("__at"))
            .withWatermark("__at", lateness).dropDuplicatesWithinWatermark(["__doc"]))
    in_time = ((F.col("__at") >= F.col(time_col)) & (F.col("__at") <= F.col(time_col) + F.expr(f"INTERVAL {wait}")))
    return waiting.join(came, (waiting[doc] == came["__doc"]) & in_time, "left_outer").drop("__doc", "__at")


def start_fallback(docs: DataFrame, detections: DataFrame, out_dir: str, checkpoint_dir: str, doc: str = "doc_id",
                   text_col: str = "text", time_col: str = "ts", spans_col: str = "spans", wait: str = "10 minutes",
                   lateness: str = "1 minute", available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Tokenize documents as their detector results come; returns the running
    query. Rows of ``tokenize_with_fallback`` are written to
    ``<out>/batch_id=<n>``; a replayed batch overwrites its own. Documents that
    still wait when the query ends are kept in its state and come out after
    the next start."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        pins: list[DataFrame] = []
        # Pinned, as the operator reads it twice and the join's state moves on.
        rows = pinned(batch, pins)
        if not rows.isEmpty():
            tokenize_with_fallback(rows, doc, text_col, spans_col).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        release(pins)

    joined = await_detections(docs, detections, doc, time_col, spans_col, wait, lateness)
    writer = joined.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
