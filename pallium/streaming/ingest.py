"""Background ingestion as a stream.

Files landing in a folder run through the same narrow flow as batch input
(decode, clean, cascade, prompt, analyzer, parse, detokenize), one row for
each file, empty ones included:

1. each trigger lists the folder in tasks (``sources.landing``);
2. a stateful ``dropDuplicates`` lets pass the files not had before (a file
   that lands again with another time or size is a new one);
3. the new files of a batch are noted in the checkpoint folder before any of
   them is read, then analysed, and the rows written to
   ``<out>/batch_id=<n>`` with overwrite;
4. the input is dropped: the batch's files are moved to the archive, or
   removed, or kept.

A batch that fails has moved nothing: its files stay where they landed, and
the restarted query replays it. The note makes the replay take the same files
(and such as landed in between), from the archive if the failure came while
they were being moved; the replay overwrites the rows that the batch wrote.
So every landed file gives one row.

Removed input is first set aside below the checkpoint folder, which has to be
on the landing folder's storage, and deleted by a later batch, when this one
can't be replayed any more.

Ids (S9) are given later, when landed rows are appended to the result table
(``ResultStore.append``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pallium.plans.flows import analyze_files
from pallium.session import release
from pallium.sources.landing import LISTING_SCHEMA, move_files, stream_listings, with_content

RESULT_COLUMNS = [
    "doc_key", "original_file", "success", "error", "pii_entities_found", "tokenized_text",
    "token_mapping", "ai_response", "detokenized_response", "parse_ok", "token_collision",
]

FINISH = ("keep", "archive", "delete")


def landed_files(spark: SparkSession, landing_dir: str, glob: str | None = None) -> DataFrame:
    """The files of a folder as a stream of ``(path, modificationTime,
    length)``, each once, empty ones too."""
    return stream_listings(spark, landing_dir, glob).dropDuplicates(["path", "modificationTime", "length"])


def analyze_file_rows(files: DataFrame, analyzer, **kw) -> DataFrame:
    """``analyze_files`` with the columns that the stream writes."""
    return analyze_files(files, analyzer, **kw).select(*RESULT_COLUMNS)


def start_ingest(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint_dir: str, analyzer,
                 available_now: bool = True, processing_time: str | None = None, glob: str | None = None,
                 finished: str = "keep", archive_dir: str | None = None, failures_dir: str | None = None,
                 **kw) -> StreamingQuery:
    """Start the ingestion stream; returns the running query.

    The checkpoint folder must be on storage that outlives executors (a shared
    folder on a cluster). ``finished`` says what becomes of a batch's files
    once its rows are written: ``keep``, ``archive`` (below
    ``<archive_dir>/batch_id=<n>``, on the landing folder's storage) or
    ``delete``. With ``failures_dir`` failed files are logged there, as
    ``(doc_key, error, failed_at)`` by batch, and the output holds successes
    only. Further arguments go to ``analyze_files``.
    """
    if finished not in FINISH or (finished == "archive") != (archive_dir is not None):
        raise ValueError(f"finished is one of {FINISH}, and 'archive' needs archive_dir")
    notes = f"{checkpoint_dir.rstrip('/')}/pallium"
    aside = {"archive": archive_dir, "delete": f"{notes}/finished"}.get(finished)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        note = f"{notes}/landed/{batch_id}"
        batch.write.mode("append").parquet(note)
        _drop_earlier(spark, notes, batch_id)
        noted = spark.read.schema(LISTING_SCHEMA).parquet(note)
        if noted.isEmpty():
            return
        files = (noted.groupBy("path").agg(F.max(F.struct("modificationTime", "length")).alias("m"))
                 .select("path", "m.modificationTime", "m.length"))
        target = aside and f"{aside.rstrip('/')}/batch_id={batch_id}"
        pins: list[DataFrame | str] = []
        content = with_content(files, target and (landing_dir, target))
        options = kw if _is_native(analyzer) else kw | {"pins": pins}
        rows = analyze_file_rows(content, analyzer, **options)
        place = f"batch_id={batch_id}"
        if failures_dir is None:
            rows.write.mode("overwrite").parquet(f"{out_dir}/{place}")
        else:
            rows.filter("success").write.mode("overwrite").parquet(f"{out_dir}/{place}")
            (rows.filter("not success").select("doc_key", "error", F.current_timestamp().alias("failed_at"))
             .write.mode("overwrite").parquet(f"{failures_dir}/{place}"))
        release(pins, spark)
        if target:
            move_files(files, landing_dir, target)

    writer = landed_files(spark, landing_dir, glob).writeStream.foreachBatch(each_batch)
    writer = writer.option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def _is_native(analyzer) -> bool:
    from pallium.plans.flows import NativeAnalyzer

    return isinstance(analyzer, NativeAnalyzer)


def _drop_earlier(spark: SparkSession, notes: str, batch_id: int) -> None:
    """Remove what earlier batches left to be replayed from: they are committed."""
    for name in ("landed", "finished"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{notes}/{name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(folder):
            for f in fs.listStatus(folder):  # two entries at most
                if int(f.getPath().getName().rpartition("=")[2]) < batch_id:
                    fs.delete(f.getPath(), True)
