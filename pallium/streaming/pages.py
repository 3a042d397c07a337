"""Page assembly as a stream.

Pages of documents arrive in any order. The state of a document holds its
pages; it comes out when its last page is in (the page count is known from a
page that carries it), or when event time has passed its waiting time. A
timer does the latter, by the watermark. State of a finished document is a
mark alone, which keeps repeated pages from starting it anew, until the same
timer removes it.

State lives in RocksDB, off the heap and checkpointed with the query.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pallium.functions.patterns import PAGE_SEPARATOR
from pallium.functions.text import clean_text

# The processor runs in Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageAssembler(StatefulProcessor):
    """Pages ``(doc, page, text, total, at)`` of one document to its row
    ``(doc, joined, n_pages, n_text_pages, complete)``; ``at`` is event time in
    milliseconds."""

    def __init__(self, wait_ms: int, separator: str):
        self.wait_ms, self.separator = wait_ms, separator

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", "texts array<string>")
        self.known = handle.getValueState("known", "total long, rows long, until long, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, count, until, done = self.known.get() if self.known.exists() else (None, 0, None, False)
        if done:
            return
        latest = None
        for row in rows:
            page = (row.page,)
            before = self.pages.getValue(page)[0] if self.pages.containsKey(page) else []
            self.pages.updateValue(page, ([*before, row.text],))
            count += 1
            total = row.total if total is None or row.total is not None and row.total > total else total
            latest = row.at if latest is None else max(latest, row.at)
        if until is None:
            until = max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait_ms
            self.handle.registerTimer(until)
        done = total is not None and sum(1 for _ in self.pages.keys()) >= total
        self.known.update((total, count, until, done))
        if done:
            yield self.document(key, count, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, count, _, done = self.known.get()
        if not done:
            yield self.document(key, count, False)
        self.known.clear()

    def document(self, key, count: int, complete: bool) -> Row:
        texts = [t for _, (texts,) in sorted(self.pages.iterator(), key=lambda x: x[0])
                 for t in sorted(texts, key=lambda t: (t is not None, t)) if t]
        self.pages.clear()
        return Row(doc=key[0], joined=self.separator.join(texts), n_pages=count, n_text_pages=len(texts), complete=complete)

    def close(self) -> None:
        pass


def assemble_page_stream(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", out_col: str = "text",
                         total_col: str = "n_pages", time_col: str = "ts", wait_seconds: int = 600,
                         lateness: str = "1 minute") -> DataFrame:
    """S6 over a stream of pages; the columns of ``assemble_pages`` and
    ``complete``.

    ``total_col`` is the document's number of pages where a page knows it, else
    null. Pages later than ``lateness`` behind the stream are dropped by the
    watermark, and so are pages of a finished document that come within its
    waiting time. Pages with a null document key are dropped; a null page
    number comes before all others, as in the batch operator. Sets the session's
    state store to RocksDB, which the operator needs.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    doc_type = pages.schema[doc_col].dataType.simpleString()
    rows = (pages.withWatermark(time_col, lateness).filter(F.col(doc_col).isNotNull())
            .select(F.col(doc_col).alias("doc"), F.coalesce(F.col(page_col).cast("long"), F.lit(-(2**63))).alias("page"),
                    F.col(text_col).alias("text"), F.col(total_col).cast("long").alias("total"),
                    F.unix_millis(time_col).alias("at"), F.col(time_col)))
    made = rows.groupBy("doc").transformWithState(
        PageAssembler(wait_seconds * 1000, PAGE_SEPARATOR),
        f"doc {doc_type}, joined string, n_pages long, n_text_pages long, complete boolean", "Append", "EventTime")
    return made.select(F.col("doc").alias(doc_col), clean_text("joined").alias(out_col), "n_pages", "n_text_pages", "complete")
