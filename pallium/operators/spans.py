"""Span-driven tokenization (D15-D18): detector output arrives as a table of
spans ``(doc, start, end, entity_type)`` -- code-point offsets, 0-based, end
exclusive -- and is applied to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pallium.functions.patterns import SPAN_ENTITY_TYPES
from pallium.operators.cascade import ENTRY_TYPE, token, tokenize_cascade


# D16 ------------------------------------------------------------------------
def allowlisted(spans: DataFrame, type_col: str = "entity_type", types: list[str] | None = None) -> DataFrame:
    """Keep spans whose entity type is on the span path's list."""
    return spans.filter(F.col(type_col).isin(*(types or SPAN_ENTITY_TYPES)))


# D18 ------------------------------------------------------------------------
def resolve_overlaps(spans: DataFrame, doc: str, start: str = "start", end: str = "end",
                     type_col: str = "entity_type") -> DataFrame:
    """Merge overlapping spans of a document, so that the result is disjoint
    and covers exactly the positions that the input covers: nothing detected
    is left in clear.

    Spans that overlap, directly or through others, become one span from the
    smallest start to the largest end. It takes the type of its best-ranked
    member: longest first, then earliest start, then smaller type name. Spans
    that only touch stay apart. Spans with ``end <= start`` cover no text and
    are dropped as invalid.

    One shuffle on the document and one window ordered by start: a span opens
    a new group where it starts at or after the largest end before it. The
    work does not depend on the length of a span.
    """
    before = Window.partitionBy(doc).orderBy(start, end, type_col).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(doc).orderBy(start, end, type_col).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    rank = F.struct((F.col(start) - F.col(end)).alias("shorter"), F.col(start).alias("first"), F.col(type_col).alias("name"))
    return (
        spans.select(doc, start, end, type_col)
        .filter(F.col(end) > F.col(start))
        .withColumn("__opens", F.when(reach > F.col(start), 0).otherwise(1))
        .withColumn("__group", F.sum("__opens").over(so_far))
        .groupBy(doc, "__group")
        .agg(F.min(start).alias("__start"), F.max(end).alias("__end"), F.min(rank).alias("__best"))
        .select(doc, F.col("__start").alias(start), F.col("__end").alias(end), F.col("__best.name").alias(type_col))
    )


# D9 on spans, D15, D11 (span order) ----------------------------------------------
def number_spans(spans: DataFrame, doc: str, start: str = "start", type_col: str = "entity_type") -> DataFrame:
    """Right-to-left numbering per (document, type): the last span is 1."""
    w = Window.partitionBy(doc, type_col).orderBy(F.col(start).desc())
    return spans.withColumn("n", F.row_number().over(w))


#: Code points per chunk of a text that pieces are taken from.
CHUNK = 256


def chunked(text: Column) -> Column:
    """The text cut once into chunks of CHUNK code points (the last shorter)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a chunked text. Reads the chunks
    they lie in only, so all pieces of a text cost time linear in the text;
    ``substr`` on the text would scan from its beginning for each piece."""
    first = (start / CHUNK).cast("int")
    last = ((end - 1) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(near, start % CHUNK + 1, end - start)).otherwise(F.lit(""))


def tokenize_spans(docs: DataFrame, spans: DataFrame, doc: str, text_col: str = "text",
                   out_col: str = "tokenized_text", entries_col: str = "entries",
                   start: str = "start", end: str = "end", type_col: str = "entity_type",
                   resolve: bool = True) -> DataFrame:
    """Replace each span by its token.

    Overlapping spans are merged first (``resolve_overlaps``); for disjoint
    spans that changes nothing, and ``resolve=False`` skips it for spans that
    are known to be disjoint.

    Spans are numbered (D9), gathered per document in start order (the
    small span rows are shuffled by document once), and joined to the
    documents. The text is cut into chunks once and rebuilt from the gaps
    between spans and the tokens, in time linear in the text. Entries (D11)
    are in start-descending order over all types. Documents without spans
    keep their text and an empty entry list. Building the plan runs no job.
    """
    # Grouped by document either way, which the numbering and gathering reuse.
    by_doc = resolve_overlaps(spans, doc, start, end, type_col) if resolve else spans.repartition(doc)
    per_doc = number_spans(by_doc, doc, start, type_col).groupBy(doc).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e"), F.col(type_col).alias("t"),
                    F.col("n").cast("int").alias("n"),
                )
            )
        ).alias("__spans")
    )
    j = docs.join(per_doc, doc, "left_outer").withColumn("__chunks", F.when(F.col("__spans").isNotNull(), chunked(F.col(text_col))))
    sp = F.coalesce(F.col("__spans"), F.array().cast("array<struct<s:int,e:int,t:string,n:int>>"))
    text, chunks = F.col(text_col), F.col("__chunks")

    def prev_end(i: Column) -> Column:
        return F.when(i == 0, F.lit(0)).otherwise(F.element_at(sp, i)["e"])

    pieces = F.transform(sp, lambda x, i: F.concat(piece(chunks, prev_end(i), x["s"]), token(x["t"], x["n"])))
    last_end = F.when(F.size(sp) == 0, F.lit(0)).otherwise(F.element_at(sp, -1)["e"])
    rebuilt = F.concat(F.array_join(pieces, ""), F.substr(text, last_end + 1))
    entries = F.transform(
        F.reverse(sp),
        lambda x: F.struct(
            x["t"].alias("entity_type"), x["n"].alias("n"), token(x["t"], x["n"]).alias("token"),
            piece(chunks, x["s"], x["e"]).alias("value"),
        ),
    ).cast(f"array<{ENTRY_TYPE}>")
    return j.withColumn(out_col, F.when(F.size(sp) == 0, text).otherwise(rebuilt)).withColumn(
        entries_col, entries
    ).drop("__spans", "__chunks")


def spans_as_array(spans: DataFrame, doc: str, start: str = "start", end: str = "end",
                   type_col: str = "entity_type") -> DataFrame:
    """Per-document span arrays ``(doc, spans)`` for ``tokenize_with_fallback``."""
    return spans.groupBy(doc).agg(
        F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end"),
                                F.col(type_col).alias("entity_type"))).alias("spans")
    )


# D17 ------------------------------------------------------------------------
def tokenize_with_fallback(docs: DataFrame, doc: str, text_col: str = "text", spans_col: str = "spans",
                           out_col: str = "tokenized_text", entries_col: str = "entries",
                           resolve: bool = True) -> DataFrame:
    """Per document: the span path when the detector produced spans (an
    empty array means it ran and found nothing), the pattern cascade when
    ``spans_col`` is null (the detector was unavailable or failed). Each
    document starts with fresh numbering either way. Detector spans may
    overlap; they are merged first (D18) unless ``resolve=False``.

    The span rows are exploded out of the array column, so the span path
    gets the same join-based plan as ``tokenize_spans``.
    """
    has = docs.filter(F.col(spans_col).isNotNull())
    lacks = docs.filter(F.col(spans_col).isNull())
    flat = has.select(doc, F.explode_outer(spans_col).alias("sp")).filter(F.col("sp").isNotNull()).select(
        doc, "sp.start", "sp.end", "sp.entity_type"
    )
    via_spans = tokenize_spans(has.drop(spans_col), flat, doc, text_col, out_col, entries_col,
                               resolve=resolve).withColumn(
        "path", F.lit("spans")
    )
    via_cascade = tokenize_cascade(lacks.drop(spans_col), text_col, out_col, entries_col).withColumn(
        "path", F.lit("cascade")
    )
    return via_spans.unionByName(via_cascade)
