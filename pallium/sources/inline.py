"""Inline text and paged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.functions.patterns import DEFAULT_INLINE_LABEL, PAGE_SEPARATOR
from pallium.functions.text import clean_text


def inline_source(df: DataFrame, text_col: str = "text", label_col: str = "source_identifier",
                  default_label: str = DEFAULT_INLINE_LABEL) -> DataFrame:
    """Rows of inline text with a source label; a missing label takes the
    default (``direct_input`` for the library, ``api_input`` for requests)."""
    label = F.col(label_col) if label_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(label_col, F.coalesce(label, F.lit(default_label)))


def assemble_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text",
                   out_col: str = "text") -> DataFrame:
    """One document per ``doc_col`` from its pages in page order.

    Empty (or null) pages are dropped, the rest joined with a blank line, and
    the result cleaned. A document whose pages are all empty comes out as
    ``''`` (the blank check rejects it later).

    The grouping is one shuffle on the document key with the pages' text as
    payload; each group is exactly one output document, so what a task holds
    for a group is bounded by that document's size.
    """
    collected = pages.groupBy(doc_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t")))).alias(
            "__pages"
        ),
        F.count(F.lit(1)).alias("n_pages"),
    )
    kept = F.filter(F.col("__pages"), lambda x: F.coalesce(x["t"], F.lit("")) != F.lit(""))
    joined = F.array_join(F.transform(kept, lambda x: x["t"]), PAGE_SEPARATOR)
    return collected.select(
        doc_col,
        clean_text(joined).alias(out_col),
        F.col("n_pages").cast("bigint").alias("n_pages"),
        F.size(kept).cast("bigint").alias("n_text_pages"),
    )
