"""File sources (S1-S4): whole files as rows, suffix dispatch, missing
inputs, and decoding with a Latin-1 fallback.

Files are read with Spark's ``binaryFile`` source, one file per row, split
over tasks by the scan. Zero-byte files are not returned by that source;
``read_files`` adds them on request. ``missing_inputs`` reports requested
paths that were not found, with an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.functions.patterns import (
    MSG_FILE_NOT_FOUND,
    MSG_UNSUPPORTED_SUFFIX,
    PAGED_SUFFIXES,
    TEXT_SUFFIXES,
)
from pallium.functions.text import clean_text, decode_bytes, file_suffix

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True,
               include_empty: bool = False) -> DataFrame:
    """One row per file ``(path, modificationTime, length, content)``.

    The scan leaves out zero-byte files; ``include_empty`` adds them with
    empty content."""
    reader = spark.read.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.unionByName(empty_files(spark, path, glob, recursive)) if include_empty else files


def empty_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """The zero-byte files of a folder in the schema of ``read_files``, listed
    in tasks; hidden names are left out, ``glob`` applies to names."""
    from pallium.sources.landing import list_files

    listed = list_files(spark, path, glob, recursive).filter("length = 0")
    return listed.withColumn("content", F.lit(b""))


def dispatch(df: DataFrame, name_col: str = "path") -> DataFrame:
    """Suffix (lower-cased), reader ``kind`` (``paged`` / ``text``) and an
    error naming the suffix for anything else."""
    suffix = file_suffix(name_col)
    kind = (
        F.when(suffix.isin(*PAGED_SUFFIXES), F.lit("paged"))
        .when(suffix.isin(*TEXT_SUFFIXES), F.lit("text"))
    )
    return df.withColumn("suffix", suffix).withColumn("kind", kind).withColumn(
        "error", F.when(F.col("kind").isNull(), F.concat(F.lit(MSG_UNSUPPORTED_SUFFIX), F.col("suffix")))
    )


def missing_inputs(requested: DataFrame, found: DataFrame, key: str, path_col: str | None = None) -> DataFrame:
    """S3: requested inputs absent from what was found, as error rows.

    A left anti join on the key: both sides shuffle on the key only (or the
    smaller side is broadcast when its measured size allows), so a hot key is
    never paired with itself."""
    missing = requested.join(found.select(key).distinct(), key, "left_anti")
    label = F.col(path_col) if path_col else F.col(key).cast("string")
    return missing.withColumn("error", F.concat(F.lit(MSG_FILE_NOT_FOUND), label))


def decode_content(content: Column | str) -> Column:
    """S4 as a column: UTF-8, or Latin-1 when the bytes are not valid UTF-8."""
    return decode_bytes(content)


def text_documents(files: DataFrame) -> DataFrame:
    """S1 + S2 + S4 + C5 for text files: ``(path, text, kind, error)``.

    Paged files need their pages extracted first (``assemble_pages``); here
    they keep ``text`` null with kind ``paged``."""
    d = dispatch(files, "path")
    text = F.when(F.col("kind") == "text", clean_text(decode_content("content")))
    return d.select("path", "length", "suffix", "kind", "error", text.alias("text"))
