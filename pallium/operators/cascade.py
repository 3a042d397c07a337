"""Pattern cascade: detection and tokenization of personal data.

Each stage makes one regex pass: every match is wrapped in a sentinel
character, and a literal (non-regex) split on that character yields
``[piece, match, piece, ..., piece]``. The text is rebuilt with ``transform``
and ``array_join``, numbering the matches right to left (the last match of a
type is number 1). The stage's mapping entries are its matches reversed and
numbered from 1.

Stages run on the output of the previous stage, in cascade order, so the
entry array ends up in token-issue order: type by type, and within a type by
number. The seven stages form one nested expression, each stage's input
bound once. It is evaluated inside a generator, which is also an optimizer
barrier. There is no shuffle and no Python on this path.

The sentinel is U+0001, which cleaning turns into a space. A text that holds
it all the same is split and matched in two passes without a sentinel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.patterns import (
    CASCADE_PATTERNS,
    CASCADE_TYPES,
    TOKEN_PREFIX,
    TOKEN_SUFFIX,
    java_pattern,
)

SENTINEL = "\u0001"

ENTRY_TYPE = "struct<entity_type:string,n:int,token:string,value:string>"


def token(entity_type: Column | str, n: Column) -> Column:
    """``[PII_<TYPE>_<n>]``."""
    et = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.concat(F.lit(TOKEN_PREFIX), et, F.lit("_"), n.cast("string"), F.lit(TOKEN_SUFFIX))


def detect(c: Column | str, entity_type: str) -> Column:
    """All matches of one pattern, left to right, as array<string>."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(col, F.lit(java_pattern(entity_type)), F.lit(0))


def split_matches(col: Column, entity_type: str) -> Column:
    """The text split into alternating pieces and matches, ``[piece, match,
    piece, ..., piece]``: one regex pass wraps each match in U+0001, then a
    literal split on that character."""
    pattern = java_pattern(entity_type)
    wrapped = F.split(F.regexp_replace(col, pattern, SENTINEL + "$0" + SENTINEL), SENTINEL, -1)
    matches = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    # One piece more than matches: the last match is null.
    apart = F.flatten(F.zip_with(F.split(col, pattern, -1), matches,
                                 lambda piece, match: F.when(match.isNull(), F.array(piece)).otherwise(F.array(piece, match))))
    return F.when(F.contains(col, F.lit(SENTINEL)), apart).otherwise(wrapped)


def stage_guards(text: Column) -> dict[str, Column]:
    """Cheap per-row tests on the *original* text; a stage whose test fails
    cannot match and its regex is skipped.

    Exact because the tokens inserted by earlier stages never supply what a
    later match needs: they hold no ``@``, ``-``, ``:`` or ``/``, and their
    digits follow ``_`` (no word boundary) and precede ``]`` (no separator or
    dot), so every numeric match consists of digits of the original text.
    """
    has_digit = text.rlike(r"(?U)\d")
    return {
        "EMAIL": text.contains("@"),
        "PHONE": has_digit,
        "SSN": text.contains("-") & has_digit,
        "CREDIT_CARD": has_digit,
        "IP_ADDRESS": text.contains(".") & has_digit,
        "URL": text.contains("http"),
    }


def _sql_str(value: str) -> str:
    """A Spark SQL string literal (backslash escapes are on by default)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stage_sql(acc: str, entity_type: str, guard_col: str | None) -> str:
    """One cascade stage as an SQL expression over ``acc``, a
    ``struct<t: text so far, e: entries so far>``.

    The stage's inputs are bound once through a one-element ``transform``
    (a let): one regex pass wraps each match in U+0001, a literal split on it
    yields ``[piece, match, piece, ..., piece]``, and the lambda rebuilds the
    text (matches numbered right to left) and appends the stage's entries
    (matches reversed, numbered from 1). Rows whose guard is false, or with
    no match, keep ``acc`` as it is.
    """
    pattern = _sql_str(java_pattern(entity_type))
    apart = (
        f"flatten(zip_with(split(x0.t, {pattern}, -1), regexp_extract_all(x0.t, {pattern}, 0), "
        f"(a, b) -> CASE WHEN b IS NULL THEN array(a) ELSE array(a, b) END))"
    )
    marked = (
        f"CASE WHEN contains(x0.t, char(1)) THEN {apart} ELSE "
        f"split(regexp_replace(x0.t, {pattern}, concat(char(1), '$0', char(1))), char(1), -1) END"
    )
    if guard_col is not None:
        marked = f"CASE WHEN `{guard_col}` THEN {marked} END"
    pre = _sql_str(f"{TOKEN_PREFIX}{entity_type}_")
    suf = _sql_str(TOKEN_SUFFIX)
    rebuilt = (
        f"array_join(transform(x.p, (s, i) -> CASE WHEN i % 2 = 0 THEN s "
        f"ELSE concat({pre}, CAST(shiftright(size(x.p) - 1, 1) - shiftright(i - 1, 1) AS STRING), {suf}) END), '')"
    )
    new_entries = (
        f"transform(reverse(filter(x.p, (s, i) -> i % 2 = 1)), (v, k) -> named_struct("
        f"'entity_type', '{entity_type}', 'n', k + 1, 'token', concat({pre}, CAST(k + 1 AS STRING), {suf}), "
        f"'value', v))"
    )
    step = (
        f"transform(array(named_struct('a', x0, 'p', {marked})), x -> "
        f"CASE WHEN x.p IS NULL OR size(x.p) <= 1 THEN x.a "
        f"ELSE named_struct('t', {rebuilt}, 'e', concat(x.a.e, {new_entries})) END)[0]"
    )
    return f"transform(array({acc}), x0 -> {step})[0]"


def tokenize_cascade(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "tokenized_text",
    entries_col: str = "entries",
    types: list[str] | None = None,
) -> DataFrame:
    """Apply the seven patterns in order, each on the previous output.

    Adds ``out_col`` (tokenized text) and ``entries_col``, an
    ``array<struct<entity_type, n, token, value>>`` in token-issue order.
    ``types`` restricts the cascade to a subset (kept in cascade order).

    The whole cascade is one expression, evaluated once per row inside the
    generator that also serves as the optimizer barrier; no intermediate rows
    are materialized between stages.
    """
    wanted = [t for t in CASCADE_TYPES if types is None or t in types]
    guards = stage_guards(F.col(text_col))
    guard_cols = {t: f"__pallium_can_{t.lower()}" for t in guards if t in wanted}
    keep = [c for c in df.columns if c not in (out_col, entries_col)]
    acc = f"named_struct('t', `{text_col}`, 'e', CAST(array() AS array<{ENTRY_TYPE}>))"
    for entity_type in wanted:
        acc = _stage_sql(acc, entity_type, guard_cols.get(entity_type))
    staged = df.select(*keep, *[guards[t].alias(c) for t, c in guard_cols.items()])
    # The generator emits the result as plain columns, and a predicate on a
    # generator's output stays above it. Without that, a user filter on the
    # tokenized text would be pushed down with the whole cascade substituted
    # into it, and run a second time before the rows are spread. The outer
    # form keeps the optimizer from inferring a ``size > 0`` predicate over
    # the same expression. One row in, one row out.
    named = f"transform(array({acc}), r -> named_struct('__pallium_t', r.t, '__pallium_e', r.e))"
    out = staged.select(*keep, F.inline_outer(F.expr(named)))
    return out.select(*keep, F.col("__pallium_t").alias(out_col), F.col("__pallium_e").alias(entries_col))


def explode_rows(df: DataFrame, keep: list[str], c: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of an array column (``pos``: 0-based position);
    rows without elements vanish.

    The outer generator followed by a null filter on its output is used on
    purpose: for an inner explode the optimizer infers ``size(c) > 0`` and
    pushes that predicate below the projections and the spreading shuffle,
    which copies the whole cascade into a filter running before the
    repartition (computed twice, the first time unspread). A filter on the
    generator's own output cannot be pushed below it.
    """
    if pos is None:
        out = df.select(*keep, F.explode_outer(c).alias(name))
    else:
        out = df.select(*keep, F.posexplode_outer(c).alias(pos, name))
    return out.filter(F.col(name).isNotNull())


def mapping(entries: Column | str) -> Column:
    """Token -> value map built from ordered entries."""
    e = F.col(entries) if isinstance(entries, str) else entries
    return F.map_from_entries(F.transform(e, lambda x: F.struct(x["token"], x["value"])))


def entity_count(m: Column | str) -> Column:
    """Number of mapping entries; 0 when the mapping is null or empty."""
    c = F.col(m) if isinstance(m, str) else m
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


def type_count(entries: Column | str, entity_type: str) -> Column:
    """D13 per row: number of tokens of one type."""
    e = F.col(entries) if isinstance(entries, str) else entries
    return F.size(F.filter(e, lambda x: x["entity_type"] == F.lit(entity_type))).cast("bigint")


def counts_by_type(df: DataFrame, key_cols: list[str], entries_col: str = "entries") -> DataFrame:
    """D13 as rows ``(keys..., entity_type, n_entities)``; types without hits
    are absent. Counting happens inside each row (no shuffle)."""
    per_type = F.filter(
        F.array(
            *[
                F.struct(F.lit(t).alias("entity_type"), type_count(entries_col, t).alias("n_entities"))
                for t in CASCADE_TYPES
            ]
        ),
        lambda x: x["n_entities"] > 0,
    )
    return explode_rows(df, key_cols, per_type, "__item").select(*key_cols, "__item.entity_type", "__item.n_entities")


def token_vault(df: DataFrame, key_cols: list[str], entries_col: str = "entries") -> DataFrame:
    """One row per issued token ``(keys..., seq, entity_type, n, token,
    value)``; ``seq`` is the 0-based insertion position in the mapping."""
    return explode_rows(df, key_cols, F.col(entries_col), "__item", pos="__seq").select(
        *key_cols,
        F.col("__seq").cast("bigint").alias("seq"),
        "__item.entity_type",
        F.col("__item.n").cast("bigint").alias("n"),
        "__item.token",
        "__item.value",
    )


def census_sketches(vault: DataFrame, doc_number: str, group_col: str) -> DataFrame:
    """Per (group, entity type) the entities and the set of documents, as
    exact bitmaps: one row for each 32,768 document numbers that occur.

    ``vault`` holds one row per token (D19) carrying ``group_col``, and
    documents are numbered (``doc_number``, an integer; dense numbers make
    small bitmaps). Bitmaps are built in the tasks and merged by key, so a
    document's tokens need not meet (tokens of a null document count, it
    doesn't), and sketches of several tables, days for
    instance, can be stored and added up by :func:`merge_sketches`."""
    number = F.col(doc_number).cast("bigint")
    return vault.groupBy(group_col, "entity_type", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("docs"))


def merge_sketches(sketches: DataFrame, group_col: str) -> DataFrame:
    """Sketches of several tables (a union of them) as those of all: a document
    that occurs in more than one counts once."""
    return sketches.groupBy(group_col, "entity_type", "bucket").agg(
        F.sum("n").cast("bigint").alias("n"), F.bitmap_or_agg("docs").alias("docs"))


def census_of(sketches: DataFrame, group_col: str) -> DataFrame:
    """D20 from sketches: entities and distinct documents per (group, entity
    type), per group and in all. Subtotals merge bitmaps; no document is
    looked at again."""
    levels = [[group_col, "entity_type", "bucket"], [group_col, "bucket"], ["bucket"]]
    merged = sketches.groupingSets([[F.col(c) for c in level] for level in levels], F.col(group_col), F.col("entity_type"),
                                   F.col("bucket")).agg(
        F.grouping_id().alias("__level"), F.sum("n").alias("n"), F.bitmap_count(F.bitmap_or_agg("docs")).alias("n_docs"))
    counted = merged.groupBy("__level", group_col, "entity_type").agg(
        F.sum("n").cast("bigint").alias("n_entities"), F.sum("n_docs").cast("bigint").alias("n_docs"))
    return counted.select(group_col, "entity_type", "n_entities", "n_docs")


def pii_census(vault: DataFrame, doc_key: str, group_col: str) -> DataFrame:
    """Documents and entities per (group, entity type) with subtotals.

    An integer key is taken as the document's number, and documents are
    counted by bitmaps (:func:`census_of`). Other keys are counted as they
    are: tokens first per (document, group, type), so that the ``rollup``'s
    expansion and its distinct count work on that much smaller table.
    """
    if vault.schema[doc_key].dataType.typeName() in ("byte", "short", "integer", "long"):
        return census_of(census_sketches(vault, doc_key, group_col), group_col)
    per_doc = vault.groupBy(doc_key, group_col, "entity_type").agg(F.count(F.lit(1)).alias("__n"))
    return per_doc.rollup(group_col, "entity_type").agg(
        F.sum("__n").cast("bigint").alias("n_entities"),
        F.countDistinct(doc_key).alias("n_docs"),
    )


__all__ = [
    "CASCADE_PATTERNS",
    "census_of",
    "census_sketches",
    "counts_by_type",
    "detect",
    "entity_count",
    "mapping",
    "merge_sketches",
    "pii_census",
    "token",
    "token_vault",
    "tokenize_cascade",
    "type_count",
]
