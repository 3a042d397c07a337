"""End-to-end flows (P1, P2): text or files in, analysed and restored
results out, optionally appended to the result table.

Text path: clean -> blank check -> cascade -> prompt -> analyzer -> strict
parse -> detokenize the answer -> envelope (-> store). Everything but a
Python analyzer is built-in expressions in one narrow stage; there is no
shuffle before the analyzer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pallium.functions.patterns import DEFAULT_INLINE_LABEL, MSG_BLANK_FILE, MSG_BLANK_TEXT
from pallium.functions.text import clean_text
from pallium.operators import answers as an
from pallium.operators import cascade as cz
from pallium.operators import detokenize as dt
from pallium.operators.analyze import analyze_in_rounds
from pallium.session import pinned, scratch
from pallium.sources import files as fs
from pallium.sources.inline import assemble_pages, inline_source


class NativeAnalyzer:
    """An analyzer written as a Column expression (prompt -> raw answer).
    It runs inside the JVM stage with no Python round trip."""

    def __init__(self, fn: Callable[[Column], Column]):
        self.fn = fn

    def __call__(self, prompt: Column) -> Column:
        return self.fn(prompt)


TOKEN_SHAPE = r"\[PII_[A-Z_]+_[0-9]+\]"

# Our own message: paged files reach the flow only as assembled pages.
MSG_NEEDS_PAGES = "Paged file needs page extraction"


def echo_analyzer(prompt: Column) -> Column:
    """Stand-in analyzer: echoes the tokens it sees as a small JSON answer
    (person tokens as parties, the first token as purpose, counts)."""
    tokens = F.regexp_extract_all(prompt, F.lit(TOKEN_SHAPE), F.lit(0))
    persons = F.filter(tokens, lambda t: t.startswith("[PII_PERSON_"))
    return F.to_json(
        F.struct(
            F.struct(
                F.lit("document").alias("contract_type"),
                persons.alias("main_parties"),
                F.coalesce(F.get(tokens, 0), F.lit("")).alias("primary_purpose"),
            ).alias("contract_summary"),
            F.size(tokens).alias("n_tokens"),
            F.char_length(prompt).alias("n_chars"),
        )
    )


ECHO = NativeAnalyzer(echo_analyzer)


def analyze_texts(
    df: DataFrame,
    analyzer: NativeAnalyzer | Callable[[str], str | None],
    key_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "source_identifier",
    default_label: str = DEFAULT_INLINE_LABEL,
    blank_message: str = MSG_BLANK_TEXT,
    precleaned: bool = False,
    attempts: int = 3,
    wait: tuple[float, float] = (4.0, 10.0),
    concurrency: int = 1,
    dedupe_prompts: bool = True,
    answer_cache: str | None = None,
    pins: list[DataFrame | str] | None = None,
    calls_dir: str | None = None,
) -> DataFrame:
    """P1 over a table of texts.

    Returns one row per input: ``key, original_file, success, error,
    pii_entities_found, tokenized_text, entries, token_mapping, ai_response,
    detokenized_response, parse_ok, token_collision`` (the source already
    held a token-shaped string, L3). Failed rows (blank text, analyzer
    exhausted) carry ``error`` and no result fields; they are never stored.

    A Python ``analyzer`` is called through ``analyze_in_rounds`` (A2); the
    tokenized rows are pinned in the reliable checkpoint folder first, and the
    answers are committed round by round, so a lost executor neither re-runs
    the cascade nor calls the analyzer again for answers of finished rounds.
    With ``calls_dir``, a folder on shared storage, a failed job that is run
    again on the same rows goes on after its last round. Calls are dealt over
    a fixed number of tasks, so that all cores wait on the analyzer. With ``dedupe_prompts`` (default) it is called once per distinct
    prompt: prompts are keyed by their SHA-256, de-duplicated (partial
    aggregation map-side), and the answers joined back on the hash, those of
    much repeated prompts in parts (``_join_answers``). Blank rows stay out of
    both. With ``answer_cache`` (a parquet
    folder on shared storage, used with ``dedupe_prompts``) successful
    answers are kept across runs: prompts answered before are not sent
    again, so rerunning a failed job does not repeat finished calls. ``pins``
    collects the pinned frames; once the result is written, ``release`` may
    remove their files.
    """
    d = inline_source(df, text_col, label_col, default_label)
    cleaned = F.col(text_col) if precleaned else clean_text(text_col)
    d = d.select(key_col, F.col(label_col).alias("original_file"), cleaned.alias("__clean"))
    blank_err = F.when(F.col("__clean") == F.lit(""), F.lit(blank_message))
    d = d.withColumn("__blank", blank_err).withColumn("token_collision", dt.token_collisions("__clean"))
    tok = cz.tokenize_cascade(d, "__clean", "tokenized_text", "entries")
    prompt = an.build_prompt("tokenized_text")

    if isinstance(analyzer, NativeAnalyzer):
        answered = tok.withColumn("raw", F.when(F.col("__blank").isNull(), analyzer(prompt))).withColumn(
            "call_error", F.lit(None).cast("string")
        )
    else:
        call_key = "__prompt_sha" if dedupe_prompts else key_col
        if dedupe_prompts:
            tok = tok.withColumn(call_key, F.when(F.col("__blank").isNull(), F.sha2(prompt, 256)))
        tok = pinned(tok.drop("__clean"), pins)
        blank = tok.filter(F.col("__blank").isNotNull())
        tok = tok.filter(F.col("__blank").isNull())
        todo = tok.select(call_key, "tokenized_text")
        if dedupe_prompts:
            todo = todo.dropDuplicates([call_key])
        cached = _cached_answers(df.sparkSession, answer_cache, call_key) if dedupe_prompts else None
        if cached is not None:
            todo = todo.join(cached.select(call_key), call_key, "left_anti")
        folder = calls_dir or scratch(df.sparkSession, "calls")
        if pins is not None and calls_dir is None:
            pins.append(folder)
        calls = analyze_in_rounds(todo.select(call_key, prompt.alias("prompt")), analyzer, folder, call_key, "prompt", attempts,
                                  wait, concurrency)
        if cached is not None or (answer_cache and dedupe_prompts):
            calls.filter(F.col("call_error").isNull()).select(call_key, "raw", "call_error").write.mode(
                "append"
            ).parquet(answer_cache)
            if cached is not None:
                calls = calls.select(call_key, "raw", "call_error").unionByName(cached)
        answered = _join_answers(tok, calls.select(call_key, "raw", "call_error"), call_key, key_col).unionByName(
            blank, allowMissingColumns=True)

    parsed = an.parse_answer(answered, "raw")
    error = F.coalesce(F.col("__blank"), F.col("call_error"))
    ok = error.isNull()
    mapping = cz.mapping("entries")
    return parsed.select(
        key_col,
        "original_file",
        *an.outcome_envelope(error, cz.entity_count(mapping)),
        F.when(ok, F.col("tokenized_text")).alias("tokenized_text"),
        F.when(ok, F.col("entries")).alias("entries"),
        F.when(ok, mapping).alias("token_mapping"),
        F.when(ok, F.col("answer_json")).alias("ai_response"),
        F.when(ok, dt.detokenize_json("answer_json", "entries")).alias("detokenized_response"),
        F.when(ok, F.col("parse_ok")).alias("parse_ok"),
        "token_collision",
    )


def _cached_answers(spark, path: str | None, call_key: str) -> DataFrame | None:
    """Answers kept by earlier runs (successes only), or None."""
    if not path:
        return None
    try:
        kept = spark.read.schema(f"`{call_key}` string, raw string, call_error string").parquet(path)
        # one answer per prompt even if two runs both stored one
        return kept.dropDuplicates([call_key])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no cache written yet


#: Rows of one prompt that are joined to its answer in one part, at least.
PART_ROWS = 64
#: A prompt is repeated much if it makes up more than one in so many rows; there
#: are fewer such prompts than this, which bounds what is broadcast.
MOST_HOT = 10_000


def _join_answers(rows: DataFrame, calls: DataFrame, call_key: str, key_col: str) -> DataFrame:
    """Rows with their answers. A prompt that makes up a large part of the rows
    is joined in parts of its rows, each with a copy of its answer, so it makes
    no hot task even without adaptive execution."""
    most = max(PART_ROWS, rows.count() // MOST_HOT)
    parts = (rows.groupBy(call_key).count().filter(F.col("count") > most)
             .select(F.col(call_key).alias("__hot"), F.least(F.ceil(F.col("count") / most), F.lit(1024)).cast("int").alias("__parts")))
    parts = F.broadcast(parts)
    n = F.coalesce("__parts", F.lit(1))
    dealt = (rows.join(parts, rows[call_key] == parts["__hot"], "left")
             .withColumn("__part", F.pmod(F.xxhash64(key_col), n).cast("int")).drop("__hot", "__parts"))
    copies = (calls.join(parts, calls[call_key] == parts["__hot"], "left")
              .withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1))).drop("__hot", "__parts"))
    return dealt.join(copies, [call_key, "__part"], "left_outer").drop("__part")


def store_outcomes(store, outcomes: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """P1/P2 last step (S7 + A7): append the successful rows to the result
    table and return every outcome with its ``contract_id`` (null for
    failures, which are never stored)."""
    ok = outcomes.filter(F.col("success")).select(
        key_col, "original_file", "tokenized_text", "ai_response", "detokenized_response", "token_mapping",
        F.transform("entries", lambda e: F.struct(e["token"].alias("token"), e["value"].alias("value"))).alias(
            "token_entries"
        ),
    )
    ids = store.append(ok, key_cols=[key_col]).select(key_col, F.col("id").alias("contract_id"))
    return outcomes.join(ids, key_col, "left_outer")


def analyze_files(files: DataFrame, analyzer, pages: DataFrame | None = None, **kw) -> DataFrame:
    """Files through the same flow, one row per file. ``files`` is a
    ``binaryFile`` frame (``read_files``, which can add empty files).

    Text files are decoded here. Paged files take their text from ``pages``
    (``path, page_no, text``, extracted elsewhere), assembled in page order;
    without pages they come out as failures, and so do unsupported suffixes.
    Works on a batch, or on a stream if the analyzer is native.
    """
    docs = fs.text_documents(files)
    error = F.col("error")
    if pages is not None:
        whole = assemble_pages(pages, "path", "page_no").select(F.col("path").alias("__path"), F.col("text").alias("__pages"))
        docs = docs.join(whole, (docs["path"] == whole["__path"]) & (docs["kind"] == "paged"), "left").withColumn(
            "text", F.coalesce("text", "__pages"))
    error = F.coalesce(error, F.when((F.col("kind") != "text") & F.col("text").isNull(), F.lit(MSG_NEEDS_PAGES)))
    docs = docs.withColumn("error", error)
    res = analyze_texts(
        docs.filter(F.col("error").isNull()).select(F.col("path").alias("doc_key"), F.col("path").alias("source_identifier"), "text"),
        analyzer, key_col="doc_key", blank_message=MSG_BLANK_FILE, precleaned=True, **kw,
    )
    failed = docs.filter(F.col("error").isNotNull()).select(
        F.col("path").alias("doc_key"),
        F.col("path").alias("original_file"),
        F.lit(False).alias("success"),
        "error",
    )
    return res.unionByName(failed, allowMissingColumns=True)


def analyze_folder(spark, path: str, analyzer, glob: str | None = None, recursive: bool = True,
                   pages: DataFrame | None = None, **kw) -> DataFrame:
    """P2 over a folder: every file gives one row, empty ones as blank."""
    return analyze_files(fs.read_files(spark, path, glob, recursive, include_empty=True), analyzer, pages, **kw)
