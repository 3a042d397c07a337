"""Analyzer calls (A2): the one Python step on the data path.

The user supplies ``fn(prompt) -> str``. Spark hands it prompts in Arrow
batches through ``mapInPandas``; only the key and the prompt cross into
Python (the token mapping never reaches the analyzer). Each call is retried:
any exception, or an answer of ``None``, counts as a failed attempt; after
the last attempt the row carries the wrapped error instead of an answer. An
empty string is an answer (the parse step rejects it).

Calls are at-least-once: a lost task re-runs its calls. ``analyze_in_rounds``
bounds what is repeated: prompts are pinned in files and sent in rounds, each
of which commits its answers, so a failure repeats no more than the round it
came in.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pallium.functions.patterns import (
    ANALYZE_ATTEMPTS,
    ANALYZE_WAIT_MAX,
    ANALYZE_WAIT_MIN,
    MSG_CALL_FAILED,
)


def backoff(attempt: int, low: float = ANALYZE_WAIT_MIN, high: float = ANALYZE_WAIT_MAX) -> float:
    """Wait after failed attempt ``attempt`` (1-based): doubling from 1 s,
    clamped to ``[low, high]``."""
    return float(min(max(2.0 ** (attempt - 1), low), high))


def retrying_caller(fn: Callable[[str], str | None], attempts: int = ANALYZE_ATTEMPTS,
                    wait: tuple[float, float] = (ANALYZE_WAIT_MIN, ANALYZE_WAIT_MAX),
                    sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple]:
    """The per-prompt caller: ``prompt -> (answer, attempts used, error)``.

    Everything it uses is local to this function, so Spark ships it to the
    Python workers by value: the workers need the user's ``fn``, not this
    package.
    """
    low, high = wait
    failed = MSG_CALL_FAILED

    def pause(attempt: int) -> float:
        return float(min(max(2.0 ** (attempt - 1), low), high))

    def call(prompt: str) -> tuple[str | None, int, str | None]:
        last = None
        for attempt in range(1, attempts + 1):
            try:
                answer = fn(prompt)
                if answer is None:
                    raise ValueError("analyzer returned no content")
                return str(answer), attempt, None
            except Exception as exc:  # any failure is retried, as in the reference
                last = exc
                if attempt < attempts:
                    sleep(pause(attempt))
        return None, attempts, failed + str(last)

    return call


def call_with_retries(fn: Callable[[str], str | None], prompt: str, attempts: int = ANALYZE_ATTEMPTS,
                      wait: tuple[float, float] = (ANALYZE_WAIT_MIN, ANALYZE_WAIT_MAX),
                      sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """One prompt: ``(answer, attempts used, error)``."""
    return retrying_caller(fn, attempts, wait, sleep)(prompt)


def answer_schema(df: DataFrame, key_col: str) -> T.StructType:
    key_field = df.schema[key_col]
    return T.StructType(
        [
            T.StructField(key_col, key_field.dataType, key_field.nullable),
            T.StructField("raw", T.StringType(), True),
            T.StructField("n_attempts", T.IntegerType(), False),
            T.StructField("call_error", T.StringType(), True),
        ]
    )


def analyze(df: DataFrame, fn: Callable[[str], str | None], key_col: str = "doc_id", prompt_col: str = "prompt",
            attempts: int = ANALYZE_ATTEMPTS, wait: tuple[float, float] = (ANALYZE_WAIT_MIN, ANALYZE_WAIT_MAX),
            concurrency: int = 1) -> DataFrame:
    """A2: ``(key, raw, n_attempts, call_error)`` for each ``(key, prompt)``.

    ``concurrency`` > 1 runs that many calls at once inside each task (a
    thread pool over the Arrow batch; output order kept). Remote analyzers
    are I/O-bound, so this raises throughput without more executors; the
    cluster-wide number of calls in flight is tasks x ``concurrency``.
    """
    out_schema = answer_schema(df, key_col)
    sleep = time.sleep if wait[1] > 0 else (lambda _s: None)
    one = retrying_caller(fn, attempts, wait, sleep)

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        pool = ThreadPoolExecutor(max_workers=concurrency) if concurrency > 1 else None

        for pdf in batches:
            prompts = list(pdf[prompt_col])
            results = list(pool.map(one, prompts)) if pool else [one(p) for p in prompts]
            yield pd.DataFrame(
                {
                    key_col: pdf[key_col].values,
                    "raw": [r[0] for r in results],
                    "n_attempts": pd.Series([r[1] for r in results], dtype="int32"),
                    "call_error": [r[2] for r in results],
                }
            )
        if pool:
            pool.shutdown()

    return df.select(key_col, prompt_col).mapInPandas(run, out_schema)


#: Prompts that a task calls for in a round, for each call it makes at once.
ROUND_CALLS = 32


def call_tasks(spark) -> int:
    """Tasks that analyzer calls are dealt over: all cores busy, whatever the
    size of the prompts."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def analyze_in_rounds(df: DataFrame, fn: Callable[[str], str | None], folder: str, key_col: str = "doc_id",
                      prompt_col: str = "prompt", attempts: int = ANALYZE_ATTEMPTS,
                      wait: tuple[float, float] = (ANALYZE_WAIT_MIN, ANALYZE_WAIT_MAX), concurrency: int = 1,
                      round_calls: int = ROUND_CALLS) -> DataFrame:
    """``analyze`` with answers committed round by round; runs at once.

    The prompts are written below ``folder`` (on shared storage), in files of
    ``round_calls`` times ``concurrency`` prompts. A stream over these files
    takes as many at a time as there are tasks, calls, and commits the answers
    of the round (availableNow: it ends with the last file). Called again with
    the folder of a run that failed, it takes the prompts from there and goes
    on after the last round committed: a lost task repeats its calls of one
    round, a lost driver at most one round.
    """
    spark = df.sparkSession
    schema = answer_schema(df, key_col)
    tasks, prompts, answers = call_tasks(spark), f"{folder}/prompts", f"{folder}/answers"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{prompts}/_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = df.select(key_col, prompt_col)
    if not files.exists(path):
        # By a hash of the key: dealt by the key itself, the shuffle could be
        # merged with one before it, whose partitions may be coalesced.
        (rows.repartition(tasks, F.xxhash64(key_col)).write.mode("overwrite")
         .option("maxRecordsPerFile", str(max(1, round_calls * concurrency))).parquet(prompts))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(tasks)).parquet(prompts)
    called = analyze(stream, fn, key_col, prompt_col, attempts, wait, concurrency)
    (called.writeStream.format("parquet").option("path", answers).option("checkpointLocation", f"{folder}/rounds")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(answers)
