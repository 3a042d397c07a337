"""Result table and the queries over it.

The stored results are a parquet table of parts, each written once by one
job. A small manifest names the parts of a version and the largest id ever
given; an append or a delete becomes visible by its manifest alone, so one
that fails halfway is never seen. Parquet files cannot delete rows: a delete
rewrites the parts that hold them, and ``purge_versions`` removes what older
versions still hold.

The query functions take any DataFrame, so they serve the result table and,
in the registered checks, the driver's tables standing in for it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pallium.functions.patterns import DEFAULT_PAGE_SIZE
from pallium.session import pinned
from pallium.sources.paging import SHALLOW, deep_page

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("original_file", T.StringType(), False),
        T.StructField("tokenized_text", T.StringType(), False),
        T.StructField("ai_response", T.StringType(), False),
        T.StructField("detokenized_response", T.StringType(), False),
        T.StructField("token_mapping", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField(
            "token_entries",
            T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("value", T.StringType())])),
            True,
        ),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)


# S10 ------------------------------------------------------------------------
def utc_now() -> Column:
    """Creation time as a naive UTC timestamp, whatever the session zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


# S9 -------------------------------------------------------------------------
_ROW_BITS = 33


def _positions(df: DataFrame) -> DataFrame:
    """``df`` pinned, each row with its partition and its place in it."""
    return pinned(df.withColumn("__part", F.spark_partition_id())
                  .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))


def assign_ids(df: DataFrame, order_by: list[Column | str], start: int | Column = 1, id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """Unique, increasing ids in ``order_by`` order, from ``start``.

    The input is read once, into the reliable checkpoint folder, each row with
    its position. Only sort key and position are then range-partitioned (the
    range bounds come from the pinned rows) and sorted within partitions; rows
    per partition, one number each, become running offsets, and offset plus
    place is the id. The ids join back to the pinned rows by position, a hash
    join with the narrow side in memory. Rows themselves are never sorted, and
    no window sees the data in one partition.

    Put a unique column last in ``order_by`` so ties are broken and a hot
    leading value is still split over partitions by the range bounds.
    """
    n = num_partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    rows = _positions(df)
    place = [F.col("__part").alias("__of"), F.col("__row").alias("__at")]
    laid = _positions(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).select(*place))
    counts = laid.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    base = F.lit(start) if isinstance(start, int) else start
    ids = laid.join(F.broadcast(offsets), "__part").select(
        F.col("__of").alias("__part"), F.col("__at").alias("__row"), (F.col("__off") + F.col("__row")).alias("__id"))
    return (rows.join(ids.hint("shuffle_hash"), ["__part", "__row"])
            .withColumn(id_col, (base + F.col("__id")).cast("bigint")).drop("__part", "__row", "__id"))


def number_rows(df: DataFrame, start: int, id_col: str = "id") -> tuple[DataFrame, int]:
    """Unique ids from ``start`` on in the order of the rows' partitions, and
    how many there are. The rows are pinned once, so the input is read once
    and not shuffled."""
    laid = _positions(df)
    # One row per partition.
    counts = sorted(tuple(r) for r in laid.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, start + total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __base long"))
    numbered = laid.join(base, "__part").withColumn(id_col, F.col("__base") + F.col("__row"))
    return numbered.drop("__part", "__row", "__base"), total


# Q1-Q6, Q8 -------------------------------------------------------------------
def get_by_id(df: DataFrame, id_value: int | Column, id_col: str = "id") -> DataFrame:
    """Q1: the row with this id, or nothing. The predicate reaches the parquet
    scan (row groups skipped by their statistics)."""
    return df.filter(F.col(id_col) == id_value).limit(1)


def newest_first(time_col: str = "created_at", id_col: str = "id") -> list[Column]:
    """Listing order: creation time descending, ties by id descending."""
    return [F.col(time_col).desc(), F.col(id_col).desc()]


def page(df: DataFrame, limit: int = DEFAULT_PAGE_SIZE, offset: int = 0, order: list[Column] | None = None,
         time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """Q2: one page in listing order. Sort + offset + limit plan as a top-k
    (each task keeps offset+limit rows), not a full sort; pages deep in the
    listing order are found by counting (``deep_page``)."""
    if order is None and offset and offset + limit > SHALLOW:
        return deep_page(df, limit, offset, time_col, id_col)
    ordered = df.orderBy(*(order or newest_first(time_col, id_col)))
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def total_count(df: DataFrame) -> DataFrame:
    """Q3: the true total row count (partial counts map-side)."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_with_total(df: DataFrame, limit: int = DEFAULT_PAGE_SIZE, offset: int = 0,
                    order: list[Column] | None = None, time_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """Q4: the page, each row carrying the table total as a scalar subquery
    (computed once, no join)."""
    total = total_count(df).scalar()
    return page(df, limit, offset, order, time_col, id_col).withColumn("total", total)


def iso_time(c: Column | str) -> Column:
    """Q8: ISO text; fractional seconds only when the microseconds are not 0."""
    ts = F.col(c) if isinstance(c, str) else c
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(
        F.date_format(ts, "SSSSSS") == F.lit("000000"), whole
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def list_view(df: DataFrame, id_col: str = "id", file_col: str = "original_file", time_col: str = "created_at",
              entity_count: Column | None = None) -> DataFrame:
    """Q5: ``id, original_file, created_at (ISO text), pii_entities_found``.
    Only these columns are read from storage."""
    count = entity_count if entity_count is not None else F.coalesce(F.size("token_mapping"), F.lit(0))
    return df.select(
        F.col(id_col).alias("id"),
        F.col(file_col).alias("original_file"),
        iso_time(time_col).alias("created_at"),
        count.cast("bigint").alias("pii_entities_found"),
    )


def detail_view(requested: DataFrame, df: DataFrame, req_col: str, id_col: str = "id") -> DataFrame:
    """Q6: requested ids against the table; ``found`` tells a miss apart.

    A left outer equi-join: shuffled on the id on both sides, or the smaller
    side broadcast when its measured size allows. ``df`` must have unique
    ids."""
    hit = df.withColumn("__hit", F.lit(True))
    return requested.join(hit, requested[req_col] == hit[id_col], "left_outer").withColumn(
        "found", F.coalesce(F.col("__hit"), F.lit(False))
    ).drop("__hit")


def detail_item(id_col: str = "id", file_col: str = "original_file", time_col: str = "created_at",
                analysis_col: str = "detokenized_response", mapping_col: str = "token_mapping") -> list[Column]:
    """Q6 as served: id, file, ISO time, detokenized analysis and entity count."""
    return [
        F.col(id_col).alias("id"),
        F.col(file_col).alias("original_file"),
        iso_time(time_col).alias("created_at"),
        F.col(analysis_col).alias("analysis"),
        F.coalesce(F.size(mapping_col), F.lit(0)).cast("bigint").alias("pii_entities_found"),
    ]


def delete_found(requested: DataFrame, df: DataFrame, req_col: str, id_col: str = "id") -> DataFrame:
    """Q7, first half: which requested ids exist (taken before any rewrite)."""
    present = df.select(F.col(id_col).alias("__id")).withColumn("__hit", F.lit(True))
    return requested.join(present, requested[req_col] == present["__id"], "left_outer").select(
        requested[req_col], F.coalesce(F.col("__hit"), F.lit(False)).alias("existed")
    )


def without_ids(df: DataFrame, requested: DataFrame, req_col: str, id_col: str = "id") -> DataFrame:
    """Q7, second half: the rows that survive a delete (left anti join)."""
    return df.join(requested, df[id_col] == requested[req_col], "left_anti")


# S11 ------------------------------------------------------------------------
def to_json_lines(df: DataFrame, cols: list[str] | None = None) -> Column:
    """A JSON text per row; timestamps become ISO strings first."""
    fields = []
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_time(c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields))


def export_json(df: DataFrame, path: str) -> None:
    """S11 as files: JSON lines, one file set per job."""
    df.select(F.col("*")).select(to_json_lines(df).alias("value")).write.mode("overwrite").text(path)


#: Parts below this size are compacted.
COMPACT_BYTES = 128 << 20


# S7, S8, Q7 on a versioned parquet table ----------------------------------------
class ResultStore:
    """The stored results: create, append, read, delete, compact, purge.

    Layout: ``<root>/parts/<name>/`` parquet folders and
    ``<root>/manifests/<version>``, JSON with the parts of that version (whole
    folders, or single files ``<name>/<file>`` of those that a delete left
    standing) and the high-water mark of ids. The newest manifest is current.
    Two writers that publish the same version at once cannot both succeed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Listed and written through Hadoop's file system, so any store works.
    def _hadoop(self, *names: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, folder = self._hadoop("manifests")
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        if version is None:
            versions = self.versions()
            if not versions:
                return {"version": -1, "parts": [], "high": 0}
            version = versions[-1]
        fs, path = self._hadoop("manifests", str(version))
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, old: dict, parts: list[str], high: int) -> None:
        """Write the next manifest aside, whole, and rename it into place. The
        rename never overwrites: of two writers of a version one fails. That is
        atomic where the file system's rename is (HDFS, and stores whose
        connector has one); on a local folder it is a test and a rename."""
        version = old["version"] + 1
        content = json.dumps({"version": version, "parts": parts, "high": high})
        fs, aside = self._hadoop("manifests", f".{version}-{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(content.encode("utf-8")))
        stream.close()
        place = self._hadoop("manifests", str(version))[1]
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        options = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(place.toUri(), sc._jsc.hadoopConfiguration()).rename(aside, place, options)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"version {version} of {self.root} was published by another writer") from None

    def _part(self, name: str) -> str:
        return f"{self.root}/parts/{name}"

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(*[f.name for f in RESULT_SCHEMA.fields]).write.parquet(self._part(name))
        return name

    def high_water(self) -> int:
        """Largest id ever given, deleted rows included, so a deleted id is
        never handed out again. Kept in the manifest; no rows are read."""
        return self._manifest()["high"]

    def create(self) -> None:
        """Create the table if absent (idempotent)."""
        if not self.versions():
            self._publish(self._manifest(), [], 0)

    def register_view(self, name: str = "parsed_results") -> DataFrame:
        """The current version as a temporary view, for SQL such as
        ``SELECT id, original_file FROM parsed_results ORDER BY created_at DESC
        LIMIT 10``. Re-register after an append or a delete (a new version)."""
        df = self.read()
        df.createOrReplaceTempView(name)
        return df

    def read(self) -> DataFrame:
        return self._rows(self._manifest()["parts"])

    def _rows(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], RESULT_SCHEMA)
        return self.spark.read.schema(RESULT_SCHEMA).parquet(*map(self._part, parts))

    def append(self, rows: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
        """Append result rows with fresh ids and creation time, all or
        nothing.

        Returns ``(key_cols..., id, original_file)`` for the written rows, so
        callers can hand each input its id. Ids continue after the high-water
        mark (S9) and are fixed before the write, from rows pinned once in the
        checkpoint folder."""
        self.create()
        old = self._manifest()
        created = F.col("created_at") if "created_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
        staged = rows.withColumn("created_at", F.coalesce(created, utc_now()))
        if "token_entries" not in staged.columns:
            staged = staged.withColumn("token_entries", F.lit(None).cast(RESULT_SCHEMA["token_entries"].dataType))
        with_ids, n = number_rows(staged, old["high"] + 1)
        self._publish(old, [*old["parts"], self._write(with_ids)], old["high"] + n)
        return with_ids.select(*(key_cols or []), "id", "original_file")

    def _files(self, entry: str) -> dict[str, int]:
        """The data files of a part, as ``<name>/<file>`` with their sizes."""
        fs, path = self._hadoop("parts", entry)
        name = entry.partition("/")[0]
        listed = {f"{name}/{f.getPath().getName()}": f.getLen() for f in fs.listStatus(path)}
        return {k: n for k, n in listed.items() if k.partition("/")[2][0] not in "._"}

    def delete(self, requested: DataFrame, req_col: str) -> DataFrame:
        """Q7: delete rows by id; returns ``(requested id, existed)`` computed
        before the rewrite. Only the files that hold requested ids are
        rewritten; the other files of their parts stand. Older versions keep
        the rows until ``purge_versions``."""
        old = self._manifest()
        current = self._rows(old["parts"])
        # Pinned to the reliable checkpoint folder: the answer must describe
        # the table before the rewrite, even if recomputed later.
        found = pinned(delete_found(requested, current, req_col))
        touched: set[str] = set()
        if old["parts"]:
            names = current.select("id", F.regexp_extract("_metadata.file_path", "/parts/([^/]+/[^/]+)$", 1).alias("file"))
            hit = names.join(requested.select(F.col(req_col).alias("id")), "id", "left_semi").select("file").distinct()
            touched = {r["file"] for r in hit.collect()}  # names of files
        folders = {f.partition("/")[0] for f in touched}
        kept = [p for p in old["parts"] if p.partition("/")[0] not in folders]
        standing = [f for p in old["parts"] if p.partition("/")[0] in folders for f in sorted(self._files(p)) if f not in touched]
        if touched:
            standing.append(self._write(without_ids(self._rows(sorted(touched)), requested, req_col)))
        self._publish(old, kept + standing, old["high"])
        return found

    def compact(self, small: int = COMPACT_BYTES) -> int:
        """Rewrite parts (and single files) of less than ``small`` bytes into
        one part, in files of about that size; returns how many went into it.
        Readers of older versions are not disturbed. Run it now and then: every
        append adds a part."""
        old = self._manifest()
        sizes = {p: sum(self._files(p).values()) for p in old["parts"]}
        chosen = [p for p in old["parts"] if sizes[p] < small]
        if len(chosen) < 2:
            return 0
        files = max(1, -(-sum(sizes[p] for p in chosen) // small))
        merged = self._write(self._rows(chosen).coalesce(files))
        self._publish(old, [*(p for p in old["parts"] if p not in set(chosen)), merged], old["high"])
        return len(chosen)

    def purge_versions(self, keep: int = 1) -> None:
        """Remove all versions but the newest ``keep``, with the parts and
        files that only they hold; deleted rows are gone from the disk then.
        What failed writes left behind goes too, so no other writer may be at
        work."""
        if keep < 1:
            raise ValueError("the current version cannot be purged")
        versions = self.versions()
        used = {p for v in versions[-keep:] for p in self._manifest(v)["parts"]}
        fs, folder = self._hadoop("parts")
        for v in versions[:-keep]:
            fs.delete(self._hadoop("manifests", str(v))[1], False)
        if fs.exists(folder):
            for f in fs.listStatus(folder):
                name = f.getPath().getName()
                if name in used:
                    continue
                if not any(p.startswith(name + "/") for p in used):
                    fs.delete(f.getPath(), True)
                    continue
                for file in self._files(name):
                    if file not in used:
                        fs.delete(self._hadoop("parts", file)[1], False)
