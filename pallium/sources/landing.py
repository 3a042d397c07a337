"""A folder of landed files as a data source, for batch and stream alike.

``spark.read.format("landed_files")`` gives one row per file, zero-byte files
included (Spark's own file sources leave those out). The folder is listed in
tasks: each takes a share of the names in the folder and walks the sub-folders
of its share, so the driver lists nothing.

As a stream, each trigger is one listing of the folder; the offset is the
number of the listing. A listing holds whatever lies in the folder when its
tasks run, so a consumer has to drop files that it has had before, by a
stateful ``dropDuplicates`` (``streaming.ingest`` does).

Files have to appear whole, by a rename into the folder. Names that begin with
a dot or an underscore are left out, as Spark does. The folder may be on any
storage that Arrow reads (local or mounted, HDFS, object stores). The classes
travel to the Python workers by value: those need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint"
#: Tasks that a folder is listed in.
SHARES = 16

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def storage(path: str):
    """The file system of a path, the path in it, and what stands before such
    a path in names as Spark writes them (``file:/a``, ``s3a://bucket/a``)."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path, "file:"
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    at, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return at, inner, path[:len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def walk(path: str, share: int = 0, shares: int = 1, recursive: bool = True, glob: str | None = None) -> Iterator[tuple]:
    """A share of the files below a folder: those of the folder by a hash of
    their names, and whole sub-folders by a hash of theirs."""
    import fnmatch
    import zlib

    from pyarrow import fs

    at, root, before = storage(path)
    todo = [(root.rstrip("/") or "/", True)]
    while todo:
        folder, top = todo.pop()
        for info in at.get_file_info(fs.FileSelector(folder, allow_not_found=not top)):
            name = info.base_name
            if name[0] in "._" or top and zlib.crc32(name.encode("utf-8", "surrogatepass")) % shares != share:
                continue
            if info.type == fs.FileType.Directory:
                if recursive:
                    todo.append((info.path, False))
            elif info.type == fs.FileType.File and (glob is None or fnmatch.fnmatchcase(name, glob)):
                yield before + info.path, in_milliseconds(info.mtime), info.size


def in_milliseconds(time):
    """As Spark's file sources give times."""
    return time.replace(microsecond=time.microsecond // 1000 * 1000)


class LandedFiles(DataSource):
    """Options: ``path``, ``glob`` (of names), ``recursive``, ``shares``."""

    @classmethod
    def name(cls) -> str:
        return "landed_files"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandedStreamReader(self.options)


def shares_of(options) -> list[InputPartition]:
    return [InputPartition(i) for i in range(int(options.get("shares", SHARES)))]


def read_share(options, partition: InputPartition) -> Iterator[tuple]:
    return walk(options["path"], partition.value, int(options.get("shares", SHARES)),
                options.get("recursive", "true").lower() == "true", options.get("glob"))


class LandedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return shares_of(self.options)

    def read(self, partition):
        return read_share(self.options, partition)


class LandedStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.last = dict(options), 0

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        # Milliseconds only grow, also over restarts, where a counter would begin anew.
        import time

        self.last = max(self.last + 1, int(time.time() * 1000))
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict):
        return shares_of(self.options) if end != start else []

    def read(self, partition):
        return read_share(self.options, partition)


def _options(path: str, glob: str | None, recursive: bool) -> dict[str, str]:
    return {"path": path, "recursive": str(recursive).lower()} | ({"glob": glob} if glob else {})


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """The files of a folder ``(path, modificationTime, length)``, empty ones too."""
    spark.dataSource.register(LandedFiles)
    return spark.read.format("landed_files").options(**_options(path, glob, recursive)).load()


def stream_listings(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """One listing of the folder per trigger, in the same columns."""
    spark.dataSource.register(LandedFiles)
    return spark.readStream.format("landed_files").options(**_options(path, glob, recursive)).load()


#: Bytes of files that leave a task at a time.
GROUP_BYTES = 16 << 20


def with_content(listed: DataFrame, moved: tuple[str, str] | None = None) -> DataFrame:
    """Listed files with their bytes, read in tasks: the columns of
    ``binaryFile``. ``moved`` is a folder and the one that its files may have
    been moved to meanwhile; they are read there then. Of a task's memory the
    bytes take up one file, or :data:`GROUP_BYTES` of small ones."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, held = [], 0
            columns = [batch.column(i) for i in range(3)]
            for i in range(batch.num_rows):
                path = columns[0][i].as_py()
                data = read_whole([path] if moved is None else [path, relocated(path, *moved)])
                rows.append((i, data))
                held += len(data)
                if held >= GROUP_BYTES:
                    yield grouped(pa, columns, rows)
                    rows, held = [], 0
            if rows:
                yield grouped(pa, columns, rows)

    def grouped(pa, columns, rows):
        at = [i for i, _ in rows]
        return pa.RecordBatch.from_arrays(
            [columns[0].take(pa.array(at)), columns[1].take(pa.array(at)), pa.array([len(d) for _, d in rows], pa.int64()),
             pa.array([d for _, d in rows], pa.binary())], names=["path", "modificationTime", "length", "content"])

    from pallium.sources.files import BINARY_FILE_SCHEMA

    return listed.select("path", "modificationTime", "length").mapInArrow(run, BINARY_FILE_SCHEMA)


def read_whole(paths: list[str]) -> bytes:
    for path in paths[:-1]:
        try:
            at, inner, _ = storage(path)
            with at.open_input_stream(inner) as f:
                return f.read()
        except FileNotFoundError:
            pass
    at, inner, _ = storage(paths[-1])
    with at.open_input_stream(inner) as f:
        return f.read()


def relocated(path: str, folder: str, target: str) -> str:
    """Where a file of ``folder`` comes to lie below ``target``."""
    root = storage(folder)[1].rstrip("/")
    inner = storage(path)[1]
    return target.rstrip("/") + inner[len(root):]


def move_files(listed: DataFrame, folder: str, target: str) -> int:
    """Move listed files of ``folder`` below ``target``, in tasks; how many were
    there to move. Files that were moved before are passed over."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            count = 0
            for path in batch.column(0).to_pylist():
                at, source, _ = storage(path)
                place = storage(relocated(path, folder, target))[1]
                at.create_dir(place.rpartition("/")[0], recursive=True)
                try:
                    at.move(source, place)
                    count += 1
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["moved"])

    return sum(r.moved for r in listed.select("path").mapInArrow(run, "moved long").collect())  # a row per batch
