"""Files themselves: listed, read and written on executors; what fails is a row with its cause.

Contents are read in chunks, so a file may have any size. Paths are plain (a shared mount) or URIs of a store that
Arrow opens; a path of any other kind fails like an unreadable file.
"""

from __future__ import annotations

import errno
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import basename, extension
from folioflow.session import stored

#: Bytes read at a time, bytes of files per task.
CHUNK, TASK_BYTES = 4 << 20, 256 << 20

ENTRIES = "path string, kind string, size_bytes bigint, error string"
EXAMINED = "path string, is_file boolean, size_bytes bigint, modified_at timestamp, sha256 string, error string"
# Fixed value: cause given for a path at which there is something other than a file.
NOT_A_FILE = "path is not a regular file."


def plain(path: str) -> str:
    """Local files without their scheme, in the form in which paths are requested; other URIs as they are."""
    return unquote(re.sub("^file:/+", "/", path)) if path.startswith("file:/") else path


def _is_uri(path: str) -> bool:
    return bool(re.match(r"\w+:/", path))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    path = plain(path)
    return fs.FileSystem.from_uri(path) if _is_uri(path) else (fs.LocalFileSystem(), path)


def _cause(error: Exception) -> str:
    number = getattr(error, "errno", None)
    return os.strerror(number) if number else str(error) or type(error).__name__


def _listed(folder: str) -> Iterator[tuple]:
    """Rows of ``ENTRIES`` for what lies directly in a folder."""
    try:
        store, inside = _store(folder)
        prefix = folder.rstrip("/")
        for entry in store.get_file_info(fs.FileSelector(inside)):
            path = f"{prefix}/{quote(entry.base_name) if _is_uri(folder) else entry.base_name}"
            if entry.type == fs.FileType.Directory:
                yield path, "folder", None, None
            elif entry.type == fs.FileType.File:
                yield path, "file", entry.size, None
            else:
                yield path, "file", None, NOT_A_FILE
    except (OSError, pa.ArrowException) as error:
        yield folder, "error", None, _cause(error)


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, size_bytes, error of every file under a folder, whatever its depth; ``glob`` selects by name.

    Folders are listed level by level on executors, and no content is read. A folder that cannot be listed is a row with its cause.
    """

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_listed(folder))
                kept = [r for r in rows if r[1] != "file" or glob is None or fnmatchcase(r[0].rpartition("/")[2], glob)]
                columns = list(zip(*kept, strict=True)) if kept else [()] * 4
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    folders, levels = spark.createDataFrame([(plain(root),)], "path string"), []
    while True:
        level = stored(folders.mapInArrow(run, ENTRIES), "listing")
        levels.append(level.filter("kind <> 'folder'").select("path", "size_bytes", "error"))
        folders = level.filter("kind = 'folder'").select("path")
        n = folders.count()
        if not n:
            return reduce(DataFrame.unionAll, levels)
        folders = folders.repartition(min(n, _tasks(spark)))


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _examined(path: str) -> dict:
    row = {"path": path, "is_file": False, "size_bytes": None, "modified_at": None, "sha256": None, "error": None}
    try:
        store, inside = _store(path)
        info = store.get_file_info(inside)
        if info.type != fs.FileType.File:
            return row | {"error": os.strerror(errno.ENOENT) if info.type == fs.FileType.NotFound else NOT_A_FILE}
        row |= {"is_file": True, "size_bytes": info.size, "modified_at": info.mtime}
        digest, size = hashlib.sha256(), 0
        with store.open_input_stream(inside) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
                size += len(chunk)
        return row | {"size_bytes": size, "sha256": digest.hexdigest()}
    except (OSError, pa.ArrowException) as error:
        return row | {"error": _cause(error)}


def examine(paths: DataFrame) -> DataFrame:
    """path, is_file, size_bytes, modified_at, sha256, error of every path (column ``path``).

    ``error`` says why there is no fingerprint: nothing there, not a file, or a failure while the file was read.
    """
    kinds = [("path", pa.string()), ("is_file", pa.bool_()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("sha256", pa.string()), ("error", pa.string())]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([_examined(path)], schema=pa.schema(kinds))

    return paths.select("path").mapInArrow(run, EXAMINED)


def examine_evenly(listed: DataFrame) -> DataFrame:
    """:func:`examine` of a stored table of paths, dealt over tasks by number and, where ``size_bytes`` is known, by size."""
    total = F.sum("size_bytes") if "size_bytes" in listed.columns else F.lit(0)
    n, size = listed.agg(F.count("*"), F.coalesce(total, F.lit(0))).first()
    if not n:
        return examine(listed)
    return examine(listed.repartition(min(n, max(_tasks(listed.sparkSession), -(-int(size) // TASK_BYTES), n // 1000))))


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, name, extension, size, time, fingerprint and error of every file under a folder; bytes stay on the executors."""
    listed = stored(list_files(spark, path, glob), "files")
    found = examine_evenly(listed.filter("error is null"))
    failed = listed.filter("error is not null").selectExpr(
        "path", "false as is_file", "size_bytes", "cast(null as timestamp) as modified_at", "cast(null as string) as sha256", "error"
    )
    return found.unionAll(failed).selectExpr(
        "path", f"{basename('path')} as name", f"{extension('path')} as extension", "size_bytes", "modified_at", "sha256", "error"
    )


def write_files(rows: DataFrame, root: str) -> int:
    """Write every row (path below ``root``, content) as a file of its own; the number of files.

    A file appears under its name when it is whole, so a task that is run again replaces it.
    """

    def run(batches):
        for batch in batches:
            store, inside = _store(root)
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{inside.rstrip('/')}/{path.lstrip('/')}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, target)
            yield pa.RecordBatch.from_pylist([{"n": batch.num_rows}], schema=pa.schema([("n", pa.int64())]))

    done = rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return int(done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
