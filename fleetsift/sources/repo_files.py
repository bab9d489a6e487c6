"""Repository files as a table.

The usual source is a Parquet table of (repo_url, scan_id, path, content bytes);
`decode_files` turns it into text.  `read_checkouts` reads directory trees on a
file system all executors mount.  Spark's own file listing hides names that
begin with a dot, and `.github/` and `.env` are the files this library is
about, so trees are listed by the tasks themselves.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.operators import ingest
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)


def decode_text(raw: Column) -> Column:
    """Bytes as UTF-8 text: undecodable bytes are dropped, every line ending becomes a newline."""
    as_text = raw.cast("string")
    valid = F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.replace(F.make_valid_utf8(as_text), F.lit("�"), F.lit("")))
    return F.coalesce(F.regexp_replace(valid, "\r\n?", "\n"), F.lit(""))


def decode_files(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Add `content` and `size_bytes` from a binary column."""
    return files.withColumns({
        "size_bytes": F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint"),
        "content": decode_text(F.col(raw)),
    }).drop(raw)


def _list_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            root, paths = row["root"], []

            def listed(row=row):
                return pa.RecordBatch.from_pydict({
                    "repo_url": pa.array([row["repo_url"]] * len(paths), pa.string()),
                    "scan_id": pa.array([row["scan_id"]] * len(paths), pa.int64()),
                    "root": pa.array([row["root"]] * len(paths), pa.string()),
                    "path": pa.array(paths, pa.string()),
                })

            for directory, _, names in os.walk(root):
                for name in names:
                    full = os.path.join(directory, name)
                    if os.path.isfile(full):
                        paths.append(os.path.relpath(full, root).replace(os.sep, "/"))
                    if len(paths) == 10_000:
                        yield listed()
                        paths.clear()
            if paths:
                yield listed()


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch_bytes = 16 << 20
    schema = pa.schema([("repo_url", pa.string()), ("scan_id", pa.int64()), ("path", pa.string()), ("raw", pa.binary())])
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            try:
                with open(os.path.join(row.pop("root"), row["path"]), "rb") as handle:
                    row["raw"] = handle.read()
            except OSError:
                row["raw"] = b""
            rows.append(row)
            held += len(row["raw"])
            if held >= batch_bytes:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def list_checkouts(checkouts: DataFrame) -> DataFrame:
    """(repo_url, scan_id, root) -> one row per regular file below each root."""
    partitions = int(checkouts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (checkouts.select("repo_url", "scan_id", "root").repartition(partitions, "root")
            .mapInArrow(_list_batches, "repo_url string, scan_id bigint, root string, path string"))


def read_checkouts(spark: SparkSession, checkouts: DataFrame) -> DataFrame:
    """Directory trees -> `repo_files`.

    Paths are filtered before any file is opened, and the listing is spread by
    path, so a checkout that holds most of the files is still read by all tasks.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = ingest.select_repo_files(list_checkouts(checkouts)).repartition(partitions, "scan_id", "path")
    read = wanted.mapInArrow(_read_batches, "repo_url string, scan_id bigint, path string, raw binary")
    return ingest.classify_repo_files(decode_files(read))
