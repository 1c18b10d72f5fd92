"""Shared folders, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch, delete, forget, new_dir, written, written_at  # noqa: F401


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file; usable on executors, for any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """write(stream) fills a file of its own, which then gets its name: a task that runs again or twice does no harm."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None) as f:
        write(f)
    store.move(own, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
