"""Files that tasks write and read themselves, in the shared folder of the session.

Addresses are URIs; ``pyarrow.fs`` resolves them (local, object stores, HDFS), so nothing
here assumes a mounted path.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from hazardframe.operators.common import scratch_path


def shared_uri(spark: SparkSession, label: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``."""
    path = scratch_path(spark, label)
    return path if ":" in path.split("/")[0] else f"file://{path}"


def make_folder(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)


def new_name(folder: str, stem: str, suffix: str) -> str:
    """A name no other task attempt uses; a retried task leaves its first file unlisted."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_output_stream(path)


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)
