"""What the operators share: tables, the shared work folder, written intermediate tables and remote files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Vocabulary of each tokenizer; a parameter of every operator that needs one.
TOKENIZER_PACKAGE = "public_tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file on this machine (resolved where it is needed, also on executors)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name (URI) below the folder that all executors share.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and all of Spark is on this machine (tests) is
    one set here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints/gridloom"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remote(uri: str):
    """(file system, path) of a URI, for tasks that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batches, size_of, limit: int):
    """Cut Arrow batches so that no piece has rows of more than ``limit`` bytes together (one row at least).

    At the end of the batches, which is the end of the task, this worker's caches are emptied: idle workers hold nothing.
    """
    import numpy as np

    try:
        for batch in batches:
            ends = np.cumsum(size_of(batch))
            start = 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        for cache in _caches.values():
            cache.clear()
        trim()


def text_bytes(column: str):
    """size_of for slices(): the bytes of a string column's values, 1 for null."""

    def size_of(batch):
        import numpy as np
        import pyarrow.compute as pc

        n = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        return np.asarray(n, dtype=np.int64) + 1

    return size_of


_caches: dict[str, dict] = {}


def own_cache(name: str, most: int, more: int = 0) -> dict:
    """This worker's cache of that name, emptied if ``more`` entries would take it over ``most``."""
    cache = _caches.setdefault(name, {})
    if len(cache) + more > most:
        cache.clear()
    return cache


def trim() -> None:
    """Give free memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
