"""What the corpus operators share: the shared folder, tables written there, null rules.

Null rules that hold for every operator unless its docstring says otherwise: a null text counts as an empty
one, a null id counts as larger than every other id, and rows that repeat an id are kept as rows of their own.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are ordered.
LAST_ID = 2**63 - 1

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir, else, on a local master, a folder of this process.

    Elsewhere a cluster must name one, as executors don't see the driver's own folders.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_root is None:
            _own_root = tempfile.mkdtemp(prefix="papyra-")
            atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
        root = _own_root
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_root(spark).rstrip('/')}/papyra/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote to the shared folder; for when their results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/papyra/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df through Parquet in the shared folder: lineage ends here, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_but(df: DataFrame, *names: str) -> list[str]:
    """df's columns but for those names, in whatever case, as Spark compares names without regard to it."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


# -- what a Python worker keeps from task to task ----------------------------------------------------------------

_kept: dict[Any, Any] = {}


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """make()'s value, kept by this worker under name until it is asked for another name or release() is called."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Gives back what earlier tasks of this worker held: a worker serves one stage after another."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it does so by itself or not at all


def without_collector(items: Iterator) -> Iterator:
    """items, with the cyclic garbage collector off meanwhile: tables of many small objects, none in a cycle, cost it much time."""
    gc.disable()
    try:
        yield from items
    finally:
        gc.enable()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_order(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))
