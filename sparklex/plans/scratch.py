"""Written tables that cut lineage.

Every table lands in the folder that the cluster names in ``spark.checkpoint.dir``, which the driver and all
executors share, so a lost executor never takes an intermediate result with it. The files are written once and read
back, where ``DataFrame.checkpoint`` would compute an uncached plan twice.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: The folders that the calls inside each open ``tidy`` block have made.
_OPEN: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes, when the block ends well, every scratch table that was begun inside it. What a caller still wants to
    read must have been written elsewhere, or by a ``Scratch`` from before the block."""
    _OPEN.append([])
    try:
        yield
    except BaseException:
        _OPEN.pop()
        raise
    for base in _OPEN.pop():
        _delete(spark, base)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Inside the block a setting of the session has this value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def swept(spark: SparkSession):
    """Inside the block the shuffle files of a query are deleted when the query ends, where they would otherwise stay
    until the driver collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session; a local session without the setting (tests) gets a temporary one."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if root:
        return root
    master = conf.get("spark.master", "")
    if not (master.startswith("local[") or master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="sparklex-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], ignore_errors=True)
    return _LOCAL_ROOTS[app]


class Scratch:
    """Named tables of one operator call under the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        for made in _OPEN:
            made.append(self.base)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return the written table."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no plan will read again."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
