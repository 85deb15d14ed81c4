"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_cleaned: set[str] = set()
_own: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers on other machines need not have the repository on their path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="strataspark-")) / "strataspark_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a session in one process (``local[..]``, as in tests) gets a folder of its own; on a
    cluster no machine-local folder can stand in, so there it is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="strataspark-shared-")
        where = _own[sc.applicationId]
    base = f"{where.rstrip('/')}/strataspark-{sc.applicationId}"
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the application has ended; the cluster's own clean-up takes the folder
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    Cuts the lineage, so a lost executor costs at most the tasks it ran, and
    several consumers read the table instead of computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.scratch_path = path
    return table


@contextmanager
def exchanges(spark: SparkSession, parts: int) -> Iterator[None]:
    """What runs inside is shuffled over ``parts`` partitions at least, so that a task's share does not grow with the table.

    For steps that run at once, as ``materialise`` does; exchanges stay Spark's own, so counts are combined before them and skew can be split.
    Beyond the session's own number they are not put together again by their compressed bytes, of which many rows may have few.
    """
    number, joined = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (number, joined)}
    if parts > int(before[number]):
        spark.conf.set(number, str(parts))
        spark.conf.set(joined, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` gave, once all that reads them has run; others are left alone."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            _remove(table.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
