"""Tables cut from their lineage, kept in the folder that every executor shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's in that of spark.checkpoint.dir, removed when the driver's process ends. Where that setting is absent, a temporary one if all executors are in this process; else that is an error."""
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if named:
        folder = f"{named.rstrip('/')}/loomfield/{app}"
        if _own.get(app) != folder:
            _own[app] = folder
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            atexit.register(_remove, at, spark.sparkContext._jsc.hadoopConfiguration())
        return folder
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loomfield-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def _remove(at, conf) -> None:
    try:
        at.getFileSystem(conf).delete(at, True)
    except Exception:  # the JVM has ended first; what is left is in a folder of its own
        pass


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later plans start there and survive lost executors."""
    return materialize_at(df, tag)[0]


def materialize_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables of materialize_at that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores if it has fewer partitions than there are, for steps that cost far more than moving their rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows; else the join shuffles and sorts. df should be a stored table, which is cheap to count."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever the session runs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="loomfield-zip-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    with zipfile.ZipFile(at / "loomfield_src.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(at / "loomfield_src.zip"))
    _shipped.add(app)
