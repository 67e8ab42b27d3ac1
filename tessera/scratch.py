"""Intermediate tables that survive the loss of executors.

Everything that must cut lineage is written as Parquet below the folder named by
``spark.checkpoint.dir``, which the driver and all executors share.  The setting
is read from the session; a folder of our own is used only where it is unset.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Where tables lie, as long as they are in use.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application; it goes when the driver's JVM ends.

    Without ``spark.checkpoint.dir`` a local folder serves a local session; a cluster,
    whose executors could not read it, is refused.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _ROOTS.get(app) or tempfile.mkdtemp(prefix="tessera-")
    if app not in _ROOTS:
        _ROOTS[app] = base
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessera-{app}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{base.rstrip('/')}/tessera-{app}"


def materialize(df: DataFrame, name: str = "table", release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read, never a
    recomputation, and a plan that uses it twice computes it once.  With ``release`` the
    driver's garbage is collected, whereupon Spark removes the shuffle files of the write;
    else they stay until that happens by itself.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing yet to be computed reads; others are left alone."""
    for df in tables:
        if (path := _PATHS.pop(df, None)) is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
