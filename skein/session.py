"""Session helpers: shared intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is only broadcast when its measured size stays below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


_written: list[str] = []


def drop_materialized(spark: SparkSession) -> int:
    """Deletes all tables that :func:`materialize` has written; results that still read them must be done."""
    jvm = spark.sparkContext._jvm
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return done


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the cluster.

    Only where the setting is absent and the session is local (tests) a private temporary folder is made and
    set as the session's checkpoint folder; it is removed when the process ends. On a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark, "_skein_shared", None)
        if not path:
            if not re.match(r"local($|\[)", spark.sparkContext.master or ""):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"skein-{uuid.uuid4().hex}")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = "file://" + folder
            spark._skein_shared = path
            spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back.

    The written table cuts the lineage, survives the loss of executors, is columnar and
    compressed, and gives later joins true sizes to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes (exact file sizes for materialised tables)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size is below ``limit``; otherwise leave the
    choice (shuffled hash or sort-merge join with skew handling) to Catalyst and AQE."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def heavy_split_join(rows: DataFrame, groups: DataFrame, key: str, size_col: str, total: int, share: int = 1000, least: int = 10_000) -> DataFrame:
    """Inner join of many ``rows`` to one ``groups`` row per key when keys may be heavily skewed.

    A group is hot if it holds at least ``max(least, total / share)`` of the ``total`` rows, so
    there are at most ``share`` hot groups whatever the data size: that side has a proven bound
    and is broadcast, and hot rows never move. All other rows meet their group in a shuffled
    join in which no key holds more than 1/``share`` of the rows.
    """
    hot_at = max(least, -(-total // share))
    hot = groups.where(F.col(size_col) >= hot_at)
    cold = groups.where(F.col(size_col) < hot_at)
    hot_keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key))


#: A local table built from this many driver rows at most is broadcast.
BROADCAST_ROWS = 20_000


def broadcast_rows(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a table built from a known number of driver-side ``rows``, if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
