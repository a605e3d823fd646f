"""Structured Streaming: file arrivals kept as latest rows per key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_dir


#: Parts of the state table.
BUCKETS = 64


def latest_from_stream(spark: SparkSession, path: str, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Reads all files at ``path`` as a stream and keeps the row with the greatest ``order`` of each key.

    The state is a table in ``BUCKETS`` parts by the hash of the key. Each micro-batch is reduced to its latest row per key and
    merged with the parts it touches; only those are written anew, under the batch's number, so a batch
    that is run again after a failure overwrites its own version only. Ends when all present files are read.
    """
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    columns = [*keys, *values, order]
    row = F.struct(order, *values)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    versions: dict[int, int] = {}  # part -> number of the batch that wrote it last

    def latest_of(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(row).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in (*values, order)])

    def merge(batch: DataFrame, number: int) -> None:
        fresh = materialize(latest_of(batch).withColumn("__b", bucket), "batch")
        touched = [r["__b"] for r in fresh.select("__b").distinct().collect()]  # at most BUCKETS
        before = {b: versions[b] for b in touched if versions.get(b, number) < number}
        both = fresh.select(*columns)
        if before:
            both = both.unionByName(spark.read.parquet(*[f"{base}/v{v}/__b={b}" for b, v in before.items()]).select(*columns))
        latest_of(both).withColumn("__b", bucket).repartition("__b").write.mode("overwrite").partitionBy("__b").parquet(f"{base}/v{number}")
        versions.update(dict.fromkeys(touched, number))

    schema = spark.read.parquet(path).schema
    # a file source reads folders: a single file is given as its folder and a name pattern
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    whole = any(f.endswith(".parquet") and f.rstrip("/") != path for f in spark.read.parquet(path).inputFiles()[:1]) and not spark.read.parquet(path).inputFiles()[0].endswith("/" + name)
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", name).parquet(folder)
    rows = stream.select(*columns).where(" and ".join(f"{k} is not null" for k in keys))
    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not versions:
        return spark.read.parquet(path).select(*columns).limit(0)
    return spark.read.parquet(*[f"{base}/v{v}/__b={b}" for b, v in sorted(versions.items())]).select(*columns)


def arrivals_per_window(events: DataFrame, time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of a stream per window of event time, with a watermark for late rows (an extension beyond search)."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
