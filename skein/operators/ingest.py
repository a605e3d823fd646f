"""Content-addressed, incremental ingestion.

State is three tables: documents ``(collection, path) -> title, hash, active, times``, content
``hash -> body`` and a manifest of file times and sizes. A scan is compared with the manifest by
one full join; everything else follows from the class of each path.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import glob_regex, scannable, split_masks
from ..functions.text import title_of
from ..session import materialize

#: Largest file, and the age below which a file's time is not yet trusted.
MAX_BYTES, RACY_SECONDS = 10 * 1024 * 1024, 2


def scan_files(spark, root: str, mask: str = "**/*.md", ignore: list[str] = ()) -> DataFrame:
    """``path, mtime, size, content`` of the files under ``root`` whose relative path matches a glob of the mask."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base) + "/", "")
    rows = files.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    wanted = F.lit(False)
    for g in split_masks(mask):
        wanted = wanted | F.col("path").rlike(glob_regex(g))
    return rows.where(wanted & scannable(F.col("path"), list(ignore)))


def gate(files: DataFrame, text_col: str = "body", size_col: str = "size", limit: int = MAX_BYTES) -> DataFrame:
    """Adds ``verdict``: ``too_large``, ``empty`` (white space only or null) or ``ok``."""
    blank = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"\S")
    return files.withColumn("verdict", F.when(F.col(size_col) > limit, "too_large").when(blank, "empty").otherwise("ok"))


def with_identity(files: DataFrame, text_col: str = "body", path_col: str = "path") -> DataFrame:
    """Adds ``hash`` and ``title``."""
    return files.withColumn("hash", F.sha2(F.col(text_col), 256)).withColumn("title", title_of(F.col(text_col), F.col(path_col)))


def classify(scan: DataFrame, manifest: DataFrame, keys: list[str] = ["collection", "path"]) -> DataFrame:  # noqa: B006
    """``keys, change`` of every path: ``new``, ``unchanged`` (same time and size and trusted), ``touched``
    (time or size changed, same hash), ``updated``, ``removed``.

    scan: keys, ``mtime, size, hash``; manifest: keys, ``mtime, size, hash``; a null time is untrusted.
    """
    s, m = scan.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("mtime", "size", "hash")]), manifest.select(*keys, *[F.col(c).alias(f"m_{c}") for c in ("mtime", "size", "hash")])
    both = s.join(m, keys, "full")
    change = (
        F.when(F.col("m_hash").isNull(), "new")
        .when(F.col("s_hash").isNull(), "removed")
        .when((F.col("s_mtime") == F.col("m_mtime")) & (F.col("s_size") == F.col("m_size")), "unchanged")
        .when(F.col("s_hash") == F.col("m_hash"), "touched")
        .otherwise("updated")
    )
    return both.select(*keys, change.alias("change"))


def trusted_time(mtime, scanned_at):
    """The time to remember: null for a file modified less than ``RACY_SECONDS`` before the scan."""
    return F.when(mtime <= scanned_at - F.expr(f"INTERVAL {RACY_SECONDS} SECONDS"), mtime)


def new_content(content: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` (hash, doc, created_at) whose hash is not stored yet, the first of each hash."""
    first = incoming.where("hash is not null").groupBy("hash").agg(F.min_by(F.struct("doc", "created_at"), "created_at").alias("r"))
    return first.select("hash", "r.doc", "r.created_at").join(content.select("hash"), "hash", "left_anti")


def upsert_documents(documents: DataFrame, incoming: DataFrame, keys: list[str] = ["collection", "path"]) -> DataFrame:  # noqa: B006
    """Documents after the upsert: an incoming row replaces the stored one of its keys, keeps its first
    ``created_at`` and makes it active again. Both: keys, ``title, hash, created_at, modified_at, active``."""
    both = documents.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    best = F.max_by(F.struct("title", "hash", "modified_at", F.when(F.col("__new") == 1, True).otherwise(F.col("active")).alias("active")), F.struct("__new", "modified_at"))
    out = both.groupBy(*keys).agg(best.alias("r"), F.min("created_at").alias("created_at"))
    return out.select(*keys, "r.title", "r.hash", "created_at", "r.modified_at", "r.active")


def deactivate_unseen(documents: DataFrame, seen: DataFrame, collection: str, keys: list[str] = ["collection", "path"]) -> DataFrame:  # noqa: B006
    """Documents of the scanned collection whose path was not seen become inactive."""
    marked = documents.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left")
    active = F.when((F.col(keys[0]) == collection) & F.col("__seen").isNull(), False).otherwise(F.col("active"))
    return marked.withColumn("active", active).drop("__seen")


def reindex(files: DataFrame, documents: DataFrame, content: DataFrame, manifest: DataFrame, collection: str, scanned_at) -> dict[str, DataFrame]:
    """One scan of a collection: ``documents``, ``content`` and ``manifest`` after it, and ``counters`` (one row: indexed, updated,
    unchanged, removed, skipped).

    files: ``path, mtime, size, body``. Times and sizes are compared first, so bodies are only read (and hashed) of files that the
    manifest does not vouch for. Files that are too large or hold white space only are retired. manifest: ``collection, path, mtime, size, hash``.
    """
    mine = manifest.where(F.col("collection") == collection)
    seen = files.select(F.lit(collection).alias("collection"), "path", "mtime", "size")
    trusted = seen.join(mine.select("path", "mtime", "size", "hash"), ["path", "mtime", "size"])
    active = documents.where("active").select("collection", "path", "hash")
    trusted = materialize(trusted.join(active, ["collection", "path", "hash"], "left_semi").select("collection", "path", "mtime", "size", "hash"), "trusted")
    read = with_identity(gate(files.join(trusted.select("path"), "path", "left_anti")))
    read = materialize(read.withColumn("collection", F.lit(collection)), "read")
    fine = read.where("verdict = 'ok'")
    changes = classify(fine, mine.join(trusted.select("collection", "path"), ["collection", "path"], "left_anti"))
    counts = changes.agg(F.count_if(F.col("change") == "new").alias("indexed"), F.count_if(F.col("change") == "updated").alias("updated"), F.count_if(F.col("change").isin("touched", "unchanged")).alias("same"), F.count_if(F.col("change") == "removed").alias("removed"))
    others = trusted.agg(F.count(F.lit(1)).alias("trusted")).crossJoin(read.agg(F.count_if(F.col("verdict") != "ok").alias("skipped")))  # one row each
    counters = counts.crossJoin(others).select("indexed", "updated", (F.col("same") + F.col("trusted")).alias("unchanged"), "removed", "skipped")
    incoming = fine.select("collection", "path", "title", "hash", F.lit(scanned_at).cast("timestamp").alias("created_at"), F.col("mtime").alias("modified_at"), F.lit(True).alias("active"))
    stored = deactivate_unseen(upsert_documents(documents, incoming), trusted.select("collection", "path").union(fine.select("collection", "path")), collection)
    bodies = new_content(content, fine.select("hash", F.col("body").alias("doc"), F.lit(scanned_at).cast("timestamp").alias("created_at")))
    vouched = fine.select("collection", "path", trusted_time(F.col("mtime"), F.lit(scanned_at).cast("timestamp")).alias("mtime"), "size", "hash")
    return {
        "documents": stored,
        "content": content.select("hash", "doc", "created_at").unionByName(bodies),
        "manifest": manifest.where(F.col("collection") != collection).unionByName(trusted).unionByName(vouched),
        "counters": counters,
    }


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
