"""Collections, their scope, contexts and listings; clean-up and upkeep of the tables behind them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import glob_regex
from . import maintenance


@dataclass
class Collection:
    """One entry of the configuration: a root, masks, ignore rules, contexts by prefix, and whether queries take it by default."""

    name: str
    path: str
    mask: str = "**/*.md"
    ignore: list[str] = field(default_factory=list)
    contexts: dict[str, str] = field(default_factory=dict)
    by_default: bool = True


class Catalog:
    """The configured collections; as many as a person writes down, so they live on the driver."""

    def __init__(self, collections: list[Collection] = (), global_context: str | None = None) -> None:
        self.collections = {c.name: c for c in collections}
        self.global_context = global_context

    @classmethod
    def from_config(cls, config: dict) -> Catalog:
        """From a parsed configuration: ``collections`` by name, each with ``path`` and optional ``pattern``, ``ignore``,
        ``context`` and ``includeByDefault``; ``global_context``."""
        found = []
        for name, c in (config.get("collections") or {}).items():
            if not c or not c.get("path"):
                raise ValueError(f"collection {name!r} has no path")
            found.append(Collection(name, c["path"], c.get("pattern", "**/*.md"), list(c.get("ignore") or []), dict(c.get("context") or {}), c.get("includeByDefault", True) is not False))
        return cls(found, config.get("global_context"))

    def sync(self, documents: DataFrame) -> DataFrame:
        """The documents of configured collections; those of others are gone with their collection."""
        return documents.where(F.col("collection").isin(list(self.collections)))

    def scope(self, named: list[str] | None = None) -> list[str]:
        """The named collections (trimmed, blanks dropped), or those that queries take by default."""
        names = [n.strip() for n in named or [] if n.strip()]
        if bad := [n for n in names if n not in self.collections]:
            raise ValueError(f"unknown collections: {', '.join(bad)}")
        return names or [c.name for c in self.collections.values() if c.by_default]

    def remove(self, name: str) -> None:
        del self.collections[name]

    def rename(self, old: str, new: str) -> None:
        if new in self.collections:
            raise ValueError(f"collection {new!r} exists")
        c = self.collections.pop(old)
        c.name = new
        self.collections[new] = c

    def set_context(self, name: str | None, prefix: str, text: str) -> None:
        if name is None:
            self.global_context = text
        elif name not in self.collections:
            raise ValueError(f"collection {name!r} not found")
        else:
            self.collections[name].contexts[prefix] = text

    def remove_context(self, name: str | None, prefix: str = "") -> int:
        """Contexts removed; without a collection the global one and each collection's root context."""
        if name is not None:
            return int(self.collections[name].contexts.pop(prefix, None) is not None)
        n, self.global_context = int(self.global_context is not None), None
        return n + sum(c.contexts.pop("", None) is not None for c in self.collections.values())

    def contexts(self, spark: SparkSession) -> DataFrame:
        """``collection, prefix, text`` by collection, longest prefix first; the global one has no collection."""
        rows = [(c.name, p, t) for c in self.collections.values() for p, t in c.contexts.items()]
        rows.sort(key=lambda r: (r[0], -len(r[1]), r[1]))
        if self.global_context is not None:
            rows.insert(0, (None, "", self.global_context))
        return spark.createDataFrame(rows, "collection string, prefix string, text string")

    def ignored(self, refs: DataFrame) -> DataFrame:
        """``ref, collection, path, rule`` of the references (``ref``) that an ignore rule excludes: the first collection and rule.

        A reference is a virtual path, an absolute path below a root, ``collection/path`` or a path.
        """
        plain = F.trim(F.replace(F.col("ref"), F.lit("\\"), F.lit("/")))
        scheme = F.regexp_extract(plain, r"^[a-z]+://+(.*)$", 1)
        found = None
        for c in self.collections.values():
            if not c.ignore:
                continue
            own = F.lit(c.name + "/")
            path = (
                F.when(scheme != "", F.when(scheme.startswith(c.name + "/"), F.substring(scheme, len(c.name) + 2, 1 << 30)))
                .when(plain.startswith(c.path.rstrip("/") + "/"), F.substring(plain, len(c.path.rstrip("/")) + 2, 1 << 30))
                .when(plain.startswith("/"), F.lit(None))
                .when(F.startswith(plain, own), F.substring(plain, len(c.name) + 2, 1 << 30))
                .otherwise(plain)
            )
            rule = F.coalesce(*[F.when(path.rlike(glob_regex(r.replace("\\", "/").lstrip("/"))), F.lit(r)) for r in c.ignore])
            hit = F.when(path.isNotNull() & rule.isNotNull(), F.struct(F.lit(c.name).alias("collection"), path.alias("path"), rule.alias("rule")))
            found = hit if found is None else F.coalesce(found, hit)
        if found is None:
            found = F.lit(None).cast("struct<collection:string,path:string,rule:string>")
        return refs.select("ref", found.alias("h")).where("h is not null").select("ref", "h.collection", "h.path", "h.rule")


def resolved_path(path: Column) -> Column:
    """An absolute path without ``.`` and ``..``; a ``..`` at the root stays there."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def contained(path: Column, root: Column) -> Column:
    """Whether a path, once resolved, stays below its collection's root; links are for the file system to resolve."""
    inside, top = resolved_path(path), resolved_path(root)
    return (top == "/") | (inside == top) | F.startswith(inside, F.concat(top, F.lit("/")))


def root_exists(spark: SparkSession, root: str) -> bool:
    """Whether the root is a directory; a scan of a missing one must leave the index as it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(path) and system.getFileStatus(path).isDirectory())


def list_files(documents: DataFrame, collection: str | None = None, prefix: str = "") -> DataFrame:
    """``collection, path, size, modified_at`` of active documents below a plain prefix, by path; the size is in characters."""
    rows = documents.where("active")
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    if prefix:
        rows = rows.where(F.startswith(F.col("path"), F.lit(prefix)))
    return rows.select("collection", "path", F.length("body").alias("size"), "modified_at").orderBy("collection", "path")


def list_collections(documents: DataFrame) -> DataFrame:
    """``collection, files`` of active documents, by name."""
    return documents.where("active").groupBy("collection").agg(F.count(F.lit(1)).alias("files")).orderBy("collection")


def attach_metadata(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Results (``doc``) with ``metadata``, a JSON object of their entries by key (arrays where a key has several); null without any.

    Joined after ranking, when few results are left.
    """
    value = F.coalesce(F.to_json(F.struct(F.col("text_value").alias("v"))), F.lit("{}"))
    text = F.when(F.col("value_type") == "string", F.regexp_replace(value, r'^\{"v":|\}$', "")).when(F.col("value_type") == "number", F.col("number_value").cast("string")).otherwise(F.col("boolean_value").cast("string"))
    per = entries.join(results.select("doc").distinct(), "doc", "left_semi").groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("ordinal", text.alias("t")))).alias("v"))
    texts = F.transform("v", lambda x: x["t"])
    shown = F.when(F.size("v") == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
    one = per.select("doc", F.struct("key", F.concat(F.lit('"'), "key", F.lit('":'), shown).alias("t")).alias("e"))
    whole = one.groupBy("doc").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda x: x["t"]), ","), F.lit("}")).alias("metadata"))
    return results.join(whole, "doc", "left")


def fingerprint_groups(vectors: DataFrame) -> DataFrame:
    """``model, fingerprint, docs, chunks`` of stored vectors."""
    return vectors.groupBy("model", "fingerprint").agg(F.count_distinct("hash").alias("docs"), F.count(F.lit(1)).alias("chunks"))


def adopt_fingerprint(checked: DataFrame, vectors: DataFrame, fingerprint: str, least: int = 1, tolerance: float = 1e-4) -> DataFrame:
    """Vectors without a fingerprint take the current one if at least ``least`` of them were embedded again (``checked``: ``distance``)
    and all came out within ``tolerance``."""
    row = checked.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).first()
    if row["n"] < least or row["far"] is None or row["far"] > tolerance:
        return vectors
    return vectors.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(fingerprint)))


def occupancy(files: DataFrame, capacity: int) -> DataFrame:
    """``rows, chunks, needed, occupancy, repack`` of a vector table whose files hold ``rows`` live rows each."""
    sums = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("chunks"))
    needed = F.ceil(F.col("rows") / capacity)
    share = F.when(F.col("chunks") == 0, 1.0).otherwise(needed / F.col("chunks"))
    return sums.select("rows", "chunks", needed.alias("needed"), share.alias("occupancy"), (share < maintenance.REPACK_BELOW).alias("repack"))


def repack(vectors: DataFrame, path: str, capacity: int, key: str = "hash") -> DataFrame:
    """The vectors written anew in full files of about ``capacity`` rows."""
    n = vectors.count()
    vectors.repartition(max(1, -(-n // capacity)), key).write.mode("overwrite").option("maxRecordsPerFile", capacity).parquet(path)
    return vectors.sparkSession.read.parquet(path)


def cleanup(content: DataFrame, documents: DataFrame, vectors: DataFrame, cache: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without inactive documents, content nothing refers to, vectors of no active document, and old cache rows.

    Content goes by what documents (inactive ones too) refer to before they go, as a second clean-up takes the rest.
    """
    out = {
        "vectors": vectors.join(documents.where("active").select("hash").distinct(), "hash", "left_semi"),
        "content": content.join(documents.where("hash is not null").select("hash").distinct(), "hash", "left_semi"),
        "documents": documents.where("active"),
    }
    if cache is not None:
        out["cache"] = maintenance.keep_newest(cache)
    return out


def remove_collection(documents: DataFrame, content: DataFrame, collection: str) -> tuple[DataFrame, DataFrame]:
    """Documents without the collection, and the content that others still refer to."""
    kept = documents.where(F.col("collection") != collection)
    return kept, content.join(kept.where("hash is not null").select("hash").distinct(), "hash", "left_semi")


def clear_embeddings(vectors: DataFrame, documents: DataFrame, collection: str | None = None) -> DataFrame:
    """Vectors without all, or without those of content that only the collection has."""
    if collection is None:
        return vectors.limit(0)
    return vectors.join(maintenance.exclusive_hashes(documents, collection), "hash", "left_anti")


def copied_vectors(vectors: DataFrame, documents: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that collections lack of vectors that others have, ready to append."""
    missing = maintenance.missing_rows(vectors, documents, rows)
    return missing.join(vectors, ["hash", "seq"])


@dataclass(frozen=True)
class Window:
    """The checked window of a metadata listing; a limit of null shows all."""

    key_limit: int | None = 50
    key_offset: int = 0
    value_limit: int | None = 10
    value_offset: int = 0
    sort: str = "count"
    min_count: int = 1

    def __post_init__(self) -> None:
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53
        for name in ("key_limit", "value_limit"):
            v = getattr(self, name)
            if v is not None and not (whole(v) and v >= 1):
                raise ValueError(f"Invalid {name}: expected a positive integer or None, received {v!r}")
        for name in ("key_offset", "value_offset"):
            if not (whole(v := getattr(self, name)) and v >= 0):
                raise ValueError(f"Invalid {name}: expected a non-negative integer, received {v!r}")
        if not (whole(self.min_count) and self.min_count >= 1):
            raise ValueError(f"Invalid min_count: expected a positive integer, received {self.min_count!r}")
        if self.sort not in ("count", "value"):
            raise ValueError(f"Invalid sort: expected 'count' or 'value', received {self.sort!r}")
