"""Typed document metadata: extraction, entries, predicates and discovery.

Entries are rows ``doc, key, ordinal, value_type, text_value, number_value, boolean_value``; a document is
eligible if its extraction is current and free of errors (table ``doc, version, error``). A predicate
becomes one boolean column over a pivot ``doc -> key -> typed values``, so a filter costs one
aggregation whatever the number of its conditions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_fold

VERSION = 1
#: Limits of front matter and of filters.
MAX_FRONT, MAX_KEYS, MAX_KEY_BYTES, MAX_STRING, MAX_ITEMS, MAX_ERROR = 64 * 1024, 64, 128, 1024, 128, 200
MAX_DEPTH, MAX_NODES, MAX_OPERANDS, MAX_MEMBERS = 16, 256, 32, 64

ENTRY_SCHEMA = "key string, ordinal int, value_type string, text_value string, number_value double, boolean_value boolean"
_FRONT = re.compile(r"\A﻿?---[ \t]*\r?\n(.*?)(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", re.S)
#: The same block for Spark, so that only it leaves the JVM.
_BLOCK = r"^\x{FEFF}?---[ \t]*\r?\n(?s:.*?)(?:(?<=\n)|\n)(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)"


class MetadataError(ValueError):
    """Metadata of the wrong shape."""


def front_matter(text: str) -> str | None:
    m = _FRONT.match(text)
    return m[1] if m else None


def _load_yaml(block: str):
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise MetadataError("YAML is not available") from e
    try:
        return yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise MetadataError(str(e)[:MAX_ERROR]) from e


def _typed(value) -> tuple[str, object]:
    if isinstance(value, bool):
        return "boolean", value
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return "number", float(value)
    if isinstance(value, str):
        if len(value) > MAX_STRING:
            raise MetadataError("string too long")
        return "string", value
    raise MetadataError(f"unsupported value of type {type(value).__name__}")


def entries_of(mapping) -> list[tuple]:
    """Typed entries of a metadata mapping; all or nothing."""
    if not isinstance(mapping, dict):
        raise MetadataError("metadata must be a mapping")
    if len(mapping) > MAX_KEYS:
        raise MetadataError("too many keys")
    out = []
    for key, value in mapping.items():
        if not isinstance(key, str) or not key or len(key.encode()) > MAX_KEY_BYTES:
            raise MetadataError("bad key")
        values = value if isinstance(value, list) else [value]
        if not values or len(values) > MAX_ITEMS:
            raise MetadataError("bad number of values")
        typed = list(dict.fromkeys(_typed(v) for v in values))
        if len({t for t, _ in typed}) > 1:
            raise MetadataError("mixed types in an array")
        for i, (t, v) in enumerate(typed):
            out.append((key, i, t, v if t == "string" else None, v if t == "number" else None, v if t == "boolean" else None))
    return out


def extract(text: str, namespace: str | None = None) -> list[tuple]:
    """Entries of a document's front matter: the mapping ``metadata`` under ``namespace`` (or under the only
    top-level key that has one). No front matter or no such mapping gives no entries."""
    block = front_matter(text)
    if block is None:
        return []
    if len(block.encode()) > MAX_FRONT:
        raise MetadataError("front matter too large")
    top = _load_yaml(block)
    if not isinstance(top, dict):
        return []
    keys = [namespace] if namespace else [k for k, v in top.items() if isinstance(v, dict) and "metadata" in v]
    if not keys or keys[0] not in top:
        return []
    space = top[keys[0]]
    if not isinstance(space, dict):
        raise MetadataError("the namespace must be a mapping")
    return entries_of(space["metadata"]) if space.get("metadata") is not None else []


def extract_metadata(docs: DataFrame, doc: str, text: str, path: str, namespace: str | None = None) -> DataFrame:
    """``doc, version, error, entries`` of each document; only Markdown files are read, the others have no entries."""
    kind = dict(docs.dtypes)[doc]
    cols = docs.select(F.col(doc).alias("doc"), F.when(F.lower(path).rlike(r"\.(md|markdown|mdx)$") & F.col(text).rlike(r"^\x{FEFF}?---"), F.regexp_extract(text, _BLOCK, 0)).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc"], pdf["text"]):
                try:
                    got, error = (extract(t, namespace) if isinstance(t, str) and "---" in t[:8] else []), None
                except MetadataError as e:
                    got, error = [], str(e)[:MAX_ERROR]
                rows.append((i, VERSION, error, [dict(zip(("key", "ordinal", "value_type", "text_value", "number_value", "boolean_value"), e)) for e in got]))
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(("doc", "version", "error", "entries"))})

    return cols.mapInPandas(run, f"doc {kind}, version int, error string, entries array<struct<{ENTRY_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")


def explode_entries(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc", F.explode("entries").alias("e")).select("doc", "e.*")


def eligible(extracted: DataFrame) -> DataFrame:
    """``doc`` of the documents with a current extraction without error."""
    return extracted.where((F.col("version") == VERSION) & F.col("error").isNull()).select("doc")


# ---- predicates -------------------------------------------------------------------------------

_ORDERED = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
_TEXT = {"contains", "prefix", "suffix"}
_MEMBER = {"in", "nin", "all"}
_SHARED = {"eq", "ne", *_ORDERED, "in", "nin", *_TEXT, "type"}


class FilterError(ValueError):
    def __init__(self, path: str, detail: str) -> None:
        super().__init__(f"invalid filter at {path}: {detail}")
        self.path = path


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object
    fold: bool = False


@dataclass(frozen=True)
class Group:
    op: str  # and, or, not
    parts: tuple


def _scalar(value, path: str):
    if isinstance(value, bool) or isinstance(value, str) and len(value) <= MAX_STRING:
        return value
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return float(value)
    raise FilterError(path, "a string, finite number or boolean is required")


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, float) else "string"


def parse_filter(node, entry: bool = False, path: str = "$", depth: int = 1, seen: list | None = None):
    """Checks a JSON predicate over documents, or over single entries (fields ``key`` and ``value``)."""
    seen = [0] if seen is None else seen
    seen[0] += 1
    if depth > MAX_DEPTH or seen[0] > MAX_NODES:
        raise FilterError(path, "too deep or too large")
    if not isinstance(node, dict):
        raise FilterError(path, "an object is required")
    op = node.get("operator")
    known = {"and": {"operator", "operands"}, "or": {"operator", "operands"}, "not": {"operator", "operand"}}
    if op in known:
        if extra := set(node) - known[op]:
            raise FilterError(path, f"unknown property {sorted(extra)[0]}")
        if op == "not":
            return Group(op, (parse_filter(node.get("operand"), entry, f"{path}.operand", depth + 1, seen),))
        parts = node.get("operands")
        if not isinstance(parts, list) or not 1 <= len(parts) <= MAX_OPERANDS:
            raise FilterError(f"{path}.operands", f"1 to {MAX_OPERANDS} operands are required")
        return Group(op, tuple(parse_filter(p, entry, f"{path}.operands[{i}]", depth + 1, seen) for i, p in enumerate(parts)))
    if op not in _SHARED | (set() if entry else {"all", "exists"}):
        raise FilterError(f"{path}.operator", "unknown operator")
    if extra := set(node) - {"field", "operator", "value", "caseInsensitive"}:
        raise FilterError(path, f"unknown property {sorted(extra)[0]}")
    field, value, fold = node.get("field"), node.get("value"), node.get("caseInsensitive")
    if not isinstance(field, str) or not field or len(field.encode()) > MAX_KEY_BYTES or entry and field not in ("key", "value"):
        raise FilterError(f"{path}.field", "bad field")
    if fold is not None and not isinstance(fold, bool):
        raise FilterError(f"{path}.caseInsensitive", "a boolean is required")
    at = f"{path}.value"
    if op in ("exists", "type"):
        if fold is not None:
            raise FilterError(f"{path}.caseInsensitive", "does not apply here")
        if op == "exists" and not isinstance(value, bool) or op == "type" and value not in ("string", "number", "boolean"):
            raise FilterError(at, "bad value")
        return Condition(field, op, value)
    if op in _MEMBER:
        if not isinstance(value, list) or not 1 <= len(value) <= MAX_MEMBERS:
            raise FilterError(at, f"1 to {MAX_MEMBERS} values are required")
        value = tuple(dict.fromkeys(_scalar(v, at) for v in value))
        if len({_kind(v) for v in value}) > 1:
            raise FilterError(at, "values of one type are required")
        strings = _kind(value[0]) == "string"
    else:
        value = _scalar(value, at)
        strings = isinstance(value, str)
        if op in _TEXT and (not strings or not value):
            raise FilterError(at, "a non-empty string is required")
        if op in _ORDERED and isinstance(value, bool):
            raise FilterError(at, "a string or number is required")
    if fold is not None and not strings:
        raise FilterError(f"{path}.caseInsensitive", "applies to strings only")
    return Condition(field, op, value, bool(fold))


_ARRAYS = {"string": "texts", "number": "numbers", "boolean": "flags"}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _compare(op: str, value, fold: bool):
    """A test of one value against the operand (or operands)."""

    def side(c: Column) -> Column:
        return ascii_fold(c) if fold else c

    def lit(v) -> Column:
        return F.lit(v.translate(_LOWER) if fold and isinstance(v, str) else v)

    def test(c: Column) -> Column:
        c = side(c)
        if op in ("in", "nin"):
            return c.isin([x.translate(_LOWER) if fold and isinstance(x, str) else x for x in value])
        if op in ("eq", "ne"):
            return c == lit(value)
        if op in _ORDERED:
            return {">": c > lit(value), ">=": c >= lit(value), "<": c < lit(value), "<=": c <= lit(value)}[_ORDERED[op]]
        return {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith}[op](c, lit(value))

    return test


def document_column(node, pivot: Column) -> Column:
    """A parsed predicate as a column over ``pivot``: map of key to (texts, numbers, flags)."""
    if isinstance(node, Group):
        parts = [document_column(p, pivot) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out
    held = F.try_element_at(pivot, F.lit(node.field))
    if node.op == "exists":
        return held.isNotNull() if node.value else held.isNull()
    if node.op == "type":
        return F.coalesce(F.size(held[_ARRAYS[node.value]]) > 0, F.lit(False))
    sample = node.value[0] if isinstance(node.value, tuple) else node.value
    values = held[_ARRAYS[_kind(sample)]]
    if node.op == "all":
        every = F.lit(True)
        for v in node.value:
            every = every & F.exists(values, _compare("eq", v, node.fold))
        return F.coalesce(every, F.lit(False))
    some = F.exists(values, _compare(node.op, node.value, node.fold))
    if node.op in ("ne", "nin"):
        some = (F.size(values) > 0) & ~some
    return F.coalesce(some, F.lit(False))


def entry_column(node) -> Column:
    """A parsed predicate over entries as a column over the entry table."""
    if isinstance(node, Group):
        parts = [entry_column(p) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.op == "and" else out | p
        return out
    if node.op == "type":
        return F.lit(node.value == "string") if node.field == "key" else F.col("value_type") == node.value
    sample = node.value[0] if isinstance(node.value, tuple) else node.value
    kind = _kind(sample)
    if node.field == "key":
        if kind != "string":
            return F.lit(False)
        column = F.col("key")
    else:
        column = F.col({"string": "text_value", "number": "number_value", "boolean": "boolean_value"}[kind])
    hit = _compare(node.op, node.value, node.fold)(column)
    return F.coalesce(column.isNotNull() & (~hit if node.op in ("ne", "nin") else hit), F.lit(False))


def pivot_entries(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``doc, m``: the entries of each document as a map of key to typed values."""
    rows = entries if keys is None else entries.where(F.col("key").isin(keys))
    held = rows.groupBy("doc", "key").agg(F.collect_set("text_value").alias("texts"), F.collect_set("number_value").alias("numbers"), F.collect_set("boolean_value").alias("flags"))
    return held.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("texts", "numbers", "flags")))).alias("m"))


def _fields(node) -> set[str]:
    return {node.field} if isinstance(node, Condition) else set().union(*map(_fields, node.parts))


def filter_documents(eligible_docs: DataFrame, entries: DataFrame, predicate: dict) -> DataFrame:
    """``doc`` of the eligible documents that satisfy the JSON predicate."""
    node = parse_filter(predicate)
    pivot = pivot_entries(entries, sorted(_fields(node)))
    return eligible_docs.join(pivot, "doc", "left").where(document_column(node, F.coalesce(F.col("m"), F.create_map().cast("map<string,struct<texts:array<string>,numbers:array<double>,flags:array<boolean>>>")))).select("doc")


# ---- discovery --------------------------------------------------------------------------------


def value_column() -> Column:
    """One text for a value of any type, for grouping and output."""
    return F.coalesce(F.col("text_value"), F.col("number_value").cast("string"), F.col("boolean_value").cast("string"))


def key_window(entries: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """``key, documents, position, total_keys, in_page``: keys by their number of documents, then name; the first key stays (outside
    the page) so that the total survives a page out of range."""
    counted = entries.groupBy("key").agg(F.count_distinct("doc").alias("documents"))
    order = W.orderBy(F.desc("documents"), "key")
    ranked = counted.withColumn("position", F.row_number().over(order)).withColumn("total_keys", F.count(F.lit(1)).over(W.partitionBy()))
    page = (F.col("position") > offset) & (F.col("position") <= offset + limit)
    return ranked.withColumn("in_page", page).where("in_page or position = 1")


def type_stats(entries: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """``key, value_type, documents, multi_valued`` and, with ``doc, collection``, the sorted collections."""
    rows = entries if collections is None else entries.join(collections, "doc")
    aggs = [F.count_distinct("doc").alias("documents"), (F.max("ordinal") > 0).alias("multi_valued")]
    if collections is not None:
        aggs.append(F.sort_array(F.collect_set("collection")).alias("collections"))
    return rows.groupBy("key", "value_type").agg(*aggs)


def number_ranges(entries: DataFrame) -> DataFrame:
    """``key, low, median, high`` over the number rows; the median is the mean of the two middle values, halved first where their
    sum is not finite. Values are counted before they are ordered, so a repeated value is one row however often it occurs."""
    counted = entries.where("value_type = 'number' and number_value is not null").groupBy("key", F.col("number_value").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    part = W.partitionBy("key")
    at = counted.withColumn("end", F.sum("k").over(part.orderBy("v").rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(part))
    middle = [F.min(F.when(F.col("end") > F.floor((F.col("n") - x) / 2), F.col("v"))).alias(c) for x, c in ((1, "a"), (0, "b"))]
    both = at.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), *middle)
    mean = (F.col("a") + F.col("b")) / 2
    finite = F.abs(F.col("a") + F.col("b")) < float("inf")
    return both.select("key", "low", F.when(finite, mean).otherwise(F.col("a") / 2 + F.col("b") / 2).alias("median"), "high")


def value_counts(entries: DataFrame, limit: int = 10, offset: int = 0, least: int = 1, by_count: bool = True) -> DataFrame:
    """``key, value_type, value, documents, position, distinct_values, in_page`` within each key and type; the first value
    stays (outside the page) so that the totals of a key survive a page out of range."""
    counted = entries.select("doc", "key", "value_type", value_column().alias("value")).groupBy("key", "value_type", "value").agg(F.count_distinct("doc").alias("documents")).where(F.col("documents") >= least)
    part = W.partitionBy("key", "value_type")
    order = [F.desc("documents"), F.col("value")] if by_count else [F.col("value")]
    ranked = counted.withColumn("position", F.row_number().over(part.orderBy(*order))).withColumn("distinct_values", F.count(F.lit(1)).over(part))
    page = (F.col("position") > offset) & (F.col("position") <= offset + limit)
    return ranked.withColumn("in_page", page).where("in_page or position = 1")


def collection_summaries(entries: DataFrame, collections: DataFrame, keys: int = 5) -> DataFrame:
    """``collection, key, documents, position, total_keys``: the most frequent keys of each collection,
    counted by first values only."""
    counted = entries.where("ordinal = 0").join(collections, "doc").groupBy("collection", "key").agg(F.count(F.lit(1)).alias("documents"))
    part = W.partitionBy("collection")
    ranked = counted.withColumn("total_keys", F.count(F.lit(1)).over(part)).withColumn("position", F.row_number().over(part.orderBy(F.desc("documents"), "key")))
    return ranked.where(F.col("position") <= keys)


def type_conflicts(entries: DataFrame) -> DataFrame:
    """``key, types``: keys whose values are of more than one type."""
    return entries.groupBy("key").agg(F.sort_array(F.collect_set("value_type")).alias("types")).where(F.size("types") > 1)


def pending(documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """Documents without a current extraction."""
    return documents.join(extracted.where(F.col("version") == VERSION).select("doc"), "doc", "left_anti")
