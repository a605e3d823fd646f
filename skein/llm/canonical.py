"""Duplicates hidden by formatting differences (problem 3).

1. Rows that agree byte for byte in ``query`` and ``output`` are collapsed with their count and
   smallest id (partial aggregation on the map side, so a hot row shrinks before it moves).
2. Only these distinct survivors are canonicalised: upper case (full case mapping, so that
   ``ß`` and ``SS`` agree), composed accents, nothing but letters, digits and the accents that
   belong to them; the entries of ``output`` as (type, text) in sorted order.
3. Survivors are grouped again on the SHA-256 digest of the full canonical text, summing counts.
4. Ids meet their group by the raw row's 128-bit hash; hot groups by a bounded broadcast
   (:func:`skein.session.heavy_split_join`), the others by a shuffled join.

Defined cases: null queries, null or empty outputs are never copies and are left out; null
entries, types or texts count as empty strings; texts may be of any length; a record id that
comes twice counts once; empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import heavy_split_join, materialize


def _compositions() -> str:
    """Every (base, mark, composed) triple of canonical composition, simple ones first."""
    found = []
    for code in range(0xC0, sys.maxunicode + 1):
        ch = chr(code)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            base, mark = (chr(int(x, 16)) for x in parts)
            found.append((len(unicodedata.normalize("NFD", ch)), base + mark + ch))
    return " ".join(t for _, t in sorted(found))


_TRIPLES = _compositions()


def letters_and_digits(text: Column) -> Column:
    """``text`` in upper case and without anything but letters, digits and their accents."""
    composed = F.when(
        text.rlike(r"\p{M}"),
        F.aggregate(F.split(F.lit(_TRIPLES), " "), text, lambda acc, t: F.replace(acc, F.substring(t, 1, 2), F.substring(t, 3, 1))),
    ).otherwise(text)
    return F.regexp_replace(F.upper(composed), r"[^\p{L}\p{N}\p{Mn}\p{Mc}]|[\x{FE00}-\x{FE0F}\x{34F}]", "")


def canonical_record(query: Column, output: Column) -> Column:
    """The canonical text of a record: query, then the sorted (type, text) entries."""

    def field(entry: Column, i: int) -> Column:
        return F.coalesce(letters_and_digits(F.get(entry, F.lit(i))), F.lit(""))

    entries = F.transform(output, lambda e: F.concat(field(e, 0), F.lit("\u0001"), field(e, 1)))
    return F.concat(letters_and_digits(query), F.lit("\u0002"), F.array_join(F.array_sort(entries), "\u0002", ""))


def copy_groups(df: DataFrame, id_col: str, query_col: str, output_col: str) -> tuple[DataFrame, DataFrame]:
    """(raw groups, canonical groups with more than one record).

    Raw groups: ``raw`` (128-bit hash), ``root`` (smallest id), ``n`` (rows), ``canon`` (digest);
    canonical groups: ``canon``, ``root``, ``n``.
    """
    q, o = F.col(query_col), F.col(output_col)
    rows = df.where(q.isNotNull() & (F.size(o) > 0)).select(F.col(id_col).alias("id"), q.alias("q"), o.alias("o"))
    survivors = rows.groupBy("q", "o").agg(F.min("id").alias("root"), F.count("id").alias("n"))
    narrow = survivors.select(
        _raw_key(F.col("q"), F.col("o")).alias("raw"),
        "root",
        "n",
        F.unhex(F.sha2(canonical_record(F.col("q"), F.col("o")), 256)).alias("canon"),
    )
    raw = materialize(narrow, "p3_raw")
    canon = raw.groupBy("canon").agg(F.min("root").alias("root"), F.sum("n").alias("n")).where("n > 1")
    return raw, canon


def _raw_key(q: Column, o: Column) -> Column:
    return F.struct(F.xxhash64(q, o).alias("a"), F.xxhash64(o, F.lit(1), q).alias("b"))


def collapse_copies(df: DataFrame, id_col: str = "record_id", query_col: str = "query", output_col: str = "output") -> DataFrame:
    """One row per group of copies: ``record_id`` (smallest id) and ``n_copies`` (records in the group)."""
    _, canon = copy_groups(df, id_col, query_col, output_col)
    return canon.select(F.col("root").alias("record_id"), F.col("n").alias("n_copies"))


def copy_pairs(df: DataFrame, id_col: str = "record_id", query_col: str = "query", output_col: str = "output") -> DataFrame:
    """``record_id, copy_id``: each copy beside the smallest id of its group."""
    raw, canon = copy_groups(df, id_col, query_col, output_col)
    total = raw.agg(F.sum("n")).first()[0] or 0
    variants = heavy_split_join(
        raw.select("canon", "raw", F.col("n").alias("n_raw")), canon.select("canon", "root", F.col("n").alias("n_all")), "canon", "n_all", total
    )
    variants = materialize(variants.select("raw", "root", "n_raw"), "p3_variants")
    q, o = F.col(query_col), F.col(output_col)
    ids = df.where(q.isNotNull() & (F.size(o) > 0)).select(F.col(id_col).alias("copy_id"), _raw_key(q, o).alias("raw"))
    met = heavy_split_join(ids, variants, "raw", "n_raw", total)
    return met.where("copy_id <> root").select(F.col("root").alias("record_id"), "copy_id")
