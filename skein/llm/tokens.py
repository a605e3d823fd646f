"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 6).

Everything runs in Spark's own expressions:

1. the vocabulary's split pattern cuts a text into words; a word is written as one character per
   UTF-8 byte and cut further wherever two neighbouring bytes occur inside no token at all (no
   merge can ever cross such a place, so this is exact);
2. a chunk that is a token has its id at once, from a literal rank map: an array of small maps,
   bucketed by Spark's own hash, as a literal map is searched from end to end;
3. the other chunks are made distinct over the whole corpus; on each, a fold over its byte array
   repeats the merge of lowest rank, keeping the ranks of neighbouring pairs beside the pieces so
   that a merge looks up two new pairs only;
4. each text's chunks meet their ids again, and are put together in order;
5. ids become text again by concatenating the binary pieces of their tokens.

The tokenizer's files are read from a path that is a parameter; nothing is trained or copied.

Defined cases: a null or an empty text gives an empty list; texts that look like special tokens
are ordinary text; texts of any length are encoded whole; repeated or null document ids keep one
row each; a lone surrogate cannot occur in Spark strings; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import heavy_split_join, materialize

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
BUCKETS = 1 << 14
_NO_RANK = (1 << 31) - 1
_CUT = "\u0100"  # no byte character
#: The published split pattern of this vocabulary (fixed value), with Unicode white space spelt out for Java
#: and the frequent alternatives first (no other alternative starts with a letter or digit).
SPLIT = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def spark_hash(data: bytes, seed: int = 42) -> int:
    """What Spark's ``hash`` gives for a string of these UTF-8 bytes (Murmur3 of 32 bits, signed)."""
    mask = 0xFFFFFFFF

    def mix(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) * 0x1B873593 & mask
        h ^= k
        return ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask

    whole = len(data) // 4 * 4
    h = seed
    for i in range(0, whole, 4):
        h = mix(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mix(h, (b - 256 if b > 127 else b) & mask)
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


@lru_cache(4)
def _model(name: str, folder: str) -> tuple[str, str]:
    """(rank buckets as JSON, pattern of the places that no merge crosses)."""
    ranks = read_ranks(os.path.join(folder, name))
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    follows: list[set] = [set() for _ in range(256)]
    for token, rank in ranks.items():
        shown = token.decode("latin-1")
        buckets[spark_hash(shown.encode()) % BUCKETS][shown] = rank
        for a, b in zip(token, token[1:]):
            follows[a].add(b)
    # Of these places only those between two characters of three or four bytes are used: such
    # scripts have the long words.
    leads = [*range(0xE3, 0xEA), 0xEF, 0xF0]
    ways = []
    for lead in leads:
        if free := [c for c in range(0x80, 0xC0) if lead not in follows[c]]:
            ways.append(rf"(?=\x{lead:02x})(?<=[" + "".join(rf"\x{c:02x}" for c in free) + "])")
    never = "(?=[" + "".join(rf"\x{c:02x}" for c in leads) + "])(?:" + ("|".join(ways) or "(?!)") + ")"
    return json.dumps(buckets), never


def _rank_of(piece: Column, buckets: Column) -> Column:
    return F.try_element_at(F.get(buckets, F.pmod(F.hash(piece), F.lit(BUCKETS))), piece)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bytes(text: Column) -> Column:
    """Text with one character per UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def chunks_of(text: Column, never: str) -> Column:
    """The words of a text, in byte characters, cut where no merge can cross."""
    words = F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))
    cut = F.flatten(
        F.transform(
            words,
            lambda w: F.when(F.length(w) == F.octet_length(w), F.array(w)).otherwise(F.split(F.regexp_replace(_bytes(w), never, _CUT), _CUT)),
        )
    )
    return F.when(F.length(text) == F.octet_length(text), words).otherwise(cut)


def merge_fold(chunk: Column, buckets: Column) -> Column:
    """Ids of a chunk of byte characters by repeated merges of lowest rank, leftmost first."""
    none = F.lit(_NO_RANK)

    def pair(a: Column, b: Column) -> Column:
        return F.coalesce(_rank_of(F.concat(a, b), buckets), none)

    pieces = F.split(chunk, "")
    start = _let(
        pieces,
        lambda p: F.struct(p.alias("p"), F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda b, i: pair(F.get(p, i), b)).alias("r")),
    )

    def merged(acc: Column, at: Column) -> Column:
        p, r, n = acc["p"], acc["r"], F.size(acc["p"])
        joined = F.concat(F.get(p, at), F.get(p, at + 1))
        left = F.when(at > 0, F.array(pair(F.get(p, at - 1), joined))).otherwise(F.array().cast("array<int>"))
        right = F.when(at + 2 < n, F.array(pair(joined, F.get(p, at + 2)))).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.concat(F.slice(p, F.lit(1), at), F.array(joined), F.slice(p, at + 3, n)).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(at - 1, F.lit(0))), left, right, F.slice(r, at + 3, n)).alias("r"),
        )

    def step(acc: Column, _: Column) -> Column:
        lowest = F.array_min(acc["r"])
        return F.when(F.coalesce(lowest, none) == none, acc).otherwise(_let((F.array_position(acc["r"], lowest) - 1).cast("int"), lambda at: merged(acc, at)))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(chunk), F.lit(1))), start, step)
    return F.transform(folded["p"], lambda t: _rank_of(t, buckets))


def _ranked(df: DataFrame, keep: list[str], text_col: str, vocabulary: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rest, found): the rows with ``slots`` (ids, null where a chunk is no token) and ``rest``
    (those chunks in order), the rows with such chunks, and the ids of each distinct chunk with its occurrences ``k``."""
    literal, never = _model(vocabulary, folder)
    buckets = F.from_json(F.lit(literal), "array<map<string,int>>")
    # Each step refers to the one before more than once, so that Catalyst keeps them apart.
    cut = df.select(*keep, F.monotonically_increasing_id().alias("row"), chunks_of(F.coalesce(F.col(text_col), F.lit("")), never).alias("chunks"))
    ranked = cut.select(*keep, "row", "chunks", F.transform("chunks", lambda c: _rank_of(c, buckets)).alias("slots"))
    known = ranked.select(*keep, "row", "slots", F.filter("chunks", lambda c, i: F.get(F.col("slots"), i).isNull()).alias("rest"))
    known = materialize(known, "p6_known")
    rest = known.where(F.size("rest") > 0).select("row", "rest")
    found = rest.select(F.explode("rest").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k")).select("c", "k", merge_fold(F.col("c"), buckets).alias("ids"))
    return known, rest, found


def _met(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks (column ``c``) with what was found for them; a chunk that most texts hold never moves."""
    found = materialize(found, "p6_found")
    total = found.agg(F.sum("k")).first()[0] or 0
    return heavy_split_join(chunks, found, "c", "k", total)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``<id_col>, ids`` for each row of ``df``."""
    known, rest, found = _ranked(df, [id_col], text_col, vocabulary, folder)
    chunks = rest.select("row", F.posexplode("rest").alias("at", "c"))
    placed = _met(chunks, found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("m"))
    per_row = placed.select("row", F.col("m.ids").alias("m"))
    return known.join(per_row.hint("shuffle_hash"), "row", "left").select(id_col, _assembled(F.col("slots"), F.col("rest"), F.col("m")).alias("ids"))


@lru_cache(4)
def _token_literal(name: str, folder: str) -> str:
    """The tokens in the order of their ids, one character per byte, as JSON; unused ids are null."""
    ranks = read_ranks(os.path.join(folder, name))
    tokens: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.decode("latin-1")
    return json.dumps(tokens)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``<id_col>, text`` for each row of ``df``: the binary pieces of the ids put together and read as UTF-8.

    Null ids give a null text, an empty list gives an empty one, and an id outside the vocabulary is an error. Bytes
    that are no UTF-8 (a list cut within a character) become replacement characters.
    """
    tokens = F.from_json(F.lit(_token_literal(vocabulary, folder)), "array<string>")
    pieces = F.transform(F.col(ids_col), lambda i: F.coalesce(F.get(tokens, i), F.raise_error(F.lit("an id is not in the vocabulary")).cast("string")))
    return df.select(id_col, F.make_valid_utf8(F.encode(F.array_join(pieces, ""), "ISO-8859-1").cast("string")).alias("text"))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``<id_col>, key, n_tokens`` for each row of ``df``, without putting the ids together; ``key`` is a hash of id and text."""
    keyed = df.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("key"))
    known, rest, found = _ranked(keyed, [id_col, "key"], text_col, vocabulary, folder)
    chunks = rest.select("row", F.explode("rest").alias("c")).groupBy("row", "c").agg(F.count(F.lit(1)).alias("k"))
    more = _met(chunks.withColumnRenamed("k", "times"), found.select("c", F.size("ids").alias("n"), "k")).select("row", F.col("times") * F.col("n"))
    sure = known.select(id_col, "key", "row", (F.size("slots") - F.size("rest")).cast("long").alias("n"))
    total = sure.unionByName(more.toDF("row", "n"), allowMissingColumns=True)
    return total.groupBy("row").agg(F.max(id_col).alias(id_col), F.max("key").alias("key"), F.sum("n").alias("n_tokens")).select(id_col, "key", "n_tokens")


def _assembled(slots: Column, rest: Column, m: Column) -> Column:
    """Ids in order: the k-th slot without an id takes the ids of the k-th of ``rest``."""
    gaps = F.filter(F.transform(slots, lambda s, i: F.when(s.isNull(), i)), lambda i: i.isNotNull())

    def filled(gap: Column) -> Column:
        def run(_: Column, k: Column) -> Column:
            start = F.coalesce(F.get(gap, k - 1) + 1, F.lit(0))
            return F.concat(F.slice(slots, start + 1, F.get(gap, k) - start), F.get(m, k))

        tail = F.slice(slots, F.element_at(gap, -1) + 2, F.size(slots))
        return F.concat(F.flatten(F.transform(rest, run)), tail)

    return F.when(F.size(rest) == 0, slots).otherwise(_let(gaps, filled))
