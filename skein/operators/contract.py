"""Validation of training targets: codes of errors and warnings of each record, as columns.

A target is a query, an optional intent and ``output``, entries of (kind, text). All checks are SQL expressions over
the record's own row, so there is no shuffle and nothing leaves the JVM. A token counter is a parameter (column to column);
the default counts words.

Defined cases: null queries, outputs, entries, kinds and texts have codes of their own; repeated rows are judged each by itself;
texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, most entries of each, chat tokens, least and most tokens of questions and passages, most of a lexical line.
KINDS = ("hyde", "lex", "vec")
MOST = {"lex": 3, "vec": 3, "hyde": 1}
CHAT_TOKENS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<think>", "</think>")
LENGTHS = {"vec": (4, 48, "WARN"), "hyde": (32, 128, "WARN")}
LEX_LENGTH = 16
ONLY_MODE = r"(?:/only:|\bonly:\s*)(?:lex|vec|hyde)\s*$"
TIME_SENSITIVE = r"\b(?:latest|current version|ranking|score)\b|\b20\d{2}\b"
TEMPLATE = "how to how to"

_CODES = "array<struct<code:string,path:string>>"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def compared(c: Column) -> Column:
    """How texts are compared: lower case, white space collapsed."""
    return F.regexp_replace(F.lower(stripped(c)), r"[\s\p{Z}]+", " ")


def word_count(c: Column) -> Column:
    return F.size(F.split(stripped(c), r"[\s\p{Z}]+"))


def _code(condition: Column, code: str, path: Column | str) -> Column:
    """An array of the code if the condition holds."""
    where = F.lit(path) if isinstance(path, str) else path
    return F.when(condition, F.array(F.struct(F.lit(code).alias("code"), where.alias("path")))).otherwise(F.array().cast(_CODES))


def _each(items: Column, condition, code, path: str = "[1]") -> Column:
    """The code for every item that meets the condition."""
    hit = F.filter(items, condition)
    return F.transform(hit, lambda x: F.struct(F.lit(code).alias("code"), F.concat(F.lit("output["), x["i"].cast("string"), F.lit("]" + path)).alias("path")))


def _sized(kind: str, least: int, below: int) -> Callable[[Column], Column]:
    """Items of a kind with a number of tokens in a range."""
    return lambda x: (x["kind"] == kind) & (x["n"] >= least) & (x["n"] < below)


def check_targets(df: DataFrame, query: str = "query", intent: str = "intent", output: str = "output", tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """Adds ``errors`` and ``warnings`` (arrays of code and path), ``valid``, ``quarantined`` and ``input_key``.

    ``input_key`` is the SHA-256 of the canonical JSON of query and intent; null without a query.
    """
    q, hint = stripped(F.coalesce(F.col(query), F.lit(""))), F.col(intent)
    raw = F.coalesce(F.col(output), F.array().cast("array<array<string>>"))
    entries = F.transform(raw, lambda e, i: F.struct(i.alias("i"), e.alias("e"), (F.coalesce(F.size(e), F.lit(-1)) == 2).alias("pair")))
    known = lambda x: x["pair"] & F.coalesce(F.get(x["e"], F.lit(0)).isin(*KINDS), F.lit(False))
    said = lambda x: known(x) & (stripped(F.coalesce(F.get(x["e"], F.lit(1)), F.lit(""))) != "")
    made = F.transform(F.filter(entries, said), lambda x: F.struct(x["i"].alias("i"), F.get(x["e"], F.lit(0)).alias("kind"), F.get(x["e"], F.lit(1)).alias("raw"), stripped(F.get(x["e"], F.lit(1))).alias("text")))
    base = df.withColumn("__e", entries).withColumn("__i", made)
    sized = F.transform("__i", lambda x: F.struct(x["i"].alias("i"), x["kind"].alias("kind"), x["raw"].alias("raw"), x["text"].alias("text"), compared(x["text"]).alias("cmp"), tokens(x["text"]).alias("n")))
    base = base.withColumn("__i", sized)
    items, quarantined = F.col("__i"), F.lower(q).rlike(ONLY_MODE)
    number = {k: F.size(F.filter(items, _sized(k, 0, 1 << 30))) for k in KINDS}
    empty = F.size(raw) == 0
    positive = lambda t: F.exists(F.regexp_extract_all(t, F.lit(r'-?"[^"]*"|\S+'), F.lit(0)), lambda w: ~w.startswith("-") & w.rlike(r"[\p{L}\p{N}_]"))
    odd = lambda t: F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
    repeated = lambda x: F.exists(items, lambda y: (y["i"] < x["i"]) & (y["kind"] == x["kind"]) & (y["cmp"] == x["cmp"]))
    errors = [
        _code(q == "", "TRAIN_EMPTY_QUERY", "query"),
        _code((q != "") & F.col(query).rlike(r"[\r\n]"), "TRAIN_MULTILINE_QUERY", "query"),
        _code(hint.isNotNull() & (stripped(hint) == ""), "TRAIN_EMPTY_INTENT", "intent"),
        _code(hint.isNotNull() & (stripped(hint) != "") & hint.rlike(r"[\r\n]"), "TRAIN_MULTILINE_INTENT", "intent"),
        _code(quarantined, "TRAIN_ONLY_MODE", "query"),
        _code(empty, "TRAIN_EMPTY_OUTPUT", "output"),
        _each(F.col("__e"), lambda x: ~x["pair"], "TRAIN_INVALID_OUTPUT_PAIR", ""),
        _each(F.col("__e"), lambda x: x["pair"] & ~known(x), "TRAIN_INVALID_OUTPUT_TYPE", "[0]"),
        _each(F.col("__e"), lambda x: known(x) & ~said(x), "TRAIN_EMPTY_OUTPUT_TEXT"),
        _each(items, lambda x: x["raw"].rlike(r"[\r\n]"), "TRAIN_MULTILINE_OUTPUT"),
        _each(items, lambda x: x["raw"].rlike(r"[\p{Cc}&&[^\r\n]]"), "TRAIN_CONTROL_CHARACTER"),
        _each(items, lambda x: x["raw"].rlike("|".join(t.replace("|", r"\|") for t in CHAT_TOKENS)), "TRAIN_CHAT_TEMPLATE_LEAK"),
        _each(items, repeated, "TRAIN_DUPLICATE_OUTPUT", ""),
        _each(items, lambda x: (x["kind"] == "lex") & (odd(x["text"]) % 2 == 1), "TRAIN_LEX_UNMATCHED_QUOTE"),
        _each(items, lambda x: (x["kind"] == "lex") & (odd(x["text"]) % 2 == 0) & ~positive(x["text"]), "TRAIN_LEX_NO_POSITIVE_TERM"),
    ]
    for kind in ("lex", "vec"):
        errors.append(_code(~quarantined & (number[kind] == 0), f"TRAIN_MISSING_{kind.upper()}", "output"))
    for kind, most in MOST.items():
        errors.append(_code(~quarantined & (number[kind] > most), f"TRAIN_TOO_MANY_{kind.upper()}", "output"))
    warnings = [
        _each(items, lambda x: (x["kind"] == "lex") & (x["n"] > LEX_LENGTH), "WARN_LEX_TOO_LONG"),
        _each(items, lambda x: x["cmp"].contains(TEMPLATE), "WARN_TEMPLATE_FINGERPRINT"),
        _each(items, lambda x: x["cmp"].rlike(TIME_SENSITIVE), "WARN_TIME_SENSITIVE"),
    ]
    for kind, (low, high, severity) in LENGTHS.items():
        warnings.append(_each(items, _sized(kind, 0, low), f"WARN_{kind.upper()}_TOO_SHORT"))
        warnings.append(_each(items, _sized(kind, high + 1, 1 << 30), f"{severity}_{kind.upper()}_TOO_LONG"))
    value = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")
    key = F.concat(F.lit('{"intent":'), F.when(hint.isNull(), "null").otherwise(value(stripped(F.coalesce(hint, F.lit(""))))), F.lit(',"query":'), value(q), F.lit("}"))
    out = base.withColumn("errors", F.concat(*errors)).withColumn("warnings", F.concat(*warnings))
    return out.withColumn("valid", F.size("errors") == 0).withColumn("quarantined", quarantined).withColumn("input_key", F.when(q != "", F.sha2(key, 256))).drop("__e", "__i")
