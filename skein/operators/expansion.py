"""Typed sub-queries: grammars, parsers and routing of query expansions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lexical import check_lexical, check_semantic

KINDS = ("lex", "vec", "hyde")
#: A first score and a lead that make expansion needless.
STRONG_SCORE, STRONG_GAP = 0.85, 0.15


@dataclass(frozen=True)
class SubQuery:
    kind: str
    text: str
    line: int = 0


def parse_document(text: str) -> tuple[list[SubQuery], str | None] | None:
    """Sub-queries and intent of a query document; null if it is one plain query to be expanded.

    Lines are ``lex:``, ``vec:``, ``hyde:``, at most one ``intent:``, or a single ``expand:`` or plain line alone.
    """
    lines = [(i, x.strip()) for i, x in enumerate(text.splitlines(), 1) if x.strip()]
    typed, plain, intent = [], [], None
    for i, line in lines:
        m = re.match(r"(lex|vec|hyde|intent|expand):\s*(.*)", line, re.I | re.S)
        if not m:
            plain.append((i, line))
            continue
        kind, body = m[1].lower(), m[2].strip()
        if not body:
            raise ValueError(f"line {i}: {kind} needs text")
        if kind == "intent":
            if intent is not None:
                raise ValueError(f"line {i}: only one intent is allowed")
            intent = body
        elif kind == "expand":
            if len(lines) > 1:
                raise ValueError(f"line {i}: expand must stand alone")
            return None
        else:
            typed.append(SubQuery(kind, body, i))
    if plain and (typed or intent or len(plain) > 1):
        raise ValueError(f"line {plain[0][0]}: plain lines do not mix with typed ones")
    if plain or not lines:
        return None
    if not typed:
        raise ValueError("an intent needs a query")
    for q in typed:
        if bad := check_lexical(q.text) if q.kind == "lex" else check_semantic(q.text):
            raise ValueError(f"line {q.line}: {bad}")
    return typed, intent


def parsed_lines(raw: Column) -> Column:
    """Array of (line, kind, text, problem) of generated output ``kind: text``. ``problem`` is
    ``invalid_line`` (no kind, or layout around it), ``empty_text``, or null."""
    lines = F.transform(F.split(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), "\n"), lambda x: F.regexp_replace(x, "\r$", ""))

    def one(x: Column, i: Column) -> Column:
        at = F.instr(x, ":")
        kind = F.trim(F.substring(x, F.lit(1), at - 1))
        text = F.regexp_replace(F.substring(x, at + 1, F.length(x)), r"^\s+|\s+$", "")
        known = (at > 0) & kind.isin(*KINDS)
        problem = F.when(~known, "invalid_line").when(text == "", "empty_text").when(~x.rlike(r"^(lex|vec|hyde): \S"), "invalid_line")
        return F.struct((i + 1).alias("line"), F.when(known, kind).alias("kind"), F.when(known & (text != ""), text).alias("text"), problem.alias("problem"))

    return F.when(F.coalesce(raw, F.lit("")).rlike(r"\S"), F.transform(lines, one)).otherwise(F.array().cast("array<struct<line:int,kind:string,text:string,problem:string>>"))


def usable(lines: Column) -> Column:
    """(kind, text) of the lines that can be searched."""
    return F.transform(F.filter(lines, lambda x: x["text"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text")))


def with_fallback(output: Column, query: Column) -> Column:
    """The output, or three fallback lines if it is empty."""
    one = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    spare = F.array(one("hyde", F.concat(F.lit("Information about "), query)), one("lex", query), one("vec", query))
    return F.when(F.size(output) == 0, spare).otherwise(output)


def strict_output(lines: Column) -> Column:
    """The output if it is exactly one ``hyde`` first and then one or two ``vec`` without any problem; else empty."""
    kinds = F.transform(lines, lambda x: F.coalesce(x["kind"], F.lit("?")))
    fine = ~F.exists(lines, lambda x: x["problem"].isNotNull()) & F.array_join(kinds, ",").rlike("^hyde,vec(,vec)?$")
    return F.when(fine, usable(lines)).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))


def artifact_status(lines: Column, error: Column) -> Column:
    """``generation_error`` if generation failed, ``format_error`` if any line has a problem or there is none, else ``ok``."""
    return F.when(error.isNotNull(), "generation_error").when((F.size(lines) == 0) | F.exists(lines, lambda x: x["problem"].isNotNull()), "format_error").otherwise("ok")


def distinct_subqueries(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows ``kind, text`` without exact repeats and without copies of ``query``; the first of equals stays."""
    first = rows.where(F.trim("text") != F.trim("query")).withColumn("n", F.row_number().over(W.partitionBy(*keys, "kind", "text").orderBy(order)))
    return first.where("n = 1").drop("n")


def strong_signal(matches: DataFrame) -> DataFrame:
    """``qid, strong``: whether the best lexical match is so good and so far ahead that expansion is needless."""
    ranked = matches.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc"))).where("n <= 2")
    two = ranked.groupBy("qid").agg(F.max(F.when(F.col("n") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("b"))
    return two.select("qid", ((F.col("a") >= STRONG_SCORE) & (F.col("a") - F.coalesce("b", F.lit(0.0)) >= STRONG_GAP)).alias("strong"))


def normal_output(output: Column) -> Column:
    """Entries with a known kind and a text, trimmed, ordered hyde, lex, vec, as ``kind: text`` lines."""
    pair = F.transform(output, lambda e: F.struct(F.lower(F.trim(F.get(e, F.lit(0)))).alias("kind"), F.trim(F.get(e, F.lit(1))).alias("text")))
    kept = F.filter(pair, lambda e: e["kind"].isin(*KINDS) & (F.coalesce(e["text"], F.lit("")) != ""))
    placed = F.array_sort(F.transform(kept, lambda e, i: F.struct(e["kind"].alias("kind"), i.alias("i"), e["text"].alias("text"))))
    return F.array_join(F.transform(placed, lambda e: F.concat(e["kind"], F.lit(": "), e["text"])), "\n")
