"""Looking up documents, bodies and snippets; contexts; result formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import SCHEME, glob_regex, is_docid, normal_docid, virtual_path
from ..functions.text import INTENT_STOP_WORDS, csv_field, xml_text
from ..session import BROADCAST_ROWS, broadcast_rows, materialize

#: Body size limit of multi-document reads, snippet width, padding and weight of intent terms.
MAX_READ, SNIPPET, PADDING, INTENT_WEIGHT, CHUNK = 64 * 1024, 500, 100, 0.3, 3600


def resolve_refs(refs: DataFrame, documents: DataFrame, scheme: str = SCHEME) -> DataFrame:
    """``ref, tier, found, doc``: each reference's document at its best tier (1 docid, 2 virtual path,
    3 collection/path, 4 path, 5 path suffix at a slash); ``found`` counts the documents at that tier,
    more than one is an ambiguity.

    refs: ``ref``; documents: ``doc, collection, path, hash``. Each tier is an equi-join: suffixes are
    listed from the paths, docids by their prefix.
    """
    r = refs.select("ref", F.regexp_replace(F.trim("ref"), r":\d+(:\d+)?$", "").alias("bare")).distinct()
    d = documents.select("doc", "collection", "path", "hash")
    docids = r.where(is_docid(F.col("bare"))).select("ref", F.lower(normal_docid(F.col("bare"))).alias("want")).withColumn("short", F.substring("want", 1, 6))
    by_id = docids.join(d.withColumn("short", F.substring("hash", 1, 6)), "short").where(F.col("hash").startswith(F.col("want")))
    keyed = d.select("doc", F.explode(F.array(F.struct(F.lit(2).alias("tier"), virtual_path(F.col("collection"), F.col("path"), scheme).alias("k")), F.struct(F.lit(3).alias("tier"), F.concat("collection", F.lit("/"), "path").alias("k")), F.struct(F.lit(4).alias("tier"), F.col("path").alias("k")))).alias("x")).select("doc", "x.tier", "x.k")
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    suffixes = d.where(F.size(parts) > 1).select("doc", F.lit(5).alias("tier"), F.explode(ends).alias("k"))
    exact = r.withColumnRenamed("bare", "k").join(keyed.unionByName(suffixes), "k").select("ref", "tier", "doc")
    every = by_id.select("ref", F.lit(1).alias("tier"), "doc").unionByName(exact)
    best = every.withColumn("best", F.min("tier").over(W.partitionBy("ref"))).where("tier = best")
    return best.groupBy("ref", "tier").agg(F.count_distinct("doc").alias("found"), F.min("doc").alias("doc"))


def _edit_keys(most: int):
    """Keys that two texts within ``most`` edits share: trigrams of long ones (an edit breaks three at most), what up to ``most`` left
    out letters leave of short ones."""
    short = 3 * most + 3

    def left(t: str) -> set[str]:
        found = layer = {t}
        for _ in range(most):
            layer = {x[:i] + x[i + 1 :] for x in layer for i in range(len(x))}
            found = found | layer
        return found

    @F.pandas_udf("array<string>")
    def keys(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            k = {"g" + t[i : i + 3] for i in range(len(t) - 2)} if len(t) >= short - most else set()
            out.append(sorted(k | {"d" + x for x in left(t)} if len(t) <= short + most else k))
        return pd.Series(out)

    return keys


def similar_paths(refs: DataFrame, documents: DataFrame, most: int = 3, limit: int = 5) -> DataFrame:
    """``ref, path, distance``: the nearest active paths of each reference by edit distance, at most ``most``.

    Up to ``BROADCAST_ROWS`` references (a handful, as a rule) go to every task; more meet the paths by keys that
    near texts share.
    """
    paths = documents.select("path").where("path is not null").distinct()
    refs = materialize(refs.select("ref").where("ref is not null").distinct(), "refs")
    size = F.abs(F.length("ref") - F.length("path")) <= most
    if (n := refs.count()) <= BROADCAST_ROWS:
        near = paths.join(broadcast_rows(refs, n), size)
    else:
        keys = _edit_keys(most)
        a = refs.select("ref", F.explode(keys(F.lower("ref"))).alias("k"))
        b = paths.select("path", F.explode(keys(F.lower("path"))).alias("k"))
        near = a.join(b, "k").where(size).select("ref", "path").distinct()
    d = F.levenshtein(F.lower("ref"), F.lower("path"), most)
    scored = near.withColumn("distance", d).where("distance >= 0")
    return scored.withColumn("n", F.row_number().over(W.partitionBy("ref").orderBy("distance", "path"))).where(F.col("n") <= limit).select("ref", "path", "distance")


def match_glob(documents: DataFrame, pattern: str, scheme: str = SCHEME) -> DataFrame:
    """Documents whose virtual path, path or collection/path matches the glob."""
    rx = glob_regex(pattern)
    c, p = F.col("collection"), F.col("path")
    return documents.where(virtual_path(c, p, scheme).rlike(rx) | p.rlike(rx) | F.concat(c, F.lit("/"), p).rlike(rx))


def read_many(documents: DataFrame, limit: int = MAX_READ) -> DataFrame:
    """Adds ``skipped`` (the reason) and empties ``body`` of documents over ``limit`` bytes."""
    size = F.octet_length("body")
    reason = F.when(size > limit, F.concat(F.lit("file too large ("), F.round(size / 1024).cast("int").cast("string"), F.lit("KB > "), F.lit(str(round(limit / 1024))), F.lit("KB)")))
    return documents.withColumn("skipped", reason).withColumn("body", F.when(reason.isNull(), F.col("body")))


def body_lines(body: Column, start: int | None = None, count: int | None = None, numbered: bool = False) -> Column:
    """Lines ``start`` (from 1) on, at most ``count`` of them, with line numbers if asked."""
    lines = F.split(body, "\n")
    first = max(1, start or 1)
    cut = F.slice(lines, F.lit(first), F.lit(count) if count is not None else F.greatest(F.size(lines), F.lit(1)))
    if numbered:
        cut = F.transform(cut, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x))
    return F.array_join(cut, "\n")


def snippet(body: str, query: str, width: int = SNIPPET, at: int | None = None, length: int | None = None, intent: str = "") -> tuple[int, str, int, int, int]:
    """(line, snippet with header, lines before, lines after, lines shown) around the best line.

    A line scores one for each query term in it and ``INTENT_WEIGHT`` for each intent term; the first
    best line wins. With ``at`` only the passage there, padded, is searched; without any hit the
    snippet starts at the passage (at 0: the whole body is searched instead).
    """
    terms = query.lower().split()
    hints = [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x) for x in intent.lower().split()) if len(w) > 1 and w not in INTENT_STOP_WORDS]
    low = 0 if at is None or at < 0 else max(0, at - PADDING)
    high = len(body) if at is None or at < 0 else min(len(body), at + (length or CHUNK) + PADDING)
    region = body[low:high]
    lines = region.split("\n")
    lowered = [x.lower() for x in lines]
    scores = [sum(t in x for t in terms) + INTENT_WEIGHT * sum(h in x for h in hints) for x in lowered]
    best = max(range(len(lines)), key=lambda i: (scores[i], -i))
    if at is not None and at >= 0 and scores[best] <= 0:
        if at == 0:
            return snippet(body, query, width, intent=intent)
        best = region[: at - low].count("\n")
    shown = lines[max(0, best - 1) : best + 3]
    text = "\n".join(shown)
    if at and at > 0 and not text.strip():
        return snippet(body, query, width, intent=intent)
    if len(text) > width:
        text = text[: width - 3] + "..."
    first = body[:low].count("\n") + max(0, best - 1) + 1
    before, after = first - 1, body.count("\n") + 1 - (first + len(shown) - 1)
    return body[:low].count("\n") + best + 1, f"@@ -{first},{len(shown)} @@ ({before} before, {after} after)\n{text}", before, after, len(shown)


def snippets(df: DataFrame, id_col: str, body_col: str, query: str, width: int = SNIPPET, at_col: str | None = None, intent: str = "") -> DataFrame:
    """``id, line, snippet, lines_before, lines_after, lines`` for each body, in Arrow batches."""
    kind = dict(df.dtypes)[id_col]
    cols = df.where(F.col(body_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(body_col).alias("b"), (F.col(at_col) if at_col else F.lit(None).cast("int")).alias("a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *snippet(b, query, width, None if a is None or a != a else int(a), intent=intent)) for i, b, a in zip(pdf["id"], pdf["b"], pdf["a"])]
            yield pd.DataFrame(rows, columns=["id", "line", "snippet", "lines_before", "lines_after", "lines"])

    return cols.mapInPandas(run, f"id {kind}, line int, snippet string, lines_before int, lines_after int, lines int")


def best_line(body: Column, query: str) -> Column:
    """Number (from 1) and score of the best line of a body, in SQL expressions."""
    scored = F.transform(F.split(body, "\n"), lambda x, i: F.struct(sum((F.when(F.lower(x).contains(t), 1).otherwise(0) for t in query.lower().split()), F.lit(0)).alias("score"), (-i).alias("k")))
    return F.array_max(scored)


# ---- contexts ----------------------------------------------------------------------------------


def contexts_of(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """``doc, contexts``: texts of all path prefixes of a document's path, from general to special.

    contexts: ``collection, prefix, text``; a null collection is global. The prefixes are plain string
    prefixes. A document's prefixes are listed only at the lengths that occur among the contexts.
    """
    lens = [r["n"] for r in contexts.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    d = documents.select("doc", "collection", "path")
    lengths = F.array(*[F.lit(n) for n in lens]) if lens else F.array().cast("array<int>")
    listed = d.select("doc", "collection", F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    own = listed.join(contexts.where("collection is not null"), ["collection", "prefix"]).select("doc", F.lit(1).alias("level"), "prefix", "text")
    everywhere = contexts.where("collection is null").select(F.lit(0).alias("level"), "prefix", "text")
    common = listed.join(everywhere, "prefix").select("doc", "level", "prefix", "text")
    both = own.unionByName(common)
    return both.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", F.length("prefix").alias("n"), "prefix", "text"))), lambda x: x["text"]).alias("contexts"))


def nearest_context(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """``doc, text``: the most special context of the document's collection, else the global one."""
    return contexts_of(documents, contexts).select("doc", F.element_at("contexts", -1).alias("text"))


def collection_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``path, collection, relative``: the collection with the longest root above the path."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    met = above.join(roots.select("collection", F.regexp_replace("root", "/+$", "").alias("root")), "root")
    best = met.groupBy("path").agg(F.max_by(F.struct("collection", "root"), F.length("root")).alias("m"))
    return best.select("path", F.col("m.collection").alias("collection"), F.regexp_replace(F.expr("substring(path, length(m.root) + 1)"), "^/", "").alias("relative"))


# ---- result formats ------------------------------------------------------------------------------

CSV_HEADER = "docid,score,file,title,context,line,snippet"


def as_csv(results: DataFrame) -> DataFrame:
    """One CSV ``row`` per result (docid, score, file, title, context, line, snippet)."""
    cols = [F.concat(F.lit("#"), F.col("docid")), F.format_string("%.4f", F.col("score")), "file", "title", "context", "line", "snippet"]
    return results.select("docid", F.concat_ws(",", *[csv_field(F.col(c) if isinstance(c, str) else c) for c in cols]).alias("row"))


def as_files(results: DataFrame) -> DataFrame:
    """``#docid,score,file`` with the context in quotes where there is one."""
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit(',"'), F.replace(F.col("context"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise("")
    return results.select("docid", F.concat(F.lit("#"), "docid", F.lit(","), F.format_string("%.2f", F.col("score")), F.lit(","), "file", context).alias("row"))


def as_xml(results: DataFrame) -> DataFrame:
    attrs = F.concat(F.lit('<file docid="#'), "docid", F.lit('" name="'), xml_text(F.col("file")), F.lit('"'))
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit(' title="'), xml_text(F.col("title")), F.lit('"'))).otherwise("")
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit(' context="'), xml_text(F.col("context")), F.lit('"'))).otherwise("")
    return results.select("docid", F.concat(attrs, title, context, F.lit(">\n"), xml_text(F.col("snippet")), F.lit("\n</file>")).alias("row"))


def as_markdown(results: DataFrame) -> DataFrame:
    head = F.concat(F.lit("---\n# "), F.coalesce("title", "file"), F.lit("\n\n**docid:** `#"), "docid", F.lit("`\n"))
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit("**context:** "), "context", F.lit("\n"))).otherwise("")
    return results.select("docid", F.concat(head, context, F.lit("\n"), "snippet", F.lit("\n")).alias("row"))


def as_json(results: DataFrame) -> DataFrame:
    score = (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score")
    return results.select("docid", F.to_json(F.struct(F.concat(F.lit("#"), "docid").alias("docid"), score, "file", "title", "context", "snippet")).alias("row"))
