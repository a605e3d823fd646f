"""Curation of query sets: near-duplicates, families, splits, leakage, selection, audits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import gram_set, jaccard, normal_query, word_set
from ..session import BROADCAST_BYTES, broadcast_if_small, materialize, plan_bytes
from . import setjoin

#: Similarities of near-duplicate queries by words and by character trigrams.
WORDS, GRAMS = 0.8, 0.85
#: Shares of the splits.
SHARES = (("train", 0.7), ("dev", 0.15), ("test", 0.15))
#: Edges of a graph whose components one task finds; larger ones are solved in rounds.
TASK_EDGES = 500_000


def near_pairs(left: DataFrame, right: DataFrame | None = None, words: float = WORDS, grams: float = GRAMS) -> DataFrame:
    """``a, b, by_words, by_grams`` of distinct texts (``id, text``) similar by words or by trigrams; without
    ``right`` within ``left`` (``a < b``). Exact: nothing is hashed away (:mod:`skein.operators.setjoin`). Tables without ``id`` have the text for it."""
    left, right = (df if df is None else df.where("text is not null").select(*[F.col(c).alias("key") for c in df.columns if c == "id"], "text") for df in (left, right))
    found = setjoin.candidates(left, right, words, grams)
    ends = (F.col("a"), F.col("b")) if right is not None else (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    similar = lambda of: jaccard(of(F.col("ta")), of(F.col("tb")))
    scored = found.select(*ends, similar(word_set).alias("by_words"), similar(gram_set).alias("by_grams"))
    return scored.where((F.col("by_words") >= words) | (F.col("by_grams") >= grams)).distinct()


def distinct_queries(df: DataFrame, query: str) -> DataFrame:
    """``id, text``: distinct normalised queries; the id is the text itself."""
    text = normal_query(F.col(query))
    return df.select(text.alias("id"), text.alias("text")).where("text <> ''").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, root`` of the nodes of ``a, b``: connected components named by their smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need few rounds and keep no
    neighbourhood on one task: each is a minimum per node and a join. Stops when nothing changes. At most ``TASK_EDGES``
    edges are merged in one task instead.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if plan_bytes(now) <= BROADCAST_BYTES and now.count() <= TASK_EDGES:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInPandas(_roots, f"node {kind}, root {kind}")
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.where("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.where("u <> v").join(low2, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(after, "cc")
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _roots(batches):
    """``node, root`` of the edges ``u, v`` of all batches: the smallest node of each component."""
    import numpy as np
    import pandas as pd

    edges = pd.concat(list(batches) or [pd.DataFrame({"u": [], "v": []})])
    nodes, code = np.unique(np.concatenate([edges["u"].to_numpy(object), edges["v"].to_numpy(object)]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in code.reshape(2, -1).T.tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    if len(nodes):
        yield pd.DataFrame({"node": nodes, "root": nodes[[root(i) for i in range(len(nodes))]]})


def query_families(queries: DataFrame, judged: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """``id, query, family``: one row per id, with the smallest query of its family.

    Queries belong together if their normalised texts are equal or nearly so or if they share a judged document
    or documents of equal content, directly or through others. queries: ``id, text``; a query without a text is
    a family of its own unless a document joins it. judged: ``id, doc``; contents: ``doc, hash``.
    """
    text = F.coalesce(normal_query(F.col("text")), F.lit(""))
    # a key behind all texts stands for a query without one
    node = F.when(text != "", text).otherwise(F.concat(F.lit("\U0010ffff"), F.col("id").cast("string")))
    own = materialize(queries.where("id is not null").select("id", node.alias("node"), (text != "").alias("has")).distinct(), "families")
    docs = judged.where("id is not null and doc is not null").select("id", F.col("doc").cast("string").alias("doc")).distinct()
    if contents is not None:
        same = contents.where("doc is not null and hash is not null").select(F.col("doc").cast("string").alias("doc"), F.concat(F.lit("\u0000"), "hash").alias("link"))
        docs = docs.join(same.groupBy("doc").agg(F.min("link").alias("link")), "doc", "left").select("id", F.coalesce("link", "doc").alias("doc"))
    by_doc = materialize(own.join(broadcast_if_small(materialize(docs, "families")), "id").select("doc", "node").distinct(), "families")
    # ids with several texts are few as a rule: only these are joined and summed up
    several = broadcast_if_small(materialize(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "families"))
    edges = near_pairs(own.where("has").select(F.col("node").alias("text")).distinct()).select("a", "b")
    for rows, key in ((by_doc, "doc"), (own.join(several, "id").select("id", "node"), "id")):
        least = rows.groupBy(key).agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        edges = edges.union(rows.join(least, key).where("node <> a").select("a", F.col("node").alias("b")))
    roots = broadcast_if_small(materialize(components(edges), "families"))
    found = own.join(roots, "node", "left").select("id", F.when(F.col("has"), F.col("node")).alias("query"), F.coalesce("root", "node").alias("family"))
    merged = found.join(several, "id", "left_semi").groupBy("id").agg(F.min("query").alias("query"), F.min("family").alias("family"))
    return found.join(several, "id", "left_anti").unionByName(merged)


def _deal(sizes: list[tuple[int, int]], shares: tuple) -> list[tuple[int, int, int, list[str]]]:
    """``size, first, last, splits`` of the ranks among families of one size that go to the splits in turn.

    sizes: (size, families), largest first. Each family goes to the split that lacks most rows, the first of equal
    ones; among equal sizes the splits within one size of the lack of the first take turns until another one lacks as much.
    """
    total = sum(s * n for s, n in sizes)
    lack = [Fraction(str(share)) * total for _, share in shares]
    out = []
    for size, n in sizes:
        rank = 0
        while rank < n:
            order = sorted(range(len(shares)), key=lambda i: (-lack[i], i))
            turn = [i for i in order if lack[i] > lack[order[0]] - size]
            rest = order[len(turn) :]
            rounds = (lack[order[0]] - lack[rest[0]]) // size if rest else n
            last = min(n, rank + int(rounds) * len(turn))
            out.append((size, rank, last, [shares[i][0] for i in turn]))
            for k, i in enumerate(turn):
                lack[i] -= size * len(range(rank + k, last, len(turn)))
            rank = last
    return out


def split_families(families: DataFrame, seed: str = "0", shares: tuple = SHARES) -> DataFrame:
    """``family, size, split``: whole families, largest first and then in the order of a seeded hash, each to the split
    that lacks most rows. families: ``family, size``. Equal sizes are dealt in bulk: the driver holds one row per distinct
    size, of which ``n`` rows have at most ``sqrt(2 n)``."""
    kept = materialize(families.where("size > 0"), "split")
    # the digest is cheaper to take twice than to keep
    keyed = kept.withColumn("h", F.unhex(hash_order(F.col("family"), seed))).withColumn("p", F.substring("h", 1, 2))
    sizes = [(r["size"], r["n"]) for r in kept.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()]
    turns = families.sparkSession.createDataFrame(_deal(sizes, shares), "size long, first long, last long, splits array<string>")
    # ranks in two levels, so that no window holds all families of a size
    parts = keyed.groupBy("size", "p").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("size", "p", (F.sum("n").over(W.partitionBy("size").orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy("size", "p").orderBy("h", "family")) - 1).join(before, ["size", "p"]).withColumn("rank", F.col("r") + F.col("before"))
    dealt = ranked.join(F.broadcast(turns), "size").where("rank >= first and rank < last")
    return dealt.select("family", "size", F.expr("splits[cast((rank - first) % size(splits) as int)]").alias("split"))


def resolve_collisions(rows: DataFrame, text: str, split: str, order: tuple = ("test", "dev", "train")) -> DataFrame:
    """Rows whose split is the first in ``order`` of all splits that have the same text."""
    rank = F.coalesce(*[F.when(F.col(split) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    best = rows.groupBy(text).agg(F.min(rank).alias("__best"))
    return rows.withColumn("__rank", rank).join(best, text).where("__rank = __best").drop("__rank", "__best")


def hash_order(id_: Column, seed: str, prefix: str = "") -> Column:
    """Seeded digest that orders a sample."""
    return F.sha2(F.concat_ws("\u0000", F.lit(prefix), F.lit(seed), id_.cast("string")), 256)


def top_by_hash(rows: DataFrame, id_col: str, seed: str, counts: dict | int, by: str | None = None) -> DataFrame:
    """A deterministic sample: the rows with the smallest digests, ``counts`` in all or per value of ``by``."""
    h = rows.withColumn("__h", hash_order(F.col(id_col), seed))
    if by is None:
        return h.orderBy("__h", id_col).limit(counts).drop("__h")
    ranked = h.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy("__h", id_col)))
    return ranked.where(F.col("__n") <= counts).drop("__h", "__n")


def largest_remainder(strata: DataFrame, total: int, size: str = "n") -> DataFrame:
    """Adds ``quota``: whole numbers in proportion to ``size`` that sum to ``total`` (at most each size).

    strata: few rows, one per stratum; ties go to the smaller stratum name.
    """
    names = [c for c in strata.columns if c != size]
    share = F.col(size) * F.lit(float(total)) / F.sum(size).over(W.partitionBy())
    base = strata.withColumn("__s", share).withColumn("__f", F.floor("__s"))
    left = F.lit(total) - F.sum("__f").over(W.partitionBy())
    ranked = base.withColumn("__left", left).withColumn("__n", F.row_number().over(W.orderBy(F.desc(F.round(F.col("__s") - F.col("__f"), 12)), *names)))
    return ranked.withColumn("quota", F.least(F.col(size), F.col("__f") + F.when(F.col("__n") <= F.col("__left"), 1).otherwise(0)).cast("long")).drop("__s", "__f", "__left", "__n")


def stratified(rows: DataFrame, strata: list[str], total: int, order: list[str]) -> DataFrame:
    """Selection of ``total`` rows with largest-remainder quotas per stratum, first by ``order``."""
    quota = largest_remainder(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), total).select(*strata, "quota")
    ranked = rows.withColumn("__n", F.row_number().over(W.partitionBy(*strata).orderBy(*order)))
    return ranked.join(quota, strata).where(F.col("__n") <= F.col("quota")).drop("__n", "quota")


def balanced_pool(rows: DataFrame, source: str, id_col: str, seed: str) -> DataFrame:
    """All rows of the smallest source and equally many of each other one, by hash."""
    least = rows.groupBy(source).count().agg(F.min("count")).first()[0] or 0
    return top_by_hash(rows, id_col, seed, least, source)


def main_pool(rows: DataFrame, text: str, source: str, key: str, tie: str, quota: int) -> DataFrame:
    """One row per normalised text (smallest ``key``), then at most ``quota`` per source by ``key, tie``."""
    norm = rows.withColumn("__t", normal_query(F.col(text)))
    one = norm.withColumn("__n", F.row_number().over(W.partitionBy("__t").orderBy(key, tie))).where("__n = 1").drop("__n", "__t")
    return one.withColumn("__n", F.row_number().over(W.partitionBy(source).orderBy(key, tie))).where(F.col("__n") <= quota).drop("__n")


def conflict_ledger(rows: DataFrame, key: str, raw: Column, canonical: Column) -> DataFrame:
    """``key, rows, variants, state``: how the answers of equal inputs relate: ``unique``, ``identical``,
    ``format_only`` (equal in canonical form), ``conflict``, ``invalid`` (none usable)."""
    by = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(raw).alias("raws"), F.count_distinct(canonical).alias("variants"))
    state = F.when(F.col("variants") == 0, "invalid").when(F.col("rows") == 1, "unique").when(F.col("raws") == 1, "identical").when(F.col("variants") == 1, "format_only").otherwise("conflict")
    return by.select(key, "rows", "variants", state.alias("state"))


def length_stats(rows: DataFrame, n: Column, by: list[str] = ()) -> DataFrame:
    """Count, extremes, sum and the values at floor index ``int(n * f)`` of the sorted lengths, from a histogram of lengths."""
    hist = rows.where(n.isNotNull()).groupBy(*by, n.alias("len")).agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(*by).orderBy("len")
    part = W.partitionBy(*by)
    at = hist.withColumn("end", F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(part))
    pick = [F.min(F.when(F.col("end") > F.floor(F.col("all") * f), F.col("len"))).alias(name) for f, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return at.groupBy(*by).agg(F.sum("k").alias("count"), F.min("len").alias("min"), F.max("len").alias("max"), F.sum(F.col("len") * F.col("k")).alias("sum"), *pick)


def usage_map(rows: DataFrame, text: str, label: str) -> DataFrame:
    """``text, labels``: every label under which a normalised text occurs."""
    t = normal_query(F.col(text))
    return rows.select(t.alias("text"), F.col(label).alias("label")).where("text <> '' and label is not null").groupBy("text").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def exact_overlap(train: DataFrame, evals: DataFrame, text: str) -> DataFrame:
    """Training rows whose normalised text some evaluation row has."""
    bad = evals.select(normal_query(F.col(text)).alias("__t")).where("__t <> ''").distinct()
    return train.withColumn("__t", normal_query(F.col(text))).join(bad, "__t", "left_semi").drop("__t")


def binary_judgements(qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """Distinct judged pairs of at least the threshold."""
    return qrels.where((F.col("score") >= threshold) & F.col("query_id").isNotNull() & F.col("corpus_id").isNotNull()).select("split", "source_id", "query_id", "corpus_id").distinct()


def judgement_audit(qrels: DataFrame) -> DataFrame:
    """``check, rows``: repeated judgements, contradicting ones, null ids, queries without a relevant document."""
    pair = qrels.groupBy("split", "source_id", "query_id", "corpus_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("score").alias("s"))
    q = qrels.where("query_id is not null").groupBy("split", "source_id", "query_id").agg(F.max("score").alias("best"))
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("rows"))
    return (
        one("repeated", pair.where("n > 1"))
        .unionByName(one("contradicting", pair.where("s > 1")))
        .unionByName(one("null_id", qrels.where("query_id is null or corpus_id is null")))
        .unionByName(one("without_relevant", q.where("coalesce(best, 0) < 1")))
    )


#: Patterns of negation.
NEGATION = r"\b(?:no|not|without|lack(?:s|ed|ing)?|neither|nor|fail(?:s|ed|ing)?\s+to|unable\s+to)\b"


def lost_negation(query: Column, expansion: Column) -> Column:
    """Whether the query negates and the expansion does not."""
    return F.lower(query).rlike(NEGATION) & ~F.lower(F.coalesce(expansion, F.lit(""))).rlike(NEGATION)


def only_directive(query: Column) -> Column:
    """Whether a query carries a directive that limits the answer to one kind."""
    return F.lower(query).rlike(r"(^|\s)/only:(lex|vec|hyde)\b")


def select_candidates(rows: DataFrame, group: str, metrics: list[str], baseline: str, tie: str) -> DataFrame:
    """The best row of each group by the metrics in order, if it beats the baseline in the first; ties by ``tie``."""
    best = rows.groupBy(group).agg(F.max_by(F.struct(*rows.columns), F.struct(*metrics, F.col(tie))).alias("r")).select("r.*")
    return best.where(F.col(metrics[0]) > F.col(baseline))


def golden_scores(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, hits, said, wanted`` of entries ``id, side ('said' or 'golden'), text``: a said entry hits if some golden
    one is similar by words."""
    s = pairs.where("side = 'said'").select("id", F.col("text").alias("s"))
    g = pairs.where("side = 'golden'").select("id", F.col("text").alias("g"))
    best = s.join(g, "id", "left").groupBy("id", "s").agg(F.max(F.when(F.col("g").isNotNull(), jaccard(word_set(F.col("s")), word_set(F.col("g")))).otherwise(0.0)).alias("j"))
    hits = best.groupBy("id").agg(F.sum((F.col("j") >= least).cast("long")).alias("hits"), F.count(F.lit(1)).alias("said"))
    return hits.join(g.groupBy("id").agg(F.count(F.lit(1)).alias("wanted")), "id", "full").fillna(0)


def render_document(heading: Column, body: Column, fenced: Column) -> Column:
    """A heading (if it is not blank), then the body with line feeds only, in a fence longer than any run of backticks in it where
    ``fenced``; a line feed ends it."""
    text = F.regexp_replace(body, "\r\n?", "\n")
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    top = F.when(F.trim(heading) != "", F.concat(F.lit("# "), heading, F.lit("\n\n"))).otherwise("")
    return F.concat(top, F.when(fenced, F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)).otherwise(text), F.lit("\n"))


#: Words that make a query temporal, comparing or personal.
TEMPORAL = ["latest", "recent", "new", "update", "changelog", "changed", "version", "release", "news", "2024", "2025"]
COMPARING = ["difference", "vs", "versus", "compare"]
PERSONAL = ["meeting", "notes", "journal", "ideas", "thoughts"]


def query_category(query: Column) -> Column:
    """The first category that fits: few words, a capital at a word's start, words of time, how, what, comparison, personal notes."""
    low, one = F.lower(query), lambda words: "|".join(words)
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return (
        F.when(words <= 2, "short_keyword")
        .when(query.rlike(r"(?:^|\s)\p{Lu}"), "named_entity")
        .when(low.rlike(one(TEMPORAL)), "temporal")
        .when(low.startswith("how "), "how_to")
        .when(low.startswith("what "), "what_is")
        .when(low.rlike(one(COMPARING)), "comparison")
        .when(low.rlike(one(PERSONAL)), "personal")
        .otherwise("other")
    )


def select_families(families: DataFrame, target: int, seed: str) -> DataFrame:
    """Whole families up to a size: unused ones first, then by seeded hash, as long as one more moves nearer to ``target``.

    families: ``family, size, used``. The running size is summed over hash ranges first, so no window holds all.
    """
    keyed = families.withColumn("h", hash_order(F.col("family"), seed)).withColumn("p", F.concat(F.when(F.col("used"), "1").otherwise("0"), F.substring("h", 1, 3)))
    total = keyed.groupBy("p").agg(F.sum("size").alias("s"))
    before = total.withColumn("before", F.sum("s").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).drop("s")
    run = F.sum("size").over(W.partitionBy("p").orderBy("h", "family").rowsBetween(W.unboundedPreceding, 0))
    at = keyed.withColumn("r", run).join(F.broadcast(before), "p").withColumn("upto", F.col("r") + F.col("before"))
    nearer = F.abs(F.col("upto") - target) < F.abs(F.col("upto") - F.col("size") - target)
    return at.where(nearer).select("family", "size", "used")
