"""Subject areas of documents by mined class-association rules (problem 8).

1. Four in five labelled documents with one subject are cut into sentences (in windows of ``WINDOW`` words at most); the words
   whose sentences lean to one subject (``LEAN``) are kept as items.
2. Each sentence becomes one basket per pair of its items, with the subject as a third item, so item sets are
   bounded before they are mined. Spark's parallel FP-growth mines the frequent sets; two words with a subject become
   rules ``words -> subject`` with their confidence, beside those of single words.
3. A rule is redundant if a part of its words has a rule for the same subject that is about as sure,
   and is pruned. Calibration is a logistic map from mined confidence to the confidence in sentences of the fifth of the documents that
   was held out; the log-odds of the calibrated confidence against the subject's share are a rule's evidence. Rules are
   then mined again from all labelled documents, with the map and the threshold that the held-out ones gave.
4. Every document is scored sentence by sentence: the most special rules that match add up their
   evidence, the best subject takes the sentence. A subject counts if it has the share ``share`` of
   the sentences and at least two of them, or is the main matter (``MAIN``) of a short text.
   ``share`` is the value of a small grid that fits the held-out documents best.
   A document without such a subject is ``general``.

The rules are mined from at most ``SAMPLE`` labelled documents (those with the smallest hashes of
their ids), which bounds them and what is broadcast to find them; every document is scored, over its whole text.

Only labels that the table of permitted subjects has are used, so no other can be given out.

Defined cases: texts without letter or digit, null texts and null ids give no row; without labels
every text is ``general``; labels that name unknown documents are ignored; repeated labels count
once; very long texts are scored to the end; front matter, fenced code and headings are no
sentences; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SAMPLE = 20_000
LEAN, SURE, REDUNDANT = 0.4, 0.6, 0.02
LEAST, LEAST_SHARE = 3, 2e-5
MAIN = 0.3
GRID = (0.06, 0.07, 0.08, 0.09, 0.1)
GENERAL = "general"
#: Words of a sentence that items are paired within; one in so many labelled documents calibrates.
WINDOW, HELD_OUT = 64, 5

_WORD = re.compile(r"[a-zß-öø-ÿāœ]+|[一-鿿々]+|[゠-ヿ]+|[^\W\d_a-zß-öø-ÿ一-鿿゠-ヿ぀-ゟ]+")
_SKIP = re.compile(r"^(?:```.*?(?:^```|\Z)|~~~.*?(?:^~~~|\Z)|#[^\n]*$)", re.S | re.M)
_FRONT = re.compile(r"\A\W{0,40}?---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_END = re.compile(r"[\n|]+|(?<=[.!?])[ \t]+|(?<=[。！？])")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    text = text.lower()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "---" in text[:200]:
        text = _FRONT.sub("\n", text, count=1)
    if "```" in text or "~~~" in text or "#" in text:
        text = _SKIP.sub("\n", text)
    find = _WORD.findall
    return [w for w in map(find, _END.split(text)) if w]


class Rules:
    """Matching of sentences. ``single``: word -> (subject, evidence); ``double``: word pair -> the same."""

    def __init__(self, single: dict, double: dict) -> None:
        self.single, self.double = single, double
        self.words = set(single) | {w for p in double for w in p}
        self.partners: dict[str, dict[str, tuple]] = {}
        for (a, b), rule in double.items():
            self.partners.setdefault(a, {})[b] = rule

    def matched(self, words: list[str]) -> list[tuple[tuple[str, ...], tuple[str, float]]]:
        """The most special rules that match: pairs, and words that no pair covers."""
        known = self.words.intersection(words)
        if not known:
            return []
        found, covered = [], set()
        if len(known) > 1:
            for a in known:
                if others := self.partners.get(a):
                    for b in (others.keys() & known) if len(others) < len(known) else (known & others.keys()):
                        found.append(((a, b), others[b]))
                        covered.update((a, b))
        found += [((w,), rule) for w in known - covered if (rule := self.single.get(w))]
        return found

    def sentence(self, words: list[str]) -> str | None:
        votes: dict[str, float] = {}
        for _, (subject, evidence) in sorted(self.matched(words)):
            votes[subject] = votes.get(subject, 0.0) + evidence
        return max(votes.items(), key=lambda v: (v[1], v[0]))[0] if votes else None

    def shares(self, text: str) -> tuple[int, Counter]:
        """Sentences of a text, and those that each subject takes."""
        all_ = sentences(text)
        found = Counter(map(self.sentence, all_))
        found.pop(None, None)
        return len(all_), found


def chosen(n: int, found: Counter, share: float) -> list[str]:
    top = max(found.values(), default=0)
    return sorted(s for s, c in found.items() if c >= 2 and c >= share * n or c == top and c >= MAIN * n) or [GENERAL]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, subjects, held`` of the labelled documents that rules are mined from or (``held``) calibrated on.

    Chosen by ids alone: a hash threshold leaves little more than ``SAMPLE`` of them before they are
    sorted, and only they (a bounded number) meet the texts.
    """
    known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    known = materialize(known.withColumn("u", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))), "p8_known")
    n = known.count()
    few = known.where(F.col("u") < 1.5 * SAMPLE / n) if n > SAMPLE else known
    ids = few.orderBy("u", "doc_id").limit(SAMPLE).select("doc_id", "subjects")
    held = (F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held")
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "subjects", held)


def mine(labelled: DataFrame) -> tuple[dict, dict]:
    """(rules as ``words -> (subject, confidence)``, the subjects' shares of the sentences)."""
    from pyspark.ml.fpm import FPGrowth

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s[0], sorted(set(w[i : i + WINDOW]))) for t, s in zip(pdf["text"], pdf["subjects"]) for w in sentences(t) for i in range(0, len(w), WINDOW)]
            yield pd.DataFrame({"subject": pd.Series([r[0] for r in rows], dtype=object), "words": pd.Series([r[1] for r in rows], dtype=object)})

    single = labelled.where(F.size("subjects") == 1)
    bags = materialize(single.mapInPandas(cut, "subject string, words array<string>"), "p8_bags")
    prior = {r["subject"]: r["n"] for r in bags.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(prior.values())
    if not total:
        return {}, {}
    least = max(LEAST, math.ceil(LEAST_SHARE * total))
    counts = bags.select("subject", F.explode("words").alias("word")).groupBy("word", "subject").count()
    lean = counts.groupBy("word").agg(F.sum("count").alias("n"), F.max("count").alias("most"))
    items = lean.where((F.col("n") >= least) & (F.col("most") >= LEAN * F.col("n"))).select("word")
    numbered = bags.withColumn("id", F.monotonically_increasing_id())
    numbered = materialize(numbered, "p8_bags")
    kept = numbered.select("id", "subject", F.explode("words").alias("word")).join(items, "word").groupBy("id", "subject").agg(F.sort_array(F.collect_set("word")).alias("words"))
    pairs = F.flatten(F.transform("words", lambda a, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda b: F.array(a, b))))
    baskets = kept.select("subject", F.explode(pairs).alias("p")).select(F.concat("p", F.array(F.concat(F.lit("="), "subject"))).alias("items"))
    baskets = materialize(baskets, "p8_baskets")
    n_baskets = baskets.count()
    alone = counts.join(items, "word").groupBy("word").agg(F.max_by(F.struct("subject", "count"), F.struct("count", "subject")).alias("top"), F.sum("count").alias("n"))
    alone = alone.where(F.col("top.count") >= F.greatest(F.lit(least), SURE * F.col("n")))
    rules = alone.select(F.array("word").alias("words"), "top.subject", F.col("top.count").alias("freq"), "n")
    if n_baskets:
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_baskets), minConfidence=SURE).fit(baskets).freqItemsets
        sets = materialize(sets, "p8_sets")
        subject = F.get(F.filter("items", lambda i: i.startswith("=")), F.lit(0))
        words = F.array_sort(F.filter("items", lambda i: ~i.startswith("=")))
        split = sets.select(words.alias("words"), subject.alias("subject"), "freq").where(F.size("words") == 2)
        whole = split.where("subject is null").select("words", F.col("freq").alias("n"))
        double = split.where("subject is not null").join(whole, "words").where(F.col("freq") >= SURE * F.col("n"))
        rules = rules.unionByName(double.select("words", F.substring("subject", 2, 1000).alias("subject"), "freq", "n"))
    mined = {tuple(r["words"]): (r["subject"], (r["freq"] + 1) / (r["n"] + 2)) for r in rules.collect() if r["subject"] != GENERAL}
    singles = {k[0]: v for k, v in mined.items() if len(k) == 1}
    sure = {k: v for k, v in mined.items() if len(k) == 1 or not any((s := singles.get(w)) and s[0] == v[0] and s[1] >= v[1] - REDUNDANT for w in k)}
    return sure, {s: n / total for s, n in prior.items()}


def _logit(c: float) -> float:
    return math.log(c / (1 - c))


def rules_of(sure: dict, base: dict, scale: tuple[float, float] = (0.0, 1.0)) -> Rules:
    """Rules whose evidence is the calibrated log-odds of their confidence against the subject's share."""
    odds = {k: (s, max(0.0, scale[0] + scale[1] * _logit(c) - (_logit(base[s]) if base[s] < 1 else -_logit(c)))) for k, (s, c) in sure.items()}
    return Rules({k[0]: v for k, v in odds.items() if len(k) == 1}, {k: v for k, v in odds.items() if len(k) == 2})


def calibration(held: DataFrame, sure: dict, base: dict, steps: int = 25) -> tuple[float, float]:
    """``(a, b)``: a rule of mined confidence c is right in held-out sentences with log-odds ``a + b logit(c)``, by Newton steps on
    the likelihood with a weak prior at the identity."""
    rules = rules_of(sure, base)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            right: Counter = Counter()
            for t, s in zip(pdf["text"], pdf["subjects"]):
                for w in sentences(t):
                    for k, (subject, _) in rules.matched(w):
                        x = round(_logit(sure[k][1]), 1)
                        seen[x] += 1
                        right[x] += subject == s[0]
            yield pd.DataFrame({"x": pd.Series(list(seen), dtype=float), "n": pd.Series(list(seen.values()), dtype="int64"), "hits": pd.Series([right[k] for k in seen], dtype="int64")})

    rows = held.mapInPandas(judge, "x double, n long, hits long").groupBy("x").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    x, n, hits = (np.array([float(r[c]) for r in rows]) for c in ("x", "n", "hits"))
    design = np.stack([np.ones(len(x)), x], 1)
    w, prior = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (n * p - hits) + (w - prior)
        w = w - np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.eye(2), gradient)
    return float(w[0]), max(0.05, float(w[1]))


def fitted_share(labelled: DataFrame, rules: Rules) -> float:
    """The share of the grid with the best F1 over the held-out documents (about one in ten sentences)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = dict.fromkeys(GRID, 0)
            said = dict.fromkeys(GRID, 0)
            for t, s in zip(pdf["text"], pdf["subjects"]):
                n, found = rules.shares(t)
                for g in GRID:
                    got = chosen(n, found, g)
                    said[g] += len(got)
                    hits[g] += len(set(got) & set(s))
            yield pd.DataFrame({"share": list(GRID), "hits": [hits[g] for g in GRID], "said": [said[g] for g in GRID]})

    found = labelled.mapInPandas(judge, "share double, hits long, said long").groupBy("share").agg(F.sum("hits").alias("hits"), F.sum("said").alias("said")).collect()
    want = labelled.agg(F.sum(F.size("subjects"))).first()[0] or 0
    score = {r["share"]: 2 * r["hits"] / max(1, r["said"] + want) for r in found}
    return max(score, key=lambda g: (round(score[g], 4), -abs(g - 0.08))) if score else 0.08


def subjects_of(docs: DataFrame, labels: DataFrame, areas: DataFrame | None = None, with_labelled: bool = False) -> DataFrame:
    """``doc_id, subject``, one row per subject of each document (unlabelled ones only, unless asked); ``areas``: the permitted subjects."""
    used = labels if areas is None else labels.join(areas.select("subject").distinct(), "subject", "left_semi")
    labelled = materialize(_labelled(docs, used), "p8_labelled")
    held = labelled.where("held")
    first = mine(labelled.where("not held"))
    scale = calibration(held.where(F.size("subjects") == 1), *first)
    share = fitted_share(held, rules_of(*first, scale))
    rules = rules_of(*mine(labelled), scale)
    todo = docs.where("doc_id is not null").where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id", "text")
    if not with_labelled:
        todo = todo.join(labels.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti")
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, out = [], []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                for s in chosen(*rules.shares(t), share):
                    ids.append(i)
                    out.append(s)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "subject": pd.Series(out, dtype=object)})

    return todo.mapInPandas(score, f"doc_id {kind}, subject string")


def subject_shares(found: DataFrame) -> DataFrame:
    """``subject, documents, share``: the corpus's composition; documents with several subjects count for each."""
    n = found.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    by = found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"))
    return by.join(F.broadcast(n)).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))
