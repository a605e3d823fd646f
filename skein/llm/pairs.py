"""Broken prompt and response pairs (problem 1).

A response is a list of entries (kind, text), given as such or as lines ``kind: text``. A record has
at most one defect; the checks run in this order:

``empty``            no letter or digit besides kind names;
``copied_question``  every entry is the prompt again, once or more, perhaps behind a short label;
``refusal``          entries that share nothing with their prompt and at least half of whose words stand
                     in sentences that recur across unrelated prompts. Sentences, with and without what leads
                     into them, are clustered by MinHash over shingles of five words: candidate pairs are verified
                     by their true similarity (0.8), clusters are the components of verified pairs, and the distinct
                     prompts of a cluster are counted exactly. A cluster is a template of refusal if it has at least two
                     and no content word stands in all of them; an answer that occurs for one prompt only, or
                     for prompts about one matter, is no refusal;
``truncated``        an entry or the output stops early: a passage without its closing mark, open
                     quotes or brackets, a kind name without text at the end, a last word that is cut
                     off, that hardly ever ends an entry, or an entry that is the beginning of a form
                     far more frequent than itself (forms: entries with the prompt's words masked);
``other_language``   at least one entry is in another language than the prompt.

Word statistics (how often a word ends an entry, frequent forms, words by language) are counted over
all records; what is sent to the tasks holds only words and forms above a fixed share of the whole, so its
size is bounded whatever the data's. The language of a prompt is seeded by short lists of function
words, then every frequent word votes with its counts by language; words shared with the prompt
do not vote for or against it, so names don't count.

Defined cases: a null prompt has no copy, refusal or language defect; null outputs, entries, kinds or
texts say nothing; repeated rows count once; texts of any length are read whole; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import setjoin
from ..operators.curation import components
from ..session import heavy_split_join, materialize

KINDS = ("lex", "vec", "hyde")
SHINGLE, SIMILAR = 5, 0.8
#: Words that may lead into a sentence without a comma.
LEAD_WORDS = 2
#: Least shares of all words and forms that are sent to the tasks; they bound the number sent.
WORD_SHARE, FORM_SHARE = 1 / 50_000, 1 / 5_000
END_RATE, FORM_RATIO, LEAST_SEEN = 0.02, 20, 20
MARGIN = 2.5

_WORD = re.compile(r"[^\W_]+")
_LINE = re.compile(r"\s*(?:[-*•+]\s*|\d+[.)]\s*)?[\"'*_`]*(lex|vec|hyde)[\"'*_`]*\s*[:：=]\s*(.*)", re.I | re.S)
_STOPS = ".!?…。！？"
_SENTENCE = re.compile(r"[.!?…]+(?:\s+|$)|[。！？]+|[\r\n]+")
_LEAD = re.compile(r"[,;:，、：]")
_CLOSERS = " \t\r\n\"'”’»)]}*_`」』"

#: Function words (articles, prepositions, pronouns, auxiliaries, question words; no content words) that seed the
#: language of a prompt; words of more than one language are left out.
SEEDS = {
    "en": "the of and to is was for with about from what who when where does did how are by at which that this it or not their".split(),
    "de": "der die das den dem und mit von über ist war wann wie wer zu im auf für ein eine einen sich nicht ich wir wo welche zum zur bei".split(),
    "fr": "le les du et avec dans est qui quand une pour par au aux ce cette où il elle pas nous vous sont quel quelle".split(),
    "es": "el los las y con en cuándo por para lo del cómo quién dónde qué su al una más cuál unos fue sobre".split(),
}
_FUNCTION = frozenset(w for v in SEEDS.values() for w in v)
_SEED_SETS = {k: frozenset(v) for k, v in SEEDS.items()}


def seed_language(prompt: list[str]) -> str | None:
    """The language with the most seeds in the prompt, if there is one."""
    inside = set(prompt)
    hits = {k: len(inside & v) for k, v in _SEED_SETS.items()}
    best = max(hits.values())
    found = [k for k, n in hits.items() if n == best]
    return found[0] if best and len(found) == 1 else None


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parse_lines(raw: str | None) -> tuple[list[tuple[str, str]], bool]:
    """Entries of an output of lines, and whether its end is cut off."""
    if raw is None:
        return [], False
    body = re.sub(r"<think>.*?</think>", "\n", raw, flags=re.S)
    cut = False
    if "<think>" in body:
        body, cut = body.split("<think>")[0], True
    entries: list[tuple[str, str]] = []
    for line in re.split(r"[\r\n]+", body):
        if m := _LINE.fullmatch(line):
            entries.append((m[1].lower(), m[2]))
            cut = not _WORD.search(m[2])
        elif word := line.strip().lower().strip("-*•:` "):
            if any(k.startswith(word) for k in KINDS):
                cut = True
            else:
                entries.append(("text", line.strip()))
                cut = False
    return entries, cut and any(_WORD.search(t) for _, t in entries)


def parse_entries(output) -> tuple[list[tuple[str, str]], bool]:
    """Entries of an output of (kind, text) lists."""
    found = []
    for e in output if output is not None else []:
        if e is not None and len(e):
            found.append(((e[0] or "").lower().strip(), (e[1] if len(e) > 1 else None) or ""))
    return found, False


def masked(words: list[str], prompt: set[str]) -> str:
    """The entry's form: runs of the prompt's words become one mark."""
    out: list[str] = []
    for w in words:
        if w in prompt:
            if not out or out[-1] != "Q":
                out.append("Q")
        else:
            out.append(w)
    return " ".join(out)


def shares_prompt(words: list[str], prompt: list[str]) -> bool:
    """A long word that is no function word beside a word of the prompt's, or a word run of the prompt."""
    inside = set(prompt)
    pairs = {p for p in zip(prompt, prompt[1:]) if not (p[0] in _FUNCTION and p[1] in _FUNCTION)}
    if any(p in pairs for p in zip(words, words[1:])):
        return True
    return any(w in inside and w not in _FUNCTION and len(w) > 6 for w in words)


def sentences(text: str) -> list[list[str]]:
    """Per sentence its openings, longest first: the sentence and what follows its first comma, each also without
    its first words, so that variants of a template that differ in what leads into them meet."""
    found = []
    for sentence in _SENTENCE.split(text):
        bases = [words_of(sentence), *[words_of(x) for x in _LEAD.split(sentence, maxsplit=1)[1:]]]
        parts = {" ".join(b[n:]) for b in bases for n in range(LEAD_WORDS + 1) if len(b) - n >= (SHINGLE if n else 3)}
        if parts:
            found.append(sorted(parts, key=lambda x: (-len(x.split()), x)))
    return found


def recurring(text: str, refusing: set[str]) -> bool:
    """Whether at least half of the entry's words stand in openings that recur."""
    held = sum(next((len(x.split()) for x in parts if x in refusing), 0) for parts in sentences(text))
    return held > 0 and 2 * held >= len(words_of(text))


def _copy(words: list[str], prompt: list[str]) -> bool:
    """The prompt's letters and digits once or more, however set apart, behind a label of at most three words."""
    whole = "".join(prompt)
    for label in range(min(4, len(words))):
        rest = "".join(words[label:])
        if len(rest) % len(whole) == 0 and rest == whole * (len(rest) // len(whole)):
            return True
    return False


_A = (
    "table_name string, record_id long, query string, kinds array<string>, texts array<string>, forms array<string>, openings array<array<string>>, cut boolean, "
    "prompt array<string>, words array<array<string>>, lang string"
)


def _read(lines: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, rid, query, output in zip(pdf["table_name"], pdf["record_id"], pdf["query"], pdf["output"]):
                entries, cut = (parse_lines if lines else parse_entries)(output)
                query = query if isinstance(query, str) else None
                prompt = words_of(query or "")
                inside = set(prompt)
                forms, openings, words = [], [], []
                for _, text in entries:
                    w = words_of(text)
                    words.append(w)
                    forms.append(masked(w, inside))
                    free = prompt and len(w) >= 3 and not shares_prompt(w, prompt)
                    openings.append(sorted({x for parts in sentences(text) for x in parts}) if free else None)
                rows.append((name, rid, query, [k for k, _ in entries], [t for _, t in entries], forms, openings, cut, prompt, words, seed_language(prompt)))
            yield pd.DataFrame({n.split()[0]: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(_A.split(", "))})

    return run


def _shingles(text: str) -> set[str]:
    w = text.split()
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


#: Members of a band up to which all its pairs are listed; of a larger one only those that decide its clusters.
BAND = 1000


def _shingle_hashes(text: Column) -> Column:
    w = F.split(text, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))


def similar_openings(openings: DataFrame, bands: int = 20, rows: int = 4) -> DataFrame:
    """``a, b``: distinct openings whose shingle sets agree to ``SIMILAR`` or more, ``a < b``.

    A pair of that similarity shares a band with probability 0.99997, one of 0.2 with 0.03. All pairs of a band are listed, but of
    a band with more than ``BAND`` members (a template with a free slot) only so many that its clusters are those of all pairs: the
    members are compared with their neighbours by text and with the smallest one; then every member outside the largest cluster of such
    a band is joined exactly (:mod:`skein.operators.setjoin`) with the members of all large bands that are in another cluster.
    """
    rng = np.random.default_rng(7)
    mul = rng.integers(1, 1 << 31, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint64)

    @F.pandas_udf("array<long>")
    def band_keys(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = np.array([zlib.crc32(s.encode()) for s in _shingles(t)], np.uint64)
            low = ((h[:, None] * mul + add) & np.uint64((1 << 32) - 1)).min(0).reshape(bands, rows)
            out.append([int(zlib.crc32(bytes([i]) + low[i].tobytes())) << 8 | i for i in range(bands)])
        return pd.Series(out)

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = [(_shingles(x), _shingles(y)) for x, y in zip(a, b)]
        return pd.Series([len(x & y) / len(x | y) for x, y in sets], dtype=float)

    keyed = materialize(openings.select("opening", F.explode(band_keys("opening")).alias("band")), "p1_bands")
    size = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("opening").alias("least"))
    size = materialize(size.where("n > 1"), "p1_band_sizes")
    members = keyed.join(size, "band")
    small = members.where(F.col("n") <= BAND).select("band", "opening")
    pairs = small.select(F.col("opening").alias("a"), "band").join(small.select(F.col("opening").alias("b"), "band"), "band").where("a < b").select("a", "b")
    verified = lambda df: df.distinct().where(jaccard("a", "b") >= SIMILAR)
    if size.where(F.col("n") > BAND).isEmpty():
        return verified(pairs)
    # the key's prefix orders a large band in runs that tasks share
    large = members.where(F.col("n") > BAND)
    run = F.struct("band", F.substring("opening", 1, 24))
    order = W.partitionBy(run).orderBy("opening")
    after = [F.lead("opening", k).over(order).alias(f"l{k}") for k in (1, 2, 4, 8)]
    chain = large.select("opening", *after).select(F.col("opening").alias("a"), F.explode(F.array(*[f"l{k}" for k in (1, 2, 4, 8)])).alias("b"))
    pairs = pairs.union(chain).union(large.select(F.col("least").alias("a"), F.col("opening").alias("b"))).where("a < b")
    near = materialize(verified(pairs), "p1_near")
    roots = components(near).select(F.col("node").alias("opening"), "root")
    large = materialize(large.select("band", "opening").join(roots, "opening", "left").withColumn("root", F.coalesce("root", "opening")), "p1_large")
    most = large.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    outside = large.join(most.where("roots > 1"), "band").where("root <> most")
    rest, every = (materialize(df.select(F.col("opening").alias("key"), F.col("opening").alias("text"), F.xxhash64("root").alias("group")).distinct(), "p1_apart") for df in (outside, large))
    if rest.isEmpty():
        return near
    apart = setjoin.candidates(rest, every, SIMILAR, None, _shingle_hashes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near.union(verified(apart))


def refusing_openings(read: DataFrame) -> DataFrame:
    """``opening, n``: those that share nothing with their prompt and whose cluster occurs for at least two unrelated prompts;
    ``n`` is the number of their occurrences."""
    free = read.select("query", "prompt", F.explode(F.flatten(F.filter("openings", lambda o: o.isNotNull()))).alias("opening"))
    hashed = F.xxhash64("query")
    own = materialize(free.groupBy("opening").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi"), F.count(F.lit(1)).alias("n")), "p1_openings")
    near = materialize(similar_openings(own), "p1_near")
    if near.isEmpty():
        clustered = own.withColumn("root", F.col("opening"))
    else:
        roots = components(near).select(F.col("node").alias("opening"), "root")
        clustered = own.join(roots, "opening", "left").withColumn("root", F.coalesce("root", "opening"))
    several = clustered.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("root")
    held = materialize(clustered.join(several, "root").select("opening", "root", "n"), "p1_clusters")
    # exactly: the distinct prompts of each cluster, and whether a content word stands in all of them
    total = held.agg(F.sum("n")).first()[0] or 0
    prompts = heavy_split_join(free.select("opening", "query", "prompt"), held, "opening", "n", total).groupBy("root", "query").agg(F.first("prompt").alias("prompt"))
    words = F.filter(F.array_distinct("prompt"), lambda w: (F.length(w) > 3) & ~w.isin(sorted(_FUNCTION)))
    counted = prompts.select("root", F.explode(F.concat(F.array(F.lit("")), words)).alias("w")).groupBy("root", "w").agg(F.count(F.lit(1)).alias("k"))
    both = counted.groupBy("root").agg(F.max(F.when(F.col("w") == "", F.col("k"))).alias("prompts"), F.max(F.when(F.col("w") != "", F.col("k"))).alias("shared"))
    unrelated = both.where((F.col("prompts") >= 2) & (F.coalesce("shared", F.lit(0)) < F.col("prompts"))).select("root")
    return held.join(unrelated, "root", "left_semi").select("opening", "n")


def _model(read: DataFrame) -> dict:
    """Bounded word and form statistics; see the module's docstring."""
    entry = read.select(F.explode(F.arrays_zip("kinds", "words", "forms")).alias("e"))
    short = entry.where("e.kinds <> 'hyde'")
    words = short.select(F.col("e.words").alias("w"))
    ends = words.select(F.posexplode("w").alias("at", "word"), F.size("w").alias("size")).select("word", (F.col("at") == F.col("size") - 1).cast("int").alias("end"))
    stats = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends"))
    total = words.agg(F.sum(F.size("w"))).first()[0] or 0
    least = max(LEAST_SEEN, int(total * WORD_SHARE))
    rates = {r["word"]: (r["n"], r["ends"]) for r in stats.where(F.col("n") >= least).collect()}
    n_forms = short.count()
    forms = short.groupBy(F.col("e.forms").alias("form")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(3, int(n_forms * FORM_SHARE)))
    form_counts = {r["form"]: r["n"] for r in forms.collect()}

    labelled = read.where("lang is not null").select("lang", F.array_union("prompt", F.flatten("words")).alias("w"))
    by_lang = labelled.select("lang", F.explode("w").alias("word")).groupBy("word").pivot("lang", list(SEEDS)).count().fillna(0)
    sums = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    records = sum(sums.values()) or 1
    common = by_lang.where(sum(F.col(k) for k in SEEDS) >= max(3, int(records * 1e-4)))
    votes = {}
    for r in common.collect():
        # documents of each language with the word, smoothed
        votes[r["word"]] = [math.log((r[k] + 0.02) / (sums.get(k, 0) + 1)) for k in SEEDS]
    return {"rates": rates, "forms": form_counts, "votes": votes}


class Judge:
    """Checks of one record, given the corpus statistics."""

    def __init__(self, model: dict) -> None:
        self.rates, self.forms, self.votes = model["rates"], model["forms"], model["votes"]
        self.langs = list(SEEDS)
        self.begin: dict[str, int] = {}
        for form, n in self.forms.items():
            for i in range(1, len(form)):
                p = form[:i].rstrip()
                self.begin[p] = max(self.begin.get(p, 0), n)

    def _never_ends(self, word: str) -> bool:
        n, ends = self.rates.get(word, (0, 0))
        return n >= LEAST_SEEN and ends < END_RATE * n

    def _ends(self, word: str) -> bool:
        n, ends = self.rates.get(word, (0, 0))
        return n >= LEAST_SEEN and ends >= END_RATE * n

    def truncated(self, kind: str, text: str, words: list[str], form: str, prompt: list[str]) -> bool:
        bare = text.rstrip()
        if bare.count('"') % 2 or bare.count("(") > bare.count(")") or bare.count("“") > bare.count("”") or bare.count("«") > bare.count("»"):
            return True
        stopped = bare.rstrip(_CLOSERS)[-1:] in tuple(_STOPS)
        if kind == "hyde":
            return not stopped
        if stopped or not words:
            return False
        last, inside = words[-1], set(prompt)
        if last not in inside and not self._ends(last) and any(p.startswith(last) for p in inside):
            return True
        if self._never_ends(last):
            return True
        return self.begin.get(form, 0) >= FORM_RATIO * max(1, self.forms.get(form, 1))

    def language(self, words: list[str], skip: set[str] = frozenset()) -> list[float] | None:
        seen = [self.votes[w] for w in set(words) if w not in skip and w in self.votes]
        return [sum(v) for v in zip(*seen)] if seen else None

    def foreign(self, text: str, words: list[str], prompt: list[str]) -> bool:
        own = self.language(prompt)
        asian = lambda t: len(re.findall(r"[぀-ヿ㐀-鿿가-힯]", t))
        here = asian(text)
        if (here >= 3) != (asian("".join(prompt)) >= 3):
            return here >= 3 or own is None
        if own is None or here >= 3:
            return False
        lang = own.index(max(own))
        votes = self.language(words, set(prompt))
        if votes is None:
            return False
        return max(votes) - votes[lang] >= MARGIN

    def __call__(self, prompt: list[str], kinds: list[str], texts: list[str], spoken: list[list[str]], forms: list[str], openings: list, cut: bool, refusing: set[int]) -> str | None:
        said = [i for i, w in enumerate(spoken) if len(w)]
        if not said:
            return "empty"
        copies = {i for i in said if prompt and _copy(spoken[i], prompt)}
        if len(copies) == len(said):
            return "copied_question"
        free = {i for i in said if openings[i] is not None}
        stopped = {i for i in free if texts[i].rstrip().rstrip(_CLOSERS)[-1:] in tuple(_STOPS)}
        weighty = [i for i in said if len(spoken[i]) >= 3 and i not in copies]
        known = stopped & refusing
        if known and weighty and 2 * len(known) >= len(weighty):
            return "refusal"
        if cut or any(self.truncated(kinds[i], texts[i], spoken[i], forms[i], prompt) for i in said if i not in copies):
            return "truncated"
        if prompt and any(self.foreign(texts[i], spoken[i], prompt) for i in said if i not in copies):
            return "other_language"
        return None


def _classify(model: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(model)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                again = set(r.refusing) if r.refusing is not None else set()
                refusing = {i for i, o in enumerate(r.openings) if o is not None and recurring(r.texts[i], again)} if again else set()
                d = judge(list(r.prompt), list(r.kinds), list(r.texts), [list(w) for w in r.words], list(r.forms), list(r.openings), bool(r.cut), refusing)
                if d:
                    rows.append((r.table_name, r.record_id, d))
            yield pd.DataFrame({n: pd.Series([x[i] for x in rows], dtype=object) for i, n in enumerate(("table_name", "record_id", "defect"))})

    return run


def read_pairs(df: DataFrame, name: str, output_col: str, lines: bool) -> DataFrame:
    """Parsed records of one table; redelivered rows once."""
    rows = df.select(F.lit(name).alias("table_name"), "record_id", "query", F.col(output_col).alias("output")).where("record_id is not null")
    return rows.dropDuplicates(["record_id"]).mapInPandas(_read(lines), _A)


def defective_pairs(read: DataFrame) -> DataFrame:
    """``table_name, record_id, defect`` of the defective records of parsed pairs (:func:`read_pairs`)."""
    read = materialize(read, "p1_read")
    at = read.select("table_name", "record_id", F.explode(F.flatten(F.filter("openings", lambda o: o.isNotNull()))).alias("opening"))
    found = materialize(refusing_openings(read), "p1_refusing")
    total = found.agg(F.sum("n")).first()[0] or 0
    refusing = heavy_split_join(at, found, "opening", "n", total).groupBy("table_name", "record_id").agg(F.collect_set("opening").alias("refusing"))
    joined = read.drop("query", "lang").join(refusing, ["table_name", "record_id"], "left")
    return joined.mapInPandas(_classify(_model(read)), "table_name string, record_id long, defect string")
