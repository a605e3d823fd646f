"""The store: one object with the verbs of the engine, each a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INTENT_STOP_WORDS
from ..operators import catalog, chunking, expansion, fusion, lexical, maintenance, metadata, retrieval, vector
from ..operators.expansion import SubQuery, parse_document
from ..session import materialize

#: Candidates that are reranked, results per list, default result limits and least vector score.
CANDIDATES, PER_LIST, LIMIT, LEAST_VECTOR = 40, 20, 10, 0.3


def word_overlap(queries: list[str], texts: list[str]) -> list[float]:
    """An offline stand-in for a reranking model: the share of the query's words in the text."""
    out = []
    for q, t in zip(queries, texts):
        words = set(q.lower().split())
        low = t.lower()
        out.append(sum(w in low for w in words) / len(words) if words else 0.0)
    return out


def intent_words(intent: str | None) -> list[str]:
    """The terms of an intent that count in the choice of a passage."""
    words = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in (intent or "").lower().split()]
    return [w for w in words if len(w) > 1 and w not in INTENT_STOP_WORDS]


class Store:
    """Documents ``doc, collection, path, title, hash, body, modified_at, active``, optional vectors
    (``doc, chunk, embedding``) and metadata entries; models are plain functions on batches."""

    def __init__(
        self,
        documents: DataFrame,
        vectors: DataFrame | None = None,
        extracted: DataFrame | None = None,
        contexts: DataFrame | None = None,
        embed: Callable[[list[str]], list[list[float]]] | None = None,
        expand: Callable[[str], str] | None = None,
        rerank: Callable[[list[str], list[str]], list[float]] = word_overlap,
    ) -> None:
        self.documents, self.vectors, self.extracted, self.contexts = documents.where("active"), vectors, extracted, contexts
        self.embed, self.expand, self.rerank = embed, expand, rerank
        self._index: lexical.LexicalIndex | None = None
        self._expanded: dict[str, list[SubQuery]] = {}

    @classmethod
    def of_documents(cls, docs: DataFrame, **models) -> Store:
        """From the table ``documents``."""
        named = docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("collection"), "path", "title", "hash", F.col("text").alias("body"), "modified_at", "active")
        return cls(named, **models)

    @property
    def spark(self):
        return self.documents.sparkSession

    def index(self, path: str | None = None, stem: bool = True) -> lexical.LexicalIndex:
        """Builds (and keeps) the inverted index of stems, clustered by term; with ``path`` it is written there and
        later sessions open it by :meth:`open_index`. The first search builds it if nothing else did."""
        self._index = lexical.build_index(self.documents, "doc", {"path": "path", "title": "title", "body": "body"}, path, stem)
        return self._index

    def open_index(self, path: str) -> lexical.LexicalIndex:
        """Takes up an index that :meth:`index` has written."""
        self._index = lexical.open_index(self.spark, path)
        return self._index

    def _lexical_lists(self, queries: list[tuple[str, str]], limit: int, collections: list[str] | None, predicate: dict | None) -> DataFrame:
        """``qid, doc, score, rank`` of the best documents of each query; ties go by path."""
        found = lexical.search(self.spark, self._index or self.index(), queries, self.scope(collections, predicate)).withColumn("score", F.round("score", 12))
        named = found.join(self.documents.select("doc", F.concat("collection", F.lit("/"), "path").alias("file")), "doc")
        return lexical.top(named, limit, F.struct("file", "doc")).drop("file")

    def scope(self, collections: list[str] | None = None, predicate: dict | None = None) -> DataFrame | None:
        """``doc`` of the documents in the collections that satisfy the metadata predicate; null: all."""
        out = None
        names = [c.strip() for c in collections or [] if c.strip()]
        if names:
            out = self.documents.where(F.col("collection").isin(names)).select("doc")
        if predicate is not None:
            if self.extracted is None:
                raise ValueError("this store has no metadata")
            fit = metadata.filter_documents(metadata.eligible(self.extracted), metadata.explode_entries(self.extracted), predicate)
            out = fit if out is None else out.join(fit, "doc", "left_semi")
        return out

    def search_lexical(self, query: str, limit: int = PER_LIST, collections: list[str] | None = None, predicate: dict | None = None) -> DataFrame:
        """``qid, doc, score, rank`` of one lexical query over stems."""
        return self._lexical_lists([("q", query)], limit, collections, predicate)

    def search_vector(self, query: str | list[float], limit: int = LIMIT, least: float = LEAST_VECTOR, collections: list[str] | None = None, predicate: dict | None = None) -> DataFrame:
        if self.vectors is None:
            raise ValueError("this store has no vectors")
        vec = self.embed([query])[0] if isinstance(query, str) else query
        rows = self.vectors
        if (scope := self.scope(collections, predicate)) is not None:
            rows = rows.join(scope, "doc", "left_semi")
        one = self.spark.createDataFrame([(0, [float(x) for x in vec])], "chunk long, embedding array<double>")
        near = vector.nearest_groups(one, rows, "chunk", "embedding", "doc", limit)
        best = near.select("qid", "doc", (1 - F.col("distance")).alias("score"))
        return fusion.keep_best(best, least=least, limit=limit)

    def expansions(self, query: str) -> list[SubQuery]:
        """Sub-queries of a plain query by the store's expander: copies of the query and exact repeats dropped; kept for the next time."""
        if query not in self._expanded:
            found: dict[SubQuery, None] = {}
            for line in (self.expand(query) if self.expand else "").splitlines():
                kind, _, body = line.partition(":")
                if kind.strip() in expansion.KINDS and body.strip() and body.strip() != query:
                    found[SubQuery(kind.strip(), body.strip())] = None
            if not found:
                return []
            self._expanded[query] = list(found)
        return self._expanded[query]

    def vector_query(self, query: str, limit: int = LIMIT, least: float = LEAST_VECTOR, collections: list[str] | None = None, predicate: dict | None = None) -> DataFrame:
        """``doc, score, rank``: the query and its semantic expansions by vectors only, the best score of each document."""
        if self.vectors is None or self.embed is None:
            return self.documents.limit(0).select("doc", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        texts = [query, *[q.text for q in self.expansions(query) if q.kind != "lex"]]
        found = None
        for t in texts:
            part = self.search_vector(t, limit, 0.0, collections, predicate).select(F.lit("q").alias("qid"), "doc", "score")
            found = part if found is None else found.unionByName(part)
        return fusion.keep_best(found, least=least, limit=limit).drop("qid")

    def query(
        self,
        searches: str | list[str],
        limit: int = LIMIT,
        least: float = 0.0,
        collections: list[str] | None = None,
        predicate: dict | None = None,
        reranked: bool = True,
        pinned: list[SubQuery] | None = None,
    ) -> DataFrame:
        """``doc, score, rank, display_path, title, snippet_pos`` (and ``metadata`` if the store has any): lists per sub-query,
        fused, best passages reranked, best first.

        ``searches``: a query document, its lines, or one plain query. A plain query whose best lexical match is good and far ahead is
        not expanded; others are, if the store can. ``pinned``: expansions to take instead, as benchmarks do, without that probe.
        """
        text = searches if isinstance(searches, str) else "\n".join(searches)
        parsed = parse_document(text)
        probe = None
        if parsed is None:
            plain = text.strip().removeprefix("expand:").strip()
            subs, intent, structured = [SubQuery("lex", plain)], None, False
            if self.embed:
                subs.append(SubQuery("vec", plain))
            if pinned is not None:
                subs += [q for q in pinned if q.text != plain]
            elif self.expand:
                probe = materialize(self._lexical_lists([("0", plain)], PER_LIST, collections, predicate), "probe")
                if not expansion.strong_signal(probe).where("strong").head(1):
                    subs += self.expansions(plain)
        else:
            (subs, intent), structured = parsed, True
        lists = None
        originals = 2 if self.embed else 1
        words = [(str(i), q.text) for i, q in enumerate(subs) if q.kind == "lex" and not (probe is not None and i == 0)]
        every = self._lexical_lists(words, PER_LIST, collections, predicate) if words else None  # all lexical lists in one pass
        if probe is not None:
            every = probe if every is None else every.unionByName(probe)
        if every is not None:
            number = F.col("qid").cast("int")
            lists = every.select(F.lit("q").alias("qid"), number.alias("list"), (F.col("rank") - 1).alias("rank0"), "doc", (number < originals).alias("original"))
        for i, q in enumerate(subs):
            if q.kind == "lex" or self.vectors is None or not self.embed:
                continue
            found = self.search_vector(q.text, PER_LIST, 0.0, collections, predicate)
            part = found.select(F.lit("q").alias("qid"), F.lit(i).alias("list"), (F.col("rank") - 1).alias("rank0"), "doc", F.lit(i < originals).alias("original"))
            lists = part if lists is None else lists.unionByName(part)
        if lists is None:  # nothing that this store can run
            return self.documents.limit(0).select("doc", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.col("path").alias("display_path"), "title", F.lit(0).alias("snippet_pos"))
        lists = materialize(lists, "lists")
        if not structured and pinned is None and lists.where("not original").isEmpty():
            self._expanded.pop(subs[0].text, None)  # expansions that contributed nothing are not kept
        fused = materialize(fusion.reciprocal_rank_fusion(fusion.list_weights(lists, structured), CANDIDATES), "fused")  # at most CANDIDATES rows
        primary = next((q.text for q in subs if q.kind == "lex"), subs[0].text)
        shown = primary if not intent else f"{intent}\n\n{primary}"
        bodies = self.documents.join(F.broadcast(fused.select("doc")), "doc")
        passages = chunking.best_passage(chunking.chunk_documents(bodies, "doc", "body", "path"), primary, intent_words(intent)).select(F.col("id").alias("doc"), "pos", "chunk")
        cand = fused.join(passages, "doc", "left").withColumn("chunk", F.coalesce("chunk", F.lit("")))
        if reranked:
            scored = fusion.fuse_rerank(fusion.rerank(cand.withColumn("query", F.lit(shown)), self.rerank))
        else:
            scored = fusion.plain_rank_score(cand)
        best = fusion.keep_best(scored.select("qid", "doc", "score"), least=least, limit=limit)
        named = self.documents.select("doc", F.concat("collection", F.lit("/"), "path").alias("display_path"), "title")
        shown = best.join(named, "doc").join(passages.select("doc", F.col("pos").alias("snippet_pos")), "doc", "left").select("doc", F.round("score", 9).alias("score"), "rank", "display_path", "title", "snippet_pos")
        return shown if self.extracted is None else catalog.attach_metadata(shown, metadata.explode_entries(self.extracted))

    def get(self, refs: list[str]) -> DataFrame:
        r = self.spark.createDataFrame([(x,) for x in refs], "ref string")
        return retrieval.resolve_refs(r, self.documents.select("doc", "collection", "path", "hash")).join(self.documents, "doc")

    def multi_get(self, pattern: str, most_bytes: int = 64 << 10) -> DataFrame:
        """Bodies for a glob, or for a list of references set apart by commas; bodies of more than ``most_bytes`` come with a reason instead."""
        refs = [r.strip() for r in pattern.split(",") if r.strip()]
        found = self.get(refs) if len(refs) > 1 and not re.search(r"[*?{\[]", pattern) else retrieval.match_glob(self.documents, pattern)
        return retrieval.read_many(found, most_bytes)

    def ls(self, collection: str | None = None, prefix: str = "") -> DataFrame:
        """Collections with their files, or the files of one below a prefix."""
        return catalog.list_collections(self.documents) if collection is None else catalog.list_files(self.documents, collection, prefix)

    def list_metadata(self, window: catalog.Window = catalog.Window(), match: dict | None = None, predicate: dict | None = None, collections: list[str] | None = None) -> dict:  # noqa: B008
        """One snapshot: ``documents``, ``filtered`` (with a predicate), ``total_keys``, ``remaining_keys`` and the tables ``keys``,
        ``types``, ``values`` and ``ranges`` of the keys in the window."""
        rows = metadata.explode_entries(self.extracted).join(metadata.eligible(self.extracted), "doc", "left_semi")
        scope = self.scope(collections, predicate)
        if scope is not None:
            rows = rows.join(scope, "doc", "left_semi")
        rows = materialize(rows, "entries")
        matched = rows if match is None else rows.where(metadata.entry_column(metadata.parse_filter(match, entry=True)))
        counted = matched.groupBy("key").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= window.min_count).select("key")
        usable = matched.join(counted, "key", "left_semi")
        keys = materialize(metadata.key_window(usable, window.key_limit or (1 << 31) - 1, window.key_offset), "keys")
        total = (keys.agg(F.max("total_keys")).first()[0]) or 0
        page = keys.where("in_page").select("key", "documents", "position")
        shown = usable.join(F.broadcast(page.select("key")), "key") if window.key_limit is not None and window.key_limit <= 10_000 else usable.join(page.select("key"), "key")
        names = self.documents.select("doc", "collection")
        return {
            "documents": self.documents.join(metadata.eligible(self.extracted), "doc", "left_semi").count(),
            "filtered": scope.count() if predicate is not None else None,
            "total_keys": total,
            "remaining_keys": max(0, total - window.key_offset - page.count()),
            "keys": page,
            "types": metadata.type_stats(shown, names),
            "values": metadata.value_counts(shown, window.value_limit or (1 << 31) - 1, window.value_offset, window.min_count, window.sort == "count"),
            "ranges": metadata.number_ranges(shown),
        }

    def status(self) -> DataFrame:
        return maintenance.collection_stats(self.documents)


def render_metadata(listing: dict, empty: str = "No metadata.") -> str:
    """A metadata listing as text: a block per key with its types, how many documents have it, and its values; the window bounds it."""
    head = f"filter: {listing['filtered']:,} of {listing['documents']:,} documents" if listing["filtered"] is not None else ""
    keys = sorted(listing["keys"].collect(), key=lambda r: r["position"])
    blocks = [head] if head else []
    if not keys:
        blocks.append(empty if not listing["total_keys"] else f"No keys at this offset, {listing['total_keys']:,} in all.")
    types, values, ranges = {}, {}, {r["key"]: r for r in listing["ranges"].collect()}
    for r in listing["types"].collect():
        types.setdefault(r["key"], []).append(r["value_type"] + ("[]" if r["multi_valued"] else ""))
    for r in listing["values"].where("in_page").orderBy("key", "value_type", "position").collect():
        values.setdefault(r["key"], []).append(f"  {r['value']} ({r['documents']:,})")
    base = listing["filtered"] if listing["filtered"] is not None else listing["documents"]
    for k in keys:
        lines = [f"{k['key']}  {' | '.join(sorted(types.get(k['key'], [])))}  {k['documents']:,} of {base:,} documents"]
        if r := ranges.get(k["key"]):
            lines.append(f"  {r['low']:g} to {r['high']:g}, median {r['median']:g}")
        blocks.append("\n".join(lines + values.get(k["key"], [])))
    if listing["remaining_keys"]:
        blocks.append(f"{listing['remaining_keys']:,} more {'key' if listing['remaining_keys'] == 1 else 'keys'}")
    return "\n\n".join(blocks)
