"""Structure-aware passages of documents.

Break points are scored (headings, fences, rules, blank lines, list items, line feeds); a passage ends
at the break of the best score, weighted down by its squared distance from the size limit, within a
window before the limit and outside fenced code. Passages overlap. Each text is cut where it
lies, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a passage, its overlap and the search window; first-pass characters per token.
SIZE, OVERLAP, WINDOW = 3600, 540, 800
TOKEN_LIMIT, TOKEN_OVERLAP, TOKEN_WINDOW, CHARS_PER_TOKEN = 900, 135, 200, 3
#: Scores of break points by kind.
SCORES = {"h1": 100, "h2": 90, "h3": 80, "h4": 70, "h5": 60, "h6": 50, "fence": 80, "rule": 60, "blank": 20, "item": 5, "number": 5, "line": 1}

_AT_LINE = re.compile(r"\n(?:(?P<h>#{1,6}(?!#))|(?P<fence>```)|(?P<rule>(?:---|\*\*\*|___)\s*\n)|(?P<blank>\n)|(?P<item>[-*]\s)|(?P<number>\d+\.\s))?")


def break_points(text: str) -> list[tuple[int, int]]:
    """(position, score), by position."""
    out, last_blank = [], -2
    for i, ch in enumerate(text):
        if ch != "\n":
            continue
        m = _AT_LINE.match(text, i)
        kind = m.lastgroup or "line"
        if kind == "h":
            kind = f"h{len(m['h'])}"
        if kind == "blank" or (kind == "line" and last_blank == i - 1):
            # later line feeds of one run of blank lines are ordinary ones
            kind, last_blank = ("line" if last_blank == i - 1 else "blank"), i
        out.append((i, SCORES[kind]))
    return out


def fences(text: str) -> list[tuple[int, int]]:
    """Regions of fenced code; an open fence lasts to the end."""
    marks = [m.start() for m in re.finditer("\n```", text)]
    pairs = list(zip(marks[::2], [e + 4 for e in marks[1::2]]))
    return pairs + ([(marks[-1], len(text))] if len(marks) % 2 else [])


#: Scores of syntax break points (imports and others, types, functions).
SYNTAX_SCORES = {"class": 100, "function": 90, "type": 80, "import": 60}
_SYNTAX = {
    "py": [("class", r"^(?:@\w.*\n)*class\s"), ("function", r"^(?:async\s+)?def\s"), ("import", r"^(?:from|import)\s")],
    "ts": [("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s"), ("class", r"^(?:export\s+)?interface\s"), ("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b"), ("type", r"^(?:export\s+)?(?:type|enum)\s"), ("import", r"^import\s")],
    "go": [("class", r"^type\s+\w+\s+(?:struct|interface)\b"), ("function", r"^func\s"), ("type", r"^type\s"), ("import", r"^import\b")],
    "rs": [("class", r"^(?:pub(?:\([^)]*\))?\s+)?(?:struct|impl|trait)\b"), ("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s"), ("type", r"^(?:pub\s+)?(?:enum|type|mod)\s"), ("import", r"^use\s")],
}
_KINDS = {"py": "py", "ts": "ts", "tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "go": "go", "rs": "rs"}


def syntax_points(text: str, path: str) -> list[tuple[int, int]]:
    """Break points before top-level definitions: from Python's own parser, else by line patterns."""
    kind = _KINDS.get(path.rsplit(".", 1)[-1].lower())
    if kind is None:
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    found: dict[int, int] = {}
    if kind == "py":
        try:
            for node in ast.parse(text).body:
                name = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.Import: "import", ast.ImportFrom: "import"}.get(type(node))
                if name:
                    line = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
                    found[max(0, starts[line - 1] - 1)] = SYNTAX_SCORES[name]
            return sorted(found.items())
        except (SyntaxError, ValueError):
            pass
    for name, pattern in _SYNTAX[kind]:
        for m in re.finditer(pattern, text, re.M):
            at = max(0, m.start() - 1)
            found[at] = max(found.get(at, 0), SYNTAX_SCORES[name])
    return sorted(found.items())


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Both lists by position; of equal positions the larger score."""
    best: dict[int, int] = {}
    for at, score in [*a, *b]:
        best[at] = max(score, best.get(at, 0))
    return sorted(best.items())


def passages(text: str, size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW, extra: list[tuple[int, int]] = ()) -> list[tuple[int, str]]:
    """(position, passage) of a text."""
    if len(text) <= size:
        return [(0, text)]
    points = merged(break_points(text), list(extra))
    at = [p for p, _ in points]
    closed = fences(text)
    begins = [s for s, _ in closed]

    def inside(p: int) -> bool:
        k = bisect.bisect_left(begins, p) - 1
        return k >= 0 and begins[k] < p < closed[k][1]

    out: list[tuple[int, str]] = []
    start = 0
    while True:
        limit = min(start + size, len(text))
        end = limit
        if limit < len(text):
            near = points[bisect.bisect_left(at, limit - window) : bisect.bisect_right(at, limit)]
            scored = [(score * (1 - 0.7 * ((limit - p) / window) ** 2), -p) for p, score in near if not inside(p)]
            if scored and -max(scored)[1] > start:
                end = -max(scored)[1]
        out.append((start, text[start:end]))
        if end >= len(text):
            return out
        start = end - overlap if end - overlap > start else end


def passages_by_tokens(text: str, count: Callable[[str], int], limit: int = TOKEN_LIMIT, overlap: int = TOKEN_OVERLAP, window: int = TOKEN_WINDOW) -> list[tuple[int, str, int]]:
    """(position, passage, tokens), none over the limit: a first pass by characters, and passages that
    turn out too large again by their measured ratio, in the end by halves."""
    todo = [(p, t, CHARS_PER_TOKEN * 1.0) for p, t in reversed(passages(text, limit * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN, window * CHARS_PER_TOKEN))]
    out = []
    while todo:
        at, part, ratio = todo.pop()
        n = count(part)
        if n <= limit or len(part) <= 1:
            out.append((at, part, n))
            continue
        ratio = min(ratio, len(part) / n) * 0.95
        size = max(1, int(limit * ratio))
        smaller = passages(part, size, min(int(overlap * ratio), size - 1), max(1, int(window * ratio)))
        if len(smaller) < 2:
            half = len(part) // 2
            smaller = [(0, part[:half]), (half, part[half:])]
        todo += [(at + p, t, ratio) for p, t in reversed(smaller)]
    return out


def chunk_documents(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None, size: int = SIZE, overlap: int = OVERLAP, window: int = WINDOW) -> DataFrame:
    """``id, seq, pos, n_chars, chunk`` of each text; with a path, syntax break points of source files too."""
    kind = dict(df.dtypes)[id_col]
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(path_col) if path_col else F.lit("")).alias("path")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, path in zip(pdf["id"], pdf["text"], pdf["path"]):
                extra = syntax_points(text, path or "") if path else []
                rows += [(i, k, p, len(t), t) for k, (p, t) in enumerate(passages(text, size, overlap, window, extra))]
            yield pd.DataFrame(rows, columns=["id", "seq", "pos", "n_chars", "chunk"])

    return df.where(F.col(text_col).isNotNull()).select(*cols).mapInPandas(run, f"id {kind}, seq int, pos int, n_chars int, chunk string")


def best_passage(chunks: DataFrame, query: str, intent: list[str] = ()) -> DataFrame:
    """The chunk of each document with the most query terms (of more than two characters) and, at half
    weight, intent terms; the first of equals."""
    terms = [t for t in query.lower().split() if len(t) > 2]
    low = F.lower(F.col("chunk"))
    score = sum((F.when(low.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) + sum((F.when(low.contains(t), 0.5).otherwise(0.0) for t in intent), F.lit(0.0))
    best = chunks.withColumn("s", score).groupBy("id").agg(F.max(F.struct("s", (-F.col("seq")).alias("k"))).alias("m"), F.max_by(F.struct("pos", "chunk"), F.struct("s", -F.col("seq"))).alias("c"))
    return best.select("id", (-F.col("m.k")).alias("seq"), F.col("c.pos").alias("pos"), F.col("m.s").alias("score"), F.col("c.chunk").alias("chunk"))
