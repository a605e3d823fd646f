"""Text and hash functions as Spark columns."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of Han, Hiragana, Katakana and Hangul, scripts whose characters are tokens of
#: their own. Plain ranges, as a script test costs a search per character.
CJK = (
    r"\x{1100}-\x{11FF}\x{2E80}-\x{2FD5}\x{3005}\x{3007}\x{3021}-\x{3029}\x{3038}-\x{303B}\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FD}-\x{30FF}"
    r"\x{3131}-\x{318E}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97C}\x{AC00}-\x{D7FB}\x{F900}-\x{FAD9}\x{FF66}-\x{FF6F}\x{FF71}-\x{FF9D}\x{20000}-\x{323AF}"
)


def _plain_letters() -> tuple[str, str]:
    """Letters with diacritics whose base is an ASCII letter, and those bases."""
    marked, bases = [], []
    for code in range(0xC0, min(sys.maxunicode, 0x2000)):
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(c) for c in d[1:]):
            marked.append(chr(code))
            bases.append(d[0].lower())
    return "".join(marked), "".join(bases)


MARKED, BASES = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case, Latin letters without diacritics."""
    low = F.lower(c)
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, MARKED, BASES))


def space_cjk(c: Column) -> Column:
    """A space around each character of a script written without spaces."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(c, f"([{CJK}])", " $1 "))


def tokens(c: Column) -> Column:
    """Index tokens: folded runs of letters and digits; CJK characters one by one. Null gives none."""
    return F.coalesce(F.regexp_extract_all(space_cjk(fold(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def docid(hash_: Column) -> Column:
    """The short id of a content hash: its first six characters."""
    return F.substring(hash_, 1, 6)


def ascii_fold(c: Column) -> Column:
    """Lower case of ASCII letters only, as metadata filters compare."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def capped_body(c: Column, limit: int = 262_144) -> Column:
    """The body, or its first ``limit`` characters if it has more than ``limit`` bytes."""
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.substring(c, 1, limit))


def word_set(c: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def gram_set(c: Column, n: int = 3) -> Column:
    """Distinct character ``n``-grams of the text; a shorter text is its own only gram, an empty one has none."""
    long_ = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(long_)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets (arrays without repeats); 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def normal_query(c: Column) -> Column:
    """Lower case, white space collapsed, without ``/only:`` directives."""
    bare = F.regexp_replace(F.lower(c), r"/only:\S*", " ")
    return F.trim(F.regexp_replace(bare, r"[\s\p{Z}]+", " "))


def rounded(c: Column, digits: int = 2) -> Column:
    """``round(x * 10^d) / 10^d`` on doubles, half up."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def csv_field(c: Column) -> Column:
    """Quoted if the text holds a comma, quote or line feed; quotes doubled."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def xml_text(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def like_escape(c: Column) -> Column:
    """Escapes ``% _ #`` with ``#``."""
    return F.regexp_replace(c, "([%_#])", "#$1")


#: Words that carry no intent.
INTENT_STOP_WORDS = (
    "am an as at be by do he if in is it me my no of on or so to up us we "
    "all and any are but can did for get has her him his how its let may not our out the too was who why you "
    "also does find from have into more need show some tell that them this want what when will with your "
    "about looking notes search where which"
).split()


def intent_terms(c: Column) -> Column:
    """Lower-case words of at least two characters without edge punctuation and stop words, in order."""
    words = F.transform(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(INTENT_STOP_WORDS))


def title_of(text: Column, path: Column) -> Column:
    """First Markdown heading of level one or two (a bare "Notes" is skipped for the next one of level
    two), an Org title or heading, or the file's name without extension."""
    first = F.trim(F.regexp_extract(text, r"(?m)^##?[ \t]+(\S[^\r\n]*)$", 1))
    second = F.trim(F.regexp_extract(text, r"(?m)^##[ \t]+(\S[^\r\n]*)$", 1))
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")
    markdown = F.when(first.isin("Notes", "📝 Notes") & (second != ""), second).when(first != "", first)
    org = F.nullif(F.trim(F.regexp_extract(text, r"(?mi)^#\+TITLE:[ \t]*(\S[^\r\n]*)$", 1)), F.lit(""))
    star = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\*+[ \t]+(\S[^\r\n]*)$", 1)), F.lit(""))
    kind = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.when(kind.isin("md", "markdown", "mdx"), markdown).when(kind == "org", F.coalesce(org, star)), name)


def embedding_query(c: Column, instruct: bool = False) -> Column:
    """The text a query is embedded as."""
    if instruct:
        return F.concat(F.lit("Instruct: Retrieve relevant documents for the given query\nQuery: "), c)
    return F.concat(F.lit("task: search result | query: "), c)


def embedding_document(text: Column, title: Column, instruct: bool = False) -> Column:
    """The text a passage is embedded as."""
    if instruct:
        return F.when(title.isNotNull() & (title != ""), F.concat(title, F.lit("\n"), text)).otherwise(text)
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), text)


#: Words that do not count in :func:`term_jaccard`.
TERM_STOP_WORDS = "the a an is are to for of in and or it this that be with as on by how what do does can you your i".split()


def term_set(c: Column) -> Column:
    """Distinct lower-case words of at least two characters that are no stop words."""
    return F.filter(word_set(c), lambda w: (F.length(w) > 1) & ~w.isin(TERM_STOP_WORDS))


def term_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts by their terms; 0 if either has none."""
    x, y = term_set(a), term_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(jaccard(x, y))


def canonical_json(value) -> str:
    """A parsed JSON value with the keys of objects in order and no white space."""
    import json

    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False)


def canonical_map(c: Column) -> Column:
    """A map of strings as a JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
