"""Virtual paths, document ids, globs and slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "skein://"


def virtual_path(collection: Column, path: Column, scheme: str = SCHEME) -> Column:
    return F.concat(F.lit(scheme), collection, F.lit("/"), path)


def display_path(collection: Column, path: Column) -> Column:
    return F.concat(collection, F.lit("/"), path)


def normal_virtual(c: Column, scheme: str = SCHEME) -> Column:
    """``scheme`` with any number of slashes, or a bare ``//``, becomes ``scheme`` once."""
    name = scheme.rstrip("/")
    return F.regexp_replace(F.regexp_replace(c, f"^{re.escape(name)}/+", scheme), "^//+", scheme)


def virtual_parts(c: Column, scheme: str = SCHEME) -> Column:
    """(collection, path, index) of a virtual path; null if it is none."""
    p = normal_virtual(c, scheme)
    pattern = rf"^{re.escape(scheme)}([^/?]+)/?([^?]*)(?:\?index=(.*))?$"
    part = lambda i: F.regexp_extract(p, pattern, i)
    return F.when(p.rlike(pattern), F.struct(part(1).alias("collection"), part(2).alias("path"), F.nullif(part(3), F.lit("")).alias("index")))


def encode_path(c: Column) -> Column:
    """Percent-encoding of path segments; slashes stay, a space becomes ``%20``."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def normal_docid(c: Column) -> Column:
    """Without quotes and a leading ``#``."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")), "^#", "")


def is_docid(c: Column) -> Column:
    return normal_docid(c).rlike("^[0-9a-fA-F]{6,}$")


def split_masks(mask: str) -> list[str]:
    """Comma-separated globs; commas inside braces or brackets belong to their glob."""
    out, depth, now = [], 0, ""
    for ch in mask:
        depth += (ch in "{[") - (ch in "}]" and depth > 0)
        if ch == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [m for m in (*out, now.strip()) if m]


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ``*``, ``?``, ``**``, ``[...]`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**/", i):
            out += r"(?:[^/]+/)*"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "{":
            out += "(?:"
            depth += 1
        elif ch == "}" and depth:
            out += ")"
            depth -= 1
        elif ch == "," and depth:
            out += "|"
        elif ch == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(ch)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    if not globs:
        return F.lit(False)
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g))
    return hit


#: Folders that a scan never enters (fixed values).
EXCLUDED_DIRS = ["node_modules", ".git", ".cache", "vendor", "dist", "build"]


def scannable(path: Column, ignore: list[str] = ()) -> Column:
    """No excluded folder, no hidden segment, no ignore rule."""
    dirs = "|".join(re.escape(d) for d in EXCLUDED_DIRS)
    return ~path.rlike(rf"(^|/)({dirs})(/|$)") & ~path.rlike(r"(^|/)\.") & ~matches_any(path, list(ignore))


def slug(path: Column) -> Column:
    """A path in which runs of other characters than letters, digits and ``$`` are one hyphen and symbols (emoji) their
    hexadecimal code points; ``___`` separates folders; case and extension stay."""
    parted = F.split(F.replace(path, F.lit("___"), F.lit("/")), "/")
    symbol = r"[\p{So}\p{Sk}]"

    def coded(segment: Column) -> Column:
        apart = F.regexp_replace(F.regexp_replace(segment, r"(\p{So})\p{Mn}", "$1"), rf"({symbol})(?={symbol})", "$1-")
        chars = F.regexp_extract_all(apart, F.lit("(?s)."), F.lit(0))
        return F.when(segment.rlike(symbol), F.array_join(F.transform(chars, lambda c: F.when(c.rlike(symbol), F.lower(F.hex(F.ascii(c)))).otherwise(c)), "")).otherwise(segment)

    def clean(segment: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(segment, r"[^\p{L}\p{N}$]+", "-"), "^-+|-+$", "")

    n = F.size(parted)
    last = coded(F.element_at(parted, -1))
    ext = F.regexp_extract(last, r"(\.[A-Za-z0-9]+)$", 1)
    stem = F.when(ext != "", F.substring(last, F.lit(1), F.length(last) - F.length(ext))).otherwise(last)
    folders = F.filter(F.transform(F.slice(parted, F.lit(1), n - 1), lambda x: clean(coded(x))), lambda x: x != "")
    return F.array_join(F.concat(folders, F.array(F.concat(clean(stem), ext))), "/")


def paths_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's suffix at a slash; case, scheme and leading slashes aside."""
    plain = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "^[a-z]+://", "")), "^/+", "")
    x, y = plain(a), plain(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x))
