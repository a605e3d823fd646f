"""Splitting oversized texts at natural boundaries (problem 4).

A text longer than ``limit`` code points is consumed from left to right by one bounded-quantifier
regular expression. Its alternatives are tried in the order of boundary strength:

1. the rest of the text, if it fits;
2. for heading, blank line, line end, sentence end, space in turn: as much as fits, ending at
   such a boundary and filling at least ``fill`` of the room;
3. any boundary of any strength within the room, however short the piece;
4. if the piece starts at a boundary, any boundary within ``limit``, giving up overlap for that
   piece (a run without boundary that is longer than the room but not than the limit);
5. ``limit - overlap`` characters: a forced cut, only inside a run of more than ``limit``
   characters without a boundary.

The room is ``limit`` for the first piece and ``limit - overlap`` for later ones, whose text then
starts ``overlap`` characters before the consumed part, so consecutive pieces share exactly
``overlap`` characters (fewer only in case 4, or where the text before is shorter).
Everything is evaluated by Spark's own SQL functions.

Defined cases: null and empty texts and texts within the limit give one piece (null text: none)
from :func:`split_texts`; very long texts are cut from end to end; repeated rows are the caller's
to remove; other columns are carried through unless they clash with the output's names, in
which case the output's column wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"(?<=[ \t\r\n])"
_CJK_STOP = r"(?<=[。！？])"
_HEADING = r"(?<=[\r\n])(?=#{1,6}[ \t])"
_BLANK = r"(?<=\n\n|\r\n\r\n|\n[ \t]\n|\r\r)"
_LINE = r"(?:(?<=\n)|(?<=\r)(?!\n))"
_SENTENCE = r"(?:(?<=[.!?…][ \t])|(?<=[.!?…][\"'”’)\]][ \t])|" + _CJK_STOP + ")"
_ANY = r"(?:" + _SPACE + "|" + _CJK_STOP + r")(?!(?<=\r)\n)"
OUTPUT = ["seq", "start", "n_chars", "forced", "piece"]


def piece_pattern(limit: int, overlap: int, fill: float = 0.5) -> str:
    """The extraction pattern; see the module's docstring."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    def at(room: int) -> str:
        low = max(1, int(room * fill))
        ways = [rf".{{1,{room}}}\z"]
        ways += [rf".{{{low},{room}}}{b}" for b in (_HEADING, _BLANK, _LINE, _SENTENCE, _SPACE)]
        ways.append(rf".{{1,{room}}}{_ANY}")
        if room < limit:
            ways.append(rf"(?<=[ \t\r\n。！？]).{{{room + 1},{limit}}}(?:{_ANY}|\z)")
        ways.append(rf".{{1,{limit - overlap}}}")
        return "|".join(ways)

    return rf"(?s)\A(?:{at(limit)})|{at(limit - overlap)}"


def _pieces(text: Column, limit: int, overlap: int, fill: float) -> Column:
    """Array of pieces as (seq, start, n_chars, forced, piece); ``start`` counts from 0."""
    parts = F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap, fill)), F.lit(0))
    # (consumed so far, [(offset, length)])
    walked = F.aggregate(
        F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), (~p.rlike(r"[ \t\r\n。！？]\z")).alias("open"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int,open:boolean>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p["n"].alias("n"), p["open"].alias("open")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def one(p: Column, i: Column) -> Column:
        back = F.least(F.lit(overlap), p["at"], F.lit(limit) - p["n"])
        start = p["at"] - back
        # A cut is forced if neither a boundary character ends the piece nor one starts what follows it,
        # and the text goes on.
        goes_on = (p["at"] + p["n"]) < F.length(text)
        return F.struct(
            i.cast("int").alias("seq"),
            start.cast("int").alias("start"),
            (p["n"] + back).cast("int").alias("n_chars"),
            (goes_on & p["open"]).alias("forced"),
            F.substring(text, start + 1, p["n"] + back).alias("piece"),
        )

    return F.transform(walked, one)


def split_texts(df: DataFrame, text_col: str, limit: int = 3600, overlap: int = 540, fill: float = 0.5) -> DataFrame:
    """One row per piece of ``text_col``: ``seq`` from 0, ``start`` (offset from 0), ``n_chars``,
    ``forced`` (the cut after this piece is inside a run without boundary) and ``piece``, beside
    the other columns of ``df``. No shuffle: each row is split where it lies."""
    text = F.col(f"`{text_col}`")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in {*OUTPUT, text_col}]
    within = F.array(F.struct(F.lit(0).alias("seq"), F.lit(0).alias("start"), F.length(text).cast("int").alias("n_chars"), F.lit(False).alias("forced"), text.alias("piece")))
    made = F.when(F.length(text) > limit, _pieces(text, limit, overlap, fill)).when(text.isNotNull(), within)
    return df.select(*keep, F.explode(made).alias("__p")).select(*keep, "__p.*")


def distinct_bodies(df: DataFrame, hash_col: str, text_col: str, longer_than: int = -1) -> DataFrame:
    """One row per content hash, redelivered rows collapsed; a null hash is replaced by the text's own."""
    text = F.col(text_col)
    long_enough = df.where(F.length(text) > longer_than) if longer_than >= 0 else df.where(text.isNotNull())
    return long_enough.groupBy(F.coalesce(F.col(hash_col), F.sha2(text, 256)).alias("hash")).agg(F.max(text).alias("doc"))


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """``hash, cut`` of each body that was cut: ``forced`` if any cut had to be made inside a run
    without boundary, otherwise ``natural``."""
    return pieces.groupBy("hash").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def rejoined(pieces: DataFrame) -> DataFrame:
    """``hash, n_chars, sha, longest``: the bodies put together again from their pieces without the overlaps."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "start", "n_chars", "piece")))
    whole = pieces.groupBy("hash").agg(parts.alias("p"), F.max("n_chars").alias("longest"))
    end = lambda x: x["start"] + x["n_chars"]
    fresh = F.transform("p", lambda x, i: F.substring(x["piece"], F.when(i == 0, 1).otherwise(end(F.get("p", i - 1)) - x["start"] + 1), x["n_chars"]))
    text = F.array_join(fresh, "")
    return whole.select("hash", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("sha"), (F.col("longest") <= 3600).alias("within"))
