"""Splitting oversized texts at natural boundaries, with overlap.

Dynamic programming over boundary positions minimises cut penalties and size imbalance, subject to the maximum
length and to the overlap: where a piece begins is fixed by the cut before it, so its overlap counts towards its
length. A cut inside a word or token run is possible only where no boundary helps within the maximum length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1600
OVERLAP = 200

# How natural a cut is, from best to worst.
LEVELS = ("end", "section", "paragraph", "line", "sentence", "clause", "word", "hard")
PENALTY = {"end": 0.0, "section": 0.0, "paragraph": 0.3, "line": 1.0, "sentence": 2.0, "clause": 5.0, "word": 9.0, "hard": 100.0}

_COARSE = re.compile(
    r"(?P<section>\n\s*\n(?=\#{1,6}\s|=+[^=\n]|<h[1-6]\b|\\(?:sub)*section))"
    r"|(?P<paragraph>\n[^\S\n]*\n\s*)"
    r"|(?P<line>\n)"
    r"|(?P<sentence>[.!?…]+[\"'”’)\]]*[^\S\n]+|[。！？]+)"
)
_FINE = re.compile(r"(?P<clause>[;,:][^\S\n]+|[；，、])|(?P<word>\s+)")
#: The characters beside which a cut is natural.
_NATURAL = re.compile(r"[\s.!?;,。！？；，、]")
#: Stretches without a sentence end that are longer than this part of the limit offer clauses and words, too.
FINE_PART = 0.25
#: Weight of size imbalance against cut penalties.
BALANCE = 8.0


def boundaries(text: str, limit: int, room: int | None = None) -> tuple[list[int], list[str]]:
    """Positions at which ``text`` may be cut, 0 and its length included, and their levels; no gap is above ``limit``.

    Stretches that no boundary helps are cut every ``room`` code points, which leaves space for an overlap.
    """
    n = len(text)
    room = limit if room is None else room
    coarse = [(m.end(), m.lastgroup) for m in _COARSE.finditer(text) if 0 < m.end() < n]
    coarse.append((n, "end"))
    at, level = [0], ["end"]
    last = 0
    for pos, kind in coarse:
        if pos - last > limit * FINE_PART:
            finer = [(m.end(), m.lastgroup) for m in _FINE.finditer(text, last, pos) if last < m.end() < pos]
            for p, k in finer:
                if p - at[-1] > limit:
                    _fill(text, p, limit, room, at, level)
                at.append(p)
                level.append(k)
        if pos - at[-1] > limit:
            _fill(text, pos, limit, room, at, level)
        at.append(pos)
        level.append(kind)
        last = pos
    return at, level


def _fill(text: str, stop: int, limit: int, room: int, at: list[int], level: list[str]) -> None:
    """Appends positions until ``stop`` is within ``limit`` of the last one: beside a natural character, else hard."""
    hard = False
    while stop - at[-1] > (room if hard else limit):
        a = at[-1]
        b = a + limit
        best = 0
        for m in _NATURAL.finditer(text, a, min(b + 1, stop)):
            p = m.end() if m.end() <= b else m.start()
            if a < p < stop:
                best = p
        hard = not best
        at.append(best or a + room)
        level.append("hard" if hard else "word")


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces of ``text`` as (start, end, level of the cut at the end), each at most ``limit`` code points.

    A piece begins at the first natural boundary among the last ``overlap`` code points before the cut, or where none is
    there, exactly ``overlap`` before it. Less than that is allowed only to a piece without any boundary inside that is too long
    for it: it takes the overlap that fits within the limit. Each piece without its overlap follows the one before, so
    the text can be put together again. A text within the limit, the empty one included, is one piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    at, level = boundaries(text, limit, max(1, limit - overlap))
    starts = [0] + [_overlap_start(text, p - overlap, p) for p in at[1:]]
    pieces = -(-max(1, n - overlap) // max(1, limit - overlap))
    ideal = (n + (pieces - 1) * overlap) / pieces
    cost = [0.0] + [float("inf")] * (len(at) - 1)
    back = [0] * len(at)
    first = 0
    for j in range(1, len(at)):
        pj = at[j]
        while first < j - 1 and pj - starts[first] > limit:
            first += 1
        best, arg = float("inf"), first
        for i in range(first, j):
            size = pj - starts[i]
            if size > limit:
                if i < j - 1:
                    continue
                size = limit  # no boundary inside: the overlap is what is left
            off = (size - ideal) / ideal
            c = cost[i] + BALANCE * off * off
            if c < best:
                best, arg = c, i
        cost[j] = best + PENALTY[level[j]]
        back[j] = arg
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    out, i = [], 0
    for j in reversed(cuts):
        begin = starts[i] if at[j] - starts[i] <= limit else _overlap_start(text, at[j] - limit, at[i])
        out.append((begin, at[j], level[j]))
        i = j
    return out


def _overlap_start(text: str, lowest: int, end: int) -> int:
    """The first natural boundary from ``lowest`` on with text between it and ``end``, else ``lowest``."""
    lowest = max(lowest, 0)
    if lowest >= end or lowest == 0 or _NATURAL.match(text, lowest - 1):
        return min(lowest, end)
    m = _NATURAL.search(text, lowest, end)
    return m.end() if m and text[m.end() : end].strip() else lowest


def split_texts(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_content: bool = False) -> DataFrame:
    """(key, pieces) with ``pieces`` an array of (start, end, cut[, content]) in code points, in order, for every row of ``rows``.

    Null texts have null pieces. Texts within the limit are answered in the JVM; longer ones go to Python in Arrow
    batches, whole. Nothing is shuffled; repeated keys give repeated rows; other columns are dropped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    kind = f"array<struct<start:int,end:int,cut:string{',content:string' if with_content else ''}>>"
    one = [F.lit(0).alias("start"), F.char_length(text).alias("end"), F.lit("end").alias("cut"), *([F.col(text).alias("content")] if with_content else [])]
    short = rows.where(F.col(text).isNull() | (F.char_length(text) <= limit)).select(key, F.when(F.col(text).isNotNull(), F.array(F.struct(*one))).cast(kind).alias("pieces"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                yield pd.DataFrame({key: part[key], "pieces": [[{"start": s, "end": e, "cut": c, **({"content": t[s:e]} if with_content else {})} for s, e, c in cut(t, limit, overlap)] for t in part[text]]})

    long = rows.where(F.char_length(text) > limit).select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, pieces {kind}")
    return short.unionByName(long)


def piece_texts(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, end, cut, content) of every piece of the non-null texts; repeated keys give repeated rows."""
    return split_texts(rows, key, text, limit, overlap, with_content=True).select(key, F.posexplode("pieces").alias("piece", "p")).select(key, "piece", "p.*")


def put_together(pieces: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, rebuilt, fits, overlapping) from ``pieces(key, pieces)`` with contents: the text put together again, whether all pieces
    are within the limit, and whether every piece but the first repeats 1 to ``overlap`` code points of the one before; none only if it is as long as allowed."""
    p = F.col("pieces")
    longest = lambda i: F.get(p, i)["end"] - F.get(p, i)["start"] == limit
    fresh = F.transform(p, lambda x, i: F.when(i == 0, x["content"]).otherwise(F.substring(x["content"], F.get(p, i - 1)["end"] - x["start"] + 1, F.char_length(x["content"]))))
    shares = F.transform(p, lambda x, i: F.when(i == 0, True).otherwise((F.get(p, i - 1)["end"] - x["start"]).between(0 if overlap < 1 else F.when(longest(i), 0).otherwise(1), overlap)))
    return pieces.where("pieces is not null").select(
        key, F.array_join(fresh, "").alias("rebuilt"), F.forall(p, lambda x: (F.char_length(x["content"]) <= limit) & (F.char_length(x["content"]) == x["end"] - x["start"])).alias("fits"),
        F.forall(shares, lambda ok: ok).alias("overlapping"),
    )
