"""Splitting oversized items at natural boundaries with a fixed overlap.

Boundaries carry a strength (block > line > sentence > blank > none). A sparse table over the
boundaries answers "strongest boundary in this window" in constant time, ties going to the right; if
a window holds no boundary the cut falls at the limit. The next piece begins ``overlap`` characters
before the cut.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, LINE, SENTENCE, WORD, CHAR = 4, 3, 2, 1, 0
NAMES = {BLOCK: "block", LINE: "line", SENTENCE: "sentence", WORD: "word", CHAR: "char", -1: "end"}

_LINE = re.compile(r"\r\n|\n|\r")
_OPEN = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_BLANK = re.compile(r"\s+")
_RUN = re.compile(r"\S+")


def lines_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end without line end, start of the next line) of each line."""
    out, at = [], 0
    for m in _LINE.finditer(text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    out.append((at, len(text), len(text)))
    return out


def blocks_of(text: str) -> list[tuple[int, int, bool, list[tuple[int, int]]]]:
    """(start, size with lines joined by LF, fenced, lines) of each block.

    Blocks are runs of non-blank lines; a fenced block is one unit with its blank lines, up to its
    closing fence or the end of the text.
    """
    out, run, fence = [], [], None

    def close(fenced):
        nonlocal run
        if run:
            out.append((run[0][0], sum(e - s for s, e in run) + len(run) - 1, fenced, run))
        run = []

    for start, end, _ in lines_of(text):
        line = text[start:end]
        if fence:
            run.append((start, end))
            bare = line.strip()
            if bare and len(line) - len(line.lstrip(" ")) <= 3 and len(bare) >= len(fence) and not bare.strip(fence[0]):
                close(True)
                fence = None
            continue
        m = _OPEN.match(line) if line.lstrip(" ")[:3] in ("```", "~~~") else None
        if m:
            close(False)
            fence = m[1]
            run.append((start, end))
        elif line.strip():
            run.append((start, end))
        else:
            close(False)
    close(fence is not None)
    return out


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions and their strengths; a cut at p separates text[:p] from text[p:]."""
    strength: dict[int, int] = {}
    for m in _BLANK.finditer(text):
        strength[m.end()] = WORD
    for _, _, after in lines_of(text):
        strength[after] = LINE
    for start, _, fenced, lines in blocks_of(text):
        strength[start] = BLOCK
        if not fenced:
            for s, e in lines:
                for m in _SENTENCE.finditer(text, s, e):
                    if m.end() < e:
                        strength[m.end()] = SENTENCE
    strength.pop(0, None)
    strength.pop(len(text), None)
    at = np.fromiter(strength.keys(), np.int64, len(strength))
    by = np.fromiter(strength.values(), np.int64, len(strength))
    order = np.argsort(at)
    return at[order], by[order]


class RangeMaximum:
    """Sparse table: the strongest boundary among positions lo..hi (inclusive), the rightmost of equals."""

    def __init__(self, at: np.ndarray, by: np.ndarray):
        self.at = at
        self.rows = [by * (len(at) + 1) + np.arange(len(at))]  # one number orders by strength, then place
        while 2 << (len(self.rows) - 1) <= len(at):
            half, row = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.maximum(row[:-half], row[half:]))

    def best(self, lo: int, hi: int) -> tuple[int, int] | None:
        i, j = int(np.searchsorted(self.at, lo)), int(np.searchsorted(self.at, hi, "right"))
        if i >= j:
            return None
        k = (j - i).bit_length() - 1
        row = self.rows[k]
        key = int(max(row[i], row[j - (1 << k)]))
        strength, place = divmod(key, len(self.at) + 1)
        return int(self.at[place]), strength


def unit_ends(text: str) -> tuple[RangeMaximum, list[tuple[int, list[tuple[int, list[int]]]]]]:
    """An index of where the units of a text end, and where they start, line ends being one character.

    The index holds the end of every block, line, sentence and run without blanks under its strength. The
    starts are nested: of each block, with its lines, with their sentences (a fenced line has none).
    """
    text = _LINE.sub("\n", text)
    strength = {m.end(): WORD for m in _RUN.finditer(text)}
    starts = []
    for start, _, fenced, lines in blocks_of(text):
        of_lines = []
        for s, e in lines:
            sentences = [s]
            for m in () if fenced else _SENTENCE.finditer(text, s, e):
                strength[m.start()] = SENTENCE
                sentences.append(m.end())
            strength[e] = LINE
            of_lines.append((s, sentences))
        strength[lines[-1][1]] = BLOCK
        starts.append((start, of_lines))
    at = np.fromiter(strength.keys(), np.int64, len(strength))
    by = np.fromiter(strength.values(), np.int64, len(strength))
    order = np.argsort(at)
    return RangeMaximum(at[order], by[order]), starts


def level(text: str, limit: int) -> str:
    """The coarsest boundary at which every unit of the text keeps to the limit.

    A unit fits if the strongest end within ``limit`` characters of its start is at least of its kind:
    the next end of that kind is its own. Only the lines of blocks that do not fit are looked at, and
    only the sentences of lines that do not.
    """
    index, starts = unit_ends(text)

    def fits(start: int, kind: int) -> bool:
        found = index.best(start, start + limit)  # from the start on, as an empty line in a fence ends there
        return found is not None and found[1] >= kind

    large = [lines for start, lines in starts if not fits(start, BLOCK)]
    if not large:
        return "block"
    if all(fits(s, LINE) or (len(inside) > 1 and all(fits(x, SENTENCE) for x in inside)) for lines in large for s, inside in lines):
        return "line"
    return "word" if all(fits(m.start(), WORD) for m in _RUN.finditer(_LINE.sub("\n", text))) else "char"


def pieces(text: str, limit: int, overlap: int, least: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of consecutive pieces; -1 marks the text's end.

    Every piece has at most ``limit`` characters, consecutive pieces share exactly ``overlap``. The
    window of a cut begins ``least`` characters into the piece, or, if no boundary is there, right after
    the overlap, so a strong boundary near the start does not make a piece that is hardly more than
    overlap. A forced cut does not part a CR from its LF if the window allows it.
    """
    if not 0 <= overlap < limit or not 0 <= least <= limit:
        raise ValueError("overlap must be at least 0 and below the limit, and a piece's least length within it")
    if len(text) <= limit:
        return [(0, len(text), -1)]
    index, out, start = RangeMaximum(*boundaries(text)), [], 0
    while len(text) - start > limit:
        found = least > overlap + 1 and index.best(start + least, start + limit) or index.best(start + overlap + 1, start + limit)
        cut, strength = found or (start + limit, CHAR)
        if not found and text[cut - 1 : cut + 1] == "\r\n" and cut - 1 > start + overlap:
            cut -= 1
        out.append((start, cut, strength))
        start = cut - overlap
    out.append((start, len(text), -1))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 4000, overlap: int = 200, keep_small: bool = False, least: int | None = None) -> DataFrame:
    """(id, item_level, piece_no, start, end, cut, piece) of every item above ``limit`` characters.

    ``item_level`` is the coarsest boundary level that suffices for the whole item, ``cut`` the kind
    of boundary at the piece's end. ``least`` is the length a cut seeks to leave in a piece, a quarter of
    the limit by default. Items within the limit are left out unless ``keep_small``; null
    texts are left out always, the empty text is one empty piece. Equal rows give equal pieces. The
    length test runs in the JVM, so only oversized texts reach Python.
    """

    least = limit // 4 if least is None else least

    @F.pandas_udf("struct<item_level: string, pieces: array<struct<start: int, end: int, cut: string>>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = [
            (level(t, limit) if len(t) > limit else "block", [{"start": s, "end": e, "cut": NAMES[c]} for s, e, c in pieces(t, limit, overlap, least)])
            for t in texts
        ]
        return pd.DataFrame(rows, columns=["item_level", "pieces"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    if not keep_small:
        rows = rows.where(F.length("_text") > limit)
    done = rows.withColumn("_cut", cut("_text"))
    flat = done.select("_id", "_text", F.col("_cut.item_level").alias("item_level"), F.posexplode_outer("_cut.pieces").alias("piece_no", "_p"))
    return flat.select(
        F.col("_id").alias(id_col), "item_level", "piece_no", F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), F.col("_p.cut").alias("cut"),
        F.substring(F.col("_text"), F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start")).alias("piece"),
    )
