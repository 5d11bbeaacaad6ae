"""Cutting oversized items into overlapping pieces at natural boundaries.

Method: the item's code points become one array; the prefix sums of its tokens (runs without
blanks, tabs and line ends) give the sorted offsets at which it may be cut, in classes from
paragraph to blank.  Scripts without blanks pause inside a token: behind their own full stops
and commas, with the quotes and brackets that close there.  Each cut is the last boundary under
the limit, found by binary search in the strongest class that reaches past half the limit; the
next piece starts at the last border that leaves the overlap.  Where a run has no boundary the
cut is hard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANKS = (0x20, 0x09, 0x0A, 0x0D)
#: Marks that end a sentence or a clause, those of them that need no blank behind, and what closes behind them.
_STOPS = tuple(map(ord, ".!?;。！？｡…"))
_PAUSES = tuple(map(ord, ",:，、；："))
_WIDE_STOPS = tuple(map(ord, "。！？｡"))
_WIDE_PAUSES = tuple(map(ord, "，、；："))
_CLOSERS = tuple(map(ord, "\"')]}”’»」』）】〉》"))
CLASSES = ("paragraph", "line", "sentence", "clause", "blank")


_STOP, _PAUSE, _WIDE_STOP, _WIDE_PAUSE, _CLOSER, _BLANK = 1, 2, 4, 8, 16, 32
#: What each code point of the basic plane is (the others are none of these).
_KIND = np.zeros(0x10000, np.uint8)
for _flag, _marks in ((_STOP, _STOPS), (_PAUSE, _PAUSES), (_WIDE_STOP, _WIDE_STOPS), (_WIDE_PAUSE, _WIDE_PAUSES), (_CLOSER, _CLOSERS), (_BLANK, _BLANKS)):
    _KIND[list(_marks)] |= _flag


def tokens(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without blanks."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], (kind & _BLANK) > 0, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def boundaries(code: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Borders at which a piece may start, and the offsets at which each class allows a cut."""
    breaks = (code == 0x0A) | ((code == 0x0D) & np.append(code[1:] != 0x0A, True))
    total = np.concatenate(([0], np.cumsum(breaks)))
    gap = np.append(total[starts[1:]], total[-1]) - total[ends]  # line ends between a token and the next
    open_at = np.flatnonzero(np.append((kind & _CLOSER) == 0, True))

    def behind(flag: int) -> np.ndarray:
        """Offsets behind each such mark and the closing quotes and brackets that follow it."""
        return open_at[np.searchsorted(open_at, np.flatnonzero(kind & flag) + 1)]

    wide_stops, wide_pauses = behind(_WIDE_STOP), behind(_WIDE_PAUSE)
    stops = np.union1d(np.intersect1d(behind(_STOP), ends), wide_stops)
    pauses = np.union1d(np.intersect1d(behind(_PAUSE), ends), wide_pauses)
    inner = np.union1d(wide_stops, wide_pauses)
    return np.union1d(starts, np.setdiff1d(inner, ends)) if len(inner) else starts, [ends[gap >= 2], ends[gap >= 1], stops, pauses, ends]


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, str]], int]:
    """Pieces (start, end, kind of cut at the end) of ``text`` by code points, and its longest unbroken run.

    Outer blanks, tabs and line ends belong to no piece; an empty or blank text has no pieces.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind_of = _KIND[np.minimum(code, 0xFFFF)]
    starts, ends = tokens(kind_of)
    if not len(starts):
        return [], 0
    longest = int((ends - starts).max())
    at, stop, pieces, done = int(starts[0]), int(ends[-1]), [], 0
    if stop - at > limit:
        starts, classes = boundaries(code, kind_of, starts, ends)
    while stop - at > limit:
        cut, kind = at + limit, "hard"
        for name, ok in zip(CLASSES, classes):
            i = int(np.searchsorted(ok, at + limit, "right")) - 1
            if i >= 0 and ok[i] > max(done, at + (limit // 2 if name != "blank" else overlap)):
                cut, kind = int(ok[i]), name
                break
        pieces.append((at, cut, kind))
        i = int(np.searchsorted(starts, cut - overlap, "right")) - 1
        back = int(starts[i]) if i >= 0 else at
        if overlap == 0:
            i = int(np.searchsorted(starts, cut, "left"))
            back = int(starts[i]) if kind != "hard" and i < len(starts) else cut
        else:
            i = int(np.searchsorted(ends, cut, "right"))
            stuck = i < len(ends) and ends[i] > back + limit and ends[i] <= cut - overlap + limit
            if back <= at or stuck or cut - back > 2 * overlap:
                back = cut - overlap  # no border near, or the next token wouldn't fit: step back by exactly the overlap
        at, done = back, cut
    pieces.append((at, stop, "end"))
    return pieces, longest


def split_items(items: DataFrame, keys: list[str], text: str, *, limit: int, overlap: int, with_text: bool = False) -> DataFrame:
    """One row per piece: ``keys, piece_no, n_pieces, start_char, end_char, cut, n_chars, longest_run[, piece]``.

    Offsets count code points of the original text from 0; pieces hold at most ``limit`` of
    them, and consecutive pieces share at least ``overlap``.  ``cut`` names the boundary the
    piece ends at (paragraph, line, sentence, clause, blank, hard, or end).  ``n_chars`` is the length
    without outer blanks, ``longest_run`` that of the longest run without a boundary.  An item
    within the limit is one piece; null, empty and blank items have none.  Repeated rows repeat.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows, cols, words = [], [[] for _ in range(7)], []
            for r, t in enumerate(texts):
                if not t:
                    continue
                pieces, longest = split_text(t, limit, overlap)
                for i, (a, b, kind) in enumerate(pieces):
                    rows.append(r)
                    for c, v in zip(cols, (i, len(pieces), a, b, kind, pieces[-1][1] - pieces[0][0], longest)):
                        c.append(v)
                    if with_text:
                        words.append(t[a:b])
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            take = pa.array(rows, pa.int64())
            out = [batch.column(i).take(take) for i in range(batch.num_columns - 1)] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = [*keys, "piece_no", "n_pieces", "start_char", "end_char", "cut", "n_chars", "longest_run"]
            if with_text:
                out, names = [*out, pa.array(words, pa.string())], [*names, "piece"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", piece_no int, n_pieces int, start_char int, end_char int, cut string, n_chars int, longest_run int" + ", piece string" * with_text
    return items.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
