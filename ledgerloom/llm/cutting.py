"""Long texts into overlapping pieces, cut where the topic changes."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKEN, size

LIMIT, OVERLAP = 256, 32
#: Words on either side of a gap whose vocabularies are compared.
BLOCK = 40
#: Fixed value: marks that end a sentence.
SENTENCE_MARKS = frozenset(".!?…。！？؟।")
PARAGRAPH, SENTENCE, WORD_END, INSIDE = 0, 1, 2, 3
KINDS = ("paragraph", "sentence", "word", "inside")


def cohesion(terms: list[str | None], block: int = BLOCK) -> array:
    """At each gap g (before term g; 0 and the end are 1) the cosine of the term counts of ``block`` terms on either side.

    Terms that are None take a place but count nothing. Counts and sums are carried from gap to gap.
    """
    n = len(terms)
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = left_square = right_square = 0
    for t in terms[:block]:
        if t is not None:
            c = right.get(t, 0)
            right_square += 2 * c + 1
            right[t] = c + 1
    found = array("d", [1.0]) * (n + 1)
    for g in range(1, n):
        t = terms[g - 1]
        if t is not None:  # from the right block to the left one
            a, b = left.get(t, 0), right[t]
            dot += b - 1 - a
            right_square -= 2 * b - 1
            left_square += 2 * a + 1
            left[t], right[t] = a + 1, b - 1
        if g > block and (t := terms[g - 1 - block]) is not None:
            a = left[t]
            dot -= right.get(t, 0)
            left_square -= 2 * a - 1
            left[t] = a - 1
        if g + block <= n and (t := terms[g + block - 1]) is not None:
            b = right.get(t, 0)
            dot += left.get(t, 0)
            right_square += 2 * b + 1
            right[t] = b + 1
        found[g] = dot / (left_square * right_square) ** 0.5 if left_square and right_square else 0.0
    return found


def depths(similar: array, block: int = BLOCK) -> array:
    """How deep each gap lies under the highest of the ``block`` gaps before it and of those after it."""
    each = np.frombuffer(similar)
    highest = lambda padding: sliding_window_view(np.pad(each, padding, mode="edge"), block + 1).max(axis=1)
    return array("d", (highest((block, 0)) + highest((0, block)) - 2 * each).tobytes())


def _kind(token: str, between: str) -> int:
    if not between:
        return INSIDE
    if any(mark in between for mark in "\n\r\x85\u2028\u2029"):
        return PARAGRAPH
    return SENTENCE if not SENTENCE_MARKS.isdisjoint(token) else WORD_END


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, int, str]]:
    """(first character, end, size, kind of the cut after it) of each piece of a text, in order.

    Each piece has at most ``limit`` tokens and begins ``overlap`` tokens before the end of the one before. Where a piece
    must end, the deepest valley of cohesion among the natural boundaries in the later half of its window is taken: the ends
    of paragraphs and sentences alike; only where there is none, the ends of words, and only where there are none of these
    either, gaps within a run without spaces. Of equally deep ones the better kind, then the last. No token is cut.
    """
    # arrays, and one string a word: a text of ten million characters takes some 100 MB
    starts, ends, terms, vocabulary = array("q"), array("q"), [], {}
    one = vocabulary.setdefault
    for match in TOKEN.finditer(text):
        first, end = match.span()
        starts.append(first)
        ends.append(end)
        word = text[first:end]
        if word[0].isalnum() or word[0] == "_":
            word = word.lower()
            terms.append(one(word, word))
        else:
            terms.append(None)
    n = len(starts)
    if not n:
        return []
    if n <= limit:
        return [(starts[0], ends[-1], n, "end")]
    deep = depths(cohesion(terms, block), block)
    kind = lambda g: _kind(text[starts[g - 1] : ends[g - 1]], text[ends[g - 1] : starts[g]])
    found = []
    start = fresh = 0
    while start + limit < n:
        lowest, highest = fresh + max(1, (start + limit - fresh) // 2), start + limit
        kinds = [kind(g) for g in range(lowest, highest + 1)]
        natural = max(SENTENCE, min(kinds))
        best = min((-deep[g], k, -g) for g, k in enumerate(kinds, lowest) if k <= natural)
        cut_at, best = best[1], -best[2]
        found.append((starts[start], ends[best - 1], best - start, KINDS[cut_at]))
        fresh, start = best, best - overlap
    found.append((starts[start], ends[-1], n - start, "end"))
    return found


def split(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """The pieces of every text with a size over ``limit``; shorter, empty and null texts give none.

    Columns: doc id, ``piece_no`` from 1, ``first_char`` and ``end_char`` (code points), ``piece_size``, ``cut_at`` (the
    kind of gap after the piece) and ``piece_text``. Sizes are counted in the JVM, so only long texts reach Python; each
    text is handled by itself in time proportional to its length, and nothing is shuffled. Repeated rows are cut each.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    long = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter((F.length("text") > limit) & (size("text") > limit))
    kind = dict(long.dtypes)["doc_id"]

    def pieces(batches):
        for batch in batches:
            rows, columns = [], ([], [], [], [], [], [])
            for row, body in enumerate(batch.column(1).to_pylist()):
                for number, (first, end, amount, cut_at) in enumerate(pieces_of(body, limit, overlap, block), 1):
                    rows.append(row)
                    for into, value in zip(columns, (number, first, end, amount, cut_at, body[first:end])):
                        into.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            arrays = [batch.column(0).take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece_no", "first_char", "end_char", "piece_size", "cut_at", "piece_text"])

    return long.mapInArrow(pieces, f"doc_id {kind}, piece_no int, first_char long, end_char long, piece_size int, cut_at string, piece_text string").withColumnRenamed("doc_id", doc_id)
