"""Substring dedup by relative Lempel-Ziv parsing over words.

Stretches of documents around shared anchors (see ``anchors``) are dealt to
reference blocks so that all places of an anchor meet in one block. A block is
indexed by a suffix array of its words. Every stretch is then factored greedily
against the block: the factor at a place is the longest match that starts
anywhere else in the block. A factor of ``length`` words or more is a duplicate
span, and parsing goes on at the last place whose window crosses the factor's
end, so that windows over a factor boundary are looked up too; a place without
such a factor is passed as a literal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SMALL, SPAN, Repeats, repeated_spans, united
from .common import ROW_KEY, byte_slices, keyed, sized_join

RULE = Repeats(length=35, gram=10, words=True)


def longest_matches(words: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """For each place, the longest match with another place, counted up to at least ``most`` words.

    ``left``: words from a place to the end of its stretch. Ranks of 1, 2, 4, ...
    words give the suffix array; the longest match of a place is with a neighbour.
    """
    n = len(words)
    ranks, width = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while width < most:
        later = np.full(n, -1, np.int64)
        later[:-width or None] = ranks[-1][width:]
        later[left <= width] = -1
        ranks.append(np.unique(ranks[-1] * (n + 1) + later + 1, return_inverse=True)[1])
        width *= 2
    index = np.argsort(ranks[-1], kind="stable")
    a, b, common = index[:-1], index[1:], np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        both = (common < left[a]) & (common < left[b]) & (ranks[level][x] == ranks[level][y])
        common += both * (1 << level)
    common = np.minimum(common, np.minimum(left[a], left[b]))
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def factors(matches: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Greedy parse of one stretch: (start, words) of the factors of at least ``length`` words."""
    long, out, at = np.flatnonzero(matches >= length), [], 0
    while True:
        i = np.searchsorted(long, at)
        if i == len(long):
            return out
        start = int(long[i])
        out.append((start, int(matches[start])))
        at = start + int(matches[start]) - length + 1  # the first window that crosses the factor's end


def shared_spans(table: pa.Table, rule: Repeats) -> pa.Table:
    stretches = [np.frombuffer(x, np.int64) for chunk in table.column("symbols").chunks for x in byte_slices(chunk)]
    sizes = np.array([len(x) for x in stretches])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(ends[-1])
    matches = longest_matches(np.concatenate(stretches), left, rule.length + rule.reach)
    ids, hashes, place = (table.column(c).to_pylist() for c in ("doc_id", "text_hash", "start"))
    known = table.column("whole").to_pylist()
    rows = []
    for s, end in enumerate(ends.tolist()):
        if not known[s]:
            rows += [(ids[s], hashes[s], place[s] + a, place[s] + a + n) for a, n in factors(matches[end - sizes[s] : end], rule.length)]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=SPAN)


def _removed(batches):
    for batch in batches:
        out = []
        for spans, text in zip(batch.column("spans").to_pylist(), byte_slices(batch.column("text"))):
            runs, words, kept, done = united(spans or []), bytes(text).split(), [], 0
            for start, end in runs:
                kept += words[done:start]
                done = end
            kept += words[done:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_word_spans(docs: DataFrame, rule: Repeats = RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, spans of words covered by windows of ``rule.length`` words that also start elsewhere."""
    return repeated_spans(docs, rule, shared_spans, merged=True, key=key, text=text)


def remove_repeated_words(docs: DataFrame, rule: Repeats = RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of other characters than space and U+0009 to U+000D, compared as
    they are. Null texts have no words. Rows that repeat a text of ``rule.length``
    words or more lose all of it, in every copy. Ids may be null or repeated; an
    empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_word_spans(docs, rule, key, text)
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    return sized_join(rows, spans, ROW_KEY, "left", SMALL).mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
