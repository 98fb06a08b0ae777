"""Suffix-array dedup by column-wise construction over many segments.

Documents are reduced to segments around shared anchors (see ``anchors``). The
segments of a block are laid out in columns, aligned at their anchors, and the
collection's Burrows-Wheeler order grows from the last column to the first: each
round inserts one symbol per segment, sorts stably on it, and updates the common
prefix of neighbours from the least common prefix between their former places.
A round reads its column and the state of the round before in sequence and writes
the next state, so a block needs memory for one column of state beside its
symbols. The files between the steps are tables in the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import SMALL, SPAN, Repeats, repeated_spans, united
from .common import ROW_KEY, byte_slices, keyed, sized_join

RULE = Repeats(length=200, gram=40, words=False)
ABSENT = 256  # beyond the ends of a document; equal to nothing


def repeated_windows(columns: np.ndarray, length: int) -> np.ndarray:
    """columns[c, s]: symbol c of segment s. True at [c, s] where the ``length`` symbols from c on also stand at c in another segment."""
    width, n = columns.shape
    hits = np.zeros((width - length + 1, n), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.int32)  # common[i]: of places i - 1 and i
    for c in range(width - 1, -1, -1):
        symbols = columns[c][order]
        moved = np.argsort(symbols, kind="stable")
        placed = symbols[moved]
        alike = np.flatnonzero((placed[1:] == placed[:-1]) & (placed[1:] != ABSENT))
        after = np.zeros(n + 1, np.int32)
        if len(alike):
            between = np.empty(2 * len(alike), np.int64)
            between[::2], between[1::2] = moved[alike] + 1, moved[alike + 1] + 1
            after[alike + 1] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[moved], after
        if c < len(hits):
            long = np.flatnonzero(common >= length)
            hits[c, order[long]] = True
            hits[c, order[long - 1]] = True
    return hits


def shared_spans(table: pa.Table, rule: Repeats) -> pa.Table:
    """Stretches of the segments of one block that are covered by windows shared with another segment."""
    segments = [x for chunk in table.column("symbols").chunks for x in byte_slices(chunk)]
    starts, at = table.column("start").to_numpy(), table.column("anchor_at").to_numpy()
    columns = np.full((rule.reach + rule.length, len(segments)), ABSENT, np.uint16)
    for s, symbols in enumerate(segments):
        left = rule.reach - int(at[s] - starts[s])
        columns[left : left + len(symbols), s] = np.frombuffer(symbols, np.uint8)
    hits = repeated_windows(columns, rule.length)
    hits[:, table.column("whole").to_numpy(zero_copy_only=False)] = False  # known to repeat
    edges = np.zeros((hits.shape[0] + 2, hits.shape[1]), np.int8)
    edges[1:-1] = hits
    edges = np.diff(edges, axis=0).T
    segment, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    place = at[segment] - rule.reach
    ids = table.column("doc_id").take(pa.array(segment)).combine_chunks()
    hashes = table.column("text_hash").take(pa.array(segment)).combine_chunks()
    return pa.table([ids, hashes, pa.array(place + begin), pa.array(place + end - 1 + rule.length)], schema=SPAN)


def _removed(batches):
    for batch in batches:
        out = []
        for spans, text in zip(batch.column("spans").to_pylist(), byte_slices(batch.column("text"))):
            runs, kept, done = united(spans or []), hashlib.sha256(), 0
            for start, end in runs:
                kept.update(text[done:start])
                done = end
            kept.update(text[done:])
            out.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_byte_spans(docs: DataFrame, rule: Repeats = RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, spans of bytes covered by strings of ``rule.length`` bytes that also start elsewhere."""
    return repeated_spans(docs, rule, shared_spans, merged=False, key=key, text=text)


def remove_repeated_bytes(docs: DataFrame, rule: Repeats = RULE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty and lose nothing. Rows that repeat a text of ``rule.length``
    bytes or more lose all of it, in every copy. Ids may be null or repeated; an
    empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_byte_spans(docs, rule, key, text)
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    return sized_join(rows, spans, ROW_KEY, "left", SMALL).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
