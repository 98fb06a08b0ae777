"""Token counts that follow edits.

A byte-pair vocabulary merges within pre-tokens, so a text's count is the sum over
its pre-tokens. Each document keeps a segment tree whose leaves stand for LEAF
pre-tokens, with their characters and tokens, and whose inner nodes hold sums. The
edits of a text are worked off from left to right. The first of a region finds its
leaf by descending on the character sums. Pre-tokens are split anew from CONTEXT
pre-tokens before it, since a pre-token can depend on what follows it, until a
boundary behind an edit is the start of an old leaf and the next edit is not near;
from there on both texts are split alike. Only the leaves in between are encoded anew,
into leaves of LEAF pre-tokens, and only their ancestors' sums change; a region that
needs more leaves than it had has the tree laid out again, without encoding the rest.

Trees are a table, some bytes per leaf. Texts are read again only for documents
that have edits.
"""

from __future__ import annotations

import base64
import bisect
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, byte_slices, keyed, sized_join, stored, worker_memory

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32
CONTEXT = 2
AHEAD = 64  # characters read behind a place to see whether a pre-token ends there
NEAR = 2000  # characters in which more than CONTEXT pre-tokens are looked for
CACHED = 1 << 20
# Edits of redaction(): what is replaced, and by what.
REDACTED = (
    (r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+", "<email>"),
    (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", "<address>"),
    (r"(?<!\w)\+?\d[\d ()-]{7,18}\d(?!\w)", "<number>"),
)


class Counter(dict):
    """Tokens of a pre-token, remembered up to a number of entries."""

    def __init__(self, ranks: bytes) -> None:
        super().__init__()
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        n = self[token] = len(self.encoding.encode_ordinary(token))
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


def counter(ranks: bytes) -> Counter:
    kept = worker_memory()
    if getattr(kept, "ranks", None) != ranks:
        kept.ranks, kept.counter = ranks, Counter(ranks)
    return kept.counter


class Tree:
    """Sums of characters and tokens over the leaves; node i has the children 2 i and 2 i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = len(chars)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + self.n, 0] = chars
        self.sums[self.width : self.width + self.n, 1] = tokens
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, i: int) -> tuple[int, int]:
        return int(self.sums[self.width + i, 0]), int(self.sums[self.width + i, 1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) for a character; the last leaf that has some for the end of the text."""
        at, node, before = max(0, min(at, self.chars - 1)), 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if at >= before + left:
                before += left
                node += 1
        return node - self.width, before

    def set(self, places: np.ndarray, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New values of some leaves; the sums above them follow, level by level."""
        node = self.width + places
        self.sums[node, 0], self.sums[node, 1] = chars, tokens
        while len(node) and node[0] > 1:
            node = np.unique(node // 2)
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        own = self.sums[self.width : self.width + self.n]
        return own[:, 0].astype(np.int32), own[:, 1].astype(np.int32)


def build(text: str, count: Counter) -> Tree:
    return _tree(count.split(text), count)


def _tree(tokens: list[str], count: Counter) -> Tree:
    starts = np.arange(0, len(tokens), LEAF)
    if not len(starts):
        return Tree(np.zeros(1, np.int64), np.zeros(1, np.int64))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    counts = np.fromiter(map(count.__getitem__, tokens), np.int64, len(tokens))
    return Tree(np.add.reduceat(lengths, starts), np.add.reduceat(counts, starts))


def in_leaves(lengths: list[int], counts: list[int]) -> tuple[list[int], list[int]]:
    """Characters and tokens of the leaves for pre-tokens of these lengths and counts."""
    first = range(0, len(lengths), LEAF)
    return [sum(lengths[i : i + LEAF]) for i in first], [sum(counts[i : i + LEAF]) for i in first]


def regions(tree: Tree, text: str, after: str, chosen: list[tuple[int, int, str]], count: Counter):
    """(first leaf, leaf behind the last, characters and tokens of the leaves in their place, pre-tokens encoded) of each region that edits touch."""
    starts = np.concatenate([[0], np.cumsum(tree.leaves()[0], dtype=np.int64)])
    edit_starts, edit_ends = (np.array([c[i] for c in chosen]) for i in (0, 1))
    shift = np.cumsum([0] + [len(new) - (end - start) for start, end, new in chosen])
    # Where the old leaves begin in the new text, if no edit crosses their start; before that stand so many edits.
    before = np.searchsorted(edit_starts, starts)
    whole = (before == 0) | (edit_ends[before - 1] <= starts)
    moved, starts, before, whole = (x.tolist() for x in (starts + shift[before], starts, before, whole))
    limits = [*edit_starts.tolist(), None]
    e = done = 0
    while e < len(chosen):
        start = chosen[e][0]
        first = max(done, tree.find(max(0, start - 1))[0])
        while first > done and len(count.split(text[starts[first] : start])) <= CONTEXT:
            first -= 1
        leaf, found, at = first + 1, [], moved[first]
        while True:
            while leaf < tree.n and (moved[leaf] <= at or before[leaf] <= e or not whole[leaf]):
                leaf += 1
            target = moved[leaf] if leaf < tree.n else len(after)
            until = min(len(after), max(target, at) + AHEAD)
            some = count.pattern.findall(after, at, until)
            if until < len(after) and some:
                some.pop()  # it may go on
            ends = list(itertools.accumulate(map(len, some), initial=at))
            place = bisect.bisect_left(ends, target)
            if place < len(ends) and ends[place] == target:
                found += some[:place]
                at = target
                if leaf == tree.n:
                    break
                following = limits[before[leaf]]
                if following is None or len(count.split(text[starts[leaf] : min(following, starts[leaf] + NEAR)])) > CONTEXT:
                    break
            else:  # no boundary there
                found += some
                at = ends[-1]
            leaf += 1 if leaf < tree.n else 0
        lengths, counts = list(map(len, found)), list(map(count.__getitem__, found))
        yield first, leaf, *in_leaves(lengths, counts), len(lengths)
        e, done = before[leaf] if leaf < tree.n else len(chosen), leaf


@dataclass(frozen=True)
class Edited:
    tree: Tree
    text: str
    encoded: int
    applied: int


def apply(tree: Tree, text: str, edits: list[dict], count: Counter) -> Edited:
    """Edits name characters of the text as it was; of overlapping ones the first stands."""
    chosen, free = [], 0
    for e in sorted(edits, key=lambda e: (e["start"], e["end"], e["replacement"] or "")):
        start, end = max(0, e["start"]), min(len(text), e["end"])
        if start >= free and start <= end:
            chosen.append((start, end, e["replacement"] or ""))
            free = max(end, start + 1)
    pieces, at = [], 0
    for start, end, new in chosen:
        pieces += [text[at:start], new]
        at = end
    after = "".join(pieces) + text[at:]
    if not chosen:
        return Edited(tree, after, 0, 0)
    touched = np.unique(np.searchsorted(np.cumsum(tree.leaves()[0]), [c[0] for c in chosen]))
    if not text or 2 * len(touched) > tree.n > 8:  # most leaves are new anyway
        fresh = count.split(after)
        return Edited(_tree(fresh, count), after, len(fresh), len(chosen))
    found = list(regions(tree, text, after, chosen, count))
    encoded = sum(r[4] for r in found)
    if all(len(chars) <= stop - first for first, stop, chars, _, _ in found) and len(after) * 2 > len(text):
        places = np.concatenate([np.arange(first, stop) for first, stop, *_ in found])
        filled = [[x for r in found for x in r[i] + [0] * (r[1] - r[0] - len(r[i]))] for i in (2, 3)]
        tree.set(places, *map(np.array, filled))
        return Edited(tree, after, encoded, len(chosen))
    old, parts_, at = tree.leaves(), [], 0
    for first, stop, *own, _ in found:
        parts_ += [tuple(x[at:first] for x in old), tuple(np.array(x, np.int64) for x in own)]
        at = stop
    parts_.append(tuple(x[at:] for x in old))
    chars, tokens = (np.concatenate(x) for x in zip(*parts_))
    some = chars > 0
    return Edited(Tree(chars[some], tokens[some]) if some.any() else build("", count), after, encoded, len(chosen))


def _ranks(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:  # the driver reads it; executors get the 1 MB of bytes
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _trees(ranks):
    def run(batches):
        count = counter(ranks.value)
        for batch in batches:
            leaves = [build(bytes(t).decode("utf-8", "replace"), count).leaves() for t in byte_slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([c.tobytes() for c, _ in leaves], pa.binary()), pa.array([t.tobytes() for _, t in leaves], pa.binary()), pa.array([int(t.sum()) for _, t in leaves], pa.int64())], names=["doc_id", "text_hash", "leaf_chars", "leaf_tokens", "n_tokens"])

    return run


TREES = "doc_id long, text_hash long, leaf_chars binary, leaf_tokens binary, n_tokens long"


def build_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per row of ``docs`` with its leaves and its number of tokens; null texts have none."""
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(_trees(_ranks(docs, vocabulary)), TREES)


def _apply(ranks):
    def run(batches):
        count = counter(ranks.value)
        for batch in batches:
            out = []
            chars, tokens, edits = (batch.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens", "edits"))
            for c, t, e, text in zip(chars, tokens, edits, byte_slices(batch.column("text"))):
                tree = Tree(np.frombuffer(c, np.int32), np.frombuffer(t, np.int32))
                done = apply(tree, bytes(text).decode("utf-8", "replace"), e, count)
                leaves = done.tree.leaves()
                out.append((leaves[0].tobytes(), leaves[1].tobytes(), done.tree.tokens, done.applied, done.encoded, done.text))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=["doc_id", "text_hash", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "n_encoded", "text"])

    return run


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Edited documents: row key (of the text before), new leaves, n_tokens, n_edits, n_encoded, text.

    ``trees`` is stored. ``edits``: doc_id, text_hash, start, end (characters), replacement
    (null deletes); of overlapping edits the first stands. One row per row of ``docs`` with edits.
    """
    gathered = edits.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    known = sized_join(trees, stored(gathered, "edits"), ROW_KEY, "inner").dropDuplicates(ROW_KEY).drop("n_tokens")
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    changed = sized_join(rows, stored(known, "edits-trees"), ROW_KEY, "inner")
    return changed.mapInArrow(_apply(_ranks(docs, vocabulary)), TREES + ", n_edits long, n_encoded long, text string")


def _redactions(batches):
    patterns = [(regex.compile(p), new) for p, new in REDACTED]
    for batch in batches:
        out = []
        for doc_id, text_hash, data in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), byte_slices(batch.column("text"))):
            text, seen = bytes(data).decode("utf-8", "replace"), set()
            for pattern, new in patterns:
                if new == "<email>" and "@" not in text:
                    continue
                for m in pattern.finditer(text):
                    if m.span() not in seen:
                        seen.add(m.span())
                        out.append((doc_id, text_hash, m.start(), m.end(), new))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_hash", "start", "end", "replacement"])


def redactions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edits that replace e-mail addresses, network addresses and long numbers."""
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(_redactions, "doc_id long, text_hash long, start long, end long, replacement string")


def counts_after(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_edits, n_encoded, n_tokens_after, text_hash.

    ``n_encoded`` counts the pre-tokens that edits had encoded anew. Null texts are
    empty. Ids may be null or repeated: edits belong to an id and a text. A text and its
    edits are held by the task that reads it. Empty tables give empty results; other
    columns, whatever their names, are ignored.
    """
    trees = stored(build_trees(docs, key, text, vocabulary), "token-trees")
    changed = apply_edits(docs, trees, edits, key, text, vocabulary)
    after = changed.select(*ROW_KEY, F.col("n_tokens").alias("n_tokens_after"), "n_edits", "n_encoded").dropDuplicates(ROW_KEY)
    found = sized_join(trees.select(*ROW_KEY, "n_tokens"), stored(after, "token-counts"), ROW_KEY, "left")
    zero = F.lit(0).cast("long")
    return found.select("doc_id", "n_tokens", F.coalesce("n_edits", zero).alias("n_edits"), F.coalesce("n_encoded", zero).alias("n_encoded"), F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"), "text_hash")
