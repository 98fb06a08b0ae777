"""SentencePiece segmentations sampled without replacement, and their decoding.

A text's lattice has a node at each character and an edge per piece of the
vocabulary. A segmentation's probability is proportional to the product of its
pieces' weights, which fall with the piece's rank (Zipf). Pieces hold blanks only
in front and no newlines, so the lattice is a chain of cells, each a run of blanks
and what follows; sums of weights from each node to the end of its cell are worked
out once per distinct cell, for as many stretches as a lattice of bounded size holds.
A stretch is short texts together or a part of a long one, so memory does not grow
with a text but for its result.

Gumbel top-k: every segmentation has its log probability plus Gumbel noise, and the k
largest are wanted. A search node is a prefix with some next pieces excluded; its
value is the largest perturbed log probability below it, whose distribution follows
from its mass alone. Best-first search therefore takes the node of the largest
value, draws the rest of that segmentation piece by piece, and splits off, at each
step, the alternatives as one node with a value truncated at the parent's. What is left
on top after k is the threshold of the inclusion scores. Splits behind a prefix of
probability e**-45 are left out: no double could tell them apart. All noise is a
function of the row's key, the sample and the place.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, keyed, release_memory, worker_memory

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 4
STRETCH_BYTES = 256 << 10  # of cells that are drawn together
LATTICE_BYTES = 512 << 10  # of distinct cells, beyond which a lattice is begun anew
BLOCK_CELLS = 1 << 14
SPELL = 1 << 18
FAR = -45.0
U = np.uint64
# Fixed limits of a cell: what runs on longer without a blank is cut there, between two characters.
CELL = re.compile(rb" {0,16384}[^ \n]{1,16380}[\x80-\xbf]{0,3}| {1,16384}|\n")
BLANK_PIECE = "▁"


class Vocabulary:
    """A byte trie of the pieces with their log weights, as arrays."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.bytes: list[bytes] = []
        self.first_byte = next(i for i in range(size) if sp.is_byte(i))
        self.weights = np.zeros(size)
        used = []
        for i in range(size):
            if sp.is_byte(i):
                self.bytes.append(bytes([i - self.first_byte]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(sp.id_to_piece(i).replace(BLANK_PIECE, " ").encode())
                used.append(i)
            self.weights[i] = -np.log(2.0 + min(-sp.get_score(i), size)) if i in used[-1:] else -np.log(2.0 + size)
        self.weights -= np.log(np.exp(self.weights[used]).sum())
        nodes: list[dict] = [{}]
        ends: dict[int, int] = {}
        for i in used:
            node = 0
            for b in self.bytes[i]:
                if b not in nodes[node]:
                    nodes[node][b] = len(nodes)
                    nodes.append({})
                node = nodes[node][b]
            ends[node] = i
        # Nodes with children come first; the others need no row of the table.
        inner = [i for i, children in enumerate(nodes) if children]
        number = np.empty(len(nodes), np.int64)
        number[inner] = np.arange(len(inner))
        number[[i for i, children in enumerate(nodes) if not children]] = np.arange(len(inner), len(nodes))
        self.next = np.zeros((len(inner), 256), np.uint16 if len(nodes) <= 1 << 16 else np.int32)
        for node in inner:
            for b, child in nodes[node].items():
                self.next[number[node], b] = number[child]
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[number[list(ends)]] = list(ends.values())
        self.longest = max(len(self.bytes[i]) for i in used)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), np.int32, size)
        self.places = np.cumsum(self.sizes) - self.sizes


def vocabulary(model: bytes) -> Vocabulary:
    kept = worker_memory()
    if getattr(kept, "model", None) != model:
        kept.model, kept.vocabulary = model, Vocabulary(model)
        release_memory()
    return kept.vocabulary


def cells_of(text: bytes) -> list[bytes]:
    """The text with the blank that the vocabulary expects in front, cut where no piece crosses."""
    return CELL.findall(b" " + text) if text else []


class Lattice:
    """The edges of distinct cells; a place is an index into their bytes, with one more after each cell.

    Stretch after stretch adds the cells that it brings, so common ones are worked
    out once; they are added in blocks that fit a processor's cache. Arrays are longer
    than what is filled of them.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.places = self.edges = 0
        self.buffer, self.low, self.high = np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.start, self.end = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.begin, self.to, self.id, self.p = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The cells of texts as numbers of those held, until the next call."""
        if self.places > LATTICE_BYTES:
            self.clear()
        held = len(self.known)
        numbers = [np.fromiter(map(self.known.__getitem__, cells), np.int64, len(cells)) for cells in texts]
        new = list(itertools.islice(self.known, held, None))
        for i in range(0, len(new), BLOCK_CELLS):
            self._add(new[i : i + BLOCK_CELLS], held + i)
        return numbers

    def _add(self, cells: list[bytes], held: int) -> None:
        buffer, start, end, begin, to, id_, p, low, high = block_edges(cells, self.v, self.places, self.edges)
        for at, parts in (
            (held, {"start": start, "end": end}),
            (self.places, {"buffer": buffer, "low": low, "high": high}),
            (self.edges, {"begin": begin, "to": to, "id": id_, "p": p}),
        ):
            for name, part in parts.items():
                whole = getattr(self, name)
                if at + len(part) > len(whole):
                    whole = np.empty(max(at + len(part), at * 3 // 2), whole.dtype)
                    whole[:at] = getattr(self, name)[:at]
                    setattr(self, name, whole)
                whole[at : at + len(part)] = part
        self.places += len(buffer)
        self.edges += len(begin)


def block_edges(cells: list[bytes], v: Vocabulary, place: int, edge: int) -> tuple[np.ndarray, ...]:
    """What a Lattice holds of some cells, whose first place and edge get the given numbers.

    begin, to, id and p are of edges; edges low to high are a place's.
    """
    buffer = np.frombuffer(b"\0".join(cells) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, cells), np.int32, len(cells))
    start = np.cumsum(sizes + 1, dtype=np.int32) - sizes - 1
    end = start + sizes
    cell = np.repeat(np.arange(len(cells), dtype=np.int32), sizes + 1)
    node = (buffer & 0xC0) != 0x80
    node[start] = True
    node[end] = False
    nodes = np.flatnonzero(node).astype(np.int32)
    stop = end[cell[nodes]]
    following = np.minimum(np.append(nodes[1:], np.int32(len(buffer))), stop)
    single = np.zeros(len(buffer), bool)  # characters that are pieces
    begins, ends, ids = [], [], []
    at, state, bound, one = nodes, np.zeros(len(nodes), v.next.dtype), stop, following
    for t in range(v.longest):
        state = v.next[state, buffer[at + t]]
        found = v.piece[state] >= 0
        begins.append(at[found])
        ends.append(at[found] + np.int32(t + 1))
        ids.append(v.piece[state[found]])
        single[begins[-1][ends[-1] == one[found]]] = True
        alive = (state > 0) & (state < len(v.next)) & (at + t + 1 < bound)
        at, state, bound, one = at[alive], state[alive], bound[alive], one[alive]
        if not len(at):
            break
    # A character that is no piece is spelled in bytes.
    spelled = ~single[nodes]
    begins.append(nodes[spelled])
    ends.append(following[spelled])
    ids.append(np.full(spelled.sum(), -1, np.int32))
    begin, to, id_ = (np.concatenate(x[::-1]) for x in (begins, ends, ids))
    order = np.argsort(begin, kind="stable")  # longest pieces first within a node
    depth = (begin - start[cell[begin]])[order]
    narrow = np.int16 if depth.max() < 1 << 15 else np.int32  # narrow ones sort by radix
    by_depth = np.argsort((-depth).astype(narrow), kind="stable")
    # Edges stand by node, and nodes from the last place of their cells to the first.
    order, depth = order[by_depth], depth[by_depth]
    begin, to, id_ = begin[order], to[order], id_[order]
    weight = np.where(id_ >= 0, v.weights[id_], v.weights[v.first_byte] * (to - begin))
    new = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]])
    stops = np.append(new[1:], len(begin))
    low, high = np.zeros(len(buffer), np.int32), np.zeros(len(buffer), np.int32)
    low[begin[new]], high[begin[new]] = new + edge, stops + edge
    # Log sums of the weights from each place on, depth by depth.
    total, p = np.zeros(len(buffer)), np.empty(len(begin))
    cuts = np.flatnonzero(np.r_[True, np.diff(depth[new]) != 0, True])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        a, b, first = new[i], stops[j - 1], new[i:j] - new[i]
        value, spread = weight[a:b] + total[to[a:b]], stops[i:j] - new[i:j]
        top = np.maximum.reduceat(value, first)
        share = np.exp(value - np.repeat(top, spread))
        sums = np.add.reduceat(share, first)
        total[begin[new[i:j]]] = top + np.log(sums)
        p[a:b] = share / np.repeat(sums, spread)
    return buffer, start + np.int32(place), end + np.int32(place), begin + np.int32(place), to + np.int32(place), id_, p, low, high


def noise(base: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1), a function of 64-bit keys."""
    x = base + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return ((x ^ (x >> U(31))) >> U(12)).astype(np.float64) * 2.0**-52 + 2.0**-53


def walk(lattice: Lattice, at: np.ndarray, stop: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw the pieces from the places ``at`` to the ends of their cells: (edges, cell by cell, and their number per cell)."""
    steps = np.zeros(len(at), np.int64)
    active, drawn, t = np.flatnonzero(at < stop), [], 0
    here = at[active]
    while len(active):
        u = noise(keys[active] + np.array([t], U) * U(0xD1342543DE82EF95))
        edge, last = lattice.low[here], lattice.high[here] - 1
        u -= lattice.p[edge]
        left = np.flatnonzero((u > 0) & (edge < last))
        while len(left):
            edge[left] += 1
            u[left] -= lattice.p[edge[left]]
            left = left[(u[left] > 0) & (edge[left] < last[left])]
        steps[active] += 1
        drawn.append((active, edge))
        here = lattice.to[edge]
        more = here < stop[active]
        active, here, t = active[more], here[more], t + 1
    first = np.cumsum(steps) - steps
    out = np.zeros(int(steps.sum()), np.int32)
    for t, (which, edge) in enumerate(drawn):
        out[first[which] + t] = edge
    return out, steps


def truncated(mass: np.ndarray, u: np.ndarray, most: float) -> np.ndarray:
    """Gumbel values of the log masses, given that they are at most ``most``."""
    return -np.logaddexp(-most, np.log(-np.log(u)) - mass)


class Drawn(NamedTuple):
    """Edges drawn for one text, with their probabilities, and how many edges leave the same node."""

    edges: np.ndarray
    p: np.ndarray
    log_p: np.ndarray
    count: np.ndarray
    ends: np.ndarray  # how many piece numbers stand up to each edge
    ids: np.ndarray


class Search:
    """Best-first search over one document's segmentations, which are drawn stretch by stretch."""

    def __init__(self, seed: int, wanted: int) -> None:
        self.seed, self.wanted, self.heap, self.found = seed, wanted, [], []
        self.value = float(-np.log(-np.log(noise(np.array([seed], U))[0])))

    def key(self, sample: int) -> int:
        return xxhash.xxh64_intdigest(sample.to_bytes(8, "little"), self.seed)

    def start(self) -> bool:
        """Go on with the node of the largest value, which is a place in a cell; its prefix is taken over."""
        self.ids, self.n_ids, self.place, self.before = [], 0, 0, 0.0
        self.cell, self.offset, self.gone = 0, 0, ()
        if self.found:
            if not self.heap:
                return False
            g, parent, self.place, self.n_ids, self.cell, self.offset, self.gone, self.before = heapq.heappop(self.heap)
            self.value, self.ids = -g, [self.found[parent][0][: self.n_ids]]
        self.base, self.fixed, self.far = self.key(len(self.found)), self.place, FAR + self.before
        return True

    def begin(self, lattice: Lattice, cells: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where drawing starts in the stretch whose cells, from the text's cell ``first`` on, are ``cells``: places, ends, keys, and the edge drawn already, if any."""
        low = max(self.cell - first, 0)
        here, forced = lattice.start[cells[low:]].copy(), np.zeros(0, np.int32)
        if self.gone and self.cell >= first:
            node = here[0] + self.offset
            allowed = np.delete(np.arange(lattice.low[node], lattice.high[node], dtype=np.int32), self.gone)
            share = np.cumsum(lattice.p[allowed])
            u = noise(np.array([self.base ^ 0x2545F4914F6CDD1D], U))[0] * share[-1]
            forced = allowed[[min(int(np.searchsorted(share, u)), len(allowed) - 1)]]
            here[0] = lattice.to[forced[0]]
        return here, lattice.end[cells[low:]], U(self.base) + np.arange(first + low, first + len(cells), dtype=U) * U(0x9FB21C651E98DF25), forced

    def add(self, lattice: Lattice, cells: np.ndarray, first: int, drawn: Drawn, steps: np.ndarray) -> None:
        """The segmentation goes on with the edges drawn, ``steps`` of them in each of the last ``len(steps)`` cells of the stretch.

        Alternatives to them become nodes as long as they are not too improbable.
        """
        edges, taken, log_p, count, ends, ids = drawn
        before = self.before + np.cumsum(log_p) - log_p
        near = int(np.searchsorted(-before, -self.far))
        taken, count = taken[:near], count[:near]
        fresh = self.place == self.fixed  # the first edge is the one chosen in place of those gone
        if near and fresh and self.gone:
            taken, count = taken.copy(), count.copy()
            taken[0] += lattice.p[lattice.low[lattice.begin[edges[0]]] + np.array(self.gone)].sum()
            count[0] -= len(self.gone)
        at = np.flatnonzero((count > 1) & (taken < 1.0))
        if len(at):
            sample = len(self.found)
            mass = before[at] + np.log1p(-taken[at])
            keys = U(self.key(sample) ^ 0x5851F42D4C957F2D) + (self.place + at).astype(U) * U(0xD6E8FEB86659FD93)
            values = truncated(mass, noise(keys), self.value)
            most = self.wanted - sample  # more of them cannot be taken, nor be the threshold
            best = np.argpartition(-values, most)[:most] if len(values) > most else np.arange(len(values))
            cell = len(cells) - len(steps) + np.searchsorted(np.cumsum(steps), at[best], side="right")
            for g, i, c in zip(values[best].tolist(), at[best].tolist(), cell.tolist()):
                node = int(lattice.begin[edges[i]])
                gone = (int(edges[i] - lattice.low[node]), *(self.gone if i == 0 and fresh else ()))
                n_ids = self.n_ids + (int(ends[i - 1]) if i else 0)
                heapq.heappush(self.heap, (-g, sample, self.place + i, n_ids, first + c, node - int(lattice.start[cells[c]]), gone, float(before[i])))
        if near < len(edges):
            self.far = np.inf
        self.ids.append(ids)
        self.n_ids += len(ids)
        self.place += len(edges)
        self.before += float(log_p.sum())

    def end(self) -> None:
        self.found.append((np.concatenate(self.ids) if self.ids else np.zeros(0, "<i4"), self.value, self.before))

    @property
    def threshold(self) -> float:
        """The largest value that was not taken."""
        return -self.heap[0][0] if self.heap and len(self.found) >= self.wanted else -np.inf


def draw(lattice: Lattice, parts: list[tuple[Search, np.ndarray, int]]) -> None:
    """Draw on in a stretch: searches with the cells of it that are theirs, and the number of the first in their text."""
    begun = [s.begin(lattice, cells, first) for s, cells, first in parts]
    at, stop, keys = (np.concatenate(x) for x in list(zip(*begun))[:3])
    drawn, steps = walk(lattice, at, stop, keys)
    # A search's edges are the one drawn already, if any, and those of its cells.
    lasts = np.cumsum([len(here) for here, *_ in begun]).tolist()
    cuts = [0, *np.cumsum(steps)[np.array(lasts) - 1].tolist()]
    edges = np.concatenate([x for (*_, forced), low, high in zip(begun, cuts, cuts[1:]) for x in (forced, drawn[low:high])])
    begin, p = lattice.begin[edges], lattice.p[edges]
    log_p, count = np.log(p), lattice.high[begin] - lattice.low[begin]
    ids, ends = ids_of(lattice, edges)
    low = known = 0
    for (s, cells, first), (here, _, _, forced), cell, size in zip(parts, begun, lasts, np.diff(cuts).tolist()):
        own = steps[cell - len(here) : cell]
        if len(forced):
            own = np.r_[own[0] + 1, own[1:]]
        high = low + size + len(forced)
        upto = int(ends[high - 1]) if high else 0
        s.add(lattice, cells, first, Drawn(edges[low:high], p[low:high], log_p[low:high], count[low:high], ends[low:high] - known, ids[known:upto].copy()), own)
        low, known = high, upto


def sample_short(texts: list[bytes], seeds: list[int], lattice: Lattice, k: int) -> list[Search]:
    """The k segmentations of each text, or all if there are fewer."""
    searches = [Search(s, k) for s in seeds]
    cells = lattice.numbers([cells_of(t) for t in texts])
    for sample in range(k):
        going = [(s, c, 0) for s, c in zip(searches, cells) if (not sample or len(c)) and s.start()]
        if any(len(c) for _, c, _ in going):
            draw(lattice, [x for x in going if len(x[1])])
        for s, _, _ in going:
            s.end()
    return searches


def stretches(text: bytes, low: int = 0):
    """(place, cells) of consecutive stretches of a long text, from a cell's place on. A cell's extent shows when another follows."""
    data = memoryview(text)
    while low < len(text):
        cells = CELL.findall(data[low : low + STRETCH_BYTES])
        if low + STRETCH_BYTES < len(text):
            cells.pop()
        yield low, cells
        low += sum(map(len, cells))


def sample_long(text: bytes, seed: int, lattice: Lattice, k: int) -> list[Search]:
    """As ``sample_short`` for one text of any length: each segmentation is drawn stretch by stretch."""
    search, data = Search(seed, k), b" " + text
    places, firsts = [], []  # of the stretches
    for sample in range(k):
        if not search.start():
            break
        i = bisect.bisect_right(firsts, search.cell) - 1 if firsts else 0
        first = firsts[i] if firsts else 0
        for place, cells in stretches(data, places[i] if places else 0):
            if not sample:
                places.append(place)
                firsts.append(first)
            (numbers,) = lattice.numbers([cells])
            draw(lattice, [(search, numbers, first)])
            first += len(cells)
        search.end()
    return [search]


def ids_of(lattice: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece numbers of edges, and how many stand up to each edge; spelled characters give one number per byte."""
    ids = lattice.id[edges]
    spelled = np.flatnonzero(ids < 0)
    if not len(spelled):
        return ids.astype("<i4"), np.arange(1, len(ids) + 1)
    sizes = np.ones(len(ids), np.int64)
    sizes[spelled] = (lattice.to[edges[spelled]] - lattice.begin[edges[spelled]])
    ends = np.cumsum(sizes)
    out = np.repeat(ids, sizes)
    some = sizes[spelled]
    within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
    out[np.repeat(ends[spelled] - some, some) + within] = lattice.buffer[np.repeat(lattice.begin[edges[spelled]], some) + within].astype(np.int32) + lattice.v.first_byte
    return out.astype("<i4"), ends


def bytes_of(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that piece numbers stand for, and how many stand up to each number."""
    sizes = v.sizes[ids]
    ends = np.cumsum(sizes, dtype=np.int64)
    return v.pool[np.repeat(v.places[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text of piece numbers, without the blank in front."""
    return bytes_of(ids, v)[0].tobytes()[1:]


SCHEMA = "doc_id long, text_hash long, sample int, pieces binary, n_pieces long, log_probability double, perturbed double, log_inclusion double, round_trip boolean"


def log_inclusion(log_p: float, threshold: float) -> float:
    """Log probability that a segmentation's perturbed value exceeds the threshold."""
    x = log_p - threshold
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def runs(ends: np.ndarray, size: int):
    """Consecutive ranges of things that together have about ``size``, given their running totals."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + size, side="right")) - 1)
        yield low, high
        low = high


def spells(ids: np.ndarray, text: bytes, v: Vocabulary) -> bool:
    """Whether the piece numbers stand for the text behind a blank; compared part by part."""
    at = -1
    for low in range(0, len(ids), SPELL):
        part = bytes_of(ids[low : low + SPELL], v)[0].tobytes()
        part, at = (part[1:], 0) if at < 0 else (part, at)
        if text[at : at + len(part)] != part:
            return False
        at += len(part)
    return max(at, 0) == len(text)


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]


def _rows(keys, texts: list[bytes], searches: list[Search], v: Vocabulary) -> pa.RecordBatch:
    found = [(key, text, s, i) for key, text, s in zip(keys, texts, searches) for i in range(len(s.found))]
    pieces = [s.found[i][0] for *_, s, i in found]
    counts, right = np.cumsum([0] + [len(x) for x in pieces]), []
    for low, high in runs(counts, SPELL):  # many short texts are spelled at once
        if high - low == 1:
            right.append(spells(pieces[low], found[low][1], v))
            continue
        data, upto = bytes_of(np.concatenate(pieces[low:high]), v)
        upto, data = np.r_[0, upto][counts[low : high + 1] - counts[low]].tolist(), data.tobytes()
        right += [data[x:y][1:] == text for (_, text, _, _), x, y in zip(found[low:high], upto[:-1], upto[1:])]
    rows = [(*key, i + 1, ids.tobytes(), len(ids), s.found[i][2], s.found[i][1], log_inclusion(s.found[i][2], s.threshold), ok) for (key, _, s, i), ids, ok in zip(found, pieces, right)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _samples(model, k: int, seed: int):
    def emit(keys, texts, lattice):
        seeds = [xxhash.xxh64_intdigest(f"{a}/{b}".encode(), seed) for a, b in keys]
        if len(texts) == 1 and len(texts[0]) >= STRETCH_BYTES:
            return _rows(keys, texts, sample_long(texts[0], seeds[0], lattice, k), lattice.v)
        return _rows(keys, texts, sample_short(texts, seeds, lattice, k), lattice.v)

    def run(batches):
        lattice = Lattice(vocabulary(model.value))
        keys, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), byte_slices(batch.column("text"))):
                if keys and size + len(text) >= STRETCH_BYTES:
                    yield emit(keys, texts, lattice)
                    keys, texts, size = [], [], 0
                keys.append((doc_id, text_hash))
                texts.append(bytes(text))
                size += len(text)
        if keys:
            yield emit(keys, texts, lattice)
        keys = texts = batch = lattice = None
        release_memory()

    return run


def _model(docs: DataFrame, model: str):
    with open(model, "rb") as f:  # the driver reads it; executors get the bytes, half a megabyte
        return docs.sparkSession.sparkContext.broadcast(f.read())


def sampled_pieces(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Up to ``samples`` distinct segmentations per row of ``docs``, in order of their perturbed log probabilities.

    ``pieces`` holds 32-bit little-endian piece numbers. ``log_inclusion`` is the log
    probability of being among the samples, given the threshold; 0 if all
    segmentations were returned. Null and empty texts have one segmentation, without
    pieces. Texts may be of any length that a row holds; no piece crosses the cut after
    16 KB without a blank. Rows with equal ids and texts get equal samples. An empty
    table gives an empty result; other columns, whatever their names, are ignored.
    """
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(_samples(_model(docs, model), samples, seed), SCHEMA)


def _decoded(model):
    def run(batches):
        v = vocabulary(model.value)
        for batch in batches:
            texts = [decode(np.frombuffer(p, "<i4"), v).decode("utf-8", "replace") for p in byte_slices(batch.column("pieces"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "sample")), pa.array(texts, pa.string())], names=["doc_id", "text_hash", "sample", "text"])

    return run


def decoded_pieces(sampled: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text_hash, sample, text of sampled pieces."""
    chosen = sampled.select("doc_id", "text_hash", "sample", "pieces")
    return chosen.mapInArrow(_decoded(_model(sampled, model)), "doc_id long, text_hash long, sample int, text string")
