"""SimHash near-dedup with vantage-point trees.

Fingerprints link when they differ in at most ``distance`` bits. The 64 bits are
cut into ``views``; linked fingerprints differ in at most ``distance // views``
bits of one view, so each view has its own trees with that smaller radius.

A tree splits fingerprints by their Hamming distance, on the view's bits, from a
vantage point: within the split radius or beyond. By the triangle inequality a
fingerprint can have partners on the other side only if its own distance is within
the search radius of the boundary. The top levels of a tree, grown on a bounded
sample, deal fingerprints to shards; each fingerprint lives in one shard and is
sent as a query to the shards whose boundary it overlaps. A shard grows its own
tree and compares what shares a leaf on all 64 bits.

Rows with equal fingerprints travel once. A shard returns a spanning forest of its
links, so a large group gives as many edges as fingerprints, and branches whose
fingerprints are connected already are passed over. Forests are joined by star
contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, byte_slices, keep_rows, keyed, release_memory, sized_join, stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
# Bits of the views: with three, linked fingerprints differ in at most one bit of some view.
VIEWS = ((0, 22), (22, 43), (43, 64))
SAMPLE = 8192
SHARD = 1 << 15
LEAF = 128
U = np.uint64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the word shingles; zero without words."""
    words = bytes(text).translate(LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        some = hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            values = np.array([simhash(t, shingle) for t in byte_slices(batch.column("text"))], U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(values.view(np.int64))], names=["doc_id", "text_hash", "fingerprint"])
        release_memory()

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    rows = keyed(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, text_hash long, fingerprint long")


def view_masks() -> list[np.uint64]:
    return [U(((1 << high) - 1) ^ ((1 << low) - 1)) for low, high in VIEWS]


def bits_apart(values: np.ndarray, one, mask) -> np.ndarray:
    return np.bitwise_count((values ^ one) & mask).astype(np.int64)


def split_at(distances: np.ndarray) -> int:
    """The radius that halves the points and leaves some on either side."""
    return min(int(np.median(distances)), int(distances.max()) - 1)


def grow(sample: np.ndarray, mask, levels: int):
    """Top of a tree: nested (vantage point, radius, inner, outer); None is a shard."""
    if levels == 0 or len(sample) < 4:
        return None
    vantage = sample[len(sample) // 2]
    distances = bits_apart(sample, vantage, mask)
    if distances.max() == 0:
        return None
    radius = split_at(distances)
    inner = distances <= radius
    return vantage, radius, grow(sample[inner], mask, levels - 1), grow(sample[~inner], mask, levels - 1)


def _deal(trees: list, reach: int):
    """Rows (shard, fingerprint, home) for every shard that a fingerprint lives in or asks."""

    def visit(tree, mask, values, home, name, out):
        if not len(values):
            return
        if tree is None:
            out.append((name, values, home))
            return
        vantage, radius, inner, outer = tree
        d = bits_apart(values, vantage, mask)
        inside = d <= radius
        near, far = d <= radius + reach, d > radius - reach
        visit(inner, mask, values[near], (home & inside)[near], 2 * name, out)
        visit(outer, mask, values[far], (home & ~inside)[far], 2 * name + 1, out)

    def run(batches):
        for batch in batches:
            values, out = batch.column(0).to_numpy(zero_copy_only=False).view(U), []
            for view, (mask, tree) in enumerate(trees):
                own: list = []
                visit(tree, mask, values, np.ones(len(values), bool), 1, own)
                out += [((view << 40) + name, v, h) for name, v, h in own]
            for name, v, h in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), name)), pa.array(v.view(np.int64)), pa.array(h)], names=["shard", "fingerprint", "home"])
        release_memory()

    return run


class Forest:
    """Which of n things are connected."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, which: np.ndarray) -> np.ndarray:
        at = self.parent[which]
        while True:
            up = self.parent[at]
            if (up == at).all():
                self.parent[which] = at
                return at
            at = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def joined(self, which: np.ndarray) -> bool:
        roots = self.roots(which)
        return bool((roots == roots[0]).all())


def link_within(values: np.ndarray, home: np.ndarray, mask, distance: int, reach: int, leaf: int = LEAF) -> Forest:
    """Connect all pairs of a home value and any value that differ in at most ``distance`` bits, by a tree over the home values.

    ``reach``: pairs that differ in more bits of ``mask`` are another view's. Values are distinct.
    """
    forest, full = Forest(len(values)), U((1 << 64) - 1)
    todo = [(np.flatnonzero(home), np.arange(len(values)), mask, reach)]
    while todo:
        points, asking, metric, radius = todo.pop()
        if not len(points) or not len(asking) or forest.joined(np.concatenate([points, asking])):
            continue
        if len(points) > leaf:
            vantage = values[points[len(points) // 2]]
            d = bits_apart(values[points], vantage, metric)
            if d.max() == 0:  # alike on the view: go on with all bits
                metric, radius = full, distance
                d = bits_apart(values[points], vantage, metric)
            asked = bits_apart(values[asking], vantage, metric)
            near = asking[np.bitwise_count(values[asking] ^ vantage) <= distance]
            forest.link(near, np.full(len(near), points[len(points) // 2]))
            split = split_at(d)
            todo.append((points[d > split], asking[asked > split - radius], metric, radius))
            todo.append((points[d <= split], asking[asked <= split + radius], metric, radius))
            continue
        step = max(1, (1 << 20) // len(points))
        for low in range(0, len(asking), step):
            some = asking[low : low + step]
            a, b = np.nonzero(np.bitwise_count(values[points][:, None] ^ values[some][None, :]) <= distance)
            forest.link(points[a], some[b])
    return forest


def _shard(distance: int, reach: int):
    masks = view_masks()

    def run(table: pa.Table) -> pa.Table:
        view = table.column("shard")[0].as_py() >> 40
        values = table.column("fingerprint").to_numpy().view(U)
        forest = link_within(values, table.column("home").to_numpy(), masks[view], distance, reach)
        roots = forest.roots(np.arange(len(values)))
        linked = np.flatnonzero(roots != np.arange(len(values)))
        return pa.table({"a": values[linked].view(np.int64), "b": values[roots[linked]].view(np.int64)})

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """a, b: edges that connect the values of the long column ``fingerprint`` (distinct, stored) as their links do."""
    rows = distinct.count()
    levels = max(0, (-(-rows // shard) - 1).bit_length())
    reach = distance // len(VIEWS)
    sample = [r[0] for r in distinct.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()]
    sample = np.array(sample, np.int64).view(U)
    trees = [(mask, grow(sample, mask, levels)) for mask in view_masks()]
    dealt = distinct.select("fingerprint").mapInArrow(_deal(trees, reach), "shard long, fingerprint long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_shard(distance, reach), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of ``edges`` (stored: a, b), the root being the least node that is reachable.

    Alternating large and small stars; each round is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, text_hash.

    ASCII letters are lower-cased; words are runs of other characters than space and
    U+0009 to U+000D. Fewer words than a shingle count as one shingle; texts without
    words, null ones too, have fingerprint zero and link like any other. component_id
    is the least id that is reachable over links; null ids take part, but only name a
    component in which all ids are null. An empty table gives an empty result. A text's
    shingles are held by the task that reads it; other columns, whatever their names, are ignored.
    """
    rows = stored(fingerprints(docs, key, text, shingle), "simhash-rows")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = components(stored(links(distinct, distance), "simhash-links"))
    named = stored(sized_join(distinct, stored(found.withColumnRenamed("node", "fingerprint"), "simhash-roots"), ["fingerprint"], "left"), "simhash-named")
    root = F.coalesce("root", "fingerprint")
    lowest = stored(named.groupBy(root.alias("root")).agg(F.min("low").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-components")
    ids = sized_join(named.withColumn("root", root), lowest, ["root"], "left").select("fingerprint", "root", F.coalesce("component_id", "low").alias("component_id"))
    out = sized_join(rows, stored(ids, "simhash-ids"), ["fingerprint"], "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the least id of each component (then the least text hash), one of each, with all their columns."""
    found = stored(near_groups(docs), "simhash-result")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    # Groups of one need no winner; only the others are joined.
    groups = found.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").select("root", F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"))
    rows = sized_join(found, stored(groups, "simhash-winners"), ["root"], "inner")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    verdicts = rows.groupBy(*ROW_KEY).agg(F.max(kept).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    return keep_rows(docs, stored(verdicts, "simhash-verdicts"))
