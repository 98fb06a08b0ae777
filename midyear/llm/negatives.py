"""Hard negatives from Hilbert-ordered blocks with zone maps.

Rows are sorted along a Hilbert curve through their most spread components and packed
into blocks, one Parquet row each, with the least and greatest value of every
component beside the packed rows. A window asks for the k best rows, of the anchor's
label or of others, whose inner product with the anchor lies within two limits.
Interval arithmetic over a block's zone map bounds its inner products with an anchor;
a block is read for a window only if the bounds meet the limits and reach the k-th
best score known. That score comes from a first look into one promising block per
window. The pass that chooses blocks reads zone maps only, not the rows.

Anchors come along the curve too, in blocks of a fixed number, so those that share a
broadcast want the same blocks. First their positives are found, by windows without
limits, then the windows of the negatives.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, parts, release_memory, sized_join, stored
from .vectors import best_of, fits_double, gathered, in_blocks, inner, integer_vectors, longest, magnitude, padded

SCALE = 256
EVERY = 100
POSITIVES = 5
K = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
CURVE_DIMENSIONS, CURVE_BITS = 12, 5
BLOCK_ROWS = 512
PARTITION_ROWS = 1 << 16
ANCHORS = 4096  # per broadcast
SCORES_IN_HAND = 1 << 21
POOL = 1 << 18
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCK = "block long, labels array<long>, low array<long>, high array<long>, ids binary, rows binary, marks binary, vectors binary"


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with coordinates of ``bits`` bits, a row each."""
    x = [c.astype(np.uint64) for c in np.ascontiguousarray(places.T)]
    zero, one = np.uint64(0), np.uint64(1)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the larger cells
        p = np.uint64(q - 1)
        for i in range(len(x)):
            set_ = (x[i] & np.uint64(q)) != 0
            swap = np.where(set_, zero, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(len(places), np.uint64), top
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    out = np.zeros(len(places), np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << one | ((c ^ turn) >> np.uint64(b)) & one
    return out.astype(np.int64)


def _extents(width: int):
    def run(batches):
        low, high = np.full(width, MOST), np.full(width, LEAST)
        for batch in batches:
            vectors = padded(batch.column("vector"), width)
            low, high = np.minimum(low, vectors.min(axis=0, initial=MOST)), np.maximum(high, vectors.max(axis=0, initial=LEAST))
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(low), pa.array(high)], names=["place", "low", "high"])

    return run


def _placed(extents: list[tuple[int, int, int]], width: int):
    """``curve``: the place along the curve through the given (component, least, greatest)."""

    def run(batches):
        for batch in batches:
            vectors, cells = padded(batch.column("vector"), width), []
            for place, low, high in extents:
                share = (vectors[:, place].astype(np.float64) - low) / (float(high) - low + 1.0)
                cells.append(np.clip(share * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.int64))
            curve = hilbert(np.stack(cells, axis=1), CURVE_BITS) if cells else np.zeros(len(vectors), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve)], names=[*batch.schema.names, "curve"])

    return run


def along_curve(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with their place ``curve``, stored."""
    each = rows.select("vector").mapInArrow(_extents(width), "place int, low long, high long")
    known = each.groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <= high")
    spread = F.col("high").cast("double") - F.col("low")
    extents = [tuple(r) for r in known.orderBy(F.desc(spread), "place").limit(CURVE_DIMENSIONS).collect()]
    return stored(rows.mapInArrow(_placed(extents, width), f"{_schema(rows)}, curve long"), "curve")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _packed(width: int, block_rows: int):
    def run(batches):
        first, number = TaskContext.get().partitionId() << 32, 0
        for table in gathered(batches, block_rows):
            for at in range(0, table.num_rows, block_rows):
                some = table.slice(at, block_rows)
                vectors = padded(some.column("vector"), width)
                ids, rows, marks = (some.column(c).to_numpy() for c in ("vec_id", "row", "label"))
                columns = [[first + number], [np.unique(marks)], [vectors.min(axis=0)], [vectors.max(axis=0)], *([x.astype(np.int64).tobytes()] for x in (ids, rows, marks, vectors))]
                kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in BLOCK.split(", ")])
                number += 1

    return run


def packed(placed: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive rows along the curve. Rows at one place are told apart by number, so copies spread over partitions."""
    n = parts(placed.count(), PARTITION_ROWS)
    ordered = placed.repartitionByRange(n, "curve", "row").sortWithinPartitions("curve", "row")
    return stored(ordered.mapInArrow(_packed(width, block_rows), BLOCK), "hilbert-blocks")


@dataclass(frozen=True)
class Windows:
    """Anchors of one broadcast, and what is asked of them.

    rows, labels, vectors: of the anchors. anchor, low, high, floor: of the windows;
    floor is a score that k rows of the window are known to reach. same: whether rows
    of the anchor's label are wanted, or those of others.
    """

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    same: bool
    k: int

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner products of the anchors with rows of blocks that have these zone maps."""
        if not fits_double(magnitude(self.vectors), max(magnitude(low), magnitude(high)), width=self.vectors.shape[1]):
            return np.full((len(self.vectors), len(low)), -np.inf), np.full((len(self.vectors), len(low)), np.inf)
        up, down = np.maximum(self.vectors, 0).astype(np.float64), np.minimum(self.vectors, 0).astype(np.float64)
        low, high = low.T.astype(np.float64), high.T.astype(np.float64)
        return up @ low + down @ high, up @ high + down @ low

    def wanted(self, least: np.ndarray, greatest: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
        """[window, block]: whether the block may hold rows for the window."""
        held = np.stack([np.isin(self.labels, x) if self.same else ~np.isin(self.labels, x) | (len(x) > 1) for x in labels], axis=1)
        floor = np.maximum(self.low, self.floor).astype(np.float64)[:, None]
        return held[self.anchor] & (greatest[self.anchor] >= floor) & (least[self.anchor] <= self.high.astype(np.float64)[:, None])


def _zones(table, windows: Windows):
    """Zone maps in pieces of which the bounds fit in hand: (block numbers, least, greatest, labels)."""
    step, width = max(1, SCORES_IN_HAND // max(1, len(windows.anchor))), windows.vectors.shape[1]
    for at in range(0, table.num_rows, step):
        some = table.slice(at, step)
        labels = [np.array(x, np.int64) for x in some.column("labels").to_pylist()]
        yield some.column("block").to_numpy(zero_copy_only=False), *windows.bounds(padded(some.column("low"), width), padded(some.column("high"), width)), labels


def _promising(sent):
    """For each window, the block whose middle score is highest, or nearest to the upper limit."""

    def run(batches):
        windows = sent.value
        best, merit = np.full(len(windows.anchor), -1), np.full(len(windows.anchor), -np.inf)
        limited = windows.high < MOST
        for batch in batches:
            for blocks, least, greatest, labels in _zones(batch, windows):
                middle = (np.maximum(least, -1e300) + np.minimum(greatest, 1e300))[windows.anchor] / 2
                value = np.where(limited[:, None], -np.abs(middle - windows.high[:, None].astype(np.float64)), middle)
                value[~windows.wanted(least, greatest, labels)] = -np.inf
                at = value.argmax(axis=1)
                top = value[np.arange(len(value)), at]
                better = top > merit
                best[better], merit[better] = blocks[at[better]], top[better]
        some = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(best[some]), pa.array(merit[some])], names=["window", "block", "merit"])

    return run


def _chosen(sent):
    """The blocks that some window must read."""

    def run(batches):
        windows = sent.value
        for batch in batches:
            for blocks, least, greatest, labels in _zones(batch, windows):
                some = blocks[windows.wanted(least, greatest, labels).any(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64())], names=["block"])

    return run


FOUND = "window int, vec_id long, row long, score long"


class Pool:
    """The best rows of each window so far."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.floor = windows, np.maximum(windows.low, windows.floor)
        self.held, self.fresh, self.n = [np.zeros(0, np.int64)] * 4, [], 0

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.fresh.append((window, score, ids, rows))
        self.n += len(window)
        if self.n > POOL:
            self.settle()

    def settle(self) -> None:
        all_ = [np.concatenate(x) for x in zip(self.held, *self.fresh)]
        self.held = [x[best_of(*all_, self.windows.k)] for x in all_]
        self.fresh, self.n = [], 0
        window, score = self.held[:2]
        count = np.bincount(window, minlength=len(self.floor))
        last = np.cumsum(count) - 1  # held rows stand by window, best first
        full = np.flatnonzero(count >= self.windows.k)
        self.floor[full] = np.maximum(self.floor[full], score[last[full]])


def _scored(sent, everything: bool):
    """The best rows of each window in some blocks; without ``everything`` a block is read for its listed windows only."""

    def run(batches):
        windows = sent.value
        pool, width = Pool(windows), windows.vectors.shape[1]
        for batch in batches:
            listed = None if everything else batch.column("windows").to_pylist()
            names = [batch.column(c).to_pylist() for c in ("labels", "ids", "rows", "marks", "vectors")]
            low, high = padded(batch.column("low"), width), padded(batch.column("high"), width)
            for b, (labels, *packed_) in enumerate(zip(*names)):
                ids, rows, marks, vectors = (np.frombuffer(x, np.int64) for x in packed_)
                vectors = vectors.reshape(len(ids), width)
                if everything:
                    now = replace(windows, floor=pool.floor)
                    some = np.flatnonzero(now.wanted(*now.bounds(low[b : b + 1], high[b : b + 1]), [np.array(labels)])[:, 0])
                else:
                    some = np.array(listed[b], np.int64)
                for at in range(0, len(some), max(1, SCORES_IN_HAND // len(ids))):
                    part = some[at : at + max(1, SCORES_IN_HAND // len(ids))]
                    anchors, which = np.unique(windows.anchor[part], return_inverse=True)
                    scores = inner(windows.vectors[anchors], vectors)[which]
                    alike = (windows.labels[anchors][:, None] == marks)[which]
                    fit = (scores >= pool.floor[part, None]) & (scores <= windows.high[part, None]) & (alike == windows.same)
                    w, r = np.nonzero(fit)
                    foreign = rows[r] != windows.rows[windows.anchor[part[w]]]
                    w, r = w[foreign], r[foreign]
                    pool.add(part[w], scores[w, r], ids[r], rows[r])
        pool.settle()
        window, score, ids, rows = pool.held
        yield pa.RecordBatch.from_arrays([pa.array(window, pa.int32()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(score, pa.int64())], names=[x.split()[0] for x in FOUND.split(", ")])
        del pool, window, score, ids, rows
        release_memory()

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def answered(blocks: DataFrame, windows: Windows) -> DataFrame:
    """window, rank, vec_id, row, score: the rows asked for by the windows, stored."""
    spark = blocks.sparkSession
    zones = blocks.select("block", "labels", "low", "high")
    sent = spark.sparkContext.broadcast(windows)
    look = zones.mapInArrow(_promising(sent), "window int, block long, merit double").groupBy("window").agg(F.max_by("block", "merit").alias("block"))
    look = stored(look.groupBy("block").agg(F.collect_list("window").alias("windows")), "blocks-promising")
    first = _merged(sized_join(blocks, look, ["block"], "inner").mapInArrow(_scored(sent, False), FOUND), windows.k)
    reached = first.where(F.col("rank") == windows.k).select("window", "score").toArrow()  # a row per window
    floor = windows.floor.copy()
    floor[reached.column("window").to_numpy()] = reached.column("score").to_numpy()
    tighter = spark.sparkContext.broadcast(replace(windows, floor=floor))
    chosen = stored(zones.mapInArrow(_chosen(tighter), "block long"), "blocks-chosen")
    return stored(_merged(sized_join(blocks, chosen, ["block"], "inner").mapInArrow(_scored(tighter, True), FOUND), windows.k), "windows-answered")


def limits(score: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """The least and greatest integer n with low * score <= 100 * n <= high * score."""
    low, high = -(-low_percent * score // 100), high_percent * score // 100
    return max(low, LEAST), min(high, MOST)


def mined(anchors: DataFrame, blocks: DataFrame, width: int, positives: int = POSITIVES, k: int = K, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT, per_broadcast: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: row, vec_id, label, vector, curve. blocks: ``packed``. An anchor block's
    positives, at most ``positives`` times ``per_broadcast`` rows, go through the driver.
    """
    spark = anchors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path, inside = new_folder(spark, "negatives"), in_blocks(anchors, per_broadcast, "curve", "row")
    for number in range(inside.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]):
        some = inside.where(F.col("block") == number).select("row", "vec_id", "label", "vector").toArrow()
        n, ids = some.num_rows, some.column("vec_id").to_pylist()
        of_anchor = [some.column("row").to_numpy(), some.column("label").to_numpy(), padded(some.column("vector"), width)]
        free = Windows(*of_anchor, np.arange(n), np.full(n, LEAST), np.full(n, MOST), np.full(n, LEAST), True, positives)
        pairs = answered(blocks, free).select("window", "vec_id", "score").toArrow().to_pylist()
        asked = [(p["window"], *limits(p["score"], low_percent, high_percent), p["vec_id"], p["score"]) for p in pairs]
        asked = [a for a in asked if a[1] <= a[2]]
        if not asked:
            continue
        anchor, low, high, positive, score = (np.array(c, np.int64) for c in zip(*asked))
        rows = answered(blocks, Windows(*of_anchor, anchor, low, high, np.full(len(anchor), LEAST), False, k))
        names = spark.createDataFrame(list(zip(range(len(asked)), [ids[a] for a in anchor], positive.tolist(), score.tolist())), "window int, anchor_id long, positive_id long, positive_score long")
        out = rows.join(F.broadcast(names), "window").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.parquet(f"{path}/block={number}")
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=-1")
    return spark.read.schema(schema).parquet(path).drop("block")


def hard_negatives(df: DataFrame, relabelled: int = 7, every: int = EVERY, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS, **asked: int) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``.

    Rows with a null label or id, or a vector that is null or holds null or non-finite
    components, take no part. Where the id is divisible by ``relabelled`` the label first
    becomes (label + 1) % 10. Components count as floor(scale * x). An anchor's positives
    are its best other rows of the same label; each asks for the best rows of other
    labels whose score lies between the given shares of the positive's. Ties go to the
    smaller id. Rows that share an id are rows of their own. Vectors may differ in
    length; what is missing counts as zero. Scores are exact where they fit 64 bits. An
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    whole = df.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    of_label = F.col(label).cast("long")
    marked = F.when(F.col(key) % relabelled == 0, (of_label + 1) % 10).otherwise(of_label).alias("label")
    rows = integer_vectors(whole, scale, marked, key=key, vector=vector)
    width = max(1, longest(rows))
    placed = along_curve(rows, width)
    return mined(placed.where(F.col("vec_id") % every == 0), packed(placed, width, block_rows), width, **asked)
