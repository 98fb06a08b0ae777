"""Exact search, hard negatives and vector codes against plain Python, on odd rows and on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from midyear.llm import codebooks, negatives, queries
from midyear.llm.common import read
from midyear.llm.exact_topk import nearest, top_k
from midyear.llm.vectors import in_blocks, integer_vectors
from verification.compare import duck, rows_of_spark, rows_of_sql

SCHEMA = "vec_id long, embedding array<float>, label int, row string, vector string, block string, curve string, rank int"


def odd_rows(seed=3, copies=60):
    """Ties, copies, nulls, shorter, empty and not finite vectors, repeated and missing ids, clashing columns."""
    r = random.Random(seed)

    def vector(n=8):
        return [float(np.float32(r.choice([-1, -0.5, 0, 0, 0.25, 0.3, 1]) * r.random())) for _ in range(n)]

    same = vector()
    rows = [(i, vector(), r.randrange(4)) for i in range(420)]
    rows += [(1000 + i, same, i % 2) for i in range(copies)]
    rows += [(600, None, 1), (601, [], 1), (700, [0.5, None] * 4, 1), (701, [math.nan] * 8, 1), (702, [math.inf] + [0.0] * 7, 2)]
    rows += [(800, vector(5), 2), (801, vector(3), None), (900, [], 3), (1100, [0.0] * 8, None), (None, vector(), 1), (None, same, None)]
    rows += [(100, vector(), 2), (100, same, 2), (101, same, 0), (101, same, 0)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame([(*row, "r", "v", "b", "c", 1) for row in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def whole(rows, scale, width=8):
    """(vec_id, integers, label) of the rows that take part."""
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            yield i, [math.floor(scale * float(np.float32(x))) for x in v] + [0] * (width - len(v)), label


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def searched(rows, k=10, every=100):
    table, out = [x for x in whole(rows, 1024) if x[0] is not None], Counter()
    for q, (i, v, _) in enumerate(table):
        if i % every == 0:
            best = sorted((-dot(v, w), j) for c, (j, w, _) in enumerate(table) if c != q)[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_search(odd, rows, empty, monkeypatch):
    from midyear.llm import exact_topk

    want = searched(rows)
    assert found(nearest(odd)) == want
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 32)
    assert found(nearest(odd)) == want
    assert found(nearest(odd, every=10, k=700)) == searched(rows, 700, 10)
    assert nearest(empty).count() == 0
    assert nearest(odd.where("vec_id = 100")).count() == 6  # three rows share this id


def test_search_in_query_blocks(odd, rows):
    table = integer_vectors(odd.where("vec_id IS NOT NULL"), 1024)
    some = table.where("vec_id % 10 = 0")
    blocks = in_blocks(some, 7, "vec_id", "row")
    sizes = [r["count"] for r in blocks.groupBy("block").count().orderBy("block").collect()]
    assert set(sizes[:-1]) == {7} and 0 < sizes[-1] <= 7 and sum(sizes) == some.count()
    assert found(top_k(table, some, 10, query_bytes=7 * 8 * 8)) == searched(rows, 10, 10)


def test_large_numbers(spark):
    """Scores are exact up to 64 bits."""
    df = spark.createDataFrame([(0, [1e6, 1.0], 1), (1, [1e6, -3.0], 1), (2, [-1e6, 0.5], 2), (3, [9e5, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    rows = [tuple(r) for r in df.collect()]
    table = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows]
    want = Counter()
    for rank, (s, j) in enumerate(sorted((-dot(table[0][1], w), j) for j, w in table[1:]), 1):
        want[0, rank, j, -s] += 1
    assert found(nearest(df)) == want
    assert negatives.hard_negatives(df).count() >= 0
    assert codebooks.compressed(df, entries=2).count() == 4


def mined(rows, low=30, high=90):
    table = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in whole(rows, 256) if i is not None and label is not None]
    out = Counter()
    for a, (i, v, label) in enumerate(table):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, c) for c, (j, w, _) in enumerate(table) if c != a)
        for s, j, _ in [x for x in scored if table[x[2]][2] == label][:5]:
            fit = [(n, m) for n, m, c in scored if table[c][2] != label and low * -s <= 100 * -n <= high * -s][:10]
            out.update((i, j, rank, m, -s, -n) for rank, (n, m) in enumerate(fit, 1))
    return out


def negative_rows(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives(odd, rows, empty, monkeypatch):
    want = mined(rows)
    assert sum(want.values()) > 50
    assert negative_rows(negatives.hard_negatives(odd)) == want
    assert negative_rows(negatives.hard_negatives(odd, block_rows=7, per_broadcast=2)) == want
    monkeypatch.setattr(negatives, "POOL", 10)
    monkeypatch.setattr(negatives, "SCORES_IN_HAND", 50)
    assert negative_rows(negatives.hard_negatives(odd, block_rows=40)) == want
    assert negatives.hard_negatives(empty).count() == 0


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """Where rows lie in clusters, most blocks are not read, and the result is that of reading all."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.03 * r.normal(size=16)).tolist(), int(r.integers(3))) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    read_ = []
    stored = negatives.stored

    def counted(table, label):
        out = stored(table, label)
        if label == "blocks-chosen":
            read_.append(out.count())
        return out

    monkeypatch.setattr(negatives, "stored", counted)
    got = negative_rows(negatives.hard_negatives(df, every=1000, block_rows=50, per_broadcast=1))
    monkeypatch.setattr(negatives.Windows, "wanted", lambda self, least, greatest, labels: np.ones((len(self.anchor), len(labels)), bool))
    assert got == negative_rows(negatives.hard_negatives(df, every=1000, block_rows=50)) and got
    of_positives, of_negatives = read_[:8:2], read_[1:8:2]  # of 80 blocks, for one anchor at a time
    assert max(of_positives) < 0.4 * 80 and max(of_negatives) < 0.7 * 80


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dimensions, bits):
    """Visits every cell once, each step to a neighbouring cell."""
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), axis=-1).reshape(-1, dimensions)
    curve = negatives.hilbert(grid, bits)
    assert sorted(curve.tolist()) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(curve)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(-10**6, 10**6), st.integers(-100, 300), st.integers(-100, 300), st.integers(-10**6, 10**6))
def test_limits(score, low, high, n):
    a, b = negatives.limits(score, low, high)
    assert (a <= n <= b) == (low * score <= 100 * n <= high * score)


def coded(rows, entries=256, rounds=4, parts=4):
    table = sorted(whole(rows, 1024), key=lambda x: (x[0] is None, x[0] or 0))
    width = 8 // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in table]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        after = []
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(p, c[p])[1]].append(c[p])
            after.append([[sum(col) // len(members[i]) for col in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])])
        books = after
    out, by = [], Counter()
    for (i, _, label), c in zip(table, cut):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, by[label], sha) for i, code, error, label in out)


def code_rows(df):
    return Counter(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("entries,cell", [(256, 64), (16, 512), (5, 16)])
def test_codes(spark, empty, entries, cell):
    # Rows that share an id are told apart by their vectors.
    rows = [r for r in odd_rows(copies=20) if r[0] not in (100, 101, None)] + [(None, [0.1] * 8, None)]
    df = spark.createDataFrame([(*row, "r", "v", "b", "c", 1) for row in rows], SCHEMA).repartition(3)
    assert code_rows(codebooks.compressed(df, entries=entries, cell=cell)) == coded(rows, entries)
    assert codebooks.compressed(empty).count() == 0


def test_cells_leave_out_dominated_entries_only():
    r = np.random.default_rng(2)
    book = r.integers(-300, 300, (64, 6))
    book[7] = book[3]
    points = np.concatenate([r.integers(-400, 400, (800, 6)), book, book])
    want = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    for cell in (16, 64, 256):
        cells = codebooks.Cells(book, cell)
        code, distance = cells.nearest(points)
        assert np.array_equal(code, want.argmin(axis=1)) and np.array_equal(distance, want.min(axis=1))
        again = cells.evaluated
        assert np.array_equal(cells.nearest(points)[0], code) and cells.evaluated == 2 * again
        if cell == 16:
            assert again < 0.2 * len(points) * len(book)
    assert np.array_equal(codebooks.nearest_of_all(book, points)[0], want.argmin(axis=1))


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_hard_negatives", "op13_vector_codes"])
def test_larger_table(spark, name):
    folder = "/root/testdata/sf0.1"
    from midyear.llm.queries import ORACLE

    if name == "op13_vector_codes":  # the SQL compares everything with everything: 2,000 rows are enough for it
        assert read(spark, folder, "embeddings").count() <= 2500
    assert rows_of_spark(queries.QUERIES[name], spark, folder) == rows_of_sql(duck(folder), ORACLE[name])
