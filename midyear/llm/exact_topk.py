"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows: a term is a component's place, its weight the integer found
there. Each task turns its candidates, block by block, into postings (per term, who
has it and with what weight) and keeps a dense array of scores over the block. A
query goes through its terms and scatters query weight times posting weight into the
array; nothing is skipped, so the scores are the inner products. The k best of the
array are selected against the worst of the k best so far, and the tasks' lists meet
in one merge per query. Queries come in blocks of a fixed number of bytes, each
broadcast to all tasks: a pass over the candidates per block, with nothing shuffled
but k rows per query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, release_memory
from .vectors import VALUES_IN_HAND, gathered, in_blocks, integer_vectors, longest, padded

SCALE = 1024
EVERY = 100
K = 10
QUERY_BYTES = 8 << 20  # of a broadcast block of queries
BLOCK_ROWS = 16384
FOUND = "query_row long, query_id long, vec_id long, row long, score long"


class Postings:
    """Per term, the places in a block that have it, and their weights; None stands for all places."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.n, self.lists = len(vectors), []
        for column in np.ascontiguousarray(vectors.T):
            places = np.flatnonzero(column)
            self.lists.append((None, column) if len(places) > self.n // 2 else (places, column[places]))


def accumulate(postings: Postings, terms: np.ndarray, weights: np.ndarray, scores: np.ndarray, spare: np.ndarray) -> None:
    """Score every place of the block for one query, term at a time."""
    scores.fill(0)
    for term, weight in zip(terms.tolist(), weights.tolist()):
        if term < len(postings.lists):
            places, values = postings.lists[term]
            if places is None:
                np.multiply(values, weight, out=spare)
                scores += spare
            else:
                scores[places] += values * weight


class Best:
    """The k best candidates of one query so far."""

    __slots__ = ("scores", "ids", "rows", "floor")

    def __init__(self) -> None:
        self.scores, self.ids, self.rows, self.floor = (np.zeros(0, np.int64),) * 3 + (None,)

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> None:
        """``own``: the query's row, which is no candidate."""
        if self.floor is None and len(scores) > k + 1:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
        else:
            some = np.flatnonzero(scores >= self.floor) if self.floor is not None else np.arange(len(scores))
        some = some[rows[some] != own]
        if not len(some):
            return
        s, i, r = (np.concatenate([a, b[some]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((r, i, ~s))[:k]
        self.scores, self.ids, self.rows = s[order], i[order], r[order]
        if len(order) == k:
            self.floor = self.scores[-1]


def sparse(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(t := np.flatnonzero(v), v[t]) for v in vectors]


def _search(queries, k: int):
    def run(batches):
        rows, ids, vectors = queries.value
        terms = sparse(vectors)
        best = [Best() for _ in terms]
        for table in gathered(batches, max(1, min(BLOCK_ROWS, VALUES_IN_HAND // max(1, vectors.shape[1])))):
            own_rows, own_ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
            postings = Postings(padded(table.column("vector"), vectors.shape[1]))
            scores, spare = np.zeros(postings.n, np.int64), np.zeros(postings.n, np.int64)
            for (t, w), b, row in zip(terms, best, rows.tolist()):
                accumulate(postings, t, w, scores, spare)
                b.take(scores, own_ids, own_rows, row, k)
        n = np.array([len(b.ids) for b in best])
        columns = [np.repeat(rows, n), np.repeat(ids, n), *(np.concatenate([getattr(b, c) for b in best]) if best else rows for c in ("ids", "rows", "scores"))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])
        del terms, best, columns
        release_memory()

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by inner product.

    Both tables have row, vec_id and vector (``integer_vectors``); a query's own row is
    no candidate. Higher scores come first, ties by smaller vec_id. Queries with fewer
    candidates get them all. Vectors may differ in length; what is missing counts as
    zero. Scores are exact where they fit 64 bits.
    """
    spark, width = candidates.sparkSession, max(1, longest(candidates), longest(queries))
    blocks = in_blocks(queries.select("row", "vec_id", "vector"), max(1, query_bytes // (8 * width)), "vec_id", "row")
    path = new_folder(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    for block in range(blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]):
        part = blocks.where(F.col("block") == block).select("row", "vec_id", "vector").toArrow()  # of a fixed number of bytes
        sent = spark.sparkContext.broadcast((part.column("row").to_numpy(), part.column("vec_id").to_numpy(), padded(part.column("vector"), width)))
        found = candidates.select("row", "vec_id", "vector").mapInArrow(_search(sent, k), FOUND)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/block={block}")
        sent.destroy()
    done = spark.createDataFrame([], schema)
    done.write.parquet(f"{path}/block=-1")
    return spark.read.schema(schema).parquet(path).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best of each row whose id is divisible by ``every``, among all other rows.

    Components count as floor(scale * x). Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id. Rows that share an
    id are rows of their own: each of them is a candidate, and a query if the id says
    so. Empty vectors score zero. Very long vectors make smaller blocks. An empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    rows = integer_vectors(df.where(F.col(key).isNotNull()), scale, key=key, vector=vector)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
