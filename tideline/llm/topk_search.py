"""Exact top-k inner-product search over norm buckets.

Every batch of stored vectors is ordered by length and cut into buckets.  A query's k-th best score
so far, divided by its own length and the bucket's greatest length, is the cosine a vector of
the bucket must reach.  Above 1 the bucket and all shorter ones are skipped.  A high cosine
selects coordinate pruning (the query's strongest coordinate bounds the same coordinate of any
vector within that angle), a low one length pruning.  Survivors are verified by exact products.

Queries are broadcast in passes of at most ``QUERY_BYTES``; stored vectors are never shuffled, and
each task hands on at most k rows per query.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors of different dimension aren't compared; a row is never its own answer (same id);
repeated rows of one id count as one each; ties go to the smaller id; a null id takes no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 32 << 20
BUCKET_ROWS = 1024
COORDINATE_COSINE = 0.6
EXACT = float(1 << 53)


def quantise(column: str, scale: int = 1024):
    """floor(scale * x) of each component as long; null where the vector takes no part."""
    x = F.col(column)
    limit = float(1 << 62) / scale
    fine = F.size(x) > 0
    fine &= F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < limit)), F.lit(False))
    return F.when(x.isNotNull() & fine, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale)))))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = np.asarray(column.flatten())
    sizes = np.diff(np.asarray(column.offsets))
    return flat, sizes


def _products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products, q rows by p rows."""
    if not len(p) or float(np.abs(p).max()) * float(np.abs(q).max()) * p.shape[1] < EXACT:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ p.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """Each query's k best (score, id); ``floor`` is the score to reach."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        self.known = np.zeros((n, 0), bool)
        self.floor = np.full(n, -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], score], 1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, known.shape)], 1)
        known = np.concatenate([self.known[rows], known], 1)
        order = np.lexsort((ids, -score.astype(float), ~known), axis=1) if np.abs(score).max(initial=0) < EXACT else np.array([sorted(range(score.shape[1]), key=lambda j, i=i: (not known[i, j], -int(score[i, j]), int(ids[i, j]))) for i in range(len(rows))])
        order = order[:, : self.k]
        pick = lambda x: np.take_along_axis(x, order, 1)
        score, ids, known = pick(score), pick(ids), pick(known)
        if self.score.shape[1] < score.shape[1]:
            wide = lambda x, kind: np.concatenate([x, np.zeros((len(x), score.shape[1] - x.shape[1]), kind)], 1)
            self.score, self.id, self.known = wide(self.score, np.int64), wide(self.id, np.int64), wide(self.known, bool)
        self.score[rows, : score.shape[1]], self.id[rows, : score.shape[1]], self.known[rows, : score.shape[1]] = score, ids, known
        if score.shape[1] == self.k:
            self.floor[rows] = np.where(known[:, -1], score[:, -1], -np.inf)


class _Searcher:
    """The queries of one dimension against batch after batch."""

    def __init__(self, ids: np.ndarray, query: np.ndarray, k: int):
        self.ids, self.query, self.best = ids, query, _Best(len(ids), k)
        self.norms = np.sqrt((query.astype(float) ** 2).sum(1))
        self.unit = query / np.where(self.norms > 0, self.norms, 1)[:, None]
        self.focus = np.abs(self.unit).argmax(1)
        self.angle = np.arccos(np.clip(self.unit[np.arange(len(self.unit)), self.focus], -1, 1))

    def see(self, batch: pa.RecordBatch) -> None:
        flat, sizes = _matrix(batch.column(1))
        mine = sizes == self.query.shape[1]
        if not mine.any():
            return
        points = flat[np.repeat(mine, sizes)].reshape(-1, self.query.shape[1])
        own = np.asarray(batch.column(0))[mine]
        length = np.sqrt((points.astype(float) ** 2).sum(1))
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), BUCKET_ROWS):
            rows = order[at : at + BUCKET_ROWS]
            if not self._bucket(points[rows], length[rows], own[rows]):
                break

    def _bucket(self, p: np.ndarray, size: np.ndarray, names: np.ndarray) -> bool:
        """False: neither this bucket nor a shorter one can change any answer."""
        best, norms = self.best, self.norms
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norms * size[0] > 0, best.floor / (norms * size[0]), np.where(best.floor > 0, np.inf, -np.inf))
            least = np.where(norms > 0, best.floor / norms, -np.inf)
        live = np.flatnonzero(need <= 1 + 1e-9)
        if not len(live):
            return False
        # within the angle arccos(t) of the query, a coordinate at angle a lies between cos(a + arccos t) and cos(a - arccos t)
        t = np.clip(need[live], -1, 1)
        spread = np.arccos(t)
        low = np.cos(np.minimum(np.pi, self.angle[live] + spread)) - 1e-9
        high = np.cos(np.maximum(0, self.angle[live] - spread)) + 1e-9
        at = (p / np.where(size > 0, size, 1)[:, None])[:, self.focus[live]].T
        by_coordinate = (at >= low[:, None]) & (at <= high[:, None])
        by_length = size[None, :] >= least[live][:, None] - 1e-6
        keep = np.where((t >= COORDINATE_COSINE)[:, None], by_coordinate, by_length) & (names[None, :] != self.ids[live][:, None])
        some, used = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
        if len(some):
            score = _products(p[used], self.query[live[some]])
            known = keep[np.ix_(some, used)] & (score >= best.floor[live[some]][:, None])
            best.add(live[some], score, names[used][None, :], known)
        return True

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.best.known)
        columns = self.ids[q], self.best.id[q, j], self.best.score[q, j]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """-> query_id, rank (from 1), ``id_col``, score."""
    spark = vectors.sparkSession
    form = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantise(vector_col, scale).alias("v")).where("id is not null and v is not null")
    stored, asked = form(vectors), form(queries).distinct()
    count, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    passes = max(1, -(-count * (width + 1) * 8 // QUERY_BYTES))
    schema = "query_id long, id long, score long"
    found = None
    for g in range(passes):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == g) if passes > 1 else asked
        got = part.toArrow()
        by_width = {}
        if got.num_rows:
            flat, sizes = _matrix(got.column(1).combine_chunks())
            names = got.column(0).to_numpy()
            by_width = {int(d): (names[sizes == d], flat[np.repeat(sizes == d, sizes)].reshape(-1, d)) for d in np.unique(sizes)}
        shared = spark.sparkContext.broadcast(by_width)

        def run(batches, shared=shared):
            searchers = [_Searcher(ids, query, k) for ids, query in shared.value.values()]
            for batch in batches:
                for s in searchers:
                    s.see(batch)
            yield from (s.found() for s in searchers)

        one = stored.mapInArrow(run, schema)
        found = one if found is None else found.unionAll(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
