"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

Vectors get one more coordinate, sqrt(largest norm ** 2 - norm ** 2), and queries a 0
there, so that inner product orders candidates as the angle does. Codes are signs after
iterative quantisation (principal axes, then rotations learned to lose least by
rounding), fitted on a bounded sample of ``SAMPLE`` rows; every row is indexed. A code is
split into ``PARTS`` substrings of 16 bits, each indexed by value. By the pigeonhole principle, a code
within radius r of the query's, r = a * m + b over m substrings, is within a in one of the
first b + 1 or within a - 1 in one of the others; probing these retrieves every code
within r, and of codes further away those that happen to agree with the query's in a substring. What
is retrieved is ranked by inner products of the original vectors, in double
precision. The radius is the ``RECALL`` quantile of the radii at which the true neighbours of
``SAMPLE_QUERIES`` queries, found among all rows by brute force, are retrieved.

Many short substrings at a small radius pass over most rows also where vectors are nearly
random: of 50,000 random unit vectors of 64 dimensions probes reach less than a tenth,
at a recall over 0.9.

The stated queries meet all rows in blocks of at most ``BLOCK`` rows, each with an index of
its own; a block returns a query's nearest, and the best of all blocks stay. A query with
fewer hits in a block than wanted widens the radius there until it has enough or the block is exhausted.

Defined results: vectors that are null, zero, of another length than most or that hold a
null or non-finite component take no part; equal scores rank by smaller id; a query's own
id is no candidate of it, in repeated rows either; rows that repeat an id and its vector count once; with fewer candidates than wanted, all
are returned; components of any finite size take part, a score beyond the range of doubles is infinite, and one that is
no number ranks last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadloom.llm.common import written
from leadloom.llm.words import ragged

SAMPLE = 4096
SAMPLE_QUERIES = 256
PARTS = 768
#: Rounds of learning a rotation, and rows of the sample that it is learned from.
ROUNDS = 3
ROTATION_ROWS = 1024
RECALL = 0.93
BLOCK = 1 << 15
#: Small tables are still dealt into so many blocks, for parallel work.
LEAST_BLOCKS = 8
#: Queries that probe a block at once, which bounds a worker's memory.
AT_ONCE = 1024


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0, top * top - (x * x).sum(1)))[:, None]), 1)


def learn(x: np.ndarray, bits: int = 16 * PARTS, seed: int = 5) -> np.ndarray:
    """A projection ``(dims, bits)``: principal axes, rotated so that signs are near the values; as many rotations as the bits need."""
    rng, out = np.random.default_rng(seed), []
    axes = np.linalg.svd(x.T @ x / len(x))[0]
    few = x[:ROTATION_ROWS]
    while sum(w.shape[1] for w in out) < bits:
        width = min(x.shape[1], bits - sum(w.shape[1] for w in out))
        basis = axes[:, :width]
        v, turn = few @ basis, np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ROUNDS):
            a, _, b = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (a @ b).T
        out.append(basis @ turn)
    return np.concatenate(out, 1).astype(np.float32)


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """``(rows, substrings)`` of 16 bits each."""
    return np.packbits(x.astype(np.float32) @ projection > 0, axis=1).view(np.uint16)


def retrieved_at(some: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The least radius at which probes for ``code`` reach each of these codes."""
    m = some.shape[1]
    return (np.bitwise_count(some ^ code).astype(np.int64) * m + np.arange(m)).min(1)


_BITS = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))


class Index:
    """A block's rows in order of each substring's value."""

    def __init__(self, all_codes: np.ndarray):
        self.rows, self.parts = all_codes.shape
        self.codes = np.ascontiguousarray(all_codes)
        self.order = [np.argsort(column, kind="stable").astype(np.uint16 if self.rows <= 1 << 16 else np.int32) for column in self.codes.T]
        self.values = [column[order] for column, order in zip(self.codes.T, self.order, strict=True)]

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """``(queries, rows)``: what the probes of each query reach, every row within the radius among it."""
        a, b = divmod(radius, self.parts)
        out = np.zeros((len(asked), self.rows), bool)
        for part in range(self.parts):
            r = a if part <= b else a - 1
            if r < 0:
                continue
            masks = np.flatnonzero(_BITS <= min(r, 16)).astype(np.uint16)
            if len(masks) * 4 > self.rows:  # fewer rows than values to look up
                out |= _BITS[asked[:, part, None] ^ self.codes[None, :, part]] <= r
                continue
            probe = (asked[:, part, None] ^ masks[None, :]).ravel()
            low, high = (np.searchsorted(self.values[part], probe, side) for side in ("left", "right"))
            some = np.flatnonzero(high > low)
            count = high[some] - low[some]
            out[np.repeat(some // len(masks), count), self.order[part][ragged(np.arange(self.rows), low[some], count)]] = True
        return out


def radius_of(radii) -> int:
    """The radius at which probes retrieve RECALL of true neighbours, given the radii at which they reach each."""
    return int(np.sort(radii)[max(0, int(np.ceil(RECALL * len(radii))) - 1)]) if len(radii) else 0


def best_of(x: np.ndarray, names: np.ndarray, ids: np.ndarray, vectors: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Rows with the largest inner products for each query, by brute force."""
    with np.errstate(all="ignore"):
        scores = np.nan_to_num(vectors @ x.T, nan=-np.inf)
    scores[ids[:, None] == names[None, :]] = -np.inf
    near = np.argpartition(-scores, min(wanted, len(x)) - 1, axis=1)[:, :wanted]
    return [(row[s > -np.inf], s[s > -np.inf]) for row, s in zip(near, np.take_along_axis(scores, near, 1), strict=True)]


def _true_neighbours(projection: Broadcast, ids: np.ndarray, vectors: np.ndarray, top: float, wanted: int):
    """Of every batch of rows the nearest of some queries, with the radii at which probes reach them."""
    asked = codes(np.concatenate((vectors, np.zeros((len(vectors), 1))), 1), projection.value)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names, x = np.asarray(batch.column("id")), np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
            for k, (near, scores) in enumerate(best_of(x, names, ids, vectors, wanted)):
                at = retrieved_at(codes(_augmented(x[near], top), projection.value), asked[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), k)), pa.array(names[near]), pa.array(scores), pa.array(at)], ["query", "id", "score", "radius"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(index: Index, names: np.ndarray, x: np.ndarray, ids: np.ndarray, asked: np.ndarray, vectors: np.ndarray, radius: int, wanted: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(id, ids of the nearest, scores)`` of each query with these codes and vectors in a block."""
    out, todo, r = {}, np.arange(len(ids)), radius
    while len(todo):
        reached, again = index.within(asked[todo], r), []
        for k, row in zip(todo.tolist(), reached, strict=True):
            found = np.flatnonzero(row)
            found = found[names[found] != ids[k]]
            if len(found) < wanted and r < 17 * index.parts and len(found) < (names != ids[k]).sum():
                again.append(k)
                continue
            with np.errstate(all="ignore"):
                scores = (x[found] * vectors[k]).sum(1)
            best = np.lexsort((names[found], -scores))[:wanted]
            out[k] = int(ids[k]), names[found][best], scores[best]
        todo, r = np.array(again, np.int64), r + index.parts
    return [out[k] for k in sorted(out)]


def _searched(projection: Broadcast, radius: int, top: float, scale: float, wanted: int):
    def run(batches):
        rows = ((b, k, i, v) for batch in batches for b, k, i, v in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "id")), np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1), strict=True))
        for _, block in groupby(rows, key=lambda r: r[0]):
            names, kept, ids, asked = [], [], [], []
            index = None

            def found():
                v = np.array(asked)
                return _hits(nearest(index, x_names, x, np.array(ids), codes(np.concatenate((v / scale, np.zeros((len(v), 1))), 1), projection.value), v, radius, wanted))

            for _, kind, i, v in block:
                if kind == 0:
                    names.append(i)
                    kept.append(v)
                    continue
                if not kept:
                    continue
                if index is None:
                    x, x_names = np.array(kept), np.array(names)
                    index = Index(codes(_augmented(x / scale, top), projection.value))
                ids.append(i)
                asked.append(v)
                if len(ids) >= AT_ONCE:
                    yield found()
                    ids, asked = [], []
            if ids:
                yield found()

    return run


def _hits(out: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids = np.concatenate([np.full(len(x), q, np.int64) for q, x, _ in out]) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate([o[k] for o in out]) if out else [], t) for k, t in ((1, pa.int64()), (2, pa.float64())))], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, wanted: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its nearest rows of ``vectors``."""
    spark = vectors.sparkSession
    # Copies of a row would take the places of others in the sample and among a block's nearest.
    base, asked = written(usable(vectors, id_col, vector_col).distinct(), "vectors"), usable(queries, id_col, vector_col)
    dims = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    base, asked = (x.filter(F.size("v") == dims.d) for x in (base, asked))
    # Codes are of vectors scaled to components of 1 at most, so that no square is beyond the range of doubles.
    scale = base.agg(F.max(F.array_max(F.transform("v", F.abs)))).head()[0]
    top = base.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale))))).head()[0]
    scaled = base.select("id", F.transform("v", lambda c: c / scale).alias("v"))
    x = np.array([r.v for r in scaled.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])  # SAMPLE rows at most
    projection = spark.sparkContext.broadcast(learn(_augmented(x, top)))
    asked = written(asked.distinct(), "queries")
    some = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()  # SAMPLE_QUERIES rows at most
    if not some:
        return spark.createDataFrame([], schema)
    run = _true_neighbours(projection, np.array([r.id for r in some]), np.array([r.v for r in some]) / scale, float(top), wanted)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    near = scaled.mapInArrow(run, "query long, id long, score double, radius long").withColumn("place", place).filter(F.col("place") <= wanted)
    radius = radius_of(np.array([r.radius for r in near.select("radius").collect()]))  # SAMPLE_QUERIES * wanted numbers at most
    blocks = max(-(-dims["count"] // BLOCK), min(LEAST_BLOCKS, -(-dims["count"] // 2048)))
    index = base.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    dealt = index.union(probes).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    hits = dealt.mapInArrow(_searched(projection, radius, float(top), float(scale), wanted), "query_id long, vec_id long, score double").distinct()
    rank_of = F.row_number().over(W.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank_of).filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
