"""Nearest neighbours by inner product with multi-index hashing of learned rotated binary codes.

Vectors are completed to equal length, so that the largest inner product is the smallest angle, and coded
by the signs of learned rotations. A code is split into substrings and each substring is indexed. Two
codes within a Hamming radius agree in some substring up to radius / substrings bits, so probing every
substring within that many flips finds every code within the radius; those are reranked on the vectors.
The radius is the least at which the table's sample keeps its neighbours, and grows for every query that
finds too few.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick


@dataclass(frozen=True)
class Codes:
    """bits in ``parts`` substrings; radius: least radius searched; fit_rows: most vectors the rotation is learned from.

    recall: share of the nearest in the sample, of at most trial_queries queries, that the radius must hold.
    index_block and query_block: rows that one task indexes and queries that it answers. Every row is
    indexed and every query meets every block.
    """

    bits: int = 64
    parts: int = 4
    radius: int = 31
    recall: float = 0.99
    trial_queries: int = 256
    fit_rows: int = 20_000
    rounds: int = 20
    index_block: int = 4096
    query_block: int = 1024


class Rotation:
    """Centre and rotations that bring vectors close to the corners of a cube."""

    def __init__(self, sample: np.ndarray, how: Codes):
        rng = np.random.default_rng(3)
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
        z = sample - self.centre
        dims = z.shape[1]
        _, vectors = np.linalg.eigh(z.T @ z)
        kept = vectors[:, ::-1][:, : how.bits]
        turns = []
        while sum(t.shape[1] for t in turns) < how.bits:
            turn = np.linalg.qr(rng.normal(size=(kept.shape[1],) * 2))[0]
            projected = z @ kept
            for _ in range(how.rounds if len(z) > dims else 0):
                corners = np.where(projected @ turn > 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(projected.T @ corners)
                turn = u @ v
            turns.append(kept @ turn)
        self.turn = np.concatenate(turns, axis=1)[:, : how.bits]

    def code(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.centre) @ self.turn > 0, axis=1)


def completed(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that all vectors are as long as the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def as_query(vectors: np.ndarray, longest: float) -> np.ndarray:
    scaled = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None] * longest
    return np.concatenate([scaled, np.zeros((len(vectors), 1))], axis=1)


def start_radius(ids: np.ndarray, vectors: np.ndarray, turn: Rotation, longest: float, k: int, every: int, how: Codes) -> int:
    """The least radius, from that of ``how`` on, within which the sample's queries find enough of their ``k`` nearest in it."""
    asked = np.flatnonzero(ids % every == 0)[: how.trial_queries]
    most = min(k, len(ids) - 1)
    if not len(asked) or most < 1:
        return how.radius
    codes, own = turn.code(completed(vectors, longest)), turn.code(as_query(vectors[asked], longest))
    held = np.zeros(how.bits + 1)
    for place, code in zip(asked, own):
        scores = vectors @ vectors[place]
        scores[place] = -np.inf
        top = np.argpartition(-scores, most - 1)[:most]
        held += np.bincount(np.bitwise_count(codes[top] ^ code).sum(axis=1, dtype=np.int64), minlength=how.bits + 1)
    enough = np.cumsum(held) >= how.recall * held.sum()
    return max(how.radius, int(enough.argmax()))


class MultiIndex:
    """Buckets of each substring of the codes of one block."""

    def __init__(self, codes: np.ndarray, how: Codes):
        self.how, self.codes = how, codes.view(np.uint64).ravel() if how.bits == 64 else codes
        self.width = how.bits // how.parts
        self.parts = self.substrings(codes)
        self.orders = [np.argsort(p, kind="stable") for p in self.parts]
        # The buckets of each substring that hold something: values, and where their rows start.
        self.buckets = [np.unique(p[o], return_index=True) for p, o in zip(self.parts, self.orders)]
        self.buckets = [(values.astype(np.uint64), np.r_[first, len(codes)]) for values, first in self.buckets]
        self.flips = how.radius // how.parts
        count = sum(math.comb(self.width, k) for k in range(self.flips + 1))
        masks = (sum(1 << b for b in c) for k in range(self.flips + 1) for c in combinations(range(self.width), k))
        # Flipping bits visits one bucket for each mask; where fewer buckets exist, the buckets are looked through.
        self.masks = np.fromiter(masks, np.uint64, count) if count < max(map(len, (v for v, _ in self.buckets)), default=0) else None

    def probed(self, own: int, values: np.ndarray, flips: int) -> np.ndarray:
        """Places of the buckets within the flips."""
        if self.masks is None or flips != self.flips:
            return np.flatnonzero(np.bitwise_count(values ^ np.uint64(own)) <= flips)
        wanted = self.masks ^ np.uint64(own)
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        return at[values[at] == wanted]

    def substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        bits = np.unpackbits(codes, axis=1)
        weights = 1 << np.arange(self.width)
        return [bits[:, i * self.width : (i + 1) * self.width] @ weights for i in range(self.how.parts)]

    def within(self, code: np.ndarray, substrings: list[int], radius: int | None = None) -> np.ndarray:
        """Places of every code within the radius (default: the least)."""
        radius = self.how.radius if radius is None else radius
        found = np.zeros(len(self.codes), bool)
        for own, order, (values, starts) in zip(substrings, self.orders, self.buckets):
            hit = self.probed(own, values, radius // self.how.parts)
            first, sizes = starts[hit], starts[hit + 1] - starts[hit]
            ends = np.cumsum(sizes)
            found[order[np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]] = True
        places = np.flatnonzero(found)
        if self.how.bits == 64:
            apart = np.bitwise_count(self.codes[places] ^ code.view(np.uint64)[0])
        else:
            apart = np.bitwise_count(self.codes[places] ^ code).sum(axis=1)
        return places[apart <= radius]

    def enough(self, code: np.ndarray, substrings: list[int], least: int) -> np.ndarray:
        """Places within the first radius that holds ``least`` codes; all where there are fewer."""
        radius = self.how.radius
        places = self.within(code, substrings, radius)
        while len(places) < least and radius < self.how.bits:
            radius += self.how.parts
            places = self.within(code, substrings, radius)
        return places


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def neighbours(df: DataFrame, k: int = 20, every: int = 20, how: Codes = Codes(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearest first by inner product in double precision on the vectors as given, ties to the smaller id;
    the query's own id is no candidate. No part take rows without id and vectors that are null, zero,
    hold null or non-finite components, or are of another length than most. An id with several vectors
    counts once, with the smallest of them. Fewer than ``k`` rows come only where fewer candidates exist.
    Other columns are left out; an empty table gives an empty one.
    """
    rows = pick(df, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    fine = "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.filter(fine)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = usual[0] if usual else 0
    rows = rows.filter(F.size("v") == dims)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count(F.lit(1)), F.max(squared)).first()
    total, longest = facts[0], (facts[1] or 0.0) ** 0.5
    # The bounded sample that the rotation is learned from: smallest hashes of the ids.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(how.fit_rows).toArrow()
    vectors = matrix(sample.column("v")) if total else np.zeros((0, dims))
    turn = Rotation(completed(vectors, longest), how)
    how = replace(how, radius=start_radius(sample.column("id").to_numpy(), vectors, turn, longest, k, every, how))

    blocks, asked = max(1, -(-total // how.index_block)), max(1, -(-total // (every * how.query_block)))
    index_of, query_of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(asked)).cast("int")
    indexed = rows.select("id", "v", F.lit(False).alias("is_query"), index_of.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("y"))
    queries = rows.filter(F.col("id") % every == 0).select(
        "id", "v", F.lit(True).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"), query_of.alias("y")
    )

    def run(part: pa.Table) -> pa.Table:
        is_query = part.column("is_query").to_numpy()
        ids, vectors = part.column("id").to_numpy(), matrix(part.column("v"))
        query_ids, own, ids, vectors = ids[is_query], vectors[is_query], ids[~is_query], vectors[~is_query]
        out: list[list[np.ndarray]] = [[], [], []]
        if len(own) and len(vectors):
            index = MultiIndex(turn.code(completed(vectors, longest)), how)
            codes = turn.code(as_query(own, longest))
            substrings = np.stack(index.substrings(codes), axis=1).tolist()
            for q, vector, code, split in zip(query_ids, own, codes, substrings):
                # One more than asked for, as the query itself may be among them.
                places = index.enough(code, split, k + 1)
                places = places[ids[places] != q]
                scores = (vectors[places] * vector).sum(axis=1)
                if len(places) > k:
                    # No score below the k-th best can be among the k best; ties stay.
                    stay = scores >= np.partition(scores, -k)[-k]
                    places, scores = places[stay], scores[stay]
                best = np.lexsort((ids[places], -scores))[:k]
                out[0].append(np.full(len(best), q))
                out[1].append(ids[places[best]])
                out[2].append(scores[best])
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for c, v, t in zip(("query_id", "vec_id", "score"), out, types)})

    found = indexed.unionAll(queries).groupBy("x", "y").applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
