"""Near duplicates by MinHash with sequential Bayesian verification.

Signatures are banded; texts that share a bucket are candidates. A candidate pair's signatures are
compared batch after batch, and the pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below the chosen miss probability. What survives is verified on
the full shingle sets.

Pairs are never listed: equal sets are folded first, each text is then compared with one leader of
its buckets, and what is not yet connected is compared inside bucket blocks, whose tasks return no
more links than a spanning forest needs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, stored
from .components import components
from .wordhash import WordHashes, mixed, runs


@dataclass(frozen=True)
class Similarity:
    """shingle: words in one; percent: links have 100 * intersection >= percent * union.

    hashes: signature length in bytes; miss: greatest probability that banding, or one pruning step,
    loses a link; batch: hashes compared between two looks at the posterior; block: members of a bucket
    compared by one task at once.
    """

    shingle: int = 3
    percent: int = 85
    hashes: int = 216
    miss: float = 1e-7
    batch: int = 36
    block: int = 1024

    @property
    def band(self) -> int:
        """Most rows in a band whose bands still find a pair at the threshold."""
        t = self.percent / 100
        return max(r for r in range(1, 9) if r == 1 or (1 - t**r) ** (self.hashes // r) <= self.miss)

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, fewest matches to go on): posterior from a uniform prior over similarities."""
        t = self.percent / 100
        t += (1 - t) / 256  # a byte of the minimum also matches by chance
        out = []
        for n in range(self.batch, self.hashes + 1, self.batch):
            # P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def shingles(text: str | None, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Fewer words than a shingle: the whole sequence as one."""
    hashes = words.of((text or "").encode().lower().split())
    if 0 < len(hashes) < size:
        return runs(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(runs(hashes, size))


class Signer:
    def __init__(self, hashes: int):
        rng = np.random.default_rng(20)
        self.a = rng.integers(1, 1 << 63, hashes, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, hashes, np.uint64)[:, None]

    def sign(self, items: np.ndarray) -> bytes:
        least = None
        for at in range(0, len(items), 512):
            h = self.a * items[None, at : at + 512]
            h += self.b
            own = h.min(axis=1)
            least = own if least is None else np.minimum(least, own)
        return (mixed(least) >> np.uint64(40)).astype(np.uint8).tobytes()


def described(df: DataFrame, how: Similarity) -> DataFrame:
    """``doc_id, n_shingles, set_hash, signature`` of every row; null signature without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signer = WordHashes(), Signer(how.hashes)
        for part in slices(batches, "text"):
            sets = [shingles(t, words, how.shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(map(len, sets), pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signer.sign(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_hash", "signature"],
            )

    return df.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary")


def with_sets(df: DataFrame, how: Similarity) -> DataFrame:
    """``id, items``: full shingle sets as sorted little-endian unsigned 64-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in slices(batches, "text"):
            sets = [shingles(t, words, how.shingle).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("signature"), pa.array(sets, pa.binary())], ["id", "signature", "items"])

    return df.select("id", "signature", "text").mapInArrow(run, "id long, signature binary, items binary")


def plausible(left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Places of the signature pairs (rows of two byte matrices) that no look at the posterior prunes."""
    open_, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in looks:
        matches = matches + np.count_nonzero(left[open_, done:n] == right[open_, done:n], axis=1)
        stay = matches >= least
        open_, matches, done = open_[stay], matches[stay], n
    return open_


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, how: Similarity) -> DataFrame:
    """Pairs ``a, b`` with ``sig_a, sig_b, items_a, items_b`` that are links."""
    looks = how.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not len(part):
                continue
            sig_a, sig_b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(len(part), -1) for c in ("sig_a", "sig_b"))
            keep = [
                i for i in plausible(sig_a, sig_b, looks).tolist()
                if linked(np.frombuffer(part.column("items_a")[i].as_py(), "<u8"), np.frombuffer(part.column("items_b")[i].as_py(), "<u8"), how.percent)
            ]
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b", "items_a", "items_b").mapInArrow(run, "a long, b long")


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(ids: np.ndarray, labels: np.ndarray, signatures: np.ndarray, items: list, side: np.ndarray, band: int, how: Similarity, looks: list) -> list[tuple[int, int]]:
    """Links between the members of one bucket block, or of two blocks, that connect different labels.

    A pair that shares an earlier band is left to that band's bucket. Pairs are taken row by row, so
    memory stays linear in the block.
    """
    forest, out, size = Forest(), [], how.band
    order = np.argsort(labels, kind="stable")
    for place, i in enumerate(order.tolist()):
        rest = order[place + 1 :]
        rest = rest[labels[rest] != labels[i]]
        if side.any() and not side.all():
            rest = rest[side[rest] != side[i]]
        if band and len(rest):
            same = signatures[rest, : band * size] == signatures[i, : band * size]
            rest = rest[~same.reshape(len(rest), band, size).all(axis=2).any(axis=1)]
        if not len(rest):
            continue
        rest = rest[plausible(np.broadcast_to(signatures[i], (len(rest), signatures.shape[1])), signatures[rest], looks)]
        for j in rest.tolist():
            if forest.root(int(labels[i])) != forest.root(int(labels[j])) and linked(items[i], items[j], how.percent):
                forest.join(int(labels[i]), int(labels[j]))
                out.append((int(ids[i]), int(ids[j])))
    return out


def meetings(label: DataFrame, how: Similarity) -> DataFrame:
    """Where the members (``band, key, id, n, label``) of buckets of several labels meet: ``x, y, second``.

    Each pair of blocks meets once; a bucket of at most ``block`` members has the single pair (0, 0). In a
    larger one the members of its most frequent label need not meet each other, so they have blocks of
    their own, which meet the blocks of the others only: a large group with a few strangers is sent once
    for every block of strangers.
    """
    mixed_ = label.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    shares = label.filter(F.col("n") > how.block).groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = shares.groupBy("band", "key").agg(F.max(F.struct("c", (-F.col("label")).alias("l"))).alias("m"))
    main = main.select("band", "key", (-F.col("m.l")).alias("main"), F.col("m.c").alias("c"))
    open_ = label.join(mixed_, ["band", "key"]).join(main, ["band", "key"], "left")
    others, own = (F.ceil(size / how.block).cast("int") for size in (F.col("n") - F.col("c"), F.col("c")))
    place = lambda of: F.pmod(F.xxhash64("id"), of).cast("int")
    is_main, small = F.col("label") == F.col("main"), F.col("main").isNull()
    open_ = open_.withColumn("block", F.when(small, 0).when(is_main, others + place(own)).otherwise(place(others)))
    open_ = open_.withColumn("last", F.when(small, 0).when(is_main, others - 1).otherwise(others + own - 1))
    meet = F.expr("transform(sequence(0, last), o -> struct(least(block, o) as x, greatest(block, o) as y, block > o as second))")
    return open_.select("band", "key", "id", "label", F.inline(meet))


def links(reps: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Edges ``a, b`` that connect all linked sets. reps: ``id, signature``; texts: ``id, text``."""
    size, bands = how.band, how.hashes // how.band
    keys = F.expr(
        f"transform(sequence(0, {bands - 1}), i -> struct(cast(i as short) as band, "
        f"xxhash64(substring(signature, i * {size} + 1, {size})) as key))"
    )
    rows = reps.select("id", F.inline(keys))
    several = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = stored(rows.join(several, ["band", "key"]), "crowd")

    # The member of most and largest buckets leads: the least changed copy of a group, as a rule.
    weight = crowd.groupBy("id").agg(F.sum("n").alias("w"))
    weighed = crowd.join(weight, "id")
    lead = weighed.groupBy("band", "key").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("lead"))
    best = (
        weighed.select("band", "key", "id", F.struct("w", (-F.col("id")).alias("i")).alias("own"))
        .join(lead, ["band", "key"])
        .filter(F.col("lead") > F.col("own"))
        .groupBy("id")
        .agg(F.max("lead").alias("lead"))
        .select(F.col("id").alias("a"), (-F.col("lead.i")).alias("b"))
    )
    members = weight.select("id").join(reps, "id")
    sets = stored(with_sets(members.join(texts, "id"), how), "sets")
    pairs = (
        stored(best, "stars")
        .join(sets.select(F.col("id").alias("a"), F.col("signature").alias("sig_a"), F.col("items").alias("items_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("signature").alias("sig_b"), F.col("items").alias("items_b")), "b")
    )
    stars = stored(verified(pairs, how), "links")

    # Buckets that still hold several labels, in blocks of members ordered by label.
    label = crowd.join(stars.select(F.col("a").alias("id"), F.col("b").alias("_l")), "id", "left")
    label = label.withColumn("label", F.coalesce("_l", "id")).drop("_l")
    sent = meetings(label, how).join(sets, "id")
    looks = how.least_matches()

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        part = frame.combine_chunks()
        signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(len(part), -1)
        items = [np.frombuffer(x, "<u8") for x in part.column("items").to_pylist()]
        found = block_links(
            part.column("id").to_numpy(), part.column("label").to_numpy(), signatures, items, np.array(part.column("second").to_pylist(), bool),
            key[0].as_py(), how, looks,
        )
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rest = sent.groupBy("band", "key", "x", "y").applyInArrow(run, "a long, b long")
    return stars.unionAll(rest)


def near_duplicates(df: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are runs of other than ASCII white space, A-Z lower-cased. ``component_id`` is the smallest
    id reachable over links, itself included; ``kept`` says whether that is the own id. A text without
    words is linked with nothing. Rows of one id count as one document with several texts. A row
    without id is linked with nothing: its component is null and it is kept. Other columns are left
    out; an empty table gives an empty one. Whole texts of any length are compared.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = stored(described(rows, how), "signatures")
    known = facts.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    sets = stored(known.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "representatives")
    # An id with several texts may stand for several sets: each is looked at, under the one id.
    reps = sets.select("id", "signature").distinct()
    texts = rows.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text").distinct()
    edges = links(reps, texts, how)
    member = known.select("doc_id", "set_hash").join(sets.select("set_hash", "id"), "set_hash")
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.collect_set("id").alias("all")).filter("a < b")
    edges = edges.unionAll(several.select(F.explode("all").alias("a"), F.col("a").alias("b")))
    label = components(edges)
    out = facts.select("doc_id", "n_shingles", "set_hash").join(sets.select("set_hash", "id"), "set_hash", "left")
    out = out.join(label, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
