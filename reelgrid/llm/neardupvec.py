"""Near duplicates among embeddings by iterative quantisation, multi-index Hamming tables and exact reranking.

Unit vectors are coded by the signs of rotations that a bounded sample is quantised best by. A code is split
into substrings, one hash table each; two codes that differ in fewer bits than there are tables agree in one of
them for certain, and two vectors at the threshold miss all tables with a chosen probability. Codes that meet
and lie within a Hamming radius form candidate groups, through spanning links only; a vector travels to
its group once. There all cosines are taken on the original vectors.

A group of very many near copies is ordered by the angle to its centre and cut into blocks: by the triangle
inequality most pairs of blocks are linked altogether or not at all, and only the others are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, placed, stored
from .components import components

# Rounding of a cosine in double precision stays far below this angle.
MARGIN = 1e-6


@dataclass(frozen=True)
class Search:
    """cosine: least cosine of a link; miss: chance that a pair at that cosine meets in no table.

    fit_rows: most vectors that the rotations are learned from; rounds of alternation; trials: pairs made at
    the threshold from the sample, by which tables and radius are chosen. bucket: members beyond which a
    table's bucket counts as one candidate group unseen; block: least size of the blocks of a large group.
    """

    cosine: float = 0.98
    miss: float = 1e-6
    fit_rows: int = 20_000
    rounds: int = 20
    trials: int = 2_000
    bucket: int = 512
    block: int = 128

    @property
    def angle(self) -> float:
        return math.acos(min(1.0, max(-1.0, self.cosine)))


def units(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square overflows or vanishes.
    vectors = vectors / np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def padded(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` components; shorter ones end in zeros."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = whole.flatten().to_numpy(zero_copy_only=False)
    return out


class Quantiser:
    """Rotations learned by iterative quantisation, and how many tables of ``width`` bits pairs at the threshold need."""

    def __init__(self, sample: np.ndarray, width: int, how: Search):
        self.width, self.turns = width, []
        rng = np.random.default_rng(5)
        dims = sample.shape[1]
        _, basis = np.linalg.eigh(sample.T @ sample)
        # Pairs at the threshold: sampled vectors, and those turned by the angle in a random direction.
        own = sample[rng.integers(len(sample), size=how.trials)]
        aside = rng.normal(size=own.shape)
        aside -= (aside * own).sum(axis=1, keepdims=True) * own
        aside /= np.maximum(np.sqrt((aside**2).sum(axis=1, keepdims=True)), 1e-300)
        other = how.cosine * own + math.sin(how.angle) * aside
        self.tables = tables = 4
        while True:
            while len(self.turns) * dims < tables * width:
                # Few dimensions leave few best rotations; those beyond the first eight stay as they start.
                self.turns.append(basis @ self._rotation(sample @ basis, rng, how.rounds if len(self.turns) < 8 else 0))
            self.tables = tables
            one, two = self.values(own), self.values(other)
            agree = one == two
            # The chance by the mean agreement of a table, and the share of made pairs that no table holds.
            lost = (1 - agree.mean()) ** tables
            if (lost <= how.miss and (~agree.any(axis=1)).mean() <= 1e-3) or tables >= 256:
                break
            tables += 4
        flips = np.bitwise_count(one ^ two).sum(axis=1)
        self.radius = int(max(tables - 1, flips.max(), math.ceil(flips.mean() + 6 * flips.std())))

    @staticmethod
    def _rotation(projected: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
        """The rotation after which vectors lie closest to the corners of the cube, from a random start."""
        turn = np.linalg.qr(rng.normal(size=(projected.shape[1],) * 2))[0]
        for _ in range(rounds if len(projected) > projected.shape[1] else 0):
            left, _, right = np.linalg.svd(projected.T @ np.where(projected @ turn > 0, 1.0, -1.0))
            turn = left @ right
        return turn

    def values(self, vectors: np.ndarray) -> np.ndarray:
        """The code's substrings, a column for each table."""
        bits = np.concatenate([vectors @ t > 0 for t in self.turns], axis=1)[:, : self.tables * self.width]
        weights = (1 << np.arange(self.width)).astype(np.int64)
        return np.stack([bits[:, i * self.width : (i + 1) * self.width] @ weights for i in range(self.tables)], axis=1).astype(np.int32)


def labelled(near: np.ndarray) -> np.ndarray:
    """Least index reachable from every row of a symmetric matrix of links."""
    n = len(near)
    labels = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, labels, n).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return starts, np.diff(np.r_[starts, len(keys)])


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys. For sorted batches and keys of bounded groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
        if held and (cut or held[-1].column(key)[0].as_py() != keys[0]):
            if not cut:
                yield pa.Table.from_batches(held)
                held = [batch]
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _meetings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of sorted ``b, c``: members of buckets of 2 to ``most`` (``first`` null), and of larger ones with their first member."""
    form = pa.schema([("b", pa.int64()), ("c", pa.int64()), ("first", pa.int64())])
    held_b, held_c, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # hot: bucket and first member already told

    def told(b, c, last):
        nonlocal hot
        starts, sizes = _runs(b)
        first, size = np.repeat(c[starts], sizes), np.repeat(sizes, sizes)
        large = size > most
        if hot is not None and len(b):
            again = b == hot[0]
            first[again], large[again] = hot[1], True
        hot = (b[-1], first[-1]) if not last and len(b) and large[-1] else None
        keep = large & (c != first) | ~large & (size > 1)
        return pa.RecordBatch.from_arrays([pa.array(b[keep]), pa.array(c[keep]), pa.array(first[keep], mask=~large[keep])], schema=form)

    for batch in batches:
        b, c = np.r_[held_b, batch.column("b").to_numpy()], np.r_[held_c, batch.column("c").to_numpy()]
        starts, sizes = _runs(b)
        if not len(b):
            continue
        # The last bucket may go on; it waits, unless it is known to be large.
        waits = sizes[-1] <= most and not (hot is not None and hot[0] == b[-1])
        cut = starts[-1] if waits else len(b)
        held_b, held_c = b[cut:], c[cut:]
        if cut:
            yield told(b[:cut], c[:cut], waits)
    yield told(held_b, held_c, True)


def _near_in_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` that connect the codes of each bucket that lie within the radius."""
    for part in _whole_runs(batches, "b"):
        codes = padded(part.column("code"), len(part.column("code")[0])).astype(np.int32)
        members = part.column("c").to_numpy()
        starts, sizes = _runs(part.column("b").to_numpy())
        two = starts[sizes == 2]
        two = two[np.bitwise_count(codes[two] ^ codes[two + 1]).sum(axis=1) <= radius]
        a, b = [members[two + 1]], [members[two]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = codes[start : start + size]
            apart = np.zeros((size, size), np.int32)
            for bits in own.T:
                apart += np.bitwise_count(bits[:, None] ^ bits)
            labels = labelled(apart <= radius)
            far = np.flatnonzero(labels != np.arange(size))
            a.append(members[start + far])
            b.append(members[start + labels[far]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _in_groups(batches: Iterator[pa.RecordBatch], cosine: float, dims: int) -> Iterator[pa.RecordBatch]:
    """``c, links, component`` of the members of whole groups."""
    for part in _whole_runs(batches, "g"):
        vectors, n, rep = units(padded(part.column("v"), dims)), part.column("n").to_numpy(), part.column("rep").to_numpy()
        keys = part.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
        links, component = np.zeros(len(n), np.int64), rep.copy()
        for start, size in zip(*_runs(keys)):
            own = slice(start, start + size)
            near = vectors[own] @ vectors[own].T >= cosine
            np.fill_diagonal(near, False)
            links[own] = near @ n[own]
            labels, least = labelled(near), np.full(size, np.iinfo(np.int64).max)
            np.minimum.at(least, labels, rep[own])
            component[own] = least[labels]
        yield pa.RecordBatch.from_arrays([part.column("c").combine_chunks(), pa.array(links), pa.array(component)], names=["c", "links", "component"])


def _in_large_groups(members: DataFrame, how: Search, dims: int) -> DataFrame:
    """``c, links, component`` of members (``g, size, c, n, rep, v``) of groups of any size."""
    def centre(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        return pa.table({"g": pa.array([key[0].as_py()]), "centre": pa.array([units(padded(part.column("v"), dims)).sum(axis=0).tolist()], pa.list_(pa.float64()))})

    # The centre only orders members; about 64 of them, told by a hash, give it.
    few = members.filter("pmod(xxhash64(c), ceil(size / 64)) = 0").select("g", "v")
    centres = stored(few.groupBy("g").applyInArrow(centre, "g string, centre array<double>"), "centres")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = units(padded(batch.column("v"), dims))
            # A group whose centre no member was chosen for is ordered by the angle to the first axis.
            given = np.stack([np.eye(1, dims)[0] if x is None else np.array(x) for x in batch.column("centre").to_pylist()]) if batch.num_rows else own
            angles = np.arccos(np.clip((own * given).sum(axis=1) / np.sqrt((given**2).sum(axis=1)), -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "c", "n", "rep", "v")), pa.array(angles)], names=["g", "c", "n", "rep", "v", "turn"])

    rows = members.join(centres, "g", "left").select("g", "c", "n", "rep", "v", "centre")
    rows = placed(rows.mapInArrow(turned, "g string, c long, n long, rep long, v array<double>, turn double"), "g", ["turn", "c"])
    wide = F.greatest(F.lit(how.block), F.least(F.lit(4096), (4 * F.sqrt("total")).cast("long")))
    rows = stored(rows.withColumn("i", F.call_function("div", F.col("index"), wide)), "blocks")
    blocks = rows.groupBy("g", "i").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.sum("n").alias("weight"), F.min_by("c", "index").alias("c"))
    blocks = stored(blocks, "bounds")
    one = blocks.select("g", "i", "low", "high")
    two = blocks.select("g", F.col("i").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), "weight", F.col("c").alias("c_j"))
    # Slim rows, one for each two blocks: whether all of their members are linked, or none, or they must be compared.
    sure = F.col("high") + F.col("high_j") <= how.angle - MARGIN
    both = one.join(two, "g").withColumn("sure", sure).filter(F.col("sure") | ((F.col("low_j") - F.col("high") <= how.angle + MARGIN) & (F.col("low") - F.col("high_j") <= how.angle + MARGIN)))
    both = stored(both.select("g", "i", "j", "sure", "weight", "c_j"), "block-pairs")
    linked = both.filter("sure").groupBy("g", "i").agg(F.sum("weight").alias("weight"), F.min_by("c_j", "j").alias("first"), F.max((F.col("i") == F.col("j")).cast("int")).alias("own"))
    full = rows.join(linked, ["g", "i"]).select("c", (F.col("weight") - F.when(F.col("own") == 1, F.col("n")).otherwise(0)).alias("links"), F.col("first").alias("to"))
    pairs = both.filter("NOT sure AND i <= j").select("g", "i", "j")
    sides = rows.select("g", "i", "c", "n", "v")
    left = sides.join(pairs, ["g", "i"]).select("g", "i", "j", F.lit(True).alias("left"), "c", "n", "v")
    right = sides.withColumnRenamed("i", "j").join(pairs.filter("i < j"), ["g", "j"]).select("g", "i", "j", F.lit(False).alias("left"), "c", "n", "v")

    def compare(part: pa.Table) -> pa.Table:
        left = part.column("left").to_numpy()
        vectors, n, c = units(padded(part.column("v"), dims)), part.column("n").to_numpy(), part.column("c").to_numpy()
        order = np.r_[np.flatnonzero(left), np.flatnonzero(~left)]
        vectors, n, c, cut = vectors[order], n[order], c[order], int(left.sum())
        near = vectors @ vectors.T >= how.cosine
        np.fill_diagonal(near, False)
        if cut < len(n):
            # Each side by itself is another task's work.
            near[:cut, :cut] = near[cut:, cut:] = False
        return pa.table({"c": pa.array(c), "links": pa.array((near @ n).astype(np.int64)), "to": pa.array(c[labelled(near)])})

    compared = left.unionByName(right).groupBy("g", "i", "j").applyInArrow(compare, "c long, links long, to long")
    found = stored(full.unionByName(compared), "large-links")
    joined = components(found.select(F.col("c").alias("a"), F.col("to").alias("b")).filter("a <> b"))
    labels = rows.select("c", "rep").join(joined.withColumnRenamed("node", "c"), "c", "left").select("c", "rep", F.coalesce("label", "c").alias("label"))
    labels = stored(labels, "large-labels")
    least = labels.groupBy("label").agg(F.min("rep").alias("component"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    return labels.join(least, "label").join(links, "c", "left").select("c", F.coalesce("links", F.lit(0)).alias("links"), "component")


def near_duplicates(df: DataFrame, how: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row for every row.

    Rows are linked when their labels are equal and not null (all labels with ``label_col`` None), their
    vectors are of one length, and their cosine in double precision is at least that of ``how``. n_links: other
    rows linked directly; component_id: smallest id reachable, the own one included; kept: it is the own one.
    Each row is a vector of its own, also where ids or vectors repeat; equal vectors of one label are folded before
    they are compared. Rows without id and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. An empty table gives an empty one; other columns are left out.
    """
    label = {"label": label_col} if label_col else {}
    rows = pick(df, id=id_col, v=vector_col, **label)
    own = F.col("label") if label_col else F.lit("")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), own.alias("label"))
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    fine = F.expr(f"coalesce(id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND {finite} AND exists(v, x -> x <> 0), false)")
    valid = rows.filter(fine)
    alone = rows.filter(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    classes = valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "vectors")
    facts = classes.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max(F.size("v")).alias("dims"))
    most, copies, dims = facts.agg(F.max("k"), F.max("n"), F.max("dims")).first()
    kept = (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept")
    if not most:
        return alone.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept)

    sample = classes.orderBy(F.xxhash64("c"), "c").limit(how.fit_rows).select("v").toArrow()
    # Tables so wide that vectors that are not alike seldom share a bucket.
    coder = Quantiser(units(padded(sample.column("v"), dims)), min(31, max(8, math.ceil(math.log2(most)) + 3)), how)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = coder.values(units(padded(batch.column("v"), dims)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * coder.tables), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("kind"), flat], names=["c", "kind", "code"])

    kind = F.xxhash64("label", F.size("v")).alias("kind")
    codes = stored(classes.select("c", kind, "v").mapInArrow(code, "c long, kind long, code array<int>"), "codes")
    spots = codes.select("c", "kind", F.posexplode("code").alias("t", "value")).select(F.xxhash64("kind", "t", "value").alias("b"), "c")
    met = spots.repartition("b").sortWithinPartitions("b", "c").mapInArrow(lambda batches: _meetings(batches, how.bucket), "b long, c long, first long")
    met = stored(met, "met")
    together = met.filter("first IS NULL").select("b", "c").join(codes.select("c", "code"), "c")
    radius = coder.radius
    near = together.repartition("b").sortWithinPartitions("b", "c").mapInArrow(lambda batches: _near_in_buckets(batches, radius), "a long, b long")
    links = near.unionByName(met.filter("first IS NOT NULL").select(F.col("c").alias("a"), F.col("first").alias("b")))
    groups = stored(components(links).toDF("c", "root"), "groups")
    groups = groups.unionByName(groups.select(F.col("root").alias("c"), "root").distinct())
    name = F.concat_ws(":", F.col("root").cast("string"), F.size("v").cast("string"), F.col("label").cast("string"))
    inside = classes.join(groups, "c").select(name.alias("g"), "c", "n", "rep", "v")
    inside = stored(inside, "candidates")
    sizes = inside.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    large = stored(sizes.filter(F.col("size") > how.block), "large")
    small = inside.join(large, "g", "left_anti") if large.limit(1).count() else inside
    cosine = how.cosine
    found = small.select("g", "c", "n", "rep", "v").repartition("g").sortWithinPartitions("g").mapInArrow(
        lambda batches: _in_groups(batches, cosine, dims), "c long, links long, component long"
    )
    if large.limit(1).count():
        found = found.unionByName(_in_large_groups(inside.join(large, "g"), how, dims))
    linked = classes.select("c", "rep", "n").join(found, "c", "left").select(
        "c", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "n"
    )
    if copies > 1:
        linked = stored(linked, "linked")
        same = [F.col("label") == F.col("_label"), F.col("v") == F.col("_v"), F.xxhash64("label", "v") == F.col("_h")]
        several = classes.filter("n > 1").select("c", F.col("label").alias("_label"), F.col("v").alias("_v"), F.xxhash64("label", "v").alias("_h"))
        ids = valid.join(several, same[0] & same[1] & same[2]).select("id", "c")
        linked = linked.filter("n = 1").select(F.col("rep").alias("id"), "n_links", "component_id").unionByName(
            ids.join(linked.select("c", "n_links", "component_id"), "c").drop("c")
        )
    else:
        linked = linked.select(F.col("rep").alias("id"), "n_links", "component_id")
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", kept)
