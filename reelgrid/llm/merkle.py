"""Merkle manifest of a dataset: a persistent tree whose tampered leaves become versions that share all untouched nodes.

Leaves ascend in their group; runs of ``fan`` consecutive nodes become one node until a single one, the subroot,
remains, and subroots become the root in the same way. Aligned blocks of ``fan ** height`` nodes are one task's work:
a first pass gives block roots, which are the leaves of the next tier, so no tree passes through one task. A second
pass brings every block the siblings above it. There a tampered leaf copies its own ancestors only: those of the
block, then, from the block's siblings above, those of the upper tiers and of the tree of groups.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, placed, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Shape:
    """fan: children of a node, 255 at most; height: levels above the leaves that one task builds."""

    fan: int = 8
    height: int = 4

    @property
    def block(self) -> int:
        return self.fan**self.height


def joined(digests: list[bytes]) -> bytes:
    """The digest of concatenated digests, all as lowercase hexadecimal text."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def leaf_digest(*fields: Column) -> Column:
    """Digest of fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*framed), 256)


class Block:
    """The levels of an aligned block of a persistent tree; a version is the list of the nodes that it copies."""

    def __init__(self, leaves: list[bytes], shape: Shape, whole: bool):
        """``whole``: the block is its group's only one and ends at a single node, else at ``height``."""
        self.fan, self.levels = shape.fan, [leaves]
        while len(self.levels[-1]) > 1 if whole else len(self.levels) <= shape.height:
            nodes = self.levels[-1]
            self.levels.append([joined(nodes[i : i + shape.fan]) for i in range(0, len(nodes), shape.fan)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def proof(self, at: int) -> tuple[bytes, bytes]:
        """Siblings of the node and its ancestors, and for each level the place in the run and its size (a byte each)."""
        siblings, places = [], bytearray()
        for nodes in self.levels[:-1]:
            first = at - at % self.fan
            run = nodes[first : first + self.fan]
            places += bytes((at - first, len(run)))
            del run[at - first]
            siblings += run
            at //= self.fan
        return b"".join(siblings), bytes(places)


def copies(leaf: bytes, siblings: bytes, places: bytes) -> list[bytes]:
    """The new version's own nodes from the leaf to the root; every other node is the siblings', shared."""
    path, at = [leaf], 0
    for place, size in zip(places[::2], places[1::2]):
        cut, end = at + 64 * place, at + 64 * (size - 1)
        path.append(joined([siblings[at:cut], path[-1], siblings[cut:end]]))
        at = end
    return path


def _tree(part: pa.Table, shape: Shape) -> tuple[pa.Table, Block]:
    part = part.sort_by("index")
    whole = part.column("total")[0].as_py() <= shape.block
    return part, Block([d.encode() for d in part.column("digest").to_pylist()], shape, whole)


def climb(nodes: DataFrame, shape: Shape) -> DataFrame:
    """``g, block, siblings, places, top`` of all blocks of nodes (``g, index, digest, total``): the way to the group's subroot."""
    block = F.expr(f"index div {shape.block}").alias("block")

    def root(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part, tree = _tree(part, shape)
        total = -(-part.column("total")[0].as_py() // shape.block)
        columns = [pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([tree.root.decode()]), pa.array([total], pa.int64())]
        return pa.table(columns, ["g", "index", "digest", "total"])

    above = stored(nodes.select("*", block).groupBy("g", "block").applyInArrow(root, "g string, index long, digest string, total long"), "blocks")
    if not above.filter("total > 1").limit(1).count():
        return above.select("g", F.col("index").alias("block"), F.lit("").alias("siblings"), F.lit(b"").alias("places"), F.col("digest").alias("top"))
    return proofs(above, climb(above, shape), shape).withColumnRenamed("index", "block")


def proofs(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """``g, index, siblings, places, top`` of every node: its block's part, then its block's way up."""

    def prove(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part, tree = _tree(part, shape)
        over, way, top = (part.column(c)[0].as_py() for c in ("siblings", "places", "top"))
        own = [tree.proof(i) for i in range(part.num_rows)]
        columns = [part.column("g"), part.column("index"), pa.array([s.decode() + over for s, _ in own], pa.string())]
        return pa.table([*columns, pa.array([p + way for _, p in own], pa.binary()), pa.array([top] * part.num_rows, pa.string())], ["g", "index", "siblings", "places", "top"])

    return _under(nodes, above, shape).groupBy("g", "block").applyInArrow(prove, "g string, index long, siblings string, places binary, top string")


def _under(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"index div {shape.block}")).join(above, ["g", "block"])


def document_leaves(df: DataFrame, tampered: Column, changed: str = "text", fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """``id, g, leaf, new_leaf``: leaf digests, and digests after ``changed`` lost its capitals A to Z where ``tampered``.

    ``tampered`` is a condition on ``id``; where it is null or false, or where the field is null, nothing
    changes and ``new_leaf`` is null or equals ``leaf``.
    """
    rows = pick(df, **{f"f{i}": name for i, name in enumerate(fields)}, id=id_col, group=group_col)
    own = [F.col(f"f{i}") for i in range(len(fields))]
    after = [F.translate(c, UPPER, UPPER.lower()) if name == changed else c for name, c in zip(fields, own)]
    # A null group comes first, in an order of its own by UTF-8 bytes.
    group = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-"))
    return rows.select("id", group.alias("g"), leaf_digest(*own).alias("leaf"), F.when(tampered, leaf_digest(*after)).alias("new_leaf"))


def manifest(leaves: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``id, leaf, subroot, root, siblings, places, copied, folded_root, verified`` of every leaf (``id, g, leaf, new_leaf``).

    siblings: digests beside the leaf's path to the root, level by level, left to right, as one text;
    places: place in the run and size of the run of every level, a byte each. copied: nodes of the version that
    the tampered leaf makes, from the leaf to the root (null where ``new_leaf`` is); all others are shared.
    folded_root: recomputed from the tampered, else the original leaf and the siblings; verified: it is the root.

    Groups and ids may be null: null ids come first in their group, the null group before all others. Equal
    ids are told apart by their leaves, wholly equal rows are interchangeable; each has its own place. An
    empty table gives an empty manifest. Large groups are spread over blocks, equal rows over partitions.
    """
    nodes = placed(leaves, "g", ["id", "leaf"]).withColumnRenamed("leaf", "digest")
    above = stored(climb(nodes, shape), "ways")
    # The tree of groups, over one subroot for each.
    tops = placed(above.filter("block = 0").select(F.lit("").alias("all"), "g", F.col("top").alias("digest")), "all", ["g"])
    tops = stored(tops, "subroots")
    ranked = tops.select(F.col("all").alias("g"), "index", "digest", "total")
    ways = proofs(ranked, climb(ranked, shape), shape).select("index", F.col("siblings").alias("_s"), F.col("places").alias("_p"), F.col("top").alias("root"))
    ways = tops.select("g", "index").join(ways, "index").drop("index")
    above = above.join(ways, "g").select(
        "g", "block", F.concat("siblings", "_s").alias("siblings"), F.concat("places", "_p").alias("places"), F.col("top").alias("subroot"), "root"
    )

    def fold(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part, tree = _tree(part, shape)
        over, way, subroot, root = (part.column(c)[0].as_py() for c in ("siblings", "places", "subroot", "root"))
        out: list[list] = [[], [], [], [], []]
        for i, (leaf, new) in enumerate(zip(tree.levels[0], part.column("new_leaf").to_pylist())):
            siblings, places = tree.proof(i)
            siblings, places = siblings + over.encode(), places + way
            path = copies(leaf if new is None else new.encode(), siblings, places)
            for column, value in zip(out, (siblings.decode(), places, None if new is None else [d.decode() for d in path], path[-1].decode(), path[-1].decode() == root)):
                column.append(value)
        n, types = part.num_rows, (pa.string(), pa.binary(), pa.list_(pa.string()), pa.string(), pa.bool_())
        columns = [part.column("id"), part.column("digest"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())]
        return pa.table(columns + [pa.array(v, t) for v, t in zip(out, types)], [f.split()[0] for f in schema.split(", ")])

    schema = f"id {leaves.schema['id'].dataType.simpleString()}, leaf string, subroot string, root string, siblings string, places binary, copied array<string>, folded_root string, verified boolean"
    return _under(nodes, above, shape).groupBy("g", "block").applyInArrow(fold, schema)


def document_manifest(df: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Manifest of documents, those tampered whose ``doc_id`` has a CRC-32 (of the decimal text) that 3 divides; a null id is not."""
    tampered = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0
    return manifest(document_leaves(df, tampered), shape)
