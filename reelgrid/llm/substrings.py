"""Repeated word windows, found with one compressed FM-index per shard.

Every window of ``window`` words belongs to the shard of its smallest 5-word hash, so equal windows
always meet. Neighbouring windows with the same smallest run form one segment. Segments of equal content
are folded (all but the first are repeats as a whole), and segments whose run stands nowhere else are
dropped. Of what is left each shard builds an FM-index and streams its segments through it: backward
search gives the matching statistics, and windows that stand earlier too are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bitmap, likely, pick, plainly, slices, stored
from .fmindex import repeated_windows
from .wordhash import FACTORS, WordHashes, mixed, runs

RUN = 5
SEGMENTS_IN_SHARD = 20_000
HOT = 4_096  # distinct segments of one run; more are split by whole windows


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Powers:
    """Powers of an odd factor and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            factor = FACTORS[2]
            powers = [np.full(2 * n, f, np.uint64) for f in (factor, pow(factor, -1, 1 << 64))]
            for p in powers:
                p[0] = 1
                np.multiply.accumulate(p, out=p)
            self.up, self.down = powers
        return self.up, self.down


def segments(hashes: np.ndarray, window: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(smallest run, content hash, start, number of windows) of each segment of a text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    run = runs(hashes, RUN)
    least, width, want = np.arange(len(run)), 1, window - RUN + 1
    while width < want:
        step = min(width, want - width)
        a, b = least[:-step], least[step:]
        least, width = np.where(run[b] < run[a], b, a), width + step  # leftmost at equal hashes
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[cut, n])
    up, down = powers.of(len(hashes) + 1)
    before = np.r_[np.uint64(0), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)]
    content = (before[cut + count + window - 1] - before[cut]) * down[cut]
    content = mixed(content + count.astype(np.uint64) * np.uint64(FACTORS[0]))
    return run[least[cut]], content, cut, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def scanned(docs: DataFrame, window: int) -> DataFrame:
    """``pos, n_words, all_sha256`` and the segments of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), Powers()
        for part in slices(batches, "text"):
            counts, digests, found = [], [], []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(segments(hashes.of(words), window, powers))
            sizes = [len(s[0]) for s in found]
            flat = pa.StructArray.from_arrays(
                [
                    _signed(np.concatenate([s[0] for s in found])), _signed(np.concatenate([s[1] for s in found])),
                    *(pa.array(np.concatenate([s[k] for s in found]).astype(np.int32)) for k in (2, 3)),
                ],
                ["run", "content", "start", "n"],
            )
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("pos"), pa.array(counts, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(offsets, flat)],
                ["pos", "n_words", "all_sha256", "segments"],
            )

    return docs.select("pos", "text").mapInArrow(run, "pos long, n_words long, all_sha256 string, segments array<struct<run:bigint,content:bigint,start:int,n:int>>")


def contents(texts: DataFrame, window: int) -> DataFrame:
    """Words of the wanted segments; hot ones as their single windows, by window hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, "text"):
            rows = []
            for pos, text, wanted in zip(*(part.column(c).to_pylist() for c in ("pos", "text", "wanted"))):
                words = hashes.of(words_of(text))
                whole = runs(words, window)
                for s in wanted:
                    start, n = s["start"], s["n"]
                    if s["hot"]:
                        rows += [(h, True, pos, start + i, 1, None) for i, h in enumerate(whole[start : start + n].view(np.int64).tolist())]
                    else:
                        rows.append((s["run"], False, pos, start, n, words[start : start + n + window - 1].tobytes()))
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            for at in range(0, len(rows), 20_000):
                columns = zip(*rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["run", "hot", "pos", "start", "n", "words"])

    return texts.select("pos", "text", "wanted").mapInArrow(run, "run long, hot boolean, pos long, start int, n int, words binary")


def shard_repeats(window: int):
    """Kernel of one shard: index its segments, stream them, report covered word ranges."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("pos", "ascending"), ("start", "ascending")]).combine_chunks()
        pos, start, n = (part.column(c).to_numpy().astype(np.int64) for c in ("pos", "start", "n"))
        words = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint64)
        sizes = n + window - 1
        symbols = np.unique(words, return_inverse=True)[1] + 1
        ends = np.cumsum(sizes) + np.arange(len(sizes))  # place of each separator
        text = np.zeros(len(symbols) + len(sizes), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols
        first = ends - sizes
        segment = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
        own = first[segment] + offset
        # Text order is document order, so the earliest place in the text is the earliest window.
        repeat = repeated_windows(text, own, window) < own
        a = (start[segment] + offset)[repeat]
        doc = pos[segment][repeat]
        # Neighbouring windows of a document as one range.
        new = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] != a[:-1] + 1)] if len(a) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(a)] - 1 if len(a) else at
        return pa.table({"pos": doc[at], "from": a[at].astype(np.int32), "to": (a[last] + window).astype(np.int32)})

    return run


def trimmed(texts: DataFrame) -> DataFrame:
    """``pos, n_removed, kept_sha256, kept`` of texts without the words in ``ranges`` (from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            removed, digests, texts_ = [], [], []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                words = words_of(text)
                out, at = [], 0
                for r in sorted(ranges, key=lambda r: r["from"]):
                    out += words[at : r["from"]]
                    at = max(at, r["to"])
                out += words[at:]
                kept = b" ".join(out)
                removed.append(len(words) - len(out))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts_.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("pos"), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts_)], ["pos", "n_removed", "kept_sha256", "kept"]
            )

    return texts.select("pos", "text", "ranges").mapInArrow(run, "pos long, n_removed long, kept_sha256 string, kept string")


def positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (``pos, text``) in document order, and the rows they stand for, with ``pos``.

    The order is the id itself where ids tell documents apart. Otherwise null ids come first and texts of
    one id in the order of their hashes; wholly equal texts of one id are one document.
    """
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if not odd.limit(1).count():
        rows = rows.withColumn("pos", F.col("doc_id").cast("long"))
        return rows.select("pos", "text"), rows
    rows = rows.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = rows.select("doc_id", "_digest").distinct().sort(F.asc_nulls_first("doc_id"), "_digest")
    order = order.sparkSession.createDataFrame(
        order.rdd.zipWithIndex().map(lambda t: (t[0][0], t[0][1], t[1])), "_id long, _d string, pos long"
    )
    order = stored(order, "order")
    placed = rows.join(order, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d"))).drop("_id", "_d", "_digest")
    return placed.groupBy("pos").agg(F.first("text").alias("text")), placed


def repeated_ranges(docs: DataFrame, scan: DataFrame, window: int) -> DataFrame:
    """``pos, ranges``: word ranges (from, to) covered by windows that stand earlier too."""
    rows = scan.select("pos", F.inline("segments"))
    several = rows.groupBy("run").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("run")
    # Aggregates are stored before joins: a skewed join can be split only between two plain exchanges.
    several = stored(several, "runs")
    rows = stored(rows.join(several, "run"), "segments")
    distinct = stored(rows.groupBy("run", "content").agg(F.min(F.struct("pos", "start")).alias("first"), F.first("n").alias("n")), "distinct")
    # A document's segments less those that are the first of their content: later copies, repeats as a
    # whole. Both sides are lists of one document, so no frequent content is a join key.
    code = lambda start: (F.col(start).cast("long") * 65536 + F.col("n")).alias("code")
    own = rows.select("pos", code("start")).groupBy("pos").agg(F.collect_list("code").alias("own"))
    firsts = distinct.select("first.pos", code("first.start")).groupBy("pos").agg(F.collect_list("code").alias("firsts"))
    later_copies = F.array_except("own", F.coalesce("firsts", F.array().cast("array<bigint>")))
    whole = own.join(firsts, "pos", "left").select("pos", later_copies.alias("codes")).filter("size(codes) > 0")
    whole = whole.select("pos", F.expr(
        f"transform(codes, c -> struct(cast(c div 65536 as int) as from, cast(c div 65536 + c % 65536 + {window - 1} as int) as to))"
    ).alias("whole"))

    unlike = distinct.groupBy("run").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    unlike = stored(unlike, "unlike")
    wanted = distinct.join(unlike, "run").select("first.pos", F.struct("run", F.col("first.start").alias("start"), "n", (F.col("kinds") > HOT).alias("hot")).alias("w"))
    wanted = stored(stored(wanted, "ambiguous").groupBy("pos").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = likely(docs, "pos", wanted.select("pos"))
    found = stored(contents(texts.join(wanted, "pos"), window), "contents")

    cold = found.filter("NOT hot")
    shards = max(1, -(-cold.count() // SEGMENTS_IN_SHARD))
    cold = cold.withColumn("shard", F.pmod(F.xxhash64("run"), F.lit(shards)))
    indexed = cold.groupBy("shard").applyInArrow(shard_repeats(window), "pos long, from int, to int")
    hot = found.filter("hot").select(F.col("run").alias("window"), "pos", "start")
    first = hot.groupBy("window").agg(F.min(F.struct("pos", "start")).alias("first"))
    first = stored(first, "first")
    later = hot.join(first, "window").filter("struct(pos, start) > first")
    parts = indexed.unionAll(later.select("pos", F.col("start").alias("from"), (F.col("start") + window).alias("to")))
    parts = parts.groupBy("pos").agg(F.collect_list(F.struct("from", "to")).alias("parts"))
    none = F.array().cast("array<struct<from:int,to:int>>")
    return whole.join(parts, "pos", "full").select("pos", F.concat(F.coalesce("whole", none), F.coalesce("parts", none)).alias("ranges"))


def _cut(docs: DataFrame, scan: DataFrame, window: int) -> DataFrame:
    """``trimmed`` for the documents that lose words."""
    covered = stored(repeated_ranges(docs, scan, window), "ranges")
    return trimmed(likely(docs, "pos", covered.select("pos")).join(covered, "pos"))


def remove_repeats(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    Words are runs of other than ASCII white space. A word goes if a window over it has the same words
    as a window that starts earlier: in a document of smaller id, or earlier in the same one. The hash is
    that of the kept words, joined by one space. A null or empty text has no words. Null ids come first;
    rows of one id with different texts are documents of their own, in a fixed order; wholly equal rows
    are one document and give equal rows. Other columns are left out; an empty table gives an empty one.
    Texts may have any length. ``without_repeats`` gives the texts.
    """
    rows = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs, members = positions(rows)
    scan = stored(scanned(docs, window), "scan")
    cut = _cut(docs, scan, window).drop("kept")
    out = members.select("doc_id", "pos").join(scan.select("pos", "n_words", "all_sha256"), "pos").join(cut, "pos", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")
    )


def without_repeats(df: DataFrame, window: int = 20, count_col: str | None = None) -> DataFrame:
    """All rows and columns (among them ``doc_id`` and ``text``), repeats taken out of the texts.

    A text that loses words becomes its kept words joined by one space, and ``count_col`` its number of
    code points; other texts stay as they are. Order, nulls and repeated rows as in ``remove_repeats``.
    """
    rows, back = plainly(df, **({"doc_id": "doc_id", "text": "text"} | ({"count": count_col} if count_col else {})))
    docs, members = positions(rows)
    cut = stored(_cut(docs, stored(scanned(docs, window), "scan"), window).select(F.col("pos").alias("_pos"), "kept"), "kept")
    maybe, untouched = by_bitmap(members, "pos", cut.select("_pos"))
    changed = maybe.join(cut, F.col("pos") == F.col("_pos"), "left").withColumn("text", F.coalesce("kept", "text"))
    if count_col:
        length = F.when(F.col("kept").isNotNull(), F.char_length("kept")).otherwise(F.col("count"))
        changed = changed.withColumn("count", length.cast(rows.schema["count"].dataType))
    return back(untouched.select(*rows.columns).unionAll(changed.select(*rows.columns)))
