"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from messy_rows import ROWS, frame

from reelgrid.llm import fmindex, neardup, substrings
from reelgrid.llm.common import by_bitmap, without
from reelgrid.llm.components import components
from reelgrid.llm.wordhash import WordHashes


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < size else (tuple(w[i : i + size]) for i in range(len(w) - size + 1)))


def brute(rows, size=3, percent=85):
    """Smallest id reachable over all links, by comparing everything with everything."""
    rows = sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: r[0])
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingle_set(t, size)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def group(rng, n, words, edits):
    base = [f"v{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check_near(spark, rows, how):
    got = neardup.near_duplicates(frame(spark, rows), how).collect()
    want = brute(rows, how.shingle, how.percent)
    assert len(got) == len(rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles) for r in got) == sorted(
        (i if i is not None else -1, len(shingle_set(t, how.shingle))) for i, t in rows
    )
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id == r.component_id)


def test_messy_rows(spark):
    check_near(spark, ROWS, neardup.Similarity())


@pytest.mark.parametrize("block", [1024, 8])
def test_groups_of_graded_copies(spark, block):
    """Chains of links, groups near the threshold, and buckets cut into blocks."""
    rng = random.Random(4)
    texts = [t for _ in range(4) for t in group(rng, 40, 90, 8)] + ["Same Text here now"] * 30 + group(rng, 60, 40, 2)
    rng.shuffle(texts)
    check_near(spark, list(enumerate(texts)), neardup.Similarity(block=block))


def test_large_buckets_with_strangers(spark):
    """One group above the block, another that shares its passages, and single texts near both."""
    rng = random.Random(9)
    base = [f"v{rng.randrange(5000)}" for _ in range(80)]
    edit = lambda words, n: [f"e{rng.randrange(10**6)}" if i in places else w for places in [set(rng.sample(range(80), n))] for i, w in enumerate(words)]
    other = base[:40] + [f"w{rng.randrange(5000)}" for _ in range(40)]
    texts = [" ".join(edit(base, rng.randrange(3))) for _ in range(60)] + [" ".join(edit(other, rng.randrange(3))) for _ in range(20)]
    texts += [" ".join(edit(base, n)) for n in (2, 3, 4, 5)] + [" ".join(base[:k] + other[k:]) for k in (45, 60, 75)]
    rng.shuffle(texts)
    check_near(spark, list(enumerate(texts)), neardup.Similarity(block=6))


def test_a_large_group_meets_strangers_only(spark):
    how = neardup.Similarity(block=16)
    rows = [(0, 7, i, 1003, 5) for i in range(1000)] + [(0, 7, 2000 + i, 1003, 2000 + i) for i in range(3)]
    rows += [(1, 7, i, 4, i // 2) for i in range(4)] + [(2, 7, i, 9, 3) for i in range(9)]
    sent = neardup.meetings(spark.createDataFrame(rows, "band int, key long, id long, n long, label long"), how).collect()
    groups = {}
    for r in sent:
        groups.setdefault((r.band, r.x, r.y), []).append(r)
    met = set()
    for (band, x, y), members in groups.items():
        for a in members:
            met |= {(band, min(a.id, b.id), max(a.id, b.id)) for b in members if a.label != b.label and (x == y or a.second != b.second)}
    want = {(0, i, 2000 + j) for i in range(1000) for j in range(3)} | {(0, 2000, 2001), (0, 2000, 2002), (0, 2001, 2002)}
    want |= {(1, i, j) for i in (0, 1) for j in (2, 3)}
    assert met == want and sum(r.band == 0 for r in sent) == 1000 + 3 * (1 + 63)


@pytest.mark.parametrize("percent", [91, 95, 100])
def test_high_similarities(spark, percent):
    rng = random.Random(percent)
    check_near(spark, list(enumerate(group(rng, 12, 200, 3))) + ROWS[:3], neardup.Similarity(percent=percent))


def test_five_words_at_four_fifths(spark):
    rng = random.Random(5)
    check_near(spark, list(enumerate(group(rng, 50, 120, 6))), neardup.Similarity(shingle=5, percent=80))


def test_ids_with_several_texts(spark):
    rng = random.Random(6)
    a, b = group(rng, 2, 50, 0)[0], group(rng, 2, 50, 0)[0]
    check_near(spark, [(5, a), (3, a), (5, b), (4, b), (9, "x y z"), (9, None)], neardup.Similarity())


def test_empty_table_near(nothing):
    assert neardup.near_duplicates(nothing).count() == 0


def test_miss_probability_of_banding_and_pruning():
    for how in (neardup.Similarity(), neardup.Similarity(shingle=5, percent=80)):
        t = how.percent / 100
        assert (1 - t**how.band) ** (how.hashes // how.band) <= how.miss
        rng = np.random.default_rng(1)
        for n, least in how.least_matches():
            assert (rng.binomial(n, t, 100_000) >= least).mean() > 0.9999


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in up} == {x: root(x) for x in up}


def test_bitmap_loses_nothing(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    ids = spark.range(0, 1000, 7)
    maybe, sure = by_bitmap(rows, "k", ids, bits=256)
    assert maybe.count() + sure.count() == 1000 and {r.k for r in maybe.collect()} >= set(range(0, 1000, 7))
    assert without(rows, "k", ids).count() == 1000 - len(range(0, 1000, 7))


# Repeated passages


def brute_repeats(rows, window):
    """Per document in order: number of words, kept words."""
    seen, out = set(), []
    for text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def check_repeats(spark, texts, window=20):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame(spark, list(enumerate(texts))), window).collect()}
    for i, (n, gone, kept) in enumerate(brute_repeats(texts, window)):
        assert got[i] == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), i


def mixture(rng, n):
    passage = [f"p{i}" for i in range(60)]
    line = [f"l{i}" for i in range(12)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            kind = rng.randrange(4)
            if kind == 0:
                a = rng.randrange(30)
                words += passage[a : a + rng.randrange(5, 31)]
            elif kind == 1:
                words += line
            elif kind == 2:
                words += ["z"] * rng.randrange(50)
            else:
                words += [f"r{rng.randrange(40)}" for _ in range(rng.randrange(40))]
        texts.append(" ".join(words))
    return texts


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    texts = mixture(rng, 120)
    check_repeats(spark, texts + texts[:5] + [None, "", "one", " \t "])


def test_hot_runs_are_split_by_windows(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "SEGMENTS_IN_SHARD", 50)
    check_repeats(spark, mixture(rng, 120))


def test_repeats_in_messy_rows(spark):
    """Null ids come first; texts of one id stand in the order of their hashes."""
    rows = ROWS + [(11, "a b c d e f g h i j k l m n o p q r s t u"), (11, "x a b c d e f g h i j k l m n o p q r s t u")]
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    want = {}
    for (i, t), (n, gone, kept) in zip(order, brute_repeats([t for _, t in order], 20)):
        want.setdefault(i, []).append((n, gone, hashlib.sha256(kept.encode()).hexdigest()))
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) in want[r.doc_id]


def test_texts_without_repeats(spark):
    rng = random.Random(10)
    texts = mixture(rng, 40)
    df = frame(spark, list(enumerate(texts)))
    out = substrings.without_repeats(df, count_col="n_chars")
    assert out.columns == df.columns
    rows = {r[0]: r for r in out.collect()}
    for i, (t, (_, gone, kept)) in enumerate(zip(texts, brute_repeats(texts, 20))):
        assert rows[i][1] == (kept if gone else t) and rows[i][8] == len(rows[i][1])


def test_empty_table_repeats(nothing):
    assert substrings.remove_repeats(nothing).count() == 0
    assert substrings.without_repeats(nothing).count() == 0


def test_segments_hold_equal_windows_together():
    """Equal windows have the same smallest run; every window is in one segment."""
    rng = random.Random(11)
    words = [f"q{rng.randrange(3)}".encode() for _ in range(400)]
    run, content, start, n = substrings.segments(WordHashes().of(words), 20, substrings.Powers())
    assert n.sum() == 381 and start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all()
    by = {}
    for r, c, s, k in zip(run.tolist(), content.tolist(), start.tolist(), n.tolist()):
        for w in range(s, s + k):
            assert by.setdefault(tuple(words[w : w + 20]), r) == r


def test_index_counts_and_finds():
    rng = np.random.default_rng(12)
    text = rng.integers(1, 5, 2000)
    text[np.r_[100:2000:100, 1999]] = 0
    index = fmindex.FmIndex(text)
    for a in range(0, 1980, 37):
        pattern = text[a : a + 6]
        if (pattern == 0).any():
            continue
        low, high = index.starts[pattern[-1:]], index.starts[pattern[-1:] + 1]
        for c in pattern[-2::-1]:
            low, high = index.step(low, high, np.array([c]))
        assert high[0] - low[0] == sum((text[i : i + 6] == pattern).all() for i in range(1995))
    starts = np.array([i for i in range(1990) if not (text[i : i + 6] == 0).any()])
    first = {}
    want = [first.setdefault(tuple(text[i : i + 6]), i) for i in starts]
    assert fmindex.repeated_windows(text, starts, 6).tolist() == want
