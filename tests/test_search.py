"""Searches of a wide radius, by blocks of queries and samples."""

import random

import pytest

from reelgrid.operators import search as V

SAMPLES = "media_id string, presentation_index bigint, pt_ns bigint, perceptual_hash bigint"
QUERIES = "query_id bigint, media_id string, q_hash bigint, q_time bigint, q_index bigint"


def wanted(queries, samples, results, distance):
    out = []
    first = lambda x: (x is not None, x or 0)
    for qid, m, h, t, i in queries:
        hits = []
        for sm, si, st, sh in samples:
            if sm != m or h is None or sh is None:
                continue
            known = i is not None and si is not None and i >= 0 and si >= 0
            own = i == si if known else t is not None and t == st
            d = ((h ^ sh) & (2**64 - 1)).bit_count()
            if d <= distance and not own:
                hits.append((d, first(None if t is None or st is None else abs(st - t)), first(st), first(si), (qid, st, si, d)))
        out += [(*x[-1], k + 1) for k, x in enumerate(sorted(hits)[:results])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [5, 8192])
def test_matching_pairs_are_no_rows(spark, monkeypatch, block):
    """All pairs within a wide radius were rows that were shuffled to be ranked."""
    rng = random.Random(3)
    value = lambda: rng.choice([None, -1, 2**63 - 1, rng.getrandbits(6), rng.getrandbits(63) - 2**62])
    samples = [(m, rng.choice([None, -1, k]), rng.choice([None, k * 5, 40]), value()) for m, n in (("a", 60), ("b", 7), ("c", 1)) for k in range(n)]
    samples = list(dict.fromkeys(samples))
    queries = [(k, rng.choice("aab"), value(), rng.choice([None, 40, k * 5]), rng.choice([None, -1, k])) for k in range(40)] + [(99, "none", 1, 1, 1)]
    monkeypatch.setattr(V, "hamming", lambda *a: pytest.fail("pairs as rows"))
    monkeypatch.setattr(V, "BLOCK_ROWS", block, raising=False)
    distinct = {s[:3] for s in samples}
    samples = [s for s in samples if sum(x[:3] == s[:3] for x in samples) == 1]
    assert len(samples) > len(distinct) / 2
    got = V.find_similar(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(samples, SAMPLES), 4, 28).collect()
    want = wanted(queries, samples, 4, 28)
    assert want and sorted(((r.query_id, r.pt_ns, r.presentation_index, r.hamming, r.rank) for r in got), key=repr) == want
