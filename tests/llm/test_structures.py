"""Conversation repair, the Merkle manifest and near duplicates of embeddings, against brute force."""

import hashlib
import math
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import oracle
import pytest

from reelgrid.llm import merkle, neardupvec, sharding, turns
from reelgrid.llm.common import placed
from reelgrid.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    message, ok = oracle.compare(spark, oracle.connect(FOLDER), FOLDER, name, SimpleNamespace(run=QUERIES[name], sql=ORACLE_SQL[name]))
    assert ok, message


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Conversations


def all_edits(rows):
    """Least cost and audit by a table over prefixes, states and whole audits."""

    def inserted(states):
        for _ in range(4):
            for q, (cost, audit) in list(states.items()):
                new = (cost + 5, audit + "I")
                states[turns.NEXT[q]] = min(states.get(turns.NEXT[q], new), new)
        return states

    states = inserted({0: (0, "")})
    for row in rows:
        new = {}
        for q, (cost, audit) in states.items():
            extra = 5 if row.truncated else 0
            options = [("D" * row.run, q, 2 * row.run)]
            if not row.must_go:
                options.append(("R", turns.NEXT[q], 1 + extra))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, row.initial))
                options += [("K", kept, extra)] if kept else []
            for letters, to, more in options:
                value = (cost + more, audit + letters)
                new[to] = min(new.get(to, value), value)
        states = inserted(new)
    return min(states[q] for q in (0, 3) if q in states)


def test_least_audit_of_all_cheapest_edits():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [turns.Row(rng.choice(["s", "u", "a", "x", ""]), rng.random() < 0.2) for _ in range(rng.randrange(14))]
        rows = [r._replace(run=rng.randrange(1, 4)) if r.must_go else r._replace(truncated=rng.random() < 0.3) for r in rows]
        want = all_edits(rows)
        assert turns.cheapest(tuple(rows)) == want
        assert turns.cheapest_edits(rows, rng.randrange(1, 5)) == want


def test_searches_from_both_ends_meet():
    rows = tuple(turns.Row("ua"[i % 2]) for i in range(40))
    assert turns.cheapest(rows) == (0, "K" * 40)
    assert turns.cheapest((turns.Row("a"),), turns.ASSISTANT, (turns.SYSTEM,)) is None
    assert turns.cheapest(()) == (0, "") and turns.cheapest((), turns.NOTHING, (turns.ASSISTANT,)) == (10, "II")


def by_hand(rows):
    """Damage and repair of conv_id, turn, role, text rows as the definition reads."""
    talks = {}
    for conv, turn, role, text in rows:
        talk = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        talk += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = [r[0] for r in talk if r[0] is not None]
        seen, faults, lattice = set(), [0, 0, 0], []
        for _, role, text in talk:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            lattice.append(turns.Row(role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit = all_edits(lattice)
        lines, state, left = [], 0, iter(talk)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[:1]] if edit == "K" else turns.NEXT[state]
                lines.append((role if edit == "K" else {2: "user", 3: "assistant"}[state]) + ":" + text)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def messy_talks():
    rng = random.Random(7)
    texts = [None, "", ".", "Hi.", "Hi", "Yes!", " \t", "a?b", "long " * 5000 + "end.", "é漢 ok?", "x.\x0b"]
    pick = lambda *values: rng.choice(values)
    return [(pick(None, 1, 2, 3, 4), pick(None, 0, 1, 2, 3, 5, 9), pick(None, "", "user", "assistant", "system", "tool"), rng.choice(texts)) for _ in range(300)] + [(9, 4, "user", "Same.")] * 40


TALK = "conv_id long, turn long, role string, text string, Text string, g string, copies string, audit string"


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None, "z") for r in rows], TALK)


@pytest.mark.parametrize("limits", [turns.Limits(), turns.Limits(segment=7, rows=4), turns.Limits(segment=3, size=20_000)], ids=str)
def test_repair_of_messy_conversations(spark, limits):
    """Nulls, empty and very long texts, equal turns, repeated rows, clashing names; spread over tasks or not."""
    rows = messy_talks()
    assert rows_of(turns.repair(turns.damaged(talk_frame(spark, rows)), limits)) == by_hand(rows)


def test_a_conversation_with_a_third_of_all_rows_is_spread(spark):
    rng = random.Random(3)
    texts = ["Ok.", "No", "Fine!", "", "Tell me more?"]
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(texts) + (f"{i}." if i % 3 else "")) for i in range(1200)]
    rows += [(2 + i // 4, i % 4, "ua"[i % 2] and ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(2400)]
    found = turns.repair(turns.damaged(talk_frame(spark, rows)), turns.Limits(segment=64, rows=100))
    assert rows_of(found) == by_hand(rows)


@pytest.mark.parametrize("limits", [turns.Limits(), turns.Limits(segment=3, rows=2)], ids=str)
def test_repaired_turns_are_the_digest(spark, limits):
    rows = turns.damaged(talk_frame(spark, messy_talks()))
    parts = {}
    for conv, place, _, role, text in rows_of(turns.repair(rows, limits, as_turns=True)):
        parts.setdefault(conv, []).append((place, f"{role}:{text}"))
    want = {r[0]: r[-1] for r in rows_of(turns.repair(rows, limits))}
    for conv, sha in want.items():
        lines = [line for _, line in sorted(parts.get(conv, []))]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == sha


def test_no_conversations(spark):
    assert rows_of(turns.repair(turns.damaged(talk_frame(spark, [])))) == []
    # All rows of a conversation dropped: zeros, an empty audit, the digest of nothing.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert rows_of(turns.repair(turns.damaged(talk_frame(spark, [(gone, 0, "user", "Hi.")])))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain_manifest(rows, fan=8):
    """Rows are doc_id, source, lang, n_chars, text."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
        return out

    def runs(tree, i):
        for nodes in tree[:-1]:
            yield i % fan, nodes[i - i % fan : i - i % fan + fan]
            i //= fan

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: levels([leaf_of(r) for r in groups[g]]) for g in order}
    crown = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            way = [*runs(trees[g], i), *runs(crown, k)]
            proof = sha(*[d for place, run in way for j, d in enumerate(run) if j != place])
            after = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                after[4] = re.sub("[A-Z]", lambda m: m.group().lower(), r[4])
            d = leaf_of(after)
            for place, run in way:
                d = sha(*run[:place], d, *run[place + 1 :])
            out.append((r[0], leaf_of(r), trees[g][-1][0], crown[-1][0], proof, d, d == crown[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, Text string, id string, index long"


def manifest_rows(spark, rows, shape):
    found = merkle.document_manifest(spark.createDataFrame([(*r, None, "x", "y", "z", 5) for r in rows], DOCS), shape).collect()
    return sorted([(r.id, r.leaf, r.subroot, r.root, sha(r.siblings), r.folded_root, r.verified) for r in found], key=repr), found


def messy_documents():
    rng = random.Random(5)
    texts = [None, "", "Abc É", "lower only", "LONG " * 9000, "a\nB"]
    langs = [None, "", "de", "en", "en", "en", "é", "z"]
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, "web"]), rng.choice(langs), rng.choice([None, 3]), rng.choice(texts)) for _ in range(400)]
    return rows + [(7, "web", "en", 3, "Same")] * 150 + [(1, None, "lone", None, "One Leaf")]


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(height=1), merkle.Shape(fan=3, height=2)], ids=str)
def test_manifest_of_messy_documents(spark, shape):
    """Null and repeated ids, a null and an empty language, a lone leaf, equal rows, clashing names; one and several tiers."""
    rows = messy_documents()
    assert manifest_rows(spark, rows, shape)[0] == plain_manifest(rows, shape.fan)


def test_versions_copy_ancestors_only(spark):
    rows = messy_documents()
    _, found = manifest_rows(spark, rows, merkle.Shape(fan=3, height=2))
    changed = [r for r in found if r.copied is not None]
    assert changed and any(not r.verified for r in changed)
    for r in found:
        # The leaf and one node a level; the rest of the tree is the siblings', shared.
        assert r.copied is None or (len(r.copied) == 1 + len(r.places) // 2 and r.copied[-1] == r.folded_root)
        path = merkle.copies(r.leaf.encode(), r.siblings.encode(), bytes(r.places))
        assert path[-1].decode() == r.root
        assert r.copied is not None or r.verified


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest_rows(spark, [], merkle.Shape())[0] == []
    (row,) = manifest_rows(spark, [(1, None, None, None, "Abc")], merkle.Shape())[0]
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_places_of_a_large_group_of_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 900 + [("a", 0), ("a", None), ("b", 2)], "g string, k long")
    found = rows_of(placed(rows, "g", ["k"]))
    assert [r[2] for r in found if r[0] == "b"] == [0] and {r[3] for r in found if r[0] == "a"} == {902}
    assert sorted(r[2] for r in found if r[0] == "a") == list(range(902))
    assert {r[1]: r[2] for r in found if r[1] != 1 and r[0] == "a"} == {None: 0, 0: 1}


# Embeddings


def linked(rows, cosine=0.98):
    """Links and components by comparing all pairs. Rows are vec_id, vector, label."""

    def fine(r):
        return all(x is not None for x in r) and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1])

    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for i, r in enumerate(rows):
        if fine(r):
            groups.setdefault((r[2], len(r[1])), []).append(i)
    for places in groups.values():
        v = np.array([rows[i][1] for i in places], float)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(v @ v.T >= cosine, 1))):
            a, b = places[a], places[b]
            links[a], links[b] = links[a] + 1, links[b] + 1
            parent[top(a)] = top(b)
    least = {}
    for i, r in enumerate(rows):
        if fine(r):
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    out = [(r[0], links[i], least.get(top(i), r[0]) if fine(r) else r[0]) for i, r in enumerate(rows)]
    return sorted([(*r, r[0] == r[2]) for r in out], key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, v string, Label string, c long, n_links long"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y", 1, 2) for i, v, label in rows], VECTORS)


def near_copies(rng, dims, groups, each, spread):
    """Copies of random centres, most of them near the threshold of a link."""
    for _ in range(groups):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(each):
            noise = rng.normal(size=dims)
            yield centre + spread * rng.random() * noise / np.linalg.norm(noise)


def check_links(spark, rows, how=neardupvec.Search()):
    want = linked(rows, how.cosine)
    got = rows_of(neardupvec.near_duplicates(vector_frame(spark, rows), how))
    assert len(got) == len(want) and [r[0] for r in got] == [r[0] for r in want]
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and found >= 0.99 * there
    return got, want


@pytest.mark.parametrize("dims", [2, 8, 64])
def test_links_of_near_copies(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = [*near_copies(rng, dims, 30, 8, 0.25), *rng.normal(size=(200, dims)), *(5 + 0.3 * rng.normal(size=(60, dims)))]
    got, want = check_links(spark, [(int(i), v, i % 3) for i, v in enumerate(vectors)])
    assert got == want


@pytest.mark.parametrize("how", [neardupvec.Search(bucket=16, block=8), neardupvec.Search(bucket=512, block=64)], ids=str)
def test_a_group_with_a_third_of_all_rows_is_cut_into_blocks(spark, how):
    rng = np.random.default_rng(2)
    vectors = [*near_copies(rng, 32, 1, 250, 0.22), *near_copies(rng, 32, 1, 150, 0.08), *rng.normal(size=(400, 32))]
    got, want = check_links(spark, [(1000 - i, v, 1) for i, v in enumerate(vectors)], how)
    assert got == want and max(r[1] for r in got) > 100


def test_exact_copies_are_folded(spark):
    rng = np.random.default_rng(4)
    one, other = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, one, 1) for i in range(300)] + [(300 + i, one * 3, 1) for i in range(5)] + [(400, one, 2), (401, other, 1)]
    got, want = check_links(spark, rows)
    assert got == want and got[0][1] == 304


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, None), (3, None, 1), (4, [0.0, -0.0, 0.0], 1), (5, [1.0, None, 2.0], 1), (6, [1.0, float("nan"), 2.0], 1), (7, [float("inf"), 1.0, 1.0], 1),
        (8, [], 1), (None, v, 1), (9, [1.0, 2.0], 1), (10, [2e200, 4e200, 6e200], 1), (11, [1e-200, 2e-200, 3e-200], 1), (1, v, 1), (12, [-1.0, -2.0, -3.0], 1), (13, [1.0, 2.0], 1),
    ]
    got, want = check_links(spark, rows)
    assert got == want
    assert rows_of(neardupvec.near_duplicates(vector_frame(spark, []))) == []
    assert rows_of(neardupvec.near_duplicates(vector_frame(spark, [(1, None, None)]))) == [(1, 0, 1, True)]


def test_all_labels_at_once(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 2), (3, [0.0, 1.0], None)]
    got = rows_of(neardupvec.near_duplicates(vector_frame(spark, rows), label_col=None))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


# Counts of a communication matrix


@pytest.mark.parametrize("good, bad, draws", [(5, 7, 4), (30, 12, 35), (1, 1, 1), (200, 300, 450), (3, 1000, 2)])
def test_law_of_counts(good, bad, draws):
    first, chances = sharding.law(good, bad, draws, reach=1e9)
    low, high = max(0, draws - bad), min(good, draws)
    assert first == low and len(chances) == high - low + 1
    want = [math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(low, high + 1)]
    assert np.allclose(chances, want, rtol=1e-9, atol=1e-300)


def test_law_holds_above_a_billion_rows():
    good, bad, draws = 500_000_000, 1_500_000_000, 1_000_000
    rng = np.random.default_rng(3)
    first, chances = sharding.law(good, bad, draws)
    mean = draws * good / (good + bad)
    deviation = (mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)) ** 0.5
    places = first + np.arange(len(chances))
    assert abs((places * chances).sum() - mean) < 1e-3 and abs(((places - mean) ** 2 * chances).sum() ** 0.5 / deviation - 1) < 1e-6
    drawn = np.array([sharding.hypergeometric(good, bad, draws, rng) for _ in range(400)])
    assert abs(drawn.mean() - mean) < 5 * deviation / 20 and 0.8 < drawn.std() / deviation < 1.2
