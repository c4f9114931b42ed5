"""The detection rules as definitions over all positions, for comparison on small inputs."""

import numpy as np

f32 = np.float32


def end_of(s):
    return s["pt_ns"] + max(s["duration_ns"], 1)


def scenes(rows, cfg):
    """Scenes after k candidates, as a definition on the scenes after k - 1."""
    score = [f32(r["scene_score"] or 0.0) for r in rows]
    times = [r["pt_ns"] for r in rows]
    around = lambda i: [score[j] for j in (i - 1, i + 1) if 0 < j < len(rows)]
    peaks = [
        i for i in range(1, len(rows))
        if rows[i]["scene_score"] is not None and score[i] >= f32(cfg.scene_threshold) and all(score[i] >= s for s in around(i))
    ]
    limit = len(rows) if cfg.results_per_kind is None else cfg.results_per_kind

    def after(k):
        if k == 0:
            return [0]
        before, i = after(k - 1), peaks[k - 1]
        last = before[-1]
        if len(before) >= limit:
            return before
        if times[i] - times[last] >= cfg.scene_separation_ns:
            return [*before, i]
        stronger = times[last] != times[0] and score[last] < score[i]
        return [*before[:-1], i] if stronger else before

    found = after(len(peaks)) if rows and limit else []
    return [("scene", times[i], end_of(rows[i]), rows[i]["presentation_index"], rows[i]["presentation_index"], 1) for i in found]


def runs(rows, label, minimum):
    out, i = [], 1
    while i < len(rows):
        k = label(i)
        if k is None:
            i += 1
            continue
        a = i
        while i < len(rows) and label(i) == k:
            i += 1
        if i - a + 1 >= minimum:
            out.append((k, rows[a - 1], rows[i - 1], i - a + 1))
    return [(k, x["pt_ns"], max(x["pt_ns"], end_of(y)), x["presentation_index"], y["presentation_index"], n) for k, x, y, n in out]


def duplicates(rows, cfg):
    def label(i):
        v = rows[i]["duplicate_score"]
        if v is None or f32(v) < f32(cfg.near_duplicate_threshold):
            return None
        a, b = rows[i - 1]["content_hash"], rows[i]["content_hash"]
        return "exact_duplicate" if a is not None and a == b else "near_duplicate"

    return runs(rows, label, cfg.duplicate_frames)[: cfg.results_per_kind]


def freezes(rows, cfg):
    def label(i):
        v = rows[i]["duplicate_score"]
        return "freeze" if v is not None and f32(v) >= f32(cfg.freeze_threshold) else None

    found = [r for r in runs(rows, label, cfg.freeze_frames) if r[2] - r[1] >= cfg.freeze_duration_ns]
    return found[: cfg.results_per_kind]


def repeated(rows, cfg, used):
    """All (length, score, earlier position) of every position, the best of each, then those not covered."""
    hashes, times = [r["perceptual_hash"] for r in rows], [r["pt_ns"] for r in rows]

    def alike(i, j):
        a, b = hashes[i], hashes[j]
        bits = None if a is None or b is None else ((a ^ b) % 2**64).bit_count()
        return None if bits is None or bits > cfg.perceptual_distance else 1 - bits / 64

    def section(cur, prev):
        steps = [alike(cur + n, prev + n) for n in range(min(len(rows) - cur, cur - prev))]
        whole = steps.index(None) if None in steps else len(steps)
        return (whole, f32(sum(steps[:whole]) / whole), prev) if whole >= cfg.repeated_frames else None

    def best(cur):
        same = [p for p in range(cur) if hashes[p] is not None and hashes[p] == hashes[cur]][-cfg.fingerprint_candidates :]
        found = [section(cur, p) for p in same if times[cur] - times[p] >= cfg.repeated_separation_ns]
        return max((s for s in found if s), default=None)

    options = [(cur, best(cur)) for cur in range(len(rows))]
    out, free = [], 0
    while nxt := next(((cur, b) for cur, b in options if b and cur >= free), None):
        cur, (n, _, prev) = nxt
        free = cur + n
        first, last = rows[cur], rows[free - 1]
        out.append((
            "repeated_section", first["pt_ns"], max(first["pt_ns"], end_of(last)), first["presentation_index"],
            last["presentation_index"], n, times[prev], rows[prev + n - 1]["presentation_index"],
        ))
    return out if cfg.results_per_kind is None else out[: max(0, cfg.results_per_kind - used)]
