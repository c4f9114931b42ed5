"""Scene cuts, duplicate ranges, freezes and repeated sections from the samples table.

Only slim columns of the samples are read. Result rows keep the chunk of their first row so that
caps and numbering stay distributed for very long media.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectionConfig
from ..functions.timebase import frame_end
from ..session import materialise
from .greedy import greedy_select
from .order import CHUNK, Ordered, arrange, chunk_rows, large_groups, running_sum, sequence, settle, trailing, union_all
from .repeats import ROWS_AT_ONCE, matcher

_INPUT = [
    "media_id", "pt_ns", "presentation_index", "pts", "duration_ns", "scene_score",
    "duplicate_score", "content_hash", "perceptual_hash",
]
RESULT = [
    "media_id", "kind", "start_ns", "end_ns", "first_frame", "last_frame", "frame_count", "score",
    "match_start_ns", "match_end_ns", "match_first_frame", "match_last_frame",
]


def _f32(value: float) -> Column:
    return F.lit(value).cast("float")


def _unit32(value: Column) -> Column:
    return F.greatest(F.least(value.cast("float"), _f32(1.0)), _f32(0.0))


def prepare(samples: DataFrame | Ordered) -> Ordered:
    """Slim ordered samples with position and neighbours, the input of all detections."""
    o = arrange(samples)
    slim = o.to(o.df.select(*o.columns(*_INPUT)))
    payload = ["pt_ns", "presentation_index", "scene_score", "content_hash"]
    return settle(sequence(slim, payload, prev=True, next=True))


def _shape(rows: DataFrame, o: Ordered, kind: Column | str) -> DataFrame:
    """Result columns; ``_pos`` is the position results are emitted at."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    null = F.lit(None).cast("bigint")
    return rows.select(
        *o.part,
        "_pos",
        kind.alias("kind"),
        "start_ns",
        F.greatest("start_ns", "end_ns").alias("end_ns"),
        "first_frame",
        "last_frame",
        F.col("frame_count").cast("bigint").alias("frame_count"),
        _unit32(F.col("score")).alias("score"),
        *[
            (F.col(c) if c in rows.columns else null).cast("bigint").alias(c)
            for c in ("match_start_ns", "match_end_ns", "match_first_frame", "match_last_frame")
        ],
    )


def _ranked(results: DataFrame, o: Ordered, name: str = "_rank") -> Ordered:
    """Results numbered from 1 in emission order."""
    r = Ordered(results, o.keys, ("_pos",), o.split)
    r = sequence(r, names=(name, "", ""))
    return r.to(r.df.withColumn(name, F.col(name) + 1))


# --- scene cuts ---------------------------------------------------------------------------


def scene_candidates(prepared: Ordered, config: DetectionConfig = DetectionConfig()) -> Ordered:
    """First sample (score 1) and local maxima of the scene score above the threshold."""
    config = config.normalized()
    s = F.col("scene_score")
    zero = _f32(0.0)
    prev = F.col("_prev")
    # Row 1 does not look back at row 0's own score.
    before = F.when(F.col("_pos") > 1, F.coalesce(prev["scene_score"], zero)).otherwise(zero)
    after = F.coalesce(F.col("_next.scene_score"), zero)
    peak = (F.col("_pos") > 0) & (s >= _f32(config.scene_threshold)) & (s >= before) & (s >= after)
    rows = prepared.df.where((F.col("_pos") == 0) | peak)
    out = rows.select(
        *prepared.part,
        "_pos",
        F.col("pt_ns").alias("start_ns"),
        frame_end(F.col("pt_ns"), F.col("duration_ns")).alias("end_ns"),
        F.col("presentation_index").alias("first_frame"),
        F.col("presentation_index").alias("last_frame"),
        F.when(F.col("_pos") == 0, _f32(1.0)).otherwise(s).alias("score"),
    )
    return Ordered(out, prepared.keys, ("_pos",), prepared.split)


def scenes(prepared: Ordered, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Scene starts after minimum separation: a close, stronger candidate replaces the latest
    scene unless that one starts with the first sample. Reaching the cap also ends replacement."""
    config = config.normalized()
    if config.results_per_kind == 0:
        return _shape(scene_candidates(prepared, config).df.where("false").withColumn("frame_count", F.lit(1)), prepared, "scene")
    candidates = scene_candidates(prepared, config)
    first = candidates.df.where(F.col("_pos") == 0).select(
        *prepared.keys, F.col("start_ns").alias("_first")
    )
    nodes = candidates.df.join(first, list(prepared.keys)).select(
        *prepared.part,
        "_pos",
        F.col("start_ns").alias("start"),
        (F.col("start_ns") + config.scene_separation_ns).alias("until"),
        F.col("score").cast("double").alias("score"),
        (F.col("start_ns") == F.col("_first")).alias("fixed"),
        "end_ns",
        "first_frame",
    )
    taken = greedy_select(candidates.to(nodes))
    # Scene k is the last node of its run of replacements; at the cap it is the pushed node.
    push = F.when(F.col("mark") == "push", 1).otherwise(0).cast("bigint")
    numbered = running_sum(settle(taken), push, "_scene")
    cap = config.results_per_kind
    usable = numbered.df
    if cap is not None:
        usable = usable.where((F.col("_scene") < cap) | ((F.col("_scene") == cap) & (F.col("mark") == "push")))
    body = ["_pos", "start", "end_ns", "first_frame", "score"]
    if prepared.split:
        body.append(CHUNK)
    best = usable.groupBy(*prepared.keys, "_scene").agg(F.max_by(F.struct(*body), "_pos").alias("b"))
    rows = best.select(*prepared.keys, "b.*").withColumnsRenamed({"start": "start_ns"})
    rows = rows.withColumns({"last_frame": F.col("first_frame"), "frame_count": F.lit(1)})
    return _shape(rows, prepared, "scene")


# --- duplicates and freezes ---------------------------------------------------------------


def _runs(prepared: Ordered, kind: Column, minimum: int) -> DataFrame:
    """Maximal runs of rows with the same non-null ``kind``, one frame longer at the start."""
    rows = settle(prepared.to(prepared.df.withColumn("_kind", F.when(F.col("_pos") > 0, kind))))
    o = settle(sequence(rows, ["_kind"], pos=False, prev=True, next=True, names=("", "_k0", "_k1")))
    opens = ~F.col("_kind").eqNullSafe(F.col("_k0._kind"))
    closes = ~F.col("_kind").eqNullSafe(F.col("_k1._kind"))
    o = o.to(o.df.withColumns({"_open": opens, "_close": closes}))
    o = running_sum(o, F.col("_open").cast("bigint"), "_run")
    # At the first row of a run the frame before it starts the range; at its last row it ends.
    open_, close = F.col("_open"), F.col("_close")
    aggs = [
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("duplicate_score").cast("double")).alias("_sum"),
        F.min("_pos").alias("_pos"),
        F.max(F.when(open_, F.col("_prev.pt_ns"))).alias("start_ns"),
        F.max(F.when(open_, F.col("_prev.presentation_index"))).alias("first_frame"),
        F.max(F.when(close, frame_end(F.col("pt_ns"), F.col("duration_ns")))).alias("end_ns"),
        F.max(F.when(close, F.col("presentation_index"))).alias("last_frame"),
    ]
    if prepared.split:
        aggs.append(F.min(CHUNK).alias(CHUNK))
    return (
        o.df.where(F.col("_kind").isNotNull())
        .groupBy(*prepared.keys, "_run", "_kind")
        .agg(*aggs)
        .where(F.col("_n") + 1 >= minimum)
        .withColumns({"frame_count": F.col("_n") + 1, "score": F.col("_sum") / F.col("_n")})
    )


def duplicate_ranges(prepared: Ordered, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Runs of equal exactness with a duplicate score at or above the near threshold."""
    config = config.normalized()
    exact = F.coalesce(F.col("content_hash") == F.col("_prev.content_hash"), F.lit(False))
    near = F.col("duplicate_score") >= _f32(config.near_duplicate_threshold)
    kind = F.when(near, F.when(exact, F.lit("exact_duplicate")).otherwise(F.lit("near_duplicate")))
    return _shape(_runs(prepared, kind, config.duplicate_frames), prepared, F.col("_kind"))


def freezes(prepared: Ordered, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Runs at or above the freeze threshold that are long in frames and in time."""
    config = config.normalized()
    still = F.when(F.col("duplicate_score") >= _f32(config.freeze_threshold), F.lit("freeze"))
    runs = _runs(prepared, still, config.freeze_frames)
    return _shape(
        runs.where(F.col("end_ns") - F.col("start_ns") >= config.freeze_duration_ns), prepared, "freeze"
    )


# --- repeated sections --------------------------------------------------------------------


def repeat_seeds(prepared: Ordered, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """(media, cur, prev): equal perceptual hash, among the latest earlier positions of that hash,
    and far enough apart in time."""
    config = config.normalized()
    hashed = prepared.df.where(F.col("perceptual_hash").isNotNull()).select(
        *prepared.keys, "perceptual_hash", "_pos", "pt_ns"
    )
    # A hash can cover most of a media, so its rows are ordered and chunked like a media.
    by_hash = arrange(hashed, (*prepared.keys, "perceptual_hash"), ("_pos",))
    back = trailing(by_hash, F.struct("_pos", "pt_ns"), config.fingerprint_candidates, "_back")
    return (
        back.df.where(F.size("_back") > 0)
        .select(*prepared.keys, F.col("_pos").alias("cur"), "pt_ns", F.explode("_back").alias("b"))
        .where(F.col("pt_ns") - F.col("b.pt_ns") >= config.repeated_separation_ns)
        .select(*prepared.keys, "cur", F.col("b._pos").alias("prev"))
    )


def seed_lengths(
    seeds: DataFrame, prepared: Ordered, config: DetectionConfig = DetectionConfig(), look_ahead: int = 16
) -> DataFrame:
    """seeds + matching ``length`` (without reaching the current position) and summed distance.

    A seed (cur, prev) lies on the diagonal d = cur - prev. Consecutive seeds of a diagonal match
    with distance 0; behind each such group the next positions are compared, twice as far each
    round, until a position fails, the media ends or the next group begins. Only unfinished groups
    go on, so the work is linear in matched positions and the rounds logarithmic.
    """
    config = config.normalized()
    keys = list(prepared.keys)
    diag = [*keys, "d"]
    s = materialise(seeds.select(*keys, (F.col("cur") - F.col("prev")).alias("d"), F.col("cur").alias("i")))
    o = arrange(s, tuple(diag), ("i",))
    o = sequence(o, ["i"], pos=False, prev=True, next=True)
    ends = (
        o.df.where(~F.coalesce(F.col("_next.i") == F.col("i") + 1, F.lit(False)))
        .select(*diag, F.col("i").alias("e"), F.col("_next.i").alias("stop"))
    )
    hashes = prepared.df.select(*keys, F.col("_pos").alias("p"), F.col("perceptual_hash").alias("h"))
    frontier = materialise(ends.withColumn("frm", F.col("e") + 1))
    fills: list[DataFrame] = []
    width = look_ahead
    while not frontier.isEmpty():
        upto = F.least(F.col("frm") + F.lit(width), F.coalesce("stop", F.col("frm") + F.lit(width)))
        probe = frontier.where(F.col("stop").isNull() | (F.col("frm") < F.col("stop"))).withColumn(
            "i", F.explode(F.sequence(F.col("frm"), upto - 1))
        )
        cur = hashes.withColumnsRenamed({"p": "i", "h": "h1"})
        old = hashes.withColumnsRenamed({"p": "j", "h": "h0"})
        checked = (
            probe.withColumn("j", F.col("i") - F.col("d"))
            .join(cur, [*keys, "i"], "left")
            .join(old, [*keys, "j"], "left")
            .withColumn("dist", F.bit_count(F.col("h1").bitwiseXOR(F.col("h0"))))
            .select(*diag, "e", "stop", "frm", "i", "dist")
        )
        bad = F.coalesce(F.col("dist") > config.perceptual_distance, F.lit(True))
        verdict = checked.groupBy(*diag, "e").agg(F.min(F.when(bad, F.col("i"))).alias("brk"))
        judged = materialise(checked.join(verdict, [*diag, "e"]))
        fills.append(
            judged.where(F.col("brk").isNull() | (F.col("i") < F.col("brk"))).select(*diag, "i", "dist")
        )
        frontier = materialise(
            judged.where(F.col("brk").isNull())
            .groupBy(*diag, "e", "stop")
            .agg((F.max("i") + 1).alias("frm"))
            .where(F.col("stop").isNull() | (F.col("frm") < F.col("stop")))
        )
        width *= 2
    cells = s.withColumns({"dist": F.lit(0), "seed": F.lit(True)})
    for f in fills:
        cells = cells.unionByName(f.withColumn("seed", F.lit(False)))
    # Along each diagonal: runs of consecutive matched cells, their end and running distance.
    o = settle(arrange(materialise(cells), tuple(diag), ("i",)))
    o = sequence(o, ["i"], pos=False, prev=True)
    opens = ~F.coalesce(F.col("_prev.i") == F.col("i") - 1, F.lit(False))
    o = settle(o.to(o.df.withColumn("_open", opens.cast("bigint")).drop("_prev")))
    o = settle(running_sum(o, F.col("_open"), "_run"))
    o = running_sum(o, F.col("dist").cast("bigint"), "_cum")
    rows = o.plain()
    stops = rows.groupBy(*diag, "_run").agg(F.max("i").alias("_end"))
    at = rows.select(*diag, F.col("i").alias("_last"), F.col("_cum").alias("_upto"))
    return (
        rows.where("seed")
        .join(stops, [*diag, "_run"])
        .withColumn("length", F.least(F.col("_end") - F.col("i") + 1, F.col("d")))
        .withColumn("_last", F.col("i") + F.col("length") - 1)
        .join(at, [*diag, "_last"])
        .select(
            *keys,
            F.col("i").alias("cur"),
            (F.col("i") - F.col("d")).alias("prev"),
            "length",
            (F.col("_upto") - F.col("_cum") + F.col("dist")).alias("distance"),
        )
    )


_EDGES = [f"{at}_{c}" for at in ("_last", "_prev", "_plast") for c in ("t", "d", "i")]


def _whole_matches(rows: Ordered, config: DetectionConfig) -> DataFrame:
    """Best match per position of media that fit one task, with time, duration and index at its edges."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keys, kept = list(rows.keys), [*rows.part, "_pos", "pt_ns", "presentation_index"]
    slim = rows.df.select(*kept, "duration_ns", "perceptual_hash")
    added = [F.lit(0).cast("bigint").alias("length"), _f32(0).alias("score"), F.lit(0).cast("bigint").alias("prev")]
    added += [F.lit(0).cast("bigint").alias(c) for c in _EDGES]
    schema = slim.select(*kept, *added).schema
    ordered = slim.repartition(*keys).sortWithinPartitions(*keys, "_pos")
    return ordered.mapInArrow(matcher(keys, kept, to_arrow_schema(schema), config), schema)


def _spread_matches(rows: Ordered, config: DetectionConfig) -> DataFrame:
    """The same by diagonals over tasks, for media of any size."""
    keys = list(rows.keys)
    sized = seed_lengths(repeat_seeds(rows, config), rows, config).where(F.col("length") >= config.repeated_frames)
    # Equal to the mean of 1 - distance / 64 in single precision.
    score = ((F.col("length") - F.col("distance") / 64.0) / F.col("length")).cast("float")
    best = (
        sized.withColumn("score", score)
        .groupBy(*keys, "cur")
        .agg(F.max(F.struct("length", "score", "prev")).alias("b"))
        .select(*keys, F.col("cur").alias("_pos"), "b.*")
    )
    place = rows.df.select(*rows.part, "_pos", "pt_ns", "presentation_index", "duration_ns")
    out = best.join(place.drop("duration_ns"), [*keys, "_pos"])
    out = out.withColumns({"_last": F.col("_pos") + F.col("length") - 1, "_plast": F.col("prev") + F.col("length") - 1})
    for at, pos in (("_last", "_last"), ("_prev", "prev"), ("_plast", "_plast")):
        edge = place.select(
            *keys, F.col("_pos").alias(pos), F.col("pt_ns").alias(f"{at}_t"), F.col("duration_ns").alias(f"{at}_d"),
            F.col("presentation_index").alias(f"{at}_i"),
        )
        out = out.join(edge, [*keys, pos])
    return out.select(*rows.part, "_pos", "pt_ns", "presentation_index", "length", "score", "prev", *_EDGES)


def _beyond_one_task(o: Ordered) -> tuple[DataFrame, int]:
    """Media of more rows than are matched at once, and how many there are."""
    large, groups, _ = large_groups(o.df, o.keys, min(ROWS_AT_ONCE, chunk_rows(o.df)))
    return large.select(*o.keys), groups


def repeated_sections(prepared: Ordered, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Best match per position (longest, then highest score, then most recent), taken greedily."""
    config = config.normalized()
    keys = list(prepared.keys)
    large, groups = _beyond_one_task(prepared)
    if groups:
        small = prepared.to(prepared.df.join(large, keys, "left_anti"))
        rest = prepared.to(prepared.df.join(large, keys, "left_semi"))
        matches = _whole_matches(small, config).unionByName(_spread_matches(rest, config))
    else:
        matches = _whole_matches(prepared, config)
    nodes = matches.select(
        *prepared.part,
        "_pos",
        F.col("_pos").alias("start"),
        (F.col("_pos") + F.col("length")).alias("until"),
        F.col("score").cast("double").alias("score"),
        F.lit(True).alias("fixed"),
        "length",
        F.col("pt_ns").alias("start_ns"),
        F.col("presentation_index").alias("first_frame"),
        *_EDGES,
    )
    taken = greedy_select(Ordered(nodes, prepared.keys, ("_pos",), prepared.split)).df
    out = taken.withColumns(
        {
            "frame_count": F.col("length"),
            "end_ns": frame_end(F.col("_last_t"), F.col("_last_d")),
            "last_frame": F.col("_last_i"),
            "match_start_ns": F.col("_prev_t"),
            "match_first_frame": F.col("_prev_i"),
            "match_end_ns": frame_end(F.col("_plast_t"), F.col("_plast_d")),
            "match_last_frame": F.col("_plast_i"),
        }
    )
    return _shape(out, prepared, "repeated_section")


# --- everything ---------------------------------------------------------------------------


def detect(
    samples: DataFrame | Ordered, config: DetectionConfig = DetectionConfig(), repeated: bool = True
) -> DataFrame:
    """All detections of a samples table. Planes are never read.

    By default all are returned. With ``results_per_kind`` exact, near and repeated results share one
    limit, in that order of emission.
    """
    config = config.normalized()
    cap = config.results_per_kind
    p = prepare(samples)
    if repeated and _beyond_one_task(p)[1]:
        p = p.to(materialise(p.df))
    if cap is None:
        out = [scenes(p, config), duplicate_ranges(p, config), freezes(p, config)]
        if repeated:
            out.append(repeated_sections(p, config))
        return union_all([df.select(*RESULT) for df in out])
    duplicates = _ranked(duplicate_ranges(p, config), p)
    still = _ranked(freezes(p, config), p)
    out = [
        scenes(p, config),
        duplicates.df.where(F.col("_rank") <= cap),
        still.df.where(F.col("_rank") <= cap),
    ]
    if repeated and cap > 0:
        used = duplicates.df.groupBy(*p.keys).agg(F.count(F.lit(1)).alias("_used"))
        again = _ranked(repeated_sections(p, config), p).df.join(used, list(p.keys), "left")
        out.append(again.where(F.col("_rank") <= cap - F.least(F.coalesce("_used", F.lit(0)), F.lit(cap))))
    return union_all([df.select(*RESULT) for df in out])


def detection_summary(detections: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts per kind and analysed samples, per media."""
    def kinds(*names: str) -> Column:
        return F.sum(F.when(F.col("kind").isin(*names), 1).otherwise(0)).alias(names[0] + "_count")

    found = detections.groupBy("media_id").agg(
        kinds("scene"),
        kinds("exact_duplicate", "near_duplicate", "repeated_section").alias("duplicate_count"),
        kinds("freeze"),
    )
    analysed = samples.groupBy("media_id").agg(F.count(F.lit(1)).alias("analysed"))
    counts = ["scene_count", "duplicate_count", "freeze_count"]
    return analysed.join(found, "media_id", "left").select(
        "media_id", "analysed", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts]
    )
