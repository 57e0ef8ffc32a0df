"""Features of map objects by ruleset: a registry of specifications, each with its plan over the object table.

Objects come as `sources.maps.objects` gives them. Every plan keeps the objects of valid maps, orders them by time and
index, and adds its columns by windows over a map's objects; nothing leaves the JVM. `vectors` gathers a map's rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import beat_angle, clip, has_flag
from .joins import asof
from .sequence import onsets, span_bin, truncate, valid_groups

#: The playfield; bits of a hit sound; slots of a hand and their states.
WIDTH, HEIGHT = 512.0, 384.0
WHISTLE, FINISH, CLAP = 2, 4, 8
HAND, EMPTY, TAP, HOLD, HELD, RELEASE = 5, 0, 1, 2, 3, 4
KIND = {"circle": 0, "slider": 1, "spinner": 2, "hold": 3}
ORDER = ["time", "object_index"]


@dataclass(frozen=True)
class FeatureSpec:
    """cardinality: of a category, None for a number; gate: the column and value under which it means something."""

    name: str
    standardize: bool = False
    cardinality: int | None = None
    gate: tuple[str, int] | None = None


@dataclass(frozen=True)
class Ruleset:
    """flips: columns that change sign together; mirror: columns that change places."""

    number: int
    features: tuple[FeatureSpec, ...]
    build: Callable[[DataFrame, DataFrame, int | None], DataFrame]
    flips: tuple[tuple[str, ...], ...] = ()
    mirror: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def gates(self) -> dict[str, Column]:
        """When each number means something: what statistics are taken over."""
        return {f.name: F.lit(True) if f.gate is None else F.col(f.gate[0]) == f.gate[1] for f in self.features if f.cardinality is None}

    def standardized(self, rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
        """Numbers less their mean, over their deviation; zero where their gate is shut."""
        out = {}
        for f in self.features:
            if f.cardinality is None:
                mean, std = stats.get(f.name, (0.0, 1.0)) if f.standardize else (0.0, 1.0)
                out[f.name] = F.when(self.gates()[f.name], (F.col(f.name) - mean) / std).otherwise(0.0)
        return rows.withColumns(out)

    def augmented(self, rows: DataFrame, key: str = "map_id", seed: int = 0) -> DataFrame:
        """By a hash of the map, signs turned and columns mirrored."""
        coin = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(2)) == 1
        out = {}
        for k, names in enumerate(self.flips):
            out |= {n: F.when(coin(k), -F.col(n)).otherwise(F.col(n)) for n in names}
        out |= {a: F.when(coin(99), F.col(b)).otherwise(F.col(a)) for a, b in zip(self.mirror, reversed(self.mirror))}
        return rows.withColumns(out) if out else rows


def _valid(objects: DataFrame, least: int = 10) -> DataFrame:
    """Objects of maps with enough of them and no tempo that is null, not finite, not above zero or above 1000."""
    bad = lambda c: F.isnan(c) | (F.col(c) <= 0) | (F.col(c) > 1000)
    return objects.join(valid_groups(objects, "map_id", bad("bpm") | bad("end_bpm"), least), "map_id", "left_semi")


def _rhythm(name: str, milliseconds: Column, when: Column | None = None) -> dict[str, Column]:
    angle = beat_angle(milliseconds, F.col("bpm"))
    pick = (lambda c: c) if when is None else (lambda c: F.when(when, c).otherwise(0.0))
    return {f"{name}_rhythm_cos": pick(F.cos(angle)), f"{name}_rhythm_sin": pick(F.sin(angle))}


def _timed(objects: DataFrame, most: int | None) -> DataFrame:
    """Ordered, cut, with onset features."""
    rows = objects if most is None else truncate(objects, "map_id", ORDER, most)
    rows = onsets(rows, "map_id", "time", ORDER).withColumnRenamed("state", "onset_state")
    return rows.withColumns({"log_onset_ioi_ms": F.log1p("ioi"), **_rhythm("onset", F.col("ioi"))})


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _lasting() -> Column:
    return F.greatest(F.col("end_time") - F.col("time"), F.lit(0)).cast("double")


def _with_exits(rows: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Where the object before was left (null if unknown), when it ended and what it was. A slider is left at its start
    after an even number of spans."""
    spans = F.greatest(F.coalesce("repeats", F.lit(0)), F.lit(0)) + 1
    rows = rows.withColumn("spans", spans)
    for a in axes:
        end = F.col(a) + F.when(F.col("spans") % 2 == 0, 0.0).otherwise(F.col(f"end_d{a}"))
        rows = rows.withColumn(f"exit_{a}", F.when(_is("slider") & F.col("path_valid"), end).when(~_is("slider") & ~_is("spinner"), F.col(a).cast("double")))
    before = Window.partitionBy("map_id").orderBy(*ORDER)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(before) for c in ("time", "end_time", "kind", *(f"exit_{a}" for a in axes))})


def _number(kind: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])[F.col(kind)]


def standard(objects: DataFrame, maps: DataFrame, most: int | None = None) -> DataFrame:
    inside = objects.where(F.col("x").between(0, WIDTH) & F.col("y").between(0, HEIGHT))
    rows = _with_exits(_timed(_valid(inside), most), ("x", "y"))
    slider, spinner = _is("slider"), _is("spinner")
    overlap = (F.col("prev_kind") == "slider") & (F.col("time") < F.col("prev_end_time"))
    moved = F.coalesce((F.col("onset_state") == 1) & F.col("prev_exit_x").isNotNull() & (F.col("time") > F.col("prev_time")) & ~overlap, F.lit(False))
    dx, dy = F.col("x") - F.col("prev_exit_x"), F.col("y") - F.col("prev_exit_y")
    rows = rows.withColumns({"incoming_motion_valid": F.when(F.col("onset_state") == 2, 2).otherwise(moved.cast("int")), "jump": F.sqrt(dx * dx + dy * dy), "reach": F.sqrt(F.col("end_dx") * F.col("end_dx") + F.col("end_dy") * F.col("end_dy"))})
    moving = F.col("incoming_motion_valid") == 1
    part = lambda when, c: F.when(when, c).otherwise(0.0)
    aimed, led = moving & (F.col("jump") > 0), slider & (F.col("reach") > 0)
    anchors, hard = clip(F.coalesce("anchors", F.lit(0)), 0, 4096), clip(F.coalesce("hard_anchors", F.lit(0)), 0, 4096)
    return rows.withColumns(
        {
            "norm_x": clip(F.col("x") / (WIDTH / 2) - 1, -1.0, 1.0),
            "norm_y": clip(F.col("y") / (HEIGHT / 2) - 1, -1.0, 1.0),
            "log_jump_distance": part(moving, F.log1p("jump")),
            "jump_direction_cos": part(aimed, dx / F.col("jump")),
            "jump_direction_sin": part(aimed, dy / F.col("jump")),
            "log_span_duration_ms": part(slider, F.log1p(_lasting())),
            **_rhythm("span", _lasting(), slider),
            "log_span_length": part(slider, F.log1p(F.greatest("length", F.lit(0.0)))),
            "log_span_end_distance": part(slider, F.log1p("reach")),
            "span_end_direction_cos": part(led, F.col("end_dx") / F.col("reach")),
            "span_end_direction_sin": part(led, F.col("end_dy") / F.col("reach")),
            "curve_residual_1_dx": part(slider, F.col("third_dx") / WIDTH),
            "curve_residual_1_dy": part(slider, F.col("third_dy") / HEIGHT),
            "curve_residual_2_dx": part(slider, F.col("two_thirds_dx") / WIDTH),
            "curve_residual_2_dy": part(slider, F.col("two_thirds_dy") / HEIGHT),
            "log_spinner_duration_ms": part(spinner, F.log1p(_lasting())),
            **_rhythm("spinner", _lasting(), spinner),
            "object_type": _number("kind"),
            "is_new_combo": F.col("new_combo").cast("int"),
            "span_count_bin": span_bin(F.col("spans"), slider),
            "log_gray_anchor_count": part(slider, F.log1p(anchors)),
            "red_anchor_bin": F.when(slider, F.least(hard, F.lit(3))).otherwise(0),
        }
    )


def drums(objects: DataFrame, maps: DataFrame, most: int | None = None) -> DataFrame:
    rows = _timed(_valid(objects), most)
    roll, swell = _is("slider"), _is("spinner")
    rim = has_flag(F.col("hit_sound"), WHISTLE | CLAP)
    return rows.withColumns(
        {
            "log_drumroll_duration_ms": F.when(roll, F.log1p(_lasting())).otherwise(0.0),
            **_rhythm("drumroll", _lasting(), roll),
            "log_swell_duration_ms": F.when(swell, F.log1p(_lasting())).otherwise(0.0),
            "note_type": F.when(swell, 3).when(roll, 2).when(rim, 1).otherwise(0),
            "is_big": (~swell & has_flag(F.col("hit_sound"), FINISH)).cast("int"),
        }
    )


def catching(objects: DataFrame, maps: DataFrame, most: int | None = None) -> DataFrame:
    rows = _with_exits(_timed(_valid(objects.where(F.col("x").between(0, WIDTH))), most), ("x",))
    stream, banana = _is("slider"), _is("spinner")
    known = F.col("prev_exit_x").isNotNull() & (F.col("time") >= F.col("prev_end_time"))
    rows = rows.withColumn("incoming_state", F.when(F.col("onset_state") == 2, 2).when((F.col("onset_state") == 1) & known, 1).otherwise(0))
    moving, way = F.col("incoming_state") == 1, F.col("x") - F.col("prev_exit_x")
    led = stream & F.col("path_valid")
    return rows.withColumns(
        {
            "norm_x": clip(F.col("x") / (WIDTH / 2) - 1, -1.0, 1.0),
            "log_movement_distance": F.when(moving, F.log1p(F.abs(way))).otherwise(0.0),
            "movement_direction": F.when(moving, F.signum(way)).otherwise(0.0),
            "log_stream_duration_ms": F.when(stream, F.log1p(_lasting())).otherwise(0.0),
            **_rhythm("stream", _lasting(), stream),
            "stream_end_dx": F.when(led, F.col("end_dx") / WIDTH).otherwise(0.0),
            "stream_residual_1_dx": F.when(led, F.col("third_dx") / WIDTH).otherwise(0.0),
            "stream_residual_2_dx": F.when(led, F.col("two_thirds_dx") / WIDTH).otherwise(0.0),
            "log_banana_duration_ms": F.when(banana, F.log1p(_lasting())).otherwise(0.0),
            "object_type": _number("kind"),
            "span_count_bin": span_bin(F.col("spans"), stream),
        }
    )


SLOTS = (*(f"left_{i}" for i in range(HAND, 0, -1)), "center", *(f"right_{i}" for i in range(1, HAND + 1)))


def keys(objects: DataFrame, maps: DataFrame, most: int | None = None) -> DataFrame:
    """One row per time at which a key is pressed or let go: the state of each slot around the centre."""
    count = maps.select(F.col("map_id"), F.bround("cs").cast("int").alias("keys")).where(F.col("keys").between(1, 2 * HAND))
    notes = _valid(objects.where(F.col("kind").isin("circle", "hold")).join(count, "map_id"))
    column = clip(F.floor(F.col("x") * F.col("keys") / WIDTH).cast("int"), 0, 1 << 20)
    notes = notes.withColumns({"column": F.least(column, F.col("keys") - 1), "long": _is("hold") & (F.col("end_time") > F.col("time"))})
    ends = notes.where("long").select("map_id", F.col("end_time").alias("time"), F.col("end_bpm").alias("bpm"), "keys", F.lit(1).alias("release"))
    both = notes.select("map_id", "time", "bpm", "keys", F.lit(0).alias("release")).unionByName(ends)
    times = both.groupBy("map_id", "time").agg(F.min_by("bpm", F.struct("release", "bpm")).alias("bpm"), F.first("keys").alias("keys")).withColumn("object_index", F.lit(0))
    times = times if most is None else truncate(times, "map_id", ["time"], most)
    held = notes.where("long").groupBy("map_id", "column", "time").agg(F.max("end_time").alias("until"))
    running = F.max("until").over(Window.partitionBy("map_id", "column").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    cells = times.select("map_id", "time", "keys", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("column"))
    cells = asof(cells, held.withColumn("until", running), ["map_id", "column"], "time", ["until"], strict=True)
    heads = notes.groupBy("map_id", "time", "column").agg(F.max(F.when(F.col("long"), HOLD).otherwise(TAP)).alias("head"))
    released = notes.where("long").select("map_id", F.col("end_time").alias("time"), "column").distinct().withColumn("released", F.lit(True))
    cells = cells.join(heads, ["map_id", "time", "column"], "left").join(released, ["map_id", "time", "column"], "left")
    half = F.floor(F.col("keys") / 2).cast("int")
    slot = F.when(F.col("column") < half, HAND - half + F.col("column")).when(F.col("column") >= F.col("keys") - half, HAND + 1 + F.col("column") - F.col("keys") + half).otherwise(HAND)
    state = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("released"), RELEASE).when(F.col("until") > F.col("time"), HELD).otherwise(EMPTY)
    states = cells.groupBy("map_id", "time").agg(*[F.max(F.when(slot == i, state).otherwise(EMPTY)).alias(name) for i, name in enumerate(SLOTS)])
    return _timed(times.join(states, ["map_id", "time"]), None).withColumn("key_count", F.col("keys") - 1)


def _specs(numbers: dict[str, bool], gates: dict[str, tuple[str, int]], categories: dict[str, int]) -> tuple[FeatureSpec, ...]:
    return (*(FeatureSpec(n, s, None, gates.get(n)) for n, s in numbers.items()), *(FeatureSpec(n, False, c, gates.get(n)) for n, c in categories.items()))


_ONSET = {"log_onset_ioi_ms": True, "onset_rhythm_cos": False, "onset_rhythm_sin": False}
_JUMP = {"log_jump_distance": True, "jump_direction_cos": False, "jump_direction_sin": False}
_SPAN = {"log_span_duration_ms": True, "span_rhythm_cos": False, "span_rhythm_sin": False, "log_span_length": True, "log_span_end_distance": True, "span_end_direction_cos": False, "span_end_direction_sin": False} | {f"curve_residual_{i}_d{a}": True for i in (1, 2) for a in "xy"}
_SPINNER = {"log_spinner_duration_ms": True, "spinner_rhythm_cos": False, "spinner_rhythm_sin": False}
_ROLL = {"log_drumroll_duration_ms": True, "drumroll_rhythm_cos": False, "drumroll_rhythm_sin": False}
_STREAM = {"log_stream_duration_ms": True, "stream_rhythm_cos": False, "stream_rhythm_sin": False, "stream_end_dx": False, "stream_residual_1_dx": True, "stream_residual_2_dx": True}
_MOVE = {"log_movement_distance": True, "movement_direction": False}
_gate = lambda names, column, value: dict.fromkeys(names, (column, value))

RULESETS = {
    "standard": Ruleset(
        0,
        _specs({"norm_x": False, "norm_y": False, **_JUMP, **_ONSET, **_SPAN, **_SPINNER, "log_gray_anchor_count": True}, _gate(_JUMP, "incoming_motion_valid", 1) | _gate([*_SPAN, "log_gray_anchor_count", "span_count_bin", "red_anchor_bin"], "object_type", KIND["slider"]) | _gate(_SPINNER, "object_type", KIND["spinner"]), {"object_type": 3, "is_new_combo": 2, "incoming_motion_valid": 3, "span_count_bin": 5, "red_anchor_bin": 4}),
        standard,
        (("norm_x", "jump_direction_cos", "span_end_direction_cos", "curve_residual_1_dx", "curve_residual_2_dx"), ("norm_y", "jump_direction_sin", "span_end_direction_sin", "curve_residual_1_dy", "curve_residual_2_dy")),
    ),
    "drums": Ruleset(1, _specs({**_ONSET, **_ROLL, "log_swell_duration_ms": True}, _gate(_ROLL, "note_type", 2) | _gate(["log_swell_duration_ms"], "note_type", 3), {"note_type": 4, "is_big": 2, "onset_state": 3}), drums),
    "catching": Ruleset(2, _specs({"norm_x": False, **_MOVE, **_ONSET, **_STREAM, "log_banana_duration_ms": True}, _gate(_MOVE, "incoming_state", 1) | _gate([*_STREAM, "span_count_bin"], "object_type", KIND["slider"]) | _gate(["log_banana_duration_ms"], "object_type", KIND["spinner"]), {"object_type": 3, "span_count_bin": 5, "incoming_state": 3}), catching, (("norm_x", "movement_direction", "stream_end_dx", "stream_residual_1_dx", "stream_residual_2_dx"),)),
    "keys": Ruleset(3, _specs(_ONSET, {}, {"onset_state": 3, "key_count": 2 * HAND, **dict.fromkeys(SLOTS, 5)}), keys, (), SLOTS),
}


def vectors(name: str, objects: DataFrame, maps: DataFrame, most: int | None = None) -> DataFrame:
    """map_id, rows: an array of a map's feature vectors in order. Numbers that aren't finite, or that half precision
    can't hold, become zero."""
    rules = RULESETS[name]
    rows = rules.build(objects, maps, most)
    value = lambda n: F.when(F.abs(F.col(n).cast("double")) <= 65504.0, F.col(n).cast("float")).otherwise(F.lit(0.0).cast("float"))
    vector = F.array(*[F.coalesce(value(n), F.lit(0.0).cast("float")) for n in rules.names])
    found = rows.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("time", "object_index", vector.alias("v")))).alias("r"))
    return found.select("map_id", F.transform("r", lambda x: x["v"]).alias("rows"))


