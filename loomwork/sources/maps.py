"""Rhythm maps as text: sections of key-value lines, timing points and hit objects, to one row per object.

A file is read by section; timing points become sorted arrays; every object's section is looked up by its time at once.
Slider paths are sampled by length. A file that can't be read gives a row with an error and no objects."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: bits of an object's type, fields of the difficulty section and their defaults.
CIRCLE, SLIDER, COMBO, SPINNER, HOLD = 1, 2, 4, 8, 128
DIFFICULTY = {"HPDrainRate": 5.0, "CircleSize": 5.0, "OverallDifficulty": 5.0, "ApproachRate": 5.0, "SliderMultiplier": 1.4, "SliderTickRate": 1.0}
#: Objects further from the origin than this are left out.
FARTHEST = 20_000

OBJECT = "struct<object_index:int,x:int,y:int,time:bigint,end_time:bigint,kind:string,new_combo:boolean,hit_sound:int,bpm:double,origin:bigint,kiai:boolean,end_bpm:double,curve:string,anchors:int,hard_anchors:int,repeats:int,length:double,path_valid:boolean,end_dx:double,end_dy:double,third_dx:double,third_dy:double,two_thirds_dx:double,two_thirds_dy:double>"
MAP = f"struct<map_id:bigint,mode:int,hp:double,cs:double,od:double,ar:double,slider_multiplier:double,slider_tick:double,objects:array<{OBJECT}>,error:string>"

#: Fixed value: what a map file begins with, before its version.
MAGIC = "osu file format v"


# --- slider paths


def bezier(points: np.ndarray, steps: int = 48) -> np.ndarray:
    """Points of a Bezier curve by repeated interpolation at all places at once."""
    t = np.linspace(0, 1, steps + 1)[:, None, None]
    level = np.repeat(points[None], steps + 1, axis=0)
    while level.shape[1] > 1:
        level = level[:, :-1] * (1 - t) + level[:, 1:] * t
    return level[:, 0]


def arc(a: np.ndarray, b: np.ndarray, c: np.ndarray, steps: int = 48) -> np.ndarray | None:
    """Points of the circle through three points, from the first over the second to the third; None if they lie on a
    line."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-6:
        return None
    centre = np.array([(a @ a) * (by - cy) + (b @ b) * (cy - ay) + (c @ c) * (ay - by), (a @ a) * (cx - bx) + (b @ b) * (ax - cx) + (c @ c) * (bx - ax)]) / d
    start, mid, end = (math.atan2(*(p - centre)[::-1]) for p in (a, b, c))
    turn = 2 * math.pi
    if (mid - start) % turn > (end - start) % turn:
        end = start - (start - end) % turn
    else:
        end = start + (end - start) % turn
    angles = np.linspace(start, end, steps + 1)
    return centre + math.dist(a, centre) * np.stack([np.cos(angles), np.sin(angles)], axis=1)


def catmull(points: np.ndarray, steps: int = 24) -> np.ndarray:
    """Points of a Catmull-Rom spline through the points."""
    padded = np.concatenate([2 * points[:1] - points[1:2], points, 2 * points[-1:] - points[-2:-1]])
    t = np.linspace(0, 1, steps + 1)[:, None]
    out = []
    for p, q, r, s in zip(padded, padded[1:], padded[2:], padded[3:]):
        out.append(0.5 * (2 * q + (r - p) * t + (2 * p - 5 * q + 4 * r - s) * t**2 + (3 * q - p - 3 * r + s) * t**3))
    return np.concatenate(out)


def path(kind: str, points: np.ndarray) -> np.ndarray:
    """A slider's path as a chain of points. A repeated control point ends a Bezier piece."""
    if len(points) < 2 or kind == "L":
        return points
    if kind == "C":
        return catmull(points)
    if kind == "P" and len(points) == 3:
        found = arc(*points)
        return points if found is None else found
    ends = np.flatnonzero((points[1:] == points[:-1]).all(axis=1)) + 1
    pieces = [p for p in np.split(points, ends) if len(p) > 0]
    return np.concatenate([bezier(p) if len(p) > 1 else p for p in pieces])


def at_lengths(chain: np.ndarray, lengths: list[float]) -> np.ndarray:
    """Places on a chain at lengths from its start; past its end along its last direction."""
    steps = np.linalg.norm(np.diff(chain, axis=0), axis=1)
    keep = np.r_[True, steps > 0]
    chain, total = chain[keep], np.r_[0, np.cumsum(steps[steps > 0])]
    if len(chain) < 2:
        return np.repeat(chain[:1], len(lengths), axis=0)
    out = []
    for wanted in lengths:
        i = int(np.clip(np.searchsorted(total, wanted, "right") - 1, 0, len(chain) - 2))
        out.append(chain[i] + (chain[i + 1] - chain[i]) * ((wanted - total[i]) / (total[i + 1] - total[i])))
    return np.array(out)


# --- text


def sections(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    own: list[str] = []
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            own = out.setdefault(line[1:-1].lower(), [])
        elif line and not line.startswith("//"):
            own.append(line)
    return out


def _pairs(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(text: str | None, other: float) -> float:
    try:
        return float(text) if text is not None else other
    except ValueError:
        return other


def timing(lines: list[str]) -> np.ndarray:
    """Rows by time: start, beat length, bpm, origin, speed, kiai. Points without a section before them run at 120."""
    rows = []
    for line in lines:
        f = line.split(",")
        try:
            rows.append((int(float(f[0])), float(f[1]), len(f) < 7 or f[6].strip() == "1", len(f) > 7 and bool(int(f[7]) & 1)))
        except (ValueError, IndexError):
            continue
    rows.sort(key=lambda r: r[0])
    out, beat, origin = [], None, 0
    for start, length, own, kiai in rows:
        if own or beat is None:
            beat, origin = (length if own else 500.0), start
        out.append((start, beat, 60000 / beat if beat > 0 else 120.0, origin, -100 / length if not own and length < 0 else 1.0, kiai))
    return np.array(out, float).reshape(-1, 6)


def _active(points: np.ndarray, time: float) -> np.ndarray | None:
    i = int(np.searchsorted(points[:, 0], time, "right")) - 1
    return points[i] if i >= 0 else None


def _object(line: str, points: np.ndarray, multiplier: float) -> dict | None:
    f = line.split(",")
    try:
        x, y, time, flags, sound = (int(float(v)) for v in f[:5])
    except (ValueError, TypeError):
        return None
    if max(abs(x), abs(y)) > FARTHEST:
        return None
    kind = next((name for bit, name in ((SLIDER, "slider"), (SPINNER, "spinner"), (HOLD, "hold"), (CIRCLE, "circle")) if flags & bit), None)
    if kind is None:
        return None
    now = _active(points, time)
    row = {"x": x, "y": y, "time": time, "end_time": time, "kind": kind, "new_combo": bool(flags & COMBO), "hit_sound": sound, "bpm": 120.0 if now is None else now[2], "origin": 0 if now is None else int(now[3]), "kiai": now is not None and bool(now[5]), "curve": "", "anchors": 0, "hard_anchors": 0, "repeats": 0, "length": 0.0, "path_valid": False}
    row |= dict.fromkeys(("end_dx", "end_dy", "third_dx", "third_dy", "two_thirds_dx", "two_thirds_dy"), 0.0)
    try:
        if kind == "slider":
            _slider(row, f, now, multiplier)
        elif kind != "circle":
            row["end_time"] = int(f[5].split(":")[0])
    except (ValueError, IndexError):
        return None
    end = _active(points, row["end_time"])
    row["end_bpm"] = row["bpm"] if end is None else end[2]
    return row


def _slider(row: dict, f: list[str], now: np.ndarray | None, multiplier: float) -> None:
    curve, *anchors = f[5].split("|")
    slides, length = int(f[6]), float(f[7])
    points, valid = [(float(row["x"]), float(row["y"]))], bool(curve)
    for a in anchors:
        try:
            px, py = a.split(":")[:2]
            points.append((float(int(px)), float(int(py))))
        except ValueError:
            valid = False
    chain = np.array(points)
    same = (chain[2:] == chain[1:-1]).all(axis=1)
    first_same = same & ~np.r_[False, same][: len(same)]
    row |= {"curve": curve, "repeats": slides - 1, "length": length, "anchors": int(len(chain) - 1 - same.sum()), "hard_anchors": int(first_same.sum())}
    if now is not None and now[1] > 0 and math.isfinite(length) and multiplier * now[4] > 0:
        row["end_time"] = row["time"] + int(length / (100 * multiplier * now[4]) * now[1] * slides)
    if valid and len(chain) > 1 and 0 < length < 1e6:
        third, two, end = at_lengths(path(curve, chain), [length / 3, 2 * length / 3, length]) - chain[0]
        row |= {"path_valid": True, "end_dx": end[0], "end_dy": end[1]}
        # how far the path lies from the straight way to its end
        row |= {"third_dx": third[0] - end[0] / 3, "third_dy": third[1] - end[1] / 3, "two_thirds_dx": two[0] - 2 * end[0] / 3, "two_thirds_dy": two[1] - 2 * end[1] / 3}


def parse(content: bytes, map_id: int | None = None, modes: tuple[int, ...] | None = None, most_objects: int = 16_384) -> dict:
    """A map's header and objects, or its error."""
    found: dict = {"map_id": map_id, "objects": None, "error": None}
    parts = sections(content.decode("utf-8", "ignore").removeprefix("﻿"))
    general, meta, difficulty = (_pairs(parts.get(x, [])) for x in ("general", "metadata", "difficulty"))
    found["mode"] = int(_number(general.get("mode") or "0", 0))
    if map_id is None:
        own = meta.get("beatmapid", "")
        found["map_id"] = int(own) if own.lstrip("-").isdigit() else None
    found |= dict(zip(("hp", "cs", "od", "ar", "slider_multiplier", "slider_tick"), (_number(difficulty.get(k.lower()), v) for k, v in DIFFICULTY.items())))
    points = timing(parts.get("timingpoints", []))
    lines = parts.get("hitobjects", [])
    if found["map_id"] is None:
        return found | {"error": "no id"}
    if modes is not None and found["mode"] not in modes:
        return found | {"error": "other mode"}
    if not len(points):
        return found | {"error": "no timing points"}
    if len(lines) > most_objects:
        return found | {"error": "too many objects"}
    objects = [o for line in lines if (o := _object(line, points, found["slider_multiplier"]))]
    if not objects:
        return found | {"error": "no objects"}
    for i, o in enumerate(objects):
        o["object_index"] = i
    return found | {"objects": objects}


def unpacked(name: str, content: bytes) -> bytes:
    return zstandard.ZstdDecompressor().stream_reader(content).read() if name.endswith(".zst") else content


def read(spark: SparkSession, root: str, pattern: str = "*", modes: tuple[int, ...] | None = None) -> DataFrame:
    """A row per file: map as `MAP`. Ids come from file names; of a plain file and its compressed twin, the latter is
    read. Files that fail have an error and can be parted from the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.zst$", "")
    chosen = files.select("path", "content", stem.alias("stem"), F.col("path").endswith(".zst").cast("int").alias("packed"))
    chosen = chosen.groupBy("stem").agg(F.max_by(F.struct("path", "content"), "packed").alias("f")).select("stem", "f.*")
    schema = spark.range(0).select(F.lit(None).cast(MAP).alias("map")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for name, where, content in zip(*(c.to_pylist() for c in batch.columns)):
                own = name.rsplit(".", 1)[0]
                try:
                    out.append({"map": parse(unpacked(where, content), int(own) if own.isdigit() else None, modes)})
                except Exception as e:  # noqa: BLE001  a file's failure is a row
                    out.append({"map": {"map_id": int(own) if own.isdigit() else None, "error": f"{type(e).__name__}: {e}"}})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return chosen.select("stem", "path", "content").mapInArrow(rows, schema)


def objects(maps: DataFrame) -> DataFrame:
    return maps.where("map.error is null").select("map.map_id", F.inline("map.objects"))


def failures(maps: DataFrame) -> DataFrame:
    """The ledger of what couldn't be read; a later run leaves these ids out by an anti join."""
    return maps.where("map.error is not null").select("map.map_id", F.col("map.error").alias("reason"))


def looks_valid(content: str = "content"):
    """At least 100 bytes whose first line begins with the format's name, after one other character at most."""
    c = F.col(content)
    line = F.trim(F.split(F.make_valid_utf8(c.cast("string")), "\n", 2)[0])
    return (F.octet_length(c) >= 100) & (line.startswith(MAGIC) | F.substring(line, 2, len(MAGIC)).eqNullSafe(MAGIC))
