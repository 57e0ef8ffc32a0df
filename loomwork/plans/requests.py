"""A search request, checked, and its plan: sources, filters, density penalty, one result a group, near-copies left out."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import in_range, month_bounds
from ..operators import vectors

#: Fixed limits of a request; results beyond those asked for that near-copies may use up.
MOST_RESULTS, MOST_SOURCES, SPARE = 1000, 100, 50


@dataclass(frozen=True)
class SearchRequest:
    """sources: ids whose vectors are averaged; bounds: column to (least, most), either may be None; months: first and
    last as YYYY-MM; status: one of the groups that `run` is given; distinct: leave out near-copies."""

    sources: tuple[int, ...]
    top_k: int = 50
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    months: tuple[str | None, str | None] = (None, None)
    status: str | None = None
    exclude_same_group: bool = True
    distinct: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "sources", tuple(dict.fromkeys(self.sources)))
        if not 1 <= len(self.sources) <= MOST_SOURCES or min(self.sources) < 0:
            raise ValueError(f"between 1 and {MOST_SOURCES} sources are needed")
        if not 1 <= self.top_k <= MOST_RESULTS:
            raise ValueError(f"top_k lies between 1 and {MOST_RESULTS}")


def filters(rows: DataFrame, request: SearchRequest, statuses: dict[str, list[str]], status: str = "status", released: str = "released_us", also: str | None = None) -> DataFrame:
    """Rows that the request allows; a status may stand in either of two columns (`also`). A null fails any bound; a row without a release date fails a first month but passes
    a last one."""
    rows = in_range(rows, request.bounds)
    if request.status is not None:
        either = [F.lower(F.col(c).cast("string")).isin(statuses[request.status]) for c in (status, also) if c]
        rows = rows.where(F.coalesce(either[0], F.lit(False)) | F.coalesce(either[-1], F.lit(False)))
    low, high = month_bounds(*request.months)
    first = F.coalesce(F.col(released), F.lit(-(1 << 63)))
    if request.months[0]:
        rows = rows.where(first >= low)
    if request.months[1]:
        rows = rows.where(first < high)
    return rows


def run(index: DataFrame, request: SearchRequest, key: str = "vec_id", group: str = "label", v: str = "embedding", density: str = "density", penalty: float = 0.3, statuses: dict[str, list[str]] | None = None) -> list[dict]:
    """The results in order: key, group, score (the plain product), rank. A bounded list."""
    own = index.where(F.col(key).isin(list(request.sources)))
    found = {r[key] for r in own.select(key).collect()}  # as many as sources
    missing = [s for s in request.sources if s not in found]
    if missing:
        raise KeyError(f"not indexed: {missing}")
    return _nearest(index, own, request, key, group, v, density, penalty, statuses)


def _nearest(index: DataFrame, own: DataFrame, request: SearchRequest, key: str, group: str, v: str, density: str, penalty: float, statuses: dict[str, list[str]] | None) -> list[dict]:
    """What lies nearest the mean of the rows `own`, without these and, if asked, their groups."""
    asked = vectors.mean_vector(own, [], v)
    rows = filters(index, request, statuses or {}).join(own.select(key), key, "left_anti")
    if request.exclude_same_group:
        rows = rows.join(own.select(group).distinct(), group, "left_anti")
    k = request.top_k + SPARE * request.distinct
    best = vectors.search(rows, asked, group, k, key, v, penalty, density)
    if request.distinct:
        best = best.join(index.select(key, v), key).orderBy(F.desc("adjusted"), group)
    results = [r.asDict() for r in best.collect()]
    if request.distinct:
        results = vectors.distinct_results(results, np.array(asked.first()["mean"]), request.top_k, v=v)
    return [{key: r[key], group: r[group], "score": r["score"], "rank": i + 1} for i, r in enumerate(results[: request.top_k])]


def recommend(index: DataFrame, plays: DataFrame, mods: list[str], request: SearchRequest, seed: int = 0, take: int = 5, key: str = "vec_id", group: str = "label", v: str = "embedding", density: str = "density", penalty: float = 0.3, statuses: dict[str, list[str]] | None = None) -> list[dict]:
    """From a user's plays (key, mods) with all of some mods, however many: their vectors' neighbours without what was
    played, of which `take` are drawn by a hash. The request's own sources aren't used."""
    with_mods = plays.where(F.size(F.array_except(F.array(*map(F.lit, mods)).cast("array<string>"), "mods")) == 0)
    own = index.join(with_mods.select(key).distinct(), key, "left_semi")
    if not own.head(1):
        return []
    near = _nearest(index, own, request, key, group, v, density, penalty, statuses)
    played = {r[key] for r in plays.where(F.col(key).isin([r[key] for r in near])).select(key).distinct().collect()}  # top_k at most
    fresh = [r for r in near if r[key] not in played]
    order = np.random.default_rng(seed).permutation(len(fresh))[:take]
    return [fresh[i] for i in sorted(order)]
