"""How competing readings of a metric are resolved.

A strategy is one of three kinds known by name, with the usual or other weights of sources, or a fold of the
user's own. A fold gives a metric's cell, a dict with value, micros (its event time), source and confidence,
and whatever else it needs to go on (JSON values):

    step(cell or None, value, micros, source) -> the cell after a reading that arrives now
    merge(a, b) -> the cell of the readings of both

merge has to be associative and commutative and to agree with step, so that the same fold serves as an
aggregate with partial results, as a running state and as the state of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from ..constants import CONFIDENCE_WEIGHTS, OTHER_WEIGHT, PRIORITY_WEIGHTS, strategy_of


@dataclass(frozen=True)
class Strategy:
    name: str
    weights: Mapping[str, float] | None = None  # of sources by lower-case name; others have OTHER_WEIGHT
    step: Callable[[dict | None, float, int, str], dict] | None = None
    merge: Callable[[dict, dict], dict] | None = None

    @property
    def own(self) -> bool:
        """Whether it is a fold of the user's own."""
        return self.step is not None

    def weight(self, source: str) -> float:
        return 1.0 if self.name == "latest" else (self.weights or {}).get(source.lower(), OTHER_WEIGHT)

    def advance(self, cell: dict | None, value: float, micros: int, source: str) -> dict:
        """A metric's cell after a reading that arrives now."""
        if self.own:
            return self.step(cell, value, micros, source)
        new = {"value": value, "micros": micros, "source": source, "confidence": self.weight(source)}
        if cell is None or micros > cell["micros"]:
            return new
        if micros < cell["micros"]:
            return cell
        had = self.weight(cell["source"])
        if self.name == "confidence_weighted":
            total = new["confidence"] + had
            fused = round((value * new["confidence"] + cell["value"] * had) / total, 4)
            return {"value": fused, "micros": micros, "source": f"weighted_fusion({cell['source']}+{source})", "confidence": min(1.0, total / 1.5)}
        return cell if self.name == "source_priority" and new["confidence"] < had else new


def of(which: str | Strategy | None, weights: Mapping[str, float] | None = None) -> Strategy:
    """The strategy a name stands for (see constants.strategy_of), with weights in place of its own if given."""
    if isinstance(which, Strategy):
        return which if weights is None else replace(which, weights=weights)
    name = strategy_of(which)
    return Strategy(name, weights or (CONFIDENCE_WEIGHTS if name == "confidence_weighted" else PRIORITY_WEIGHTS))


def averaged(weights: Mapping[str, float] = CONFIDENCE_WEIGHTS) -> Strategy:
    """The weighted mean of all readings at a metric's latest time, whatever their order; confidence grows with
    their weight. An example of a fold of one's own."""

    def cell(micros: int, total: float, weight: float, sources: list[str]) -> dict:
        return {"value": total / weight, "micros": micros, "source": "+".join(sources), "confidence": weight / (weight + 1.0), "total": total, "weight": weight, "sources": sources}

    def merge(a: dict, b: dict) -> dict:
        if a["micros"] != b["micros"]:
            return max(a, b, key=lambda c: c["micros"])
        return cell(a["micros"], a["total"] + b["total"], a["weight"] + b["weight"], sorted({*a["sources"], *b["sources"]}))

    def step(had: dict | None, value: float, micros: int, source: str) -> dict:
        weight = weights.get(source.lower(), OTHER_WEIGHT)
        new = cell(micros, value * weight, weight, [source.lower()])
        return new if had is None else merge(had, new)

    return Strategy("averaged", weights, step, merge)
