"""A plain, one-event-at-a-time model of the telemetry semantics, for comparison."""

from __future__ import annotations

import random

import numpy as np

from tidegauge.constants import CONFIDENCE_WEIGHTS, METRICS, PRIORITY_WEIGHTS, PRIORS, precision


def random_events(n: int, seed: int, sensors: int = 3, odd: float = 0.1) -> list[dict]:
    """Events with late arrivals, equal times, copies, partial readings and strange values."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.1:
            out.append(dict(rng.choice(out)))
            continue
        minute = max(0, i // 2 + rng.choice([0, 0, 0, -3, -40, 1]))
        readings = {}
        for m in rng.sample(METRICS, rng.randint(0, 4)):
            mean, std, _, high = PRIORS[m]
            readings[m] = round(rng.gauss(mean, std), 2) if rng.random() > odd else round(rng.choice([mean + 6 * std, high + 1, mean - 2 * std]), 2)
        day, rest = divmod(minute * 20, 1440)
        stamp = f"2024-06-{15 + day:02d}T{rest // 60:02d}:{rest % 60:02d}:00Z"
        out.append({"sensor_id": f"S{rng.randrange(sensors)}", "timestamp": stamp, "readings": readings, "source": rng.choice(["lab", "field", "backup", "Mobile", "strange", "calibration"])})
    return out


def unique(events: list[dict]) -> list[tuple[int, dict]]:
    seen, out = set(), []
    for i, e in enumerate(events):
        key = (e["sensor_id"], e["timestamp"], tuple(sorted(e["readings"].items())), e["source"].lower())
        if key not in seen:
            seen.add(key)
            out.append((i, e))
    return out


def fold(events: list[tuple[int, dict]], strategy: str) -> dict[str, dict]:
    """metric -> value, ts, source of one sensor's events, folded in event time."""
    weights = CONFIDENCE_WEIGHTS if strategy == "confidence_weighted" else PRIORITY_WEIGHTS
    cells: dict[str, dict] = {}
    for _, e in sorted(events, key=lambda x: (x[1]["timestamp"], x[0])):
        for m, v in e["readings"].items():
            old, new = cells.get(m), {"value": v, "ts": e["timestamp"], "source": e["source"]}
            w = weights.get(e["source"].lower(), 0.5)
            if old is not None and old["ts"] == e["timestamp"]:
                had = weights.get(old["source"].lower(), 0.5)
                if strategy == "source_priority" and w < had:
                    continue
                if strategy == "confidence_weighted":
                    new |= {"value": round((v * w + old["value"] * had) / (w + had), 4), "source": f"weighted_fusion({old['source']}+{e['source']})"}
            cells[m] = new
    return cells


def micros(stamp: str) -> int:
    from datetime import datetime

    return round(datetime.fromisoformat(stamp).timestamp() * 1e6)


def anomalies(events: list[tuple[int, dict]], strategy: str) -> dict[int, str]:
    """Anomaly type by arrival number, each state folded from scratch."""
    out = {}
    P, mean = precision(), np.array([PRIORS[m][0] for m in METRICS])
    for sensor in {e["sensor_id"] for _, e in events}:
        own = [x for x in events if x[1]["sensor_id"] == sensor]
        before, sums = None, {m: (0.0, 0.0) for m in METRICS}
        for k, (i, e) in enumerate(own):
            state = {m: c["value"] for m, c in fold(own[: k + 1], strategy).items()}
            now = micros(e["timestamp"])
            if any(not PRIORS[m][2] <= v <= PRIORS[m][3] for m, v in state.items()):
                out[i] = "OUT_OF_BOUNDS"
                continue
            if before:
                dt = max(1.0, (now - before[0]) / 1e6)
                change = {m: state[m] - before[1][m] for m in state if m in before[1]}
                if abs(change.get("pH", 0)) / dt * 60 > 0.8 or change.get("turbidity", 0) / dt * 60 > 15:
                    out[i] = "TEMPORAL_RATE_OF_CHANGE"
                    continue
                if change.get("temperature", 0) >= 3.5 and change.get("pH", 0) <= -0.4 and dt <= 300:
                    out[i] = "THERMAL_PH_COUPLING"
                    continue
            before = (now, state)
            drift = False
            for m, v in state.items():
                z = (v - PRIORS[m][0]) / PRIORS[m][1]
                sums[m] = (max(0.0, sums[m][0] + z - 0.5), max(0.0, sums[m][1] - z - 0.5))
                drift = drift or max(sums[m]) > 4.5
            d = np.array([state.get(m, PRIORS[m][0]) for m in METRICS]) - mean
            out[i] = "MULTIVARIATE_OUTLIER" if d @ P @ d > 13.28 else "SENSOR_DRIFT" if drift else "NONE"
    return out


def corroborated(events: list[tuple[int, dict]], types: dict[int, str], clusters: dict[str, list[str]]) -> dict[int, list[str]]:
    """Corroborating neighbours of each anomaly, with an evicting cache as events arrive."""
    cache: dict[str, list[int]] = {}
    flag: dict[str, bool] = {}
    out = {}
    for i, e in events:
        now, s = micros(e["timestamp"]), e["sensor_id"]
        odd = types[i] != "NONE"
        if odd:
            cache.setdefault(s, []).append(now)
            cache[s] = [t for t in cache[s] if t >= now - 3 * 3600 * 10**6]
            members = next((c for c in clusters.values() if s in c), [])
            out[i] = [n for n in members if n != s and (any(abs(t - now) <= 1800 * 10**6 for t in cache.get(n, [])) or flag.get(n))]
        flag[s] = odd
    return out
