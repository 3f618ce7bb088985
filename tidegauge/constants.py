"""Fixed values of the telemetry model: they decide results and stand here together."""

import numpy as np

METRICS = ("pH", "turbidity", "conductivity", "temperature")
#: mean, standard deviation, least and greatest possible value
PRIORS = {"pH": (7.3, 0.45, 0.0, 14.0), "turbidity": (3.5, 1.8, 0.0, 500.0), "conductivity": (420.0, 65.0, 10.0, 4000.0), "temperature": (21.0, 3.2, 0.0, 50.0)}
CORRELATION = [[1.0, 0.15, -0.10, -0.20], [0.15, 1.0, 0.30, 0.05], [-0.10, 0.30, 1.0, 0.40], [-0.20, 0.05, 0.40, 1.0]]
PRIORITY_WEIGHTS = {"lab": 1.0, "calibration": 0.95, "field": 0.80, "mobile": 0.60, "backup": 0.50}
CONFIDENCE_WEIGHTS = {"lab": 0.99, "calibration": 0.95, "field": 0.80, "mobile": 0.65, "backup": 0.50}
OTHER_WEIGHT = 0.5
OUTLIER_SQ = 13.28
PH_RATE, TURBIDITY_RATE = 0.8, 15.0
THERMAL = {"rise": 3.5, "drop": -0.4, "seconds": 300.0}
CUSUM_SLACK, CUSUM_LIMIT, CUSUM_SCALE = 0.5, 4.5, 8.0
WINDOW_MINUTES, EVICT_HOURS = 30, 3
GENESIS = "0" * 64
CLUSTERS = {
    "cluster_basin_north": ["WQ-S101", "WQ-S102", "WQ-S103", "WQ-S123"],
    "cluster_basin_south": ["WQ-S201", "WQ-S202", "WQ-S203", "WQ-S204"],
    "cluster_industrial_inflow": ["WQ-IND01", "WQ-IND02", "WQ-S301"],
}
DEFAULT_CLUSTER = "default_zone"
STRATEGIES = {
    "source_priority": "source_priority", "source": "source_priority", "priority": "source_priority",
    "confidence_weighted": "confidence_weighted", "weighted": "confidence_weighted", "confidence": "confidence_weighted",
    "latest": "latest", "timestamp": "latest",
}


def strategy_of(name: str | None) -> str:
    """The strategy a name stands for; unknown names mean source priority."""
    return STRATEGIES.get((name or "").strip().lower(), "source_priority")


def precision() -> np.ndarray:
    """Inverse covariance of the priors."""
    d = np.diag([PRIORS[m][1] for m in METRICS])
    return np.linalg.pinv(d @ np.array(CORRELATION) @ d)
