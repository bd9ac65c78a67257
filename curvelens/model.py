"""The data model: readings, one row per logged value, of all runs of all sources.

Three states stay apart everywhere: no row (nothing was logged), NULL (something was logged
but cannot be read) and NaN or an infinity (a reading like any other).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READINGS = "source_id string, run_id string, metric string, raw_metric string, seq long, step long, value double, wall_time double, epoch double"
FINDINGS = (
    "source_id string, run_id string, detector string, title string, severity string, sev_rank int, metric string, step_start long, step_end long, "
    "message string, evidence map<string,string>, detector_ord int, emit_ord int"
)
SERIES = ["source_id", "run_id", "metric"]
MAX_STEP = (1 << 53) - 1

# Severities from worst to least; detectors in the order in which they run.
SEVERITIES = {"error": 0, "warning": 1, "info": 2}
DETECTORS = ["spikes", "setbacks", "divergence", "plateau", "overfitting", "lr_schedule", "grad_norm", "throughput", "eval_noise", "loss_floor"]


def finite(value: Column) -> Column:
    """A number that arithmetic can use; false for NULL."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def severity_at_least(rank: Column, severity: str) -> Column:
    return rank <= SEVERITIES[severity]
