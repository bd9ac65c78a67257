"""Times as windows against the detector's own rule, run by run."""

import numpy as np
import pandas as pd
import pytest

from curvelens.model import READINGS
from curvelens.operators import detectors
from curvelens.operators.timing import timings


def series(run, metric, values, clocks=None, steps=None):
    n = len(values)
    clocks, steps = [None] * n if clocks is None else clocks, range(n) if steps is None else steps
    return [("s", run, metric, metric, i, int(s), None if v is None else float(v), None if c is None else float(c), None) for i, (v, c, s) in enumerate(zip(values, clocks, steps, strict=True))]


@pytest.mark.parametrize("axis", ["step", "logging_step"])
def test_equals_the_rule_run_by_run(spark, axis):
    r = np.random.default_rng(1)
    slow = np.cumsum(np.r_[r.uniform(0.9, 1.1, 40), r.uniform(1.9, 2.1, 20)])
    rows = (
        series("clock", "train/loss", r.random(60), slow)
        + series("odd steps", "eval/loss", r.random(60), slow, np.cumsum(r.integers(1, 5, 60)))
        + series("back", "train/loss", r.random(60), np.r_[slow[:58], slow[10], slow[59]])
        + series("unclocked", "train/loss", r.random(60), [None, *slow[1:]]) + series("unclocked", "eval/loss", r.random(60), slow)
        + series("short", "train/loss", r.random(10), slow[:10])
        + series("timed", "step_time", r.random(30) + 1) + series("timed", "throughput", r.random(30) + 1)
        + series("rate", "throughput", np.r_[r.random(30) + 1, np.nan, 0.0, r.random(8) + 1])
        + series("poor", "step_time", [None, *(r.random(30) + 1)]) + series("poor", "throughput", r.random(30) + 1)
        + series("few", "step_time", [1.0] * 9) + series("few", "throughput", r.random(30) + 1)
        + series("double", "train/loss", np.r_[r.random(60), 0.5], np.r_[slow, 3.0], [*range(60), 59])
        + series("same step", "throughput", [*(r.random(20) + 1), None], None, [*range(20), 3])
    )
    df = spark.createDataFrame(rows, READINGS)
    got = {x["run_id"]: x for x in timings(df, axis).collect()}
    frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in READINGS.split(", ")])
    frame["unreadable"] = frame["value"].isna() & (frame["raw_metric"] != "rate") & ~frame["run_id"].eq("rate")
    for run, own in frame.groupby("run_id"):
        want = detectors.timing(detectors.RunView(own, axis))
        assert (run in got) == (want["source"] is not None), run
        if run in got:
            assert (got[run]["observations"], got[run]["invalid"], got[run]["win"], got[run]["first_step"], got[run]["last_step"]) == tuple(want[k] for k in ("observations", "invalid", "window", "first", "last")), run
            assert got[run]["ratio"] == (None if want["ratio"] is None else pytest.approx(want["ratio"])), run


def test_an_empty_table_has_no_times(spark):
    assert timings(spark.createDataFrame([], READINGS)).count() == 0
