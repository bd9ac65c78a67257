import json

import numpy as np

from curvelens import report
from curvelens.cli import main
from curvelens.model import READINGS
from curvelens.operators.detectors import run_all
from curvelens.streaming.watch import follow, watch


def rows(values, first=0, run="r", seq=None):
    return [("s", run, "train/loss", "loss", first + i if seq is None else seq + i, first + i, float(v), None, None) for i, v in enumerate(values)]


def test_new_findings_are_told_once_and_again_after_a_rewrite(spark, tmp_path):
    decay = 2 * np.exp(-np.arange(100) / 20) + 0.2
    rise = decay[-1] + np.linspace(0, 2, 50)
    told = []

    def step(values, first=0):
        spark.createDataFrame(rows(values, first), READINGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = watch(follow(spark, f"{tmp_path}/in"), f"{tmp_path}/home", lambda df, n: told.append([(r.detector, r.title) for r in df.collect()]), once=True)
        q.awaitTermination()

    step(decay)
    step(rise, 100)
    assert ("divergence", "Diverged (did not recover)") in told[-1]
    step([rise[-1]] * 3, 150)
    assert ("divergence", "Diverged (did not recover)") not in told[-1]
    step([rise[0]], 100)  # the same places anew
    assert ("divergence", "Diverged (did not recover)") in told[-1]


def test_reports_and_gate(spark, tmp_path):
    bad = np.linspace(1, 3, 60)
    df = spark.createDataFrame(rows(bad) + rows(np.linspace(3, 1, 60), run="ok"), READINGS)
    found = run_all(df)
    docs = report.documents(df, found)
    assert [d["run"]["run_id"] for d in docs] == ["ok", "r"] and docs[1]["summary"]["severities"]["error"] == 1
    assert docs[1]["summary"]["metrics"][0]["readings"] == 60 and docs[1]["schema_version"] == 1
    assert "Diverged" in report.terminal(docs[1]) and "no findings" in report.terminal({**docs[0], "findings": []})
    assert "<script" not in report.page(docs[1], report.charts(df, "s", "r")) and "<svg" in report.page(docs[1], report.charts(df, "s", "r"))
    assert report.gate(found, fail_on="error") == 1 and report.gate(found.filter("run_id = 'ok'"), fail_on="error") == 0
    (tmp_path / "a.csv").write_text("step,loss\n" + "".join(f"{i},{v}\n" for i, v in enumerate(bad)))
    out = tmp_path / "o.json"
    assert main(["analyze", str(tmp_path / "a.csv"), "--output", "json", "--out", str(out), "--fail-on", "error"], spark) == 1
    assert json.loads(out.read_text())["findings"][0]["title"] == "Diverged (rose from the start)"
    (tmp_path / "b.csv").write_text("note\nx\n")
    assert main(["analyze", str(tmp_path / "b.csv")], spark) == 2


def test_notes_tell_what_is_odd_about_an_input():
    fine = {"metric": "train/loss", "readings": 5, "distinct_steps": 5, "unreadable_steps": 0, "excluded": False}
    assert report.notes({"axis": "step", "skipped_rows": 0}, [fine]) == []
    odd = report.notes({"axis": "row_index", "skipped_rows": 2, "unread_bytes": 3}, [fine | {"readings": 6, "excluded": True, "unreadable_steps": 1}])
    assert len(odd) == 6 and "train/loss" in odd[1]
