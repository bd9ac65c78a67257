"""Watching log files: what is told once, what is told again, and what a failed read does."""

import numpy as np
import pytest

from curvelens.cli import main
from curvelens.sources import check_options, load, load_sources
from curvelens.sources.text import Unreadable
from curvelens.streaming.logs import LogWatch

DECAY = 2 * np.exp(-np.arange(100) / 20) + 0.2
RISE = DECAY[-1] + np.linspace(0, 2, 50)
ENDED = ("divergence", "Diverged (did not recover)")


def write(path, values):
    path.write_text("step,loss\n" + "".join(f"{i},{float(v)!r}\n" for i, v in enumerate(values)))


def told(poll):
    return [] if poll.new is None else [(r["detector"], r["title"]) for r in poll.new.collect()]


def test_findings_are_told_once_and_again_when_history_changes(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    write(log / "a.csv", DECAY)
    state = LogWatch(spark, str(log), f"file://{tmp_path}/home", fail_on="error")
    first = state.poll()
    assert ENDED not in told(first) and first.status == 0 and first.notice is None
    write(log / "a.csv", [*DECAY, *RISE])
    second = state.poll()
    assert ENDED in told(second) and second.status == 1 and second.rewritten == 0
    again = state.poll()
    assert told(again) == [] and again.status == 1
    write(log / "a.csv", [DECAY[0] + 0.001, *DECAY[1:], *RISE])
    changed = state.poll()
    assert ENDED in told(changed) and changed.rewritten == 1
    state.close()
    assert not (tmp_path / "home").exists()


def test_a_failed_read_keeps_what_was_known(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    write(log / "a.csv", [*DECAY, *RISE])
    write(log / "b.csv", DECAY)
    state = LogWatch(spark, str(log), f"file://{tmp_path}/home")
    assert ENDED in told(state.poll())
    (log / "a.csv").write_text("step,loss,loss\n1,2,3\n")
    broken = state.poll()
    assert broken.status == 2 and told(broken) == [] and "a.csv" in broken.notice
    assert state.poll().notice is None  # the same remark is not made twice
    write(log / "a.csv", [*DECAY, *RISE, RISE[-1]])
    well = state.poll()
    assert well.status == 0 and well.rewritten == 0 and ENDED not in told(well) and "recovered" in well.notice


def test_nothing_to_read_is_status_2_until_there_is(spark, tmp_path):
    state = LogWatch(spark, str(tmp_path / "none"), f"file://{tmp_path}/home")
    missing = state.poll()
    assert missing.new is None and missing.status == 2 and "skipped" in missing.notice
    assert state.poll().notice is None
    (tmp_path / "none").mkdir()
    write(tmp_path / "none" / "a.csv", DECAY)
    assert state.poll().status == 0


def test_the_run_asked_for_is_held(spark, tmp_path):
    log = tmp_path / "c.csv"
    head = '"Step","one - train/loss","one - train/loss__MIN","one - train/loss__MAX"'
    body = "".join(f"{i},{float(v)!r},0,9\n" for i, v in enumerate(DECAY))
    log.write_text(head + "\n" + body)
    state = LogWatch(spark, str(log), f"file://{tmp_path}/home", run="on", fmt="wandb")
    state.poll()
    # a second run that begins so comes later: the first one stays chosen
    two = head + ',"only - train/loss","only - train/loss__MIN","only - train/loss__MAX"'
    log.write_text(two + "\n" + "".join(f"{i},{float(v)!r},0,9,{float(v)!r},0,9\n" for i, v in enumerate([*DECAY, *RISE])))
    runs = {r["run_id"] for r in state.poll().new.collect()}
    assert runs == {"one"}


def test_watch_command(spark, tmp_path, capsys):
    write(tmp_path / "a.csv", [*DECAY, *RISE])
    assert main(["watch", str(tmp_path / "a.csv"), "--once", "--fail-on", "error"], spark) == 1
    assert "Diverged (did not recover)" in capsys.readouterr().out
    assert main(["watch", str(tmp_path / "no.csv"), "--once"], spark) == 2


def test_options_must_fit_the_format(spark, tmp_path):
    check_options("csv", step_key="n")
    check_options("wandb", single_run="x", run="x")
    for fmt, options in (("hf", {"step_key": "n"}), ("csv", {"single_run": "x"}), ("csv", {"run": "x"}), ("tensorboard", {"step_key": "n"})):
        with pytest.raises(Unreadable):
            check_options(fmt, **options)
    write(tmp_path / "a.csv", DECAY)
    with pytest.raises(Unreadable):
        load(spark, str(tmp_path), "csv", single_run="x")
    assert "not for csv" in load_sources(spark, str(tmp_path), run="x").first()["error"]
    assert main(["analyze", str(tmp_path / "a.csv"), "--format", "csv", "--run", "x"], spark) == 2
