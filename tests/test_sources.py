import json
import sqlite3
import struct
import zlib

import pytest

from curvelens import report
from curvelens.functions.names import stored_names
from curvelens.sources import binary, detect, load, load_sources, read_bytes, text
from curvelens.sources.text import Unreadable


def values(log):
    return [(r[1], r[4], r[5]) for r in log.rows]


def test_csv_layouts_agree():
    for sep, point in ((",", "."), (";", ","), ("\t", ".")):
        rows = [["step", "loss", "learning_rate"], ["1", f"2{point}5", "0"], ["2", "", "1e-3"], ["3.0", "n/a", "nan"]]
        log = text.read_csv("\n".join(sep.join(r) for r in rows))
        assert [(m, s, None if v is None else repr(v)) for m, s, v in values(log)] == [("train/loss", 1, "2.5"), ("lr", 1, "0.0"), ("lr", 2, "0.001"), ("train/loss", 3, None), ("lr", 3, "nan")]
        assert (log.axis, log.skipped_values, log.skipped_rows) == ("step", 1, 0)


def test_csv_rejected_rows_are_gaps_and_headers_are_checked():
    log = text.read_csv("step,loss\n1,2\n2,3,4\nx,5\n3,1\n")
    assert values(log) == [("train/loss", 1, 2.0), ("train/loss", 2, None), ("train/loss", 3, 1.0)] and log.skipped_rows == 2
    assert text.read_csv("loss,note\n1,a\n2,b\n").axis == "row_index"
    assert {m for m, *_ in values(text.read_csv("loss,note\n1,a\n2,b\n"))} == {"train/loss"}
    for bad in ("step,loss,loss\n1,2,3", "step,global_step,loss\n1,1,2", ""):
        with pytest.raises(Unreadable):
            text.read_csv(bad)
    assert values(text.read_csv("k,loss\n5,2\n", step_key="k")) == [("train/loss", 5, 2.0)]


def test_jsonl_and_trainer_state():
    log = text.read_jsonl('{"step": 1, "loss": 2}\nbad\n{"step": 2, "loss": null, "eval_loss": 1e400}\n{"step": 3, "step": 4, "loss": 1}\n')
    assert values(log) == [("train/loss", 1, 2.0), ("eval/loss", 2, float("inf"))] and log.skipped_rows == 2
    state = {"log_history": [{"step": 1, "loss": 3.5, "epoch": 0.1}, {"step": 2, "eval_loss": 2.0}, {"loss": 1}, {"step": 2, "train_runtime": 9}]}
    log = text.read_trainer_state(json.dumps(state))
    assert values(log) == [("train/loss", 1, 3.5), ("epoch", 1, 0.1), ("eval/loss", 2, 2.0)] and log.skipped_rows == 1 and log.meta["train_runtime"] == "9"


def test_tracker_exports():
    log = text.read_history("_step,_runtime,train/loss,trainer/global_step\n0,1.5,3,10\n1,2.5,2,20\n")
    assert [(r[1], r[4], r[5], r[6]) for r in log.rows] == [("train/loss", 10, 3.0, 1.5), ("train/loss", 20, 2.0, 2.5)] and log.axis == "step"
    chart = 'Step,"a - train/loss","a - train/loss__MIN","a - train/loss__MAX"\n1,2,1,3\n'
    log = text.read_chart(chart)
    assert [(r[0], r[1], r[4], r[5]) for r in log.rows] == [("a", "train/loss", 1, 2.0)]
    with pytest.raises(Unreadable):
        text.read_chart('Step,"a - b - loss"\n1,2\n')
    assert text.read_chart('Step,"a - b - loss"\n1,2\n', "a - b").rows[0][:2] == ("a - b", "train/loss")
    assert detect("x.csv", chart.encode()) == "chart"


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(n, wire, body):
    return varint(n << 3 | wire) + (varint(len(body)) + body if wire == 2 else body)


def tf_event(step, tag=None, value=None, start=False, version=None, tensor=None):
    body = field(1, 1, struct.pack("<d", 100.0 + step)) + field(2, 0, varint(step))
    if version:
        body += field(3, 2, version)
    if start:
        body += field(7, 2, field(1, 0, varint(1)))
    if tag:
        item = field(1, 2, tag) + (field(8, 2, tensor) if tensor is not None else field(2, 5, struct.pack("<f", value)))
        body += field(5, 2, field(1, 2, item))
    head = struct.pack("<Q", len(body))
    return head + struct.pack("<I", binary.masked(head)) + body + struct.pack("<I", binary.masked(body))


def test_event_files_restart_and_damage():
    assert binary.crc32c(b"123456789") == 0xE3069283
    data = tf_event(0, version=b"brain.Event:2") + b"".join(tf_event(s, b"loss", 5.0 - s) for s in range(4)) + tf_event(2, start=True) + tf_event(2, b"loss", 9.0)
    half = field(1, 0, varint(14)) + field(4, 2, struct.pack("<f", 1.5)[2:])
    data += tf_event(3, b"acc", tensor=half) + tf_event(4, b"img", tensor=half + field(2, 2, field(2, 2, b"")))
    log = binary.read_events({"train/events.out.tfevents.1.h": data + b"cut"})
    assert values(log) == [("train/loss", 0, 5.0), ("train/loss", 1, 4.0), ("train/loss", 2, 9.0), ("train/acc", 3, 1.5)]
    assert (log.overwritten, log.unread_bytes) == (2, 3)


def test_a_session_start_takes_back_what_follows_it():
    assert [binary.file_version(x) for x in ("brain.Event:2", "brain.Event:1", "brain.Event: 12", "other", "")] == [2, 1, 12, None, None]
    data = tf_event(0, version=b"brain.Event:2") + b"".join(tf_event(s, b"loss", float(s)) for s in range(1, 6)) + tf_event(3, start=True)
    log = binary.read_events({"a/events.out.tfevents.1.h": data})
    assert values(log) == [("train/loss", 1, 1.0), ("train/loss", 2, 2.0)] and log.overwritten == 3
    twice = tf_event(0, version=b"brain.Event:2") + tf_event(4, b"loss", 1.0) + tf_event(4, b"loss", 2.0)
    assert values(binary.read_events({"a/events.out.tfevents.1.h": twice})) == [("train/loss", 4, 1.0), ("train/loss", 4, 2.0)]


def test_before_session_starts_a_falling_step_takes_back_its_own_tags():
    data = tf_event(0, version=b"brain.Event:1") + b"".join(tf_event(s, tag, float(s)) for s in range(1, 5) for tag in (b"loss", b"acc")) + tf_event(3, b"loss", 9.0)
    log = binary.read_events({"a/events.out.tfevents.1.h": data})
    assert [v for v in values(log) if v[0] == "train/loss"] == [("train/loss", 1, 1.0), ("train/loss", 2, 2.0), ("train/loss", 3, 9.0)]
    assert [v[1] for v in values(log) if v[0] == "train/acc"] == [1, 2, 3, 4] or [v[1] for v in values(log) if v[0] == "acc"] == [1, 2, 3, 4]
    assert log.overwritten == 2
    equal = tf_event(0, version=b"brain.Event:1") + tf_event(4, b"loss", 1.0) + tf_event(4, b"loss", 2.0)
    assert len(values(binary.read_events({"a/events.out.tfevents.1.h": equal}))) == 2


def native(records):
    out = binary.RUN_HEADER
    for body in records:
        parts = []
        at = 0
        while True:
            left = binary.BLOCK - len(out) % binary.BLOCK
            if left < 7:
                out += b"\0" * left
                continue
            part = body[at : at + left - 7]
            last = at + len(part) == len(body)
            kind = (1 if not parts else 4) if last else (2 if not parts else 3)
            out += struct.pack("<IHB", zlib.crc32(bytes([kind]) + part), len(part), kind) + part
            parts.append(part)
            at += len(part)
            if last:
                break
    return out


def test_native_run_files():
    def history(step, **items):
        body = b"".join(field(1, 2, field(1, 2, k.encode()) + field(16, 2, v.encode())) for k, v in items.items())
        return field(2, 2, body + field(2, 2, field(1, 0, varint(step))))

    data = native([field(17, 2, field(1, 2, b"run7")), history(0, loss="2.5", big='"' + "x" * 70000 + '"'), history(1, loss="null"), history(2, loss='"NaN"')])
    log = binary.read_native(data)
    assert [(r[0], r[1], r[4], repr(r[5])) for r in log.rows] == [("run7", "train/loss", 0, "2.5"), ("run7", "train/loss", 1, "None"), ("run7", "train/loss", 2, "nan")]
    assert binary.envelopes(data[:-1])[1] > 0
    with pytest.raises(Unreadable):
        binary.read_native(b"something else")


def test_tracking_stores(tmp_path):
    db = sqlite3.connect(tmp_path / "m.db")
    db.executescript("create table metrics(key, value, timestamp, step, is_nan, run_uuid); create table runs(run_uuid, name); insert into runs values('r', 'n'); insert into metrics values('loss', 2.0, 1500, 1, 0, 'r'), ('loss', 0, 2500, 2, 1, 'r')")
    db.commit()
    db.close()
    data = (tmp_path / "m.db").read_bytes()
    assert [(r[0], r[1], r[4], repr(r[5]), r[6]) for r in read_bytes("m.db", data).rows] == [("r", "train/loss", 1, "2.0", 1.5), ("r", "train/loss", 2, "nan", 2.5)]
    log = binary.read_file_store({"0/r1/metrics/train/loss": b"1000 2.5 1\n2000 x 2\n3000 1.5 3\ncut"})
    assert values(log) == [("train/loss", 1, 2.5), ("train/loss", 3, 1.5)] and (log.skipped_rows, log.unread_bytes) == (1, 3)


def test_load_reads_all_logs_and_reports_bad_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("step,loss\n" + "".join(f"{i},{5 / (1 + i)}\n" for i in range(50)))
    (tmp_path / "b.jsonl").write_text('{"step": 1, "loss": NaN}\n')
    (tmp_path / "c.csv").write_text("step,step,loss\n1,1,1\n")
    got = load(spark, str(tmp_path)).groupBy("source_id").count().collect()
    assert sorted((r.source_id[-5:], r["count"]) for r in got) == [("a.csv", 50), ("jsonl", 1)]
    about = {r.source_id[-5:]: (r.format, r.error) for r in load_sources(spark, str(tmp_path)).collect()}
    assert about["a.csv"] == ("csv", None) and about["jsonl"] == ("jsonl", None) and "Unreadable" in about["c.csv"][1]


def test_stored_names():
    assert stored_names(["train_loss", "loss", "eval_loss", "eval/loss", "x", "lr-Adam"]) == {"loss": "train/loss", "eval/loss": "eval/loss", "lr-Adam": "lr", "train_loss": "train_loss", "x": "x", "eval_loss": "eval/loss[2]"}


def test_write_and_text(tmp_path):
    report.write(str(tmp_path / "o"), "x")
    assert (tmp_path / "o").read_text() == "x"
    with pytest.raises(ValueError):
        report.write(str(tmp_path / "o"), "y", (str(tmp_path / "o"),))
    assert report.visible("a\x1b‮b") == "a\\u001b\\u202eb"
    assert report.safe({"a": float("nan"), "b": [float("inf"), 1]}) == {"a": "nan", "b": ["inf", 1]}


def test_tables_of_runs_and_ambiguous_delimiters_are_refused():
    import pytest

    from curvelens.sources import text

    with pytest.raises(text.Unreadable, match="one row per run"):
        text.sniff_csv("Name,State,train/loss\na,finished,0.1\n")
    assert text.sniff_csv("Name,loss\na,1\n") == "csv" and not text.is_runs_table(["Name", "State", "step"])
    with pytest.raises(text.Unreadable, match="delimiters"):
        text.delimiter("a,b;c\n1,2;3\n4,5;6\n")
    assert text.delimiter("step;loss\n1;0,5\n2;0,25\n") == ";" and text.delimiter("step,loss\n") == ","
