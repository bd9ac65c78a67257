"""Readers of metric logs; `load` reads any number of them, each with the reader that its bytes ask for.

Single files are a source each and are parsed in parallel. Of the formats that are folders
(event files, file stores) a folder is a source: its files meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.model import READINGS
from curvelens.operators import project
from curvelens.sources import binary, text
from curvelens.sources.text import Log, Unreadable

FORMATS = ["hf", "csv", "jsonl", "wandb", "wandb-native", "lightning", "tensorboard", "mlflow"]
SOURCES = "source_id string, format string, axis string, skipped_rows long, skipped_values long, unread_bytes long, overwritten long, error string"


def detect(name: str, data: bytes) -> str:
    """The format of one file, by its suffix, else by what it begins with."""
    suffix = name.rpartition(".")[2].lower()
    if binary.is_sqlite(data) or suffix in ("db", "sqlite", "sqlite3"):
        return "mlflow"
    if suffix == "wandb" or data[:4] == binary.RUN_HEADER[:4]:
        return "wandb-native"
    if "tfevents" in name:
        return "tensorboard"
    if suffix in ("jsonl", "json", "csv", "tsv", "txt"):
        if suffix == "json":
            return "hf"
        return "jsonl" if suffix == "jsonl" else text.sniff_csv(data.decode("utf-8-sig", "replace"))
    raise Unreadable(f"no format is known for {name}")


#: Formats with columns of which one can be named as the step, and formats that hold several runs.
STEP_KEYED = ["csv", "jsonl", "wandb", "wandb-native", "lightning", "mlflow"]
SEVERAL_RUNS = ["wandb", "tensorboard", "mlflow", "mlflow-files"]


def check_options(fmt: str, step_key: str | None = None, single_run: str | None = None, run: str | None = None) -> None:
    """Refuses options that mean nothing for a format, as a silent one would give other readings than asked for."""
    for given, formats, what in ((step_key, STEP_KEYED, "a step key"), (single_run, ["wandb"], "the run of a chart"), (run, SEVERAL_RUNS, "a run")):
        if given is not None and fmt not in formats:
            raise Unreadable(f"{what} can be given for {', '.join(formats)}, not for {fmt}")


def read_bytes(name: str, data: bytes, fmt: str | None = None, step_key: str | None = None, single_run: str | None = None, run: str | None = None) -> Log:
    fmt = fmt or detect(name, data)
    check_options("wandb" if fmt == "chart" else fmt, step_key, single_run, run)
    decoded = "" if fmt in ("mlflow", "wandb-native", "tensorboard") else data.decode("utf-8-sig", "replace")
    if fmt == "wandb" and text.is_chart(text.records(decoded)[0]):
        fmt = "chart"
    if fmt in ("csv", "lightning"):
        return text.read_csv(decoded, step_key, fmt)
    if fmt == "jsonl":
        return text.read_jsonl(decoded, step_key)
    if fmt == "hf":
        return text.read_trainer_state(decoded)
    if fmt == "wandb":
        return text.read_history(decoded, step_key)
    if fmt == "chart":
        return text.read_chart(decoded, single_run)
    if fmt == "wandb-native":
        return binary.read_native(data, step_key)
    if fmt == "mlflow":
        return binary.read_sqlite(data)
    if fmt == "tensorboard":
        return binary.read_events({name: data})
    raise Unreadable(f"unknown format {fmt!r}")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    # a log has the size that it had when the folder was listed: bytes that are appended meanwhile wait
    return found.select("path", F.expr("substring(content, 1, cast(length as int))").alias("content"))


def load(spark: SparkSession, path: str, fmt: str | None = None, step_key: str | None = None, single_run: str | None = None, pattern: str | None = None, run: str | None = None) -> DataFrame:
    """Readings of every log under a path; with `run`, of the run so named or the only one that begins so."""
    found = _parsed(files(spark, path, pattern), path, fmt, step_key, single_run, run, READINGS, False)
    return found if run is None else found.join(project.select_run(found, run), ["source_id", "run_id"], "left_semi")


def load_sources(spark: SparkSession, path: str, fmt: str | None = None, step_key: str | None = None, single_run: str | None = None, pattern: str | None = None, run: str | None = None) -> DataFrame:
    """A row per log: its format, axis, and what could not be read; an error instead of readings."""
    return _parsed(files(spark, path, pattern), path, fmt, step_key, single_run, run, SOURCES, True)


def _parsed(found: DataFrame, root: str, fmt, step_key, single_run, run, schema: str, about: bool) -> DataFrame:
    if fmt is not None:
        check_options(fmt, step_key, single_run, run)
    columns = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def emit(source: str, read) -> pa.RecordBatch | None:
        try:
            log, error = read(), None
        except Exception as e:  # a log that cannot be read must not stop the others
            log, error = Log(fmt or "unknown"), f"{type(e).__name__}: {e}"
        if about:
            rows = [(source, log.format, log.axis, log.skipped_rows, log.skipped_values, log.unread_bytes, log.overwritten, error)]
        else:
            rows = list(text.rows_of(log, source))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns) if rows else None

    if fmt in ("tensorboard", "mlflow-files"):
        reader = binary.read_events if fmt == "tensorboard" else binary.read_file_store

        def folder(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            batch = emit(key[0], lambda: reader({binary.relative(p, root): bytes(c) for p, c in zip(frame["path"], frame["content"], strict=True)}))
            return batch.to_pandas() if batch is not None else pd.DataFrame(columns=columns)

        return found.withColumn("source", F.lit(root)).groupBy("source").applyInPandas(folder, schema)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if (out := emit(p, lambda p=p, data=data: read_bytes(p.rpartition("/")[2], data, fmt, step_key, single_run, run))) is not None:
                    yield out

    return found.mapInArrow(single, schema)
