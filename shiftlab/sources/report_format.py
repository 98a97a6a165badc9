"""S4/S5 as a data source of its own: ``format("shiftlab_report")``.

A path holds a folder per experiment, ``name=<experiment>``, with one wide CSV: two header rows
(split labels, then mean and std), then a row per metric. Rows are
``(name, metric, split, mean, std)``.

Reading makes a partition per ``FOLDERS`` experiments. Writing is a two-phase commit: tasks write
whole reports into a staging folder; only when all tasks have ended does the driver
move them to their places, and if any fails it removes the staging folder, so no reader ever
sees a half-written report. All rows of a report must be in one task; :func:`save_reports`
sees to that.
"""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from shiftlab import SPLIT_LABELS, SPLITS
from shiftlab.sources.tables import file_system

FORMAT = "shiftlab_report"
#: Experiments that one reading task takes.
FOLDERS = 64
SCHEMA = "name string, metric string, split string, mean double, std double"
_FILE = "report.csv"


def report_text(rows: list[tuple]) -> str:
    """The CSV of one report from (metric, split, mean, std) rows."""
    values = {(metric, split): (mean, std) for metric, split, mean, std in rows}
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n").writerow
    write([""] + [SPLIT_LABELS[s] for s in SPLITS for _ in range(2)])
    write([""] + ["mean", "std"] * len(SPLITS))
    for metric in sorted({m for m, _ in values}):
        numbers = [x for s in SPLITS for x in values.get((metric, s), (None, None))]
        write([metric] + ["" if x is None else repr(float(x)) for x in numbers])
    return out.getvalue()


def report_rows(text: str):
    """(metric, split, mean, std) rows of a report's CSV; its header says which splits it has."""
    label, stat, *body = list(csv.reader(io.StringIO(text)))
    split = {SPLIT_LABELS[s]: s for s in SPLITS}
    places: dict[str, dict[str, int]] = {}
    for i, (lab, st) in enumerate(zip(label, stat)):
        if i:
            places.setdefault(split.get(lab, lab), {})[st] = i

    def number(row, i):
        return float(row[i]) if i is not None and i < len(row) and row[i] != "" else None

    for row in body:
        for s, at in places.items():
            if row and row[0]:
                yield row[0], s, number(row, at.get("mean")), number(row, at.get("std"))


@dataclass
class _Folders(InputPartition):
    names: list


@dataclass
class _Staged(WriterCommitMessage):
    names: list


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs
        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("name="))
        return [_Folders(names[i:i + FOLDERS]) for i in range(0, len(names), FOLDERS)] or [_Folders([])]

    def read(self, partition):
        system, root = file_system(self.path)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}/{_FILE}") as f:
                text = f.read().decode()
            for metric, split, mean, std in report_rows(text):
                yield unquote(name[5:]), metric, split, mean, std


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stage = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        reports: dict[str, list] = {}
        for row in iterator:
            if row["split"] not in SPLITS:
                raise ValueError(f"unknown split {row['split']!r}")
            reports.setdefault(row["name"], []).append((row["metric"], row["split"], row["mean"], row["std"]))
        system, root = file_system(self.path)
        for name, rows in reports.items():
            folder = f"{root}/{self.stage}/{uuid.uuid4().hex}/name={quote(str(name), safe='')}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{_FILE}") as f:
                f.write(report_text(rows).encode())
            reports[name] = folder
        return _Staged(list(reports.items()))

    def commit(self, messages):
        from pyarrow import fs
        system, root = file_system(self.path)
        staged = [n for m in messages if m is not None for n in m.names]
        names = [name for name, _ in staged]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            self.abort(messages)
            raise ValueError(f"rows of one report came from several tasks: {twice[:3]}")
        old = f"{root}/_replaced-{uuid.uuid4().hex}"
        system.create_dir(root, recursive=True)
        present = {f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("name=")}
        goes = present if self.overwrite else present & {folder.rsplit("/", 1)[1] for _, folder in staged}
        if goes:
            system.create_dir(old)
        for folder in sorted(goes):
            system.move(f"{root}/{folder}", f"{old}/{folder}")
        for _, folder in staged:
            system.move(folder, f"{root}/{folder.rsplit('/', 1)[1]}")
        self._remove(system, f"{root}/{self.stage}")
        self._remove(system, old)

    def abort(self, messages):
        system, root = file_system(self.path)
        self._remove(system, f"{root}/{self.stage}")

    @staticmethod
    def _remove(system, folder: str) -> None:
        from pyarrow import fs
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class ReportSource(DataSource):
    """Option ``path`` (or ``load(path)``, ``save(path)``)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register_report_format(spark: SparkSession) -> None:
    """Make ``format("shiftlab_report")`` known to the session."""
    spark.dataSource.register(ReportSource)


def save_reports(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5 through the format: the long summary ``(name, metric, split, mean, std)``, a report
    per name. ``overwrite`` replaces all reports of the path, ``append`` those of the same names."""
    register_report_format(summary.sparkSession)
    rows = summary.select("name", "metric", "split", F.col("mean").cast("double").alias("mean"),
                          F.col("std").cast("double").alias("std"))
    rows.repartition("name").write.format(FORMAT).mode(mode).save(path)


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """S4 through the format: ``(name, metric, split, mean, std)``."""
    register_report_format(spark)
    return spark.read.format(FORMAT).load(path)
