"""The first records of many files, reading no more of each than holds them.

Tasks open the files of a listing through Arrow's file systems and stop after the wanted records, so the bytes read grow with the number
of files and not with their size.
"""

from __future__ import annotations

import csv
import io
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import FILE, KEY, LINEAGE, qc
from ..spec import JobSpec
from .footers import open_file
from .rows import apply_header, drop_skipped

STEP = 1 << 16  # bytes read at a time
ROWS = f"__path string, {FILE} string, row long, vals array<string>"


class _Steps(io.RawIOBase):
    """A file as a raw stream in small steps, which counts what it handed out."""

    def __init__(self, f):
        self.f, self.taken = f, 0

    def readable(self):
        return True

    def readinto(self, into):
        got = self.f.read(min(len(into), STEP))
        into[: len(got)] = got
        self.taken += len(got)
        return len(got)


def first_records(f, n: int, delimiter: str = ",", encoding: str = "utf-8"):
    """(records, bytes read) of the first ``n`` non-blank records of an open file; missing cells are None."""
    steps = _Steps(f)
    text = io.TextIOWrapper(io.BufferedReader(steps, STEP), encoding=encoding, errors="replace", newline="")
    records = ([c if c != "" else None for c in r] for r in csv.reader(text, delimiter=delimiter) if r)
    return list(islice(records, n)), steps.taken


def file_heads(listing: DataFrame, n: int, delimiter: str = ",", encoding: str = "utf-8", per_task: int = 64) -> DataFrame:
    """(path, source_file, row, vals) of the first ``n`` records of every delimited file in ``listing`` (a frame with ``path``)."""
    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                where, name = open_file(path)
                with where.open_input_stream(name) as f:
                    out += [(path, path.rsplit("/", 1)[-1], i, r) for i, r in enumerate(first_records(f, n, delimiter, encoding)[0])]
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [KEY, FILE, "row", "vals"])

    files = listing.select("path")
    return files.repartition(max(1, -(-files.count() // per_task)), "path").mapInArrow(run, ROWS)


def preview_files(listing: DataFrame, spec: JobSpec, n: int = 10) -> DataFrame:
    """The first ``n`` data rows of every delimited file in ``listing``, under the spec's header row, selection and names."""
    from ..operators.project import filter_and_rename
    from .csv import NULL_MARKS

    above = max([int(spec.header_row) + len(spec.skiprows), *(s for s in spec.skiprows)]) + 1
    rows = drop_skipped(file_heads(listing, n + above, spec.delimiter, spec.encoding), spec.skiprows)
    frame, _ = apply_header(rows.where(F.col("row") <= int(spec.header_row) + n), spec)
    data = [c for c in frame.columns if c not in LINEAGE]
    frame = frame.withColumns({c: F.when(~qc(c).isin(*NULL_MARKS), qc(c)) for c in data}) if data else frame
    return frame if spec.headers else filter_and_rename(frame, spec)
