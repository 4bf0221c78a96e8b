"""Row counts, columns and schemas of Parquet files from their footers: nothing else of a file is read, so a folder's cost follows
the number of its files and not their size.

Tasks open the files of a listing through Arrow's file systems (local, HDFS, object stores). Files they cannot open come back with a message.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"  # fixed: where Spark keeps a file's schema


def open_file(uri: str):
    """(file system, name there) of a listed path."""
    from pyarrow import fs

    if re.match("(file:)?/", uri):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _spark_schema(footer) -> str:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_schema

    known = (footer.metadata or {}).get(ROW_SCHEMA)
    schema = T.StructType.fromJson(json.loads(known)) if known else from_arrow_schema(footer.schema.to_arrow_schema(), prefer_timestamp_ntz=True)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).json()


def _read(batches):
    from pyarrow import parquet

    for batch in batches:
        out = []
        for uri in batch.column("path").to_pylist():
            try:
                where, name = open_file(uri)
                with where.open_input_file(name) as f:
                    footer = parquet.read_metadata(f)
                out.append((uri, footer.num_rows, len(footer.schema.to_arrow_schema().names), _spark_schema(footer), None))
            except Exception as e:  # noqa: BLE001 - any unreadable file is reported, not fatal
                out.append((uri, None, None, None, f"{type(e).__name__}: {e}"[:500]))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))],
                                         ["path", "rows", "columns", "schema", "message"])


def file_footers(listing: DataFrame, per_task: int = 64) -> DataFrame:
    """(path, rows, columns, schema as JSON, message) of every Parquet file in ``listing`` (a frame with ``path``); ``message`` is null where
    the footer could be read. About ``per_task`` files a task."""
    files = listing.select("path")
    spread = files.repartition(max(1, -(-files.count() // per_task)), "path")
    return spread.mapInArrow(_read, "path string, rows long, columns int, schema string, message string")


def preflight_footers(listing: DataFrame) -> DataFrame:
    """A10, A9 of Parquet inputs without a scan: rows, columns and a status (OK, Empty or the error) of every listed file."""
    status = F.when(F.col("message").isNotNull(), F.concat(F.lit("error: "), F.col("message"))).when(F.col("rows") > 0, "OK").otherwise("Empty")
    return file_footers(listing).select("path", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"), status.alias("status"))
