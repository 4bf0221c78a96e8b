"""Row tables: the common shape of header-less scans (CSV records, worksheet rows).

``source_file, sheet, row, vals: array<string>, kinds: array<string>`` with ``row`` the 0-based
record index in its file/sheet. Header rows are found and applied here; data columns come out as
``values[i]`` projections, so no cell-level shuffle is needed.
"""

from __future__ import annotations

import logging
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import to_num
from ..operators.discover import first_header_row
from ..operators.lineage import FILE, KEY, LAYOUT, NUMERIC, ORD, SHEET, file_keys, qc
from ..session import scratch_path
from ..spec import JobSpec

log = logging.getLogger(__name__)


def scope_of(rows: DataFrame) -> list[str]:
    return file_keys(rows) + ([SHEET] if SHEET in rows.columns else [])


def drop_skipped(rows: DataFrame, skiprows) -> DataFrame:
    """Remove ``skiprows`` (record indices) and renumber the rest."""
    skip = sorted({int(s) for s in skiprows or []})
    if not skip:
        return rows
    r = F.col("row")
    shift = sum((F.when(r > s, 1).otherwise(0) for s in skip), F.lit(0))
    return rows.where(~r.isin(skip)).withColumn("row", r - shift)


def header_row_guess_rows(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """M1 on a row table: per file/sheet the first row with > 80 % text and > 50 % fill."""
    scope = scope_of(rows)
    r = rows if max_rows is None else rows.where(F.col("row") < max_rows)
    if "kinds" not in r.columns:
        from .csv import with_text_kinds
        r = with_text_kinds(r)
    filled = F.size(F.filter("vals", lambda v: v.isNotNull()))
    texts = F.size(F.filter(F.arrays_zip("vals", "kinds"),
                            lambda z: z["vals"].isNotNull() & (z["kinds"] == "text")))
    width = F.col("w") if "w" in r.columns else F.size("vals")  # scans pad records to the widest file and tell the file's own
    stats = r.select(*scope, "row", filled.alias("filled"), texts.alias("texts"), width.alias("w"))
    return first_header_row(stats, scope)


def _unique_names(names: list) -> list[str]:
    """Blank header cells become ``Unnamed: i``; repeated names get ``.1``, ``.2``."""
    out, seen = [], {}
    for i, n in enumerate(names):
        base = f"Unnamed: {i}" if n is None or str(n).strip() == "" else str(n)
        name = base
        k = seen.get(base, 0)
        while name in seen:
            k += 1
            name = f"{base}.{k}"
        seen[base] = k
        seen.setdefault(name, 0)
        out.append(name)
    return out


def apply_header(rows: DataFrame, spec: JobSpec, header_rows: DataFrame | None = None,
                 header_override: DataFrame | None = None, heads: DataFrame | None = None, shown=None) -> tuple[DataFrame, list[list[str]]]:
    """Turn a row table (skipped rows already dropped) into a frame: header row per file (spec, or ``header_rows`` table),
    names from that row, data rows below it; files with different header layouts are stacked by
    name. ``header_override``: ``(scope…, names array<string>)`` replacing the read names (merged
    header expansion); ``heads``: the header cells ``(scope…, names)``, where they are known already; ``shown(names, columns)``: what the
    layout column holds instead of a file's own names, told once per layout. Returns the frame and, if all files share one layout, its names.

    Only the names of the result's columns reach the driver; which file has which layout, and where a layout has which
    name, are joined.
    """
    scope = scope_of(rows)
    if header_rows is None:
        tagged = rows.withColumn("header_row", F.lit(int(spec.header_row)))      # no per-file table
    else:
        tagged = rows.join(header_rows, scope)
    data = tagged.where(F.col("row") > F.col("header_row"))
    if spec.headers:
        # Positional; names come from the spec, not from the file
        cols = []
        for cell in spec.headers:
            target = cell.alias or spec.column_mappings.get(cell.name, cell.name)
            cols.append(F.try_element_at("vals", F.lit(cell.column + 1)).alias(target))
        return data.select(*cols, *_lineage(scope)), [[c.alias or c.name for c in spec.headers]]
    head = heads if heads is not None else tagged.where(F.col("row") == F.col("header_row")).select(*scope, F.col("vals").alias("names"))
    if header_override is not None:
        head = head.join(header_override.withColumnRenamed("names", "__ov"), scope, "left") \
                   .select(*scope, F.coalesce("__ov", "names").alias("names"))
    head = _kept(head.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
                 .withColumn("__layout", F.xxhash64("names")), "heads")
    layouts = _kept(head.select("__layout", "names").distinct().mapInArrow(_column_names, "__layout long, names array<string>, columns array<string>"), "layouts")
    # the columns of the result: every name once, by its leftmost place
    order = [r["name"] for r in layouts.select(F.posexplode("columns").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
             .orderBy("at", "name").collect()]
    if not order:
        return rows.select(*_lineage(scope)).limit(0), []
    two = layouts.select("names").limit(2).collect()
    if len(two) == 1:
        own = F.array(*[F.lit(c) for c in order])                                 # one layout: no join
        own = shown(own, order) if shown else own
        cells = [F.try_element_at("vals", F.lit(i + 1)).alias(c) for i, c in enumerate(order)]
    else:  # each file's layout, then each layout's names, both written tables whose size the planner knows
        data = data.join(head.select(*scope, "__layout"), scope).join(layouts.select(
            "__layout", F.col("columns").alias("__own"), (shown(F.col("columns"), order) if shown else F.col("columns")).alias("__shown")), "__layout")
        own = F.col("__shown")
        cells = [F.try_element_at("vals", F.nullif(F.array_position("__own", F.lit(c)), F.lit(0)).cast("int")).alias(c) for c in order]
    out = data.select(*cells, *_lineage(scope), own.alias(LAYOUT))
    return out, [order] if len(two) == 1 else []


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A small table written to the shared folder and read back, with a size the planner knows."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _column_names(batches):
    """The column names that each layout's header cells give."""
    for batch in batches:
        names = [_unique_names(_trim(list(n))) for n in batch.column("names").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("__layout"), batch.column("names"), pa.array(names, pa.list_(pa.string()))],
                                         names=["__layout", "names", "columns"])


def apply_metadata_headers(rows: DataFrame, cells) -> DataFrame:
    """Header cells picked on the sheet (``HeaderCell`` with row and column) name the columns.

    The header row is the lowest picked row; for a column picked twice the first pick in
    (row, column) order wins; data are the rows below the header row; columns are taken by index.
    """
    cells = sorted(cells, key=lambda c: (c.row, c.column))
    if not cells:
        raise ValueError("no header cells picked")
    header_row = max(c.row for c in cells)
    names: dict[int, str] = {}
    for c in cells:
        names.setdefault(c.column, c.alias or c.name)
    scope = scope_of(rows)
    data = rows.where(F.col("row") > header_row)
    cols = [F.try_element_at("vals", F.lit(i + 1)).alias(n) for i, n in sorted(names.items())]
    return data.select(*cols, *_lineage(scope))


def _trim(names: list) -> list:
    """Header cells after the last named one are padding, not columns."""
    while names and (names[-1] is None or str(names[-1]).strip() == ""):
        names = names[:-1]
    return names


def _lineage(scope) -> list[Column]:
    cols = [F.col(c) for c in scope if c != SHEET]
    if SHEET in scope:
        cols.append(F.col(SHEET))
    # one order shape for every scan (sheet null for delimited text), so scans stack
    order = [F.col(KEY if KEY in scope else FILE).alias("f"),
             (F.col(SHEET) if SHEET in scope else F.lit(None).cast("string")).alias("s"),
             F.col("row").cast("long").alias("i")]
    cols.append(F.struct(*order).alias(ORD))
    return cols


def infer_types(df: DataFrame, exclude=(), stats: DataFrame | None = None) -> DataFrame:
    """Number-like text columns become doubles (longs when every value is whole); one grouped pass, or none with ``stats``
    (file, column, cells, numbers, whole: how many cells of it are there, are numbers, are whole).

    Types are those of each file: a column is a number in a file that has values there which all parse (the strict
    shape of ``to_num``). Where every file with values agrees, the column is cast. Where files differ it stays text, and
    the lineage column ``__numeric`` names the columns that are numbers in the row's file, for sums. ``exclude`` names columns to
    leave as text (declared types).
    """
    from pyspark.sql.types import StringType
    cols = [c for c in df.columns if c not in (FILE, SHEET, ORD, LAYOUT, KEY) and c not in set(exclude)
            and isinstance(df.schema[c].dataType, StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = to_num(qc(c))
        aggs += [F.count(qc(c)).alias(f"n{i}"), F.count(x).alias(f"x{i}"),
                 F.sum((x == F.floor(x)).cast("long")).alias(f"w{i}")]
    keys = file_keys(df)
    if stats is not None:
        of = lambda c, what: F.coalesce(F.max(F.when(F.col("column") == c, F.col(what))), F.lit(0))
        aggs = [of(c, what).alias(f"{short}{i}") for i, c in enumerate(cols) for what, short in (("cells", "n"), ("numbers", "x"), ("whole", "w"))]
    stats = _kept((df if stats is None else stats).groupBy(*keys).agg(*aggs), "types")   # joined below: its size is known
    number = [(F.col(f"n{i}") > 0) & (F.col(f"n{i}") == F.col(f"x{i}")) for i in range(len(cols))]
    some = stats.agg(*[F.max(number[i]).alias(f"any{i}") for i in range(len(cols))],
                     *[F.min(number[i] | (F.col(f"n{i}") == 0)).alias(f"all{i}") for i in range(len(cols))],
                     *[F.min(F.coalesce(F.col(f"w{i}"), F.lit(0)) == F.col(f"x{i}")).alias(f"whole{i}") for i in range(len(cols))]).first()
    casts, mixed = {}, []
    for i, c in enumerate(cols):
        if some[f"any{i}"] and some[f"all{i}"]:
            casts[c] = to_num(qc(c)).try_cast("long") if some[f"whole{i}"] else to_num(qc(c))
        elif some[f"any{i}"]:
            mixed.append(i)
    if mixed:
        own = F.filter(F.array(*[F.when(number[i], F.lit(cols[i])) for i in mixed]), lambda c: c.isNotNull())
        df = df.join(stats.select(*keys, own.alias(NUMERIC, metadata={"columns": [cols[i] for i in mixed]})), keys, "left")
    return df.withColumns(casts) if casts else df
