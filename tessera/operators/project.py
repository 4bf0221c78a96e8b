"""Column selection and renaming."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import PROVIDER_FIELD, JobSpec
from .lineage import FILE, LAYOUT, LINEAGE, qc


def _keep_lineage(df: DataFrame) -> list[str]:
    return [c for c in LINEAGE if c in df.columns]


def _only(names: Column, present: list[str]) -> Column:
    return F.array_intersect(names, F.array(*[F.lit(c) for c in present]) if present else F.array().cast("array<string>"))


def _renamed(names: Column, renames: dict) -> Column:
    m = F.create_map(*[x for k, v in renames.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(names, lambda x: F.coalesce(F.try_element_at(m, x), x))


def layout_names(names: Column, spec: JobSpec, columns: list[str]) -> Column:
    """The layout column that P1 then P2 leave of a file's own ``names`` in a frame of ``columns``."""
    if spec.columns:
        columns = [c for c in dict.fromkeys(spec.columns) if c in columns]
        names = _only(names, columns)
    renames = {k: v for k, v in spec.column_mappings.items() if k in columns and k != v}
    return _renamed(names, renames) if renames else names


def select_present(df: DataFrame, columns, layout: bool = True) -> DataFrame:
    """The listed columns that exist, in list order (lineage kept). ``layout``: the layout column follows."""
    present = [c for c in dict.fromkeys(columns) if c in df.columns]
    out = df.select(*[qc(c) for c in present], *[c for c in _keep_lineage(df) if c not in present])
    return out.withColumn(LAYOUT, _only(F.col(LAYOUT), present)) if layout and LAYOUT in out.columns else out


def rename(df: DataFrame, mapping: dict, layout: bool = True) -> DataFrame:
    """Rename by mapping; unmapped columns keep their name. ``layout``: the layout column follows."""
    renames = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    out = df.withColumnsRenamed(renames)
    return out.withColumn(LAYOUT, _renamed(F.col(LAYOUT), renames)) if layout and LAYOUT in out.columns and renames else out


def positional_select(df: DataFrame, spec: JobSpec, raw_columns: list[str] | None = None) -> DataFrame:
    """Header cells pick columns by their 0-based ``column`` index.

    Target name = alias, else mapping of the header text, else the header text. ``raw_columns``
    are the frame's positional columns (default: all data columns in order).
    """
    cols = raw_columns or [c for c in df.columns if c not in LINEAGE]
    picked: list[Column] = []
    for cell in spec.headers:
        if cell.column >= len(cols):
            continue
        target = cell.alias or spec.column_mappings.get(cell.name, cell.name)
        picked.append(qc(cols[cell.column]).alias(target))
    return df.select(*picked, *_keep_lineage(df))


def filter_and_rename(df: DataFrame, spec: JobSpec, raw_columns: list[str] | None = None, layout: bool = True) -> DataFrame:
    """Selection + rename of a scanned frame as the spec says (P3, else P1 then P2). ``layout``: the layout column follows (not where the scan
    told it by ``layout_names``)."""
    if spec.headers:
        return positional_select(df, spec, raw_columns)
    if spec.columns:
        df = select_present(df, spec.columns, layout)
    if spec.column_mappings:
        df = rename(df, spec.column_mappings, layout)
    return df


def replace_headers(df: DataFrame, headers: list[str]) -> DataFrame:
    """Replace data column names by a list; pad with old names, or truncate."""
    if not headers:
        return df
    data = [c for c in df.columns if c not in LINEAGE]
    names = list(headers)[: len(data)] + data[len(headers):]
    return df.select(*[qc(old).alias(new) for old, new in zip(data, names)], *_keep_lineage(df))


def common_columns(frames: dict, order_from: str | None = None) -> tuple[list[str], dict]:
    """Columns shared by all frames, in the first frame's order; per frame ``+n / -m``.

    ``frames`` maps a label (sheet or file) to a DataFrame; only schemas are read.
    """
    labels = list(frames)
    if not labels:
        return [], {}
    first = order_from or labels[0]
    sets = {k: [c for c in v.columns if c not in LINEAGE] for k, v in frames.items()}
    shared = [c for c in sets[first] if all(c in s for s in sets.values())]
    report = {k: {"added": len([c for c in s if c not in shared]),
                  "removed": len([c for c in shared if c not in s])} for k, s in sets.items()}
    return shared, report


def align_to(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select ``columns``; absent ones become null text (P7 alignment)."""
    return df.select(*[qc(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in columns], *_keep_lineage(df))


_MAP_LINE = re.compile(r"^\s*(.+?)\s*(?:->|:)\s*(.+?)\s*$")


def parse_header_map_text(text: str) -> dict:
    """P8 (spec text): ``src -> dst`` or ``src: dst`` lines, ``#`` comments, blanks skipped."""
    out: dict = {}
    for line in (text or "").splitlines():
        line = line.split("#", 1)[0]
        m = _MAP_LINE.match(line)
        if m:
            out[m.group(1)] = m.group(2)
    return out


def header_map_rows(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """P8 over a text source: one ``(source, target)`` row per mapping line, in Spark."""
    body = F.trim(F.regexp_replace(F.col(text_col), "#.*$", ""))
    pattern = r"^(.+?)\s*(?:->|:)\s*(.+?)$"
    return (lines.select(body.alias("line"))
            .where(F.col("line").rlike(pattern))
            .select(F.trim(F.regexp_extract("line", pattern, 1)).alias("source"),
                    F.trim(F.regexp_extract("line", pattern, 2)).alias("target")))


def apply_header_map(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename with a header map whose source side is matched case-blind."""
    lower = {k.lower(): v for k, v in mapping.items()}
    renames = {c: lower[c.lower()] for c in df.columns if c.lower() in lower}
    return df.withColumnsRenamed(renames)


def stamp_provider(df: DataFrame, spec: JobSpec) -> DataFrame:
    """``provider_id`` = provider name, else the source file; always overwrites."""
    if spec.provider_name:
        value = F.lit(spec.provider_name)
    elif FILE in df.columns:
        value = F.col(FILE)
    else:
        value = F.lit(spec.source_file).cast("string")
    return df.withColumn(PROVIDER_FIELD, value)


def project(df: DataFrame, columns) -> DataFrame:
    """P10: chosen columns in the given order; none chosen means all."""
    cols = [c for c in (columns or []) if c in df.columns]
    return df.select(*[qc(c) for c in cols]) if cols else df
