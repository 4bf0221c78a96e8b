"""Spreadsheet workbooks as row tables.

Spark has no workbook reader, so files come in through ``binaryFile`` and one Arrow-batched
``mapInArrow`` task decodes each file (stdlib ``zipfile`` + ``ElementTree``; an xlsx is a zip of
XML parts). The decoded table holds worksheet rows, merged ranges, the sheet list and decode
errors; it is checkpointed once into the shared checkpoint folder, so header discovery and data
selection read it without decoding again.
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

from ..operators.lineage import FILE, KEY, SHEET, file_keys, qc
from ..spec import JobSpec
from .rows import apply_header, drop_skipped, header_row_guess_rows

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# Built-in number formats that are dates (format ids of the file format).
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}

DECODED = ("rtype string, source_file string, path string, sheet string, sheet_pos int, row long, "
           "vals array<string>, kinds array<string>, r0 int, c0 int, r1 int, c1 int, message string")

_REF = re.compile(r"([A-Z]+)(\d+)")


def col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def col_letters(index: int) -> str:
    index += 1
    out = ""
    while index:
        index, rem = divmod(index - 1, 26)
        out = chr(65 + rem) + out
    return out


def _is_date_code(code: str) -> bool:
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "").lower()
    return bool(re.search(r"[dy]|m{1,4}(?![a-z])|h|s", code)) and "general" not in code


def _date_styles(z: zipfile.ZipFile) -> set:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): n.get("formatCode") for n in root.iter(f"{_M}numFmt")}
    xfs = root.find(f"{_M}cellXfs")
    out = set()
    for i, xf in enumerate(xfs if xfs is not None else []):
        fid = int(xf.get("numFmtId", 0))
        if fid in DATE_FORMAT_IDS or (fid in custom and _is_date_code(custom[fid])):
            out.add(i)
    return out


def _serial_to_text(serial: float, date1904: bool) -> str:
    base = _dt.datetime(1904, 1, 1) if date1904 else _dt.datetime(1899, 12, 30)
    value = base + _dt.timedelta(days=serial)
    return value.replace(microsecond=0).isoformat(sep=" ")


def _number_text(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f.is_integer() and "e" not in v.lower() and "." not in v else v


def decode_workbook(content: bytes, name: str, path: str):
    """Yield decoded records of one xlsx file (see ``DECODED``)."""
    blank = dict(sheet=None, sheet_pos=None, row=None, vals=None, kinds=None, r0=None, c0=None, r1=None,
                 c1=None, message=None)
    if content[:2] != b"PK":
        yield {**blank, "rtype": "not_zip", "source_file": name, "path": path,
               "message": "not a zip container; read as delimited text"}
        return
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target") for r in rels.iter(f"{_P}Relationship")}
        pr = wb.find(f"{_M}workbookPr")
        date1904 = pr is not None and pr.get("date1904") in ("1", "true")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_M}t")))
        dates = _date_styles(z)
        sheets = wb.find(f"{_M}sheets")
        for pos, sh in enumerate(sheets if sheets is not None else []):
            sname = sh.get("name")
            target = targets.get(sh.get(f"{_R}id"), "")
            part = target.lstrip("/") if target.startswith("/") else "xl/" + target
            yield {**blank, "rtype": "sheet", "source_file": name, "path": path, "sheet": sname, "sheet_pos": pos}
            root = ET.fromstring(z.read(part))
            data = root.find(f"{_M}sheetData")
            for r in (data if data is not None else []):
                cells: dict[int, tuple] = {}
                for c in r.iter(f"{_M}c"):
                    m = _REF.match(c.get("r", ""))
                    ci = col_index(m.group(1)) if m else (max(cells) + 1 if cells else 0)
                    t = c.get("t", "n")
                    v = c.find(f"{_M}v")
                    text = v.text if v is not None else None
                    if t == "s" and text is not None:
                        val, kind = shared[int(text)], "text"
                    elif t == "inlineStr":
                        val, kind = "".join(x.text or "" for x in c.iter(f"{_M}t")), "text"
                    elif t in ("str", "e"):
                        val, kind = text, "text"
                    elif t == "b":
                        val, kind = ("True" if text == "1" else "False") if text is not None else None, "bool"
                    elif t == "d":
                        val, kind = text, "date"
                    elif text is None:
                        val, kind = None, None
                    elif int(c.get("s", 0)) in dates:
                        val, kind = _serial_to_text(float(text), date1904), "date"
                    else:
                        val, kind = _number_text(text), "number"
                    if val is not None:
                        cells[ci] = (val, kind)
                if not cells:
                    continue
                width = max(cells) + 1
                rnum = int(r.get("r")) - 1 if r.get("r") else None
                yield {**blank, "rtype": "row", "source_file": name, "path": path, "sheet": sname,
                       "sheet_pos": pos, "row": rnum,
                       "vals": [cells.get(i, (None, None))[0] for i in range(width)],
                       "kinds": [cells.get(i, (None, None))[1] for i in range(width)]}
            merged = root.find(f"{_M}mergeCells")
            for mc in (merged if merged is not None else []):
                a, _, b = mc.get("ref", "").partition(":")
                ma, mb = _REF.match(a), _REF.match(b or a)
                if ma and mb:
                    yield {**blank, "rtype": "merge", "source_file": name, "path": path, "sheet": sname,
                           "sheet_pos": pos, "r0": int(ma.group(2)) - 1, "c0": col_index(ma.group(1)),
                           "r1": int(mb.group(2)) - 1, "c1": col_index(mb.group(1))}
    except Exception as exc:  # corrupt file: an error record, never a failed job
        yield {**blank, "rtype": "error", "source_file": name, "path": path, "message": f"{type(exc).__name__}: {exc}"}


ARROW_DECODED = pa.schema([
    ("rtype", pa.string()), ("source_file", pa.string()), ("path", pa.string()), ("sheet", pa.string()),
    ("sheet_pos", pa.int32()), ("row", pa.int64()), ("vals", pa.list_(pa.string())),
    ("kinds", pa.list_(pa.string())), ("r0", pa.int32()), ("c0", pa.int32()), ("r1", pa.int32()),
    ("c1", pa.int32()), ("message", pa.string()),
])


def _decode_batches(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            recs = []
            for rec in decode_workbook(content or b"", path.rsplit("/", 1)[-1], path):
                recs.append(rec)
                if len(recs) >= 4096:
                    yield pa.RecordBatch.from_pylist(recs, schema=ARROW_DECODED)
                    recs = []
            if recs:
                yield pa.RecordBatch.from_pylist(recs, schema=ARROW_DECODED)


def decode(spark: SparkSession, paths, checkpoint: bool = True) -> DataFrame:
    """Decode every workbook once; the result is checkpointed (shared folder) for reuse."""
    from pyspark.sql.types import _parse_datatype_string
    paths = [paths] if isinstance(paths, str) else list(paths)
    # decoded in the scan task: file contents are never shuffled; Spark packs small files into
    # one split and gives a large file a task of its own
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "content")
    out = files.mapInArrow(_decode_batches, _parse_datatype_string(DECODED))
    return checkpointed(out) if checkpoint else out


def _letters_expr(c):
    """Column letters of a 0-based index (A..XFD) as a Spark expression."""
    return _letters_of(c + 1)


def _letters_of(v):
    one = F.char(65 + F.pmod(v - 1, F.lit(26)))
    q = F.floor((v - 1) / 26)
    two = F.char(65 + F.pmod(q - 1, F.lit(26)))
    three = F.char(64 + F.floor((q - 1) / 26))
    return (F.when(v <= 26, one)
             .when(v <= 702, F.concat(two, one))
             .otherwise(F.concat(three, two, one)))


def sheet_list(decoded: DataFrame) -> DataFrame:
    """``(source_file, sheet, position)``; a file that cannot be decoded lists no sheet."""
    return decoded.where("rtype = 'sheet'").select(FILE, "path", "sheet", F.col("sheet_pos").alias("position"))


def decode_errors(decoded: DataFrame) -> DataFrame:
    return decoded.where("rtype IN ('error', 'not_zip')").select(FILE, "path", "rtype", "message")


def sheet_rows(decoded: DataFrame, spec: JobSpec) -> DataFrame:
    """Row table of the sheets the spec names (all listed sheets, the single sheet, else the
    first); ``source_sheet`` carries the sheet as written in the spec."""
    rows = decoded.where("rtype = 'row'").withColumn(KEY, F.col("path"))
    wanted = list(spec.sheets) if spec.combine_sheets and spec.sheets else \
        ([spec.sheet] if spec.sheet is not None else [0])
    label = F.lit(None).cast("string")
    for s in reversed(wanted):
        chosen = F.col("sheet_pos") == s if isinstance(s, int) else F.col("sheet") == s
        if isinstance(s, str) and s.isdigit():      # a position, unless the file has a sheet of that name
            named = decoded.where((F.col("rtype") == "sheet") & (F.col("sheet") == s)).select(F.col("path").alias(KEY), F.lit(True).alias("__named"))
            rows = rows.drop("__named").join(named.distinct(), KEY, "left")
            chosen = chosen | (F.col("__named").isNull() & (F.col("sheet_pos") == int(s)))
        rows = rows.withColumn("__chosen", F.when(chosen, F.lit(str(s))).otherwise(F.col("__chosen") if "__chosen" in rows.columns else label))
    return rows.where(F.col("__chosen").isNotNull()).select(FILE, KEY, F.col("__chosen").alias(SHEET), "row", "vals", "kinds")


def merged_header_names(decoded: DataFrame, rows: DataFrame, header_rows: DataFrame, spec: JobSpec) -> DataFrame:
    """P5: header names with merged ranges expanded over their span.

    A merged range covering the header row puts its top-left value on every column it spans; an
    empty one becomes ``merged_<A1>`` (``_<column>`` added when it spans several columns).
    ``header_rows`` is in worksheet coordinates. Returns ``(source_file, source_sheet, names)``.
    """
    merges = decoded.where("rtype = 'merge'").select(FILE, F.col("path").alias(KEY), F.col("sheet").alias("__sheet_name"), "r0", "c0",
                                                     "r1", "c1")
    sheet_names = rows.select(FILE, KEY, SHEET).distinct()
    # the row table keys sheets by spec label; merges by name or position
    sheets = decoded.where("rtype = 'sheet'").select(FILE, F.col("path").alias(KEY), F.col("sheet").alias("__sheet_name"), "sheet_pos")
    keyed = sheet_names.join(sheets, [FILE, KEY]).where(
        (F.col(SHEET) == F.col("__sheet_name")) | (F.col(SHEET) == F.col("sheet_pos").cast("string")))
    hm = (merges.join(keyed.select(FILE, KEY, SHEET, "__sheet_name"), [FILE, KEY, "__sheet_name"])
          .join(header_rows, [FILE, KEY, SHEET])
          .where((F.col("r0") <= F.col("header_row")) & (F.col("header_row") <= F.col("r1"))))
    top = rows.select(FILE, KEY, SHEET, F.col("row").alias("r0"), F.col("vals").alias("__top"))
    hm = hm.join(top, [FILE, KEY, SHEET, "r0"], "left")
    base = F.try_element_at("__top", F.col("c0") + 1)
    letters = _letters_expr
    place = F.concat(F.lit("merged_"), letters(F.col("c0")), (F.col("r0") + 1).cast("string"))
    spans = hm.select(FILE, KEY, SHEET, "c0", "c1", base.alias("base"), place.alias("place"),
                      F.explode(F.sequence("c0", "c1")).alias("col"))
    named = spans.select(FILE, KEY, SHEET, "col", F.when(F.coalesce(F.col("base"), F.lit("")) != "", F.col("base"))
                         .when(F.col("c1") > F.col("c0"), F.concat("place", F.lit("_"), letters(F.col("col"))))
                         .otherwise(F.col("place")).alias("name"))
    head = rows.join(header_rows, [FILE, KEY, SHEET]).where(F.col("row") == F.col("header_row")) \
               .select(FILE, KEY, SHEET, F.col("vals").alias("names"))
    repl = named.groupBy(FILE, KEY, SHEET).agg(F.map_from_entries(F.collect_list(F.struct("col", "name"))).alias("m"),
                                          F.max("col").alias("mx"))
    out = repl.join(head, [FILE, KEY, SHEET], "left").select(
        FILE, KEY, SHEET,
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("mx"), F.coalesce(F.size("names") - 1, F.lit(-1)))),
                    lambda i: F.coalesce(F.try_element_at("m", i),
                                         F.try_element_at(F.coalesce("names", F.array().cast("array<string>")),
                                                          i + 1),
                                         F.lit(""))).alias("names"))
    return out


def read_workbooks(spark: SparkSession, paths, spec: JobSpec, guess_header: bool = False,
                   decoded: DataFrame | None = None) -> DataFrame:
    """S2 + S3 + S4 + P5: the sheets of many workbooks as one frame, selected and renamed."""
    from ..operators.project import filter_and_rename
    decoded = decoded if decoded is not None else decode(spark, paths)
    sheet = sheet_rows(decoded, spec)
    rows = drop_skipped(sheet, spec.skiprows)         # row numbers below count without the skipped ones
    found = header_row_guess_rows(rows) if guess_header else \
        rows.select(*file_keys(rows), SHEET).distinct().withColumn("header_row", F.lit(spec.header_row))
    place = F.col("header_row")
    for s in sorted({int(x) for x in spec.skiprows}):  # merged ranges are in worksheet coordinates
        place = F.when(place >= s, place + 1).otherwise(place)
    override = merged_header_names(decoded, sheet, found.withColumn("header_row", place), spec)
    frame, _ = apply_header(rows, spec, found if guess_header else None, header_override=override)
    frame = drop_null_columns(frame)                                  # S4 (rows: empty rows absent)
    frame = frame if spec.headers else filter_and_rename(frame, spec)
    if not spec.combine_sheets:
        frame = frame.drop(SHEET)
    return frame


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Columns without any value leave the frame (one aggregate pass)."""
    from ..operators.lineage import LINEAGE
    cols = [c for c in df.columns if c not in LINEAGE and c != SHEET]
    if not cols:
        return df
    counts = df.agg(*[F.count(qc(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    dead = [c for i, c in enumerate(cols) if counts[f"n{i}"] == 0]
    return df.drop(*dead) if dead else df
