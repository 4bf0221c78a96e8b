"""Minimal xlsx writer for test fixtures (stdlib only)."""

import zipfile
from xml.sax.saxutils import escape


def _letters(i):
    i += 1
    s = ""
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref, v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    if isinstance(v, tuple) and v[0] == "date":          # ("date", serial)
        return f'<c r="{ref}" s="1"><v>{v[1]}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def write_xlsx(path, sheets, merges=None):
    """``sheets``: {name: {(row, col): value}} (0-based); ``merges``: {name: ["A1:C1", ...]}."""
    merges = merges or {}
    names = list(sheets)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        sheets_xml = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml",
                   '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f"<sheets>{sheets_xml}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   f"{rels}</Relationships>")
        z.writestr("xl/styles.xml",
                   '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                   '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, n in enumerate(names):
            cells = sheets[n]
            rows = {}
            for (r, c), v in cells.items():
                rows.setdefault(r, []).append((c, v))
            body = ""
            for r in sorted(rows):
                cs = "".join(_cell(f"{_letters(c)}{r + 1}", v) for c, v in sorted(rows[r]))
                body += f'<row r="{r + 1}">{cs}</row>'
            mc = ""
            if merges.get(n):
                mc = f'<mergeCells count="{len(merges[n])}">' + "".join(
                    f'<mergeCell ref="{m}"/>' for m in merges[n]) + "</mergeCells>"
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                       '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                       f"<sheetData>{body}</sheetData>{mc}</worksheet>")


def grid(header, rows, start=0):
    out = {}
    for c, h in enumerate(header):
        out[(start, c)] = h
    for i, row in enumerate(rows):
        for c, v in enumerate(row):
            out[(start + 1 + i, c)] = v
    return out


def write_samples(root):
    """The sample workbooks of the reference's golden header test, with our own values."""
    orders_hdr = ["order_id", "region", "product", "quantity", "unit_price"]
    write_xlsx(root / "multi_sheet_jan.xlsx", {
        "Orders": grid(orders_hdr, [[101, "North", "Widget", 7, 12.0], [102, "West", "Gadget", 4, 19.5]]),
        "Adjustments": grid(["order_id", "adjustment", "amount"], [[101, "Discount", -5.0], [102, "Rush", 12.0]]),
    })
    write_xlsx(root / "consistent_schema_feb.xlsx", {
        "Orders": grid(orders_hdr, [[201, "North", "Widget", 6, 12.0], [202, "West", "Gadget", 5, 19.5]])})
    off = grid(["department", "owner", "active", "budget"],
               [["Finance", "L. S.", True, 125000], ["Marketing", "C. W.", True, 98000]], start=3)
    off[(0, 0)] = "Department roster export"
    off[(1, 0)] = "Headers start on row 4"
    write_xlsx(root / "offset_header.xlsx", {"Departments": off})
    merged = grid(["Jan", "Feb", "Mar"], [[10, 12, 8], [14, 7, 9]], start=1)
    merged[(0, 0)] = "2020"
    write_xlsx(root / "merged_header.xlsx", {"Sales": merged}, {"Sales": ["A1:C1"]})
    split = grid(["SKU", "2020", "2021"], [["A1", 10, 12], ["B2", 14, 7]], start=2)
    split.update({(0, 0): "SKU", (0, 1): "2020", (0, 2): "2021", (1, 1): "tammikuu", (1, 2): "helmikuu"})
    write_xlsx(root / "split_year_month.xlsx", {"Split": split})
