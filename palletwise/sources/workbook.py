"""Executor-side reader for the first sheet of an .xlsx workbook.

Spark has no workbook source, so each workbook (one row of a ``binaryFile``
scan) is parsed inside a ``mapInPandas`` task with the standard library
(zip + streaming XML).  Output is one row per sheet row with the cell
values as text; row 0 is the header.  A file that cannot be parsed yields a
single row with ``row_idx = -1`` and the error.

Cell handling: shared and inline strings, booleans (``True``/``False``),
numbers as written in the file (integral values without ``.0``), formulas by
their cached value.  Numbers whose cell style is a date format become
``YYYY-MM-DD HH:MM:SS`` text, time-only formats ``HH:MM:SS`` (1900 date
system; the 1904 system is honoured when the workbook declares it).
"""

from __future__ import annotations

import datetime as _dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import types as T

CELLS_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_REF = re.compile(r"([A-Z]+)(\d+)")


def _ns(root) -> str:
    """Namespace prefix of an element's tag (transitional and strict OOXML
    use different namespace URIs; matching follows the document's own)."""
    return root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""


def _is(tag: str, name: str) -> bool:
    return tag == name or tag.endswith("}" + name)


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _number_text(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    if f.is_integer() and abs(f) < 1e16 and "e" not in v.lower():
        return str(int(f))
    return v


# Built-in number-format ids that display dates / times.
_BUILTIN_DATE_IDS = set(range(14, 18)) | {22} | set(range(27, 37)) | set(range(50, 59))
_BUILTIN_TIME_IDS = set(range(18, 22)) | {45, 46, 47}
_QUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


def _format_kind(code: str) -> str | None:
    """'date', 'time' or None for a custom number-format code."""
    c = _QUOTED.sub("", code).lower()
    if "general" in c:
        return None
    if "y" in c or "d" in c:
        return "date"
    if "h" in c or "s" in c:
        return "time"
    if "m" in c and "0" not in c and "#" not in c:
        return "date"
    return None


def _style_kinds(z: zipfile.ZipFile) -> list[str | None]:
    """Per cell-style index: 'date', 'time' or None."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.parse(z.open("xl/styles.xml")).getroot()
    ns = _ns(root)
    custom = {}
    fmts = root.find(ns + "numFmts")
    if fmts is not None:
        for f in fmts.findall(ns + "numFmt"):
            custom[int(f.get("numFmtId"))] = _format_kind(f.get("formatCode", ""))
    kinds = []
    xfs = root.find(ns + "cellXfs")
    for xf in (xfs.findall(ns + "xf") if xfs is not None else []):
        fid = int(xf.get("numFmtId", "0"))
        if fid in custom:
            kinds.append(custom[fid])
        elif fid in _BUILTIN_DATE_IDS:
            kinds.append("date")
        elif fid in _BUILTIN_TIME_IDS:
            kinds.append("time")
        else:
            kinds.append(None)
    return kinds


def _serial_text(v: str, kind: str, epoch: _dt.datetime) -> str:
    try:
        serial = float(v)
    except ValueError:
        return v
    ts = epoch + _dt.timedelta(days=serial)
    ts = (ts + _dt.timedelta(microseconds=500_000)).replace(microsecond=0)  # nearest second
    return ts.strftime("%H:%M:%S") if kind == "time" else ts.strftime("%Y-%m-%d %H:%M:%S")


def _epoch(z: zipfile.ZipFile) -> _dt.datetime:
    wb = ET.parse(z.open("xl/workbook.xml")).getroot()
    pr = wb.find(_ns(wb) + "workbookPr")
    if pr is not None and pr.get("date1904") in ("1", "true"):
        return _dt.datetime(1904, 1, 1)
    return _dt.datetime(1899, 12, 30)


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.parse(z.open("xl/workbook.xml")).getroot()
    sheets = wb.find(_ns(wb) + "sheets")
    if sheets is None or len(sheets) == 0:
        raise ValueError("workbook has no sheet")
    rid = next((v for k, v in sheets[0].attrib.items() if k.endswith("}id")), None)
    rels = ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()
    for r in rels.iter(_ns(rels) + "Relationship"):
        if r.get("Id") == rid:
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("first sheet not found")


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    for _, el in ET.iterparse(z.open("xl/sharedStrings.xml")):
        if _is(el.tag, "si"):
            ns = el.tag[: len(el.tag) - 2]
            # plain text and rich-text runs; phonetic hints are not content
            parts = [t.text or "" for t in el.iter(ns + "t")]
            for rph in el.findall(ns + "rPh"):
                for t in rph.iter(ns + "t"):
                    if t.text and parts and t.text in parts:
                        parts.remove(t.text)
            out.append("".join(parts))
            el.clear()
    return out


class _SheetTarget:
    """XML parser target for a worksheet: collects finished rows as lists of
    cell texts without building an element tree."""

    def __init__(self, shared, kinds, epoch):
        self._ROW = self._C = self._V = self._T = None  # set from the root's namespace
        self.shared, self.kinds, self.epoch = shared, kinds, epoch
        self.done: list[dict] = []
        self.cells: dict | None = None
        self.kind = self.ref = self.style = None
        self.value: list[str] | None = None
        self.inline: list[str] | None = None
        self.capture = False
        self.position = 0

    def start(self, tag, attrib):
        if self._ROW is None:  # the worksheet root: adopt its namespace
            ns = tag[: tag.index("}") + 1] if tag.startswith("{") else ""
            self._ROW, self._C, self._V, self._T = ns + "row", ns + "c", ns + "v", ns + "t"
        if tag == self._C:
            self.ref, self.kind, self.style = attrib.get("r"), attrib.get("t", "n"), attrib.get("s")
            self.value, self.inline = None, ([] if attrib.get("t") == "inlineStr" else None)
        elif tag == self._V:
            self.value, self.capture = [], True
        elif tag == self._T and self.inline is not None:
            self.capture = True
        elif tag == self._ROW:
            self.cells, self.position = {}, 0

    def data(self, text):
        if self.capture:
            (self.value if self.value is not None and self.inline is None else self.inline).append(text)

    def end(self, tag):
        if tag in (self._V, self._T):
            self.capture = False
        elif tag == self._C:
            m = _REF.match(self.ref) if self.ref else None
            idx = _col_index(m.group(1)) if m else (max(self.cells) + 1 if self.cells else self.position)
            self.position += 1
            self.cells[idx] = self._cell_text()
        elif tag == self._ROW:
            self.done.append(self.cells)
            self.cells = None

    def _cell_text(self):
        t = self.kind
        v = "".join(self.value) if self.value is not None else None
        if t == "inlineStr":
            return "".join(self.inline or [])
        if v is None or t == "e":
            return None
        if t == "s":
            return self.shared[int(v)]
        if t == "b":
            return "True" if v == "1" else "False"
        if t == "str":
            return v
        style = int(self.style) if self.style else 0
        kind = self.kinds[style] if style < len(self.kinds) else None
        return _serial_text(v, kind, self.epoch) if kind else _number_text(v)

    def close(self):
        return None


def iter_rows(data, chunk: int = 1 << 20):
    """``data``: the workbook's bytes or a seekable binary file.  Yields lists of cell texts (None for empty cells), header first."""
    z = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
    shared = _shared_strings(z)
    target = _SheetTarget(shared, _style_kinds(z), _epoch(z))
    parser = ET.XMLParser(target=target)
    width = None
    with z.open(_first_sheet_path(z)) as fh:
        while True:
            block = fh.read(chunk)
            if block:
                parser.feed(block)
            else:
                parser.close()
            for cells in target.done:
                if not cells or all(x is None or x == "" for x in cells.values()):
                    continue  # blank rows are skipped, as a tabular reader does
                if width is None:
                    width = max(cells) + 1
                yield [cells.get(i) for i in range(width)]
            target.done.clear()
            if not block:
                break


CHUNK_ROWS = 20_000


def parse_workbooks(batches):
    """``mapInPandas`` body: (path, content) -> CELLS_SCHEMA rows, emitted in
    chunks so a large sheet never sits in one pandas frame.  A workbook
    without content is opened by its path."""
    import pandas as pd

    from palletwise.sources.files import open_input

    def frame(paths, idxs, vals, errs):
        return pd.DataFrame({"path": paths, "row_idx": idxs, "values": vals, "error": errs})

    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            n = 0
            buf: list = []
            try:
                for r in iter_rows(open_input(path) if content is None else bytes(content)):
                    buf.append(r)
                    n += 1
                    if len(buf) >= CHUNK_ROWS:
                        yield frame([path] * len(buf), list(range(n - len(buf), n)), buf, [None] * len(buf))
                        buf = []
                if n == 0:
                    raise ValueError("empty workbook")
                if buf:
                    yield frame([path] * len(buf), list(range(n - len(buf), n)), buf, [None] * len(buf))
            except Exception as e:  # isolate the bad file
                yield frame([path], [-1], [None], [f"{type(e).__name__}: {e}"])


def write_xlsx(path, rows) -> None:
    """Minimal single-sheet workbook writer (inline strings), used by tests
    and examples to produce inputs without an external library.  ``path`` is
    a local path or a writable binary file object; ``rows`` (any iterable of
    lists) are written one by one, so they are never held together."""

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, _dt.datetime):
            serial = (v - _dt.datetime(1899, 12, 30)).total_seconds() / 86400
            return f'<c r="{ref}" s="1"><v>{serial}</v></c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        s = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{s}</t></is></c>'

    def letters(i):
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    names: list[str] = []

    def row_text(ri, r):
        while len(names) < len(r):
            names.append(letters(len(names)))
        return f'<row r="{ri + 1}">' + "".join(cell(f"{names[ci]}{ri + 1}", v) for ci, v in enumerate(r)) + "</row>"

    begin = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
             f'<worksheet xmlns="{_NS[1:-1]}"><sheetData>')
    workbook = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                f'<workbook xmlns="{_NS[1:-1]}" xmlns:r="{_REL[1:-1]}">'
                '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            f'<Relationships xmlns="{_PKG_REL[1:-1]}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" '
            'Target="worksheets/sheet1.xml"/></Relationships>')
    styles = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
              f'<styleSheet xmlns="{_NS[1:-1]}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm"/>'
              '</numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/workbook.xml", workbook)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(begin.encode())
            for ri, r in enumerate(rows):
                sheet.write(row_text(ri, r).encode())
            sheet.write(b"</sheetData></worksheet>")
