"""Workbooks: .xlsx by the archive and XML readers of Python, .xls by a library that may be missing.

A workbook is read and written on the driver: its format holds a million rows
at most, which are counted before they are fetched.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal
import io
import re
from xml.etree import ElementTree
from xml.sax.saxutils import escape
import zipfile

from pyspark.sql import DataFrame, SparkSession

from scrubjay.sources import store
from scrubjay.sources.csv import frame_of

MOST_ROWS = 1_048_575
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_DAY_ZERO = datetime(1899, 12, 30)
# Built-in number formats that show a date or a time.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def guard_xlsx(data: bytes) -> None:
    """Raise for files that are damaged, encrypted or carry macros."""
    try:
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    except zipfile.BadZipFile as e:
        raise ValueError("a damaged workbook") from e
    if any("vbaproject" in n.lower() for n in names):
        raise ValueError("a workbook with macros")
    if not any(n.startswith("xl/") for n in names):
        raise ValueError("not a workbook")


def guard_xls(data: bytes) -> None:
    """Raise for old workbooks with macros or encryption, by the names of their streams."""
    upper = data.upper()
    for name, what in (("_VBA_PROJECT", "macros"), ("VBA", "macros"), ("EncryptedPackage", "encryption")):
        if name.upper().encode("utf-16-le") in upper:
            raise ValueError(f"a workbook with {what}")


# --- reading -----------------------------------------------------------------


def _sheet_paths(book: zipfile.ZipFile) -> dict[str, str]:
    """Part of each sheet by its name, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    at = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return {s.get("name"): at(links[s.get(f"{_REL}id")]) for s in sheets}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", plain(f.get("formatCode", "")))}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in own | _DATE_FORMATS}


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item; hints of pronunciation left out."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> object:
    kind, inline, v = cell.get("t", "n"), cell.find(f"{_MAIN}is"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _texts(inline) if inline is not None else None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    if int(cell.get("s", -1)) in dates:
        return _DAY_ZERO + timedelta(days=number)
    return int(number) if number.is_integer() and not re.search("[.eE]", v.text) else number


def sheets_xlsx(data: bytes) -> dict[str, list[list]]:
    """The rows of each sheet: values only, formulas by the result that is stored."""
    guard_xlsx(data)
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    dates, out = _date_styles(book), {}
    for name, path in _sheet_paths(book).items():
        rows: list[list] = []
        for row in ElementTree.fromstring(book.read(path)).iter(f"{_MAIN}row"):
            rows += [[] for _ in range(int(row.get("r", len(rows) + 1)) - 1 - len(rows))]
            values: list = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(values)
                values += [None] * (at - len(values)) + [_value(cell, shared, dates)]
            rows.append(values)
        width = max(map(len, rows), default=0)
        out[name] = [r + [None] * (width - len(r)) for r in rows]
    return out


def sheets_xls(data: bytes) -> dict[str, list[list]]:
    import python_calamine

    guard_xls(data)
    book = python_calamine.CalamineWorkbook.from_filelike(io.BytesIO(data))
    return {n: book.get_sheet_by_name(n).to_python() for n in book.sheet_names}


def read_workbook(spark: SparkSession, data: bytes, kind: str) -> dict[str, DataFrame]:
    """Each sheet that isn't empty as a frame; a workbook fits the driver by its format's limits."""
    sheets = {"xlsx": sheets_xlsx, "xls": sheets_xls}[kind](data)
    return {name: frame_of(spark, rows) for name, rows in sheets.items() if any(any(v is not None for v in r) for r in rows)}


# --- writing -----------------------------------------------------------------


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: str, value: object) -> str:
    """A cell with a plain value; what has no kind of its own in a workbook is text."""
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f'<c r="{at}"><v>{value}</v></c>'
    if isinstance(value, (date, datetime)):
        value = value.isoformat(" ") if isinstance(value, datetime) else value.isoformat()
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(df: DataFrame, name: str, out) -> None:
    from scrubjay.sources.sinks import exported

    rows = exported(df)
    if rows.count() > MOST_ROWS:
        raise ValueError(f"{name} has more rows than a sheet holds")
    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
    columns = [_letters(i) for i in range(len(rows.columns))]
    for n, values in enumerate(_with_head(rows), 1):
        cells = "".join(_cell(f"{c}{n}", v) for c, v in zip(columns, values, strict=True))
        out.write(f'<row r="{n}">{cells}</row>'.encode())
    out.write(b"</sheetData></worksheet>")


def _with_head(rows: DataFrame):
    yield rows.columns
    yield from rows.toLocalIterator()


def _sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook takes: 31 characters, none of them special, no two alike."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31].strip("'") or "sheet"
        new, k = base, 1
        while new.lower() in (x.lower() for x in out):
            k += 1
            new = f"{base[: 31 - len(str(k)) - 1]}_{k}"
        out.append(new)
    return out


def write_xlsx(frames: dict[str, DataFrame], path: str, source: str | None = None, removed: list[str] = ()) -> str:
    """Frames as sheets of a workbook, values only, in any store that Spark writes to.

    With a ``source`` workbook, sheets of its that have a frame by their name
    get its values, those ``removed`` go, others stay byte for byte as they
    are; frames that it has no sheet for are added.
    """
    spark = SparkSession.active()
    old = zipfile.ZipFile(io.BytesIO(store.read_bytes(spark, source))) if source else None
    parts = _sheet_paths(old) if old else {}
    kept = [n for n in parts if n not in removed]
    new = [n for n in frames if n not in parts]
    places = {n: parts[n] for n in kept} | {n: f"xl/worksheets/added{i}.xml" for i, n in enumerate(new, 1)}
    titles = kept + _sheet_names(new)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    dropped = {parts[n] for n in removed if n in parts}
    with store.open_write(spark, path) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as book:
        others = {}
        for entry in old.namelist() if old else ():
            if entry in dropped or entry in ("[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "_rels/.rels", "xl/calcChain.xml"):
                continue
            if entry not in {places[n] for n in kept if n in frames}:
                book.writestr(entry, old.read(entry))
            others[entry] = entry
        for name, place in places.items():
            if name in frames:
                with book.open(place, "w") as out:
                    _sheet(frames[name], name, out)
        links = "".join(f'<Relationship Id="sheet{i}" Type="{_REL[1:-1]}/worksheet" Target="/{place}"/>' for i, place in enumerate(places.values(), 1))
        extra = [(part, what) for part, what in (("xl/sharedStrings.xml", "sharedStrings"), ("xl/styles.xml", "styles"), ("xl/theme/theme1.xml", "theme")) if part in others]
        links += "".join(f'<Relationship Id="{what}" Type="{_REL[1:-1]}/{what}" Target="/{part}"/>' for part, what in extra)
        sheets = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="sheet{i}"/>' for i, t in enumerate(titles, 1))
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{sheets}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="book" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = _content_types(old, dropped)
        types |= {f"/{place}": f"{kind}worksheet+xml" for place in places.values()} | {"/xl/workbook.xml": f"{kind}sheet.main+xml"}
        overrides = "".join(f'<Override PartName="{part}" ContentType="{what}"/>' for part, what in types.items())
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{_defaults(old)}{overrides}</Types>')
    return path


def _types_of(old: zipfile.ZipFile | None):
    return ElementTree.fromstring(old.read("[Content_Types].xml")) if old else ()


def _content_types(old: zipfile.ZipFile | None, dropped: set[str]) -> dict[str, str]:
    gone = {f"/{x}" for x in dropped} | {"/xl/calcChain.xml"}
    return {x.get("PartName"): x.get("ContentType") for x in _types_of(old) if x.get("PartName") and x.get("PartName") not in gone}


def _defaults(old: zipfile.ZipFile | None) -> str:
    own = {x.get("Extension"): x.get("ContentType") for x in _types_of(old) if x.get("Extension") and x.get("Extension") not in ("rels", "xml")}
    return "".join(f'<Default Extension="{e}" ContentType="{what}"/>' for e, what in own.items())
