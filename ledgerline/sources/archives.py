"""Zip archives of CSV files and workbooks, read one member or sheet a partition, small ones packed.

``spark.dataSource.register`` makes two formats: ``csvzip`` (rows of the CSV members of zip
files) and ``workbook`` (cells of xlsx sheets, by our own reading of shared strings and cell
references). The driver reads directories of zip files and of large workbooks; tasks open the file and stream their member,
so neither memory nor a lost executor hangs on an archive's size. Of workbooks the driver lists one level only: the
folders below are listed by tasks, so its memory doesn't hang on the number of files where these are dealt over folders. Paths are URIs that
pyarrow's file systems open.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 16_384
#: Bytes of members that make a partition at least, where there are so many.
PACK = 1 << 20
FOLDER = PACK // 8
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, sheet string, row int, col int, text string, number double"


def _open(uri: str):
    where, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    return where.open_input_file(path)


def _sized(folder: str, suffix: str, below: bool = True) -> list[tuple[str, int]]:
    """URIs and bytes of the files with a suffix in a folder and, if so told, in those below it, or of the one file named."""
    where, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    info = where.get_file_info(path)
    base = folder.rstrip("/")
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    found = where.get_file_info(fs.FileSelector(path, recursive=below, allow_not_found=True))
    return sorted((base + f.path[len(path.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def _folders(folder: str) -> list[str]:
    """URIs of the folders in a folder, one level."""
    where, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    if where.get_file_info(path).type != fs.FileType.Directory:
        return []
    found = where.get_file_info(fs.FileSelector(path))
    return sorted(folder.rstrip("/") + f.path[len(path.rstrip("/")) :] for f in found if f.type == fs.FileType.Directory)


def _files(folder: str, suffix: str) -> list[str]:
    return [file for file, _ in _sized(folder, suffix)]


class _Part:
    """A member of a file, a whole file (member empty) or all files of a folder (member None)."""

    def __init__(self, file: str, member: str | None, name: str, size: int):
        self.file, self.member, self.name, self.size = file, member, name, size


class _Pack(InputPartition):
    """Members that one task reads: one, or several that are small together."""

    def __init__(self, parts: list[_Part]):
        super().__init__([(p.file, p.member) for p in parts])
        self.parts = parts


def _packed(parts: list[_Part], least: int) -> list[_Pack]:
    packs, held, size = [], [], 0
    for p in parts:
        held.append(p)
        size += p.size
        if size >= least:
            packs.append(_Pack(held))
            held, size = [], 0
    return packs + ([_Pack(held)] if held else [])


class _Rows(DataSourceReader):
    """Rows of CSV members as text columns by name: a member without one gives nulls, other columns are left out."""

    def __init__(self, path: str, wanted: list[str], types: pa.Schema, least: int):
        self.path, self.wanted, self.types, self.least = path, wanted, types, least

    def partitions(self) -> list[_Pack]:
        parts = []
        for file in _files(self.path, ".zip"):
            with _open(file) as f, zipfile.ZipFile(f) as z:
                parts += [_Part(file, i.filename, i.filename, i.file_size) for i in z.infolist() if i.filename.lower().endswith((".csv", ".txt")) and i.file_size]
        return _packed(parts, self.least)

    def read(self, pack: _Pack | None) -> Iterator[pa.RecordBatch]:
        for part in pack.parts if pack else ():  # without partitions Spark reads one that is none
            yield from self._member(part)

    def _member(self, part: _Part) -> Iterator[pa.RecordBatch]:
        with _open(part.file) as f, zipfile.ZipFile(f) as z, z.open(part.member) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", "replace", newline=""))
            head = next(rows, [])
            at = [head.index(c) if c in head else None for c in self.wanted]
            held: list[list[str | None]] = []
            for n, row in enumerate(rows):
                held.append([row[k] if k is not None and k < len(row) else None for k in at])
                if len(held) == BATCH:
                    yield self._made(part, held, n + 1 - BATCH)
                    held = []
            if held:
                yield self._made(part, held, n + 1 - len(held))

    def _made(self, part: _Part, rows: list, first: int) -> pa.RecordBatch:
        same = lambda x: pa.array([x] * len(rows), pa.string())
        columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(self.wanted))]
        return pa.RecordBatch.from_arrays([same(part.file), same(part.member), pa.array(range(first, first + len(rows)), pa.int64()), *columns], schema=self.types)


class CsvZip(DataSource):
    """Format ``csvzip``: options path, columns (comma-separated) and pack (see PACK); file, member, line (from 0), and the columns as text."""

    @classmethod
    def name(cls) -> str:
        return "csvzip"

    def _wanted(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return "file string, member string, line long, " + ", ".join(f"`{c}` string" for c in self._wanted())

    def reader(self, schema) -> DataSourceReader:
        kinds = pa.schema([("file", pa.string()), ("member", pa.string()), ("line", pa.int64()), *((c, pa.string()) for c in self._wanted())])
        return _Rows(self.options["path"], self._wanted(), kinds, int(self.options.get("pack", PACK)))


def column_number(reference: str) -> int:
    """The column of a cell reference, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of a workbook's sheets, in order; external and missing ones left out."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    known, out = set(z.namelist()), []
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links.get(s.get(LINK), "")
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if member in known:
            out.append((s.get("name"), member))
    return out


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, x in ElementTree.iterparse(f):
            if x.tag == f"{MAIN}si":
                out.append("".join(t.text or "" for t in x.iter(f"{MAIN}t")))
                x.clear()
    return out


def _parts(file: str) -> list[_Part]:
    with _open(file) as f, zipfile.ZipFile(f) as z:
        return [_Part(file, member, name, z.getinfo(member).file_size) for name, member in _sheets(z)]


class _Cells(DataSourceReader):
    def __init__(self, path: str, least: int):
        self.path, self.least = path, least

    def partitions(self) -> list[_Pack]:
        """Sheets of large files, and small files whole, which only their task opens; a folder below is one part, which its task lists, and so much work as FOLDER bytes."""
        parts = [_Part(folder, None, "", FOLDER) for folder in _folders(self.path)]
        for file, size in _sized(self.path, ".xlsx", below=False):
            if size < PACK:
                parts.append(_Part(file, "", "", max(size, 1)))
            else:
                parts += _parts(file)
        return _packed(parts, self.least)

    def read(self, pack: _Pack | None) -> Iterator[tuple]:
        for part in pack.parts if pack else ():
            for file in [part.file] if part.member is not None else _files(part.file, ".xlsx"):
                with _open(file) as f, zipfile.ZipFile(f) as z:
                    shared = _strings(z)
                    for name, member in [(part.name, part.member)] if part.member else _sheets(z):
                        yield from self._sheet(z, shared, file, name, member)

    def _sheet(self, z: zipfile.ZipFile, shared: list[str], file: str, name: str, member: str) -> Iterator[tuple]:
        with z.open(member) as sheet:
            row = -1
            for event, x in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start" and x.tag == f"{MAIN}row":
                    row, col = int(x.get("r") or row + 2) - 1, -1
                elif event == "end" and x.tag == f"{MAIN}c":
                    col = column_number(x.get("r")) if x.get("r") else col + 1
                    kind, value = x.get("t"), x.findtext(f"{MAIN}v")
                    if kind == "s" and value is not None:
                        text, number = shared[int(value)], None
                    elif kind == "inlineStr":
                        text, number = "".join(t.text or "" for t in x.iter(f"{MAIN}t")), None
                    elif kind in ("str", "b", "e"):
                        text, number = value, None
                    else:
                        text, number = value, float(value) if value else None
                    if text:
                        yield file, name, row, col, text, number
                elif event == "end" and x.tag == f"{MAIN}row":
                    x.clear()


class Workbook(DataSource):
    """Format ``workbook``: options path and pack (see PACK); the filled cells of all sheets: file, sheet, row and col (from 0), text, number (null of text)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _Cells(self.options["path"], int(self.options.get("pack", PACK)))


def csv_rows(spark: SparkSession, path: str, columns: list[str], pack: int = PACK) -> DataFrame:
    spark.dataSource.register(CsvZip)
    return spark.read.format("csvzip").option("columns", ",".join(columns)).option("pack", pack).load(path)


def cells(spark: SparkSession, path: str, pack: int = PACK) -> DataFrame:
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").option("pack", pack).load(path)


def sheet_bytes(rows: list[list]) -> bytes:
    """A workbook of one sheet, ``Sheet1``: strings shared, numbers as they are, None empty."""
    strings: dict[str, int] = {}

    def cell(v, r: int, c: int) -> str:
        ref, n = "", c + 1
        while n:
            n, k = divmod(n - 1, 26)
            ref = chr(65 + k) + ref
        if v is None:
            return ""
        if isinstance(v, str):
            return f'<c r="{ref}{r + 1}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'
        return f'<c r="{ref}{r + 1}"><v>{v!r}</v></c>'

    body = "".join(f'<row r="{r + 1}">{"".join(cell(v, r, c) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
    space, office = MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
    return out.getvalue()


def header_period(text: Column, number: Column) -> Column:
    """What a header cell of a model says of its column: struct of period (2026Q2 or 2026; null if none), and for dates year and month, which alone can't tell a quarter from a year.

    2Q26, Q2 2026, 2026Q2, FY26, 2026E and bare years are plain; 6/30/2026, 2026-06-30 and
    day numbers of a workbook are dates.
    """
    part = lambda p, k: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    century = lambda y: F.when(y.cast("int") < 100, y.cast("int") + 2000).otherwise(y.cast("int"))
    quarter = F.coalesce(
        F.concat(century(part(r"(?i)^([1-4])Q\s*'?(\d{2}|20\d{2})[AE]?$", 2)), F.lit("Q"), part(r"(?i)^([1-4])Q\s*'?(\d{2}|20\d{2})[AE]?$", 1)),
        F.concat(century(part(r"(?i)^Q([1-4])\s*'?(\d{2}|20\d{2})[AE]?$", 2)), F.lit("Q"), part(r"(?i)^Q([1-4])\s*'?(\d{2}|20\d{2})[AE]?$", 1)),
        F.concat(part(r"(?i)^(20\d{2})\s*Q([1-4])[AE]?$", 1), F.lit("Q"), part(r"(?i)^(20\d{2})\s*Q([1-4])[AE]?$", 2)),
    )
    whole = century(F.coalesce(part(r"(?i)^FY\s*'?(\d{2}|20\d{2})[AE]?$", 1), part(r"(?i)^(20\d{2})(?:\.0)?[AE]?$", 1))).cast("string")
    slashed, dashed = r"^(\d{1,2})/\d{1,2}/(\d{2,4})$", r"^(\d{4})-(\d{1,2})-\d{1,2}"
    serial = F.when(number.between(36526, 73050), F.date_add(F.to_date(F.lit("1899-12-30")), number.cast("int")))
    year = F.coalesce(century(part(slashed, 2)), part(dashed, 1).cast("int"), F.year(serial))
    month = F.coalesce(part(slashed, 1), part(dashed, 2)).cast("int")
    month = F.when(month.between(1, 12), month).otherwise(F.month(serial))
    dated = F.when(year.isNotNull() & month.isNotNull(), F.concat(year, F.lit("Q"), F.ceil(month / 3)))
    plain = F.coalesce(quarter, whole)
    return F.struct(F.coalesce(plain, dated).alias("period"), F.when(plain.isNull() & dated.isNotNull(), year).alias("year"), F.when(plain.isNull() & dated.isNotNull(), month).alias("month"))


def estimates(cells: DataFrame, lead: int = 8) -> DataFrame:
    """Models laid out as metric rows by period columns, as long rows: file, sheet, metric, period, value.

    The header is the first of the ``lead`` leading rows with two periods or more behind the
    first column. Its dates are taken together: all of one month in different years head
    years, else quarters. Values are numbers, or text with signs, separators or parentheses;
    others, and rows without name, are left out, as are sheets without header.
    """
    sheet = ["file", "sheet"]
    said = F.transform(F.array(F.struct(F.trim("text").alias("text"), "number")), lambda x: header_period(x.text, x.number))  # once a cell: written out, it runs again for each of its fields
    head = cells.where((F.col("row") < lead) & (F.col("col") > 0)).select(*sheet, "row", "col", F.explode_outer(said).alias("h")).where(F.coalesce(F.col("h.period"), F.lit("")) != "")
    counted = head.groupBy(*sheet, "row").agg(F.count("*").alias("n"), F.count("h.year").alias("dates"), F.count_distinct("h.year").alias("years"), F.count_distinct("h.month").alias("months"))
    first = counted.where("n >= 2").groupBy(*sheet).agg(F.min_by(F.struct("row", "dates", "years", "months"), "row").alias("f"))
    annual = (F.col("f.dates") >= 2) & (F.col("f.months") == 1) & (F.col("f.years") == F.col("f.dates"))
    columns = head.join(first, sheet).where("row = f.row").select(*sheet, "col", F.col("f.row").alias("top"), F.when(annual & F.col("h.year").isNotNull(), F.col("h.year").cast("string")).otherwise(F.col("h.period")).alias("period"))
    names = cells.where("col = 0").select(*sheet, "row", F.trim("text").alias("metric")).where("metric != ''")
    plain = F.regexp_replace(F.trim("text"), r"[$,%\s]", "")
    signed = F.when(plain.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(plain, "[()]", ""))).otherwise(plain)
    value = F.coalesce("number", signed.try_cast("double"))
    body = cells.where("col > 0").join(columns, [*sheet, "col"]).where("row > top").withColumn("value", value).where("value is not null and not isnan(value) and abs(value) < 1e300")
    return body.join(names, [*sheet, "row"]).select(*sheet, "metric", "period", "value")
