"""Statements as rendered on filed pages, and their stitching over filings.

A page's table becomes lines (label, kind, element, section) and figures by period. Over
the filings of a company each period is owned by the newest filing that states it; lines
whose wording changed are folded into one where that can't hide a figure. Pages, lines and
figures are DataFrame work. A page is read, and the lines of a company are stitched and
folded, in Python, each in one list of one task: the one as long as the page, the other as
the company's filings. Between them is one shuffle of lines, by company.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import releases as R
from ledgerline.functions import rules
from ledgerline.operators.filings import merged_order
from ledgerline.operators.reltables import number
from ledgerline.sources import pages

# Words of statements.
NOISE = r"(?i)\[extensible\s+enumeration\]|^\s*\[\d+\]\s*$"
GRAND_TOTAL = r"(?i)^\s*total\s+liabilities\s+and\b.{0,40}\bequity\b|^\s*liabilities\s+and\b.{0,40}\bequity,\s*total\b"
PLACEHOLDER = r"(?i)shares?\s+issued\s+not\s+disclosed"
FILLERS = set("inc incorporated corp corporation company co bancshares bancorp bancorporation and the of at gain gains loss losses".split())
SHUFFLED = set("total interest fees fee dividend dividends income on including securities security net".split())
VALUES = "array<struct<period:date,value:double>>"
PER_SHARE = re.compile(r"per share|per common share|\(in shares\)|in shares", re.I)


SHEET = "title string, heads array<string>, rows array<struct<row:int,label:string,ref:string,type:string,texts:array<string>>>"
PAGES = 256  # whose cells a task holds at once


def _sheet(cells: list[tuple]) -> tuple[str | None, list, list]:
    """A page's first table, from its cells: the title, the texts of the last row of header cells, and (row, label, ref, type, texts behind the label) of the others, types by the page's definitions."""
    rows: dict[int, list] = {}
    marks, ones = [], {}
    for tab, row, col, _, _, head, style, ref, name, text in cells:
        if tab == 0:
            if row not in rows:
                rows[row] = []
            rows[row].append((col, text, ref, style, head))
        if col < 2 and name and name.startswith("defref"):
            if col == 1 and text is not None:
                ones[tab, row] = min(text, ones.get((tab, row), text))
            elif col == 0 and text == "Data Type:":
                marks.append((tab, row, name[7:507]))
    types: dict[str, str] = {}
    for tab, row, ref in marks:
        if (tab, row) in ones:
            types[ref] = min(ones[tab, row], types.get(ref, ones[tab, row]))
    title, titled, heads, body = None, False, [], []
    for k in sorted(rows):
        row = rows[k]
        if any(a[0] >= b[0] for a, b in zip(row, row[1:])):
            row.sort(key=lambda c: (c[0], c[1] is not None, c[1] or "", c[2] is not None, c[2] or ""))
        if not titled:
            for _, text, _, style, _ in row:
                if style and "tl" in style and "tl" in style.split(" "):
                    title, titled = text, True
                    break
        told = [head for *_, head in row if head is not None]
        if not told:
            continue
        if all(told):
            heads = [text for _, text, *_ in row]
            continue
        own = [c for c in row if c[0] <= 0 or c[3] is not None and not ("th" in c[3] and "th" in c[3].split(" "))]
        if own and own[0][1]:
            _, label, ref, _, _ = own[0]
            body.append((k, label, ref, types.get(ref) if ref is not None else None, [text for _, text, *_ in own[1:501]]))
    return title, heads, body


def _batch(keys: pa.Array, key: str, sheets: list[tuple]) -> pa.RecordBatch:
    """Sheets as Arrow, one a page."""
    ends = lambda xs: pa.array([0, *accumulate(map(len, xs))], pa.int32())
    rows = [r for _, _, body in sheets for r in body]
    texts = pa.ListArray.from_arrays(ends([r[4] for r in rows]), pa.array([x for r in rows for x in r[4]], pa.string()))
    parts = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3)), texts]
    body = pa.ListArray.from_arrays(ends([b for _, _, b in sheets]), pa.StructArray.from_arrays(parts, ["row", "label", "ref", "type", "texts"]))
    return pa.RecordBatch.from_arrays([keys, pa.array([t for t, _, _ in sheets], pa.string()), pa.array([h for _, h, _ in sheets], pa.list_(pa.string())), body], [key, "title", "heads", "rows"])


def _ruled(sheets: DataFrame, key: str) -> DataFrame:
    """The lines of sheets, one a page: periods, kinds, figures and sections by the rules of labels and texts; no row leaves its page's task.

    Rows are left out by conditions that Spark infers nothing from (an outer explode, a
    coalesced comparison): what it infers goes below the rules and has them run twice.
    """
    values = lambda r: F.transform(r.texts, lambda x: number(x, notes=False))
    blank = lambda r: (F.size(r.texts) > 0) & (F.size(F.filter(r.texts, lambda x: x != "")) == 0)
    periods = F.filter(F.transform("heads", R.period_end), lambda p: p.isNotNull())
    told = F.transform(
        F.filter("rows", lambda r: ~r.label.rlike(NOISE)),
        lambda r: F.struct(r.row.alias("row"), r.label.alias("label"), r.ref.alias("ref"), r["type"].alias("type"), values(r).alias("values"), blank(r).alias("header"), r.label.rlike(GRAND_TOTAL).alias("total")),
    )
    page = sheets.where(F.col(key).isNotNull()).select(key, rules.units_scale(F.coalesce("title", F.lit(""))).alias("units"), periods.alias("periods"), told.alias("told"))
    row = lambda wanted: F.transform(F.filter("told", wanted), lambda r: r.row)
    last = F.least(F.array_max(row(lambda r: F.exists(r["values"], lambda v: v.isNotNull()))), F.array_min(row(lambda r: r.total & ~r.header)))
    page = page.select(key, "units", "periods", F.when(F.size("periods") > 0, F.col("told")).alias("told"), F.array_max(F.transform("told", lambda r: F.size(r["values"]))).alias("widest"), last.alias("end"), row(lambda r: r.header).alias("heads"))
    wanted = F.when(F.size("periods") > F.col("widest"), F.slice("periods", F.size("periods") - F.col("widest") + 1, F.col("widest"))).otherwise(F.col("periods"))
    line = page.select(key, "units", wanted.alias("wanted"), "end", "heads", F.explode_outer("told").alias("r")).where(F.coalesce(F.col("r.row") <= F.col("end"), F.lit(False)))
    line = line.select(key, "units", "wanted", "heads", "r.*")
    kind = rules.row_kind(F.col("label"), F.coalesce("type", F.lit("")))
    line = line.withColumn("kind", kind).withColumn("scale", F.when(F.col("kind") == "monetary", F.col("units")).otherwise(1.0))
    figures = F.zip_with("wanted", F.slice("values", 1, F.size("wanted")), lambda p, v: F.struct(p.alias("period"), (v * F.col("scale")).alias("value")))
    section = F.array_max(F.filter("heads", lambda h: h <= F.col("row")))
    return line.select(key, "row", "label", F.concat(rules.label_key(F.col("label")), F.when(F.col("header"), "|").otherwise("")).alias("line"), "header", F.coalesce(section, F.lit(-1)).alias("section"), "kind", "ref", F.when(~F.col("header"), figures).alias("figures"))


def lines(cells: DataFrame, key: str) -> DataFrame:
    """The lines of each page's statement, its first table: key, row, label, line, header, section, kind, ref, figures.

    figures: array of (period, value), aligned with the dates of the last row of header
    cells; value null where blank, amounts times the unit in the title, per-share figures
    and counts as they stand. The kind comes from the element's type where the page gives
    it, else from the label. line: the label without numbers, its key over filings; a
    heading (no figures) is marked ``header`` and is the section of the lines below.
    Metadata rows, spacer cells, what follows the grand total of a balance sheet and what
    follows the last figure are left out. Pages without dates give nothing. A page's cells
    are brought together once.
    """
    whole = cells.groupBy(key).agg(F.collect_list(F.struct(*pages.CELL)).alias("cells"))
    kind = cells.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                yield _batch(part.column(0), key, [_sheet([tuple(c.values()) for c in x]) for x in part.column(1).to_pylist()])

    return _ruled(whole.mapInArrow(read, f"`{key}` {kind}, {SHEET}"), key)


def page_lines(df: DataFrame, key: str, html: str) -> DataFrame:
    """The :func:`lines` of pages, each read and ruled where it is: a page is one row, its cells are never rows of their own. Deal the pages over all tasks before."""
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                yield _batch(part.column(0), key, [_sheet(pages.parsed(x)) for x in part.column(1).to_pylist()])

    return _ruled(df.select(key, html).mapInArrow(read, f"`{key}` {kind}, {SHEET}"), key)


def _stitched(given: list[tuple], years: int) -> list[dict]:
    """One company's statement from its lines (filing, row, line, label, header, ref, figures as (period, value)), in the order of filings and rows."""
    owner, seen, known, shown, lists = {}, {}, {}, {}, {}
    for filing, row, line, label, header, ref, figures in given:
        lists.setdefault(filing, []).append(line)
        if line not in shown or filing != shown[line][0]:
            shown[line] = (filing, label, header, ref)
        if header or filing is None:
            continue
        for period, value in figures or ():
            if period is not None:
                owner[period] = seen[period, line] = filing
                if value is not None and known.get((period, line), (None,))[0] != filing:
                    known[period, line] = (filing, value)
    newest = sorted(owner, reverse=True)[:years]
    if not newest:
        return []
    out, section = [], -1
    for position, line in enumerate(merged_order(list(reversed(lists.values())))):
        _, label, header, ref = shown[line]
        if header:
            section = position
        values = None if header else [{"period": p, "value": known.get((p, line), (None, None))[1] if seen.get((p, line)) == owner[p] else None} for p in newest]
        out.append({"position": position, "line": line, "label": label, "header": header, "section": section, "ref": ref, "values": values})
    return out


def _companies(lines: DataFrame, company: str, filing: str) -> DataFrame:
    """(company, rows): all lines of a company, in one list by filing and row; companies are dealt over all tasks."""
    figures = [F.transform("figures", lambda f: f[x]).alias(f"{x}s") for x in ("period", "value")]
    item = F.struct(F.col(filing).alias("filing"), "row", "line", "label", "header", "ref", *figures)
    spark = lines.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.where(F.col(company).isNotNull()).select(company, item.alias("_i")).repartition(tasks, company).groupBy(company).agg(F.collect_list("_i").alias("rows"))


def _by_company(lines: DataFrame, company: str, filing: str, years: int, last, columns: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """``last`` of each company's stitched lines, row by row."""
    kind = dict(lines.dtypes)[company]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                lists = part.column(1)
                *flat, periods, values = (x.to_pylist() for x in lists.flatten().flatten())
                every = list(zip(*flat, [None if p is None else list(zip(p, v)) for p, v in zip(periods, values)]))
                own, found, start = [], [], 0
                for k, size in enumerate(lists.value_lengths().to_pylist()):
                    given = sorted(every[start : start + size], key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]))
                    start += size
                    rows = last(_stitched(given, years))
                    found += rows
                    own += [k] * len(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), *(pa.array([r[i] for r in found], t) for i, t in enumerate(kinds))], [company, *columns])

    return _companies(lines, company, filing).mapInArrow(stitch, f"`{company}` {kind}, {schema}")


def stitched(lines: DataFrame, company: str, filing: str, years: int = 5) -> DataFrame:
    """One statement a company over its filings (larger is newer): company, position, line, label, header, section, ref, values.

    values: array of (period, value), newest of the ``years`` periods first. The newest
    filing that states a period owns it: what it doesn't list is blank, what it lists but
    leaves blank comes from the newest older filing with a figure. Lines are in the merged
    order of all filings; label and element are those of the newest. A company is one list of one task.
    """
    columns = ["position", "line", "label", "header", "section", "ref", "values"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.struct([("period", pa.date32()), ("value", pa.float64())]))]
    last = lambda rows: [tuple(r[c] for c in columns) for r in rows]
    return _by_company(lines, company, filing, years, last, columns, kinds, f"position int, line string, label string, header boolean, section int, ref string, values {VALUES}")


def statements(lines: DataFrame, company: str, filing: str, years: int = 5) -> DataFrame:
    """:func:`stitched` and :func:`consolidated` in one pass over each company's lines: company, position, label, header, ref, period, value."""
    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.date32(), pa.float64()]
    blank = [{"period": None, "value": None}]

    def last(rows: list[dict]) -> list[tuple]:
        return [(k, r["label"], r["header"], r["ref"], v["period"], v["value"]) for k, r in enumerate(folded(rows)) for v in r["values"] or blank]

    return _by_company(lines, company, filing, years, last, ["position", "label", "header", "ref", "period", "value"], kinds, "position int, label string, header boolean, ref string, period date, value double")


@lru_cache(1 << 14)
def _tokens(label: str) -> frozenset[str]:
    """The words that tell a line: no closing ', Total', parentheses, numbers, names of legal forms or sides of a result."""
    text = re.sub(r"(?i),\s*total\s*$|\([^)]*\)|[\d,]+|['’]", " ", label)
    return frozenset(w for w in re.findall(r"\w+", text.lower()) if w not in FILLERS)


def _alike(a: str, b: str) -> bool:
    """One wording within the other: equal sets of words, or one of two words or more (of any, for figures per share) inside the other."""
    x, y = sorted((_tokens(a), _tokens(b)), key=len)
    return bool(x) and x <= y and (len(x) > 1 or x == y or bool(PER_SHARE.search(a) and PER_SHARE.search(b)))


def _twins(a: str, b: str) -> bool:
    """As :func:`_alike`, also with words that are shuffled when a line is renamed left out; for lines of which one is blank."""
    x, y = sorted((_tokens(a) - SHUFFLED, _tokens(b) - SHUFFLED), key=len)
    return bool(x) and x <= y


def folded(rows: list[dict]) -> list[dict]:
    """Lines of one statement, in order, with rewordings folded into the first of them.

    Two lines are one if they report the same element, or their wordings are alike, or one
    of them is blank throughout, stands in the same section and is a twin; and only if no
    period has figures of both. The label is of the line that reaches the newer period.
    """
    out: list[dict] = []
    for r in rows:
        if r["header"]:
            out.append(r)
            continue
        if re.search(PLACEHOLDER, r["label"]):
            continue
        own = [v["value"] for v in r["values"]]
        blank = all(v is None for v in own)
        for o in out:
            if o["header"]:
                continue
            kept = [v["value"] for v in o["values"]]
            twin = (blank or all(v is None for v in kept)) and o["section"] == r["section"] and _twins(o["label"], r["label"])
            if not ((r["ref"] and r["ref"] == o["ref"]) or _alike(o["label"], r["label"]) or twin):
                continue
            if any(a is not None and b is not None for a, b in zip(kept, own)):
                continue
            first = lambda vs: next((k for k, v in enumerate(vs) if v is not None), len(vs))
            if first(own) < first(kept):
                o["label"], o["ref"] = r["label"], r["ref"] or o["ref"]
            o["values"] = [a if a["value"] is not None else b for a, b in zip(o["values"], r["values"])]
            break
        else:
            out.append(r)
    return out


def consolidated(stitched: DataFrame, company: str) -> DataFrame:
    """``stitched`` with rewordings folded: company, position (from 0, anew), label, header, ref, period, value; a heading is one row without period."""
    item = f"struct<position:int,label:string,header:boolean,section:int,ref:string,values:{VALUES}>"
    lists = stitched.groupBy(company).agg(F.array_sort(F.collect_list(F.struct("position", "label", "header", F.col("section").cast("int").alias("section"), "ref", "values"))).cast(f"array<{item}>").alias("rows"))
    kind = dict(stitched.dtypes)[company]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([folded(x) for x in b.column(1).to_pylist()], b.column(1).type)], [company, "rows"])

    rows = lists.mapInArrow(fold, f"`{company}` {kind}, rows array<{item}>").select(company, F.posexplode("rows").alias("position", "r"))
    return rows.select(company, "position", "r.label", "r.header", "r.ref", F.explode_outer("r.values").alias("v")).select(company, "position", "label", "header", "ref", "v.period", "v.value")
