"""Archives and workbooks that the query writes from the tables, and reads back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources import archives as A
from ledgerline.sources.workspace import folder, written

from .base import SQL_FILINGS, Tables, query


#: Folders that models are dealt over; the driver lists these and never the files, one a bank.
FOLDERS = 1024


def _put(spark, rows: DataFrame, name: str, made) -> str:
    """Writes a file for each row (name, body) to a new shared folder, in tasks, and returns the folder; names may have a folder before them, and ``made`` turns a body into bytes."""
    out = folder(spark, name)
    where, path = fs.FileSystem.from_uri(out if ":" in out else f"file://{out}")
    where.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(out if ":" in out else f"file://{out}")
        there = {""}
        for b in batches:
            for file, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (under := file.rpartition("/")[0]) not in there:
                    target.create_dir(f"{base}/{under}", recursive=True)
                    there.add(under)
                with target.open_output_stream(f"{base}/{file}", compression=None) as f:
                    f.write(made(body))
            yield b.select([0])

    rows.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return out


def _zipped(body: list) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for m in body:
            z.writestr(m["member"], m["text"])
        z.writestr("notes.md", "no table")
        z.writestr("empty.csv", "")
    return out.getvalue()


@query(
    "archive_panel",
    """WITH p AS (SELECT o_custkey AS respondent, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(max(o_orderkey) AS VARCHAR) || ', "x"' AS lei FROM orders GROUP BY 1, 2)
SELECT respondent, arg_max(lei, y) AS lei, max(y) AS year FROM p GROUP BY 1""",
)
def archive_panel(t: Tables) -> DataFrame:
    """Yearly archives of lender panels, two members each with their columns in different order; the newest year wins a respondent."""
    p = t.orders.groupBy(F.col("o_custkey").alias("respondent"), F.year("o_orderdate").alias("y")).agg(F.max("o_orderkey").alias("k"))
    lei = F.concat(F.lit('"'), F.col("k").cast("string"), F.lit(', ""x""'), F.lit('"'))
    odd = F.col("respondent") % 2 == 1
    line = F.when(odd, F.concat_ws(",", lei, F.lit("skip"), "respondent")).otherwise(F.concat_ws(",", "respondent", lei))
    head = F.when(F.col("odd"), "lei,other,respondent\n").otherwise("respondent,lei\n")
    members = p.groupBy("y", odd.alias("odd")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("b")).withColumn("text", F.concat(head, "b"))
    files = members.groupBy("y").agg(F.collect_list(F.struct(F.concat(F.lit("part"), F.col("odd").cast("string"), F.lit(".csv")).alias("member"), "text")).alias("body"))
    out = _put(t.spark, files.select(F.concat(F.lit("panel-"), F.col("y").cast("string"), F.lit(".zip")).alias("name"), "body"), "panels", _zipped)
    rows = A.csv_rows(t.spark, out, ["respondent", "lei"]).withColumn("year", F.regexp_extract("file", r"panel-(\d+)\.zip$", 1).cast("int"))
    best = rows.groupBy(F.col("respondent").cast("long").alias("respondent")).agg(F.max(F.struct("year", "lei")).alias("b"))
    return best.select("respondent", "b.lei", "b.year")


def _model(rows: list) -> bytes:
    return A.sheet_bytes([[c["s"] if c["s"] is not None else c["n"] for c in row] for row in rows])


@query(
    "workbook_estimates",
    f"""WITH {SQL_FILINGS}, o AS (SELECT bank, qi, revenue, row_number() OVER (PARTITION BY bank ORDER BY qi DESC) AS k, bank % 3 AS layout FROM filings WHERE bank % 4 > 0),
four AS (SELECT *, count(*) OVER (PARTITION BY bank) AS n FROM o WHERE k <= 4), same AS (SELECT bank FROM four GROUP BY 1 HAVING min(qi % 4) = max(qi % 4)),
v AS (SELECT bank, CASE WHEN layout = 2 THEN CAST(2030 - k AS VARCHAR) WHEN layout = 1 AND bank IN (SELECT bank FROM same) THEN CAST(qi // 4 + 28 AS VARCHAR) ELSE (qi // 4 + 28) || 'Q' || (qi % 4 + 1) END AS period, revenue, layout FROM four WHERE n = 4)
SELECT bank, 'Revenue' AS metric, period, floor(revenue) AS value FROM v UNION ALL SELECT bank, 'Loss', period, -floor(revenue / 1000) FROM v WHERE layout = 1""",
)
def workbook_estimates(t: Tables) -> DataFrame:
    """A model a bank: quarters as text, as days of a workbook, or year ends that head years; titles above, notes and blanks beside the figures."""
    w = t.filings().where("bank % 4 > 0").groupBy("bank").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("qi", "revenue")))), 1, 4).alias("q")).where(F.size("q") == 4)
    text = lambda x: F.struct(x.alias("s"), F.lit(None).cast("double").alias("n"))
    number = lambda x: F.struct(F.lit(None).cast("string").alias("s"), x.cast("double").alias("n"))
    year, quarter = (lambda x: (F.floor(x.qi / 4) + 28).cast("int")), (lambda x: (x.qi % 4 + 1).cast("int"))
    short = lambda x: text(F.concat(quarter(x).cast("string"), F.lit("Q"), F.lpad((year(x) % 100).cast("string"), 2, "0"), F.lit("E")))
    serial = lambda x: number(F.datediff(F.last_day(F.make_date(year(x), quarter(x) * 3, F.lit(1))), F.to_date(F.lit("1899-12-30"))))
    ends = F.array(*(text(F.lit(f"12/31/{2030 - k}")) for k in range(1, 5)))
    layout = F.col("bank") % 3
    head = F.when(layout == 0, F.transform("q", short)).when(layout == 1, F.transform("q", serial)).otherwise(ends)
    row = lambda label, values: F.concat(F.array(text(F.lit(label) if isinstance(label, str) else F.lit(None).cast("string"))), values)
    cells = F.array(
        row("Model", F.array(text(F.lit("USD & co")))), row(None, head), row("Revenue", F.transform("q", lambda x: number(F.floor(x.revenue)))),
        row("Loss", F.transform("q", lambda x: text(F.when(layout == 1, F.concat(F.lit("($"), F.format_number(F.floor(x.revenue / 1000), 0), F.lit(")"))).otherwise("n/a")))), row("Blank", F.array(text(F.lit(None).cast("string")))),
        row(None, F.transform("q", lambda x: number(x.revenue))),
    )
    name = F.concat(F.pmod("bank", F.lit(FOLDERS)).cast("string"), F.lit("/m"), F.col("bank").cast("string"), F.lit(".xlsx"))
    out = _put(t.spark, w.select(name.alias("name"), cells.alias("body")), "models", _model)
    e = A.estimates(written(A.cells(t.spark, out), "cells"))
    return e.select(F.regexp_extract("file", r"m(\d+)\.xlsx$", 1).cast("long").alias("bank"), "metric", "period", "value")
