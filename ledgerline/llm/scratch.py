"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.workspace import folder

PLACES = 1024


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage, survives the loss of executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing needs any longer."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ledgerline/" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fraction(share: float, salt: str, *columns: str) -> Column:
    """Whether a row is in a sample of about ``share`` of all rows, by a hash of the columns; fine enough for any number of rows."""
    return F.xxhash64(*columns, F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(min((1 << 63) - 1, int(share * 2.0**63)))


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "left", merge: bool = False) -> DataFrame:
    """``rows`` joined to ``table`` (one row per ``key``), inner or left, where one key may hold any share of the rows.

    A key's rows are dealt over PLACES by a hash of the column ``spread``, and the table's
    row goes to the places that the key has. Rows without key join nothing. With ``merge``
    neither join is a broadcast: for tables whose rows are far larger than their files.
    """
    (place,) = free([*rows.columns, *table.columns], "_place")
    dealt = rows.where(F.col(key).isNotNull()).withColumn(place, F.pmod(F.xxhash64(spread), F.lit(PLACES)).cast("int"))
    wide = dealt.select(key, place).distinct().join(table.hint("merge") if merge else table, key)
    joined = dealt.join(wide.hint("merge") if merge else wide, [key, place], how).drop(place)
    return joined if how == "inner" else joined.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
