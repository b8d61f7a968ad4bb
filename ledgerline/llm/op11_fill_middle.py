"""Fill-in-the-middle rearrangement of documents, in Spark's own functions only.

A text is cut into units (a word with the white space before it, or white space at the
end), by ``regexp_extract_all``. Two hashes of the row's id give two cuts among the units;
a third decides whether the text is rearranged, a fourth in which order. ``slice`` and
``array_join`` build prefix, middle and suffix, and the arrangement puts a sentinel before
each. Sentinels are told apart from text because texts that hold one stay plain; so the
arrangement alone, split at its sentinels, gives the text back.

One projection over the table: no shuffle, no Python; a document of any length is one row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import free

NAME = "op11_fill_middle"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


class Settings(NamedTuple):
    """Percent of texts to rearrange, percent of those with the suffix first, salt of the draws, sentinels of prefix, suffix and middle."""

    rate: int = 50
    suffix_first: int = 80
    salt: str = "42:"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight digits of a hexadecimal digest, as an unsigned number; k from 1."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def rearranged(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text, any others) with n, form, prefix, middle, suffix and output.

    n: the text's units; form: ``plain``, ``psm`` (prefix, suffix, middle) or ``spm``
    (suffix, prefix, middle); output: the arrangement, of a plain text the text itself.
    prefix, middle and suffix are null where the form is plain. A null text is empty; an
    empty text, and one that holds a sentinel, stays plain. Draws follow from salt and
    doc_id alone, so repeated rows are rearranged alike; a null doc_id draws as no digits.
    White space alone is one unit. Columns of ``docs`` with names of the new ones are
    replaced; others stay. An empty table gives an empty result.
    """
    s = settings
    body, digest, units, low, high = free([*docs.columns, "n", "form", "prefix", "middle", "suffix", "output"], "_body", "_digest", "_units", "_low", "_high")
    names = [body, digest, units, low, high]
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.withColumn(body, text).withColumn(digest, F.sha2(F.concat(F.lit(s.salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    marked = F.lit(False)
    for sentinel in (s.prefix, s.suffix, s.middle):
        marked = marked | F.contains(F.col(body), F.lit(sentinel))
    plain = (F.col(body) == "") | marked | (_draw(F.col(digest), 3) % 100 >= s.rate)
    form = F.when(plain, "plain").when(_draw(F.col(digest), 4) % 100 < s.suffix_first, "spm").otherwise("psm")
    cut = cut.withColumn("form", form).withColumn(units, F.regexp_extract_all(body, F.lit(UNIT), F.lit(0)))
    cut = cut.withColumn("n", F.size(units).cast("long"))
    at = [_draw(F.col(digest), k) % (F.col("n") + 1) for k in (1, 2)]
    cut = cut.withColumn(low, F.least(*at).cast("int")).withColumn(high, F.greatest(*at).cast("int"))
    part = lambda start, count: F.when(F.col("form") != "plain", F.array_join(F.slice(units, start, count), ""))
    first, last = F.col(low), F.col(high)
    cut = cut.withColumns({"prefix": part(F.lit(1), first), "middle": part(first + 1, last - first), "suffix": part(last + 1, F.size(units) - last)})
    psm = F.concat(F.lit(s.prefix), "prefix", F.lit(s.suffix), "suffix", F.lit(s.middle), "middle")
    spm = F.concat(F.lit(s.suffix), "suffix", F.lit(s.prefix), "prefix", F.lit(s.middle), "middle")
    return cut.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col(body))).drop(*names)


def restored(output: Column | str, form: Column | str, settings: Settings = Settings()) -> Column:
    """The text that was rearranged to ``output`` in ``form``, from these two alone: split at the sentinels and put in order."""
    s = settings
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    quoted = lambda *marks: "|".join(rf"\Q{m}\E" for m in marks)
    psm = F.split(output, quoted(s.prefix, s.suffix, s.middle), 4)
    spm = F.split(output, quoted(s.suffix, s.prefix, s.middle), 4)
    part = lambda parts, k: F.element_at(parts, k)  # noqa: E731  the first is what stands before the first sentinel: nothing
    return F.when(form == "psm", F.concat(part(psm, 2), part(psm, 4), part(psm, 3))).when(form == "spm", F.concat(part(spm, 3), part(spm, 4), part(spm, 2))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rearranged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
  CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
