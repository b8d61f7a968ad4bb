"""Names of entities: normal forms, similarity, fuzzy joins and tagging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words at the end of a name that don't tell entities apart.
SUFFIXES = ["INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLC", "NA", "BANCORP", "BANCSHARES", "HOLDING", "HOLDINGS", "GROUP", "THE"]
# Words that count for nothing in a similarity.
TRIVIAL = ["THE", "OF", "AND", "BANK", "FIRST", "NATIONAL", "CO", "INC"]


def normal(name: Column) -> Column:
    """Upper case, punctuation as spaces, suffix words stripped from the end again and again."""
    bare = F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))
    return F.trim(F.regexp_replace(bare, rf"( ({'|'.join(SUFFIXES)}))+$", ""))


def tokens(name: Column) -> Column:
    """Distinct words of the normal form without trivial ones."""
    return F.array_except(F.array_distinct(F.split(normal(name), " ")), F.array(*(F.lit(x) for x in [*TRIVIAL, ""])))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; null where neither has any."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every)


def fuzzy_join(left: DataFrame, right: DataFrame, least: float, most: int = 1) -> DataFrame:
    """Best candidates by name: (id, other, similarity, place) with similarity of ``least`` or more, ties by larger weight, then other.

    ``left`` has (id, name), ``right`` (other, name, weight). Distinct word sets stand for the names that have them, so
    copies of a name are compared once: of each set on the right only the best ``most`` rows can be a result, and each
    set on the left is looked up for all its ids. Sets meet over their rarest words alone, as many as two sets of that
    similarity must share one of, so that a common word brings no pairs together.
    """
    words = F.array_sort(tokens(F.col("name")))
    l = left.select("id", words.alias("_a"))
    first = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("weight"), "other"))
    r = right.select("other", "weight", words.alias("_b")).withColumn("_r", first).where(F.col("_r") <= most).drop("_r")
    aw = l.select("_a").distinct().select("_a", F.explode("_a").alias("_w"))
    bw = r.select("_b").distinct().select("_b", F.explode("_b").alias("_w"))
    counts = aw.select("_w").unionByName(bw.select("_w")).groupBy("_w").agg(F.count("*").alias("_n"))

    def rarest(df: DataFrame, of: str) -> DataFrame:
        ranked = df.join(counts, "_w").groupBy(of).agg(F.sort_array(F.collect_list(F.struct("_n", "_w"))).alias("_s"))
        enough = F.size("_s") - F.ceil(F.lit(least) * F.size("_s") - 1e-9).cast("int") + 1
        return ranked.select(of, F.explode(F.slice("_s", 1, enough)).alias("_x")).select(of, F.col("_x._w").alias("_w"))

    met = rarest(aw, "_a").join(rarest(bw, "_b"), "_w").select("_a", "_b").distinct()
    near = met.withColumn("similarity", jaccard(F.col("_a"), F.col("_b"))).where(F.col("similarity") >= least)
    place = F.row_number().over(Window.partitionBy("_a").orderBy(F.desc("similarity"), F.desc("weight"), "other"))
    best = near.join(r, "_b").withColumn("place", place).where(F.col("place") <= most)
    return l.join(best, "_a").select("id", "other", "similarity", "place")


def tagged(df: DataFrame, key: str, text: str, phrases: dict[str, str]) -> DataFrame:
    """Entities named in a text: key, entity, n. Phrases match whole words, longest first, without overlaps.

    The dictionary is a parameter of fixed size and goes to the workers with the function.
    """
    import ahocorasick

    machine = ahocorasick.Automaton()
    for phrase, entity in phrases.items():
        machine.add_word(f" {phrase.lower()} ", (len(phrase) + 2, entity))
    machine.make_automaton()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, entities, counts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = sorted(((end - n + 1, n, e) for end, (n, e) in machine.iter(f" {t or ''} ")), key=lambda x: (-x[1], x[0]))
                taken: list[tuple[int, int]] = []
                seen: dict[str, int] = {}
                for at, n, e in found:  # neighbours may share the blank between them
                    if all(at + n - 1 <= a or a + m - 1 <= at for a, m in taken):
                        taken.append((at, n))
                        seen[e] = seen.get(e, 0) + 1
                for e, n in seen.items():
                    keys.append(k)
                    entities.append(e)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(entities, pa.string()), pa.array(counts, pa.int64())], [key, "entity", "n"])

    words = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " "))
    return df.select(key, words.alias("_t")).mapInArrow(scan, f"{key} {dict(df.dtypes)[key]}, entity string, n long")


def primary(df: DataFrame, cluster: str, order: list[Column]) -> DataFrame:
    """One row of each cluster, by the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where("_r = 1").drop("_r")
