"""Matching registrants with institutions of another registry, by name and state.

A name is a candidate, not an identity: a match needs the registrant's state to agree with
the holder's or the bank's, and where several candidates stay, none is taken. Names meet in
two phases: equal names first, and only what they leave over by containment and long common
prefixes. No pair of names is formed that doesn't share a key: a name within another shares
its rarest run of GRAM letters with it, and of a common prefix the shorter name says how
long it must be, so that prefix itself is the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spellings of one word, words too common to tell a company, lengths.
SPELLINGS = {
    "BANCORPORATION": "BCORP", "BANCORP": "BCORP", "BANCSHARES": "BSHRS", "BANKSHARES": "BSHRS", "BSHRS": "BSHRS", "CORPORATION": "CORP", "COMPANY": "CO", "INCORPORATED": "INC", "NATIONAL": "NATL", "FINANCIAL": "FNCL", "HOLDINGS": "HOLDING", "SAINT": "ST",
}
GENERIC = {"AND", "THE", "OF", "BCORP", "BSHRS", "CORP", "CO", "INC", "NATL", "FNCL", "HOLDING", "BANK", "BANKS", "TRUST", "FIRST", "GROUP", "SAVINGS", "COMMUNITY", "UNITED", "ST", "STATE"}
GRAM, SHORTEST_PREFIX, PREFIX_SHARE = 8, 12, 0.8
LIST, CHUNK = 1000, 64  # keys of a class that one row holds, and that are expanded at once


def tokens(name: Column) -> Column:
    """Words of a name in one spelling each: upper case, & as AND, a state in parentheses or behind a slash left out."""
    plain = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"\s*(?:/[A-Z]{2,3}/?|\([A-Z]{2}\))\s*$", "")
    words = F.filter(F.split(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "), " "), lambda w: w != "")
    spelt = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(spelt, w), w))


def collapsed(name: Column) -> Column:
    """A name's words without anything between."""
    return F.array_join(tokens(name), "")


def contained(a: Column, b: Column) -> Column:
    """Whether one collapsed name of GRAM letters or more is within the other."""
    return (F.least(F.length(a), F.length(b)) >= GRAM) & (F.contains(b, a) | F.contains(a, b))


def prefixed(a: Column, b: Column) -> Column:
    """Whether two collapsed names begin alike for PREFIX_SHARE of the shorter, which has SHORTEST_PREFIX letters or more."""
    short = F.least(F.length(a), F.length(b))
    need = F.ceil(short * PREFIX_SHARE).cast("int")
    return (short >= SHORTEST_PREFIX) & (F.substr(a, F.lit(1), need) == F.substr(b, F.lit(1), need))


def alike(a: Column, b: Column, prefix: bool) -> Column:
    """Whether two names may be one company's: a telling word in common, one within the other or, with ``prefix``, a long common beginning."""
    telling = lambda t: F.filter(t, lambda w: ~w.isin(*sorted(GENERIC)))
    x, y = collapsed(a), collapsed(b)
    same = F.arrays_overlap(telling(tokens(a)), telling(tokens(b))) | contained(x, y)
    return F.coalesce((x != "") & (y != "") & (same | prefixed(x, y) if prefix else same), F.lit(False))


def corroborated(name: Column, holder: Column, bank: Column) -> Column:
    """Whether a registrant may be the company of a bank's record: its holder is alike, or the bank's own name is one with the registrant's; a bank without holder is compared by itself."""
    has = F.size(tokens(holder)) > 0
    return F.when(has, alike(name, holder, True) | F.coalesce(contained(collapsed(name), collapsed(bank)), F.lit(False))).otherwise(alike(name, bank, False))


def _keys(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key, collapsed(F.col(name)).alias("_c")).where("_c != ''")


def _within(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs where a name of ``short`` is within one of ``long``, met at its rarest run of letters."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_c") - GRAM + 1), lambda i: F.substr("_c", i, F.lit(GRAM))))
    split = lambda df: df.where(F.length("_c") >= GRAM).withColumn("_g", F.explode(runs))
    grams = split(long.withColumnRenamed(b, "_b"))
    counts = grams.groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = split(short).join(counts, "_g", "left").groupBy(a, "_c").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("x"))
    met = rarest.where("x.n > 0").select(F.col(a), F.col("_c").alias("_s"), F.col("x.g").alias("_g")).join(grams, "_g")
    return met.where(F.contains(F.col("_c"), F.col("_s"))).select(a, F.col("_b").alias(b))


def _beginning(short: DataFrame, long: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that begin alike, the first no longer than the second: the first's part that must agree meets the beginnings of the second."""
    one = short.where(F.length("_c") >= SHORTEST_PREFIX).select(a, F.length("_c").alias("_l"), F.substr("_c", F.lit(1), F.ceil(F.length("_c") * PREFIX_SHARE).cast("int")).alias("_p"))
    least = F.lit(int(SHORTEST_PREFIX * PREFIX_SHARE))
    each = F.transform(F.sequence(least, F.length("_c")), lambda i: F.substr("_c", F.lit(1), i))
    many = long.where(F.length("_c") >= SHORTEST_PREFIX).select(F.col(b), F.length("_c").alias("_m"), F.explode(each).alias("_p"))
    return one.join(many, "_p").where("_l <= _m").select(a, b)


def _classed(keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, name) as classes of keys with equal names: (class, key), each key once, and (class, name)."""
    sets = keys.groupBy(key).agg(F.array_sort(F.collect_set("_c")).alias("_names"))
    return sets.select(F.col("_names").alias("_class"), key), sets.select("_names").distinct().select(F.col("_names").alias("_class"), F.explode("_names").alias("_c"))


def _listed(members: DataFrame, key: str) -> DataFrame:
    """The keys of each class (class, key) as lists of at most LIST of them: class, list."""
    part = F.floor((F.row_number().over(Window.partitionBy("_class").orderBy(key)) - 1) / LIST)
    return members.withColumn("_part", part).groupBy("_class", "_part").agg(F.collect_list(key).alias(key)).select("_class", key)


def name_links(left: DataFrame, right: DataFrame, a: str, left_name: str, b: str, right_name: str) -> DataFrame:
    """All pairs (a, b) of which one name is within the other or which begin alike; no others are looked at but those sharing a key.

    Each name is compared once, however many rows have it; only links that were found are
    expanded to rows. Until then rows with equal names are lists, and pairs of lists are
    dealt over all tasks: a pair of rows is made by its task, never joined, sorted or shuffled.
    """
    one, xs = _classed(_keys(left, a, left_name), a)
    two, ys = _classed(_keys(right, b, right_name), b)
    x, y = xs.select(F.col("_c").alias("_x"), "_c").distinct(), ys.select(F.col("_c").alias("_y"), "_c").distinct()
    swap = lambda df: df.select("_x", "_y")
    links = _within(x, y, "_x", "_y").union(swap(_within(y, x, "_y", "_x"))).union(_beginning(x, y, "_x", "_y")).union(swap(_beginning(y, x, "_y", "_x"))).distinct()
    pairs = links.join(xs.select("_class", F.col("_c").alias("_x")), "_x").join(ys.select(F.col("_class").alias("_class2"), F.col("_c").alias("_y")), "_y")
    pairs = pairs.select("_class", "_class2").distinct()
    met = pairs.join(_listed(one, a), "_class").join(_listed(two, b).withColumnRenamed("_class", "_class2"), "_class2").select(F.col(a).alias("_as"), F.col(b).alias("_bs"))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    chunks = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CHUNK).cast("int")), lambda i: F.slice(c, i * CHUNK + 1, F.lit(CHUNK)))).alias(c)
    few = met.repartition(tasks).select(chunks("_as"), "_bs").select("_as", chunks("_bs"))
    few = few.coalesce(tasks)  # merges nothing: Spark buffers what one row is expanded to up to the next such step, which would be a million rows
    return few.select(F.explode("_as").alias(a), "_bs").select(a, F.explode("_bs").alias(b))


def matched(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Each row of ``left`` (a, name, states) with the institution of ``right`` (b, holder, states, size) it is: a, b, phase, status.

    Phase 1 takes candidates whose holder has the same name, phase 2, for rows that phase 1
    has no candidate for, those with linked names. Among candidates whose states overlap the
    row's the largest is taken (ties: refused, ``tied``); none overlaps: ``state``. A row
    without states takes its only candidate, of several none (``ambiguous``). No candidate:
    ``none``, phase null. ``states`` are arrays; nulls in them don't count. Rows with equal
    names and states are judged as one, which the smallest of them stands for.
    """
    own = left.groupBy(a).agg(F.array_sort(F.collect_list(F.struct("name", "states"))).alias("_rows"))
    classes = own.groupBy("_rows", F.col(a).isNull().alias("_none")).agg(F.min(a).alias("_rep"))
    members = own.select(a, "_rows", F.col(a).isNull().alias("_none")).join(classes, ["_rows", "_none"]).select(a, "_rep")
    found = _judged(classes.where("not _none").select(F.col("_rep").alias(a), F.inline("_rows")), right, a, b)
    return members.join(found.withColumnRenamed(a, "_rep"), "_rep", "left").select(a, b, "phase", F.coalesce("status", F.lit("none")).alias("status"))


def _judged(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of :func:`matched` that have candidates."""
    l = left.select(a, F.col("name").alias("_name"), F.array_compact(F.coalesce("states", F.array().cast("array<string>"))).alias("_ls"))
    r = right.select(b, F.col("holder").alias("_holder"), F.array_compact(F.coalesce("states", F.array().cast("array<string>"))).alias("_rs"), F.col("size").alias("_size"))
    x, y = _keys(left, a, "name"), _keys(right, b, "holder")
    equal = x.join(y, "_c").select(a, b, F.lit(1).alias("phase"))
    rest = left.join(equal, a, "left_anti")
    linked = name_links(rest, right, a, "name", b, "holder").select(a, b, F.lit(2).alias("phase"))
    pairs = equal.union(linked).join(l.drop("_name"), a).join(r.drop("_holder"), b)
    fits = F.arrays_overlap("_ls", "_rs")
    w = Window.partitionBy(a)
    best = F.max(F.when(fits, F.coalesce("_size", F.lit(float("-inf"))))).over(w)
    judged = pairs.withColumns({"_n": F.count("*").over(w), "_fits": F.count_if(fits).over(w), "_best": best, "_ok": fits})
    known = F.size("_ls") > 0
    chosen = F.when(known, F.col("_ok") & (F.coalesce("_size", F.lit(float("-inf"))) == F.col("_best"))).otherwise(F.col("_n") == 1)
    per = judged.groupBy(a, "phase").agg(
        F.count_if(chosen).alias("_c"), F.min(F.when(chosen, F.col(b))).alias(b), F.max("_n").alias("_n"), F.max("_fits").alias("_fits"), F.max(F.size("_ls")).alias("_k"),
    )
    status = F.when(F.col("_c") == 1, "matched").when(F.col("_c") > 1, "tied").when(F.col("_k") == 0, "ambiguous").otherwise("state")
    return per.select(a, F.when(F.col("_c") == 1, F.col(b)).alias(b), "phase", status.alias("status"))


def flags(joins: DataFrame, records: DataFrame, apart: float = 20.0) -> DataFrame:
    """What is doubtful about existing joins: ticker, cert, flag; a join may have several.

    ``joins``: ticker, cert, name, states, assets, cik; ``records``: cert, bank, holder,
    states, multibank, assets. Flags: ``missing`` (no record; the only flag then),
    ``mismatch`` (names don't corroborate), ``state`` (states known on both sides and apart),
    ``size`` (registrant ``apart`` times its only bank, which has no multibank holder),
    ``shared`` (several registrants, by cik or else by name, claim the cert).
    """
    both = joins.where("cert is not null").join(records.select("cert", "bank", "holder", F.col("states").alias("_rs"), "multibank", F.col("assets").alias("_ra"), F.lit(True).alias("_there")), "cert", "left")
    there = F.coalesce("_there", F.lit(False))
    owner = F.coalesce(F.col("cik").cast("string"), F.col("name"))
    claims = F.size(F.collect_set(owner).over(Window.partitionBy("cert")))
    far = (F.size("states") > 0) & (F.size("_rs") > 0) & ~F.arrays_overlap("states", "_rs")
    both = both.withColumns({"_named": corroborated(F.col("name"), F.col("holder"), F.col("bank")), "_claims": claims})
    each = F.array(
        F.when(~there, "missing"), F.when(there & ~F.col("_named"), "mismatch"), F.when(there & far, "state"),
        F.when(there & ~F.coalesce("multibank", F.lit(False)) & (F.col("_ra") > 0) & (F.col("assets") >= apart * F.col("_ra")), "size"), F.when(there & (F.col("_claims") > 1), "shared"),
    )
    return both.select("ticker", "cert", F.explode(F.array_compact(each)).alias("flag"))
