import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op4_compaction as op


@pytest.fixture
def store(spark, tmp_path):
    return lambda **k: op.ShardStore(spark, f"file://{tmp_path}/shards", **k)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip(docs):
    table = docs([(k, f"text {k}" * (k % 9)) for k in range(200)] + [(None, None), (3, "twice"), (3, "twice"), (-5, "")])
    back = op.round_trip(table)
    assert back.columns == table.columns and rows(back) == rows(table)
    assert rows(op.round_trip(docs([]))) == []


def test_tiers_merge_and_versions_stay_readable(spark, docs, store):
    s = store(target=1 << 20, small=1 << 10)
    everything = docs([(k, f"text {k}") for k in range(120)])
    for k in range(6):
        s.append(everything.where(F.col("doc_id") % 6 == k).coalesce(1))
    before, shards = s.version, s.shards().count()
    old = rows(s.read(everything.schema))
    assert before == 6 and shards == 6 and old == rows(everything)
    s.compact(everything.schema)
    assert s.version > before and s.shards().count() < shards
    assert rows(s.read(everything.schema)) == old
    assert rows(s.read(everything.schema, before)) == old  # a reader of the old version isn't disturbed
    assert {tuple(r) for r in s.shards().agg(F.sum("rows")).collect()} == {(120,)}


def test_large_shards_are_left_alone(spark, docs, store):
    s = store(target=1000, small=100)
    table = docs([(k, f"text {k}" * 50) for k in range(400)])
    s.append(table.repartition(8))
    assert s.compact(table.schema) == 1


def test_below_the_fan_out_nothing_moves(docs, store):
    s = store()
    for k in range(op.FANOUT - 1):
        s.append(docs([(k, "a")]).coalesce(1))
    assert s.compact(docs([]).schema) == op.FANOUT - 1


def test_of_two_writers_one_fails_and_changes_nothing(docs, store):
    a, b = store(), store()
    table = docs([(1, "a")]).coalesce(1)
    a.append(table)
    with pytest.raises(op.VersionTaken):
        b.append(docs([(2, "b")]).coalesce(1))
    assert [r[0] for r in store().read(table.schema).select("doc_id").collect()] == [1]
    b = store()
    b.append(docs([(2, "b")]).coalesce(1))
    assert sorted(r[0] for r in store().read(table.schema).select("doc_id").collect()) == [1, 2]


def test_vacuum_deletes_only_what_no_kept_version_names(docs, store):
    s = store(target=1 << 20, small=1 << 10)
    table = docs([(k, "t") for k in range(40)])
    for k in range(4):
        s.append(table.where(F.col("doc_id") % 4 == k).coalesce(1))
    s.compact(table.schema)
    assert s.vacuum(keep=2, age=0) == 0
    assert s.vacuum() == 0  # files younger than a day may be an append that is yet to commit
    assert s.vacuum(age=0) == 4
    assert rows(s.read(table.schema)) == rows(table)
