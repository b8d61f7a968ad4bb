import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerline.llm import op12_prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, node string, place int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    return {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}


def brute(rows):
    own, paths = ordered(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = [n for n in below if not any(x[: len(n)] == n and len(x) > len(n) for x in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), sum(len(n) == len(node) + 1 for n in below), len(childless), saved, sha(ends)))
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "n", 7) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in op.query(spark, str(tmp_path)).select(columns).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_every_prefix(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 200), 60):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bé", "a long turn"])))
    rows += [(None, 0, "user", "no id"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_copies_a_long_path_and_turnless_ones(spark, tmp_path):
    rows = [(c, t, "u", f"t{t}") for c in range(1000, 1060) for t in range(3)]  # a first turn of a third of all
    rows += [(5, t, "u", f"long {t % 7}") for t in range(300)]
    rows += [(c, 0, "u", "lone") for c in range(201, 400, 5)]  # without a base: those cut to no turn end at the root
    wanted = brute(rows)
    assert found(spark, rows, tmp_path) == wanted
    assert any(r[1] == 0 and r[7] != sha("") for r in wanted)


def test_no_conversations(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_roles_and_texts_do_not_run_together(spark):
    df = spark.createDataFrame([(1, 0, "a", "bc", "", 0), (2, 0, "ab", "c", "", 0)], SCHEMA)
    assert op.turns(df).select("digest").distinct().count() == 2
