import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import op7_pack as op


class Held:
    def __init__(self):
        with open(op.VOCABULARY, "rb") as f:
            self.value = f.read()


@pytest.fixture(scope="module")
def encode():
    coder = op._encoding(Held())
    return lambda text: coder.encode(text or "", disallowed_special=())


def unpacked(rows, length):
    """All pieces by document and row order, put together again; checks every row's own shape."""
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.token_ids, "<u2")
        assert len(ids) == length and r.n_tokens <= length and (ids[r.n_tokens :] == op.PAD).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert len(r.doc_ids) == len(r.pieces) == len(r.cu_seqlens) - 1
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[d].append((p, ids[a:b].tolist()))
    return pieces


def test_round_trip_of_all_documents(spark, small, documents, encode):
    rows = op.query(spark, small).collect()
    pieces = unpacked(rows, op.LENGTH)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own)))
        assert sum((x for _, x in own), []) == encode(texts[d])
    full = sum(r.n_tokens for r in rows)
    assert full > 0.9 * len(rows) * op.LENGTH or len(rows) < 10
    assert len({r.pack_id for r in rows}) == len(rows)


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.choice([0, 1, 5, 20, 21, 32, rng.randrange(33)]) for _ in range(rng.randrange(200))]
        space, rows = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [s for s in space if s >= sizes[k]]
            if fits:
                at = space.index(min(fits))
                space[at] -= sizes[k]
            else:
                space.append(32 - sizes[k])
        rows = op.pack(sizes, 32)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
        assert sorted(32 - sum(sizes[k] for k in r) for r in rows) == sorted(space)


def test_nulls_empty_long_and_repeated(spark, docs, encode):
    long = "many words and more " * 5000
    rows = op.packed(docs([(1, None), (2, ""), (3, long), (4, "twice"), (4, "twice"), (None, "no id")]), length=128).collect()
    pieces = unpacked(rows, 128)
    assert pieces[1] == [(0, [])] and pieces[2] == [(0, [])]
    assert sum((x for _, x in sorted(pieces[3])), []) == encode(long)
    assert pieces[4] == [(0, encode("twice"))] * 2 and pieces[None] == [(0, encode("no id"))]


def test_small_buffers_and_no_rows(spark, docs, encode):
    pairs = [(k, "word " * (k % 50)) for k in range(300)]
    pieces = unpacked(op.packed(docs(pairs), length=64, buffer=500).collect(), 64)
    assert all(sum((x for _, x in sorted(pieces[k])), []) == encode(t) for k, t in pairs)
    assert op.packed(docs([])).collect() == []


def test_position_ids(spark, docs):
    (row,) = op.packed(docs([(1, "a b c"), (2, "d e")]).coalesce(1), length=16).collect()
    wanted = np.concatenate([np.arange(b - a) for a, b in zip(row.cu_seqlens, [*row.cu_seqlens[1:], 16])])
    assert (op.position_ids(row, 16) == wanted).all()


def test_matrix_files(spark, docs, tmp_path):
    rows = op.packed(docs([(k, "some words here " * k) for k in range(40)]), length=64).persist()
    held = {r.pack_id: r for r in rows.collect()}
    manifest = op.write_matrices(rows, f"file://{tmp_path}/ids", 64).collect()
    seen = 0
    for m in manifest:
        with open(m.file.removeprefix("file://"), "rb") as f:
            data = f.read()
        ids = np.frombuffer(data, "<u2").reshape(m.rows, m.columns)
        assert zlib.crc32(data) == m.crc32
        ends = iter(np.split(np.array(m.cu_seqlens), np.cumsum(m.counts)[:-1]))
        for name, row in zip(m.pack_ids, ids):
            assert row.tobytes() == held[name].token_ids and next(ends).tolist() == held[name].cu_seqlens
            seen += 1
    assert seen == len(held)


BLANKS = " " * 1_200_000


@pytest.mark.parametrize(
    "text",
    ["a" + BLANKS + "b", BLANKS, "a" + BLANKS, BLANKS + "b", "a" + "\n" * 5_000_000 + "b", "x " + " \n\t\u3000" * 400_000 + "\nend", "one" + BLANKS + "two" + BLANKS + "\nthree", "\u00a0" * 1_100_000 + "9"],
    ids=lambda t: f"{len(t)}",
)
def test_long_blanks(spark, docs, text):
    from regex import compile as pattern

    # words as the pattern has them, by a matcher that copes with such runs, each encoded by itself
    coder, wanted = op._encoding(Held()), []
    space = op._BLANK
    words = pattern(op.PATTERN.replace(r"[^\s", "[^" + space[1:-1]).replace(r"\s", space).replace(r"\S", "[^" + space[1:]))
    for w in words.finditer(text):
        wanted += coder._encode_single_piece(w.group())
    assert coder.decode(wanted) == text
    assert op.token_ids(coder, text).tolist() == wanted
    rows = op.packed(docs([(1, text)])).collect()
    assert sum((x for _, x in sorted(unpacked(rows, op.LENGTH)[1])), []) == wanted


def test_cut_at_any_run_gives_the_same_ids(monkeypatch, encode):
    rng = random.Random(8)
    monkeypatch.setattr(op, "LONG_RUN", 2)
    monkeypatch.setattr(op, "_LONG_BLANK", __import__("re").compile(f"(?<!{op._BLANK}){op._BLANK}{{2}}{op._BLANK}*"))
    for _ in range(500):
        text = "".join(rng.choice([" ", "  ", "\n", "\t ", "\u2003", "ab", "7", "don't", "!", "\x1c", "\u200b"]) for _ in range(rng.randrange(30)))
        assert op.token_ids(op._encoding(Held()), text).tolist() == encode(text)


def test_files_of_bounded_size_come_back(spark, docs, tmp_path):
    rows = op.packed(docs([(k, "some words here " * (k % 40)) for k in range(300)] + [(None, None), (7, "twice"), (7, "twice")]), length=64, buffer=2000).persist()
    manifest = op.write_matrices(rows, f"file://{tmp_path}/ids", 64, file_bytes=20 * 128)
    manifest.write.parquet(f"{tmp_path}/manifest")
    manifest = spark.read.parquet(f"{tmp_path}/manifest")
    files = manifest.collect()
    assert len(files) > 5 and all(m.rows <= 20 for m in files)
    back = op.read_matrices(manifest)
    assert back.schema == rows.schema
    key = lambda r: r.pack_id
    assert sorted(back.collect(), key=key) == sorted(rows.collect(), key=key)
    with open(files[0].file.removeprefix("file://"), "r+b") as f:
        f.write(b"\x01\x02\x03\x04")
    with pytest.raises(Exception, match="damaged"):
        back.collect()
    assert op.stored(docs([])).collect() == []
