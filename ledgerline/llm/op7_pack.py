"""Token ids of documents, packed into rows of equal length by best-fit decreasing.

Each task tokenises its documents, cuts those longer than a row into pieces of a row and
a rest, and packs buffers of about ``BUFFER`` tokens: longest segment first, each into the
row with the least space that still holds it. A segment tree over the spaces 0 to L finds
that row. Nothing is shuffled, memory follows the buffer, and a task that is run again
gives the same rows.

Rows are written as matrix files of bounded size, each with an Arrow file beside it that
holds cumulative segment lengths, position resets and the segments' documents. The written
manifest says which files count; query and pipeline return the rows read back from them.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.workspace import folder

from .scratch import written
from .storage import NewFile, place
from .words import slices

NAME = "op7_pack"
ORACLE_SQL = None
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
PAD = 50256
BUFFER = 4 << 20
FILE_BYTES = 64 << 20
LONG_RUN = 100_000

# Fixed value: the vocabulary's public splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters of the pattern's class of white space.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANK = re.compile(f"(?<!{_BLANK}){_BLANK}{{{LONG_RUN}}}{_BLANK}*")


class Spaces:
    """Open rows by the space they have left: a segment tree whose leaves are the spaces 0 to ``length``."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.filled = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        node = space + self.width
        while node:
            self.filled[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes a row with the least space of ``need`` or more: (row, space)."""
        node, filled = need + self.width, self.filled
        if not filled[node]:
            while node > 1 and not (node & 1 == 0 and filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        space = node - self.width
        row = self.rows[space].pop()
        while node:
            filled[node] -= 1
            node >>= 1
        return row, space


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Segments by row, by best-fit decreasing; of equal sizes the earlier goes first. Segments of size 0 take no space."""
    rows: list[list[int]] = []
    spaces = Spaces(length)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = spaces.take(sizes[k])
        if found is None:
            found = len(rows), length
            rows.append([])
        rows[found[0]].append(k)
        spaces.add(found[1] - sizes[k], found[0])
    return rows


_encodings: dict = {}


def _encoding(vocabulary):
    """The tokenizer, built once in each worker from the broadcast file."""
    import tiktoken

    if vocabulary.value not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        _encodings[vocabulary.value] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary.value]


def token_ids(encoding, text: str) -> np.ndarray:
    """The tokenizer's ids of a text of any kind.

    The pattern backtracks over runs of white space and fails on very long ones. Such a
    run is one word of the pattern, without its last character where text follows; it is
    encoded by itself, and the text is cut at its ends, where no word reaches across.
    """
    ids, at = [], 0
    for run in _LONG_BLANK.finditer(text) if len(text) >= LONG_RUN else ():
        end = run.end() - (run.end() < len(text))
        ids.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        ids.append(np.array(encoding._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    ids.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(ids).astype("<u2") if len(ids) > 1 else ids[0].astype("<u2")


SCHEMA = "pack_id string, token_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"
_ARROW = pa.schema(
    [("pack_id", pa.string()), ("token_ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))]
)


def _packed(batches: Iterator[pa.RecordBatch], vocabulary, length: int, pad: int, buffer: int) -> Iterator[pa.RecordBatch]:
    encode, kind = _encoding(vocabulary), np.dtype("<u2")
    task, count = TaskContext.get().partitionId(), 0
    segments: list[tuple[int | None, int, np.ndarray]] = []
    held = 0

    def rows():
        nonlocal count
        out = []
        for chosen in pack([len(x) for _, _, x in segments], length):
            own = [segments[k] for k in chosen]
            ends = np.concatenate([[0], np.cumsum([len(x) for _, _, x in own])]).astype(np.int32)
            ids = np.full(length, pad, kind)
            ids[: ends[-1]] = np.concatenate([x for _, _, x in own])
            out.append((f"{task:06d}-{count:08d}", ids.tobytes(), int(ends[-1]), ends, ends[:-1], [d for d, _, _ in own], [p for _, p, _ in own]))
            count += 1
        for a in range(0, len(out), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 512]), _ARROW.types)], schema=_ARROW)

    for batch in batches:
        for part in slices(batch, "text"):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = token_ids(encode, text or "")
                for p, a in enumerate(range(0, max(1, len(ids)), length)):
                    segments.append((doc, p, ids[a : a + length]))
                held += len(ids) + 16
            if held >= buffer:
                yield from rows()
                segments, held = [], 0
    yield from rows()


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, pad: int = PAD, buffer: int = BUFFER) -> DataFrame:
    """Rows of ``length`` token ids from ``docs`` (doc_id, text).

    token_ids: little-endian 16-bit ids, ``pad`` after the first n_tokens; cu_seqlens: 0
    and the end of each segment; position_resets: where positions start again at 0, at
    every segment's start; doc_ids, pieces: each segment's document and number within it,
    from 0. A document's pieces in order, put together, are all its ids. A null or empty
    text is a segment of length 0 at its document's place. Repeated rows are packed each,
    further columns ignored; an empty table gives no rows. ``vocabulary``: path of a
    ranks file with ids below 65,536; read by the driver and broadcast (its size is fixed).
    """
    spread = _spread(docs, vocabulary)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _packed(it, spread, length, pad, buffer), SCHEMA)


def _spread(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def position_ids(row, length: int = LENGTH) -> np.ndarray:
    """Positions of a packed row's ids: from 0 in each segment, and in the padding."""
    out = np.arange(length)
    starts = np.array([*row["position_resets"], row["n_tokens"]])
    lengths = np.diff([*starts, length])
    return out - np.repeat(starts, lengths)


MANIFEST = "file string, index string, rows long, columns long, crc32 long, pack_ids array<string>, cu_seqlens array<int>, counts array<int>"


def _files(batches: Iterator[pa.RecordBatch], folder: str, length: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes a task's packed rows; the manifest's rows."""
    named = [f.name for f in _ARROW if f.name != "token_ids"]
    index_schema = pa.schema([_ARROW.field(n) for n in named])
    file = index = sink = None
    crc, held = 0, []

    def closed():
        file.close()
        sink.close()
        index.close()
        own = pa.Table.from_batches(held, index_schema)
        ends = own.column("cu_seqlens").combine_chunks()
        return pa.RecordBatch.from_pydict(
            {
                "file": [file.uri], "index": [index.uri], "rows": [own.num_rows], "columns": [length], "crc32": [crc], "pack_ids": [own.column("pack_id").to_pylist()],
                "cu_seqlens": pa.array([ends.flatten()], pa.list_(pa.int32())), "counts": pa.array([np.diff(ends.offsets.to_numpy())], pa.list_(pa.int32())),
            }
        )

    most = max(1, file_bytes // (2 * length))
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if file is None:
                stem = f"ids-{TaskContext.get().partitionId():06d}"
                file, index, crc, held, left = NewFile(folder, stem, ".bin"), NewFile(folder, stem, ".arrow"), 0, [], most
                sink = pa.ipc.new_stream(index, index_schema)
            part = batch.slice(at, left)
            for data in part.column("token_ids"):
                file.write(data.as_buffer())
                crc = zlib.crc32(data.as_buffer(), crc)
            held.append(pa.RecordBatch.from_arrays([part.column(n) for n in named], schema=index_schema))
            sink.write_batch(held[-1])
            at, left = at + part.num_rows, left - part.num_rows
            if not left:
                yield closed()
                file = None
    if file:
        yield closed()


def write_matrices(rows: DataFrame, folder: str, length: int = LENGTH, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes packed rows under a URI, as matrix files (rows of ``length`` 16-bit ids) of at most ``file_bytes``; returns the manifest.

    Beside each matrix an Arrow file holds, row by row, pack_id, n_tokens, cu_seqlens,
    position_resets, doc_ids and pieces. The manifest, one row per matrix, has the URIs of
    both, rows, columns, CRC-32 of the ids and, row by row, pack_ids, cu_seqlens (all
    rows' one after another) and the count of each row's.
    """
    return rows.select(_ARROW.names).mapInArrow(lambda it: _files(it, folder, length, file_bytes), MANIFEST)


def read_matrices(manifest: DataFrame) -> DataFrame:
    """The packed rows of the files that a manifest names, as :func:`packed` gives them. A matrix of another size or CRC-32 is an error."""

    def parse(batches):
        for b in batches:
            for uri, index, rows, columns, crc in zip(*(b.column(c).to_pylist() for c in ("file", "index", "rows", "columns", "crc32"))):
                (where, path), (_, beside) = place(uri), place(index)
                seen = found = 0
                with where.open_input_stream(path, compression=None) as ids, where.open_input_stream(beside, compression=None) as own:
                    for part in pa.ipc.open_stream(own):
                        data = ids.read(2 * columns * part.num_rows)
                        seen, found = zlib.crc32(data, seen), found + part.num_rows
                        if len(data) != 2 * columns * part.num_rows:
                            raise ValueError(f"{uri} ends within a row")
                        matrix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * columns), part.num_rows, [None, pa.py_buffer(data)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([part.column("pack_id"), matrix, *part.columns[1:]], schema=_ARROW)
                    if ids.read(1) or seen != crc or found != rows:
                        raise ValueError(f"{uri} is damaged")

    files = manifest.count()
    return manifest.select("file", "index", "rows", "columns", "crc32").repartition(max(1, min(files, 100_000)), "file").mapInArrow(parse, SCHEMA)


def stored(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, pad: int = PAD, buffer: int = BUFFER, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The packed rows of ``docs``, as :func:`packed` gives them, written as matrix files to the shared folder by the tasks that pack them, and read back."""
    spread, where = _spread(docs, vocabulary), folder(docs.sparkSession, "matrices")
    made = docs.select("doc_id", "text").mapInArrow(lambda it: _files(_packed(it, spread, length, pad, buffer), where, length, file_bytes), MANIFEST)
    return read_matrices(written(made, "manifest"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed rows, as read back from their matrix files. Null and empty texts are segments without tokens, repeated rows are packed each."""
    return stored(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
