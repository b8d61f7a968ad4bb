"""Words of many texts at once, as 64-bit hashes, from the UTF-8 bytes of an Arrow column.

All delimiters are ASCII, so bytes can be classed one by one. A word's hash is a
polynomial over its lower-cased (A-Z only) bytes, mixed; equal words have equal hashes
and, in a corpus of 10 million distinct words, some two differ with equal hashes with
probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_SLICE = 1 << 20
_K = U(0xD6E8FEB86659FD93)

#: Bytes that end a word: the classes [\x20\x09-\x0D] and [\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: int) -> np.ndarray:
    out = np.full(_SLICE, U(base), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_tables: dict = {}


def _table(name):
    if name not in _tables:
        if name == "pow":
            _tables[name] = _powers(_P)
        elif name == "inv":
            _tables[name] = _powers(_PINV)
        else:
            delimiters, lower = name
            values = (LOWER if lower else np.arange(256)).astype(U) + U(1)
            values[np.frombuffer(delimiters, np.uint8)] = 0
            _tables[name] = values
    return _tables[name]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of a column: byte ranges, document and hash (of the lower-cased word, unless ``lower`` is false) of each, and where each document's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, delimiters: bytes, lower: bool = True):
        values = _table((delimiters, lower))
        self.data, self.offsets, docs = data, offsets, len(offsets) - 1
        inside = (values != 0)[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        at = offsets[:-1][filled]
        first[at] = inside[at]
        at = offsets[1:][filled] - 1
        last[at] = inside[at]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=docs)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = self._hashes(values)

    def _hashes(self, values: np.ndarray) -> np.ndarray:
        data, starts, out = self.data, self.start, np.zeros(len(self.start), U)
        power, inverse = _table("pow"), _table("inv")
        for a in range(0, len(data), _SLICE):
            b = min(len(data), a + _SLICE)
            i, j = np.searchsorted(starts, [a, b])
            terms = values[data[a:b]] * power[: b - a]
            at = starts[i:j] - a
            if j > i:
                out[i:j] += np.add.reduceat(terms, at) * inverse[at]
            if i:  # the rest of a word that began in an earlier slice
                head = int(terms[: at[0] if j > i else b - a].sum())
                if head:
                    out[i - 1 : i] += U(head * pow(_P, a - int(starts[i - 1]), 1 << 64) & _MASK)
        return mix(out)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, lower-cased, between single spaces."""
        return b" ".join(LOWER[self.data[self.start[k] : self.end[k]]].tobytes() for k in range(i, j))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words and the document of each, in order; of a document with fewer words, but some, the whole sequence as one."""
        h, doc = self.hash, self.doc
        if len(h) >= n:
            run = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                run = run * _K + h[k : len(h) - n + 1 + k]
            whole = doc[: len(run)] == doc[n - 1 :]
            run, of = mix(run[whole]), doc[: len(whole)][whole]
        else:
            run, of = np.zeros(0, U), np.zeros(0, np.int64)
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            extra = np.zeros(len(short), U)
            for k, d in enumerate(short):
                total = 0
                for x in h[self.first[d] : self.first[d + 1]]:
                    total = (total * int(_K) + int(x)) & _MASK
                extra[k] = U(total ^ int(self.count[d]))
            run, of = np.concatenate([run, mix(mix(extra))]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            run, of = run[order], of[order]
        return run, of


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with at most ``most`` bytes of text (or one row), so that memory follows neither batch nor group size."""
    lengths = np.diff(flat(batch[column] if isinstance(batch, pa.Table) else batch.column(column))[1])
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 65536]), most, "right")))
        yield batch.slice(at, n)
        at += n
