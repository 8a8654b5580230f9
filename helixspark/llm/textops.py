"""NumPy helpers that run inside Spark tasks: UTF-8 buffers, word hashes, shingles and packed exchange blobs.

Everything works on one Arrow batch at a time, in slices of about ``SLICE`` bytes, so that a task's memory does not
depend on the size of its partition (one document longer than a slice is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_C = np.uint64(0xD6E8FEB86659FD93)

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Byte classes of the two word definitions: not ASCII white space; ASCII letters and digits or anything not ASCII.
NON_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1024)
        ones = np.full(size, base, dtype=np.uint64)
        ones[0] = 1
        have = _powers[name] = np.multiply.accumulate(ones)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so different inputs stay different."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial of codes[i:j] times R**i."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power(_R, len(codes), "r"), out=out[1:])
    return out


def inverse_powers(n: int) -> np.ndarray:
    return _power(_RINV, n, "rinv")


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power(_RINV, len(prefix), "rinv")[start] + (end - start).astype(np.uint64) * _C)


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
    """Word hashes, byte starts and ends, and the first word of each row (with the total at the end)."""
    if lower:
        buf = LOWER[buf]
    inside = kind[buf]
    filled = offsets[1:] > offsets[:-1]
    before = np.zeros(len(buf), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(buf), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    prefix = prefix_hash(buf.astype(np.uint64) + np.uint64(1))
    return span_hash(prefix, start, end), start, end, np.searchsorted(start, offsets)


def ngrams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, at the run's first word (runs may cross rows; the caller masks those)."""
    total = len(word_hash) - n + 1
    if total <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(total, dtype=np.uint64)
    for j in range(n):
        out = out * _C + word_hash[j : j + total]
    return mix(out + np.uint64(n))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none no shingle."""
    h, _, _, first = words(buf, offsets, NON_SPACE)
    grams = ngrams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(ngrams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def packed(buckets: np.ndarray, rows: np.ndarray, key: str = "bucket") -> pa.RecordBatch | None:
    """One row for each bucket that occurs: its number, and the bytes of its records."""
    if not len(rows):
        return None
    order = np.argsort(buckets, kind="stable")
    rows, buckets = rows[order], buckets[order]
    cut = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    ends = np.append(cut[1:], len(rows))
    blobs = [rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(buckets[cut].astype(np.int32)), pa.array(blobs, pa.binary())], names=[key, "data"])


def unpacked(column, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() if hasattr(x, "as_py") else x for x in column), dtype=dtype)
