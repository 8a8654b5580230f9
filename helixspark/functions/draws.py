"""Strands of texts and noisy copies of strands for whole Arrow batches: the MD5 draws of many bases advance one round at a time together."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_SHIFTS = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Draws that are worked on together, and letters of strands.
_LANES, _LETTERS = 1 << 15, 1 << 20
_BASES = np.frombuffer(b"ACGT", np.uint8)
_OTHERS, _UPPER = bytes(set(range(256)) - set(b"ACGTacgt")), bytes.maketrans(b"acgt", b"ACGT")
_ALIGNED = StructType().add("ref_row", StringType()).add("read_row", StringType())
_READS = ArrayType(StructType().add("read_idx", IntegerType()).add("read", StringType()))
_ROWS = ArrayType(StructType().add("read_idx", IntegerType()).add("ref_row", StringType()).add("read_row", StringType()))


def strands_in(length: int):
    """A function of a text: its A, C, G and T letters, in upper case, in strands of ``length``; the last one goes on with
    the letters from their start until it is full. A text without letters has none."""
    def cut(text: str | None) -> list[str]:
        s = (text or "").encode("utf-8", "replace").translate(_UPPER, _OTHERS).decode("ascii")
        whole = s + s * -(-length // max(1, len(s)))
        return [whole[at : at + length] for at in range(0, len(s), length)]

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([cut(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return run


def md5_head(words: list, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of messages of one block, given as 16 words: numbers, or arrays that fit ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[_WORDS[i]]
        if isinstance(word, int):
            f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[i])
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        f <<= np.uint32(_SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _messages(heads: np.ndarray, places: np.ndarray) -> list:
    """The 16 words of head + place (of one number of digits) for each pair of heads and places: bytes, one row a head."""
    size = heads.shape[1]
    digits = np.array([list(str(p).encode()) for p in places.tolist()], np.uint8)
    total = size + digits.shape[1]
    if total > 55:
        raise ValueError("a key of a draw fits one block")
    own, rest = np.zeros((len(heads), 64), np.uint8), np.zeros((len(places), 64), np.uint8)
    own[:, :size], rest[:, size:total], rest[:, total] = heads, digits, 0x80
    own, rest = own.view("<u4"), rest.view("<u4")
    out: list = []
    for w in range(16):
        if w * 4 >= size:  # nothing of the head
            out.append(rest[:, w, None] if w * 4 <= total else 0)
        else:
            out.append(own[None, :, w] if w * 4 + 4 <= size else own[None, :, w] | rest[:, w, None])
    out[14] = total * 8
    return out


def _draws(heads: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words, bytes swapped, of md5(head + place) for places 1 to length, a row a head."""
    first, second = (np.zeros((len(heads), length), np.uint32) for _ in range(2))
    sizes = np.array([len(x) for x in heads])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        texts = np.frombuffer(b"".join(heads[r] for r in rows), np.uint8).reshape(len(rows), size)
        for lo in range(0, len(rows), _LANES):
            some = rows[lo : lo + _LANES]
            step, low = max(1, _LANES // len(some)), 1
            while low <= length:
                high = min(low + step - 1, length, 10 ** len(str(low)) - 1)
                places = np.arange(low, high + 1)
                x, y = md5_head(_messages(texts[lo : lo + _LANES], places), (len(places), len(some)))
                first[some, low - 1 : high], second[some, low - 1 : high] = x.byteswap().T, y.byteswap().T
                low = high + 1
    return first, second


def _strings(letters: np.ndarray) -> pa.Array:
    """A string a row, of the letters that are not 0."""
    there = letters != 0
    offsets = np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(letters), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters[there]))])


def _pieces(strands: list[bytes], heads: list[bytes], rates: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own letter, what stands for it, what is inserted after it) of all bases, a row a strand; 0 where there is none."""
    sizes = np.array([len(x) for x in strands])
    length = int(sizes.max(initial=0))
    own = np.zeros((len(strands), length), np.uint8)
    inside = np.arange(length) < sizes[:, None]
    own[inside] = np.frombuffer(b"".join(strands), np.uint8)
    number = np.full(256, 255, np.uint8)
    number[_BASES] = np.arange(4)
    x, y = _draws(heads, length)
    shifted = _BASES[(number[own] + 1 + (y >> 8 & 15) % 3) % 4]
    deletion, substitution, insertion = rates
    kept = np.where(x >> 16 < deletion, 0, np.where(x & 0xFFFF < substitution, shifted, own)).astype(np.uint8)
    more = np.where(y >> 16 < insertion, _BASES[y >> 12 & 3], 0).astype(np.uint8)
    return own, np.where(inside, kept, 0).astype(np.uint8), np.where(inside, more, 0).astype(np.uint8)


def _each(strand: pa.Array, key: pa.Array, rates: tuple[int, int, int], make) -> list:
    """make(own, kept, more) for parts of a batch that have some million letters."""
    strands = [x.encode("ascii") for x in strand.fill_null("").to_pylist()]
    heads = [x.encode("ascii") + b":" for x in key.to_pylist()]
    step = max(1, _LETTERS // max(1, max(map(len, strands), default=1)))
    return [make(*_pieces(strands[lo : lo + step], heads[lo : lo + step], rates)) for lo in range(0, len(strands), step)]


def _joined(parts: list, strand: pa.Array) -> pa.Array:
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return pc.if_else(strand.is_valid(), out, pa.scalar(None, pa.string()))


def noisy(deletion: int, substitution: int, insertion: int):
    """A function of a strand of ASCII letters and its key: a copy with errors.

    The draws of base p are slices of md5(key:p): deletion first, a substitution only if the base stays, an insertion in
    any case; thresholds of 65,536. Each base draws the same numbers whatever the rates, so higher rates only add errors.
    """
    @F.arrow_udf(StringType())
    def run(strand: pa.Array, key: pa.Array) -> pa.Array:
        return _joined([x for (x,) in _each(strand, key, (deletion, substitution, insertion), _one_row)], strand)

    return run


def _one_row(own, kept, more) -> tuple[pa.Array]:
    return (_strings(np.stack([kept, more], axis=2).reshape(len(own), -1)),)


def _two_rows(own, kept, more) -> tuple[pa.Array, pa.Array]:
    gap = ord("-")
    ref = np.stack([own, np.where(more != 0, gap, 0)], axis=2).astype(np.uint8)
    read = np.stack([np.where((own != 0) & (kept == 0), gap, kept), more], axis=2).astype(np.uint8)
    return _strings(ref.reshape(len(own), -1)), _strings(read.reshape(len(own), -1))


def noisy_clusters(deletion: int, substitution: int, insertion: int, aligned: bool = False):
    """A function of a strand, its number and a number of copies: the list of the copies (read_idx from 0) that ``noisy``
    (``aligned``: ``noisy_aligned``) makes with the keys number:read_idx."""
    make, names = (_two_rows, ["ref_row", "read_row"]) if aligned else (_one_row, ["read"])

    @F.arrow_udf(_ROWS if aligned else _READS)
    def run(strand: pa.Array, number: pa.Array, copies: pa.Array) -> pa.Array:
        n = np.maximum(copies.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        first = np.concatenate(([0], np.cumsum(n)))
        index = np.arange(first[-1]) - np.repeat(first[:-1], n)
        each = strand.take(pa.array(np.repeat(np.arange(len(n)), n)))
        keys = [f"{c}:{i}" for c, m in zip(number.to_pylist(), n.tolist(), strict=True) for i in range(m)]
        parts = _each(each, pa.array(keys, pa.string()), (deletion, substitution, insertion), make)
        columns = [_joined([p[k] for p in parts], each) for k in range(len(names))]
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(index.astype(np.int32)), *columns], names=["read_idx", *names]))

    return run


def noisy_aligned(deletion: int, substitution: int, insertion: int):
    """The same copy and its strand as two rows of one length, gaps where one of them has no letter."""
    @F.arrow_udf(_ALIGNED)
    def run(strand: pa.Array, key: pa.Array) -> pa.Array:
        parts = _each(strand, key, (deletion, substitution, insertion), _two_rows)
        return pa.StructArray.from_arrays([_joined([p[k] for p in parts], strand) for k in range(2)], names=["ref_row", "read_row"])

    return run


def _first_drawn(heads: list[bytes], n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of each head, which of the places 1 to n are the ``most`` first by md5(head + place): a row a head.

    The first 64 bits decide; rows in which two places share them there, and heads of over one block, take the whole digests.
    """
    wide = int(n.max())
    drawn, own = np.zeros((len(heads), wide), bool), np.arange(wide) < n[:, None]
    short = np.array([len(h) + len(str(wide)) <= 55 for h in heads])
    at = np.flatnonzero(short)
    if len(at):
        first, second = _draws([heads[i] for i in at.tolist()], wide)
        keys = np.where(own[at], first.astype(np.uint64) << np.uint64(32) | second, np.uint64(0xFFFFFFFFFFFFFFFF))
        last = np.take_along_axis(np.sort(keys, axis=1), most[at, None] - 1, axis=1)
        drawn[at] = (keys <= last) & own[at]
    for i in np.flatnonzero(drawn.sum(axis=1) != most).tolist():
        order = sorted(range(int(n[i])), key=lambda p: (hashlib.md5(heads[i] + str(p + 1).encode()).digest(), p))
        drawn[i] = False
        drawn[i, order[: int(most[i])]] = True
    return drawn


def fitted(low: int, high: int):
    """A function of a read and a key: the read with ``low`` to ``high`` letters, at places drawn by md5(key:place). Of a longer
    one letters go, and a shorter one gets an A before letters, or at its end where it has not enough."""
    @F.arrow_udf(StringType())
    def run(reads: pa.Array, keys: pa.Array) -> pa.Array:
        out, names = reads.to_pylist(), keys.to_pylist()
        odd = [i for i, x in enumerate(out) if x is not None and not low <= len(x) <= high]
        for i in odd:
            if not out[i] or names[i] is None:
                out[i] = out[i].ljust(low, "A")
        odd = sorted((i for i in odd if out[i] and names[i] is not None and not low <= len(out[i]) <= high), key=lambda i: len(out[i]))
        while odd:  # the longest ones first, some million letters at a time
            step = max(1, _LETTERS // len(out[odd[-1]]))
            some, odd = odd[-step:], odd[:-step]
            n = np.array([len(out[i]) for i in some])
            most = np.where(n > high, n - high, np.minimum(n, low - n))
            row, place = np.nonzero(_first_drawn([names[i].encode() + b":" for i in some], n, most))
            bounds = np.searchsorted(row, np.arange(len(some) + 1)).tolist()
            place = place.tolist()
            for k, i in enumerate(some):
                x, at = out[i], place[bounds[k] : bounds[k + 1]]
                cuts = zip([0, *(p + 1 for p in at)] if len(x) > high else [0, *at], [*at, len(x)], strict=True)
                out[i] = ("" if len(x) > high else "A").join([x[a:b] for a, b in cuts]).ljust(low, "A")
        return pa.array(out, pa.string())

    return run
