"""Edit distances and window codes of strands for whole Arrow batches: many strings advance one letter at a time together."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

_CHUNK, _CELLS = 1 << 14, 1 << 21
_PAIRS = ArrayType(StructType().add("i", IntegerType()).add("j", IntegerType()).add("d", IntegerType()))
_WINDOWS = ArrayType(StructType().add("pos", IntegerType()).add("edge", LongType()).add("e", IntegerType()).add("p", IntegerType()).add("s", IntegerType()))
_CHANCES = ArrayType(StructType().add("pos", IntegerType()).add("edge", LongType()).add("forward", DoubleType()).add("reverse", DoubleType()))
_ONE, _TOP, _ALL = np.uint64(1), np.uint64(63), np.uint64(0xFFFFFFFFFFFFFFFF)


def _letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(codes, lengths, letters): a row of letter codes for each string, padded with ``letters``; null counts as empty."""
    values = strings.fill_null("").to_pylist()
    raw = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    n = np.array([len(x) for x in values], np.int64)
    used = np.flatnonzero(np.bincount(raw))
    number = np.zeros(int(used.max(initial=0)) + 1, np.uint16)
    number[used] = np.arange(len(used))
    out = np.full((len(n), max(1, int(n.max(initial=0)))), len(used), np.uint16)
    out[np.arange(out.shape[1]) < n[:, None]] = number[raw]
    return out, n, len(used)


def distances(strings: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs (left[i], right[i]) of strings.

    Bit-parallel columns: the differences between neighbouring cells of a column are bits of 64-bit words, and a letter
    of the right string moves a whole column, for all pairs of a chunk at once.
    """
    codes, n, letters = _letters(strings)
    words = max(1, -(-int(n[left].max(initial=0)) // 64))
    flat, out = _patterns(codes, letters, words), np.zeros(len(left), np.int32)
    step = max(1, min(_CHUNK, _CELLS // max(1, int(n[right].max(initial=0)))))
    for lo in range(0, len(left), step):
        out[lo : lo + step] = _columns(codes, n, flat, letters, words, left[lo : lo + step], right[lo : lo + step])
    return out


def _patterns(codes: np.ndarray, letters: int, words: int) -> np.ndarray:
    """Where each letter stands in each string, as bits: by string, letter and word."""
    wide = np.zeros((len(codes), letters + 1, words), np.uint64)
    for c in range(letters):
        bits = np.zeros((len(codes), words * 64), np.uint8)
        bits[:, : codes.shape[1]] = (codes == c)[:, : words * 64]
        wide[:, c] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return wide.reshape(-1)


def _columns(codes: np.ndarray, n: np.ndarray, flat: np.ndarray, letters: int, words: int, a: np.ndarray, b: np.ndarray, gaps: tuple | None = None) -> np.ndarray:
    """``distances`` of a chunk of pairs. A column's last cell is its first one and the differences below it, so it is
    added up only where a right string ends. gaps takes, by column, word and pair, the cells that are left by a gap in the
    left string, and by one in the right string."""
    size, m, columns = len(a), n[a], n[b]
    at = codes[b, : int(columns.max(initial=0))].T.astype(np.int64)
    at *= words
    at += a * ((letters + 1) * words)
    inside = [np.where(m - 64 * w >= 64, _ALL, (_ONE << np.clip(m - 64 * w, 0, 63).astype(np.uint64)) - _ONE) for w in range(words)]
    plus, minus = [np.full(size, _ALL) for _ in range(words)], [np.zeros(size, np.uint64) for _ in range(words)]
    eq, x, h, hp, hq, up, down, next_up, next_down = (np.zeros(size, np.uint64) for _ in range(9))
    out, shortest = np.where(columns == 0, m, 0), int(columns.min(initial=0))
    for j, place in enumerate(at):
        for w in range(words):
            p, q = plus[w], minus[w]
            np.take(flat[w:], place, out=eq, mode="clip")
            np.bitwise_or(eq, q, out=x)
            if gaps:
                np.invert(eq, out=gaps[1][j, w])
            if w:  # what the word below hands on
                eq |= down
            np.bitwise_and(eq, p, out=h)
            h += p
            h ^= p
            h |= eq
            np.bitwise_or(h, p, out=hp)
            np.invert(hp, out=hp)
            hp |= q
            if gaps:  # no letter of the one on one of the other: the same as before both, and the letters differ
                gaps[1][j, w] &= h | q
                np.bitwise_and(gaps[1][j, w], hp, out=gaps[0][j, w])
                gaps[1][j, w] ^= gaps[0][j, w]
            np.bitwise_and(p, h, out=hq)
            if w + 1 < words:
                np.right_shift(hp, _TOP, out=next_up)
                np.right_shift(hq, _TOP, out=next_down)
            hp += hp  # a bit up
            hq += hq
            hp |= up if w else _ONE
            if w:
                hq |= down
            np.bitwise_or(x, hp, out=p)
            np.invert(p, out=p)
            p |= hq
            np.bitwise_and(hp, x, out=q)
            up, next_up, down, next_down = next_up, up, next_down, down
        if j + 1 >= shortest:
            end = np.flatnonzero(columns == j + 1)
            if len(end):
                out[end] = j + 1
                for p, q, mask in zip(plus, minus, inside, strict=True):
                    out[end] += np.bitwise_count(p[end] & mask[end]).astype(np.int64) - np.bitwise_count(q[end] & mask[end]).astype(np.int64)
    return out


@F.arrow_udf(IntegerType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """The Levenshtein distance of two strings."""
    i = np.arange(len(a))
    return pa.array(distances(pa.concat_arrays([a.cast(pa.string()), b.cast(pa.string())]), i, i + len(a)), pa.int32())


#: Bytes of working space for a chunk of banded pairs.
_SPACE = 32 << 20
#: Letters of pairs that are compared by bits.
_SHORT = 256


def _points(strings: list[str], before: int, width: int, fill: int) -> np.ndarray:
    """Code points, a row a string, from column ``before`` on; ``fill`` elsewhere."""
    out = np.full((len(strings), width), fill, np.uint32)
    for row, x in zip(out, strings, strict=True):
        row[before : before + len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32)
    return out


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """The Levenshtein distance of each pair, or most + 1 where it is more than ``most``.

    Pairs of up to ``_SHORT`` letters are compared by bits, which takes less than a band does. Of longer ones only the cells
    within ``most`` of the diagonal are computed, and a pair ends as soon as all of them are above it. A chunk of pairs of
    like bands advances one letter at a time; its size follows the bytes that its band takes.
    """
    n, m = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    out = most.astype(np.int64) + 1
    todo = np.flatnonzero(np.abs(n - m) <= most)
    short = np.maximum(n, m)[todo] <= _SHORT
    few, todo = todo[short], todo[~short]
    if len(few):
        i = np.arange(len(few))
        strings = pa.array([a[k] for k in few.tolist()] + [b[k] for k in few.tolist()], pa.string())
        out[few] = np.minimum(out[few], distances(strings, i, i + len(few)))
    most = np.minimum(most, np.maximum(n, m))  # no distance is larger
    todo = todo[np.lexsort((n[todo], most[todo]))]
    while len(todo):
        band = int(most[todo[-1]])
        size = max(1, _SPACE // (4 * int(max(n[todo].max(), m[todo].max())) * 2 + 24 * (2 * band + 3)))
        now, todo = todo[-size:], todo[:-size]
        rows, width = int(n[now].max()), int(max(n[now].max(), m[now].max())) + 2 * band + 2
        x, y = _points([a[k] for k in now], 0, rows, 0xFFFFFFFE), _points([b[k] for k in now], band, width, 0xFFFFFFFF)
        offset = np.arange(2 * band + 1)
        far = np.int32(1 << 28)
        first = np.where(offset >= band, offset - band, far).astype(np.int32)
        d = np.where(offset - band <= m[now, None], first, far)
        for i in range(rows + 1):
            if i:
                column = i + offset - band
                cand = d + (x[:, i - 1 : i] != y[:, i - 1 : i + 2 * band])
                cand[:, :-1] = np.minimum(cand[:, :-1], d[:, 1:] + 1)
                cand[(column < 0) | (column > m[now, None])] = far
                if i <= band:
                    cand[:, band - i] = i
                d = np.minimum.accumulate(cand - offset, axis=1) + offset
                d[(column < 0) | (column > m[now, None])] = far
            end = np.flatnonzero(n[now] == i)
            if len(end):
                got = d[end, m[now[end]] - i + band]
                out[now[end]] = np.minimum(got, most[now[end]] + 1) if i else m[now[end]]
            if len(end) or not i % 16:
                keep = (n[now] > i) & (d.min(axis=1) <= most[now])
                if not keep.all():
                    now, x, y, d = now[keep], x[keep], y[keep], d[keep]
                    if not len(now):
                        break
    return out


@F.arrow_udf(IntegerType())
def distance_within(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    """``within`` of two string columns and a column of bounds; null strings count as empty, a null bound gives null."""
    bound = np.array(most.fill_null(0).to_pylist(), np.int64)
    found = within(a.fill_null("").to_pylist(), b.fill_null("").to_pylist(), np.maximum(bound, 0))
    return pa.array(found.astype(np.int32), mask=np.array(most.is_null()))


def _rows(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a column of lists, and the first element of each row (with the total at the end)."""
    n = np.array(lists.value_lengths().fill_null(0).to_pylist(), np.int64)
    return lists.flatten(), np.concatenate(([0], np.cumsum(n)))


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


@F.arrow_udf(_PAIRS)
def pair_distances(strings: pa.Array) -> pa.Array:
    """Of each list of strings, the distance of each pair i <= j (a string has none from itself)."""
    values, first = _rows(strings)
    n = np.diff(first)
    upper = {m: np.triu_indices(m) for m in set(n.tolist())}
    i = np.concatenate([np.zeros(0, np.int64), *(upper[m][0] for m in n.tolist())])
    j = np.concatenate([np.zeros(0, np.int64), *(upper[m][1] for m in n.tolist())])
    pairs = n * (n + 1) // 2
    base, d = np.repeat(first[:-1], pairs), np.zeros(len(i), np.int32)
    real = np.flatnonzero(i != j)
    d[real] = distances(values, (base + i)[real], (base + j)[real])
    return _lists(np.concatenate(([0], np.cumsum(pairs))), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (i, j, d)], names=["i", "j", "d"]))


@F.arrow_udf(ArrayType(DoubleType()))
def distance_sums(strings: pa.Array, cap: pa.Array) -> pa.Array:
    """Of each list of strings, each one's sum of distances to the others, over the longer one's length, and at most cap.

    Pairs of a list come in parts of about a million, so that a long list takes no more space than a short one.
    """
    values, first = _rows(strings)
    n, size = np.diff(first), np.array([len(x or "") for x in values.to_pylist()], np.int64)
    out, limit = np.zeros(len(values)), np.array(cap.to_pylist(), float)

    def add(left: list[np.ndarray], right: list[np.ndarray], bound: list[np.ndarray]) -> None:
        i, j = np.concatenate(left), np.concatenate(right)
        d = np.minimum(np.concatenate(bound), distances(values, i, j) / np.maximum(1, np.maximum(size[i], size[j])))
        np.add.at(out, i, d)
        np.add.at(out, j, d)

    held, pairs, upper = ([], [], []), 0, {}
    for k, m in enumerate(n.tolist()):
        if m <= 64:  # all pairs of a short list at once
            if m not in upper:
                upper[m] = np.triu_indices(m, 1)
            i, j = upper[m]
            held[0].append(first[k] + i)
            held[1].append(first[k] + j)
            held[2].append(np.full(len(i), limit[k]))
            pairs += len(i)
        for i in range(m - 1 if m > 64 else 0):  # a string and those after it
            held[0].append(np.full(m - 1 - i, first[k] + i))
            held[1].append(np.arange(first[k] + i + 1, first[k] + m))
            held[2].append(np.full(m - 1 - i, limit[k]))
            pairs += m - 1 - i
            if pairs > 1 << 20:
                add(*held)
                held, pairs = ([], [], []), 0
        if pairs > 1 << 20:
            add(*held)
            held, pairs = ([], [], []), 0
    if pairs:
        add(*held)
    return _lists(first, pa.array(out))


@F.arrow_udf(ArrayType(IntegerType()))
def center_distances(strings: pa.Array, center: pa.Array) -> pa.Array:
    """The distance of each string of a list from the row's center."""
    values, first = _rows(strings)
    owner = np.repeat(np.arange(len(center)), np.diff(first))
    both = pa.concat_arrays([values.cast(pa.string()), center.cast(pa.string())])
    return _lists(first, pa.array(distances(both, np.arange(len(values)), len(values) + owner), pa.int32()))


def _repeats(codes: np.ndarray, pad: int) -> np.ndarray:
    """The length of the longest string that stands at two places of each row of up to 255 codes, a column a row."""
    best, run = np.zeros(codes.shape[1], np.uint8), np.zeros(codes.shape, np.uint8)
    for j in range(1, len(codes)):  # run[i]: letters that end at i and at j and are the same
        run[1:j] = run[: j - 1] + np.uint8(1)
        run[0] = 1
        run[:j] *= (codes[:j] == codes[j]) & (codes[j] != pad)
        np.maximum(best, run[:j].max(axis=0), out=best)
    return best


def _longest_repeat(x: str) -> int:
    """The same of a long string, by halving: a string that stands twice has shorter ones that do."""
    low, high = 0, len(x)
    while low < high:
        k = (low + high + 1) // 2
        n = len(x) - k + 1
        if n > 1 and len({x[i : i + k] for i in range(n)}) < n:
            low = k
        else:
            high = k - 1
    return low


@F.arrow_udf(ArrayType(IntegerType()))
def longest_repeats(strings: pa.Array) -> pa.Array:
    """Of each string of a list the length of its longest substring that stands at two places."""
    values, first = _rows(strings)
    size, texts = np.zeros(len(values), np.int64), values.to_pylist()
    n = np.array([len(x) for x in texts], np.int64)
    for i in np.flatnonzero(n > 255).tolist():
        size[i] = _longest_repeat(texts[i])
    short = np.flatnonzero(n <= 255)
    for lo in range(0, len(short), 512):
        some = short[lo : lo + 512]
        codes, _, letters = _letters(pa.array([texts[i] for i in some.tolist()], pa.string()))
        kind = np.uint8 if letters < 256 else np.uint16
        size[some] = _repeats(np.ascontiguousarray(codes.T.astype(kind)), letters)
    return _lists(first, pa.array(size.astype(np.int32)))


def _codes(strings: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, code) of each window of ``size`` letters of A, C, G and T; windows with others are left out."""
    raw = np.frombuffer("".join(strings.fill_null("").to_pylist()).encode("ascii", "replace"), np.uint8)
    n = np.array([len(x) for x in strings.fill_null("").to_pylist()], np.int64)
    table = np.full(256, -(1 << 62), np.int64)
    table[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    letter, row = table[raw], np.repeat(np.arange(len(n)), n)
    total = len(raw) - size + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3
    good = row[:total] == row[size - 1 :]
    code, bad = np.zeros(total, np.int64), np.zeros(total, bool)
    for k in range(size):
        own = letter[k : k + total]
        bad |= own < 0
        code = code * 4 + np.maximum(own, 0)
    at = np.flatnonzero(good & ~bad)
    return row[at], at - (np.cumsum(n) - n)[row[at]], code[at]


#: Letters of the longest windows whose code and the number of a row of a slice fit a word.
CODED, _SLICE = 24, 1 << 13


def coded_windows(strings: pa.Array, size: int):
    """For slices of a column (code, n, rows) of the windows of up to ``CODED`` letters of A, C, G and T: how often a window occurs,
    and in how many rows."""
    for lo in range(0, len(strings), _SLICE):
        row, _, code = _codes(strings.slice(lo, _SLICE), size)
        if len(row):
            both = np.sort(code * _SLICE + row)
            new = np.diff(both, prepend=-1) != 0
            code = both // _SLICE
            start = np.flatnonzero(np.diff(code, prepend=-1))
            yield code[start], np.diff(start, append=len(code)), np.add.reduceat(new.astype(np.int64), start)


def window_counts(size: int):
    """A function of a string column: its windows of ``size`` letters as (pos, edge, e, p, s): the window's code, and how
    often the string has the window, its first size - 1 letters, and its last ones, among its windows."""
    @F.arrow_udf(_WINDOWS)
    def run(strings: pa.Array) -> pa.Array:
        row, pos, code = _codes(strings, size)
        counts = []
        for part, width in ((code, size), (code >> 2, size - 1), (code & ((1 << 2 * (size - 1)) - 1), size - 1)):
            _, inverse, n = np.unique((row << 2 * width) | part, return_inverse=True, return_counts=True)
            counts.append(n[inverse].astype(np.int32))
        first = np.searchsorted(row, np.arange(len(strings) + 1))
        return _lists(first, pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(code), *(pa.array(c) for c in counts)], names=["pos", "edge", "e", "p", "s"]))

    return run


def window_totals(seqs: DataFrame, seq: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each window of ``size`` letters occurs in a column, each first size - 1 letters, and each last ones: arrays
    by code, 4^size long whatever the rows are. Windows are counted in the tasks' batches before the exchange."""
    def count(batches):
        for batch in batches:
            code, n = np.unique(_codes(batch.column(0), size)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["edge", "n"])

    found = seqs.select(seq).mapInArrow(count, "edge long, n long").groupBy("edge").agg(F.sum("n").alias("n")).toArrow()
    edges = np.zeros(4**size, np.int64)
    edges[found.column("edge").to_numpy()] = found.column("n").to_numpy()
    return edges, edges.reshape(-1, 4).sum(axis=1), edges.reshape(4, -1).sum(axis=0)


def _loo(strings: pa.Array, size: int, totals: tuple) -> tuple[np.ndarray, ...]:
    """(row, pos, code, forward, reverse) of each window, from ``window_totals`` less the counts of its own string."""
    row, pos, code = _codes(strings, size)
    rest = []
    for part, width, total in zip((code, code >> 2, code & ((1 << 2 * (size - 1)) - 1)), (size, size - 1, size - 1), totals, strict=True):
        _, inverse, n = np.unique((row << 2 * width) | part, return_inverse=True, return_counts=True)
        rest.append(np.maximum(total[part] - n[inverse], 0))
    return row, pos, code, (rest[0] + 0.5) / (rest[1] + 2), (rest[0] + 0.5) / (rest[2] + 2)


def loo_chances(size: int, totals):
    """A function of a string column: its windows as (pos, edge, forward, reverse); totals is a broadcast ``window_totals``."""
    @F.arrow_udf(_CHANCES)
    def run(strings: pa.Array) -> pa.Array:
        row, pos, code, forward, reverse = _loo(strings, size, totals.value)
        fields = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(code), pa.array(forward), pa.array(reverse)], names=["pos", "edge", "forward", "reverse"])
        return _lists(np.searchsorted(row, np.arange(len(strings) + 1)), fields)

    return run


def _widest(row: np.ndarray, value: np.ndarray, width: int, shape: tuple[int, int]) -> np.ndarray:
    """By row and position the largest value of the windows over it; windows of a row are numbered as they come."""
    at = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full(shape, -np.inf)
    for k in range(width):
        inside = at + k < shape[1]
        r, c = row[inside], at[inside] + k
        out[r, c] = np.maximum(out[r, c], value[inside])
    return out


def surprise_scores(size: int, totals, local_weight: float, top: int):
    """A function of a guide and its local surprises: the mean of the ``top`` most surprising positions, null without a window.

    A position's surprise is the largest of the windows of ``size`` letters over it (negative log probability, both
    directions) and ``local_weight`` times that of the local windows, if there are any over it.
    """
    @F.arrow_udf(DoubleType())
    def run(guide: pa.Array, local: pa.Array, local_size: pa.Array) -> pa.Array:
        out, width = np.full(len(guide), np.nan), int(local_size[0].as_py()) if len(guide) else 1
        for lo in range(0, len(guide), 1024):
            row, _, _, forward, reverse = _loo(guide.slice(lo, 1024), size, totals.value)
            n = min(1024, len(guide) - lo)
            windows = np.bincount(row, minlength=n)
            if not len(row):
                continue
            length = np.where(windows > 0, windows + size - 1, 0)
            shape = (n, int(length.max()))
            both = _widest(row, -(np.log(forward) + np.log(reverse)), size, shape)
            values, first = _rows(local.slice(lo, 1024))
            own = _widest(np.repeat(np.arange(n), np.diff(first)), values.to_numpy(zero_copy_only=False), width, shape)
            both += local_weight * np.where(np.isinf(own), 0.0, own)
            both[np.arange(shape[1]) >= length[:, None]] = -np.inf
            best = -np.sort(-both, axis=1)[:, :top]
            used = np.minimum(length, top)
            total = np.where(np.isinf(best), 0.0, best).cumsum(axis=1)[:, -1]
            out[lo : lo + n] = np.where(windows > 0, total / np.maximum(used, 1), np.nan)
        return pa.array(out, pa.float64(), from_pandas=True)

    return run


def layered_windows(lists: pa.Array, k: int, layers: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, layer, window, evidence, windows) of lists of reads, in this order: each read's windows of k letters (numbers of
    the sorted windows) at the layers they project to, spread over neighbours with a weight that falls by one with each layer
    away. Letters may be any."""
    values, first = _rows(lists)
    codes, n, letters = _letters(values)
    used = sorted(set("".join(values.fill_null("").to_pylist())))  # as _letters numbers them
    wide = max(0, codes.shape[1] - k + 1)
    inside = np.arange(wide) <= (n - k)[:, None]
    code, kinds = np.zeros((len(n), wide), np.int64), 1
    for i in range(k):
        code *= letters + 1
        code += codes[:, i : i + wide]
        kinds *= letters + 1
        if kinds > 1 << 40:  # numbered without gaps
            found, code = np.unique(code, return_inverse=True)
            code, kinds = code.reshape(len(n), wide), max(1, len(found))
    code = code[inside]
    if kinds <= 1 << 20:
        there = np.zeros(kinds, bool)
        there[code] = True
        found = np.flatnonzero(there)
        number = np.zeros(kinds, np.int64)
        number[found] = np.arange(len(found))
        code, where = number[code], np.zeros(len(found), np.int64)
        where[code] = np.arange(len(code))
    else:
        _, where, code = np.unique(code, return_index=True, return_inverse=True)
    kinds = max(1, len(where))
    at = np.floor(np.arange(wide) * (layers - 1) / np.maximum(n - k, 1)[:, None] + 0.5).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(first))
    # layers with room for their neighbours, so that a window's neighbours are places of its own, in order
    deep = layers + 2 * radius
    place = (owner[:, None] * deep + at + radius)[inside] * kinds + code
    place.sort()
    start = np.flatnonzero(np.diff(place, prepend=-1))
    times, place = np.diff(start, append=len(place)), place[start]
    bits = int(max(1, times.max(initial=0) * (radius + 1))).bit_length()
    spread = np.concatenate([(place + d * kinds) << bits | times * (radius + 1 - abs(d)) for d in range(-radius, radius + 1)])
    spread.sort()
    place = spread >> bits
    start = np.flatnonzero(np.diff(place, prepend=-1))
    evidence = np.add.reduceat(spread & ((1 << bits) - 1), start) if len(start) else np.zeros(0, np.int64)
    place = place[start]
    layer = place // kinds
    row = layer // deep
    layer -= row * deep + radius
    ok = (layer >= 0) & (layer < layers)
    read, pos = np.nonzero(inside)
    names = ["".join([used[x] for x in w]) for w in codes[read[where, None], pos[where, None] + np.arange(k)].tolist()]
    return row[ok], layer[ok], (place % kinds)[ok], evidence[ok], names


def own_windows(lists: pa.Array, k: int, pad: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, window, n, windows) of lists of strings, ``pad`` before and after each: how often a list has each window of k
    letters. Letters may be any; windows are numbered as the list of windows has them, A to Z."""
    values, first = _rows(lists)
    texts = [pad + x + pad for x in values.to_pylist() if x is not None] if pad else [x or "" for x in values.to_pylist()]
    owner = np.repeat(np.arange(len(lists)), np.diff(first))
    if pad:
        owner = owner[np.array([x is not None for x in values.to_pylist()], bool)]
    codes, n, letters = _letters(pa.array(texts, pa.string()))
    used = np.array(sorted(set("".join(texts))), dtype="<U1")
    wide = max(0, codes.shape[1] - k + 1)
    inside = np.arange(wide) <= (n - k)[:, None]
    code, kinds = np.zeros((len(n), wide), np.int64), 1
    for i in range(k):
        code = code * (letters + 1) + codes[:, i : i + wide]
        kinds *= letters + 1
        if kinds > 1 << 40:  # numbered without gaps
            found, code = np.unique(code, return_inverse=True)
            code, kinds = code.reshape(len(n), wide), max(1, len(found))
    place = (owner[:, None] * kinds + code)[inside]
    order = np.argsort(place, kind="stable")
    place = place[order]
    start = np.flatnonzero(np.diff(place, prepend=-1))
    _, where, window = np.unique(place[start] % kinds, return_index=True, return_inverse=True)
    read, pos = np.nonzero(inside)
    at = order[start[where]]
    letters_of = used[codes[read[at, None], pos[at, None] + np.arange(k)]] if len(at) else np.zeros((0, k), "<U1")
    names = np.ascontiguousarray(letters_of).view(f"<U{k}").ravel().tolist() if len(at) else []
    return place[start] // kinds, window, np.diff(start, append=len(place)), names


def kmer_centrality(size: int, most: int):
    """A function of a list of reads: for each read, how many reads of the list have its different k-mers, each counted up
    to ``most``, on average; null for a read without a k-mer."""
    def means(reads: list[str | None]) -> list[float | None]:
        own = [{x[i : i + size] for i in range(len(x) - size + 1)} if x else set() for x in reads]
        have = Counter(chain.from_iterable(own))
        return [sum(min(have[x], most) for x in read) / len(read) if read else None for read in own]

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(reads: pa.Array) -> pa.Array:
        return pa.array([means(x or []) for x in reads.to_pylist()], pa.list_(pa.float64()))

    return run


def local_surprise(size: int):
    """A function of a list of reads and a guide: for each window of the guide, the surprise (negative log probability,
    both directions) that the windows of the reads give it."""
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(reads: pa.Array, guide: pa.Array) -> pa.Array:
        states, found = 4**size, [np.zeros(0)]
        row, _, own = _codes(guide, size)
        for lo in range(0, len(guide), 32):  # codes and a table of all windows for some rows at a time: they stay in a cache
            values, first = _rows(reads.slice(lo, 32))
            read, _, code = _codes(values, size)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            x, y = np.searchsorted(row, [lo, lo + 32])
            table = np.bincount(owner[read] * states + code, minlength=32 * states)
            r, c = (row[x:y] - lo) * states, own[x:y]
            # the sums are looked up for the guide's own windows alone
            before, after = r + (c & ~3), r + (c & (states // 4 - 1))
            n, p = table[r + c], sum(table[before + i] for i in range(4))
            q = sum(table[after + i * (states // 4)] for i in range(4))
            found.append(-(np.log((n + 0.5) / (p + 2)) + np.log((n + 0.5) / (q + 2))))
        return _lists(np.searchsorted(row, np.arange(len(guide) + 1)), pa.array(np.concatenate(found)))

    return run
