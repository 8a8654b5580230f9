"""Repeated byte strings by common-prefix intervals of sparse suffix arrays, sharded by content anchors.

A string of ``length`` bytes contains anchors: k-grams whose hash is the least of some window of length - k + 1
neighbouring k-grams. Equal strings have equal anchors at equal places, so every repeat meets at an anchor, and an
anchor with its bytes to the left (length - k) and right (length) decides all strings around it.

1. Anchors go to anchor buckets with a hash of their context. Occurrences with an equal context are covered by the
   first one (a task settles its own before the exchange, so copies and common passages cost little).
2. Anchors with several contexts ask for the bytes of one occurrence of each context; these are fetched from the texts.
3. In an anchor bucket the occurrences are sorted by their right context (a suffix array over the anchors), with the
   lengths of common prefixes between neighbours. A stack scan yields the tree of common-prefix intervals (of two occurrences, the one that there is). An interval
   whose occurrences differ to the left is a maximal repeat, and belongs with all its occurrences; each occurrence is
   covered as far to the left as it agrees with any earlier one of the interval.
4. An anchor with very many contexts (the edge of a passage in a third of all texts) is hot: instead of its contexts,
   the hashes of the strings that it is the least anchor of are dealt out, after a task has settled its own repeats.
5. Covered spans return to their documents.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import textops
from helixspark.llm.runtime import discard, id_text, spread, written

K = 24
_HIT = np.dtype([("doc", "<i8"), ("pos", "<u4"), ("ask", "u1"), ("a", "<u8"), ("c", "<u8")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])
_FLUSH = 1 << 19
_CHUNK = 1 << 13


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each window of w: prefixes and suffixes of blocks of w meet."""
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if f is np.minimum else np.uint64(0)
    blocks = np.concatenate((x, np.full(pad, fill))).reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def _gram_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    h = (prefix[K:] - prefix[:-K]) * textops.inverse_powers(n - K + 1) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int):
    """(row, byte position in the row, anchor hash, context hash) of the anchors of rows of ``length`` bytes or more."""
    w = length - K + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(buf) < length:
        return none
    prefix = textops.prefix_hash(buf.astype(np.uint64) + np.uint64(1))
    h = _gram_hash(prefix, len(buf))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(h)] == row[K - 1 :]
    h[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate((edge, low, edge)), w, np.maximum) == h) & inside)
    at = at[np.diff(offsets)[row[at]] >= length]
    r = row[at]
    left, right = np.maximum(offsets[r], at - (length - K)), np.minimum(offsets[r + 1], at + length)
    context = textops.mix(textops.span_hash(prefix, left, at) * textops._C + textops.span_hash(prefix, at, right))
    # anchors are minima, so their hashes lie low; mixed, they spread over all buckets
    return r, at - offsets[r], textops.mix(h[at]), context


def _bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (textops.mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _split(at: np.ndarray, rows: np.ndarray):
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        yield int(at[a]), rows[a:b].tobytes()


def _first(a: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Order by (a, c, doc, pos), and where a new (a, c) begins."""
    order = np.lexsort((pos, doc, c, a))
    a, c = a[order], c[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]))) if len(a) else np.zeros(0, bool)


_ROW = np.dtype([("a", "u1", 7), ("c", "<u8"), ("pos", "<u4")])


def _post(length: int, buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def flush(held):
        doc, pos, a, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order, new = _first(a, c, doc, pos)
        doc, pos, a, c = doc[order], pos[order], a[order], c[order]
        hits = np.zeros(int((~new).sum()), _HIT)
        hits["doc"], hits["pos"], hits["a"], hits["c"] = doc[~new], pos[~new], a[~new], c[~new]
        out = [(b, 1, blob) for b, blob in _split(_bucket_of(hits["doc"], buckets), hits)]
        doc, pos, a, c = doc[new], pos[new], a[new], c[new]
        bucket = (a >> shift).astype(np.int64)
        order = np.lexsort((doc, bucket))
        doc, pos, a, c, bucket = doc[order], pos[order], a[order], c[order], bucket[order]
        rows = np.zeros(len(a), _ROW)
        rows["a"], rows["c"], rows["pos"] = a.view(np.uint8).reshape(-1, 8)[:, :7], c, pos
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            dd = doc[cuts[b] : cuts[b + 1]]
            new = np.flatnonzero(np.concatenate(([True], dd[1:] != dd[:-1])))
            n = np.diff(np.append(new, len(dd))).astype(np.uint32)
            out.append((b, 0, np.uint32(len(new)).tobytes() + dd[new].astype(np.int64).tobytes() + n.tobytes() + rows[cuts[b] : cuts[b + 1]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            buf, offsets = textops.utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in textops.slices(offsets):
                r, pos, a, c = anchors(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)
                if len(r):
                    held.append((ids[lo + r], pos, a, c))
                    size += len(r)
                if size > _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _contexts(buckets: int, hot: int):
    """In an anchor bucket: occurrences whose context an earlier one has; one of each context where there are several.

    ``ask`` is 0 for the first kind, else 1, or 2 where an anchor has more than ``hot`` contexts.
    """
    low = np.uint64((1 << 56) - 1)
    top = np.uint64(64 - (buckets.bit_length() - 1))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b, out, parts = key[0].as_py(), [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind:
                out.append((b, blob))
                continue
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            docs, counts = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n)
            rows = np.frombuffer(blob, _ROW, offset=4 + 12 * n)
            a = np.zeros((len(rows), 8), np.uint8)
            a[:, :7] = rows["a"]
            parts.append((a.view("<u8").ravel(), rows["c"].copy(), np.repeat(docs, counts), rows["pos"].astype(np.int64)))
        if parts:
            a, c, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(a)
            same = a[order][1:] == a[order][:-1]
            order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            a, c, doc, pos = a[order], c[order], doc[order], pos[order]
            order, new = _first(a, c, doc, pos)
            a, c, doc, pos = a[order], c[order], doc[order], pos[order]
            _, inverse = np.unique(a, return_inverse=True)
            n = np.bincount(inverse, weights=new)[inverse] if len(a) else np.zeros(0)
            keep = ~new | (n > 1)
            hits = np.zeros(int(keep.sum()), _HIT)
            hits["doc"], hits["pos"], hits["ask"] = doc[keep], pos[keep], (new * np.where(n > hot, 2, 1))[keep]
            hits["a"], hits["c"] = (a[keep] & low) | (np.uint64(b) << top), c[keep]
            out += list(_split(_bucket_of(hits["doc"], buckets), hits))
        return pa.table([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["to", "data"])

    return run


def _texts(buckets: int):
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            texts = [z.compress((x or "").encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_bucket_of(ids.to_numpy(), buckets).astype(np.int32)), ids, pa.array(texts, pa.binary())], names=["to", "doc_id", "z"])

    return run


def _around(length: int) -> np.dtype:
    """An occurrence with its bytes: to the left in reading order from the anchor backwards."""
    return np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("nl", "u1"), ("nr", "u1"), ("left", "u1", length - K), ("right", "u1", length)])


def _by_doc(data: list[bytes]):
    hits = np.sort(textops.unpacked(data, _HIT), order=["doc", "pos"])
    if not len(hits):
        return {}
    cut = np.flatnonzero(np.concatenate(([True], hits["doc"][1:] != hits["doc"][:-1])))
    return {int(hits["doc"][a]): hits[a:b] for a, b in zip(cut, [*cut[1:], len(hits)], strict=True)}


_WINDOW = np.dtype([("h", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<i8")])


def _windows(buf: np.ndarray, doc: int, pos: np.ndarray, length: int) -> np.ndarray:
    """The strings of ``length`` bytes whose least k-gram is at one of pos, by 128 bits of hash."""
    prefix = textops.prefix_hash(buf.astype(np.uint64) + np.uint64(1))
    h = _gram_hash(prefix, len(buf))
    low = _sliding(h, length - K + 1, np.minimum)
    at = np.unique(np.concatenate([_owned(low, h, p, length, len(buf)) for p in pos.tolist()]))
    out = np.zeros(len(at), _WINDOW)
    other = textops.prefix_hash(textops.mix(buf.astype(np.uint64) + textops._C))
    out["h"], out["h2"], out["doc"], out["start"] = textops.span_hash(prefix, at, at + length), textops.span_hash(other, at, at + length), doc, at
    return out


def _owned(low: np.ndarray, h: np.ndarray, p: int, length: int, n: int) -> np.ndarray:
    j = np.arange(max(0, p - (length - K)), min(p, n - length) + 1)
    return j[low[j] == h[p]]


def _repeated(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each hash, and the spans of the others."""
    rows = np.sort(rows, order=["h", "h2", "doc", "start"])
    new = np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]))) if len(rows) else np.zeros(0, bool)
    spans = np.zeros(int((~new).sum()), _SPAN)
    spans["doc"], spans["start"], spans["end"] = rows["doc"][~new], rows["start"][~new], rows["start"][~new] + length
    return rows[new], spans


def _fetch(length: int, buckets: int):
    """What anchors ask for: the bytes around occurrences (kind 0), or for hot anchors the hashes of all strings around
    them (kind 1), where a task settles its own repeats (kind 2: spans, by document bucket)."""
    kind = _around(length)
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = {d: h[h["ask"] > 0] for d, h in _by_doc(left.column("data").to_pylist()).items()}
        unz, parts, wide = zstandard.ZstdDecompressor(), [], []
        for doc, blob in zip(right.column("doc_id").to_pylist(), right.column("z").to_pylist(), strict=True):
            h = asked.get(doc)
            if h is None or not len(h):
                continue
            buf = np.frombuffer(unz.decompress(blob), np.uint8)
            if (h["ask"] == 2).any():
                wide.append(_windows(buf, doc, h["pos"][h["ask"] == 2].astype(np.int64), length))
                h = h[h["ask"] == 1]
            padded = np.concatenate((np.zeros(length, np.uint8), buf, np.zeros(length, np.uint8)))
            pos = h["pos"].astype(np.int64)
            rows = np.zeros(len(h), kind)
            rows["a"], rows["c"], rows["doc"], rows["pos"] = h["a"], h["c"], doc, pos
            rows["nl"], rows["nr"] = np.minimum(length - K, pos), np.minimum(length, len(buf) - pos)
            rows["left"] = padded[(pos + length - 1)[:, None] - np.arange(length - K)]
            rows["right"] = padded[(pos + length)[:, None] + np.arange(length)]
            parts.append(rows)
        rows = np.concatenate(parts) if parts else np.zeros(0, kind)
        out = [(b, 0, x) for b, x in _split((rows["a"] >> shift).astype(np.int64), rows)]
        if wide:
            first, spans = _repeated(np.concatenate(wide), length)
            out += [(b, 1, x) for b, x in _split((first["h"] >> shift).astype(np.int64), first)]
            out += [(b, 2, x) for b, x in _split(_bucket_of(spans["doc"], buckets), spans)]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "data"])

    return run


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows of bytes, of at most ``most`` bytes."""
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return np.minimum(first, most)


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of a suffix array, by a stack scan over neighbours' lengths."""
    out, stack = [], [(0, 0)]
    for i, x in enumerate([*lcp, 0], start=1):
        lo = i - 1
        while stack[-1][0] > x:
            value, lo = stack.pop()
            out.append((value, lo, i - 1))
        if stack[-1][0] < x:
            stack.append((x, lo))
    return out


def _left_reach(lefts: list[bytes]) -> list[int]:
    """For each string, the longest common prefix with any earlier one: neighbours in the sorted earlier ones decide."""
    seen: list[bytes] = []
    out = []
    for s in lefts:
        at = bisect.bisect_left(seen, s)
        best = 0
        for o in seen[max(0, at - 1) : at + 1]:
            n = min(len(s), len(o))
            differ = int.from_bytes(s[:n]) ^ int.from_bytes(o[:n])
            best = max(best, n - (differ.bit_length() + 7) // 8)
        out.append(best)
        seen.insert(at, s)
    return out


def _reach(rows: np.ndarray, side: str, n: str) -> np.ndarray:
    """For each row the longest common prefix of a side with any other row of its anchor: neighbours in order decide."""
    width = rows[side].shape[1]
    wide = np.zeros((len(rows), -(-width // 8) * 8), np.uint8)
    wide[:, :width] = rows[side]
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*(keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)), rows["a"]))
    s = rows[order]
    near = np.where(s["a"][1:] == s["a"][:-1], _common(s[side][1:], s[side][:-1], np.minimum(s[n][1:], s[n][:-1])), 0)
    out = np.zeros(len(rows), np.int64)
    out[order] = np.maximum(np.concatenate(([0], near)), np.concatenate((near, [0])))
    return out


def covered(rows: np.ndarray, length: int) -> np.ndarray:
    """The spans that repeat earlier strings of ``length`` bytes or more around the anchors of rows (_around)."""
    if len(rows):  # rows that can be in no repeat that is long enough leave at once
        rows = rows[_reach(rows, "left", "nl") + _reach(rows, "right", "nr") >= length]
    rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["a"]))]
    a = rows["a"]
    cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
    size = np.diff(np.append(cut, len(a)))
    pairs = cut[size == 2]  # the later of two: directly
    x, y = rows[pairs], rows[pairs + 1]
    left = _common(x["left"], y["left"], np.minimum(x["nl"], y["nl"]))
    right = _common(x["right"], y["right"], np.minimum(x["nr"], y["nr"]))
    good = left.astype(int) + right >= length
    spans = [np.stack((y["doc"][good], y["pos"][good].astype(np.int64) - left[good], y["pos"][good].astype(np.int64) + right[good]), axis=1)]
    for at, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        g = rows[at : at + n]
        rights = [r.tobytes()[:m] for r, m in zip(g["right"], g["nr"].tolist(), strict=True)]
        order = sorted(range(n), key=rights.__getitem__)
        s = g[order]
        lcp = _common(s["right"][:-1], s["right"][1:], np.minimum(s["nr"][:-1], s["nr"][1:])).tolist()
        lefts = [x.tobytes()[:m] for x, m in zip(g["left"], g["nl"].tolist(), strict=True)]
        for r, lo, hi in intervals(lcp):
            if r < K:
                continue
            members = sorted(order[lo : hi + 1])  # in the order of the corpus
            own = [lefts[i] for i in members]
            need = length - r
            if need and len({x[:1] for x in own}) == len(own):
                continue  # all differ to the left at once: the repeat ends at the anchor
            for i, reach in zip(members, _left_reach(own), strict=True):
                if reach >= need and i != members[0]:
                    pos = int(g["pos"][i])
                    spans.append(np.array([[int(g["doc"][i]), pos - reach, pos + r]], dtype=np.int64))
    flat = np.concatenate(spans)
    out = np.zeros(len(flat), _SPAN)
    out["doc"], out["start"], out["end"] = flat[:, 0], flat[:, 1], flat[:, 2]
    return out


def maximal_repeats(rows: np.ndarray, length: int) -> list[tuple[int, int, list[int]]]:
    """(left, right, members) for each maximal repeat of ``length`` bytes or more around one anchor's rows (_around).

    The stack scan over right contexts gives the intervals whose rows have ``right`` bytes in common; a second one over
    the rows' left contexts gives the parts of an interval with ``left`` bytes in common. A part is a maximal repeat if its
    rows differ to the right as well, or the context or a text ends there.
    """
    rights = [r.tobytes()[:m] for r, m in zip(rows["right"], rows["nr"].tolist(), strict=True)]
    lefts = [r.tobytes()[:m] for r, m in zip(rows["left"], rows["nl"].tolist(), strict=True)]

    def tree(keys: list[bytes], members: list[int]):
        order = sorted(members, key=keys.__getitem__)
        x, y = ([np.frombuffer(keys[i], np.uint8) for i in z] for z in (order[:-1], order[1:]))
        lcp = [int(np.append(u[: len(v)] == v[: len(u)], False).argmin()) for u, v in zip(x, y, strict=True)]
        for value, lo, hi in intervals(lcp):
            yield value, order[lo : hi + 1], min(lcp[lo:hi])

    out = []
    for right, members, _ in tree(rights, list(range(len(rows)))):
        if right < K:
            continue
        for left, part, _ in [*tree(lefts, members), *([(0, members, 0)] if len({lefts[i][:1] for i in members}) > 1 or not all(lefts[i] for i in members) else [])]:
            if left + right >= length and len(part) > 1:
                after = {rights[i][right : right + 1] for i in part}
                if len(after) > 1 or b"" in after:
                    out.append((left, right, sorted(part)))
    return out


def _list_groups(length: int):
    kind = _around(length)

    def run(table: pa.Table) -> pa.Table:
        rows = textops.unpacked([x for k, x in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == 0], kind)
        rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["a"]))]
        cut = np.flatnonzero(np.concatenate(([True], rows["a"][1:] != rows["a"][:-1]))).tolist() if len(rows) else []
        out: list[list] = [[], [], [], [], []]
        for lo, hi in zip(cut, [*cut[1:], len(rows)], strict=True):
            own = rows[lo:hi]
            for i, (left, right, members) in enumerate(maximal_repeats(own, length)):
                for m in members:
                    for column, value in zip(out, (int(own["a"][m].view(np.int64)), i, int(own["c"][m].view(np.int64)), left, right), strict=True):
                        column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["a", "i", "c", "left", "right"])

    return run


def _members(batches):
    for batch in batches:
        h = textops.unpacked(batch.column(0).to_pylist(), _HIT)
        yield pa.RecordBatch.from_arrays([pa.array(h["a"].view(np.int64)), pa.array(h["c"].view(np.int64)), pa.array(h["doc"]), pa.array(h["pos"].astype(np.int64))], names=["a", "c", "doc_id", "pos"])


def _cover(length: int, buckets: int):
    kind = _around(length)

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        own = [textops.unpacked([x for k, x in zip(kinds, data, strict=True) if k == i], t) for i, t in enumerate((kind, _WINDOW, _SPAN))]
        del data
        rows = own[0]
        order = np.argsort(rows["a"], kind="stable")
        a = rows["a"][order]
        parts, lo = [np.zeros(0, _SPAN)], 0
        while lo < len(a):  # some whole anchors at a time: what sorting takes does not grow with the bucket
            hi = int(np.searchsorted(a, a[min(lo + _CHUNK, len(a)) - 1], side="right"))
            parts.append(covered(rows[order[lo:hi]], length))
            lo = hi
        spans = np.concatenate([*parts, _repeated(own[1], length)[1], own[2]])
        out = list(_split(_bucket_of(spans["doc"], buckets), spans))
        return pa.table([pa.array([x for x, _ in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["to", "kind", "data"])

    return run


def _apply(length: int, keep_bytes: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, data = left.column("kind").to_pylist(), left.column("data").to_pylist()
        hits = _by_doc([x for k, x in zip(kinds, data, strict=True) if not k])
        spans = np.sort(textops.unpacked([x for k, x in zip(kinds, data, strict=True) if k], _SPAN), order="doc")
        unz, out = zstandard.ZstdDecompressor(), []
        for doc, blob in zip(right.column("doc_id").to_pylist(), right.column("z").to_pylist(), strict=True):
            a, b = np.searchsorted(spans["doc"], [doc, doc + 1])
            own, h = spans[a:b], hits.get(doc)
            if a == b and (h is None or h["ask"].all()):
                continue
            text = unz.decompress(blob)
            n = len(text)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, own["start"], 1)
            np.add.at(edge, own["end"], -1)
            if h is not None:
                pos = h["pos"][h["ask"] == 0].astype(np.int64)
                s, e = np.maximum(0, pos - (length - K)), np.minimum(n, pos + length)
                s, e = s[e - s >= length], e[e - s >= length]
                np.add.at(edge, s, 1)
                np.add.at(edge, e, -1)
            gone = np.cumsum(edge[:-1]) > 0
            if not gone.any():
                continue
            change = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((doc, int(gone.sum()), np.flatnonzero(change == 1), np.flatnonzero(change == -1), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


#: Documents without an id of their own come after all others.
_LAST = 1 << 62


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(key, text) once for each document; (doc_id, key, n_bytes, sha) of each row; and the texts' bytes."""
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    sha = F.sha2("text", 256)
    meta = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha")), "texts")
    late = F.lit(_LAST).bitwiseOR(F.xxhash64("doc_id", "sha").bitwiseAND(_LAST - 1))
    per = meta.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("sha").alias("first"), F.max("sha").alias("last"))
    several, clash, total = per.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("first") != F.col("last")), F.coalesce(F.sum("n"), F.lit(0))).first()
    key = F.when(F.col("doc_id").isNull(), late).otherwise(F.col("doc_id"))
    if clash:
        of = per.where("doc_id is not null and first <> last").select("doc_id", "first")
        key = F.when(F.col("doc_id").isNull() | (F.col("sha") > F.col("first")), late).otherwise(F.col("doc_id"))
        meta = meta.join(of, "doc_id", "left").select("doc_id", key.alias("key"), "n_bytes", "sha")
        rows = rows.withColumn("sha", sha).join(of, "doc_id", "left").select(key.alias("key"), "text")
    else:
        meta = meta.select("doc_id", key.alias("key"), "n_bytes", "sha")
        rows = rows.withColumn("sha", sha).select(key.alias("key"), "text") if several else rows.select(F.when(F.col("doc_id").isNull(), F.lit(_LAST).bitwiseOR(F.xxhash64("doc_id", sha).bitwiseAND(_LAST - 1))).otherwise(F.col("doc_id")).alias("key"), "text")
    if several:
        rows = rows.dropDuplicates(["key"])
    return rows, meta, meta.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def _anchored(rows: DataFrame, length: int, hot: int, n_bytes: int):
    """Occurrences by document bucket (hits), the texts in the same buckets, and the anchors with their contexts."""
    spark = rows.sparkSession
    n_parts = spread(spark, n_bytes // 2)
    buckets = 1 << max(4, (4 * n_parts - 1).bit_length())
    posted = rows.mapInArrow(_post(length, buckets), "bucket int, kind int, data binary").repartition(n_parts, "bucket")
    hits = written(posted.groupBy("bucket").applyInArrow(_contexts(buckets, hot), "to int, data binary"), "hits")
    texts = rows.mapInArrow(_texts(buckets), "to int, doc_id long, z binary").repartition(n_parts, "to").groupBy("to")
    around = hits.repartition(n_parts, "to").groupBy("to").cogroup(texts).applyInArrow(_fetch(length, buckets), "bucket int, kind int, data binary")
    return hits, texts, around.repartition(n_parts, "bucket"), n_parts, buckets


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, hot: int = 20000) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts earlier.

    Texts are UTF-8 bytes (null: empty); earlier means a smaller doc_id, or the same document and an earlier start;
    overlaps count, matches never cross documents, and strings are judged on the input.

    Returns doc_id, n_bytes, n_removed, starts and ends of the maximal removed runs, kept_sha256, and kept (the other
    bytes; null where nothing was removed, or without ``keep_bytes``). Contexts of an anchor are taken as equal by 64 bits
    of hash besides the anchor's own 64, the strings around hot anchors by 128 bits; all others are compared byte by byte.
    An anchor with more than ``hot`` different contexts is not sorted in one task: the strings around it are dealt out by
    their own hashes. A text equal to an earlier one loses all its bytes if it has ``length`` or more. Rows of one doc_id
    and one text are one document and get equal results; of rows of one doc_id with different texts, the one of the least
    SHA-256 has the id's place and the others come after all documents, as do rows without an id, in an order by hash. Ids
    are below 2^62. Other columns are not read; an empty table gives an empty result.
    """
    if not 2 * K <= length <= 255:
        raise ValueError(f"length must be between {2 * K} and 255")
    rows, meta, n_bytes = _keyed(docs, id_col, text_col)
    hits, texts, around, n_parts, buckets = _anchored(rows, length, hot, n_bytes)
    spans = around.groupBy("bucket").applyInArrow(_cover(length, buckets), "to int, kind int, data binary")
    all_ = written(hits.withColumn("kind", F.lit(0)).select("to", "kind", "data").unionByName(spans), "spans")
    discard(hits)
    changed = all_.repartition(n_parts, "to").groupBy("to").cogroup(texts).applyInArrow(_apply(length, keep_bytes), "doc_id long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string, kept binary").withColumnRenamed("doc_id", "key")
    if not keep_bytes:
        changed = changed.drop("kept")
    first = meta.groupBy("sha").agg(F.min("key").alias("first"))
    out = meta.join(first, "sha").join(changed, "key", "left")
    copy = (F.col("key") != F.col("first")) & (F.col("n_bytes") >= length)
    zero = F.array().cast("array<bigint>")
    cols = {
        "n_removed": F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))),
        "starts": F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", zero)),
        "ends": F.when(copy, F.array("n_bytes")).otherwise(F.coalesce("ends", zero)),
        "kept_sha256": F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")),
    } | ({"kept": F.when(copy, F.lit(b"")).otherwise(F.col("kept"))} if keep_bytes else {})
    return out.select("doc_id", "n_bytes", *(c.alias(n) for n, c in cols.items()))


def repeat_groups(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The maximal repeats of ``length`` bytes or more, with all their occurrences.

    Returns two tables. Groups: group_id, context_id, n_left, n_right; a row for each different surrounding in which a
    maximal repeat occurs, where the repeat goes from n_left bytes before to n_right bytes after the place. Contexts:
    context_id, key, pos; all places with that surrounding, which is how copies are listed once and not with each group
    (key is the doc_id where ids are unique). A context alone in several places (up to length - K bytes before, length
    bytes after) is a repeat as well and longer than its surrounding tells, so only contexts and not strings beyond them
    are compared. Repeats that are longer than the context are reported around each of their anchors.
    """
    rows, _, n_bytes = _keyed(docs, id_col, text_col)
    hits, _, around, _, _ = _anchored(rows, length, (1 << 31) - 1, n_bytes)
    context = F.struct("a", "c").alias("context_id")
    groups = around.groupBy("bucket").applyInArrow(_list_groups(length), "a long, i long, c long, left long, right long").select(F.struct("a", "i").alias("group_id"), context, F.col("left").alias("n_left"), F.col("right").alias("n_right"))
    places = hits.select("data").mapInArrow(_members, "a long, c long, doc_id long, pos long").select(context, F.col("doc_id").alias("key"), "pos").distinct()
    return groups, places


def op5_query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
