"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import textops
from helixspark.llm.runtime import id_text, sample_rows

#: Words of a window, and words from one window's start to the next one's.
WINDOW, STEP = 8, 4
#: Bytes of a trained dictionary.
DICTIONARY = 16384
#: Bytes of the pieces that a toxic dictionary is made of.
PIECE = 6
#: Counts of windows from here on have one score.
MOST = 8
#: Both dictionaries end with it and each window begins with it, so every window becomes a compressed block (short ones
#: are stored as they are otherwise), and its length is a constant plus the cost of its own bytes.
_CARRIER = b"\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19"
#: Ends each window: the compressor begins no match in the last bytes of a block.
_TAIL = b"\x1a\x1b\x1c\x1d\x1e\x1f\x7f\x1f\x1e\x1d\x1c\x1b"


@dataclass(frozen=True)
class Model:
    """Both dictionaries, the window threshold in bytes, and the score for each number of windows beyond it."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    scores: tuple[float, ...]


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) in bytes of the windows of all rows, and the first window of each row (with the total at the end).

    A window is ``WINDOW`` words (anything but ASCII white space) with what stands between them; windows begin every
    ``STEP`` words until one reaches the last word, so each word is in one. A row of fewer words is one window.
    """
    _, start, end, first = textops.words(buf, offsets, textops.NON_SPACE)
    n = np.diff(first)
    per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)), 0)
    ends = np.cumsum(per)
    row = np.repeat(np.arange(len(n)), per)
    a = first[row] + STEP * (np.arange(len(row)) - (ends - per)[row])
    b = np.minimum(a + WINDOW, first[row + 1]) - 1
    return np.stack((start[a], end[b] - start[a]), axis=1) if len(row) else np.zeros((0, 2), np.int64), np.concatenate(([0], ends))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, window_log=15, hash_log=14, chain_log=15, search_log=4, min_match=6, strategy=zstandard.STRATEGY_GREEDY)
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=params)


class Gains:
    """Bytes that the toxic dictionary saves on a window.

    The toxic side has the ordinary dictionary behind the toxic one, so ordinary words cost the same on both sides. Both
    are used for their content alone: with entropy tables the difference is blurred (see README).
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.pair = _compressor(ordinary + _CARRIER), _compressor(toxic + b"\n" + ordinary + _CARRIER)

    def lengths(self, low: np.ndarray, spans: np.ndarray, sides: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
        """Compressed lengths of the windows of a lower-cased buffer, for each side."""
        if not len(spans):
            return [np.zeros(0, np.int64)] * len(sides)
        head, tail = np.frombuffer(_CARRIER, np.uint8), np.frombuffer(_TAIL, np.uint8)
        size = spans[:, 1] + len(head) + len(tail)
        start = np.cumsum(size) - size
        framed = np.empty(int(size.sum()), np.uint8)
        framed[start[:, None] + np.arange(len(head))] = head
        framed[(start + size - len(tail))[:, None] + np.arange(len(tail))] = tail
        at = np.arange(int(spans[:, 1].sum())) - np.repeat(np.cumsum(spans[:, 1]) - spans[:, 1], spans[:, 1])
        framed[at + np.repeat(start + len(head), spans[:, 1])] = low[at + np.repeat(spans[:, 0], spans[:, 1])]
        data = zstandard.BufferWithSegments(framed.tobytes(), np.stack((start, size), axis=1).astype("<u8").tobytes())
        return [np.fromiter((len(x) for x in self.pair[i].multi_compress_to_buffer(data, threads=1)), np.int64, len(spans)) for i in sides]

    def of(self, low: np.ndarray, spans: np.ndarray) -> np.ndarray:
        a, b = self.lengths(low, spans)
        return a - b


def _cut(text: bytes) -> np.ndarray:
    return windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def _train(texts: list[bytes], most: int) -> bytes:
    """A dictionary of the windows of texts; evenly taken ones where there are more than ``most``."""
    cut = [_cut(t) for t in texts]
    every = max(1, -(-sum(map(len, cut)) // most))
    own = [t[a : a + n] for t, c in zip(texts, cut, strict=True) for a, n in c[::every].tolist()]
    try:
        return zstandard.train_dictionary(DICTIONARY, own, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on
        return b"\n".join(own)[-DICTIONARY:]


def kinds(texts: list[bytes], most: int = 6, rounds: int = 10) -> np.ndarray:
    """A number below ``most`` for each text: texts whose bytes are alike, as those of one language or script are.

    Means of byte shares, from texts that lie far from each other; nothing but the texts is used.
    """
    share = np.zeros((len(texts), 256))
    for row, t in zip(share, texts, strict=True):
        row += np.sqrt(np.bincount(np.frombuffer(t, np.uint8), minlength=256) / max(1, len(t)))
    if not len(texts):
        return np.zeros(0, np.int64)
    # of texts long enough to tell, the first, and then again and again the one farthest from all means so far
    sure = share[[i for i, t in enumerate(texts) if len(t) >= 1000]] if sum(len(t) >= 1000 for t in texts) >= most else share
    means = sure[:1]
    while len(means) < min(most, len(sure)):
        far = ((sure[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1)
        means = np.concatenate((means, sure[far.argmax()][None]))
    for _ in range(rounds):
        own = ((share[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([share[own == k].mean(axis=0) if (own == k).any() else means[k] for k in range(len(means))])
    return own


def _pieces(contents: list[bytes], toxic: list[list[bytes]], ordinary: list[list[bytes]], odds: float = 3.5, near: float = 1.5, least: int = 8) -> bytes:
    """The runs of dictionaries whose pieces the toxic texts of a kind have far more often than ordinary ones, each once.

    The first content, with its texts, is that of all kinds. A piece needs log odds over ``odds`` against all ordinary
    texts and over ``near`` against those of its kind, and ``least`` toxic texts that have it in surroundings not seen
    before, so a passage in many copies counts once. What a trained dictionary has besides (ordinary words, entropy
    tables) goes.
    """
    cut = lambda t: [t[i : i + PIECE] for i in range(len(t) - PIECE + 1)]
    wanted = {g for c in contents for g in cut(c)}

    def count(texts: list[bytes]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            out.update(wanted.intersection(cut(t)))
        return out

    runs, by_kind = [], [count(o) for o in ordinary]
    everywhere, size = by_kind[0], len(ordinary[0])
    for content, texts, others, own in zip(contents, toxic, ordinary, by_kind, strict=True):
        a = count(texts)
        more = lambda g, n, b, m, k=len(texts): math.log((n + 0.5) / (k + 1)) - math.log((b[g] + 0.5) / (m + 1))
        odd = {g for g, n in a.items() if n >= least and more(g, n, everywhere, size) > odds and more(g, n, own, len(others)) > near}
        around: dict[bytes, set[bytes]] = {g: set() for g in odd}
        fresh: Counter = Counter()
        for t in texts:
            here: dict[bytes, set[bytes]] = {}
            for i in range(len(t) - PIECE + 1):
                if (g := t[i : i + PIECE]) in odd:
                    here.setdefault(g, set()).add(t[max(0, i - 2 * PIECE) : i + 3 * PIECE])
            for g, seen in here.items():
                fresh[g] += not seen <= around[g]
                around[g] |= seen
        marks = {g for g, n in fresh.items() if n >= least}
        keep = np.zeros(len(content) + 1, np.int8)
        for i, g in enumerate(cut(content)):
            if g in marks:
                keep[i : i + PIECE] = 1
        edges = np.flatnonzero(np.diff(keep, prepend=0)).tolist()
        runs += [content[lo:hi] for lo, hi in zip(edges[::2], edges[1::2], strict=True)]
    once: list[bytes] = []
    for r in sorted(runs, key=lambda r: (-len(r), r)):
        if not any(r in x for x in once):
            once.append(r)
    return b"\n".join(reversed(once))


def dictionaries(toxic: list[bytes], ordinary: list[bytes], most: int = 60000) -> tuple[bytes, bytes]:
    """The ordinary dictionary and the toxic one.

    Toxic dictionaries are trained for all texts, and by kind of text, so that a language with few toxic texts has one
    too; each twice: on all toxic windows, and then on those that the ordinary texts' dictionary shortens least.
    """
    plain = _train(ordinary, most)
    gains = Gains(plain, b"")
    of = kinds(toxic + ordinary)
    group = lambda texts, at, k: [t for t, x in zip(texts, at, strict=True) if k is None or x == k]
    contents, groups, others = [], [], []
    for k in [None, *sorted(set(of[: len(toxic)].tolist()))]:
        own = group(toxic, of[: len(toxic)], k)
        hard = []
        for t in own:
            spans = _cut(t)
            rate = gains.lengths(np.frombuffer(t, np.uint8), spans, (0,))[0] / (spans[:, 1] + 8)
            hard += [(r, t[a : a + n]) for r, (a, n) in zip(rate.tolist(), spans.tolist(), strict=True)]
        hard.sort(key=lambda x: -x[0])
        second = _train([w for _, w in hard[: max(len(hard) // 3, min(len(hard), 1000))]], most)
        contents.append(_train(own, most) + b"\n" + second)
        groups.append(own)
        others.append(group(ordinary, of[len(toxic) :], k))
    return plain, _pieces(contents, groups, others)


def fit(rows: list[tuple[str | None, int]], trained_on: int = 60000) -> Model:
    """Dictionaries from two thirds of the labelled texts; threshold and scores from the rest."""
    texts = [(textops.LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes(), y == 1) for t, y in rows]
    build, hold = [x for i, x in enumerate(texts) if i % 3], [x for i, x in enumerate(texts) if not i % 3]
    ordinary, toxic = dictionaries([t for t, y in build if y], [t for t, y in build if not y], trained_on)
    gains = Gains(ordinary, toxic)
    found = [gains.of(np.frombuffer(t, np.uint8), _cut(t)) for t, _ in hold]
    y = np.array([v for _, v in hold], dtype=float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    tried = []
    for threshold in range(1, 9):
        n = np.array([min(MOST, int((g >= threshold).sum())) for g in found], dtype=int)
        # a count's rate is drawn to that of all texts, or of all texts with a window beyond the threshold
        some = (y[n > 0].sum() + rate) / ((n > 0).sum() + 1)
        scores = np.maximum.accumulate([(y[n == c].sum() + (some if c else rate)) / ((n == c).sum() + 1) for c in range(MOST + 1)])
        loss = float(-(y * np.log(scores[n]) + (1 - y) * np.log(1 - scores[n])).sum())
        tried.append((loss, threshold, tuple(scores.tolist())))
    # of thresholds that tell the texts about as well (within one nat over all of them) the lowest
    _, threshold, scores = next(x for x in tried if x[0] <= min(tried)[0] + 1)
    return Model(ordinary, toxic, threshold, scores)


def _score(shared):
    names = ["doc_id", "score", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        gains, scores = Gains(model.ordinary, model.toxic), np.array(model.scores)
        for batch in batches:
            buf, offsets = textops.utf8(batch.column(1))
            for lo, hi in textops.slices(offsets):
                part, off = textops.LOWER[buf[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                spans, first = windows(part, off)
                beyond = np.concatenate(([0], np.cumsum(gains.of(part, spans) >= model.threshold)))
                n = beyond[first[1:]] - beyond[first[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores[np.minimum(n, MOST)]), pa.array(n)], names=names)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 3000, longest: int = 32768, trained_on: int = 60000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts for toxicity.

    The model is fitted on at most ``sample`` labelled texts of each class, of at most ``longest`` bytes each (so the
    driver gets 2 x sample x longest bytes at most). Each dictionary is trained on at most ``trained_on`` windows of its
    class's texts in that sample, evenly taken (every third ordinary window at sf0.1; all toxic ones). All rows of ``labels`` may be used, so leave held-out rows out before
    the call. Overlapping windows of eight words of the whole text are compressed with both dictionaries; windows that the
    toxic one shortens by at least the calibrated number of bytes more count, and the count gives the score.

    Returns doc_id, score (0 to 1) and windows (the count) for each row, null and repeated ids included. Null and empty
    texts have no windows and the lowest score; without labels of a class the scores are the labels' rate. Texts of equal
    bytes have equal scores; other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    rows = sample_rows(docs, labels, label, sample, id_col, text_col, longest).collect()
    model = fit([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.h, r.doc_id))], trained_on)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return id_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id long, score double, windows long")


def held_out(column):
    return F.crc32(column.cast("string").cast("binary")) % 5 == 0


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")
