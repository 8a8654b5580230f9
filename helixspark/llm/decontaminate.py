"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import textops
from helixspark.llm.runtime import id_text, written

_FOUND = "n_words long, hit_words array<int>, span_starts array<long>, span_ends array<long>, items array<string>"
_ARROW = pa.schema([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


@dataclass
class Windows:
    """Windows of one length: their sorted hashes (a bitmap of the first 20 bits goes before them), where each one's words
    stand in the table's text, and the numbers of the items that have it, items[first[i]:first[i + 1]]."""

    bitmap: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Table:
    """The items' words, lower-cased and parted by single spaces; the items' names; the windows by their number of words."""

    text: np.ndarray
    names: pa.Array
    windows: dict[int, Windows]

    def nbytes(self) -> int:
        return self.text.nbytes + self.names.nbytes + sum(x.nbytes for w in self.windows.values() for x in vars(w).values())


def _entries(buf: np.ndarray, offsets: np.ndarray, n: int, base: int, row0: int):
    """The words of some items as one text, and by window length (hash, start in the text from ``base`` on, size, item)."""
    h, s, e, first = textops.words(buf, offsets, textops.ALNUM)
    size = e - s
    at = np.cumsum(size + 1) - (size + 1)  # where each word begins in the joined text
    text = np.full(int((size + 1).sum()), 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[inside + np.repeat(at, size)] = textops.LOWER[buf][inside + np.repeat(s, size)]
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    out = {}
    for m in sorted({min(n, int(c)) for c in count} - {0}):
        g = textops.ngrams(h, m)
        own = row[: len(g)]
        # items of fewer than n words have one window, of all of them
        i = np.flatnonzero((own == row[m - 1 :]) & (count[own] >= n if m == n else count[own] == m))
        out[m] = (g[i], base + at[i], at[i + m - 1] + size[i + m - 1] - at[i], row0 + own[i])
    return text, out


def _windows(parts: list[tuple], text: np.ndarray) -> Windows:
    h, start, size, item = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((item, h))
    h, start, size, item = h[order], start[order], size[order], item[order]
    # windows of one hash are told apart by their words
    kind = np.zeros(len(h), np.int32)
    cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    for lo, hi in zip(cut[:-1][np.diff(cut) > 1].tolist(), cut[1:][np.diff(cut) > 1].tolist(), strict=True):
        seen: dict[bytes, int] = {}
        for k in range(lo, hi):
            kind[k] = seen.setdefault(text[start[k] : start[k] + size[k]].tobytes(), len(seen))
    order = np.lexsort((item, kind, h))
    h, start, size, item, kind = h[order], start[order], size[order], item[order], kind[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])))
    keep = new | np.concatenate(([True], item[1:] != item[:-1]))
    first = np.append(np.flatnonzero(new[keep]), keep.sum())
    bitmap = np.zeros(1 << 20, dtype=bool)
    bitmap[h >> np.uint64(44)] = True
    return Windows(bitmap, h[new], start[new], size[new].astype(np.int32), first, item[keep].astype(np.int32))


def window_table(items: list[tuple[str | None, str | None]], n: int) -> Table:
    """The windows of (item, text): of n words, or of all of an item's words where it has fewer (but some).

    NumPy arrays over one text: some 30 bytes a window besides the text.
    """
    buf, offsets = textops.utf8(pa.array([t for _, t in items], pa.large_string()))
    texts, parts, base = [], {}, 0
    for lo, hi in textops.slices(offsets):
        text, found = _entries(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n, base, lo)
        texts.append(text)
        base += len(text)
        for m, part in found.items():
            parts.setdefault(m, []).append(part)
    whole = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    return Table(whole, pa.array([i for i, _ in items], pa.large_string()), {m: _windows(p, whole) for m, p in parts.items()})


def _scan(table, only_hits: bool = False):
    """Scan the text in a batch's last column; the other columns stay in front of the results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_table = table.value
        for batch in batches:
            buf, offsets = textops.utf8(batch.column(batch.num_columns - 1))
            for lo, hi in textops.slices(offsets):
                found = _scan_slice(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], own_table)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                out = pa.RecordBatch.from_arrays([*own, *found.columns], names=[*batch.schema.names[:-1], *_ARROW.names])
                yield out.filter(pc.greater(pc.list_value_length(out.column("hit_words")), 0)) if only_hits else out

    return run


def _scan_slice(buf, offsets, table: Table) -> pa.RecordBatch:
    h, s, e, first = textops.words(buf, offsets, textops.ALNUM)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)
    hit = np.zeros(len(h), dtype=bool)
    items: dict[int, set[int]] = {}
    low = None
    for m, w in table.windows.items():
        g = textops.ngrams(h, m)
        maybe = np.flatnonzero(w.bitmap[g >> np.uint64(44)] & (row[: len(g)] == row[m - 1 :]))
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(w.hashes, g[maybe]), len(w.hashes) - 1)
        good = w.hashes[at] == g[maybe]
        maybe, at = maybe[good], at[good]
        low = textops.LOWER[buf].tobytes() if low is None and len(maybe) else low
        for i, k in zip(maybe.tolist(), at.tolist(), strict=True):
            words = b" ".join(low[a:b] for a, b in zip(s[i : i + m].tolist(), e[i : i + m].tolist(), strict=True))
            while k < len(w.hashes) and w.hashes[k] == g[i]:
                if table.text[w.start[k] : w.start[k] + w.size[k]].tobytes() == words:
                    hit[i : i + m] = True
                    items.setdefault(int(row[i]), set()).update(w.items[w.first[k] : w.first[k + 1]].tolist())
                    break
                k += 1
    hits: list = [[]] * len(n_words)
    starts: list = [[]] * len(n_words)
    ends: list = [[]] * len(n_words)
    named: list = [[]] * len(n_words)
    for r, own in items.items():
        a, b = first[r], first[r + 1]
        at = np.flatnonzero(hit[a:b])
        cut = np.flatnonzero(np.diff(at) > 1)
        hits[r] = at.astype(np.int32)
        starts[r] = s[a + at[np.concatenate(([0], cut + 1))]] - offsets[r]
        ends[r] = e[a + at[np.concatenate((cut, [len(at) - 1]))]] - offsets[r]
        # rows of one item id count once
        named[r] = sorted({x for x in table.names.take(pa.array(sorted(own))).to_pylist() if x is not None})
    return pa.RecordBatch.from_arrays([pa.array(n_words.astype(np.int64)), *(pa.array(x, t.type) for x, t in zip((hits, starts, ends, named), list(_ARROW)[1:], strict=True))], schema=_ARROW)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 128 << 20) -> DataFrame:
    """Find the benchmark's word windows in whole documents.

    Words are runs of ASCII letters (lower-cased) and digits or of characters beyond ASCII. A benchmark item's windows
    are its runs of n words, or the whole item where it has fewer. The windows are broadcast as a hash set in blocks of
    at most ``block_bytes`` of item text (one item longer than that is a block of its own); the documents are scanned
    once for each block, and a hit counts only when the words themselves are equal. With several blocks, each block's
    hits are written and its set released before the next one is read; what a text hits depends on the text alone, so
    hits are kept by two 64-bit hashes of it and joined to the rows at last, and the result does not depend on the blocks.

    Returns for each row of docs: doc_id, n_words, hit_words (numbers of the words in windows), span_starts and
    span_ends (byte offsets of the maximal runs of such words), items (sorted as strings). Null and empty texts have no
    words and no hits; windows of a benchmark row with a null id hit, but add no item; an empty benchmark hits nothing;
    an empty table gives an empty result. Each row gets its own result, whatever its id; other columns are not read.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = bench.agg(F.sum(F.octet_length("text") + 36 * words)).first()[0] or 0
    blocks = -(-total // block_bytes) if total > block_bytes else 1
    blocks += blocks > 1 and blocks // 4 + 1  # items are dealt by hash, so blocks differ in size
    broadcast = lambda part: spark.sparkContext.broadcast(window_table([(x.item, x.text) for x in part], n))
    if blocks == 1:
        return rows.mapInArrow(_scan(broadcast(bench.collect())), f"doc_id long, {_FOUND}")
    key = (F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    parts = []
    for k in range(blocks):
        table = broadcast(bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect())
        parts.append(written(rows.select(*key, "text").mapInArrow(_scan(table, True), f"k1 long, k2 long, {_FOUND}").distinct(), "hits"))
        table.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = found.groupBy("k1", "k2").agg(flat("hit_words").alias("hit_words"), F.flatten(F.collect_list(F.arrays_zip("span_starts", "span_ends"))).alias("spans"), flat("items").alias("items"))
    # spans of different blocks may overlap or touch: sorted, each either extends the last one or begins a new one
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    join = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<span_starts:bigint,span_ends:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["span_ends"] >= x["span_starts"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["span_starts"].alias("span_starts"), F.greatest(last(acc)["span_ends"], x["span_ends"]).alias("span_ends"))))).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.withColumn("spans", join).select("k1", "k2", "hit_words", F.col("spans.span_starts").alias("span_starts"), F.col("spans.span_ends").alias("span_ends"), "items")
    counted = rows.select("doc_id", *key, "text").mapInArrow(_scan(broadcast([])), f"doc_id long, k1 long, k2 long, {_FOUND}").select("doc_id", "n_words", "k1", "k2")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return counted.join(merged, ["k1", "k2"], "left").select("doc_id", "n_words", none("hit_words", "int"), none("span_starts", "long"), none("span_ends", "long"), none("items", "string"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, bench)
    return out.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) i) WHERE len(w) >= m),
hit AS (SELECT doc_id, m, i, item_id FROM dw JOIN bw USING (m, g)),
wordhit AS (SELECT doc_id, count(DISTINCT i + j) n_hit FROM (SELECT DISTINCT doc_id, m, i FROM hit), LATERAL (SELECT unnest(range(0, m)) j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN wordhit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
