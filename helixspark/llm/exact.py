"""Exact deduplication by Grace hashing: records are dealt by hash into spill files, again and again, until each bucket
fits an open-addressing table that compares complete contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm import textops
from helixspark.llm.runtime import id_text, spread, written

#: A row of the spill files: a text, what is known of the rows that have it, and its number of rows.
_RECORD = "digest binary, text binary, n long, points long, id long, ties long"
_RECORD_ARROW = pa.schema([("digest", pa.binary()), ("text", pa.large_binary()), ("n", pa.int64()), ("points", pa.int64()), ("id", pa.int64()), ("ties", pa.int64())])
_MARK_ARROW = pa.schema([("doc_id", pa.int64()), ("points", pa.int64()), ("digest", pa.binary())])
#: Rounds of dealing after which a table takes all that is left: 192 bits of a digest are used up by then.
_ROUNDS = 3
#: A class is hot if it has more than one row in so many; there are no more such classes than that.
_HOT = 4096


class _Table:
    """Distinct texts with what is known of their rows: linear probing in a table of at most half its slots filled.

    A slot is a text's own only if all bytes are equal; of equal texts the most code points, then the smallest id count.
    """

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def _slot(self, digest: bytes, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (i := self.slots[at]) >= 0:
            if self.rows[i][0] == digest:
                if self.rows[i][1] != text:
                    raise ValueError(f"two different texts have the SHA-256 {digest.hex()}")
                break
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, text: bytes, n: int, points: int, doc_id: int | None, ties: int) -> None:
        at = self._slot(digest, text)
        if (i := self.slots[at]) >= 0:
            row = self.rows[i]
            row[2] += n
            new, old = ((-p, d is None, d or 0) for p, d in ((points, doc_id), (row[3], row[4])))
            if new <= old:
                row[3:] = [points, doc_id, ties + (row[5] if new == old else 0)]
            return
        self.slots[at] = len(self.rows)
        self.rows.append([digest, text, n, points, doc_id, ties])
        self.bytes += len(text) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, row in enumerate(self.rows):
                self.slots[self._slot(row[0], row[1])] = i

    def emptied(self) -> Iterator[list]:
        rows, self.rows, self.slots, self.bytes = self.rows, [], [-1] * 1024, 0
        yield from rows


def _batches(rows: Iterator[list], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """rows as Arrow batches of about ``SLICE`` bytes; ``sized`` is the column whose length counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"") + 100
        if size > textops.SLICE:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes, bytes]]:
    """(doc_id, code points, digest and bytes of the text without white space) of each row of (doc_id, text)."""
    ids, points = batch.column(0).to_pylist(), pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    buf, offsets = textops.utf8(batch.column(1))
    for lo, hi in textops.slices(offsets):
        part = buf[offsets[lo] : offsets[hi]]
        keep = textops.NON_SPACE[part]
        ends = np.concatenate(([0], np.cumsum(keep)))[offsets[lo : hi + 1] - offsets[lo]].tolist()
        data = part[keep].tobytes()
        for i in range(lo, hi):
            text = data[ends[i - lo] : ends[i - lo + 1]]
            yield ids[i], points[i], hashlib.sha256(text).digest(), text


def _gathered(limit: int):
    """Rows to records: equal texts of one task become one record before they are dealt out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            table = _Table()
            for batch in batches:
                for doc_id, points, digest, text in _read(batch):
                    table.add(digest, text, 1, points, doc_id, 1)
                    if table.bytes > limit:
                        yield from table.emptied()
            yield from table.emptied()

        yield from _batches(rows(), _RECORD_ARROW, 1)

    return run


def _bucket(limit: int | None):
    """A bucket's records to its classes, whose text is null; if they do not fit, records go on to the next round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            table, spilt = _Table(), False
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if spilt:
                        yield row
                        continue
                    table.add(*row)
                    if limit is not None and table.bytes > limit and len(table.rows) > 1:
                        spilt = True
                        yield from table.emptied()
            yield from ([r[0], None, *r[2:]] for r in table.emptied())

        yield from _batches(rows(), _RECORD_ARROW, 1)

    return run


def classes(rows: DataFrame, n_bytes: int, limit: int = 64 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(digest, n, points, id, ties) for each distinct text of rows(doc_id, text): its SHA-256, its number of rows, the
    most code points a row of it has, the smallest id of those rows, and how many rows have both.

    Each round deals the records by eight more bytes of their digests into buckets of about ``bucket_bytes``. A bucket
    that grows beyond ``limit`` bytes of distinct texts leaves its records in the round's table in the shared folder,
    from where the next round deals them into smaller ones. A lost executor costs the tasks of one round.
    """
    spark = rows.sparkSession
    records, left, found = rows.mapInArrow(_gathered(limit // 4), _RECORD), n_bytes, None
    for k in range(_ROUNDS + 1):
        dealt = records.repartition(spread(spark, left, bucket_bytes), F.xxhash64(F.substring("digest", 1 + 8 * min(k, _ROUNDS - 1), 8)))
        out = written(dealt.mapInArrow(_bucket(limit if k < _ROUNDS else None), _RECORD), "buckets")
        done = out.where("text is null").drop("text")
        found = done if found is None else found.unionByName(done)
        left = out.agg(F.sum(F.octet_length("text"))).first()[0]
        if left is None:
            return found
        records, bucket_bytes = out.where("text is not null"), max(1, bucket_bytes // 4)
    return found


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _batches(([d, p, h] for d, p, h, _ in _read(batch)), _MARK_ARROW, 2)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 64 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Which of the rows whose texts are equal but for ASCII white space (space, 9 to 13) stays.

    Returns for each row: doc_id, keep_id (the doc_id of the row that stays: most code points in the text as it is, then
    smallest doc_id), group_size, kept, text_sha256 (of the text without white space). A null text counts as an empty
    one, and all empty texts are equal. A null doc_id comes after all others. Of rows that repeat id, length and class
    of the one that stays, exactly one is kept. An empty table gives an empty result; other columns are not read.

    Rows find their class by the digest that the tables compared contents for. Classes with more than one row in 4,096
    are broadcast (there are fewer than 4,096 of them); rows of those are spread over all tasks of the join for the rest.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    found = classes(rows, n_bytes, limit, bucket_bytes)
    marks = rows.mapInArrow(_marks, "doc_id long, points long, digest binary")
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in ("digest", "n", "points", "id", "ties")))
    hot = F.broadcast(named(found.where(F.col("n") > total / _HOT), "h_"))
    cold = named(found.where(F.col("n") <= total / _HOT), "c_")
    out = marks.join(hot, F.col("digest") == F.col("h_digest"), "left")
    elsewhere = F.concat("digest", F.encode(F.hex(F.xxhash64("doc_id", F.monotonically_increasing_id())), "UTF-8"))  # longer than any digest
    out = out.withColumn("key", F.when(F.col("h_n").isNull(), F.col("digest")).otherwise(elsewhere)).join(cold, F.col("key") == F.col("c_digest"), "left")
    of = lambda c: F.when(F.col("h_n").isNull(), F.col(f"c_{c}")).otherwise(F.col(f"h_{c}"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == of("points"))
    out = out.withColumn("keep_id", of("id")).select("doc_id", "keep_id", of("n").alias("group_size"), best.alias("kept"), "digest", of("ties").alias("ties"))
    if not found.where("ties > 1").isEmpty():
        # which of several equal rows stays cannot be seen in the result: the first of each class in any order
        tied = F.col("kept") & (F.col("ties") > 1)
        first = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id")) == 1
        out = out.where(~tied).unionByName(out.where(tied).withColumn("kept", first))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w keep_id, count(*) OVER (PARTITION BY t) group_size, row_number() OVER w = 1 kept, sha256(t) text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
