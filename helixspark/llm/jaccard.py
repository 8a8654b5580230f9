"""N-gram Jaccard join with prefix filters under several global token orders.

A pair of sets with Jaccard similarity >= t shares a token among the first n - ceil(t*n) + 1 tokens of each set, under
any global token order. Here a candidate must do so under three orders (all rarest first, with different frequency
classes and tie breaks) before the sets themselves are compared.

1. Each whole text becomes its set of word-shingle hashes; equal sets form one class (one node), named by 64 bits of a
   128-bit hash of the set. Names that different sets share (some at 10^10 texts) are found and replaced.
2. Tokens go to token buckets as packed blobs. A bucket counts the classes that have a token; tokens of one class cannot
   link anything, so only their number returns to the class. The few tokens that a fixed share of all texts has never
   meet in a bucket: they are last in every order, and only travel with their class.
3. A class with fewer frequent tokens than its prefix has room for rare ones has no candidates. The others post the
   rest of their prefix.
4. Rounds. In the first, a token's classes are candidates of its smallest class only. In later rounds only tokens whose
   classes are still in different components count: first each class proposes its nearest classes, at last all pairs of
   different components. A token of many classes is cut by set size first (sizes of a pair differ by the threshold at
   most), then into blocks of a bounded number of classes. Parity sketches (whose distance never exceeds the sets'
   difference) drop pairs inside the task, so candidate rows follow the links and not the squares of groups.
5. Candidates are verified under the second and third order and then on the whole sets; links become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm import textops
from helixspark.llm.graph import components, merged
from helixspark.llm.runtime import discard, id_text, spread, written

#: A token is hot, and last in every order, if at least this share of the texts has it; so there are at most
#: average set size / HOT_SHARE hot tokens, whatever the number of texts.
HOT_SHARE = 1 / 256
_HOT = 1 << 31
_REC = np.dtype([("c", "<i8"), ("t", "<u8"), ("d", "<u4")])
_LOW = np.uint64((1 << 56) - 1)
SKETCH_WORDS = 16
BLOCK = 2048


def _class_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: the name of its class, and what tells sets of one name apart."""
    folded = np.array([np.bitwise_xor.reduce(textops.mix(tokens)), tokens.sum(), len(tokens)], dtype=np.uint64)
    name = textops.mix(textops.mix(folded) + folded[[1, 2, 0]]).sum(keepdims=True)
    other = textops.mix(textops.mix(folded ^ textops._C) + textops.mix(folded[[2, 0, 1]])).sum(keepdims=True)
    return int(name.view(np.int64)[0]), int(other.view(np.int64)[0])


def _renamed(twins: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """New names for the classes whose names different sets share."""
    out: dict[tuple[int, int], int] = {}
    for name, other in sorted(twins):
        both = np.array([name, other], dtype=np.int64).view(np.uint64)
        out[name, other] = int(textops.mix(textops.mix(both[:1]) + both[1:]).view(np.int64)[0])
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(doc ids, sets) of each slice."""
    for batch in batches:
        buf, offsets = textops.utf8(batch.column(1))
        for lo, hi in textops.slices(offsets):
            yield batch.column(0).slice(lo, hi - lo), textops.shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)


def _describe(k: int):
    """Each text's set size and class (kind 0); and tokens that this task has often (kind 1, class: token, size: texts)."""
    names = ["kind", "doc_id", "n_shingles", "class", "other"]

    def frequent(held):
        t, n = np.unique(np.concatenate([x for x, _ in held]), return_counts=True)
        n_docs = sum(x for _, x in held)
        keep = n >= max(16, n_docs * HOT_SHARE)
        m = int(keep.sum())
        return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(n[keep].astype(np.int64)), pa.array(t[keep].view(np.int64)), pa.nulls(m, pa.int64())], names=names)

    def run(batches):
        held, size, seen = [], 0, set()
        for ids, sets in _sets(batches, k):
            classes = [_class_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), ids, pa.array([len(s) for s in sets], pa.int64()), *(pa.array([c[i] for c in classes], pa.int64()) for i in (0, 1))], names=names)
            new = []
            for c, s in zip(classes, sets, strict=True):
                if c[0] is not None and c not in seen:
                    seen.add(c)
                    new.append(s)
            if new:
                held.append((np.concatenate(new), len(new)))
                size += len(held[-1][0])
            if size > 1 << 22:
                yield frequent(held)
                held, size, seen = [], 0, set()
        if held:
            yield frequent(held)

    return run


def _post(k: int, buckets: int, hot: np.ndarray, names: dict[tuple[int, int], int]):
    """Packed tokens by token bucket; a class's hot tokens and size by a bucket of the class (kind 1)."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)

    def run(batches):
        pending, size, seen = [], 0, set()
        for _, sets in _sets(batches, k):
            for s in sets:
                if not len(s):
                    continue
                both = _class_of(s)
                if (c := names.get(both, both[0])) not in seen:
                    seen.add(c)
                    pending.append((c, s))
                    size += len(s)
            if size > 1 << 20:
                yield from flush(pending)
                pending, size, seen = [], 0, set()
        if pending:
            yield from flush(pending)

    def flush(pending):
        classes = np.array([c for c, _ in pending], dtype=np.int64)
        lens = np.array([len(s) for _, s in pending])
        t = np.concatenate([s for _, s in pending])
        own = np.repeat(np.arange(len(classes)), lens)
        is_hot = hot[np.minimum(np.searchsorted(hot, t), len(hot) - 1)] == t if len(hot) else np.zeros(len(t), bool)
        meta = np.zeros(len(classes) + int(is_hot.sum()), dtype=_REC)
        meta["c"] = np.concatenate((classes, classes[own[is_hot]]))
        meta["t"] = np.concatenate((lens.astype(np.uint64), t[is_hot]))
        meta["d"][len(classes) :] = _HOT
        at = (textops.mix(meta["c"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        ids, kinds, blobs = [], [], []
        for b, blob in _split(at, meta):
            ids.append(b), kinds.append(1), blobs.append(blob.tobytes())
        t, own = t[~is_hot], own[~is_hot]
        bucket = (t >> shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # tokens of a class stay together
        t, own, bucket = t[order], own[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            tt, oo = t[cuts[b] : cuts[b + 1]], own[cuts[b] : cuts[b + 1]]
            first = np.flatnonzero(np.concatenate(([True], oo[1:] != oo[:-1])))
            counts = np.diff(np.append(first, len(oo)))
            low = np.ascontiguousarray((tt & _LOW).view(np.uint8).reshape(-1, 8)[:, :7])
            ids.append(b), kinds.append(0)
            blobs.append(np.uint32(len(first)).tobytes() + classes[oo[first]].tobytes() + counts.astype(np.uint32).tobytes() + low.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "data"])

    return run


def _split(at: np.ndarray, rows: np.ndarray):
    if not len(at):
        return
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        yield int(at[a]), rows[a:b]


def _unpost(blob: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    classes, counts = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n)
    low = np.frombuffer(blob, np.uint8, offset=4 + 12 * n).reshape(-1, 7)
    t = np.zeros((len(low), 8), dtype=np.uint8)
    t[:, :7] = low
    return t.view("<u8").ravel(), np.repeat(classes, counts)


def _count(buckets: int):
    """In a token bucket: the tokens of two classes or more, sent to the classes with the number of classes."""
    top = np.uint64(buckets.bit_length() - 1)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        out, tokens, classes = [], [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind:
                out.append((b, blob))
            else:
                t, c = _unpost(blob, b)
                tokens.append(t), classes.append(c)
        if tokens:
            t, c = np.concatenate(tokens), np.concatenate(classes)
            order = np.argsort(t)
            t, c = t[order], c[order]
            same = t[1:] == t[:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            t, c = t[several], c[several]
            order = np.lexsort((c, t))  # copies of a class in other tasks count once
            t, c = t[order], c[order]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1]))) if len(t) else np.zeros(0, bool)
            t, c = t[new], c[new]
            _, inverse, n = np.unique(t, return_inverse=True, return_counts=True)
            keep = n[inverse] > 1
            rows = np.zeros(int(keep.sum()), dtype=_REC)
            rows["c"], rows["d"] = c[keep], n[inverse][keep]
            # the bucket's own bits make up for those that the blob leaves out
            rows["t"] = textops.mix((t[keep] << top) | np.uint64(b))
            out += [(to, np.sort(r, order="c").tobytes()) for to, r in _split((textops.mix(rows["c"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), rows)]
        return pa.table([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["to", "data"])

    return run


def _orders(t: np.ndarray, d: np.ndarray, size: int) -> list[np.ndarray]:
    """The first ``size`` tokens under each of the three orders."""
    log = np.ceil(np.log2(d))
    keys = [(t, d), (textops.mix(t + np.uint64(0x5851F42D4C957F2D)), log), (textops.mix(t ^ np.uint64(0x14057B7EF767814F)), np.ceil(log / 2))]
    return [t[np.lexsort(k)[:size]] for k in keys]


_SET = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("tokens", pa.binary()), ("prefixes", pa.list_(pa.binary())), ("sketch", pa.binary())])


def _prefixes(num: int, den: int):
    """In a class bucket: the classes whose prefix holds a token of another class."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.sort(np.unique(textops.unpacked(table.column("data").to_pylist(), _REC)), order=["c", "d"])
        out = []
        c = rows["c"]
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, int)
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(c)).tolist() if len(c) else [], strict=True):
            own = rows[a:b]
            n, t, d = int(own["t"][0]), own["t"][1:], own["d"][1:]  # d is 0 in the class's own record, which is first
            rare = n - len(t)
            room = n - -(-num * n // den) + 1 - rare
            if room <= 0 or not len(t):
                continue
            bits = (textops.mix(t) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
            sketch = np.packbits((np.bincount(bits, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8))
            out.append((int(own["c"][0]), n, rare, np.sort(t).tobytes(), [x.tobytes() for x in _orders(t, d, room)], sketch.tobytes()))
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_SET)], schema=_SET)

    return run


def _tokens(batches):
    for batch in batches:
        first = [np.frombuffer(x[0], "<i8") for x in batch.column("prefixes").to_pylist()]
        sizes = [len(x) for x in first]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*first, np.zeros(0, "<i8")])), pa.array(np.repeat(batch.column("class").to_numpy(), sizes))], names=["token", "class"])


def _near(n1, n2, rare1, rare2, s1, s2, num, den):
    """Whether the parity sketches allow a similarity of num/den; and by how much."""
    apart = np.bitwise_count(s1 ^ s2).sum(axis=-1, dtype=np.int64) + rare1 + rare2
    # |A ^ B| <= (den - num) / (den + num) * (|A| + |B|) where the similarity is at least num / den
    slack = (den - num) * (n1 + n2) - (den + num) * apart
    return slack


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, SKETCH_WORDS)


def _filter_pairs(num: int, den: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = {x: batch.column(x) for x in batch.schema.names}
                ints = {x: c[x].to_numpy().astype(np.int64) for x in ("n1", "n2", "rare1", "rare2")}
                ok = _near(ints["n1"], ints["n2"], ints["rare1"], ints["rare2"], _sketches(c["s1"]), _sketches(c["s2"]), num, den) >= 0
                yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(ok)), c["b"].filter(pa.array(ok))], names=["a", "b"])

    return run


def _cross_pairs(num: int, den: int, nearest: int):
    """In a block of a token's classes: pairs of different components that the sketches allow.

    ``nearest`` > 0 keeps that many pairs for each class, the likeliest; 0 keeps all.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        cls, comp = table.column("class").to_numpy(), table.column("comp").to_numpy()
        n, rare, side, upper = (table.column(x).to_numpy().astype(np.int64) for x in ("n", "rare", "side", "upper"))
        s = _sketches(table.column("sketch"))
        a, b = [], []
        left, right = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
        for i in left.tolist():
            to = right[(comp[right] != comp[i]) & ((cls[right] > cls[i]) | (side[i] == 1)) & (upper[right] + upper[i] < 2)]
            if not len(to):
                continue
            slack = _near(n[i], n[to], rare[i], rare[to], s[i], s[to], num, den)
            good = np.flatnonzero(slack >= 0)
            if nearest and len(good) > nearest:
                good = good[np.argsort(-slack[good], kind="stable")[:nearest]]
            a += [int(cls[i])] * len(good)
            b += cls[to[good]].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _verify(num: int, den: int):
    """Prefixes under the second and third order must meet, and the sets must be similar."""

    def run(batches):
        for batch in batches:
            ok = []
            for p1, p2, t1, t2, n1, n2 in zip(*(batch.column(x).to_pylist() for x in ("p1", "p2", "t1", "t2", "n1", "n2")), strict=True):
                if all(len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(p1[1:], p2[1:], strict=True)):
                    both = len(np.intersect1d(np.frombuffer(t1, "<u8"), np.frombuffer(t2, "<u8"), assume_unique=True))
                    ok.append(den * both >= num * (n1 + n2 - both))
                else:
                    ok.append(False)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, sketched: bool) -> DataFrame:
    def side(i: int, key: str, *cols: tuple[str, str]) -> DataFrame:
        return sets.select(F.col("class").alias(key), F.col("n").alias(f"n{i}"), *(F.col(x).alias(y) for x, y in cols))

    if not sketched:
        heads = pairs.join(side(1, "a", ("rare", "rare1"), ("sketch", "s1")), "a").join(side(2, "b", ("rare", "rare2"), ("sketch", "s2")), "b")
        pairs = heads.mapInArrow(_filter_pairs(num, den), "a long, b long")
    full = pairs.join(side(1, "a", ("prefixes", "p1"), ("tokens", "t1")), "a").join(side(2, "b", ("prefixes", "p2"), ("tokens", "t2")), "b")
    return full.mapInArrow(_verify(num, den), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group whole texts whose sets of k-word shingles have a Jaccard similarity of num/den or more, by chains of links.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer than k words is one
    shingle; a text without words (or null) has none and is linked with nothing.

    Returns for each row: doc_id, n_shingles, class_id (texts of equal sets share it; null without words) and
    component_id, the smallest doc_id reachable by links, itself included. Each row counts as a text of its own, so rows of
    one doc_id with different texts may have different components. Rows with a null doc_id link texts as others do; their
    component_id is null only where no row of the component has an id. Other columns are not read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    info = written(rows.mapInArrow(_describe(k), "kind int, doc_id long, n_shingles long, class long, other long"), "sets")
    table = info.where("kind = 0").drop("kind")
    total, n_tokens = table.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    hot = info.where("kind = 1").groupBy("class").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= max(64, total * HOT_SHARE)).select("class").toPandas()["class"].to_numpy()
    hot = np.sort(hot.astype(np.int64).view(np.uint64))
    # sets whose names meet by chance: about total ** 2 / 2 ** 65 of them, so few at any size
    twins = table.groupBy("class").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("class")
    names = _renamed([tuple(r) for r in table.join(F.broadcast(twins), "class").select("class", "other").distinct().collect()])
    if names:
        new = spark.createDataFrame([(*c, n) for c, n in names.items()], "class long, other long, new long")
        table = table.join(F.broadcast(new), ["class", "other"], "left").withColumn("class", F.coalesce("new", "class")).drop("new")
    n_parts = spread(spark, 8 * n_tokens)
    buckets = 1 << max(4, (n_parts - 1).bit_length())
    posted = rows.mapInArrow(_post(k, buckets, hot, names), "bucket int, kind int, data binary").repartition(n_parts, "bucket")
    counted = posted.groupBy("bucket").applyInArrow(_count(buckets), "to int, data binary").repartition(n_parts, "to")
    sets = written(counted.groupBy("to").applyInArrow(_prefixes(num, den), "class long, n int, rare int, tokens binary, prefixes array<binary>, sketch binary"), "prefixes")
    every = written(sets.select("class", "prefixes").mapInArrow(_tokens, "token long, class long"), "postings")
    # tokens of the same classes say the same: one of them is enough
    sums = every.groupBy("token").agg(F.count("*").alias("g"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("s"), F.min("class").alias("low")).where("g > 1")
    tokens = sums.groupBy("g", "s", "low").agg(F.min("token").alias("token"))
    post = written(every.join(tokens, "token").select("token", "class", "low", "g"), "postings")
    discard(every)
    links = written(_links(post.where("class <> low").select(F.col("low").alias("a"), F.col("class").alias("b")).distinct(), sets, num, den, False), "links")
    comp = components(links)
    discard(links)
    for nearest in (1, 4, 0):
        pairs = written(_candidates(post, sets, comp, num, den, nearest), "pairs")
        if pairs.isEmpty():  # no pair of different components is left, at any setting of nearest
            discard(pairs)
            break
        new = written(_links(pairs, sets, num, den, True), "links")
        if not new.isEmpty():
            comp = merged(comp, new)
        discard(pairs, new)
    discard(post, sets)
    low = table.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low")).join(comp.withColumnRenamed("node", "class"), "class", "left")
    low = low.withColumn("component", F.coalesce("component", "class"))
    root = low.groupBy("component").agg(F.min("low").alias("root"))
    named = low.join(root, "component").select("class", "root")
    return table.join(named, "class", "left").select("doc_id", "n_shingles", F.col("class").alias("class_id"), F.coalesce("root", "doc_id").alias("component_id"))


def _candidates(post: DataFrame, sets: DataFrame, comp: DataFrame, num: int, den: int, nearest: int) -> DataFrame:
    of = post.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class"))
    open_ = of.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    of = of.join(open_, "token").join(sets.select("class", "n", "rare", "sketch"), "class")
    # sizes of a pair differ by one level at most: a class meets its own level (as a lower one) and the one below (as an
    # upper one, which other upper ones do not meet there); tokens of one block need no levels
    level = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * (1 + 1e-9))).cast("int")
    many = F.col("g") > BLOCK
    one = lambda lv, up: F.struct(lv.alias("level"), F.lit(up).alias("upper"))
    of = of.withColumn("at", F.explode(F.when(many, F.array(one(level, 0), one(level - 1, 1))).otherwise(F.array(one(F.lit(0), 0))))).select("*", "at.level", "at.upper").drop("at")
    # a level's classes in blocks; a pair of blocks is one group, so no group exceeds two blocks whatever the token
    size = of.where(many).groupBy("token", "level").agg(F.count("*").alias("size"))
    of = of.join(size, ["token", "level"], "left").withColumn("nb", F.ceil(F.coalesce("size", "g") / BLOCK).cast("int"))
    of = of.withColumn("block", F.pmod(F.xxhash64("class"), F.col("nb")).cast("int"))
    pair = F.when(F.col("other") == F.col("block"), 0).when(F.col("other") > F.col("block"), 1).otherwise(2)
    of = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", pair)
    of = of.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    grouped = of.select("token", "level", "i", "j", "side", "upper", "class", "comp", "n", "rare", "sketch").groupBy("token", "level", "i", "j")
    return grouped.applyInArrow(_cross_pairs(num, den, nearest), "a long, b long").distinct()


def op4_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id")
