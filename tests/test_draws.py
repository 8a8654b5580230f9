"""Strands of texts and noisy copies, against their plain definitions."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from helixspark.functions import draws
from helixspark.sources import fixture


def drawn(strand: str, key: str, rates=(1245, 1376, 1048)):
    own, kept, more = list(strand), [], []
    for p, b in enumerate(own, 1):
        h = hashlib.md5(f"{key}:{p}".encode()).hexdigest()
        shifted = "ACGT"[("ACGT".index(b) + 1 + int(h[13], 16) % 3) % 4]
        kept.append("" if int(h[:4], 16) < rates[0] else shifted if int(h[4:8], 16) < rates[1] else b)
        more.append("ACGT"[int(h[12], 16) % 4] if int(h[8:12], 16) < rates[2] else "")
    read = "".join(k + m for k, m in zip(kept, more, strict=True))
    ref_row = "".join(b + "-" * len(m) for b, m in zip(own, more, strict=True))
    return read, ref_row, "".join((k or "-") + m for k, m in zip(kept, more, strict=True))


def test_md5_head():
    heads = [f"{c}:{r}:".encode() for c in (1, 99, 10**18, -(10**18)) for r in (0, 7, 10, 2**31 - 1)]
    first, second = draws._draws(heads, 1001)
    for i, h in enumerate(heads):
        digests = [hashlib.md5(h + str(p).encode()).digest() for p in range(1, 1002)]
        assert first[i].tolist() == [int.from_bytes(d[:4], "big") for d in digests]
        assert second[i].tolist() == [int.from_bytes(d[4:8], "big") for d in digests]


def test_copies(spark):
    """Strands of different lengths, copies of one key and of many; no draw runs letter by letter in an expression."""
    rng = np.random.default_rng(1)
    strands = {c: "".join(rng.choice(list("ACGT"), n)) for c, n in ((1, 110), (2, 1), (12, 9), (12345678901, 120), (3, 110))}
    df = spark.createDataFrame(list(strands.items()), "cluster_id long, center string")
    channel = fixture.Channel(9000, 9000, 9000)
    reads = fixture.simulate_reads(df, F.lit(12), channel)
    aligned = fixture.simulate_aligned(df, F.lit(12), channel)
    want = {(c, i): drawn(s, f"{c}:{i}", (9000, 9000, 9000)) for c, s in strands.items() for i in range(12)}
    assert {(r.cluster_id, r.read_idx): r.read for r in reads.collect()} == {k: v[0] for k, v in want.items()}
    assert {(r.cluster_id, r.read_idx): (r.ref_row, r.read_row) for r in aligned.collect()} == {k: v[1:] for k, v in want.items()}
    for made in (reads, aligned):
        assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_strands_of(spark):
    """Null, empty and letterless texts have none; short ones fill up by themselves; other letters and signs are left out."""
    long = "acgtTGCAé\n漢 xyz" * 40
    texts = {1: None, 2: "", 3: "hello wörld?!".replace("t", ""), 4: "xA", 5: "aCg-t", 6: long, 7: "ACGT" * 50}
    got = fixture.strands_of(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 110).orderBy("cluster_id").collect()
    want = []
    for d, t in texts.items():
        s = "".join(c for c in t or "" if c in "ACGTacgt").upper()
        want += [(d, p // 110, (s[p : p + 110] + s * 110)[:110]) for p in range(0, len(s), 110)]
    assert [(r.doc_id, r.piece, r.center) for r in got] == want and [r.cluster_id for r in got] == list(range(1, len(want) + 1))


def test_alignments_are_dealt(spark):
    """Clusters that a join left in one partition are aligned by several tasks, pairs of several clusters together."""
    from helixspark.operators import reconstruct

    rows = [(c, ["ACGTACGT"[: c % 9], "ACGGT"], "ACGTACG" + "T" * (c % 3)) for c in range(300)]
    out = reconstruct.alignments(spark.createDataFrame(rows, "cluster_id long, reads array<string>, center string").coalesce(1))
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1 and len(got) == 600
    for r in got:
        assert r.ref_row.replace("-", "") == rows[r.cluster_id][2] and r.read_row.replace("-", "") == rows[r.cluster_id][1][r.read_idx]
        assert r.distance == sum(x != y for x, y in zip(r.ref_row, r.read_row, strict=True))


def test_centrality_and_least_k(spark):
    """Short, empty and repetitive reads; neither query explodes k-mers or runs over letters in an expression."""
    from helixspark.operators import baselines, clusters

    reads = {1: ["ACGTACGTAC", "ACGTACGTCC", "ACG"], 2: [""], 3: ["A" * 80], 4: ["ACGTTGCA", "ACGTTGCA"]}
    df = spark.createDataFrame([(c, i, r) for c, x in reads.items() for i, r in enumerate(x)], "cluster_id long, read_idx int, read string")
    seeds, sizes = clusters.centrality_seed(df, 10), baselines.select_k(df)
    assert sorted((r.cluster_id, r.seed, r.score) for r in seeds.collect()) == [(1, 0, 2.0), (2, 0, -0.55), (3, 0, -2.85), (4, 0, 1.89)]
    assert dict(map(tuple, sizes.select("cluster_id", "k").collect())) == {1: 8, 2: 5, 3: 64, 4: 5}
    for made in (seeds, sizes):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "aggregate(" not in plan


def test_clusters_are_drawn_in_rows(spark, monkeypatch):
    """A cluster's row has the reads that are drawn one by one; strands are numbered over many ranges, without a window over them."""
    strands = {1: "ACGT" * 30, 2: "A", 5: "", 12345678901: "TTGCA" * 9}
    df = spark.createDataFrame(list(strands.items()), "cluster_id long, center string")
    channel, copies = fixture.Channel(9000, 9000, 9000), F.when(F.col("cluster_id") == 2, 0).otherwise(F.col("cluster_id") % 4 + 1)
    for aligned, one in ((False, fixture.simulate_reads), (True, fixture.simulate_aligned)):
        rows = fixture.simulate_clusters(df, copies, channel, aligned)
        assert rows.count() == 4 and rows.where("size(r) > 1 and r[1].read_idx <> 1").count() == 0
        got, want = (sorted(map(tuple, x.collect())) for x in (rows.select("cluster_id", F.inline("r")), one(df.where("cluster_id <> 2"), copies, channel)))
        assert got == want
    texts = spark.range(3000).select((F.col("id") * 977 - 5000).alias("doc_id"), F.repeat(F.lit("ACGTA"), (F.col("id") * 31 % 90).cast("int")).alias("text"))
    made = fixture.strands_of(texts, 110)
    assert "center" not in "".join(x for x in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x)
    got = [(r.doc_id, r.piece) for r in made.orderBy("cluster_id").collect()]
    assert got == sorted(got) and len(got) == sum(-(-(i * 31 % 90) * 5 // 110) for i in range(3000))
    assert made.agg(F.min("cluster_id"), F.max("cluster_id"), F.count_distinct("cluster_id")).first() == (1, len(got), len(got))
