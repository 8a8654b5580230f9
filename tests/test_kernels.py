"""Kernels against brute force, exact recovery and their invariants."""

import random

import pytest

from helixspark.operators.kernels import align, baselines, decode, guide

RATES = {"match": 0.95, "sub": 0.021, "ins": 0.016, "del": 0.019}


def strand(r, n=110):
    return "".join(r.choice("ACGT") for _ in range(n))


def noisy(r, s, p=0.02):
    out = ""
    for c in s:
        u = r.random()
        out += "" if u < p else r.choice("ACGT".replace(c, "")) if u < 2 * p else c
        out += r.choice("ACGT") if r.random() < p else ""
    return out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_align():
    r = random.Random(1)
    pairs = [(strand(r, r.randrange(1, 30)), strand(r, r.randrange(1, 30))) for _ in range(100)]
    d, steps = align.align([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), x, s in zip(pairs, d, steps, strict=True):
        assert x == levenshtein(a, b)
        p, q = align.left_normalize(*align.rows(a, b, s))
        assert p.replace("-", "") == a and q.replace("-", "") == b
        assert sum(u != v for u, v in zip(p, q, strict=True)) == x


def test_guide():
    r = random.Random(2)
    right = 0
    for _ in range(20):
        c = strand(r)
        g = guide.local_guide([noisy(r, c) for _ in range(10)], 110)
        assert len(g["sequence"]) == 110
        right += g["sequence"] == c
    assert right >= 18
    c = strand(r)
    assert guide.local_guide([c] * 3, 110)["sequence"] == c
    assert guide.local_guide([c] * 45, 110)["sequence"] == c  # the positional chain
    assert guide.local_guide(["", "NNN"], 110)["sequence"] == ""
    assert len(guide.local_guide([c[:60]], 110)["sequence"]) == 110


def test_trellis_keeps_and_mends():
    r = random.Random(3)
    c = strand(r)
    reads = [noisy(r, c, 0.01) for _ in range(12)]
    model = decode.Model(8, {}, {}, {})
    assert decode.trellis(c, reads, model, 0.0, 0.4, RATES) == c
    bad = c[:40] + ("A" if c[40] != "A" else "C") + c[41:]
    assert decode.trellis(bad, reads, model, 0.0, 0.4, RATES) == c
    assert decode.trellis(c, [], model, 0.5, 0.4, RATES) == c


def test_baselines():
    r = random.Random(4)
    c = strand(r)
    reads = [noisy(r, c, 0.01) for _ in range(12)]
    assert baselines.trace_posterior([c] * 3, 110) == c
    assert levenshtein(baselines.trace_posterior(reads, 110), c) <= 2


def test_frequency_consensus(spark):
    """Strands come back from noisy reads, and each choice is no worse than the cluster's medoid."""
    from helixspark.operators import clusters
    from helixspark.operators.baselines import frequency_consensus

    r = random.Random(8)
    strands = [strand(r) for _ in range(12)]
    rows = [(i, k, noisy(r, c, 0.02)) for i, c in enumerate(strands) for k in range(9)] + [(99, 0, strands[0])]
    reads = spark.createDataFrame(rows, "cluster_id long, read_idx int, read string")
    got = {x.cluster_id: x for x in frequency_consensus(reads, 110).collect()}
    assert len(got) == 13 and got[99].sequence == strands[0]
    assert sum(got[i].sequence == c for i, c in enumerate(strands)) >= 11
    for x in clusters.medoid_seed(reads, 110).collect():
        assert got[x.cluster_id].total <= sum(levenshtein(x.seed_read, y) for c, _, y in rows if c == x.cluster_id)


def test_reconstruct(spark):
    from helixspark.operators.reconstruct import Params, ablations, reconstruct

    r = random.Random(5)
    strands = [strand(r) for _ in range(24)]
    rows = [(i + 1, k, noisy(r, c, 0.015)) for i, c in enumerate(strands) for k in range(8)]
    reads = spark.createDataFrame(rows, "cluster_id long, read_idx int, read string")
    got = {x.cluster_id: x for x in reconstruct(reads).collect()}
    assert len(got) == 24 and all(len(x.sequence) == 110 for x in got.values())
    assert all(x.sequence == x.guide for x in got.values() if not x.joint_active)
    assert sum(got[i + 1].sequence == c for i, c in enumerate(strands)) >= 20
    off = reconstruct(reads, ablations(Params())["guide_only"]).collect()
    assert all(x.sequence == x.guide for x in off)


def test_scan_text(spark, tmp_path):
    from helixspark.sources import text

    sep = text.SEPARATOR
    (tmp_path / "c.txt").write_text(f"{sep}\nACGT\nAC GT\n{sep}\n{sep}\nTTTT\n{sep}\n")
    got = sorted(map(tuple, text.scan_clusters(spark, str(tmp_path / "c.txt")).collect()))
    assert got == [(1, 0, "ACGT"), (1, 1, "AC"), (1, 2, "GT"), (2, 0, "TTTT")]
    kept = sorted(map(tuple, text.scan_clusters(spark, str(tmp_path / "c.txt"), keep_empty=True).collect()))
    assert kept[-1] == (3, 0, "TTTT")
    (tmp_path / "f.fa").write_text(">a x\nACG\nT\n>b\nGG\n")
    assert [tuple(x) for x in text.scan_fasta(spark, str(tmp_path / "f.fa")).select("name", "seq").orderBy("name").collect()] == [("a x", "ACGT"), ("b", "GG")]
    (tmp_path / "bad.txt").write_text(f"{sep}\nACXT\n")
    with pytest.raises(Exception, match="not a read"):
        text.scan_clusters(spark, str(tmp_path / "bad.txt"), validate=True).collect()


def test_stream(spark, tmp_path):
    from helixspark.streaming.clusters import stream_guides

    r = random.Random(6)
    strands = [strand(r) for _ in range(3)]
    for i, c in enumerate(strands):
        spark.createDataFrame([(i, [c] * 3)], "cluster_id long, reads array<string>").write.parquet(str(tmp_path / f"in/{i}"))
    stream_guides(spark, str(tmp_path / "in/*"), str(tmp_path / "out"), str(tmp_path / "state"), 110).awaitTermination()
    got = {x.cluster_id: x.sequence for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == dict(enumerate(strands))


def test_boundaries_of_several_rows():
    """Rows of different lengths, with reads of none, one and many letters, against each insertion tried on its own."""
    import random

    from helixspark.operators.kernels.decode import boundaries

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diag, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        return row[-1]

    rng = random.Random(4)
    left, right, rows = "ACG", "TG", []
    for k in range(24):
        true = left + "".join(rng.choice("ACGT") for _ in range(rng.choice((6, 9)))) + right
        gone = rng.randrange(3, len(true) - 2)
        guide = "T" + true[:gone] + true[gone + 1 :]
        reads = [true[: rng.randrange(len(true) + 1)] if rng.random() < 0.4 else true for _ in range(rng.randrange(5))]
        rows.append((guide, reads if k else ["", "A"], rng.choice((0, len(guide) - 1))))
    want = []
    for guide, reads, position in rows:
        short = guide[:position] + guide[position + 1 :]
        options = [short[:p] + b + short[p:] for p in range(3, min(len(guide) - 1, len(short) + 1)) for b in "ACGT"]
        best = min(options, key=lambda o: sum(distance(o, r) for r in reads))
        gain = sum(distance(guide, r) - distance(best, r) for r in reads) + (3 if position == 0 else 2)
        want.append(best if reads and best != guide and gain > 0 else guide)
    assert boundaries(rows, left, right) == want
    assert [boundaries([row], left, right)[0] for row in rows] == want


def test_distances_of_many_letters_and_lengths():
    """Words of a column at their borders, chunks of any size, and sums that are taken where a string ends."""
    import numpy as np
    import pyarrow as pa

    import helixspark.functions.distance as D

    rng = random.Random(12)
    texts = ["", "A", "A" * 63, "A" * 64, "C" * 65, "G" * 128, "é🦆x"] + ["".join(rng.choices("ACGTN", k=rng.randint(0, 140))) for _ in range(25)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    i, j = (x.ravel() for x in np.indices((len(texts), len(texts))))
    want = [plain(texts[a], texts[b]) for a, b in zip(i, j, strict=True)]
    assert D.distances(pa.array(texts), i, j).tolist() == want


def test_space_of_distances_follows_a_chunk(monkeypatch):
    """Long strings take small chunks, whatever the number of pairs."""
    import numpy as np
    import pyarrow as pa

    import helixspark.functions.distance as D

    sizes = []
    monkeypatch.setattr(D, "_columns", lambda *x: sizes.append(len(x[-1])) or np.zeros(len(x[-1])))
    same = np.zeros(3000, np.int64)
    D.distances(pa.array(["ACGT" * 5000]), same, same)
    assert sum(sizes) == 3000 and max(sizes) * 20000 <= D._CELLS
