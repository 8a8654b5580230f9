"""Work that is done within Arrow batches or clusters' rows, against plain code."""

import hashlib
import random

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fitted_lengths_are_drawn_in_batches(spark):
    """Letters of any kind, keys of over one block, and reads of no letters; no digest is a column."""
    from helixspark.functions.sequence import fit_length

    r = random.Random(1)
    rows = [("".join(r.choices("ACGTé🦆", k=n)), "k" * (90 if i % 5 == 0 else 3) + str(i)) for i, n in enumerate((0, 1, 2, 5, 8, 9, 10, 11, 12, 13, 30, 121, 5, 300))]
    df = spark.createDataFrame([*rows, (None, "x")], "read string, key string").select("read", "key", fit_length(F.col("read"), F.col("key"), 10, 1).alias("fitted"))
    assert "md5" not in plan(df)
    got = {(x.read, x.key): x.fitted for x in df.collect()}
    for read, key in rows:
        order = sorted(range(1, len(read) + 1), key=lambda i: (hashlib.md5(f"{key}:{i}".encode()).hexdigest(), i))
        gone, more = set(order[: max(0, len(read) - 11)]), set(order[: max(0, 9 - len(read))])
        want = "".join("" if i in gone else "A" * (i in more) + x for i, x in enumerate(read, 1))
        assert got[read, key] == want + "A" * (9 - len(want))
    assert got[None, "x"] is None


def test_drawn_places_that_share_64_bits(monkeypatch):
    """Whole digests decide where their first words do not."""
    import numpy as np

    from helixspark.functions import draws

    monkeypatch.setattr(draws, "_draws", lambda heads, n: (np.zeros((len(heads), n), np.uint32),) * 2)
    first = draws._first_drawn([b"a:", b"b:"], np.array([6, 9]), np.array([2, 3]))
    for row, head, n, most in zip(first, "ab", (6, 9), (2, 3), strict=True):
        order = sorted(range(n), key=lambda p: hashlib.md5(f"{head}:{p + 1}".encode()).digest())
        assert set(np.flatnonzero(row)) == set(order[:most])


def test_histogram_takes_distances_within_rows(spark):
    from helixspark import catalog

    assert "levenshtein" not in plan(catalog.queries()["ed_histogram"](spark, "/root/testdata/sf0.001"))


def test_alignments_of_many_pairs(spark, monkeypatch):
    """Rows of batches are those of the steps one by one, for words at their borders, small chunks and letters of any kind."""
    import numpy as np
    import pyarrow as pa

    from helixspark.operators.kernels import align as A
    from helixspark.operators.reconstruct import alignments

    r, pairs = random.Random(2), [("", ""), ("A", ""), ("", "AC")]
    for n in (1, 3, 10, 63, 64, 65, 110, 130):
        for p in (0.0, 0.05, 0.3, 1.0):
            ref = "".join(r.choices("ACGT"[: r.choice((2, 4))], k=n))
            pairs += [(ref, "".join("" if r.random() < p else x if r.random() > p else r.choice("ACGTN") + "A" * (r.random() < 0.3) for x in ref)) for _ in range(4)]
    _, steps = A.align([a for a, _ in pairs], [b for _, b in pairs])
    want = [A.left_normalize(*A.rows(a, b, s)) for (a, b), s in zip(pairs, steps, strict=True)]
    both, i = pa.array([a for a, _ in pairs] + [b for _, b in pairs]), np.arange(len(pairs))
    for space in (1, 1 << 24):
        monkeypatch.setattr(A, "_SPACE", space)
        found = [(part, x, y, letters) for part, _, x, y, letters in A.gapped(both, i, i + len(pairs))]
        assert len(found) == (len(pairs) if space == 1 else 1)
        assert [v for _, x, y, letters in found for v in zip(A.texts(x, letters).to_pylist(), A.texts(y, letters).to_pylist(), strict=True)] == want
    df = spark.createDataFrame([(k, [b, a, "é🦆" + b], a) for k, (a, b) in enumerate(pairs)], "cluster_id long, reads array<string>, center string")
    rows = alignments(df).collect()
    assert {(x.cluster_id, x.ref_row, x.read_row) for x in rows if x.read_idx == 0} == {(k, *w) for k, w in enumerate(want)}
    assert all(x.read_row.replace("-", "") == df_reads and x.distance == sum(a != b for a, b in zip(x.ref_row, x.read_row, strict=True)) for x in rows for df_reads in [[pairs[x.cluster_id][1], pairs[x.cluster_id][0], "é🦆" + pairs[x.cluster_id][1]][x.read_idx]])
    counts = {(x.cluster_id, x.read_idx): tuple(x[2:]) for x in alignments(df, counts=True).collect()}
    kind = lambda a, b: "i" if a == "-" else "d" if b == "-" else "m" if a == b else "s"
    assert counts == {(x.cluster_id, x.read_idx): tuple("".join(map(kind, x.ref_row, x.read_row)).count(k) for k in "msid") for x in rows}


def test_guides_of_many_clusters_together():
    """Guides of a batch are those one by one: clusters of none, one, few, many and deep reads, and other letters."""
    from helixspark.operators.kernels import guide

    r, raw = random.Random(3), []
    for n in (0, 1, 2, 3, 4, 5, 9, 16, 20, 21, 30, 45):
        c = "".join(r.choices("ACGT", k=110))
        raw.append(["".join("" if r.random() < 0.03 else x if r.random() > 0.03 else r.choice("ACGT") for x in c) for _ in range(n)])
    raw += [["", "NN"], ["acgtN" * 22, "ACGT" * 27], ["A"], ["A" * 300, "ACGT"]]
    got = guide.local_guides(raw, 110)
    assert got == [guide.local_guide(x, 110) for x in raw]
    assert [len(g["sequence"]) for g in got] == [110 if guide.cleaned(x) else 0 for x in raw]
    assert [g["seed_read_index"] for g in got][:2] == [-1, 0] and [g["num_reads"] for g in got][12:] == [0, 2, 1, 2]
    # of letters that as many reads have the first one counts
    tie = guide.local_guides([["ACGT" * 10 + "C" + "ACGT" * 10, "ACGT" * 10 + "G" + "ACGT" * 10]], 81)[0]
    assert tie["sequence"] == "ACGT" * 10 + "C" + "ACGT" * 10 and tie["weak_positions"] == 1


def test_traces_of_many_clusters_together():
    """Posteriors of a batch are those one by one: traces off the diagonal, clusters of none, and strands that come back."""
    from helixspark.operators.kernels.baselines import trace_posteriors

    r = random.Random(4)
    strands = ["".join(r.choices("ACGT", k=110)) for _ in range(6)]
    rows = [["".join("" if r.random() < 0.02 else x for x in c) for _ in range(9)] for c in strands]
    rows += [[], [""], ["A"], ["ACGT" * 40, "ACGT" * 27], [strands[0][:94], strands[0][:95], strands[0] + "A" * 17]]
    got = trace_posteriors(rows, 110)
    assert got == [trace_posteriors([x], 110)[0] for x in rows] and got[:6] == strands
    assert [len(x) for x in got[6:]] == [0, 0, 110, 110, 110]


def stored(spark, own, kind):
    return spark.createDataFrame(list(own.items()), f"cluster_id long, r array<struct<read_idx:int,{kind}>>")


def test_chains_within_rows(spark):
    """Chains of reads are those of evidence and edges as rows; nothing is exploded or exchanged for stored clusters."""
    from helixspark.operators import aligned, kmers, paths

    r, reads, pairs = random.Random(5), {}, {}
    for c in range(300):
        ref = "".join(r.choices("ACGT"[: 2 + c % 3], k=c % 12))
        reads[c] = [(i, "".join("" if r.random() < 0.1 else x for x in ref * 2)) for i in range(c % 9 + 1)]
        pairs[c] = []
        for i in range(c % 9 + 1):
            x = y = ""
            for letter in [*ref, ""]:
                more = "".join(r.choices("ACN", k=r.choice((1, 2, 25)))) if r.random() < 0.15 else ""
                x, y = x + "-" * len(more) + letter, y + more + (r.choice((letter, letter, letter, "-", "G")) if letter else "")
            pairs[c].append((i, x, y))
    evidence = kmers.positional_kmers(stored(spark, reads, "read:string"), 14, 3)
    found = paths.phase_chain_of_reads(stored(spark, reads, "read:string"), 14, 3)
    assert "Exchange" not in plan(found) and "Generate" not in plan(found)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, paths.phase_chain(evidence.repartition(3), 12).collect())) and len(got) > 100
    rows = stored(spark, pairs, "ref_row:string,read_row:string")
    edges = aligned.conditional_frequencies(rows).repartition(3).persist()
    both = paths.paths_of_reads(rows, {"heaviest": None, "exact": 9})
    assert "Exchange" not in plan(both) and "Generate" not in plan(both)
    both = both.collect()
    for name, whole in (("heaviest", paths.heaviest_path(edges)), ("exact", paths.exact_length_path(edges, 9))):
        got = sorted((x.cluster_id, x[name], x[f"{name}_score"]) for x in both if x[name] is not None)
        assert got == sorted(map(tuple, whole.collect())) and len(got) > 50
    # equal costs at each of two places: the first in A to Z counts, whole paths being compared
    tie = {1: [(0, "AAA", "ACA"), (1, "AAA", "AGA"), (2, "AAA", "A-A")], 2: [(0, "-AG", "CAG"), (1, "A-G", "AAG")]}
    assert sorted(tuple(x) for x in paths.paths_of_reads(stored(spark, tie, "ref_row:string,read_row:string"), {"path": None}).select("cluster_id", "path").collect()) == [(1, "AA"), (2, "AAG")]


def test_guesses_of_least_sum_need_no_exchange(spark):
    from helixspark.operators.baselines import frequency_consensus

    r, own = random.Random(6), {}
    for c in range(40):
        x = "".join(r.choices("ACGT", k=60))
        own[c] = [(i, "".join("" if r.random() < 0.03 else b for b in x)) for i in range(1 + c % 11)]
    made = frequency_consensus(stored(spark, own, "read:string"), 60)
    assert "Exchange" not in plan(made)
    loose = spark.createDataFrame([(c, i, x) for c, xs in own.items() for i, x in xs], "cluster_id long, read_idx int, read string")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, frequency_consensus(loose.repartition(3), 60).collect()))


def test_counts_within_rows(spark):
    """Pileups, insertions and windows of stored clusters are neither rows nor exchanged, and are those of loose reads and of
    plain code: letters of any kind, missing reads and clusters of no letters."""
    from collections import Counter

    from helixspark.operators import aligned, kmers, paths

    r, pairs, reads = random.Random(7), {}, {}
    for c in range(150):
        ref = "".join(r.choices("ACGT", k=c % 9))
        pairs[c] = []
        for i in range(c % 8 + 1):
            x = y = ""
            for letter in [*ref, ""]:
                more = "".join(r.choices("AC漢", k=r.choice((1, 2, 7)))) if r.random() < 0.3 else ""
                x, y = x + "-" * len(more) + letter, y + more + (r.choice((letter, "-", "N")) if letter else "")
            pairs[c].append((i, x, y))
        reads[c] = [(i, y.replace("-", "")) for i, _, y in pairs[c]]
    reads[7].append((99, None))
    pairs[7].append((99, None, "A"))
    rows, own = stored(spark, pairs, "ref_row:string,read_row:string"), stored(spark, reads, "read:string")
    loose, read_rows = (d.select("cluster_id", F.inline("r")).repartition(3) for d in (rows, own))
    ways = {
        "pileup": (aligned.pileup(rows), aligned.pileup(loose)),
        "options": (aligned.options_of_reads(rows), aligned.insertion_options(aligned.insertions(loose))),
        "local": (kmers.local_markov(own, 2), kmers.local_markov(read_rows, 2)),
        "profile": (paths.bbs_profile(own, 3), paths.bbs_profile(read_rows, 3)),
    }
    for name, (made, whole) in ways.items():
        assert "Exchange" not in plan(made) and "Generate" not in plan(made), name
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, whole.collect())), name
    for k, got in ((3, ways["local"][0].select("cluster_id", F.col("edge").alias("kmer"), "n")), (3, ways["profile"][0])):
        pad = "$" * k if got is ways["profile"][0] else ""
        want = Counter((c, s[i : i + k]) for c, xs in reads.items() for _, x in xs if x is not None for s in (pad + x + pad,) for i in range(len(s) - k + 1))
        assert {(x.cluster_id, x.kmer): x.n for x in got.collect()} == want
    n = {(x.cluster_id, x.edge): x.n for x in ways["local"][0].collect()}
    for x in ways["local"][0].collect():
        before, after = (sum(v for (c, e), v in n.items() if c == x.cluster_id and part(e) == part(x.edge)) for part in (lambda e: e[:2], lambda e: e[1:]))
        assert (x.forward, x.reverse) == ((x.n + 0.5) / (before + 2), (x.n + 0.5) / (after + 2))


def test_short_pairs_are_compared_by_bits(monkeypatch):
    """With and without the band, at its border and beyond the bound; and one comparison serves both bounds of the query."""
    import numpy as np

    from helixspark.functions import distance as D

    r = random.Random(8)
    a = ["".join(r.choices("ACG", k=r.choice((0, 1, 20, 255, 256, 257)))) for _ in range(80)]
    b = [x[r.randrange(3) :] + "T" * r.randrange(4) if r.random() < 0.7 else y for x, y in zip(a, a[1:] + a[:1], strict=True)]
    most, found, bits = np.array([r.choice((0, 1, 5, 40)) for _ in a]), [], []
    own = D.distances
    monkeypatch.setattr(D, "distances", lambda s, i, j: bits.append(len(i)) or own(s, i, j))
    for short in (256, -1, 10**6):
        monkeypatch.setattr(D, "_SHORT", short)
        found.append(D.within(a, b, most).tolist())
    assert found[0] == found[1] == found[2] and len(bits) == 2 and 0 < bits[0] < bits[1]
