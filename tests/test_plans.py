"""Ranks, routes and readers where values are far from even, and the batch kernels against plain definitions."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def edits(a, b):
    from functools import cache

    @cache
    def d(i, j):
        return i + j if not i or not j else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


def test_distances():
    from helixspark.functions.distance import distances

    r = random.Random(1)
    s = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 1, 7, 63, 64, 65, 110, 128, 129, 150)] + ["añb", "ab", None]
    i, j = (np.array(x) for x in zip(*((a, b) for a in range(len(s)) for b in range(len(s))), strict=True))
    got = distances(pa.array(s, pa.string()), i, j)
    assert all(edits(s[a] or "", s[b] or "") == d for a, b, d in zip(i, j, got, strict=True))


VALUES = {
    "outlier": [float(i) for i in range(400)] + [1e300],
    "common": [5.0] * 300 + [float(i % 50) for i in range(100)],
    "one": [7.0] * 50,
    "longs": [(1 << 60) + i % 90 for i in range(300)],
    "decimals": [Decimal(i % 37) / 4 for i in range(200)],
    "few": [3.0, 1.0],
}


@pytest.mark.parametrize("small", [0, 1 << 20])
@pytest.mark.parametrize("name", sorted(VALUES))
def test_ranks(spark, name, small, monkeypatch):
    """In ranges, and in one where rows are few."""
    from helixspark.functions import ranges
    from helixspark.operators import routing

    monkeypatch.setattr(ranges, "SMALL", small)
    monkeypatch.setattr(ranges, "EACH", 4)

    rows = list(enumerate(VALUES[name]))
    random.Random(2).shuffle(rows)
    kind = {"longs": "long", "decimals": "decimal(10,2)"}.get(name, "double")
    df = spark.createDataFrame(rows, f"cluster_id long, score {kind}").repartition(3)
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    got = {r.cluster_id: r["rank"] for r in routing.global_rank(df, "score", "cluster_id").collect()}
    assert got == {k: i for i, (k, _) in enumerate(order)}
    for k in (0, 1, len(rows) // 3, len(rows), len(rows) + 5):
        best = sorted(rows, key=lambda x: (-x[1], x[0]))[:k]
        assert sorted(r.cluster_id for r in routing.topk(df, k).collect()) == sorted(i for i, _ in best)
    for num, den in ((1, 2), (3, 4), (0, 1)):
        assert routing.rank_at(df, "score", num, den).collect()[0].gate == order[len(rows) * num // den][1]
    assert routing.global_rank(df.limit(0), "score", "cluster_id").count() == 0 and routing.topk(df.limit(0), 3).count() == 0


def test_many_different_values(spark):
    """More rows than one range has: two million, nearly all different, and a third of them equal."""
    from helixspark.functions import ranges
    from helixspark.functions.sequence import dense_index
    from helixspark.operators import routing

    df = spark.range(2_000_000).select(F.col("id").alias("cluster_id"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double")).alias("score"))
    sizes = [r["count"] for r in ranges.ranged(df, "score", "g").groupBy("g").count().collect()]
    assert len(sizes) > 10 and sorted(sizes)[-2] < 400_000
    ranked = routing.global_rank(df, "score", "cluster_id")
    assert ranked.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (0, 1_999_999, 2_000_000)
    assert ranked.where("score = 7.0").agg(F.max("rank") - F.min("rank")).first()[0] == df.where("score = 7.0").count() - 1
    spaced = df.where("cluster_id % 7 < 2").select((F.col("cluster_id") * 1000 + 5).alias("key"))
    got = dense_index(spaced, "key", "n").agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.corr("key", "n")).first()
    assert got[0] == 1 and got[1] == got[2] == spaced.count() and got[3] > 0.999999


def test_medoid_of_a_deep_cluster(spark):
    """A cluster whose pairs come in many parts, beside small ones and one read alone."""
    from helixspark.operators import clusters

    r = random.Random(12)
    rows = [(c, i, "".join(r.choices("ACGT", k=r.randint(3, 9)))) for c, n in ((1, 1), (2, 3), (3, 60)) for i in range(n)]
    got = {x.cluster_id: x for x in clusters.medoid_seed(spark.createDataFrame(rows, "cluster_id long, read_idx int, read string"), 6).collect()}
    for c in (1, 2, 3):
        own = [x[2] for x in rows if x[0] == c]
        cost = [(round(sum(min(0.32, edits(a, b) / max(len(a), len(b))) for j, b in enumerate(own) if j != i) + 0.01 * abs(len(a) - 6), 9), i) for i, a in enumerate(own)]
        assert (got[c].cost, got[c].seed) == min(cost) and got[c].seed_read == own[got[c].seed]


def test_auc_with_ties_and_outlier(spark):
    from helixspark.operators import evaluate

    rows = [(5.0, i % 3 == 0) for i in range(60)] + [(float(i), i % 2 == 0) for i in range(40)] + [(1e200, True)]
    pairs = [(p, n) for p, a in rows if a for n, b in rows if not b]
    got = evaluate.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    assert abs(got.auc - sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)) < 1e-12


def test_join_positional_checks_keys(spark):
    from helixspark.operators import evaluate

    a = spark.createDataFrame([(1, "A"), (2, "C")], "cluster_id long, sequence string")
    ok = spark.createDataFrame([(2, "C"), (1, "G")], "cluster_id long, center string")
    other = spark.createDataFrame([(1, "A"), (3, "C")], "cluster_id long, center string")
    assert sorted(map(tuple, evaluate.join_positional(a, ok).collect())) == [(1, "A", "G"), (2, "C", "C")]
    with pytest.raises(Exception, match="key [23]"):
        evaluate.join_positional(a, other).collect()


def test_scan_fasta_of_aligned_records(spark, tmp_path):
    from helixspark.sources import text

    (tmp_path / "a.fa").write_text("ignored\n>one\nAC--GT\nA-\n>two x\n\n>three\r\nAC\r\n")
    (tmp_path / "b.fa").write_text("go on\n>four\nTT")
    got = sorted(map(tuple, text.scan_fasta(spark, str(tmp_path)).collect()))
    assert got == [(1, "one", "AC--GTA-"), (2, "two x", ""), (3, "three", "AC"), (4, "four", "TT")]


def test_separator_rewrite(spark, tmp_path):
    """Clusters in one separator's file come out of another one's, empty ones counted or not."""
    from helixspark.sources import text

    (tmp_path / "in.txt").write_text("=====\nAC\nGT\n=====\n=====\nTT\n")
    mine = text.scan_clusters(spark, str(tmp_path / "in.txt"), separator="=====")
    text.write_clusters(mine, str(tmp_path / "out"))
    back = text.scan_clusters(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, mine.collect())) == [(1, 0, "AC"), (1, 1, "GT"), (2, 0, "TT")]
    assert text.scan_clusters(spark, str(tmp_path / "in.txt"), separator="=====", keep_empty=True).select(F.max("cluster_id")).first()[0] == 3


def test_markov_arrays(spark):
    from helixspark.operators import kmers, reconstruct

    seqs = spark.createDataFrame([(1, "ACGTACGTAA"), (2, "TTTTTTTT"), (3, "ACG")], "cluster_id long, seq string")
    model = reconstruct.markov(seqs, 3)
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    rows = kmers.markov_model(seqs, 3).collect()
    tables = {"edge": model.edges, "node": model.nodes, "suffix": model.suffixes}
    assert rows and all(tables[r.kind].counts[code(r.kmer)] == r.n for r in rows)
    assert sum(int(t.counts.sum()) for t in tables.values()) == sum(r.n for r in rows)


def test_strands_hold_all_letters(spark):
    from helixspark.sources import fixture

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: "".join(c for c in (r.text or "").upper() if c in "ACGT") for r in fixture.table(spark, sf, "documents").collect()}
    got = {}
    for r in sorted(fixture.centers(spark, sf).collect(), key=lambda r: r.cluster_id):
        got.setdefault(r.doc_id, []).append(r.center)
    import re

    want = {i: re.sub("[^ACGTacgt]", "", t) for i, t in texts.items() if t}
    for i, pieces in got.items():
        joined = "".join(pieces)
        assert all(len(p) == 110 for p in pieces) and joined[: len(want[i])] == want[i] and len(joined) - len(want[i]) < 110
    assert set(got) == set(want)


def test_two_means_against_plain_steps(spark):
    from helixspark.operators import calibrate

    r = random.Random(3)
    x = [r.gauss(2, 0.5) for _ in range(150)] + [r.gauss(9, 1) for _ in range(30)]
    got = calibrate.two_means(spark.createDataFrame([(v,) for v in x], "score double"))
    low, high, v = min(x), max(x), np.array(x)
    for _ in range(64):
        up = v > (low + high) / 2
        low, high = v[~up].mean(), v[up].mean()
    assert abs(got["low"] - low) < 1e-9 and abs(got["high"] - high) < 1e-9 and got["high_count"] == up.sum() == 30
    assert abs(got["separation"] - (high - low) / (v[~up].std() + v[up].std())) < 1e-9
    same = calibrate.two_means(spark.createDataFrame([(1.0,)] * 5, "score double"))
    assert same["separation"] == 0 and same["high_count"] == 0


def test_thresholds_choose_the_policy():
    from helixspark.operators.reconstruct import Params, policy

    at = lambda reuse, phase, **p: policy({"reuse": reuse, "phase": phase, "fallback": False}, Params(**p))
    assert at(0.2, 4) == "median-anomaly-or-coverage" and at(0.2, 4, high_reuse=0.1) == "by-anomaly"
    assert at(0.2, 4, low_phase=5) == "low-phase-weak-position" and at(0.2, 4, high_phase=4) == "low-reuse-high-phase-dense"
    assert at(0.6, 7) == "by-anomaly" and at(0.6, 7, disable_decode=True) == "disabled"


def test_adaptive_route_follows_its_fractions(spark):
    from helixspark.operators.reconstruct import Params, decide

    rows = spark.createDataFrame([(i, 8, float(i < 40) * 10 + i / 100) for i in range(100)], "cluster_id long, num_reads int, score double")
    ctx = {"reuse": 0.9, "phase": 4.0, "fallback": False, "n": 100}
    for p, n, name in ((Params(), 40, "adaptive-bimodal-anomaly"), (Params(most_fraction=0.3), 30, "adaptive-bimodal-anomaly"), (Params(separation=1e9), 10, "sparse-10pct-fallback"), (Params(separation=1e9, least_fraction=0.05), 5, "sparse-5pct-fallback")):
        routed, got = decide(rows, ctx, p)
        assert got == name and routed.where("joint_active").count() == n


def test_supports_are_not_broadcast(spark):
    """Windows and supports of sequences whose files are small meet by an exchange of both, however small they look."""
    from helixspark.operators import kmers

    seqs = spark.createDataFrame([(1, "ACGTACGTACGTACGT"), (2, "TTACGTACGTACGTTT"), (3, "ACG"), (4, "GGGGGGGGGGGGGGG")], "cluster_id long, seq string")
    by, whole = kmers.reuse_by_sequence(seqs, 12), kmers.reuse_fraction(seqs, 12)
    assert sorted(map(tuple, by.collect())) == [(1, 5, 3), (2, 5, 2), (4, 4, 0)]
    assert tuple(whole.first())[:2] == (14, 5)
    for df in (by, whole):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_ranks_within_clusters(spark):
    """Samples, copies, budgets and cores of rows that are together need no exchange, and are those of loose reads."""
    from helixspark.operators import clusters, routing

    r = random.Random(3)
    rows = [(c, i, "".join(r.choices("ACGT", k=r.randint(3, 30)))) for c, n in ((1, 1), (2, 2), (3, 12), (4, 40), (5, 5)) for i in range(n)]
    loose = spark.createDataFrame(rows, "cluster_id long, read_idx int, read string").repartition(3)
    stored = spark.createDataFrame(clusters.together(loose).collect(), "cluster_id long, r array<struct<read_idx:int,read:string>>")
    ways = {
        "nested": lambda d: routing.nested_samples(d, [1, 2], [2, 5]),
        "budget": lambda d: routing.context_budget(d, 6, 60),
        "copies": lambda d: clusters.max_copies(d, 3, 1),
        "core": lambda d: clusters.coherent_core(clusters.with_seeds(d, 20)),
    }
    for name, f in ways.items():
        made = f(stored)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString(), name
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, f(loose).collect())), name
    core = clusters.coherent_core(loose, clusters.medoid_seed(loose, 20))
    assert sorted(map(tuple, core.collect())) == sorted(map(tuple, ways["core"](stored).collect()))
    samples = routing.nested_samples(stored, [1, 2], [2, 5, 4])
    gone = samples.where("not (coverage = 4 and rank = 1 and cluster_id = 3) and not (coverage = 5 and seed = 2)")
    assert sorted(map(tuple, routing.nested_violations(samples).collect())) == [(s, a, b, 0) for s in (1, 2) for a, b in ((2, 4), (4, 5))]
    assert sorted(map(tuple, routing.nested_violations(gone).collect())) == [(1, 2, 4, 1), (1, 4, 5, 0), (2, 2, 4, 1), (2, 4, 5, 11)]


def test_leave_one_out_in_batches(spark):
    """Chances and scores from broadcast counts are those of the exchange, windows of other letters left out; windows meet no join."""
    from helixspark.operators import kmers

    r = random.Random(4)
    seqs = {c: "".join(r.choices("ACGT", k=n)) for c, n in enumerate((0, 2, 3, 5, 30, 30, 41, 110))} | {20: "ACGNACGTTACG", 21: "ACGT" * 20}
    guides = spark.createDataFrame(list(seqs.items()), "cluster_id long, seq string")
    reads = spark.createDataFrame([(c, i, s[i : i + 25]) for c, s in seqs.items() for i in range(3) if c != 5], "cluster_id long, read_idx int, read string")
    made = kmers.loo_transitions(guides, 2)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = []
    for most in (9, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(kmers, "BROADCAST_K", most)
            found.append([sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in d.collect()) for d in (kmers.loo_transitions(guides, 2), kmers.anomaly_scores(guides, reads, 2, top=7))])
    assert found[0] == found[1] and len(found[0][1]) == 8 and len(found[0][0]) > 200


def test_evidence_and_choices_within_rows(spark):
    """Windows are added up without being rows, letters beyond four, short and missing reads included; guesses need no exchange."""
    from collections import Counter

    from helixspark.operators import clusters, kmers, paths

    r = random.Random(5)
    reads = {c: ["".join(r.choices("ACGT" + "Né漢" * (c % 2), k=r.choice((0, 2, 3, 4, 12, 15, 90)))) for _ in range(c % 7 + 1)] for c in range(150)}
    reads[7] += [None, ""]
    df = spark.createDataFrame([(c, i, x) for c, xs in reads.items() for i, x in enumerate(xs)], "cluster_id long, read_idx int, read string")
    for k, layers in ((3, 10), (20, 30)):
        want = Counter()
        for c, xs in reads.items():
            for x in (x or "" for x in xs):
                for p in range(len(x) - k + 1):
                    at = int(p * (layers - 1) / max(len(x) - k, 1) + 0.5)
                    for d in range(-2, 3):
                        if 0 <= at + d < layers:
                            want[c, at + d, x[p : p + k]] += 3 - abs(d)
        for rows in (df, clusters.together(df)):
            made = kmers.positional_kmers(rows, layers + k - 1, k)
            assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
            assert {(x.cluster_id, x.layer, x.kmer): x.evidence for x in made.collect()} == want and made.count() == len(want)
    full = clusters.together(df.where("cluster_id <> 7"))
    guesses = [(F.array_max("r.read"), 2.0), (F.array_min("r.read"), 3.0), (F.array_min("r.read"), 1.0)]
    loose = full.select("cluster_id", F.explode(F.array(*(F.struct(g.alias("guess"), F.lit(s).alias("score")) for g, s in guesses))).alias("x")).select("cluster_id", "x.*")
    want = paths.least_sum_choice(loose, clusters.guess_distances(loose, df.where("cluster_id <> 7")))
    assert sorted(map(tuple, paths.least_sum_in_rows(full, guesses).collect())) == sorted(map(tuple, want.collect()))


def test_kmers_are_counted_before_they_are_rows(spark):
    """Counts by code in batches, and texts for other letters and long k-mers; windows never meet their supports."""
    from collections import Counter

    from helixspark.operators import kmers

    seqs = ["ACGTACGTAC", "ACGTA", "", "AC", "ACGNNACGTA", "acgta", "éACGTACGT", "ACGTACGTAC" * 5] + [None]
    df = spark.createDataFrame(list(enumerate(seqs)), "cluster_id long, seq string").repartition(3)
    for k in (1, 4, 12, 24, 30):
        own = [[x[i : i + k] for i in range(len(x) - k + 1)] for x in seqs if x]
        n, s = Counter(w for x in own for w in x), Counter(w for x in own for w in set(x))
        assert {r.kmer: (r.n, r.sequences) for r in kmers.kmer_counts(df, k).collect()} == {w: (n[w], s[w]) for w in n}
        assert {r.kmer: r.support for r in kmers.support(df, k).collect()} == dict(s)
        row = kmers.reuse_fraction(df, k).first()
        assert (row.windows, row.shared) == (sum(n.values()), sum(v for w, v in n.items() if s[w] > 1))
    plan = kmers.reuse_fraction(df, 12)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
