"""Aligned reads, best paths and banded distances against plain code that tries everything."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.operators import aligned as A
from helixspark.operators import paths as P

SCHEMA = "cluster_id long, read_idx int, ref_row string, read_row string"


def micro(x):
    return round(x * 1e9)


def alignments(seed=1, clusters=6, letters=7, reads=5):
    rng, out = random.Random(seed), []
    for c in range(clusters):
        ref = "".join(rng.choices("ACGT", k=letters))
        for r in range(reads):
            a = b = ""
            for x in [*ref, ""]:
                for _ in range(rng.choice([0, 0, 0, 1, 2, 7] if rng.random() < 0.4 else [0])):
                    a, b = a + "-", b + rng.choice("ACGT-")
                if x:
                    a, b = a + x, b + rng.choice([x, x, x, x, "-", "A", "N"])
            out.append((c, r, a, b))
    return out


def plain_slots(ref, read):
    inserted, state = [""], []
    for x, y in zip(ref, read, strict=True):
        if x == "-":
            inserted[-1] += y.replace("-", "")
        else:
            state.append(y)
            inserted.append("")
    return inserted, state


def by_cluster(rows):
    out = defaultdict(list)
    for c, _, a, b in rows:
        out[c].append((a, b))
    return out


def test_pileup_and_insertions(spark):
    rows = [*alignments(), (50, 0, "", ""), (51, 0, "--", "AC")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bases, inserts = Counter(), defaultdict(Counter)
    for c, _, a, b in rows:
        ins, state = plain_slots(a, b)
        for s, x in enumerate(ins):
            inserts[(c, s)][x[:5]] += 1
        for p, x in enumerate(state):
            bases[(c, p, x if x in "ACGT" else "gap")] += 1
    got = A.pileup(df).collect()
    assert {(r.cluster_id, r.pos, k): r[k.lower()] for r in got for k in ("A", "C", "G", "T", "gap") if r[k.lower()]} == dict(bases)
    found = A.insertions(df)
    assert {(r.cluster_id, r.slot, r.inserted): r.n for r in found.collect()} == {(*k, x): n for k, v in inserts.items() for x, n in v.items()}
    options = defaultdict(list)
    for r in A.insertion_options(found).orderBy("rank").collect():
        options[(r.cluster_id, r.slot)].append((r.inserted, r.n))
        assert r.total == sum(inserts[(r.cluster_id, r.slot)].values()) and r.kinds == len(inserts[(r.cluster_id, r.slot)])
    for key, v in inserts.items():
        best = sorted(((x, n) for x, n in v.items() if x), key=lambda o: (-o[1], len(o[0]), o[0]))[:2]
        assert options[key] == [("", v[""]), *best]


def test_channel_counts_reject_what_is_far(spark):
    rng, rows = random.Random(4), []
    for c, n in enumerate((1, 2, 5, 30)):
        ref = "".join(rng.choices("ACGT", k=40))
        for r in range(n):
            wild = rng.random() < 0.2
            read = "".join("-" if rng.random() < 0.05 else rng.choice("ACGT") if wild or rng.random() < 0.1 else x for x in ref)
            rows.append((c, r, ref, read))
    rows += [(9, 0, "ACGT" * 10, "-" * 40), (9, 1, "-" * 90, "A" * 90)]
    got = {r.cluster_id: r for r in A.channel_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), 40, most=8, delta=35).collect()}
    for c, own in by_cluster(rows).items():
        picked = own if len(own) <= 8 else [own[s * len(own) // 8] for s in range(8)]
        counts = []
        for a, b in picked:
            k = Counter("I" if x == "-" else "D" if y == "-" else "M" if x == y else "S" for x, y in zip(a, b, strict=True))
            size = k["M"] + k["S"] + k["I"]
            if size and abs(size - 40) <= 35:
                counts.append(((k["S"] + k["I"] + k["D"]) / max(size, k["M"] + k["S"] + k["D"], 1), k))
        x = [v for v, _ in counts]
        limit = min(0.42, np.median(x) + 3 * max(np.median(np.abs(x - np.median(x))), 1 / 40)) if x else 0
        good = [k for v, k in counts if v <= limit]
        r = got[c]
        assert (r.reads, r.used, r.m, r.s, r.i, r.d) == (len(own), len(good), *(sum(k[o] for k in good) for o in "MSID"))


def plain_edges(rows):
    out = {}
    for c, own in by_cluster(rows).items():
        vectors = []
        for a, b in own:
            ins, state = plain_slots(a, b)
            vectors.append([y for x in zip(ins, [s.replace("-", "") for s in state] + [None], strict=True) for y in x][:-1])
        edges = {}
        for s in range(len(vectors[0]) - 1):
            pairs, single = Counter((v[s], v[s + 1]) for v in vectors), Counter(v[s] for v in vectors)
            edges[s] = {k: (n, len(vectors) if s == 0 else single[k[0]]) for k, n in pairs.items()}
        out[c] = edges
    return out


def test_frequencies_and_paths(spark):
    """Of all chains of entries the best one, and the best one of each length that some chain has."""
    rows = alignments(seed=2, clusters=8, letters=4)
    edges = A.conditional_frequencies(spark.createDataFrame(rows, SCHEMA).repartition(3)).persist()
    want = plain_edges(rows)
    assert {(r.cluster_id, r.slot, r.a, r.b): (r.n, r.total) for r in edges.collect()} == {(c, s, *k): v for c, e in want.items() for s, own in e.items() for k, v in own.items()}
    chains = {}
    for c, own in want.items():
        paths = [((a, b), a + b, micro(math.log(n / t))) for (a, b), (n, t) in own[0].items()]
        for s in range(1, len(own)):
            paths = [((x[1], b), p + b, w + micro(math.log(n / t))) for x, p, w in paths for (a, b), (n, t) in own[s].items() if a == x[1]]
        chains[c] = [(-w, p) for _, p, w in paths]
    heavy = {r.cluster_id: (r.path, r.score) for r in P.heaviest_path(edges).collect()}
    assert {c: heavy[c][1] for c in chains} == {c: -min(v)[0] for c, v in chains.items()}
    assert all((-heavy[c][1], heavy[c][0]) in v for c, v in chains.items())
    for length in range(9):
        got = {r.cluster_id: (-r.score, r.path) for r in P.exact_length_path(edges, length).collect()}
        assert got == {c: min(o) for c, v in chains.items() if (o := [x for x in v if len(x[1]) == length])}
    assert P.exact_length_path(edges.limit(0), 4).count() == P.heaviest_path(edges.limit(0)).count() == 0


def whole_clusters(spark, rows):
    """Rows (cluster_id, r), as clusters are stored."""
    own = defaultdict(list)
    for c, i, a, b in rows:
        own[c].append((i, a, b))
    return spark.createDataFrame(list(own.items()), "cluster_id long, r array<struct<read_idx:int,ref_row:string,read_row:string>>")


def test_frequencies_of_whole_clusters(spark):
    """Entries of stored clusters are neither rows nor exchanged; clusters may be deep, and rows missing or of no letters."""
    rows = [*alignments(seed=5, clusters=150, letters=9), *((200, i, "AC-G", "A-TG" if i % 3 else "ACTG") for i in range(900)), (201, 0, None, "A"), (201, 1, "AA", "AC"), (202, 0, "", ""), (203, 0, "--", "AC")]
    edges = A.conditional_frequencies(whole_clusters(spark, rows))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {(r.cluster_id, r.slot, r.a, r.b): (r.n, r.total) for r in edges.collect()}
    want = plain_edges([r for r in rows if r[2] is not None])
    assert got == {(c, s, *k): v for c, e in want.items() for s, own in e.items() for k, v in own.items()}
    assert got[200, 4, "T", "G"] == (900, 900) and got[200, 2, "", "C"] == (300, 900)
    assert A.conditional_frequencies(whole_clusters(spark, rows).limit(0)).count() == 0


def test_phase_chain(spark):
    rng, evidence = random.Random(3), {}
    for c in range(12):
        alphabet = "ACGT"[: 2 + c % 3]
        for layer in range(5):
            for k in {"".join(rng.choices(alphabet, k=3)) for _ in range(7)}:
                evidence[(c, layer, k)] = rng.randint(1, 4)
    del_layer = {key: v for key, v in evidence.items() if key[:2] != (11, 2)}  # a cluster that misses a layer
    df = spark.createDataFrame([(*k, v) for k, v in del_layer.items()], "cluster_id long, layer long, kmer string, evidence long").repartition(3)
    got = {r.cluster_id: (-r.score, r.path) for r in P.phase_chain(df, 5).collect()}
    want = {}
    for c in range(11):
        layers = [{k: micro(math.log1p(v)) for (x, y, k), v in evidence.items() if (x, y) == (c, layer)} for layer in range(5)]
        found = [(-sum(layer[k] for layer, k in zip(layers, ks, strict=True)), ks) for ks in itertools.product(*layers) if all(a[1:] == b[:-1] for a, b in itertools.pairwise(ks))]
        if found:
            best = min(w for w, _ in found)
            want[c] = best, [ks[0] + "".join(k[-1] for k in ks[1:]) for w, ks in found if w == best]
    assert set(got) == set(want) and len(want) > 5
    assert all(got[c][0] == w and got[c][1] in p for c, (w, p) in want.items())


def walks(reads, k, length, alpha=0.1):
    """The weights of all walks of that many letters and k end marks over padded k-mers."""
    counts = Counter(p[i : i + k] for r in reads for p in ("$" * k + r + "$" * k,) for i in range(len(p) - k + 1))
    front = {"$" * k: 0}
    for step in range(length + k):
        new = {}
        for path, w in front.items():
            tail = path[len(path) - k + 1 :]
            letters = sum(counts[tail + b] for b in "ACGT")
            for b in "ACGT" if step < length else "$":
                n = counts[tail + b]
                total = letters if b != "$" else n if tail.endswith("$") else letters + n
                if n:
                    new[path + b] = w + micro(math.log2((n + alpha) / (total + 4 * alpha)))
        if not new:
            break
        front = new
    return front


def test_beam_against_all_walks(spark):
    rng, reads, sizes = random.Random(6), [], []
    for c in range(8):
        center = "".join(rng.choices("ACGT", k=9))
        for i in range(4):
            read = "".join("" if rng.random() < 0.1 else rng.choice("ACGT") if rng.random() < 0.1 else x for x in center)
            reads.append((c, i, read))
        sizes.append((c, 3 + c % 2))
    reads += [(20, 0, "AC"), (21, 0, "")]
    sizes += [(20, 4), (21, 3)]
    df, k = spark.createDataFrame(reads, "cluster_id long, read_idx int, read string").repartition(3), spark.createDataFrame(sizes, "cluster_id long, k int")
    got = {r.cluster_id: r for r in P.beam_consensus(df, k, 9, width=10**6).collect()}
    assert set(got) == {c for c, _ in sizes}
    for c, size in sizes:
        own = [r for x, _, r in reads if x == c]
        both = walks(own, size, 9)
        for p, w in walks([r[::-1] for r in own], size, 9).items():
            both[p[::-1]] = max(w, both.get(p[::-1], w))
        best = max(both.values())
        r = got[c]
        assert r.score == best and r.sequence == min(p for p, w in both.items() if w == best).strip("$")
        assert r.confidence == pytest.approx(1 / sum(math.exp((w - best) / 1e9) for w in both.values()))


def test_least_sum(spark):
    from helixspark.operators.clusters import guess_distances

    reads = spark.createDataFrame([(1, i, r) for i, r in enumerate(["ACGT", "ACGT", "ACGA"])] + [(2, 0, "AA"), (2, 1, "TT")], "cluster_id long, read_idx int, read string")
    guesses = spark.createDataFrame([(1, "ACGT", 0.5), (1, "ACGT", 0.7), (1, "GGGG", 9.0), (2, "TT", 1.0), (2, "AA", 1.0), (2, "AT", 3.0)], "cluster_id long, guess string, score double")
    got = P.least_sum_choice(guesses, guess_distances(guesses, reads)).orderBy("cluster_id").collect()
    assert [tuple(r) for r in got] == [(1, "ACGT", 0.7, 1), (2, "AA", 1.0, 2)]


def test_banded_distance(spark):
    from helixspark.functions.distance import distance_within, distances, within

    import pyarrow as pa

    rng = random.Random(7)
    strings = ["", "A", "ACGT", "é🦆x"] + ["".join(rng.choices("ACGT", k=rng.randint(1, 60))) for _ in range(60)]
    near = lambda s: "".join("" if rng.random() < 0.1 else x + rng.choice(["", "", "G"]) for x in s)
    pairs = [(rng.choice(strings), rng.choice(strings)) for _ in range(300)] + [(s, near(s)) for s in strings * 5]
    both = pa.array([a for a, _ in pairs] + [b for _, b in pairs])
    i = np.arange(len(pairs))
    exact = distances(both, i, i + len(pairs))
    for most in (0, 1, 3, 10, 200):
        bound = np.full(len(pairs), most)
        assert (within([a for a, _ in pairs], [b for _, b in pairs], bound) == np.minimum(exact, most + 1)).all()
    mixed = np.array([rng.randint(0, 40) for _ in pairs])
    assert (within([a for a, _ in pairs], [b for _, b in pairs], mixed) == np.minimum(exact, mixed + 1)).all()
    # strings of a quarter million letters: the square of that would not end
    long = "ACGT" * 62_500
    assert within([long, long, long], ["G" + long[:-2], long[::-1], long], np.array([5, 5, 0])).tolist() == [3, 6, 0]
    df = spark.createDataFrame([("ab", "b", 5), (None, "abc", 1), ("x", "y", None)], "a string, b string, m int")
    assert [r[0] for r in df.select(distance_within(F.col("a"), F.col("b"), F.col("m"))).collect()] == [1, 2, None]


def plain_consensus(rows, length, weights, delta=35, reject=0.42):
    """All ways through the options, for short references."""
    ref = rows[0][0].replace("-", "")
    slots, bases, norms, total = defaultdict(Counter), defaultdict(Counter), [], 0
    for a, b in rows:
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
        size, edits = sum(y != "-" for _, y in pairs), sum(x != y for x, y in pairs)
        norm = edits / max(size, len(ref), 1)
        if abs(size - length) > delta or norm > reject:
            continue
        w = weights(norm)
        norms.append(norm)
        total += w
        ins, state = plain_slots(a, b)
        for i, x in enumerate(ins):
            slots[i][x[:5]] += w
        for i, x in enumerate(state):
            bases[i][x if x in "ACGT" else ""] += w
    if not norms:
        return "", 0, 0
    steps, weak = [], 0
    for i in range(len(ref) + 1):
        best = sorted((x for x in slots[i] if x), key=lambda x: (-slots[i][x], len(x), x))[:2]
        kinds = len({*slots[i], ""})
        steps.append([(x, micro(math.log((slots[i][x] + 0.35) / (total + 0.35 * kinds)))) for x in ["", *best]])
        if i < len(ref):
            weak += max(bases[i][x] for x in "ACGT") / total < 0.72
            steps.append([(x, micro(math.log((bases[i][x] + 0.35) / (total + 5 * 0.35)))) for x in ("", *"ACGT") if bases[i][x] or x == ref[i]])
    ways = {("", 0)}
    for options in steps:
        ways = {(p + x, s + w) for p, s in ways for x, w in options if len(p + x) <= length}
    own = [s for p, s in ways if len(p) == length]
    return (max(own) if own else None), weak, len(norms)


@pytest.mark.parametrize("uniform", [True, False])
@pytest.mark.parametrize("length", [5, 7, 9])
def test_consensus_pass(spark, uniform, length):
    from helixspark.functions.sequence import READ_WEIGHT_REST, READ_WEIGHTS

    def weights(norm):
        return 256 if uniform else next((w for bound, w in READ_WEIGHTS if norm <= bound), READ_WEIGHT_REST)

    rows = [*alignments(seed=3, clusters=8, letters=7, reads=6), (50, 0, "", ""), (51, 0, "--", "AC")]
    got = {r.cluster_id: r for r in P.consensus_pass(spark.createDataFrame(rows, SCHEMA).repartition(3), length, uniform).collect()}
    found = by_cluster(rows)
    assert set(got) == set(found)
    for c, own in found.items():
        score, weak, n = plain_consensus(own, length, weights)
        r = got[c]
        assert (r.aligned_reads, r.rejected_reads, r.weak_positions) == (n, len(own) - n, weak)
        if n and score is not None:
            assert len(r.sequence) == length and r.score == score
        else:
            assert r.sequence == "" and r.score is None and r.mean_chosen_conf == 0.0


def test_consensus_ties(spark):
    # two reads, each with another letter at one place: the first letter; each with another insertion: the shorter one first
    rows = [(1, 0, "AAAA", "ACAA"), (1, 1, "AAAA", "AGAA"), (2, 0, "A-A--A", "ATA--A"), (2, 1, "A-A--A", "A-ACCA")]
    got = {r.cluster_id: r.sequence for r in P.consensus_pass(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got == {1: "ACAA", 2: "ATAA"}
    assert P.consensus_pass(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_consensus_of_whole_clusters(spark):
    """Votes of stored clusters are neither rows nor exchanged, and give what loose reads give."""
    rows = [*alignments(seed=8, clusters=140, letters=8, reads=7), *((200, i, "AC-G", "A-TG" if i % 3 else "ACTG") for i in range(400)), (201, 0, "", "")]
    by = P.consensus_pass(whole_clusters(spark, rows), 8)
    plan = by._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    plain = lambda df: sorted(tuple(-1 if x is None else x for x in r[:-1]) + (round(r[-1], 9),) for r in df.collect())
    assert plain(by) == plain(P.consensus_pass(spark.createDataFrame(rows, SCHEMA).repartition(3), 8)) and by.count() == 142
    missing = P.consensus_pass(whole_clusters(spark, [(1, 0, "ACG", "ACG"), (1, 1, None, "A")]), 3).first()
    assert (missing.sequence, missing.aligned_reads, missing.rejected_reads) == ("ACG", 1, 1)


def test_beam_of_whole_clusters(spark):
    """K-mers of stored clusters are neither rows nor exchanged; clusters of several k, and one whose beams end early."""
    from helixspark.operators.baselines import least_k

    rng, own = random.Random(9), {}
    for c in range(300):
        center = "".join(rng.choices("ACGT", k=30))
        own[c] = [(i, "".join("" if rng.random() < 0.05 else x for x in center)) for i in range(1 + c % 5)]
    own[400], own[401] = [(0, "ACG"), (1, None)], [(0, "A" * 300), (1, "")]
    df = spark.createDataFrame(list(own.items()), "cluster_id long, r array<struct<read_idx:int,read:string>>")
    by = P.beam_consensus(df, least_k(F.col("r.read")), 30)
    plan = by._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    found = {r.cluster_id: r for r in by.collect()}
    assert set(found) == set(own) and found[400].k == 64 and found[401].k == 64
    for c in range(0, 300, 5):  # one read of no errors, or of a few letters less
        (read,) = (r for _, r in own[c])
        repeat = max((n for n in range(len(read)) if len({read[i : i + n] for i in range(len(read) - n + 1)}) < len(read) - n + 1), default=0)
        assert found[c].k == max(repeat + 1, 4) + 1
        assert found[c].sequence == read
    loose = df.select("cluster_id", F.inline("r"))
    from helixspark.operators.baselines import select_k

    again = {r.cluster_id: r for r in P.beam_consensus(loose, select_k(loose), 30).collect()}
    assert {c: r[:4] for c, r in again.items()} == {c: r[:4] for c, r in found.items()}
