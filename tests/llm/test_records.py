"""Exact deduplication, Merkle manifests and conversation repair against plain code, and at their edges."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact deduplication

def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        free = True  # of equal rows one stays
        for m in members:
            out.append((m[2], best[2], len(members), m == best and free, sha(key)))
            free = free and m != best
    return Counter(out)


def some_texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices(["ab", "c", "é", "日本", "🦆", "x\ty"], k=rng.randint(1, 40))) for _ in range(40)]
    rows = [(k, rng.choice(base) + rng.choice(["", " ", "\n", "\r\n", "\v "])) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "only here"), (None, base[0]), (7, base[0]), (7, base[0]), (7, base[0] + " " * 9), (7, base[0] + "\t" * 9)]
    return [*rows, (2000, "w " * 300_000), (1999, "w" * 300_000), (2001, "w" * 299_999), *[(3000 + k, "hot text") for k in range(200)]]


@pytest.mark.parametrize("limit, bucket", [(64 << 20, 16 << 20), (600, 1 << 20)])
def test_exact(spark, limit, bucket):
    """Also with tables so small that most buckets go through several rounds of spill files."""
    from helixspark.llm.exact import exact_duplicates

    rows = some_texts()
    table = spark.createDataFrame([(i, t, "d", "k", 1, True) for i, t in rows], "doc_id long, text string, digest string, key string, n int, kept boolean").repartition(5)
    got = exact_duplicates(table, limit=limit, bucket_bytes=bucket)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == exact_brute(rows)
    assert exact_duplicates(table.limit(0)).count() == 0


def test_table_compares_contents():
    from helixspark.llm.exact import _Table

    t = _Table()
    for k in range(3000):  # all in one slot's run: the table grows and probes on
        t.add(k.to_bytes(24, "big") + bytes(8), str(k).encode(), 1, 1, k, 1)
    for k in range(3000):
        t.add(k.to_bytes(24, "big") + bytes(8), str(k).encode(), 1, 2, k + 1, 1)
    assert len(t.rows) == 3000 and all(r[2:] == [2, 2, k + 1, 1] for k, r in enumerate(t.rows))
    with pytest.raises(ValueError, match="two different texts"):
        t.add((5).to_bytes(24, "big") + bytes(8), b"another", 1, 1, 1, 1)


# Merkle manifests

def tree_brute(leaves, fanout):
    """(top, [siblings by level as (left, right)] for each leaf)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run, j = runs[i // fanout], i % fanout
            paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
        at, level = [i // fanout for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def manifest_brute(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n_chars, text))))
        by[source].append(((doc_id is not None, doc_id or 0), leaf, doc_id))
    tops, below = [], []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source])
        top, paths = tree_brute([x[1] for x in own], fanout)
        tops.append(top)
        below.append((own, paths))
    root, above = tree_brute(tops, fanout)
    out = Counter()
    for (own, paths), top, up in zip(below, tops, above, strict=True):
        for (_, leaf, doc_id), path in zip(own, paths, strict=True):
            out[(doc_id, leaf, top, root, tuple(path + up))] += 1
    return out


def some_docs():
    rng = random.Random(3)
    sizes = {"a": 1, "b": 2, "é": 90, None: 17, "": 16, "B": 5, "big": 300}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, "".join(rng.choices("aBc dÉ", k=9)), rng.choice(["en", None]), source, rng.choice([9, None])))
            k += 1
    rows += [(None, "no id", "en", "b", 5), (None, None, None, None, None), (5, "again", None, "é", 1), (30, None, "en", "é", 0), (30, None, "en", "é", 0), (30, "", "en", "é", 0)]
    rows += [(77, "the same row", "en", "big", 1)] * 60 + [(10**6, "Long " * 100_000, "en", "big", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fanout, every", [(16, 2), (2, 3), (3, 1)])
def test_manifest(spark, fanout, every):
    from helixspark.llm.merkle import folded, manifest, path_digest, tampered

    rows = some_docs()
    docs = spark.createDataFrame(rows, DOCS).withColumn("pos", F.lit("x")).withColumn("grp", F.lit("y")).withColumn("digest", F.lit(1)).repartition(5)
    m = manifest(docs, tampered(docs), fanout, every)
    proofs = m.proofs()
    got = proofs.select("doc_id", "leaf", "subroot", "root", "path", folded(F.col("leaf"), F.col("path")).alias("own"), folded(F.col("other"), F.col("path")).alias("bad"), (F.col("leaf") != F.col("other")).alias("changed"), path_digest(F.col("path")).alias("p")).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in got) == manifest_brute(rows, fanout)
    assert all(r.own == m.root and (r.bad == m.root) == (not r.changed) for r in got) and any(r.changed for r in got)
    assert all(r.p == sha("".join(a + b for a, b in r.path)) for r in got)
    # only every few levels are stored, and a stored level is as small as its place in the trees says
    n = m.rows.levels[0].groupBy("grp").count().collect()
    for j, level in enumerate(m.rows.levels[1:], 1):
        assert level.count() == sum(-(-r["count"] // fanout ** (every * j)) for r in n if r["count"] > fanout ** (every * (j - 1)))


def test_manifest_of_nothing_and_of_one(spark):
    from helixspark.llm.merkle import manifest

    none = manifest(spark.createDataFrame([], DOCS))
    assert none.root is None and none.proofs().count() == 0
    one = manifest(spark.createDataFrame([(None, None, None, None, None)], DOCS))
    (row,) = one.proofs().collect()
    assert row.leaf == row.subroot == row.root == one.root == sha("-----") and row.path == []


# conversation repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_brute(rows):
    """rows (turn, role, text) in order; their faults: b, d, t or empty."""
    out, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair_brute(rows):
    """The cheapest edits by trying all of them, with at most two rows inserted at each place."""
    faults, best = faults_brute(rows), None
    chains = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    ways = []
    for (_, role, _), fault in zip(rows, faults, strict=True):
        own = [("D", 2, None)]
        if fault not in ("b", "d"):
            extra = 5 if fault == "t" else 0
            own += [("K", extra, role[:1] or "-"), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        ways.append(own)
    for edits in itertools.product(*ways):
        for put in itertools.product(chains, repeat=len(rows) + 1):
            if 5 * sum(map(len, put)) > 12:
                continue
            roles = "".join("".join(p) + (e[2] or "") for p, e in itertools.zip_longest(put, edits, fillvalue=("", 0, "")))
            if GRAMMAR.fullmatch(roles):
                audit = "".join("I" * len(p) + e[0] for p, e in itertools.zip_longest(put, edits, fillvalue=("", 0, "")))
                cost = 5 * sum(map(len, put)) + sum(e[1] for e in edits)
                best = min(best or (cost, audit), (cost, audit))
    return best


def applied(rows, audit):
    out, state, k = [], "", 0
    for e in audit:
        if e == "I":
            state = "a" if state == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = rows[k]
        k += 1
        if e == "K":
            state = role[0]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = "a" if state == "u" else "u"
            out.append(f"{ {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    assert k == len(rows)
    return out


def some_conversations():
    rng = random.Random(11)
    rows = []
    for c in range(150):
        for k in range(rng.randint(1, 4)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "admin"])
            text = rng.choice(["Yes.", "No!", "well", " \n", "", "Is it?\t", "cut off", f"row {k}."])
            rows.append((c, rng.choice([k, k, k, 3 * k, None]), role, text))
    rows += [(None, 1, "user", "no id."), (None, None, "assistant", "none at all."), (500, None, "user", "x."), (500, None, "user", "x.")]
    return [*rows, (501, -(2**62), "user", "far."), (501, 2**62, "assistant", "apart.")]


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in by.items()}


def test_repair(spark):
    from helixspark.llm import conversations as C

    rows = some_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("mine")).withColumn("audit", F.lit("mine")).repartition(4)
    best, after = C.repair(C.turns(table))
    got = {r.conv_id: r for r in best.collect()}
    expected = ordered(rows)
    assert set(got) == set(expected) and best.count() == len(expected)
    turns = defaultdict(list)
    for r in after.collect():
        turns[r.conv_id].append((r.place, r.edit, f"{r.role}:{r.text}"))
    for c, own in expected.items():
        r, faults = got[c], faults_brute(own)
        assert (r.blank, r.duplicate, r.truncated) == (faults.count("b"), faults.count("d"), faults.count("t"))
        numbers = {t for t, _, _ in own if t is not None}
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert r.illegal == sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        assert (r.cost, r.audit) == repair_brute(own), own
        assert [x[2] for x in sorted(turns[c])] == applied(own, r.audit)


def test_nodes_are_shared(spark):
    """Each different suffix of all signatures is a node once, but for those on which a range of signatures begins."""
    from helixspark.llm import conversations as C

    rng = random.Random(2)
    signatures = {"".join(rng.choices("suaUxo", k=rng.randint(0, 30))) + rng.choice(["", "uauaua" * 50]) for _ in range(400)} | {"ua" * 3000}
    found = spark.createDataFrame([(s,) for s in signatures for _ in range(2)], "signature string")
    got = C.plans(found).collect()
    assert {r.signature for r in got} == signatures and len(got) == len(signatures)
    nodes = len({s[i:] for s in signatures for i in range(len(s))})
    assert nodes <= sum(r.n_new for r in got) <= nodes + 8 * max(map(len, signatures))
    whole = list(C._plans(iter([pa.RecordBatch.from_pydict({"signature": sorted(signatures, key=lambda s: s[::-1])})])))
    assert sum(sum(b.column("n_new").to_pylist()) for b in whole) == nodes


def test_long_and_empty_conversations(spark):
    from helixspark.llm import conversations as C

    one = [(1, k, ["user", "assistant"][k % 2], f"{k}." if k % 100 else f"no end {k}") for k in range(20_001)]
    best, after = C.repair(C.turns(spark.createDataFrame(one, "conv_id long, turn long, role string, text string").repartition(3)))
    (r,) = best.collect()
    assert r.truncated == 201 and len(r.audit) >= 20_001 and r.audit.count("I") == 0
    places = [x.place for x in after.select("place").orderBy("place").collect()]
    assert places == list(range(len(r.audit) - r.audit.count("D")))
    empty, none = C.repair(C.turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert empty.count() == none.count() == 0


def test_damage_and_query(spark, tmp_path):
    """Conversations that lose all rows stay, with zeros; nulls in any column; equal ids and turns share their damage."""
    import zlib

    from helixspark.llm import conversations as C

    rng = random.Random(8)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(40)]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "Hm.", "So?", "a b", "Good. Yes!", "Ünïcode…"])) for _ in range(600)]
    rows += [(c, 0, "user", "alone.") for c in range(1000, 1060)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    after = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            after += [row] * (2 if kind == 3 else 1)
    damaged = ordered(after)
    got = {r.conv_id: r for r in C.op11_query(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    lost = [c for c in got if c not in damaged]
    assert lost and all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for c in lost)
    for c, own in damaged.items():
        assert got[c].repaired_sha256 == sha("\n".join(applied(own, got[c].audit)))
        if len(own) <= 4:
            assert (got[c].cost, got[c].audit) == repair_brute(own)
