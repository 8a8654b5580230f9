"""The training-data operators against brute force, round trips and SQL, and at their edges."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, extra int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", "en", 1) for i, t in enumerate(texts)], SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def edge_texts():
    a = words(120, 1, 10**6)
    near = a[:]
    near[50] = "changed"
    far = a[:60] + words(60, 2, 10**6)
    line = "the same line of text again and again"
    return [None, "", " ", "x", "x", " ".join(a), " ".join(near), " ".join(a), " ".join(far), f"{line}\n{line}\n{line}", f"intro\n{line}\n{line}", "Ünï cödé " * 40, "long " * 30000, "\n\n\n", "x" * 5000]


def jaccard_brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark, edge_texts, monkeypatch):
    from helixspark.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 3)  # groups of more than one block
    base = words(60, 9, 10**6)
    group = []
    for k in range(12):
        w = base[:]
        for p in range(0, k * 2, 2):
            w[p] = f"c{k}x{p}"
        group.append(" ".join(w))
    texts = edge_texts + group
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_brute(texts)


def test_components(spark):
    from helixspark.llm.graph import components

    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_brute(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_remove_repeats(spark, edge_texts):
    from helixspark.llm.suffix import remove_repeats

    r = random.Random(3)
    passage = " ".join(words(60, 5))
    texts = [t for t in edge_texts if t is None or len(t) < 20000]
    texts += [" ".join(words(r.randrange(20), k)) + passage[r.randrange(40) :] + " ".join(words(r.randrange(30), k + 99)) for k in range(25)]
    texts += ["ab" * 400, "ab" * 350 + "c"]
    want = repeats_brute(texts)
    for hot in (20000, 1):  # 1: every anchor of two contexts goes the way of hot ones
        got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.starts), x.kept_sha256) for x in remove_repeats(frame(spark, texts), hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_intervals():
    from helixspark.llm.suffix import intervals

    assert sorted(intervals([3, 5, 0, 2])) == [(2, 3, 4), (3, 0, 2), (5, 1, 2)]


def test_packing(spark, edge_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from helixspark.llm.packing import pack, plan

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    edge_texts = [*edge_texts, "hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b"]
    assert t.encode("hello <|endoftext|> x", add_special_tokens=False).ids == [31373, 220, 50256, 2124]
    got = pack(frame(spark, edge_texts), capacity=64).collect()
    docs, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(edge_texts):
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [2], 0
        for k, p in enumerate(sorted(docs[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and (p.length == 64 or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    slots = plan({10: 5, 6: 5, 4: 3, 16: 2}, 16)
    assert sum(hi - lo for _, lo, hi, *_ in slots) == 15 and max(s[3] for s in slots) < 9


def test_histogram(spark, edge_texts):
    from helixspark.llm.tokens import encoder, length_histogram

    edge_texts = [*edge_texts, "<|endoftext|> and <|endoftext|>"]
    n = [len(encoder()(t)) if t else 0 for t in edge_texts]
    assert n[-1] == 4
    got = {r.length: r for r in length_histogram(frame(spark, edge_texts)).collect()}
    assert set(got) == set(n)
    for x, r in got.items():
        assert (r.n_docs, r.n_longer, r.tokens_longer) == (n.count(x), sum(v > x for v in n), sum(v for v in n if v > x))
        assert r.truncated_tokens == sum(min(v, x) for v in n) and r.total_tokens == sum(n)


def test_toxicity(spark):
    from helixspark.llm.toxicity import score_toxicity

    r = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        w = words(80, i)
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(80)] = r.choice(["nastyword", "vileterm", "uglyname"])
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    texts += [None, "", "NASTYWORD here", "vileterm, uglyname!"]
    docs = frame(spark, texts)
    train = spark.createDataFrame(labels[:450], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in score_toxicity(docs, train).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert [got[600 + i] >= 0.5 for i in range(4)] == [False, False, True, True]
    assert score_toxicity(docs, train.limit(0)).count() == len(texts)


def test_quality(spark):
    from helixspark.llm.quality import classify_quality

    good = [" ".join(words(60, i)) for i in range(100)]
    bad = [" ".join(f"{w}###" for w in words(60, i)) for i in range(100)]
    docs = frame(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(0, 200, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in classify_quality(docs, labels).collect()}
    assert all(got[i] == (i < 100) for i in range(200)) and len(got) == 202
    assert classify_quality(docs, labels.limit(0)).count() == 202
    assert classify_quality(docs.limit(0), labels).count() == 0


def test_quality_of_tenfold_copy(spark):
    from pyspark.sql import functions as F

    from helixspark.llm.quality import classify_quality

    r = random.Random(8)
    sites = [(s, bad) for s, bad in (("a", 0.1), ("b", 0.3), ("c", 0.9)) for _ in range(80)]
    rows = [(i, " ".join(f"{w}##" if r.random() < 0.3 + 0.3 * (r.random() < bad) else w for w in words(40, i)), s, "en" if i % 2 else "de", 1) for i, (s, bad) in enumerate(sites)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(r.random() > bad)) for i, (_, bad) in enumerate(sites)], "doc_id long, quality int")
    tenfold = docs.crossJoin(spark.range(10).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("k")).drop("k")
    logit = lambda x: np.log(x / (1 - x))
    one, ten = ({x.doc_id: x for x in classify_quality(d, labels).collect()} for d in (docs, tenfold))
    assert len(ten) == 10 * len(one)
    shrinkage = {i: logit(ten[i].path_mean) - logit(x.path_mean) for i, x in one.items()}
    for i, x in one.items():
        assert abs(logit(ten[i + 9000].evidence) - logit(x.evidence)) < 1e-3
        assert abs(logit(ten[i + 9000].score) - logit(x.score) - shrinkage[i]) < 1e-3
    assert max(abs(logit(x.path_mean) - logit(np.mean([y.evidence for y in one.values()]))) for x in one.values()) > 0.2


def test_variety_reads_whole_text(spark):
    from helixspark.llm.quality import features

    def brute(t):
        w = (t or "").split()
        run = min(200, len(w))
        return sum(len(set(w[i : i + run])) for i in range(len(w) - run + 1)) / (len(w) - run + 1) / run if w else 0.0

    start = " ".join(f"a{i}" for i in range(200))
    texts = [start, f"{start} {'buy now ' * 400}", f"{start} {' '.join(words(800, 3, 10**6))}", " ".join(words(199, 1, 60)), " ".join(words(201, 2, 60)), "a a", "a", ""]
    got = {r.doc_id: r.variety for r in features(frame(spark, texts)).select("doc_id", "f.variety").collect()}
    assert all(abs(got[i] - brute(t)) < 1e-9 for i, t in enumerate(texts))
    assert got[1] < 0.5 < 0.95 < got[2]


def test_line_dedup_keeps_columns(spark, edge_texts):
    from helixspark.llm.lines import dedup_lines

    docs = frame(spark, edge_texts)
    out = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert len(out) == len(edge_texts) and out[0].text is None and out[1].text == ""
    line = edge_texts[9].split("\n")[0]
    assert out[9].text == line and out[10].text == "intro"
    assert dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_long_single_lines(spark):
    from helixspark.llm.lines import dedup_lines

    long, short, almost = " ".join(words(60, 1, 10**6)), "a short line", " ".join(words(49, 2, 10**6))
    texts = [f"one\n{long}\ntwo", f"three\n{long}\nfour\n{short}", long, f"{short}\nfive\n{long}\n{long}", f"six\n{almost}", f"seven\n{almost}", f"\n{long}\n{short}\nnine", f"eight\n{long}\n{short}\nnine"]
    got = {r.doc_id: (r.text, *r.line_stats) for r in dedup_lines(frame(spark, texts)).collect()}
    assert got[0] == (texts[0], 3, 0, 0) and got[1] == (f"three\nfour\n{short}", 4, 1, 1)
    assert got[2] == ("", 1, 1, 1) and got[3] == (f"{short}\nfive", 4, 2, 1)
    assert got[4][0] == texts[4] and got[5][0] == texts[5]
    assert got[6] == (f"\n{short}\nnine", 3, 1, 1) and got[7] == ("eight", 4, 3, 1)


def test_url_templates(spark):
    from helixspark.llm.urls import filter_urls

    urls = [f"http://a.net/bad/{i}" for i in range(20)] + [f"http://a.net/good/{i}" for i in range(20)] + [None, "", "no scheme", "http://", "HTTP://B.ORG?x", "http://x.example.org/en/12"]
    pages = spark.createDataFrame([(i, u, None if i in (3, 25) else int(i < 20) if i < 40 else None) for i, u in enumerate(urls)], "page_id long, url string, y int")
    from pyspark.sql import functions as F

    got = {r.page_id: r["filter"] for r in filter_urls(pages, label=F.col("y")).collect()}
    assert got[3].verdict == "block" and got[25].verdict == "allow" and got[3].template == "/bad/*"
    assert got[40].host == "" and got[42].path == "" and got[44].host == "b.org" and got[45].rule == "example.org/en/1"


def test_url_templates_of_deep_paths(spark):
    from pyspark.sql import functions as F

    from helixspark.llm.urls import filter_urls

    urls = [f"http://a.net/a/b{'/' * (i % 3)}/c/d/{'bad' if i < 20 else 'good'}/x/y{i % 2}" for i in range(40)] + ["http://a.net/a/b/c/d", "http://a.net/"]
    pages = spark.createDataFrame([(i, u, None if i in (3, 25) else int(i < 20) if i < 40 else None) for i, u in enumerate(urls)], "page_id long, url string, y int")
    got = {r.page_id: r["filter"] for r in filter_urls(pages, label=F.col("y")).collect()}
    assert len(got) == 42 and all(got[i].verdict == ("block" if i < 20 else "allow") for i in range(42))
    assert {got[i].template for i in range(20)} == {"/*/*/*/*/bad/*/*"} and got[40].template == "/*/*/*/*" and got[41].template == ""


def test_rules_edges(spark, edge_texts):
    from helixspark.llm.rules import cascade

    got = {r.doc_id: r.quality for r in cascade(frame(spark, edge_texts)).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[12].n_repeat_words == 30000 and got[5].kept and got[9].n_dup_lines == 2


def test_decontaminate_blocks(spark, edge_texts):
    from helixspark.llm.decontaminate import decontaminate

    docs = frame(spark, edge_texts)
    bench = spark.createDataFrame([("i1", " ".join(words(120, 1, 10**6)[20:40])), ("i2", "the SAME line, of text"), ("i3", None), ("i4", "")], "item_id string, text string")
    one = {r.doc_id: (r.n_words, r.hit_words, r.items, r.span_starts, r.span_ends) for r in decontaminate(docs, bench).collect()}
    many = {r.doc_id: (r.n_words, r.hit_words, r.items, r.span_starts, r.span_ends) for r in decontaminate(docs, bench, block_bytes=2000).collect()}
    assert one == many and one[5][2] == ["i1"] and len(one[5][1]) == 20 and one[9][2] == ["i2"]
    assert decontaminate(docs, bench.limit(0)).where("size(hit_words) > 0").count() == 0


def test_window_table_is_small_and_whole():
    """16 MiB of items, some of them repeated: their arrays stay under 300 MB, and every window is there with all its items."""
    from helixspark.llm.decontaminate import window_table

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=60))) for k in range(45_000)]
    items += [("again", items[7][1]), (None, items[7][1]), ("short", "Two words"), ("empty", ""), (None, None), ("twice", "a b c d e f g h i j a b c d e f g h i j")]
    assert sum(len(t or "") for _, t in items) > 16 << 20
    table = window_table(items, 10)
    assert table.nbytes() < 300_000_000
    w = table.windows[10]
    assert sorted(table.windows) == [2, 10] and (w.hashes[1:] >= w.hashes[:-1]).all()
    at = {table.text[a : a + n].tobytes(): k for k, (a, n) in enumerate(zip(w.start.tolist(), w.size.tolist(), strict=True))}
    own = lambda words: [table.names[i].as_py() for i in w.items[w.first[at[words]] : w.first[at[words] + 1]].tolist()]
    seven = items[7][1].split()
    assert all(own(" ".join(seven[k : k + 10]).encode()) == ["i7", "again", None] for k in range(51))
    assert own(b"a b c d e f g h i j") == ["twice"] and len(at) == len(w.hashes) >= 45_000 * 51


def test_decontaminate_null_item(spark, edge_texts):
    from helixspark.llm.decontaminate import decontaminate

    docs = frame(spark, edge_texts)
    bench = spark.createDataFrame([(None, " ".join(words(120, 1, 10**6)[20:40])), ("i2", "the same line of text"), (None, "of text again and")], "item_id string, text string")
    for size in (32 << 20, 1000):
        got = {r.doc_id: r for r in decontaminate(docs, bench, block_bytes=size).collect()}
        assert len(got[5].hit_words) == 20 and got[5].items == [] and len(got[5].span_starts) == 1
        assert got[9].items == ["i2"] and len(got[9].hit_words) == 24 - 3


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_url_filter", "op7_quality_rules", "op10_decontaminate"])
def test_sql(spark, name):
    from helixspark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    out = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in out.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
