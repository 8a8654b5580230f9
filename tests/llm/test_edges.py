"""The training-data operators on empty tables, clashing columns, null and repeated ids, long texts and ties."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SF, jaccard_brute, repeats_brute, words

LINE = "the same line of text again and again\nand one more line that goes with it"
TEXTS = [None, "", LINE, f"start\n{LINE}", " ".join(words(90, 1, 10**6)), " ".join(words(90, 1, 10**6)), "idiot " * 30]
SCHEMA = "doc_id long, text string, source string, lang string, line_stats string, filter string, quality string, q int, words int, key long, sha string, kind int"


def table(spark, rows):
    """rows (doc_id, text) with columns that operators use for themselves."""
    return spark.createDataFrame([(i, t, "s", "en", "mine", "mine", "mine", 7, 8, 9, "x", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(7)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("b1", " ".join(words(90, 1, 10**6)[10:40])), (None, "one more line that goes"), ("b2", None)], "item_id string, text string")


def operators(labels, bench):
    from helixspark.llm import decontaminate, jaccard, lines, packing, quality, rules, suffix, tokens, toxicity

    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "lines": lines.dedup_lines,
        "packing": packing.pack,
        "jaccard": jaccard.near_duplicates,
        "suffix": suffix.remove_repeats,
        "rules": rules.cascade,
        "lengths": tokens.length_histogram,
        "quality": lambda d: quality.classify_quality(d, labels),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "decontaminate in blocks": lambda d: decontaminate.decontaminate(d, bench, block_bytes=800),
    }


NAMES = ["toxicity", "lines", "packing", "jaccard", "suffix", "rules", "lengths", "quality", "decontaminate", "decontaminate in blocks"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, labels, bench, name):
    """Empty tables give empty results; repeated and null ids, and columns of the operators' own names, do no harm."""
    run = operators(labels, bench)[name]
    assert run(table(spark, []).limit(0)).count() == 0
    rows = [*enumerate(TEXTS), (None, LINE), (None, None), (2, LINE), (4, "another text of the same id"), (5, TEXTS[5])]
    out = run(table(spark, rows))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    if name == "lengths":
        assert sum(r.n_docs for r in got) == len(rows)
    elif name == "packing":
        assert sum(r.piece == 0 for r in got) == len(rows)
    else:
        assert len(got) == len(rows)
    if name in ("lines", "rules"):
        assert {r.q for r in got} == {7} and {r.words for r in got} == {8} and {r.key for r in got} == {9}
    if name.startswith("decontaminate"):
        hits = sorted((r.doc_id is None, r.doc_id or 0, len(r.hit_words), tuple(r.items)) for r in got)
        assert [h for h in hits if h[2]] == [(False, 2, 5, ()), (False, 2, 5, ()), (False, 3, 5, ()), (False, 4, 30, ("b1",)), (False, 5, 30, ("b1",)), (False, 5, 30, ("b1",)), (True, 0, 5, ())]
    if name == "jaccard":
        by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
        assert by[(4, 86)] == by[(5, 86)] == 4 and by[(4, 2)] == 4 and by[(None, 12)] == 2 and by[(3, 13)] == 2
    if name == "suffix":
        by = sorted((r.doc_id, r.n_removed) for r in got if r.doc_id is not None)
        n = len(TEXTS[5])
        first = min(TEXTS[4], "another text of the same id", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
        assert [x for x in by if x[1] and x[0] < 6] == ([(5, n), (5, n)] if first == TEXTS[4] else [(4, n)])


def test_line_dedup_of_repeated_ids(spark):
    from helixspark.llm.lines import dedup_lines

    a, b = "one two\nthree four", "five six\nseven eight"
    got = dedup_lines(table(spark, [(1, a), (1, a), (1, f"{b}\n{a}"), (2, f"{a}\n{b}"), (None, a)])).collect()
    texts = sorted((r.doc_id or 0, r.text) for r in got)
    # the two rows of one text are one document; of the id's two texts one comes first, and it is the same in each run
    assert texts in ([(0, a), (1, a), (1, a), (1, b), (2, "")], [(0, a), (1, ""), (1, ""), (1, f"{b}\n{a}"), (2, "")])


def test_winnowed_places_are_few(spark):
    from helixspark.llm.lines import _fingerprints

    text = "\n".join(f"line {w}" for w in words(3000, 3, 10**9))
    places = table(spark, [(1, text)]).selectExpr(f"inline({_fingerprints(4, 50)})")
    n = places.count()
    assert 0.3 < n / 3000 < 0.5  # two of five lines, for windows of four
    p = sorted(r.p for r in places.collect())
    assert max(b - a for a, b in zip(p, p[1:])) <= 4


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_runs(spark, run):
    from helixspark.llm.lines import dedup_lines

    r = random.Random(run)
    texts = ["\n".join(f"w{r.randrange(6)}" for _ in range(r.randrange(30))) for _ in range(30)]
    seen, want = set(), []
    for t in texts:
        lines = [x for x in t.split("\n") if x]
        gone = set()
        for i in range(len(lines) - run + 1):
            k = tuple(lines[i : i + run])
            if k in seen:
                gone |= set(range(i, i + run))
            seen.add(k)
        want.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    got = {x.doc_id: x.text for x in dedup_lines(table(spark, enumerate(texts)), min_run=run).collect()}
    assert [got[i] for i in range(30)] == want


def test_urls_edges(spark):
    from helixspark.llm.urls import filter_urls

    urls = [None, "", "x", "http://", "http://a.com//de///7", "http://a.com/fr/8", "http://a.com/" + "s/" * 3000 + "9", "http://a.com/" + "s/" * 3000 + "9", "http://b.net/" + "x" * 100000, "http://n.net/es/1"]
    urls += [f"http://a{i}.example.org/es/{i}" for i in range(9)]
    pages = spark.createDataFrame([(i % 9, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, filter string")
    out = filter_urls(pages)
    assert out.columns == ["page_id", "url", "filter"] and filter_urls(pages.limit(0)).count() == 0
    got = {r.url: r["filter"] for r in out.collect()}
    assert got["http://a.com//de///7"].rule is None and got["http://a.com/fr/8"].verdict == "allow"
    assert got[urls[6]].template.count("/*") == 3001 and got["http://n.net/es/1"].verdict == "block"


def test_urls_without_rule_are_blocked(spark):
    """The tree decides: on the given pages some urls that no rule fits are blocked, and not all of them."""
    from helixspark.llm.urls import op6_query

    got = op6_query(spark, SF.replace("0.001", "0.01")).where("rule is null").groupBy("verdict").count().collect()
    n = {r.verdict: r["count"] for r in got}
    assert n["block"] > 0 and n["allow"] > 0


def test_rule_costs(spark):
    from helixspark.llm.rules import cascade, rule_costs

    rows = spark.range(400).selectExpr("id", "concat('x', id, repeat(' abc', 300)) text")
    slow = F.length(F.regexp_replace("text", "(a|b|c|x)+?[ ]*", "")) >= 0
    cheap, rare, never = F.col("id") % 2 == 0, F.col("id") == 3, F.col("id") < 0
    got = rule_costs(rows, {"slow": slow, "rare": rare, "cheap": cheap, "never": never})
    assert [x["rule"] for x in got[:1]] == ["cheap"] and got[-1]["rule"] == "never"
    by = {x["rule"]: x for x in got}
    assert by["slow"]["cost"] > 10 * by["cheap"]["cost"] and by["slow"]["rejected"] == 400 and by["rare"]["rejected"] == 1 and by["cheap"]["rejected"] == 200
    # ties: equal rules go by cost, and the verdict does not depend on the order
    text = " ".join(words(60, 5, 10**6))
    docs = table(spark, [(1, text), (2, text.upper())])
    assert {r.doc_id: r.quality.kept for r in cascade(docs, sample=1).collect()} == {1: True, 2: False}


def test_fullest_against_enumeration():
    from itertools import product

    from helixspark.llm.packing import fullest

    r = random.Random(2)
    for _ in range(300):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(r.randrange(1, 5))}
        room = r.randrange(1, 60)
        best = max(s for s in (sum(x * n for x, n in zip(counts, ns)) for ns in product(*(range(v + 1) for v in counts.values()))) if s <= room)
        got = fullest(counts, room)
        assert sum(x * n for x, n in got.items()) == best and all(n <= counts[x] for x, n in got.items())


def test_posteriors(spark):
    """Against the same formulas over plain lists: shrinkage by labelled counts, sites first, then paths."""
    from helixspark.llm.quality import posteriors

    r = random.Random(6)
    rates = {"a": 0.9, "b": 0.5, "c": 0.2, "d": 0.7}
    rows = [(s, p, int(r.random() < rates[s])) for s in rates for p, n in (("x", 80), ("y", 40), ("z", 3)) for _ in range(n if s != "d" else 1)]
    got = {(x.site, x.path): x for x in posteriors(spark.createDataFrame(rows, "site string, path string, y int")).collect()}

    def strength(groups):  # (n, good, mean)
        n = np.array([g[0] for g in groups], float)
        share, m = np.array([g[1] for g in groups]) / n, np.array([g[2] for g in groups], float)
        noise = (m * (1 - m)).sum() - (n * m * (1 - m)).sum() / n.sum()
        part = ((n * (share - m) ** 2).sum() - noise) / ((n.sum() - (n * n).sum() / n.sum()) * (n * m * (1 - m)).sum() / n.sum())
        return max(1.0, min(1e6, 1 / part - 1 if part > 0 else 1e6))

    def count(key):
        out = {}
        for row in rows:
            n, g = out.get(key(row), (0, 0))
            out[key(row)] = n + 1, g + row[2]
        return out

    sites, paths = count(lambda x: x[0]), count(lambda x: x[:2])
    m = (sum(g for _, g in sites.values()) + 0.5) / (len(rows) + 1)
    ks = strength([(n, g, m) for n, g in sites.values()])
    site_mean = {s: (g + ks * m) / (n + ks) for s, (n, g) in sites.items()}
    kp = strength([(n, g, site_mean[s]) for (s, _), (n, g) in paths.items()])
    for (s, p), (n, g) in paths.items():
        x = got[s, p]
        assert abs(x.m - m) < 1e-9 and abs(x.site_mean - site_mean[s]) < 1e-9
        assert abs(x.path_mean - (g + kp * site_mean[s]) / (n + kp)) < 1e-9
    # a site of three labels stays nearer to the global share than its own share is, one of 123 near its own
    assert abs(site_mean["a"] - sites["a"][1] / sites["a"][0]) < 0.02


def test_quality_with_sites_of_no_label(spark):
    from helixspark.llm.quality import classify_quality

    rows = [(i, " ".join(words(30, i)), f"s{i % 5}" if i < 50 else None, "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(50)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify_quality(docs, labels).collect()}
    assert len(got) == 60 and got[55].site is None and abs(got[55].site_mean - 40.5 / 51) < 1e-9
    assert got[0].site_mean < 0.3 < 0.9 < got[1].site_mean and not got[0].keep and got[1].keep


@pytest.mark.parametrize("name", ["jaccard", "suffix"])
def test_all_of_the_smallest_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    texts, ids = [r.text for r in rows], [r.doc_id for r in rows]
    if name == "jaccard":
        from helixspark.llm.jaccard import near_duplicates

        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
        assert [got[i] for i in ids] == [(n, ids[c]) for n, c in jaccard_brute(texts)]
    else:
        from helixspark.llm.suffix import remove_repeats

        got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.starts), x.kept_sha256) for x in remove_repeats(docs).collect()}
        assert [got[i] for i in ids] == repeats_brute(texts)


def test_classes_of_one_name_are_told_apart(spark, monkeypatch):
    from helixspark.llm import jaccard

    real = jaccard._class_of
    monkeypatch.setattr(jaccard, "_class_of", lambda tokens: (real(tokens)[0] % 3, real(tokens)[1]))
    texts = [" ".join(words(40, i // 2, 10**6)) for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(table(spark, enumerate(texts))).collect()}
    assert got == {i: i // 2 * 2 for i in range(20)}


def test_levels_of_a_frequent_token(spark, monkeypatch):
    from helixspark.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(1)
    core, texts = words(40, 4, 10**6), []
    for k in range(60):
        extra = words(r.choice([2, 4, 8, 12, 14, 20]), 100 + k // 2, 10**6)
        texts.append(" ".join(core + extra[: r.randrange(1, len(extra) + 1)]))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(table(spark, enumerate(texts))).collect()}
    assert [got[i] for i in range(60)] == jaccard_brute(texts)


def test_repeat_groups(spark):
    from helixspark.llm.suffix import repeat_groups

    r = random.Random(9)
    passage = " ".join(words(30, 5))
    texts = [" ".join(words(r.randrange(3, 20), k)) + passage[r.randrange(20) : len(passage) - r.randrange(20)] + " ".join(words(r.randrange(3, 30), k + 99)) for k in range(12)]
    texts += [texts[3], texts[4] + " end"]
    raw = [t.encode() for t in texts]
    groups, places = repeat_groups(table(spark, enumerate(texts)))
    of = {}
    for p in places.collect():
        of.setdefault(tuple(p.context_id), []).append((p.key, p.pos))
    by = {}
    for g in groups.collect():
        by.setdefault((tuple(g.group_id), g.n_left, g.n_right), []).extend((d, p - g.n_left, p + g.n_right) for d, p in of[tuple(g.context_id)])
    assert by
    shared = set()
    for members in by.values():
        strings = {raw[d][a:b] for d, a, b in members}
        assert len(strings) == 1 and len(members) > 1 and len(strings.pop()) >= 100
        before = {raw[d][a - 1 : a] if a else None for d, a, _ in members}
        assert len(before) > 1 or None in before or max(b - a for _, a, b in members) >= 76
        shared |= {frozenset(((d, i), (e, j))) for d, a, b in members for e, c, _ in members for i in range(a, b - 99) for j in [c + i - a] if (d, i) != (e, j)}
    # each pair of equal strings of different documents is in a group, unless all around them is equal as well
    at = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - 99):
            at.setdefault(b[i : i + 100], []).append((d, i))
    copies = {tuple(sorted((d, e))) for v in of.values() for d, _ in v for e, _ in v if d != e}
    for v in at.values():
        for x in v:
            for y in v:
                if x[0] < y[0] and (x[0], y[0]) not in copies:
                    assert frozenset((x, y)) in shared


def test_long_texts(spark, labels, bench):
    from helixspark.llm.jaccard import near_duplicates
    from helixspark.llm.quality import classify_quality
    from helixspark.llm.suffix import remove_repeats
    from helixspark.llm.toxicity import score_toxicity

    long = " ".join(words(300000, 7, 10**7))
    docs = table(spark, [(1, long), (2, long + " idiot"), (3, "x" * 3_000_000)])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    got = {r.doc_id: r for r in remove_repeats(docs, keep_bytes=False).collect()}
    assert got[1].n_removed == 0
    assert got[2].n_removed == len(long)
    assert got[3].n_removed == 3_000_000 - 1  # all but the first letter is in a string that also starts earlier
    assert score_toxicity(docs, labels).count() == 3 and classify_quality(docs, labels).count() == 3


def test_long_texts_by_lines_and_tokens(spark):
    """One text of 2 MB in a single line, one of 60,000 lines, and one of a million equal characters."""
    from helixspark.llm import decontaminate, lines, packing, rules, tokens

    many = "\n".join(f"line {k} of a long text" for k in range(60_000))
    one = " ".join(words(250_000, 3, 10**7))
    docs = table(spark, [(1, many), (2, "first\n" + many), (3, one), (4, "x" * 1_000_000)])
    got = {r.doc_id: r.line_stats for r in lines.dedup_lines(docs).select("doc_id", "line_stats").collect()}
    assert [(got[i].n_lines, got[i].n_removed) for i in (1, 2, 3, 4)] == [(60_000, 0), (60_001, 60_000), (1, 0), (1, 0)]
    pieces = packing.pack(docs).collect()
    lengths = {i: sum(r.length for r in pieces if r.doc_id == i) for i in (1, 2, 3, 4)}
    assert all(r.length <= 1024 for r in pieces) and all(sorted((r.start, r.length) for r in pieces if r.doc_id == i)[-1][0] > 1024 for i in (1, 2, 3))
    hist = {r.length: r.n_docs for r in tokens.length_histogram(docs).collect()}
    assert sum(hist.values()) == 4 and {n - 1 for n in lengths.values()} == set(hist)  # packing adds an end id
    kept = {r.doc_id: r.quality for r in rules.cascade(docs).select("doc_id", "quality").collect()}
    assert kept[3].n_words == 250_000 and kept[4].n_words == 1 and kept[1].n_words == 360_000
    bench = spark.createDataFrame([("b", " ".join(one.split()[-30:]))], "item_id string, text string")
    hits = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert len(hits[3].hit_words) == 30 and hits[3].hit_words[-1] == 249_999 and not hits[1].hit_words and hits[4].n_words == 1


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def brute_lines(rows):
    """Later repeats of runs of two lines, and of lines of 50 words."""
    pairs, single, out = set(), set(), {}
    for i, text in rows:
        lines = (text or "").split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a, b in zip(filled, filled[1:]):
            if (lines[a], lines[b]) in pairs:
                gone |= {a, b}
            pairs.add((lines[a], lines[b]))
        for k in filled:
            if len(lines[k].split()) >= 50:
                gone |= {k} if lines[k] in single else set()
                single.add(lines[k])
        if not gone or len(gone) < len(filled):
            out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone) if text is not None else None
    return out


def brute_hits(rows, bench):
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {tuple(w[k : k + min(10, len(w))]) for w in map(find, bench) if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(g) for g in grams}
    return {i for i, t in rows for w in [find(t)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams}


def test_pipeline_stage_by_stage(spark, pipeline):
    """Each stage but the first and last against brute force on its own input; the last by its pieces."""
    from helixspark.llm.quality import classify_quality
    from helixspark.llm.tokens import encoder

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = {r.doc_id for r in classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.keep}
    for name, stage in pipeline.STAGES[:-1]:
        rows = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            assert set(got) == keep and len([i for i in keep if labels.get(i) == 1]) >= 0.95 * sum(labels.values())
        elif name == "lines":
            assert got == brute_lines(rows)
        elif name == "near_copies":
            roots = jaccard_brute([t for _, t in rows])
            assert set(got) == {i for k, (i, _) in enumerate(rows) if roots[k][1] == k}
        else:
            assert set(got) == {i for i, _ in rows} - brute_hits(rows, bench)
        docs = out
    sizes = {}
    for r in pipeline.STAGES[-1][1](spark, docs, SF).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {r.doc_id: (len(encoder()(r.text)) if r.text else 0) + 1 for r in docs.collect()}


def test_pipeline_edges(spark, pipeline):
    rows = [*enumerate(TEXTS), (None, LINE), (None, " ".join(words(80, 77, 10**6))), (5, TEXTS[5])]
    docs = table(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and {r.line_stats for r in out.collect()} <= {"mine"}
        got = sorted(((r.doc_id is None, r.doc_id or 0) for r in out.collect()))
        assert name != "near_copies" or got == [(False, 0), (False, 1), (False, 2), (False, 4), (False, 6), (True, 0), (True, 0)]
