"""Registered queries of routing, evaluation and experiment tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from helixspark.functions import sequence as S
from helixspark.operators import evaluate, experiments, kmers, reconstruct, routing
from helixspark.plans.registry import query
from helixspark.plans.strand_queries import ANOMALY, C, K12, R
from helixspark.sources import fixture
from helixspark.sources.fixture import table
from helixspark.sources.scratch import frozen


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score"), "o_orderpriority", "o_orderstatus", "o_custkey")


@query("topk_route", "SELECT o_orderkey AS key, o_totalprice score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM orders)")
def topk_route(spark, sf):
    o = orders(spark, sf).select("key", "score")
    return routing.topk(o, -(-o.count() // 10), key="key")


def gate_sql(num: int, den: int) -> str:
    return f"WITH g AS (SELECT list_sort(list(l_quantity))[count(*) * {num} // {den} + 1] gate FROM lineitem) SELECT l_orderkey, l_linenumber, gate, l_quantity >= gate active FROM lineitem, g"


@query("median_gate", gate_sql(1, 2))
def median_gate(spark, sf):
    return routing.gate(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 1, 2).select("l_orderkey", "l_linenumber", "gate", "active")


@query("q3_gate", gate_sql(3, 4))
def q3_gate(spark, sf):
    return routing.gate(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 3, 4).select("l_orderkey", "l_linenumber", "gate", "active")


DECILE = "d AS (SELECT o_orderkey AS key, o_totalprice score, o_orderstatus, CAST(least(10, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 // count(*) OVER () + 1) AS INT) decile FROM orders)"


@query("rank_decile", f"WITH {DECILE} SELECT key, score, decile FROM d")
def rank_decile(spark, sf):
    return routing.rank_decile(orders(spark, sf).select("key", "score"), "score", "key")


@query("gate_by_decile", f"WITH {DECILE} SELECT decile, count(*) clusters, count(*) FILTER (WHERE o_orderstatus = 'F') failed, count(*) FILTER (WHERE score > 150000) active, 100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) failed_percent, 100.0 * count(*) FILTER (WHERE score > 150000) / count(*) active_percent, coalesce(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F' AND score > 150000) / nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0), 'nan'::DOUBLE) failed_active_percent FROM d GROUP BY decile")
def gate_by_decile(spark, sf):
    d = routing.rank_decile(orders(spark, sf), "score", "key").withColumns({"failed": F.col("o_orderstatus") == "F", "active": F.col("score") > 150000})
    return evaluate.gate_by_decile(d)


@query("systematic_sample", C + ", n AS (SELECT count(*) n FROM centers) SELECT DISTINCT cluster_id FROM centers, n, (SELECT unnest(range(0, 128)) s) WHERE n <= 128 OR cluster_id - 1 = s * n // 128")
def systematic_sample(spark, sf):
    c = fixture.centers(spark, sf).withColumn("i", F.col("cluster_id") - 1)
    return routing.systematic_sample(c, "i", 128).select("cluster_id")


HASH = "('0x' || substr(sha256({}), 1, 15))::BIGINT"
NESTED = R + f""", rich AS (SELECT cluster_id FROM reads GROUP BY 1 HAVING count(*) >= 10), k AS (SELECT seed, cluster_id, read_idx, read, CAST(row_number() OVER (PARTITION BY seed, cluster_id ORDER BY {HASH.format("seed || ':' || cluster_id || ':' || read_idx")}, read_idx) AS INT) rank FROM reads JOIN rich USING (cluster_id), (SELECT CAST(unnest([1, 2]) AS INT) seed)),
ns AS (SELECT seed, coverage, cluster_id, rank, read_idx, read FROM k, (SELECT CAST(unnest([5, 8, 10]) AS INT) coverage) WHERE rank <= coverage)"""


@query("nested_coverage", NESTED + " SELECT * FROM ns")
def nested_coverage(spark, sf):
    return routing.nested_samples(fixture.clusters(spark, sf), [1, 2], [5, 8, 10])


@query("verify_nested", NESTED + ", l AS (SELECT * FROM (VALUES (5, 8), (8, 10)) t(small, large)) SELECT a.seed, l.small, l.large, count(*) FILTER (WHERE b.rank IS NULL) missing FROM ns a JOIN l ON a.coverage = l.small LEFT JOIN ns b ON b.coverage = l.large AND b.seed = a.seed AND b.cluster_id = a.cluster_id AND b.rank = a.rank AND b.read_idx = a.read_idx GROUP BY ALL")
def verify_nested(spark, sf):
    return routing.nested_violations(routing.nested_samples(fixture.clusters(spark, sf), [1, 2], [5, 8, 10]))


@query("verify_nested_samples", NESTED + """, lv AS (SELECT DISTINCT seed, coverage FROM ns), per AS (SELECT seed, coverage, cluster_id, count(*) n, count(DISTINCT rank) d, min(rank) lo, max(rank) hi FROM ns GROUP BY ALL)
SELECT 'reads' AS "rule", seed, coverage, (SELECT count(*) FROM ns WHERE ns.seed = lv.seed AND ns.coverage = lv.coverage AND NOT EXISTS (SELECT 1 FROM reads r WHERE r.cluster_id = ns.cluster_id AND r.read_idx = ns.read_idx AND r.read = ns.read)) violations FROM lv
UNION ALL SELECT 'cohort', seed, coverage, (SELECT count(*) FROM rich) - (SELECT count(*) FROM per WHERE per.seed = lv.seed AND per.coverage = lv.coverage) FROM lv
UNION ALL SELECT 'order', seed, coverage, (SELECT count(*) FROM per WHERE per.seed = lv.seed AND per.coverage = lv.coverage AND (n <> per.coverage OR d <> per.coverage OR lo <> 1 OR hi <> per.coverage)) FROM lv""")
def verify_nested_samples(spark, sf):
    r = fixture.reads(spark, sf)
    return routing.nested_report(routing.nested_samples(fixture.clusters(spark, sf), [1, 2], [5, 8, 10]), r)


#: Contexts (reuse, phase, fallback) that lead to each policy, with a share to route by hand in the first.
CONTEXTS = ((0.6, 4.0, False, 0.25), (0.2, 4.0, False, None), (0.2, 7.0, False, None), (0.3, 2.0, False, None), (0.1, 2.0, False, None), (0.05, 4.0, True, None))
ROUTES = R + ANOMALY + """, gr AS (SELECT cluster_id, count(*) num_reads, count(*) FILTER (WHERE abs(length(read) - 110) > 3) weak FROM reads GROUP BY 1), s AS (SELECT gr.*, coalesce(score, 0) score FROM gr LEFT JOIN anomaly USING (cluster_id)),
q AS (SELECT list_sort(list(score))[count(*) // 2 + 1] med, list_sort(list(num_reads))[count(*) * 3 // 4 + 1] q3 FROM s), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, cluster_id) r, count(*) OVER () n FROM s),
routes AS (SELECT 0 context, 'manual-fraction' AS policy, cluster_id, score joint_anomaly, r <= ceil(0.25 * n) joint_active FROM t UNION ALL SELECT 1, 'median-anomaly-or-coverage', cluster_id, score, score >= med OR num_reads >= q3 FROM t, q UNION ALL SELECT 2, 'low-reuse-high-phase-dense', cluster_id, 0, true FROM t
  UNION ALL SELECT 3, 'low-phase-weak-position', cluster_id, 0, weak >= 2 FROM t UNION ALL SELECT 4, 'low-phase-weak-position', cluster_id, 0, weak >= 1 FROM t UNION ALL SELECT 5, 'shallow-dense-fallback', cluster_id, 0, true FROM t)"""


def route_contexts(spark, sf):
    """(context, policy, routes) of each context, from scores of all clusters rounded as the SQL rounds them."""
    rows = fixture.clusters(spark, sf)
    seqs = fixture.centers(spark, sf).select("cluster_id", F.col("center").alias("seq"))
    guides = rows.select("cluster_id", F.size("r").cast("long").alias("num_reads"), F.size(F.filter("r", lambda x: F.abs(F.length(x["read"]) - 110) > 3)).cast("long").alias("weak_positions"))
    found = kmers.anomaly_scores(seqs, rows, 8).select("cluster_id", F.round("score", 6).alias("score"))
    rows = frozen(guides.join(found, "cluster_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "scores")
    n = rows.count()
    for i, (reuse, phase, fallback, share) in enumerate(CONTEXTS):
        routed, policy = reconstruct.decide(rows, {"reuse": reuse, "phase": phase, "fallback": fallback, "n": n}, reconstruct.Params(route_fraction=share))
        yield i, policy, routed


@query("route_policies", ROUTES + " SELECT CAST(context AS INT) context, policy, cluster_id, CAST(joint_anomaly AS DOUBLE) joint_anomaly, joint_active FROM routes")
def route_policies(spark, sf):
    parts = [routed.select(F.lit(i).alias("context"), F.lit(policy).alias("policy"), "cluster_id", "joint_anomaly", "joint_active") for i, policy, routed in route_contexts(spark, sf)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("run_metrics", ROUTES + " SELECT CAST(context AS INT) context, policy, count(*) clusters, count(*) FILTER (WHERE joint_active) planned, 100.0 * count(*) FILTER (WHERE joint_active) / count(*) planned_percent, round(avg(joint_anomaly), 6) mean_anomaly FROM routes GROUP BY ALL")
def run_metrics(spark, sf):
    """The metrics row of a run, for each context."""
    parts = [reconstruct.run_metrics(routed, policy).withColumns({"context": F.lit(i), "mean_anomaly": F.round("mean_anomaly", 6)}) for i, policy, routed in route_contexts(spark, sf)]
    return reduce(lambda a, b: a.unionByName(b), parts)


SPLIT = C + f""", h AS (SELECT cluster_id, center, row_number() OVER (ORDER BY {HASH.format("'5:' || cluster_id")}, cluster_id) - 1 r, count(*) OVER () n FROM centers), sp AS (SELECT cluster_id, center, CASE WHEN r < CAST(floor(0.8 * n) AS BIGINT) THEN 'train' WHEN r < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT) THEN 'val' ELSE 'test' END split FROM h)"""


@query("split_assign", SPLIT + " SELECT cluster_id, split FROM sp")
def split_assign(spark, sf):
    return routing.split_assign(fixture.centers(spark, sf), "cluster_id", 5).select("cluster_id", "split")


@query("split_overlap", SPLIT + " SELECT a.split split_a, b.split split_b, count(DISTINCT a.center) shared FROM sp a JOIN sp b ON a.center = b.center AND a.split < b.split GROUP BY ALL")
def split_overlap(spark, sf):
    return routing.split_overlap(routing.split_assign(fixture.centers(spark, sf), "cluster_id", 5), "center")


@query("context_budget", R + f""", k AS (SELECT cluster_id, read_idx, read, count(*) OVER (PARTITION BY cluster_id) n, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {HASH.format("'7:' || cluster_id || ':' || read_idx")}, read_idx) AS INT) rank FROM reads),
u AS (SELECT *, CAST(sum(length(read) + 1) OVER (PARTITION BY cluster_id ORDER BY rank) - 1 AS BIGINT) used FROM k WHERE n >= 2 AND rank <= 10) SELECT cluster_id, read_idx, rank, used FROM u WHERE used <= 900""")
def context_budget(spark, sf):
    return routing.context_budget(fixture.clusters(spark, sf), budget=900)


@query("summary_stats", "SELECT l_returnflag, l_linestatus, count(*) n, avg(l_quantity) l_quantity_mean, coalesce(stddev_samp(l_quantity), 0) l_quantity_sd, coalesce(stddev_samp(l_quantity), 0) / sqrt(count(*)) l_quantity_sem, median(l_quantity) l_quantity_median FROM lineitem GROUP BY ALL")
def summary_stats(spark, sf):
    return evaluate.summary_stats(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus"], ["l_quantity"])


@query("auc", "WITH r AS (SELECT quality, avg(rn) OVER (PARTITION BY s) rk FROM (SELECT quality, n_chars s, row_number() OVER (ORDER BY n_chars) rn FROM documents JOIN labels USING (doc_id))) SELECT (sum(rk) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)) auc, count(*) FILTER (WHERE quality = 1) positives, count(*) FILTER (WHERE quality = 0) negatives FROM r")
def auc(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return evaluate.auc(d, "n_chars", "quality")


@query("mcnemar", """WITH t AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) both_, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) harmed, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) rescued, count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) neither FROM labels),
p AS (SELECT sum(exp(lgamma(harmed + rescued + 1.0) - lgamma(i + 1.0) - lgamma(harmed + rescued - i + 1.0) - (harmed + rescued) * ln(2.0))) s FROM t, LATERAL (SELECT unnest(range(0, least(harmed, rescued) + 1)) i))
SELECT both_ AS "both", harmed, rescued, neither, round(least(1.0, 2 * s), 9) p_value FROM t, p""")
def mcnemar(spark, sf):
    out = evaluate.mcnemar(table(spark, sf, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")
    return out.withColumn("p_value", F.round("p_value", 9))


@query("phase_summary", R + """, e AS (SELECT cluster_id, levenshtein(center, first(read ORDER BY read_idx)) g, levenshtein(center, last(read ORDER BY read_idx)) f, length(first(read ORDER BY read_idx)) l FROM reads JOIN centers USING (cluster_id) GROUP BY cluster_id, center),
x AS (SELECT *, CASE WHEN l = 110 THEN 'same' WHEN l < 110 THEN 'short' ELSE 'long' END error_type, CASE WHEN f = 0 THEN 'exact' WHEN f < g THEN 'partial' WHEN f = g THEN 'unchanged' ELSE 'worsened' END o FROM e)
SELECT error_type, count(*) clusters, 100.0 * count(*) FILTER (WHERE o = 'exact') / count(*) exact_percent, 100.0 * count(*) FILTER (WHERE o = 'partial') / count(*) partial_percent, 100.0 * count(*) FILTER (WHERE o = 'unchanged') / count(*) unchanged_percent, 100.0 * count(*) FILTER (WHERE o = 'worsened') / count(*) worsened_percent,
coalesce(100.0 * (sum(g) - sum(f)) / nullif(sum(g), 0), 'nan'::DOUBLE) ed_reduction_percent, 100.0 * count(*) / (SELECT count(*) FROM x) share_percent FROM x GROUP BY error_type""")
def phase_summary(spark, sf):
    e = fixture.reads(spark, sf).groupBy("cluster_id").agg(F.min_by("read", "read_idx").alias("a"), F.max_by("read", "read_idx").alias("b")).join(fixture.centers(spark, sf), "cluster_id")
    e = e.select(F.levenshtein("center", "a").alias("guide_ed"), F.levenshtein("center", "b").alias("final_ed"), F.length("a").alias("l"))
    e = e.withColumns({"error_type": F.when(F.col("l") == 110, "same").when(F.col("l") < 110, "short").otherwise("long"), "outcome": S.outcome(F.col("guide_ed"), F.col("final_ed"))})
    return evaluate.phase_summary(e)


@query("linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) n FROM lineitem")
def linear_fit(spark, sf):
    out = evaluate.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("nondeterminism_check", C + " SELECT md5(substr(center, 1, 12)) digest_key, count(DISTINCT sha256(center)) digests FROM centers GROUP BY ALL HAVING count(DISTINCT sha256(center)) > 1")
def nondeterminism_check(spark, sf):
    c = fixture.centers(spark, sf).select(F.md5(F.substring("center", 1, 12).cast("binary")).alias("digest_key"), F.sha2("center", 256).alias("digest"))
    return evaluate.nondeterministic(c, ["digest_key"], "digest")


#: Experiment rows from orders: a condition (coverage and rate), a seed and a method for each customer group.
RUNS = "runs AS (SELECT CAST(o_custkey % 4 AS INT) * 5 + 5 coverage, CAST(o_custkey % 3 AS INT) seed, ['main', 'beam', 'freq'][CAST(o_orderkey % 3 AS INT) + 1] AS method, avg(o_totalprice) / 1000 success, avg(o_totalprice % 97) mean_ed, CAST(count(*) AS DOUBLE) AS seconds FROM orders GROUP BY ALL)"


def runs(spark, sf):
    o = table(spark, sf, "orders").select(((F.col("o_custkey") % 4).cast("int") * 5 + 5).alias("coverage"), (F.col("o_custkey") % 3).cast("int").alias("seed"), F.get(F.array(*map(F.lit, ("main", "beam", "freq"))), (F.col("o_orderkey") % 3).cast("int")).alias("method"), "o_totalprice")
    return o.groupBy("coverage", "seed", "method").agg((F.avg("o_totalprice") / 1000).alias("success"), F.avg(F.col("o_totalprice") % 97).alias("mean_ed"), F.count("*").cast("double").alias("seconds"))


@query("experiment_grid", "SELECT DISTINCT a.o_orderpriority priority, b.n_name nation, c.r_name region FROM (SELECT DISTINCT o_orderpriority FROM orders) a, nation b, region c")
def experiment_grid(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()
    return p.crossJoin(F.broadcast(table(spark, sf, "nation").select(F.col("n_name").alias("nation")))).crossJoin(F.broadcast(table(spark, sf, "region").select(F.col("r_name").alias("region"))))


@query("sweep_grid", f"WITH {RUNS} SELECT method, parameter, CAST(value AS DOUBLE) AS value, count(*) runs FROM runs, (VALUES ('band', 3.0), ('band', 6.0), ('weight', 0.4), ('weight', 0.68)) s(parameter, value) GROUP BY ALL")
def sweep_grid(spark, sf):
    settings = spark.createDataFrame([("band", 3.0), ("band", 6.0), ("weight", 0.4), ("weight", 0.68)], "parameter string, value double")
    return runs(spark, sf).crossJoin(F.broadcast(settings)).groupBy("method", "parameter", "value").agg(F.count("*").alias("runs"))


@query("paired_advantage", f"""WITH {RUNS}, w AS (SELECT coverage, seed, max(success) FILTER (WHERE method = 'main') m, max(success) FILTER (WHERE method = 'beam') b, max(success) FILTER (WHERE method = 'freq') f, max(mean_ed) FILTER (WHERE method = 'main') me, max(mean_ed) FILTER (WHERE method = 'beam') be, max(mean_ed) FILTER (WHERE method = 'freq') fe FROM runs GROUP BY ALL)
SELECT coverage, seed, m - greatest(b, f) success_gain, least(be, fe) - me ed_gain FROM w WHERE m IS NOT NULL AND b IS NOT NULL AND f IS NOT NULL""")
def paired_advantage(spark, sf):
    return experiments.paired_advantage(runs(spark, sf), "main", ["beam", "freq"], ["coverage", "seed"])


BY_METHOD = f"{RUNS}, m AS (SELECT coverage, method, avg(success) success, avg(seconds) AS seconds FROM runs GROUP BY ALL)"


def by_method(spark, sf):
    return runs(spark, sf).groupBy("coverage", "method").agg(F.avg("success").alias("success"), F.avg("seconds").alias("seconds"))


@query("delta_vs_baseline", f"WITH {BY_METHOD} SELECT m.coverage, m.method, m.success, m.seconds, m.success - b.success success_delta, m.seconds - b.seconds seconds_delta, m.success / b.success success_ratio, m.seconds / b.seconds seconds_ratio FROM m JOIN m b ON m.coverage = b.coverage AND b.method = 'main'")
def delta_vs_baseline(spark, sf):
    return experiments.delta_vs_baseline(by_method(spark, sf), "coverage", "method", "main", ["success", "seconds"])


@query("robustness", f"WITH {BY_METHOD} SELECT m.coverage, max(abs(m.success - b.success)) max_abs_success_delta, min(m.seconds) min_seconds, max(m.seconds) max_seconds FROM m JOIN m b ON m.coverage = b.coverage AND b.method = 'main' GROUP BY m.coverage")
def robustness(spark, sf):
    return experiments.robustness(experiments.delta_vs_baseline(by_method(spark, sf), "coverage", "method", "main", ["success", "seconds"]), ["coverage"])


@query("advantage_matrix", f"WITH {RUNS} SELECT method, coalesce(avg(success) FILTER (WHERE coverage = 5), 'nan'::DOUBLE) c5, coalesce(avg(success) FILTER (WHERE coverage = 10), 'nan'::DOUBLE) c10, coalesce(avg(success) FILTER (WHERE coverage = 25), 'nan'::DOUBLE) c25 FROM runs GROUP BY method")
def advantage_matrix(spark, sf):
    return experiments.advantage_matrix(runs(spark, sf), "method", "coverage", [5, 10, 25], "success")


#: Two whole tables with some common keys: a day's state of customers' orders, and what the event stream last said of users.
OLD = "old AS (SELECT CAST(o_custkey AS BIGINT) AS key, max(o_orderstatus) status FROM orders GROUP BY 1), new AS (SELECT CAST(user_id AS BIGINT) AS key, max(event_type) status FROM events GROUP BY 1)"


def old_new(spark, sf):
    old = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("key")).agg(F.max("o_orderstatus").alias("status"))
    return old, table(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("key")).agg(F.max("event_type").alias("status"))


@query("merge_last_wins", f"WITH {OLD} SELECT coalesce(new.key, old.key) AS key, coalesce(new.status, old.status) status FROM old FULL JOIN new ON old.key = new.key")
def merge_last_wins(spark, sf):
    return experiments.merge_last_wins(list(old_new(spark, sf)), ["key"])


@query("upsert", f"WITH {OLD} SELECT key, status FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT key, status FROM new")
def upsert(spark, sf):
    return experiments.upsert(*old_new(spark, sf), ["key"])


@query("resume_anti_join", f"WITH {OLD} SELECT key, status FROM new WHERE key NOT IN (SELECT key FROM old)")
def resume_anti_join(spark, sf):
    old, new = old_new(spark, sf)
    return experiments.pending(new, old, ["key"])


@query("custom_order", "SELECT o_orderstatus, count(*) n, min(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 99 END) place FROM orders GROUP BY ALL")
def custom_order(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    place = F.coalesce(F.nullif(F.array_position(F.array(F.lit("P"), F.lit("O")), F.col("o_orderstatus")), F.lit(0).cast("long")), F.lit(99).cast("long")).cast("int")
    return experiments.ordered(n, "o_orderstatus", ["P", "O"], "o_orderstatus").withColumn("place", place)


@query("reuse_by_cluster", C + f", {K12} SELECT cluster_id, count(*) windows, count(*) FILTER (WHERE support >= 2) shared FROM w JOIN s USING (kmer) GROUP BY cluster_id")
def reuse_by_cluster(spark, sf):
    seqs = fixture.centers(spark, sf).select("cluster_id", F.col("center").alias("seq"))
    return kmers.reuse_by_sequence(seqs, 12)
