"""URL filters: explicit rules, and a path-template tree per host, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.runtime import others, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that vary by their form: numbers (with a file ending or not), hexadecimal ids, and mixtures of both kinds.
_FORMS = ((r"^[0-9]+$", "<num>"), (r"^[0-9]+[.][a-z]+$", "<num-file>"), (r"^[0-9a-fA-F-]{12,}$", "<hex>"), (r"^[^0-9]*[0-9]{4,}[^0-9]*$", "<id>"))
#: The rules of the registered query: (domain, path prefix, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MOST_RULES = 1000
#: Levels of OP6_SQL; the query goes down as far as path forms share a node.
DEPTH = 6
#: Borrowed labels are fractions: counts and shares this near are equal.
_SLACK = 1e-9


def host_path(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host, path, rules):
    """The longest rule that fits, as struct(rule, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; more belong in the labelled urls")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    # longer rules are asked first; of equal ones the first in their order
    for domain, prefix, verdict in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(f"{domain}{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def segments(path):
    """All path segments but empty ones, by their form where they vary."""
    def form(s):
        out = F.translate(s, _UPPER, _LOWER)
        for pattern, name in reversed(_FORMS):
            out = F.when(F.rlike(s, F.lit(pattern)), F.lit(name)).otherwise(out)
        return out

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), form)


def evidence(urls: DataFrame, borrowed: float = 10.0) -> DataFrame:
    """(host, segs, n, lab, bad) for urls(host, segs, label): labels and bad ones of each path form of a host.

    A form without labels on its own host takes those of the same form on all hosts, scaled to ``borrowed`` labels where
    there are more, so a host that no label reaches is judged by what is known of such paths elsewhere.
    """
    own = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    every = own.groupBy("segs").agg(F.sum("lab").alias("all_lab"), F.sum("bad").alias("all_bad"))
    part = F.least(F.col("all_lab").cast("double"), F.lit(borrowed))
    lab = F.when((F.col("lab") == 0) & (F.col("all_lab") > 0), part).otherwise(F.col("lab").cast("double"))
    bad = F.when((F.col("lab") == 0) & (F.col("all_lab") > 0), part * F.col("all_bad") / F.col("all_lab")).otherwise(F.col("bad").cast("double"))
    return own.join(every, "segs").select("host", "segs", "n", lab.alias("lab"), bad.alias("bad"))


def templates(urls: DataFrame, min_kids: int = 8, z: float = 1.96, borrowed: float = 10.0) -> DataFrame:
    """(host, segs, template, lab, bad) for the different (host, segs) of urls(host, segs, label), level by level.

    At a node, literal segments become ``*`` where they vary (``min_kids`` or more branches of under 3 urls on
    average); else a branch keeps its name only if its share of bad labels differs from its siblings' by a two-sided
    test of two proportions at ``z``, and branches that are alike merge into ``*``. Paths that end at a node are one
    unnamed branch there and do not go on. A path form that is alone at a node has nothing to differ from: the rest of
    it is ``*`` throughout, so levels are gone down only for as long as forms share a node, to the deepest one that does.
    """
    size = F.size("segs")
    t, done, level = written(evidence(urls, borrowed).withColumn("template", F.lit("")), "templates"), [], 0
    while not t.where(size > level).isEmpty():
        t = t.withColumn("kid", F.coalesce(F.get("segs", F.lit(level)), F.lit("")))
        kids = t.groupBy("host", "template", "kid").agg(F.count("*").alias("forms"), *(F.sum(c).alias(c) for c in ("n", "lab", "bad")))
        of = kids.groupBy("host", "template").agg(F.count_if(F.col("kid") != "").alias("kids"), F.sum("forms").alias("all_forms"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "lab", "bad")))
        both = kids.join(of, ["host", "template"])
        rest, rest_bad = F.col("all_lab") - F.col("lab"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.col("all_lab")
        # (p1 - p2)^2 > z^2 * p (1 - p) (1/n1 + 1/n2)
        apart = F.pow(F.col("bad") / F.col("lab") - rest_bad / rest, 2) >= z * z * share * (1 - share) * (1 / F.col("lab") + 1 / rest)
        own = (F.col("lab") > _SLACK) & (rest > _SLACK) & (F.col("all_bad") > _SLACK) & (F.col("all_bad") < F.col("all_lab") - _SLACK) & apart
        varies = (F.col("kids") >= min_kids) & (F.col("all_n") < 3 * F.col("kids"))
        name = F.when(F.col("kid") == "", "").when(~varies & F.coalesce(own, F.lit(False)), F.concat(F.lit("/"), F.col("kid"))).otherwise("/*")
        named = t.join(both.select("host", "template", "kid", name.alias("name"), (F.col("all_forms") == 1).alias("alone")), ["host", "template", "kid"])
        whole = F.when(F.col("alone"), F.concat("template", F.repeat(F.lit("/*"), F.greatest(size - level, F.lit(0))))).otherwise(F.concat("template", "name"))
        t = written(named.withColumn("template", whole).drop("kid", "name"), "templates")
        ended = (size <= level) | F.col("alone")
        done.append(t.where(ended).drop("alone"))
        t = t.where(~ended).drop("alone")
        level += 1
    for part in done:
        t = t.unionByName(part)
    return t.select("host", "segs", "template", "lab", "bad")


def rejected_templates(found: DataFrame, weight: float = 4.0, least: int = 5) -> DataFrame:
    """(host, template) of at least ``least`` labels whose smoothed share of bad ones is a half or more.

    A template's share is drawn to its host's, and that to the share of all labels, each as ``weight`` more labels.
    """
    of = found.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    hosts = of.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    every = hosts.agg(F.sum("h_lab").alias("g_lab"), F.sum("h_bad").alias("g_bad"))
    g = F.when(F.col("g_lab") > 0, F.col("g_bad") / F.col("g_lab")).otherwise(0.0)
    out = of.join(hosts, "host").crossJoin(F.broadcast(every))  # one row
    h = (F.col("h_bad") + weight * g) / (F.col("h_lab") + weight)
    return out.where((F.col("lab") >= least - _SLACK) & ((F.col("bad") + weight * h) / (F.col("lab") + weight) >= 0.5 - _SLACK)).select("host", "template")


def filter_urls(pages: DataFrame, rules=RULES, url_col: str = "url", label=None) -> DataFrame:
    """Judge each url by the longest rule that fits, else by its path template's labels.

    Labels are 1 (bad), 0 (good) or null: ``label`` if given (a Column of pages), else the verdicts of the rules. Hosts
    that no label reaches borrow those of equal path forms on other hosts (``evidence``). Templates are rejected by
    smoothed purity; a url of a template without enough labels is allowed.

    Returns the columns of pages and a struct ``filter``: host, path, rule, template, verdict; it replaces a column of
    that name. A null url, or one without ``://``, has an empty host and path and no rule. Each row gets its own result,
    whatever its id. An empty table gives an empty result. Counting by host and path form before the exchanges keeps a
    host with a third of all urls to one row for each form and task.
    """
    host, path = host_path(F.col(f"`{url_col}`").cast("string"))
    own = pages.select(F.struct(*(F.col(f"`{c}`") for c in others(pages, "filter")), F.lit(0).alias("__none")).alias("row"), host.alias("host"), path.alias("path"), (F.lit(None).cast("int") if label is None else label.cast("int")).alias("label"))
    own = own.withColumns({"hit": rule_for(F.col("host"), F.col("path"), rules), "segs": segments(F.col("path"))})
    if label is None:
        own = own.withColumn("label", F.when(F.col("hit").isNotNull(), (F.col("hit.verdict") == "block").cast("int")))
    found = templates(own.select("host", "segs", "label"))
    bad = rejected_templates(found).withColumn("bad", F.lit(True))
    verdicts = found.join(bad.select("host", "template", F.col("bad").alias("rejected")), ["host", "template"], "left").select("host", "segs", "template", "rejected")
    out = own.join(verdicts, ["host", "segs"], "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(*(F.col(f"row.`{c}`") for c in others(pages, "filter")), F.struct("host", "path", F.col("hit.rule").alias("rule"), "template", verdict.alias("verdict")).alias("filter"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    out = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict")


def _op6_sql() -> str:
    fits = lambda d, p: f"(host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(d, p)} THEN '{d}{p}'" for d, p, _ in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{d}{p}' THEN '{v}'" for d, p, v in longest) + " END"
    form = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for p, n in _FORMS) + f" ELSE translate(s, '{_UPPER}', '{_LOWER}') END"
    sql = rf"""
WITH p0 AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path FROM pages),
p1 AS (SELECT *, {rule} rule FROM p0),
p2 AS (SELECT *, {verdict} rv, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {form}) parts FROM p1),
p3 AS (SELECT *, list_transform(range(1, {DEPTH + 1}), lambda i: coalesce(parts[i], '')) segs, CASE WHEN rv IS NOT NULL THEN CAST(rv = 'block' AS INT) END label FROM p2),
o AS (SELECT host, segs, count(*) n, count(label) lab, coalesce(sum(label), 0) bad FROM p3 GROUP BY host, segs),
a AS (SELECT segs, sum(lab) all_lab, sum(bad) all_bad FROM o GROUP BY segs),
t0 AS (SELECT host, segs, n, CASE WHEN lab = 0 AND all_lab > 0 THEN least(CAST(all_lab AS DOUBLE), 10) ELSE CAST(lab AS DOUBLE) END lab,
  CASE WHEN lab = 0 AND all_lab > 0 THEN least(CAST(all_lab AS DOUBLE), 10) * all_bad / all_lab ELSE CAST(bad AS DOUBLE) END bad, '' template FROM o JOIN a USING (segs))"""
    for k in range(DEPTH):
        sql += f""",
k{k} AS (SELECT host, template, segs[{k + 1}] kid, sum(n) n, sum(lab) lab, sum(bad) bad FROM t{k} GROUP BY ALL),
o{k} AS (SELECT host, template, count(*) FILTER (WHERE kid <> '') kids, sum(n) all_n, sum(lab) all_lab, sum(bad) all_bad FROM k{k} GROUP BY ALL),
b{k} AS (SELECT host, template, kid, CASE WHEN kid = '' THEN '' WHEN NOT (kids >= 8 AND all_n < 3 * kids) AND lab > 1e-9 AND all_lab - lab > 1e-9 AND all_bad > 1e-9 AND all_bad < all_lab - 1e-9
  AND pow(bad / lab - (all_bad - bad) / (all_lab - lab), 2) >= 1.96 * 1.96 * (all_bad / all_lab) * (1 - all_bad / all_lab) * (1 / lab + 1 / (all_lab - lab)) THEN '/' || kid ELSE '/*' END name FROM k{k} JOIN o{k} USING (host, template)),
t{k + 1} AS (SELECT t.host, t.segs, t.n, t.lab, t.bad, t.template || b.name template FROM t{k} t JOIN b{k} b ON t.host = b.host AND t.template = b.template AND t.segs[{k + 1}] = b.kid)"""
    return sql + f""",
f AS (SELECT host, template, sum(lab) lab, sum(bad) bad FROM t{DEPTH} GROUP BY ALL),
h AS (SELECT host, sum(lab) h_lab, sum(bad) h_bad FROM f GROUP BY ALL),
g AS (SELECT CASE WHEN sum(h_lab) > 0 THEN sum(h_bad) / sum(h_lab) ELSE 0 END g FROM h),
r AS (SELECT host, template FROM f JOIN h USING (host), g WHERE lab >= 5 - 1e-9 AND (bad + 4 * ((h_bad + 4 * g) / (h_lab + 4))) / (lab + 4) >= 0.5 - 1e-9)
SELECT p3.page_id, p3.host, p3.path, p3.rule, coalesce(p3.rv, CASE WHEN r.host IS NOT NULL THEN 'block' ELSE 'allow' END) verdict
FROM p3 JOIN t{DEPTH} t ON p3.host = t.host AND p3.segs = t.segs LEFT JOIN r ON t.host = r.host AND t.template = r.template
"""


OP6_SQL = _op6_sql()
