"""Quality by hierarchical empirical Bayes: a document classifier combined with site and path posteriors."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.runtime import sample_rows, written

_SPACE = " \t\n\x0b\x0c\r"
_FEATURES = ("symbols", "bars", "upper", "digits", "marks", "word_length", "size", "stutter", "variety")
_RUN = 200


def variety(words):
    """The mean share of different words over all runs of ``_RUN`` words (or the whole text, where it has fewer); 0 without words.

    A run has one different word less for each pair of neighbouring occurrences of a word inside it, so the pairs less
    than a run apart are summed, each as often as runs hold it. Words are sorted by 33 bits of their hash and their
    position (30 bits: a string has fewer words); hashes can only meet by chance inside a run.
    """
    n = F.size(words)
    run = F.least(n, F.lit(_RUN))
    at = F.sort_array(F.transform(words, lambda w, i: F.shiftrightunsigned(F.xxhash64(w), 31).bitwiseAND((1 << 33) - 1) * (1 << 30) + i))

    def runs_with(a, b):
        p = a.bitwiseAND((1 << 30) - 1)
        return F.when(b - a < run, F.least(p, n - run) - F.greatest(p + (b - a) - run + 1, F.lit(0)) + 1).otherwise(0)

    pairs = F.zip_with(F.slice(at, 1, F.greatest(n - 1, F.lit(1))), F.slice(at, 2, F.greatest(n - 1, F.lit(1))), runs_with)
    less = F.aggregate(pairs, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(1 - less / ((n - run + 1).cast("double") * run))


def features(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with a struct ``f`` of figures that do not depend on language; all are 0 for a text without words."""
    text = F.col("text")
    with_words = docs.withColumn("words", F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    n = F.greatest(F.size("words"), F.lit(1)).cast("double")
    letters = F.greatest(F.length(text), F.lit(1)).cast("double")

    def count(chars: str):
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")

    capped = lambda x: F.least(x, F.lit(3.0))
    return with_words.withColumn(
        "f",
        F.struct(
            capped(count("#*$%&<>") / n).alias("symbols"),
            capped(count("|") / n).alias("bars"),
            (F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / letters).alias("upper"),
            (count("0123456789") / letters).alias("digits"),
            capped(count("!?") / n).alias("marks"),
            F.least(F.length(F.translate(text, _SPACE, "")) / n, F.lit(30.0)).alias("word_length"),
            F.log1p(F.size("words").cast("double")).alias("size"),
            # words equal to the one before: neighbours are compared as two arrays, without a lookup for each word
            (F.when(F.size("words") < 2, 0).otherwise(F.size(F.filter(F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(1))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1))), lambda a, b: a == b), lambda x: x))) / n).alias("stutter"),
            variety(F.col("words")).alias("variety"),
        ),
    ).drop("words")


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str, sample: int, id_col: str, text_col: str):
    """Logistic regression on at most ``sample`` labelled texts of each class; None unless both classes are there.

    Returns weights for the raw features, so scoring is an expression. Classes count alike and the intercept is then
    moved to the labels' own shares, so the probabilities are those of the labelled population. The texts stay on the
    executors: the driver gets sums over their figures.
    """
    rows = sample_rows(docs, labels, label, sample, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    table = written(features(rows).select(F.col("y").cast("double").alias("y"), "f.*"), "sample")
    n, good = table.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < good < n:
        return None
    share = labels.where(F.col(f"`{label}`").isin(0, 1)).agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
    table = VectorAssembler(inputCols=list(_FEATURES), outputCol="x").transform(table.withColumn("w", F.when(F.col("y") == 1, 0.5 / good).otherwise(0.5 / (n - good))))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=60, regParam=1e-3).fit(table)
    return [float(v) for v in model.coefficients], float(model.intercept) + math.log(share / (1 - share))


def prior_strength(groups: DataFrame, mean, n: str = "n", good: str = "good"):
    """A column over all groups: the strength (as labels) of the beta prior that the spread of the groups' shares shows.

    Method of moments: the weighted spread of shares about ``mean`` less what binomial noise alone gives, as a part of
    m (1 - m), is 1 / (strength + 1). Held between 1 and 1e6; 1e6 where there is no spread beyond the noise.
    """
    count, share = F.col(n), F.col(good) / F.col(n)
    s = F.sum(count * F.pow(share - mean, 2))
    noise = F.sum(mean * (1 - mean)) - F.sum(count * mean * (1 - mean)) / F.sum(count)
    room = (F.sum(count) - F.sum(count * count) / F.sum(count)) * F.sum(count * mean * (1 - mean)) / F.sum(count)
    part = F.try_divide(s - noise, room)
    return F.greatest(F.least(F.try_divide(F.lit(1.0), F.greatest(part, F.lit(0.0))) - 1, F.lit(1e6)), F.lit(1.0))


def posteriors(labelled: DataFrame) -> DataFrame:
    """One row for each labelled (site, path) of labelled(site, path, y): site_mean, path_mean and the global mean m.

    Labels are counted by site and path. A site's share of good labels is drawn to that of all labels with the strength
    of a beta prior fitted to the sites, and a path's share to its site's posterior with the strength fitted to the paths,
    so sparse sites and paths stay near their priors and well-counted ones near their own shares.
    """
    paths = labelled.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("good").alias("site_good"))
    every = sites.agg(((F.sum("site_good") + 0.5) / (F.sum("site_n") + 1)).alias("m"))  # within 0 and 1
    of_sites = sites.crossJoin(F.broadcast(every))  # one row
    strength = of_sites.agg(F.coalesce(prior_strength(of_sites, F.col("m"), "site_n", "site_good"), F.lit(1e6)).alias("site_strength"))
    sites = of_sites.crossJoin(F.broadcast(strength)).withColumn("site_mean", (F.col("site_good") + F.col("site_strength") * F.col("m")) / (F.col("site_n") + F.col("site_strength")))
    of_paths = paths.join(sites.select("site", "site_mean", "m"), "site")
    strength = of_paths.agg(F.coalesce(prior_strength(of_paths, F.col("site_mean")), F.lit(1e6)).alias("path_strength"))
    return of_paths.crossJoin(F.broadcast(strength)).withColumn("path_mean", (F.col("good") + F.col("path_strength") * F.col("site_mean")) / (F.col("n") + F.col("path_strength"))).select("site", "path", "site_mean", "path_mean", "m")


def classify_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", site_col: str = "source", path_col: str = "lang", sample: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability that a document is good, from its own text, its site and its path on the site.

    A document's evidence is a classifier's probability (fitted on at most ``sample`` labelled texts of each class), whose
    log odds are those of the labels' share m plus what the text adds. Labels counted by site and path give a posterior
    share for each (``posteriors``), and the log odds of the path's posterior take the place of those of m, once. A path
    without labels has its site's posterior, a site without labels has m.

    Returns doc_id, site, path, evidence, site_mean, path_mean, score and keep (score >= threshold) for each row, null
    and repeated ids included; of a doc_id's labels each counts, with each of its rows. Null texts count as empty; null
    sites and paths form their own groups; equal texts of one path have equal scores; other columns are not read. Without
    labels of both classes the evidence is the labels' share (1/2 without any). An empty table gives an empty result. Sums
    are built before the exchange, so a site with a third of all rows is a row for each task.
    """
    fitted = fit_classifier(docs, labels, label, sample, id_col, text_col)
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), name(site_col).alias("site"), name(path_col).alias("path"))
    if fitted is None:
        share = labels.agg(F.avg(F.col(f"`{label}`").cast("double"))).first()[0]
        scored = own.withColumn("p", F.lit(0.5 if share is None else float(share)))
    else:
        weights, intercept = fitted
        z = F.lit(intercept)
        for feature, w in zip(_FEATURES, weights, strict=True):
            z = z + F.lit(w) * F.col(f"f.{feature}")
        scored = features(own).withColumn("p", 1 / (1 + F.exp(-z)))
    y = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
    known = posteriors(own.select("doc_id", "site", "path").join(y, "doc_id"))
    known = written(known, "posteriors")
    sites = known.select("site", F.col("site_mean").alias("of_site")).distinct()
    share = known.agg(F.first("m")).first()[0]
    m = F.lit(0.5 if share is None else float(share))
    out = scored.select("doc_id", "site", "path", "p").join(known.select("site", "path", "path_mean"), ["site", "path"], "left").join(sites, "site", "left")
    out = out.withColumn("site_mean", F.coalesce("of_site", m)).withColumn("path_mean", F.coalesce("path_mean", "site_mean"))
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("path_mean")) - _logit(m))))
    own_name = lambda c: F.nullif(F.col(c), F.lit("\0")).alias(c)
    return out.select("doc_id", own_name("site"), own_name("path"), F.col("p").alias("evidence"), "site_mean", "path_mean", score.alias("score"), (score >= threshold).alias("keep"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_quality(docs, labels)
