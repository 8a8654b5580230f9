"""Quality rules as a short-circuit cascade, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from helixspark.llm.runtime import discard, others, written

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Words in 8-word windows that the text holds twice or more: windows are hashed, sorted with their places, and the
#: places of equal neighbours are merged. Texts without equal windows stop after the distinct count.
_REPEATED = """
transform(array(transform(words, x -> xxhash64(x))), w -> CASE WHEN size(w) < 8 THEN 0 ELSE
  transform(array(transform(sequence(1, size(w) - 7), j -> xxhash64(slice(w, j, 8)))), g -> CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE
    transform(array(array_sort(transform(g, (h, j) -> named_struct('h', h, 'j', j)))), s ->
      aggregate(array_sort(transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h OR get(s, i + 1).h <=> x.h), x -> x.j)),
        named_struct('last', -8, 'n', 0), (acc, j) -> named_struct('last', j, 'n', acc.n + least(8, j - acc.last)), acc -> acc.n))[0]
  END)[0] END)[0]
"""


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base measures in a struct ``q`` (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    inner = docs.withColumns({"words": F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), "lines": F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))})
    return inner.withColumn(
        "q",
        F.struct(
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
        ),
    ).drop("words", "lines")


def base_rule() -> F.Column:
    return (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))


def default_rules(text_col: str = "text") -> dict[str, F.Column]:
    """Rules by name; each is true where it rejects."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return {
        "symbols": 10 * F.col("q.n_symbols") > 3 * F.col("q.n_words"),
        "repeated_lines": (F.col("q.n_lines") >= 4) & (10 * F.col("q.n_dup_lines") > 5 * F.col("q.n_lines")),
        "word_length": (F.col("q.word_chars") > 20 * F.col("q.n_words")) | (F.col("q.word_chars") < 2 * F.col("q.n_words")),
        "shouting": 2 * F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
        "exclamations": 10 * (F.length(text) - F.length(F.translate(text, "!", ""))) > 3 * F.col("q.n_words"),
    }


def draw(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows, drawn by a hash of the row's plain columns: a share is taken from all partitions, and cut
    by the hash. Only the share, about 4 x ``sample`` rows, is sorted.
    """
    h = F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if isinstance(f.dataType, AtomicType)), F.lit(1))
    every = max(1, rows.count() // (4 * sample))
    return rows.where(F.pmod(h, F.lit(every)) == 0).orderBy(F.xxhash64(F.lit(2), h)).limit(sample)


def rule_costs(rows: DataFrame, rules: dict[str, F.Column], repeat: int = 5) -> list[dict]:
    """For each rule: its name, nanoseconds and rejections over the rows, and rejections per nanosecond; best first.

    One pass: each row applies all rules in turn and notes the clock between them, ``repeat`` times, of which the first
    warms up and is not counted. What an empty rule takes is taken off; a tenth of it is the least cost that can be told.
    """
    clock = lambda: F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    timed = {"": F.lit(False), **rules}
    steps = [clock().alias("t0")]
    for i, rule in enumerate(timed.values(), 1):
        steps += [F.coalesce(rule & (F.col("again") > 0), F.lit(False)).alias(f"r{i}"), clock().alias(f"t{i}")]
    table = written(rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).select("again", F.struct(*steps).alias("s")), "costs")
    sums = [F.sum(F.col(f"s.t{i}") - F.col(f"s.t{i - 1}")).alias(f"c{i}") for i in range(1, len(timed) + 1)]
    sums += [F.count_if(F.col(f"s.r{i}")).alias(f"n{i}") for i in range(1, len(timed) + 1)]
    row = table.where("again > 1").agg(*sums).first()
    discard(table)
    floor = row["c1"] or 0
    out = []
    for i, name in enumerate(timed, 1):
        if name:
            cost = max((row[f"c{i}"] or 0) - floor, floor // 10, 1)
            out.append({"rule": name, "cost": cost, "rejected": row[f"n{i}"] // (repeat - 1), "rank": row[f"n{i}"] / cost})
    return sorted(out, key=lambda x: (-x["rank"], x["cost"], x["rule"]))


def cascade(docs: DataFrame, rules: dict[str, F.Column] | None = None, text_col: str = "text", sample: int = 1000) -> DataFrame:
    """Measure whole texts and apply the rules, likeliest and cheapest first, stopping at the first that rejects.

    The base measures are results of their own, so they are there for every row; a row that fails the base rule meets no
    other rule, and the order of the others comes from their measured cost and rejections on a sample of what passes it.

    Returns the columns of docs and a struct ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept; it replaces a column of that name. Words are runs of anything but ASCII white space. A null text is
    an empty one, which the base rule rejects; each row gets its own result, whatever its id; an empty table gives an
    empty result; a column of docs named ``q``, ``words`` or ``lines`` is kept. Rules of equal rank go by cost and name.
    """
    rules = rules or default_rules("__text")
    # the caller's columns wait in one struct, so that names cannot clash
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in others(docs, "quality")), F.lit(0).alias("__none")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    base = F.coalesce(base_rule(), F.lit(True))
    part = written(measures(draw(docs, sample).select(F.col(f"`{text_col}`").cast("string").alias("__text")), "__text").where(~base), "sample")
    order = [x["rule"] for x in rule_costs(part, rules)]
    discard(part)
    measured = measures(own, "__text")
    rejected = F.lit(False)
    for name in reversed(order):
        rejected = F.when(rules[name], F.lit(True)).otherwise(rejected)
    quality = F.struct(*(F.col(f"q.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base.alias("base_failed"), F.when(base, F.lit(False)).otherwise(~rejected).alias("kept"))
    return measured.select(*(F.col(f"row.`{c}`") for c in others(docs, "quality")), quality.alias("quality"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return cascade(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "quality.*")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
l AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT line) n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) i) WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) n_repeat_words FROM r, (SELECT unnest(range(0, 8)) j) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
      CAST(coalesce(n_dup_lines, 0) AS BIGINT) n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) n_repeat_words, coalesce(n_lines, 0) n_lines
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines) OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))
    OR 10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words) kept
FROM b
"""
