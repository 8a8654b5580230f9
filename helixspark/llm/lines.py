"""Line deduplication by winnowing over line hashes, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixspark.llm.runtime import id_text, others, written

#: A line with a word: anything but ASCII white space.
_FILLED = r"[^\\x20\\x09-\\x0D]"
_LINES = f"filter(transform(split(text, '\\n', -1), (x, i) -> named_struct('pos', i, 'line', x)), x -> x.line rlike '{_FILLED}')"


def _let(value: str, name: str, body: str) -> str:
    """Bind a value once inside a SQL expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fingerprints(run: int, long_line: int | None) -> str:
    """The places (p, f, g, before, after, far) that winnowing selects in a text's lines with a word.

    A window is ``run`` neighbouring lines, and its least line hash f (the last of equal ones) is selected, once for all
    windows that select it. Each place has the hashes of up to run - 1 lines before and after it. Lines of ``long_line``
    words or more (far) are places of their own besides; g is a second hash for them.
    """
    words = "size(filter(split(x.line, '[\\\\x20\\\\x09-\\\\x0D]+'), y -> y <> ''))"
    far = "false" if long_line is None else f"length(x.line) >= {2 * long_line - 1} AND {words} >= {long_line}"
    hashes = f"transform({_LINES}, x -> named_struct('f', xxhash64(x.line), 'g', xxhash64(1, x.line), 'far', {far}))"
    keys = "transform(h, (x, i) -> named_struct('f', x.f, 'i', -i))"
    least = f"CASE WHEN size(h) < {run} THEN array() ELSE array_distinct(transform(sequence(0, size(h) - {run}), j -> -array_min(slice(k, j + 1, {run})).i)) END"
    alone = "filter(transform(h, (x, i) -> CASE WHEN x.far THEN i END), i -> i IS NOT NULL)"
    of = "transform(h, x -> x.f)"
    each = f"transform(array_union({_let(keys, 'k', least)}, {alone}), p -> named_struct('p', p, 'f', h[p].f, 'g', h[p].g, 'far', h[p].far, 'before', slice(hs, greatest(p - {run - 1}, 0) + 1, least(p, {run - 1})), 'after', slice(hs, p + 2, {run - 1})))"
    return _let(hashes, "h", _let(of, "hs", each))


def repeated_lines(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", long_line: int | None = 50) -> DataFrame:
    """(doc_id, t, gone): the lines, counted among lines with a word, that are in a repeat; t is the text's hash.

    Two equal runs of ``min_run`` lines have the same least hash at the same line of the run, so both are selected places
    of one fingerprint. Places of a fingerprint that another place has are joined on it and on what stands around them:
    a place extends l lines to the left and min_run - 1 - l to the right, for each l, where these neighbours equal those
    of an earlier place, and the run it then spans is a repeat. Longer repeats are chains of such runs, as neighbouring
    places are at most ``min_run`` lines apart. Of each extension the first place (smallest doc_id, then position) is what
    the others are joined with, and it is found by partial aggregation, so no pairs of places are built and a line in a
    third of all documents costs a row for each place.
    """
    rows = id_text(docs, id_col, text_col).where("doc_id is not null and text is not null")
    places = written(rows.select("doc_id", F.xxhash64("text").alias("t"), F.expr(f"inline({_fingerprints(min_run, long_line)})")), "lines")
    at = F.struct("doc_id", "t", "p")
    often = places.groupBy("f").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("f")
    reach = f"filter(transform(sequence(0, {min_run - 1}), l -> named_struct('l', l, 'k', CASE WHEN size(before) >= l AND size(after) >= {min_run - 1} - l THEN xxhash64(slice(before, size(before) - l + 1, l), slice(after, 1, {min_run - 1} - l)) END)), x -> x.k IS NOT NULL)"
    alone = "CASE WHEN far THEN array(named_struct('l', -1, 'k', g)) ELSE array() END"
    if min_run == 1:
        reach = "array(named_struct('l', 0, 'k', g))"
    spans = places.join(often, "f").select("f", "doc_id", "t", "p", F.expr(f"inline(concat({reach}, {alone}))"))
    first = spans.groupBy("f", "l", "k").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    later = spans.join(first, ["f", "l", "k"]).where(at > F.col("first"))
    run = F.expr(f"CASE WHEN l < 0 THEN array(p) ELSE sequence(p - l, p - l + {min_run - 1}) END")
    return later.groupBy("doc_id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(run)))).alias("gone"))


def dedup_lines(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", long_line: int | None = 50, stats_col: str = "line_stats") -> DataFrame:
    """Delete later repeats of runs of at least ``min_run`` lines, and of single lines of ``long_line`` words or more.

    A line with a word goes if it is in a run of ``min_run`` or more such lines (blank lines between them do not count)
    that also occurs earlier: in a document of a smaller doc_id, or further up in the same one. So does a line of
    ``long_line`` words (between ASCII white space) or more, whatever its neighbours; None leaves that out. Shorter single
    lines stay, as headings and salutations repeat in unrelated documents. Runs may overlap, and are judged on the input,
    so the first place of a run or long line stays. Blank lines stay: they hold no words, and windows skip them so that
    spacing does not hide a repeat.

    Returns the columns of docs with the text replaced, and ``stats_col``: struct(n_lines, n_removed, n_runs), where
    n_lines counts lines with a word; it replaces a column of that name. A null text stays null with no lines; empty
    texts stay empty; rows with a null doc_id are kept as they are. Rows of one doc_id and one text are one document and
    get equal results; rows of one doc_id with different texts are documents in the order of a hash of their texts. An
    empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}
    key, t, gone = (next(f"{x}_{i}" for i in range(99) if f"{x}_{i}" not in taken) for x in ("dedup_id", "dedup_text", "dedup_gone"))
    found = repeated_lines(docs, min_run, id_col, text_col, long_line).select(F.col("doc_id").alias(key), F.col("t").alias(t), F.col("gone").alias(gone))
    joined = docs.join(found, (F.col(f"`{id_col}`").cast("long") == F.col(key)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(t)), "left")
    lines = _LINES.replace("(text,", f"(`{text_col}`,")
    n_runs = "size(g) - size(array_intersect(g, transform(g, x -> x + 1)))"
    stats = f"CASE WHEN `{text_col}` IS NULL THEN named_struct('n_lines', 0L, 'n_removed', 0L, 'n_runs', 0L) ELSE {_let(f'coalesce({gone}, array())', 'g', f"named_struct('n_lines', cast(size({lines}) AS bigint), 'n_removed', cast(size(g) AS bigint), 'n_runs', cast({n_runs} AS bigint))")} END"
    drop = _let(lines, "nb", f"transform({gone}, r -> nb[r].pos)")
    rest = _let(f"split(`{text_col}`, '\\n', -1)", "l", f"array_join(transform(array_except(sequence(0, size(l) - 1), {drop}), x -> l[x]), '\\n')")
    text = f"CASE WHEN {gone} IS NULL THEN `{text_col}` ELSE {rest} END"
    return joined.select(*(F.expr(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in others(docs, stats_col)), F.expr(stats).alias(stats_col))


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Windows of two lines, the smallest that ``dedup_lines`` takes: the shortest run that goes has two lines, so two thirds
    of all lines are fingerprints and a match extends by one neighbour to each side."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "line_stats.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) pos FROM documents WHERE text IS NOT NULL)),
nb AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.i, a.line || chr(10) || b.line k FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 again FROM w),
far AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 again FROM nb WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
gone AS (SELECT DISTINCT doc_id, i + j i FROM r, (SELECT unnest([0, 1]) j) WHERE again UNION SELECT doc_id, i FROM far WHERE again),
runs AS (SELECT doc_id, count(*) n_removed, count(*) FILTER (WHERE p IS NULL OR p <> i - 1) n_runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) p FROM gone) GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) t FROM l LEFT JOIN nb ON l.doc_id = nb.doc_id AND l.pos = nb.pos LEFT JOIN gone g ON g.doc_id = nb.doc_id AND g.i = nb.i WHERE g.i IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) n_lines FROM nb GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n_lines, 0) AS BIGINT) n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) n_runs, sha256(coalesce(t, '')) kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
