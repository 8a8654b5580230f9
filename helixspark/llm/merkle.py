"""A Merkle manifest of a dataset: trees over each source's rows and over the sources, of which only every few levels
are stored; proofs regenerate the levels between from the stored ones below them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.llm.runtime import spread, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
EVERY = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value as text."""
    field = lambda v: F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*(field(v.cast("string")) for v in values)), 256)


def _row_digest(docs: DataFrame, changed: dict[str, Column] | None = None) -> Column:
    return leaf_digest(*((changed or {}).get(c, F.col(f"`{c}`")) for c in FIELDS))


def _numbered(nodes: DataFrame, order: list[Column], n: int) -> DataFrame:
    """nodes(grp, ...) with pos, numbered from 0 within each grp, and size, the rows of that grp; no grp is gathered.

    Rows are sorted in ranges and written; a row's place in its range comes with it, and ranges are added up by grp.
    Rows that are equal in the order are told apart by where they stand in the input, so they too fill several ranges.
    """
    spark = nodes.sparkSession
    keys = [F.col("grp"), *order, F.col("_in")]
    ranged = nodes.withColumn("_in", F.monotonically_increasing_id()).repartitionByRange(spread(spark, 200 * n), *keys).sortWithinPartitions(*keys)
    placed = written(ranged.drop("_in").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "placed")
    parts = placed.groupBy("grp", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("grp", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("grp")).alias("size"))
    return placed.join(parts, ["grp", "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")


def _height(size: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree: powers of the fan-out below its number of leaves."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 63]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < size))


def _runs(digests: Column, fanout: int) -> Column:
    """The level above a level of one subtree."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / fanout).cast("int")), lambda i: F.sha2(F.array_join(F.slice(digests, i * fanout + 1, F.lit(fanout)), ""), 256))


@dataclass
class Tree:
    """Trees by grp. levels[j]: the stored nodes (grp, pos, digest, height[, item]) of level j * every of all trees that
    reach so high, and the apex of a tree whose height is below that and above (j - 1) * every."""

    levels: list[DataFrame]
    fanout: int
    every: int

    def apexes(self) -> DataFrame:
        """(grp, digest) of the tops."""
        tops = [t.where(F.col("height") <= j * self.every).select("grp", "digest") for j, t in enumerate(self.levels)]
        out = tops[0]
        for t in tops[1:]:
            out = out.unionByName(t)
        return out

    def blocks(self, j: int) -> DataFrame:
        """Aligned subtrees between the stored levels j and j + 1: (grp, block, height, nodes, d0, d1, ...); nodes are
        the stored ones, d0 their digests, and d1 and on the levels made from those, as far as the tree goes."""
        own = self.levels[j].where(F.col("height") > j * self.every)
        fields = [c for c in own.columns if c in ("pos", "digest", "item")]
        out = own.groupBy("grp", "height", F.expr(f"pos div {self.fanout**self.every}").alias("block")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nodes")).withColumn("d0", F.col("nodes.digest"))
        for k in range(self.every):
            out = out.withColumn(f"d{k + 1}", F.when(F.col("height") > j * self.every + k, _runs(F.col(f"d{k}"), self.fanout)).otherwise(F.col(f"d{k}")))
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, digest, item, path, apex columns) of all leaves. path: for each level from the leaf on, the joined
        digests of the siblings left and right of it. above(grp, path, ...) is what follows a tree's apex; its other
        columns come along.

        From the top down, each stored level takes its subtrees, regenerates what lies between for one subtree of at
        most fanout ** every stored nodes at a time, and goes on with the path of the subtree's own top.
        """
        more = [c for c in above.columns if c not in ("grp", "path")]
        up = None
        for j in range(len(self.levels) - 1, -1, -1):
            level, item = self.levels[j], ["item"] if j == 0 else []
            found = level.where(F.col("height") <= j * self.every).join(above, "grp").select("grp", "pos", "digest", *item, "path", *more)
            if up is not None:
                top = up.select("grp", F.col("pos").alias("block"), "path", *more)
                each = self.blocks(j).join(top, ["grp", "block"]).select("*", F.posexplode("nodes").alias("i", "node"))
                steps = []
                for k in range(self.every):
                    at = F.expr(f"i div {self.fanout**k}")  # the ancestor's place on level k
                    first = at - at % self.fanout
                    sides = F.struct(F.array_join(F.slice(f"d{k}", first + 1, at - first), "").alias("left"), F.array_join(F.slice(f"d{k}", at + 2, F.lit(self.fanout - 1) - (at - first)), "").alias("right"))
                    steps.append(F.when(F.col("height") > j * self.every + k, sides))
                path = F.concat(F.filter(F.array(*steps), lambda s: s.isNotNull()), F.col("path"))
                found = found.unionByName(each.select("grp", "node.pos", "node.digest", *(F.col(f"node.{c}") for c in item), path.alias("path"), *more))
            up = found
        return up.drop("pos")


def build(leaves: DataFrame, n: int, order: list[Column], fanout: int = FANOUT, every: int = EVERY) -> Tree:
    """Trees over leaves(grp, digest, item), ascending by order within each grp (then by digest): while several nodes
    remain, each run of ``fanout`` neighbours becomes the digest of their joined digests.

    Level 0 and every ``every``-th level above are written to the shared folder, each made from the one before by
    grouping aligned subtrees of at most fanout ** every nodes, so a large grp is worked on by many tasks.
    """
    level = _numbered(leaves, [*order, F.col("digest")], n).withColumn("height", _height(F.col("size"), fanout)).select("grp", "pos", "digest", "height", "item")
    tree = Tree([written(level, "level")], fanout, every)
    top = tree.levels[0].agg(F.max("height")).first()[0] or 0
    while (len(tree.levels) - 1) * every < top:
        made = tree.blocks(len(tree.levels) - 1)
        tree.levels.append(written(made.select("grp", F.col("block").alias("pos"), F.col(f"d{every}")[0].alias("digest"), "height"), "level"))
    return tree


@dataclass
class Manifest:
    """rows: the trees by source, whose items are (doc_id, other): the id and the digest that the changed row would have.
    sources: the tree over their tops, whose items are the sources' groups. root: its top, None for an empty table."""

    rows: Tree
    sources: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """(doc_id, source_group, leaf, other, path, subroot, root) of all rows; folding path over leaf gives root."""
        none = F.array().cast("array<struct<left:string,right:string>>")
        spark = self.rows.levels[0].sparkSession
        over = self.sources.paths(spark.range(1).select(F.lit("").alias("grp"), none.alias("path")))
        above = over.select(F.col("item").alias("grp"), "path", F.col("digest").alias("subroot"))
        out = self.rows.paths(above)
        return out.select("item.doc_id", F.col("grp").alias("source_group"), F.col("digest").alias("leaf"), "item.other", "path", "subroot", F.lit(self.root).alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fanout: int = FANOUT, every: int = EVERY) -> Manifest:
    """The trees over docs(doc_id, source, lang, n_chars, text), one for each source over its rows ascending by doc_id,
    and one over the sources' tops, ascending bytewise.

    A null source is a source of its own, before all others; a null doc_id comes before all others of its source; rows
    of one doc_id ascend by their digests. A source of one row has that row's digest as its top. An empty table has no
    root and no proofs. Other columns are not read. ``changed`` gives some fields another value; the digest of the row
    so changed is kept beside its own, for checks that a proof does not hold for it.
    """
    own = _row_digest(docs)
    other = _row_digest(docs, changed) if changed else own
    grp = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = docs.select(grp.alias("grp"), own.alias("digest"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), other.alias("other")).alias("item"))
    leaves = written(leaves, "leaves")  # narrow: the texts are read once
    rows = build(leaves, leaves.count(), [F.col("item.doc_id")], fanout, every)
    tops = written(rows.apexes(), "tops")
    over = build(tops.select(F.lit("").alias("grp"), "digest", F.col("grp").alias("item")), tops.count(), [F.col("item")], fanout, every)
    root = over.apexes().first()
    return Manifest(rows, over, root.digest if root else None)


def tampered(docs: DataFrame) -> dict[str, Column]:
    """Lower case for A to Z in the texts of rows whose doc_id, in decimal, has a CRC-32 that 5 divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return {"text": F.when(hit, F.translate(F.col("text").cast("string"), _UPPER, _LOWER)).otherwise(F.col("text"))}


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = manifest(docs, tampered(docs)).proofs().withColumn("folded_root", folded(F.col("other"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The CRC-32 of short ASCII texts, for DuckDB: crc(k) over a table that is made from the polynomial.
CRC32_SQL = """crct AS MATERIALIZED (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) v FROM range(256) r(i)))"""


def crc32_sql(key: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({key}, ''), lambda ch: CAST(ascii(ch) AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT)"


_LEAF_SQL = " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS)


def _tree_sql(name: str, leaves: str, depth: int = 5) -> str:
    """{name}0 ... {name}{depth}: the levels (grp, i, h) of trees over leaves(grp, i, h), up to 16 ** depth of them; a tree
    that has ended goes on as its top. {name}p: for each leaf its siblings (left, right) by level."""
    out = [f"{name}0 AS MATERIALIZED (SELECT grp, i, h, count(*) OVER (PARTITION BY grp) n FROM {leaves})"]
    for k in range(depth):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT grp, i // 16 i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END h, (any_value(n) + 15) // 16 n FROM {name}{k} GROUP BY grp, i // 16)")
        w = "PARTITION BY grp, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT grp, i, n > 1 up, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') l, coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') r FROM {name}{k})")
    joins = " ".join(f"JOIN {name}s{k} s{k} ON s{k}.grp = z.grp AND s{k}.i = z.i // {16**k}" for k in range(depth))
    steps = ", ".join(f"CASE WHEN s{k}.up THEN {{'l': s{k}.l, 'r': s{k}.r}} END" for k in range(depth))
    out.append(f"{name}p AS MATERIALIZED (SELECT z.grp, z.i, list_filter([{steps}], lambda x: x IS NOT NULL) path FROM {name}0 z {joins})")
    return ",\n".join(out)


_FOLD_SQL = "list_reduce(list_prepend({{'l': '', 'r': {leaf}}}, path), lambda a, p: {{'l': '', 'r': sha256(p.l || a.r || p.r)}}).r"

OP13_SQL = f"""
WITH {CRC32_SQL},
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') grp, sha256({_LEAF_SQL.format(**{c: c for c in FIELDS})}) h,
  sha256({_LEAF_SQL.format(**{c: c for c in FIELDS} | {"text": f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"})}) other FROM documents, crct),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 i FROM d),
{_tree_sql("a", "leaves")},
tops AS MATERIALIZED (SELECT '' grp, grp item, h, row_number() OVER (ORDER BY grp) - 1 i FROM a5),
{_tree_sql("b", "tops")},
f AS MATERIALIZED (SELECT doc_id, leaves.h leaf, tops.h subroot, b5.h root, other, list_concat(ap.path, bp.path) path
  FROM leaves JOIN ap USING (grp, i) JOIN tops ON tops.item = leaves.grp JOIN bp ON bp.i = tops.i, b5)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) proof_sha256, {_FOLD_SQL.format(leaf="other")} folded_root,
  {_FOLD_SQL.format(leaf="other")} = root verified FROM f
"""
