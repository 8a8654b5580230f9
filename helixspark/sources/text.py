"""Readers and writers of the text formats that clusters, strands and run logs come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixspark.functions.sequence import dense_index

SEPARATOR = "=" * 31


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(value, file, block) of text files: block is where the part of the file that a task reads begins."""
    options = {"lineSep": line_sep} if line_sep else {}
    return spark.read.options(**options).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of ``read_lines`` with line_no, from 0 in the order of files and lines, without gathering them.

    Lines are numbered within their file block, and blocks by the lines before them.
    """
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("file", "block").orderBy("id")
    return lines.withColumn("k", F.row_number().over(own) - 1).join(blocks, ["file", "block"]).select((F.col("base") + F.col("k")).alias("line_no"), "value", "file")


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(line_no, value, file) of text files, as of ``numbered``."""
    return numbered(read_lines(spark, path, line_sep))


def running_count(lines: DataFrame, flag: Column, out: str) -> DataFrame:
    """lines(line_no, ...) with how many lines up to each one have the flag, counted in blocks of 65,536 lines."""
    block = lines.withColumns({"_f": flag.cast("int"), "_b": F.floor(F.col("line_no") / 65536)})
    sums = block.groupBy("_b").agg(F.sum("_f").alias("_n"))
    sums = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_b").orderBy("line_no")
    return block.withColumn("_k", F.sum("_f").over(own)).join(sums, "_b").withColumn(out, F.col("_k") + F.col("_base")).drop("_f", "_b", "_k", "_base")


def write_clusters(reads: DataFrame, path: str, separator: str = SEPARATOR) -> None:
    """Clusters in order, each after a separator line; reads(cluster_id, read_idx, read)."""
    blocks = reads.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("read_idx", "read"))).alias("r"))
    blocks.orderBy("cluster_id").select(F.concat(F.lit(f"{separator}\n"), F.array_join("r.read", "\n")).alias("value")).write.text(path)


def cluster_blocks(lines: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(cluster_id, value, file, place, tokens): the texts between separators, from lines that were cut there.

    Clusters are numbered from 1 in the order of files and places, empty ones too; place counts within the file. What
    stands before a file's first separator is a cluster only if it holds something. A separator that ends a file opens
    none.
    """
    end = F.lit(rf"\Q{separator}\E\s*\z")
    blocks = numbered(lines).withColumn("value", F.regexp_replace("value", end, F.lit("")))
    blocks = blocks.withColumn("tokens", F.filter(F.split("value", r"\s+"), lambda x: x != ""))
    none = F.size("tokens") == 0
    # of each file the first text may be nothing; the numbers of all later ones fall by that
    files = blocks.groupBy("file").agg(F.min(F.struct("line_no", none.cast("int").alias("none"))).alias("first"))
    files = files.select("file", F.col("first.line_no").alias("_first"), F.col("first.none").alias("_none"), F.sum("first.none").over(Window.orderBy("first.line_no")).alias("_gone"))
    kept = blocks.join(files, "file").where((F.col("line_no") > F.col("_first")) | (F.col("_none") == 0))
    return kept.select((F.col("line_no") + 1 - F.col("_gone")).cast("long").alias("cluster_id"), "value", "file", (F.col("line_no") + 1 - F.col("_first") - F.col("_none")).cast("long").alias("place"), "tokens")


def _checked(out: DataFrame, validate: bool, upper: bool) -> DataFrame:
    """Reads in upper case, or checked for their letters, if asked for."""
    if upper:
        out = out.withColumn("read", F.upper("read"))
    if validate:
        bad = F.col("read").rlike("[^ACGTNacgtn]")
        out = out.withColumn("read", F.when(bad, F.raise_error(F.concat(F.lit("not a read: "), F.col("read")))).otherwise(F.col("read")))
    return out


def scan_clusters(spark: SparkSession, path: str, separator: str = SEPARATOR, keep_empty: bool = False, validate: bool = False, upper: bool = False) -> DataFrame:
    """(cluster_id, read_idx, read): clusters are what stands between separator lines, numbered from 1 by position.

    Lines may hold several reads. Empty clusters are dropped before numbering, or with ``keep_empty`` counted (they have
    no reads). ``validate`` fails on letters other than A, C, G, T and N.
    """
    blocks = cluster_blocks(read_lines(spark, path, f"{separator}\n"), separator).select("cluster_id", "tokens")
    if not keep_empty:
        blocks = dense_index(blocks.where(F.size("tokens") > 0), "cluster_id", "_n").drop("cluster_id").withColumnRenamed("_n", "cluster_id")
    return _checked(blocks.select("cluster_id", F.posexplode("tokens").alias("read_idx", "read")), validate, upper)


#: What makes a line a boundary between clusters.
BOUNDARIES = {
    "equals": lambda line, sep: line == sep,
    "startswith": lambda line, sep: line.startswith(sep),
    "contains": lambda line, sep: line.contains(sep),
    "any": lambda line, sep: line.contains(sep) | line.rlike("^={3,}$") | line.startswith("CLUSTER "),
}


def scan_cluster_lines(spark: SparkSession, path: str, boundary: str = "any", separator: str = SEPARATOR, keep_empty: bool = False, validate: bool = False, upper: bool = False) -> DataFrame:
    """As ``scan_clusters``, for files whose boundaries are lines of other forms (``BOUNDARIES``), read by lines.

    A file begins a cluster of its own. With ``keep_empty`` each boundary begins a cluster, else only those with reads.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", "[\\s\ufeff]", " ")))
    cut = BOUNDARIES[boundary](F.col("value"), F.lit(separator))
    lines = running_count(lines.where("value <> ''"), cut, "_c").withColumn("tokens", F.when(cut, F.array().cast("array<string>")).otherwise(F.split("value", " +")))
    first = lines.groupBy("file").agg(F.min("line_no").alias("_first"))
    opens = lines.join(first, "file").withColumn("_open", (F.col("line_no") == F.col("_first")) & ~cut)
    # a file that does not begin with a boundary begins a cluster without one
    rows = running_count(opens, F.col("_open"), "_o").withColumn("_c", F.col("_c") + F.col("_o"))
    words = rows.where(F.size("tokens") > 0).select("_c", "line_no", F.posexplode("tokens").alias("_p", "read"))
    ids = words.select("_c").distinct()
    ids = ids.withColumn("cluster_id", F.col("_c").cast("long")) if keep_empty else dense_index(ids, "_c", "cluster_id")
    read_idx = (F.row_number().over(Window.partitionBy("_c").orderBy("line_no", "_p")) - 1).alias("read_idx")
    return _checked(words.join(ids, "_c").select("cluster_id", read_idx, "read"), validate, upper)


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, name, seq): records of header lines, numbered from 1 by the order of files and lines, their other lines
    joined; gaps (``-``) of aligned records stay. Lines before a file's first header are left out.

    Files are read by lines and not as a whole: headers are counted in blocks of lines, so a record may span tasks.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r", "")).withColumn("head", F.col("value").startswith(">").cast("int"))
    of = running_count(lines, F.col("head") == 1, "seq_id").where("seq_id > 0")
    first = F.max(F.when(F.col("head") == 1, F.struct(F.substring("value", 2, 1 << 30).alias("name"), "file"))).alias("first")
    parts = of.groupBy("seq_id").agg(first, F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("line_no", "value", "file")))).alias("lines"))
    own = F.filter("lines", lambda x: x["file"] == F.col("first.file"))
    return parts.select("seq_id", "first.name", F.array_join(F.transform(own, lambda x: x["value"]), "").alias("seq"))


def scan_split_file(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, read_idx, read, center) of lines ``read|read|...:center``."""
    lines = numbered_lines(spark, path)
    cut = lines.select("line_no", F.regexp_extract("value", "^(.*):", 1).alias("left"), F.regexp_extract("value", ":([^:]*)$", 1).alias("center"))
    return cut.select("line_no", "center", F.posexplode(F.split("left", r"\|")).alias("read_idx", "read"))


#: Keys of a run log, with the pattern of their value.
LOG_FIELDS = {"clusters": (r"(?m)^clusters: (\d+)", "long"), "elapsed": (r"(?m)^elapsed: ([0-9.]+)", "double"), "policy": (r"(?m)^policy: (\S+)", "string"), "decoded": (r"(?m)^decoded: (\d+)/", "long"), "planned": (r"(?m)^decoded: \d+/(\d+)", "long")}


def parse_run_log(text) -> dict:
    """Typed columns of a run log; what is missing is null, an unknown policy ``unknown``."""
    out = {k: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast(kind) for k, (p, kind) in LOG_FIELDS.items()}
    return out | {"policy": F.coalesce(out["policy"], F.lit("unknown"))}


def run_log(**fields: Column) -> Column:
    """A run's log as one text column: a ``key: value`` line for each field that is not null, as ``parse_run_log`` reads it.

    ``decoded`` and ``planned`` share a line.
    """
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items() if k not in ("decoded", "planned")]
    if "decoded" in fields:
        lines.append(F.concat(F.lit("decoded: "), fields["decoded"].cast("string"), F.lit("/"), fields["planned"].cast("string")))
    return F.concat_ws("\n", *lines)


def scan_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, center, read_idx, read) of cases of a center line, a line of stars, and reads; two blank lines end a case."""
    cases = numbered_lines(spark, path, "\n\n\n").where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return cases.select((F.col("line_no") + 1).alias("case_id"), F.get(lines, F.lit(0)).alias("center"), F.posexplode(F.slice(lines, 3, F.size(lines))).alias("read_idx", "read"))


def scan_toolkit(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, read_idx, read, quality) of files with a number of clusters, then for each its number of reads and ``read,quality`` lines.

    Lines without a comma begin clusters, so the numbers need not be followed one after the other.
    """
    lines = numbered_lines(spark, path).where("line_no > 0 and trim(value) <> ''").withColumn("head", (~F.col("value").contains(",")).cast("int"))
    reads = running_count(lines, F.col("head") == 1, "cluster_id").where("head = 0")
    parts = F.split("value", ",", 2)
    order = Window.partitionBy("cluster_id").orderBy("line_no")
    return reads.select("cluster_id", (F.row_number().over(order) - 1).alias("read_idx"), parts[0].alias("read"), F.trim(parts[1]).alias("quality"))


def scan_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with a header and a given schema; a mark before the first name is dropped, and required columns must be there."""
    names = [x.split()[0] for x in schema.split(",")]
    header = spark.read.text(path).limit(1).first()
    there = [x.strip().lstrip("﻿").strip('"') for x in header.value.split(",")] if header else []
    if missing := [c for c in required or names if c not in there]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    kinds = {x.split()[0]: x.split(None, 1)[1] for x in (y.strip() for y in schema.split(","))}
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in there)).select(*names)


def scan_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON documents of any folder below path, with a given schema: one a file, or one a line."""
    return spark.read.json(path, schema=schema, multiLine=multi_line, recursiveFileLookup=True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_sequences(strands: DataFrame, path: str, key: str = "cluster_id", seq: str = "sequence") -> None:
    """One strand a line, in the order of clusters (part files in the order of their names)."""
    strands.orderBy(key).select(F.col(seq).alias("value")).write.text(path)


def write_diagnostics(rows: DataFrame, path: str) -> None:
    rows.orderBy("cluster_id").write.csv(path, header=True)


def markdown(rows: DataFrame, *columns: str) -> DataFrame:
    """Lines of a Markdown table's body."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("line"))
