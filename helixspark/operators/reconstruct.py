"""Reconstruction of strands: local guides, dataset context, routing, and structured decoding of what is difficult.

Reads are grouped by cluster once and stay an array; kernels run over these rows in Arrow batches. The stages between
kernels are aggregations over all guides, and the driver sees single rows of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixspark.functions.distance import _rows as rows_of
from helixspark.functions.sequence import boundary_signature, kmer_code, normalize_seq, safe_percent
from helixspark.operators import aligned, calibrate, kmers, routing
from helixspark.operators.kernels import align as A
from helixspark.operators.kernels import decode as D
from helixspark.operators.kernels import guide as G
from helixspark.sources.scratch import frozen

GUIDE = "cluster_id long, sequence string, num_reads int, used_reads int, seed_read_index int, seed_len int, passes int, aligned_reads int, rejected_reads int, final_len int, seed_to_final_edits int, weak_positions int, coherence_filtered int, coherence_threshold double, mean_norm_dist double, mean_chosen_conf double"


@dataclass(frozen=True)
class Params:
    """Settings of a run; switches take one piece away."""

    length: int = 110
    deep: int = 40
    local_weight: float | None = None
    cross_weight: float | None = None
    decode_all: bool = False
    disable_decode: bool = False
    disable_cross: bool = False
    disable_channel: bool = False
    high_reuse: float = 0.50
    low_phase: float = 3.0
    high_phase: float = 6.0
    cross_scale: float = 1.0
    least_fraction: float = 0.10
    most_fraction: float = 0.50
    separation: float = 2.0
    route_fraction: float | None = None


def clustered(reads: DataFrame) -> DataFrame:
    """(cluster_id, reads): one row a cluster, in the order of its reads, dealt evenly to tasks. Reads may be rows
    (cluster_id, r) of whole clusters, which stay where they are."""
    if "r" in reads.columns:
        return reads.select("cluster_id", F.col("r.read").alias("reads"))
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reads.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("read_idx", "read"))).alias("r")).select("cluster_id", F.col("r.read").alias("reads")).repartition(n, "cluster_id")


def per_cluster(df: DataFrame, kernel: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Apply a kernel to each row; it returns rows of the schema."""
    return per_part(df, lambda rows: [x for row in rows for x in kernel(row)], schema)


def per_part(df: DataFrame, kernel: Callable[[list[dict]], list[dict]], schema: str, size: int = 64) -> DataFrame:
    """Apply a kernel to up to ``size`` rows at a time; it returns rows of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                out = kernel(batch.slice(lo, size).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in zip(names, fields, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def local_guides(clusters: DataFrame, length: int, deep: int = 40) -> DataFrame:
    def kernel(rows):
        return [{"cluster_id": row["cluster_id"]} | guide for row, guide in zip(rows, G.local_guides([row["reads"] for row in rows], length, deep=deep), strict=True)]

    return per_part(clusters, kernel, GUIDE, 256)


def channel_counts(clusters: DataFrame, length: int, most: int = 24) -> DataFrame:
    """(cluster_id, reads, used, m, s, i, d) for clusters(cluster_id, reads, sequence): up to ``most`` reads at even distances
    are aligned to the guide, and those that lie close to it are counted."""
    own = F.filter(F.transform("reads", normalize_seq), lambda x: x != "")
    n = F.size("reads")
    even = F.when(n <= most, F.col("reads")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("reads", F.floor(i * n / most).cast("int"))))
    picked = clusters.where("sequence <> ''").withColumn("reads", own).select("cluster_id", even.alias("reads"), F.col("sequence").alias("center"))
    return aligned.channel_counts(alignments(picked, counts=True), length, most)


def alignments(pairs: DataFrame, counts: bool = False) -> DataFrame:
    """(cluster_id, read_idx, distance, ref_row, read_row) for clusters(cluster_id, reads, center), or with ``counts`` what
    ``aligned.read_channels`` finds in these rows. Reads of many clusters are aligned together."""
    kind = "cluster_id long, read_idx int, " + ("m long, s long, i long, d long" if counts else "distance int, ref_row string, read_row string")
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                reads, first = rows_of(part.column(1))
                owner, index = np.repeat(np.arange(part.num_rows), np.diff(first)), np.arange(first[-1])
                strings = pa.concat_arrays([reads.cast(pa.string()), part.column(2).cast(pa.string())])
                for some, d, x, y, letters in A.gapped(strings, len(reads) + owner, index):
                    found = list(A.channels(x, y, letters).T) if counts else [d.astype(np.int32), A.texts(x, letters), A.texts(y, letters)]
                    own = [part.column(0).cast(pa.int64()).take(pa.array(owner[some])), pa.array((index - first[owner])[some].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*own, *(v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)) for v in found)], names=names)

    # dealt after any join, which may go by the few files of its other side
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("cluster_id", "reads", "center").repartition(n, F.xxhash64("cluster_id")).mapInArrow(run, kind)


def markov(guides: DataFrame, k: int) -> D.Model:
    """The model's counts as arrays, for broadcast: 4 ** (k + 1) edges and twice 4 ** k nodes, whatever the number of guides.

    Counts travel packed: executors put those of 65,536 neighbouring codes into one row, 12 bytes each.
    """
    rows = kmers.markov_model(guides, k).select("kind", kmer_code(F.col("kmer")).alias("code"), "n").withColumn("block", F.shiftright("code", 16))
    record = np.dtype([("code", "<i8"), ("n", "<u4")])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(table.num_rows, record)
        out["code"], out["n"] = table.column("code").to_numpy(), np.minimum(table.column("n").to_numpy(), 0xFFFFFFFF)
        return pa.table([pa.array([key[0].as_py()]), pa.array([out.tobytes()], pa.binary())], names=["kind", "data"])

    packed = rows.groupBy("kind", "block").applyInArrow(pack, "kind string, data binary")
    counts = {kind: np.zeros(4**size, dtype) for kind, size, dtype in (("edge", k + 1, np.uint16), ("node", k, np.uint32), ("suffix", k, np.uint32))}
    for row in packed.toLocalIterator():
        own = np.frombuffer(bytes(row.data), record)
        counts[row.kind][own["code"]] = np.minimum(own["n"], np.iinfo(counts[row.kind].dtype).max)
    return D.Model(k, *(D.Table(c) for c in counts.values()))


def permuted(model: D.Model, seed: int) -> D.Model:
    """The model with each table's counts dealt anew to its k-mers."""
    return D.Model(model.k, *(t.dealt(3 * seed + i) for i, t in enumerate((model.edges, model.nodes, model.suffixes))))


def context(clusters: DataFrame, guides: DataFrame, p: Params) -> dict:
    """Everything that decoding takes from the dataset: channel, phase load, reuse, k, trust, weights."""
    n = guides.count()
    most = max(128, math.floor(4 * math.sqrt(n) + 0.5))
    numbered = guides.select("cluster_id", "sequence").withColumn("i", F.col("cluster_id") - 1)
    sample = routing.systematic_sample(numbered, "i", most)
    profile = calibrate.channel_profile(channel_counts(clusters.join(sample.select("cluster_id", "sequence"), "cluster_id"), p.length)).first()
    seqs = guides.select("cluster_id", F.col("sequence").alias("seq"))
    reuse = float(kmers.reuse_fraction(seqs).first().fraction)
    k = 11 if reuse >= p.high_reuse else 8
    trusted = calibrate.chosen_trust(calibrate.trust_gains(seqs, k)).first() if n >= 16 else None
    trust, accepted = (trusted.trust, trusted.accepted) if trusted else (0.0, False)
    phase = phase_load(profile["ins"], profile["del"], p.length)
    rates = {x: profile[x] for x in ("match", "sub", "ins", "del")}
    one = guides.sparkSession.range(1)
    own = one.select(*(v.alias(c) for c, v in weights(F.lit(reuse), F.lit(phase), F.lit(accepted), F.lit(trust), p).items())).first()
    return {"rates": rates, "phase": phase, "total_error": rates["sub"] + rates["ins"] + rates["del"], "reuse": reuse, "trust": trust, "accepted": accepted, "n": n} | own.asDict()


def phase_load(insertions, deletions, length: int):
    """Letters by which a strand is expected to lose its frame."""
    return length * (insertions + deletions)


def weights(reuse: Column, phase: Column, accepted: Column, trust: Column, p: Params) -> dict[str, Column]:
    """What decoding is set to, from four numbers of the data set.

    fallback: nothing is learned from other clusters, and all are decoded; k of the model; cross and local: weights of the
    other clusters and of a cluster's own reads; band and states of the trellis; most: reads that it looks at.
    """
    high, low = reuse >= p.high_reuse, phase < p.low_phase
    fallback = F.lit(p.cross_weight is None) & ~accepted & (reuse < 0.10) & ~low & (phase < p.high_phase)
    cross = F.lit(0.0 if p.disable_cross else p.cross_weight) if p.disable_cross or p.cross_weight is not None else F.when(high, 0.68).when(low, 0.0).otherwise(0.50) * trust * p.cross_scale
    local = F.lit(p.local_weight) if p.local_weight is not None else F.when(high, 0.0).when(low, 0.80).otherwise(0.40)
    return {"k": F.when(high, 11).otherwise(8), "cross": cross, "local": local, "band": F.when(high | ~low, 6).otherwise(3), "states": F.when(fallback, 4).otherwise(8), "fallback": fallback, "most": F.when(~high & ~low, 60).otherwise(36)}


def route(reads: DataFrame, guides: DataFrame, ctx: dict, p: Params) -> tuple[DataFrame, str]:
    """(cluster_id, joint_anomaly, joint_active) and the policy's name. Only what a policy needs is computed."""
    name = policy(ctx, p)
    if name not in SCORED:
        return decide(guides, ctx, p)
    found = kmers.anomaly_scores(guides.select("cluster_id", F.col("sequence").alias("seq")), reads, ctx["k"])
    scores = frozen(guides.select("cluster_id", "num_reads").join(found, "cluster_id", "left").select("cluster_id", "num_reads", F.coalesce("score", F.lit(0.0)).alias("score")), "scores")
    return decide(scores, ctx, p)


#: Policies that rank clusters by their anomaly.
SCORED = ("by-anomaly", "median-anomaly-or-coverage")


def policy(ctx: dict, p: Params) -> str:
    """How clusters are chosen for decoding, from what the context says of the data set."""
    high, phase = ctx["reuse"] >= p.high_reuse, ctx["phase"]
    if p.disable_decode:
        return "disabled"
    if p.decode_all:
        return "decode-all"
    if ctx["fallback"]:
        return "shallow-dense-fallback"
    if not high and phase >= p.high_phase:
        return "low-reuse-high-phase-dense"
    if not high and phase < p.low_phase:
        return "low-phase-weak-position"
    return "by-anomaly" if high or p.route_fraction is not None else "median-anomaly-or-coverage"


def decide(rows: DataFrame, ctx: dict, p: Params) -> tuple[DataFrame, str]:
    """(cluster_id, joint_anomaly, joint_active) of rows(cluster_id, and what the policy asks for: weak_positions, or
    score and num_reads), and the policy's full name."""
    name = policy(ctx, p)
    if name == "low-phase-weak-position":
        return rows.select("cluster_id", F.lit(0.0).alias("joint_anomaly"), (F.col("weak_positions") >= (2 if ctx["reuse"] >= 0.25 else 1)).alias("joint_active")), name
    if name not in SCORED:
        return rows.select("cluster_id", F.lit(0.0).alias("joint_anomaly"), F.lit(name != "disabled").alias("joint_active")), name
    if name == "by-anomaly":
        n = ctx["n"]
        count, name = math.ceil(p.least_fraction * n), f"sparse-{round(100 * p.least_fraction)}pct-fallback"
        if p.route_fraction is not None:
            count, name = math.ceil(p.route_fraction * n), "manual-fraction"
        elif (mix := calibrate.two_means(rows))["separation"] >= p.separation:
            count, name = min(max(mix["high_count"], count), math.ceil(p.most_fraction * n)), "adaptive-bimodal-anomaly"
        chosen = routing.topk(rows.select("cluster_id", "score"), count).select("cluster_id", F.lit(True).alias("joint_active"))
        return rows.join(chosen, "cluster_id", "left").select("cluster_id", F.col("score").alias("joint_anomaly"), F.coalesce("joint_active", F.lit(False)).alias("joint_active")), name
    gated = routing.gate(rows, "score", 1, 2).drop("gate").withColumnRenamed("active", "a")
    gated = routing.gate(gated, "num_reads", 3, 4).withColumnRenamed("active", "b")
    return gated.select("cluster_id", F.col("score").alias("joint_anomaly"), (F.col("a") | F.col("b")).alias("joint_active")), name


def run_metrics(routed: DataFrame, policy_name: str) -> DataFrame:
    """One row about a run: policy, clusters, planned (chosen for decoding), the share in percent and the mean anomaly."""
    n, planned = F.count("*"), F.count_if("joint_active")
    return routed.agg(F.lit(policy_name).alias("policy"), n.alias("clusters"), planned.alias("planned"), safe_percent(planned, n).alias("planned_percent"), F.avg("joint_anomaly").alias("mean_anomaly"))


def decode(rows: DataFrame, model: D.Model, ctx: dict, p: Params, anchors: tuple[str, str] = ("", "")) -> DataFrame:
    """(cluster_id, decoded) of rows(cluster_id, reads, sequence, boundary) that are active."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by k, not by the data
    rates = {"match": 1.0, "sub": 3.0, "ins": 4.0, "del": 1.0} if p.disable_channel else ctx["rates"]

    def kernel(row):
        reads, guide = G.cleaned(row["reads"]), row["sequence"]
        if not guide:
            out = "A" * p.length
        elif row["boundary"] >= 0:
            out = D.boundary(guide, reads, *anchors, row["boundary"])
        else:
            out = D.trellis(guide, reads, shared.value, ctx["cross"], ctx["local"], rates, ctx["band"], ctx["states"], ctx["most"])
        return [{"cluster_id": row["cluster_id"], "decoded": out}]

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return per_cluster(rows.repartition(4 * n, "cluster_id"), kernel, "cluster_id long, decoded string")


def reconstruct(reads: DataFrame, p: Params = Params(), other: DataFrame | None = None, permute: int | None = None, guides: DataFrame | None = None) -> DataFrame:
    """(cluster_id, sequence, guide, policy, the guide's diagnostics, joint_anomaly, joint_active), one row a cluster.

    Guides are frozen before anything is taken from them, and each cluster is decoded at most once, from the frozen
    guides. ``other`` takes the context's model from another dataset's guides, ``permute`` deals its counts anew.
    """
    clusters = frozen(clustered(reads), "clusters")
    guides = guides if guides is not None else frozen(local_guides(clusters, p.length, p.deep), "guides")
    ctx = context(clusters, guides, p)
    routed, policy = route(reads, guides, ctx, p)
    routed = frozen(routed, "routes")
    model = markov((other if other is not None else guides).select("cluster_id", F.col("sequence").alias("seq")), ctx["k"])
    if permute is not None:
        model = permuted(model, permute)
    anchors = ("", "")
    if ctx["reuse"] < p.high_reuse and ctx["phase"] < p.low_phase:
        rich = routing.gate(guides, "num_reads", 3, 4).where("active")
        if rich.count() >= 64:
            a = kmers.conserved_anchors(rich.where(F.length("sequence") == p.length).select(F.col("sequence").alias("seq"))).first()
            anchors = (a.left_anchor, a.right_anchor) if a else anchors
    at = boundary_signature(F.col("sequence"), anchors[0], anchors[1], F.length("sequence"))
    rows = guides.join(routed, "cluster_id").withColumn("boundary", at if all(anchors) else F.lit(-1))
    active = rows.where((F.lit(not p.disable_decode) & (F.col("joint_active") | (F.col("boundary") >= 0))) | (F.col("sequence") == ""))
    done = decode(active.select("cluster_id", "sequence", "boundary").join(clusters, "cluster_id"), model, ctx, p, anchors)
    diag = [c for c in guides.columns if c not in ("cluster_id", "sequence")]
    return rows.join(done, "cluster_id", "left").select("cluster_id", F.coalesce("decoded", "sequence").alias("sequence"), F.col("sequence").alias("guide"), F.lit(policy).alias("policy"), *diag, "joint_anomaly", "joint_active")


def ablations(p: Params) -> dict[str, Params]:
    """The variants of an ablation run."""
    return {"full": p, "guide_only": replace(p, disable_decode=True), "no_cross_loo": replace(p, disable_cross=True), "no_blind_ids": replace(p, disable_channel=True), "decode_all": replace(p, decode_all=True), "local_only": replace(p, decode_all=True, cross_weight=0.0)}
