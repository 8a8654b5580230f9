"""Readers over several files, boundaries of other forms, tables with a pointer, and the ordered stream."""

import pytest

from helixspark.sources import text, versioned
from helixspark.streaming import clusters as stream

SEP = text.SEPARATOR


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / f"{name}.txt").write_text(body)
    return str(folder)


def rows(df):
    return sorted(map(tuple, df.select("cluster_id", "read_idx", "read").collect()))


def test_clusters_of_three_files(spark, tmp_path):
    """Each file begins with a separator; one has an empty cluster inside, one begins without a separator, one is blank."""
    path = write(tmp_path / "in", a=f"{SEP}\nAC\nGT TT\n{SEP}\n{SEP}\nCC\n", b=f"{SEP}\nGG\n", c=f"TT\n{SEP}\nAA\n{SEP}\n", d="\n", e=f"{SEP}\nCA\n{SEP}")
    kept = [(1, 0, "AC"), (1, 1, "GT"), (1, 2, "TT"), (3, 0, "CC"), (4, 0, "GG"), (5, 0, "TT"), (6, 0, "AA"), (7, 0, "CA")]
    assert rows(text.scan_clusters(spark, path, keep_empty=True)) == kept
    dense = [(c - (c > 2), i, r) for c, i, r in kept]
    assert rows(text.scan_clusters(spark, path)) == dense
    blocks = {(r.file.rsplit("/", 1)[-1], r.place): r.cluster_id for r in text.cluster_blocks(text.read_lines(spark, path, f"{SEP}\n")).collect()}
    assert blocks == {("a.txt", 1): 1, ("a.txt", 2): 2, ("a.txt", 3): 3, ("b.txt", 1): 4, ("c.txt", 1): 5, ("c.txt", 2): 6, ("e.txt", 1): 7}


def test_sink_in_several_parts(spark, tmp_path):
    reads = spark.createDataFrame([(c, i, "ACGT"[i] * (c % 5 + 1)) for c in range(1, 101) for i in range(c % 4 + 1)], "cluster_id long, read_idx int, read string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_clusters(reads, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) >= 3
    for keep in (False, True):
        assert rows(text.scan_clusters(spark, str(tmp_path / "out"), keep_empty=keep)) == rows(reads)
    assert rows(text.scan_cluster_lines(spark, str(tmp_path / "out"))) == rows(reads)


def test_boundaries(spark, tmp_path):
    path = write(tmp_path / "in", a=f"﻿CLUSTER 1\n ac GT\r\n\n====\nTT\nx{SEP}y\nGG\n{SEP}\n{SEP} tail\nCC\n", b="AA\n===\n===\nTC\n")
    assert rows(text.scan_cluster_lines(spark, path)) == [(1, 0, "ac"), (1, 1, "GT"), (2, 0, "TT"), (3, 0, "GG"), (4, 0, "CC"), (5, 0, "AA"), (6, 0, "TC")]
    kept = rows(text.scan_cluster_lines(spark, path, keep_empty=True, upper=True))
    assert kept == [(1, 0, "AC"), (1, 1, "GT"), (2, 0, "TT"), (3, 0, "GG"), (5, 0, "CC"), (6, 0, "AA"), (8, 0, "TC")]
    starts = rows(text.scan_cluster_lines(spark, write(tmp_path / "s", a=f"{SEP} one\nAC\nG{SEP}\n{SEP}\nTT\n"), boundary="startswith"))
    assert starts == [(1, 0, "AC"), (1, 1, f"G{SEP}"), (2, 0, "TT")]
    equal = rows(text.scan_cluster_lines(spark, write(tmp_path / "e", a=f"{SEP} one\nAC\n{SEP}\nTT\n"), boundary="equals"))
    assert equal == [(1, 0, SEP), (1, 1, "one"), (1, 2, "AC"), (2, 0, "TT")]
    with pytest.raises(Exception, match="not a read"):
        text.scan_cluster_lines(spark, path, boundary="equals", validate=True).collect()


def table(spark, path):
    return sorted(map(tuple, versioned.read_version(spark, path).select("key", "value").collect()))


def test_upsert_survives_a_failure_before_the_swap(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    make = lambda *r: spark.createDataFrame(list(r), "key long, value string")
    assert versioned.read_version(spark, path) is None
    versioned.upsert_table(make((1, "a"), (2, "b")), path, ["key"])
    more = make((2, "c"), (3, "d"))

    def broken(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(versioned, "commit", broken)
        with pytest.raises(OSError, match="lost"):
            versioned.upsert_table(more, path, ["key"])
    assert len(list((tmp_path / "t").glob("v-*"))) == 2 and table(spark, path) == [(1, "a"), (2, "b")]
    old = versioned.read_version(spark, path)  # a reader that began before the next write
    for _ in range(2):  # again, and once more
        versioned.upsert_table(more, path, ["key"])
        assert table(spark, path) == [(1, "a"), (2, "c"), (3, "d")]
    assert len(list((tmp_path / "t").glob("v-*"))) == 2
    assert old.schema == more.schema
    with pytest.raises(ValueError, match="repeat a key"):
        versioned.upsert_table(make((5, "x"), (5, "y")), path, ["key"])
    with pytest.raises(RuntimeError, match="another writer"):
        versioned.replace(more, path, {"version": "an old one"})
    assert table(spark, path) == [(1, "a"), (2, "c"), (3, "d")]


def run(spark, tmp_path, **more):
    stream.stream_text_clusters(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "state"), **more).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("cluster_id", "reads").collect() if (tmp_path / "out").exists() else []
    return sorted((r.cluster_id, *r.reads) for r in got)


def test_stream_restores_the_order_of_files(spark, tmp_path):
    """Equal clusters in one file, an empty cluster, an empty file, and files that arrive before their turn."""
    write(tmp_path / "in", part_2=f"{SEP}\nGG\n{SEP}\nGG\n", part_4=f"{SEP}\nTT\n")
    assert run(spark, tmp_path) == []
    write(tmp_path / "in", part_1=f"{SEP}\nAA\nAC\n{SEP}\n{SEP}\nAA\n")
    first = [(1, "AA", "AC"), (2,), (3, "AA"), (4, "GG"), (5, "GG")]
    assert run(spark, tmp_path) == first
    assert versioned.read_state(spark, str(tmp_path / "state"))["file"] == 3
    write(tmp_path / "in", part_3="\n", part_6=f"{SEP}\nCC\n", part_5=f"{SEP}\nCA\n")
    assert run(spark, tmp_path, files_a_batch=1) == [*first, (6, "TT"), (7, "CA"), (8, "CC")]


def test_stream_gives_no_number_twice(spark, tmp_path, monkeypatch):
    """A failure after a batch's rows are written and before its numbers are committed."""
    write(tmp_path / "in", part_1=f"{SEP}\nAA\n{SEP}\nAA\n")
    with monkeypatch.context() as m:
        m.setattr(stream, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    write(tmp_path / "in", part_2=f"{SEP}\nCC\n")
    assert run(spark, tmp_path) == [(1, "AA"), (2, "AA"), (3, "CC")]


def test_stream_of_guides(spark, tmp_path):
    write(tmp_path / "in", a_1=f"{SEP}\nACGTACGTAC\nACGTACGTAC\n{SEP}\n{SEP}\nTTTTTTTTTT\n")
    stream.stream_text_guides(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "state"), 10).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("cluster_id").select("cluster_id", "sequence").collect()
    assert [tuple(r) for r in got] == [(1, "ACGTACGTAC"), (2, ""), (3, "TTTTTTTTTT")]


def test_numbers_of_files(spark):
    assert stream._number("file:/a/7/part-00012.txt") == 12
    with pytest.raises(ValueError, match="no number"):
        stream._number("file:/a/7/part.txt")
