"""Sources, sinks and side effects."""

import pytest

from millrace.operators.grouping import partition_lists, two_level
from millrace.plans.clustering import library_kmeans
from millrace.sources import committed, files
from millrace.session import cut
from pyspark.sql import Row
from pyspark.sql import functions as F


def test_lines_end_with_any_usual_line_end_by_default(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\nfour")
    got = [r.value for r in files.read_lines(spark, str(tmp_path)).collect()]
    assert got == ["one", "two", "three", "four"]
    assert files.read_lines(spark, str(tmp_path), separator="\n").count() == 3


def test_text_goes_out_and_comes_back(spark, tmp_path):
    df = spark.createDataFrame([("a\tb ",), ("",), ("é",)], "value string")
    files.write_lines(df, str(tmp_path / "t"))
    assert sorted(r.value for r in files.read_lines(spark, str(tmp_path / "t"), "\n").collect()) == ["", "a\tb ", "é"]


def test_columns_keep_their_types(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5], bytearray(b"x"))], "k long, v array<double>, b binary")
    files.write_columns(df, str(tmp_path / "c"))
    back = files.read_columns(spark, str(tmp_path / "c"), df.schema)
    assert back.schema == df.schema and back.collect() == df.collect()
    assert cut(df, "test").collect() == df.collect()


def test_literal_rows_spread_over_partitions(spark):
    df = files.literal_rows(spark, [(i, str(i)) for i in range(40)], "k int, v string", partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 40


def test_effects_see_every_row_once(spark):
    df = spark.range(0, 1000, numPartitions=5)
    rows, sums, parts, batches = (spark.sparkContext.accumulator(0) for _ in range(4))
    files.for_each_row(df, lambda row: rows.add(1))

    def whole(partition):
        parts.add(1)
        sums.add(sum(row.id for row in partition))

    files.for_each_partition(df, whole)
    files.for_each_batch(df, lambda batch: batches.add(batch.num_rows))
    assert (rows.value, parts.value, sums.value, batches.value) == (1000, 5, 499500, 1000)


def test_partition_lists_in_pieces(spark):
    lists = partition_lists(spark.range(100), "id", F.col("id") % 3, 3, piece=10).collect()
    assert max(len(r["keys"]) for r in lists) == 10
    whole = {}
    for r in sorted(lists, key=lambda r: r.chunk):
        whole.setdefault(r.partition, []).extend(r["keys"])
    assert whole == {p: list(range(p, 100, 3)) for p in range(3)}


def test_two_levels_give_the_same_total(spark):
    got = two_level(spark.range(1000), ["id"], 8, [F.sum("id").alias("t")], [F.sum("t").alias("t")])
    assert got.first().t == 499500


def test_library_clusters_save_and_load(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i % 2 * 10), 1.0]) for i in range(20)], "id long, x array<double>")
    model = library_kmeans(points)
    files.save_model(model, str(tmp_path / "m"))
    centers = sorted(tuple(c) for c in files.load_model(str(tmp_path / "m")).clusterCenters())
    assert centers == [(0.0, 1.0), (10.0, 1.0)]


def test_committed_lines_are_all_there_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "lines")
    df = spark.range(100).repartition(5).selectExpr("id")
    got = committed.results_of_rows(df, lambda row: f"row {row.id}", path)
    assert sorted(r.value for r in got.collect()) == sorted(f"row {k}" for k in range(100))

    def fails(rows):
        if any(row.id == 37 for row in rows):
            raise ValueError("no")
        return ["done"]

    other = str(tmp_path / "failed")
    with pytest.raises(Exception, match="no"):
        committed.results_of_partitions(df, fails, other)
    assert committed.saved_lines(spark, other).count() == 0
    assert committed.results_of_rows(df.limit(0), str, str(tmp_path / "none")).count() == 0


def test_a_doubled_task_counts_once(spark, tmp_path):
    writer = committed.LineWriter(str(tmp_path))
    rows = [Row(value="a"), Row(value="b")]
    writer.write(iter(rows))  # an attempt that was lost after it wrote
    writer.commit([writer.write(iter(rows)), None, writer.write(iter([]))])
    assert sorted(r.value for r in committed.saved_lines(spark, str(tmp_path)).collect()) == ["a", "b"]
    writer.abort([writer.write(iter(rows))])
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("part-") and not p.name.endswith("crc")]) == 3
