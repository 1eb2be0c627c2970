import pytest
from pyspark.sql import functions as F

from tessella.sources import stores as S


def test_files(spark, tmp_path):
    for name, content in (("b.PDF", b"1"), ("a.pdf", b"2"), ("sub/c.pdf", b"1"), ("_hidden/x.pdf", b"1"), ("Shared/d.pdf", b"1"), ("e.txt", b"1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    names = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert names(S.list_files(spark, str(tmp_path), ("pdf",), skip="Shared")) == ["a.pdf", "b.PDF", "c.pdf"]
    assert names(S.list_files(spark, str(tmp_path), ("pdf",), most=1)) == ["d.pdf"]
    same = S.hashed_files(spark, str(tmp_path)).where(F.col("path").endswith("e.txt")).first()
    assert same["first"].endswith("d.pdf")


def test_snapshot_and_restore(spark, tmp_path):
    S.snapshot({"a": spark.range(3), "b": spark.range(4)}, str(tmp_path), "v1")
    back = S.restore(spark, str(tmp_path), "v1", ("a", "b"))
    assert (back["a"].count(), back["b"].count()) == (3, 4)
    with pytest.raises(Exception, match="exists"):
        S.snapshot({"a": spark.range(3)}, str(tmp_path), "v1")


def test_traces_skip_bad_lines(spark, tmp_path):
    folder = str(tmp_path / "t")
    S.append_traces(spark.range(2), folder)
    S.append_traces(spark.range(2, 3), folder)
    (tmp_path / "t" / "bad.json").write_text('{"id": 9}\n{broken\n')
    assert sorted(r[0] for r in S.read_traces(spark, folder, "id long").where("id IS NOT NULL").collect()) == [0, 1, 2, 9]


def test_only_given_partitions_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "p")
    S.replace_partitions(spark.range(6).withColumn("k", F.col("id") % 3), folder, "k")
    S.replace_partitions(spark.createDataFrame([(100, 1)], "id long, k long"), folder, "k")
    assert sorted(r["id"] for r in spark.read.parquet(folder).collect()) == [0, 2, 3, 5, 100]


def test_shares_and_columns(spark):
    rows = spark.createDataFrame([("40%/60% CPU/GPU",), ("100% GPU",), ("30% CPU",), ("?",)], "p string")
    assert [r[0] for r in rows.select(S.gpu_share(F.col("p"))).collect()] == [60, 100, 70, None]
    assert spark.range(1).select(S.split_columns(F.lit(" a b   c  d "))).first()[0] == ["a b", "c", "d"]
