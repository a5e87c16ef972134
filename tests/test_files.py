"""The data source of documents: round trips, failing tasks, pages in several tasks, files that cannot be decoded."""

import json

import pytest
from pyspark.sql import functions as F

from quireframe.sources import files


def pages(spark, root, n=6):
    rows = [(f"{root}/d{k % 3}/doc{k}.jsonl", p, json.dumps({"k": k, "p": p, "t": "\u00e9\u65e5"})) for k in range(n) for p in range(k % 4 + 1)]
    return rows, spark.createDataFrame(rows[::-1], "path string, page_no int, page string").repartition(4)


def names(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark, tmp_path)
    files.write(df, str(tmp_path))
    assert names(tmp_path) == sorted({r[0][len(str(tmp_path)) + 1 :] for r in rows}) and not list(tmp_path.glob(".staging*"))
    back = [(r.path, r.page_no, json.loads(r.page), r.error) for r in files.read(spark, str(tmp_path)).collect()]
    assert sorted(back, key=str) == sorted(((p, n, json.loads(t), None) for p, n, t in rows), key=str)
    one = files.read(spark, str(tmp_path)).where(F.col("path") == rows[-1][0])
    assert sorted(r.page_no for r in one.collect()) == list(range(5 % 4 + 1))
    files.write(spark.createDataFrame([(rows[0][0], 0, "[]")], "path string, page_no int, page string"), f"file://{tmp_path}")
    assert (tmp_path / "d0" / "doc0.jsonl").read_text() == "[]\n"
    (tmp_path / "d0" / "torn.JSONL").write_text("{")
    assert [r.path.rsplit("/", 1)[1] for r in files.read(spark, str(tmp_path)).where("error is not null").collect()] == ["torn.JSONL"]


def test_no_half_document_when_a_task_fails(spark, tmp_path):
    rows, df = pages(spark, tmp_path)
    files.write(spark.createDataFrame(rows[:1], df.schema), str(tmp_path))
    before = {n: (tmp_path / n).read_bytes() for n in names(tmp_path)}
    broken = df.withColumn("page", F.when((F.col("page_no") == 1) & F.col("path").endswith("doc3.jsonl"), F.raise_error(F.lit("planted"))).otherwise(F.col("page")))
    with pytest.raises(Exception, match="planted"):
        files.write(broken, str(tmp_path))
    assert {n: (tmp_path / n).read_bytes() for n in names(tmp_path)} == before and not list(tmp_path.glob(".staging*"))


def test_pages_have_to_come_together(spark, tmp_path):
    rows, df = pages(spark, tmp_path)
    spark.dataSource.register(files.Quire)
    with pytest.raises(Exception, match="several tasks|not together"):
        df.repartition(6).write.format("quire").mode("append").save(str(tmp_path))
    assert names(tmp_path) == []
    with pytest.raises(Exception, match="are written from"):
        df.select("path", "page").write.format("quire").mode("append").save(str(tmp_path))


def test_listed_files_are_read_where_their_rows_are(spark, tmp_path):
    rows, df = pages(spark, tmp_path)
    files.write(df, str(tmp_path))
    listed = spark.createDataFrame([(rows[0][0],), (f"file:{rows[1][0]}",), (f"{tmp_path}/missing.jsonl",)], "path string")
    got = files.pages_of(listed).collect()
    assert sorted(r.page_no for r in got if r.error is None) == [0, 0, 1] and [r.error.split(":")[0] for r in got if r.error] == ["FileNotFoundError"]
