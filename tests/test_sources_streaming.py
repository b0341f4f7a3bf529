"""Formats and streams."""

from pyspark.sql import functions as F

from veldspar.operators import schema as S
from veldspar.sources import formats
from veldspar.streaming import vet


def test_formats(spark, tmp_path):
    (tmp_path / "a.toml").write_text('x = 1\n[s]\ny = "t"\n')
    (tmp_path / "b.toml").write_text("x = = 1")
    got = {r["path"][-6:]: r for r in formats.read_toml(spark, str(tmp_path / "*.toml")).select("path", F.try_variant_get("document", "$.s.y", "string").alias("y"), "error").collect()}
    assert got["a.toml"]["y"] == "t", got
    assert got["b.toml"]["error"]
    (tmp_path / "c.ini").write_text("[one]\nA = b\n")
    assert formats.read_ini(spark, str(tmp_path / "c.ini")).select(F.try_variant_get("document", "$.one.A", "string").alias("a")).first()["a"] == "b"
    (tmp_path / "d.xml").write_text('<r><p id="1">x</p><p id="2">y</p></r>')
    assert sorted(map(tuple, formats.read_xml(spark, str(tmp_path / "d.xml"), "p", "`$id` int, `$$` string").collect())) == [(1, "x"), (2, "y")]
    formats.write_jsonl(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":1}'
    assert formats.read_variant(spark, str(tmp_path / "j")).where("document IS NOT NULL").count() == 1


def test_stream_is_split(spark, tmp_path):
    src, good, bad = (str(tmp_path / n) for n in ("src", "good", "bad"))
    spark.range(10).select(F.col("id").alias("n")).write.parquet(src)
    q = vet.split(spark.readStream.schema("n long").parquet(src), S.struct(n=S.Bound("<", 7)), good, bad, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(good).count() == 7
    assert spark.read.parquet(bad).count() == 3
    done = tmp_path / "ck" / "commits"
    for f in ("0", ".0.crc"):
        (done / f).unlink(missing_ok=True)
    q = vet.split(spark.readStream.schema("n long").parquet(src), S.struct(n=S.Bound("<", 7)), good, bad, str(tmp_path / "ck"))
    q.processAllAvailable()  # the only batch again, as after a loss before its commit
    q.stop()
    assert q.recentProgress and q.recentProgress[0]["batchId"] == 0
    assert spark.read.parquet(good).count() == 7 and spark.read.parquet(bad).count() == 3
