"""Formats of Spark's own: round trips, writes that fail, streams by the number of a write."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from foliant.sources import formats


@pytest.fixture
def known(spark):
    formats.register(spark)
    return spark


def _sections(spark, docs):
    return spark.createDataFrame([(d, f"page_{i}", i, b) for d, bodies in docs.items() for i, b in enumerate(bodies, 1)], formats.SECTION).repartition("doc").sortWithinPartitions("doc", "ord")


def test_sections_round_trip(known):
    at = tempfile.mkdtemp()
    docs = {"a": ["one\ntwo", "", "ü  "], "b/c.d": ["x" * 3_000_000], "": ["\nlead"]}
    rows = _sections(known, docs)
    rows.write.format("sections").mode("append").save(at)
    got = {(r["doc"], r["ord"]): (r["image"], r["body"]) for r in known.read.format("sections").load(at).collect()}
    assert got == {(d, i): (f"page_{i}", b.rstrip()) for d, bodies in docs.items() for i, b in enumerate(bodies, 1)}
    rows.filter("doc = 'a'").write.format("sections").mode("append").save(at)
    assert known.read.format("sections").load(at).count() == 8
    rows.filter("doc = 'a'").write.format("sections").mode("overwrite").save(at)
    assert known.read.format("sections").load(at).count() == 3 and os.listdir(at) == ["write-00000003"]
    assert known.read.format("sections").load(tempfile.mkdtemp()).count() == 0


def test_many_documents_are_few_parts(known):
    """A part holds many files, whose commit moves folders; files that lie in no folder, as former writes left them, are read too."""
    at = tempfile.mkdtemp()
    rows = known.range(2500).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc"), F.lit("page_1").alias("image"), F.lit(1).alias("ord"), F.col("id").cast("string").alias("body"))
    rows.repartition(2, "doc").sortWithinPartitions("doc").write.format("sections").mode("append").save(at)
    got = known.read.format("sections").load(at)
    assert got.rdd.getNumPartitions() <= 4 and {(r["doc"], r["body"]) for r in got.collect()} == {(f"d{i}", str(i)) for i in range(2500)}
    os.mkdir(f"{at}/write-00000002")
    for i in range(3):
        with open(f"{at}/write-00000002/{i}.{f'old{i}'.encode().hex()}.txt", "w") as f:
            f.write("Image: page_1\nx\n")
    assert known.read.format("sections").load(at).count() == 2503 and known.read.format("sections").load(at).filter("doc like 'old%'").count() == 3


def test_a_write_that_fails_leaves_nothing(known):
    at = tempfile.mkdtemp()
    rows = _sections(known, {c: ["x"] for c in "abcdefgh"})
    with pytest.raises(Exception):  # noqa: B017
        rows.withColumn("body", F.when(F.col("doc") == "e", F.raise_error(F.lit("lost"))).otherwise(F.col("body"))).write.format("sections").mode("append").save(at)
    assert os.listdir(at) == [] and known.read.format("sections").load(at).count() == 0


def test_log_lines_as_a_stream(known):
    at, root = tempfile.mkdtemp(), tempfile.mkdtemp()

    def go():
        q = known.readStream.format("lines_log").load(at).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start()
        q.awaitTermination(120)

    known.range(5).select(F.col("id").cast("string").alias("value")).write.format("lines_log").mode("append").save(at)
    go()
    known.range(3).select("id", F.lit("ä\nb").alias("t")).write.format("lines_log").mode("append").save(at)
    go()
    go()
    got = sorted(r["value"] for r in known.read.parquet(f"{root}/out").collect())
    assert got == sorted([*"01234", *('{"id": %d, "t": "ä\\nb"}' % i for i in range(3))])
