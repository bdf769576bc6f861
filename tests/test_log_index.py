"""The log search that skips files against a plain scan of every block."""

from pyspark.sql import functions as F

from flowspark.operators import files_with, index_log, search_log, write_log
from flowspark.operators import log_index
from flowspark.operators.log_index import _paths, _triples, gram_table
from flowspark.session import work_dir
from flowspark.sources import read_log_blocks

HEAD = "Logging record "


def log_of(spark, groups):
    """A log with one file per group of block bodies, in a folder whose name needs encoding."""
    base = work_dir(spark, "log index 100%")
    for bodies in groups:
        lines = spark.createDataFrame([(HEAD + b,) for b in bodies], "line string").coalesce(1)
        write_log(lines, f"{base}/log")
    index_log(spark, f"{base}/log", f"{base}/index")
    return base


def found(spark, base, text):
    return sorted(r.line for r in search_log(spark, f"{base}/index", text).collect())


GROUPS = [["1\nred fox", "2\nred hen"], ["3\nblue whale", "3\nblue whale"], ["4\nÄpfel 🍎🍏🍐 here", "5\nab"],
          ["6\n" + "x" * 200_000 + "needle"]]


def test_search_equals_a_full_scan(spark):
    base = log_of(spark, GROUPS)
    blocks = [HEAD + b for g in GROUPS for b in g]
    for text in ["2\nred", "blue whale", "🍎🍏🍐", "xneedle", "", "red whale", "x" * 5000]:
        assert found(spark, base, text) == sorted(b for b in blocks if text in b), text


def test_only_files_that_can_match_are_read(spark):
    base = log_of(spark, GROUPS)
    assert files_with(spark, f"{base}/index", "blue whale").count() == 1
    assert files_with(spark, f"{base}/index", "ab").count() == 4  # too short for the table
    assert len(search_log(spark, f"{base}/index", "blue whale").inputFiles()) == 1


def test_new_files_are_added_once(spark):
    base = log_of(spark, GROUPS[:1])
    index_log(spark, f"{base}/log", f"{base}/index")
    assert spark.read.parquet(f"{base}/index/files").count() == 1
    write_log(spark.createDataFrame([(HEAD + "9\nlate heron",)], "line string").coalesce(1), f"{base}/log")
    assert found(spark, base, "late heron") == []
    index_log(spark, f"{base}/log", f"{base}/index")
    assert found(spark, base, "late heron") == [HEAD + "9\nlate heron"]
    # a run that broke off after the bit table leaves a file's rows twice
    files = _paths(spark.read.text(f"{base}/log").inputFiles())
    gram_table(read_log_blocks(spark, files, file="file")).write.mode("append").parquet(f"{base}/index/grams")
    assert len(found(spark, base, "late heron")) == 1 and len(found(spark, base, "red")) == 2


def test_a_file_has_at_most_its_bits(spark):
    words = spark.range(3000).select(F.lit("f").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("line"))
    table = gram_table(words).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("bits")).alias("b")).first()
    assert table.n <= 33 and table.b == 4096
    assert gram_table(words.select("file", F.lit(None).cast("string").alias("line"))).count() == 0


def test_a_task_sends_each_triple_of_a_file_once(spark, monkeypatch):
    monkeypatch.setattr(log_index, "CHUNK", 7)
    lines = ["abcabc" * 500, "", None, "ab", "c\u00c4\U0001f34ed", "x", "yz"]
    rows = [(f, line) for f in ("f", "g") for line in lines]
    got = [tuple(r) for r in _triples(spark.createDataFrame(rows, "file string, line string").coalesce(1)).collect()]
    texts = [(f, line.encode()) for f, line in rows if line]
    want = {(f, int.from_bytes(t[i:i + 3], "little")) for f, t in texts for i in range(len(t) - 2)}
    assert len(got) == len(want) and set(got) == want
