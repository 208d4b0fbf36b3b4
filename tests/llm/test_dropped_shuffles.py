"""Shuffles behind a kept table are deleted when it is written, whether or not the driver collects its plans."""

import re
import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import ngram_join, shared

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    """Bytes of each shuffle that lies on disk."""
    found = {}
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    for k in range(files.size()):
        f = files.apply(k)
        if m := re.match(r"shuffle_(\d+)_", f.getName()):
            found[int(m[1])] = found.get(int(m[1]), 0) + f.length()
    return found


def left(spark, before, most=0):
    """Bytes of the shuffles made since, once they are ``most`` or have had ten seconds to go."""
    for _ in range(100):
        size = sum(v for k, v in shuffles(spark).items() if k not in before)
        if size <= most:
            break
        time.sleep(0.1)
    return size


def test_a_kept_table_leaves_no_shuffle(spark):
    before = shuffles(spark)
    df = spark.range(50000).repartition(8, "id").groupBy((F.col("id") % 1000).alias("k")).count()
    kept = shared.keep(df, "some")
    assert left(spark, before) == 0
    assert kept.count() == df.count() == 1000
    shared.discard(spark, kept)


def test_lists_are_gone_after_the_join(spark):
    texts = [" ".join(f"w{(k * 7919 + j * j * 31) % 5003}" for j in range(400)) for k in range(300)]
    docs = spark.createDataFrame([(k, texts[k // 2 * 2]) for k in range(300)], "doc_id long, text string")
    before = shuffles(spark)
    joined = ngram_join.ngram_join(docs)
    lists = 150 * ngram_join.prefix_length(396, ngram_join.PERCENT) * 6  # bytes of the hashes alone
    assert left(spark, before, lists // 4) <= lists // 4
    assert {r.component_id for r in joined.collect()} == set(range(0, 300, 2))


@pytest.mark.parametrize("own", [None, "false", "true"])
def test_the_sessions_own_setting_stays(spark, own):
    default = spark.conf.get(CLEANUP, None)
    try:
        if own is not None:
            spark.conf.set(CLEANUP, own)
        shared.discard(spark, shared.keep(spark.range(3), "few"))
        with pytest.raises(Exception, match="no such"), shared.shuffles_dropped(spark):
            raise ValueError("no such")
        assert spark.conf.get(CLEANUP, None) == (default if own is None else own)
    finally:
        if own is not None:
            spark.conf.unset(CLEANUP)
