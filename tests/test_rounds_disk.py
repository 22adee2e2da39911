"""What rounds leave on the disk."""

from pyspark.sql import functions as F

from factweave.operators import graph, louvain


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_rounds_leave_no_shuffle_files(spark):
    links = [(a, b, 1.0) for a in range(60) for b in range(a) if a % 3 == b % 3 or (a * b) % 11 == 0]
    both = graph.written(louvain.both_ways(spark.createDataFrame(links, "src long, dst long, weight double").repartition(4)))
    state = graph.written(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("community"), "k", F.lit(0.0).alias("loop")))
    before = shuffle_files(spark)
    held = []
    for turn in range(4):
        wish, state = louvain._round(both, state, 2.0 * len(links), turn)
        held.append((wish, state))  # so that no garbage is collected
    assert len(shuffle_files(spark) - before) == 0
    assert spark.conf.get(graph.CLEANS, "false") == "false"
