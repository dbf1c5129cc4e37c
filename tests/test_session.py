import time

from pyspark.sql import functions as F

from tallyspan.session import stored


def test_stored_deletes_its_shuffle_files(spark):
    """What a stored table was made from takes no disk any more."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    before = shuffled()
    out = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert sorted(r["count"] for r in out.collect()) == [142, 143, 143, 143, 143, 143, 143]
