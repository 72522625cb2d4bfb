"""Tables in the shared folder."""

from pyspark.sql import functions as F

from gleanery.plans.lineage import CLEANUP, Scratch


def test_shuffle_files_go_with_the_job_that_wrote_a_table(spark):
    def kept():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for k in range(found.size()) if (x := found.apply(k).getName()).startswith("shuffle_")}

    before, set_to = kept(), spark.conf.get(CLEANUP)
    table = Scratch(spark).write(spark.range(20000).groupBy((F.col("id") % 700).alias("k")).count())
    assert kept() <= before and spark.conf.get(CLEANUP) == set_to
    assert table.agg(F.sum("count")).first()[0] == 20000 and table.groupBy("count").count().count() == 2
