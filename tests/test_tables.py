"""Tables that cut lineage."""

import glob

from textmill.operators import tables


def test_sweep_deletes_what_this_application_wrote(spark):
    df = tables.checkpointed(spark.range(10), "numbers")
    assert df.count() == 10
    at = tables.scratch_folder(spark).removeprefix("file:")
    assert glob.glob(f"{at}/numbers-*")
    tables.sweep(spark)
    assert not glob.glob(f"{at}/*") and tables.checkpointed(spark.range(3), "numbers").count() == 3


def test_spread_deals_out_few_files(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for n in (1, cores + 3):
        spark.range(100).repartition(n).write.parquet(str(tmp_path / str(n)))
    one, many = (tables.spread(spark.read.parquet(str(tmp_path / str(n)))) for n in (1, cores + 3))
    assert one.rdd.getNumPartitions() == cores and "Exchange" not in many._jdf.queryExecution().executedPlan().toString()
