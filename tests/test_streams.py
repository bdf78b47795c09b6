from pyspark.sql import functions as F

from hitsieve.plans import q_screen


def test_staged_files_grow_with_the_rows(spark):
    """A task that writes arriving files gets no larger share of a larger library."""
    few = spark.range(0, 50, 1, 2).withColumnRenamed("id", "doc_id")
    many = spark.range(0, 5000, 1, 20).withColumnRenamed("id", "doc_id")
    count = lambda df: spark.read.parquet(q_screen.staged_files(spark, "", df)).select(F.input_file_name()).distinct().count()
    assert count(few) == 3 and count(many) == 20
