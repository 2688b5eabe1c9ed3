"""Cleaning in fewer passes, with the same results."""

from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions import text


def test_cleaning_joins_in_one_pass(spark):
    odd = [f"a{chr(i)} {chr(i)}{chr(i * 7919 % 55000)} b {chr(i)}" for i in range(0x3100)]
    odd += [" " * i + "x" + "\t" * (i % 3) + " " * (i % 4) + "(y)" for i in range(20)] + ["", " ", "()", "a  b", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    steps = text.collapse_spaces(text.drop_irrelevant(F.col("t")))
    assert df.filter(~text.join_relevant(F.col("t")).eqNullSafe(steps)).count() == 0
    plan = df.select(text.clean_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert K.IRRELEVANT_CHARS not in plan
