from pyspark.sql import functions as F

from strandframe.functions import sequences as S


def test_attributes_are_parsed_once(spark):
    """the expression makes its pairs once, not again for each pair."""
    df = spark.createDataFrame([('ID=a;id=b; Note "x y";Name="q=1"',)], "t string").select(S.attributes(F.col("t")).alias("m"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert df.first().m == {"id": "b", "note": "x y", "name": "q=1"}
