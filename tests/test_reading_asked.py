"""A page whose primary reading holds costs no comparison with the fallback."""

from pyspark.sql import functions as F

from dossierlake.operators import reading


def test_nothing_is_compared_where_the_primary_holds(spark, monkeypatch):
    monkeypatch.setattr(reading, "critical_fields", lambda lines: F.transform(lines, lambda x: F.raise_error(F.concat(F.lit("compared: "), x)).cast("string")))
    lines = spark.createDataFrame([(1, e, 1, f"CCCD: 11111111{k}", 0.9) for k, e in enumerate(("primary", "fallback"))], "page_id int, engine string, line int, text string, conf double")
    images = spark.createDataFrame([(1, 90.0, 20.0)], "page_id int, blur double, contrast double")
    got = reading.select_reading(lines, images).collect()
    assert [(r["engine"], r["reason"], r["disagreement"], r["gate"]) for r in got] == [("primary", None, False, "PASS")]
