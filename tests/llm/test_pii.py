"""Surrogates: more names than a space holds."""

from pyspark.sql import functions as F

from loadweave.llm import pii


def test_names_beyond_the_first_space(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "de"])  # 2 ** 3 * 6 family names of three syllables
    names = spark.range(150).select(F.lit("family").alias("kind"), F.concat(F.lit("Xy"), F.col("id")).alias("value"))
    again = {r["value"]: r["surrogate"] for r in pii.redrawn(names, "key").collect()}
    firsts = names.select("value", pii.draw(F.col("kind"), F.col("value"), F.lit(0), "key").alias("s")).collect()
    assert len({again.get(r["value"], r["s"]) for r in firsts}) == 150
