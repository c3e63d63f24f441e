"""The fit's sample counts distinct texts: repeating a text changes neither its bound nor its words."""

import numpy as np
from pyspark.sql import functions as F

from tidepost.llm import language


def test_copies_count_once(spark):
    line = F.concat(F.lit("wort nummer "), F.col("id").cast("string"), F.lit(" im haus "), F.chr((F.col("id") % 26) + 97))
    de = spark.range(300).select(F.lit("de").alias("lang"), line.alias("text"))
    en = spark.range(300).select(F.lit("en").alias("lang"), F.concat(F.lit("the "), line).alias("text"))
    plain = de.unionByName(en)
    # every text 40 times, and one of each language 8,000 times more
    many = plain.crossJoin(spark.range(40).select()).unionByName(
        plain.where("text LIKE '%nummer 7 im%'").crossJoin(spark.range(8000).select())
    )
    once, often = language.fit(plain), language.fit(many)
    assert once.languages == often.languages == ["de", "en"]
    assert np.array_equal(once.probs, often.probs)
