"""Case folding and ASCII forms against Python's, for every character there is."""

import random
import sys

import pandas as pd
from pyspark.sql import functions as F

from loomtext.functions import characters, names, text


def test_all_of_unicode(spark):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    # sixteen neighbours a row, so that what needs taking apart and what does not stand together
    rows = ["a" + "".join(every[i : i + 16]) + "Z" for i in range(0, len(every), 16)]
    frame = spark.createDataFrame(pd.DataFrame({"s": rows})).repartition(8)
    got = frame.select("s", characters.case_folded(F.col("s")).alias("case"), names.fold(F.col("s")).alias("fold")).toPandas()
    assert len(got) == len(rows)
    assert [s for s, x in zip(got["s"], got["case"], strict=True) if x != s.casefold()] == []
    assert [s for s, x in zip(got["s"], got["fold"], strict=True) if x != names.fold_text(s)] == []


def test_names_and_surfaces(spark):
    rng = random.Random(41)
    said = ["Straße", "ﬁn", "İstanbul", "  ΌΣΟΣ ", "Ærø", "½ Ångström", "éá̧", "𐐀lder", "", "  x ", "Ａｎａ", "Nicolás"]
    said += ["".join(rng.choice("aÉßﬁ ½𐐀İ̈日x") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    frame = spark.createDataFrame([(s,) for s in said] + [(None,)], "s string")
    got = frame.select(text.strip(characters.case_folded(F.col("s"))).alias("case"), names.fold(F.col("s")).alias("fold")).collect()
    assert [r.case for r in got] == [s.casefold().strip() for s in said] + [None]
    assert [r.fold for r in got] == [names.fold_text(s) for s in said] + [None]


def test_no_python_worker_folds(spark):
    plan = spark.range(3).select(names.fold(F.concat(F.lit("É"), F.col("id").cast("string"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
