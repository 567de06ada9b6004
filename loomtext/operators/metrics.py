"""Scores of predictions against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.ratios import f1, hit_rate
from loomtext.operators import matching


def bcubed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """precision, recall, f1 from rows (key, cluster) of each side; a key on one side only counts 0 on both."""
    g = gold.select("key", F.col("cluster").alias("g")).dropDuplicates(["key", "g"])
    p = predicted.select("key", F.col("cluster").alias("p")).dropDuplicates(["key", "p"])
    both = g.join(p, "key", "full")
    cell = both.where("g is not null and p is not null").groupBy("g", "p").agg(F.count("*").alias("n"))
    of_g, of_p = g.groupBy("g").agg(F.count("*").alias("n_g")), p.groupBy("p").agg(F.count("*").alias("n_p"))
    scored = cell.join(of_g, "g").join(of_p, "p").agg(F.sum(F.col("n") * F.col("n") / F.col("n_p")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("n_g")).alias("r"))
    total = both.agg(F.count_distinct("key").alias("total"))
    rate = lambda c: F.when(F.col("total") == 0, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)) / F.nullif(F.col("total"), F.lit(0)))
    one = lambda d: d.withColumn("one", F.lit(1))
    return one(scored).join(one(total), "one").select(rate("p").alias("precision"), rate("r").alias("recall")).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) whose name sets share a name, from rows (id, names) with folded names."""
    names = lambda d, c: d.select(F.col("id").alias(c), F.explode("names").alias("name")).where("name <> ''").distinct()
    return names(a, "a_id").join(names(b, "b_id"), "name").select("a_id", "b_id").distinct()


def greedy_matches(edges: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Each `first` in order takes the least `second` not yet taken that it has an edge with, within a group."""
    asked = edges.select(group, F.col(second).alias("name"), F.col(first).alias("x"))
    found = matching.greedy(asked, edges.select(group, F.col(second).alias("name"), F.col(second).alias("y")), group)
    return found.select(group, F.col("x").alias(first), F.col("y").alias(second))


def detection(gold: DataFrame, predicted: DataFrame, matches: DataFrame, group: str) -> DataFrame:
    """precision, recall, f1 a work."""
    count = lambda d, c: d.groupBy(group).agg(F.count("*").alias(c))
    all_ = count(gold, "n_gold").join(count(predicted, "n_pred"), group, "full").join(count(matches, "tp"), group, "left").fillna(0)
    scored = all_.select(group, hit_rate(F.col("tp"), F.col("n_pred"), F.col("n_gold")).alias("precision"), hit_rate(F.col("tp"), F.col("n_gold"), F.col("n_pred")).alias("recall"))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def silent_bad_merges(gold_pairs: DataFrame, first_match: DataFrame, covered: DataFrame) -> DataFrame:
    """Pairs (x, y) of different gold entities whose first match is one prediction and that no candidate covers.

    first_match: (gold_id, pred_id); gold_pairs: pairs that share a name, which don't count; covered: pairs in any order.
    """
    m = first_match
    same = m.select(F.col("gold_id").alias("x"), "pred_id").join(m.select(F.col("gold_id").alias("y"), "pred_id"), "pred_id").where("x < y")
    either = lambda d: d.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return same.join(either(gold_pairs), ["x", "y"], "left_anti").join(either(covered), ["x", "y"], "left_anti")


def relation_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """By bucket (extracted, inferred, all): precision, recall, f1, type_accuracy, from rows (a, b, rel_type, provenance).

    A predicted pair is precise if it is gold in any bucket; a gold pair is found by a prediction of the same bucket, and
    type accuracy is over the pairs found, null without any. All three buckets have a row, also without pairs.
    """
    names = F.array(*map(F.lit, ("extracted", "inferred", "all")))
    buckets = lambda d: d.withColumn("bucket", F.explode(F.array(F.col("provenance"), F.lit("all"))))
    g, p = gold.select("a", "b", F.col("rel_type").alias("g_type")), buckets(predicted).select("bucket", "a", "b", F.col("rel_type").alias("p_type"))
    by_gold = buckets(gold).join(p, ["bucket", "a", "b"], "left").groupBy("bucket").agg(F.count("*").alias("n_gold"), F.count("p_type").alias("found"), F.count_if(F.col("p_type") == F.col("rel_type")).alias("typed"))
    by_pred = buckets(predicted).join(g, ["a", "b"], "left").groupBy("bucket").agg(F.count("*").alias("n_pred"), F.count("g_type").alias("hits"))
    every = gold.sparkSession.range(1).select(F.explode(names).alias("bucket"))
    rows = every.join(by_gold, "bucket", "left").join(by_pred, "bucket", "left").fillna(0)
    scored = rows.select("bucket", hit_rate(F.col("hits"), F.col("n_pred"), F.col("n_gold")).alias("precision"), hit_rate(F.col("found"), F.col("n_gold"), F.col("n_pred")).alias("recall"), F.when(F.col("found") > 0, F.col("typed") / F.nullif(F.col("found"), F.lit(0))).alias("type_accuracy"))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def attribute_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """By class (static, stateful, all): precision, recall, f1 over triples (character, key, value_norm, attr_class)."""
    triple = ["character", "key", "value_norm"]
    sides = gold.select(*triple, "attr_class").distinct().withColumn("g", F.lit(1)).join(predicted.select(*triple, "attr_class").distinct().withColumn("p", F.lit(1)), [*triple, "attr_class"], "full").fillna(0, ["g", "p"])
    counted = sides.withColumn("bucket", F.explode(F.array("attr_class", F.lit("all")))).groupBy("bucket").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    scored = counted.select("bucket", hit_rate(F.col("tp"), F.col("n_pred"), F.col("n_gold")).alias("precision"), hit_rate(F.col("tp"), F.col("n_gold"), F.col("n_pred")).alias("recall"))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


#: The least scores that pass.
LEAST = {"detection_f1": 0.90, "bcubed_f1": 0.85, "pair_f1": 0.90, "type_accuracy": 0.90, "triple_f1": 0.90, "chapters": 0.95, "separators": 0.90}


def passes(**scores: Column) -> Column:
    """Every score reaches its threshold; a null score passes where it may be unmeasured."""
    out = F.lit(True)
    for name, c in scores.items():
        ok = c >= LEAST[name]
        out = out & (F.coalesce(ok, F.lit(True)) if name in ("bcubed_f1", "type_accuracy") else F.coalesce(ok, F.lit(False)))
    return out
