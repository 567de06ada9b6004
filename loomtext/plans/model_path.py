"""From wanted responses to answers: stored ones first, a model for the rest, every answer kept.

Rows are asked once each, in parallel tasks; what a model is told about known characters is a column, so a scene needs
no answer of the scene before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomtext.functions.prompts import SYSTEM, judge_prompt, scene_prompt
from loomtext.operators.evidence import top_quotes
from loomtext.operators.resolution import similar_pairs
from loomtext.schemas import JUDGEMENT
from loomtext.sources import models, responses


def completed(wanted: DataFrame, store: str, layer: str, schema: str, valid: Column, client: Callable[[], models.Model] | None, context: Column, chapter: Column | None = None, force: bool = False, totals: dict | None = None) -> DataFrame:
    """wanted, rows with cache_key and text, with response, hit (stored before), answered (by the model now) and error.

    Misses are asked by scene_prompt(), and the answers appended to the store, also failures, which are asked again the
    next time. force asks for all rows, and writes too. Without a client misses stay misses. A broken contract fails its
    row alone; an absent provider fails the job, and what was stored stays. totals gets the run's rows (scenes), cache_hits,
    asked, answered and failed, observed while the answers are written: no job looks at the table again for them.
    """
    spark = wanted.sparkSession
    looked = responses.looked_up(wanted, responses.saved(spark, store, layer), schema, valid, force)
    before = looked.select(*wanted.columns, "hit", F.col("response").alias("_stored"))
    if client is None:
        return before.withColumnRenamed("_stored", "response").withColumns({"answered": F.lit(False), "error": F.lit(None).cast("string")})
    seen, wrote = Observation(f"{layer} looked up"), Observation(f"{layer} asked")
    watched = looked.observe(seen, F.count(F.lit(1)).alias("scenes"), F.count_if("hit").alias("cache_hits"))
    asked = watched.where("not hit").select("cache_key", scene_prompt(F.col("text"), context, chapter).alias("prompt")).dropDuplicates(["cache_key"])
    run = spark.sql("select uuid() as run").first()["run"]
    told = models.answered(asked, SYSTEM[layer], schema, client).withColumns({"layer": F.lit(layer), "run": F.lit(run), "answered_at": F.current_timestamp()})
    answers = told.observe(wrote, F.count(F.lit(1)).alias("asked"), F.count_if(F.col("payload").isNotNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    spark.sparkContext.setJobDescription(f"{layer}: asking a model for what is not stored")
    try:
        responses.save(answers, store)
    finally:
        spark.sparkContext.setJobDescription(None)
    if totals is not None:
        totals |= {**seen.get, **wrote.get}
    new = spark.read.schema("layer string, cache_key string, payload string, error string, run string").parquet(store).where((F.col("layer") == layer) & (F.col("run") == run))
    fresh = responses.looked_up(new.select("cache_key", "error").withColumnRenamed("error", "failure"), new, schema, valid)
    rows = before.join(fresh.select("cache_key", F.col("response").alias("_new"), "failure", F.lit(True).alias("_asked")), "cache_key", "left")
    broken = F.when(F.col("_asked") & F.col("_new").isNull() & ~F.col("hit"), F.coalesce("failure", F.lit("contract_violation: payload")))
    return rows.select(*wanted.columns, "hit", F.coalesce("_stored", "_new").alias("response"), (~F.col("hit") & F.col("_new").isNotNull()).alias("answered"), broken.alias("error"))


def counters(done: DataFrame) -> DataFrame:
    """A row a manuscript: scenes, cache_hits, written (answered now), failed and skipped (neither stored nor asked)."""
    return done.groupBy("manuscript_id").agg(
        F.count("*").alias("scenes"), F.count_if("hit").alias("cache_hits"), F.count_if("answered").alias("written"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(~F.col("hit") & ~F.col("answered") & F.col("error").isNull()).alias("skipped")
    )


def judge_questions(candidates: DataFrame, scenes: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """manuscript_id, name_a (known before), name_b (new), cache_key and prompt of names that may be one person's.

    candidates: CANDIDATE rows. Similar names share a last word, or one holds the other (similar_pairs()), within a
    manuscript. The prompt has A's first three quotes and an excerpt of the scene that brought B. mentions: (manuscript_id, canonical_name, quote, mention_id, scene_order).
    """
    first = candidates.groupBy("manuscript_id", "canonical_name").agg(F.min(F.struct("scene_order", "pos", "aliases", "role")).alias("x"))
    named = first.select("manuscript_id", "canonical_name", "x.*")
    when = lambda c: named.select("manuscript_id", F.col("canonical_name").alias(f"name_{c}"), F.struct("scene_order", "pos").alias(f"at_{c}"))
    met = similar_pairs(named.select("manuscript_id", F.col("canonical_name").alias("name"))).join(when("a"), ["manuscript_id", "name_a"]).join(when("b"), ["manuscript_id", "name_b"])
    in_order = F.col("at_a") < F.col("at_b")
    pairs = met.select("manuscript_id", F.when(in_order, F.col("name_a")).otherwise(F.col("name_b")).alias("name_a"), F.when(in_order, F.col("name_b")).otherwise(F.col("name_a")).alias("name_b"))
    told = lambda c: named.select("manuscript_id", F.col("canonical_name").alias(f"name_{c}"), F.struct("canonical_name", "aliases", "role").alias(f"who_{c}"), F.col("scene_order").alias(f"order_{c}"))
    rows = pairs.join(told("a"), ["manuscript_id", "name_a"]).join(told("b"), ["manuscript_id", "name_b"])
    rows = rows.join(scenes.select("manuscript_id", F.col("order_narrative_global").cast("long").alias("order_b"), "text"), ["manuscript_id", "order_b"], "left")
    none = F.array().cast("array<string>")
    if mentions is None:
        rows = rows.withColumn("quotes", none)
    else:
        ranked = top_quotes(mentions.withColumn("character_id", F.struct("manuscript_id", "canonical_name")), F.col("scene_order"))
        quotes = ranked.groupBy("character_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda x: x["quote"]).alias("quotes"))
        rows = rows.join(quotes.select("character_id.manuscript_id", F.col("character_id.canonical_name").alias("name_a"), "quotes"), ["manuscript_id", "name_a"], "left")
    prompt = judge_prompt(F.col("who_a"), F.col("who_b"), F.coalesce("text", F.lit("")), F.coalesce("quotes", none))
    return rows.select("manuscript_id", "name_a", "name_b", F.sha2(prompt, 256).alias("cache_key"), prompt.alias("prompt"))


def judgements(questions: DataFrame, client: Callable[[], models.Model]) -> DataFrame:
    """(manuscript_id, name_a, name_b, same_entity, confidence, rationale) for judge_questions(); failed ones are left out."""
    said = models.answered(questions.select("cache_key", "prompt").dropDuplicates(["cache_key"]), SYSTEM["judge"], JUDGEMENT, client)
    answer = said.where("payload is not null").select("cache_key", F.from_json("payload", JUDGEMENT).alias("j")).where("j.same_entity is not null and j.confidence between 0 and 1")
    return questions.join(answer, "cache_key").select("manuscript_id", "name_a", "name_b", "j.same_entity", "j.confidence", "j.rationale")
