"""Works whose layers are made from frozen responses: no model is asked, and what is not frozen is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.errors import NotMeasured
from loomtext.operators import evidence
from loomtext.plans import ingest, layers
from loomtext.sources.staging import shared_folder, staged

LAYERS = ("characters", "relations", "attributes")


def seeded(spark: SparkSession, folder: str, works: dict[str, tuple[str, ...]], frozen: DataFrame, model: str, versions: dict[str, tuple[str, str]] | None = None) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """({file: manuscript_id}, tables of the raw layer and of the layers that each work asks for).

    works: files of the folder with their LAYERS, each of which needs characters; frozen: (cache_key, payload); versions: prompt and schema
    version of a layer, "1" and "1" if it has none. A scene without a frozen response is an error that names it, so
    that a gate never scores half a work. Ids follow from contents: seeding again gives the same rows.
    """
    version = lambda layer: (versions or {}).get(layer, ("1", "1"))
    tables = ingest.ingest(spark, f"{folder}/{{{','.join(works)}}}", f"{shared_folder(spark)}/seed")
    ids = {r["source_id"].rpartition("/")[2]: r["manuscript_id"] for r in tables["manuscript"].select("source_id", "manuscript_id").collect()}
    own = lambda layer: tables["scene"].where(F.col("manuscript_id").isin([ids[f] for f, asked in works.items() if layer in asked]))

    def whole(looked: DataFrame, layer: str) -> DataFrame:
        missed = [r["scene_id"] for r in looked.where("not hit").select("scene_id").orderBy("scene_id").take(5)]
        if missed:
            raise NotMeasured(f"{layer}: no frozen response for {', '.join(missed)}")
        return looked

    looked = staged(layers.extractions(layers.keyed(own("characters"), model, *version("characters")), frozen), "seed-characters")
    tables |= layers.character_layer(whole(looked, "characters"), keep=staged)
    casts = staged(evidence.scene_casts(tables["appears_in"], tables["character"]), "seed-casts")
    for layer, least, lookup in (("relations", 2, layers.relations_looked_up), ("attributes", 1, layers.attributes_looked_up)):
        asked = staged(lookup(layers.keyed(own(layer), model, *version(layer), casts, least), frozen), f"seed-{layer}")
        made = layers.relation_tables if layer == "relations" else layers.attribute_tables
        tables |= {k: v for k, v in made(whole(asked, layer)).items() if k != "quarantine"}
    return ids, tables
