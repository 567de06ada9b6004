"""A registry that grows: candidates are resolved as their scenes come, and the registry of each manuscript is the state.

The fold needs its candidates in narrative order. Within a batch they are put in order; one that comes late, before what
was resolved already, sets its manuscript back: all its candidates are folded again, and its rows get a new generation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomtext.operators import resolution
from loomtext.operators.resolution import CHANGED, RESOLVED, Registry, Told

PREPARED = (
    "manuscript_id string, scene_order long, pos long, canonical_name string, role string, entity_kind string, filtered boolean, split struct<honorific:string,base:string>, "
    "forms array<struct<alias:string,honorific:string,base:string,valid:boolean>>, told array<struct<other:string,status:string,same_entity:boolean,confidence:double,rationale:string,auto:boolean>>"
)
OUT = f"{RESOLVED}, {CHANGED}, generation int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(candidates: DataFrame, decisions: DataFrame | None = None, judgements: DataFrame | None = None) -> DataFrame:
    """PREPARED rows for CANDIDATE rows: set-based rules decided, and what is known of each name and others as an array."""
    rows = resolution.with_forms(candidates)
    kind = next(f.dataType for f in candidates.sparkSession.createDataFrame([], PREPARED).schema.fields if f.name == "told")
    if judgements is None:
        rows = rows.withColumn("told", F.array().cast(kind))
    else:
        said = resolution.told_pairs(candidates.sparkSession, decisions, judgements)
        way = lambda a, b: said.select("manuscript_id", F.col(a).alias("canonical_name"), F.struct(F.col(b).alias("other"), "status", "same_entity", "confidence", "rationale", "auto").alias("x"))
        listed = way("name_a", "name_b").unionAll(way("name_b", "name_a")).groupBy("manuscript_id", "canonical_name").agg(F.collect_list("x").alias("told"))
        rows = rows.join(listed, ["manuscript_id", "canonical_name"], "left").withColumn("told", F.coalesce(F.col("told").cast(kind), F.array().cast(kind)))
    forms = F.transform("forms", lambda x: F.struct(x["alias"].alias("alias"), x["honorific"].alias("honorific"), x["base"].alias("base"), x["valid"].alias("valid")))
    return rows.withColumn("forms", forms).select(*[c.split()[0] for c in PREPARED.split(", ") if " " in c])


def _plain(row: Any) -> dict:
    """A PREPARED row as JSON can hold it."""
    each = lambda items, names: [{n: x[n] for n in names} for x in (items if items is not None else ())]
    return {
        "scene_order": int(row.scene_order), "pos": int(row.pos), "canonical_name": row.canonical_name, "role": row.role, "entity_kind": row.entity_kind, "filtered": bool(row.filtered),
        "split": {n: row.split[n] for n in ("honorific", "base")}, "forms": each(row.forms, ("alias", "honorific", "base", "valid")),
        "told": each(row.told, ("other", "status", "same_entity", "confidence", "rationale", "auto")),
    }


def _known(candidates: list[dict]) -> dict[str, dict[str, Told]]:
    """What fold() is told, from all candidates there are: a decision goes before an answer."""
    out: dict[str, dict[str, Told]] = {}
    for c in candidates:
        for x in c["told"]:
            decided, about = x["status"] is not None, out.setdefault(c["canonical_name"], {})
            if decided or x["other"] not in about:
                about[x["other"]] = Told(status=x["status"]) if decided else Told(None, bool(x["same_entity"]), x["confidence"], x["rationale"], bool(x["auto"]))
    return out


class Growing(StatefulProcessor):
    """State of a manuscript: its registry with the moment it stands at, and all its candidates, for when one comes late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stands = handle.getValueState("stands", "registry string, scene_order long, pos long, generation int")
        self.seen = handle.getMapState("candidates", "scene_order long, pos long", "candidate string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = {(c["scene_order"], c["pos"]): c for frame in rows for c in map(_plain, frame.itertuples())}
        if not new:
            return
        before = self.stands.get() if self.stands.exists() else None
        for moment, c in new.items():
            self.seen.updateValue(moment, (json.dumps(c),))
        late = before is not None and min(new) <= (before[1], before[2])
        registry = Registry()
        if before is not None and not late:
            held = json.loads(before[0])
            registry = Registry(held["entries"], held["forms"], {k: tuple(v) for k, v in held["splits"].items()})
        todo = [json.loads(v[0]) for v in self.seen.values()] if late else list(new.values())
        found, registry = resolution.fold(pd.DataFrame(todo), _known(todo), registry)
        generation = 0 if before is None else before[3] + int(late)
        end = max((c["scene_order"], c["pos"]) for c in todo)
        self.stands.update((json.dumps({"entries": registry.entries, "forms": registry.forms, "splits": registry.splits}), *end, generation))
        columns = [x.split()[0] for x in f"{RESOLVED}, linked_name x, written x, known_aliases x, generation x".split(", ")]
        yield pd.DataFrame([(key[0], *r, generation) for r in found], columns=columns)

    def close(self) -> None:
        pass


def resolve_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Resolve PREPARED rows (Parquet files of a folder) until the folder is drained; rows of OUT go to one folder a batch.

    State is kept by RocksDB, so a registry need not fit with all others in memory; the setting holds for this query. A
    batch that is run twice overwrites its folder.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        grown = spark.readStream.schema(PREPARED).parquet(source).groupBy("manuscript_id").transformWithStateInPandas(Growing(), OUT, "Append", "None")
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}")
        return grown.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def resolved_so_far(spark: SparkSession, target: str) -> DataFrame:
    """The rows of each manuscript's last generation."""
    rows = spark.read.schema(f"{OUT}, batch int").parquet(target)
    last = rows.groupBy("manuscript_id").agg(F.max("generation").alias("generation"))
    return rows.join(last, ["manuscript_id", "generation"]).drop("batch", "generation")
