"""The service surface as plain functions: each answers with a DataFrame or a JSON-ready dict, from one pinned snapshot."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.operators import ingest, lineage
from moorline.plans import executor, planner
from moorline.plans.ir import DEFAULT_LIMIT, MAX_LIMIT, Predicate, Query, RequestError
from moorline.schema.mapping import Bundle
from moorline.schema.ontology import SchemaError
from moorline.tables import Store

REVIEW_LIMIT, REVIEW_MAX = 50, 1000


def status_of(error: Exception) -> int:
    """The HTTP status that an error stands for."""
    if isinstance(error, (LookupError, FileNotFoundError)):
        return 404
    return 400 if isinstance(error, (RequestError, SchemaError, ValueError)) else 500


class Service:
    """Requests on a store as it is when the service is made; refresh() moves on to the latest publication."""

    def __init__(self, store: Store, bundle: Bundle):
        self.store, self.bundle = store, bundle
        self.refresh()

    def refresh(self) -> None:
        self.at = self.store.snapshot()
        types = [t for t in self.bundle.ontology.types if self.at.has(f"entity_{t}")]
        self.entities = {t: self.at.table(f"entity_{t}") for t in types}

    @property
    def graph(self) -> executor.Graph:
        return executor.Graph(self.bundle.ontology, self.entities, self.at.table("links"))

    # Schema and entities

    def ontology(self) -> dict[str, Any]:
        of = self.bundle.ontology
        properties = lambda t: [{"name": p.name, "type": p.kind, "indexed": p.indexed, "title": p.title, "fuse": p.fuse} for p in t.properties.values()]
        return {"version": of.version, "types": [{"id": t.id, "name": t.name, "display": t.display, "properties": properties(t)} for t in of.types.values()], "links": [{"id": x.id, "name": x.name, "from": x.source, "to": x.target, "inverse": x.inverse, "cardinality": x.cardinality, "time_index": x.time_index} for x in of.links.values()]}

    def list_entities(self, type_name: str, q: str | None = None, limit: int = DEFAULT_LIMIT, **equal: str) -> DataFrame:
        """Entities whose title begins with q and whose properties equal the others."""
        of = self.bundle.ontology.type(type_name)
        if not 1 <= limit <= MAX_LIMIT:
            raise RequestError(f"limit must be from 1 to {MAX_LIMIT}")
        tests = [Predicate(k, "eq", v).column(self.bundle.ontology.property(type_name, k)) for k, v in equal.items()]
        if q is not None:
            if of.title is None:
                raise RequestError(f"{type_name} has no title to search")
            tests.append(Predicate(of.title.name, "starts_with", q).column(of.title))
        rows = self.entities[type_name].where(reduce(lambda a, b: a & b, tests, F.lit(True)))
        return rows.withColumn("display", of.display_column()).orderBy("entity_id").limit(limit)

    def entity(self, entity_id: str) -> dict[str, Any]:
        """An entity of any type, with a summary of where its values come from."""
        found = self.graph.find(entity_id).first()
        if found is None:
            raise LookupError(f"no entity {entity_id}")
        told = self.provenance(entity_id).select("prop", "rule", "confidence", "cluster_size", F.size("rejected").alias("rejected")).orderBy("prop")
        return {**found.asDict(), "provenance": [r.asDict() for r in told.collect()]}

    def by_value(self, type_name: str, prop: str) -> DataFrame:
        """Every entity that has a property, in the order of its values."""
        self.bundle.ontology.property(type_name, prop)
        return self.entities[type_name].where(F.col(prop).isNotNull()).orderBy(prop, "entity_id")

    def links_of(self, entity_id: str, link: str | None = None) -> DataFrame:
        """An entity's edges in both directions: link, other, reverse, ts."""
        every = self.at.table("links")
        if link is not None:
            every = every.where(F.col("link") == self.bundle.ontology.link(link)[0].name)
        out = every.where(F.col("src") == entity_id).select("link", F.col("dst").alias("other"), F.lit(False).alias("reverse"), "ts")
        return out.unionByName(every.where(F.col("dst") == entity_id).select("link", F.col("src").alias("other"), F.lit(True).alias("reverse"), "ts"))

    # Traversals

    def traverse(self, request: str | dict) -> dict[str, Any]:
        return executor.run(self.graph, Query.from_json(request)).to_dict(self.bundle.ontology)

    def explain(self, request: str | dict) -> dict[str, Any]:
        """The plan alone; nothing runs."""
        plan = planner.build(Query.from_json(request), self.bundle.ontology)
        return {"plan": plan.render(), "index_used": plan.headline, "warnings": plan.warnings}

    # Lineage

    def provenance(self, entity_id: str, prop: str | None = None) -> DataFrame:
        rows = self.at.table("provenance").where(F.col("entity_id") == entity_id)
        return rows if prop is None else rows.where(F.col("prop") == prop)

    def lineage(self, entity_id: str, prop: str | None = None) -> DataFrame:
        """Values explained down to the raw cell, and replayed."""
        return lineage.explained(self.provenance(entity_id, prop), self.at.table("raw"), self.at.table("ingest_manifest"), self.bundle)

    def round_trip(self) -> dict[str, Any]:
        every = lineage.explained(self.at.table("provenance"), self.at.table("raw"), self.at.table("ingest_manifest"), self.bundle)
        return lineage.round_trip(every).first().asDict()

    def raw(self, source_id: int, batch_id: int, row_seq: int) -> str:
        row = self.at.table("raw").where((F.col("source_id") == source_id) & (F.col("batch_id") == batch_id) & (F.col("row_seq") == row_seq)).first()
        if row is None:
            raise LookupError(f"no row {source_id}/{batch_id}/{row_seq}")
        return row.raw

    def raw_batch(self, source_id: int, batch_id: int) -> DataFrame:
        return self.at.table("raw").where((F.col("source_id") == source_id) & (F.col("batch_id") == batch_id)).orderBy("row_seq")

    def entity_of(self, source_id: int, natural_key: str) -> DataFrame:
        """The entities that a source's record went into."""
        return self.at.table("xref").where((F.col("source_id") == source_id) & (F.col("key_hash") == F.xxhash64(F.lit(natural_key))))

    # Reviews

    def review(self, limit: int = REVIEW_LIMIT) -> DataFrame:
        """Pairs between the thresholds that nobody has decided on, the likeliest first."""
        if not 1 <= limit <= REVIEW_MAX:
            raise RequestError(f"limit must be from 1 to {REVIEW_MAX}")
        queue = self.at.table("review_queue")
        if self.at.has("review_decisions"):
            queue = queue.join(self.at.table("review_decisions").select("pair_id"), "pair_id", "left_anti")
        return queue.orderBy(F.desc("score"), "pair_id").limit(limit)

    def decide(self, pair_id: int, decision: str, reviewer: str) -> None:
        """Keeps a reviewer's word in a table that resolution never clears."""
        if decision not in ("accept", "reject"):
            raise RequestError("a decision is accept or reject")
        if self.at.table("review_queue").where(F.col("pair_id") == pair_id).isEmpty():
            raise LookupError(f"no pair {pair_id}")
        said = self.store.spark.range(1).select(F.lit(pair_id).alias("pair_id"), F.lit(decision).alias("decision"), F.lit(reviewer).alias("reviewer"), F.current_timestamp().alias("at"))
        self.store.publish(append={"review_decisions": said})
        self.refresh()

    # Counts

    def stats(self) -> dict[str, Any]:
        """Entities by type, source records, the share that resolution merged, and the sources' batches."""
        counts = {t: e.count() for t, e in self.entities.items()}
        records = self.at.table("xref").count() if self.at.has("xref") else 0
        merged = 0.0 if not records else 1 - sum(counts.values()) / records
        return {"entities": counts, "source_records": records, "dedup_ratio": merged, "sources": [r.asDict() for r in ingest.source_stats(self.at).orderBy("source_id").collect()]}

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "version": self.at.version}
