"""The whole resolution: latest cells, candidates, scores, clusters both ways, fusion, links, and the report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.schema.mapping import Bundle
from moorline.stage import materialise, ship
from moorline.tables import Store

from . import blocking, cluster, fusion, links, mapping, scoring


@dataclass
class Resolution:
    keys: DataFrame
    scored: DataFrame
    transitive: DataFrame
    clusters: DataFrame
    refused: DataFrame
    provenance: DataFrame
    entities: dict[str, DataFrame]
    xref: DataFrame
    links: DataFrame
    link_report: DataFrame


def resolve(cells: DataFrame, refs: DataFrame, bundle: Bundle, config: scoring.Config | None = None, *, max_block: int = blocking.MAX_BLOCK, cross_source_only: bool = False, decisions: DataFrame | None = None) -> Resolution:
    """Resolves all records. With decisions, reviewers' words on pairs count; without, as by default, they don't."""
    ship(cells.sparkSession)
    blocking.bind(bundle.ontology)
    now = materialise(mapping.latest(cells), "cells")
    types = list(bundle.ontology.types)
    records = {t: materialise(mapping.records(now, bundle.ontology, t), "records") for t in types}
    keys = materialise(reduce(DataFrame.unionByName, [blocking.blocking_keys(records[t], t) for t in types]), "keys")
    pairs = materialise(blocking.candidate_pairs(keys, max_block, cross_source_only), "candidates")
    scored = reduce(DataFrame.unionByName, [scoring.score_pairs(pairs, records[t], t, config) for t in types])
    if decisions is not None:
        scored = scoring.apply_reviews(scored, decisions)
    scored = materialise(scored, "scored")
    every = reduce(DataFrame.unionByName, [records[t].select(F.lit(t).alias("type"), F.struct("source_id", "key_hash").alias("ref")) for t in types])
    clusters, refused = cluster.constrained(scored, every)
    clusters = materialise(clusters, "clusters")
    provenance = materialise(fusion.fuse(now, clusters, bundle.ontology, {s.source_id: s.trust for s in bundle.sources.values()}), "provenance")
    entities = {t: materialise(fusion.entities(provenance, clusters, bundle.ontology, t), "entities") for t in types}
    xref = fusion.xref(clusters)
    current = refs.join(now.select("source_id", "type", "key_hash", "batch_id", "row_seq").distinct(), ["source_id", "type", "key_hash", "batch_id", "row_seq"], "left_semi")
    resolved = materialise(links.resolve_links(current, xref, entities, bundle.ontology), "links")
    return Resolution(keys, scored, cluster.transitive(scored, every), clusters, refused, provenance, entities, xref, links.edges(resolved), links.link_report(resolved))


def publish(store: Store, of: Resolution) -> None:
    """All derived tables become visible together; what was ingested, and reviews, stay."""
    tables = {"provenance": of.provenance, "xref": of.xref, "links": links.laid_out(of.links), "review_queue": scoring.review_queue(of.scored)}
    store.publish(replace={**tables, **{f"entity_{t}": e.orderBy("entity_id") for t, e in of.entities.items()}})
