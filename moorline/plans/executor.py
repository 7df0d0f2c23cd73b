"""Running a plan: each step is a join or a filter, and Catalyst puts them together.

A row is an entity of the frontier with ord, the order in which it was discovered. Deduplication keeps the first
discovery. Joins are left to the optimiser: small frontiers are broadcast at run time by their measured size.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from moorline.schema.ontology import Ontology

from .ir import Plan, Query, Step
from .planner import build


@dataclass
class Graph:
    """Entities by type (entity_id and properties) and the table links (link, src, dst, ts)."""

    ontology: Ontology
    entities: dict[str, DataFrame]
    links: DataFrame

    def entity(self, type_name: str) -> DataFrame:
        return self.entities[type_name]

    def find(self, entity_id: str) -> DataFrame:
        """An entity of any type by its id, as type, entity_id, properties (JSON)."""
        rows = [by_id(e, (entity_id,)).select(F.lit(t).alias("type"), F.col("entity_id").cast("string").alias("entity_id"), F.to_json(F.struct(*[c for c in e.columns if c != "entity_id"])).alias("properties")) for t, e in self.entities.items()]
        return reduce(DataFrame.unionByName, rows)


def by_id(rows: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The rows with these entity ids, which are compared in the type they are stored in, so that scans can be pruned by them."""
    if isinstance(rows.schema["entity_id"].dataType, IntegralType):
        own = [int(i) for i in ids if re.fullmatch("-?[0-9]{1,18}", i) and str(int(i)) == i]
    else:
        own = list(ids)
    return rows.where(F.col("entity_id").isin(*own) if own else F.lit(False))


def rows_scanned(plan) -> int:
    """Rows that the scans of a physical plan have put out, once it has run; what adaptive execution reuses counts once."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_scanned(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return rows_scanned(plan.plan())
    if name == "ReusedExchangeExec":
        return 0
    children = plan.children()
    if children.isEmpty():
        rows = plan.metrics().get("numOutputRows")
        return rows.get().value() if rows.isDefined() else 0
    return sum(rows_scanned(children.apply(i)) for i in range(children.size()))


@dataclass
class Result:
    """entities: in order of discovery; edges walked; the plan; total(): before the limit."""

    plan: Plan
    entities: DataFrame
    edges: DataFrame
    frontiers: list[DataFrame] = field(default_factory=list)
    everything: DataFrame | None = None
    truncated: list[DataFrame] = field(default_factory=list)

    def total(self) -> int:
        return self.everything.count()

    def to_dict(self, ontology: Ontology) -> dict:
        began = time.perf_counter()
        ordered = self.entities.orderBy("depth", "ord")
        rows = [r.asDict(recursive=True) for r in ordered.collect()]
        scanned = rows_scanned(ordered._jdf.queryExecution().executedPlan())
        edges = [r.asDict() for r in self.edges.collect()]
        total, cut = self.total(), [i for i, t in enumerate(self.truncated, 1) if not t.isEmpty()]
        steps = [{"kind": s.kind, "type": s.target, "access": s.access, "link": s.link, "reverse": s.reverse} for s in self.plan.steps]
        found = [{"id": r["entity_id"], "type": r["type"], "display": r["display"], "depth": r["depth"], "properties": r["properties"]} for r in rows]
        stats = {"elapsed_us": int((time.perf_counter() - began) * 1e6), "truncated_steps": cut, "keys_scanned": scanned, "blocks_read": None}
        return {"entities": found, "edges": edges, "count": len(found), "total_before_limit": total, "_plan": {"steps": steps, "warnings": self.plan.warnings, "index_used": self.plan.headline}, "_stats": stats}


def conditions(step: Step, ontology: Ontology) -> Column:
    of = ontology.type(step.target).properties
    every = [*([step.indexed] if step.indexed else []), *step.residual]
    return reduce(lambda a, b: a & b, [p.column(of[p.prop]) for p in every], F.lit(True))


def start(graph: Graph, query: Query, step: Step) -> DataFrame:
    """entity_id, ord of the start set: by id, or by value and id where an index gave them."""
    rows = graph.entity(query.type).where(conditions(step, graph.ontology))
    if query.ids is not None:
        rows = by_id(rows, query.ids)
    lead = F.col(step.indexed.prop).cast("string") if step.access in ("IDX_RANGE", "IDX_PREFIX") and graph.ontology.property(query.type, step.indexed.prop).kind == "string" else F.lit("")
    value = F.col(step.indexed.prop).cast("double") if step.access == "IDX_RANGE" and graph.ontology.property(query.type, step.indexed.prop).kind != "timestamp" else F.unix_micros(F.col(step.indexed.prop).cast("timestamp")).cast("double") if step.access == "IDX_RANGE" else F.lit(0.0)
    return rows.select("entity_id", F.array(F.struct(lead.alias("text"), value.alias("number"), F.col("entity_id").cast("string").alias("id"))).alias("ord"))


def hop(graph: Graph, frontier: DataFrame, step: Step) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next frontier, the edges walked, and, if max_expand cut it, a row."""
    near, far = ("dst", "src") if step.reverse else ("src", "dst")
    edges = graph.links.where(F.col("link") == step.link)
    if step.window:
        edges = edges.where(step.window.column(F.col("ts")))
    walked = frontier.join(edges, F.col("entity_id") == F.col(near))
    by_time = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")).cast("double"), F.lit(0.0)) if step.access == "TIDX" else F.lit(0.0)
    reached = walked.select(F.col(far).alias("entity_id"), F.concat("ord", F.array(F.struct(F.lit("").alias("text"), by_time.alias("number"), F.col(far).cast("string").alias("id")))).alias("ord"), F.col("src"), F.col("dst"))
    first = reached.groupBy("entity_id").agg(F.min("ord").alias("ord"))
    # A top-k, not a full sort; one row more than allowed tells whether there were more.
    kept = first.orderBy("ord").limit(step.max_expand)
    cut = first.orderBy("ord").limit(step.max_expand + 1).offset(step.max_expand)
    if step.residual:
        test = graph.entity(step.target).where(conditions(step, graph.ontology)).select("entity_id")
        kept = kept.join(test, "entity_id", "left_semi")
    walked_edges = reached.select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), F.lit(step.link).alias("link"), F.lit(step.reverse).alias("reverse"))
    return kept, walked_edges, cut


def materialised(graph: Graph, frontier: DataFrame, type_name: str, depth: int, query: Query) -> DataFrame:
    """The frontier's entities: entity_id, type, display, depth, properties (JSON, as selected), ord."""
    of = graph.ontology.type(type_name)
    chosen = [s.split(".")[1] for s in query.select if s.split(".")[0] == type_name] if query.select else list(of.properties)
    rows = frontier.join(graph.entity(type_name), "entity_id")
    properties = F.to_json(F.struct(*chosen)) if chosen else F.lit("{}")
    return rows.select(F.col("entity_id").cast("string").alias("entity_id"), F.lit(type_name).alias("type"), of.display_column().alias("display"), F.lit(depth).alias("depth"), properties.alias("properties"), "ord")


def run(graph: Graph, query: Query, plan: Plan | None = None) -> Result:
    plan = plan or build(query, graph.ontology)
    frontier = start(graph, query, plan.steps[0])
    frontiers, edges, cuts = [frontier], [], []
    for step in plan.steps[1:]:
        frontier, walked, cut = hop(graph, frontier, step)
        frontiers.append(frontier)
        edges.append(walked)
        cuts.append(cut)
    depths = range(len(frontiers)) if query.include_path else [len(frontiers) - 1]
    parts = [materialised(graph, frontiers[d], plan.steps[d].target, d, query) for d in depths]
    everything = reduce(DataFrame.unionByName, parts)
    limited = everything.orderBy("depth", "ord", "entity_id").limit(query.limit)
    none = graph.links.select(F.col("src").cast("string").alias("from"), F.col("dst").cast("string").alias("to"), "link", F.lit(False).alias("reverse")).limit(0)
    walked = reduce(DataFrame.unionByName, edges, none).distinct()
    shown = limited.select(F.col("entity_id").alias("id"))
    touching = walked.join(shown.withColumnRenamed("id", "from"), "from", "left_semi").union(walked.join(shown.withColumnRenamed("id", "to"), "to", "left_semi").select("from", "to", "link", "reverse")).distinct()
    return Result(plan, limited, touching, frontiers, everything, cuts)
