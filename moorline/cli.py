"""Commands: schema, ingest, stats, block, resolve, eval, query, explain, lineage, review, serve. Run as python -m moorline.cli."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline import serve
from moorline.api import Service, status_of
from moorline.operators import blocking, cluster, evaluate, ingest, lineage, mapping, resolve, scoring
from moorline.schema.mapping import Bundle
from moorline.stage import materialise
from moorline.tables import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="moorline", description=__doc__)
    out.add_argument("--ontology", required=True)
    out.add_argument("--mappings", required=True)
    out.add_argument("--store", required=True)
    out.add_argument("--root", default=".")
    to = out.add_subparsers(dest="command", required=True)
    to.add_parser("schema")
    to.add_parser("stats")
    to.add_parser("review")
    own = to.add_parser("ingest")
    own.add_argument("source")
    own.add_argument("--force", action="store_true")
    own.add_argument("--limit", type=int)
    own = to.add_parser("resolve")
    own.add_argument("--config")
    own.add_argument("--dry-run", action="store_true")
    own.add_argument("--max-block", type=int, default=blocking.MAX_BLOCK)
    own.add_argument("--cross-source-only", action="store_true")
    own = to.add_parser("block")
    own.add_argument("--max-block", type=int, default=blocking.MAX_BLOCK)
    own.add_argument("--cross-source-only", action="store_true")
    own = to.add_parser("eval")
    own.add_argument("golden")
    own.add_argument("--config")
    own = to.add_parser("serve")
    own.add_argument("--host", default="127.0.0.1")
    own.add_argument("--port", type=int, default=8080)
    for name in ("query", "explain"):
        to.add_parser(name).add_argument("request")
    own = to.add_parser("lineage")
    own.add_argument("entity")
    own.add_argument("prop", nargs="?")
    return out


def run(args: argparse.Namespace, spark: SparkSession) -> object:
    """What a command prints: a dict or a text."""
    bundle, store = Bundle.read(args.ontology, args.mappings), Store(spark, args.store)
    if args.command == "ingest":
        done = ingest.ingest_source(store, bundle, bundle.sources[args.source], args.root, force=args.force, limit=args.limit)
        return [{"batch": o.batch_id, "skipped": o.skipped, **o.counts} for o in done]
    if args.command == "block":
        return blocked(store, bundle, args.max_block, args.cross_source_only)
    if args.command in ("resolve", "eval"):
        at = store.snapshot()
        config = scoring.Config.read(args.config) if args.config else None
        if args.command == "eval":
            of = resolve.resolve(at.table("cells"), at.table("link_refs"), bundle, config)
            golden = evaluate.golden_pairs(bundle, Path(args.golden), spark)
            return {"pairs": [r.asDict() for r in evaluate.evaluate(of.scored, golden).orderBy("split").collect()], "blocking": blocking.coverage(of.scored, golden).first().asDict(recursive=True), "clusters": cluster.metrics(of.clusters, golden, of.refused).first().asDict()}
        of = resolve.resolve(at.table("cells"), at.table("link_refs"), bundle, config, max_block=args.max_block, cross_source_only=args.cross_source_only)
        if not args.dry_run:
            resolve.publish(store, of)
        return {**scoring.decision_counts(of.scored).first().asDict(), "links": [r.asDict() for r in of.link_report.collect()]}
    service = Service(store, bundle)
    if args.command == "serve":
        serve.forever(service, args.host, args.port)
        return {}
    if args.command == "lineage":
        return "\n".join(lineage.render(r) for r in service.lineage(args.entity, args.prop).orderBy("prop").collect())
    if args.command == "review":
        return [r.asDict(recursive=True) for r in service.review().collect()]
    return {"schema": service.ontology, "stats": service.stats, "query": lambda: service.traverse(args.request), "explain": lambda: service.explain(args.request)}[args.command]()


def blocked(store: Store, bundle: Bundle, max_block: int, cross_source_only: bool) -> dict:
    """What blocking does, without scoring: keys, blocks, pairs by generator, the reduction."""
    now = materialise(mapping.latest(store.snapshot().table("cells")), "cells")
    types = [r[0] for r in now.select("type").distinct().orderBy("type").collect()]  # bounded by the ontology
    keys = materialise(reduce(DataFrame.unionByName, [blocking.blocking_keys(mapping.records(now, bundle.ontology, t), t) for t in types]), "keys")
    pairs = materialise(blocking.candidate_pairs(keys, max_block, cross_source_only), "candidates")
    sizes = now.select("type", "source_id", "key_hash").distinct().groupBy("type").agg(F.count("*").alias("n"))
    return {**blocking.block_stats(keys, max_block).first().asDict(), **blocking.reduction(pairs, sizes).first().asDict(), "by_generator": {r.generator: r.pairs for r in blocking.pairs_by_generator(pairs).collect()}}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("moorline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        told = run(args, spark)
    except Exception as e:
        if status_of(e) == 500:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(told if isinstance(told, str) else json.dumps(told, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
