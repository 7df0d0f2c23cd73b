"""Ingestion: rows of a source into raw, cells, link references and a manifest, once for each content."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moorline.schema.mapping import Bundle, Source
from moorline.sources import rows as readers
from moorline.tables import Snapshot, Store

from .mapping import map_rows

MANIFEST = "source_id int, batch_id bigint, source_key string, uri string, endpoint string, header array<string>, fingerprint string, started timestamp, finished timestamp, rows_read bigint, rows_filtered bigint, records_written bigint, properties_written bigint, properties_rejected bigint"


@dataclass(frozen=True)
class Outcome:
    batch_id: int | None
    skipped: bool
    counts: dict[str, int]


def latest_batch(at: Snapshot, source_id: int) -> int:
    if not at.has("ingest_manifest"):
        return 0
    return at.table("ingest_manifest").where(F.col("source_id") == source_id).agg(F.max("batch_id")).first()[0] or 0


def batches(at: Snapshot, source_id: int) -> DataFrame:
    return at.table("ingest_manifest").where(F.col("source_id") == source_id).orderBy("batch_id")


def ingest(store: Store, bundle: Bundle, source: Source, rows: DataFrame, fingerprint: str = "", *, endpoint: str | None = None, header: list[str] | None = None, force: bool = False, limit: int | None = None) -> Outcome:
    """Adds one batch. A content that has been ingested whole is skipped unless forced; an empty fingerprint never is.

    A limited run is a batch of its own, whose fingerprint isn't kept, so the full run after it isn't skipped.
    """
    at = store.snapshot()
    if fingerprint and not force and at.has("ingest_manifest"):
        seen = at.table("ingest_manifest").where((F.col("source_id") == source.source_id) & (F.col("fingerprint") == fingerprint) & F.col("endpoint").eqNullSafe(F.lit(endpoint)))
        if not seen.isEmpty():
            return Outcome(None, True, {})
    batch = latest_batch(at, source.source_id) + 1
    started = datetime.now(UTC)
    taken = rows if limit is None else rows.where(F.col("row_seq") <= limit)
    mapped = map_rows(taken, source, batch, bundle.ontology, endpoint)
    # Only rows that give a record are kept raw: of the others nothing refers to it.
    raw = mapped.kept.select(F.lit(source.source_id).alias("source_id"), F.lit(batch).cast("bigint").alias("batch_id"), "row_seq", "raw")
    counts = taken.agg(F.count("*").alias("rows_read"), F.count_if(mapped.records.isNull()).alias("rows_filtered"), F.coalesce(F.sum(mapped.records), F.lit(0)).alias("records_written")).first().asDict()
    counts |= mapped.cells.agg(F.count_if(F.col("error").isNull()).alias("properties_written"), F.count_if(F.col("error").isNotNull()).alias("properties_rejected")).first().asDict()
    line = (source.source_id, batch, source.id, source.uri, endpoint, header, fingerprint if limit is None else "", started, datetime.now(UTC), counts["rows_read"], counts["rows_filtered"], counts["records_written"], counts["properties_written"], counts["properties_rejected"])
    manifest = store.spark.createDataFrame([line], MANIFEST)
    store.publish(append={"raw": raw, "cells": mapped.cells, "link_refs": mapped.refs, "ingest_manifest": manifest})
    return Outcome(batch, False, counts)


def ingest_source(store: Store, bundle: Bundle, source: Source, root: str = ".", **options) -> list[Outcome]:
    """Reads a source by its connector and ingests it; of a snapshot folder one batch for each endpoint that a mapping uses."""
    spark = store.spark
    if source.connector == "csv":
        path = f"{root}/{source.uri}"
        with open(path, encoding="utf-8-sig", newline="") as f:
            header = readers.csv_header(f.read(1 << 20))
        return [ingest(store, bundle, source, readers.read_csv(spark, path), readers.fingerprint_file(path), header=header, **options)]
    if source.connector == "http":
        out = []
        for endpoint in dict.fromkeys(m.endpoint for m in source.mappings if m.endpoint):
            rows = readers.read_snapshot(spark, f"{root}/{source.snapshot_dir}", endpoint, source.columns(), source.endpoints.get(endpoint))
            out.append(ingest(store, bundle, source, rows, readers.fingerprint_file(f"{root}/{source.snapshot_dir}/{endpoint}.json"), endpoint=endpoint, **options))
        return out
    if source.connector == "postgres":
        rows = readers.read_jdbc(spark, source.dsn or "", source.query or "", source.params, source.fetch_size)
        return [ingest(store, bundle, source, rows, readers.fingerprint_rows(rows), **options)]
    raise ValueError(f"{source.id}: rows of a {source.connector} source are given to ingest() itself")


def source_stats(at: Snapshot) -> DataFrame:
    """Per source: batches, raw rows, records, the latest batch."""
    raw = at.table("raw").groupBy("source_id").agg(F.countDistinct("batch_id").alias("batches"), F.count("*").alias("raw_rows"), F.max("batch_id").alias("latest_batch"))
    records = at.table("cells").groupBy("source_id").agg(F.countDistinct("type", "key_hash").alias("records"))
    return raw.join(records, "source_id", "left").select("source_id", "batches", "raw_rows", F.coalesce("records", F.lit(0)).alias("records"), "latest_batch")
