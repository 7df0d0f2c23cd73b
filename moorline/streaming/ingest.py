"""Structured Streaming ingestion: new files of a folder are batches, each published once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moorline.operators.ingest import ingest
from moorline.schema.mapping import Bundle, Source
from moorline.sources.rows import numbered
from moorline.tables import Store


def follow(store: Store, bundle: Bundle, source: Source, folder: str, columns: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Ingests JSON-lines files of a folder as they come. A micro-batch that runs again after a failure is known by its
    number, which is its fingerprint, so it isn't added twice."""
    stream = store.spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).json(folder)

    def add(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        cells = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in columns]), lambda x: x["value"].isNotNull()))
        rows = numbered(batch.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("raw"), cells.alias("fields")))
        ingest(store, bundle, source, rows, f"{checkpoint}#{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
