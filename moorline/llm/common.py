"""What several operators share: the shared folder, written stages, Arrow limits, graph components."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.operators.graph import components
from moorline.stage import discard, materialise, remove, shared_dir, ship

from .tokens import give_back, release

__all__ = ["append", "components", "discard", "free_name", "give_back", "keep", "large_batches", "materialise", "open_fs", "release", "remove", "shared_dir", "ship", "to_batch", "tune", "write_bytes"]

#: Rows and bytes of one Arrow batch handed to Python; both bound a worker's memory, however long texts are.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Ships the package, and bounds Arrow batches by rows and bytes, so that long texts cannot fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path on it, usable on executors."""
    return pafs.FileSystem.from_uri(uri)


def write_bytes(folder: str, name: str, chunks) -> tuple[str, int]:
    """Writes chunks to a file of the shared folder: first under another name, then renamed, so no half file shows."""
    filesystem, root = open_fs(folder)
    filesystem.create_dir(root, recursive=True)
    final = posixpath.join(root, name)
    part = f"{final}.{uuid.uuid4().hex}.tmp"
    n = 0
    with filesystem.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    filesystem.move(part, final)
    return f"{folder}/{name}", n


def keep(table: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return table.select(*[F.col(f"`{n}`") for n in names])


def large_batches(batches, schema: pa.Schema):
    """Record batches of rows given as tuples, at most BATCH_ROWS in each."""
    rows: list[tuple] = []
    for row in batches:
        rows.append(row)
        if len(rows) >= BATCH_ROWS:
            yield to_batch(rows, schema)
            rows = []
    if rows:
        yield to_batch(rows, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append(df: DataFrame, column: str, make, kind: str) -> tuple[DataFrame, str]:
    """df with one more column, which make(list of values of column) gives for each batch, and that column's name.

    Rows pass through with all their columns, evaluated once; kind is the new column's type as in SQL.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    name = free_name(df, "made")
    made = _parse_datatype_string(f"x {kind}").fields[0].dataType
    schema = StructType([*[StructField(f.name, f.dataType, True) for f in df.schema], StructField(name, made, True)])
    arrow = to_arrow_type(made)

    def run(batches):
        release()
        function = make() if getattr(make, "per_task", False) else make
        for batch in batches:
            at = batch.schema.names.index(column)
            new = pa.array(function(batch.column(at).to_pylist()), type=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])
            del batch, new
        give_back()

    return df.mapInArrow(run, schema), name
