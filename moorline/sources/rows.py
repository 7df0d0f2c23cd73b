"""Readers. Each gives rows of row_seq (dense, from 1), raw (the verbatim record) and fields (column or path to text).

A column that a row lacks isn't in fields; one that is there without a value is an empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.stage import materialise

SCHEMA = "row_seq bigint, raw string, fields map<string,string>"
#: Bytes of one file that are hashed at a time.
CHUNK = 256 << 10


def split_csv(text: str) -> Iterator[tuple[str, list[str]]]:
    """Records of CSV text with their verbatim text: quotes may hold commas, line ends and doubled quotes."""
    text = text.removeprefix("﻿")
    fields, cell, start, at, n = [], [], 0, 0, len(text)
    special = re.compile('[",\r\n]')
    quoted = False
    while at < n:
        if quoted:
            end = text.find('"', at)
            if end < 0:
                cell.append(text[at:])
                at = n
            elif text.startswith('""', end):
                cell.append(text[at : end + 1])
                at = end + 2
            else:
                cell.append(text[at:end])
                at, quoted = end + 1, False
            continue
        m = special.search(text, at)
        end = m.start() if m else n
        cell.append(text[at:end])
        if m is None:
            at = n
            break
        c = m.group()
        at = end + 1
        if c == '"':
            if "".join(cell):
                cell.append('"')  # a quote inside a bare cell is text
            else:
                quoted = True
        elif c == ",":
            fields.append("".join(cell))
            cell = []
        else:
            if c == "\r" and text.startswith("\n", at):
                at += 1
            if fields or "".join(cell) or text[start:end]:
                yield text[start:end], [*fields, "".join(cell)]
            fields, cell, start = [], [], at
    if text[start:]:
        yield text[start:], [*fields, "".join(cell)]


def csv_header(text: str) -> list[str]:
    return next((f for _, f in split_csv(text)), [])


def _named(header: Sequence[str], cells: Sequence[str]) -> dict[str, str]:
    """Cells by column: the first of equal names counts, and short rows read as empty."""
    out: dict[str, str] = {}
    for i, name in enumerate(header):
        out.setdefault(name, cells[i] if i < len(cells) else "")
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file (or several, each with its header): whole files are split, so quoted line ends are safe.

    For single files beyond memory, cut them before: quotes make a record's end unknown without what is before it.
    """
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        for batch in batches:
            for text in batch["value"]:
                records = split_csv(text)
                header = next(records, (None, []))[1]
                rows = [(i, raw, _named(header, cells)) for i, (raw, cells) in enumerate(records, 1)]
                for k in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[k : k + 5000], columns=["row_seq", "raw", "fields"])

    return files.mapInPandas(run, SCHEMA)


def read_csv_plain(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The fast way for files without need of verbatim records: Spark's own reader, columns as text, empty not null."""
    table = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return table.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def _json_path(path: str) -> str:
    return "$" + "".join(p if p.startswith("[") else f"['{p}']" for p in re.findall(r"\[\d+\]|[^.\[\]]+", path))


def read_json(spark: SparkSession, path: str, columns: Sequence[str], records_at: str | None = None) -> DataFrame:
    """Elements of a JSON array, which is the body or lies at records_at; any other shape is an error."""
    body = spark.read.text(path, wholetext=True)
    return json_rows(body, columns, records_at)


def json_rows(body: DataFrame, columns: Sequence[str], records_at: str | None = None) -> DataFrame:
    """As read_json, of a table with one JSON body in value."""
    whole = F.parse_json("value")
    array = F.variant_get(whole, _json_path(records_at), "array<variant>") if records_at else F.try_variant_get(whole, "$", "array<variant>")
    told = F.when(array.isNotNull(), array).otherwise(F.raise_error(F.lit(f"the JSON body has no array{' at ' + records_at if records_at else ''}")))
    rows = body.select(F.posexplode(told).alias("at", "item"))
    paths = {c: _json_path(c) for c in columns}
    cells = [F.struct(F.lit(c).alias("key"), _scalar(F.col("item"), p).alias("value")) for c, p in paths.items()]
    present = F.filter(F.array(*cells), lambda x: x["value"].isNotNull()) if cells else F.array().cast("array<struct<key:string,value:string>>")
    return rows.select((F.col("at") + 1).cast("bigint").alias("row_seq"), F.to_json("item").alias("raw"), F.map_from_entries(present).alias("fields"))


def _scalar(item, path: str):
    """A value's text: whole numbers without a fraction, objects and arrays as JSON; an explicit null is empty, a missing step null."""
    value = F.try_variant_get(item, path, "variant")
    text = F.coalesce(F.try_variant_get(item, path, "string"), F.to_json(value))
    text = F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.when(F.is_variant_null(value), F.lit("")).when(value.isNotNull(), text)


def read_snapshot(spark: SparkSession, folder: str, endpoint: str, columns: Sequence[str], records_at: str | None = None) -> DataFrame:
    """An endpoint's saved body, folder/endpoint.json; nothing is fetched from a network."""
    path = Path(folder, f"{endpoint}.json")
    if "://" not in folder and not path.exists():
        raise FileNotFoundError(f"{path} isn't there: save the endpoint's body under this name first")
    return read_json(spark, f"{folder.rstrip('/')}/{endpoint}.json", columns, records_at)


def bind(query: str, params: Sequence[str]) -> str:
    """A query with $1, $2, ... replaced by quoted literals; a number without a value is an error."""
    def literal(m: re.Match) -> str:
        i = int(m.group(1))
        if not 1 <= i <= len(params):
            raise ValueError(f"${i} has no value")
        return "'" + str(params[i - 1]).replace("'", "''") + "'"

    return re.sub(r"\$(\d+)", literal, query)


def read_jdbc(spark: SparkSession, dsn: str, query: str, params: Sequence[str] = (), fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A database query by JDBC (its driver must be on the class path); nulls read as empty."""
    table = spark.read.format("jdbc").options(url=dsn, query=bind(query, params), fetchsize=str(fetch_size), **options).load()
    return from_table(table)


def from_table(table: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Any table as rows: cells as text, raw tab-separated, the sequence by order (else as they come)."""
    names = table.columns
    if order:
        table = table.orderBy(*order)
    cells = table.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])
    return numbered(cells.select(F.concat_ws("\t", *[F.col(f"`{c}`") for c in names]).alias("raw"), F.create_map(*[y for c in names for y in (F.lit(c), F.col(f"`{c}`"))]).alias("fields")))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a dense row_seq: counts of the partitions before, then the place in the own one. The rows are written
    with their places first, so that a partition that is worked out again can't come in another order."""
    tagged = materialise(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "numbered")
    sizes = {r.part: r.n for r in tagged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, so_far = {}, 0
    for part in sorted(sizes):
        before[part] = so_far
        so_far += sizes[part]
    if not before:
        return tagged.select(F.lit(0).cast("bigint").alias("row_seq"), "raw", "fields").limit(0)
    offsets = F.create_map(*[F.lit(y) for k, v in before.items() for y in (k, v)])
    seq = F.try_element_at(offsets, F.col("part")) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return tagged.select(seq.cast("bigint").alias("row_seq"), "raw", "fields")


def memory_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[str]]) -> DataFrame:
    """A small table given as lists, in the order given."""
    return spark.createDataFrame([(i, "\t".join("" if c is None else str(c) for c in r), _named(columns, ["" if c is None else str(c) for c in r])) for i, r in enumerate(rows, 1)], SCHEMA)


def fingerprint_file(path: str) -> str:
    """A hash of a file's bytes and length."""
    h, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
            n += len(chunk)
    h.update(str(n).encode())
    return h.hexdigest()


def fingerprint_rows(rows: DataFrame) -> str:
    """A hash of a table's records that doesn't depend on how they are dealt out."""
    n, x, s = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("row_seq", "raw")), F.sum(F.xxhash64("raw", "row_seq").bitwiseAND((1 << 40) - 1))).first()
    return hashlib.sha256(json.dumps([n, x, s]).encode()).hexdigest()
