"""Cell-level lineage: a fused value back to its raw row, column and chain, and the chain replayed on that cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions.transforms import apply_chain, chain_fingerprint, chain_names, display
from moorline.schema.mapping import Bundle
from moorline.sources.rows import _json_path, _scalar, split_csv
from moorline.stage import ship

from .mapping import SEPARATOR, SLOTS, declared

FAILURES = ("no_raw_row", "no_cell", "chain_changed", "replay_failed", "differs")


def _csv_cell(raw: Column, spark) -> Column:
    """The text of each of the origin column's parts in a CSV row, joined; null if one isn't in the header."""
    ship(spark)

    @F.pandas_udf("string")
    def cell(raw: pd.Series, header: pd.Series, column: pd.Series) -> pd.Series:
        out = []
        for text, names, wanted in zip(raw, header, column):
            cells = next((c for _, c in split_csv(text)), []) if text is not None else None
            if cells is None or names is None:
                out.append(None)
                continue
            place = {}
            for i, n in enumerate(names):
                place.setdefault(n, i)
            parts = [wanted] if wanted in place else wanted.split("+")
            out.append(SEPARATOR.join(cells[place[p]] if place[p] < len(cells) else "" for p in parts) if all(p in place for p in parts) else None)
        return pd.Series(out, dtype="object")

    return cell(raw, F.col("header"), F.col("origin.column"))


def _json_cell(columns: list[str]) -> Column:
    item = F.try_parse_json("raw")
    cell: Column = F.lit(None).cast("string")
    for c in columns:
        cell = F.when(F.col("origin.column") == c, _scalar(item, _json_path(c))).otherwise(cell)
    return cell


def _tab_cell() -> Column:
    at = F.array_position("header", F.col("origin.column"))
    return F.when(at > 0, F.get(F.split("raw", "\t"), (at - 1).cast("int")))


def _with_cells(joined: DataFrame, bundle: Bundle) -> DataFrame:
    """The cell of each row, by its source's kind, in one pass."""
    of = F.col("origin.source_id")
    by = {k: [s for s in bundle.sources.values() if s.connector == k] for k in ("csv", "http")}
    of_kind = {k: of.isin(*[s.source_id for s in sources]) for k, sources in by.items() if sources}
    cell = _tab_cell()
    for s in by["http"]:
        cell = F.when(of == s.source_id, _json_cell(s.columns())).otherwise(cell)
    if "csv" in of_kind:
        cell = F.when(of_kind["csv"], _csv_cell(F.when(of_kind["csv"], F.col("raw")), joined.sparkSession)).otherwise(cell)
    return joined.withColumn("cell", F.when(of.isin(*[s.source_id for s in bundle.sources.values()]), cell))


def explained(provenance: DataFrame, raw: DataFrame, manifest: DataFrame, bundle: Bundle) -> DataFrame:
    """provenance with raw row, cell, replayed value, verified and failure; one job, a compiled chain for each mapping."""
    at = raw.select(F.col("source_id").alias("rs"), F.col("batch_id").alias("rb"), F.col("row_seq").alias("rr"), "raw")
    heads = manifest.select(F.col("source_id").alias("ms"), F.col("batch_id").alias("mb"), "header", "endpoint")
    joined = provenance.join(at, (F.col("origin.source_id") == F.col("rs")) & (F.col("origin.batch_id") == F.col("rb")) & (F.col("origin.row_seq") == F.col("rr")), "left").join(heads, (F.col("origin.source_id") == F.col("ms")) & (F.col("origin.batch_id") == F.col("mb")), "left").drop("rs", "rb", "rr", "ms", "mb")
    rows = _with_cells(joined, bundle)
    replayed, known = None, None
    seen = set()
    same: Column = F.lit(False)
    told: Column = F.lit(None).cast("string")
    failed: Column = F.lit(None).cast("string")
    for source in bundle.sources.values():
        for m in source.mappings:
            for p in m.properties:
                kind = bundle.ontology.property(m.target, p.name)
                if (m.target, p.name, p.chain, len(p.columns)) in seen:
                    continue
                seen.add((m.target, p.name, p.chain, len(p.columns)))
                cell = F.col("cell") if len(p.columns) == 1 else F.split("cell", SEPARATOR)
                typed = declared(apply_chain(p.chain, cell, "string" if len(p.columns) == 1 else "string[]"), kind.kind, kind.values)
                mine = (F.col("type") == m.target) & (F.col("prop") == p.name) & (F.col("chain_fp") == chain_fingerprint(p.chain))
                slot = F.col(SLOTS[kind.kind])
                equal = F.size(F.array_except(typed.value, slot)) == 0 if kind.kind == "string[]" else typed.value == slot
                same = F.when(mine, F.coalesce(equal, F.lit(False))).otherwise(same)
                told = F.when(mine, display("string" if kind.kind == "enum" else kind.kind, typed.value)).otherwise(told)
                failed = F.when(mine, typed.error).otherwise(failed)
                known = mine if known is None else known | mine
    failure = F.when(F.col("raw").isNull(), "no_raw_row").when(F.col("cell").isNull(), "no_cell").when(~F.coalesce(known, F.lit(False)), "chain_changed").when(failed.isNotNull(), "replay_failed").when(~same, "differs")
    replayed = rows.withColumn("replayed", told).withColumn("failure", failure)
    return replayed.withColumn("verified", F.col("failure").isNull())


def round_trip(of: DataFrame) -> DataFrame:
    """entities, properties, verified, failed, union, rate."""
    return of.agg(F.countDistinct("type", "entity_id").alias("entities"), F.count("*").alias("properties"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("failed"), F.count_if(F.col("rule") == "union").alias("union")).withColumn("rate", F.when(F.col("properties") == 0, 1.0).otherwise(F.col("verified") / F.col("properties")))


def failures(of: DataFrame, limit: int = 25) -> DataFrame:
    return of.where("not verified").orderBy("type", "entity_id", "prop").limit(limit)


def render(row) -> str:
    """An explained value as text."""
    o = row["origin"]
    emitted = next((row[s] for s in ("s", "i", "d", "b", "ts", "l") if row[s] is not None), None)
    lines = [f"{row['type']} {row['entity_id']}  {row['prop']} = {emitted}", f"  rule {row['rule']}, confidence {row['confidence']:.2f}, {row['cluster_size']} records", f"  source {o['source_id']} batch {o['batch_id']} row {o['row_seq']} column {o['column']}", f"  raw {row['raw_value']!r} through {' > '.join(chain_names(row['chain'])) or '(nothing)'}"]
    lines += [f"  rejected {r['value']!r} of source {r['source_id']}: {r['reason']}" for r in row["rejected"] or []]
    return "\n".join([*lines, "  replay agrees" if row["verified"] else f"  replay fails: {row['failure']}"])
