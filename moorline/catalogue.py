"""The queries over the given tables, each with DuckDB SQL for the same rows where SQL can say it.

The tables make a graph of their own: an ontology of regions to events, on which the traversal engine runs; the other
operators get their input from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moorline.api import Service
from moorline.functions import geo, text
from moorline.functions.transforms import FLAGS, apply_chain
from moorline.operators import blocking, cluster, evaluate, fusion, graph, ingest, lineage, links, mapping, resolve, scoring
from moorline.plans import executor
from moorline.plans.ir import Query
from moorline.schema.mapping import Bundle
from moorline.schema.ontology import Ontology
from moorline.sources import rows as readers
from moorline.stage import materialise, shared_dir, ship
from moorline.tables import Store

ONTOLOGY = {
    "version": 1,
    "entity_types": {
        "Region": {"id": 1, "properties": {"name": {"id": 1, "type": "string", "title": True, "indexed": True}}, "display": "{name}"},
        "Nation": {"id": 2, "properties": {"name": {"id": 10, "type": "string", "title": True, "indexed": True}}, "display": "{name}"},
        "Customer": {"id": 3, "properties": {"name": {"id": 20, "type": "string", "title": True, "indexed": True, "unique_hint": True}, "balance": {"id": 21, "type": "double", "indexed": True}, "segment": {"id": 22, "type": "string", "indexed": True}}, "display": "{name} ({segment})"},
        "Supplier": {"id": 4, "properties": {"name": {"id": 30, "type": "string", "title": True, "indexed": True}, "balance": {"id": 31, "type": "double"}}, "display": "{name}"},
        "Part": {"id": 5, "properties": {"name": {"id": 40, "type": "string", "title": True, "indexed": True}, "brand": {"id": 41, "type": "string", "indexed": True}, "kind": {"id": 42, "type": "string"}, "size": {"id": 43, "type": "int", "indexed": True}, "words": {"id": 44, "type": "string[]", "fuse": "union"}}, "display": "{name}"},
        "Order": {"id": 6, "properties": {"status": {"id": 50, "type": "string", "indexed": True}, "price": {"id": 51, "type": "double", "indexed": True}, "ordered_at": {"id": 52, "type": "timestamp", "indexed": True}, "priority": {"id": 53, "type": "string"}}, "display": "{status} {priority}"},
        "User": {"id": 7, "properties": {"ref": {"id": 60, "type": "string", "title": True, "indexed": True}}},
        "Event": {"id": 8, "properties": {"kind": {"id": 70, "type": "string", "indexed": True}, "value": {"id": 71, "type": "double", "indexed": True}, "at": {"id": 72, "type": "timestamp", "indexed": True}}},
        "Document": {"id": 9, "properties": {"lang": {"id": 80, "type": "string", "indexed": True}, "source": {"id": 81, "type": "string", "indexed": True}, "n_chars": {"id": 82, "type": "int", "indexed": True}}},
    },
    "link_types": {
        "customer_in": {"id": 1, "from": "Customer", "to": "Nation", "cardinality": "many_to_one", "inverse": "customers"},
        "supplier_in": {"id": 2, "from": "Supplier", "to": "Nation", "cardinality": "many_to_one", "inverse": "suppliers"},
        "nation_in": {"id": 3, "from": "Nation", "to": "Region", "cardinality": "many_to_one", "inverse": "nations"},
        "placed_by": {"id": 4, "from": "Order", "to": "Customer", "cardinality": "many_to_one", "inverse": "orders", "time_index": "ordered_at"},
        "contains": {"id": 5, "from": "Order", "to": "Part", "cardinality": "many_to_many", "inverse": "contained_in"},
        "performed_by": {"id": 6, "from": "Event", "to": "User", "cardinality": "many_to_one", "inverse": "events", "time_index": "at"},
    },
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def world(spark: SparkSession, sf_dir: str) -> executor.Graph:
    """The graph over the given tables; nothing is copied, and ids stay numbers, so filters and ids reach their scans."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda c: F.col(c).cast("bigint")
    entities = {
        "Region": t("region").select(key("r_regionkey").alias("entity_id"), F.col("r_name").alias("name")),
        "Nation": t("nation").select(key("n_nationkey").alias("entity_id"), F.col("n_name").alias("name")),
        "Customer": t("customer").select(key("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "Supplier": t("supplier").select(key("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "Part": t("part").select(key("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("bigint").alias("size"), F.split("p_type", " ").alias("words")),
        "Order": t("orders").select(key("o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ordered_at"), F.col("o_orderpriority").alias("priority")),
        "User": t("events").select(key("user_id").alias("entity_id"), F.col("user_id").cast("string").alias("ref")).distinct(),
        "Event": t("events").select(key("event_id").alias("entity_id"), F.col("event_type").alias("kind"), "value", F.col("ts").alias("at")),
        "Document": t("documents").select(key("doc_id").alias("entity_id"), "lang", "source", "n_chars"),
    }
    edge = lambda name, of, src, dst, ts=None: t(of).select(F.lit(name).alias("link"), key(src).alias("src"), key(dst).alias("dst"), (F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")).alias("ts"))
    parts = [edge("customer_in", "customer", "c_custkey", "c_nationkey"), edge("supplier_in", "supplier", "s_suppkey", "s_nationkey"), edge("nation_in", "nation", "n_nationkey", "n_regionkey"), edge("placed_by", "orders", "o_orderkey", "o_custkey", "o_orderdate"), edge("contains", "lineitem", "l_orderkey", "l_partkey"), edge("performed_by", "events", "event_id", "user_id", "ts")]
    return executor.Graph(Ontology.read(ONTOLOGY), entities, reduce(DataFrame.unionByName, parts))


def traverse(spark: SparkSession, sf_dir: str, request: dict) -> executor.Result:
    return executor.run(world(spark, sf_dir), Query.from_json(request))


def found(spark: SparkSession, sf_dir: str, request: dict) -> DataFrame:
    return traverse(spark, sf_dir, {"limit": 10_000, **request}).everything.select("entity_id", "display")


# Access paths ----------------------------------------------------------------------------------------------------

_CUSTOMER = "select c_custkey::varchar entity_id, c_name || ' (' || c_mktsegment || ')' display from customer"


@query(f"{_CUSTOMER} where c_custkey in (1, 5, 77, 123)")
def point_lookup(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "ids": ["1", "5", "77", "123", "none"]}})


@query(f"{_CUSTOMER} where c_mktsegment = 'BUILDING'")
def index_eq(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"segment": "BUILDING"}}})


@query(f"{_CUSTOMER} where c_acctbal >= 1000 and c_acctbal < 2500.5")
def index_range(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"balance": {"gte": 1000, "lt": 2500.5}}}})


@query(f"{_CUSTOMER} where starts_with(lower(c_name), 'customer#00000000')")
def index_prefix(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"name": {"prefix": "cUstOmEr#00000000"}}}})


@query(_CUSTOMER)
def full_scan(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer"}})


@query("select 'Nation' \"type\", '7' entity_id, n_name \"name\" from nation where n_nationkey = 7 union all select 'Region', '7', r_name from region where r_regionkey = 7 union all select 'Customer', '7', c_name from customer where c_custkey = 7 union all select 'Supplier', '7', s_name from supplier where s_suppkey = 7 union all select 'Part', '7', p_name from part where p_partkey = 7 union all select 'Order', '7', null from orders where o_orderkey = 7 union all select distinct 'User', '7', null from events where user_id = 7 union all select 'Event', '7', null from events where event_id = 7 union all select 'Document', '7', null from documents where doc_id = 7")
def find_entity(spark, sf_dir):
    """An id that entities of several types have: all are found."""
    return world(spark, sf_dir).find("7").select("type", "entity_id", F.get_json_object("properties", "$.name").alias("name"))


# Predicates ------------------------------------------------------------------------------------------------------


@query("select p_partkey::varchar entity_id, p_name display from part where p_brand <> 'Brand#12'")
def pred_ne_null(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Part", "filter": {"brand": {"ne": "Brand#12"}}}})


@query("select c_custkey::varchar entity_id, c_name || ' (' || c_mktsegment || ')' display from customer where contains(lower(c_mktsegment), 'build')")
def pred_contains_ci(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"segment": {"contains": "bUiLd"}}}})


@query(f"{_CUSTOMER} where starts_with(lower(c_mktsegment), 'auto')")
def pred_starts_ci(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"segment": {"starts_with": "AuTo"}}}})


@query("select p_partkey::varchar entity_id, p_name display from part where list_contains(string_split(p_type, ' '), (select min(string_split(p_type, ' ')[1]) from part))")
def pred_list_any(spark, sf_dir):
    first = table(spark, sf_dir, "part").agg(F.min(F.split("p_type", " ")[0])).first()[0]
    return found(spark, sf_dir, {"start": {"type": "Part", "filter": {"words": first}}})


@query("select p_partkey::varchar entity_id, p_name display from part where false")
def pred_type_mismatch_empty(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Part", "filter": {"size": "ten"}}})


@query("select p_partkey::varchar entity_id, p_name display from part where p_size > 10 and p_size <= 20")
def pred_range_strict(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Part", "filter": {"size": {"gt": 10, "lte": 20}}}})


@query("select event_id::varchar entity_id from events where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-11 12:00:00'")
def pred_timestamp(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Event", "filter": {"at": {"gte": "2024-01-10T00:00:00Z", "lte": "2024-01-11T12:00:00Z"}}}}).select("entity_id")


# Hops ------------------------------------------------------------------------------------------------------------


@query("select distinct n_nationkey::varchar entity_id, n_name display from customer join nation on c_nationkey = n_nationkey where c_acctbal < -900")
def hop_forward(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"balance": {"lt": -900}}}, "hops": [{"link": "customer_in"}]})


@query("select s_suppkey::varchar entity_id, s_name display from supplier join nation on s_nationkey = n_nationkey where n_nationkey in (3, 4)")
def hop_reverse(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Nation", "ids": ["3", "4"]}, "hops": [{"link": "suppliers"}]})


@query("select distinct p_partkey::varchar entity_id, p_name display from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_custkey in (1, 2, 4, 5)")
def two_hop_distinct(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "ids": ["1", "2", "4", "5"]}, "hops": [{"link": "orders"}, {"link": "contains"}]})


@query("select distinct r_regionkey::varchar entity_id, r_name display from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 9900")
def three_types_hop(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Customer", "filter": {"balance": {"gt": 9900}}}, "hops": [{"link": "customer_in"}, {"link": "nation_in"}]})


_QUARTER = {"start": {"type": "Customer", "filter": {"segment": "MACHINERY"}}, "hops": [{"link": "orders", "where": {"ordered_at": {"gte": "1996-01-01T00:00:00Z", "lt": "1996-04-01T00:00:00Z"}}}]}
_IN_QUARTER = "from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-04-01'"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, _QUARTER)


@query(f"select o_orderkey::varchar entity_id, o_orderstatus || ' ' || o_orderpriority display {_IN_QUARTER}")
def quarter_window(spark, sf_dir):
    return flagship(spark, sf_dir)


def _machinery_orders(spark: SparkSession, sf_dir: str, hop: dict) -> DataFrame:
    """The orders at the ends of all edges that a hop from the quarter's customers walks: max_expand cuts frontiers, not these."""
    graph, request = world(spark, sf_dir), Query.from_json({"start": _QUARTER["start"], "hops": [hop]})
    first, then = executor.build(request, graph.ontology).steps
    _, walked, _ = executor.hop(graph, executor.start(graph, request, first), then)
    orders = graph.entity("Order").withColumn("entity_id", F.col("entity_id").cast("string"))
    return walked.select(F.col("from").alias("entity_id")).distinct().join(orders, "entity_id")


@query(f"select count(*)::bigint by_window, count(*)::bigint by_scan, true same {_IN_QUARTER}")
def window_equals_scan(spark, sf_dir):
    """The quarter's orders by the time index, and by a test of all orders of the same customers; ids as they are shown."""
    number, ids = F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("entity_id")), F.lit(0))
    windowed = _machinery_orders(spark, sf_dir, _QUARTER["hops"][0]).agg(number.alias("by_window"), ids.alias("x"))
    scanned = _machinery_orders(spark, sf_dir, {"link": "orders"}).where("ordered_at >= timestamp_ntz '1996-01-01' and ordered_at < timestamp_ntz '1996-04-01'").agg(number.alias("by_scan"), ids.alias("y"))
    return windowed.crossJoin(scanned).select("by_window", "by_scan", (F.col("x") == F.col("y")).alias("same"))


@query("select event_id::varchar entity_id from events where user_id in (3, 5, 8) and ts >= timestamp '2024-01-20'")
def open_window(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "User", "ids": ["3", "5", "8"]}, "hops": [{"link": "events", "where": {"at": {"gte": "2024-01-20T00:00:00Z"}}}]}).select("entity_id")


@query("select distinct o_custkey::varchar entity_id from orders where o_orderdate > timestamp '1996-01-01' and o_orderdate <= timestamp '1996-02-01' and o_totalprice > 300000")
def forward_window(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Order", "filter": {"price": {"gt": 300000}}}, "hops": [{"link": "placed_by", "where": {"ordered_at": {"gt": "1996-01-01T00:00:00Z", "lte": "1996-02-01T00:00:00Z"}}}]}).select("entity_id")


@query("select c_custkey::varchar entity_id, c_name || ' (' || c_mktsegment || ')' display from customer where c_nationkey = 6 and c_mktsegment = 'FURNITURE'")
def hop_residual(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Nation", "ids": ["6"]}, "hops": [{"link": "customers", "where": {"segment": "FURNITURE"}}]})


@query("select entity_id from (select c_custkey::varchar entity_id from customer where c_nationkey = 6) order by entity_id limit 7")
def hop_max_expand(spark, sf_dir):
    return found(spark, sf_dir, {"start": {"type": "Nation", "ids": ["6"]}, "hops": [{"link": "customers", "max_expand": 7}]}).select("entity_id")


@query("select entity_id from (select c_custkey::varchar entity_id, c_acctbal from customer where c_acctbal > 5000) order by c_acctbal, entity_id limit 25")
def limit_ordered(spark, sf_dir):
    return traverse(spark, sf_dir, {"start": {"type": "Customer", "filter": {"balance": {"gt": 5000}}}, "limit": 25}).entities.select("entity_id")


@query("select 0 depth, 'Region' \"type\", '1' entity_id union all select 1, 'Nation', n_nationkey::varchar from nation where n_regionkey = 1 union all select 2, 'Supplier', s_suppkey::varchar from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1")
def include_path(spark, sf_dir):
    return traverse(spark, sf_dir, {"start": {"type": "Region", "ids": ["1"]}, "hops": [{"link": "nations"}, {"link": "suppliers"}], "include_path": True, "limit": 10_000}).everything.select("depth", "type", "entity_id")


@query("select s_suppkey::varchar \"from\", s_nationkey::varchar \"to\", 'supplier_in' link, true reverse from supplier where s_nationkey in (2, 3) union all select n_nationkey::varchar, n_regionkey::varchar, 'nation_in', false from nation where false")
def edge_list(spark, sf_dir):
    return traverse(spark, sf_dir, {"start": {"type": "Nation", "ids": ["2", "3"]}, "hops": [{"link": "suppliers"}], "limit": 10_000}).edges


@query("select p_partkey::varchar entity_id, '{\"brand\":\"' || p_brand || '\"}' properties from part where p_size = 7")
def select_properties(spark, sf_dir):
    return traverse(spark, sf_dir, {"start": {"type": "Part", "filter": {"size": 7}}, "select": ["Part.brand"], "limit": 10_000}).everything.select("entity_id", "properties")


@query("select 0 step, 'start' kind, 'IDX' access union all select 1, 'hop', 'TIDX'")
def explain_plan(spark, sf_dir):
    plan = executor.build(Query.from_json(_QUARTER), world(spark, sf_dir).ontology)
    return spark.createDataFrame([(i, s.kind, s.access) for i, s in enumerate(plan.steps)], "step int, kind string, access string")


# Transforms ------------------------------------------------------------------------------------------------------


def _xf(name: str, chain: list[str], of: str, key: str, cell, sql: str | None, error_sql: str = "false", kind: str = "string"):
    """A transform over a whole table: key, value, failed."""

    def run(spark, sf_dir):
        typed = apply_chain(chain, cell(), kind)
        return table(spark, sf_dir, of).select(F.col(key).alias("key"), typed.value.alias("value"), typed.error.isNotNull().alias("failed"))

    run.__name__ = f"xf_{name}"
    query(f'select {key} "key", {sql} "value", {error_sql} failed from {of}' if sql else None)(run)


_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IMO = "lpad(o_orderkey::varchar, 7, '9')"
_IMO_OK = "(" + " + ".join(f"substr({_IMO}, {i}, 1)::int * {8 - i}" for i in range(1, 7)) + f") % 10 = substr({_IMO}, 7, 1)::int"
_MID = "(200 + c_custkey % 500)"
_MIDS = "case " + " ".join(f"when {_MID} = {k} then '{v}'" for k, v in FLAGS.items()) + " end"
_WORDS = "list_transform(string_split(p_type, ' '), lambda x: "

_xf("trim", ["trim"], "part", "p_partkey", lambda: F.concat(F.lit(" \t "), F.col("p_name"), F.lit("\n ")), "p_name")
_xf("collapse_ws", ["collapse_ws"], "part", "p_partkey", lambda: F.concat(F.lit(" "), F.regexp_replace("p_type", " ", " \t "), F.lit("  ")), "p_type")
_xf("upper", ["upper"], "documents", "doc_id", lambda: F.col("text"), f"translate(text, '{_az}', '{_AZ}')")
_xf("lower", ["lower"], "documents", "doc_id", lambda: F.col("text"), f"translate(text, '{_AZ}', '{_az}')")
_xf("title_case", ["title_case"], "part", "p_partkey", lambda: F.concat(F.lit("PORT OF o'brien-"), F.col("p_type")), f"'Port of O''Brien-' || array_to_string({_WORDS} upper(substr(x, 1, 1)) || lower(substr(x, 2))), ' ')")
_xf("strip_diacritics", ["strip_diacritics"], "documents", "doc_id", lambda: F.col("text"), "replace(strip_accents(text), 'ß', 'ss')")
_xf("first_char", ["first_char"], "part", "p_partkey", lambda: F.col("p_type"), "upper(substr(p_type, 1, 1))")
_xf("null_if_blank", ["null_if_blank"], "part", "p_partkey", lambda: F.when(F.col("p_size") % 2 == 0, F.lit(" \t")).otherwise(F.col("p_name")), "case when p_size % 2 <> 0 then p_name end")
_xf("concat", ["concat"], "part", "p_partkey", lambda: F.array("p_brand", "p_type"), "p_brand || p_type", kind="string[]")
_xf("split_semicolon", ["split_semicolon"], "part", "p_partkey", lambda: F.concat(F.lit("; "), F.regexp_replace("p_type", " ", " ;; ")), "string_split(p_type, ' ')")
_xf("to_string", ["to_int", "to_string"], "part", "p_partkey", lambda: F.col("p_size").cast("string"), "p_size::varchar")
_xf("to_int", ["to_int"], "part", "p_partkey", lambda: F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" +"), F.col("p_size").cast("string"), F.lit(" "))).when(F.col("p_size") % 3 == 1, F.lit("1.5")).otherwise(F.lit("")), "case when p_size % 3 = 0 then p_size::bigint end", "p_size % 3 = 1")
_xf("to_double", ["to_double"], "customer", "c_custkey", lambda: F.when(F.col("c_custkey") % 5 == 0, F.lit("12x")).otherwise(F.concat(F.col("c_acctbal").cast("string"), F.lit("e1"))), "case when c_custkey % 5 <> 0 then (c_acctbal::varchar || 'e1')::double end", "c_custkey % 5 = 0")
_xf("parse_timestamp", ["parse_timestamp"], "orders", "o_orderkey", lambda: F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:30:15.5+02:00")), "o_orderdate + interval '8 hours 30 minutes 15.5 seconds'")
QUERIES["xf_parse_timestamp"] = (lambda f: lambda spark, sf_dir: f(spark, sf_dir).withColumn("value", F.to_timestamp_ntz(F.date_format(F.from_utc_timestamp(F.to_utc_timestamp("value", F.current_timezone()), "UTC"), "yyyy-MM-dd HH:mm:ss.SSS"))))(QUERIES["xf_parse_timestamp"])
_xf("validate_locode", ["validate_locode"], "part", "p_partkey", lambda: F.concat(F.lit(" nl "), F.substring("p_type", 1, 3), F.when(F.col("p_size") % 4 == 0, "1").otherwise("")), "case when p_size % 4 <> 0 then 'NL' || upper(substr(p_type, 1, 3)) end", "p_size % 4 = 0")
_xf("validate_imo", ["validate_imo"], "orders", "o_orderkey", lambda: F.lpad(F.col("o_orderkey").cast("string"), 7, "9"), f"case when {_IMO_OK} then {_IMO} end", f"not ({_IMO_OK})")
_xf("strip_imo_prefix", ["strip_imo_prefix"], "orders", "o_orderkey", lambda: F.concat(F.lit(" imo "), F.col("o_orderkey").cast("string")), "o_orderkey::varchar")
_xf("mid_to_country", ["mid_to_country"], "customer", "c_custkey", lambda: F.concat((200 + F.col("c_custkey") % 500).cast("string"), F.lit("123456")), _MIDS)
_xf("normalize_ship_type", ["to_int", "normalize_ship_type"], "part", "p_partkey", lambda: (F.col("p_size") * 4).cast("string"), "case when p_size * 4 <= 99 then (p_size * 4)::bigint end", "p_size * 4 > 99")
_DDMM = lambda: F.format_string("%02d%02dN %03d%02dW", (F.col("p_size") % 90).cast("int"), (F.col("p_partkey") % 70).cast("int"), (F.col("p_partkey") % 170).cast("int"), (F.col("p_partkey") % 60).cast("int"))
_xf("ddmm_to_decimal_lat", ["ddmm_to_decimal_lat"], "part", "p_partkey", _DDMM, "case when p_partkey % 70 <= 59 then (p_size % 90) + (p_partkey % 70) / 60.0::double end", "p_partkey % 70 > 59")
_xf("ddmm_to_decimal_lon", ["ddmm_to_decimal_lon"], "part", "p_partkey", _DDMM, "-((p_partkey % 170) + (p_partkey % 60) / 60.0::double)")
_xf("chain_stops", ["trim", "to_int", "to_string", "upper"], "part", "p_partkey", lambda: F.when(F.col("p_size") > 25, "many").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))), "case when p_size <= 25 then p_size::varchar end", "p_size > 25")


@query("select p_partkey \"key\", case when p_size % 2 = 0 then p_type end \"value\", p_size % 2 <> 0 failed from part")
def enum_domain(spark, sf_dir):
    values = tuple(r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().collect())
    cell = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("?"))
    typed = mapping.declared(apply_chain([], cell), "enum", values)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), typed.value.alias("value"), typed.error.isNotNull().alias("failed"))


# Names, similarity, geography --------------------------------------------------------------------------------------


@query(f"select doc_id, len(list_filter(regexp_split_to_array(translate(text, '{_az}', '{_AZ}'), '[^0-9A-Z]+'), lambda x: x <> ''))::int n, md5(array_to_string(list_filter(regexp_split_to_array(translate(text, '{_az}', '{_AZ}'), '[^0-9A-Z]+'), lambda x: x <> ''), ' ')) all_words from documents")
def norm_tokens(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("all_words"))


_TWO = "select a.p_partkey a, b.p_partkey b, string_split(a.p_type, ' ') x, string_split(b.p_type, ' ') y from part a join part b on b.p_partkey = a.p_partkey + 1"


def _neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("a"), F.split("p_type", " ").alias("x"), (F.col("p_partkey") + 1).alias("next")).join(p.select(F.col("p_partkey").alias("b"), F.split("p_type", " ").alias("y")), F.col("next") == F.col("b"))


@query(f"select a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double, 9) jaccard from ({_TWO})")
def token_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", F.round(text.token_jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query(f"select a, b, list_has_all(list_distinct(x), list_distinct(y)) or list_has_all(list_distinct(y), list_distinct(x)) contained from ({_TWO})")
def tokens_contained(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", text.tokens_contained(F.col("x"), F.col("y")).alias("contained"))


@query(f"select a, b, round(jaro_similarity(p, q), 9) jaro, round(jaro_winkler_similarity(p, q), 9) jaro_winkler from (select a, b, array_to_string(x, ' ') p, array_to_string(y, ' ') q from ({_TWO}))")
def jaro_winkler(spark, sf_dir):
    ship(spark)
    p = _neighbours(spark, sf_dir).select("a", "b", F.array_join("x", " ").alias("p"), F.array_join("y", " ").alias("q"))
    return p.select("a", "b", F.round(text.jaro(F.col("p"), F.col("q")), 9).alias("jaro"), F.round(text.jaro_winkler(F.col("p"), F.col("q")), 9).alias("jaro_winkler"))


@query()
def soundex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.soundex_phrase(F.col("p_type")).alias("code"))


@query()
def geohash(spark, sf_dir):
    lat, lon = F.col("c_acctbal") / 112, (F.col("c_custkey") % 360 - 180).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", geo.geohash(lat, lon, 6).alias("cell"), F.size(geo.geohash_with_neighbours(lat, lon, 4)).alias("cells"))


_H = "pow(sin(radians(51.9 - c_acctbal / 112) / 2), 2) + cos(radians(c_acctbal / 112)) * cos(radians(51.9)) * pow(sin(radians(4.5 - (c_custkey % 360 - 180)) / 2), 2)"


@query(f"select c_custkey, round(2 * 6371.0088 * asin(sqrt(least({_H}, 1.0))), 6) km from customer")
def haversine(spark, sf_dir):
    lat, lon = F.col("c_acctbal") / 112, (F.col("c_custkey") % 360 - 180).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(geo.haversine_km(lat, lon, F.lit(51.9), F.lit(4.5)), 6).alias("km"))


@query()
def port_names(spark, sf_dir):
    told = F.concat(F.lit("Port of St "), F.col("n_name"), F.lit(" Hbr."))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.canonical(text.port_tokens(told)).alias("port"), text.canonical(text.vessel_tokens(F.concat(F.lit("M/V "), F.col("n_name")))).alias("vessel"))


# Blocking, clusters, evaluation --------------------------------------------------------------------------------------


def _keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ref = F.struct((F.col("c_custkey") % 3).cast("int").alias("source_id"), F.col("c_custkey").alias("key_hash"))
    keys = [c.select(F.lit("Customer").alias("type"), ref.alias("ref"), F.lit("balance").alias("generator"), F.floor(F.col("c_acctbal") / 50).cast("string").alias("value")), c.select(F.lit("Customer").alias("type"), ref.alias("ref"), F.lit("place").alias("generator"), F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / 100)).alias("value"))]
    keys.append(c.select(F.lit("Customer").alias("type"), ref.alias("ref"), F.lit("segment").alias("generator"), F.col("c_mktsegment").alias("value")))
    return reduce(DataFrame.union, keys)


_KEYS = "(select c_custkey k, 'balance' generator, floor(c_acctbal / 50)::bigint::varchar v from customer union all select c_custkey, 'place', c_nationkey || '|' || c_mktsegment || '|' || floor(c_custkey / 100)::bigint from customer union all select c_custkey, 'segment', c_mktsegment from customer)"
_SIZES = f"(select generator, v, count(*) n from {_KEYS} group by 1, 2)"
_PAIRS = f"select a.k a, b.k b, array_to_string(list_sort(list_distinct(list(a.generator))), '+') via from {_KEYS} a join {_KEYS} b on a.generator = b.generator and a.v = b.v and (a.k % 3, a.k) < (b.k % 3, b.k) join {_SIZES} s on s.generator = a.generator and s.v = a.v where s.n <= {blocking.MAX_BLOCK} group by 1, 2"


def _pairs(spark, sf_dir):
    return blocking.candidate_pairs(_keys(spark, sf_dir))


@query(_PAIRS)
def block_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("a.key_hash").alias("a"), F.col("b.key_hash").alias("b"), F.array_join("via", "+").alias("via"))


@query(f"select count(*) pairs from ({_PAIRS}) where a % 3 <> b % 3")
def block_cross_source(spark, sf_dir):
    return blocking.candidate_pairs(_keys(spark, sf_dir), cross_source_only=True).agg(F.count("*").alias("pairs"))


@query(f"select sum(n)::bigint blocking_keys, count(*) blocks, max(n) largest_block, count(*) filter (n > {blocking.MAX_BLOCK}) purged_blocks from {_SIZES}")
def block_stats(spark, sf_dir):
    return blocking.block_stats(_keys(spark, sf_dir))


@query(f"select generator, count(*) pairs from (select unnest(string_split(via, '+')) generator from ({_PAIRS})) group by 1")
def block_by_generator(spark, sf_dir):
    return blocking.pairs_by_generator(_pairs(spark, sf_dir))


@query(f"select count(*) candidate_pairs, any_value(n * (n - 1) // 2)::bigint possible_pairs, round(1 - count(*) / any_value(n * (n - 1) // 2)::double, 12) reduction_ratio from ({_PAIRS}), (select count(*) n from customer)")
def reduction_ratio(spark, sf_dir):
    n = table(spark, sf_dir, "customer").agg(F.lit("Customer").alias("type"), F.count("*").alias("n"))
    return blocking.reduction(_pairs(spark, sf_dir), n).withColumn("reduction_ratio", F.round("reduction_ratio", 12))


@query(f"select generator, v \"value\", n from {_SIZES} where n > {blocking.MAX_BLOCK}")
def block_purge(spark, sf_dir):
    return blocking.block_sizes(_keys(spark, sf_dir)).where(F.col("n") > blocking.MAX_BLOCK).select("generator", "value", "n")


_RUNS = "select c_custkey node, min(c_custkey) over (partition by g) component from (select c_custkey, sum(cut) over (order by c_custkey) g from (select c_custkey, case when c_mktsegment = lag(c_mktsegment) over (order by c_custkey) then 0 else 1 end cut from customer))"


def _edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), "c_mktsegment").join(c.select(F.col("c_custkey").alias("b"), F.col("c_mktsegment").alias("m")), "b").where("c_mktsegment = m").select("a", "b")


@query(f"select node, component from ({_RUNS}) where component in (select component from ({_RUNS}) group by 1 having count(*) > 1)")
def cluster_components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


def _scored(spark, sf_dir):
    """Match edges between neighbours of one segment; neighbours' neighbours of one nation are vetoed."""
    e = _edges(spark, sf_dir)
    ref = lambda c: F.struct(F.lit(1).alias("source_id"), F.col(c).alias("key_hash"))
    matches = e.select(ref("a").alias("a"), ref("b").alias("b"), (F.col("a") % 7).cast("double").alias("score"), F.lit("match").alias("decision"), F.lit(False).alias("vetoed"))
    far = e.select(F.col("a"), F.col("b").alias("m")).join(e.select(F.col("a").alias("m"), F.col("b")), "m").where("a % 4 = 0").select(ref("a").alias("a"), ref("b").alias("b"), F.lit(0.0).alias("score"), F.lit("non_match").alias("decision"), F.lit(True).alias("vetoed"))
    records = table(spark, sf_dir, "customer").select(F.lit("Customer").alias("type"), ref("c_custkey").alias("ref"))
    return matches.union(far), records


@query(f"select count(*) clusters, max(n) largest, count(*) filter (n = 1) singletons, sum(n * (n - 1) // 2)::bigint implied_pairs from (select count(*) n from ({_RUNS}) group by component)")
def cluster_transitive(spark, sf_dir):
    return cluster.cluster_stats(cluster.transitive(*_scored(spark, sf_dir)))


@query()
def cluster_veto(spark, sf_dir):
    clusters, refused = cluster.constrained(*_scored(spark, sf_dir))
    return cluster.cluster_stats(clusters).crossJoin(refused.agg(F.count("*").alias("refused")))


_LABELLED = "(select quality = 1 t, n_chars > 1500 s, n_chars between 1000 and 1500 r, toxic from labels join documents using (doc_id))"
_MATRIX = f"select toxic, count(*) filter (t and s) tp, count(*) filter (not t and s) fp, count(*) filter (not t and not s) tn, count(*) filter (t and not s) fn, count(*) filter (t and r) missed_to_review from {_LABELLED} group by 1"


def _judged(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("toxic", F.when(F.col("quality") == 1, "match").otherwise("non_match").alias("label"), F.when(F.col("n_chars") > 1500, "match").when(F.col("n_chars") >= 1000, "review").otherwise("non_match").alias("decision"))


@query(_MATRIX)
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), "toxic")


@query(f"select toxic, round(tp / nullif(tp + fp, 0), 9) \"precision\", round(tp / nullif(tp + fn, 0), 9) recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) f1, round((tp + tn) / (tp + fp + tn + fn), 9) accuracy from ({_MATRIX})")
def prf1(spark, sf_dir):
    rates = evaluate.with_rates(evaluate.confusion(_judged(spark, sf_dir), "toxic"))
    return rates.select("toxic", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query()
def vessel_scores(spark, sf_dir):
    """Suppliers as vessels: keys, candidates, features, decisions."""
    ship(spark)
    s = table(spark, sf_dir, "supplier")
    records = s.select(F.lit(1).alias("source_id"), F.col("s_suppkey").alias("key_hash"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.lpad((F.col("s_suppkey") / 4).cast("int").cast("string"), 7, "9")).alias("imo"), F.col("s_nationkey").cast("string").alias("mmsi"), F.lit(None).cast("string").alias("call_sign"), F.col("s_nationkey").cast("string").alias("flag"))
    keys = blocking.blocking_keys(records, "Vessel")
    scored = scoring.score_pairs(blocking.candidate_pairs(keys), records, "Vessel")
    return scored.select(F.col("a.key_hash").alias("a"), F.col("b.key_hash").alias("b"), F.round("score", 6).alias("score"), "decision", "vetoed", scoring.explanation().alias("explanation"))


# Fusion, links, ingestion, lineage -----------------------------------------------------------------------------------

_ITEM = {"version": 1, "entity_types": {"Item": {"id": 1, "properties": {"trusted": {"id": 1, "type": "string", "fuse": "most_trusted"}, "recent": {"id": 2, "type": "string", "fuse": "most_recent"}, "frequent": {"id": 3, "type": "string", "fuse": "most_frequent"}, "median": {"id": 4, "type": "double", "fuse": "numeric_median"}, "long": {"id": 5, "type": "string", "fuse": "longest"}, "all": {"id": 6, "type": "string[]", "fuse": "union"}}}}}
_TRUST = {0: 0.2, 1: 0.9, 2: 0.5, 3: 0.5, 4: 0.1}
_CELL = "(select o_custkey part, o_orderkey % 5 source_id, o_orderkey k, o_orderkey % 9 batch_id, o_orderkey row_seq, o_orderstatus || substr(o_orderpriority, 1, 1) s, o_totalprice d, o_orderdate::date::varchar shipped, case o_orderkey % 5 when 0 then 0.2 when 1 then 0.9 when 4 then 0.1 else 0.5 end trust from orders)"
_SHORT = lambda: F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))


def _fused(spark, sf_dir, prop: str, slot: str, value, keep: bool = False) -> DataFrame:
    """A property of customers, fused from their orders by the property's rule; keep: with the rejected cells."""
    o, key, source = table(spark, sf_dir, "orders"), F.col("o_orderkey").alias("key_hash"), (F.col("o_orderkey") % 5).cast("int").alias("source_id")
    slots = [(value if s == slot else F.lit(None)).cast(t).alias(s) for s, t in mapping.SLOT_TYPES.items()]
    cells = o.select(source, (F.col("o_orderkey") % 9).alias("batch_id"), F.col("o_orderkey").alias("row_seq"), F.lit("Item").alias("type"), key, F.lit(prop).alias("prop"), *slots, F.lit("").alias("raw"), F.lit("c").alias("column"), F.array().cast("array<int>").alias("chain"), F.lit(0).cast("bigint").alias("chain_fp"), F.lit(None).cast("string").alias("error"))
    clusters = o.select(F.lit("Item").alias("type"), F.struct(source, key).alias("ref"), F.col("o_custkey").cast("string").alias("cluster"))
    names = clusters.select(F.col("cluster").cast("bigint").alias("part"), fusion.entity_id(F.col("cluster"), F.col("type")).alias("entity_id")).distinct()
    return fusion.fuse(cells, clusters, Ontology.read(_ITEM), _TRUST).join(names, "entity_id").select("part", slot, "confidence", "cluster_size", *["rejected"] * keep)


@query(f"select part, s, trust confidence from (select *, row_number() over (partition by part order by trust desc, source_id, k) r from {_CELL}) where r = 1 and part in (select part from {_CELL} group by 1 having count(*) > 1)")
def fuse_most_trusted(spark, sf_dir):
    return _fused(spark, sf_dir, "trusted", "s", _SHORT()).where("cluster_size > 1").select("part", "s", "confidence")


@query(f"with r as (select *, row_number() over (partition by part order by trust desc, source_id, k) r from {_CELL}) select l.part, l.row_seq, l.s \"value\", 'lower source trust (' || printf('%.2f', l.trust) || ' < ' || printf('%.2f', w.trust) || ')' reason from r l join r w on w.part = l.part and w.r = 1 where l.s <> w.s")
def fuse_rejected(spark, sf_dir):
    """What lost under trust, each cell with its reason."""
    lost = _fused(spark, sf_dir, "trusted", "s", _SHORT(), keep=True).select("part", F.explode("rejected").alias("x"))
    return lost.select("part", "x.row_seq", "x.value", "x.reason")


@query(f"select part, s from (select *, row_number() over (partition by part order by batch_id desc, row_seq desc, source_id, k) r from {_CELL}) where r = 1")
def fuse_most_recent(spark, sf_dir):
    return _fused(spark, sf_dir, "recent", "s", _SHORT()).select("part", "s")


@query(f"select part, s from (select part, s, row_number() over (partition by part order by count(*) desc, s) r from {_CELL} group by part, s) where r = 1")
def fuse_most_frequent(spark, sf_dir):
    return _fused(spark, sf_dir, "frequent", "s", _SHORT()).select("part", "s")


@query(f"select part, d from (select part, d, row_number() over (partition by part order by d) r, count(*) over (partition by part) n from {_CELL}) where r = n // 2 + 1")
def fuse_numeric_median(spark, sf_dir):
    return _fused(spark, sf_dir, "median", "d", F.col("o_totalprice")).select("part", "d")


@query(f"select part, repeat(s, (1 + k % 50)::int) s from (select *, row_number() over (partition by part order by k % 50 desc, source_id, k) r from {_CELL}) where r = 1")
def fuse_longest(spark, sf_dir):
    return _fused(spark, sf_dir, "long", "s", F.repeat(_SHORT(), (1 + F.col("o_orderkey") % 50).cast("int"))).select("part", "s")


@query(f"select part, array_to_string(list_sort(list_distinct(list(shipped))), ',') \"all\" from {_CELL} group by 1")
def fuse_union(spark, sf_dir):
    fused = _fused(spark, sf_dir, "all", "l", F.array(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return fused.select("part", F.array_join("l", ",").alias("all"))


_BATCH = [
    {"source": {"id": "c", "source_id": 1, "connector": "memory", "natural_key": ["k"]}, "mappings": [{"target_type": "Customer", "properties": {"name": {"from": "n", "transform": ["trim"]}, "segment": {"from": "s", "transform": ["upper"]}}}]},
]


def _batch(rows: DataFrame, number: int, bundle: Bundle) -> DataFrame:
    fields = F.map_from_arrays(F.array(F.lit("k"), F.lit("n"), F.lit("s")), F.array(F.col("k").cast("string"), F.col("n"), F.col("s")))
    given = rows.select(F.col("k").alias("row_seq"), fields.alias("fields"))
    return mapping.map_rows(given, bundle.sources["c"], number, bundle.ontology).cells


@query("select c_custkey::varchar natural_key, 'name' prop, c_name || case when c_custkey % 3 = 0 then ' II' else '' end \"value\", case when c_custkey % 3 = 0 then 2 else 1 end::bigint batch_id from customer union all select c_custkey::varchar, 'segment', c_mktsegment, 1 from customer where c_custkey % 3 <> 0")
def latest_per_key(spark, sf_dir):
    """Two batches: the second brings a third of the customers anew, without a segment; of each record the newer batch's cells stay."""
    bundle = Bundle.read(ONTOLOGY, _BATCH)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("s"))
    again = c.where("k % 3 = 0").select("k", F.concat("n", F.lit(" II ")).alias("n"), F.lit(None).cast("string").alias("s"))
    cells = _batch(c, 1, bundle).unionByName(_batch(again, 2, bundle))
    return mapping.latest(cells).where("s is not null").select("natural_key", "prop", F.col("s").alias("value"), "batch_id")


_REFS = "(select o_orderkey, case when o_orderkey % 11 = 0 then 'nobody' else c_name end told, o_orderkey % 13 = 0 orphan, o_orderdate ts from orders left join customer on c_custkey = o_custkey)"


def _resolved(spark, sf_dir):
    g = world(spark, sf_dir)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    refs = o.select(F.lit("Order").alias("type"), F.lit(1).alias("source_id"), F.col("o_orderkey").alias("key_hash"), F.lit("placed_by").alias("link"), F.lit("Customer").alias("target_type"), F.lit("name").alias("match_property"), F.when(F.col("o_orderkey") % 11 == 0, "nobody").otherwise(F.col("c_name")).alias("match_value"))
    xref = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(F.lit("Order").alias("type"), F.lit(1).alias("source_id"), F.col("o_orderkey").alias("key_hash"), F.col("o_orderkey").cast("string").alias("entity_id"))
    return links.resolve_links(refs, xref, {"Customer": g.entity("Customer"), "Order": g.entity("Order")}, g.ontology)


@query(f"select 'placed_by' link, count(*) seen, count(*) filter (c is not null and not orphan) written, count(*) filter (c is not null and not orphan) edges, count(*) filter (c is not null and not orphan) time_indexed, count(*) filter (not orphan and c is null) unresolved, count(*) filter (orphan) orphaned from {_REFS} left join (select c_name, min(c_custkey::varchar) c from customer group by 1) on told = c_name")
def link_resolve_report(spark, sf_dir):
    return links.link_report(_resolved(spark, sf_dir))


@query(f"select o_orderkey::varchar src, c dst, ts from {_REFS} join (select c_name, min(c_custkey::varchar) c from customer group by 1) on told = c_name where not orphan")
def link_resolve(spark, sf_dir):
    return links.edges(_resolved(spark, sf_dir)).select("src", "dst", "ts")


_CSV_ROW = "'\"' || c_custkey || '\",\"' || c_name || '\",\"say \"\"hi\"\",' || chr(10) || c_mktsegment || '\"'"


@query(f"select row_number() over (order by c_custkey) row_seq, c_custkey \"key\", c_name \"name\", 'say \"hi\",' || chr(10) || c_mktsegment segment, {_CSV_ROW} raw from customer")
def csv_scan(spark, sf_dir):
    """The customers, written as one CSV file in order and read by the splitter: dense row numbers, cells and verbatim rows."""
    ship(spark)
    path = shared_dir(spark, "csv")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit('say "hi",\n'), F.col("c_mktsegment")).alias("c_mktsegment"))
    c.repartition(1).sortWithinPartitions("c_custkey").write.csv(path, header=True, quoteAll=True, escape='"')
    f = lambda name: F.col("fields")[name]
    return readers.read_csv(spark, path).select("row_seq", f("c_custkey").cast("bigint").alias("key"), f("c_name").alias("name"), f("c_mktsegment").alias("segment"), "raw")


@query("select row_number() over (order by c_custkey) row_seq, c_name \"name\", c_mktsegment segment, '2' \"second\" from customer")
def json_scan(spark, sf_dir):
    """The customers as one JSON body with nested parts, read by path."""
    c = table(spark, sf_dir, "customer")
    body = c.agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))), lambda x: F.struct(x["c_name"].alias("name"), F.struct(x["c_mktsegment"].alias("segment"), F.array(F.lit(1.0), F.lit(2.0)).alias("n")).alias("more"))).alias("rows")).alias("data"))).alias("value"))
    fields = readers.json_rows(body, ["name", "more.segment", "more.n[1]", "absent"], "data.rows")
    return fields.select("row_seq", F.col("fields")["name"].alias("name"), F.col("fields")["more.segment"].alias("segment"), F.col("fields")["more.n[1]"].alias("second"))


_SOURCES = [
    {"source": {"id": "customers", "source_id": 1, "connector": "memory", "natural_key": ["c_custkey"], "trust": 0.8, "filter": [{"column": "c_mktsegment", "matches": "^[A-M]"}]}, "mappings": [{"target_type": "Customer", "properties": {"name": {"from": "c_name", "transform": ["trim", "upper"]}, "balance": {"from": "c_acctbal", "transform": ["to_double"]}, "segment": {"from": "c_mktsegment", "transform": ["title_case"]}}}]},
    {"source": {"id": "suppliers", "source_id": 2, "connector": "memory", "natural_key": ["s_suppkey"], "trust": 0.6}, "mappings": [{"target_type": "Supplier", "properties": {"name": {"from": "s_name", "transform": ["trim"]}, "balance": {"from": "s_acctbal", "transform": ["to_int", "to_double"]}}}]},
]


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[Store, Bundle]:
    """A store with the customers and suppliers; the suppliers' balances fail, as they aren't whole numbers."""
    ship(spark)
    bundle = Bundle.read(ONTOLOGY, _SOURCES)
    store = Store(spark, shared_dir(spark, "store"))
    for name, of in (("customers", "customer"), ("suppliers", "supplier")):
        t = materialise(readers.from_table(table(spark, sf_dir, of).orderBy(*table(spark, sf_dir, of).columns[:1])), "rows")
        ingest.ingest(store, bundle, bundle.sources[name], t, header=table(spark, sf_dir, of).columns)
    return store, bundle


@query("select 1 source_id, 1::bigint batches, count(*) raw_rows, count(*) records, 1::bigint latest_batch from customer where regexp_matches(c_mktsegment, '^[A-M]') union all select 2, 1, count(*), count(*), 1 from supplier")
def source_stats(spark, sf_dir):
    store, _ = _ingested(spark, sf_dir)
    return ingest.source_stats(store.snapshot())


@query("select 1 source_id, count(*) rows_read, count(*) filter (not regexp_matches(c_mktsegment, '^[A-M]')) rows_filtered, count(*) filter (regexp_matches(c_mktsegment, '^[A-M]')) records_written, 3 * count(*) filter (regexp_matches(c_mktsegment, '^[A-M]')) properties_written, 0::bigint properties_rejected from customer union all select 2, count(*), 0, count(*), count(*), count(*) from supplier")
def ingest_manifest(spark, sf_dir):
    store, _ = _ingested(spark, sf_dir)
    return store.snapshot().table("ingest_manifest").select("source_id", "rows_read", "rows_filtered", "records_written", "properties_written", "properties_rejected")


def _provenance(spark, sf_dir):
    store, bundle = _ingested(spark, sf_dir)
    at = store.snapshot()
    now = mapping.latest(at.table("cells"))
    clusters = now.select("type", F.struct("source_id", "key_hash").alias("ref")).distinct().withColumn("cluster", cluster.ref_text("ref"))
    provenance = fusion.fuse(now, clusters, bundle.ontology, {1: 0.8, 2: 0.6})
    return lineage.explained(provenance, at.table("raw"), at.table("ingest_manifest"), bundle)


@query("select n + s entities, 3 * n + s properties, 3 * n + s verified, 0::bigint failed, 0::bigint \"union\", 1.0::double rate from (select count(*) n from customer where regexp_matches(c_mktsegment, '^[A-M]')), (select count(*) s from supplier)")
def provenance_roundtrip(spark, sf_dir):
    return lineage.round_trip(_provenance(spark, sf_dir))


@query("select c_custkey::varchar raw_key, upper(c_name) emitted, c_name raw_value, 'c_name' \"column\", true verified from customer where regexp_matches(c_mktsegment, '^[A-M]')")
def lineage_explain(spark, sf_dir):
    of = _provenance(spark, sf_dir).where("type = 'Customer' and prop = 'name'")
    return of.select(F.split("raw", "\t")[0].alias("raw_key"), F.col("s").alias("emitted"), "raw_value", F.col("origin.column").alias("column"), "verified")


@query("select 'Customer' \"type\", count(*) n from customer union all select 'Supplier', count(*) from supplier union all select 'Nation', count(*) from nation union all select 'Order', count(*) from orders union all select 'Region', count(*) from region union all select 'Part', count(*) from part union all select 'Event', count(*) from events union all select 'User', count(distinct user_id) from events union all select 'Document', count(*) from documents")
def type_counts(spark, sf_dir):
    g = world(spark, sf_dir)
    return reduce(DataFrame.unionByName, [e.agg(F.lit(t).alias("type"), F.count("*").alias("n")) for t, e in g.entities.items()])


_SHIP = {"version": 1, "entity_types": {"Vessel": {"id": 1, "properties": {"name": {"id": 1, "type": "string", "title": True, "fuse": "most_trusted"}, "imo": {"id": 2, "type": "string", "indexed": True}, "mmsi": {"id": 3, "type": "string"}, "call_sign": {"id": 4, "type": "string"}, "flag": {"id": 5, "type": "string"}}}, "Port": {"id": 2, "properties": {"name": {"id": 6, "type": "string", "title": True, "fuse": "most_trusted"}, "locode": {"id": 7, "type": "string"}, "alt_names": {"id": 8, "type": "string[]"}, "country": {"id": 9, "type": "string"}, "lat": {"id": 10, "type": "double", "fuse": "numeric_median"}, "lon": {"id": 11, "type": "double", "fuse": "numeric_median"}}}}}
_VESSEL = {"target_type": "Vessel", "properties": {"name": {"from": "n", "transform": ["trim"]}, "imo": {"from": "i", "transform": ["trim"]}, "mmsi": {"from": "m", "transform": ["to_string"]}}}
_PORT = {"target_type": "Port", "properties": {"name": {"from": "n", "transform": ["title_case"]}, "locode": {"from": "c", "transform": ["trim"]}, "lat": {"from": "lat", "transform": ["to_double"]}, "lon": {"from": "lon", "transform": ["to_double"]}}}
_FLEETS = [
    {"source": {"id": "register", "source_id": 1, "connector": "memory", "natural_key": ["k"], "trust": 0.9}, "mappings": [_VESSEL]},
    {"source": {"id": "broadcast", "source_id": 2, "connector": "memory", "natural_key": ["k"], "trust": 0.5}, "mappings": [_VESSEL]},
    *[{"source": {"id": f"ports{i}", "source_id": 2 + i, "connector": "memory", "natural_key": ["k"], "trust": 0.9 - i / 10}, "mappings": [_PORT]} for i in (1, 2, 3)],
]


def _resolver(spark: SparkSession, given: dict[str, DataFrame]) -> tuple[Store, Bundle, resolve.Resolution]:
    """A store with the given sources' tables, resolved and published."""
    ship(spark)
    bundle = Bundle.read(_SHIP, _FLEETS)
    store = Store(spark, shared_dir(spark, "store"))
    for name, rows in given.items():
        ingest.ingest(store, bundle, bundle.sources[name], materialise(readers.from_table(rows), "rows"), header=rows.columns)
    at = store.snapshot()
    of = resolve.resolve(at.table("cells"), at.table("link_refs"), bundle)
    resolve.publish(store, of)
    return store, bundle, of


@query("select count(*) entities, 2 * count(*) source_records, 0.5::double dedup_ratio from supplier")
def dedup_ratio(spark, sf_dir):
    """Suppliers as vessels of two sources that agree on a number, resolved end to end; counted by the service."""
    s = table(spark, sf_dir, "supplier")
    fleet = lambda name: s.select(F.col("s_suppkey").alias("k"), name.alias("n"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0").alias("i"), (F.col("s_suppkey") + 200_000_000).alias("m"))
    store, bundle, _ = _resolver(spark, {"register": fleet(F.concat(F.lit("Ship "), F.col("s_suppkey"))), "broadcast": fleet(F.concat(F.lit("M/V SHIP "), F.col("s_suppkey")))})
    told = Service(store, bundle).stats()
    return spark.createDataFrame([(told["entities"]["Vessel"], told["source_records"], told["dedup_ratio"])], "entities bigint, source_records bigint, dedup_ratio double")


@query("select n_nationkey nation, 'ports' || a pa, 'ports' || b pb, case when b = 3 then 'non_match' else 'match' end decision, b = 3 vetoed from nation, (values (1, 2), (1, 3), (2, 3)) v(a, b)")
def resolve_ports(spark, sf_dir):
    """Nations as ports of three sources: two agree on code, name and place, the third has another code, which is a veto."""
    n = table(spark, sf_dir, "nation")
    code = lambda c: F.concat(F.lit(c), F.lpad(F.conv(F.col("n_nationkey").cast("string"), 10, 5).cast("string"), 4, "A"))
    ports = lambda c, far: n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"), code(c).alias("c"), (F.col("n_nationkey") * 3 - 40 + far).alias("lat"), (F.col("n_nationkey") * 7 - 90).alias("lon"))
    _, _, of = _resolver(spark, {"ports1": ports("X", 0.0), "ports2": ports("X", 0.01), "ports3": ports("Y", 0.0)})
    names = n.select(F.col("n_nationkey").cast("bigint").alias("nation"), F.xxhash64(F.col("n_nationkey").cast("string")).alias("key"))
    same = of.scored.where("type = 'Port' and a.key_hash = b.key_hash").join(names, F.col("a.key_hash") == F.col("key"))
    source = lambda c: F.concat(F.lit("ports"), F.col(f"{c}.source_id") - 2)
    return same.select("nation", source("a").alias("pa"), source("b").alias("pb"), "decision", "vetoed")


__all__ = ["ORACLES", "QUERIES", "flagship", "query", "table", "world"]
