"""Ingestion to lineage on a small corpus of ports, vessels and voyages of our own."""

import pytest
from pyspark.sql import functions as F

from moorline.operators import blocking, cluster, evaluate, ingest, lineage, resolve, scoring
from moorline.plans import executor
from moorline.plans.ir import Query, RequestError
from moorline.schema.mapping import Bundle
from moorline.sources import rows as R
from moorline.stage import materialise
from moorline.tables import Store

ONTOLOGY = {
    "version": 1,
    "entity_types": {
        "Port": {"id": 1, "properties": {"name": {"id": 1, "type": "string", "title": True, "indexed": True}, "locode": {"id": 2, "type": "string", "indexed": True, "unique_hint": True}, "alt_names": {"id": 3, "type": "string[]"}, "country": {"id": 4, "type": "string", "fuse": "most_frequent"}, "lat": {"id": 5, "type": "double", "fuse": "numeric_median"}, "lon": {"id": 6, "type": "double", "fuse": "numeric_median"}}, "display": "{name} ({locode})"},
        "Vessel": {"id": 2, "properties": {"name": {"id": 10, "type": "string", "title": True, "fuse": "most_recent"}, "imo": {"id": 11, "type": "string", "indexed": True}, "mmsi": {"id": 12, "type": "string", "indexed": True}, "call_sign": {"id": 13, "type": "string"}, "flag": {"id": 14, "type": "string"}}},
        "Voyage": {"id": 3, "properties": {"ref": {"id": 20, "type": "string"}, "arrived_at": {"id": 21, "type": "timestamp"}}},
    },
    "link_types": {"arrives_at": {"id": 1, "from": "Voyage", "to": "Port", "cardinality": "many_to_one", "inverse": "arrivals", "time_index": "arrived_at"}},
}
PORTS = {"name": {"from": "n", "transform": ["trim", "collapse_ws", "title_case"]}, "locode": {"from": "c", "transform": ["validate_locode"]}, "alt_names": {"from": "a", "transform": ["split_semicolon"]}, "country": {"from": "k", "transform": ["upper"]}, "lat": {"from": "lat", "transform": ["to_double"]}, "lon": {"from": "lon", "transform": ["to_double"]}}
SOURCES = [
    {"source": {"id": "p1", "source_id": 1, "connector": "memory", "natural_key": ["i"], "trust": 0.8}, "mappings": [{"target_type": "Port", "properties": PORTS}]},
    {"source": {"id": "p2", "source_id": 2, "connector": "memory", "natural_key": ["i"], "trust": 0.95}, "mappings": [{"target_type": "Port", "properties": PORTS}]},
    {"source": {"id": "v", "source_id": 3, "connector": "memory", "natural_key": ["i"]}, "mappings": [{"target_type": "Vessel", "properties": {"name": {"from": "n", "transform": ["trim"]}, "imo": {"from": "imo", "transform": ["validate_imo"]}, "mmsi": {"from": "m", "transform": ["to_string"]}, "flag": {"from": "m", "transform": ["mid_to_country"]}}}]},
    {"source": {"id": "y", "source_id": 4, "connector": "memory", "natural_key": ["i"]}, "mappings": [{"target_type": "Voyage", "properties": {"ref": {"from": "i", "transform": ["to_string"]}, "arrived_at": {"from": "ata", "transform": ["parse_timestamp"]}}, "links": [{"type": "arrives_at", "via": {"from": "to", "match_property": "locode"}}]}]},
]
P = ["i", "n", "c", "a", "k", "lat", "lon"]
P1 = [["1", "PORT OF ROTTERDAM", "NLRTM", "Europoort; Botlek", "nl", "51.90", "4.48"], ["2", "HAMBURG", "", "", "de", "53.54", "9.98"], ["3", "ANTWERP", "BEANR", "", "be", "51.23", "4.40"], ["4", "SPRINGFIELD", "", "", "us", "", ""]]
P2 = [["a", "Rotterdam", "NLRTM", "", "nl", "51.92", "4.50"], ["b", "Hamburg Harbour", "DEHAM", "", "de", "53.55", "9.99"], ["c", "Antwerpen", "BEANR", "Anvers", "be", "51.24", "4.41"], ["d", "Springfield", "USSPR", "", "us", "", ""], ["e", "Springfield", "USSPI", "", "us", "", ""]]
V = [["1", "BALTIC TRADER", "9074729", "244000001"], ["2", "M/V Baltic Trader", "9074729", "244000001"], ["3", "NORTH STAR", "9387425", "244000001"]]
Y = [[str(i), "NLRTM" if i % 3 == 0 else "DEHAM" if i % 3 == 1 else "XXXXX", "" if i % 10 == 9 else f"2026-0{1 + i % 6}-15T10:00:00Z"] for i in range(30)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    bundle = Bundle.read(ONTOLOGY, SOURCES)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    tables = {"p1": (P, P1), "p2": (P, P2), "v": (["i", "n", "imo", "m"], V), "y": (["i", "to", "ata"], Y)}
    for name, (columns, rows) in tables.items():
        ingest.ingest(store, bundle, bundle.sources[name], R.memory_table(spark, columns, rows), f"{name}-1", header=columns)
    at = store.snapshot()
    of = resolve.resolve(at.table("cells"), at.table("link_refs"), bundle)
    return store, bundle, of


def test_ingest_is_idempotent(spark, world):
    store, bundle, _ = world
    before = store.snapshot().version
    again = ingest.ingest(store, bundle, bundle.sources["p1"], R.memory_table(spark, P, P1), "p1-1", header=P)
    assert again.skipped and store.snapshot().version == before
    stats = {r.source_id: r for r in ingest.source_stats(store.snapshot()).collect()}
    assert stats[1].raw_rows == 4 and stats[4].records == 30


def test_ingested_tables_are_safe(world):
    store = world[0]
    with pytest.raises(ValueError):
        store.clear("raw")
    with pytest.raises(ValueError):
        store.publish(replace={"cells": store.snapshot().table("cells")})


def test_clusters_respect_vetoes(world):
    _, _, of = world
    stats = cluster.cluster_stats(of.clusters.where("type = 'Port'")).first()
    # The bare Springfield matches both coded ones, which a code conflict keeps apart: one joins it, the other can't.
    assert (stats.clusters, stats.largest) == (5, 2)
    assert of.refused.count() == 1
    assert cluster.cluster_stats(of.transitive.where("type = 'Port'")).first().largest == 3
    assert cluster.cluster_stats(of.clusters.where("type = 'Vessel'")).first().clusters == 2


def test_scores(world):
    scored = world[2].scored
    by = {r.decision: r.n for r in scored.groupBy("decision").agg(F.count("*").alias("n")).collect()}
    assert by["match"] >= 4 and scored.where("vetoed and veto_reason like 'locode conflict%'").count() >= 1
    assert scored.where("type = 'Vessel' and vetoed and veto_reason like 'imo conflict%'").count() == 2
    text = scored.where("decision = 'match' and type = 'Port'").select(scoring.explanation().alias("e")).first().e
    assert "locode_exact 6.00" in text or "name_exact 5.00" in text
    again = scoring.rescore(scored.where("type = 'Vessel'"), scoring.Weights({"imo_exact": 0.1}, 5.0, 3.0))
    assert again.where("decision = 'match'").count() == 0


def test_fused_values(world):
    ports = {r.locode: r for r in world[2].entities["Port"].where("locode is not null").collect()}
    assert ports["NLRTM"].name == "Rotterdam"  # the more trusted source
    assert ports["NLRTM"].lat == 51.92  # the upper median
    assert ports["NLRTM"].alt_names == ["Botlek", "Europoort"]
    assert len(ports["NLRTM"].entity_id) == 26


def test_links_and_report(world):
    _, _, of = world
    r = of.link_report.first()
    assert (r.seen, r.written, r.unresolved, r.orphaned) == (30, 20, 10, 0) and r.time_indexed == of.links.where("ts is not null").count()


def test_round_trip_and_negative_control(world):
    store, bundle, of = world
    at = store.snapshot()
    explained = materialise(lineage.explained(of.provenance, at.table("raw"), at.table("ingest_manifest"), bundle), "explained")
    got = lineage.round_trip(explained).first()
    assert got.failed == 0 and got.rate == 1.0 and got.properties == of.provenance.count()
    assert "replay agrees" in lineage.render(explained.first())
    spoilt = at.table("raw").withColumn("raw", F.when((F.col("source_id") == 2) & (F.col("row_seq") == 1), F.regexp_replace("raw", "Rotterdam", "Amsterdam")).otherwise(F.col("raw")))
    broken = lineage.explained(of.provenance, spoilt, at.table("ingest_manifest"), bundle).where("not verified").collect()
    assert [(r.prop, r.failure) for r in broken] == [("name", "differs")]
    gone = lineage.explained(of.provenance, at.table("raw").where("source_id <> 2 or row_seq <> 1"), at.table("ingest_manifest"), bundle)
    assert gone.where("failure = 'no_raw_row'").count() >= 1


def test_traversal(world):
    _, bundle, of = world
    g = executor.Graph(bundle.ontology, of.entities, of.links)
    window = {"gte": "2026-02-01T00:00:00Z", "lt": "2026-05-01T00:00:00Z"}
    request = {"start": {"type": "Port", "filter": {"locode": "NLRTM"}}, "hops": [{"link": "arrivals", "where": {"arrived_at": window}}]}
    got = executor.run(g, Query.from_json(request)).to_dict(bundle.ontology)
    expected = [i for i in range(0, 30, 3) if i % 10 != 9 and 2 <= 1 + i % 6 < 5]
    assert got["count"] == len(expected) == got["total_before_limit"] and got["_plan"]["index_used"] == "TIDX"
    assert len(got["edges"]) == len(expected)
    back = executor.run(g, Query.from_json({"start": {"type": "Voyage"}, "hops": [{"link": "arrives_at"}]}))
    assert back.total() == 2
    for bad in ({"start": {"type": "Pier"}}, {"start": {"type": "Port", "filter": {"nome": 1}}}, {"start": {"type": "Port"}, "hops": [{"link": "arrives_at"}]}, {"start": {"type": "Port"}, "limit": 0}, {"start": {"type": "Port", "filter": {"name": {"like": "x"}}}}):
        with pytest.raises(RequestError):
            executor.run(g, Query.from_json(bad))


def test_evaluation_and_tuning(spark, world):
    _, bundle, of = world
    golden = evaluate.golden_pairs(bundle, "record_a,record_b,label,truth_id\np1:1,p2:a,match,1\np1:2,p2:b,match,2\np1:3,p2:c,match,3\np2:d,p2:e,non_match,4\n", spark)
    overall = evaluate.evaluate(of.scored, golden).where("split = 'overall'").first()
    assert (overall.tp, overall.fp, overall.fn) == (3, 0, 0) and overall.f1 == 1.0
    assert blocking.coverage(of.scored, golden).first().completeness == 1.0
    weights, f1 = evaluate.tune([{"a": 1.0}, {"b": 1.0}], [True, False], [False, False], scoring.Weights({"a": 0.0, "b": 3.0}, 2.0, 1.0))
    assert f1 == 1.0 and weights.weight("a") > 0
    with pytest.raises(ValueError):
        evaluate.golden_pairs(bundle, "record_a,record_b,label,truth_id\nzz:1,p2:a,match,1\n", spark)
    with pytest.raises(ValueError):
        scoring.Weights({}, 1.0, 2.0)


def test_reviews_survive_as_their_own_table(spark, world):
    _, _, of = world
    pair = of.scored.where("decision = 'match' and type = 'Port'").select(scoring.pair_id().alias("pair_id"), F.lit("reject").alias("decision"), F.current_timestamp().alias("at")).limit(1)
    after = scoring.apply_reviews(of.scored, materialise(pair, "decisions"))
    assert after.where("veto_reason = 'rejected by review'").count() == 1


def test_publication(world):
    store, _, of = world
    pinned = store.snapshot()
    resolve.publish(store, of)
    assert not pinned.has("provenance") and store.snapshot().table("entity_Port").count() == 5


def test_service(world):
    from moorline.api import Service, status_of

    store, bundle, of = world
    resolve.publish(store, of)
    service = Service(store, bundle)
    assert {t["name"] for t in service.ontology()["types"]} == {"Port", "Vessel", "Voyage"}
    found = service.list_entities("Port", q="rott").collect()
    assert [r.display for r in found] == ["Rotterdam (NLRTM)"]
    one = found[0].entity_id
    assert service.entity(one)["type"] == "Port" and {p["prop"] for p in service.entity(one)["provenance"]} >= {"name", "locode", "lat"}
    assert service.links_of(one, "arrivals").where("reverse").count() == 10
    assert service.lineage(one, "name").first().verified and service.raw(2, 1, 1).startswith("a\tRotterdam")
    assert service.entity_of(2, "a").first().entity_id == one
    assert service.explain({"start": {"type": "Port", "filter": {"locode": "NLRTM"}}})["index_used"] == "IDX"
    assert service.traverse({"start": {"type": "Port", "ids": [one]}})["count"] == 1
    assert service.stats()["entities"] == {"Port": 5, "Vessel": 2, "Voyage": 30} and service.health()["status"] == "ok"
    assert service.by_value("Port", "locode").first().locode == "BEANR" and service.review().count() == of.scored.where("decision = 'review'").count()
    for wrong, status in ((lambda: service.entity("none"), 404), (lambda: service.list_entities("Pier"), 400), (lambda: service.review(0), 400), (lambda: service.raw(9, 9, 9), 404)):
        with pytest.raises(Exception) as e:  # noqa: PT011
            wrong()
        assert status_of(e.value) == status


def test_http(world):
    import json
    import threading
    import urllib.error
    import urllib.request
    from http.server import ThreadingHTTPServer

    from moorline import serve
    from moorline.api import Service

    store, bundle, of = world
    resolve.publish(store, of)
    server = ThreadingHTTPServer(("127.0.0.1", 0), serve.handler(Service(store, bundle)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", data=body) as r:
                assert r.headers["Access-Control-Allow-Origin"] == "*"
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/api/health") == (200, {"status": "ok", "version": store.snapshot().version})
        status, found = ask("/api/entities/Port?q=rott&limit=5")
        assert status == 200 and [r["display"] for r in found] == ["Rotterdam (NLRTM)"]
        assert ask("/api/traverse", json.dumps({"start": {"type": "Port", "ids": [found[0]["entity_id"]]}}).encode())[1]["count"] == 1
        assert [ask(p)[0] for p in ("/api/entity/none", "/api/entities/Pier", "/api/review?limit=0", "/api/raw/1/x/2", "/nothing", "/api/raw/9/9/9")] == [404, 400, 400, 400, 404, 404]
    finally:
        server.shutdown()


def test_cluster_metrics(spark, world):
    _, bundle, of = world
    golden = evaluate.golden_pairs(bundle, "record_a,record_b,label,truth_id\np1:1,p2:a,match,1\np1:2,p2:b,match,2\np2:d,p2:e,non_match,4\np1:1,p1:2,match,9\n", spark)
    assert set(r.split for r in golden.collect()) <= {"holdout", "train"}
    got = cluster.metrics(of.clusters, golden, of.refused).first()
    assert (got.tp, got.fp, got.fn, got.precision, got.refused_merges) == (2, 0, 1, 1.0, 1) and got.recall == pytest.approx(2 / 3)


def test_large_components_are_settled_as_in_one_task(spark, monkeypatch):
    import random

    own = random.Random(6)
    ref = lambda i: (1, i)
    pairs = {(own.randrange(40), own.randrange(40)) for _ in range(110)}
    rows = [(ref(a), ref(b), float(own.randrange(6)), "match", False) for a, b in sorted(pairs) if a < b] + [(ref(a), ref(b), 0.0, "non_match", True) for a, b in sorted(pairs) if a > b]
    kind = "a struct<source_id:int,key_hash:bigint>, b struct<source_id:int,key_hash:bigint>, score double, decision string, vetoed boolean"
    scored = spark.createDataFrame(rows, kind)
    records = spark.createDataFrame([("T", ref(i)) for i in range(40)], "type string, ref struct<source_id:int,key_hash:bigint>")
    told = []
    for largest in (200_000, 0):
        monkeypatch.setattr(cluster, "LARGEST", largest)
        clusters, refused = cluster.constrained(scored, records)
        told.append((sorted((r.ref.key_hash, r.cluster) for r in clusters.collect()), sorted((r.a, r.b) for r in refused.collect())))
    assert told[0] == told[1] and len(told[0][1]) > 3 and len(told[0][0]) == 40


def test_commands(spark, tmp_path):
    import json

    from moorline import cli

    (tmp_path / "o.json").write_text(json.dumps(ONTOLOGY))
    lines = lambda rows: "\n".join(",".join(f'"{c}"' for c in r) for r in [P, *rows])
    sources = []
    for name, rows, i in (("p1", P1, 1), ("p2", P2, 2)):
        (tmp_path / f"{name}.csv").write_text(lines(rows))
        sources.append({"source": {"id": name, "source_id": i, "connector": "csv", "uri": f"{name}.csv", "natural_key": ["i"], "trust": 0.8}, "mappings": [{"target_type": "Port", "properties": PORTS}]})
    bundle, store = Bundle.read(ONTOLOGY, sources), str(tmp_path / "store")
    ask = lambda *words: cli.run(cli.parser().parse_args(["--ontology", "o", "--mappings", "m", "--store", store, "--root", str(tmp_path), *words]), spark)
    read, cli.Bundle = cli.Bundle, type("Given", (), {"read": staticmethod(lambda *_: bundle)})
    try:
        assert ask("ingest", "p1")[0]["records_written"] == 4 and ask("ingest", "p2")[0]["rows_read"] == 5
        told = ask("block")
        assert told["candidate_pairs"] >= 4 and set(told["by_generator"])
        (tmp_path / "golden.csv").write_text("record_a,record_b,label,truth_id\np1:1,p2:a,match,1\np2:d,p2:e,non_match,4\n")
        judged = ask("eval", str(tmp_path / "golden.csv"))
        assert judged["clusters"]["f1"] == 1.0 and judged["blocking"]["completeness"] == 1.0
        assert ask("resolve")["match"] >= 3 and ask("stats")["entities"]["Port"] == 5
    finally:
        cli.Bundle = read


def test_vessel_scores_use_all_generators(spark, tmp_path):
    from moorline import catalogue

    rows = [(1, "Nova Star", 1), (3, "Nova Star", 2), (5, "Quick Whale", 3)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalogue.QUERIES["vessel_scores"](spark, str(tmp_path)).collect()
    assert [(r.a, r.b) for r in got] == [(1, 3)]


@pytest.mark.parametrize("n", [120, 100_100])
def test_window_equals_scan(spark, tmp_path, monkeypatch, n):
    """Orders on both bounds, without a date and of another segment; and more orders than max_expand is by default."""
    from moorline import catalogue
    from moorline.plans import ir

    empty = {"region": "r_regionkey bigint, r_name string", "nation": "n_nationkey bigint, n_name string, n_regionkey bigint", "supplier": "s_suppkey bigint, s_name string, s_acctbal double, s_nationkey bigint", "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", "lineitem": "l_orderkey bigint, l_partkey bigint", "events": "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz", "documents": "doc_id bigint, lang string, source string, n_chars int"}
    tables = {name: spark.createDataFrame([], columns) for name, columns in empty.items()}
    tables["customer"] = spark.createDataFrame([(1, "a", 0.0, "MACHINERY", 0), (2, "b", 0.0, "BUILDING", 0), (3, "c", 0.0, "MACHINERY", 0)], "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string, c_nationkey bigint")
    # The keys from 90 on, or from 99000 to 99999, come last as strings, and all but the special ones are in the quarter.
    inside = "id between 90 and 99 or id between 99000 and 99999"
    day = f"case id when 92 then null when 93 then timestamp_ntz '1995-12-31 23:59:59' when 94 then timestamp_ntz '1996-01-01' when 95 then timestamp_ntz '1996-03-31 23:59:59' when 96 then timestamp_ntz '1996-04-01' else if({inside}, timestamp_ntz '1996-02-03', timestamp_ntz '1994-05-06') end"
    tables["orders"] = spark.range(1, n + 1).selectExpr("id o_orderkey", "if(id = 97, 2, 1) o_custkey", "'O' o_orderstatus", "1.0D o_totalprice", f"{day} o_orderdate", "'1-URGENT' o_orderpriority")
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    ask = lambda: tuple(catalogue.QUERIES["window_equals_scan"](spark, str(tmp_path)).first())
    right = 6 + (1000 if n > 99_999 else 0)
    assert ask() == (right, right, True)
    monkeypatch.setattr(ir.Window, "column", lambda self, ts: (ts > ir.instant(self.low)) & (ts <= ir.instant(self.high)))
    assert ask() == (right, right, False)
