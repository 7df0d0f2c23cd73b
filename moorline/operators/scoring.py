"""Scoring candidate pairs: vetoes first, then weighted features, then a decision by two thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.functions import geo, text
from moorline.schema.ontology import load

#: Weights before tuning. The tuned ones differ in name_exact, name_jaro_winkler and country_match.
PORT_DEFAULTS = {"locode_exact": 6.0, "name_exact": 3.0, "name_jaro_winkler": 3.0, "name_jaccard": 1.5, "name_contained": 1.5, "alt_name_match": 2.5, "country_match": 1.0, "geo_proximity": 2.5}
PORT_TUNED = {**PORT_DEFAULTS, "name_exact": 5.0, "name_jaro_winkler": 5.0, "country_match": 3.0}
VESSEL_WEIGHTS = {"imo_exact": 8.0, "mmsi_exact": 3.0, "callsign_exact": 2.0, "name_exact": 2.5, "name_jaro_winkler": 3.0, "name_jaccard": 1.0, "flag_match": 0.5}
_FEATURE = "struct<name:string,value:double,weight:double,contribution:double,detail:string>"


@dataclass(frozen=True)
class Weights:
    weights: dict[str, float]
    match: float
    review: float

    def __post_init__(self):
        if self.review > self.match:
            raise ValueError("review_threshold is above match_threshold")

    def weight(self, name: str) -> float:
        return self.weights.get(name, 0.0)


@dataclass(frozen=True)
class Config:
    types: dict[str, Weights] = field(default_factory=lambda: {"Port": Weights(PORT_TUNED, 6.0, 4.0), "Vessel": Weights(VESSEL_WEIGHTS, 5.0, 3.0)})
    port_max_km: float = 150.0
    port_geo_scale_km: float = 25.0

    @classmethod
    def defaults(cls) -> Config:
        return cls({"Port": Weights(PORT_DEFAULTS, 6.0, 4.0), "Vessel": Weights(VESSEL_WEIGHTS, 5.0, 3.0)})

    @classmethod
    def read(cls, source: str | Path | dict) -> Config:
        raw, base = load(source), cls.defaults()
        types = dict(base.types)
        for name, old in base.types.items():
            own = raw.get(name) or {}
            types[name] = Weights({**old.weights, **{k: float(v) for k, v in (own.get("weights") or {}).items()}}, float(own.get("match_threshold", old.match)), float(own.get("review_threshold", old.review)))
        return cls(types, float(raw.get("port_max_km", base.port_max_km)), float(raw.get("port_geo_scale_km", base.port_geo_scale_km)))

    def to_dict(self) -> dict:
        return {**{n: {"weights": dict(w.weights), "match_threshold": w.match, "review_threshold": w.review} for n, w in self.types.items()}, "port_max_km": self.port_max_km, "port_geo_scale_km": self.port_geo_scale_km}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)


def _differ(name: str) -> Column:
    return F.col(f"x.{name}").isNotNull() & F.col(f"y.{name}").isNotNull() & (F.col(f"x.{name}") != F.col(f"y.{name}"))


def _agree(name: str) -> Column:
    return F.col(f"x.{name}") == F.col(f"y.{name}")


def _conflict(name: str) -> Column:
    return F.concat(F.lit(f"{name} conflict: "), F.col(f"x.{name}"), F.lit(" vs "), F.col(f"y.{name}"))


def _feature(w: Weights, name: str, on: Column, value: Column, detail: Column) -> Column:
    weight = F.lit(w.weight(name))
    return F.when(on, F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), weight.alias("weight"), (value * weight).cast("double").alias("contribution"), detail.alias("detail")))


def _name_features(w: Weights, contained: bool) -> list[Column]:
    """Equal canonical names, or else how close they are."""
    a, b, jw = F.col("name_x"), F.col("name_y"), F.col("jw")
    named = F.col("x.name").isNotNull() & F.col("y.name").isNotNull()
    close, jaccard = named & (a != b), text.token_jaccard(F.col("words_x"), F.col("words_y"))
    out = [
        _feature(w, "name_exact", named & (a == b), F.lit(1.0), a),
        _feature(w, "name_jaro_winkler", close, jw, F.concat(a, F.lit(" / "), b)),
        _feature(w, "name_jaccard", close & (jaccard > 0), jaccard, F.round(jaccard, 2).cast("string")),
    ]
    if contained:
        out.append(_feature(w, "name_contained", close & text.tokens_contained(F.col("words_x"), F.col("words_y")), F.lit(1.0), F.lit("one name contains the other")))
    return out


def score_pairs(pairs: DataFrame, records: DataFrame, type_name: str, config: Config | None = None) -> DataFrame:
    """type, a, b, via, features, score, vetoed, veto_reason, decision of a type's candidate pairs."""
    config = config or Config()
    own = records.select(F.struct("source_id", "key_hash").alias("ref"), F.struct(*[c for c in records.columns if c not in ("source_id", "key_hash")]).alias("rec"))
    joined = pairs.where(F.col("type") == type_name).join(own.select(F.col("ref").alias("a"), F.col("rec").alias("x")), "a").join(own.select(F.col("ref").alias("b"), F.col("rec").alias("y")), "b")
    if type_name not in config.types:
        none = F.array().cast(f"array<{_FEATURE}>")
        return joined.select("type", "a", "b", "via", none.alias("features"), F.lit(0.0).alias("score"), F.lit(False).alias("vetoed"), F.lit(None).cast("string").alias("veto_reason"), F.lit("non_match").alias("decision"))
    w = config.types[type_name]
    words = text.port_tokens if type_name == "Port" else text.vessel_tokens
    joined = joined.withColumns({"words_x": words(F.col("x.name")), "words_y": words(F.col("y.name"))})
    joined = joined.withColumns({"name_x": text.canonical(F.col("words_x")), "name_y": text.canonical(F.col("words_y"))})
    joined = joined.withColumn("jw", text.jaro_winkler(F.col("name_x"), F.col("name_y")))
    if type_name == "Port":
        km = geo.haversine_km(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
        joined = joined.withColumn("km", km)
        veto = F.when(_differ("locode"), _conflict("locode")).when(_differ("country"), _conflict("country")).when(F.col("km") > config.port_max_km, F.concat(F.round("km").cast("int").cast("string"), F.lit(f" km apart, beyond {config.port_max_km:.0f} km")))
        other = lambda own, name: F.exists(F.coalesce(F.col(f"{own}.alt_names"), F.array().cast("array<string>")), lambda alt: text.canonical(text.port_tokens(alt)) == F.col(name))
        features = [
            _feature(w, "locode_exact", _agree("locode"), F.lit(1.0), F.concat(F.lit("both "), F.col("x.locode"))),
            *_name_features(w, True),
            _feature(w, "alt_name_match", F.col("x.name").isNotNull() & F.col("y.name").isNotNull() & (other("x", "name_y") | other("y", "name_x")), F.lit(1.0), F.lit("one's name is an alternate name of the other")),
            _feature(w, "country_match", _agree("country"), F.lit(1.0), F.concat(F.lit("both "), F.col("x.country"))),
            _feature(w, "geo_proximity", F.col("km").isNotNull(), F.exp(-F.col("km") / config.port_geo_scale_km), F.concat(F.round("km", 1).cast("string"), F.lit(" km apart"))),
        ]
    else:
        veto = F.when(_differ("imo"), _conflict("imo"))
        exact = [("imo_exact", "imo"), ("mmsi_exact", "mmsi"), ("callsign_exact", "call_sign")]
        features = [*[_feature(w, f, _agree(c), F.lit(1.0), F.concat(F.lit("both "), F.col(f"x.{c}"))) for f, c in exact], *_name_features(w, False), _feature(w, "flag_match", _agree("flag"), F.lit(1.0), F.concat(F.lit("both "), F.col("x.flag")))]
    made = joined.select("type", "a", "b", "via", veto.alias("veto_reason"), F.array_compact(F.array(*features)).alias("features"))
    made = made.withColumn("features", F.when(F.col("veto_reason").isNull(), F.col("features")).otherwise(F.array().cast(f"array<{_FEATURE}>")))
    return decide(made.withColumn("score", total("features")), w)


def total(features: str) -> Column:
    return F.aggregate(F.col(features), F.lit(0.0), lambda so_far, f: so_far + f["contribution"])


def decide(scored: DataFrame, w: Weights) -> DataFrame:
    """A veto is no match whatever the score."""
    vetoed, score = F.col("veto_reason").isNotNull(), F.col("score")
    decision = F.when(vetoed, "non_match").when(score >= w.match, "match").when(score >= w.review, "review").otherwise("non_match")
    return scored.select("type", "a", "b", "via", "features", "score", vetoed.alias("vetoed"), "veto_reason", decision.alias("decision"))


def rescore(scored: DataFrame, w: Weights) -> DataFrame:
    """The same features under other weights."""
    none = F.lit(0.0)
    lookup = F.create_map(*[F.lit(y) for k, v in w.weights.items() for y in (k, v)]) if w.weights else None

    def again(f: Column) -> Column:
        own = F.coalesce(F.try_element_at(lookup, f["name"]), none) if lookup is not None else none
        return F.struct(f["name"].alias("name"), f["value"].alias("value"), own.alias("weight"), (f["value"] * own).alias("contribution"), f["detail"].alias("detail"))

    made = scored.withColumn("features", F.transform("features", again))
    return decide(made.withColumn("score", total("features")), w)


def top_contributions(n: int = 4) -> Column:
    """The features that count most, by the size of their contribution."""
    ranked = F.array_sort(F.transform("features", lambda f: F.struct((-F.abs(f["contribution"])).alias("k"), f["name"].alias("name"), f["contribution"].alias("contribution"))))
    return F.slice(ranked, 1, n)


def explanation(n: int = 4) -> Column:
    shown = F.transform(top_contributions(n), lambda f: F.concat(f["name"], F.lit(" "), F.format_number(f["contribution"], 2)))
    return F.when(F.col("vetoed"), F.concat(F.lit("vetoed: "), F.col("veto_reason"))).otherwise(F.array_join(shown, ", "))


def decision_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.count_if((F.col("decision") == d) & ~F.col("vetoed")).alias(d) for d in ("match", "review", "non_match")], F.count_if("vetoed").alias("vetoed"))


def pair_id() -> Column:
    """A hash of the ordered pair, so that equal keys of two sources don't cancel out."""
    return F.xxhash64(F.col("a.source_id"), F.col("a.key_hash"), F.col("b.source_id"), F.col("b.key_hash"))


def review_queue(scored: DataFrame) -> DataFrame:
    """Pairs between the thresholds; read it ordered by score, then pair_id."""
    return scored.where("decision = 'review'").select(pair_id().alias("pair_id"), "type", "a", "b", "score", "features", explanation().alias("explanation"))


def apply_reviews(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewers' last words (pair_id, decision accept or reject, at): accepted pairs match, rejected ones are vetoed."""
    last = decisions.groupBy("pair_id").agg(F.max_by("decision", "at").alias("said"))
    joined = scored.withColumn("pair_id", pair_id()).join(last, "pair_id", "left")
    rejected = F.coalesce(F.col("said") == "reject", F.lit(False))
    decision = F.when(F.col("said") == "accept", "match").when(rejected, "non_match").otherwise(F.col("decision"))
    return joined.select("type", "a", "b", "via", "features", "score", (rejected | (F.col("vetoed") & (F.coalesce("said", F.lit("")) != "accept"))).alias("vetoed"), F.when(rejected, F.lit("rejected by review")).otherwise(F.col("veto_reason")).alias("veto_reason"), decision.alias("decision"))
