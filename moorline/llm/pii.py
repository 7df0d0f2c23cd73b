"""Personal data: generators propose overlapping spans, boosted trees judge them, calibrated thresholds select.

Spark SQL expressions alone find, judge, resolve and redact spans. Exact base patterns always count; the trees add
spans of looser forms and of secrets where no base span lies. Of overlapping added spans the best judged stays.

A null text counts as empty and has no spans. Positions are code points, ends exclusive. Repeated rows each get their
own result, and very long texts are searched whole: no pattern bounds a run's length or goes back over one, and passes over
matches are in blocks. Whether a span counts depends on itself and the 32 code points before it, on nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .pii_model import CONTEXT, DOMAIN, FEATURES, KINDS, ZERO, Node, fitted

#: The base patterns as given, written so that no search goes back: a match starts where a run of its first class does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A number up to 255 with any zeros before it, or zeros alone.
_BYTE = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})|0++)"
#: Looser generators of candidates for the trees, with no bound on a run's length.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?\((?:at|AT)\)\x20?|\x20?\[(?:at|AT)\]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){3,}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?+[0-9])++",
    "phone": r"(?<![0-9+])\(?[0-9]++\)?(?:[\x20./-]?+[0-9]++)*+",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
#: What a text with a candidate always holds: else the generator needn't run.
NEEDS = {"email": r"\((?:at|AT)\)|\[(?:at|AT)\]|\x20at\x20", "ip": ":", "card": "[0-9]", "phone": "[0-9]", "secret": "[A-Za-z0-9+/_-]{16}"}
#: Numbers of digits of what can be a card or phone number at all.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: Code points before a candidate that the trees see.
BEFORE = 32
#: Elements that a running pass over an array takes at once: a pass copies its results so far within such a block only.
BLOCK = 128
_SPAN = "struct<kind:string,rank:int,first:bigint,last:bigint,match:string,before:string>"
_SPANS = f"array<{_SPAN}>"


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used, also in lambdas within."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, start: Column, step, kind: str) -> Column:
    """The state before each item, of a pass from start by step(state, item); kind is the state's type.

    In two levels: first the state before each block of items, then those within a block. So the time grows with the
    items, not with their square, up to the square of the number of blocks.
    """

    def note(move):
        return lambda so_far, x: F.struct(move(so_far["now"], x).alias("now"), F.concat(so_far["seen"], F.array(so_far["now"])).alias("seen"))

    begin = lambda at: F.struct(at.cast(kind).alias("now"), _none(f"array<{kind}>").alias("seen"))
    typed = lambda a, x: step(a, x).cast(kind)

    def passed(blocks: Column) -> Column:
        starts = F.aggregate(blocks, begin(start), note(lambda now, block: F.aggregate(block, now, typed)), lambda x: x["seen"])
        each = F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("at")), lambda z: F.aggregate(z["block"], begin(z["at"]), note(typed), lambda x: x["seen"]))
        return F.flatten(each)

    last = lambda n: F.greatest(F.ceil(n / BLOCK).cast("int") - 1, F.lit(0))
    cut = lambda own: F.transform(F.sequence(F.lit(0), last(F.size(own))), lambda i: F.slice(own, i * BLOCK + 1, F.lit(BLOCK)))
    return let(let(items, cut), passed)


def _places(text: Column, pattern: str, kind: str, context: bool) -> Column:
    """All matches of pattern, leftmost and not overlapping, as spans: what lies between them gives their places."""
    matches = F.regexp_extract_all(text, _literal(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda x: x["m"].isNotNull())
    if context:
        # What stands before a match is followed along, as cutting it out of the text would take the whole text each time.
        tail = lambda a, x: F.right(F.concat(a, x), F.lit(BEFORE))
        state, kind_of_state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail")), "struct<at:bigint,tail:string>"
        step = lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), tail(a["tail"], F.concat(F.right(x["g"], F.lit(BEFORE)), F.right(x["m"], F.lit(BEFORE)))).alias("tail"))
    else:
        state, kind_of_state = F.struct(F.lit(0).cast("bigint").alias("at")), "struct<at:bigint>"
        step = lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"))

    def span(z: Column) -> Column:
        first = z["s"]["at"] + F.length(z["p"]["g"])
        before = tail(z["s"]["tail"], F.right(z["p"]["g"], F.lit(BEFORE))) if context else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), first.alias("first"), (first + F.length(z["p"]["m"])).alias("last"), z["p"]["m"].alias("match"), before.alias("before"))

    return let(pairs, lambda own: F.transform(F.arrays_zip(own.alias("p"), running(own, state, step, kind_of_state).alias("s")), span))


def _found(text: Column, pattern: str, kind: str, needs: Column, context: bool = False) -> Column:
    return F.when(needs, _places(text, pattern, kind, context)).otherwise(_none(_SPANS))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """The base rules beyond the patterns."""
    n = F.length(_digits(x))
    if kind == "ip":
        return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", _digits(x))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _validator(kind: str):
    return lambda x: _valid(kind, x["match"])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _features(x: Column, before: Column) -> dict[str, Column]:
    """A candidate's features, as pii_model.describe has them."""
    match, low = x["match"], F.lower(before)
    number = lambda c: c.cast("double")
    out = {
        "length": number(F.length(match)),
        "digits": number(F.length(_digits(match))),
        "letters": number(F.length(F.regexp_replace(match, "[^A-Za-z]", ""))),
        "marks": number(F.length(F.regexp_replace(match, "[^ ().:@_+/=-]", ""))),
        "groups": number(F.length(F.regexp_replace(F.regexp_replace(match, "[0-9]+", "9"), "[^0-9]+", ""))),
        "luhn": number(F.call_function("luhn_check", _digits(match))),
        "variety": F.size(F.array_distinct(F.split(match, ""))) / F.length(match),
        "cases": number(match.rlike("[a-z]")) + number(match.rlike("[A-Z]")),
        "hex": number(match.rlike("^[0-9A-Fa-f]+$")),
        "sign": number(match.rlike(r"^[+(]")),
        "kind": number(x["rank"]),
        "zero": number(match.rlike(ZERO)),
        "domain": number(match.rlike(DOMAIN)),
    }
    out |= {name: number(low.rlike(pattern)) for name, pattern in CONTEXT.items()}
    return out


def _tree(node: Node, row: str) -> str:
    if node.low is None:
        return f"{node.value!r}D"
    return f"CASE WHEN {row}.`{FEATURES[node.feature]}` <= {node.at!r}D THEN {_tree(node.low, row)} ELSE {_tree(node.high, row)} END"


def score_sql(row: str) -> str:
    """The sum of the trees for a row of features, as SQL: one text is parsed far faster than as many calls are made."""
    trees, _ = fitted()
    return " + ".join(f"({_tree(t, row)})" for t in trees)


def threshold_sql(kind: str) -> str:
    _, thresholds = fitted()
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {at!r}D" for k, at in thresholds.items() if at < float("inf")) + " ELSE double('infinity') END"


def _possible(kind: str):
    least, most = DIGITS.get(kind, (0, 0))
    return lambda x: F.length(_digits(x["match"])).between(least, most) if kind in DIGITS else F.lit(True)


def _apart(loose: Column, base: Column) -> Column:
    """The loose spans that overlap no base span: base spans are met from the left by their furthest end, from the right by their nearest start."""
    mark = lambda own: lambda x: F.struct(x["first"].alias("first"), F.lit(own).alias("loose"), x.alias("span"))

    def clear(both: Column) -> Column:
        left = running(both, F.lit(0), lambda a, x: F.when(x["loose"] == 0, F.greatest(a, x["span"]["last"])).otherwise(a), "bigint")
        right = F.reverse(running(F.reverse(both), F.lit(1 << 62), lambda a, x: F.when(x["loose"] == 0, x["first"]).otherwise(a), "bigint"))
        return F.filter(F.arrays_zip(both.alias("x"), left.alias("left"), right.alias("right")), lambda z: (z["x"]["loose"] == 1) & (z["left"] <= z["x"]["first"]) & (z["x"]["span"]["last"] <= z["right"]))

    return F.transform(let(F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(loose, mark(1)))), clear), lambda z: z["x"]["span"])


def _best(scored: Column) -> Column:
    """Of scored spans (against, span), from the left: one that overlaps the span kept last replaces it if judged better."""
    kind = f"struct<against:double,span:{_SPAN}>"
    own = lambda x: F.struct(x["against"].alias("against"), x["span"].alias("span"))
    step = lambda a, x: F.when(a.isNull() | (x["first"] >= a["span"]["last"]) | (x["against"] < a["against"]), own(x)).otherwise(a)

    def kept(ordered: Column) -> Column:
        return F.transform(F.arrays_zip(ordered.alias("x"), running(ordered, F.lit(None), step, kind).alias("a")), lambda z: F.struct(z["x"]["first"].alias("first"), step(z["a"], z["x"]).alias("now")))

    def final(own: Column) -> Column:
        # A kept span is final once the next doesn't overlap it, or there is none.
        following = F.concat(F.slice(F.transform(own, lambda z: z["first"]), 2, F.greatest(F.size(own) - 1, F.lit(0))), F.array(F.lit(1 << 62).cast("bigint")))
        return F.filter(F.arrays_zip(own.alias("k"), following.alias("next")), lambda z: z["next"] >= z["k"]["now"]["span"]["last"])

    ordered = F.array_sort(F.transform(scored, lambda x: F.struct(x["span"]["first"].alias("first"), x["against"].alias("against"), x["span"].alias("span"))))
    return F.transform(let(let(ordered, kept), final), lambda z: z["k"]["now"]["span"])


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with all its columns, a column of base spans, and one of all spans; and the two columns' names."""
    names = {k: free_name(docs, f"pii_{k}") for k in ("text", "raw", "base", "loose", "fresh", "judged", "spans")}
    c = {k: F.col(n) for k, n in names.items()}
    table = docs.withColumn(names["text"], F.coalesce(F.col("text"), F.lit("")))
    needs = {"email": F.contains(c["text"], F.lit("@")), "ip": c["text"].rlike("[0-9]\\.[0-9]"), "card": c["text"].rlike("[0-9]"), "phone": c["text"].rlike("\\+[0-9]")}
    table = table.withColumn(names["raw"], F.struct(*[_found(c["text"], p, k, needs[k]).alias(k) for k, p in BASE.items()]))
    table = table.withColumn(names["base"], F.concat(*[F.filter(F.col(f"{names['raw']}.{k}"), _validator(k)) for k in BASE]))
    table = table.withColumn(names["loose"], F.concat(*[F.filter(_found(c["text"], p, k, c["text"].rlike(NEEDS[k]), True), _possible(k)) for k, p in LOOSE.items()]))
    table = table.withColumn(names["fresh"], F.when(F.size(c["loose"]) == 0, _none(_SPANS)).when(F.size(c["base"]) == 0, c["loose"]).otherwise(_apart(c["loose"], c["base"])))
    # Features first, then the score: a lambda's inner expressions would else be worked out once for each use.
    described = F.transform(c["fresh"], lambda x: F.struct(x.alias("span"), F.struct(*[v.alias(k) for k, v in _features(x, x["before"]).items()]).alias("row")))
    table = table.withColumn(names["judged"], F.when(F.size(c["fresh"]) > 0, described))
    scored = f"transform(`{names['judged']}`, x -> struct(-({score_sql('x.row')}) AS against, x.span AS span))"
    chosen = F.expr(f"filter({scored}, x -> -x.against >= {threshold_sql('x.span.kind')})")
    table = table.withColumn(names["judged"], F.when(c["judged"].isNotNull(), chosen))
    table = table.withColumn(names["spans"], F.when(F.coalesce(F.size(c["judged"]), F.lit(0)) <= 0, c["base"]).otherwise(F.concat(c["base"], _best(c["judged"]))))
    return table.drop(names["text"], names["raw"], names["loose"], names["fresh"], names["judged"]), names["base"], names["spans"]


def _listed(spans: Column) -> Column:
    """kind:first:last by kind as listed, then first, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["rank"].alias("rank"), x["first"].alias("first"), x["last"].alias("last"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts by kind, base_sha256, all spans."""
    table, base, spans = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter(F.col(base), _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return table.select("doc_id", *counts, F.sha2(_listed(F.col(base)).cast("binary"), 256).alias("base_sha256"), _listed(F.col(spans)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and n_chars, if there is one, set anew; null texts stay.

    Spans of two kinds may overlap (a number in an e-mail): such are covered as one, by the first's kind."""
    columns = docs.columns
    table, base, spans = with_spans(docs)
    names = {k: free_name(table, f"pii_{k}") for k in ("ordered", "cuts")}
    text = F.col("text")
    ordered = F.array_sort(F.transform(F.col(spans), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["kind"].alias("kind"))))
    table = table.withColumn(names["ordered"], F.when(F.size(spans) > 0, ordered))
    # Each span with how far those before it reach: from there on the text stays up to the span.
    reach = running(F.col(names["ordered"]), F.lit(0), lambda a, x: F.greatest(a, x["last"]), "bigint")
    table = table.withColumn(names["cuts"], F.when(F.size(names["ordered"]) > 0, F.arrays_zip(F.col(names["ordered"]).alias("x"), reach.alias("at"))))
    cuts = F.col(names["cuts"])
    many = F.ceil(F.size(cuts) / BLOCK).cast("int")

    def block(i: Column) -> Column:
        """The text from where the block's first span is reached to its last one's end, redacted: cut out once for the block."""

        def redacted(own: Column) -> Column:
            start = own[0]["at"]
            part = F.substring(text, (start + 1).cast("int"), F.greatest(F.element_at(own, -1)["x"]["last"] - start, F.lit(0)).cast("int"))
            piece = lambda of: lambda z: F.when(z["x"]["first"] >= z["at"], F.concat(F.substring(of, (z["at"] - start + 1).cast("int"), (z["x"]["first"] - z["at"]).cast("int")), F.lit("["), F.upper(z["x"]["kind"]), F.lit("]"))).otherwise("")
            return let(part, lambda of: F.array_join(F.transform(own, piece(of)), ""))

        return let(F.slice(cuts, i * BLOCK + 1, F.lit(BLOCK)), redacted)

    end = F.array_max(F.transform(F.col(names["ordered"]), lambda x: x["last"]))
    whole = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), many - 1), block), ""), F.substring(text, (end + 1).cast("int"), F.length(text)))
    made = F.when(F.size(cuts) > 0, whole).otherwise(text)
    out = table.withColumn("text", made).drop(base, spans, *names.values())
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
