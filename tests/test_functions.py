import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from moorline.functions import geo, text
from moorline.functions import transforms as T


def chain(spark, names, values, kind="string"):
    """Values and errors of a chain over cells."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {'array<string>' if kind == 'string[]' else 'string'}")
    typed = T.apply_chain(names, F.col("x"), kind)
    return [(r.v, r.e) for r in rows.select("i", typed.value.alias("v"), typed.error.alias("e")).orderBy("i").collect()]


def values(spark, names, cells, kind="string"):
    return [v for v, _ in chain(spark, names, cells, kind)]


def test_title_case(spark):
    cells = ["PORT OF ROTTERDAM", "O'BRIEN WHARF", "DE HAVEN", "SAINT-DE PAUL", "ville-DE-paris", "the end OF"]
    assert values(spark, ["title_case"], cells) == ["Port of Rotterdam", "O'Brien Wharf", "De Haven", "Saint-de Paul", "Ville-De-Paris", "The End of"]


def test_strip_diacritics(spark):
    assert values(spark, ["strip_diacritics"], ["Ærosund", "straße", "Привет × ÷", "Łódź", "Œuvre ĳ"]) == ["AErosund", "strasse", "Привет × ÷", "Lodz", "OEuvre ij"]


def test_ascii_only_case_and_space(spark):
    assert values(spark, ["upper"], ["straße é"]) == ["STRAßE é"]
    assert values(spark, ["trim"], ["\t a \n", "\u00a0a\u00a0"]) == ["a", "\u00a0a\u00a0"]
    assert values(spark, ["collapse_ws"], ["  a \t b  "]) == ["a b"]


def test_locode_and_failures(spark):
    found = chain(spark, ["trim", "validate_locode"], [" NL RTM ", "NLRT0", "1LRTM", "  ", None])
    assert [v for v, _ in found] == ["NLRTM", None, None, None, None]
    assert [bool(e) for _, e in found] == [False, True, True, False, False]
    assert found[1][1].startswith("validate_locode: ")


def test_numbers(spark):
    assert values(spark, ["to_int"], ["  42 ", "+7", "1.5", "9223372036854775808", ""]) == [42, 7, None, None, None]
    found = values(spark, ["to_double"], ["51.92", "1e3", "1.0d", "inf", "nan"])
    assert found[:4] == [51.92, 1000.0, None, math.inf] and math.isnan(found[4])
    assert [bool(e) for _, e in chain(spark, ["to_int", "normalize_ship_type"], ["70", "100", "x", ""])] == [False, True, True, False]


def test_timestamps(spark):
    cells = ["2026-02-31", "2026-04-01T10:20:30.1239+02:00", "1969-12-31T23:59:59Z", "2026-13-01", "2026-01-01 10:00", "2026-01-01T10:00:61", "2026-01-01T10:00:60Z", "2026-01-01T00:00-0330"]
    day = datetime
    assert values(spark, ["parse_timestamp"], cells) == [day(2026, 3, 3), day(2026, 4, 1, 8, 20, 30, 123000), day(1969, 12, 31, 23, 59, 59), None, day(2026, 1, 1, 10), None, day(2026, 1, 1, 10, 1), day(2026, 1, 1, 3, 30)]
    shown = spark.createDataFrame([("2026-04-01T10:20:30.5Z",)], "x string").select(T.format_iso8601(T.parse_iso8601(F.col("x")))).first()[0]
    assert shown == "2026-04-01T10:20:30.500Z"


#: The reference's maritime identities with their flag states, written down apart from the code's list.
IDENTITIES = """201AL 202AD 203AT 204PT 205BE 206BY 207BG 208VA 209CY 210CY 211DE 212CY 213GE 214MD 215MT 216AM 218DE 219DK 220DK 224ES 225ES
226FR 227FR 228FR 229MT 230FI 231FO 232GB 233GB 234GB 235GB 236GI 237GR 238HR 239GR 240GR 241GR 242MA 243HU 244NL 245NL 246NL
247IT 248MT 249MT 250IE 251IS 252LI 253LU 254MC 255PT 256MT 257NO 258NO 259NO 261PL 262ME 263PT 264RO 265SE 266SE 267SK 268SM
269CH 270CZ 271TR 272UA 273RU 274MK 275LV 276EE 277LT 278SI 279RS 301AI 303US 304AG 305AG 306CW 307AW 308BS 309BS 310BM 311BS
312BZ 314BB 316CA 319KY 321CR 323CU 325DM 327DO 329GP 330GD 331GL 332GT 334HN 336HT 338US 339JM 341KN 343LC 345MX 347MQ 348MS
350NI 351PA 352PA 353PA 354PA 355PA 356PA 357PA 358PR 359SV 361PM 362TT 364TC 366US 367US 368US 369US 370PA 371PA 372PA 373PA
374PA 375VC 376VC 377VC 378VG 379VI 401AF 403SA 405BD 408BH 410BT 412CN 413CN 414CN 416TW 417LK 419IN 422IR 423AZ 425IQ 428IL
431JP 432JP 434TM 436KZ 437UZ 438JO 440KR 441KR 443PS 445KP 447KW 450LB 451KG 453MO 455MV 457MN 459NP 461OM 463PK 466QA 468SY
470AE 471AE 472TJ 473YE 475YE 477HK 478BA 501TF 503AU 506MM 508BN 510FM 511PW 512NZ 514KH 515KH 516CX 518CK 520FJ 523CC 525ID
529KI 531LA 533MY 536MP 538MH 540NC 542NU 544NR 546PF 548PH 553PG 555PN 557SB 559AS 561WS 563SG 564SG 565SG 566SG 567TH 570TO
572TV 574VN 576VU 577VU 578WF 601ZA 603AO 605DZ 607TF 608SH 609BI 610BJ 611BW 612CF 613CM 615CG 616KM 617CV 618TF 619CI 620KM
621DJ 622EG 624ET 625ER 626GA 627GH 629GM 630GW 631GQ 632GN 633BF 634KE 635TF 636LR 637LR 638SS 642LY 644LS 645MU 647MG 649ML
650MZ 654MR 655MW 656NE 657NG 659NA 660RE 661RW 662SD 663SN 664SC 665SH 666SO 667SL 668ST 669SZ 670TD 671TG 672TN 674TZ 675UG
676CD 677TZ 678ZM 679ZW 701AR 710BR 720BO 725CL 730CO 735EC 740FK 745GF 750GY 755PY 760PE 765SR 770UY 775VE"""


def test_flags_of_all_identities(spark):
    expected = {x[:3]: x[3:] for x in IDENTITIES.split()}
    assert len(expected) == 291 and (expected["403"], expected["470"], expected["525"], expected["574"]) == ("SA", "AE", "ID", "VN")
    cells = [f"{i:03d}" for i in range(1000)]
    assert values(spark, ["mid_to_country"], [f"{c}123456" for c in cells]) == [expected.get(c) for c in cells]


def test_coordinates_imo_flags(spark):
    assert values(spark, ["ddmm_to_decimal_lat"], ["5155N 00429E", "5160N 00429E", "5155N", "x y z"]) == [pytest.approx(51.916666), None, pytest.approx(51.916666), None]
    assert values(spark, ["ddmm_to_decimal_lon"], ["5155N 00429W", "5155N"]) == [pytest.approx(-4.483333), None]
    assert values(spark, ["strip_imo_prefix", "validate_imo"], ["IMO 9074729", "9074728", "imo"]) == ["9074729", None, None]
    assert values(spark, ["mid_to_country"], ["244123456", "999", "12"]) == ["NL", None, None]


def test_lists(spark):
    assert values(spark, ["split_semicolon", "upper"], ["a; b;;", "; "]) == [["A", "B"], None]
    assert values(spark, ["concat"], [["NL", "RTM"]], "string[]") == ["NLRTM"]
    assert values(spark, ["first_char"], ["medium", "", "éa"]) == ["M", None, None]
    assert values(spark, ["null_if_blank"], [" ", " a "]) == [None, " a "]


def test_registry_is_pinned():
    assert len(T.REGISTRY) == 21
    assert {n: hex(i) for n, (i, *_) in T.REGISTRY.items()}["title_case"] == "0x105"
    assert T.chain_names(T.resolve_chain(["trim", "upper"])) == ["trim", "upper"]
    assert T.chain_fingerprint(["trim", "upper"]) != T.chain_fingerprint(["upper", "trim"])
    with pytest.raises(ValueError):
        T.resolve_chain(["trim", "shout"])


def test_names(spark):
    row = spark.createDataFrame([("Port of Spain", "M/V Baltic Trader", "St. John's Hbr", "Port")], "a string, b string, c string, d string").select(text.canonical(text.port_tokens(F.col("a"))), text.canonical(text.vessel_tokens(F.col("b"))), text.canonical(text.port_tokens(F.col("c"))), text.canonical(text.port_tokens(F.col("d")))).first()
    assert list(row) == ["SPAIN", "BALTIC TRADER", "SAINT JOHN S", "PORT"]


def test_soundex(spark):
    words = [("Robert", "R163"), ("Rupert", "R163"), ("Ashcraft", "A261"), ("Tymczak", "T522"), ("Pfister", "P236"), ("1234", ""), ("2ROTT", "R300")]
    rows = spark.createDataFrame(words, "w string, e string").select(text.soundex(F.col("w")), "e").collect()
    assert all(a == b for a, b in rows)


def test_similarity(spark):
    pairs = [(b"MARTHA", b"MARHTA"), (b"DIXON", b"DICKSONX"), (b"", b""), (b"a", b"")]
    assert text.jaro_of(*map(list, zip(*pairs))).tolist() == pytest.approx([0.9444, 0.7667, 1.0, 0.0], abs=1e-4)
    assert text.jaro_winkler_of(*map(list, zip(*pairs))).tolist() == pytest.approx([0.9611, 0.8133, 1.0, 0.0], abs=1e-4)
    own = random.Random(3)
    pairs = [tuple(bytes(own.choice(b"abcd") for _ in range(own.randint(0, 12))) for _ in range(2)) for _ in range(600)]
    assert text.jaro_of(*map(list, zip(*pairs))).tolist() == pytest.approx([plain_jaro(*p) for p in pairs])
    row = spark.createDataFrame([(["A", "B"], ["B", "A", "C"], [])], "a array<string>, b array<string>, c array<string>")
    assert list(row.select(text.token_jaccard(F.col("a"), F.col("b")), text.token_jaccard(F.col("c"), F.col("c")), text.tokens_contained(F.col("a"), F.col("b")), text.tokens_contained(F.col("a"), F.col("c"))).first()) == [2 / 3, 1.0, True, False]


def test_geography(spark):
    row = spark.createDataFrame([(42.6, -5.6, 0.0, 0.0, 89.9, 179.9)], "a double, b double, c double, d double, e double, f double")
    got = row.select(geo.geohash(F.col("a"), F.col("b"), 5), geo.geohash(F.col("c"), F.col("d"), 5), F.size(geo.geohash_neighbours(F.col("c"), F.col("d"), 4)), F.size(geo.geohash_neighbours(F.col("e"), F.col("f"), 4)), geo.geohash_decode(F.lit("ezs42")), geo.haversine_km(F.lit(51.0), F.lit(4.0), F.lit(52.0), F.lit(4.0)), geo.geohash_decode(F.lit("a!"))).first()
    assert list(got)[:4] == ["ezs42", "s0000", 8, 5]
    assert got[4]["lat"] == pytest.approx(42.605, abs=0.01) and got[4]["lon"] == pytest.approx(-5.603, abs=0.01)
    assert got[5] == pytest.approx(111.195, abs=0.01) and got[6] is None


def plain_jaro(x, y):
    """Jaro a byte at a time."""
    if x == y or not x or not y:
        return float(x == y)
    reach, free, met = max(max(len(x), len(y)) // 2, 1) - 1, dict(enumerate(y)), []
    for i, c in enumerate(x):
        j = next((j for j in sorted(free) if free[j] == c and abs(i - j) <= reach), None)
        if j is not None:
            met.append(c)
            del free[j]
    other = [c for j, c in enumerate(y) if j not in free]
    m = len(met)
    return (m / len(x) + m / len(y) + (m - sum(p != q for p, q in zip(met, other)) / 2) / m) / 3 if m else 0.0


def test_portable_hashes(spark):
    from moorline.functions import hashing

    # FNV-1a of nothing and of "a", finished by hand.
    def finished(h):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = ((h ^ (h >> shift)) * factor) % (1 << 64)
        return h

    assert hashing.hash64(b"") == finished(0xCBF29CE484222325) and hashing.hash64(b"a") == finished(0xAF63DC4C8601EC8C)
    assert hashing.hash64_fields(["ab", "c"]) != hashing.hash64_fields(["a", "bc"])
    texts = ["", "a", "é東京", "x" * 300, None]
    table = spark.createDataFrame([(t, None if t is None else [t, "z"]) for t in texts], "t string, l array<string>")
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    for r in table.select("t", hashing.hash64_column(F.col("t")).alias("h"), hashing.hash64_fields_column(F.col("l")).alias("f")).collect():
        assert (r.h, r.f) == ((None, None) if r.t is None else (signed(hashing.hash64(r.t.encode())), signed(hashing.hash64_fields([r.t, "z"]))))
    pair = ((1, 5), (2, 1 << 63))
    assert hashing.holdout(pair) == hashing.holdout(pair[::-1])
    assert 0.15 < sum(hashing.holdout(((1, i), (2, i * 7))) for i in range(4000)) / 4000 < 0.25
