"""Printed text to value or NULL."""
import pytest
from pyspark.sql import functions as F

from planlens.functions import normalise as N, text as T
from planlens.operators.claims import normalise

CASES = [
    ("occupancy", "ASSEMBLY (A-3)", "A-3"), ("occupancy", "GROUP A", "A"), ("occupancy", "BUSINESS / OFFICE", "B"),
    ("occupancy", "SEE PLAN", None), ("construction", "TYPE II-B", "II-B"), ("construction", "TYPE 2B", "II-B"),
    ("construction", "III - A", "III-A"), ("construction", "WOOD", None), ("sprinkler", "YES, PER NFPA 13R", "NFPA13R"),
    ("sprinkler", "SEE M-1", None), ("sprinkler", "NON-SPRINKLERED", "NONE"), ("sprinkler", "FULLY SPRINKLERED", "YES"),
    ("wind", "ULTIMATE: 170 MPH  NOMINAL: 132 MPH", "170.0"), ("wind", "12 MPH", None), ("wind", "NOMINAL 132 MPH", None),
    ("area", "1,436 SF", "1436.0"), ("area", "12", None), ("feet", "26'-4\"", str(26 + 4 / 12.0)), ("feet", "250 LF", "250.0"),
    ("inches", "44\"", "44.0"), ("inches", "1 3/4\"", "1.75"), ("inches", "5'-6\"", "66.0"), ("count", "70 PERSONS", "70.0"),
    ("count", "1.5", None), ("factor", "0.15\" (DOORS)", "0.15"), ("factor", "1.5", None), ("roman", "III (3)", "III"),
    ("roman", "2", "II"), ("roman", "VII", None), ("letter", "CATEGORY C", "C"), ("bool", "NO", "false"), ("bool", "MAYBE", None),
    ("edition", "2023 FLORIDA BUILDING CODE 8TH EDITION", "fbc2023"), ("edition", "2020 NATIONAL ELECTRIC CODE", None),
    ("edition", "FBC 2020", "fbc2020"), ("text", "  a   b. ", "A B"), ("text", "----", None),
]


def test_parsers(frame):
    got = normalise(frame([(i, k, t) for i, (k, t, _) in enumerate(CASES)], "i int, kind string, raw string"))
    rows = got.select("i", F.coalesce("value_str", F.col("value_num").cast("string"), F.col("value_bool").cast("string"))).collect()
    found = dict(map(tuple, rows))
    assert {i: found[i] for i in found} == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_answers_normalise(frame):
    rows = [("construction_type", "Type IIB", "II-B"), ("construction_type", "2B", "II-B"), ("occupancy_group", "Group B", "B"),
            ("jurisdiction", "Lee County, Florida", "LEE COUNTY FL"), ("separation_method", "TABLE 508.4", "separated"),
            ("separation_method", "NON-SEPARATED", "nonseparated"), ("sprinkler_system", "none", "NONE"), ("risk_category", "iii", "III")]
    df = frame(rows, "f string, v string, w string")
    c = N.canonical(F.col("f"), F.lit(None).cast("double"), F.col("v"), F.lit(None).cast("boolean"))
    assert all(a == w for a, w in df.select(c["c_str"], "w").collect())


def test_label_splits(frame):
    df = frame([("OCCUPANT LOAD 70",), ("TOTAL SF",), ("250 LF",), ("SPRINKLERED YES",), ("SCALE 1:2",), ("HEIGHT: 26'-4\"",), ("OCCUPANCY:",)], "t string")
    got = {r.t: (r.a and tuple(r.a), r.b and tuple(r.b)) for r in df.select("t", T.trailing_pair(F.col("t")).alias("a"), T.inline_pair(F.col("t")).alias("b")).collect()}
    assert got["OCCUPANT LOAD 70"][0] == ("OCCUPANT LOAD", "70") and got["TOTAL SF"][0] is None and got["250 LF"][0] is None
    assert got["SPRINKLERED YES"][0] == ("SPRINKLERED", "YES") and got["SCALE 1:2"][1] is None
    assert got["HEIGHT: 26'-4\""][1] == ("HEIGHT", "26'-4\"") and got["OCCUPANCY:"][1] == ("OCCUPANCY", "")
