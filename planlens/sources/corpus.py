"""The code corpus: threshold tables and edition dates, as small dimension tables.

Every table here has a fixed size (the largest has 72 rows), so broadcasting one is always
safe. ``corpus(spark)`` hands them out as DataFrames.
"""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import DataFrame, SparkSession

INF = float("inf")

# ---- fixed values: the code tables ------------------------------------------------------
COMMON_PATH_FT = [("A", True, 75.0), ("A", False, 75.0), ("E", True, 75.0), ("E", False, 75.0),
                  ("M", True, 75.0), ("M", False, 75.0), ("B", True, 100.0), ("B", False, 75.0)]
TRAVEL_FT = [("A", True, 250.0), ("A", False, 200.0), ("B", True, 300.0), ("B", False, 200.0),
             ("M", True, 250.0), ("M", False, 200.0)]
DEAD_END_FT, DEAD_END_LONG_FT = 20.0, 50.0
DEAD_END_LONG_GROUPS = ["B", "E", "F", "I-1", "M", "R-1", "R-2", "S", "U"]
CORRIDOR_IN = 44.0
DOOR_CLEAR_IN, DOOR_STOP_IN, LEAF_THICKNESS_IN = 32.0, 0.125, 1.75
CAPACITY_BASE, CAPACITY_REDUCED = 0.20, 0.15
EXIT_STEPS = [(500.0, 2), (1000.0, 3), (INF, 4)]
RISK_III_LOAD = 300.0
MIN_CEILING_FT = 7.5
POSTING_GROUPS = ["A", "A-1", "A-2", "A-3", "A-4", "A-5"]
PLUMBING_ROWS = [("A-3", "assembly halls and gymnasiums", 125.0, 65.0, 200.0, 200.0, 500.0, 1.0)]
TYPES = ["I-A", "I-B", "II-A", "II-B", "III-A", "III-B", "IV", "V-A", "V-B"]
HEIGHT_GROUPS = ["A", "B", "E", "F", "M", "S", "U"]
# height limit in feet, without and with a sprinkler system
HEIGHT_FT = {
    "I-A": [INF, INF],
    "I-B": [160, 180],
    "II-A": [65, 85],
    "II-B": [55, 75],
    "III-A": [65, 85],
    "III-B": [55, 75],
    "IV": [65, 85],
    "V-A": [50, 70],
    "V-B": [40, 60],
}
# storeys by type in the order of TYPES, without and with a sprinkler system
STORIES = {
    "B": {"without": [INF, 11, 5, 3, 5, 3, 5, 3, 2],
          "with": [INF, 12, 6, 4, 6, 4, 6, 4, 3]},
    "A-3": {"without": [INF, 11, 3, 2, 3, 2, 3, 2, 1],
          "with": [INF, 12, 4, 3, 4, 3, 4, 3, 2]},
    "M": {"without": [INF, 11, 4, 2, 4, 2, 4, 3, 1],
          "with": [INF, 12, 5, 3, 5, 3, 5, 4, 2]},
    "S-1": {"without": [INF, 11, 4, 2, 3, 2, 4, 3, 1],
          "with": [INF, 12, 5, 3, 4, 3, 5, 4, 2]},
}
# square feet by type in the order of TYPES: without a sprinkler system; sprinklered, one storey; sprinklered, several storeys
AREA = {
    "A-3": {"without": [INF, INF, 15500, 9500, 14000, 9500, 15000, 11500, 6000],
          "one_storey": [INF, INF, 62000, 38000, 56000, 38000, 60000, 46000, 24000],
          "several": [INF, INF, 46500, 28500, 42000, 28500, 45000, 34500, 18000]},
    "B": {"without": [INF, INF, 37500, 23000, 28500, 19000, 36000, 18000, 9000],
          "one_storey": [INF, INF, 150000, 92000, 114000, 76000, 144000, 72000, 36000],
          "several": [INF, INF, 112500, 69000, 85500, 57000, 108000, 54000, 27000]},
    "M": {"without": [INF, INF, 21500, 12500, 18500, 12500, 20500, 14000, 9000],
          "one_storey": [INF, INF, 86000, 50000, 74000, 50000, 82000, 56000, 36000],
          "several": [INF, INF, 64500, 37500, 55500, 37500, 61500, 42000, 27000]},
    "S-1": {"without": [INF, 48000, 26000, 17500, 26000, 17500, 25500, 14000, 9000],
          "one_storey": [INF, 192000, 104000, 70000, 104000, 70000, 102000, 56000, 36000],
          "several": [INF, 144000, 78000, 52500, 78000, 52500, 76500, 42000, 27000]},
}
# rating hours: frame, bearing exterior, bearing interior, nonbearing interior, floor, roof;
# NULL stands for heavy timber
RATINGS = {"I-A": (3, 3, 3, 0, 2, 1.5), "I-B": (2, 2, 2, 0, 2, 1), "II-A": (1, 1, 1, 0, 1, 1),
           "II-B": (0, 0, 0, 0, 0, 0), "III-A": (1, 2, 1, 0, 1, 1), "III-B": (0, 2, 0, 0, 0, 0),
           "IV": (None, 2, None, None, None, None), "V-A": (1, 1, 1, 0, 1, 1),
           "V-B": (0, 0, 0, 0, 0, 0)}
LOAD_GROSS = [("B", 150.0), ("M", 60.0), ("S-1", 300.0), ("S-2", 500.0), ("F-1", 100.0),
              ("F-2", 100.0)]
LOAD_USES = [("business", 150.0, "gross"), ("mercantile", 60.0, "gross"),
             ("exercise room", 50.0, "gross"),
             ("assembly, concentrated (chairs only)", 7.0, "net"),
             ("assembly, unconcentrated (tables and chairs)", 15.0, "net"),
             ("assembly, standing space", 5.0, "net"), ("classroom", 20.0, "net"),
             ("storage, stock, shipping", 300.0, "gross"), ("warehouse", 500.0, "gross")]
# words that name one use, most specific first
USE_WORDS = [
    (r"\bEXERCISE\s+ROOMS?\b", "exercise room"),
    (r"\bCLASSROOMS?\b", "classroom"),
    (r"\bSTANDING\s+SPACE\b", "assembly, standing space"),
    (r"\bUNCONCENTRATED\b|\bTABLES\s+AND\s+CHAIRS\b",
     "assembly, unconcentrated (tables and chairs)"),
    (r"\bCONCENTRATED\b|\bCHAIRS\s+ONLY\b", "assembly, concentrated (chairs only)"),
    (r"\bWAREHOUSES?\b", "warehouse"),
    (r"\bSTORAGE\b|\bSTOCK\b|\bSHIPPING\b", "storage, stock, shipping"),
    (r"\bMERCANTILE\b|\bRETAIL\b", "mercantile"),
    (r"\bBUSINESS\b|\bOFFICES?\b", "business"),
]
EDITIONS = [
    ("fbc2017", "6th", 2017, dt.date(2017, 12, 31), "IBC 2015", None),
    ("fbc2020", "7th", 2020, dt.date(2020, 12, 31), "IBC 2018", "ASCE 7-16"),
    ("fbc2023", "8th", 2023, dt.date(2023, 12, 31), "IBC 2021", "ASCE 7-22"),
    ("fbc2026", "9th", 2026, dt.date(2026, 12, 31), "IBC 2024", None),
]


def code_tables() -> dict[str, tuple[list[tuple], str]]:
    """(rows, schema) of every code table, by name."""
    height = [(g, t, s, float(HEIGHT_FT[t][s]))
              for g, t, s in product(HEIGHT_GROUPS, TYPES, (0, 1))]
    stories = [(g, t, s, float(row["with" if s else "without"][i]))
               for g, row in STORIES.items() for i, t in enumerate(TYPES) for s in (False, True)]
    area = [(g, t, *(float(row[k][i]) for k in ("without", "one_storey", "several")))
            for g, row in AREA.items() for i, t in enumerate(TYPES)]
    ratings = [(t, *(None if v is None else float(v) for v in RATINGS[t])) for t in TYPES]
    exits, low = [], -INF
    for top, need in EXIT_STEPS:
        exits.append((low, top, need))
        low = top
    return {
        "common_path": (COMMON_PATH_FT, "grp string, sprinklered boolean, limit_ft double"),
        "travel": (TRAVEL_FT, "grp string, sprinklered boolean, limit_ft double"),
        "exits": (exits, "above double, up_to double, exits int"),
        "height": ([(g, t, bool(s), v) for g, t, s, v in height],
                        "grp string, ctype string, sprinklered boolean, limit_ft double"),
        "stories": (stories,
                         "grp string, ctype string, sprinklered boolean, limit_n double"),
        "area": (area, "grp string, ctype string, ns double, s1 double, sm double"),
        "ratings": (ratings, "ctype string, frame double, bearing_ext double, "
                         "bearing_int double, nonbearing_int double, floor double, roof double"),
        "load_gross": (LOAD_GROSS, "grp string, factor double"),
        "load_uses": (LOAD_USES, "fn string, factor double, basis string"),
        "use_words": ([(i, p, u) for i, (p, u) in enumerate(USE_WORDS)],
                           "rank int, pattern string, fn string"),
        "plumbing": (PLUMBING_ROWS, "grp string, description string, wc_m double, "
                          "wc_f double, lav_m double, lav_f double, df double, sinks double"),
        "editions": (EDITIONS, "key string, ordinal string, year int, effective date, "
                          "base string, wind string"),
    }


def corpus(spark: SparkSession) -> dict[str, DataFrame]:
    """Every code table as a DataFrame, by name."""
    return {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in code_tables().items()}
