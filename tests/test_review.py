"""From positioned words to the register."""
from pyspark.sql import functions as F

from planlens.plans.review import RULE_TABLES, drawn, review, review_corpus
from planlens.sources.readers import DECLARATIONS

WORDS = "set_id bigint, page int, block int, line int, seq int, x0 double, y0 double, x1 double, y1 double, text string"


def printed(set_id, page, *lines):
    """Words of lines (x, y, text[, height]), each line a text object of its own."""
    out = []
    for n, (x, y, text, *h) in enumerate(lines):
        at, h = float(x), h[0] if h else 10.0
        for k, word in enumerate(text.split()):
            end = at + 6.0 * len(word)
            out.append((set_id, page, n, 0, k, at, float(y), end, y + h, word))
            at = end + 3.0
    return out


SHEET = [(200, 0, "REQUIRED:"), (285, 0, "PROVIDED:"), (0, 20, "COMMON PATH OF TRAVEL (1006.2.1):"), (200, 20, "50 LF"), (285, 20, "38'-2\""),
         (0, 100, "OCCUPANCY: ASSEMBLY (A-3)"), (0, 130, "CONSTRUCTION TYPE: III-B"), (0, 160, "BUILDING AREA:"), (0, 172, "1,436 SF"),
         (0, 210, "EXIT DISCHARGE 1:"), (0, 224, "OCCUPANT LOAD: 35"), (560, 740, "G-1")]


def test_words_become_a_register(frame):
    words = frame(printed(1, 0, *SHEET) + printed(2, 0, *SHEET[:-1], (1160, 1100, "G-1")), WORDS)
    pages = frame([(1, 0, 612.0, 792.0), (2, 0, 1224.0, 1152.0), (3, 0, 612.0, 792.0)], "set_id bigint, page int, width double, height double")
    said = drawn(words, pages)
    got = {(r.set_id, r.label): (r.kind, r["values"], r.sheet) for r in said["pairs"].collect()}
    for k in (1, 2):
        assert got[(k, "COMMON PATH OF TRAVEL (1006.2.1)")] == ("row", ["50 LF", "38'-2\""], "G-1")
        assert got[(k, "BUILDING AREA")][:2] == ("stacked", ["1,436 SF"])
    answers = {"set_id": 1, "construction_type": "V-B", "occupancy_group": "A-3"}
    fields = [f.split()[0] for f in DECLARATIONS.split(", ")]
    declarations = frame([tuple(answers.get(f) for f in fields)], DECLARATIONS)
    register, stood = review(said["pairs"], declarations, only=["DECL.CONSTRUCTION_TYPE", "DECL.OCCUPANCY", "EGRESS.COMMON_PATH"], **{k: said[k] for k in RULE_TABLES})
    found = {(r.set_id, r.rule_id): r.status for r in register.select("set_id", "rule_id", "status").collect()}
    assert found[(1, "DECL.CONSTRUCTION_TYPE")] == "CONFLICT" and found[(1, "DECL.OCCUPANCY")] == "PASS"
    silent = {(r.set_id, r.rule_id) for r in stood.select("set_id", "rule_id").collect()}
    for k in (1, 2):  # a rule finds something or says why not
        assert (k, "EGRESS.COMMON_PATH") in found or (k, "EGRESS.COMMON_PATH") in silent


def test_no_words(frame):
    none = frame([], WORDS)
    pages = frame([], "set_id bigint, page int, width double, height double")
    register, stood = review_corpus(none, pages, frame([], DECLARATIONS), only=["DECL.OCCUPANCY"])
    assert register.count() == 0 and stood.count() == 0


def test_a_missing_value_is_no_pair(frame):
    words = frame(printed(1, 0, (0, 0, "ZONING:"), (0, 12, "170 MPH"), (0, 300, "HEIGHT:")), WORDS)
    said = drawn(words, frame([(1, 0, 612.0, 792.0)], "set_id bigint, page int, width double, height double"))
    assert [(r.label, r["values"]) for r in said["pairs"].collect()] == [("ZONING", ["170 MPH"])]
    assert said["pairs"].where(F.exists("value_ids", lambda v: v.isNull())).count() == 0
