"""Questions answered from running text."""
import random
import re

from planlens.functions import vocabulary as V
from planlens.operators import reconcile as R, sweep as SW

TEXT = "set_id bigint, page int, text string"
CODES = "set_id bigint, page int, code string"
FACTS = "set_id bigint, field string, value_num double, value_str string, value_bool boolean, source string, page int, note string"


def values(df):
    return {(r.set_id, r.field): (r.value_num if r.value_num is not None else r.value_str if r.value_str is not None else r.value_bool, r.page)
            for r in df.collect()}


def test_hits_equal_a_plain_search(frame):
    rng = random.Random(4)
    said = ["BUILDING AREA: 1,500 SF", "Square Footage per Floor (Maximum)\n15,376\n92,000", "STORIES 2", "FSPK 1 STORY", "NFPA 13R", "FULLY SPRINKLERED",
            "OCCUPANCY: BUSINESS / OFFICE", "occupancy group = A-3", "MIXED OCCUPANCY? NO", "SEPARATED per Table 508.4", "TYPE II-B", "7TH EDITION (2020)",
            "Vult = 140 MPH", "ORANGE COUNTY, FLORIDA", "nothing at all", "HEIGHT 26'-4\" 75 FT.", "ZONING: C-2  LOT 4", "RISK CATEGORY II", "EXPOSURE C"]
    pages, codes = [], []
    for s in range(15):
        for p in range(8):
            pages.append((s, p, None if rng.random() < .1 else "\n".join(rng.choices(said, k=rng.randrange(0, 5)))))
            codes.append((s, p, rng.choice(["G-1", "g-2", "A-1", None])))
    code = {c[:2]: c[2] for c in codes}
    want = {}
    for s in range(15):
        order = sorted((r for r in pages if r[0] == s), key=lambda r: ((code[r[:2]] or "")[:1].upper() != "G", r[1]))
        for rank, (field, _, pattern, _) in enumerate(V.TEXT_SWEEP):
            for _, p, t in order:
                m = re.search(pattern, t or "", re.I)
                if m:
                    want[s, field, rank] = (p, next((g for g in m.groups() if g), m.group(0)))
                    break
    got = SW.sweep_hits(frame(pages + pages[:5], TEXT), frame(codes + codes[:5], CODES)).collect()  # repeated rows change nothing
    assert {(r.set_id, r.field, r.rank): (r.page, r.stated) for r in got} == want and len(got) == len(want) > 50


def test_every_match_holds_its_word():
    samples = ["NON-SEPARATED", "SEPARATION TABLE 508.4", "TABLE 508.3", "5 STOREYS", "STOREYS 5", "V=150 MPH", "4TH EDITION (2010)", "FLORIDA BUILDING CODE, 2020"]
    for _, word, pattern, groups in V.TEXT_SWEEP:
        assert re.compile(pattern).groups == groups
        for s in samples:
            assert not re.search(pattern, s, re.I) or word in s.upper()


def test_a_general_sheet_and_a_stated_form_come_first(frame):
    text = frame([(1, 0, "STORIES: 3\nGROUP B"), (1, 1, "STORIES: 4"), (2, 0, "1 STORY"), (2, 1, "STORIES 2"), (3, 0, None), (3, 1, ""),
                  (4, 0, "OCCUPANCY: ??\nGROUP A-3"), (5, 0, "OCCUPANCY: BUSINESS"), (5, 3, "FULLY SPRINKLERED")], TEXT)
    got = values(SW.swept_values(SW.sweep_hits(text, frame([(1, 0, "A-1"), (1, 1, "G-1")], CODES))))
    assert got[1, "stories"] == (4.0, 1) and got[2, "stories"] == (2.0, 1)
    assert got[4, "occupancy_group"] == ("A-3", 0) and got[5, "occupancy_group"] == ("B", 0) and not any(k[0] == 3 for k in got)
    assert SW.swept_values(SW.sweep_hits(frame([], TEXT))).count() == 0


def test_a_hit_that_is_no_value_gives_way_to_the_next_pattern(frame):
    text = frame([(1, 0, "OCCUPANCY: GROUP"), (1, 1, "GROUP A-3"), (1, 2, "OCCUPANCY: BUSINESS")], TEXT)
    assert values(SW.swept_values(SW.sweep_hits(text))) == {(1, "occupancy_group"): ("A-3", 1)}


def test_a_fact_stands_before_the_sweep_and_a_cited_table_implies_mixed(frame):
    text = frame([(1, 0, "STORIES: 3\nSEPARATED per Table 508.4\nMIXED OCCUPANCY? NO")], TEXT)
    swept = SW.swept_values(SW.sweep_hits(text, frame([(1, 0, "G-1")], CODES)))
    facts = frame([(1, "stories", 5.0, None, None, "A-1", 7, "")], FACTS)
    got = {r.field: r for r in R.apply_implication(R.drawn_values(facts, facts.where("false"), swept)).collect()}
    assert got["stories"].value_num == 5.0 and got["mixed_occupancy"].value_bool is True and got["mixed_occupancy"].source == "G-1"
    assert "not mixed" in got["mixed_occupancy"].note and got["separation_method"].value_str == "separated"
