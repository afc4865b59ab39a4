"""Edits that add, revise and withdraw, against the plain loop over them."""
import random

import pytest
from pyspark.sql import functions as F

from planlens.functions import vocabulary as V
from planlens.operators import register as RG

EDITS = "set_id bigint, key string, pass int, ordinal int, op string, status string, severity string, title string, reason string, quote string, quote_found boolean, page int"


def state(s, v, status, severity):
    new_s, new_v = s or status, v or severity
    if s == "PASS":
        if v in V.RAMP:
            return status, severity, "bad"
        return new_s, new_v if new_v in V.PASSING else "VERIFIED", ""
    if s == "OPEN":
        return (status, severity, "bad") if v in V.PASSING or new_v not in V.RAMP else (new_s, new_v, "")
    if v in V.RAMP and status not in V.ACTIONABLE:
        new_s = "OPEN"
    elif v in V.PASSING and status in V.ACTIONABLE:
        new_s = "PASS"
    return new_s, new_v, ""


def loop(findings, edits):
    """One edit after the other, as a reviewer would apply them."""
    rows, gone, rejected, added = {k: list(v) for k, v in findings.items()}, {}, [], 0
    for e in sorted(edits, key=lambda e: (e[2], e[3])):
        _, key, at, n, op, s, v, title, reason, quote, found, _ = e
        found = bool(found and quote.strip())
        ok = bool(reason.strip())
        if ok and op == "add":
            new_s, new_v, why = state(s, v, "", "")
            ok = bool(title.strip() and not why and new_s and found)
            if ok:
                added += 1
                rows[f"AI-{added:02d}"] = [new_s, new_v, title]
        elif ok and key not in rows:
            ok = False
        elif ok and op == "withdraw":
            ok = found
            if ok:
                gone[key] = rows.pop(key)
        elif ok:
            new_s, new_v, why = state(s, v, *rows[key][:2])
            new = [new_s, new_v, title.strip() or rows[key][2]]
            ok = not why and (found or (not quote.strip() and new[:2] == rows[key][:2])) and new != rows[key]
            if ok:
                rows[key] = new
        if not ok:
            rejected.append((at, n))
    return {**{k: (*v, False) for k, v in rows.items()}, **{k: (*v, True) for k, v in gone.items()}}, sorted(rejected)


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_equal_the_plain_loop(frame, seed):
    r, findings, edits = random.Random(seed), {}, []
    for set_id in range(12):
        findings[set_id] = {f"F-{i}": (s, r.choice(V.RAMP if s in V.ACTIONABLE else V.PASSING), f"title {i}") for i in range(3)
                            for s in [r.choice(["OPEN", "CONFLICT", "PASS"])]}
        for n in range(14):
            edits.append((set_id, r.choice(["F-0", "F-1", "AI-01", "AI-02", "none"]), r.randint(1, 2), n, r.choice(["add", "add", "revise", "revise", "withdraw"]),
                          r.choice(["", "", "OPEN", "PASS"]), r.choice(["", *V.RAMP, *V.PASSING]), r.choice(["", "new", "other"]), r.choice(["why", "why", "why", " "]),
                          r.choice(["q", "q", ""]), r.random() < 0.8, 3))
    keyed = frame([(i, k, "R.X", *v, 1, k) for i, fs in findings.items() for k, v in fs.items()],
                  "set_id bigint, key string, rule_id string, status string, severity string, title string, page int, fid string")
    done, rejected = RG.review_edits(keyed, frame(edits, EDITS))
    got, refused = {}, {}
    for x in done.collect():
        got.setdefault(x.set_id, {})[x.key] = (x.status, x.severity, x.title, x.gone)
    for x in rejected.collect():
        assert x.why
        refused.setdefault(x.set_id, []).append((x["pass"], x.ordinal))
    for set_id, fs in findings.items():
        want, no = loop(fs, [e for e in edits if e[0] == set_id])
        assert got[set_id] == want and sorted(refused.get(set_id, [])) == no
    assert any(k.startswith("AI-") and v[3] for fs in got.values() for k, v in fs.items()), "no addition was withdrawn"
    assert RG.withdrawal_abstentions(done).count() == sum(v[3] for fs in got.values() for v in fs.values())


def test_quotes_are_looked_up_on_their_page(frame):
    words = frame([(1, 0, i, 50.0 + 40 * i, 100.0, 85.0 + 40 * i, 110.0, t) for i, t in enumerate("EXIT DISCHARGE WIDTH 44 INCHES".split())],
                  "set_id bigint, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = frame([(1, 0, 612.0, 792.0), (1, 1, 612.0, 792.0)], "set_id bigint, page int, width double, height double")
    edits = frame([(1, "F-1", 1, n, "revise", "", "", "t", "why", q, None, p) for n, (q, p) in enumerate([("WIDTH 44", 0), ("WIDTH 46", 0), ("WIDTH 44", 1), (" ", 0)])], EDITS)
    got = {r.ordinal: r for r in RG.prove_quotes(edits, words, pages).collect()}
    assert [got[n].quote_found for n in range(4)] == [True, False, False, False]
    assert got[0].box.x0 == 130.0 and got[0].box.x1 == 205.0
    assert RG.prove_quotes(edits.where(F.lit(False)), words, pages).count() == 0
