"""The file readers on files as tools leave them."""
import json

from planlens.sources import readers as R


def test_recognised_words_from_tab_separated_files(spark, tmp_path):
    at = tmp_path / "set_id=7" / "page=2"
    at.mkdir(parents=True)
    rows = [["5", "1", "1", "1", "1", str(n), left, "20", "30", "10", conf, text]
            for n, (left, conf, text) in enumerate([("5", "96.5", "EXIT"), ("40", "91", ' "A" '), ("80", "-1", "noise"), ("x", "95", "unboxed"), ("90", "95", " ")])]
    (at / "words.tsv").write_text("\n".join("\t".join(r) for r in [R.OCR_COLUMNS, *rows]) + "\n")
    got = {r.text: r for r in R.read_ocr_tsv(spark, str(tmp_path)).collect()}
    assert set(got) == {"EXIT", '"A"'}
    assert (got["EXIT"].set_id, got["EXIT"].page, got["EXIT"].x0, got["EXIT"].x1, got["EXIT"].y1) == (7, 2, 5.0, 35.0, 30.0)


def test_recorded_readings_and_their_page_errors(spark, tmp_path):
    one = {"set_id": 3, "file_sha256": "ab", "model": "m", "prompt_version": "1", "errors": {"4": "timed out"}, "usage": {"tokens": 9},
           "sheets": {"0": {"sheet_number": "G-1", "fields": [{"field": "stories", "value": "2", "quote": "TWO STORIES", "role": ""}]}, "1": {"sheet_number": None, "fields": []}}}
    (tmp_path / "a.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"set_id": 4, "sheets": None, "errors": None, "other": 1}))
    proposals, errors = R.read_readings(spark, str(tmp_path))
    assert [tuple(r) for r in proposals.collect()] == [(3, 0, "stories", "2", "TWO STORIES", "")]
    assert [tuple(r) for r in errors.collect()] == [(3, 4, "timed out")]


def test_drawing_sidecars(spark, tmp_path):
    box = [1.0, 2.0, 3.0, 4.0]
    side = {"set_id": 5, "pages": [{"page": 0, "number": "A-1", "title": "PLAN", "layout": "L1", "text": [{"text": "ROOM", "handles": ["2F"], "box": box}]}],
            "claims": [{"type": "attribute", "page": 0, "kind": "title", "tag": "NO", "prompt": "Number", "text": "A-1", "layer": "0", "handle": "30", "viewport": None,
                        "repeated": False, "box": None}, {"type": "dimension", "page": 0, "text": "12"}]}
    (tmp_path / "s.json").write_text(json.dumps(side, indent=2))
    pages, cells, attrs = R.read_sidecar(spark, str(tmp_path))
    assert [tuple(r) for r in pages.collect()] == [(5, 0, "A-1", "PLAN", "L1")]
    cell = cells.first()
    assert cell.text == "ROOM" and cell.handles == ["2F"] and tuple(cell.box) == tuple(box)
    assert [(a.tag, a.text, a.box) for a in attrs.collect()] == [("NO", "A-1", None)]


def test_declarations(spark, tmp_path):
    rows = [{"set_id": 1, "stories": 2, "height_ft": 26.5, "mixed_occupancy": False, "made_up": "x"}, {"set_id": 2, "occupancy_group": None}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r.set_id: r for r in R.read_declarations(spark, str(tmp_path)).collect()}
    assert (got[1].stories, got[1].height_ft, got[1].mixed_occupancy) == (2, 26.5, False) and "made_up" not in got[1]
    assert got[2].occupancy_group is None and got[2].stories is None
