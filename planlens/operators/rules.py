"""The rules: one set-wise job over every reading of every set.

A rule that looks at one set's own values is a Column: all of them are worked out side by side in
one projection over a wide frame with one row per (set, reading), so thirty rules cost one pass.
Rules that report per row (doors, spaces, conflicts, declared questions) are frames of their own.
Every (set, reading, rule) yields a finding or a recorded reason for not checking.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from planlens.functions import text as T, vocabulary as V
from planlens.sources import corpus as K
from planlens.session import kept
from planlens.sources.catalog import DECLARED_FIELDS, QUESTION_OF

CASE = ["set_id", "scenario"]
OUT = ("rule_id string, fid string, status string, severity string, discipline string, page int, sheet string, "
       "anchor string, title string, code string, basis string, reason string, detail string")
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
ABSENT = "not stated on the drawings and not answered in the project declaration"
NO_ROW = "{} row not carried in this build's corpus"

SCALAR: dict[str, Callable[[], Column]] = {}
FRAMES: dict[str, Callable[["Inputs", DataFrame], DataFrame]] = {}


def rule(rule_id: str):
    """A rule over one reading of one set, as a Column holding an array of outcomes."""
    def register(fn):
        SCALAR[rule_id] = fn
        return fn
    return register


def frame_rule(*rule_ids: str):
    """A rule that reports per row, as a DataFrame of outcomes."""
    def register(fn):
        for r in rule_ids:
            FRAMES[r] = fn
        return fn
    return register


@dataclass
class Inputs:
    """The tables a review run reads; any of them may be missing. All are keyed by set_id.

    scenario_rows: scenarios(reconciled, keep_silent=True). attrs: one row per set of values read
    off structured blocks. resolved: resolved_facts rows. claims: group-ranked claims of audit
    rows. The rest are the row tables the extraction steps give.
    """
    scenario_rows: DataFrame
    attrs: DataFrame | None = None
    resolved: DataFrame | None = None
    path_claims: DataFrame | None = None
    code_data: DataFrame | None = None
    exits: DataFrame | None = None
    doors: DataFrame | None = None
    spaces: DataFrame | None = None
    space_areas: DataFrame | None = None
    ventilation: DataFrame | None = None
    ceilings: DataFrame | None = None
    fixtures: DataFrame | None = None
    schedules: DataFrame | None = None
    sheets: DataFrame | None = None
    text: DataFrame | None = None
    egress_runs: DataFrame | None = None
    area_tally: DataFrame | None = None

    def given(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]


def _lit(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def outcome(rule_id: str, **values) -> Column:
    types = dict(x.split() for x in OUT.split(", "))
    return F.struct(*[_lit(values.get(c) if c != "rule_id" else rule_id).cast(types[c]).alias(c) for c in COLUMNS])


def found(rule_id: str, fid, bad, severity, discipline, at, anchor, title, code, basis="drawings") -> Column:
    """A finding that is open when ``bad`` holds and verified otherwise.

    ``fid``, ``title`` are (when bad, when good); ``severity`` is the level when bad; ``at`` is
    (page, sheet).
    """
    pick = lambda pair: F.when(bad, pair[0]).otherwise(pair[1]) if isinstance(pair, tuple) else _lit(pair)
    return outcome(rule_id, fid=pick(fid), status=pick(("OPEN", "PASS")), severity=F.when(bad, severity).otherwise("VERIFIED"),
                   discipline=discipline, page=at[0], sheet=at[1], anchor=anchor, title=pick(title), code=code, basis=basis)


def abstained(rule_id: str, reason, detail="") -> Column:
    return outcome(rule_id, reason=reason, detail=detail)


def one(*arms) -> Column:
    """The first arm whose condition holds, as a one-element array."""
    *conds, last = arms
    out = F.array(last)
    for cond, value in reversed(conds):
        out = F.when(cond, F.array(value)).otherwise(out)
    return out


# ---- the wide frame --------------------------------------------------------------------------

SECTION_FIELD = {"1005.3.2": "egress.width", "1006.2.1": "egress.common_path", "1006.3.2": "egress.exits", "1006.3.3": "egress.exits",
                 "1010.1.1": "egress.door_clear_width", "1017.2": "egress.travel_distance", "1020.3": "egress.corridor_width",
                 "1020.5": "egress.dead_end"}
TEXT_FLAGS = {"t_alarm": r"(?i)VOICE/ALARM|EVACS|907\.5\.2\.2", "t_unrated": "(?i)NON-RATED|NON RATED"}
ATTRS = {"occupant_load": "double", "meta_group": "string", "meta_sprinklered": "boolean", "meta_risk": "string", "area_stated": "double",
         "area_tabulated": "double", "oa_required_cfm": "double", "panel_rating_a": "double", "has_general_sheets": "boolean", "as_of": "date",
         "include_measured": "boolean"}


def _with(case: DataFrame, extra: DataFrame | None, cols: dict[str, str], need: set[str] | None = None) -> DataFrame:
    """Left-join a one-row-per-set frame, adding NULL columns where it is missing or nothing of it is needed."""
    have = [] if extra is None or (need is not None and not need & set(cols)) else [c for c in cols if c in extra.columns]
    if have:
        case = case.join(extra.select("set_id", *have), "set_id", "left")
    return case.select("*", *[F.lit(None).cast(t).alias(c) for c, t in cols.items() if c not in have])


def _resolved_name(field: str, role: str) -> str:
    return "r_" + field.replace(".", "_") + (f"_{role}" if role else "")


def needed(only: list[str] | None) -> set[str] | None:
    """The wide frame's columns the rules read, worked out from their expressions (None: all)."""
    if only is None:
        return None
    names = {"tally", "first_sheet"} if any(r in FRAMES for r in only) else set()
    for r in only:
        if r in SCALAR:
            names |= set(re.findall(r"\w+", str(SCALAR[r]())))
    if "rival" in names:
        names.add("s_1006_2_1")
    for s, f in SECTION_FIELD.items():
        if "s_" + s.replace(".", "_") in names:
            names |= {"c_" + s.replace(".", "_"), _resolved_name(f, "required"), _resolved_name(f, "provided")}
    if names & {"wc_m", "sinks"}:
        names |= {"f_wc_m", "grp"}
    if names & {"grp", "letter", "k_path", "k_travel"}:
        names.add("meta_group")
    if names & {"sprk", "k_path", "k_travel"}:
        names.add("meta_sprinklered")
    if "cur" in names:
        names.add("as_of")
    return names


def build_case(i: Inputs, spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """One row per (set, reading) with everything the wanted rules read; inputs none of them reads are not joined."""
    need = needed(only)
    rows = i.scenario_rows
    box = F.struct("num", "str", "basis", "page", "state")
    # one conditional aggregate per question, so that those no rule reads are pruned
    case = rows.groupBy(*CASE).agg(*[F.first(F.when(F.col("field") == f, box), ignorenulls=True).alias(f"b_{f}") for f in DECLARED_FIELDS])
    case = _with(case, i.attrs, ATTRS, need)
    # what each audit row states: the cited block row, else the resolved fact of that section
    dtype = "struct<required:double,provided:double,page:int,sheet:string,anchor:string,required_raw:string>"
    data = None
    if i.code_data is not None:
        keep = F.struct(F.col("required").cast("double").alias("required"), F.col("provided").cast("double").alias("provided"),
                        F.col("page").cast("int").alias("page"), "sheet", F.col("label").alias("anchor"), "required_raw")
        data = i.code_data.groupBy("set_id").agg(*[
            F.min_by(keep, F.when(F.col("section") == s, F.col("ord"))).alias("c_" + s.replace(".", "_")) for s in SECTION_FIELD])
    case = _with(case, data, {"c_" + s.replace(".", "_"): dtype for s in SECTION_FIELD}, need)
    audit = sorted(set(SECTION_FIELD.values()))
    rtype = "struct<value:double,page:int,sheet:string,label:string,raw:string,n_methods:bigint,method:string,txt:string>"
    wanted = [(f, r) for f in audit for r in ("required", "provided")] + [
        (f, "") for f in ("occupant_load", "egress_width_factor", "building_area_sf", "total_area_sf", "area.tabulated_total_sf", "risk_category")]
    name = _resolved_name
    res = None
    if i.resolved is not None:
        keep = F.struct(F.col("value_num").alias("value"), F.col("lead.page").cast("int").alias("page"), F.col("lead.sheet").alias("sheet"),
                        F.col("lead.label").alias("label"), F.col("lead.raw").alias("raw"), F.col("n_methods"), F.col("lead.method").alias("method"),
                        F.col("value_str").alias("txt"))
        res = i.resolved.groupBy("set_id").agg(*[
            F.first(F.when((F.col("field") == f) & (F.col("role") == r), keep), ignorenulls=True).alias(name(f, r)) for f, r in wanted])
    case = _with(case, res, {name(f, r): rtype for f, r in wanted}, need)

    for s, f in SECTION_FIELD.items():
        c, q, p = F.col("c_" + s.replace(".", "_")), F.col(name(f, "required")), F.col(name(f, "provided"))
        home = F.coalesce(q, p)
        alt = F.when(home.isNotNull(), F.struct(q["value"].alias("required"), p["value"].alias("provided"), home["page"].alias("page"),
                                                home["sheet"].alias("sheet"), home["label"].alias("anchor"), q["raw"].alias("required_raw")))
        case = case.withColumn("s_" + s.replace(".", "_"), F.coalesce(c, alt))

    if i.text is not None:
        t = F.coalesce("text", F.lit(""))
        hit = F.struct(F.col("page").cast("int").alias("page"), T.rx(t, f"({V.LOAD_POSTING})", 1).alias("words"))
        flags = i.text.groupBy("set_id").agg(
            *[F.bool_or(t.rlike(p)).alias(k) for k, p in TEXT_FLAGS.items()], F.min(F.length(F.trim(t))).alias("t_shortest"),
            F.min_by(hit, F.when(t.rlike(V.LOAD_POSTING), F.col("page"))).alias("t_posting"),
            F.min_by(F.regexp_replace(T.rx(t, V.STATED_LOAD, 1), ",", "").cast("double"), F.when(t.rlike(V.STATED_LOAD), F.col("page"))).alias("t_load"))
    else:
        flags = None
    case = _with(case, flags, {"t_alarm": "boolean", "t_unrated": "boolean", "t_shortest": "int", "t_posting": "struct<page:int,words:string>",
                               "t_load": "double"}, need)

    exits = None
    if i.exits is not None:
        k = F.try_divide(F.col("width_provided_in"), F.col("capacity"))
        rated = i.exits.where("width_provided_in > 0 and capacity > 0")
        exits = rated.groupBy("set_id").agg(F.min(k).alias("x_lo"), F.max(k).alias("x_hi"), F.min_by(
            F.struct(F.col("page").cast("int").alias("page"), F.col("exit").alias("anchor")), F.struct("page", "exit")).alias("x_first"))
    case = _with(case, exits, {"x_lo": "double", "x_hi": "double", "x_first": "struct<page:int,anchor:string>"}, need)

    ceil = None
    if i.ceilings is not None:
        ceil = i.ceilings.groupBy("set_id").agg(F.min("height_ft").alias("h_low"), F.count(F.lit(1)).alias("h_n"), F.min_by(
            F.struct(F.col("page").cast("int").alias("page"), F.col("code").alias("sheet"), F.col("raw").alias("anchor")), "height_ft").alias("h_at"))
    case = _with(case, ceil, {"h_low": "double", "h_n": "bigint", "h_at": "struct<page:int,sheet:string,anchor:string>"}, need)

    spaces = None
    if i.space_areas is not None:
        factors = sorted({f for _, f in K.LOAD_GROSS})
        spaces = i.space_areas.where("area_sf >= 50").groupBy("set_id").agg(
            F.count(F.lit(1)).alias("sp_n"), F.map_from_arrays(F.array(*[F.lit(f) for f in factors]), F.array(*[
                F.sum(F.ceil(F.col("area_sf") / f).cast("double")) for f in factors])).alias("sp_loads")).where("sp_n >= 2")
    case = _with(case, spaces, {"sp_n": "bigint", "sp_loads": "map<double,double>"}, need)

    sh = None
    if i.sheets is not None:
        unread = F.col("code") == F.concat(F.lit("p"), (F.col("page") + 1).cast("string"))
        title = F.upper(F.coalesce(F.col("title") if "title" in i.sheets.columns else F.lit(None), F.lit("")))
        sh = i.sheets.groupBy("set_id").agg(
            F.count(F.lit(1)).alias("n_sheets"), F.count_if(unread).alias("n_unread"),
            F.bool_or(title.contains("CEILING") | title.startswith("RCP")).alias("has_rcp"), F.min_by("code", "page").alias("first_sheet"))
    case = _with(case, sh, {"n_sheets": "bigint", "n_unread": "bigint", "has_rcp": "boolean", "first_sheet": "string"}, need)

    sched = None
    if i.schedules is not None:
        oa = F.element_at(F.map_values(F.map_filter("cells", lambda k, v: F.upper(k).contains("OUTSIDE AIR"))), -1)
        oa = F.when(F.size(F.map_filter("cells", lambda k, v: F.upper(k).contains("OUTSIDE AIR"))) > 0, oa)
        num = lambda c: T.rx(F.regexp_replace(c, ",", ""), r"(-?\d+\.?\d*)", 1).try_cast("double")
        rtu, elec = F.col("schedule") == "ROOF TOP UNIT SCHEDULE", F.col("schedule") == "ELECTRICAL LOAD CALCULATIONS"
        amp = elec & F.upper("mark").contains("AMPERAGE")
        sched = i.schedules.groupBy("set_id").agg(
            F.min_by(F.struct(num(oa).alias("oa"), F.col("page").cast("int").alias("page"), "mark"), F.when(rtu, F.col("row_no"))).alias("u_first"),
            F.max(F.when(elec, 1)).alias("e_any"), F.max_by(num(F.try_element_at("vals", F.lit(2))), F.when(amp, F.col("row_no"))).alias("e_amps"),
            F.min(F.when(elec, F.col("page"))).cast("int").alias("e_page"),
            F.max(F.when(F.col("schedule") == "OCCUPANT DENSITY", 1)).alias("v_any"))
    case = _with(case, sched, {"u_first": "struct<oa:double,page:int,mark:string>", "e_any": "int", "e_amps": "double", "e_page": "int", "v_any": "int"}, need)

    vent = None
    if i.ventilation is not None:
        z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        people = F.col("area_sf") * F.col("density") / 1000.0
        vbz = z("rp") * z("persons") + z("ra") * z("area_sf")
        off = (F.abs(F.col("persons") - people) >= 1.0).cast("int")
        vent = i.ventilation.where("not is_total and total_cfm is not null").groupBy("set_id").agg(
            F.count(F.lit(1)).alias("v_n"), F.sum(vbz).alias("v_sum"),
            (F.sum(F.coalesce(off, F.lit(0))) + F.sum((F.abs(F.col("total_cfm") - vbz) > 1.0).cast("int"))).alias("v_bad"),
            F.min("page").cast("int").alias("v_page"))
    case = _with(case, vent, {"v_n": "bigint", "v_sum": "double", "v_bad": "bigint", "v_page": "int"}, need)

    fx = None
    if i.fixtures is not None:
        at = lambda part, kind, c: F.max(F.when((F.col("part") == part) & (F.col("kind") == kind), F.col(c)))
        kinds = ("wc", "lav", "drinking_fountain", "service_sink")
        fx = i.fixtures.groupBy("set_id").agg(
            F.min("page").cast("int").alias("f_page"), at("load", "load", "male").alias("f_load"), at("ratio", "wc", "male").alias("f_wc_m"),
            at("ratio", "wc", "female").alias("f_wc_f"), at("ratio", "lav", "male").alias("f_lav_m"), at("ratio", "lav", "female").alias("f_lav_f"),
            at("ratio", "drinking_fountain", "male").alias("f_df"), F.count_if(F.col("part") == "ratio").alias("f_ratios"),
            F.count_if(F.col("part") == "provided").alias("f_provided"),
            *[at(p, k, "male").alias(f"f_{p}_{k}") for p in ("required", "provided") for k in kinds])
    kinds = ("wc", "lav", "drinking_fountain", "service_sink")
    case = _with(case, fx, {"f_page": "int", "f_load": "double", "f_wc_m": "double", "f_wc_f": "double", "f_lav_m": "double", "f_lav_f": "double",
                            "f_df": "double", "f_ratios": "bigint", "f_provided": "bigint",
                            **{f"f_{p}_{k}": "double" for p in ("required", "provided") for k in kinds}}, need)

    case = _with(case, i.egress_runs, {"g_page": "int", "g_sheet": "string", "g_segments": "bigint", "g_run_pt": "double", "g_scale": "double", "g_why": "string"}, need)
    tally = None
    if i.area_tally is not None:
        tally = i.area_tally.select("set_id", F.struct(F.col("page").cast("int").alias("page"), "heading", "total_sf").alias("tally"))
    case = _with(case, tally, {"tally": "struct<page:int,heading:string,total_sf:double>"}, need)

    # the rival statement of the common path on another sheet, when the set holds one
    rv = None
    if i.path_claims is not None and (need is None or "rival" in need):
        d = case.select("set_id", F.col("s_1006_2_1.sheet").alias("d_sheet"), F.col("s_1006_2_1.required").alias("d_req")).where("d_req is not null").distinct()
        j = i.path_claims.join(d, "set_id").where((F.col("sheet") != F.col("d_sheet")) & (F.abs(F.col("value_num") - F.col("d_req")) > 0.5))
        rv = j.groupBy("set_id").agg(F.min_by(F.struct(F.col("value_num").alias("value"), F.col("page").cast("int").alias("page"), "sheet", "label"),
                                              F.struct("rank", "page", "seq")).alias("rival"))
    case = _with(case, rv, {"rival": "struct<value:double,page:int,sheet:string,label:string>"}, need)
    return _lookups(case)


def _lookups(case: DataFrame) -> DataFrame:
    """The code tables' answers, as literal maps and cases: tables of a fixed few rows need no join."""
    tables = K.code_tables()
    c = T.staged(case, grp=F.coalesce(b("occupancy_group"), F.col("meta_group")), sprk=F.coalesce(
        b("sprinkler_system").isin(V.SPRINKLER_PRESENT), F.col("meta_sprinklered")), own_grp=b("occupancy_group"), ctype=b("construction_type"),
        credited=b("sprinkler_system").isin(V.SPRINKLER_CREDITED), edition=b("code_edition"))
    c = c.withColumn("letter", F.upper(F.element_at(F.split("grp", "-"), 1))).withColumn("own_letter", F.element_at(F.split("own_grp", "-"), 1))
    text = lambda v: str(v).lower() if isinstance(v, bool) else v

    def look(table: str, on: list[str], take: int) -> Column:
        """Column ``take`` of the row whose first columns are ``on``; NULL without such a row or with a NULL key."""
        pairs = [x for row in tables[table][0] for x in (F.lit("|".join(text(v) for v in row[:len(on)])), F.lit(row[take]))]
        key = F.concat(*[y for i, x in enumerate(on) for y in ([F.lit("|")] if i else []) + [F.col(x).cast("string")]])
        return F.try_element_at(F.create_map(*pairs), key)
    unrated = lambda row: all(v == 0 for v in row[1:])  # heavy timber (NULL) is rated
    rated = F.create_map(*[x for row in tables["ratings"][0] for x in (F.lit(row[0]), F.lit(unrated(row)))])
    c = c.withColumns({
        "k_path": look("common_path", ["letter", "sprk"], 2), "k_travel": look("travel", ["letter", "sprk"], 2),
        "k_height": look("height", ["own_letter", "ctype", "credited"], 3), "k_stories": look("stories", ["own_grp", "ctype", "credited"], 3),
        "k_ns": look("area", ["own_grp", "ctype"], 2), "k_s1": look("area", ["own_grp", "ctype"], 3), "k_sm": look("area", ["own_grp", "ctype"], 4),
        "k_rated": F.try_element_at(rated, F.col("ctype")).isNotNull(), "k_unrated": F.try_element_at(rated, F.col("ctype")),
        "k_factor": F.coalesce(look("load_gross", ["own_grp"], 1), look("load_gross", ["own_letter"], 1)),
        "as_of": F.coalesce("as_of", F.current_date())})
    c = c.withColumn("k_rated", F.when(F.col("k_rated"), True))
    # the edition cited, and the latest already in force on the review's date
    of = lambda e: F.struct(F.lit(e[0]).alias("key"), F.lit(e[3]).alias("effective"), F.lit(e[5]).cast("string").alias("wind"), F.lit(e[1]).alias("ordinal"))
    cited, now = F.lit(None), F.lit(None)
    for e in sorted(K.EDITIONS, key=lambda e: e[3]):
        cited, now = F.when(F.col("edition") == e[0], of(e)).otherwise(cited), F.when(F.col("as_of") >= F.lit(e[3]), of(e)).otherwise(now)
    c = c.withColumn("cur", now).withColumn("_ed", cited)
    c = c.withColumns({"ed_from": F.col("_ed.effective"), "ed_wind": F.col("_ed.wind"), "ed_ordinal": F.col("_ed.ordinal")}).drop("_ed")
    # the plumbing row whose ratios the sheet prints
    row = F.lit(None)
    for g, _, wm, wf, lm, lf, df, sinks in K.PLUMBING_ROWS:
        hit = ((F.col("f_wc_m") == wm) & (F.col("f_wc_f") == wf) & (F.col("f_lav_m") == lm) & (F.col("f_lav_f") == lf) & (F.col("f_df") == df)
               & (F.col("grp").isNull() | F.col("grp").isin(g, g.split("-")[0])))
        row = F.coalesce(row, F.when(hit, F.struct(*[F.lit(v).alias(k) for k, v in (("wc_m", wm), ("wc_f", wf), ("lav_m", lm), ("lav_f", lf), ("df", df), ("sinks", sinks))])))
    c = c.withColumn("_p", row)
    return c.withColumns({k: F.col(f"_p.{k}") for k in ("wc_m", "wc_f", "lav_m", "lav_f", "df", "sinks")}).drop("_p")


# ---- short names for the wide frame's columns --------------------------------------------------

def b(field: str) -> Column:
    """A building answer of this reading."""
    part = "num" if field in ("building_area_sf", "total_area_sf", "height_ft", "stories", "wind_speed_mph") else "str"
    return F.col(f"b_{field}")[part]


def participating(field: str) -> Column:
    """A building answer, only where the declaration had something to say about it."""
    return F.when(F.col(f"b_{field}")["state"].isin("CORROBORATED", "CONFLICT", "DECLARED_ONLY"), b(field))


def s(section: str) -> Column:
    return F.col("s_" + section.replace(".", "_"))


def where(*names: str) -> tuple[Column, Column]:
    """Page and sheet to hang a finding on: the page of the first drawn input, else the first."""
    page = F.coalesce(*[F.col(f"b_{f}")["page"] for f in names], F.lit(0))
    return page, F.coalesce(F.when(page == 0, F.col("first_sheet")), F.concat(F.lit("p"), (page + 1).cast("string")))


def basis(*names: str) -> Column:
    seen = F.array_compact(F.array(*[F.when(F.col(f"b_{f}")["state"] != "UNKNOWN", F.col(f"b_{f}")["basis"]) for f in names]))
    return (F.when(F.array_contains(seen, "declaration"), "declaration")
            .when((F.size(seen) > 0) & F.forall(seen, lambda x: x == "both"), "both").otherwise("drawings"))


def missing(*names: str) -> Column:
    return F.concat_ws("; ", *[F.when(b(f).isNull(), F.lit(QUESTION_OF[f])) for f in names])


def datum_at(section: str) -> tuple[Column, Column]:
    return s(section)["page"], s(section)["sheet"]


def no_context(group: bool = True, sprinklers: bool = True) -> tuple[Column, Column]:
    """(is something missing, what) of the group and sprinkler status egress tables need."""
    parts = []
    if group:
        parts.append(F.when(F.col("grp").isNull(), F.lit(QUESTION_OF["occupancy_group"])))
    if sprinklers:
        parts.append(F.when(F.col("sprk").isNull(), F.lit(QUESTION_OF["sprinkler_system"])))
    text = F.concat_ws("; ", *parts)
    return text != "", text


def computed_load(read: Callable[[str], Column]) -> Column:
    """Occupants from the gross factor: space by space when the set lists spaces, else whole."""
    area = F.coalesce(F.nullif(read("building_area_sf"), F.lit(0.0)), read("total_area_sf"))
    by_space = F.try_element_at("sp_loads", F.col("k_factor"))
    return F.when(read("occupancy_group").isNotNull(), F.coalesce(by_space, F.ceil(area / F.col("k_factor")).cast("double")))


# ---- egress ------------------------------------------------------------------------------------
EG = "Means of egress"


@rule("EGRESS.COMMON_PATH")
def _():
    r, d, other = "EGRESS.COMMON_PATH", s("1006.2.1"), F.col("rival")
    lack, what = no_context()
    off = F.abs(d["required"] - F.col("k_path")) > 0.5
    here = found(r, ("H-02", "V-CP"), off, "HIGH", EG, datum_at("1006.2.1"), d["anchor"],
                 ("common path requirement misstated", "common path requirement is correct"), "1006.2.1")
    there = found(r, "H-02", F.lit(True), "HIGH", EG, (other["page"], other["sheet"]), other["label"],
                  "common path requirement misstated on another sheet", "1006.2.1")
    return one((d["required"].isNull(), abstained(r, "no code datum citing 1006.2.1 with a parseable required value")),
               (lack, abstained(r, ABSENT, what)), (F.col("k_path").isNull(), abstained(r, NO_ROW.format("Table 1006.2.1"), F.col("grp"))),
               (off, here), (other.isNotNull(), there), here)


def _limit_rule(r: str, section: str, limit: Column, fids, severity: str, subject: str, sprinklers: bool = True, table: str | None = None):
    d = s(section)
    lack, what = no_context(sprinklers=sprinklers)
    off = F.abs(d["required"] - limit) > 0.5
    arms = [(d["required"].isNull(), abstained(r, f"no parseable {section} datum")), (lack, abstained(r, ABSENT, what))]
    if table:
        arms.append((limit.isNull(), abstained(r, NO_ROW.format(table), F.col("grp"))))
    return one(*arms, found(r, fids, off, severity, EG, datum_at(section), d["anchor"],
                            (f"{subject} is wrong", f"{subject} is correct"), section))


@rule("EGRESS.TRAVEL_DISTANCE")
def _():
    return _limit_rule("EGRESS.TRAVEL_DISTANCE", "1017.2", F.col("k_travel"), ("H-TD", "V-01"), "HIGH", "travel distance limit", table="Table 1017.2")


@rule("EGRESS.DEAD_END")
def _():
    long = F.col("sprk") & (F.upper("grp").isin(K.DEAD_END_LONG_GROUPS) | F.col("letter").isin(K.DEAD_END_LONG_GROUPS))
    limit = F.when(long, K.DEAD_END_LONG_FT).otherwise(K.DEAD_END_FT)
    return _limit_rule("EGRESS.DEAD_END", "1020.5", limit, ("M-DE", "V-02"), "MEDIUM", "dead-end limit")


@rule("EGRESS.CORRIDOR_WIDTH")
def _():
    return _limit_rule("EGRESS.CORRIDOR_WIDTH", "1020.3", F.lit(K.CORRIDOR_IN), ("M-CW", "V-03"), "MEDIUM", "corridor width", sprinklers=False)


@rule("EGRESS.CAPACITY_FACTOR")
def _():
    r, d = "EGRESS.CAPACITY_FACTOR", s("1005.3.2")
    lack, what = no_context(group=False)
    load = F.nullif("occupant_load", F.lit(0.0))
    allowed = F.when(F.col("sprk") & F.coalesce("t_alarm", F.lit(False)), K.CAPACITY_REDUCED).otherwise(K.CAPACITY_BASE)
    low = d["required"] / load < allowed - 0.005
    return one((d["required"].isNull(), abstained(r, "no parseable 1005.3.2 datum")), (load.isNull(), abstained(r, "occupant load not extracted")),
               (lack, abstained(r, ABSENT, what)),
               found(r, ("M-01", "V-CF"), low, "MEDIUM", EG, datum_at("1005.3.2"), d["anchor"],
                     ("egress width factor is not supported", "egress width factor is supported"), "1005.3.2"))


@rule("EGRESS.EXIT_COUNT")
def _():
    r, d = "EGRESS.EXIT_COUNT", F.coalesce(s("1006.3.2"), s("1006.3.3"))
    load = F.coalesce(F.nullif("occupant_load", F.lit(0.0)), computed_load(participating))
    need = F.coalesce(*[F.when(load <= top, F.lit(n)) for top, n in K.EXIT_STEPS])
    return one((load.isNull(), abstained(r, "occupant load not extracted")), (d["provided"].isNull(), abstained(r, "exit count row not found in a code data block")),
               found(r, ("C-EX", "V-04"), d["provided"] < need, "CRITICAL", EG, (d["page"], d["sheet"]), d["anchor"],
                     ("too few exits", "exit count is correct"), "1006.3.2"))


@rule("EGRESS.FACTOR_CONSISTENCY")
def _():
    r, d = "EGRESS.FACTOR_CONSISTENCY", s("1005.3.2")
    used = F.coalesce(F.col("r_egress_width_factor")["value"], F.nullif(d["required"], F.lit(0.0)) / F.nullif("occupant_load", F.lit(0.0)))
    differ = (F.col("x_hi") - used > 0.005) | (used - F.col("x_lo") > 0.005)
    x = F.col("x_first")
    return one((F.col("x_lo").isNull(), abstained(r, "exit widths and the occupants each exit is rated for not extracted")),
               (used.isNull(), abstained(r, "required-width capacity factor not extracted")),
               found(r, ("M-02", "V-UF"), differ, "MEDIUM", EG, (x["page"], F.concat(F.lit("p"), (x["page"] + 1).cast("string"))), x["anchor"],
                     ("two capacity factors in one analysis", "one capacity factor throughout"), "1005.3.2"))


@rule("EGRESS.CEILING_HEIGHT")
def _():
    r, at = "EGRESS.CEILING_HEIGHT", F.col("h_at")
    return one((~F.coalesce("has_rcp", F.lit(False)), abstained(r, "reflected ceiling plan not found in this set")),
               (F.col("h_low").isNull(), abstained(r, "ceiling heights not extracted from the reflected ceiling plan")),
               found(r, ("M-CH", "V-17"), F.col("h_low") + 1e-6 < K.MIN_CEILING_FT, "MEDIUM", EG, (at["page"], at["sheet"]), at["anchor"],
                     ("a ceiling is under the minimum", "ceiling heights clear the minimum"), "1003.2"))


@rule("EGRESS.OCCUPANT_LOAD_POSTING")
def _():
    r, ol = "EGRESS.OCCUPANT_LOAD_POSTING", F.col("r_occupant_load")
    lack, what = no_context(sprinklers=False)
    hit = F.col("t_posting")
    page = F.coalesce(hit["page"], ol["page"], F.lit(0))
    sheet = F.coalesce(F.when(hit.isNull(), ol["sheet"]), F.concat(F.lit("p"), (page + 1).cast("string")))
    return one((lack, abstained(r, ABSENT, what)),
               (~F.col("grp").isin(K.POSTING_GROUPS) & ~F.col("letter").isin(K.POSTING_GROUPS),
                abstained(r, "the occupant-load posting of 1004.9 applies only to assembly occupancies", F.col("grp"))),
               (F.coalesce("t_shortest", F.lit(0)) < 20, abstained(r, "sheet text not extracted on every sheet, so an absent posting cannot be established")),
               found(r, ("M-05", "V-OLP"), hit["words"].isNull(), "MEDIUM", EG, (page, sheet), F.coalesce(hit["words"], ol["label"], F.lit("OCCUPANT LOAD")),
                     ("assembly occupant-load posting is not shown", "the occupant-load posting is called for"), "1004.9"))


@rule("EGRESS.OCCUPANT_LOAD_COMPUTED")
def _():
    r = "EGRESS.OCCUPANT_LOAD_COMPUTED"
    load = computed_load(b)
    stated = F.coalesce(F.nullif("occupant_load", F.lit(0.0)), "t_load")
    off = F.abs(stated - load)
    bad = F.coalesce(off > F.greatest(F.lit(1.0), 0.02 * load), F.lit(False))
    sev = F.when(stated > load, "MEDIUM").otherwise("HIGH")
    title = ("stated occupant load does not follow from the factor", "occupant load agrees with the factor")
    return one((b("occupancy_group").isNull(), abstained(r, ABSENT, missing("occupancy_group"))),
               (F.col("k_factor").isNull(), abstained(r, "Table 1004.5 has no single gross factor for this group", F.col("own_grp"))),
               (F.col("sp_n").isNull() & b("building_area_sf").isNull(), abstained(r, ABSENT, missing("building_area_sf"))),
               (load.isNull(), abstained(r, "no area to apply the factor to")),
               found(r, ("H-OL", "V-OL"), bad, sev, "Occupancy", where("building_area_sf", "occupancy_group"), "OCCUPANT LOAD", title, "1004.5",
                     basis("occupancy_group", "building_area_sf")))


# ---- doors, mechanical, electrical, plumbing ----------------------------------------------------

@rule("DOORS.CLEAR_WIDTH_REQUIREMENT")
def _():
    r, d = "DOORS.CLEAR_WIDTH_REQUIREMENT", s("1010.1.1")
    return one((d["required"].isNull(), abstained(r, "stated door clear-width requirement not extracted")),
               found(r, ("H-DR", "V-05"), d["required"] + 0.01 < K.DOOR_CLEAR_IN, "HIGH", EG, datum_at("1010.1.1"), d["anchor"],
                     ("door clear-width requirement understated", "stated clear opening meets the requirement"), "1010.1.1"))


@rule("MECH.OUTDOOR_AIR_CAPACITY")
def _():
    r, u = "MECH.OUTDOOR_AIR_CAPACITY", F.col("u_first")
    at = (u["page"], F.concat(F.lit("p"), (u["page"] + 1).cast("string")))
    return one((F.col("oa_required_cfm").isNull(), abstained(r, "outdoor-air total not extracted")), (u.isNull(), abstained(r, "no rooftop unit schedule found")),
               (u["oa"].isNull(), abstained(r, "unit schedule has no outside-air column")),
               found(r, ("C-01", "V-OA"), F.col("oa_required_cfm") - u["oa"] > 1, "CRITICAL", "Mechanical", at, "OUTDOOR AIR CALCULATIONS",
                     ("outdoor-air capacity below the sheet's own requirement", "scheduled outdoor air meets the requirement"), "403.3.1.1"))


@rule("MECH.OUTDOOR_AIR_ARITHMETIC")
def _():
    r = "MECH.OUTDOOR_AIR_ARITHMETIC"
    total = F.coalesce(F.abs(F.col("oa_required_cfm") - F.col("v_sum")) > F.greatest(F.lit(1.0), 0.5 * F.col("v_n")), F.lit(False))
    at = (F.col("v_page"), F.concat(F.lit("p"), (F.col("v_page") + 1).cast("string")))
    return one((F.col("v_any").isNull() | F.col("v_n").isNull(), abstained(r, "outdoor-air calculation rows not extracted")),
               found(r, ("M-OA", "V-35"), (F.col("v_bad") > 0) | total, "MEDIUM", "Mechanical", at, "OUTDOOR AIR CALCULATIONS",
                     ("the outdoor-air calculation does not add up", "the outdoor-air arithmetic is correct"), "403.3.1.1.1"))


@rule("ELEC.PANEL_LOADING")
def _():
    r = "ELEC.PANEL_LOADING"
    at = (F.col("e_page"), F.concat(F.lit("p"), (F.col("e_page") + 1).cast("string")))
    return one((F.col("e_any").isNull(), abstained(r, "no load calculation table found")),
               (F.col("e_amps").isNull() | F.col("panel_rating_a").isNull(), abstained(r, "total amperage or panel rating not extracted")),
               found(r, ("C-PL", "V-30"), F.col("e_amps") / F.col("panel_rating_a") * 100 > 100, "CRITICAL", "Electrical", at, "PANEL SCHEDULE",
                     ("connected load exceeds the panel rating", "the panel has headroom"), "NEC 220"))


@rule("PLUMB.FIXTURE_COUNT")
def _():
    r = "PLUMB.FIXTURE_COUNT"
    load = F.coalesce(F.nullif("f_load", F.lit(0.0)), F.nullif("occupant_load", F.lit(0.0)))
    half = load / 2
    up = lambda a, n: F.ceil(a / F.col(n)).cast("double")
    need = {"wc": up(half, "wc_m") + up(half, "wc_f"), "lav": up(half, "lav_m") + up(half, "lav_f"), "drinking_fountain": up(load, "df"), "service_sink": F.col("sinks")}
    any_of = lambda cs: reduce(lambda x, y: x | y, cs)
    short = (F.col("f_provided") > 0) & any_of([F.coalesce(F.col(f"f_provided_{k}"), F.lit(0.0)) < n for k, n in need.items()])
    wrong = any_of([F.coalesce(F.col(f"f_required_{k}") != n, F.lit(False)) for k, n in need.items()])
    at = (F.col("f_page"), F.concat(F.lit("p"), (F.col("f_page") + 1).cast("string")))
    common = dict(discipline="Plumbing", at=at, anchor="PLUMBING COUNTS", code="Table 2902.1")
    return one((F.coalesce("f_ratios", F.lit(0)) == 0, abstained(r, "plumbing fixture calculation not extracted")),
               (load.isNull(), abstained(r, "occupant load not extracted")),
               (F.col("wc_m").isNull(), abstained(r, NO_ROW.format("Table 2902.1"), F.col("grp"))),
               (short, found(r, "P-01", F.lit(True), "HIGH", title="fewer fixtures provided than required", **common)),
               found(r, ("P-02", "V-06"), wrong, "MEDIUM", title=("stated fixture requirement is miscomputed", "every ratio, split and round-up is correct"), **common))


# ---- across sheets ------------------------------------------------------------------------------

@rule("XSHEET.BUILDING_AREA")
def _():
    r = "XSHEET.BUILDING_AREA"
    ca = F.coalesce(F.col("r_building_area_sf"), F.col("r_total_area_sf"))
    cb = F.col("r_area_tabulated_total_sf")
    a = F.coalesce(ca["value"], "area_stated", participating("building_area_sf"))
    t = F.coalesce(cb["value"], "area_tabulated", participating("total_area_sf"))
    used_a, used_t = F.coalesce(ca["value"], F.col("area_stated")).isNull(), F.coalesce(cb["value"], F.col("area_tabulated")).isNull()
    bs = F.when(used_a & used_t, basis("building_area_sf", "total_area_sf")).when(used_a, basis("building_area_sf")).when(
        used_t, basis("total_area_sf")).otherwise("drawings")
    at = (F.coalesce(ca["page"], F.lit(0)), F.coalesce(ca["sheet"], "first_sheet"))
    why = F.when(F.coalesce("has_general_sheets", F.lit(True)), "building area not found on both general sheets").otherwise(
        "this submittal carries no general sheets, so neither area was read from one; declare the building area to have this checked")
    return one((a.isNull() | t.isNull(), abstained(r, why)),
               found(r, ("M-04", "V-AR"), F.abs(a - t) > 1, "MEDIUM", "Occupancy", at, F.concat(F.format_number(a, 0), F.lit(" SF")),
                     ("building area disagrees between sheets", "building area agrees"), "1004.5", bs))


@rule("XSHEET.RISK_CATEGORY")
def _():
    r, claim = "XSHEET.RISK_CATEGORY", F.col("r_risk_category")
    rc = F.coalesce(F.nullif("meta_risk", F.lit("")), participating("risk_category"))
    load = F.coalesce(F.nullif("occupant_load", F.lit(0.0)), computed_load(participating))
    home = F.when(F.col("meta_risk").isNotNull(), claim)
    bad = F.upper(F.trim(rc)).isin("III", "3") & (load <= K.RISK_III_LOAD)
    return one((rc.isNull() | load.isNull(), abstained(r, "risk category or occupant load not extracted")),
               found(r, ("M-03", "V-RC"), bad, "MEDIUM", "Structural / Occupancy", (F.coalesce(home["page"], F.lit(0)), F.coalesce(home["sheet"], "first_sheet")),
                     F.coalesce(home["label"], F.lit("RISK CATEGORY")), ("risk category III does not match the occupant load", "risk category is consistent"), "Table 1604.5"))


# ---- height, area, fire, structure, code ----------------------------------------------------------

def _table_rule(r: str, keys: tuple[str, ...], limit: Column, value: Column, fids, table: str, at: tuple[str, ...], anchor: str, subject: str):
    gone = missing(*keys)
    return one((gone != "", abstained(r, ABSENT, gone)), (limit.isNull(), abstained(r, NO_ROW.format(table), F.concat_ws(", ", "own_grp", "ctype"))),
               found(r, fids, value > limit, "CRITICAL", "Height and area", where(*at), anchor,
                     (f"{subject} exceeds what the table allows", f"{subject} is within what the table allows"), table, basis(*keys)))


_GTS = ("occupancy_group", "construction_type", "sprinkler_system")


@rule("HEIGHT_AREA.TABLE_504_HEIGHT")
def _():
    return _table_rule("HEIGHT_AREA.TABLE_504_HEIGHT", (*_GTS, "height_ft"), F.col("k_height"), b("height_ft"), ("H-504H", "V-504H"), "Table 504.3",
                       ("height_ft", "construction_type", "occupancy_group"), "BUILDING HEIGHT", "building height")


@rule("HEIGHT_AREA.TABLE_504_STORIES")
def _():
    return _table_rule("HEIGHT_AREA.TABLE_504_STORIES", (*_GTS, "stories"), F.col("k_stories"), F.floor(b("stories")), ("H-504S", "V-504S"), "Table 504.4",
                       ("stories", "construction_type", "occupancy_group"), "NUMBER OF STORIES", "storey count")


@rule("HEIGHT_AREA.TABLE_506_AREA")
def _():
    n = F.floor(b("stories"))
    single = F.coalesce((n != 0) & (n <= 1), F.lit(False))
    limit = F.when(~F.col("credited"), F.col("k_ns")).when(single, F.col("k_s1")).otherwise(F.col("k_sm"))
    return _table_rule("HEIGHT_AREA.TABLE_506_AREA", (*_GTS, "building_area_sf"), limit, b("building_area_sf"), ("H-506", "V-506"), "Table 506.2",
                       ("building_area_sf", "construction_type", "occupancy_group"), "BUILDING AREA", "floor area")


@rule("FIRE.TABLE_601")
def _():
    r = "FIRE.TABLE_601"
    bad = F.coalesce("t_unrated", F.lit(False)) & ~F.col("k_unrated")
    return one((b("construction_type").isNull(), abstained(r, ABSENT, missing("construction_type"))),
               (F.col("k_rated").isNull(), abstained(r, NO_ROW.format("Table 601"), F.col("ctype"))),
               found(r, ("H-601", "V-601"), bad, "HIGH", "Fire protection", where("construction_type"), "CONSTRUCTION TYPE",
                     ("described as non-rated, but ratings are required", "ratings are consistent with the set"), "Table 601", basis("construction_type")))


@rule("STRUCT.WIND_STANDARD")
def _():
    r, cur = "STRUCT.WIND_STANDARD", F.col("cur")
    gone = missing("code_edition", "wind_speed_mph")
    newer = cur["effective"] > F.col("ed_from")
    bad = F.coalesce(newer & (cur["wind"] != F.col("ed_wind")), F.lit(False))
    return one((gone != "", abstained(r, ABSENT, gone)),
               (F.col("ed_wind").isNull(), abstained(r, "no ASCE 7 edition is recorded for this code edition", F.col("edition"))),
               (F.coalesce(newer, F.lit(False)) & cur["wind"].isNull(), abstained(r, "the edition in force has no ASCE 7 adoption recorded", cur["key"])),
               found(r, ("H-WIND", "V-WIND"), bad, "HIGH", "Structural", where("wind_speed_mph", "code_edition"), "WIND SPEED",
                     ("wind design is to a replaced standard", "wind design basis is current"), "1609", basis("code_edition", "wind_speed_mph")))


@rule("CODE.EDITION_CURRENT")
def _():
    r, cur = "CODE.EDITION_CURRENT", F.col("cur")
    return one((b("code_edition").isNull(), abstained(r, ABSENT, missing("code_edition"))),
               (F.col("ed_from").isNull(), abstained(r, "this build carries no effective date for that edition", F.col("edition"))),
               found(r, ("C-ED", "V-ED"), F.coalesce(cur["effective"] > F.col("ed_from"), F.lit(False)), "CRITICAL", "Administration", where("code_edition"),
                     "BUILDING CODE", ("designed to a superseded edition", "the cited edition is in force"), "adoption schedule", basis("code_edition")))


@rule("DOC.SHEET_NUMBERS")
def _():
    r = "DOC.SHEET_NUMBERS"
    share = F.col("n_unread") / F.col("n_sheets")
    counted = F.concat(F.col("n_unread").cast("string"), F.lit(" of "), F.col("n_sheets").cast("string"))
    why = F.when(F.col("n_unread") == 0, "every sheet's number was read from its title block").otherwise(
        "sheets could not be identified; inside the reporting floor")
    return one((F.coalesce("n_sheets", F.lit(0)) == 0, abstained(r, "the set has no sheets to identify")),
               (share <= V.SHEET_NUMBER_FLOOR, abstained(r, why, counted)),
               found(r, "H-SN", F.lit(True), "HIGH", "Administration", (F.lit(0), F.col("first_sheet")), "", "sheet numbers were not recognised", "coverage"))


@rule("MEASURE.EGRESS_EXTENT")
def _():
    r, d = "MEASURE.EGRESS_EXTENT", F.col("c_1017_2")
    run = F.col("g_run_pt") / F.col("g_scale")
    over = F.coalesce(run > F.nullif(d["required"], F.lit(0.0)), F.lit(False))
    good = outcome(r, fid="MEAS-1", status=F.when(over, "OPEN").otherwise("PASS"), severity=F.when(over, "CRITICAL").otherwise("MEASURED"), discipline=EG,
                   page=F.col("g_page"), sheet=F.col("g_sheet"), anchor="TRAVEL DISTANCE", code="Table 1017.2", basis="drawings",
                   title=F.concat(F.lit("longest egress run measured "), F.format_number(run, 1), F.lit(" ft")))
    return one((~F.coalesce("include_measured", F.lit(True)), abstained(r, "geometric measurement was switched off in the review options")),
               (F.col("g_page").isNull(), abstained(r, "no CAD layer matching 'egress path'")),
               (F.coalesce("g_segments", F.lit(0)) == 0, abstained(r, "egress layer present but carries no line geometry")),
               (F.col("g_scale").isNull(), abstained(r, "scale unresolved", F.col("g_why"))), good)


# ---- rules that report per row ---------------------------------------------------------------------

#: question -> (rule, finding when it conflicts, finding when it agrees, discipline); fixed values
DECLARED_RULES = {
    "occupancy_group": ("DECL.OCCUPANCY", "X-OCC", "V-OCC", "Occupancy"), "mixed_occupancy": ("DECL.MIXED_OCCUPANCY", "X-MIX", "V-MIX", "Occupancy"),
    "construction_type": ("DECL.CONSTRUCTION_TYPE", "X-CON", "V-CON", "Construction"), "height_ft": ("DECL.HEIGHT", "X-HGT", "V-HGT", "Height and area"),
    "stories": ("DECL.STORIES", "X-STY", "V-STY", "Height and area"), "sprinkler_system": ("DECL.SPRINKLER", "X-SPR", "V-SPR", "Fire protection"),
    "wind_speed_mph": ("DECL.WIND_SPEED", "X-WND", "V-WND", "Structural"), "exposure_category": ("DECL.EXPOSURE", "X-EXP", "V-EXP", "Structural"),
    "risk_category": ("DECL.RISK_CATEGORY", "X-RSK", "V-RSK", "Structural / Occupancy"), "code_edition": ("DECL.CODE_EDITION", "X-EDN", "V-EDN", "Administration"),
    "building_area_sf": ("DECL.BUILDING_AREA", "X-ARE", "V-ARE", "Height and area"), "total_area_sf": ("DECL.BUILDING_AREA", "X-ART", "V-ART", "Height and area"),
}
THRESHOLD_FIELDS = ["occupancy_group", "construction_type", "sprinkler_system", "risk_category", "code_edition", "mixed_occupancy", "separation_method"]


def decl_severity() -> Column:
    """By consequence: a moved threshold is HIGH, a near miss LOW, a changed number MEDIUM."""
    gap = F.abs(F.col("declared_num") - F.col("drawn_num"))
    limit = F.greatest("tol_abs", F.col("tol_rel") * F.greatest(F.abs(F.col("declared_num")), F.abs(F.col("drawn_num"))))
    return (F.when(F.col("field").isin(THRESHOLD_FIELDS), "HIGH").when(F.col("tol_abs").isNotNull() & (gap <= 2 * limit), "LOW").otherwise("MEDIUM"))


@frame_rule(*sorted({v[0] for v in DECLARED_RULES.values()}))
def declared_rules(i: Inputs, case: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """Declared against drawn: one generic job over the question rows of every reading, or of the questions ``asked``."""
    asked = list(DECLARED_RULES) if asked is None else asked
    pick = lambda n: F.coalesce(*[F.when(F.col("field") == k, F.lit(v[n])) for k, v in DECLARED_RULES.items()])
    q = i.scenario_rows.where(F.col("field").isin(asked))
    area = F.col("field").isin("building_area_sf", "total_area_sf")
    decided = F.col("state").isin("CORROBORATED", "CONFLICT")
    # of the two area questions the first decided one speaks, else the first
    w = W.partitionBy(*CASE).orderBy(F.when(decided, 0).otherwise(1), "ord")
    silent = F.max((F.col("state") != "UNKNOWN").cast("int")).over(W.partitionBy(*CASE)) == 0
    areas = q.where(area).withColumn("_n", F.row_number().over(w)).withColumn("_silent", silent).where("_n = 1").drop("_n")
    rest = q.where(~area).withColumn("_silent", F.lit(False))
    both = [df for df, fields in ((areas, {"building_area_sf", "total_area_sf"} & set(asked)), (rest, set(asked) - {"building_area_sf", "total_area_sf"})) if fields]
    q = reduce(lambda a, x: a.unionByName(x), both)
    # what a set adds is the same in both its readings
    if i.sheets is None and i.area_tally is None:
        q = q.where("set_id is not null").select("*", F.lit(None).cast(case.schema["tally"].dataType).alias("tally"), F.lit(None).cast("string").alias("first_sheet"))
    else:
        q = q.join(case.where("scenario = 'as_drawn'").select("set_id", "tally", "first_sheet"), "set_id")
    page = F.coalesce("drawn_page", F.lit(0))
    sheet = F.coalesce(F.col("source") if "source" in q.columns else F.lit(None), "first_sheet")
    conflict = F.col("state") == "CONFLICT"
    said = outcome("", fid=F.when(conflict, pick(1)).otherwise(pick(2)), status=F.when(conflict, "CONFLICT").otherwise("PASS"),
                   severity=F.when(conflict, decl_severity()).otherwise("VERIFIED"), discipline=pick(3), page=page, sheet=sheet, anchor=F.upper("label"),
                   title=F.concat(F.col("label"), F.when(conflict, ": declared and drawn differ").otherwise(" agrees with the drawings")), code="declaration", basis="both")
    t = F.col("tally")
    added = outcome("", fid="D-ARE", status="OPEN", severity="MEDIUM", discipline="Height and area", page=t["page"],
                    sheet=F.concat(F.lit("p"), (t["page"] + 1).cast("string")), anchor=t["heading"], title="building area is not stated; its area table adds up to a total",
                    code="coverage", basis="drawings")
    why = (F.when(F.col("state") == "DECLARED_ONLY", "answered, but there is nothing to compare: the drawings do not state it")
           .when(F.col("state") == "DRAWN_ONLY", "stated, but there is nothing to compare: the declaration left it blank")
           .otherwise("neither the drawings nor the declaration state this"))
    out = F.when(decided, said).when(area & F.col("_silent") & t.isNotNull(), added).otherwise(abstained("", why, F.col("label")))
    return q.withColumn("rule_id", pick(0)).select(*CASE, "rule_id", out.alias("o")).select(*CASE, "rule_id", *[f"o.{c}" for c in COLUMNS if c != "rule_id"])


def _rows(df: DataFrame, o: Column) -> DataFrame:
    return df.select(*CASE, o.alias("o")).select(*CASE, "o.*")


@frame_rule("DOORS.CLEAR_WIDTH")
def door_rules(i: Inputs, case: DataFrame) -> DataFrame:
    """Each new door's clear width: a finding per failing door, one roll-up of those that pass."""
    r = "DOORS.CLEAR_WIDTH"
    every = case.select(*CASE)
    if i.doors is None:
        return _rows(every, abstained(r, "no door schedule extracted"))
    clear = F.col("width_in") - F.coalesce(F.nullif("thickness_in", F.lit(0.0)), F.lit(K.LEAF_THICKNESS_IN)) - K.DOOR_STOP_IN
    d = i.doors.withColumn("bad", clear < K.DOOR_CLEAR_IN).withColumn("new", ~F.col("is_existing") & F.col("width_in").isNotNull())
    sheet = F.concat(F.lit("p"), (F.col("page") + 1).cast("string"))
    folding = F.upper("remarks").contains("BI-FOLD") | (F.upper(F.trim("style")) == "B")
    bad = every.join(d.where("new and bad"), "set_id")
    per = outcome(r, fid=F.when(folding, "M-03b").otherwise("H-03"), status="OPEN", severity=F.when(folding, "MEDIUM").otherwise("HIGH"),
                  discipline="Means of egress / Accessibility", page=F.col("page"), sheet=sheet, anchor="DOOR AND FRAME SCHEDULE",
                  title=F.concat(F.lit("door "), "number", F.lit(" is under the clear width")), code="1010.1.1", basis="drawings", detail="")
    n = d.groupBy("set_id").agg(F.count_if(F.col("new") & ~F.col("bad")).alias("ok"), F.count_if(~F.col("is_existing")).alias("n"), F.min("page").alias("page"))
    j = every.join(n, "set_id", "left")
    roll = outcome(r, fid="V-DW", status="PASS", severity="VERIFIED", discipline=EG, page=F.col("page"), sheet=sheet, anchor="DOOR AND FRAME SCHEDULE",
                   title=F.concat(F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" new doors meet the clear opening")), code="1010.1.1", basis="drawings")
    some = d.where("new and bad").select("set_id").distinct().withColumn("_b", F.lit(True))
    j = j.join(some, "set_id", "left")
    none = F.when(F.col("n").isNull(), abstained(r, "no door schedule extracted")).when(F.col("ok") > 0, roll).when(
        F.col("_b").isNull(), abstained(r, "new door widths not extracted"))
    return _rows(bad, per).unionByName(_rows(j.withColumn("_o", none).where("_o is not null"), F.col("_o")))


def suffix(n: Column) -> Column:
    """What tells the n-th finding of one kind from the first: nothing, b to z, then -27, -28, ..."""
    return F.when(n == 1, "").when(n <= 26, F.char(n + 96)).otherwise(F.concat(F.lit("-"), n.cast("string")))


@frame_rule("XSHEET.STATED_CONFLICT")
def conflict_rules(i: Inputs, case: DataFrame) -> DataFrame:
    """The same fact stated differently: a finding per fact with rivals, a roll-up when none."""
    r = "XSHEET.STATED_CONFLICT"
    every = case.select(*CASE)
    if i.resolved is None:
        return _rows(every, abstained(r, "stated values not extracted"))
    folded = (F.col("field") == "egress.common_path") & (F.col("role") == "required")
    f = i.resolved.withColumn("_c", (F.col("n_rivals") > 0) & ~folded).withColumn("_s", (F.col("n_stating") > 1) & (F.col("n_rivals") == 0))
    # a set's facts are at most the catalog's fields and roles; its readings meet them in one join
    clash = F.array_sort(F.collect_list(F.when(F.col("_c"), F.struct("field", "role", "lead"))))
    agg = f.groupBy("set_id").agg(clash.alias("clash"), F.count_if("_s").alias("s"), F.min_by("lead", F.when(F.col("_s"), F.struct("field", "role"))).alias("lead"))
    j = every.join(agg, "set_id", "left").fillna(0, ["s"])
    per = lambda x, n: outcome(r, fid=F.concat(F.lit("M-XS"), suffix(n + 1)), status="OPEN", severity="MEDIUM", discipline="General", page=x["lead"]["page"], sheet=x["lead"]["sheet"],
                               anchor=F.coalesce(F.nullif(x["lead"]["label"], F.lit("")), x["lead"]["raw"]), title=F.concat(x["field"], F.lit(" is stated differently")),
                               code="107.2.1", basis="drawings")
    ok = outcome(r, fid="V-XS", status="PASS", severity="VERIFIED", discipline="General", page=F.col("lead.page"), sheet=F.col("lead.sheet"), anchor=F.col("lead.label"),
                 title=F.concat(F.col("s").cast("string"), F.lit(" values stated on more than one sheet agree")), code="107.2.1", basis="drawings")
    none = F.when(F.col("s") > 0, ok).otherwise(abstained(r, "no value is stated on more than one sheet, so there is nothing to compare"))
    return j.select(*CASE, F.inline(F.when(F.size("clash") > 0, F.transform("clash", per)).otherwise(F.array(none))))


def use_named(c: Column) -> Column:
    """The table function a text names, most specific first."""
    return F.coalesce(*[F.when(F.upper(c).rlike(p), F.lit(fn)) for p, fn in K.USE_WORDS])


@frame_rule("OCC.CLASSIFICATION_CONSISTENCY")
def space_rules(i: Inputs, case: DataFrame) -> DataFrame:
    """Each tabulated occupant-load factor against the function the set's own words name."""
    r = "OCC.CLASSIFICATION_CONSISTENCY"
    every = case.select(*CASE)
    if i.spaces is None:
        return _rows(every, abstained(r, "occupant-load table not extracted"))
    sp = i.spaces.where("code <> 'FFPC'").withColumn("room", F.upper(F.trim(F.regexp_replace("space", r"\s+", " "))))
    # headings over the same room in any table, each naming the row's own use word
    word = F.upper(F.element_at(F.split(F.trim("use"), r"\s+"), 1))
    sp = T.staged(sp, direct=use_named(F.col("use")), word=F.nullif(word, F.lit("")))
    ctx = i.spaces.withColumn("room", F.upper(F.trim(F.regexp_replace("space", r"\s+", " ")))).select(
        "set_id", "room", F.col("page").alias("cpage"), F.col("ord").alias("cord"), F.posexplode("context").alias("cpos", "line"))
    ctx = T.staged(ctx, named=use_named(F.col("line"))).where("named is not null")
    near = (sp.where("direct is null and word is not null").join(ctx, ["set_id", "room"]).where(F.contains(F.upper("line"), F.col("word")))
            .groupBy("set_id", "page", "ord").agg(F.min_by("named", F.struct((~((F.col("cpage") == F.col("page")) & (F.col("cord") == F.col("ord")))).alias("a"), "cpage", "cord", "cpos")).alias("ctx_fn")))
    sp = sp.join(near, ["set_id", "page", "ord"], "left").withColumn("fn", F.coalesce("direct", "ctx_fn"))
    uses = F.broadcast(sp.sparkSession.createDataFrame(K.LOAD_USES, "fn string, want double, want_basis string"))
    sp = sp.join(uses, "fn", "left")
    zero = (F.col("code") == "FBC") & (F.col("factor") == 0)
    live = F.coalesce("factor", F.lit(0.0)) != 0
    same = (F.abs(F.col("factor") - F.col("want")) < 0.01) & ((F.col("basis") == "") | (F.col("basis") == F.col("want_basis")))
    sp = sp.withColumn("kind", F.when(zero, "zero").when(live & F.col("want").isNotNull(), F.when(same, "match").otherwise("wrong")).when(live, "unnamed").otherwise("none"))
    n = F.row_number().over(W.partitionBy("set_id", "kind").orderBy("page", "ord"))  # a set's few failing spaces
    bad = every.join(sp.where("kind in ('zero', 'wrong')").withColumn("n", n), "set_id")
    letter = suffix(F.col("n"))
    z = F.col("kind") == "zero"
    sheet = F.concat(F.lit("p"), (F.col("page") + 1).cast("string"))
    per = outcome(r, fid=F.concat(F.when(z, "L-01").otherwise("H-01"), letter), status="OPEN", severity=F.when(z, "LOW").otherwise("HIGH"), discipline="Occupancy",
                  page=F.col("page"), sheet=sheet, anchor=F.col("space"), title=F.when(z, "a factor of 0 is not a table function").otherwise(
                      "occupant load factor is not the one for the named function"), code="Table 1004.5", basis="drawings")
    agg = sp.groupBy("set_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("zero", "match", "wrong", "unnamed")], F.count(F.lit(1)).alias("n"),
                                   F.min_by(F.struct("page", "space"), F.when(F.col("kind") == "match", F.struct("page", "ord"))).alias("first"))
    j = every.join(agg, "set_id", "left").fillna(0, ["zero", "match", "wrong", "unnamed", "n"])
    ok = outcome(r, fid="V-OLF", status="PASS", severity="VERIFIED", discipline="Occupancy", page=F.col("first.page"), sheet=F.concat(F.lit("p"), (F.col("first.page") + 1).cast("string")),
                 anchor=F.col("first.space"), title="occupant load factors match the named functions", code="Table 1004.5", basis="drawings")
    none = (F.when(F.col("n") == 0, abstained(r, "occupant-load table not extracted")).when(F.col("match") > 0, ok)
            .when((F.col("zero") + F.col("wrong")) > 0, None)
            .when(F.col("unnamed") > 0, abstained(r, "the set does not name a Table 1004.5 function for its tabulated spaces"))
            .otherwise(abstained(r, "occupant load factors not extracted")))
    return _rows(bad, per).unionByName(_rows(j.withColumn("_o", none).where("_o is not null"), F.col("_o")))


# ---- the engine --------------------------------------------------------------------------------------

def registered() -> list[str]:
    return sorted([*SCALAR, *FRAMES])


def run_scalar(case: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All scalar rules in one projection over the wide frame."""
    wanted = [SCALAR[r]() for r in sorted(SCALAR) if only is None or r in only]
    # one expression per rule keeps each small enough to compile; inline turns them into rows
    return case.select(*CASE, F.inline(F.flatten(F.array(*wanted))))


def run_rules(i: Inputs, spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """Outcomes of every rule for every reading: findings have a ``fid``, abstentions a ``reason``."""
    if only is None:  # both are read by the scalar pass and by every frame rule: work them out once
        i = replace(i, scenario_rows=kept(i.scenario_rows))
    case = build_case(i, spark, only)
    if only is None:
        case = kept(case)
    parts = []
    if only is None or any(r in SCALAR for r in only):
        parts.append(run_scalar(case, only))
    for fn in dict.fromkeys(fn for r, fn in FRAMES.items() if only is None or r in only):
        asked = [f for f, v in DECLARED_RULES.items() if only is None or v[0] in only]
        out = fn(i, case, asked) if fn is declared_rules else fn(i, case)
        parts.append(out if only is None else out.where(F.col("rule_id").isin(only)))
    cols = [*CASE, *COLUMNS]
    return reduce(lambda a, x: a.unionByName(x), [p.select(*cols) for p in parts])


def findings(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("fid is not null").drop("reason", "detail")


def abstentions(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("fid is null").select(*CASE, "rule_id", "reason", "page", "detail")
