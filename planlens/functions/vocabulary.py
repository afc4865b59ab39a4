"""Word lists, patterns and limits a result depends on.

They are facts about how drawing sets are written, not logic. Each must keep its value for
results to match.
"""

import re

# ---- patterns ---------------------------------------------------------------------------
CITED_IN_BRACKETS = r"\(\s*\d{3,4}(?:\.\d+)*\s*\)"
CITED_SECTION = r"\(\s*(\d{3,4}(?:\.\d+)*)\s*\)|\b(?:SECTION|TABLE)\s+(\d{3,4}(?:\.\d+)*)"
NUMERIC_TOKEN = "^[±+\\-]?\\d[\\d,]*(?:\\.\\d+)?(?:[\"'”’]|%)?$"
DIMENSION_TOKEN = "^\\d+\\s*'\\s*-?\\s*\\d*(?:\\s+\\d+/\\d+)?\\s*\"?$|^\\d+/\\d+\"?$|^\\d+'-\\d+\"?$"
GROUP_TOKEN = r"(?i)^(?:GROUP\s+)?[ABEFHIMRSU](?:\s*-\s*\d)?$|^\([ABEFHIMRSU]-?\d?\)$"
TYPE_TEXT = r"(?i)^(?:TYPE\s+)?(?:I{1,3}|IV|V)\s*-?\s*[AB]?(?:\s*\(.*\))?$"
INLINE_SPLIT = r"^(.*?[A-Za-z)\]])\s*([:?])(?:\s+|$)(.*)$"
FEET_INCHES = "(\\d+(?:\\.\\d+)?)\\s*'\\s*[-–]?\\s*(\\d+(?:\\.\\d+)?)?\\s*(?:\"|''|”)?"
FEET_DASH_INCHES = "(\\d+)\\s*'\\s*-\\s*(\\d+(?:\\s+\\d+/\\d+)?)\\s*\""
LINEAR_FEET = r"(?i)(\d[\d,]*\.?\d*)\s*(LF|FEET|FT)\b"
INCHES = "(?:(\\d+)\\s+)?(?:(\\d+)\\s*/\\s*(\\d+)|(\\d+(?:\\.\\d+)?))\\s*\""
PLAIN_NUMBER = r"^\s*(\d[\d,]*\.?\d*)\s*$"
SCALE_LABEL = "(\\d+)?\\s*(?:(\\d+)\\s*/\\s*(\\d+))?\\s*\"\\s*=\\s*1\\s*'\\s*-\\s*0\\s*\""
SHEET_NUMBER = r"^([A-Z]{1,3})[-.]?(\d{1,3}(?:\.\d{1,2})?[A-Z]?)$"
DATE_LIKE = r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\s*$"
AREA_HEADING = (
    r"(?i)^\s*(OCCUPAN(?:CY|T)\s+(?:LOAD\s+)?CALCULATIONS?|AREA\s+CALCULATIONS?|AREA\s+TABULATIONS?"
    r"|AREA\s+(?:SUMMARY|SCHEDULE|BREAKDOWN|ANALYSIS)|ROOM\s+(?:AREA|SCHEDULE)S?"
    r"|SQUARE\s+FOOTAGE(?:\s+(?:SUMMARY|SCHEDULE|BREAKDOWN))?|GROSS\s+(?:FLOOR\s+)?AREAS?"
    r"|TENANT\s+AREAS?)\s*[:\-]?\s*$")
AREA_ROW = (
    r"(?i)^\s*(.*?[A-Za-z][^\d]*?)\s+(\d[\d,]*(?:\.\d+)?)\s*"
    r"(?:SQ\.?\s*FT\.?|SQ\.?\s*F\.?|S\.\s*F\.|SQFT|SF)\.?\s*$")
TOTAL_LABEL = r"(?i)^\s*(?:SUB[\s\-]?)?TOTALS?\b"
BANNER = (
    r"(?i)\b(?:TABLES?|SECTIONS?)\s+((?:\d{3,4}(?:\.\d+)*)"
    r"(?:\s*(?:,|&|AND)\s*\d{3,4}(?:\.\d+)*)*)")
LEADING_JUNK = r"^[\|\[\]\{\}<>_\-—–\.,;:\s]+"
TRAILING_JUNK = r"[\|\[\]\{\}<>_\s]+$"
EXIT_HEADING = r"^(EXIT(?:\s+DISCHARGE)?\s*(?:#|NO\.?)?\s*\d+[A-Z]?)\b"
OCCUPANCY_FACTOR = r"(?i)^(\d[\d,]*\.?\d*)\s*(?:SF)?\s*\(?\s*(NET|GROSS)?\s*\)?"
CEILING_REFERENCE = (
    r"^(?:A\.?\s?F\.?\s?F\.?|CLG\.?|CEILING|"
    r"(?:B\.?\s?O\.?|B/O|BOTTOM\s+OF)\s+(?:BAR\s+|STEEL\s+)?(?:JOISTS?|STRUCTURE|DECK))$")
CEILING_HEIGHT = "^\\+?\\s*\\d{1,2}\\s*'\\s*-?\\s*\\d{1,2}(?:\\s+\\d/\\d)?\\s*\"?$"
CEILING_ONE_LINE = "^(\\+\\s*\\d{1,2}\\s*'\\s*-?\\s*\\d{1,2}\\s*\"?)\\s+(A\\.?\\s?F\\.?\\s?F\\.?)$"
PLUMBING_HEADING = (
    r"^PLUMBING\s+(?:FIXTURE\s+)?(?:COUNTS?|CALCULATIONS?|FIXTURES|FIXTURE\s+COUNT|REQUIREMENTS)\b")
FIXTURE_RATIO = (
    r"^(WC|W\.C\.|WATER\s+CLOSETS?|LAVS?|LAVATOR(?:Y|IES)|DF|D\.F\.|DRINKING\s+FOUNTAINS?)\s*:\s*(.+)$")
FIXTURE_COUNT = (
    r"^(\d+)\s+(UNISEX\s+)?(WC|W\.C\.|WATER\s+CLOSETS?|LAVS?|LAVATOR(?:Y|IES)|DF|D\.F\.|"
    r"DRINKING\s+FOUNTAINS?|SERVICE\s+SINKS?|MOP\s+SINKS?|URINALS?)\b")
SERVICE_SINK = r"^SERVICE\s+SINKS?\s*:\s*(\d+)\b"
FIXTURE_LOAD = r"\b(?:OCCUPANCY|OCCUPANT\s+LOAD|OCCUPANTS)\s*:\s*(\d[\d,]*)\b"
HEADER_DATA = "^(\\d+\\s*'|\\d+(\\.\\d+)?\\s*\"|\\d+[A-Z]?$|EXISTING$|[A-Z]$|\\d+\\s+\\d+/\\d+)"
LOAD_POSTING = (
    r"(?i)OCCUPANT\s+LOAD\s+(?:SIGN|PLACARD|POSTING)|"
    r"(?:MAX(?:IMUM)?\.?\s+)?OCCUPAN(?:CY|T\s+LOAD)\s+(?:SIGN|PLACARD)|"
    r"POST(?:ED)?\s+(?:THE\s+)?(?:MAX(?:IMUM)?\.?\s+)?OCCUPAN(?:CY|T\s+LOAD)|"
    r"OCCUPAN(?:CY|T\s+LOAD)\s+(?:SHALL\s+BE\s+)?POSTED|\b1004\.9\b")
STATED_LOAD = r"(?i)\bOCCUPANT\s+LOAD\s*[:=]\s*([\d,]+)"
NAMES_THE_CODE = r"\bFLORIDA\s+BUILDING\s+CODE\b|\bFBC\b|\bF\.B\.C\."
AREA_LAYER = r"(?i)(^|[^A-Z])(AREA|ROOM|ROOMS|SPACE|SPACES|GROSS|OCCP)([^A-Z]|$)"

# ---- word lists -------------------------------------------------------------------------
UNITS = ["SF", "S.F.", "SQ", "SQ.", "FT", "FT.", "FEET", "LF", "IN", "IN.", "MPH", "CFM", "PSF",
         "KVA", "A", "AMPS", "V", "%", "GSF", "NSF", "OCC", "PERSONS", "PEOPLE", "DOOR(S)", "DOORS",
         "EXITS", "(DOORS)", "(GROSS)", "(NET)", "(ENCLOSED)", "HR", "HOUR", "HOURS", "STORY",
         "STORIES"]
VALUE_WORDS = ["YES", "NO", "NONE", "N/A", "NA", "N.A.", "----", "---", "--", "-", "SPRINKLERED",
               "NON-SPRINKLERED", "UNSPRINKLERED", "FULLY", "PARTIAL", "PARTIALLY", "ASSEMBLY",
               "BUSINESS", "MERCANTILE", "EDUCATIONAL", "FACTORY", "INDUSTRIAL", "STORAGE",
               "RESIDENTIAL", "INSTITUTIONAL", "UTILITY", "HAZARDOUS", "ENCLOSED",
               "PARTIALLY ENCLOSED", "OPEN", "I", "II", "III", "IV", "V", "B", "C", "D", "SEPARATED",
               "NON-SEPARATED", "NONSEPARATED", "ACCESSORY", "OFFICE", "RETAIL", "EXERCISE",
               "CLASSROOM", "KITCHEN", "WAREHOUSE", "CIRCULATION"]
# value tokens (see text.value_token) one after the other, each followed by a space, upper-cased
VALUE_RUN = ("\\A(?:[,;]*(?:[±+\\-]?\\d[\\d,]*(?:\\.\\d+)?(?:[\"'”’]|%)?|\\d+'-?\\d*\"?|\\d+/\\d+\"?|[ABEFHIMRSU](?:-\\d)?|\\([ABEFHIMRSU]-?\\d?\\)|"
             + "|".join(re.escape(w) for w in UNITS + VALUE_WORDS if " " not in w) + ")[,;]* )++")
TRUE_WORDS = ["YES", "Y", "TRUE", "T", "1", "PROVIDED", "REQUIRED"]
FALSE_WORDS = ["NO", "N", "FALSE", "F", "0", "NONE", "NOT REQUIRED", "N/A", "NA"]
OCCUPANCY_WORDS = {"BUSINESS": "B", "OFFICE": "B", "PROFESSIONAL": "B", "MERCANTILE": "M",
                   "RETAIL": "M", "ASSEMBLY": "A", "EDUCATIONAL": "E", "FACTORY": "F",
                   "INDUSTRIAL": "F", "STORAGE": "S", "WAREHOUSE": "S", "RESIDENTIAL": "R",
                   "INSTITUTIONAL": "I", "UTILITY": "U", "HAZARDOUS": "H"}
EDITION_ORDINALS = {"6TH": "fbc2017", "SIXTH": "fbc2017", "7TH": "fbc2020", "SEVENTH": "fbc2020",
                    "8TH": "fbc2023", "EIGHTH": "fbc2023", "9TH": "fbc2026", "NINTH": "fbc2026"}
EDITION_YEARS = {"2017": "fbc2017", "2020": "fbc2020", "2023": "fbc2023", "2026": "fbc2026"}
SPRINKLER_PRESENT = ["NFPA13", "NFPA13R", "NFPA13D", "YES"]
SPRINKLER_CREDITED = ["NFPA13", "NFPA13R", "YES"]
DISCIPLINES = ["G", "GN", "T", "C", "L", "A", "AA", "AG", "AD", "AR", "S", "M", "E", "P", "FP", "FA", "LS", "ID", "K", "EL", "SP"]
REQUIRED_HEADS = ["REQUIRED", "REQ", "MIN", "MAX", "MINIMUM", "MAXIMUM", "ALLOWABLE", "ALLOWED",
                  "LIMIT"]
PROVIDED_HEADS = ["PROVIDED", "ACTUAL", "PROPOSED", "DESIGN", "MEASURED"]
LIMIT_WORDS = ["MAX", "MAXIMUM", "MIN", "MINIMUM", "ALLOWABLE", "REQUIRED", "LIMIT"]
PROVIDED_WORDS = ["PROVIDED", "ACTUAL", "PROPOSED", "DESIGN"]
TOTAL_WORDS = ["TOTAL", "TOTALS", "GRAND TOTAL"]
AREA_HEADERS = ["AREA", "AREA SF", "SQ FT", "SF", "NET AREA", "GROSS AREA"]
LOAD_HEADERS = ["OCCUPANT LOAD", "OCCUPANTS", "LOAD", "NO OF OCCUPANTS"]
LABEL_STOP_WORDS = ["OF", "THE", "AND", "PER", "NO", "TOTAL", "MAX", "MIN", "MAXIMUM", "MINIMUM",
                    "NUMBER", "A", "AN", "TO", "FOR", "IN", "ON", "REQUIRED", "PROVIDED"]
SCHEDULES = [
    ("DOOR AND FRAME SCHEDULE", ["DOOR AND FRAME SCHEDULE", "DOOR SCHEDULE"]),
    ("ROOF TOP UNIT SCHEDULE", ["ROOF TOP UNIT SCHEDULE", "ROOF TOP UNIT", "RTU SCHEDULE"]),
    ("AIR BALANCE", ["AIR BALANCE"]),
    ("OCCUPANT DENSITY", ["OCCUPANT DENSITY"]),
    ("ELECTRICAL LOAD CALCULATIONS",
     ["ELECTRICAL LOAD CALCULATIONS", "LOAD CALCULATIONS", "LOAD CALCULATION"]),
    ("PANEL SCHEDULE", ["PANEL SCHEDULE"]),
    ("OCCUPANT LOAD", ["OCCUPANT LOAD"]),
]

# ---- severities, statuses, states -------------------------------------------------------
RAMP = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
RULE_ORDER = RAMP + ["VERIFIED", "MEASURED"]
CALIBRATED_ORDER = RAMP + ["MEASURED", "VERIFIED"]
ACTIONABLE = ["OPEN", "CONFLICT"]
PASSING = ["VERIFIED", "MEASURED"]

# ---- limits -----------------------------------------------------------------------------
RIVAL_SCORE = 0.9
READING_SCORE = 0.85
OCR_MIN_CONFIDENCE = 40.0
MIN_VECTOR_ITEMS, MIN_LIVE_CHARS, IMAGE_COVER_RASTER = 120, 120, 0.55
MIN_REGION_COVER, MIN_REGION_MEGAPIXELS = 0.04, 0.4
SEAM_PT, SEAM_SHARE = 2.0, 0.8
MIN_SHEET_CHARS, MIN_SHEET_PATHS = 200, 50
SHEET_NUMBER_FLOOR = 0.20
GRID_CELL = 64.0
JOIN_EMS, SAME_LINE, ROW_REACH = 0.6, 0.5, 0.10
STACK_EMS, ALIGN_EMS, CONT_EMS, CONTEXT_EMS, TITLE_RATIO = 2.6, 1.5, 0.8, 7.0, 1.4
MERGE_SIZE_RATIO = 1.3
STRIP_GAP_EMS, STRIP_MIN_WORDS = 1.5, 2
CELL_GAP_EMS, ROW_EMS = 1.2, 0.6
SPLIT_GAP_RATIO = 1.8
AREA_MIN_SF, AREA_MAX_SF, AREA_SCAN, AREA_GAP, AREA_TOTAL_TOL = 5.0, 2_000_000.0, 60, 3, 0.02
TABLE_MAX_SHARE = 0.30
EGRESS_LAYER = "egress path"
VIEW_CELL, VIEW_GAP, VIEW_MIN_CELLS, VIEW_BORDER_SHARE = 12.0, 24.0, 12, 0.55
LABEL_REACH, LABEL_MARGIN = 96.0, 12.0
COLLINEAR_PT, RUN_JOIN_PT = 0.6, 2.0
POINTS_PER_INCH = 72.0
SPAN_SHARE, SPAN_EMS = 0.15, 45.0
ANCHOR_PREFIX = 16
MAX_REREAD_PAGES = 8
MAX_SHIFT = 2
CONTESTED_AT = 3
STARVED_FLOOR = 3
CONCURRENT_JOBS, JOBS_PER_HOUR = 3, 10
STALE_MINUTES, STALE_DRAWING_MINUTES = 15, 60

# ---- text sweep: fixed values -------------------------------------------------------------
# (question, a word in capitals that every match holds, pattern without case, its groups), in order of preference.
TEXT_SWEEP = [
    ("occupancy_group", "OCCUPANCY", r"\bOCCUPANCY(?:\s+GROUP|\s+CLASSIFICATION)?\s*[:=]\s*([A-Za-z][A-Za-z\-\s]{0,24}?)\s*(?:[/,;]|\s{2,}|[\r\n]|$)", 1),
    ("occupancy_group", "OCCUPANCY", r"\bUSE\s+AND\s+OCCUPANCY\s+CLASSIFICATION\s*[:=]\s*([A-Za-z][A-Za-z\-\s]{0,24}?)\s*(?:[/,;]|\s{2,}|[\r\n]|$)", 1),
    ("occupancy_group", "GROUP", r"\bGROUP\s+([ABEFHIMRSU]\s*-?\s*\d?)\b", 1),
    ("mixed_occupancy", "MIXED", r"\bMIXED\s+OCCUPANC(?:Y|IES)\s*\??\s*[:=]?\s*(YES|NO)\b", 1),
    ("separation_method", "SEPARATED", r"\b(NON[\s\-]?SEPARATED)\b", 1),
    ("separation_method", "SEPARAT", r"\bSEPARAT(?:ED|ION)[^\r\n]{0,60}?\b(?:PER\s+)?TABLE\s+(508\.4)\b", 1),
    ("separation_method", "508.", r"\bTABLE\s+(508\.[34])\b", 1),
    ("construction_type", "CONSTRUCTION", r"\bCONSTRUCTION\s+TYPE\s*[:=]\s*([IV]{1,3}\s*-?\s*[AB]?|[1-5]\s*-?\s*[AB]?)\b", 1),
    ("construction_type", "CONSTRUCTION", r"\bTYPE\s+OF\s+CONSTRUCTION\s*[:=]\s*([IV]{1,3}\s*-?\s*[AB]?|[1-5]\s*-?\s*[AB]?)\b", 1),
    ("construction_type", "TYPE", r"\bTYPE\s+([IV]{1,3}\s*-\s*[AB])\b", 1),
    ("building_area_sf", "AREA", r"\bBUILDING\s+AREA\s*[:=]\s*([\d,]+)\s*(?:SF|S\.F\.|SQ)", 1),
    ("building_area_sf", "AREA", r"\bAREA\s+PER\s+(?:FLOOR|STOR[EY]{1,2})\s*[:=]\s*([\d,]+)", 1),
    ("building_area_sf", "FOOTAGE", r"\bSQUARE\s+FOOTAGE\s+PER\s+(?:FLOOR|STOR[EY]{1,2})[^\d]{0,24}([\d][\d,]{2,})", 1),
    ("total_area_sf", "TOTAL", r"\bTOTAL\s+(?:BUILDING\s+)?AREA\s*[:=]\s*([\d,]+)\s*(?:SF|S\.F\.|SQ)", 1),
    ("total_area_sf", "GROSS", r"\bGROSS\s+(?:BUILDING\s+)?AREA\s*[:=]\s*([\d,]+)\s*(?:SF|S\.F\.|SQ)", 1),
    ("total_area_sf", "FOOTAGE", r"\bTOTAL\s+SQUARE\s+FOOTAGE[^\d]{0,24}([\d][\d,]{2,})", 1),
    ("height_ft", "HEIGHT", r"\bBUILDING\s+HEIGHT\s*[:=]\s*(\d+\s*'\s*-?\s*\d*\s*\"?|\d+(?:\.\d+)?\s*(?:FT|FEET))", 1),
    ("height_ft", "HEIGHT", r"\bMEAN\s+ROOF\s+HEIGHT\s*[:=]\s*(\d+\s*'\s*-?\s*\d*\s*\"?|\d+(?:\.\d+)?)", 1),
    ("height_ft", "HEIGHT", r"\bHEIGHT\s+(\d+\s*'\s*-?\s*\d*\s*\"?)", 1),
    ("stories", "STOR", r"\b(?:NUMBER\s+OF\s+)?STOR(?:IES|EYS)\s*[:=]\s*(\d+)\b", 1),
    ("stories", "STOR", r"\bSTOR(?:IES|EYS)\s+(\d+)\b", 1),
    ("stories", "STOR", r"\b(\d+)\s+STOR(?:Y|IES|EY|EYS)\b", 1),
    ("sprinkler_system", "SPRINKLER", r"\bSPRINKLER[^\r\n]{0,40}?[:=]\s*(NFPA\s*13[RD]?|YES|NO|NONE)\b", 1),
    ("sprinkler_system", "NFPA", r"\b(NFPA\s*13[RD]?)\b", 1),
    ("sprinkler_system", "SPRINKLERED", r"\bFULLY\s+SPRINKLERED\b()", 1),
    ("wind_speed_mph", "MPH", r"\bV\s*(?:ULT|ULTIMATE)?\s*[:=]\s*(\d{2,3})\s*MPH", 1),
    ("wind_speed_mph", "WIND", r"\bULTIMATE\s+(?:DESIGN\s+)?WIND\s+SPEED\s*[:=]\s*(\d{2,3})", 1),
    ("wind_speed_mph", "WIND", r"\bWIND\s+SPEED\s*[:=]\s*(\d{2,3})\s*MPH", 1),
    ("exposure_category", "EXPOSURE", r"\bEXPOSURE\s*(?:CATEGORY)?\s*[:=]?\s*([B-D])\b", 1),
    ("risk_category", "RISK", r"\bRISK\s*CATEGORY\s*[:=]?\s*(I{1,3}V?|IV|[1-4])\b", 1),
    ("zoning", "ZONING", r"\bZONING\s*[:=]\s*([^\r\n]{1,40}?)(?:\s{2,}|[\r\n]|$)", 1),
    ("jurisdiction", "COUNTY", r"\b([A-Z][A-Za-z\.\s]{2,28}?\s+COUNTY,?\s+(?:FL|FLORIDA))\b", 1),
    ("jurisdiction", "JURISDICTION", r"\bJURISDICTION\s*[:=]\s*([^\r\n]{1,40}?)(?:\s{2,}|[\r\n]|$)", 1),
    ("code_edition", "EDITION", r"\bFLORIDA\s+BUILDING\s+CODE[^\r\n]{0,40}?\b(\d(?:ST|ND|RD|TH)\s+EDITION)", 1),
    ("code_edition", "EDITION", r"\b(\d(?:ST|ND|RD|TH)\s+EDITION)[^\r\n]{0,30}?\((\d{4})\)", 2),
    ("code_edition", "CODE", r"\bFLORIDA\s+BUILDING\s+CODE[,\s]+(20\d\d)\b", 1),
]
