"""Readers: the tables a review starts from, each with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planlens.functions import vocabulary as V
from planlens.sources.catalog import QUESTIONS

WORDS = ("set_id bigint, page int, block int, line int, seq int, x0 double, y0 double, x1 double, "
         "y1 double, text string")
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_FIELD = "struct<field:string,value:string,quote:string,role:string>"
READINGS = (f"set_id bigint, file_sha256 string, model string, prompt_version string, "
            f"sheets map<string,struct<sheet_number:string,fields:array<{_FIELD}>>>, "
            f"errors map<string,string>, usage map<string,bigint>")
_ATTR = (f"struct<type:string,page:int,kind:string,tag:string,prompt:string,text:string,layer:string,"
         f"handle:string,source:string,viewport:string,repeated:boolean,box:array<double>>")
SIDECAR = (f"set_id bigint, pages array<struct<page:int,number:string,title:string,layout:string,"
           f"text:array<struct<text:string,handles:array<string>,box:array<double>>>>>, claims array<{_ATTR}>")
_KIND = {"enum": "string", "text": "string", "bool": "boolean", "number": "double", "integer": "int"}
DECLARATIONS = "set_id bigint, " + ", ".join(f"{q['field']} {_KIND[q['kind']]}" for q in QUESTIONS)
OCR_COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width",
               "height", "conf", "text"]


def drop_blank(words: DataFrame) -> DataFrame:
    return words.withColumn("text", F.trim("text")).where("text <> ''")


def read_words(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Positioned words of every page; words with no text are dropped."""
    return drop_blank(spark.read.schema(WORDS).format(fmt).load(path))


def page_lines(pages: DataFrame) -> DataFrame:
    """(set_id, page, line_no, text) from page text."""
    return pages.select("set_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def clean_ocr_words(raw: DataFrame) -> DataFrame:
    """Recognised words worth keeping: printed text, a readable box and enough confidence."""
    n = {c: F.col(c).try_cast("double") for c in ("left", "top", "width", "height", "conf")}
    text = F.trim("text")
    keys = [c for c in ("set_id", "page") if c in raw.columns]
    return raw.select(*keys, n["left"].alias("x0"), n["top"].alias("y0"),
                      (n["left"] + n["width"]).alias("x1"), (n["top"] + n["height"]).alias("y1"),
                      text.alias("text"), n["conf"].alias("conf")).where(
        (F.col("text") != "") & F.col("x1").isNotNull() & F.col("y1").isNotNull()
        & (F.col("conf") >= V.OCR_MIN_CONFIDENCE))


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser output, tab separated with a header; set and page come from the folder names."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", schema=", ".join(
        f"{c} string" for c in OCR_COLUMNS))
    return clean_ocr_words(raw)


def proposals_of(readings: DataFrame) -> DataFrame:
    """One row per proposed value: set_id, page (0-based), field, value, quote, role."""
    sheets = readings.select("set_id", F.explode("sheets").alias("page", "sheet"))
    return sheets.select("set_id", F.col("page").try_cast("int").alias("page"),
                         F.explode("sheet.fields").alias("f")).select("set_id", "page", "f.*")


def reading_errors(readings: DataFrame) -> DataFrame:
    return readings.select("set_id", F.explode("errors").alias("page", "error")).withColumn(
        "page", F.col("page").try_cast("int"))


def parse_readings(json: DataFrame, column: str = "json") -> DataFrame:
    return json.select("set_id", F.from_json(column, READINGS.replace("set_id bigint, ", "")).alias("r")).select(
        "set_id", "r.*")


def read_readings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(proposals, page errors) of recorded readings, one JSON document per set."""
    r = spark.read.schema(READINGS).json(path, multiLine=True)
    return proposals_of(r), reading_errors(r)


def _box(c: str) -> Column:
    return F.struct(*[F.element_at(c, i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def sidecar_tables(sidecar: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, text cells, block attributes) of drawing sidecars."""
    p = sidecar.select("set_id", F.explode("pages").alias("p"))
    pages = p.select("set_id", "p.page", "p.number", "p.title", "p.layout")
    cells = (p.select("set_id", "p.page", F.explode("p.text").alias("c"))
             .select("set_id", "page", "c.text", "c.handles", _box("c.box").alias("box")))
    attrs = (sidecar.select("set_id", F.explode("claims").alias("a")).where("a.type = 'attribute'")
             .select("set_id", "a.page", "a.kind", "a.tag", "a.prompt", "a.text", "a.layer", "a.handle",
                     "a.viewport", "a.repeated", F.when(F.col("a.box").isNotNull(), _box("a.box")).alias("box")))
    return pages, cells, attrs


def read_sidecar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return sidecar_tables(spark.read.schema(SIDECAR).json(path, multiLine=True))


def parse_declarations(json: DataFrame, column: str = "json") -> DataFrame:
    schema = DECLARATIONS.replace("set_id bigint, ", "")
    return json.select("set_id", F.from_json(column, schema).alias("d")).select("set_id", "d.*")


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """Declarations; unknown keys are dropped, nulls stay unanswered."""
    return spark.read.schema(DECLARATIONS).json(path)
