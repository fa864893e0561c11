"""Readers and writers for the formats around the corpus."""

from __future__ import annotations

import itertools
import json
import re
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = (
    "mode string, sentence string, score_total double, score_lw double, score_cs double, score_ne double, score_length double, score_alpha double, cqp_id bigint, cpos bigint, spos bigint, seed bigint,"
    " filtered boolean, filter_reason string, matched_lemmas array<string>, tag_map map<string,string>, token_surprisals map<string,double>"
)
RECORD = (
    "source_annotated_loanwords string, source_annotated_loanwords_replaced string, target string, source_plain string, source_annotated_plain string,"
    " words_in_L_tags map<string,string>, words_in_N_tags map<string,string>, corresponding_words map<string,array<string>>"
)


_XML_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATE).json(path).where("mode is not null or sentence is not null")


def write_candidates(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_dataset(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with one object a line, as write_dataset() makes them, or with one object or a list of them over many lines; the first line that isn't blank tells which, for all of them."""
    first = spark.read.text(paths).where("trim(value) != ''").head(1)
    lines = bool(first) and first[0]["value"].strip().startswith("{") and first[0]["value"].strip().endswith("}")
    return spark.read.option("multiLine", not lines).schema(RECORD).json(paths)


def write_dataset(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def write_dataset_array(rows: DataFrame, path: str) -> None:
    """One JSON array in a file on the driver's disk, as other tools expect it; records stream through the driver one by one."""
    with Path(path).open("w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(rows.toLocalIterator()):
            f.write(",\n" if k else "\n")
            json.dump(r.asDict(recursive=True), f, ensure_ascii=False)
        f.write("\n]\n")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet as strings; xlsx goes through pandas where openpyxl is installed."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str).fillna(""))
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_sheet(rows: DataFrame, path: str, mode: str = "error") -> None:
    from lexarium.operators.annotation import known_columns

    known_columns(rows).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_xlsx(rows: DataFrame, path: str, widths: dict[str, float] | None = None, name: str = "Annotation") -> None:
    """The known columns as a workbook on the driver's disk: wrapped text, a bold first row, column widths. Rows stream through the driver one by one; a workbook holds 1,048,575 of them."""
    from lexarium.operators.annotation import known_columns

    sheet = known_columns(rows)
    cell = lambda ref, v, style: f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(_XML_BAD.sub("", "" if v is None else str(v)))}</t></is></c>'
    letters = [chr(65 + k) for k in range(len(sheet.columns))]
    cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{(widths or {}).get(c, 40)}" customWidth="1"/>' for k, c in enumerate(sheet.columns))
    main, rel, doc = ("http://schemas.openxmlformats.org/" + x for x in ("spreadsheetml/2006/main", "package/2006/relationships", "officeDocument/2006/relationships"))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    font = lambda x: f"<font>{x}<sz val='11'/><name val='Calibri'/></font>"
    style = "".join(f'<xf fontId="{k}" applyFont="1" applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf>' for k in range(2))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        + "".join(f'<Override PartName="/xl/{f}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for f, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{doc}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{doc}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2">{font("")}{font("<b/>")}</fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellXfs count="2">{style}</cellXfs></styleSheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in parts.items():
            z.writestr(part, head + text)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write((head + f'<worksheet xmlns="{main}"><cols>{cols}</cols><sheetData>').encode())
            for n, values in enumerate(itertools.chain([sheet.columns], sheet.toLocalIterator()), 1):
                if n > 1 << 20:
                    raise ValueError("too many rows for a workbook")
                f.write(f'<row r="{n}">{"".join(cell(f"{a}{n}", v, int(n == 1)) for a, v in zip(letters, values, strict=True))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


def write_pairs(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Tab-separated, without a header."""
    rows.write.mode(mode).option("sep", "\t").csv(path)


def read_words(spark: SparkSession, path: str, column: str, valid_column: str | None = None, valid_value: str = "x", strip: bool = True, skip_empty: bool = True) -> DataFrame:
    """word: a column of a CSV; empty cells go before validity is looked at."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in (column, valid_column) if c and c not in rows.columns]:
        raise ValueError(f"missing columns {missing}")
    cell = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    cell = F.trim(cell) if strip else cell
    if skip_empty:
        rows = rows.where(F.trim(cell) != "")
    if valid_column:
        rows = rows.where(F.trim(F.coalesce(F.col(f"`{valid_column}`"), F.lit(""))) == valid_value)
    return rows.select(cell.alias("word"))


def unexpected_validity(spark: SparkSession, path: str, valid_column: str, valid_value: str = "x") -> DataFrame:
    """value, n: what stands in the validity column that is neither empty nor the expected value."""
    value = F.trim(F.coalesce(F.col(f"`{valid_column}`"), F.lit("")))
    return spark.read.option("header", True).csv(path).select(value.alias("value")).where((F.col("value") != "") & (F.col("value") != valid_value)).groupBy("value").agg(F.count("*").alias("n"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("code string, canonical_name string").csv(path)


def write_index(index: DataFrame, path: str, meta: dict, mode: str = "error", sort: list[str] | None = None) -> None:
    """Parquet in order of spos (or sort) within files, with the metadata as a one-row JSON table beside it."""
    index.sortWithinPartitions(*(sort or ["spos"])).write.mode(mode).option("compression", "zstd").parquet(f"{path}/rows")
    index.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def store_index(index: DataFrame, name: str, path: str, buckets: int = 64, key: str = "spos", mode: str = "error") -> None:
    """An index as the table `name` in path, dealt into buckets by key and sorted by it inside each: stored indices of one number of buckets join on key without a shuffle, and a look-up of a key reads one bucket's matching row groups."""
    spread = index.repartition(buckets, key).sortWithinPartitions(key)
    spread.write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(name)


def stored_index(spark: SparkSession, name: str, keys: list[int] | None = None, key: str = "spos") -> DataFrame:
    """A stored index, or its rows of some keys."""
    rows = spark.table(name)
    return rows if keys is None else rows.where(F.col(key).isin(keys))


def write_splits(rows: DataFrame, path: str, sources: list[str], mode: str = "error") -> None:
    """Parquet by split, and the SHA-256 of each source file."""
    rows.write.mode(mode).partitionBy("split").parquet(f"{path}/rows")
    rows.sparkSession.read.format("binaryFile").load(sources).select("path", F.sha2("content", 256).alias("sha256")).coalesce(1).write.mode(mode).json(f"{path}/sources")


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{path}/rows")
    if "split" not in rows.columns:
        raise ValueError("no split column")
    return rows, spark.read.json(f"{path}/sources")


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.coalesce(1).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_text(text: str, path: str, replace: bool = False) -> None:
    """A framed report at the end of a local file, or instead of it."""
    frame = "=" * 60
    with Path(path).open("w" if replace else "a", encoding="utf-8") as f:
        f.write(f"{frame}\n{text}\n{frame}\n")
