"""Page text: boxes to lines, text scores, choice between embedded and rendered text, page limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the identity-text score.
IDENTITY_WORDS = (
    "FEDERAL", "REPUBLIC", "VOTER", "CODE", "VIN", "DELIM", "DATE", "BIRTH", "GENDER", "OCCUPATION", "ADDRESS",
)
IDENTITY_PATTERNS = (
    (r"\bCODE\s*:\s*\d{2}-\d{2}-\d{2}-\d{3}", 8),
    (r"\bVIN\s*:\s*[A-Z0-9 ]{10,30}", 8),
    (r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", 5),
    (r"\b(MALE|FEMALE)\b", 5),
)
#: A row takes a box within this part of its average height; heights count as LEAST_HEIGHT at least.
ROW_PART, LEAST_HEIGHT = 0.7, 10
_BOX = "struct<y:double,x:double,h:double,text:string>"


def box_geometry(box: Column) -> Column:
    """(y, x, h) of a polygon of [x, y] points; without points 0, 0 and a height of 12."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    empty = box.isNull() | (F.size(box) == 0)
    mean = F.aggregate(ys, F.lit(0.0), lambda a, b: a + b) / F.size(box)
    return F.struct(
        F.when(empty, 0.0).otherwise(mean).alias("y"),
        F.when(empty, 0.0).otherwise(F.array_min(xs)).alias("x"),
        F.when(empty, 12.0).otherwise(F.array_max(ys) - F.array_min(ys)).alias("h"),
    )


def lines_of_boxes(boxes: Column) -> Column:
    """Text of an array of (y, x, h, text): boxes by (y, x) fall into rows, rows are read from left to right.

    A box joins the row if it is as near to the row's last box as ROW_PART of the row's average height allows; the
    average changes with every box, so this is a fold and not a comparison with the row before.
    """
    row = lambda boxes: F.array_join(
        F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["text"].alias("t")))), lambda b: b["t"]), " "
    )
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("lines"), F.expr(f"cast(array() as array<{_BOX}>)").alias("row"), F.lit(0.0).alias("sum")
    )

    def step(acc: Column, b: Column) -> Column:
        n = F.size(acc["row"])
        height = F.greatest(b["h"], F.lit(float(LEAST_HEIGHT)))
        near = (n == 0) | (F.abs(b["y"] - F.element_at(acc["row"], -1)["y"]) <= acc["sum"] / n * ROW_PART)
        return F.when(
            near, F.struct(acc["lines"].alias("lines"), F.concat(acc["row"], F.array(b)).alias("row"), (acc["sum"] + height).alias("sum"))
        ).otherwise(F.struct(F.concat(acc["lines"], F.array(row(acc["row"]))).alias("lines"), F.array(b).alias("row"), height.alias("sum")))

    folded = lambda acc: F.array_join(
        F.when(F.size(acc["row"]) > 0, F.concat(acc["lines"], F.array(row(acc["row"])))).otherwise(acc["lines"]), "\n"
    )
    return F.aggregate(F.array_sort(boxes.cast(f"array<{_BOX}>")), start, step, folded)


def group_boxes(boxes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page (keys) with its text, from rows of y, x, h, text. A page's boxes fit in a row by nature."""
    found = boxes.groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "h", "text")).alias("boxes"))
    return found.select(*keys, lines_of_boxes(F.col("boxes")).alias("text"))


def readability_score(text: Column) -> Column:
    """Words, 200 at most, plus twice the lines with text, 50 at most, less 5 for each replacement character."""
    value = F.coalesce(text, F.lit(""))
    words = F.regexp_count(value, F.lit(r"[A-Za-z0-9][A-Za-z0-9'&./-]*"))
    lines = F.size(F.filter(F.split(value, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"), lambda x: F.trim(x) != ""))
    bad = F.length(value) - F.length(F.replace(value, F.lit("�"), F.lit("")))
    return F.greatest(F.lit(0), F.least(words, F.lit(200)) + F.least(lines, F.lit(50)) * 2 - bad * 5)


def identity_text_score(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    words = sum((F.contains(upper, F.lit(w)).cast("int") * 2 for w in IDENTITY_WORDS), F.lit(0))
    return words + sum((F.regexp_like(upper, F.lit(p)).cast("int") * w for p, w in IDENTITY_PATTERNS), F.lit(0))


def select_page_text(pages: DataFrame, embedded: str = "embedded", rendered: str = "rendered", confidence: str = "ocr_confidence") -> DataFrame:
    """Add text, source and text_confidence: the rendered text only if it ranks strictly higher.

    The rank is (identity score, readability); an empty or null side loses, two empty ones count as rendered.
    """
    e, r = F.coalesce(F.col(embedded), F.lit("")), F.coalesce(F.col(rendered), F.lit(""))
    rank = lambda t: F.struct(identity_text_score(t).alias("a"), readability_score(t).alias("b"))
    use = (e == "") | ((r != "") & (rank(r) > rank(e)))
    return pages.withColumns(
        {
            "text": F.when(use, r).otherwise(e),
            "source": F.when(use, "rendered_ocr").otherwise("embedded_pdf_text"),
            "text_confidence": F.when(use, F.col(confidence)),
        }
    )


def limit_pages(pages: DataFrame, max_pages: int = 20, max_chars: int = 100_000, id_col: str = "doc_id", order: str = "page_number") -> DataFrame:
    """The first max_pages pages of each document, texts cut to max_chars, with total_pages and truncated.

    These limits are the feature: documents beyond them are flagged.
    """
    by_page = Window.partitionBy(id_col).orderBy(order, "text")
    total = F.count(F.lit(1)).over(Window.partitionBy(id_col))
    ranked = pages.withColumns({"_rank": F.row_number().over(by_page), "total_pages": total})
    cut = F.length("text") > max_chars
    return (
        ranked.where(F.col("_rank") <= max_pages)
        .withColumn("truncated", F.coalesce(cut, F.lit(False)) | (F.col("total_pages") > max_pages))
        .withColumn("text", F.substring("text", 1, max_chars))
        .drop("_rank")
    )


def document_text(pages: DataFrame, id_col: str = "doc_id", order: str = "page_number") -> DataFrame:
    """One row per document: the pages with text, in order, joined by line feeds."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.trim("text").alias("t"))))
    kept = F.filter(F.transform(parts, lambda p: p["t"]), lambda t: t != "")
    return pages.groupBy(id_col).agg(F.trim(F.array_join(kept, "\n")).alias("text"), F.count(F.lit(1)).alias("pages"))


#: Scores from which a text needs no other reading, and what a reader is told of an extraction.
EMBEDDED_READABLE, OCR_READABLE, IDENTITY_ENOUGH, OCR_SURE = 60, 50, 4, 0.65
EXTRACTION_WARNINGS = {
    "page_limit_reached": "The document exceeded the configured page limit and was truncated.",
    "page_text_limit_reached": "Extracted page text exceeded the configured character limit and was truncated.",
    "no_text_extracted": "No readable text was extracted from the document.",
}


def embedded_text_is_sufficient(text: Column, score: Callable[[Column], Column] = identity_text_score) -> Column:
    """Whether a page's own text is useful enough to leave the page unrendered; score tells what is wanted of it."""
    return (score(text) >= IDENTITY_ENOUGH) & (readability_score(text) >= EMBEDDED_READABLE)


def ocr_text_is_sufficient(text: Column, confidence: Column, score: Callable[[Column], Column] = identity_text_score) -> Column:
    """Whether a recognised text is sure and useful enough to try no other orientation. A null confidence is not sure."""
    sure = F.coalesce(confidence >= OCR_SURE, F.lit(False))
    return sure & (score(text) >= IDENTITY_ENOUGH) & (readability_score(text) >= OCR_READABLE)


def extraction_metadata(
    pages: DataFrame, max_pages: int = 20, max_chars: int = 100_000, id_col: str = "doc_id", order: str = "page_number",
    source: Column | None = None, confidence: Column | None = None,
) -> DataFrame:
    """One row per document: pages_processed, total_pages, truncated, pages and warnings.

    pages lists the first max_pages with their page, source, ocr_confidence and text_length, at most max_chars. Warnings are
    sentences, in the order of EXTRACTION_WARNINGS. Null texts are empty; pages of one number go by their text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ranked = pages.select(
        F.col(id_col).alias("doc_id"),
        F.col(order).alias("page"),
        (F.lit(None).cast("string") if source is None else source).alias("source"),
        (F.lit(None).cast("double") if confidence is None else confidence).alias("ocr_confidence"),
        F.least(F.length(text), F.lit(max_chars)).alias("text_length"),
        (F.length(text) > max_chars).alias("cut"),
        (F.trim(text) != "").alias("some"),
        F.row_number().over(Window.partitionBy(id_col).orderBy(order, text)).alias("rank"),
    )
    kept = F.col("rank") <= max_pages
    page = F.struct("rank", "page", "source", "ocr_confidence", "text_length")
    found = ranked.groupBy("doc_id").agg(
        F.count_if(kept).alias("pages_processed"),
        F.count(F.lit(1)).alias("total_pages"),
        F.coalesce(F.max(F.when(kept, F.col("cut"))), F.lit(False)).alias("cut"),
        F.coalesce(F.max(F.when(kept, F.col("some"))), F.lit(False)).alias("some"),
        F.array_sort(F.collect_list(F.when(kept, page))).alias("listed"),
    )
    over = F.col("total_pages") > F.col("pages_processed")
    say = lambda condition, name: F.when(condition, EXTRACTION_WARNINGS[name])
    warnings = F.array_compact(F.array(say(over, "page_limit_reached"), say(F.col("cut"), "page_text_limit_reached"), say(~F.col("some"), "no_text_extracted")))
    shown = F.transform("listed", lambda p: F.struct(*(p[c].alias(c) for c in ("page", "source", "ocr_confidence", "text_length"))))
    return found.select("doc_id", "pages_processed", "total_pages", (over | F.col("cut")).alias("truncated"), shown.alias("pages"), warnings.alias("warnings"))
