"""Cleaning a corpus of pages: boilerplate, review flags, vocabulary, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..sources.folders import materialised, sent

#: Signs, and forms of typed formulas, that mark a page as mathematical.
MATH_SIGNS = "αβγδεζηθικλμνξπρστυφχψωΣΠΔΩΛΘΦΨΛ≤≥≠≈±∓×÷→←↔⇒∑∏∫∮√∞∂∇²³⁰¹⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
MATH_FORMS = r"[A-Za-z0-9)\]}]\s*[\^_]\s*[A-Za-z0-9{(]|\\frac|\\sum|\\alpha|\\theta"
MATH = f"[{MATH_SIGNS}]|{MATH_FORMS}"
#: What counts as a technical term of a course, and Roman numbers, which do not.
TERM = r"^(?:[A-Z]{2,}[A-Za-z0-9]*|[A-Z][a-z]+(?:-[A-Z][a-z]+)+|[A-Z][a-z]{2,}[A-Z][A-Za-z]*)$"
ROMAN = "^[IVXL]+$"
HYPHENATED, PIECE = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*", r"[\p{L}\p{N}_]+"


def line_key(line: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    return F.when(key.rlike(r"^[\d\s/|.:-]+$"), F.lit("#")).otherwise(key)


def exploded_lines(pages: DataFrame) -> DataFrame:
    lines = pages.select("deck", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return lines.withColumn("key", line_key(F.col("line")))


def boilerplate_keys(pages: DataFrame, threshold: float = 0.5, min_pages: int = 3) -> DataFrame:
    """Lines that stand on more than ``threshold`` of a deck's pages, one row each; single characters are never boilerplate.

    Hashes are counted first; lines themselves are only where their hash is that frequent.
    """
    n = pages.groupBy("deck").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    keys = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: line_key(x)))
    # outer explodes: plain ones would cut the texts a second time, to leave out empty rows beforehand
    hashes = pages.select("deck", F.explode_outer(F.transform(keys, lambda x: F.xxhash64(x))).alias("__hash"))
    many = hashes.groupBy("deck", "__hash").agg(F.count(F.lit(1)).alias("n")).join(n, "deck").where(F.col("n") > threshold * F.col("n_pages"))
    many = sent(materialised(many.select("deck", "__hash", "n_pages")))
    lines = pages.select("deck", F.explode_outer(keys).alias("key")).withColumn("__hash", F.xxhash64("key"))
    on = lines.join(many, ["deck", "__hash"]).groupBy("deck", "key", "n_pages").agg(F.count(F.lit(1)).alias("n"))
    common = on.where((F.col("key") != "") & (F.col("n") > threshold * F.col("n_pages")) & ((F.length("key") > 1) | (F.col("key") == "#")))
    return common.select("deck", "key", "n")


def strip_boilerplate(pages: DataFrame, threshold: float = 0.5, min_pages: int = 3, common: DataFrame | None = None) -> DataFrame:
    """The pages without boilerplate, that of ``common`` (deck, key) if given: for some pages of decks whose lines are known."""
    common = boilerplate_keys(pages, threshold, min_pages) if common is None else common
    kept = exploded_lines(pages).join(common.select("deck", "key"), ["deck", "key"], "left_anti")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return pages.select("deck", "page_no").join(kept.groupBy("deck", "page_no").agg(text.alias("text")), ["deck", "page_no"], "left").fillna("", ["text"])


def page_needs_review(text: Column, clipped: Column, n_images: Column) -> Column:
    """No text, clipped, mathematical, a list of scraps, or an image with little text."""
    text = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.filter(full, lambda x: F.size(F.split(F.trim(x), r"\s+")) <= 2)
    scraps = (F.size(full) >= 6) & (2 * F.size(short) > F.size(full))
    return (F.trim(text) == "") | clipped | text.rlike(MATH) | scraps | ((n_images > 0) & (F.length(text) < 300))


def math_uncertain(markdown: Column, text: Column) -> Column:
    return F.upper(markdown).contains("UNCERTAIN") | (text.rlike(MATH) & ~markdown.contains("$"))


def review_queue(pages: DataFrame, cap: int = 80, mode: str = "auto") -> DataFrame:
    """Flagged pages (``needs``, or all when mode is on) among the first ``cap`` of each deck, not yet rendered."""
    placed = pages.withColumn("place", F.row_number().over(Window.partitionBy("deck").orderBy("page_no")) - 1)
    wanted = {"off": F.lit(False), "on": F.lit(True), "auto": F.col("needs")}[mode]
    return placed.where((F.col("place") < cap) & ~F.col("rendered") & wanted).select("deck", "page_no")


def clip_flag(boxes: DataFrame, width: float, edge: float = 0.02) -> DataFrame:
    out = (F.col("x0") < width * edge) | (F.col("x1") > width * (1 - edge))
    return boxes.groupBy("page_id").agg(F.bool_or(out).alias("clipped"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes in bands of similar height, left to right; the band follows the page's upper-median box height."""
    heights = F.sort_array(F.collect_list(F.col("y1") - F.col("y0")))
    bands = boxes.groupBy("page_id").agg(heights.alias("h")).select("page_id", F.greatest(F.lit(4.0), 0.6 * F.get("h", F.floor(F.size("h") / 2).cast("int"))).alias("band"))
    row = F.rint((F.col("y0") + F.col("y1")) / 2 / F.col("band"))
    w = Window.partitionBy("page_id").orderBy(row, "x0", "box_id", "text", "y1")
    return boxes.join(bands, "page_id").withColumn("place", F.row_number().over(w)).select("page_id", "box_id", "place", "text")


def course_vocabulary(pages: DataFrame, terms: DataFrame, limit: int = 30, extra: int = 10) -> DataFrame:
    """Acronyms and compound names that stand on two or more pages of a course, after its glossary; case-insensitive."""
    slides = pages.where("kind = 'slides'").select("project_id", "doc_id", "text")
    names = F.filter(F.regexp_extract_all("text", F.lit(HYPHENATED), F.lit(0)), lambda x: x.contains("-") & x.rlike(TERM))
    others = F.filter(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)), lambda x: x.rlike(TERM))
    found = slides.select("project_id", "doc_id", F.explode(F.array_distinct(F.concat(names, others))).alias("term"))
    df = found.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= 2)
    df = df.where((F.length("term") <= 30) & ~F.col("term").rlike(ROMAN))
    lower = slides.select("project_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("common")).distinct()
    caps = F.col("term") == F.upper("term")
    marked = df.withColumn("common", F.lower("term")).join(lower.withColumn("seen", F.lit(True)), ["project_id", "common"], "left")
    kept = marked.where(~caps | F.col("seen").isNull())
    w = Window.partitionBy("project_id").orderBy(F.desc("df"), "term")
    top = kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("project_id", F.lit(1).alias("tier"), "place", "term")
    glossary = terms.where("auto = 1 and trim(repl) <> ''").select("project_id", F.lit(0).alias("tier"), F.col("id").cast("int").alias("place"), F.col("repl").alias("term"))
    return distinct_terms(glossary.union(top), limit + extra)


def distinct_terms(terms: DataFrame, limit: int) -> DataFrame:
    """First of each spelling, glossary (tier 0) first: columns project_id, tier, place, term."""
    first = terms.withColumn("__n", F.row_number().over(Window.partitionBy("project_id", F.lower("term")).orderBy("tier", "place"))).where("__n = 1")
    w = Window.partitionBy("project_id").orderBy("tier", "place", "term")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("project_id", "rank", "term")
