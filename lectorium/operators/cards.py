"""Flashcards: validation of generated records, packing of context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cloze_valid, dedup_key

LATEX = r"\$([^$\n]{1,200})\$"


def latex_spans(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(LATEX), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", ""))


def allowed_formulas(blocks: DataFrame, key: str) -> DataFrame:
    """Formulas of the material, one row each, without those of uncertain pages (columns text, uncertain)."""
    return blocks.where("not uncertain").select(key, F.explode(F.array_distinct(latex_spans(F.col("text")))).alias("formula")).where("formula <> ''").distinct()


def validate_cards(items: DataFrame, existing: DataFrame, formulas: DataFrame, pages: DataFrame, cap: int = 12, per_page: int = 2) -> DataFrame:
    """run_id, pos, reason (null: accepted), slide of every record that is looked at; looking stops at the cap.

    Whether a record is a duplicate or exceeds its page depends on those accepted before it, so the records of a run
    are folded in order; existing fronts, formulas and pages come in as one list per run.
    """
    stateless = (
        F.when(~F.col("kind").isin("qa", "cloze") | (F.trim("front") == ""), "malformed")
        .when((F.col("kind") == "qa") & (F.trim("back") == ""), "empty_back")
        .when((F.col("kind") == "cloze") & ~cloze_valid(F.col("front")), "bad_cloze")
    )
    known = lambda df, name: df.groupBy("run_id").agg(F.collect_set(df.columns[-1]).alias(name))
    rows = items.join(known(existing, "__old"), "run_id", "left").join(known(formulas, "__ok"), "run_id", "left").join(known(pages, "__pages"), "run_id", "left")
    strings, ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    spans = F.filter(latex_spans(F.concat_ws(" ", "front", "back")), lambda x: x != "")
    bad_math = F.size(F.array_except(spans, F.coalesce("__ok", strings))) > 0
    key = dedup_key(F.trim("front"))
    reason = F.coalesce(stateless, F.when(bad_math, "unverified_formula"), F.when((key == "") | F.array_contains(F.coalesce("__old", strings), key), "duplicate"))
    slide = F.when(F.array_contains(F.coalesce(F.col("__pages").cast("array<int>"), ints), F.col("slide").cast("int")), F.col("slide").cast("int"))
    item = F.struct(F.col("pos").cast("int").alias("pos"), reason.alias("reason"), key.alias("key"), slide.alias("slide"))
    runs = rows.select("run_id", item.alias("i")).groupBy("run_id").agg(F.sort_array(F.collect_list("i")).alias("items"))
    out_type = "array<struct<pos:int,reason:string,slide:int>>"
    zero = F.struct(strings.alias("seen"), ints.alias("used"), F.lit(0).alias("n"), F.array().cast(out_type).alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = x["slide"].isNotNull() & (F.size(F.filter(a["used"], lambda s: s == x["slide"])) >= per_page)
        why = F.coalesce(x["reason"], F.when(F.array_contains(a["seen"], x["key"]), "duplicate"), F.when(full, "page_cap"))
        ok = why.isNull()
        looked = F.struct(
            F.when(ok, F.concat(a["seen"], F.array(x["key"]))).otherwise(a["seen"]).alias("seen"),
            F.when(ok & x["slide"].isNotNull(), F.concat(a["used"], F.array(x["slide"]))).otherwise(a["used"]).alias("used"),
            (a["n"] + ok.cast("int")).alias("n"),
            F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), why.alias("reason"), x["slide"].alias("slide")))).alias("out"),
        )
        return F.when(a["n"] >= cap, a).otherwise(looked)

    folded = runs.select("run_id", F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("o"))
    return folded.select("run_id", "o.*")


def citations(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that answers cite in square brackets, with a time, or in round groups; a group counts only if all of its
    labels exist. Columns answer_id, project_id, text; project_id, label, transcript_id."""
    square = F.regexp_extract_all("text", F.lit(r"\[(L\d+(?: \d+:\d{2})?)\]"), F.lit(1))
    rounds = F.regexp_extract_all("text", F.lit(r"\((L\d+(?:, ?L\d+)*)\)"), F.lit(1))
    one = answers.select("answer_id", "project_id", F.explode(square).alias("c"), F.lit(-1).alias("grp"))
    many = answers.select("answer_id", "project_id", F.posexplode(rounds).alias("grp", "c")).select("answer_id", "project_id", F.explode(F.split("c", ", ?")).alias("c"), "grp")
    cited = one.union(many).select("answer_id", "project_id", "grp", F.regexp_extract("c", r"^(L\d+)", 1).alias("label"), F.regexp_extract("c", r" (\d+):\d{2}$", 1).alias("m"), F.regexp_extract("c", r":(\d{2})$", 1).alias("s"))
    at = F.when(F.col("m") != "", F.col("m").cast("long") * 60 + F.col("s").cast("long"))
    found = cited.join(labels, ["project_id", "label"], "left")
    broken = found.where("grp >= 0 and transcript_id is null").select("answer_id", "grp").distinct()
    return found.join(broken, ["answer_id", "grp"], "left_anti").where("transcript_id is not null").select("answer_id", "label", "transcript_id", at.alias("at_seconds"))


def deck_id(name: Column) -> Column:
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def note_table(cards: DataFrame) -> DataFrame:
    """Stable export rows of the active cards (uid, course, lecture, kind, front, back, slide)."""
    deck = F.concat_ws("::", "course", "lecture")
    return cards.where("status = 'active'").select(deck.alias("deck"), deck_id(deck).alias("deck_id"), F.substring(F.sha2("uid", 256), 1, 10).alias("guid"), "kind", "front", "back")


def deck_lines(cards: DataFrame) -> DataFrame:
    """One TSV line per active card: cloze cards have no back; backs name their slide."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    back = F.concat(flat("back"), F.when(F.col("slide").isNotNull(), F.concat(F.lit(" (slide "), F.col("slide").cast("string"), F.lit(")"))).otherwise(""))
    deck = F.concat_ws("::", "course", "lecture")
    line = F.when(F.col("kind") == "cloze", F.concat_ws("\t", flat("front"), deck)).otherwise(F.concat_ws("\t", flat("front"), back, deck))
    return cards.where("status = 'active'").select("kind", "uid", line.alias("line"))
