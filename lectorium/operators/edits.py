"""Edit plans: where a text stands, which proposals can be applied, and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIGNS, SPACES, normalize_match
from .needles import find_needles

MAX_DELTA = 160


def tolerant_pattern(find: Column) -> Column:
    """A pattern for whole-word matches that takes any white space for a space and any quote or dash for its kind."""
    quoted = F.regexp_replace(normalize_match(find), r"([\\\[\](){}.*+?^$|&~#])", r"\\$1")
    for plain in ("'", '"', "-"):
        forms = "".join(s for s, p in SIGNS.items() if p == plain)
        quoted = F.replace(quoted, F.lit(plain), F.lit(f"[{forms}{plain}]"))
    gap = f"[{SPACES}]+".replace("\\", "\\\\")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(quoted, " ", gap), F.lit(r"(?![\p{L}\p{N}])"))


def find_occurrences(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, transcript_id, idx, start, end (characters from 0) of every match of a rule in its course's segments.

    All rules of a course in one pass over each segment.
    """
    return find_needles(segments.select("project_id", "transcript_id", "idx", "text"), rules, "project_id", "rule_id").drop("project_id")


def occurrences_by_pattern(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, transcript_id, idx, start, end (characters from 0) of every match of a rule: one pattern after the other.

    The same as ``find_occurrences``, for few rules, without leaving the JVM. Places follow from the pieces between the matches.
    """
    r = rules.where(normalize_match(F.col("find")) != "").select("project_id", "rule_id", tolerant_pattern(F.col("find")).alias("pattern"))
    met = segments.select("project_id", "transcript_id", "idx", "text").join(r, "project_id")
    found = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    met = met.select("rule_id", "transcript_id", "idx", F.split("text", F.col("pattern"), -1).alias("between"), found.alias("found")).where(F.size("found") > 0)
    hits = met.select("*", F.posexplode("found").alias("i", "hit"))
    lengths = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    start = lengths("between", F.col("i") + 1) + lengths("found", F.col("i"))
    return hits.select("rule_id", "transcript_id", "idx", start.alias("start"), (start + F.length("hit")).alias("end"))


def check_proposals(proposals: DataFrame, occurrences: DataFrame, allow_multiple: bool = False) -> DataFrame:
    """The flag of each proposal (project_id, rule_id, find, repl); the first of equal ones is not a duplicate."""
    n = occurrences.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("project_id", normalize_match(F.col("find")), normalize_match(F.col("repl"))).orderBy("rule_id")
    rows = proposals.withColumn("__place", F.row_number().over(same)).join(n, "rule_id", "left").fillna(0, ["n"])
    real = F.trim("find") != ""
    flag = (
        F.when(real & (normalize_match(F.col("find")) != "") & (F.col("__place") > 1), "duplicate")
        .when(~real, "unmatched")
        .when(F.col("find") == F.col("repl"), "noop")
        .when(F.abs(F.length("repl") - F.length("find")) > MAX_DELTA, "too_large")
        .when(F.col("n") == 0, "unmatched")
        .when((F.col("n") > 1) & ~F.lit(allow_multiple), "ambiguous")
        .otherwise("ok")
    )
    return rows.select("project_id", "rule_id", flag.alias("flag"), F.when(flag.isin("ok", "ambiguous"), F.col("n")).otherwise(0).alias("occurrences"))


def settle_spans(spans: DataFrame) -> DataFrame:
    """Adds ``status`` to spans (transcript_id, idx, start, end, rule_id): left to right, longest first, a span is applied
    unless it overlaps one that is applied already; an equal span is a duplicate.

    Spans are in order of start, so the last applied one is all that a fold must carry. The spans of one segment are
    bounded by its length.
    """
    key = ["transcript_id", "idx"]
    item = F.struct("start", (-F.col("end")).alias("back"), "rule_id")
    ordered = spans.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("s"))
    out_type = "array<struct<start:int,end:int,rule_id:bigint,status:string>>"
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(out_type).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = -x["back"]
        status = F.when((x["start"] == a["start"]) & (end == a["end"]), "duplicate_span").when(x["start"] < a["end"], "conflict").otherwise("applied")
        ok = status == "applied"
        row = F.struct(x["start"].alias("start"), end.cast("int").alias("end"), x["rule_id"].cast("long").alias("rule_id"), status.alias("status"))
        return F.struct(F.when(ok, x["start"]).otherwise(a["start"]).alias("start"), F.when(ok, end).otherwise(a["end"]).alias("end"), F.concat(a["out"], F.array(row)).alias("out"))

    typed = F.transform("s", lambda x: F.struct(x["start"].cast("int").alias("start"), x["back"].cast("int").alias("back"), x["rule_id"].cast("long").alias("rule_id")))
    folded = ordered.select(*key, F.aggregate(typed, zero, step, lambda a: a["out"]).alias("o"))
    return folded.select(*key, F.explode("o").alias("o")).select(*key, "o.*")


def apply_proposals(segments: DataFrame, settled: DataFrame, rules: DataFrame) -> DataFrame:
    """The changed segments: text with the applied spans replaced, and their number."""
    applied = settled.where("status = 'applied'").join(rules.select("rule_id", "repl"), "rule_id")
    edits = applied.groupBy("transcript_id", "idx").agg(F.sort_array(F.collect_list(F.struct("start", "end", "repl"))).alias("e"))
    joined = segments.join(edits, ["transcript_id", "idx"])
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["text"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), x["repl"]).alias("text"), x["end"].alias("at"))
    rebuilt = F.aggregate("e", zero, step, lambda a: F.concat(a["text"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return joined.select("transcript_id", "idx", rebuilt.alias("text"), F.size("e").alias("n_applied"))


def apply_glossary(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Every automatic rule of a course in order of its text, each on what the one before left; all occurrences."""
    rule = F.struct(F.lower("find").alias("o"), "id", tolerant_pattern(F.col("find")).alias("p"), F.regexp_replace("repl", r"([\\$])", r"\\$1").alias("r"))
    rules = terms.where("auto = 1").groupBy("project_id").agg(F.sort_array(F.collect_list(rule)).alias("rules"))  # rules of one course
    joined = segments.join(rules, "project_id", "left")
    zero = F.struct(F.col("text").alias("t"), F.lit(0).alias("n"))
    step = lambda a, r: F.struct(F.regexp_replace(a["t"], r["p"], r["r"]).alias("t"), (a["n"] + F.regexp_count(a["t"], r["p"])).alias("n"))
    done = F.aggregate(F.coalesce("rules", F.array().cast("array<struct<o:string,id:int,p:string,r:string>>")), zero, step)
    return joined.select("project_id", "transcript_id", "idx", done.alias("d")).select("project_id", "transcript_id", "idx", F.col("d.t").alias("text"), F.col("d.n").alias("n_applied"))


def locate_across_segments(segments: DataFrame, needle: str) -> DataFrame:
    """First place of a text in the joined segments of each lecture, as segment and place within it."""
    joined = segments.groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("t"))
    at = joined.select("transcript_id", (F.instr(F.col("t"), needle) - 1).alias("at")).where("at >= 0")
    w = Window.partitionBy("transcript_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    spans = segments.select("transcript_id", "idx", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("lo"), F.length("text").alias("len"))
    inside = (F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("lo") + F.col("len"))
    return spans.join(at, "transcript_id").where(inside).select("transcript_id", "idx", (F.col("at") - F.col("lo")).cast("long").alias("local"))
