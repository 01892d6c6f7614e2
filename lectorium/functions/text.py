"""Text helpers as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented Latin letters and what they fold to, in order.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
#: Fixed value: what counts as a token of a query.
TOKEN = "[a-zà-ÿ0-9]{3,}"
WORD = r"[\p{L}\p{N}]+"
#: Typographic signs and the plain ones that they count as.
SIGNS = {
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u2018": "'", "\u2019": "'", "\u2032": "'", "\u00b4": "'", "\u0060": "'",
    "\u201c": '"', "\u201d": '"', "\u00ab": '"', "\u00bb": '"',
}
#: White space, beyond ASCII too, as the inside of a character class.
SPACES = r"\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Keys under which a model returns a whole document, in order.
DOCUMENT_KEYS = ["markdown", "documento", "document", "notes", "appunti", "text", "testo"]
#: Languages by code.
LANGUAGES = {"it": "Italian", "en": "English", "fr": "French", "de": "German", "es": "Spanish", "pt": "Portuguese", "nl": "Dutch", "ru": "Russian", "zh": "Chinese", "ja": "Japanese", "ar": "Arabic"}


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def folded_words(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_match(text: Column) -> Column:
    """One form for comparing: plain quotes and dashes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(text, "".join(SIGNS), "".join(SIGNS.values())), f"[{SPACES}]+", " "))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
    return texts.map(bare, na_action="ignore")


def dedup_key(text: Column) -> Column:
    """Lower case, decomposed (NFKD), without accents; all but letters a-z and digits becomes one space.

    Spark has no decomposition of its own. Plain texts, nearly all, are handled by the JVM and go to Python as nulls.
    """
    text = F.coalesce(text, F.lit(""))
    folded = F.coalesce(_decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def cloze_valid(text: Column) -> Column:
    """One or two deletions, none of them blank."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\{\{c\d::(.+?)\}\}"), F.lit(1))
    return F.size(parts).between(1, 2) & F.forall(parts, lambda p: F.trim(p) != "")


def one_line(text: Column) -> Column:
    return normalize_ws(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def preview(find: Column, replace: Column) -> Column:
    return F.concat(F.substring(one_line(find), 1, 60), F.lit(" → "), F.substring(one_line(replace), 1, 60))


def slug(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]+", " "))
    return F.substring(F.regexp_replace(clean, r"\s+", "-"), 1, 60)


def file_slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r'[\\/:*?"<>|]+', ""))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def word_count(markdown: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.translate(markdown, "#*`>|-", "      "), r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def strip_plan(markdown: Column) -> Column:
    """Without closed plan blocks, and from the first title on if there is one."""
    body = F.regexp_replace(markdown, r"(?is)<plan>.*?</plan>\s*", "")
    from_title = F.regexp_extract(body, r"(?ms)^# .*\z", 0)
    return F.coalesce(F.nullif(from_title, F.lit("")), body)


def unwrap(markdown: Column) -> Column:
    """Without a fence around the whole text, if there is a section inside."""
    inside = F.regexp_extract(F.trim(markdown), r"(?s)\A```[a-z]*\n(.*)\n```\z", 1)
    return F.when(inside.contains("## "), inside).otherwise(markdown)


def title(markdown: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(markdown, r"(?m)^\s*# (.*)$", 1))
    return F.substring(F.coalesce(F.nullif(found, F.lit("")), fallback), 1, 200)


def fmt_ts(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    s = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60
    short = F.concat_ws(":", two(m), two(s % 60))
    return F.when(h > 0, F.concat_ws(":", two(h), short)).otherwise(short)


def unwrap_json(text: Column) -> Column:
    """The document inside a JSON object: the first of the known keys that holds more than 40 characters."""
    bare = F.trim(text)
    found = [F.trim(F.get_json_object(bare, f"$.{k}")) for k in DOCUMENT_KEYS]
    return F.when(bare.startswith("{"), F.coalesce(*[F.when(F.length(v) > 40, v) for v in found], bare)).otherwise(bare)


def overview(markdown: Column, limit: int = 400) -> Column:
    """The first paragraph after the title and before any other heading, without bold and code marks."""
    after = F.regexp_extract(markdown, r"(?ms)^[ \t]*# [^\n]*\n(.*)\z", 1)
    paragraph = F.regexp_extract(after, r"(?s)\A(?:[ \t]*\n)*(?![ \t]*#)(.*?)(?:\n[ \t]*\n|\n[ \t]*#|\z)", 1)
    return F.substring(F.regexp_replace(normalize_ws(paragraph), "[*`]", ""), 1, limit)


def sections(markdown: Column) -> Column:
    """(title, body) of every second-level heading."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), markdown), "\n## "), 2, 1_000_000)
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A([^\n]*)", 1)).alias("title"), F.trim(F.regexp_extract(p, r"(?s)\A[^\n]*\n(.*)\z", 1)).alias("body")))


def language_name(code: Column) -> Column:
    """The English name of a language code, or a phrase that stands for it."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    base = F.lower(F.substring_index(code, "-", 1))
    phrase = F.concat(F.lit("the same language as the transcript"), F.when(code != "", F.concat(F.lit(" ("), code, F.lit(")"))).otherwise(""))
    return F.coalesce(F.try_element_at(known, base), phrase, F.lit("the same language as the transcript"))


def job_speed(position: Column, start: Column, elapsed: Column) -> Column:
    """Media seconds per second, null before anything is done."""
    return F.when(position > start, (position - start) / F.greatest(elapsed, F.lit(0.001)))


def job_progress(position: Column, total: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(position, total), F.lit(0.0))), 4)


def job_eta(position: Column, total: Column, speed: Column) -> Column:
    return F.when((speed > 0) & (total > 0) & (position < total), (total - position) / speed)
