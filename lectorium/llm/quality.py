"""Line-first quality rules (DataFrame functions only).

Each line is judged on its own (punctuation, navigation, boilerplate), failing lines are removed, and a
document that loses too much of its text is rejected. All work happens inside the row: no shuffle.

Defined results: a null text has no words and no lines, so it fails the base rules; an empty text likewise.
A very long text is judged whole, in the one row that it is; an empty table stays empty.
Blank lines never fail. Repeated rows are judged alike, once each. Other columns pass through ``clean_lines``
unless their name is one of the added ones, which then takes its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CHAR, WORD_GAP, words_of

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules and of the verdict on a document."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line without closing punctuation fails if it has fewer words.
    unclosed_words: int = 12
    #: Symbols, or runs of ! and ?, may make up one in so many characters of a line.
    chars_per_symbol: int = 20
    #: Navigation and boilerplate phrases condemn only lines with fewer words.
    phrase_words: int = 20
    #: Share of the word characters that a document may lose, in percent.
    max_lost_percent: int = 40


CLOSED = r"[.!?…:;。！？][\"'”’»)\]]*" + WORD_GAP + r"*\z"
SHOUTS = r"[!?]{2,}"
#: Letters of scripts that are written without spaces: two count as a word where a line is measured.
UNSPACED = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
#: Phrases in English, German, French and Spanish. Case is folded for ASCII letters only, so others stand in both.
NAVIGATION_PHRASES = (
    "home|menu|login|log in|sign in|next|previous|back to top|skip to content|read more"
    "|startseite|men[üÜ]|anmelden|weiter|zur[üÜ]ck|nach oben|zum inhalt springen|mehr lesen|weiterlesen"
    "|accueil|connexion|se connecter|suivant|pr[éÉ]c[éÉ]dent|haut de page|aller au contenu|lire la suite"
    "|inicio|men[úÚ]|iniciar sesi[óÓ]n|siguiente|anterior|volver arriba|ir al contenido|leer m[áÁ]s"
)
BOILERPLATE_PHRASES = (
    r"all rights reserved|cookies?\b|privacy policy|terms of (use|service)|enable javascript|lorem ipsum"
    r"|subscribe (to|now)|click here|sign up|powered by|follow us"
    r"|alle rechte vorbehalten|datenschutzerkl[äÄ]rung|nutzungsbedingungen|newsletter abonnieren|hier klicken|folgen sie uns"
    r"|tous droits r[éÉ]serv[éÉ]s|politique de confidentialit[éÉ]|conditions d.utilisation|cliquez ici|abonnez-vous|suivez-nous"
    r"|todos los derechos reservados|pol[íÍ]tica de privacidad|condiciones de uso|haga clic|haz clic|s[íÍ]guenos|suscr[íÍ]bete"
)
#: Separators of a menu, or a line of nothing but navigation phrases: a sentence may begin with one.
NAVIGATION = rf"(\|[^|]*\||»|›|→|(?i:^[^\p{{L}}\p{{N}}]*((?:{NAVIGATION_PHRASES})[^\p{{L}}\p{{N}}]*)+\z))"
BOILERPLATE = f"(?i:{BOILERPLATE_PHRASES})"


def at_least_words(line: Column, n: int) -> Column:
    return line.rlike(f"(?:{WORD_CHAR}+{WORD_GAP}+){{{n - 1}}}{WORD_CHAR}")


def line_fails(line: Column, rules: LineRules) -> Column:
    blank = ~line.rlike(WORD_CHAR)
    length = F.length(line)
    punctuation = (
        (~line.rlike(CLOSED) & ~at_least_words(line, rules.unclosed_words) & (F.regexp_count(line, F.lit(UNSPACED)) < 2 * rules.unclosed_words))
        | (F.regexp_count(line, F.lit(SYMBOLS)) * rules.chars_per_symbol > length)
        | (F.regexp_count(line, F.lit(SHOUTS)) * rules.chars_per_symbol > length)
    )
    # the bound on words comes first: it looks at the start of a long line only
    phrases = ~at_least_words(line, rules.phrase_words) & (line.rlike(NAVIGATION) | line.rlike(BOILERPLATE))
    return ~blank & (punctuation | phrases)


def repeat_words(words: Column, ordered: Column) -> Column:
    """Words inside a 3-word window whose sequence occurs twice or more in the text.

    ``ordered``: the windows as (hash, window, position), sorted; equal windows stand side by side, and each
    such neighbour pair covers three words at either position.
    """
    same = F.filter(
        F.sequence(F.lit(1), F.size(ordered) - 1),
        lambda i: (ordered[i - 1]["h"] == ordered[i]["h"]) & (ordered[i - 1]["w"] == ordered[i]["w"]),
    )
    at = F.flatten(
        F.transform(
            same,
            lambda i: F.array(*[ordered[i - d]["p"] + s for d in (1, 0) for s in (0, 1, 2)]),
        )
    )
    return F.when(F.size(words) < 4, 0).otherwise(F.size(F.array_distinct(at)))


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars,
    cleaned_text, base_failed and kept to every row of ``df``."""
    t = F.coalesce(F.col(text), F.lit(""))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines",
             "lost_chars", "cleaned_text", "base_failed", "kept"]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in added]
    step = df.select(*rest, words_of(F.col(text)).alias("__words"), F.split(t, "\n").alias("__lines"))
    words, lines = F.col("__words"), F.col("__lines")
    window = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])
    windows = F.when(
        F.size(words) >= 4,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(window(i).alias("w"), i.alias("p"))),
    ).otherwise(F.array().cast("array<struct<w:string,p:int>>"))
    step = step.select(
        "*",
        windows.alias("__windows"),
        F.filter(lines, lambda x: x.rlike(WORD_CHAR)).alias("__full"),
        F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x, rules).alias("bad"))).alias("__judged"),
    )
    ordered = F.sort_array(
        F.transform("__windows", lambda x: F.struct(F.xxhash64(x["w"]).alias("h"), x["w"].alias("w"), x["p"].alias("p")))
    )
    step = step.select("*", ordered.alias("__ordered"))
    chosen = lambda bad: F.transform(F.filter("__judged", lambda x: x["bad"] == bad), lambda x: x["line"])
    failed = chosen(True)
    step = step.select(
        *rest,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        repeat_words(words, F.col("__ordered")).cast("long").alias("n_repeat_words"),
        F.size("__full").cast("long").alias("n_lines"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        F.length(F.regexp_replace(F.array_join(failed, " "), WORD_GAP + "+", "")).cast("long").alias("lost_chars"),
        F.array_join(chosen(False), "\n").alias("cleaned_text"),
    )
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    lost = 100 * F.col("lost_chars") > rules.max_lost_percent * F.col("word_chars")
    return step.withColumn("base_failed", base).withColumn("kept", ~base & ~lost)


def kept_documents(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns and ``cleaned_text`` besides.

    The verdict selects rows through an explode of none or one element: a filter on it would be pushed below the steps
    that it is made of, and these would then be computed again for every element of an array.
    """
    judged = clean_lines(df)
    rest = [F.col(f"`{c}`") for c in df.columns if c != "cleaned_text"]
    one = F.when(F.col("kept"), F.array("cleaned_text")).otherwise(F.array().cast("array<string>"))
    return judged.select(*rest, F.explode(one).alias("cleaned_text"))


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
          "n_lines", "n_failed_lines", "lost_chars"]


def quality_digest(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select(*DIGEST)


def _sql(rules: LineRules = LineRules()) -> str:
    words = lambda n: f"regexp_matches(l, '(?:{WORD_CHAR}+{WORD_GAP}+){{{n - 1}}}{WORD_CHAR}')"
    q = lambda s: s.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{WORD_GAP}+'), lambda x: x <> '') AS words FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
f AS (SELECT doc_id, l, ((NOT regexp_matches(l, '{q(CLOSED)}') AND NOT {words(rules.unclosed_words)}
      AND len(regexp_extract_all(l, '{UNSPACED}')) < {2 * rules.unclosed_words})
    OR len(regexp_extract_all(l, '{SYMBOLS}')) * {rules.chars_per_symbol} > length(l)
    OR len(regexp_extract_all(l, '{SHOUTS}')) * {rules.chars_per_symbol} > length(l)
    OR ((regexp_matches(l, '{q(NAVIGATION)}') OR regexp_matches(l, '{q(BOILERPLATE)}')) AND NOT {words(rules.phrase_words)})) AS bad
  FROM l WHERE regexp_matches(l, '{WORD_CHAR}')),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_failed,
    coalesce(sum(length(regexp_replace(l, '{WORD_GAP}+', '', 'g'))) FILTER (bad), 0) AS lost FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
    AND NOT (100 * lost_chars > {rules.max_lost_percent} * word_chars) AS kept,
  n_lines, n_failed_lines, lost_chars
FROM b"""


SQL = _sql()
