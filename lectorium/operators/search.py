"""Lexical retrieval: TF-IDF, an inverted index with phrase search, passages for questions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, folded_words, tokenize
from ..sources.folders import materialised, sent, stored
from .packing import pack

K1, B = 1.2, 0.75
#: Scores are given to six digits, so bounds within this of a score to beat still count.
NEAR = 2e-6
#: The most frequent tokens, whose weights are sent to all tasks.
HEAD = 65_536
#: So many different words of phrases are looked for inside the texts; more are joined.
WORDS_AT_ONCE = 20_000


def term_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, tf. Tokens are sorted and counted inside their row; only rows that share their keys meet in a shuffle."""
    again = materialised(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    if not again.count():
        return _counted(docs, keys)
    named = again.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    once, more = (_counted(docs.join(named, same, how), keys) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.groupBy(*keys, "token").agg(F.sum("tf").alias("tf")))


def _counted(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The tokens of each row, once each, with their number: where a token begins in the row's sorted tokens, and the next."""
    rows = docs.select(*keys, F.sort_array(tokenize(F.col("text"))).alias("__t")).select("*", F.size("__t").alias("__n"))
    first = F.filter(F.transform("__t", lambda x, i: F.when((i == 0) | (x != F.get("__t", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select(*keys, "__t", "__n", first.alias("__at"))
    told = F.transform("__at", lambda i, j: F.struct(F.get("__t", i).alias("token"), (F.coalesce(F.get("__at", j + 1), "__n") - i).cast("long").alias("tf")))
    # an outer explode: a plain one would cut the texts a second time, to leave out empty rows beforehand
    return rows.select(*keys, F.explode_outer(told).alias("__c")).where("__c is not null").select(*keys, "__c.token", "__c.tf")


def document_frequency(docs: DataFrame, scope: str, doc: str) -> DataFrame:
    distinct = docs.select(scope, doc, F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    return distinct.groupBy(scope, "token").agg(F.count(F.lit(1)).alias("df"))


def tfidf_weights(queries: DataFrame, docs: DataFrame, scope: str, query: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """Shares of a query's and a document's length that each token has: (scope, query, token, qw) and (scope, token, doc, w).

    A token weighs (1 + ln tf) times ln((1 + N) / (1 + df)) + 1. Texts are cut into tokens once; of the documents only tokens
    that a query of their scope has are kept. A cosine is the sum of qw * w over the tokens that both have.
    """
    n = docs.groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(term_counts(docs, [scope, doc]))
    idf = counts.groupBy(scope, "token").agg(F.count(F.lit(1)).alias("df")).join(n, scope)
    idf = stored(idf.select(scope, "token", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    weight = ((1 + F.log("tf")) * F.col("idf")).alias("w")

    def lengths(weighed: DataFrame, key: str) -> DataFrame:
        return weighed.groupBy(scope, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    asked = term_counts(queries, [scope, query]).join(idf, [scope, "token"])
    asked = materialised(asked.select(scope, query, "token", "idf", weight))
    q = materialised(asked.join(lengths(asked, query), [scope, query]).select(scope, query, "token", (F.col("w") / F.col("norm")).alias("qw")))
    # the most frequent tokens make up most rows and are sent to them; only rows of the others travel to meet their weight
    head = F.broadcast(materialised(idf.orderBy(F.desc("df"), scope, "token").limit(HEAD).select(scope, "token", "idf")))
    rare = counts.join(head, [scope, "token"], "left_anti").join(idf, [scope, "token"])
    weighed = counts.join(head, [scope, "token"]).select(scope, doc, weight).union(rare.select(scope, doc, weight))
    known = sent(materialised(asked.select(scope, "token", "idf").distinct()))
    d = counts.join(known, [scope, "token"]).select(scope, doc, "token", weight)
    return q, stored(d.join(lengths(weighed, doc), [scope, doc]).select(scope, doc, "token", (F.col("w") / F.col("norm")).alias("w")))


def cosines(pairs: DataFrame, q: DataFrame, d: DataFrame, scope: str, query: str, doc: str) -> DataFrame:
    """The pairs (scope, query, doc) with their score."""
    asked = pairs.join(q, [scope, query])
    met = asked.join(d, [scope, doc, "token"]).groupBy(scope, query, doc)
    return met.agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))


def tfidf_rank(queries: DataFrame, docs: DataFrame, scope: str = "project_id", query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Cosine of every query and document of a scope that share a token. For all pairs; ``tfidf_top`` looks for the best only."""
    q, d = tfidf_weights(queries, docs, scope, query, doc)
    met = d.join(sent(q), [scope, "token"]).groupBy(scope, query, doc)
    return met.agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))


def tfidf_candidates(q: DataFrame, d: DataFrame, k: int, lead: int, scope: str, query: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """Scores of all pairs that can be among the k best of their query, in two steps.

    Postings of a token are taken by impact. First every query meets the ``lead`` strongest of each of its tokens; the k-th
    best score so far is to be beaten. What lies behind the lead of a token adds no more than the last of it, so a pair that
    has not been met scores at most the sum of these bounds. Only postings that reach the score to beat together with the
    bounds of the query's other tokens bring further pairs; long lists of frequent tokens mostly do not.
    """
    order = Window.partitionBy(scope, "token").orderBy(F.desc("w"), doc)
    strong = materialised(d.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= lead))
    behind = strong.where(F.col("__place") == lead).select(scope, "token", F.col("w").alias("__most"), F.col(doc).alias("__last"))
    first = materialised(cosines(q.join(strong, [scope, "token"]).select(scope, query, doc).distinct(), q, d, scope, query, doc))
    best = Window.partitionBy(scope, query).orderBy(F.desc("score"))
    beat = first.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == k).select(scope, query, F.col("score").alias("__beat"))
    bound = q.join(behind, [scope, "token"]).join(beat, [scope, query], "left")
    bound = bound.select(scope, query, "token", "qw", "__most", "__last", (F.col("qw") * F.col("__most")).alias("__bound"), (F.coalesce("__beat", F.lit(0.0)) - NEAR).alias("__beat"))
    # of a pair's tokens the one of the largest bound brings it: the others add no more than the bounds up to that one
    rising = Window.partitionBy(scope, query).orderBy("__bound", "token").rowsBetween(Window.unboundedPreceding, 0)
    bound = bound.withColumn("__up", F.sum("__bound").over(rising)).where(F.col("__up") >= F.col("__beat"))
    weaker = (F.col("w") < F.col("__most")) | ((F.col("w") == F.col("__most")) & (F.col(doc) > F.col("__last")))
    able = F.col("qw") * F.col("w") + F.col("__up") - F.col("__bound") >= F.col("__beat")
    more = bound.join(d, [scope, "token"]).where(weaker & able).select(scope, query, doc).distinct()
    more = more.join(first, [scope, query, doc], "left_anti")
    return first, materialised(cosines(more, q, d, scope, query, doc))


def tfidf_top(queries: DataFrame, docs: DataFrame, k: int, scope: str = "project_id", query: str = "query_id", doc: str = "doc_id", lead: int | None = None) -> DataFrame:
    """The k best documents of every query by ``tfidf_rank``'s score, ties to the smaller id: scope, query, doc, score, rank."""
    q, d = tfidf_weights(queries, docs, scope, query, doc)
    first, more = tfidf_candidates(q, d, k, lead or k, scope, query, doc)
    w = Window.partitionBy(scope, query).orderBy(F.desc("score"), doc)
    return first.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_pages(queries: DataFrame, pages: DataFrame, limit: int = 12, min_score: float = 0.08, min_chars: int = 40) -> DataFrame:
    """The slide pages nearest to each query: at least three quarters of the best score, at most ``limit``."""
    docs = pages.where(F.col("kind") == "slides").where(F.length("text") >= min_chars)
    near = tfidf_top(queries, docs, limit)
    least = F.greatest(F.lit(min_score), F.round(0.75 * F.max("score").over(Window.partitionBy("query_id")), 6))
    near = near.withColumn("__floor", least).where(F.col("score") >= F.col("__floor"))
    return near.select("query_id", "doc_id", F.round("score", 3).alias("score"), "rank")


def transcript_windows(segments: DataFrame, chars: int = 1000) -> DataFrame:
    """Consecutive segments of a lecture, gathered until they hold ``chars`` characters; then a new window begins.

    A last window without a word is left out.
    """
    length = F.length(F.coalesce("text", F.lit(""))) + 1
    packed = pack(segments.select("project_id", "transcript_id", "idx", "start_s", "text"), "transcript_id", "idx", length, chars)
    said = F.sort_array(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text"))))  # one window's
    windows = packed.groupBy("project_id", "transcript_id", F.col("pack").alias("win")).agg(
        F.min_by("start_s", F.when(F.col("start_s").isNotNull(), F.col("idx"))).alias("start_s"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"), F.sum(length).alias("__n")
    )
    full = windows.where((F.trim("text") != "") | (F.col("__n") >= chars))
    return full.select("project_id", "transcript_id", "win", "start_s", F.trim("text").alias("text"))


def ask_passages(questions: DataFrame, windows: DataFrame, numbers: DataFrame, k: int = 8, min_score: float = 0.02) -> DataFrame:
    """For every question its k nearest windows that score above ``min_score``, in order of lecture and time.

    Only windows of lectures in ``numbers`` take part: those that have a summary, where the caller leaves out the others.
    """
    docs = windows.join(numbers.select("transcript_id"), "transcript_id", "left_semi").withColumn("doc_id", F.concat_ws("-", "transcript_id", "win"))
    docs = materialised(docs)
    top = tfidf_top(questions, docs, k).where(F.col("score") > min_score)
    placed = top.join(docs.select("doc_id", "transcript_id", "start_s", "text"), "doc_id").join(numbers.select("transcript_id", "lecture_no", "label"), "transcript_id")
    order = Window.partitionBy("query_id").orderBy("lecture_no", "start_s", "doc_id")
    return placed.withColumn("place", F.row_number().over(order)).select("query_id", "place", "label", "transcript_id", "start_s", "text", "score")


def build_postings(docs: DataFrame) -> DataFrame:
    """token, doc_id, pos for every word of every text, folded."""
    return docs.select("doc_id", F.posexplode(folded_words(F.col("text"))).alias("pos", "token"))


def phrase_hits(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, doc_id, place: where the words of a phrase stand one after another.

    The rarest word of a phrase names the places; only there, and in documents that have such a place, are the other
    words looked up. So frequent words multiply nothing.
    """
    words = phrases.select("query_id", F.posexplode(folded_words(F.col("text"))).alias("i", "token"))
    seen = postings.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    ranked = words.join(seen, "token", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("token", "i"), F.struct(F.coalesce("seen", F.lit(0)), "i")).alias("rare")
    )
    starts = postings.join(ranked.select("query_id", "n", "rare.*"), "token")
    starts = starts.select("query_id", "doc_id", (F.col("pos") - F.col("i")).alias("place"), "n").where("place >= 0")
    wanted = starts.join(words, "query_id").select("query_id", "doc_id", "place", "n", (F.col("place") + F.col("i")).alias("pos"), "token")
    near = postings.join(starts.select("doc_id").distinct(), "doc_id", "left_semi")
    met = wanted.join(near, ["doc_id", "pos", "token"]).groupBy("query_id", "doc_id", "place")
    return met.agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where("found = n").select("query_id", "doc_id", "place")


def phrase_search(postings: DataFrame, phrases: DataFrame, limit: int = 50) -> DataFrame:
    """Documents that hold a phrase, by BM25 of the phrase as one term; ``place`` is the first place. For an index that is there."""
    sizes = postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return _ranked(phrase_hits(postings, phrases), sizes, totals, limit)


def text_hits(docs: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hits of ``phrase_hits`` in texts without an index, and the size of each text in words: (doc_id, dl).

    One pass over the texts says which words of the phrases each has. A second one looks for the rarest word of each phrase
    and compares the words around it, inside the row. Nothing but these hits travels.
    """
    words = folded_words(F.col("text"))
    asked = phrases.select("query_id", folded_words(F.col("text")).alias("__phrase")).where(F.size("__phrase") > 0)
    tokens = materialised(asked.select(F.explode("__phrase").alias("token")).distinct())
    if tokens.limit(WORDS_AT_ONCE + 1).count() > WORDS_AT_ONCE:
        sizes = stored(docs.select("doc_id", F.size(words).alias("dl")))
        return materialised(phrase_hits(stored(build_postings(docs).join(tokens, "token", "left_semi")), phrases)), sizes
    known = F.array(*[F.lit(r.token) for r in tokens.collect()]).cast("array<string>")
    read = docs.select("doc_id", words.alias("__words"))
    sizes = stored(read.select("doc_id", F.size("__words").alias("dl"), F.array_intersect("__words", known).alias("has")))
    seen = sizes.select(F.explode_outer("has").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    placed = asked.select("query_id", "__phrase", F.posexplode("__phrase").alias("i", "token")).join(seen, "token")
    rarest = materialised(placed.groupBy("query_id").agg(F.min_by(F.struct("token", "i", "__phrase"), F.struct("seen", "i")).alias("r")).select("query_id", "r.*"))
    rare = [r.token for r in rarest.select("token").distinct().collect()]
    places = F.filter(F.transform("__words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("pos"), w.alias("token")))), lambda x: x.isNotNull())
    at = read.select("doc_id", "__words", F.explode_outer(places).alias("__at")).where("__at is not null").select("doc_id", "__words", "__at.*")
    start = F.col("pos") - F.col("i")
    met = at.join(sent(rarest), "token").where((start >= 0) & (F.slice("__words", F.greatest(start, F.lit(0)) + 1, F.size("__phrase")) == F.col("__phrase")))
    return materialised(met.select("query_id", "doc_id", start.alias("place"))), sizes.select("doc_id", "dl")


def search_phrases(docs: DataFrame, phrases: DataFrame, limit: int = 50) -> DataFrame:
    """The same over documents without an index."""
    hits, sizes = text_hits(docs, phrases)
    sizes = sizes.where("dl > 0").groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    totals = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return _ranked(hits, sizes, totals, limit)


def _ranked(hits: DataFrame, sizes: DataFrame, totals: DataFrame, limit: int) -> DataFrame:
    tf = hits.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.min("place").alias("place"))
    df = tf.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(df, "query_id").join(sizes, "doc_id").crossJoin(F.broadcast(totals))  # one row of totals
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = joined.select("query_id", "doc_id", "tf", "place", F.round(score, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def snippet(hits: DataFrame, docs: DataFrame, phrases: DataFrame, size: int = 12) -> DataFrame:
    """``size`` words around the first hit (columns query_id, doc_id, place), the phrase in [[ ]], a dot line where words are left out.

    A phrase that is longer than the window is marked up to its end.
    """
    words, at = F.col("__words"), F.col("place") + 1  # places count from 0, slices from 1
    start = F.greatest(F.col("place") - (size // 2 - 1), F.lit(1))
    end = start + size  # the first word behind the window
    some = lambda lo, n: F.array_join(F.slice(words, lo, F.greatest(n, F.lit(0))), " ")
    hit = F.concat(F.lit("[["), some(at, F.least("__n", end - at)), F.lit("]]"))
    parts = [F.nullif(some(start, at - start), F.lit("")), hit, F.nullif(some(at + F.col("__n"), end - at - F.col("__n")), F.lit(""))]
    text = F.concat(F.when(start > 1, "…").otherwise(""), F.concat_ws(" ", *parts), F.when(F.size(words) >= end, "…").otherwise(""))
    n = phrases.select("query_id", F.size(folded_words(F.col("text"))).alias("__n"))
    hits = materialised(hits)
    mine = docs.join(sent(hits.select("doc_id").distinct()), "doc_id", "left_semi")  # so that only their texts travel
    met = hits.join(n, "query_id").join(mine.select("doc_id", folded_words(F.col("text")).alias("__words")), "doc_id")
    return met.select("query_id", "doc_id", text.alias("snippet"))


def hit_time(segments: DataFrame, needle: str) -> DataFrame:
    """Start of the first segment of each lecture that holds the needle, in any case."""
    found = segments.where(F.lower("text").contains(needle.lower()))
    return found.groupBy("project_id", "transcript_id").agg(F.min_by("start_s", "idx").alias("start_s"))


def newest_summaries(summaries: DataFrame) -> DataFrame:
    last = F.struct("id", "title", "created_at")
    return summaries.groupBy("transcript_id").agg(F.max_by(last, last).alias("s")).select("transcript_id", "s.*")


def search_summaries(summaries: DataFrame, needle: str, limit: int = 30) -> DataFrame:
    """Lectures whose newest summary holds the needle, accents and case aside, newest first."""
    at = F.instr(fold(F.col("title")), needle)
    snip = F.substring(F.regexp_replace("title", "[#*`>]", ""), F.greatest(at - 80, F.lit(1)), F.lit(200))
    hit = newest_summaries(summaries).where(at > 0).withColumn("snippet", snip)
    return hit.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("transcript_id", "id", "snippet")


def search(docs: DataFrame, segments: DataFrame, summaries: DataFrame, phrases: DataFrame, limit: int = 10, most_summaries: int = 30) -> DataFrame:
    """Everything that a search finds: query_id, kind, ref_id, score, at, snippet.

    Documents by BM25 with a snippet; lectures where the phrase is said, ``at`` the start of the first such segment; newest
    summaries whose title has the phrase word by word, newest first up to ``most_summaries``.
    """
    columns = ["query_id", "kind", "ref_id", "score", "at", "snippet"]
    found = materialised(search_phrases(docs, phrases, limit))
    shown = found.join(snippet(found, docs, phrases), ["query_id", "doc_id"]).select("query_id", F.lit("document").alias("kind"), F.col("doc_id").alias("ref_id"), "score", F.lit(None).cast("double").alias("at"), "snippet")
    places = lambda table: text_hits(table, phrases)[0]
    said = places(segments.select(F.struct("transcript_id", "idx", "start_s").alias("doc_id"), "text"))
    first = said.groupBy("query_id", "doc_id.transcript_id").agg(F.min_by("doc_id.start_s", "doc_id.idx").alias("at"))
    told = first.select("query_id", F.lit("lecture").alias("kind"), F.col("transcript_id").alias("ref_id"), F.lit(0.0).alias("score"), "at", F.lit(None).cast("string").alias("snippet"))
    newest = newest_summaries(summaries)
    titled = places(newest.select(F.struct("created_at", "id", "transcript_id", "title").alias("doc_id"), F.col("title").alias("text"))).select("query_id", "doc_id").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("doc_id.created_at"), F.desc("doc_id.id"))
    titled = titled.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_summaries)
    named = titled.select("query_id", F.lit("summary").alias("kind"), F.col("doc_id.transcript_id").alias("ref_id"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("at"), F.col("doc_id.title").alias("snippet"))
    return shown.select(*columns).unionByName(told.select(*columns)).unionByName(named.select(*columns))
