"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every document is repeated k times, where k inverts a Poisson distribution whose mean is the repetition rate of
its source, at a uniform number hashed from the seed and the document's id. A rate above ``LARGEST_MEAN``, whose
probabilities would leave the range of doubles, is a sum of equal Poisson draws, each at its own hash. The copies are then dealt to
partitions by a second hash and sorted by it: a global shuffle in one pass, reproducible at any parallelism.

Weights and rates of any size count: they are kept to thirteen significant digits, so engines that add up in another
order draw alike.

Defined results: a null source is a source of its own; rows that share an id share its draw; a row without one is named
by a hash of all its columns, so only equal rows share a draw. A source whose weight is zero gets no copies. Extra columns pass through; ``rate``, ``copy``
and ``shuffle_key`` of the input are replaced. Texts are never looked at, so null, empty and very long ones are alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

#: Sources beyond which the table of rates is no longer broadcast.
BROADCAST_SOURCES = 10_000
BITS = 52
#: Mean up to which a number of copies is drawn at once.
LARGEST_MEAN = 500


def hashed_bits(*parts: Column, bits: int = BITS) -> Column:
    """The first bits of an MD5 as a long: the same number in every SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def significant(x: Column) -> Column:
    """To thirteen significant digits; null stays null."""
    return F.when(x.isNotNull(), F.format_string("%.12e", x).cast("double"))


def named(columns: list[str]) -> Column:
    """The id as text; where it is null, a hash of the row."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns])
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.md5(row)))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: its rows, its target share and the mean number of copies that reaches it.

    weights: target share by source (they need not sum to 1; sources that are not named get none). Without
    weights a source's share is its row count to the power ``flatten``: 1 keeps the mixture, 0 makes it uniform.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        wish = F.pow(F.col("n_docs").cast("double"), F.lit(float(flatten)))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        wish = F.coalesce(given[F.col("source")], F.lit(0.0)) if given is not None else F.lit(0.0)
    sizes = sizes.withColumn("wish", significant(wish))
    total = sizes.agg(F.sum("n_docs").alias("all_docs"), F.sum("wish").alias("all_wish"))
    # one row of totals: the only product here is with a single row
    rate = significant(epochs * (F.col("wish") / F.nullif(F.col("all_wish"), F.lit(0.0))) * (F.col("all_docs") / F.col("n_docs")))
    return sizes.crossJoin(F.broadcast(total)).select("source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies, up to where the rest is below 2**-52."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 25).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("cs"))
    grown = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct(
            (a["p"] * rate / k).alias("p"),
            (a["c"] + a["p"] * rate / k).alias("c"),
            F.concat(a["cs"], F.array(a["c"] + a["p"] * rate / k)).alias("cs"),
        ),
    )
    return grown["cs"]


def poisson_parts(rate: Column) -> Column:
    """Number of independent draws of equal mean, ``LARGEST_MEAN`` at most, whose sum has the rate as its mean."""
    return F.greatest(F.lit(1), F.ceil(rate / LARGEST_MEAN).cast("int"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Every document ``copy`` = 1..k times, in a global order by ``shuffle_key`` within hash partitions."""
    rest = [c for c in docs.columns if c not in ("rate", "copy", "shuffle_key")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    parts = poisson_parts(F.col("rate"))
    rates = repetition_rates(docs, weights, flatten, epochs).select(
        F.col("source").alias("__source"), "rate", parts.alias("__parts"), poisson_steps(F.col("rate") / parts).alias("__steps")
    )
    # counting the sources costs a scan of one column and proves the size of what is broadcast
    rates = broadcast_if_small(rates, docs.select("source").distinct().count(), BROADCAST_SOURCES)
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("__source")))
    draw = lambda *key: F.size(F.filter("__steps", lambda c: c <= hashed_bits(F.lit(seed), *key) / F.lit(float(2**BITS))))
    first = draw(F.col("__name"))
    others = F.aggregate(F.sequence(F.lit(2), F.col("__parts")), F.lit(0), lambda n, i: n + draw(F.lit("draw"), i, F.col("__name")))
    copies = F.when(F.col("__parts") > 1, first + others).when(F.col("rate") > 0, first).otherwise(0)
    drawn = joined.withColumn("__name", named(rest)).withColumn("__n", copies).where("__n > 0")
    out = drawn.select(*[F.col(f"`{c}`") for c in rest], "rate", "__name", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    out = out.withColumn("shuffle_key", hashed_bits(F.lit(seed), F.lit("order"), F.col("__name"), F.col("copy"))).drop("__name")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "lang", "text"))


SQL = """
WITH sizes AS (SELECT source, count(*) AS n_docs, CAST(printf('%.12e', pow(CAST(count(*) AS DOUBLE), 0.5)) AS DOUBLE) AS wish FROM documents GROUP BY source),
total AS (SELECT sum(n_docs) AS all_docs, sum(wish) AS all_wish FROM sizes),
rates AS (SELECT *, CAST(greatest(1, ceil(rate / 500)) AS BIGINT) AS parts
  FROM (SELECT source, CAST(printf('%.12e', (wish / all_wish) * (CAST(all_docs AS DOUBLE) / n_docs)) AS DOUBLE) AS rate FROM sizes, total)),
pmf AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p
  FROM (SELECT source, rate / parts AS mean, unnest(range(0, CAST(ceil(rate / parts + 10 * sqrt(rate / parts) + 25) AS BIGINT) + 1)) AS k FROM rates WHERE rate > 0)),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
named AS (SELECT *, row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), 'row ' || md5(concat_ws(chr(31), chr(0), coalesce(source, chr(0)), coalesce(lang, chr(0)), coalesce(text, chr(0))))) AS name FROM documents),
tries AS (SELECT r.rate, d.r, doc_id, d.source, lang, text, name, unnest(range(1, parts + 1)) AS i
  FROM named d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT r, doc_id, t.source, lang, text, rate, name, count(*) AS n FROM tries t JOIN steps s ON t.source IS NOT DISTINCT FROM s.source
    AND s.c <= CAST(concat('0x', substr(md5(CASE WHEN i = 1 THEN concat_ws(':', 'mix-1', name) ELSE concat_ws(':', 'mix-1', 'draw', CAST(i AS VARCHAR), name) END), 1, 13)) AS BIGINT) / 4503599627370496.0
  GROUP BY ALL),
copies AS (SELECT doc_id, source, lang, text, rate, name, unnest(range(1, n + 1)) AS copy FROM drawn)
SELECT doc_id, source, lang, text, rate, CAST(copy AS INTEGER) AS copy,
  CAST(concat('0x', substr(md5(concat_ws(':', 'mix-1', 'order', name, CAST(copy AS VARCHAR))), 1, 13)) AS BIGINT) AS shuffle_key
FROM copies"""
