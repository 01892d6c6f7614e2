import itertools
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lectorium.llm import reshard


def cost(sizes_by_old, keep):
    """Bytes moved if old shard s keeps its keep[s] largest rows."""
    return sum(sum(sorted(v)[: len(v) - keep[s]]) for s, v in sizes_by_old.items())


def test_fewest_bytes_against_brute_force(spark, documents):
    rng = random.Random(3)
    for n_new, counts in ((3, [7, 1, 0, 5]), (4, [9, 2]), (2, [0, 3, 4]), (3, [5, 5, 5])):
        items, olds = [], []
        for s, n in enumerate(counts):
            for _ in range(n):
                olds.append(s)
                items.append((len(items), "x" * rng.randrange(50)))
        docs = documents(items)
        olds_of = spark.createDataFrame(list(enumerate(olds)), "doc_id long, o int")
        rows = reshard.reshard(docs.join(olds_of, "doc_id"), F.col("o"), n_new).collect()
        assert len(rows) == len(items)
        per = Counter(r.shard for r in rows)
        share, extra = divmod(len(items), n_new)
        assert all(per[t] in (share, share + 1) for t in range(n_new)) and max(per.values()) - min(per[t] for t in range(n_new)) <= 1
        for t in range(n_new):
            assert sorted(r.slot for r in rows if r.shard == t) == list(range(per[t]))
        by_old = {s: [r.size for r in rows if r.old_shard == s] for s in range(len(counts))}
        best = min(
            cost(by_old, {s: min(len(by_old[s]), share + (s in up)) if s < n_new else 0 for s in by_old})
            for up in itertools.combinations(range(n_new), extra)
        )
        assert sum(r.size for r in rows if r.shard != r.old_shard) == best


def test_query_contract(spark, documents):
    docs = documents([(1, None), (1, None), (2, "é"), (None, "é"), (5, "")] + [(i, "same") for i in range(100, 160)]).selectExpr("*", "1 as shard", "2 as slot")
    rows = reshard.reshard_query(docs, 7).collect()
    per = Counter(r.shard for r in rows)
    assert len(rows) == 65 and max(per.values()) - min(per.values()) == 1 and set(per) == set(range(7))
    for r in rows:
        if r.doc_id == 1:
            assert (r.size, r.text_crc32) == (16, 0)
        if r.doc_id == 2:
            assert (r.size, r.text_crc32) == (18, zlib.crc32("é".encode()))
    assert reshard.reshard_query(documents([])).count() == 0
    long = reshard.reshard_query(documents([(1, "x" * 3_000_000), (2, "y")]), 2).collect()
    assert {(r.doc_id, r.size) for r in long} == {(1, 3_000_016), (2, 17)} and {r.shard for r in long} == {0, 1}


def test_only_affected_files_are_written(spark, documents, tmp_path):
    items = [(i, f"text {i}") for i in range(11)]
    docs = documents(items).withColumn("o", F.when(F.col("doc_id") < 3, 0).when(F.col("doc_id") < 6, 1).when(F.col("doc_id") < 11, 2))
    placed = reshard.reshard(docs, F.col("o"), 4)
    numbers = reshard.rewrite_affected(docs.drop("o"), placed, str(tmp_path / "out"))
    assert numbers == [2, 3]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {2: 3, 3: 2}
    reshard.rewrite_affected(docs.drop("o"), placed, str(tmp_path / "runs"), file_rows=2)
    files = list((tmp_path / "runs").glob("shard=*/*.parquet"))
    assert sorted(spark.read.parquet(str(f)).count() for f in files) == [1, 2, 2]
    slots = placed.select("doc_id", "slot")
    for f in files:  # a file is one run of slots
        assert len({r.slot // 2 for r in spark.read.parquet(str(f)).select("doc_id").join(slots, "doc_id").collect()}) == 1
