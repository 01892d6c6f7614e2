"""The data source against the batch operator, as a stream, and its exports."""

import os

import pytest
from pyspark.sql import functions as F

from lectorium.operators.timed import scan_timed_text
from lectorium.sources import readers
from lectorium.sources.timed_text import LectureFiles
from lectorium.streaming import streams

FILES = {
    "a.txt": "[00:05] one\n[00:09] two\nmore of two\n\n[01:00:00] three",
    "b.txt": "before\nalso before\n[1:05] first\n  [1:07]   \nlast  ",
    "deep/c.txt": "no time\nat all\r\n  \n",
    "d.txt": "",
    "e.txt": "[00:10] back\r\n[00:03] in time\n[x:00] no stamp é漢🙂\n",
    ".hidden": "[00:01] hidden",
    "_draft-x/f.txt": "[00:01] draft",
}


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(LectureFiles)
    return lay(tmp_path / "lectures", FILES)


def lay(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    return str(root)


def rows_of(df, folder):
    return sorted((r.path.removeprefix(folder + "/"), r.idx, r.start, r.end, r.text, r.offset, r.ts) for r in df.collect())


def wanted(spark, files):
    table = spark.createDataFrame([(n, t) for n, t in files.items() if not n.startswith((".", "_"))], "path string, value string")
    return rows_of(scan_timed_text(table), "-")


def test_a_folder_gives_what_the_operator_gives(spark, folder):
    assert rows_of(spark.read.format("lecture_files").load(folder), folder) == wanted(spark, FILES)
    assert spark.read.format("lecture_files").load(folder + "/none").collect() == []


def test_arriving_files_are_read_once(spark, folder, tmp_path):
    run = str(tmp_path / "run")
    stream = lambda: spark.readStream.format("lecture_files").load(folder)
    streams.append(stream(), run)
    late = {"g.txt": "[00:02] new\n", "deep/h.txt": "[00:03] new too"}
    lay(tmp_path / "lectures", late)
    streams.append(stream(), run)
    streams.append(stream(), run)
    assert rows_of(spark.read.parquet(f"{run}/rows"), folder) == wanted(spark, FILES | late)


EXPORTS = [(f"course {i % 2}/lecture {i}/transcript.md", f"text {i} é" if i else None) for i in range(12)]


def read_back(root):
    return sorted((os.path.relpath(os.path.join(d, n), root), open(os.path.join(d, n), encoding="utf-8").read()) for d, _, ns in os.walk(root) for n in ns)


def test_an_export_replaces_the_last_one_whole(spark, folder, tmp_path):
    target = str(tmp_path / "out" / "dump")
    save = lambda rows, mode: spark.createDataFrame(rows, "path string, content string").repartition(3).write.format("lecture_files").mode(mode).save(target)
    save([("old.md", "old")], "append")
    save(EXPORTS, "overwrite")
    assert read_back(target) == sorted((p, c or "") for p, c in EXPORTS)
    with pytest.raises(Exception, match="is there already"):
        save([("more.md", "x")], "append")
    assert read_back(target) == sorted((p, c or "") for p, c in EXPORTS) and os.listdir(tmp_path / "out") == ["dump"]


def test_a_failed_task_leaves_no_part(spark, folder, tmp_path):
    target = str(tmp_path / "out" / "dump")
    rows = spark.createDataFrame(EXPORTS, "path string, content string").repartition(4)
    broken = rows.withColumn("content", F.when(F.col("path").contains("lecture 7"), F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("lecture_files").mode("append").save(target)
    outside = spark.createDataFrame([("ok.md", "x"), ("../evil.md", "x")], "path string, content string")
    with pytest.raises(Exception, match="outside the export"):
        outside.write.format("lecture_files").mode("append").save(target)
    # a task that was still writing when the others were given up may leave a hidden draft
    assert all(n.startswith("_draft-") for n in os.listdir(tmp_path / "out")) if os.path.exists(tmp_path / "out") else True
    assert not os.path.exists(target)


def test_media_are_listed_from_folders_files_and_patterns(spark, tmp_path):
    root = lay(tmp_path / "media", {"a.mp3": "12345", "b/c.MP4": "1", "b/d.txt": "1", "e.tmp.mp3": "1", "~f.mp3": "1", "b/g.mp3.part": "1"})
    names = lambda places: sorted((r.name, r.ext, r["size"]) for r in readers.scan_media_inventory(spark, places, ["mp3", "mp4"]).collect())
    both = [("a.mp3", "mp3", 5), ("c.MP4", "mp4", 1)]
    assert names(root) == both and names([root, f"{root}/a.mp3"]) == both  # each once
    assert names([f"{root}/*.mp3"]) == both[:1]
    usage = {r.ext: (r.bytes, r.files) for r in readers.storage_usage(readers.scan_media_inventory(spark, root, ["mp3", "mp4"])).collect()}
    assert usage == {"mp3": (5, 1), "mp4": (1, 1)}
