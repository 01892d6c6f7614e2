"""Reading: segments in JSON, media inventories, model responses."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:double,end:double,text:string>>"
MEDIA = ["mp3", "mp4", "m4a", "wav", "webm", "ogg", "flac", "mkv", "mov", "aac", "opus"]


def scan_segments_json(transcripts: DataFrame) -> DataFrame:
    """One row per segment of a JSON column; JSON that cannot be read gives none."""
    parsed = F.from_json("segments", SEGMENTS, {"mode": "PERMISSIVE"})
    return transcripts.select("transcript_id", F.posexplode(F.coalesce(parsed, F.array().cast(SEGMENTS))).alias("idx", "s")).select("transcript_id", "idx", "s.start", "s.end", "s.text")


def scan_media_inventory(spark: SparkSession, places: str | list[str], extensions: list[str] | None = None) -> DataFrame:
    """Files of folders (with all below), single files or patterns by extension, without reading them; each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
    return inventory(files.select("path", "length"), extensions)


def inventory(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """path, name, ext, size of a listing (path, length), each path once; temporary names are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), F.col("length").alias("size"))
    rows = rows.where(~F.col("name").rlike(r"^(\.|~)|\.(tmp|part)(\.|$)"))
    return rows.where(F.col("ext").isin(MEDIA if extensions is None else extensions)).dropDuplicates(["path"])


def storage_usage(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("ext").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def first_json(text: str | None):
    """The first balanced JSON object or array of objects in a text, with or without a fence before it."""
    text, decoder = text or "", json.JSONDecoder()
    for i, c in enumerate(text):
        if c in "{[":
            try:
                value = decoder.raw_decode(text[i:])[0]
            except ValueError:
                continue
            if isinstance(value, dict) or isinstance(value, list) and any(isinstance(x, dict) for x in value):
                return value
    return None


def records(value) -> list[dict]:
    """The records of a response: under ``cards``, a bare array, or a single one that has a front."""
    if isinstance(value, dict):
        value = value["cards"] if isinstance(value.get("cards"), list) else [value] if value.get("front") else []
    return [x for x in value or [] if isinstance(x, dict)]


def scan_model_responses(responses: DataFrame) -> DataFrame:
    """id, pos, front, back, ok for every record of a response (id, content); a response without one has one row, not ok.

    A clean object goes through the JVM's parser; only what that cannot read goes to Python.
    """
    card = "struct<cards:array<struct<front:string,back:string>>>"
    fenced = F.regexp_extract("content", r"(?s)\A\s*(?:```(?:json)?\s*)?(\{.*\})\s*(?:```)?\s*\z", 1)
    tried = responses.select("id", "content", F.from_json(F.nullif(fenced, F.lit("")), card, {"mode": "PERMISSIVE"})["cards"].alias("cards"))
    fast = tried.where("cards is not null").select("id", F.posexplode("cards").alias("pos", "c")).select("id", "pos", "c.front", "c.back", F.lit(True).alias("ok"))

    def recover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, content in zip(f["id"], f["content"], strict=True):
                found = records(first_json(content))
                rows += [(i, n, x.get("front"), x.get("back"), True) for n, x in enumerate(found)] or [(i, 0, None, None, False)]
            yield pd.DataFrame(rows, columns=["id", "pos", "front", "back", "ok"])

    slow = tried.where("cards is null").select("id", "content").mapInPandas(recover, "id long, pos int, front string, back string, ok boolean")
    return fast.unionByName(slow)
