"""JSON, media and task inputs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.errors import EngineError
from loomfield.functions import text as T
from loomfield.operators.scorecard import NESTED

MEDIA = ("mp3", "m4a", "qta")


def scorecards(spark: SparkSession, *paths: str) -> DataFrame:
    """skill (file name without extension) and groups."""
    raw = spark.read.text(list(paths), wholetext=True)
    return raw.select(T.path_stem(F.input_file_name()).alias("skill"), F.from_json("value", NESTED).alias("groups"))


def media(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem, extension, length, modificationTime of the audio files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return files.withColumns({"stem": T.path_stem(F.col("path")), "extension": F.ltrim(T.path_extension(F.col("path")), F.lit("."))}).where(F.col("extension").isin(*MEDIA))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of transcript_*.md and transcript-*.md with a leading [HH:MM:SS] and speaker where they have one."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter="transcript[-_]*.md").select(F.input_file_name().alias("doc"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    pattern = r"^\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?\s*([^:]{1,60}):\s*(.*)$"
    part = lambda k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    return whole.select("doc", (F.col("i") + 1).alias("line_no"), T.seconds_of(part(1)).alias("second"), part(2).alias("speaker"), F.coalesce(part(3), F.col("line")).alias("said"))


def phase_files(spark: SparkSession, folder: str, prefix: str = "extracted") -> DataFrame:
    """doc, phase (slug of the file's name), value of `<prefix>-<phase>.md`."""
    whole = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{prefix}-*.md")
    return whole.select(F.input_file_name().alias("doc"), F.regexp_replace(T.path_stem(F.input_file_name()), f"^{prefix}-", "").alias("phase"), "value")


def task(text: str) -> dict:
    """A JSON task input; paths and a project name."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise EngineError("INVALID_INPUT", str(e)) from e
    if not isinstance(found, dict) or any(not found.get(k) for k in ("insights_path", "transcript_path", "output_dir")):
        raise EngineError("INVALID_INPUT", "insights_path, transcript_path and output_dir are needed")
    return {"project_name": os.path.basename(str(found["output_dir"]).rstrip("/")), **found}
