"""Shared pieces: the word class, the tokenizer files, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else, on UTF-8 bytes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Splitting patterns whose matches end at every place of `PLACE`.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The character before a stable place: any but white space before an ASCII blank, or an ideograph, kana or
#: Hangul syllable before full-width punctuation. In both patterns no match holds white space after
#: another character, nor a letter and then punctuation; neither looks back, and only runs of white
#: space look ahead. So matches on either side don't depend on each other, in any script.
PLACE = re.compile("\\S(?=[ \t\n\r])|[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3](?=[。、，！？；：])")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; PUBLIC_TOKENIZERS may name another folder."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def unused(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores after it as make it none of `taken`."""
    others = {x.lower() for x in taken}
    while name.lower() in others:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local master, as in tests, may leave it unset; then it is a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints/loomfield"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker, which later tasks use again, gives free memory back to the system at the end."""

    @functools.wraps(run)
    def until_done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks otherwise
            if trim:
                trim(0)

    return until_done


class Workspace:
    """Tables written once to the shared folder and read back, which cuts lineage and survives lost executors.

    `drop` deletes what no later step reads. What a result still reads stays until the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path, files = self._file(self.root)
        files.deleteOnExit(path)

    def _file(self, place: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._file(f"{self.root}/{name}")
            files.delete(path, True)
