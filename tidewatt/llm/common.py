"""Reading of the corpus tables and small helpers that several operators use."""

from __future__ import annotations

import hashlib
import zlib

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty); other columns never meet an operator's own names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; no text has no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def crc32_bytes(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a worker holds few texts at a time."""
    pa.default_memory_pool().release_unused()  # what earlier tasks of this worker have left
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
