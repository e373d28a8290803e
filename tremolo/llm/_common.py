"""Shared pieces: hash folds, byte-bounded batches, tokens, table access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus).cast("int")


def folded(doc_id: Column, modulus: int, remainder: int) -> Column:
    return fold(doc_id, modulus) == remainder


def parts(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, one row at least, so
    that memory follows the longest text and not the batch."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(texts.cast(pa.large_binary()))
        ends = np.cumsum(np.asarray(sizes.fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + size, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8; a null
    text has none.  ``bytes.split`` cuts at exactly these six characters and
    ``bytes.lower`` changes exactly these 26 letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word → 64-bit hash, kept up to a bound; a pure function of the word."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
