"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-token lengths, counted on a bounded sample of the
documents and broadcast; tier two is a cache in each worker, filled by encoding misses. The sample
only decides what is looked up first: a miss is encoded, so counts are exact for every row.
No pre-token is ever shuffled.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import columns_of, map_batches, read

#: Bounds of tier one: about so many sampled documents, entries kept.
SAMPLE_DOCS, FREQUENT = 1_000, 20_000

_encoders: dict[tuple, bpe.CountEncoder] = {}


def frequent_lengths(docs: DataFrame, folder: str, text: str = "text") -> tuple[bytes, bytes]:
    """Tier one as (pre-tokens joined by line ends, one length byte each).

    At most SAMPLE_DOCS whole texts reach the driver, a partition at a time.
    """
    total = docs.count()
    share = max(1, -(-total // SAMPLE_DOCS))
    rows = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(share)) == 0).select(F.col(text).alias("text")).limit(SAMPLE_DOCS)
    counts: Counter[str] = Counter()
    for row in rows.toLocalIterator():
        counts.update((bpe.split(row.text or "") or [""])[1:])
    encode = bpe.piece_library(folder).encode_ordinary
    kept = [(p, len(encode(" " + p))) for p, _ in counts.most_common(FREQUENT) if "\n" not in p and len(p) <= bpe.LONGEST_KEPT]
    kept = [(p, n) for p, n in kept if n < 256]
    return "\n".join(p for p, _ in kept).encode(), bytes(n for _, n in kept)


def encoder(folder: str, table: tuple[bytes, bytes]) -> bpe.CountEncoder:
    """The worker's encoder for a broadcast table; made once per process and table."""
    key = (folder, hash(table))
    if key not in _encoders:
        _encoders.clear()
        names, lengths = table
        _encoders[key] = bpe.CountEncoder(folder, dict(zip(names.decode().split("\n"), lengths)) if lengths else {})
    return _encoders[key]


def token_counts(docs: DataFrame, *, folder: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null text counts as empty (0 bytes, 0 tokens); null and repeated keys and repeated rows pass
    through row by row; other columns are not read; an empty table gives no rows.
    """
    folder = folder or bpe.default_dir()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, folder, text))

    def count(batch: pa.RecordBatch) -> dict:
        keys, texts = columns_of(batch, "k", "t")
        encode = encoder(folder, table.value)
        n = [encode(t) if t else 0 for t in texts]
        return {"k": keys, "b": [len(t.encode()) if t else 0 for t in texts], "n": n, "o": [x > limit for x in n]}

    kind = rows.schema["k"].dataType.simpleString()
    return map_batches(rows, count, f"k {kind}, b long, n long, o boolean").toDF(key, "n_bytes", "n_tokens", "over_limit")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document: ``token_counts`` at its production parameters."""
    return token_counts(read(spark, sf_dir, "documents"))
