"""Balanced label propagation: documents to shards of equal counts, equal texts together.

Native: DataFrame operations only. Linked documents - those of equal text - form units; a unit that
is too large for a shard is dealt into several. Documents start in the shard of their id's hash. In
each round a unit's members vote, every member wants to move to the shard that most of them hold,
and a shard admits as many units as its free quota allows. A last pass makes counts exact: the
places after a shard's quota - single documents stand there - move on to shards with room.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import counted_join, read, staged

SHARDS, ROUNDS = 16, 3
#: Largest unit as a share of a shard's quota, and rows that one ranking task sorts, about.
UNIT_SHARE, CELL_ROWS = 8, 50_000


def _fraction(*columns) -> F.Column:
    """A hash of columns in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def units(docs: DataFrame, quota: int, shards: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, unit (a number equal for the members), single, label (the first shard)."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("same"),
    )
    # a row's place in the staged files tells rows apart whose ids are null or repeat; files do not change
    rows = staged(rows, "rows")
    rows = rows.withColumn("place", F.xxhash64("doc_id", "_metadata.file_name", "_metadata.row_index"))
    # a text of very many rows is joined by broadcast, so that no task gets all of them
    counts = rows.groupBy("same").agg(F.count(F.lit(1)).alias("n"))
    most = max(1, quota // UNIT_SHARE)
    joined = counted_join(rows, counts, "same", quota * shards)
    deal = F.pmod(F.xxhash64("place", F.lit(7)), F.ceil(F.col("n") / most))
    return joined.select("doc_id", "size", "text_crc32", F.xxhash64("same", deal).alias("unit"), (F.col("n") == 1).alias("single"), F.pmod(F.xxhash64("place", F.lit(1)), F.lit(shards)).cast("int").alias("label"))


def propagated(rows: DataFrame, quota: int, shards: int, turn: int) -> DataFrame:
    """One round: votes, wishes, admission under the quotas. The driver holds two numbers per shard."""
    linked = rows.where(~F.col("single"))
    votes = linked.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n"))
    wishes = votes.groupBy("unit").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("wish"), (F.sum("n") - F.max("n")).alias("movers")).where("movers > 0")
    wishes = staged(wishes, "wishes")
    asked = {r["wish"]: r["n"] for r in wishes.groupBy("wish").agg(F.sum("movers").alias("n")).collect()}
    if not asked:
        return rows
    # single documents give way in the last pass, so a shard admits up to its quota of linked ones
    bound = {r["label"]: r["n"] for r in linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = {s: min(1.0, max(0, quota - bound.get(s, 0)) / n) for s, n in asked.items()}
    share = F.create_map(*[F.lit(x) for pair in sorted(chance.items()) for x in pair])
    admitted = wishes.where(_fraction("unit", F.lit(turn)) < share[F.col("wish")]).select("unit", "wish")
    return rows.join(admitted, "unit", "left").withColumn("label", F.coalesce("wish", "label")).drop("wish")


def exact(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Adds shard and slot: counts differ by one at most, slots are 0, 1, ... in each shard.

    Ranks are two-level: counts per (label, cell) are summed up to each cell's first rank, then rows
    are ranked inside their cell. Cells follow linked units first, single documents last.
    """
    cells = max(1, -(-total // (CELL_ROWS * shards)))
    salt = F.when(F.col("single"), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(cells)) + cells).otherwise(F.pmod(F.xxhash64("unit", F.lit(2)), F.lit(cells)))
    rows = rows.withColumn("cell", salt)
    counts = rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("label", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("label", "cell").orderBy("unit", "doc_id", "size")
    ranked = rows.withColumn("nth", F.row_number().over(inside) - 1).join(firsts, ["label", "cell"]).withColumn("nth", F.col("nth") + F.col("first"))
    held = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    low, more = divmod(total, shards)
    # the fullest shards take the odd documents, so that fewest move
    order = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))
    quota = {s: low + (i < more) for i, s in enumerate(order)}
    over, passed = [], 0
    for s in range(shards):
        over.append((s, quota[s], passed))
        passed += max(0, held.get(s, 0) - quota[s])
    room, at = [], 0
    for s in range(shards):
        if (free := quota[s] - held.get(s, 0)) > 0:
            room.append((at, s, held.get(s, 0)))
            at += free
    own = F.create_map(*[F.lit(x) for s, q, _ in over for x in (s, q)])
    base = F.create_map(*[F.lit(x) for s, _, b in over for x in (s, b)])
    extra = F.col("nth") - own[F.col("label")] + base[F.col("label")]
    shard, slot = F.col("label"), F.col("nth")
    stays = F.col("nth") < own[F.col("label")]
    moved_shard, moved_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for first, s, taken in room:  # later rooms start higher, and win
        moved_shard = F.when(extra >= first, F.lit(s)).otherwise(moved_shard)
        moved_slot = F.when(extra >= first, extra - first + taken).otherwise(moved_slot)
    return ranked.select("doc_id", "size", "text_crc32", F.when(stays, shard).otherwise(moved_shard).cast("int").alias("shard"), F.when(stays, slot).otherwise(moved_slot).cast("long").alias("slot"))


def sharded(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null under this law).

    Counts differ by one at most. Null text has size 1 and the checksum of no bytes; null and
    repeated ids and repeated rows each take a place of their own; an empty table gives no rows.
    """
    total = docs.count()
    quota = -(-total // shards)
    rows = staged(units(docs, quota, shards, key=key, text=text), "units")
    for turn in range(rounds):
        after = propagated(rows, quota, shards, turn)
        if after is rows:
            break
        rows = staged(after, "labels")
    placed = exact(rows, total, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards under the law ``rows``: ``sharded`` at its production parameters."""
    return sharded(read(spark, sf_dir, "documents"))
