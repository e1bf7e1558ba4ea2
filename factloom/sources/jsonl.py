"""Tagged JSON lines: canonical export, sharded export, tolerant import, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TABLES


def rendered(df: DataFrame, table: str, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """One canonical JSON line a row: ``_table`` and the columns by name, nulls written."""
    fields = [F.lit(table).alias("_table"), *[F.col(c) for c in sorted(columns)]]
    return df.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def shard_of(ident, length: int = 2):
    """Leading characters of an id's last twelve."""
    return F.substring(F.substring(ident, -12, 12), 1, length)


def sharded_lines(df: DataFrame, table: str, owner: str = "id", length: int = 2) -> DataFrame:
    """shard, line: rows follow their owner's shard."""
    return rendered(df.withColumn("shard", shard_of(F.col(owner), length)), table, df.columns, keep=["shard"])


def export_sharded(df: DataFrame, table: str, path: str, owner: str = "id", only: DataFrame | None = None) -> None:
    """Lines in one folder per shard, sorted in each file; with ``only`` (shard) no other shard is written anew."""
    lines = sharded_lines(df, table, owner)
    lines = lines.join(F.broadcast(only.select("shard").distinct()), "shard", "left_semi") if only is not None else lines  # 256 shards at most
    writer = lines.repartition("shard").sortWithinPartitions("shard", "line").write.partitionBy("shard").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").text(path)


def changed_shards(ours: DataFrame, written: DataFrame) -> DataFrame:
    """Shards (shard, line) whose content differs from what is written already."""
    def digest(df: DataFrame) -> DataFrame:
        # sums of two hashes: no list of all of a shard's lines
        each = df.select("shard", F.xxhash64("line").cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), "line").cast("decimal(38,0)").alias("b"))
        return each.groupBy("shard").agg(F.struct(F.count(F.lit(1)), F.sum("a"), F.sum("b")).cast("string").alias("digest"))

    return digest(ours).join(digest(written), ["shard", "digest"], "left_anti").select("shard")


def tables_of(lines: DataFrame, schemas: dict) -> dict[str, DataFrame]:
    """Tables by name from tagged lines (column value): unknown tables and broken lines are left out. A line is
    kept as often as it stands there; what shares a key is for the merge to settle."""
    tag = F.get_json_object("value", "$._table")
    plain = {name: s if isinstance(s, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s) for name, s in schemas.items()}
    broken = {name: F.from_json("value", f"{s}, _broken string", {"columnNameOfCorruptRecord": "_broken"}) for name, s in plain.items()}
    return {name: lines.where(tag == name).select(r.alias("r")).where("r._broken is null").select("r.*").drop("_broken") for name, r in broken.items()}


def import_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by name from tagged lines under a path."""
    return tables_of(spark.read.text(path, recursiveFileLookup=True), TABLES)


def export_ordered(lines: DataFrame, path: str) -> None:
    """One text file of rendered rows (table, key, line), ordered by table and key: equal content, equal bytes."""
    lines.orderBy("table", "key", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


#: Sources of a prompt that a person typed; left out stands for the empty one (fixed values).
TYPED = ("typed", "queued", "")
TRANSCRIPT = "type string, isSidechain boolean, promptSource string, sessionId string, message struct<role:string, content:string>"


def transcript_messages(lines: DataFrame, allowed: tuple[str, ...] = TYPED) -> DataFrame:
    """session_id, text of user messages from lines (value): no side chains, sources that a person typed, broken
    lines dropped. Content may be a string or a list of blocks, of which the text ones are joined by spaces.
    Works on batch and streaming frames."""
    row = F.from_json("value", TRANSCRIPT)
    source = F.coalesce("r.promptSource", F.when(F.get_json_object("value", "$.promptSource").isNull(), F.lit("")))
    kept = lines.select("value", row.alias("r")).where((F.col("r.type") == "user") & ~F.coalesce("r.isSidechain", F.lit(False)) & source.isin(*allowed))
    content = F.col("r.message.content")
    blocks = F.from_json(content, "array<struct<type:string, text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    text = F.when(content.startswith("[") & blocks.isNotNull(), joined).otherwise(content)
    return kept.select(F.col("r.sessionId").alias("session_id"), text.alias("text")).where(F.col("text").rlike(r"\S"))


def hook_payload(lines: DataFrame, fields: str = "session_id string, hook_event_name string, cwd string, prompt string, transcript_path string") -> DataFrame:
    """Fields of event payloads (value); a payload that is no object gives nulls, never an error."""
    return lines.select(F.from_json("value", fields).alias("r")).select("r.*")


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, found by an aggregate that combines before the shuffle."""
    columns = df.columns
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__r"))
    return picked.select("__r.*").select(*columns)
