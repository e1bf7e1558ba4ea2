"""Best-fit packing by patterns: non-negative least squares over the length histogram.

1. Documents become token pieces of at most ``size`` (executors).
2. The histogram of piece lengths - at most ``size`` numbers - goes to the driver.
3. Patterns of one to three lengths that fill a sequence exactly get repeat counts by
   non-negative least squares; counts are rounded, and what is left over is packed best-fit
   decreasing, on the histogram, with groups of equal sequences as the unit.
4. Pieces of one length are interchangeable: each gets a rank among its equals, by a two-level
   count over (length, salt) cells, and the rank names its place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import columns_of, map_batches, read, staged

SIZE = 2048
#: Rows of a (length, salt) cell that one window task sorts, about.
CELL_ROWS = 50_000
ROUNDS = 120

Group = tuple[tuple[int, ...], int]


def exact_patterns(present: np.ndarray, size: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0 with a + b + c = size and every length > 0 present."""
    lengths = np.flatnonzero(present)
    lengths = lengths[(lengths > 0) & (lengths < size)].astype(np.int32)
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = size - a - b
    fits = (a >= b) & (c >= 0) & (c <= b)
    a, b, c = a[fits], b[fits], c[fits]
    fits = (c == 0) | present[c]
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def fitted_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|^2, by multiplicative updates (A is never built)."""
    goal = histogram.astype(float)
    goal[0] = 0.0

    def gather(values: np.ndarray) -> np.ndarray:
        return values[patterns[:, 0]] + values[patterns[:, 1]] + values[patterns[:, 2]]

    def scatter(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, i], x, len(goal)) for i in range(3))
        out[0] = 0.0
        return out

    pull = gather(goal)
    x = pull / max(1, len(patterns))
    for _ in range(rounds):
        x = x * pull / np.maximum(gather(scatter(x)), 1e-12)
    return x


def best_fit(histogram: np.ndarray, size: int) -> list[Group]:
    """Best-fit decreasing where equal sequences are one group; the work follows lengths, not pieces."""
    room: dict[int, list[list]] = {}
    open_rooms: list[int] = []
    done: list[Group] = []

    def put(pattern: tuple[int, ...], n: int, left: int) -> None:
        if left == 0:
            done.append((pattern, n))
            return
        if left not in room:
            room[left] = []
            insort(open_rooms, left)
        room[left].append([pattern, n])

    for length in np.flatnonzero(histogram)[::-1].tolist():
        left_over = int(histogram[length])
        while left_over and (i := bisect_left(open_rooms, length)) < len(open_rooms):
            space = open_rooms[i]
            pattern, n = room[space][-1]
            used = min(n, left_over)
            if used == n:
                room[space].pop()
                if not room[space]:
                    del room[space]
                    open_rooms.pop(i)
            else:
                room[space][-1][1] -= used
            put((*pattern, length), used, space - length)
            left_over -= used
        each = size // length
        full, rest = divmod(left_over, each)
        if full:
            put((length,) * each, full, size - length * each)
        if rest:
            put((length,) * rest, 1, size - length * rest)
    return done + [(tuple(p), n) for groups in room.values() for p, n in groups]


def plan(histogram: np.ndarray, size: int = SIZE) -> list[Group]:
    """Groups (lengths of a sequence, how many such sequences) that hold the whole histogram."""
    left = histogram.astype(np.int64).copy()
    groups: list[Group] = []
    if left[size]:
        groups.append(((size,), int(left[size])))
        left[size] = 0
    patterns = exact_patterns(left > 0, size)
    if len(patterns):
        wanted = fitted_counts(patterns, left)
        for i in np.argsort(-wanted, kind="stable"):
            n = int(wanted[i] + 0.5)
            if not n:
                break
            lengths = [int(x) for x in patterns[i] if x]
            n = min(n, *(int(left[x]) // lengths.count(x) for x in lengths))
            if n > 0:
                groups.append((tuple(lengths), n))
                for x in lengths:
                    left[x] -= n
    return groups + best_fit(left, size)


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """Intervals of ranks by length: sorted key (length << 40 | first rank), first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in groups:
        offset = 0
        for x in lengths:
            first = taken.get(x, 0)
            rows.append(((x << 40) | first, sequence - first, offset))
            taken[x] = first + n
            offset += x
        sequence += n
    rows.sort()
    key, base, offset = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return {"key": key, "base": base, "offset": offset}


def token_pieces(docs: DataFrame, *, size: int = SIZE, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids, 0 appended: doc_id, piece, start, length, ids_crc32, row_salt.

    A document of more than ``size`` ids is cut into pieces of ``size``, of which the first may be
    shorter. Null text is empty: one piece of the single id 0.
    """
    folder = folder or bpe.default_dir()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def cut(batch: pa.RecordBatch) -> dict:
        encode = bpe.id_encoder(folder)
        out: dict[str, list] = {n: [] for n in ("k", "p", "s", "n", "c")}
        for k, t in zip(*columns_of(batch, "k", "t")):
            ids = (encode(t) if t else b"") + b"\0\0\0\0"
            total = len(ids) // 4
            first = total % size or size
            bounds = [0, *range(first, total + 1, size)]
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                for n, v in zip("kpsnc", (k, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                    out[n].append(v)
        return {n: pa.array(v, pa.int32()) if n == "p" else v for n, v in out.items()}

    kind = rows.schema["k"].dataType.simpleString()
    return map_batches(rows, cut, f"k {kind}, p int, s long, n long, c long").toDF(key, "piece", "start", "length", "ids_crc32")


def pack(pieces: DataFrame, *, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to rows of (doc_id, piece, start, length, ids_crc32).

    Every input row gets a place of its own (repeated rows too); no sequence exceeds ``size``;
    an empty table gives no rows. The driver holds one count per length and the plan.
    """
    pieces = staged(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        histogram[length] = n
    plan_rows = places(plan(histogram, size))
    salts = max(1, -(-sum(counts.values()) // CELL_ROWS))
    # the count of rows before a cell, then a rank inside it: no task sorts a whole length
    # the salt is of a row's place in the staged files, too, so that rows equal altogether are spread; files do not change
    spread = F.xxhash64(key, "piece", "ids_crc32", "_metadata.file_name", "_metadata.row_index")
    cells = pieces.withColumn("salt", F.pmod(spread, F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy(key, "piece", "start", "ids_crc32")
    ranked = cells.withColumn("nth", F.row_number().over(inside) - 1).join(firsts, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("first"))
    table = pieces.sparkSession.sparkContext.broadcast(plan_rows)
    names = [key, "piece", "start", "length", "ids_crc32"]

    def place(batch: pa.RecordBatch) -> dict:
        at = table.value
        length, nth = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "nth"))
        i = np.searchsorted(at["key"], (length << 40) | nth, side="right") - 1
        return {n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"sequence_id": pa.array(at["base"][i] + nth), "offset": pa.array(at["offset"][i])}

    kind = pieces.schema[key].dataType.simpleString()
    return map_batches(ranked.select(*names, F.col("nth").cast("long")), place, f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, size: int = SIZE, folder: str | None = None) -> DataFrame:
    """``token_pieces`` then ``pack``; nulls, ties and repeated rows as stated there."""
    return pack(token_pieces(docs, size=size, folder=folder), size=size)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens: ``pack_documents``."""
    return pack_documents(read(spark, sf_dir, "documents"))
