"""Best-fit packing of tokenized documents into sequences by hierarchical residual packing.

Each partition tokenizes its documents, cuts the longer ones and packs the pieces best-fit in order of
falling length. Bins that are nearly full are final. The others are handed up a tree of tasks as items:
a task takes the underfull bins of several children, packs them best-fit as wholes, and again keeps only
what is nearly full, until one task is left.

After a best-fit round at most one bin of a task is half full or less, and two fuller ones can never
join. So all the tasks together hold at most as many joinable bins as there are tasks, and a task need
only hand on its emptiest `hand_on` bins: the others become final as they are. That bounds what any
task reads, whatever the lengths; no piece is lost by it.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import checkpoint, read_table

PIECES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@functools.lru_cache(2)
def fast_vocabulary(path: str) -> bpe.Vocabulary:
    """The same ids through the library's merge loop, which is faster on pieces not met before."""
    from tiktoken._tiktoken import CoreBPE

    v = bpe.Vocabulary(path)
    core = CoreBPE({b: i for b, i in v.usable.items()}, {}, bpe.PATTERN)
    v._pieces = lambda text: array("I", core.encode_ordinary(text)).tobytes()
    v.spaced.make = lambda chunk: array("I", core.encode_ordinary(" " + chunk)).tobytes()
    return v


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size, packed best-fit in order of falling size (equal sizes in their order)."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that they have left
    rooms: list[int] = []  # the rooms, sorted, of which there are bins
    n_bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            free = rooms[at]
            b = room[free].pop()
            if not room[free]:
                del rooms[at]
        else:
            free, b = capacity, n_bins
            n_bins += 1
        placed[i] = (b, capacity - free)
        left = free - size
        if left:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append(b)
    return placed


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, and before them what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _local(path: str, capacity: int, slack: int, hand_on: int, end_id: int, window: int):
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = fast_vocabulary(path)
        task = TaskContext.get().partitionId()
        made, names = 0, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "final"]
        rows: list[list] = [[] for _ in range(5)]

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal made, rows
            sizes = rows[3]
            placed = best_fit(sizes, capacity)
            fill: dict[int, int] = {}
            for (b, _), size in zip(placed, sizes):
                fill[b] = fill.get(b, 0) + size
            open_bins = sorted((f, b) for b, f in fill.items() if f < capacity - slack)[:hand_on]
            handed = {b for _, b in open_bins}
            base = (task << 36) + made
            made += len(fill)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[0], kind), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:]),
                    pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64()),
                    pa.array([fill[b] for b, _ in placed], pa.int32()), pa.array([b not in handed for b, _ in placed], pa.bool_()),
                ],
                names,
            )
            rows = [[] for _ in range(5)]
            return out

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = v.encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        column.append(value)
                if len(rows[0]) >= window:
                    yield flush(kind)
        if rows[0]:
            yield flush(kind)

    return work


def _merge(capacity: int, slack: int, hand_on: int, last: bool):
    """One level of the tree: underfull bins in; bins with their members and whether they are final out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [row for batch in batches for row in batch.to_pylist()]
        if not items:
            return
        items.sort(key=lambda r: r["bin"])  # the order of a shuffle isn't fixed
        placed = best_fit([r["fill"] for r in items], capacity)
        bins: dict[int, dict] = {}
        for r, (b, offset) in zip(items, placed):
            into = bins.setdefault(b, {"bin": r["bin"], "fill": 0, "members": []})
            into["bin"] = min(into["bin"], r["bin"])
            into["fill"] += r["fill"]
            into["members"] += [{"bin": m["bin"], "shift": m["shift"] + offset} for m in r["members"]]
        rows = sorted(bins.values(), key=lambda r: (r["fill"], r["bin"]))
        handed = 0
        for r in rows:
            r["final"] = last or r["fill"] >= capacity - slack or handed >= hand_on
            handed += not r["final"]
        group = items[0]["grp"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group] * len(rows), pa.int64()), pa.array([r["bin"] for r in rows], pa.int64()), pa.array([r["fill"] for r in rows], pa.int32()),
                pa.array([r["members"] for r in rows], pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int32())]))), pa.array([r["final"] for r in rows], pa.bool_()),
            ],
            ["grp", "bin", "fill", "members", "final"],
        )

    return work


_ITEM = "grp long, bin long, fill int, members array<struct<bin:long,shift:int>>, final boolean"


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2, slack: int = 0, hand_on: int = 4096, fan_in: int = 8, window: int = 200_000) -> DataFrame:
    """Rows of PIECES: where each piece of each document stands.

    slack: ids that a bin may lack and be final. hand_on: underfull bins that a task hands up the tree.
    window: pieces that a task holds at once; a larger partition packs window by window.
    A null or empty text is the end id alone; repeated rows are packed as often as they come, each row as
    a document; a null doc_id is carried along; an empty table gives no rows; other columns are left out.
    """
    path = path or bpe.default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("string"))
    local = source.mapInArrow(_local(path, capacity, slack, hand_on, end_id, window), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int, final boolean")
    local = checkpoint(local)  # tokenized once, and bins keep their numbers if a task runs again
    groups = local.rdd.getNumPartitions()
    level = (
        local.where("not final").groupBy("bin").agg(F.first("fill").alias("fill"))
        .select(F.shiftright("bin", 36).alias("grp"), "bin", "fill", F.array(F.struct("bin", F.lit(0).alias("shift"))).alias("members"))
    )
    done: list[DataFrame] = []
    while True:
        groups = -(-groups // fan_in)
        step = (
            level.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("grp")
            .agg(F.collect_list(F.struct("bin", "fill", "members")).alias("items"))
            .mapInArrow(_each_group(capacity, slack, hand_on, groups <= 1), _ITEM)
        )
        step = checkpoint(step)
        done.append(step.where("final"))
        level = step.where("not final").drop("final")
        if groups <= 1:
            break
    moved = functools.reduce(DataFrame.unionByName, done).select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"))
    final = local.where("final").withColumn("sequence_id", F.col("bin"))
    joined = local.where("not final").join(moved, "bin").withColumn("offset", F.col("offset") + F.col("shift"))
    return final.select(PIECES).unionByName(joined.select(PIECES))


def _each_group(capacity: int, slack: int, hand_on: int, last: bool):
    merge = _merge(capacity, slack, hand_on, last)
    member = pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                arrays = [pa.array([group] * len(items), pa.int64()), pa.array([i["bin"] for i in items], pa.int64()), pa.array([i["fill"] for i in items], pa.int32()), pa.array([i["members"] for i in items], member)]
                yield from merge(iter([pa.RecordBatch.from_arrays(arrays, ["grp", "bin", "fill", "members"])]))

    return work


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
