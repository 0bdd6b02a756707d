"""SimHash near-duplicates by the May-Ozerov recursion.

A text's shingles are its runs of five words (A-Z lower-cased); a shorter text with a word is one
shingle. Each distinct shingle votes with its hash on 256 bits, so texts of similarity s (Jaccard, of
shingle sets of like size) differ in about 256 * acos(2s / (1 + s)) / pi of them.

Texts of the same shingle set are one class at once; the set, known by its hash, stands for them. Candidates among
these are found by repetitions of a recursion: on a random strip of coordinates a fingerprint goes to
the lists of those random centres from which it differs in the smallest weights; a list that is still
long recurses on another strip; a short one is compared throughout. As many repetitions are made as
bring the chance that a pair at the threshold meets in some list to the target. The first level is a
shuffle, the others stay in a task; the number of centres follows the number of texts, and where it is large the
first level is a recursion too, over strips with few centres each. A list longer than
was assumed is split by further strips, as often as keeps the chance; one too long for a task is compared
block against block.

A list first hands on two candidate pairs a text at most: with the first text before it that is near, and
with the closest one. These pairs are verified exactly on their shingle sets, and
verified pairs join texts. Then the lists are gone through again for all candidate pairs that are neither
joined nor verified yet, so that a choice that was refuted hides no pair. Pairs leave a list as they are
found, so what a task holds is its fingerprints. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpoint, mix, read_table, span_hashes, text_blocks, word_spans

SHINGLE, BITS = 5, 256
_SALT = [np.uint64(x) for x in (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]

_LANES = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None], axis=2, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a block of texts, in order."""
    starts, ends, row = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.bincount(row, minlength=len(offsets) - 1)
    step = np.uint64(0x9FB21C651E98DF25)
    total = np.zeros(len(h), np.uint64)
    # A shingle's words stand at most `width` apart, and not beyond its text's last word.
    last = np.cumsum(n)[row]
    at = np.arange(len(h))
    for k in range(width):
        inside = at + k < last
        total = total * step
        total[inside] += h[at[inside] + k]
    whole = at + width <= last
    first = at == last - n[row]
    keep = whole | first  # a text of fewer words is one shingle
    row, s = row[keep], mix(total[keep])
    key = (row.astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


def fingerprints(row: np.ndarray, shingle: np.ndarray, rows: int, bits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of shingles, a hash of the whole set, and 4 words of fingerprint of each text."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros((rows, 4), np.uint64)
    whole = np.zeros(rows, np.uint64)
    if not len(row):
        return n, whole, out
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    mixed = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    whole[some] = np.add.reduceat(mixed, first)
    if not bits:
        return n, whole, out
    votes = np.zeros((len(some), BITS), np.int32)
    # Votes are counted in eight lanes of a long, for at most 255 shingles at once.
    run = np.flatnonzero((np.arange(len(row)) - np.repeat(first, n[some])) % 255 == 0)
    run_row = np.searchsorted(some, row[run])
    for lo in range(0, len(run), 256):
        hi = min(len(run), lo + 256)
        begin, end = run[lo], run[hi] if hi < len(run) else len(row)
        words = np.stack([mix(mixed[begin:end] ^ salt) for salt in _SALT], axis=1)
        lanes = np.add.reduceat(_LANES[words.view(np.uint8).reshape(-1, 32)], run[lo:hi] - begin, axis=0)
        np.add.at(votes, run_row[lo:hi], lanes.view(np.uint8).reshape(-1, BITS))
    out[some] = np.packbits(2 * votes > n[some, None], axis=1, bitorder="little").view(np.uint64)
    return n, whole, out


def distance_share(similarity: float) -> float:
    """Share of bits in which fingerprints of texts of this similarity differ on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def _lists(bits: np.ndarray, strip: np.ndarray, centres: np.ndarray, to: int) -> np.ndarray:
    """(text, to) centres from which a text differs least on the strip."""
    near = (2 * bits[:, strip].astype(np.float32) - 1) @ (2 * centres.astype(np.float32) - 1).T
    near += np.arange(len(centres), dtype=np.float32) * (0.4 / len(centres))  # ties go one way everywhere
    return np.argpartition(-near, min(to, len(centres)) - 1, axis=1)[:, :to]


def _inner(n: int, short: int, to: int) -> int:
    """How many centres split a list of n texts into short ones."""
    return max(8, -(-to * n // (short * 2 // 3)))


@lru_cache(maxsize=None)
def _chances(share: float, to: int, centres: int, tries: int) -> tuple[float, ...]:
    """The chance that a pair which differs in this share of bits meets in a list of one strip, of two, ... of `tries`."""
    rng = np.random.default_rng([17, centres])
    x = rng.integers(0, 2, (1000, BITS), dtype=np.uint8)
    y = x ^ (rng.random(x.shape) < share).astype(np.uint8)
    met, out = np.zeros(len(x), bool), []
    for _ in range(tries):
        strip, drawn = rng.choice(BITS, 64, replace=False), rng.integers(0, 2, (centres, 64), dtype=np.uint8)
        a, b = _lists(x, strip, drawn, to), _lists(y, strip, drawn, to)
        met |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        out.append(float(met.mean()))
    return tuple(out)


class Plan:
    """The random strips and centres of every repetition, and how often to repeat."""

    def __init__(self, texts: int, similarity: float, recall: float, list_size: int = 20_000, short: int = 1200, to: int = 3, wide: int = 1024, seed: int = 17):
        self.to, self.short, self.seed, self.list_size = to, short, seed, list_size
        self.share = share = distance_share(similarity)
        sigma = (share * (1 - share) * BITS) ** 0.5
        self.limit = int(share * BITS + 2.75 * sigma)  # 99.7 % of pairs at the threshold
        self.near = int(share * BITS + 1)
        # Centres of each strip of the first level: at most `wide`, so a text is compared with few.
        self.levels = 1
        while (per := self._per(texts)) > wide:
            self.levels += 1
        self.per = per
        self.centres = 1 if texts <= list_size else per**self.levels
        if texts <= short:
            self.repeat = 1
            return
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 2, (600, BITS), dtype=np.uint8)
        y = x ^ (rng.random(x.shape) < share).astype(np.uint8)
        tries, met = 6, 0.0
        inner = _inner(min(texts, list_size), short, to)
        for r in range(tries):
            a, b = self.assign(x, r), self.assign(y, r)
            both = (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
            rng2 = np.random.default_rng([seed, 99, r])
            both &= self._meet(x, y, rng2.choice(BITS, 64, replace=False), rng2.integers(0, 2, (inner, 64), dtype=np.uint8))
            met += both.mean() / tries
        self.repeat = max(1, int(np.ceil(np.log(1 - recall) / np.log(max(1e-9, 1 - met)))))

    def _per(self, texts: int) -> int:
        lists = self.to**self.levels * texts / self.list_size
        return max(2, int(np.ceil(lists ** (1 / self.levels))))

    def tries(self, n: int, depth: int) -> int:
        """Strips by which a list of n texts is split: one at the length that `repeat` assumes, as many as give that chance in a longer one; deeper down, where `repeat` assumes that all pairs meet, for 0.999."""
        if depth == 0 and n <= self.list_size:
            return 1
        target = 0.999 if depth else _chances(self.share, self.to, _inner(self.list_size, self.short, self.to), 1)[0]
        centres = 1 << (_inner(n, self.short, self.to) - 1).bit_length()  # rounded up, so that few are simulated
        chances = _chances(self.share, self.to, centres, 16)
        return next((k for k, c in enumerate(chances, 1) if c >= target), len(chances))

    def _meet(self, x, y, strip, centres) -> np.ndarray:
        a, b = _lists(x, strip, centres, self.to), _lists(y, strip, centres, self.to)
        return (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))

    def assign(self, bits: np.ndarray, r: int) -> np.ndarray:
        """The lists that texts go to in a repetition: each strip's nearest centres, and their combinations over the strips."""
        lists = np.zeros((len(bits), 1), np.int64)
        if self.centres == 1:
            return lists
        for level in range(self.levels):
            rng = np.random.default_rng([self.seed, r] + [level] * (level > 0))
            strip, centres = rng.choice(BITS, 128 // self.levels, replace=False), rng.integers(0, 2, (self.per, 128 // self.levels), dtype=np.uint8)
            lists = (lists[:, :, None] * self.per + _lists(bits, strip, centres, self.to)[:, None, :]).reshape(len(bits), -1)
        return lists


def _differences(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, bits in which rows differ from those up to themselves) in blocks of rows; too many where a row meets itself or a later one."""
    n = len(fp)
    lo = 0
    while lo < n:
        hi = min(n, lo + max(16, min(256, (1 << 22) // (lo + 256))))
        d = np.zeros((hi - lo, hi), np.uint16)
        for w in range(fp.shape[1]):
            d += np.bitwise_count(fp[lo:hi, w, None] ^ fp[None, :hi, w])
        d[:, lo:][np.triu_indices(hi - lo)] = BITS + 1
        yield lo, d
        lo = hi


def close_blocks(fp: np.ndarray, limit: int, short: int, to: int, seed: list[int], depth: int = 0, group: np.ndarray | None = None, tries: Callable[[int, int], int] | None = None, near: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) that differ in `limit` bits at most: all in a short list, those that the recursion meets in a longer one; a pair may come again.

    Pairs of one group are left out. tries: strips by length and depth of a list, one by default. near: only two
    pairs of a row with earlier ones are wanted, the first that differs in so many bits at most and the closest.
    """
    n = len(fp)
    times = tries(n, depth) if tries and n > short and depth < 3 else 1
    # Below the first level a list is compared throughout if that takes no more than all of its strips.
    if n <= short or depth >= 3 or (tries and depth and n <= times * to * (short * 2 // 3)):
        for lo, d in _differences(fp):
            if near is not None:
                best, close = d.argmin(axis=1), d <= near
                first, rows = close.argmax(axis=1), np.arange(len(d))
                some, other = np.flatnonzero(d[rows, best] <= limit), np.flatnonzero(close[rows, first] & (first != best))
                yield np.concatenate([best[some], first[other]]), np.concatenate([some, other]) + lo
                continue
            i, j = np.nonzero(d <= limit)
            i += lo
            if group is not None:
                apart = group[i] != group[j]
                i, j = i[apart], j[apart]
            yield j, i
        return
    part = 0
    for at in range(times):
        rng = np.random.default_rng([*seed, depth] + [at] * (at > 0))
        strip = rng.choice(BITS, 64, replace=False)
        centres = rng.integers(0, 2, (_inner(n, short, to), 64), dtype=np.uint8)
        to_list = np.concatenate([_lists(_bits(fp[lo : lo + 4096]), strip, centres, to) for lo in range(0, n, 4096)])
        member = np.repeat(np.arange(n), to_list.shape[1])
        order = np.argsort(to_list.ravel(), kind="stable")
        for rows in np.split(member[order], np.cumsum(np.bincount(to_list.ravel(), minlength=len(centres)))[:-1]):
            if len(rows) > 1:
                for i, j in close_blocks(fp[rows], limit, short if len(rows) < 0.7 * n else n, to, [*seed, part], depth + 1, None if group is None else group[rows], tries, near):
                    yield rows[i], rows[j]
                part += 1


_SIGNATURE = "doc_id long, n int, whole long, f0 long, f1 long, f2 long, f3 long"


def set_key(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What a shingle set is known by."""
    return mix(whole + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), whole (hash of their set), f0 to f3 (fingerprint) for every row; doc_id must be whole numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in text_blocks(batch.column(1)):
                parts.append(fingerprints(*shingle_sets(data, offsets), len(offsets) - 1))
            if parts:
                n, whole, fp = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), pa.array(set_key(n, whole)), *(pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(4))], ["doc_id", "n", "whole", "f0", "f1", "f2", "f3"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, _SIGNATURE)


def _to_lists(plan: Plan):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5)], axis=1).view(np.uint64)
            for lo in range(0, len(fp), 4096):
                part = batch.slice(lo, 4096)
                bits = _bits(np.ascontiguousarray(fp[lo : lo + 4096]))
                for r in range(plan.repeat):
                    lists = plan.assign(bits, r)
                    rows = pa.array(np.repeat(np.arange(len(bits)), lists.shape[1]))
                    key = pa.array(lists.ravel() + r * plan.centres)
                    yield pa.RecordBatch.from_arrays([key, *(c.take(rows) for c in part.columns)], ["list", *part.schema.names])

    return work


def _in_list(plan: Plan, rest: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("id")  # the order of a shuffle isn't fixed
        ids = table.column("id").to_numpy()
        fp = np.ascontiguousarray(np.stack([table.column(f"f{k}").to_numpy() for k in range(4)], axis=1)).view(np.uint64)
        group = table.column("joined").to_numpy() if rest else None
        held, n = [], 0
        for i, j in close_blocks(fp, plan.limit, plan.short, plan.to, [plan.seed, int(table.column("list")[0].as_py())], group=group, tries=plan.tries, near=None if rest else plan.near):
            held.append((ids[i], ids[j]))
            n += len(i)
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*held)], ["a", "b"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([np.concatenate(x) for x in zip(*held)], ["a", "b"])

    return work


def candidates(reps: DataFrame, plan: Plan, hot: int = 200_000) -> DataFrame:
    """Distinct (a, b), a < b, to verify among id, f0 to f3: two of each text in a list, or with a column `joined` all that differ in it. A list of more than `hot` texts is dealt into blocks by a hash, and each two of them are compared in a task."""
    columns = ["id", "f0", "f1", "f2", "f3"] + ["joined"] * ("joined" in reps.columns)
    keys = reps.select(columns).mapInArrow(_to_lists(plan), "list long, " + ", ".join(f"{c} long" for c in columns))
    # Blocks of each list, as a table that is joined only if there are such lists.
    large = keys.groupBy("list").count().where(F.col("count") > hot).select("list", F.ceil(F.col("count") / (hot / 2)).alias("blocks")) if plan.centres > 1 else None
    if large is not None and (large := checkpoint(large)).limit(1).count():
        keys = keys.join(large, "list", "left").withColumn("block", F.pmod(F.xxhash64("id", "list"), F.coalesce("blocks", F.lit(1))))
        # A text goes to a task with each other block; its own is beside it in all of them.
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: F.when(q != F.col("block"), F.least("block", q) * F.col("blocks") + F.greatest("block", q)))
        keys = keys.withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.filter(meets, lambda x: x.isNotNull()))))
    else:
        keys = keys.withColumn("part", F.lit(0).cast("long"))
    pairs = keys.select("part", "list", *columns).groupBy("list", "part").applyInArrow(_in_list(plan, "joined" in columns), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingles) of those rows whose set the id stands for."""
    for batch in batches:
        keys, out = [], []
        for _, data, offsets in text_blocks(batch.column(1)):
            row, s = shingle_sets(data, offsets)
            n, whole, _ = fingerprints(row, s, len(offsets) - 1, bits=False)
            keys.append(set_key(n, whole))
            s = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out += [x.tobytes() for x in np.split(s, np.cumsum(n)[:-1])]
        if out:
            right = pa.array(np.concatenate(keys) == batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "shingles"]).filter(right)


def _jaccard(similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.unique(np.frombuffer(x, np.uint32)), np.unique(np.frombuffer(y, np.uint32))
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return work


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sets have a Jaccard similarity of `similarity` or more. reps: id, rep, a doc_id (of docs) whose text has the set."""
    needed = reps.select("id", "rep").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(needed, "rep").select("id", "text")
    sets = checkpoint(texts.mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"]))
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(_jaccard(similarity), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b): the smallest node of each connected component, by passing on smallest labels and following them."""
    edges = checkpoint(edges.select("a", "b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("mid"))
        to = labels.select(F.col("node").alias("mid"), F.col("label").alias("jump"))
        new = checkpoint(step.join(to, "mid", "left").select("node", "old", F.least("mid", F.coalesce("jump", "mid")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def set_classes(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and for each set with a doc_id: whole, class_id, keeper (whether it stands for its class)."""
    signed = checkpoint(signatures(docs))
    worded = signed.where("doc_id IS NOT NULL AND n > 0")
    reps = checkpoint(worded.groupBy(F.col("whole").alias("id")).agg(F.min("doc_id").alias("rep"), *[F.first(f"f{k}").alias(f"f{k}") for k in range(4)]))
    plan = Plan(reps.count(), similarity, recall)
    pairs = checkpoint(candidates(reps, plan))
    edges = checkpoint(verify(docs, reps, pairs, similarity))
    known = components(edges)
    # What the choice left out: every candidate pair between texts that it didn't join.
    grouped = reps.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("joined", F.coalesce("label", "id"))
    left = checkpoint(candidates(grouped, plan).join(pairs, ["a", "b"], "left_anti"))
    labels = components(edges.unionByName(verify(docs, reps, left, similarity)))
    in_class = checkpoint(reps.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "rep", F.coalesce("label", "id").alias("label")))
    first = in_class.groupBy("label").agg(F.min(F.struct("rep", "id")).alias("first"))
    classes = in_class.join(first, "label").select(F.col("id").alias("whole"), F.col("first.rep").alias("class_id"), (F.col("first.id") == F.col("id")).alias("keeper"))
    return signed, classes


def near_duplicates(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_shingles for every row.

    Texts without a word (null, empty or white space) are classes of their own; so are rows whose doc_id is
    null, whose class_id is null. Rows of one doc_id are judged each by its own text. Other columns are left out. An empty table gives no rows.
    """
    signed, classes = set_classes(docs, similarity, recall)
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id"))
    return signed.join(classes, "whole", "left").select("doc_id", own.cast("long").alias("class_id"), F.col("n").cast("long").alias("n_shingles"))


def keep_one(docs: DataFrame, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """The rows of docs of which one is kept in each class: one of the smallest doc_id. Rows without a word or a doc_id are all kept.

    Rows of one doc_id are judged each by its own text; of rows that have both the doc_id and the shingle set
    in common the least is kept, by their columns in order.
    """
    signed, classes = set_classes(docs, similarity, recall)
    stays = (F.col("n") == 0) | (F.col("keeper") & (F.col("class_id") == F.col("doc_id")))
    by_id = signed.where("doc_id IS NOT NULL").join(classes, "whole", "left").groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(stays).alias("__some"), (F.count("*") > 1).alias("__again"))
    joined = docs.join(by_id.where("NOT __some OR __again"), F.col("doc_id").cast("long") == F.col("__id"), "left").where("coalesce(__some, true)")
    plain = joined.where("NOT coalesce(__again, false)").select(docs.columns)
    # Few ids have several rows; these are told apart by their sets.
    schema = docs.schema

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(*shingle_sets(data, offsets), len(offsets) - 1, bits=False) for _, data, offsets in text_blocks(batch.column("text"))]
            if parts:
                n, whole, _ = (np.concatenate(x) for x in zip(*parts))
                yield batch.append_column("__n", pa.array(n.astype(np.int64))).append_column("__whole", pa.array(set_key(n, whole)))

    marked = joined.where("__again").select(docs.columns).mapInArrow(mark, StructType([*schema.fields, StructField("__n", LongType()), StructField("__whole", LongType())]))
    chosen = marked.join(classes.where("keeper").select(F.col("whole").alias("__whole"), F.col("class_id").alias("__class")), "__whole", "left")
    least = chosen.where("__n > 0 AND __class = cast(doc_id AS long)").groupBy("__whole").agg(F.min(F.struct(docs.columns)).alias("__row")).select("__row.*")
    return plain.unionByName(chosen.where("__n = 0").select(docs.columns)).unionByName(least)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
