"""Toxicity by a classifier chain over label columns.

Categories are predicted one after the other. Each has a sparse linear model (logistic, with a penalty
on absolute weights) of the words and word beginnings that a text holds, of a few shares of its
characters, and of the probabilities of the categories before it. A later model is trained with the
earlier categories' out-of-fold predictions, so it learns how far to trust them. A category's cut is
chosen on out-of-fold predictions too.

A text's features need each distinct word of a block once; only words that hold a chosen feature are
followed to their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, read_table, span_hashes, text_blocks, word_spans

#: What stands between words here: all bytes but letters, digits, apostrophes and parts of longer characters.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_MARK = np.zeros(256, dtype=np.int64)
_MARK[[ord(c) for c in "#*$%&|<>!"]] = 1
#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
#: Features that are chosen at most, and the texts of the sample that must hold one; half of them at most may. TELLING: the least chi-square.
MOST, LEAST, TELLING = 6000, 3, 6.6
N_DENSE = 3


def _word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(word, 1 + stems) hashes: the whole word and its beginnings, 0 where it is too short."""
    out = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    out[:, 0] = span_hashes(data, starts, ends)
    for k, n in enumerate(STEMS, 1):
        longer = ends - starts > n
        out[longer, k] = span_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(0x5BD1E995 + n)
    return out


def _dense(data: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shares of upper-case letters and of marks, and a scaled logarithm of the number of words."""
    n = np.diff(offsets)

    def per_row(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)

    words = np.bincount(row, minlength=len(n))
    return np.stack([per_row(_UPPER), np.minimum(1, 5 * per_row(_MARK)), np.log1p(words) / 10], axis=1)


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = span_hashes(data, starts, ends)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    return where, which


def find_features(column: pa.Array, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs without repetition, and the dense features of each text.

    chosen: sorted hashes of the features that count, named by their place; None: all, named by their hashes.
    """
    pairs_row, pairs_feature, dense = [], [], []
    for first, data, offsets in text_blocks(column):
        starts, ends, row = word_spans(data, offsets, _BETWEEN)
        dense.append(_dense(data, offsets, row))
        if not len(starts):
            continue
        where, which = _distinct(data, starts, ends)
        features = _word_features(data, starts[where], ends[where])
        if chosen is None:
            pair = np.unique(row * len(where) + which)
            r, w = pair // len(where), pair % len(where)
            f = features[w].ravel()
            r = np.repeat(r, features.shape[1])
            r, f = r[f != 0], f[f != 0]
            order = np.lexsort((f, r))
            r, f = r[order], f[order]
            new = np.r_[True, (r[1:] != r[:-1]) | (f[1:] != f[:-1])] if len(r) else np.zeros(0, bool)
            pairs_row.append(r[new] + first)
            pairs_feature.append(f[new])
        else:
            place = np.searchsorted(chosen, features)
            place[place == len(chosen)] = 0
            known = (chosen[place] == features) & (features != 0) if len(chosen) else np.zeros(features.shape, bool)
            tokens = np.flatnonzero(known.any(axis=1)[which])
            w = which[tokens]
            hit = known[w]
            r = np.repeat(row[tokens], hit.sum(axis=1))
            pair = np.unique(r * len(chosen) + place[w][hit]) if len(r) else np.zeros(0, np.int64)
            pairs_row.append(pair // max(1, len(chosen)) + first)
            pairs_feature.append(pair % max(1, len(chosen)))
    empty = np.zeros(0, np.int64)
    return (
        np.concatenate(pairs_row) if pairs_row else empty,
        np.concatenate(pairs_feature) if pairs_feature else (empty if chosen is not None else empty.astype(np.uint64)),
        np.concatenate(dense) if dense else np.zeros((0, N_DENSE)),
    )


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * np.clip(x, -40, 40)) + 1)


class Linear:
    """Logistic regression on sparse presences and dense columns; proximal gradient steps with momentum."""

    def __init__(self, n_sparse: int, n_dense: int):
        self.sparse, self.dense, self.bias = np.zeros(n_sparse), np.zeros(n_dense), 0.0

    def margin(self, row: np.ndarray, feature: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.sparse[feature], minlength=len(dense)) + dense @ self.dense + self.bias

    def fit(self, row: np.ndarray, feature: np.ndarray, dense: np.ndarray, y: np.ndarray, l1: float = 0.5, l2: float = 1.0, steps: int = 250) -> Linear:
        n = len(y)
        size = np.bincount(row, minlength=n).mean() + (dense**2).sum(axis=1).mean() + 1
        most = np.bincount(row, minlength=n).max(initial=0) + (dense**2).sum(axis=1).max(initial=0) + 1
        step = 4.0 / (n * min(most, 20 * size)) * 4
        s, d, b = self.sparse.copy(), self.dense.copy(), 0.0
        ps, pd, pb, t = s, d, b, 1.0
        m = Linear(len(s), len(d))
        for _ in range(steps):
            m.sparse, m.dense, m.bias = s, d, b
            g = _logistic(m.margin(row, feature, dense)) - y
            ns = s - step * (np.bincount(feature, weights=g[row], minlength=len(s)) + l2 * s)
            ns = np.sign(ns) * np.maximum(0, np.abs(ns) - step * l1)
            nd = d - step * (dense.T @ g + l2 * d)
            nb = b - step * g.sum()
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            w = (t - 1) / t2
            s, d, b = ns + w * (ns - ps), nd + w * (nd - pd), nb + w * (nb - pb)
            ps, pd, pb, t = ns, nd, nb, t2
        self.sparse, self.dense, self.bias = ps, pd, pb
        return self


class Chain:
    """Features chosen, and a model and a cut for each category in order."""

    def __init__(self, names: list[str], chosen: np.ndarray, models: list[Linear], cuts: list[float]):
        self.names, self.chosen, self.models, self.cuts = names, chosen, models, cuts

    def predict(self, column: pa.Array) -> np.ndarray:
        """(text, category) probabilities."""
        row, feature, dense = find_features(column, self.chosen)
        out = np.zeros((len(column), len(self.names)))
        for k, model in enumerate(self.models):
            out[:, k] = _logistic(model.margin(row, feature, np.hstack([dense, out[:, :k]])))
        return out


def counts(row: np.ndarray, feature: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that texts hold, and for each the texts, and those of each category."""
    names, which = np.unique(feature, return_inverse=True)
    return names, np.stack([np.bincount(which, minlength=len(names)), *(np.bincount(which, y[row, k], len(names)) for k in range(y.shape[1]))], axis=1)


def worth(df, held: list, shares: list[float], greatest, when):
    """What a feature tells about any category: a chi-square with the sign kept to what marks it. For arrays or columns."""
    parts = []
    for a, share in zip(held, shares):
        expected = df * share
        parts.append(when(a > expected, (a - expected) * (a - expected) / (expected * (1 - share) + 1e-9)))
    return greatest(parts)


def _cut(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The cut of the best F1 among those of at least `precision`, in the middle of the gap below it."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    n = np.arange(1, len(p) + 1)
    f1 = 2 * hits / (n + y.sum())
    edge = np.r_[p[order][1:] < p[order][:-1], True]
    f1[(hits < precision * n) | ~edge] = -1
    best = int(np.argmax(f1))
    if f1[best] <= 0:
        return 1.0
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def fit_chain(rows: list[tuple[str | None, list[int]]], names: list[str], most: int = MOST, least: int = LEAST) -> Chain:
    """A chain from (text, label of each category) rows, without Spark."""
    column = pa.array([t for t, _ in rows], pa.large_string())
    y = np.array([v for _, v in rows], dtype=float).reshape(len(rows), len(names))
    row, feature, _ = find_features(column, None)
    found, n = counts(row, feature, y)
    w = worth(n[:, 0], list(n[:, 1:].T), y.mean(axis=0).tolist() if len(rows) else [], lambda x: np.max(x, axis=0), lambda c, x: np.where(c, x, 0.0)) if len(rows) else np.zeros(0)
    w[(n[:, 0] < least) | (n[:, 0] > 0.5 * len(rows))] = 0
    top = np.lexsort((found.view(np.int64), -w))[:most]
    chosen = np.sort(found[top[w[top] > TELLING]])
    return fit_presence(*find_features(column, chosen), y, chosen, names)


def fit_presence(row: np.ndarray, feature: np.ndarray, dense: np.ndarray, y: np.ndarray, chosen: np.ndarray, names: list[str], folds: int = 5, precision: float = 0.98) -> Chain:
    """A chain from the places of chosen features that texts hold, their dense features and their labels."""
    rows = y
    fold = np.arange(len(rows)) % folds
    models, cuts, before = [], [], np.zeros((len(rows), 0))
    for k in range(len(names)):
        x = np.hstack([dense, before])
        apart = np.zeros(len(rows))
        for j in range(folds):
            new = np.cumsum(fold != j) - 1
            use, test = fold != j, fold == j
            m = Linear(len(chosen), x.shape[1])
            if use.any():
                inside = use[row]
                m.fit(new[row[inside]], feature[inside], x[use], y[use, k])
            apart[test] = _logistic(m.margin(row, feature, x))[test]
        m = Linear(len(chosen), x.shape[1])
        models.append(m.fit(row, feature, x, y[:, k]) if len(rows) else m)
        cuts.append(_cut(apart, y[:, k], precision) if len(rows) else 1.0)
        before = np.hstack([before, apart[:, None]])
    return Chain(names, chosen, models, cuts)


#: Category: the condition on a row of `labels` that makes it true; earlier ones feed later ones.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, each: int = 1500) -> Chain:
    """A chain from a bounded sample of labelled texts: of each category at most `each` texts that have it, and twice `each` of all, by hash of the id.

    Rows of labels whose id or any label is null take no part; of an id labelled twice, a category holds if
    any row says so.
    """
    names = list(categories)
    truth = labels.where("doc_id IS NOT NULL").select("doc_id", *[F.expr(c).cast("int").alias(f"c{k}") for k, c in enumerate(categories.values())]).dropna().groupBy("doc_id").agg(*[F.max(f"c{k}").alias(f"c{k}") for k in range(len(names))])
    truth = truth.withColumn("draw", F.xxhash64("doc_id"))
    parts = [truth.where(F.col(f"c{k}") == 1).orderBy("draw", "doc_id").limit(each) for k in range(len(names))] + [truth.orderBy("draw", "doc_id").limit(2 * each)]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    sample = sample.distinct()  # at most (categories + 2) * each small rows
    labelled = [f"c{k}" for k in range(len(names))]
    # Of differing texts of an id the least counts. Features are found and counted where the texts are.
    texts = checkpoint(docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "draw", *labelled).agg(F.min("text").alias("text")))
    n, *held = texts.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in labelled]).first()
    shares = [h / max(1, n) for h in held]
    width = len(labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1)
            row, feature, _ = find_features(batch.column(0), None)
            found, c = counts(row, feature, y)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in c.T)], ["feature", "df", *labelled])

    counted = texts.select("text", *labelled).mapInArrow(count, "feature long, df long, " + ", ".join(f"{c} long" for c in labelled)).groupBy("feature").agg(F.sum("df").alias("df"), *[F.sum(c).alias(c) for c in labelled])
    told = worth(F.col("df"), [F.col(c) for c in labelled], shares, lambda x: F.array_max(F.array(*x)), lambda c, x: F.when(c, x).otherwise(0.0))
    counted = counted.where((F.col("df") >= LEAST) & (F.col("df") <= 0.5 * n)).withColumn("worth", told).where(F.col("worth") > TELLING)
    chosen = np.sort(np.array([r.feature for r in counted.orderBy(F.desc("worth"), "feature").limit(MOST).collect()], np.int64).view(np.uint64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, dense = find_features(batch.column(0), chosen)
            parts = np.split(feature.astype("<u4"), np.cumsum(np.bincount(row, minlength=len(dense)))[:-1]) if len(dense) else []
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(dense.tolist(), pa.list_(pa.float64())), *batch.columns[1:]], ["features", "dense", *batch.schema.names[1:]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.select("text", "draw", "doc_id", *labelled).mapInArrow(place, f"features binary, dense array<double>, draw long, doc_id {kind}, " + ", ".join(f"{c} int" for c in labelled)).collect()  # at most (categories + 2) * each small rows
    rows.sort(key=lambda r: (r.draw, r.doc_id))
    features = [np.frombuffer(r.features, "<u4").astype(np.int64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(f) for f in features]).astype(np.int64)
    y = np.array([[r[c] for c in labelled] for r in rows], dtype=float).reshape(len(rows), width)
    dense = np.array([r.dense for r in rows]).reshape(len(rows), N_DENSE)
    return fit_presence(row, np.concatenate(features) if features else np.zeros(0, np.int64), dense, y, chosen, names)


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last category's probability reaches its cut) for every row.

    A null or empty text is scored as one without features, and is never toxic. Repeated rows get the same;
    a null doc_id stays null; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            p, toxic = judge(c, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(toxic)], ["doc_id", *names, "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, {', '.join(f'{n} double' for n in names)}, toxic boolean")


def judge(chain: Chain, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each text's categories, and whether the last one reaches its cut."""
    p = chain.predict(column)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return p, (p[:, -1] >= chain.cuts[-1]) & (size > 0)


def flagged(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows as they are, with __toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("__toxic", pa.array(judge(shared.value, batch.column(batch.schema.get_field_index("text")))[1], pa.bool_()))

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("__toxic", T.BooleanType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels")))
