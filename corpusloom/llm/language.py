"""Language identification by a bidirectional gated recurrent network over bytes.

One gated recurrent layer reads a word's bytes (A-Z lower-cased) forwards and one backwards; both states
at a byte give the probabilities of its language. A text's probabilities are the normalised geometric
mean of those of its letters. The network starts anew at each word, and words longer than 64 bytes are
read in windows of 64, so a block of texts needs each distinct word only once.

It is trained in numpy by backpropagation through time on words of a bounded, balanced sample of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, read_table, span_hashes, text_blocks, word_spans

UNDETERMINED = "und"
WINDOW = 64
#: Bytes whose labels are pooled: letters, and parts of longer characters.
_POOLED = np.zeros(256, dtype=np.float32)
_POOLED[97:123] = 1
_POOLED[128:] = 1


def lettered(text: str | None) -> bool:
    """Whether a text has a letter, of any script; digits and numerals of other kinds are none."""
    return text is not None and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _run(w: np.ndarray, u: np.ndarray, x: np.ndarray, active: list[int], keep: bool = False):
    """States of one direction over words x (n, steps), of which the first active[t] last longer than t."""
    n, hidden = len(x), u.shape[0]
    h = np.zeros((n, hidden), np.float32)
    states, trace = [], []
    for t, a in enumerate(active):
        before = h[:a]
        g = w[x[:a, t]]
        c = before @ u
        zr = _sigmoid(g[:, : 2 * hidden] + c[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        new = np.tanh(g[:, 2 * hidden :] + r * c[:, 2 * hidden :])
        now = new + z * (before - new)
        if keep:
            trace.append((before.copy(), z, r, new, c[:, 2 * hidden :]))
        h[:a] = now
        states.append(now)
    return states, trace


def _back(w: np.ndarray, u: np.ndarray, x: np.ndarray, active: list[int], trace: list, outer: list[np.ndarray]):
    """Gradients of one direction, given those of its states."""
    hidden = u.shape[0]
    du = np.zeros_like(u)
    gates, bytes_ = [], []
    carry = np.zeros((len(x), hidden), np.float32)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        before, z, r, new, inner = trace[t]
        dh = carry[:a] + outer[t]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        to_u = np.concatenate([dz, dr, dn * r], axis=1)
        du += before.T @ to_u
        carry[:a] = dh * z + to_u @ u.T
        gates.append(np.concatenate([dz, dr, dn], axis=1))
        bytes_.append(x[:a, t])
    g, b = np.concatenate(gates), np.concatenate(bytes_)
    order = np.argsort(b, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(b[order]) != 0])
    dw = np.zeros_like(w)
    dw[b[order][first]] = np.add.reduceat(g[order], first, axis=0)
    return dw, du


class Network:
    """Weights: of bytes to gates and of states to gates in both directions, and of both states to languages."""

    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden

        def of(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "wf": of(256, 3 * hidden, scale=0.3), "uf": of(hidden, 3 * hidden, scale=hidden**-0.5), "wb": of(256, 3 * hidden, scale=0.3), "ub": of(hidden, 3 * hidden, scale=hidden**-0.5),
            "v": of(2 * hidden, len(languages), scale=hidden**-0.5), "b": np.zeros(len(languages), np.float32),
        }

    def _label(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        """Log-probabilities (word, position, language) of words sorted by falling length, 0 beyond their ends."""
        n, steps = x.shape
        active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]
        turned = np.zeros_like(x)
        place = length[:, None] - 1 - np.arange(steps)[None, :]
        inside = place >= 0
        turned[inside] = x[np.nonzero(inside)[0], place[inside]]
        p = self.p
        forward, ft = _run(p["wf"], p["uf"], x, active, keep)
        backward, bt = _run(p["wb"], p["ub"], turned, active, keep)
        h = self.hidden
        states = np.zeros((n, steps, 2 * h), np.float32)
        other = np.zeros((n, steps, h), np.float32)
        for t, a in enumerate(active):
            states[:a, t, :h] = forward[t]
            other[:a, t] = backward[t]
        rows = np.nonzero(inside)
        states[rows[0], rows[1], h:] = other[rows[0], place[inside]]
        logits = states @ p["v"] + p["b"]
        top = logits.max(axis=2, keepdims=True)
        logp = logits - top - np.log(np.exp(logits - top).sum(axis=2, keepdims=True))
        logp[~inside] = 0
        return logp, (active, turned, ft, bt, states, inside, place)

    def words(self, x: np.ndarray, length: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the pooled positions of each word's log-probabilities, and the number of those positions."""
        order = np.argsort(-length, kind="stable")
        sums, count = np.zeros((len(x), len(self.languages))), np.zeros(len(x))
        for at in range(0, len(x), chunk):
            rows = order[at : at + chunk]
            n = length[rows]
            cut = x[rows, : max(1, int(n[0]))]
            logp, rest = self._label(cut, n)
            weight = _POOLED[cut] * rest[5]
            sums[rows] = np.einsum("ntl,nt->nl", logp, weight)
            count[rows] = weight.sum(axis=1)
        return sums, count

    def train(self, x: np.ndarray, length: np.ndarray, label: np.ndarray, steps: int = 700, batch: int = 384, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on balanced batches of words, every letter of which should be labelled with its text's language."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(r, max(1, batch // len(of))) for r in of if len(r)])
            rows = rows[np.argsort(-length[rows], kind="stable")]
            n = length[rows]
            cut = x[rows, : int(n[0])]
            logp, (active, turned, ft, bt, states, inside, place) = self._label(cut, n, keep=True)
            weight = _POOLED[cut] * inside
            weight /= max(1.0, float(weight.sum()))
            d = np.exp(logp)
            d[np.arange(len(rows))[:, None], np.arange(cut.shape[1])[None, :], label[rows][:, None]] -= 1
            d *= weight[:, :, None]
            h, p = self.hidden, self.p
            ds = d @ p["v"].T
            dv = np.tensordot(states, d, axes=([0, 1], [0, 1]))
            mirror = np.zeros_like(ds[:, :, h:])
            at = np.nonzero(inside)
            mirror[at[0], place[inside]] = ds[at[0], at[1], h:]
            dwf, duf = _back(p["wf"], p["uf"], cut, active, ft, [ds[:a, t, :h] for t, a in enumerate(active)])
            dwb, dub = _back(p["wb"], p["ub"], turned, active, bt, [mirror[:a, t] for t, a in enumerate(active)])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in {"wf": dwf, "uf": duf, "wb": dwb, "ub": dub, "v": dv, "b": d.sum(axis=(0, 1))}.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] -= (pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of words, the long ones in windows."""
    starts, ends, row = word_spans(data, offsets)
    parts = -(-(ends - starts) // WINDOW)
    if len(parts) and parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, row = np.repeat(starts, parts) + WINDOW * k, np.repeat(ends, parts), np.repeat(row, parts)
        ends = np.minimum(ends, starts + WINDOW)
    return starts, ends, row


def _matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of spans, one a row, and their lengths."""
    length = ends - starts
    widest = int(length.max()) if len(length) else 1
    x = np.zeros((len(starts), widest), np.uint8)
    inside = np.arange(widest)[None, :] < length[:, None]
    x[inside] = LOWER[data[np.repeat(starts - np.cumsum(length) + length, length) + np.arange(int(length.sum()))]] if len(length) else 0
    return x, length


def pool(network: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-probabilities over each text's letters, and the number of those."""
    sums, count = np.zeros((len(column), len(network.languages))), np.zeros(len(column))
    for first, data, offsets in text_blocks(column):
        starts, ends, row = _windows(data, offsets)
        if not len(starts):
            continue
        h = span_hashes(data, starts, ends)
        _, where, which = np.unique(h, return_index=True, return_inverse=True)
        s, c = network.words(*_matrix(data, starts[where], ends[where]))
        rows = len(offsets) - 1
        for k in range(s.shape[1]):
            sums[first : first + rows, k] += np.bincount(row, weights=s[which, k], minlength=rows)
        count[first : first + rows] += np.bincount(row, weights=c[which], minlength=rows)
    return sums, count


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 250, words_each: int = 400, hidden: int = 16, steps: int = 700) -> Network | None:
    """A network from at most `per_language` texts of each language (a bounded sample by hash of the id) and at most `words_each` words of each of them.

    Rows whose doc_id, text or lang is null take no part, nor do held-out ones. None if no row is left.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~_held_out())
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(1.3 * per_language / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    def some_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = _windows(data, np.array([0, len(data)]))
                if len(starts) > words_each:
                    chosen = np.sort(np.random.default_rng(int(at * (1 << 30))).choice(len(starts), words_each, replace=False))
                    starts, ends = starts[chosen], ends[chosen]
                out.append([data[a:b].tobytes() for a, b in zip(starts, ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], ["lang", "draw", "words"])

    picked = usable.select("lang", draw.alias("draw"), F.col("text").cast("string").alias("text")).where(F.col("draw") < share[F.col("lang")])
    rows = picked.mapInArrow(some_words, "lang string, draw double, words array<binary>").collect()  # about per_language rows of each, of words_each words at most
    xs, lengths, labels = [], [], []
    for k, lang in enumerate(languages):
        for r in sorted((r for r in rows if r.lang == lang), key=lambda r: (r.draw, r.words))[:per_language]:
            if r.words:
                n = np.array([len(w) for w in r.words])
                ends = np.cumsum(n)
                x, n = _matrix(np.frombuffer(b"".join(r.words), np.uint8), ends - n, ends)
                xs.append(np.pad(x, ((0, 0), (0, WINDOW - x.shape[1]))))
                lengths.append(n)
                labels.append(np.full(len(n), k))
    network = Network(languages, hidden)
    if xs:
        network.train(np.concatenate(xs), np.concatenate(lengths), np.concatenate(labels), steps)
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for every row, from its text alone.

    `und` with score 0 where the text is null or has no letter, or nothing was learned from. Repeated rows
    get the same; a null doc_id stays null; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, score = judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def judge(network: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text."""
    n = len(column)
    if network is None:
        return [UNDETERMINED] * n, np.zeros(n)
    sums, count = pool(network, column)
    p = _softmax(sums / np.maximum(count, 1)[:, None])
    best = p.argmax(axis=1)
    some = [lettered(t) for t in column.to_pylist()]
    return [network.languages[b] if ok else UNDETERMINED for b, ok in zip(best, some)], np.where(some, p[np.arange(n), best], 0.0)


def flagged(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """The rows as they are, with __keep: whether a language is determined with a probability of `least` or more. If nothing was learned from, every text with a letter is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            if shared.value is None:
                keep = [lettered(t) for t in column.to_pylist()]
            else:
                said, score = judge(shared.value, column)
                keep = [x != UNDETERMINED and s >= least for x, s in zip(said, score)]
            yield batch.append_column("__keep", pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("__keep", T.BooleanType())]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
