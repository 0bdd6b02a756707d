"""Toxicity, language, mixing, near-duplicates, quality rules and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import language, mixing, quality, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- toxicity


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def test_chain_finds_toxic_texts_and_leaves_others(judged):
    docs, labels, chain = judged
    rows = toxicity.score_documents(docs, chain).join(labels, "doc_id").collect()
    caught = [r.toxic for r in rows if r["toxic"] is not None]
    assert len(caught) == len(rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r["toxic"] for r in toxicity.score_documents(docs, chain).collect()}
    hit = sum(got[d] for d, t in truth.items() if t)
    wrong = sum(got[d] for d, t in truth.items() if not t)
    assert hit >= 0.85 * sum(truth.values()) and wrong <= 3


def test_later_models_see_earlier_probabilities(judged):
    chain = judged[2]
    assert [len(m.dense) for m in chain.models] == [toxicity.N_DENSE, toxicity.N_DENSE + 1]


def test_chain_on_held_out_rows():
    random.seed(1)
    clean = [" ".join(random.choice(["sun", "moon", "tree", "lake", "bird", "road"]) for _ in range(30)) for _ in range(400)]
    rows = [(t + (" frabjous" if k % 4 == 0 else ""), [int(k % 4 == 0 and k % 8 == 0), int(k % 4 == 0)]) for k, t in enumerate(clean)]
    chain = toxicity.fit_chain(rows[:300], ["mean", "toxic"])
    p = chain.predict(pa.array([t for t, _ in rows[300:]]))[:, -1] >= chain.cuts[-1]
    assert (p == [v[1] == 1 for _, v in rows[300:]]).all()


def test_toxicity_edges(judged, docs, hard_texts, spark):
    chain = judged[2]
    out = {r.doc_id: r for r in toxicity.score_documents(docs(hard_texts), chain).collect()}
    assert len(out) == len(hard_texts) and not out[0]["toxic"] and not out[1]["toxic"]
    assert out[5]["p_toxic"] == out[6]["p_toxic"]
    assert toxicity.score_documents(docs([]), chain).count() == 0
    empty = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    nothing = toxicity.fit(docs(["a text"]), empty)
    assert not toxicity.score_documents(docs(["a text"]), nothing).first()["toxic"]


def test_sample_holds_1500_texts_of_a_category(docs, spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit_presence", lambda row, feature, dense, y, chosen, names: taken.extend(y.tolist()))
    labels = spark.range(8000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 4 = 0 AS int) AS toxic")
    toxicity.fit(docs([f"text {k}" for k in range(8000)]), labels)
    assert sum(v[1] for v in taken) >= 1500


def plain_linear(x, y, size, most, l1=0.5, l2=1.0, steps=250, sparse=0):
    """Proximal gradient steps with momentum on a full matrix, whose first `sparse` columns are penalised by absolute value."""
    n = len(y)
    step = 4.0 / (n * min(most, 20 * size)) * 4
    w, b = np.zeros(x.shape[1]), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
        nw = w - step * (x.T @ g + l2 * w)
        nw[:sparse] = np.sign(nw[:sparse]) * np.maximum(0, np.abs(nw[:sparse]) - step * l1)
        nb = b - step * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, b = nw + (t - 1) / t2 * (nw - pw), nb + (t - 1) / t2 * (nb - pb)
        pw, pb, t = nw, nb, t2
    return pw, pb


def test_chain_against_a_plain_loop():
    rng = np.random.default_rng(15)
    n, width = 120, 9
    presence = (rng.random((n, width)) < 0.3).astype(float)
    dense = rng.random((n, toxicity.N_DENSE))
    y = np.stack([presence[:, 0] * (rng.random(n) < 0.8), np.maximum(presence[:, 0], presence[:, 1]) * (rng.random(n) < 0.9)], axis=1)
    row, feature = np.nonzero(presence)
    chain = toxicity.fit_presence(row, feature, dense, y, np.arange(width, dtype=np.uint64), ["a", "b"])
    before = np.zeros((n, 0))
    for k in range(2):
        full = np.hstack([dense, before])
        apart = np.zeros(n)

        def fit(use):
            size = presence[use].sum(axis=1).mean() + (full[use] ** 2).sum(axis=1).mean() + 1  # noqa: B023
            most = presence[use].sum(axis=1).max() + (full[use] ** 2).sum(axis=1).max() + 1  # noqa: B023
            return plain_linear(np.hstack([presence[use], full[use]]), y[use, k], size, most, sparse=width)  # noqa: B023

        for fold in range(5):
            test = np.arange(n) % 5 == fold
            w, b = fit(~test)
            apart[test] = 1 / (1 + np.exp(-(np.hstack([presence, full])[test] @ w + b)))
        w, b = fit(np.ones(n, bool))
        assert np.allclose(np.r_[chain.models[k].sparse, chain.models[k].dense], w, atol=1e-9) and abs(chain.models[k].bias - b) < 1e-9
        before = np.hstack([before, apart[:, None]])


def test_features_are_chosen_alike_with_and_without_a_cluster(spark, docs):
    rng = np.random.default_rng(16)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 40)) + (" vile nasty" if k % 5 == 0 else "") for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs(texts).repartition(3), labels)
    alone = toxicity.fit_chain([(t, [0, int(k % 5 == 0)]) for k, t in enumerate(texts)], ["low_quality", "toxic"])
    assert (chain.chosen == alone.chosen).all() and len(chain.chosen) > 1


# ---- language


def test_numerals_are_no_letters():
    assert [language.lettered(t) for t in (None, "", "12 ²½Ⅷ_!", "٣", "a", "12 é", "中")] == [False, False, False, False, True, True, True]


def test_language_on_held_out_documents(spark, docs, hard_texts):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.fit(table, per_language=60, steps=250)
    rows = language.identify(table, network).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == table.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    out = {r.doc_id: r for r in language.identify(docs(hard_texts), network).collect()}
    assert [out[k].lang_pred for k in range(3)] == ["und"] * 3 and out[5].lang_pred == out[6].lang_pred and abs(out[5].score - out[6].score) < 1e-5
    assert language.identify(docs(["12 34 !"]), network).first().lang_pred == "und"
    assert language.identify(docs([]), network).count() == 0
    assert language.fit(docs([(1, None), (None, "x")])) is None
    assert language.identify(docs(["abc"]), None).first().lang_pred == "und"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b"], hidden=3)
    x, n = rng.integers(97, 110, (4, 5)).astype(np.uint8), np.array([5, 4, 2, 1])
    label = np.array([0, 1, 1, 0])

    def loss():
        logp, rest = net._label(x, n)
        w = language._POOLED[x] * rest[5]
        return -(logp[np.arange(4)[:, None], np.arange(5)[None], label[:, None]] * w).sum() / w.sum()

    logp, (active, turned, ft, bt, states, inside, place) = net._label(x, n, keep=True)
    w = language._POOLED[x] * inside
    d = np.exp(logp)
    d[np.arange(4)[:, None], np.arange(5)[None], label[:, None]] -= 1
    d *= (w / w.sum())[:, :, None]
    ds = d @ net.p["v"].T
    dw, du = language._back(net.p["wf"], net.p["uf"], x, active, ft, [ds[:a, t, :3] for t, a in enumerate(active)])
    for name, grad, at in (("wf", dw, (int(x[0, 1]), 4)), ("uf", du, (1, 2)), ("uf", du, (0, 7))):
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        down = loss()
        net.p[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


# ---- mixing


def test_mixing_counts_and_scores(docs, hard_texts):
    random.seed(2)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "of", "of", "of", "the", "the"]
    texts = hard_texts + [" ".join(random.choice(vocabulary) for _ in range(60)) for _ in range(120)]
    table = docs(texts)
    from pyspark.sql import functions as F

    rows = {r.doc_id: r for r in mixing.score_documents(table, F.col("doc_id") % 7 != 2).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [WORD.findall((t or "").translate(lower)) + [None] for t in texts]
    c = Counter(x for k, w in enumerate(tokens) if k % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    for k, w in enumerate(tokens):
        r = rows[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * max(1, len(w))
        assert r.score < 0
    long = [rows[k] for k in range(len(hard_texts), len(texts))]
    for held in (True, False):
        some = [r for r in long if r.train != held]
        assert sum(r.score for r in some) > sum(r.base_score for r in some)
    assert mixing.score_documents(docs([]), F.lit(True)).count() == 0
    alone = mixing.score_documents(docs(["some text"]), F.lit(False)).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score < 0


def test_mixing_beats_its_base_and_sets_copies_apart(spark):
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.op3_mixing(spark, "/root/testdata/sf0.01").join(table.groupBy("text").agg(F.count("*").alias("copies"), F.first("doc_id").alias("doc_id")), "doc_id").collect()
    for held in (True, False):
        some = [r for r in rows if r.held_out == held]
        assert sum(r.score for r in some) > sum(r.base_score for r in some)
    single = np.sort([r.bits_per_byte for r in rows if r.copies == 1])
    assert np.mean([r.bits_per_byte < single[len(single) // 10] for r in rows if r.copies > 1]) > 0.7


def some_words(rng, n=4000):
    """A vocabulary, and places in a text of it: classes of several sizes."""
    c = np.array([400, 250, 100, 100, 9, 9, 9, 2, 2, 2, 2, 1, 1, 1, 1, 1])
    kind = mixing.word_class(c)
    v = mixing.Words([(int(k), int((kind == k).sum()), int(c[kind == k].sum())) for k in np.unique(kind)], 40, 1)
    seq = rng.permutation(np.repeat(np.arange(v.unknown), [c[0], c[1], c[2], c[3], 40, *c[4:]]))[:n]
    seq[1::2] = np.where(rng.random(len(seq[1::2])) < 0.5, (seq[::2] + 1)[: len(seq[1::2])] % 5, seq[1::2])
    return v, seq


def history(seq, start):
    return [np.r_[np.full(k, start), seq[:-k]] for k in (1, 2)], [np.r_[start, seq[:-1]], np.r_[start, start, seq[:-2]]]


def test_next_words_add_up_to_one():
    v, seq = some_words(np.random.default_rng(3))
    back, far = history(seq, v.start)
    asked = np.r_[np.arange(v.unknown), v.unknown]
    for at in (5, 40, 200):
        more = lambda x: np.r_[x, np.full(len(asked), x[at])]  # noqa: B023, E731
        full = np.r_[seq, asked]
        train = np.arange(len(full)) < len(seq)
        p = mixing.word_scores(v, train, full, [more(x) for x in back], [more(x) for x in far])
        assert abs((10 ** p[len(seq) :]).sum() - 1) < 1e-4


def test_next_letters_add_up_to_one():
    rng = np.random.default_rng(5)
    data = rng.choice(np.frombuffer(b"aabcd ", np.uint8), 3000).astype(np.int64)
    contexts = [mixing._hash(*[np.r_[np.zeros(j, int), data[:-j]] for j in range(1, k + 1)]) for k in range(1, 6)]
    code = mixing.Code(np.bincount(data, minlength=256) + 0.05, np.ones(256))
    full = np.r_[data, np.arange(256)]
    train = np.arange(len(full)) < len(data)
    p = mixing.mixed_log10(code, full, 0 * full, code.length[full], [np.r_[c, np.full(256, c[77])] for c in contexts], train, mixing.LETTER_PRIOR, mixing.LETTER_LEAST, all_wanted=False)
    assert abs((10 ** p[len(data) :]).sum() - 1) < 1e-4


def slow_mixing(code, leaf, number, depth, contexts, train, prior, least, teach):
    """The same model, bit by bit, on dictionaries."""
    weights, seen_, came_, out = {}, {}, {}, [0.0] * len(leaf)
    logistic = lambda x: 1 / (1 + math.exp(-x))

    def bits(k):
        path = [(int(code.bit[d, leaf[k]]), float(code.odds[d, leaf[k]])) for d in range(min(depth[k], code.length[leaf[k]]))]
        lo, hi = 0, int(code.members[leaf[k]])
        for rest in range(int(depth[k] - len(path)), 0, -1):
            middle = lo + (1 << (rest - 1))
            b = int(number[k] >= middle)
            left, right = min(hi, middle) - lo, max(0, hi - middle)
            path.append((b, math.inf if right == 0 else (1 if b else -1) * math.log(right / left)))
            lo, hi = (middle, hi) if b else (lo, min(hi, middle))
        return path

    paths = [bits(k) for k in range(len(leaf))]
    whole = lambda k, d: tuple(b for b, _ in paths[k][:d])
    order = [k for k in range(len(leaf)) if train[k]] + [k for k in range(len(leaf)) if not train[k]]
    alive = [[True] * len(contexts) for _ in leaf]
    for d in range(max(depth) + 1):
        groups = [{} for _ in contexts]
        for k in order:
            for c in range(len(contexts)):
                if len(paths[k]) >= d and alive[k][c]:
                    groups[c].setdefault((contexts[c][k], whole(k, d)), []).append(k)
        for c, group in enumerate(groups):
            for members in group.values():
                n = sum(bool(train[k]) for k in members)
                if n < max(1, least[c]) or (least[c] <= 1 and n == 1 and len(members) == 1):
                    for k in members:
                        alive[k][c] = False
        batch = []
        for k in order:
            if d >= len(paths[k]):
                continue
            if not any(alive[k]):
                if d == 0 or any(alive_before[k]):
                    rest = [o for _, o in paths[k][d:]]
                    out[k] += sum(math.log10(logistic(o)) if o < 700 else 0 for o in rest)
                continue
            b, odds = paths[k][d]
            if odds == math.inf:
                continue
            p = logistic(max(-15, min(15, odds)))
            x, gate = [max(-15, min(15, odds))], 0
            for c, s in enumerate(prior):
                n = m = 0
                if alive[k][c]:
                    for o in groups[c][(contexts[c][k], whole(k, d))]:
                        if train[o] and o != k and len(paths[o]) > d:
                            n, m = n + 1, m + (paths[o][d][0] == b)
                p = (m + s * p) / (n + s)
                x.append(math.log(p / max(1 - p, 1e-7)))
                if c >= len(prior) - 3:
                    gate = gate * 3 + min(n, 2)
            batch.append((k, x, gate))
        step = {}
        for k, x, gate in batch:
            w = weights.setdefault(gate, [0.0] * len(prior) + [1.0])
            margin = max(-14, min(14, sum(a * b for a, b in zip(w, x))))
            at = (max(-12, min(12, margin)) + 12) * 32 / 24
            low = min(int(at), 31)
            middle = [24 * logistic(-12 + 24 * i / 32) for i in range(33)]
            seen, came = seen_.setdefault(gate, [24.0] * 33), came_.setdefault(gate, middle)
            value = lambda i: came[i] / seen[i]  # noqa: E731, B023
            p = logistic(margin)
            out[k] += math.log10(0.5 * p + 0.5 * (value(low) * (1 - at + low) + value(low + 1) * (at - low)))
            if train[k] and d < teach[k]:
                step.setdefault(gate, []).append((x, 1 - p, low, at - low))
        for gate, lessons in step.items():
            for x, error, low, part in lessons:
                for i, share in ((low, 1 - part), (low + 1, part)):
                    came_[gate][i] += share
                    seen_[gate][i] += share
                    seen_[gate][32 - i] += share
                for i, value in enumerate(x):
                    weights[gate][i] += 0.04 * error * value / (len(lessons) + 64)
        alive_before = [list(a) for a in alive]
    return out


def test_mixing_against_a_slow_loop():
    v, seq = some_words(np.random.default_rng(6), 700)
    back, far = history(seq, v.start)
    train = np.random.default_rng(7).random(len(seq)) < 0.8
    leaf, number, depth = v.place(seq)
    contexts = [mixing._hash(*far), mixing._hash(back[0]), mixing._hash(*back)]
    teach = np.where(leaf == v.rare, v.code.length[leaf], depth)
    fast = mixing.mixed_log10(v.code, leaf, number, depth, contexts, train, mixing.WORD_PRIOR, mixing.WORD_LEAST, teach=teach)
    slow = slow_mixing(v.code, leaf, number, depth, contexts, train, mixing.WORD_PRIOR, mixing.WORD_LEAST, teach)
    assert np.abs(fast - slow).max() < 1e-3


def test_mixing_finds_bits_once_for_equal_tokens(monkeypatch):
    """Time: a word's bits were found anew at each of its places."""
    v, seq = some_words(np.random.default_rng(6), 700)
    back, far = history(seq, v.start)
    asked, at = [], mixing.Code.at
    monkeypatch.setattr(mixing.Code, "at", lambda self, depth, leaf, number: asked.append(len(leaf)) or at(self, depth, leaf, number))
    mixing.word_scores(v, np.ones(len(seq), bool), seq, back, far)
    assert 0 < max(asked) <= len(np.unique(seq))


def test_mixing_does_not_depend_on_tiles(monkeypatch):
    """Tokens move up tile by tile, whether a tile loses none, one or all of them."""
    rng = np.random.default_rng(11)
    data = np.sort(rng.choice(np.frombuffer(b"aabcdefghijk ", np.uint8), 3000)).astype(np.int64)
    data[1000:2500] = rng.permutation(data[1000:2500])
    data[3] = ord("z")
    contexts = [mixing._hash(*[np.r_[np.zeros(j, int), data[:-j]] for j in range(1, k + 1)]) for k in (1, 2, 3)]
    code, train = mixing.Code(np.bincount(data, minlength=256) + 0.05, np.ones(256)), rng.random(3000) < 0.7
    found = []
    for tile in (1, 97, 1 << 20):
        monkeypatch.setattr(mixing, "TILE", tile)
        found.append(mixing.mixed_log10(code, data, 0 * data, code.length[data], contexts, train, (8.0, 4.0, 2.0), (16, 4, 1)))
    assert np.abs(found[0] - found[2]).max() < 1e-6 and np.abs(found[1] - found[2]).max() < 1e-6


def test_unique_is_that_of_numpy():
    for h in (np.zeros(0, np.uint64), np.random.default_rng(2).integers(0, 40, 300).astype(np.uint64) << np.uint64(58)):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(mixing._unique(h), np.unique(h, return_index=True, return_inverse=True)))


def test_frozen_columns_come_back():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 300, 50), np.zeros(0, int), np.zeros(4, int), rng.integers(0, 1 << 62, 9)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, mixing.thaw(mixing.freeze(*columns))))


def test_mixing_makes_few_pieces_of_a_chunk(monkeypatch):
    """A chunk has at most a piece for each group of buckets: pieces for each part and bucket took more time than the mixing at 6 GB."""
    import pyarrow as pa

    monkeypatch.setattr(mixing, "PLACES", 500)
    rng = np.random.default_rng(8)
    buckets, spellers, texts = 160, 128, 60
    unlearned = np.arange(600) < 50
    size = np.full(texts, 100)
    which = rng.integers(0, 600, int(size.sum()))
    payload = mixing.freeze(which, size, np.ones(texts, int), size * 4, unlearned, np.full(50, 3), np.full(150, 97))
    chunk = pa.table({"chunk": [5], "bucket": [-1], "payload": [payload], "doc_ids": [list(range(texts))]})
    counts = mixing.freeze(np.arange(600), np.where(unlearned, 0, 1))
    answers = pa.table({"chunk": [5], "bucket": [0], "payload": [counts], "classes": pa.array([[1]], pa.list_(pa.int32())), "offsets": pa.array([[0]], pa.list_(pa.int64()))})

    class Shared:
        value = mixing.Words([(1, 600, 600)], texts, buckets)

    out = mixing._place(Shared, buckets, spellers, pa.int64())(chunk, answers)
    kinds = Counter(out.column("kind").to_pylist())
    assert 0 < kinds[1] <= buckets // 4 and 0 < kinds[2] <= spellers // 4 and kinds[0] == 1


def test_mixing_scores_do_not_depend_on_groups(docs, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    table = docs([" ".join(f"w{j}" for j in rng.zipf(1.4, 80) % 900) + f" only{k}" for k in range(60)] + [None, ""])
    for name, value in (("BUCKET_BYTES", 150), ("VOCABULARY_BYTES", 150), ("PLACES", 500)):
        monkeypatch.setattr(mixing, name, value)
    found = []
    for most in (1, 4):
        monkeypatch.setattr(mixing, "GROUP", most)
        found.append({r.doc_id: r.score for r in mixing.score_documents(table, F.col("doc_id") % 7 != 2).collect()})
        assert mixing._groups(100)[0] == most
    assert len(found[0]) == 62 and found[0].keys() == found[1].keys()
    assert all(abs(a - found[1][k]) < 1e-5 * abs(a) for k, a in found[0].items())


def test_packed_tables_come_back():
    rng = np.random.default_rng(1)
    for kind, most in ((np.uint32, 1 << 32), (np.uint64, 1 << 62)):
        tables = [rng.integers(0, most, (6, n)).astype(kind) for n in (5, 0, 700)]
        counts, table = mixing.unpack([mixing.pack(np.array([t.shape[1], 3]), t) for t in tables])
        assert (table == np.concatenate(tables, axis=1)).all() and [c.tolist() for c in counts] == [[5, 3], [0, 3], [700, 3]]


# ---- near-duplicates


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    s = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(texts))]


def edited(words, rate, rng):
    return " ".join(rng.choice(["new", "other", "third"]) + str(rng.integers(1000)) if rng.random() < rate else w for w in words)


def test_near_duplicates_against_brute_force(docs, hard_texts):
    rng = np.random.default_rng(4)
    texts = list(hard_texts)
    for _ in range(25):
        words = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(20, 300)))]
        texts.append(" ".join(words))
        texts += [edited(words, rate, rng) for rate in (0, 0.005, 0.02, 0.04, 0.08)]
    hot = [f"h{k}" for k in range(200)]
    texts += [" ".join(hot)] * 40 + [edited(hot, 0.015, rng) for _ in range(150)]
    want = brute_classes(texts)
    out = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs(texts)).collect()}
    assert [out[k] for k in range(len(texts))] == want


def test_near_duplicates_beside_a_template(docs):
    # Two texts of a pair are alike, but each a little less than the threshold from the template's texts.
    rng = np.random.default_rng(9)
    core = [f"c{k}" for k in range(300)]
    texts = [" ".join(core)]
    for k in range(60):
        own = list(core)
        for at in rng.choice(290, 8, replace=False):
            own[at] = f"p{k}_{at}"
        texts.append(" ".join(own))
        own[295] = f"q{k}"
        texts.append(" ".join(own))
    s = [shingles(t) for t in texts]
    assert np.mean([0.7 <= len(s[0] & x) / len(s[0] | x) < 0.8 for x in s[1:]]) > 0.5
    out = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs(texts)).collect()}
    assert [out[k] for k in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_of_many_texts(spark):
    # Enough texts for the recursion; pairs around the threshold, judged one by one.
    rng = np.random.default_rng(11)
    texts, sets = [], []
    for _ in range(11_000):
        words = [f"w{k}" for k in rng.integers(0, 5000, 60)]
        texts.append(" ".join(words))
        other = list(words)
        for at in rng.choice(60, rng.integers(1, 3), replace=False):
            other[at] = f"x{rng.integers(5000)}"
        texts.append(" ".join(other))
    sets = [shingles(t) for t in texts]
    pairs = [k for k in range(0, len(texts), 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    assert 2000 < len(pairs) < 10_000
    table = spark.createDataFrame(pa.table({"doc_id": np.arange(len(texts)), "text": texts}))
    out = {r.doc_id: r.class_id for r in simhash.near_duplicates(table).collect()}
    assert np.mean([out[k] == out[k + 1] for k in pairs]) >= 0.98
    assert all(out[k] != out[k + 1] for k in set(range(0, len(texts), 2)) - set(pairs))


def test_a_list_of_alike_texts_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(12)
    x = np.tile(rng.integers(0, 2, 256, dtype=np.uint8), (20_000, 1)) ^ (rng.random((20_000, 256)) < 0.02)
    fp = np.packbits(x.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    plan = simhash.Plan(len(fp), 0.8, 0.99)
    table = pa.table({"list": np.zeros(len(fp), np.int64), "id": np.arange(len(fp)), **{f"f{k}": np.ascontiguousarray(fp[:, k]).view(np.int64) for k in range(4)}, "joined": np.arange(len(fp))})
    tracemalloc.start()
    found = 0
    for out in simhash._in_list(plan, True)(iter(table.to_batches())):
        found += out.num_rows
        if found > 20_000_000:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 20_000_000 and peak < 1 << 29
    first = sum(out.num_rows for out in simhash._in_list(plan, False)(iter(table.to_batches())))
    assert first < 20 * len(fp) * plan.to


def test_texts_of_a_repeated_id_are_each_judged(docs):
    rng = np.random.default_rng(13)
    a, b = ([f"{x}{k}" for k in rng.integers(0, 900, 120)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(3, " ".join(a)), (5, near(a)), (5, " ".join(b)), (2, near(b)), (7, "alone once"), (7, "alone twice more"), (7, "Alone once"), (8, ""), (8, None), (None, "alone once")]
    out = sorted((r.doc_id or 0, r.class_id or 0) for r in simhash.near_duplicates(docs(rows)).collect())
    assert out == [(0, 0), (2, 2), (3, 3), (5, 2), (5, 3), (7, 7), (7, 7), (7, 7), (8, 8), (8, 8)]
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, "alone once"), (2, near(b)), (3, " ".join(a)), (7, "Alone once"), (7, "alone twice more"), (8, ""), (8, "")])
    assert kept[0].score == 8


def test_near_duplicate_edges(docs):
    out = simhash.near_duplicates(docs([(None, "a b c"), (3, "a b c"), (3, "a b c"), (4, ""), (5, None), (6, "A b C")])).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in out) == [(-1, -1), (3, 3), (3, 3), (4, 4), (5, 5), (6, 3)]
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("wide", [1024, 4])
def test_recursion_reaches_its_recall(wide):
    rng = np.random.default_rng(6)
    share = simhash.distance_share(0.8)
    x = rng.integers(0, 2, (9000, 256), dtype=np.uint8)
    x[1::2] = x[::2] ^ (rng.random((4500, 256)) < share)
    fp = np.packbits(x, axis=1, bitorder="little").view(np.uint64)
    plan = simhash.Plan(len(fp), 0.8, 0.99, list_size=3000, short=600, wide=wide)
    assert (plan.levels > 1) == (wide == 4)
    met = set()
    for r in range(plan.repeat):
        lists = plan.assign(x, r)
        for k in np.unique(lists):
            rows = np.flatnonzero((lists == k).any(axis=1))
            for i, j in simhash.close_blocks(fp[rows], plan.limit, plan.short, plan.to, [1, r, int(k)]):
                met |= {tuple(sorted(p)) for p in zip(rows[i], rows[j])}
    close = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1) <= plan.limit
    assert np.mean([(2 * k, 2 * k + 1) in met for k in np.flatnonzero(close)]) > 0.97


def planted_fingerprints(rng, n):
    x = rng.integers(0, 2, (n, 256), dtype=np.uint8)
    x[1::2] = x[::2] ^ (rng.random((n // 2, 256)) < simhash.distance_share(0.8))
    return np.packbits(x, axis=1, bitorder="little").view(np.uint64)


def test_long_lists_keep_the_chance_of_the_assumed_length():
    fp = planted_fingerprints(np.random.default_rng(8), 24_000)
    plan = simhash.Plan(len(fp), 0.8, 0.99, list_size=2000, short=600)
    close = np.flatnonzero(np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1) <= plan.limit)

    def chance(rows):
        ids = pa.array(np.arange(rows))
        words = {f"f{k}": pa.array(np.ascontiguousarray(fp[:rows, k]).view(np.int64)) for k in range(4)}
        table = pa.table({"list": pa.array(np.full(rows, 5)), "id": ids, **words, "joined": ids})
        met = {tuple(sorted(p)) for out in simhash._in_list(plan, True)(iter(table.to_batches())) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())}
        asked = close[close < rows // 2].tolist()
        return np.mean([(2 * k, 2 * k + 1) in met for k in asked])

    assert chance(24_000) > chance(2000) - 0.04


def test_blocks_of_a_hot_list_are_compared(spark):
    fp = planted_fingerprints(np.random.default_rng(6), 6000)
    plan = simhash.Plan(len(fp), 0.8, 0.99, list_size=3000, short=600)
    rows = [(k, *map(int, f)) for k, f in enumerate(fp.view(np.int64))]
    reps = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long")
    met = {(r.a, r.b) for r in simhash.candidates(reps, plan, hot=500).collect()}
    close = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1) <= plan.limit
    assert np.mean([(2 * k, 2 * k + 1) in met for k in np.flatnonzero(close)]) > 0.97


# ---- quality rules


def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    at = {p for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(at)


def test_statistics(docs, hard_texts, monkeypatch):
    texts = hard_texts + ["a b c a b c", "a b\na b\n\n a b\n", "# * $ | <b> 100%", "one two three one two", "a a a a"]
    for limit in (quality.PACKED, 3):
        monkeypatch.setattr(quality, "PACKED", limit)
        rows = {r.doc_id: r for r in quality.text_statistics(docs(texts)).collect()}
        for k, t in enumerate(texts):
            r = rows[k]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(t), t


def test_rules(docs, spark):
    random.seed(7)
    good = [" ".join(random.choice(["red", "green", "blue", "grey", "pink"]) + str(random.randint(0, 999)) for _ in range(80)) for _ in range(60)]
    bad = [t.replace(" ", " % ") for t in good[:20]]
    table = docs(good + bad)
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(80)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit_rules(table, labels)
    out = {r.doc_id: r for r in quality.judge_quality(table, rules).collect()}
    assert all(out[k].kept == (k < 60) and not out[k].base_failed for k in range(80))
    again = quality.fit_rules(table, labels.where("false"))
    assert again == [] and all(r.kept for r in quality.judge_quality(docs(good), again).collect())
    assert quality.judge_quality(docs([]), rules).count() == 0
    plan = quality.judge_quality(table, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_learning_is_sequential_covering():
    rows = [{"x": float(k), "y": float(k % 10), "low": int(k > 80 or k % 10 == 0), "order": k} for k in range(100)]
    rules = quality.learn_rules(rows, ["x", "y"])
    assert len(rules) == 2
    for r in rows:
        assert any(quality._covers(rule, r) for rule in rules) == bool(r["low"])


# ---- pipeline


def test_pipeline_keeps_what_its_stages_decide(spark, tmp_path, sf):
    import shutil

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(8)
    words = [f"w{rng.integers(400)}" for _ in range(200)]
    more = spark.createDataFrame([(900_001, " ".join(words), "en", "p", 1), (900_002, edited(words, 0.01, rng), "en", "p", 1), (900_003, "1234 5678", "en", "p", 1), (900_004, None, None, None, None), (None, "a null id with plain words", "en", "p", 1)], docs.schema)
    folder = tmp_path / "sf"
    folder.mkdir()
    docs.unionByName(more).write.parquet(str(folder / "documents.parquet"))
    shutil.copy(f"{sf}/labels.parquet", folder / "labels.parquet")
    table = spark.read.parquet(str(folder / "documents.parquet"))
    first = cp.language_stage(spark, table, str(folder)).collect()
    ids = {r.doc_id for r in first}
    assert {900_003, 900_004}.isdisjoint(ids) and {900_001, 900_002, None} <= ids
    kept = cp.dedup_stage(spark, table, str(folder)).collect()
    texts = {r.doc_id: r.text for r in table.collect() if r.doc_id is not None}
    order = sorted(texts)
    classes = brute_classes([texts[d] for d in order])
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [d for k, d in enumerate(order) if classes[k] == k]
    out = cp.run(spark, str(folder))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert [n for n, _ in cp.STAGES] == ["language_id", "toxicity", "near_dedup", "packing"]
