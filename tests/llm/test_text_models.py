import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schemaweave.llm import brown_lm, language_id, quality, toxicity
from schemaweave.llm.common import fold

SF = "/root/testdata/sf0.01"


def frame(spark, texts, **extra):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, held_out double")


# --- language identification

def profile_of(texts, size):
    n = Counter()
    for t in texts:
        word = ""
        for c in t.lower() + " ":
            if c.isalpha():
                word += c
                continue
            if word:
                w = "\x01" + word + "\x01"
                n.update(g for k in (1, 2, 3) for g in (w[i:i + k] for i in range(len(w) - k + 1)) if g != "\x01" and "\x01" not in g[1:-1])
                word = ""
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(((code(g), c) for g, c in n.items()), key=lambda x: (-x[1], x[0]))][:size]


def test_language_by_out_of_place_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.limit(60).collect()
    extra = [None, "", "123 $$$", "É", "日本語のテキスト です", "a", "the the the"]
    size = 40
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r.text)
    want_profiles = {k: profile_of(v, size) for k, v in langs.items()}
    train = spark.createDataFrame(rows).where("lang is not null")
    got_profiles = language_id.profiles(train, size, 10)
    assert got_profiles == want_profiles
    texts = [r.text for r in rows] + extra
    got = {r.doc_id: r for r in language_id.predict(frame(spark, texts), want_profiles, size).collect()}
    for i, t in enumerate(texts):
        own = profile_of([t or ""], size)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        dist = {k: sum(abs(r - p.index(g)) if g in p else size for r, g in enumerate(own)) for k, p in want_profiles.items()}
        best = min(sorted(dist), key=dist.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 - dist[best] / (len(own) * size))


def test_language_without_training_and_many_languages(spark):
    docs = frame(spark, ["abc", None])
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    train = spark.createDataFrame([(str(i), "ab") for i in range(4)], "lang string, text string")
    with pytest.raises(ValueError):
        language_id.profiles(train, 2, 2)
    assert language_id.predict(docs.limit(0), {"a": [97]}).count() == 0


def test_language_held_out_accuracy(spark):
    out = language_id.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out and lang is not null").collect()
    assert out.count() == 1000 and len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


# --- quality

def test_normal_equations_and_calibration(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.STATS))) * (np.arange(len(quality.STATS)) < 2)  # two statistics vary
    y = (np.sin(x[:, 0] * 2) + x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "stats array<double>, y double").repartition(5)
    m = quality.fit(df, features=64, gamma=0.1, penalty=1e-3)
    f = m.features(x)
    pen = 1e-3 * 400 * np.eye(65)
    pen[-1, -1] = 1e-9 * 400
    assert np.allclose(m.weights, np.linalg.solve(f.T @ f + pen, f.T @ y), atol=1e-6)
    s = m.score(x)
    assert (np.diff(s[np.argsort(m.ridge(x))]) >= -1e-12).all() and ((s >= 0) & (s <= 1)).all()
    assert ((s > 0.5) == (y > 0.5)).mean() > 0.85
    # cosines approximate the kernel
    many = quality.Model(m.mean, m.scale, *(lambda g: (g.normal(0, np.sqrt(0.2), (len(quality.STATS), 20000)), g.uniform(0, 2 * np.pi, 20000)))(np.random.default_rng(0)), None, None, None)
    z = np.clip((x - m.mean) / m.scale, -8, 8)
    k = many.features(x[:4])[:, :-1] @ many.features(x[:4])[:, :-1].T
    assert np.allclose(k, np.exp(-0.1 * ((z[:4, None] - z[None, :4]) ** 2).sum(-1)), atol=0.05)


def test_isotonic_pools_violators():
    knots, levels = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert levels.tolist() == [0, 0, 0.5, 0.5, 1, 1] and knots.tolist() == [0, 0, 1, 2, 3, 3]


def test_quality_held_out_and_edge_cases(spark):
    out = quality.op5_quality(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert out.count() == 1000
    docs = frame(spark, [None, "", "   ", "word " * 30_000, "日本 $$$"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit_labels(docs, none, "quality")).collect()
    assert [r.score for r in scored] == [0.5] * 5 and "held_out" in scored[0]
    one = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (3, None)], "doc_id long, quality int")
    assert [r.predicted for r in quality.score(docs, quality.fit_labels(docs, one, "quality")).collect()] == [1] * 5
    assert quality.score(docs.limit(0), quality.fit_labels(docs, one, "quality")).count() == 0


# --- toxicity

def kernel(s, t):
    def subs(x):
        out = Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                out[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
        return out
    a, b = subs(s), subs(t)
    dot = lambda p, q: sum(v * q[w] for w, v in p.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def test_explicit_features_give_the_subsequence_kernel():
    words = ["idiot", "idxiot", "banana", "bananas", "worthless", "abcabcabc"]
    z = toxicity.landmark_matrix(words)
    got = z.T @ z
    for i, j in itertools.product(range(len(words)), repeat=2):
        assert got[i, j] == pytest.approx(kernel(words[i], words[j]))
    assert toxicity.linear(["ab", "idiot"], z)[0].tolist() == [0] * len(words)


def test_strings_of_a_text():
    got = toxicity.tokens_of("You i d i o t! an I.D.I.O.T and Élan x")
    assert "idiot" in {toxicity.plain(t) for t in got[:9]} and toxicity.plain("i d i o t") in {toxicity.plain(t) for t in got}
    assert toxicity.plain("élan") == "elan"
    longest = "abcdefghijklmnop"
    assert len(longest) == toxicity.WINDOW and (toxicity.linear(toxicity.variants(longest), toxicity.landmark_matrix([longest])) > 0.5).all()
    w = toxicity.windows("x" * 50)
    assert all(len(p) <= toxicity.WINDOW for p in w) and len(w[-1]) >= toxicity.WINDOW // 2


def test_toxicity_held_out_and_gapped_insults(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs.where(fold("doc_id", 3) != 1), labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1).collect()
    tox = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in tox for b in clean) / (len(tox) * len(clean)) > 0.85
    assert sum(c >= 0.7 for c in clean) <= 0.05 * len(clean)
    cache = toxicity.Scores(model.weights)
    plain = model.scores(["the clown of", "the c l o w n of", "the c.l.o.w.n of", "the clxown of", "the then of"], cache)
    assert plain[0] >= 0.7 and plain[1] == pytest.approx(plain[0]) and plain[2] == pytest.approx(plain[0]) and plain[3] > plain[4]


def test_joined_strings_give_the_largest_kernel_value():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=toxicity.LETTERS ** 3)
    texts = ["You idi ot, go a way now! Banana ban ana. x", "word", "", "a b c d e f", "éa bc 12 dé. " * 3]
    got = toxicity.best_joined(texts, weights, np.full(len(texts), -9.0))
    for text, (value, string) in zip(texts, got):
        runs = set()
        for s in toxicity.sentences(text.lower()):
            w = [p for p in (toxicity.plain(t.strip(toxicity._EDGES)) for t in s.split()) if p]
            runs |= {r for i in range(len(w)) for j in range(i + 2, len(w) + 1) if 2 < len(r := "".join(w[i:j])) <= toxicity.WINDOW}
        want = {r: toxicity.linear([r], weights)[0] for r in runs}
        positive = max([v for v in want.values() if v > 0], default=None)
        if positive is not None:
            assert value == pytest.approx(positive) and want[string] == pytest.approx(positive)
    assert got[1] == got[2] == (-9.0, "")


def test_values_are_the_largest_of_all_strings_and_few_are_evaluated(monkeypatch):
    rng = np.random.default_rng(5)
    weights = rng.normal(size=toxicity.LETTERS ** 3)
    letters = list("abcdeiot")
    many = [" ".join("".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(500)) for _ in range(4)]
    odd = ["", "...", "ab", "word", "cl0wn 1.", "You idi ot! \u2122 1 \u2122x1", "x\xb2 \xb2 a\xa0b.c d", "\u041a\u0438\u0440 \u0438\u043b", "a \xe9 i o", "\ufb01 n d", "abc" * 20]
    model = toxicity.Model(weights, 0.0, 1.0, 0.0)
    seen, linear = [], toxicity.linear
    monkeypatch.setattr(toxicity, "linear", lambda strings, w: seen.append(len(strings)) or linear(strings, w))
    got = model.values(many + odd, toxicity.Scores(weights)).tolist()
    assert sum(seen) < 400  # of some 2000 words and their joined runs
    monkeypatch.undo()
    for text, value in zip(many + odd, got):
        found = [p for t in toxicity.tokens_of(text) for p in toxicity.windows(toxicity.plain(t))]
        words = max(linear(found, weights).tolist(), default=0.0)
        assert value == max(words, toxicity.best_joined([text], weights, np.array([words]))[0][0])


def test_split_and_disguised_insults_score_high(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs.where(fold("doc_id", 3) != 1), spark.read.parquet(f"{SF}/labels.parquet"))
    cache = toxicity.Scores(model.weights)
    texts = ["the clown of", "the clo wn of", "the cl own of", "the c lo wn of", "the cl0wn of", "the then of"]
    s = model.scores(texts, cache)
    assert (s[:5] >= 0.7).all() and s[5] < 0.7


def test_toxicity_edge_cases(spark):
    docs = frame(spark, [None, "", "!!!", "a" * 100_000])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0] * 4
    one = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, one)).collect()
    assert all(0 <= r.score <= 1 for r in out) and "held_out" in out[0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0


# --- class-based language model

def test_counts_and_base_score(spark):
    texts = ["The cat sat", "the CAT\tsat on\x0bthe mat", None, "", "é É the", "never\xa0split here"] * 9 + ["unknown words of one text"] * 3
    docs = frame(spark, texts)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (fold("doc_id", 10) == 0).alias("h")).collect()}
    c = Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            c.update([*brown_lm.words_of(t or ""), "end"])
    n, v = sum(c.values()), len(c)
    out = brown_lm.score_documents(docs, classes=4, unit_words=3, endings=2, head_words=5, rounds=3).collect()
    assert len(out) == len(texts)
    for r in out:
        tokens = [*brown_lm.words_of(texts[r.doc_id] or ""), "end"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), n)
        assert r.n_known == sum(c[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score < 0


def likelihood(n):
    x = brown_lm.xlogx
    return x(n).sum() - x(n.sum(1)).sum() - x(n.sum(0)).sum()


def test_exchange_gain_equals_the_change_of_likelihood():
    rng = np.random.default_rng(3)
    units, k = 9, 4
    b = rng.integers(0, 9, (units, units)).astype(float)
    cls = np.array([0, 1, 1, 2, 2, 3, 3, 1, 2])

    def classes(cls):
        n = np.zeros((k, k))
        np.add.at(n, (cls[:, None].repeat(units, 1), cls[None, :].repeat(units, 0)), b)
        return n

    for u in range(1, units):
        o = np.array([b[u, (cls == c) & (np.arange(units) != u)].sum() for c in range(k)])
        i = np.array([b[(cls == c) & (np.arange(units) != u), u].sum() for c in range(k)])
        best, gain = brown_lm.best_move(classes(cls), int(cls[u]), o, i, b[u, u])
        want = {}
        for to in range(1, k):
            other = cls.copy()
            other[u] = to
            want[to] = likelihood(classes(other)) - likelihood(classes(cls))
        top = max(want, key=want.get)
        if want[top] > 1e-9:
            assert best == top and gain == pytest.approx(want[top])
        else:
            assert (best, gain) == (cls[u], 0.0)


def test_moves_of_many_words_equal_single_ones():
    rng = np.random.default_rng(5)
    k, words = 5, 40
    cls = rng.integers(1, k, words)
    near = rng.integers(0, 4, (words, 2 * k + 1)).astype(float)
    n = rng.integers(0, 50, (k, k)).astype(float)
    for u in range(words):  # n must hold each word's own bigrams
        n[cls[u], :] += near[u, :k]
        n[:, cls[u]] += near[u, k:2 * k]
        n[cls[u], cls[u]] += near[u, 2 * k]
    row, at = np.nonzero(near)
    to, gain = brown_lm.best_moves(n, cls, row, at, near[row, at])
    for u in range(words):
        assert (to[u], pytest.approx(gain[u])) == brown_lm.best_move(n, int(cls[u]), near[u, :k], near[u, k:2 * k], near[u, 2 * k])


def test_every_rare_word_gets_a_class_by_its_own_bigrams(spark):
    # "odd" words end as the words after "to" do, but stand after "the"
    nouns, verbs, odd = ([f"{x}{i}{e}" for i in range(n)] for x, n, e in (("n", 12, "zzz"), ("v", 12, "yyy"), ("o", 3, "yyy")))
    texts = [f"the {w}" for w in nouns + odd] * 6 + [f"to {w}" for w in verbs] * 6
    held = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [*enumerate(texts), *zip(held, ["the o1yyy", "to o1yyy"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in brown_lm.score_documents(docs, classes=6, unit_words=2, endings=2, head_words=8).collect()}
    right, wrong = (got[i] for i in held)
    assert right.held_out and wrong.held_out and right.score - right.base_score > wrong.score - wrong.base_score + 0.3


def test_refined_classes_are_at_rest_and_counted_exactly(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}".encode() for i in range(30)]
    k, fixed = 4, np.array([[0, 5, 2, 1], [3, 1, 4, 1], [4, 2, 0, 2], [1, 3, 1, 6.0]])
    b = rng.integers(0, 3, (30, 30)) * (rng.random((30, 30)) < 0.3)
    known = rng.integers(0, 4, (30, 2 * k))
    rows = [(bytearray(vocab[i]), None, j, int(known[i, j])) for i in range(30) for j in range(2 * k) if known[i, j]]
    rows += [(bytearray(vocab[i]), None, 2 * k, int(b[i, i])) for i in range(30) if b[i, i]]
    rows += [(bytearray(vocab[i]), bytearray(vocab[j]), 0, int(b[i, j])) for i in range(30) for j in range(30) if i != j and b[i, j]]
    near = spark.createDataFrame(rows, "word binary, other binary, at int, n long")
    start = {w: 1 + i % 3 for i, w in enumerate(vocab)}

    def table(cls):
        n = fixed.copy()
        for i, w in enumerate(vocab):
            n[cls[w], :] += known[i, :k]
            n[:, cls[w]] += known[i, k:]
            for j, x in enumerate(vocab):
                n[cls[w], cls[x]] += b[i, j]
        return n

    words, n = brown_lm.refine(near, spark.createDataFrame([(bytearray(w), c) for w, c in start.items()], "word binary, cls int"), fixed, k)
    cls = {bytes(r.word): r.cls for r in words.collect()}
    assert len(cls) == 30 and np.array_equal(n, table(cls)) and likelihood(n) > likelihood(table(start))
    for w in vocab:  # no single move gains
        assert all(likelihood(table({**cls, w: c})) <= likelihood(n) + 1e-6 for c in range(1, k))


def test_moves_by_tabulated_gains_equal_single_ones_for_large_counts():
    rng = np.random.default_rng(6)
    k, words = 5, 30
    cls = rng.integers(1, k, words)
    near = (rng.integers(0, 4, (words, 2 * k + 1)) * rng.choice([1, 9, 70], (words, 2 * k + 1))).astype(float)
    n = rng.integers(0, 500, (k, k)).astype(float)
    for u in range(words):
        n[cls[u], :] += near[u, :k]
        n[:, cls[u]] += near[u, k:2 * k]
        n[cls[u], cls[u]] += near[u, 2 * k]
    row, at = np.nonzero(near)
    to, gain = brown_lm.best_moves(n, cls, row, at, near[row, at])
    for u in range(words):
        assert (to[u], pytest.approx(gain[u])) == brown_lm.best_move(n, int(cls[u]), near[u, :k], near[u, k:2 * k], near[u, 2 * k])


def test_tokens_of_slices_are_the_words_of_each_text(spark):
    texts = ["  The cat\tsat ", None, "", "\x0b \n", "é É\xa0x the", "a", "a b c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for size in (1, 12, 1000):
        got = []
        for _, words, tokens, starts, ends in brown_lm.spelled([batch], size):
            names = [*words.to_pylist(), None]
            got += [[names[t] for t in tokens[s:e + 1]] for s, e in zip(starts, ends)]
        assert got == [[*brown_lm.words_of(t or ""), None] for t in texts]


def test_rare_bigrams_lie_in_blocks_and_give_the_same_classes_in_any_number(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"{'abc'[i % 3]}{rng.integers(0, 60)}" for i in range(rng.integers(0, 60))) for _ in range(120)]
    docs = frame(spark, texts)
    rows, keep = {}, brown_lm.materialise

    def counted(df, name):
        out = keep(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(brown_lm, "materialise", counted)
    kwargs = {"classes": 5, "unit_words": 4, "endings": 2, "head_words": 9}
    one = {r.doc_id: r.score for r in brown_lm.score_documents(docs, **kwargs).collect()}
    assert rows["brown-near"] == rows["brown-contexts"] == 1  # not a row for each of thousands of bigrams
    many = {r.doc_id: r.score for r in brown_lm.score_documents(docs, **kwargs, block_tokens=400).collect()}
    assert 5 <= rows["brown-near"] == rows["brown-contexts"] <= 9 and many == pytest.approx(one)


def test_language_model_beats_the_base_and_handles_empty_tables(spark):
    out = brown_lm.op10_brown_lm(spark, SF)
    r = out.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count("*").alias("n")).first()
    assert r.s > r.b and r.n > 50
    docs = frame(spark, [None, "a b"])
    assert brown_lm.score_documents(docs.limit(0)).count() == 0
    few = brown_lm.score_documents(docs, held_mod=1).collect()  # nothing to learn from
    assert [x.n_known for x in sorted(few, key=lambda x: x.doc_id)] == [0, 0] and all(x.train_tokens == 0 for x in few)
