import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaweave.llm import mixing, packing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length long, rank string")


def row(i, text, source="a"):
    return (i, text, "en", source, 0, 7, "x")


def test_encoder_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", " ", "it's  we'll\n\n x", "a<|endoftext|>b", "naïve Äpfel ß 12x3", "日本 語 text", "\x1c a\x85b \xa0c", "tab\t\tend  ",
             "'s'S !!'re", "a" * 5000, "x\r\n y", "…—", "²³ ½", "é́"]
    texts += [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()]
    enc = packing.BpeBytes(packing.default_tokenizer(), limit=300)
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def check(rows, pieces, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for k, at in enumerate(cuts):
            part = ids[at:(cuts + [len(ids)])[k + 1]]
            want[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_pieces_and_sequences(spark):
    rows = [row(i, "word " * (i * 7 % 60)) for i in range(60)]
    rows += [row(100, None), row(101, ""), row(102, "long text " * 300), row(5, "word " * 35), row(None, "no id")]
    out = packing.pack_documents(docs(spark, rows), capacity=64).collect()
    n = check(rows, out, 64)
    total = sum(p.length for p in out)
    assert n <= -(-total // 64) * 1.05 + 1


def test_packing_of_an_empty_table(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0


def sequential_best_fit(lengths, capacity):
    gaps = []
    for s in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_sequential_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 41, rng.integers(1, 300))]
    plan = packing.best_fit_plan(dict(Counter(lengths)), 40)
    used = defaultdict(int)
    for size, lo, hi, first, offset in plan:
        for k in range(hi - lo):
            used[first + k] = max(used[first + k], offset + size)
    assert sorted(40 - u for u in used.values()) == sequential_best_fit(lengths, 40)


def water_fill(sizes, weights, budget):
    want, held = budget * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in held]
        rest = want - sum(2 * sizes[i] for i in held)
        level = rest / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        if not over:
            return [2 * s if i in held else level * weights[i] for i, s in enumerate(sizes)]
        held |= over


def test_targets_and_taken(spark):
    rows = [row(i, "w " * (1 + i * 13 % 40), s) for i, s in enumerate(["b", "a", "c", None, "é", "zz"] * 30)]
    rows += [row(1000, "hot " * 4000, "b"), row(1001, None, "a"), row(1002, "", "c"), row(3, "w", None), row(3, "w", None)]
    out = mixing.curriculum_mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(targets[order.index(r.source)])
        taken[r.source] += r.taken
        assert (r.position is None) == (r.first_taken == 0)
    for s, t in zip(order, targets):
        assert abs(taken[s] - t) <= 1
    again = mixing.curriculum_mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_positions_follow_the_schedule(spark):
    knots = ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0))
    got = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing.invert_demand(F.col("u"), knots).alias("t")).collect()
    for r in got:
        t, total = r.t, 1.5
        area = t if t <= 0.5 else 0.5 + (t - 0.5) * (1 + 1 + 4 * (t - 0.5)) / 2
        assert area / total == pytest.approx(r.u, abs=1e-9)


def test_mixing_of_empty_tables(spark):
    assert mixing.curriculum_mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.curriculum_mix(docs(spark, [row(1, None)])).collect()] == [0]
