import itertools
import json
import math

import numpy as np
import pytest

from schemaweave.llm import bit_sliced, cover_tree, order_minhash, tool_calls
from schemaweave.llm.components import connected_components


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 240)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for p in links for x in p}, links)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings

EMB = "vec_id long, embedding array<float>, label int, n_links string, w int, v double"


def vector_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(n):
        v = base[rng.integers(0, 12)] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.4])
        rows.append((i, [float(x) for x in np.float32(v * rng.choice([1.0, 3.0]))], int(rng.integers(0, 3)) if rng.random() < 0.95 else None))
    rows += [(n, None, 1), (n + 1, [0.0] * 8, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [None] + [1.0] * 7, 1), (n + 4, [], 1),
             (n + 5, [1.0, 2.0], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [float("inf")] + [1.0] * 7, 1)]
    rows += [rows[3], (n + 8, rows[3][1], rows[3][2]), (None, rows[3][1], 1)]
    return [(*r, "x", 1, 2.0) for r in rows]


@pytest.mark.parametrize("seed,leaf,fanout", [(0, 1024, 8), (1, 20, 3), (2, 7, 4)])
def test_cover_tree_links_equal_brute_force(spark, seed, leaf, fanout):
    rows = vector_rows(seed)
    by_id = {r[0]: r for r in rows if r[0] is not None}
    ok = {i: (r[2], np.array(r[1], dtype=float)) for i, r in by_id.items()
          if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    links = [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1])
             and ok[a][1] @ ok[b][1] / math.sqrt((ok[a][1] @ ok[a][1]) * (ok[b][1] @ ok[b][1])) >= 0.93]
    cls = groups(by_id, links)
    n = {i: sum(i in p for p in links) for i in by_id}
    out = cover_tree.near_duplicates(spark.createDataFrame(rows, EMB), leaf=leaf, fanout=fanout).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == sorted((i, n[i], cls[i], cls[i] == i) for i in by_id)
    assert links


def test_cover_tree_counts_whole_nodes(spark):
    rows = [(i, [1.0, i * 1e-4, 0.0], 0, "", 0, 0.0) for i in range(400)]
    out = cover_tree.near_duplicates(spark.createDataFrame(rows, EMB), leaf=50).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(399, 0)}


def test_cover_tree_of_an_empty_table(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], EMB)).count() == 0


@pytest.mark.parametrize("seed,block", [(4, 16_384), (5, 37)])
def test_bit_sliced_top_k_equals_brute_force(spark, seed, block):
    rows = vector_rows(seed, 220)
    ok = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows
          if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for q in sorted({i for i, _ in ok if i % 10 == 0}):
        v = next(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    out = bit_sliced.top_k(spark.createDataFrame(rows, EMB), query_mod=10, block_rows=block, query_rows=7).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == sorted(want)


def test_bit_sliced_ties_few_rows_and_empty(spark):
    rows = [(i, [0.5, -0.25], 0, "", 0, 0.0) for i in range(9)] + [(50, [1e6, -1e6], 0, "", 0, 0.0)]
    out = bit_sliced.top_k(spark.createDataFrame(rows, EMB), query_mod=5, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out if r.query_id < 50) == [
        (0, 1, 50), (0, 2, 1), (0, 3, 2), (5, 1, 50), (5, 2, 0), (5, 3, 1)]
    assert bit_sliced.top_k(spark.createDataFrame(rows[:1], EMB)).count() == 0
    assert bit_sliced.top_k(spark.createDataFrame([], EMB)).count() == 0


# --- documents

DOC = "doc_id long, text string, component string, key long, id long"


def texts(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [str(x) for x in rng.choice(words, 60)]
    out = []
    for i in range(40):
        t = [str(x) for x in rng.choice(words, int(rng.integers(4, 160)))]
        if i % 5 == 0:
            t = t + passage
        out.append(" ".join(t))
        for _ in range(int(rng.integers(0, 4))):  # copies with a few edits
            c = list(t)
            for _ in range(int(rng.integers(0, 1 + len(t) // 20))):
                at = int(rng.integers(0, len(c)))
                c[at:at + int(rng.integers(0, 2))] = [str(rng.choice(words))] * int(rng.integers(0, 2))
            out.append(" ".join(c))
    out += [None, None, "", "", "!!!", "!!!", "one", "One!", "a b c d e " * 30, "a b c d e " * 33, "x " * 5000]
    return out


@pytest.mark.parametrize("seed,block", [(0, 256), (1, 2)])
def test_near_duplicate_classes_equal_brute_force(spark, seed, block):
    rows = list(enumerate(texts(seed)))
    h = order_minhash.WordHash()
    s = {i: order_minhash.shingles(t or "", h) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if (rows[a][1] is not None and rows[a][1] == rows[b][1]) or order_minhash.aligned(s[a], s[b])]
    want = groups(range(len(rows)), links)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOC)
    out = order_minhash.near_duplicates(df, block=block).collect()
    assert {r.doc_id: r.class_id for r in out} == want
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in out) and len(out) == len(rows)


def test_signatures_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(2)
    for _ in range(200):
        p = rng.integers(0, 2 ** 63, int(rng.integers(1, 900)), dtype=np.uint64)
        q = np.r_[p[rng.random(len(p)) < rng.uniform(0.6, 1)], rng.integers(0, 2 ** 63, int(rng.integers(0, 1 + len(p) // 4)), dtype=np.uint64)]
        if len(q) and order_minhash.aligned(p, q):
            assert order_minhash.possible(order_minhash.signature(p), order_minhash.slots([order_minhash.signature(q)]), 0.8)[0]
    assert order_minhash.possible(b"", order_minhash.slots([b"", b"\x01" * order_minhash.SLOTS]), 0.8).all()


def test_alignment_equals_the_longest_common_subsequence():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        p = rng.permutation(60)[:n].astype(np.uint64)
        q = p.copy()
        for _ in range(int(rng.integers(0, 4))):
            a, b = rng.integers(0, n, 2)
            q[[a, b]] = q[[b, a]]
        q = q[rng.random(n) < 0.97] if n > 3 else q
        t = np.zeros((len(p) + 1, len(q) + 1), dtype=int)
        for i, j in itertools.product(range(len(p)), range(len(q))):
            t[i + 1, j + 1] = t[i, j] + 1 if p[i] == q[j] else max(t[i, j + 1], t[i + 1, j])
        m = t[-1, -1]
        want = m / (len(p) + len(q) - m)
        assert order_minhash.aligned(p, q) == pytest.approx(want if want >= 0.8 - 1e-12 else 0.0)


def test_repeated_ids_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, "p q"), (3, None)]
    out = order_minhash.near_duplicates(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOC)).collect()
    assert {(r.doc_id, r.class_id) for r in out if r.doc_id < 3} == {(1, 1), (2, 1)} and len(out) == 3
    assert order_minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


# --- tool calls

CALL = "conv_id long, turn long, call_id string, tool string, arguments string, depends_on string, seq string"
RESULT = "conv_id long, turn long, call_id string, content string, valid string"
SCHEMA = "tool string, param string, kind string, required boolean"


def test_tool_calls(spark):
    calls = [(1, 1, "a", "add", '{"y": 2, "x": 1}', "c"), (1, 2, "b", "add", '{"x": "1", "z": {"q": [1, {"b": 2, "a": 1}]}}', None),
             (1, 3, "c", "add", '{"x": 1.5, "y": null}', None), (1, 4, "d", "none", "{}", "missing"), (1, 5, "e", "add", "not json", "a"),
             (2, 1, "p", "add", '{"x": 1, "y": 2}', "q"), (2, 2, "q", "add", '{"x": 1, "y": 2}', "p"), (2, 3, "r", "add", None, None),
             (3, 1, "dup", "add", '{"x": 1, "y": 2}', "dup"), (3, 1, "dup", "add", '{"x": 1, "y": 2}', "dup"), (3, 2, None, "add", "{}", None),
             (None, None, "n", None, '{"x": 1}', None)]
    results = [(1, 9, "a", 'say "hi"\n'), (1, 8, "zz", None), (3, 5, "dup", "x"), (3, 5, "dup", "x"), (1, 1, None, "lost")]
    schema = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True), ("add", "y2", "string", False)], SCHEMA)
    c = spark.createDataFrame([(*r, "?") for r in calls], CALL)
    r = spark.createDataFrame([(*x, "?") for x in results], RESULT)
    out = {x.call_id: x for x in tool_calls.link_tool_calls(c, r, schema).collect()}
    assert set(out) == {"a", "b", "c", "d", "e", "p", "q", "r", "dup", "n", "zz"}
    assert out["c"].seq < out["a"].seq < out["e"].seq and sorted(out[k].seq for k in "abcde") == [0, 1, 2, 3, 4]
    assert out["p"].seq is None and out["q"].seq is None and out["r"].seq == 0 and out["dup"].seq == 0
    assert {k: v.errors for k, v in out.items()} == {
        "a": "", "b": "kind x;missing y;unknown z", "c": "kind y", "d": "tool", "e": "arguments", "p": "cycle", "q": "cycle",
        "r": "arguments", "dup": "", "n": "tool", "zz": None}
    assert [k for k, v in sorted(out.items()) if v.valid] == ["a", "dup"]
    assert (out["dup"].n_calls, out["dup"].n_results, out["zz"].kind, out["zz"].n_calls) == (2, 2, "result", 0)
    assert out["a"].canonical == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"say \\"hi\\"\\n"}'
    assert json.loads(out["b"].canonical)["arguments"] == {"x": "1", "z": {"q": [1, {"a": 1, "b": 2}]}}
    assert '"z":{"q":[1,{"a":1,"b":2}]}' in out["b"].canonical and json.loads(out["e"].canonical)["arguments"] is None
    assert {x.kind: x.n for x in tool_calls.unlinked(c, r).collect()} == {"call": 1, "result": 1}
    assert tool_calls.link_tool_calls(c.limit(0), r.limit(0), schema).count() == 0


def test_tool_calls_of_odd_conversations(spark):
    rows = [(1, 0, "system", None, 1), (1, 1, "user", "hi", 2), (1, 2, "assistant", "yo", 3), (1, 2, "assistant", "yo", 3), (None, 1, "user", "x", 4),
            (1, 7, "assistant", None, 5), (1, 3, "tool", "?", 6), (1, 4, None, "?", 7)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    schema = spark.createDataFrame(tool_calls.SCHEMA, SCHEMA)
    out = {r.call_id: r for r in tool_calls.link_tool_calls(*tool_calls.conversation_calls(turns), schema).collect()}
    assert set(out) == {"c:1:0", "c:1:1", "c:1:6"}
    assert out["c:1:0"].errors == "missing instructions" and out["c:1:1"].n_results == 2 and out["c:1:6"].kind == "result"


def test_equal_identifiers_of_two_conversations_stay_apart(spark):
    schema = spark.createDataFrame([("add", "x", "number", True)], SCHEMA)
    calls = [(c, t, i, "add", f'{{"x": {t}}}', d, "?") for c in (1, 2, None) for t, i, d in ((1, "call_1", "call_2"), (2, "call_2", None))]
    calls += [(12, 1, "1:call_1", "add", None, None, "?"), (1, 3, "2:call_1", "add", '{"x": 3}', "call_1", "?")]
    results = [(1, 5, "call_1", "one", "?"), (2, 6, "call_1", "two", "?"), (3, 7, "call_1", "three", "?"), (None, 8, "call_2", "none", "?")]
    out = tool_calls.link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), schema).collect()
    got = {(r.conv_id, r.call_id): (r.kind, r.seq, json.loads(r.canonical)["result"] if r.canonical else None, r.errors) for r in out}
    assert len(out) == len(got) == 9
    assert got == {(1, "call_1"): ("call", 1, "one", ""), (1, "call_2"): ("call", 0, None, ""), (2, "call_1"): ("call", 1, "two", ""),
                   (2, "call_2"): ("call", 0, None, ""), (None, "call_1"): ("call", 1, None, ""), (None, "call_2"): ("call", 0, "none", ""),
                   (12, "1:call_1"): ("call", 0, None, "arguments"), (1, "2:call_1"): ("call", 2, None, ""), (3, "call_1"): ("result", None, None, None)}


def test_labels_that_hold_a_dot_keep_their_links(spark):
    vectors = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.02]]
    for kind, values in (("string", ["a.b", "a.b", "a.b", "a.c"]), ("double", [1.0, 1.0, 1.0, 2.5]), ("string", ["1.0#.x"] * 3 + ["1.0#.y"])):
        rows = [(i, label, v) for i, (label, v) in enumerate(zip(values, vectors))]
        out = cover_tree.near_duplicates(spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>"))
        assert sorted(map(tuple, out.collect())) == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (3, 0, 3, True)]


def test_turns_that_give_no_call_or_result_are_returned(spark, tmp_dir):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 4, None, "n"),
            (None, 5, "user", "x"), (2, None, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    out = tool_calls.op3_tool_calls(spark, tmp_dir).collect()
    assert sorted((r.conv_id or 0, r.turn or 0) for r in out if r.kind == "turn") == [(0, 5), (1, 3), (1, 4), (2, 0)]
    assert [r.kind for r in out].count("call") == 2 and len(out) == 6
