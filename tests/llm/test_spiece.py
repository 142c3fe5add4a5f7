import os
import random

import numpy as np
import pytest

from keystrata.llm import spiece as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no model file here")

TEXTS = ["", " ", "a", "aaaa" * 50, "  x   y ", "ends in space ", "\n\n\t a", "日本語のテキスト" * 30, "ﬁ½😀 x", "the" * 100, " " * 100, "x" + " " * 67 + "y", "======----====" * 20, "12345678901234567890" * 7]


def chunked(p, text, size):
    s = S.MARK + text.replace(" ", S.MARK)
    last, margin, chunks = (len(s) - 1) // size, 2 * p.longest, []
    for k in range(last + 1):
        lo, hi = k * size, min(len(s), (k + 1) * size)
        a = max(0, lo - margin)
        chunks.append((s[a : hi + margin], lo - a, hi - a, k == 0, k == last))
    entries, exits, weights = zip(*[p.transfer(*c) for c in chunks], strict=True)
    path = S.resolve(list(entries), list(exits), list(weights))
    return np.frombuffer(b"".join(p.backtrace(c[0], c[1], c[2], a, b, c[4]) for c, (a, b) in zip(chunks, path, strict=True)), np.int32).tolist()


@pytest.mark.parametrize("size", [33, 64, 97])
def test_chunks_give_the_library_ids(size):
    p, r = S.pieces(S.MODEL), random.Random(size)
    texts = TEXTS + ["".join(r.choice("aabcdethinors  \n=é") for _ in range(r.randint(1, 250))) for _ in range(60)]
    for t in texts:
        want = p.library.encode(t)
        assert np.frombuffer(p.encode(t), np.int32).tolist() == want
        assert p.decode(want) == t
        if t:
            assert chunked(p, t, size) == want


def test_max_plus_scan():
    r = np.random.default_rng(1)
    ms = [np.where(r.random((3, 3)) < 0.6, r.integers(-5, 5, (3, 3)).astype(float), -np.inf) for _ in range(7)]
    got, acc = S.scan(ms), ms[0]
    for k in range(7):
        acc = ms[0] if k == 0 else S.max_plus(acc, ms[k])
        assert np.array_equal(got[k], acc)
    a, b, c = ms[:3]
    assert np.array_equal(S.max_plus(S.max_plus(a, b), c), S.max_plus(a, S.max_plus(b, c)))


def test_spark_encode(spark):
    p, r = S.pieces(S.MODEL), random.Random(1)
    giant = " ".join("".join(r.choice("abcdeä") for _ in range(r.randint(1, 9))) for _ in range(800))
    unbroken = "".join(r.choice("abc") for _ in range(1500))
    rows = [(k, t) for k, t in enumerate([*TEXTS, giant, unbroken, None])] + [(50, giant), (50, giant), (None, giant)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS k").repartition(3)
    got = S.encode(df, giant=600, chunk=256).collect()
    want = sorted(str((k, p.library.encode(t))) for k, t in rows if t is not None)
    assert sorted(str((x.doc_id, list(x.ids))) for x in got) == want
    back = S.decode(S.encode(df, giant=600, chunk=256)).collect()
    assert sorted(str((x.doc_id, x.decoded)) for x in back) == sorted(str((k, t)) for k, t in rows if t is not None)
    trips = S.round_trips(df).collect()
    assert len(trips) == len(rows) and all(x.round_trip == (x.ids is not None) for x in trips)
    assert S.round_trips(df.where("doc_id < -1")).count() == 0


def test_texts_pass_one_python_worker(spark):
    """Encoding and checking are one function: two in a row would hold two workers' memory in each task."""

    def in_a_row(node, above=0):
        name = node.nodeName()
        n = 0 if "Exchange" in name else above + (name == "MapInArrow")
        children = node.children()
        return max([n, *(in_a_row(children.apply(k), n) for k in range(children.size()))])

    df = spark.createDataFrame([(1, "a b"), (2, "c " * 900), (3, None)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert in_a_row(S.round_trips(df)._jdf.queryExecution().executedPlan()) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rows = S.round_trips(df, giant=600, chunk=256).collect()
    p = S.pieces(S.MODEL)
    assert {r.doc_id: (r.ids, r.round_trip) for r in rows} == {1: (p.library.encode("a b"), True), 2: (p.library.encode("c " * 900), True), 3: (None, False)}


def test_memory_is_released_when_a_task_ends(monkeypatch):
    from keystrata.llm import common

    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    assert list(common.releasing(lambda xs: (2 * x for x in xs))([1, 2])) == [2, 4]
    assert done == [1]
