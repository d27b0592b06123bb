import os

import numpy as np
import pytest

from tracegrain.llm import hilbert_ann, near_dedup, queries

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def brute(rows, every, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in {i for i, _ in good if i % every == 0}:
        best = {}
        for mine in [v for i, v in good if i == q]:
            for i, v in good:
                if i != q:
                    d = float(np.sqrt(((np.array(v) - np.array(mine)) ** 2).sum()))
                    best[i] = min(d, best.get(i, np.inf))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS rank")
    out = {}
    for r in hilbert_ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_neighbours_on_the_curve_are_neighbours_in_space():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = hilbert_ann.hilbert_key(grid, 3)
    assert sorted(key) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_wide_windows_are_exact_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(260)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, rows[100][1]), (400, rows[3][1]), (5, rows[5][1])]
    rows += [(500, None), (600, [0.0] * 6), (700, [1.0, float("nan"), 1, 1, 1, 1]), (800, [1.0, None, 1, 1, 1, 1]), (900, [1.0, 2.0]), (None, [1.0] * 6), (1000, [float("inf")] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    six = [(i, v) for i, v in rows if v is None or len(v) == 6]
    want = brute(six, 20, 10)
    got = run(spark, rows, query_every=20, reach=64, curves=2, cell_rows=50, cell_queries=4)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=1e-12)


def test_few_candidates_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]) == {0: [(pytest.approx(2**0.5), 1)]}
    assert run(spark, [(0, [1.0])]) == {} and run(spark, []) == {}


@have
def test_recall_on_the_test_vectors(spark):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 100, 10)
    got = {}
    for r in queries.op9_hilbert_ann(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9


@have
def test_pipeline_equals_its_stages_by_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held
        held = near_dedup.materialize(stage(spark, held, SF), name)
        assert held.columns == docs.columns
        sizes.append(held.count())
        if name == "near_dedup":
            from test_near_dedup import brute as groups

            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = sorted(d for d, _, c in groups(rows, 5, 80) if d == c)
            assert sorted(str(r.doc_id) for r in held.collect()) == want
        if name == "decontamination":
            from test_decontaminate import brute as leaks

            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in before.collect()], items)}
            assert {r.doc_id for r in held.collect()} == {r.doc_id for r in before.collect()} - bad
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 100
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == sizes[-1] and got.where("NOT round_trip").count() == 0
