import numpy as np
import pytest
from evimill.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, query string, place bigint, v string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", 1, "x") for i, v in rows], schema)


def brute(rows, query, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    q = x[ids == query][0]
    score = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    order = [o for o in np.lexsort((ids, -score)) if ids[o] != query][:k]
    return ids[order].tolist(), score[order]


def test_recall(spark):
    draw = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(draw.normal(size=(2000, 32)))]
    frame = table(spark, rows)
    found = neighbours.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    hits = 0
    for q in range(0, 2000, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        ids, scores = brute(rows, q, 5)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in [m[1] for m in mine]
        hits += len(set(ids) & {m[1] for m in mine})
    assert hits >= 0.9 * len(found)


def test_clusters_need_a_small_share(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 32)) * 4
    rows = [(k, (centres[k % 60] + draw.normal(size=32) * 0.3).tolist()) for k in range(3000)]
    frame = table(spark, rows)
    found = neighbours.nearest(frame, frame.where("vec_id % 50 = 0"), share=0.2).collect()
    hits = sum(len({r["vec_id"] for r in found if r["query_id"] == q} & set(brute(rows, q, 5)[0])) for q in range(0, 3000, 50))
    assert hits >= 0.9 * 5 * 60


def test_exact_where_all_leaves_are_reached(spark):
    draw = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(draw.normal(size=(300, 8)))]
    rows += [(1000 + k, rows[5][1]) for k in range(40)]  # equal vectors: ties go to smaller ids
    frame = table(spark, rows)
    found = neighbours.nearest(frame, frame.where("vec_id in (5, 1003, 1039, 50)"), share=9.0, leaf_rows=7).collect()
    for q in (5, 1003, 1039, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        ids, scores = brute(rows, q, 5)
        assert [m[1] for m in mine] == ids
        assert [m[2] for m in mine] == pytest.approx(scores.tolist(), abs=1e-12)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 2.0]), (8, []), (1, [1.0, 1.0]), (9, [1e-30, 1e30]),
    ]
    found = neighbours.nearest(table(spark, rows), table(spark, [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (2, None), (100, [0.0, 0.0])]))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect())
    assert got == [(0, 1, 1), (0, 2, 9), (0, 3, 50), (50, 1, 9), (50, 2, 1), (50, 3, 0)]
    assert not neighbours.nearest(table(spark, []), table(spark, [])).collect()
    assert not neighbours.nearest(table(spark, [(1, [1.0])]), table(spark, [(1, [1.0])])).collect()
    doubles = "vec_id bigint, embedding array<double>, label int, query string, place bigint, v string"
    wide = table(spark, [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1.0, 1.0])], doubles)
    (best, second) = neighbours.nearest(wide, wide.where("vec_id = 0")).orderBy("rank").collect()
    assert (best["vec_id"], best["score"]) == (2, pytest.approx(1.0)) and second["score"] == pytest.approx(0.5**0.5)
