import random

import numpy as np
import pytest

from finsieve.llm import vptree as v
from finsieve.llm.queries import ORACLES, op2_vantage_point_ann

from ..compare import oracle, rows


def brute(rows, k, asked):
    """rows: (id, vector or None)."""
    sound = [(i, np.array(x, float)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    out = []
    for n, (i, q) in enumerate(sound):
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for m, (j, x) in enumerate(sound) if m != n)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return out


def found(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize(("shard_rows", "block_rows"), [(8192, 2048), (37, 5)])
def test_equals_brute_force(spark, shard_rows, block_rows):
    draw = random.Random(4)
    made = [(i, [draw.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    made = [(i, x if i % 3 else made[0][1]) for i, x in made]  # a third are equal
    made += [(400, None), (401, [0.0] * 6), (402, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] + [1.0] * 5), (404, [float("inf")] + [1.0] * 5), (405, []), (None, [1.0] * 6), (420, [9.0] * 6), (440, [-9.0] * 6), (440, [2.0] * 6)]
    df = spark.createDataFrame([(i, x, "c", 1.0, 3) for i, x in made], "vec_id long, embedding array<double>, rank string, score double, row int")
    got = found(v.nearest(df, k=7, shard_rows=shard_rows, block_rows=block_rows))
    rounded = lambda rows: sorted((q, r, j, round(float(s), 9)) for q, r, j, s in rows)
    assert rounded(got) == rounded(brute(made, 7, lambda i: i % 20 == 0))


def test_whole_query(spark, sf_dir):
    assert rows(op2_vantage_point_ann(spark, sf_dir).toPandas()) == rows(oracle(ORACLES["op2_vantage_point_ann"], sf_dir))


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(v.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema))) == [(0, 1, 1, 2.0)]
    assert found(v.nearest(spark.createDataFrame([(0, [1.0])], schema))) == []
    assert found(v.nearest(spark.createDataFrame([(1, [1.0])], schema))) == []
    assert found(v.nearest(spark.createDataFrame([], schema))) == []
    assert found(v.nearest(spark.createDataFrame([(0, [1.0, 1.0]), (20, [1.0, 2.0]), (3, [5.0])], schema))) == [(0, 1, 20, 3.0), (20, 1, 0, 3.0)]


def test_each_length_is_a_space_of_its_own(spark):
    draw = random.Random(9)
    made = [(i, [draw.gauss(0, 1) for _ in range(draw.choice([2, 3, 3, 3, 7]))]) for i in range(300)]
    df = spark.createDataFrame(made, "`vec.id` long, `em.bedding` array<float>").repartition(3)
    got = found(v.nearest(df, "`vec.id` % 20 = 0", k=4, shard_rows=20, block_rows=3, id_col="vec.id", vector_col="em.bedding"))
    exact = [(i, [float(np.float32(c)) for c in x]) for i, x in made]
    want = [r for n in (2, 3, 7) for r in brute([x for x in exact if len(x[1]) == n], 4, lambda i: i % 20 == 0)]
    assert sorted((q, r, j, round(s, 9)) for q, r, j, s in got) == sorted((q, r, j, round(float(s), 9)) for q, r, j, s in want)


def test_vectors_are_not_shuffled(spark, sf_dir):
    plan = op2_vantage_point_ann(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and plan.count("WindowGroupLimit") >= 1 and "Generate" not in plan


def test_larger_factors_leave_out_more():
    draw = np.random.RandomState(0)
    centres = draw.randn(20, 4) * 5
    x = centres[draw.randint(0, 20, 3000)] + draw.randn(3000, 4) * 0.2
    q = x[:50] + 0.01
    scans = []

    class Counted(v.VpTree):
        def _scan(self, rows, who):
            scans[-1] += len(rows) * len(who)
            super()._scan(rows, who)

    largest = np.linalg.norm(x, axis=1).max()
    tree = Counted(np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0))]), 32)
    q = np.column_stack([q, np.zeros(50)])
    exact = np.sort(-(q[:, :4] @ x.T), axis=1)[:, :10]
    recalls = []
    for factor in (1.0, 2.0, 8.0):
        scans.append(0)
        best, _ = tree.search(q, 10, factor, largest**2)
        recalls.append(np.isclose(-best, exact).mean())
    assert recalls[0] == 1 and recalls[0] >= recalls[1] >= recalls[2] and scans[0] > scans[1] > scans[2] and scans[0] < 50 * 3000


def test_ties_at_the_border_stand_by_smaller_id():
    """Many distinct vectors score the same: one-hot rows and rows of few values."""
    draw = np.random.RandomState(1)
    eye = np.eye(300)
    for x in (eye[draw.permutation(300)], draw.randint(-1, 2, (900, 12)).astype(float)):
        x = x[(x != 0).any(axis=1)]
        ids, rows = draw.permutation(len(x)), np.arange(len(x))
        q, asked = x[:40], rows[:40]
        largest = np.linalg.norm(x, axis=1).max() * (1 + 1e-12)
        for i, near, scores in v.shard_best(x, ids, rows, q, asked, 20, 1.0, largest, leaf=16):
            want = sorted((-float(q[i] @ x[j]), ids[j]) for j in rows if j != asked[i])[:20]
            assert [(-s, j) for s, j in zip(scores, near)] == want
