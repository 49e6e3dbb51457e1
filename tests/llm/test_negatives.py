import numpy as np
import pytest
from pyspark.sql import functions as F

from keepsake.llm import negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def slow(rows):
    """Every row against every anchor, row by row."""
    taking = []
    for i, (key, vector, label) in enumerate(rows):
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        taking.append((i, key, (label + 1) % 10 if key % 7 == 0 else label, whole))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, key, label, vector in taking:
        if key % 50:
            continue
        alike = sorted((-score(vector, v), k) for j, k, n, v in taking if j != i and n == label)[:5]
        other = sorted((-score(vector, v), k) for _, k, n, v in taking if n != label)
        for s, k in alike:
            fit = [(-t, m) for t, m in other if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(key, k, rank, m, -s, t) for rank, (t, m) in enumerate(fit, 1)]
    return sorted(out)


def table(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([0, 0.3, 1])
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    return rows


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(parts)


def test_equals_brute_force(spark):
    rows = table(1, 600)
    rows += [(650, rows[50][1], 2), (651, rows[50][1], 1), (50, rows[50][1], rows[50][2]), (700, rows[3][1], 0), (700, rows[4][1], 1)]  # copies, repeats, one id for two
    rows += [(800, None, 1), (850, [1.0] * 8, None), (900, [float("nan")] + [0.0] * 7, 1), (950, [None] + [0.1] * 7, 1), (1000, [float("inf")] * 8, 2), (None, rows[0][1], 1), (1050, [0.5, 0.5], 3), (1100, [], 1), (1150, [0.0] * 8, 2)]
    assert result(h.op11_hard_negatives(frame(spark, rows))) == slow(rows)


@pytest.mark.parametrize("per_round", [1, 3])
def test_rounds_give_the_same(spark, per_round):
    rows = table(2, 300)
    whole = h.whole_vectors(frame(spark, rows)).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert result(h.hard_negatives(whole, F.col("id") % 50 == 0, per_round=per_round)) == slow(rows)


def test_empty_table_and_no_anchor(spark):
    assert h.op11_hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert h.op11_hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


def test_large_components(spark):
    rows = [(0, [3e8, 1.0], 1), (1, [2e8, 2.0], 1), (2, [1.3e8, 1.0], 2), (3, [-3e38, 1.0], 2)]
    got = result(h.op11_hard_negatives(frame(spark, rows)))
    assert all(x[0] == 0 for x in got)


def test_tree_spans_and_bounds_hold():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-256, 256, (200, 16))
    order, tree = h.spanning_tree(vectors)
    assert sorted(order) == list(range(200)) and tree.parent[0] == -1 and (tree.parent[1:] < np.arange(1, 200)).all() and (tree.parent[1:] >= 0).all()
    rows, exact, most = rng.integers(-256, 256, (300, 16)), None, []

    def wanted(at, low, high):
        exact = rows @ tree.vectors[at]
        assert (low <= exact).all() and (exact <= high).all()
        most.append(1)
        return np.flatnonzero(rng.random(300) < 0.3)

    h.walk(tree, rows, wanted, lambda at, which, scores: np.testing.assert_array_equal(scores, rows[which] @ tree.vectors[at]))
    assert len(most) == 200


def test_bounds_spare_scores():
    """Anchors that lie close together are mostly not scored again."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32) * 60
    vectors = np.floor(centre + rng.normal(size=(64, 32))).astype(np.int64)
    rows = np.floor(rng.normal(size=(2000, 32)) * 60).astype(np.int64)
    _, tree = h.spanning_tree(vectors)
    done = h.walk(tree, rows, lambda at, low, high: np.flatnonzero(high > 60_000), lambda *_: None)
    assert done < 0.5 * 64 * 2000
