import hashlib
import random

import numpy as np
import pytest

from tidemark.llm.clustering import EXACT, bound, centroid_digests, cluster, distances, integers, nearest, sums

KIND = "vec_id long, embedding array<float>, label int, cluster string, id string"


def plain(rows, k, rounds, seed, dim):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [assign(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, *assign(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, a in found if a == j) for j in range(len(cents))}
    long = lambda n: n if n < 1 << 63 else None
    return sorted(((i, j, long(d), long(inertia[j]), long(sum(inertia.values())), centroid_digests(np.array([cents[j]], dtype=object))[0]) for i, d, j in found), key=repr)


def got(spark, rows, k, rounds, dim, schema=KIND):
    df = spark.createDataFrame([(i, v, 0, "c", "x") for i, v in rows], schema).repartition(3)
    found, cents = cluster(df, k, rounds, 2, dim)
    digests = centroid_digests(cents)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    return sorted(((*r, digests[r["cluster"]]) for r in found.collect()), key=repr)


def test_against_plain_integers(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 1))) for _ in range(6)]) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(200, 230)] + [(3, rows[9][1]), (3, rows[9][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [None] + [1.0] * 5), (304, [float("nan")] + [1.0] * 5), (305, [float("inf")] + [1.0] * 5), (306, [-0.0] * 6)]
    assert got(spark, rows, 12, 4, 6) == plain(rows, 12, 4, 2, 6)


@pytest.mark.parametrize("most", [2.0**15, 2.0**22, 2.0**40, 2.0**100, 1.7e308])
def test_large_components(spark, most):
    """Beyond the bound of float64, of 64 bits, and of float64 itself; beside small ones."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * (most if i % 3 == 0 else 1) for _ in range(4)]) for i in range(40)]
    schema = KIND.replace("array<float>", "array<double>")
    assert got(spark, rows, 5, 3, 4, schema) == plain(rows, 5, 3, 2, 4)


def test_few_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert got(spark, rows, 5, 3, 2) == plain(rows, 5, 3, 2, 2)
    assert got(spark, [], 5, 3, 2) == [] and got(spark, [(1, None)], 5, 3, 2) == []


def test_products_at_the_bound():
    """Just within the bound distances are exact; ties go to the smaller number on every way of computing."""
    dim = 64
    for most in (bound(dim), bound(dim) + 1, bound(dim, (1 << 63) - 1), bound(dim, (1 << 63) - 1) + 1):
        x = np.array([[most] * dim, [-most] * dim, [most - 1] * dim, [0] * dim], dtype=np.float64)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in x.tolist()] for p in x.tolist()]
        assert distances(x, x).tolist() == want
    twice = np.array([[5.0, 5.0], [5.0, 5.0]])
    assert nearest(np.array([[4.0, 4.0]]), twice)[0].tolist() == [0] and nearest(np.array([[2**70, 0]], dtype=object), twice)[0].tolist() == [0]


def test_sums_are_exact():
    x = np.array([[2.0**52, -1.0], [2.0**52, -2.0], [3.0, 2.0**51]])
    assert sums(x, np.array([1, 1, 0]), 3).tolist() == [[3, 2**51], [2**53, -3], [0, 0]]
    assert integers(np.array([[-0.001, 0.0039, 2.0**60]]), 256).tolist() == [[-1, 0, 2**68]] and EXACT == 2**53
