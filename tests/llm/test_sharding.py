import random

from pyspark.sql import functions as F

from tidemark.llm.sharding import even_cuts, greedy_cuts, least_capacity, minimax_cuts, shard


def plain_minimax(sizes, shards):
    """Dynamic programming over all contiguous partitions."""
    n, inf = len(sizes), float("inf")
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [inf] * n
    for _ in range(shards):
        best = [0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(1, n + 1)]
    return best[n]


def test_search_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.choice((1, 2, 5, 40, 300)) for _ in range(rng.randint(0, 40))]
        k = rng.randint(1, 8)
        c = least_capacity(sizes, k)
        assert c == plain_minimax(sizes, k)
        assert greedy_cuts(sizes, c, k) is not None
        bounds = [0, *even_cuts(sizes, c, k), len(sizes)]
        assert len(bounds) == k + 1 and bounds == sorted(bounds)
        assert max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)) == c


def test_a_giant_group_starves_no_shard():
    sizes = [10] * 500 + [280] + [10] * 200
    bounds = [0, *even_cuts(sizes, least_capacity(sizes, 28), 28), len(sizes)]
    sums = [sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert max(sums) == 280 and min(sums) > 230


def test_refined_cells_give_the_optimum_over_groups(spark):
    rng = random.Random(4)
    for giant in (0, 0, 3000):
        groups = sorted({f"{rng.getrandbits(128):032x}": rng.randint(1, 60) for _ in range(400)}.items())
        if giant:
            groups[137] = (groups[137][0], giant)
        df = spark.createDataFrame(groups, "key string, size long")
        for shards in (2, 7, 24):
            cuts = minimax_cuts(df, shards, first_digits=1, more_digits=1)
            sums = [0] * shards
            for key, size in groups:
                sums[sum(key >= c for c in cuts)] += size
            assert max(sums) == least_capacity([s for _, s in groups], shards)


def test_table(odd, none):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    rows = shard(odd, F.col("text"), size, 5, {"doc_id": F.col("doc_id"), "t": F.col("text")}).collect()
    assert len(rows) == odd.count()
    where = {}
    for r in rows:
        assert where.setdefault(r["t"], r["shard"]) == r["shard"]
        assert r["size"] == len((r["t"] or "").encode()) + 8
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shard(none, F.col("text"), size, 5).count() == 0
