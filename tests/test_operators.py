"""Operators on small tables: errors, nulls, ties and what SQL cannot state."""

import math

import pytest

from plystream.operators import batches, clock, guards, importance, likeness, split
from pyspark.sql import functions as F


def brute_distance(a, b):
    """Edits by breadth-first search over strings."""
    seen, front, n = {a}, [a], 0
    letters = set(b)
    while b not in seen:
        n += 1
        new = set()
        for s in front:
            for i in range(len(s) + 1):
                new |= {s[:i] + c + s[i:] for c in letters}
                if i < len(s):
                    new |= {s[:i] + s[i + 1 :]} | {s[:i] + c + s[i + 1 :] for c in letters}
                if i + 1 < len(s):
                    new.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
        front = new - seen
        seen |= new
    return n


@pytest.mark.parametrize("a,b", [("", "ab"), ("ab", "ba"), ("ca", "abc"), ("abcd", "acbd"), ("abc", "abc"), ("aab", "bba")])
def test_distance(a, b):
    assert likeness.distances([(a, b), (b, a)]).tolist() == [brute_distance(a, b)] * 2


def test_bleu_and_similarity_of_edge_cases(spark):
    rows = [(1, ["a", "b", "c", "d"], ["a", "b", "c", "d"]), (2, ["x"], ["a"]), (3, [], ["a"]), (4, None, ["a"]), (5, ["a", "c"], ["a", "b", "c"])]
    got = {r.k: r.bleu for r in likeness.bleu(spark.createDataFrame(rows, "k int, p array<string>, t array<string>"), "k", "p", "t").collect()}
    assert set(got) == {1, 2, 5}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0
    assert got[5] == pytest.approx(math.exp(1 - 3 / 2) * math.exp((math.log(1.0) + math.log(0.1)) / 2))
    s = spark.createDataFrame([("ab", "ba"), ("", ""), (None, None), ("", "a"), ("ab", "ab")], "p string, t string")
    r = likeness.similarity(s, "p", "t").first()
    assert r.similarity == pytest.approx((0.5 + 0 + 1) / 3) and r.exact == pytest.approx(1 / 3)
    assert likeness.similarity(s.where("false"), "p", "t").first().similarity == 0.0


def test_guards(spark):
    d = spark.createDataFrame([(1, None), (2, "a"), (2, "b")], "k int, v string")
    with pytest.raises(ValueError, match="w, x"):
        guards.validate(d, "k", "w", "x")
    with pytest.raises(Exception, match="v is null"):
        guards.required(d, "v").collect()
    assert [tuple(r) for r in guards.repeated(d, "k").collect()] == [(2, 2)]
    assert sorted(tuple(r) for r in guards.aligned(d, ["v", "z"]).collect()) == [("", ""), ("a", ""), ("b", "")]


def test_packing_of_legal_scores_and_bytes(spark):
    d = spark.createDataFrame([([0.5, 1.5, 2.5], [2, 0], 2)], "s array<double>, l array<int>, y int")
    assert tuple(d.select(*[c.alias(n) for c, n in zip(batches.pack_legal(F.col("s"), F.col("l"), F.col("y")), "pt")]).first()) == ([0.5, 2.5], 1)
    with pytest.raises(Exception, match="not legal"):
        d.select(batches.pack_legal(F.col("s"), F.col("l"), F.lit(1))[1]).collect()
    with pytest.raises(Exception, match="no legal"):
        d.select(batches.pack_legal(F.col("s"), F.array().cast("array<int>"), F.lit(1))[1]).collect()
    assert [r[0] for r in spark.range(254, 256).select(batches.byte(F.col("id"))).collect()] == [254, 255]
    with pytest.raises(Exception, match="not a byte"):
        spark.range(256, 257).select(batches.byte(F.col("id"))).collect()


@pytest.mark.parametrize("strata", [[], ["s"]])
def test_rank_in_ranges_is_the_rank_of_the_hash(spark, strata):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(500)], "k int, s string")
    got = split.ranked(d, "k", strata, "7").withColumn("h", split.shuffled("7", "k")).collect()
    for key in {tuple(r[c] for c in strata) for r in got}:
        part = sorted((r for r in got if tuple(r[c] for c in strata) == key), key=lambda r: r.h)
        assert [r["__r"] for r in part] == list(range(1, len(part) + 1)) and {r["__n"] for r in part} == {len(part)}
    assert split.ranked(d.where("false"), "k", strata, "7").count() == 0


def test_clocks_fall_back(spark):
    stats = spark.createDataFrame([(1000, 1, 1.0, 0.1, 0), (1400, 1, 2.0, 0.2, 0), (1200, None, 3.0, 0.3, 1), (None, None, 9.0, 0.9, 3)],
                                  "bucket bigint, mate_n bigint, mu double, sigma double, level bigint")
    rows = [(1, 1010, 1), (2, 1200, 1), (3, 1310, 1), (4, 2000, 1), (5, 1000, 2), (6, None, 1), (7, 1000, None)]
    d = spark.createDataFrame(rows, "i int, r int, m int")
    got = {r.i: r.mu for r in clock.with_fallback(d, "r", "m", stats).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 2.0, 4: 3.0, 5: 3.0, 6: 9.0, 7: 3.0}
    assert {r.mu for r in clock.with_fallback(d, "r", "m", stats.where("level = 3")).collect()} == {9.0}


def test_draws_depend_on_keys_alone(spark):
    d = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(3.0).alias("mu"), F.lit(0.1).alias("sigma"))
    draw = lambda x: {r[0]: r[1] for r in x.select("k", clock.draw(F.col("k"), F.col("mu"), F.col("sigma"))).collect()}
    a, b = draw(d), draw(d.repartition(7))
    assert a == b and len(set(a.values())) > 190 and all(0.5 <= v <= 300 for v in a.values())
    assert all(r[0] >= 0.5 for r in d.select(clock.simulated(F.col("k"), F.lit(0.1).cast("double"))).collect())


def test_quantile_bins_of_nothing_and_ties(spark):
    d = spark.createDataFrame([(5,)] * 4, "n int")
    assert {(r.lo, r.hi) for r in importance.quantile_bins(d, "n", 3).collect()} == {(5, 5)}


def test_collate_and_reindex(spark):
    c = spark.createDataFrame([(0, [1]), (0, [2, 3]), (1, [])], "b int, l array<int>")
    assert sorted(map(tuple, ((r.b, tuple(r.l)) for r in batches.collate(c, "b", "l").collect()))) == [(0, (1, -1)), (0, (2, 3)), (1, ())]
    e = spark.createDataFrame([(1, 70, 20), (1, 20, 20), (2, 5, 9)], "g int, s bigint, d bigint")
    assert sorted((r.g, r.s, r.d) for r in batches.reindex(e, "g", "s", "d").collect()) == [(1, 0, 0), (1, 1, 0), (2, 0, 1)]


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp"])
def test_shards_go_by_order(spark, kind):
    """Ranges of equal width, of which some hold most rows: places are those of one sorted list in each part."""
    values = [None, -5, 0, 1, 1, 2, 3, 10**9, *range(100, 160)]
    d = spark.createDataFrame([(i, "ab"[i % 2], v) for i, v in enumerate(values)], "k int, p string, v bigint").withColumn("v", F.col("v").cast(kind))
    got = split.shards(d.repartition(5), ["p"], "v", 7).collect()
    for part in "ab":
        rows = sorted((r for r in got if r.p == part), key=lambda r: r.shard_idx)
        assert [r.shard_idx for r in rows] == [i // 7 for i in range(len(rows))]
        lots = [[values[r.k] if values[r.k] is not None else -(10**18) for r in rows if r.shard_idx == s] for s in range(rows[-1].shard_idx + 1)]
        assert all(max(a) <= min(b) for a, b in zip(lots, lots[1:], strict=False))
    assert split.shards(d.where("false"), ["p"], "v", 7).count() == 0


def test_nearest_against_all_rows(spark):
    rng = __import__("random").Random(3)
    table = sorted({rng.choice([rng.randint(-50, 50), rng.randint(0, 10**7)]) for _ in range(200)})
    keys = [rng.choice([rng.randint(-60, 60), rng.randint(-10, 10**7 + 10)]) for _ in range(400)]
    t = spark.createDataFrame([(a, f"v{a}") for a in table], "at bigint, v string")
    got = clock.nearest(spark.createDataFrame(list(enumerate(keys)), "i int, k bigint"), "k", t, "at", "v").collect()
    assert {r.i: r.v_at for r in got} == {i: min(table, key=lambda a: (abs(a - k), a)) for i, k in enumerate(keys)} and all(r.v == f"v{r.v_at}" for r in got)


def test_reindex_keeps_no_table_of_edges(spark):
    """Repeated edges, null nodes and null graphs; both ends meet by a sort, which spills."""
    e = spark.createDataFrame([(1, 5, 9, "a"), (1, 5, 9, "a"), (1, 9, None, "b"), (None, 3, 3, "c"), (None, 4, 3, "d")], "g int, s long, d long, x string")
    got = batches.reindex(e, "g", "s", "d")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.x, r.g, r.s, r.d) for r in got.collect()) == [("a", 1, 1, 2), ("a", 1, 1, 2), ("b", 1, 2, 0), ("c", None, 0, 0), ("d", None, 1, 0)]
