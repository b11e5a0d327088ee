import random

from conftest import by_hand
from pyspark.sql import functions as F

from lexforge.llm import groups as g


def frame(spark, pairs):
    return spark.createDataFrame([(*p, "clash", 1) for p in pairs], "a string, b string, v string, low int")


def plain(pairs):
    up = {}
    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return sorted((top(x), x) for x in up)


def test_chains_stars_and_random_links(spark):
    rng = random.Random(3)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(300)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    assert by_hand(g.hash_to_min(frame(spark, pairs))) == plain(pairs)


def test_nulls_loops_repeats_and_nothing(spark):
    assert by_hand(g.hash_to_min(frame(spark, [("a", None), (None, "b"), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e")]))) == [("d", "d"), ("d", "e")]
    assert g.hash_to_min(frame(spark, [])).count() == 0


def test_links_of_arrays(spark):
    rows = spark.createDataFrame([(["b", None, "a", "b"],), ([None],), ([],), (None,), (["x"],)], "ids array<string>")
    assert by_hand(g.star_links(rows, F.col("ids"))) == [("a", "b")]
    long = spark.createDataFrame([([f"{i:05}" for i in range(3000)],)], "ids array<string>")
    assert g.hash_to_min(g.star_links(long, F.col("ids"))).where("group_id = '00000'").count() == 3000
