import random

import pytest
from pyspark.sql import functions as F

from lattica.llm import setjoin as J


def _brute(rows, threshold, least):
    sets = [(k, {x for x in v if x is not None}) for k, v in rows if k is not None and v is not None]
    sets = [(k, s) for k, s in sets if len(s) >= least]
    return {(min(a, b), max(a, b)) for i, (a, s) in enumerate(sets) for b, t in sets[i + 1 :] if a != b and len(s & t) / len(s | t) >= threshold}


@pytest.mark.parametrize("threshold,most", [(0.7, 8), (0.5, 6), (0.9, 40), (1.0, 5), (0.34, 5)])
def test_pairs_match_brute_force(spark, threshold, most):
    r = random.Random(most)
    items = [f"i{min(int(r.paretovariate(0.6)), 60)}" for _ in range(60)]
    rows = []
    for k in range(150):
        base = set(r.choices(items, k=r.randint(1, most))) if k % 3 or not rows else set(rows[-1][1]) ^ {r.choice(items)}
        rows.append((f"p{k}", list(base)))
    rows += [("dup1", rows[0][1]), ("dup2", rows[0][1][::-1]), ("n1", None), ("n2", []), ("n3", [None]), (None, rows[0][1]), rows[5], ("long", [f"x{i}" for i in range(300)]), ("long2", [f"x{i}" for i in range(2, 300)])]
    df = spark.createDataFrame([(k, v, "c", 1) for k, v in rows], "key string, items array<string>, set_id string, size int")
    got = [tuple(x) for x in J.similar_records(df, "key", "items", threshold, 1).distinct().collect()]
    assert set(got) == _brute([tuple(x) for x in dict(((k, str(v)), (k, v)) for k, v in rows).values()], threshold, 1)


def test_empty_and_sizes(spark):
    df = spark.createDataFrame([], "key string, items array<string>")
    assert J.similar_records(df, "key", "items", 0.7).count() == 0
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["x", "y", "z"]), ("d", ["z", "y", "x", "x"])], "key string, items array<string>")
    assert {tuple(x) for x in J.similar_records(df, "key", "items", 0.7, 3).collect()} == {("c", "d")}
    with pytest.raises(ValueError):
        J.similar_sets(J.set_classes(df, "key", "items")[0], 0)


def test_hot_item_shared_by_all(spark):
    rows = [(f"p{i}", ["hot", f"a{i}", f"b{i}", f"c{i}"]) for i in range(2000)] + [("q", ["hot", "a1", "b1", "c1"])]
    df = spark.createDataFrame(rows, "key string, items array<string>")
    assert {tuple(x) for x in J.similar_records(df, "key", "items", 0.7, 3).collect()} == {("p1", "q")}


def test_normalized_items(spark):
    df = spark.createDataFrame([([" #Wiki", "wiki", None, "", "##", "a b "],), (None,)], "t array<string>").select(J.normalize_set(F.col("t")))
    assert [r[0] for r in df.collect()] == [["a b", "wiki"], None]


def test_links_of_classes(spark):
    rows = [("a", ["x", "y", "z"]), ("b", ["z", "y", "x"]), ("c", ["x", "y", "z", "w"]), ("d", ["q", "r", "s"]), ("e", None), ("f", ["x"]), (None, ["x", "y", "z"]), ("a", ["x", "y", "z"])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "key string, items array<string>, links int")
    got = sorted(map(tuple, J.record_links(df, "key", "items", 0.7, 3).collect()))
    assert got == [("a", "a", 2, 1), ("b", "a", 2, 1), ("c", "c", 1, 1), ("d", "d", 1, 0)]
    assert J.record_links(df.limit(0), "key", "items", 0.7).count() == 0
