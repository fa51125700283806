from collections import defaultdict

import pytest

from lattica.llm import mixing as X


@pytest.fixture(scope="module")
def mixed(spark):
    docs = []
    for i in range(400):
        s = "Big " if i % 2 else "big"
        docs.append((i, s, f"text number {i} " * (1 + i % 7), 1, 2))
    docs += [(1000 + i, "small_one", f"small words {i}", 1, 2) for i in range(20)]
    docs += [(2000 + i, "Small-Two", f"other short words {i} and more", 1, 2) for i in range(10)]
    docs += [(3000, "big", docs[0][2], 1, 2), (3001, "small-one", docs[1][2], 1, 2), (3002, None, "no source", 1, 2), (3003, "big", None, 1, 2), (3004, "big", "", 1, 2), (3005, " ", "blank", 1, 2)]
    docs += [docs[3], (3006, "big", "long " * 30_000, 1, 2)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens int, before int")
    targets = spark.createDataFrame(
        [("a", "BIG", 0.5, 2), ("a", "small-one", 0.25, 3), ("a", "small two ", 0.25, 8), ("a", "absent", 0.1, None), ("a", "big", 0.0, 2), ("p", "big", 80.0, 1), ("p", "small-one", 20.0, None), ("z", "absent", 1.0, 2), (None, "big", 1.0, 1), ("a", None, 1.0, 1)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    supply = X.text_supply(df, "doc_id", "source", "text").cache()
    plan = X.plan_mix(supply, X.mix_targets(targets))
    return df, supply, plan, X.mix_texts(supply, plan).collect(), X.mix_shares(plan, X.mix_texts(supply, plan)).collect()


def test_supply_counts_each_text_once_with_running_sums(mixed):
    _, supply, *_ = mixed
    rows = supply.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["before"], r["tokens"], r["doc"]))
    assert set(by) == {"big", "small-one", "small-two"} and len(by["small-one"]) == 20 and len(by["big"]) == 401
    for v in by.values():
        total = 0
        for before, tokens, _ in sorted(v):
            assert before == total
            total += tokens


def test_caps_shares_and_positions(mixed):
    _, supply, plan, rows, shares = mixed
    uses = defaultdict(list)
    for r in rows:
        uses[r["mix_name"], r["source"], r["doc"]].append(r["copy"])
    caps = {(p["mix_name"], p["source"]): p["max_repeats"] for p in plan.collect()}
    for (m, s, _), copies in uses.items():
        assert sorted(copies) == list(range(len(copies))) and (caps[m, s] is None or len(copies) <= caps[m, s])
    at = [(r["mix_name"], r["position"]) for r in rows]
    assert at == sorted(at)
    got = {(r["mix_name"], r["source"]): r for r in shares}
    assert got["a", "absent"]["actual_share"] == 0 and got["z", "absent"]["tokens"] == 0
    want = {"small-one": 0.25, "small-two": 0.25}
    for s, share in want.items():  # one long text may overshoot the large source
        assert abs(got["a", s]["actual_share"] - share) < 0.05
    assert got["p", "big"]["most_uses"] == 1 and abs(got["p", "small-one"]["actual_share"] - 0.2) < 0.02
    total = defaultdict(int)
    for r in rows:
        total[r["mix_name"], r["source"]] += r["tokens"]
    assert {k: r["tokens"] for k, r in got.items() if r["tokens"]} == total


def test_weights_follow_the_schedule(mixed):
    _, _, plan, rows, _ = mixed
    p = {r["source"]: r for r in plan.collect() if r["mix_name"] == "p"}
    whole = p["big"]["total"]
    first = defaultdict(int)
    for r in rows:
        if r["mix_name"] == "p" and r["position"] < whole / 2:
            first[r["source"]] += r["tokens"]
    for s, r in p.items():  # demand up to the middle: half, less a quarter of the slope
        want = r["demand"] * (0.5 - r["slope"] / 4)
        assert abs(first[s] - want) < 0.1 * r["demand"] + (40_000 if s == "big" else 0)


def test_given_total_and_empty_tables(spark, mixed):
    df, supply, *_ = mixed
    targets = X.mix_targets(spark.createDataFrame([("a", "small-one", 0.9, 2), ("a", "big", 0.1, 1)], "mix_name string, source string, target_share double, max_repeats int"))
    plan = X.plan_mix(supply, targets, total_tokens=1000)
    shares = {r["source"]: r for r in X.mix_shares(plan, X.mix_texts(supply, plan)).collect()}
    assert shares["small-one"]["most_uses"] == 2 and shares["small-one"]["texts"] == 20
    none = X.text_supply(df.limit(0), "doc_id", "source", "text")
    plan = X.plan_mix(none, targets)
    assert X.mix_texts(none, plan).count() == 0 and X.mix_shares(plan, X.mix_texts(none, plan)).count() == 2
    assert X.mix_texts(supply, X.plan_mix(supply, targets.limit(0))).count() == 0


def test_tokens_round_trip():
    e = X._encoder(X.TOKENIZER)
    for t in ("", "Hello world's 12 naïve 文字", "<|endoftext|>", "a" * 100_000):
        assert e.decode(e.encode_ordinary(t)) == t


def test_checks_hold_and_tokens_are_counted_once(mixed):
    df, supply, plan, *_ = mixed
    mix = X.mix_texts(supply, plan)
    assert all(r["capped"] and r["reached"] and r["repeated"] for r in X.mix_checks(plan, mix).collect())
    twice = mix.union(mix)
    assert not all(r["capped"] for r in X.mix_checks(plan, twice).collect()) and not all(r["reached"] for r in X.mix_checks(plan, twice).collect())
    sized = X.count_tokens(df, "text").where("tokens > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert sized.count("ArrowEvalPython") == 1
