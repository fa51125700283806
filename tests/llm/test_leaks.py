import random

from lattica.llm import leaks as K
from lattica.llm.lookalike import words


def _brute(docs, items, run):
    out = set()
    for d, t in docs:
        for i, q in items:
            if d is None or i is None or t is None or q is None:
                continue
            a, b = words(t), words(q)
            grams = {tuple(a[j : j + run]) for j in range(len(a) - run + 1)}
            if any(tuple(b[j : j + run]) in grams for j in range(len(b) - run + 1)):
                out.add((d, i))
    return out


def test_leaks_match_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.randint(15, 60))) for i in range(30)] + [(30, None), (31, ""), (None, text(30))]
    items += items[:2]
    docs = []
    for d in range(120):
        body = text(r.randint(0, 80))
        if r.random() < 0.6:
            source = r.choice(items)[1] or ""
            w = source.split()
            n = r.choice([19, 20, 21, 40])
            at = r.randrange(max(1, len(w) - n + 1))
            part = w[at : at + n]
            shape = r.choice([" ".join, ", ".join, "\n> ".join, lambda x: "* ".join(x).upper(), lambda x: "\u00a0".join(x).replace("w", "ｗ")])
            body = f"{body} {shape(part)} {text(5)}"
        docs.append((d, body))
    docs += [(500, None), (501, ""), (None, text(30)), docs[0], (502, text(50_000))]
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, sig int")
    b = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, _item string")
    got = [tuple(x) for x in K.find_leaks(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(docs, items, 20) and len(got) > 20
    for by in (0, K.BROADCAST_BYTES):  # joined, and sent to every worker
        assert {tuple(x) for x in K.find_leaks(a, b, run=8, broadcast_bytes=by).collect()} == _brute(docs, items, 8)
    assert set(map(tuple, K.find_leaks(a, b, broadcast_bytes=0).collect())) == _brute(docs, items, 20)
    assert K.find_leaks(a.limit(0), b).count() == 0 and K.find_leaks(a, b.limit(0)).count() == 0


def test_one_hot_passage_in_many_documents(spark):
    text = " ".join(f"t{i}" for i in range(25))
    a = spark.createDataFrame([(d, f"{d} {text}") for d in range(3000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, text), (2, "other " + text)], "item_id long, text string")
    assert K.find_leaks(a, b).count() == 6000


def test_size_partitions(spark):
    assert [K.run_for_size(n, 20, 0.5) for n in (5, 20, 39, 40, 79, 80, 160, 1000)] == [20, 20, 20, 20, 20, 40, 80, 320]
    assert {K.run_for_size(n) for n in range(2000)} == {20}
    item = [f"t{i}" for i in range(100)]
    a = spark.createDataFrame([(n, " ".join(item[7 : 7 + n])) for n in (19, 20, 39, 40, 60)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:30]))], "item_id long, text string")
    for by in (0, K.BROADCAST_BYTES):
        got = {tuple(x) for x in K.find_leaks(a, b, share=0.5, broadcast_bytes=by).collect()}
        assert got == {(40, 1), (60, 1), *[(n, 2) for n in (20, 39, 40, 60)]}


def test_letters_recomposed_after_their_script_is_set():
    assert words("d\u0435\u0301jà") == words("déjà") == ["déjà"]
