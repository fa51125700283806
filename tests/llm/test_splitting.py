import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import splitting as S

STRETCH = re.compile(r"[^\s.!?;,。！？；，、]+")


def _check(text, limit, overlap):
    pieces = S.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    begin = 0
    for i, (a, b, level) in enumerate(pieces):
        assert b - a <= limit and (b > begin or not text)
        assert max(0, begin - overlap) <= a <= begin
        assert not i or not overlap or a < begin or b - a == limit  # as much overlap as fits
        begin = b
    joined = text[pieces[0][0] : pieces[0][1]]
    for (a, b, _), (_, before, _) in zip(pieces[1:], pieces):
        joined += text[before:b]
    assert joined == text
    hard = any(len(m) > limit for m in STRETCH.findall(text))
    assert any(level == "hard" for *_, level in pieces) == hard
    assert (len(pieces) > 1) == (len(text) > limit)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab .\n,;#。　é\u200b", max_size=400), st.integers(5, 60), st.data())
def test_invariants(text, limit, data):
    _check(text, limit, data.draw(st.integers(0, limit - 1)))


def test_long_and_edge_texts():
    r = random.Random(2)
    for text in ("", "x", "x" * 1600, "x" * 1601, "x" * 1600 + "." + "y" * 1600, " " * 5000, "." * 5000, "ab " * 100_000, "x" * 200_000, "".join(r.choices("abc .\n", k=50_000)), "é" * 1601):
        _check(text, 1600, 200)


def test_overlap_is_kept_where_nothing_is_natural():
    pieces = S.cut("x" * 10_000, 1600, 200)
    assert [b for _, b, _ in pieces][:2] == [1400, 2800] and all(before - a == 200 for (a, *_), (_, before, _) in zip(pieces[1:], pieces))
    text = "word " * 100 + "y" * 1590 + " word" * 100  # a stretch that just fits leaves little room
    assert [level for *_, level in S.cut(text)].count("hard") == 0


def test_cuts_prefer_natural_boundaries():
    text = "\n\n".join(" ".join(["word"] * 60) + "." for _ in range(12))
    levels = {level for *_, level in S.cut(text, 1600, 200)}
    assert levels <= {"paragraph", "end"}


def test_frame(spark):
    rows = [(1, "short"), (2, None), (3, ""), (4, "word " * 2000), (4, "word " * 2000), (None, "z" * 1700)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "note_id long, body string, pieces int, cut string")
    got = S.split_texts(df, "note_id", "body").collect()
    assert len(got) == 6
    by = {r["note_id"]: r["pieces"] for r in got}
    assert by[2] is None and [tuple(p) for p in by[3]] == [(0, 0, "end")] and [tuple(p) for p in by[1]] == [(0, 5, "end")]
    assert [tuple(p) for p in by[4]] == S.cut("word " * 2000) and [p["cut"] for p in by[None]][0] == "hard"
    assert S.split_texts(df.limit(0), "note_id", "body").count() == 0
    texts = S.piece_texts(df.dropDuplicates(["note_id"]), "note_id", "body").where("note_id = 4").orderBy("piece").collect()
    assert [r["content"] for r in texts] == [("word " * 2000)[a:b] for a, b, _ in S.cut("word " * 2000)]
    whole = S.put_together(S.split_texts(df, "note_id", "body", with_content=True), "note_id").collect()
    assert len(whole) == 5 and all(r["fits"] and r["overlapping"] for r in whole) and {r["rebuilt"] for r in whole} == {t for _, t in rows if t is not None}
    with pytest.raises(ValueError):
        S.split_texts(df, "note_id", "body", 10, 10)
