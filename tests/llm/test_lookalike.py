import random
import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import lookalike as L


def test_kinds():
    cases = {
        "plain text": [], "Straße déjà naïve Ñandú": [], "ｗｏｒｄ": ["form"], "𝐁old": ["form"], "ﬁne": ["form"], "４１ days": ["form"], "cafe\u0301": ["combining"], "x\u0302 mark": [],
        "keep\u200bs": ["invisible"], "soft\u00adhyphen": ["invisible"], "\ufeffhead": ["invisible"], "a\u200eb": ["invisible"], "a\u00a0b": ["space"], "a\u3000b\u2009c": ["space"],
        "sсope": ["lookalike"], "Οnce": ["lookalike"], "карта мира": [], "Δ and π": [], "read карта": [], "\U0001f469\u200d\U0001f4bb": [], "\U0001f3f3\ufe0f\u200d\U0001f308": [],
        "ｅ\u0301 \u200b\u00a0 сat": ["form", "combining", "invisible", "space", "lookalike"], "5 µm n.º": [], "": [], "line\nbreak\ttab": [], "й": [], "и\u0306": ["combining"],
    }
    for text, kinds in cases.items():
        assert L.unify(text)[1] == kinds, text
    assert L.unify("ｗｏｒｄ cafe\u0301 keep\u200bs a\u00a0b sсope \U0001f469\u200d\U0001f4bb")[0] == "word café keeps a b scope \U0001f469\u200d\U0001f4bb"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_stable_and_agrees_with_whole_text_normalisation(text):
    once, _ = L.unify(text)
    assert ud.is_normalized("NFC", once) or any(ud.category(c) == "Cf" for c in once)
    # letters outside the kept characters end up as whole-text NFKC has them, but for mixed words
    if not any(L._class(c) in ("other", "mark", "invisible", "space") for c in text) and not set(text) & set("µªº"):
        assert ud.normalize("NFC", once) == ud.normalize("NFC", "".join(ud.normalize("NFKC", c) if L._class(c) in ("form", "styled") else c for c in text))


def test_frame(spark):
    long = "word " * 200_000 + "ｗ"
    rows = [(1, "plain", "x"), (1, "plain", "x"), (2, None, None), (3, "", None), (4, "a\u00a0b", "y"), (None, "ｗ", "z"), (5, long, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = [(r["doc_id"], r["text"], r["kinds"]) for r in L.unify_texts(df).collect()]
    assert len(got) == 7 and got.count((1, "plain", [])) == 2
    assert (2, None, []) in got and (3, "", []) in got and (4, "a b", ["space"]) in got and (None, "w", ["form"]) in got and (5, long[:-1] + "w", ["form"]) in got
    assert L.unify_texts(df.limit(0)).count() == 0


def test_words():
    r = random.Random(1)
    for _ in range(50):
        tokens = ["".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(10)]
        assert L.words(" *".join(t.upper() if r.random() < 0.3 else t for t in tokens)) == tokens


def test_script_follows_letters_and_neighbours():
    cases = {
        "Высокая cосна растёт": "Высокая сосна растёт", "pост": "рост", "oрen door": "open door", "αβγtest": "αβγtest", "the сoр of": "the cop of", "Оса, лес: cор": "Оса, лес: сор",
        "d\u0435\u0301jà": "déjà", "b\u0435\u0308": "bë", "Tシャツ": "Tシャツ", "x\u0301аx": "x\u0301ax",
    }
    for text, want in cases.items():
        assert L.unify(text)[0] == want and "lookalike" in L.unify(text)[1], text
    # a styled letter of another script counts though the text holds others already
    assert L.unify("мир p\U0001d6fct")[1] == ["form", "lookalike"]
    for script, twins in L.LOOKALIKES.items():
        assert all(L._script(c) == script and L._script_of(x) == "LATIN" for c, x in twins.items()), script
