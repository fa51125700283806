from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import markup as M
from lattica.llm import markup_training as R
from lattica.llm.gbt import BoostedTrees


def found(text):
    return set(M.elements([text], M.model())[0])


def test_held_out_accuracy_needs_more_than_the_form():
    right = total = missed = 0
    by_form = defaultdict(Counter)
    for text, truth in R.labelled_notes(300, 12345):
        nodes = M.parse(text)
        starts = {x.start for x in nodes}
        missed += sum(s not in starts for s in truth)
        for x, k in M.label_notes([text], M.model())[0]:
            total += 1
            right += k == truth.get(x.start, 0)
            by_form[x.form, any(nodes[p].form in M._CODES for p in _ancestors(nodes, x))][truth.get(x.start, 0)] += 1
    form_alone = sum(max(c.values()) for c in by_form.values()) / total
    assert total > 2000 and missed <= 2 and right / total > 0.998 and form_alone < 0.95
    assert sum(len(c) > 1 for c in by_form.values()) >= 8  # so many forms are now this, now that


def _ancestors(nodes, x):
    while x.parent >= 0:
        yield x.parent
        x = nodes[x.parent]


def test_features_cover_whole_nodes():
    body = "\n".join("a word" for _ in range(2000))
    for middle in ("x" * 3000, "(;)" * 1000, "4" * 3000):
        text = f"```\n{body}{middle}{body}\n```"
        inner = text[4:-3]
        row = M.features(text, M.parse(text))[0]
        assert np.allclose(row[8:11], [sum(map(str.isalpha, inner)) / len(inner), sum(map(str.isdigit, inner)) / len(inner), sum(c in "();" for c in inner) / len(inner)])
        assert row[7] == len(inner.split()) and row[6] == inner.count("\n")


def test_look_alikes_of_markup():
    for text in ("It costs $20 to $35 here.", "#tag of a note", "1987. The river keeps its stones.", "- - -", "=> so it goes", "Use the <li> tag for lists.", "Set $HOME/bin:$PATH first.", '<pre class="poem">\nThe river keeps the stone.\nThe winter finds it.\n</pre>'):
        assert found("The paper moves.\n\n" + text) == set(), text
    assert found("Now $a$ b $c$.") == {("formula", "a"), ("formula", "c")}
    assert found("A line.\n\n    load = open(name[0]);\n    if (a < b) { run(a); }\n\nEnd.") == {("code", "load = open(name[0]); if (a < b) { run(a); }")}


def test_elements_of_each_markup():
    text = "\n\n".join([
        "# The **Title** ##", "Setext [head](x.md)\n-----", "== Wiki ''head'' ==", "<H2>\n  Html &amp; <b>head</b>\n</H2>", "\\subsection*{Tex \\emph{head}}",
        "- [ ] One `a_b`\n  - Two ~~gone~~\n* [[Page|Three]]", "* '''Four'''\n** [[Five]]", "1. Six\n2. ==Seven==", "<ul>\n<li>Eight\n<li><em>Nine</em> &eacute;\n</ul>", "\\begin{itemize}\n  \\item Ten \\textbf{x}\n  \\item Eleven\n\\end{itemize}",
        "```python\n# no heading\n- no item\n$x$\n```", '<pre><code>a &lt; b\n## no</code></pre>', '<syntaxhighlight lang="c">\nint x;\n</syntaxhighlight>', "\\begin{verbatim}\n- no\n\\end{verbatim}",
        "It costs $20 to $35 and $x^2$ here.", "$$\na =\n b\n$$", "\\[ c \\]", "So \\(d\\) and <math>e</math>.", "\\begin{equation*}\n f\n\\end{equation*}", "`$no$` <!-- # no --> text", "***",
    ])
    assert found(text) == {
        ("heading", "The Title"), ("heading", "Setext head"), ("heading", "Wiki head"), ("heading", "Html & head"), ("heading", "Tex head"),
        *[("item", x) for x in ("One a_b", "Two gone", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine é", "Ten x", "Eleven")],
        ("code", "# no heading - no item $x$"), ("code", "a < b ## no"), ("code", "int x;"), ("code", "- no"), *[("formula", x) for x in ("x^2", "a = b", "c", "d", "e", "f")],
    }


def test_clean_text_keeps_structure():
    text = "# Head\n\nSome **bold** [[Page|shown]] text.\n\n- one\n- two\n\n```\nx = 1\n  y\n```\n\nWith $z$."
    out = M.clean_text(text, M.label_notes([text], M.model())[0])
    assert [p for p in out.split("\n") if p] == ["# Head", "Some bold shown text.", "- one", "- two", "```", "x = 1", "  y", "```", "With", "$z$", "."]


def test_clean_text_keeps_words_and_drops_source():
    clean = lambda text: [p for p in M.clean_text(text, M.label_notes([text], M.model())[0]).split("\n") if p]
    assert clean('{| class="plain"\n|+ Stock\n! Name !! Count\n|-\n| style="x" | Alpha || 5\n|-\n| Beta\n| 6\n|}') == ["Stock", "Name | Count", "Alpha | 5", "Beta | 6"]
    assert clean("| a | b |\n|---|:-:|\n| [[P|c]] | 4 |") == ["a | b", "c | 4"]
    assert clean("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>") == ["A | B", "1 | 2"]
    assert clean("Alpha<ref>An important note</ref> here.\\footnote{And this} {{Box|name=awning|stone}} end<!-- gone -->[^1].") == ["Alpha (An important note) here. (And this) (Box, awning, stone) end."]
    assert clean("Before\n\n<script>\nvar x = 1;\n\n# track(x)\n</script>\n<style>p {color: red}</style>\nafter") == ["Before", "after"]


def test_clean_text_keeps_nested_elements():
    def clean(text, *labels):
        """With the labels given by form, so that the rendering alone is tested."""
        return [p for p in M.clean_text(text, [(x, dict(labels).get(M.FORMS[x.form], 0)) for x in M.parse(text)]).split("\n") if p]

    li, pre, item, bracket, dollar = ("li", 2), ("pre", 3), ("item", 2), ("bracket", 4), ("dollar", 4)
    assert clean("<ul><li>run <pre>a\n b</pre></li></ul>", li, pre) == ["- run", "```", "a", " b", "```"]
    assert clean("<ul><li>run <pre>a</pre> or <b>so</b> <pre>b</pre> end</li><li>two</li></ul>", li, pre) == ["- run", "```", "a", "```", "or so", "```", "b", "```", "end", "- two"]
    assert clean("<ul><li><pre>a</pre></li></ul>", li, pre) == ["-", "```", "a", "```"]
    assert clean("\\begin{itemize}\n\\item so \\[ x^2 \\]\n\\end{itemize}", item, bracket) == ["- so $x^2$"]
    assert clean("- so **big $\\text{a}_1 * b$ and** c\n- d", ("bullet", 2), dollar) == ["- so big $\\text{a}_1 * b$ and c", "- d"]
    assert clean("# On $a_1$ ##\n\ntext", ("hash", 1), dollar) == ["# On $a_1$", "text"]
    assert clean("On $a$\n-----\n\ntext", ("setext", 1), dollar) == ["## On $a$", "text"]
    assert clean("- see <ref>of $x$</ref>", ("bullet", 2), dollar) == ["- see (of $x$)"]
    text = "<ul>\n<li>run <pre>a\n b</pre></li>\n</ul>\n\n\\begin{itemize}\n\\item so \\[ x^2 \\]\n\\end{itemize}"
    out = M.clean_text(text, M.label_notes([text], M.model())[0])
    assert [p for p in out.split("\n") if p] == ["- run", "```", "a", " b", "```", "- so $x^2$"]


def test_marks_close_at_any_distance():
    far = "word " * 2_000 + "end"
    for text in (f"a <!-- {far} --> b", f"a <ref>{far}</ref> b"):
        assert M.inline_text(text) == "a b"
    for text in (f"**{far}**", f"*{far}*", f"_{far}_", f"~~{far}~~", f"`{far}`"):
        assert M.inline_text(text) == far
    title = "\\section{" + far + "}"
    assert [(x.cs, x.ce) for x in M.parse(title)] == [(9, len(title) - 1)]


def test_marks_match_unbounded_patterns():
    import random
    import re

    drop = re.compile(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|\{\{[^{}]*\}\}|\\(?:cite[a-z]*|label|ref|footnote)\s*(?:\[[^\]]*\])?\{[^{}]*\}|\[\^[^\]\s]+\]", re.S | re.I)
    emphasis = re.compile(r"(?<![\w*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?!\*)|(\*\*)(?=\S)(.+?)(?<=\S)\3|(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\5(?!\w)|(~~|==)(?=\S)(.+?)(?<=\S)\7", re.S)
    ticks = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
    r = random.Random(3)
    for _ in range(5_000):
        s = "".join(r.choice(["*", "**", "***", "_", "__", "~~", "==", "=", "a", " ", "é", "\n", "-"]) for _ in range(r.randint(1, 16)))
        assert M._emphasis(s) == emphasis.sub(lambda m: m.group(2) or m.group(4) or m.group(6) or m.group(8), s), s
        s = "".join(r.choice(["`", "``", "```", "a", " "]) for _ in range(r.randint(1, 12)))
        assert M._code_spans(s) == [(*m.span(), *m.span(2)) for m in ticks.finditer(s)], s
        s = "".join(r.choice(["<!--", "-->", "<ref>", "<REF a>", "</ref>", "<ref a/>", "{{", "}}", "[^a]", "\\ref{a}", "x", "<"]) for _ in range(r.randint(1, 12)))
        assert M._drop(s) == drop.sub("", s), s


def test_decoder_forbids_contradictions():
    p = np.log(np.array([[0.05, 0.05, 0.05, 0.8, 0.05], [0.2, 0.1, 0.6, 0.05, 0.05], [0.2, 0.1, 0.6, 0.05, 0.05]]))
    assert M.decode([-1, 0, 0], p) == [3, 0, 0]  # the code block wins over its two lines
    p[0] = np.log([0.35, 0.1, 0.1, 0.4, 0.05])
    assert M.decode([-1, 0, 0], p) == [0, 2, 2]  # the lines win over a doubtful block
    r = np.random.default_rng(0)
    for _ in range(50):
        q = np.log(r.dirichlet(np.ones(5), 4))
        parents = [-1, 0, 1, 0]
        best = max(np.ndindex(5, 5, 5, 5), key=lambda y: sum(q[i, k] for i, k in enumerate(y)) if _fits(parents, y) else -1e9)
        assert np.isclose(sum(q[i, k] for i, k in enumerate(M.decode(parents, q))), sum(q[i, k] for i, k in enumerate(best)))


def _fits(parents, labels):
    for i, p in enumerate(parents):
        while p >= 0:
            if labels[i] not in M._BELOW[labels[p]]:
                return False
            p = parents[p]
    return True


def test_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    t = BoostedTrees(2, rounds=30).fit(x[:1500], y[:1500])
    assert (t.log_proba(x[1500:]).argmax(1) == y[1500:]).mean() > 0.93
    assert np.allclose(np.exp(t.log_proba(x)).sum(1), 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# a\n", "- b\n", "```\n", "<li>", "</ul>", "<ul>", "<pre>", "</pre>", "$", "$$", "\\[", "\\]", "\\item x ", "\\begin{itemize}", "\\end{itemize}", "`", "\n\n", "x y ", "{{", "}}", "{|", "<!--", "-->", "---\n", "== h ==\n", "\\section{", "}", "<h2>", "</h2>", "    c\n", "&amp;", "<math>", "\\begin{verbatim}", "\\"]), max_size=25))
def test_any_mess_parses(parts):
    text = "".join(parts)
    nodes = M.parse(text)
    for i, x in enumerate(nodes):
        assert 0 <= x.start <= x.cs <= len(text) + 1 and x.cs <= x.ce + 1 and x.ce <= len(text) and x.parent < i
    M.clean_text(text, M.label_notes([text], M.model())[0])
    M.elements([text], M.model())


def test_long_messes_stay_fast():
    import time

    for part in ("* a ", "`x ", "**b ", "<code>", "<h2>x ", "$ y", "[[", "<ref>", "{{", "\\section{", "- x\n", "__", "\\(", "''", "<!-- "):
        text = "- " + part * 3_000
        begin = time.process_time()
        M.elements([text], M.model())
        M.clean_text(text, M.label_notes([text], M.model())[0])
        assert time.process_time() - begin < 30, part


def test_frame(spark):
    rows = [(1, "# A\n\n- b", "x"), (1, "# A\n\n- b", "x"), (2, None, None), (3, "", ""), (4, "word " * 200_000 + "\n\n# End", ""), (None, "$x$", "")]
    df = spark.createDataFrame(rows, "note_id long, body string, elements string")
    got = [(r["note_id"], sorted(map(tuple, r["elements"]))) for r in M.structure(df, "note_id", "body").collect()]
    assert len(got) == 5 and got.count((1, [("heading", "A"), ("item", "b")])) == 2
    assert (3, []) in got and (4, [("heading", "End")]) in got and (None, [("formula", "x")]) in got
    assert M.structure(df.limit(0), "note_id", "body", with_text=True).count() == 0
