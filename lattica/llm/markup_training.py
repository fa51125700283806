"""Labelled notes for the markup model: written from a seed, so what each part is, is known."""

from __future__ import annotations

import random
import re

# Words of the invented notes.
WORDS = "river stone paper signal copper garden letter window market engine harbor winter candle mirror planet basket thread orange violet silver meter ticket folder branch tunnel pocket saddle pepper walnut marble".split()
VERBS = "moves keeps finds builds holds turns opens draws reads counts".split()

NONE, HEADING, ITEM, CODE, FORMULA = range(5)
STYLES = ("markdown", "wiki", "html", "latex")


class _Note:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.size, self.truth = rng, [], 0, {}

    def put(self, text: str, label: int = NONE, skip: int = 0) -> None:
        """Appends ``text``; with a label, the element begins ``skip`` characters into it."""
        if label:
            self.truth[self.size + skip] = label
        self.parts.append(text)
        self.size += len(text)


def _phrase(r: random.Random, low: int = 2, high: int = 6) -> str:
    return " ".join(r.choices(WORDS, k=r.randint(low, high)))


def _title(r: random.Random) -> str:
    s = _phrase(r, 1, 5).capitalize()
    return s + r.choice(["", "", "", f" {r.randint(1, 99)}", ":", "?"])


def _sentence(r: random.Random) -> str:
    s = f"{_phrase(r, 2, 5)} {r.choice(VERBS)} {_phrase(r, 2, 7)}"
    extra = r.choice(["", "", "", " with 3 * 4 parts", " for $15 to $40 each", " with $HOME/bin:$PATH set", " and US$7/kg or CA$9/kg", " at $5 or $6", " where a < b and c > d", " [[Some page|shown]]", " from 2% to 5%", " in R&D", " `x = 1`"])
    return s[0].upper() + s[1:] + extra + r.choice("....?!")


def _paragraph(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, 4)))


def _inline(r: random.Random, s: str, style: str) -> str:
    if r.random() < 0.6:
        return s
    words = s.split(" ")
    i = r.randrange(len(words))
    marks = {
        "markdown": [("**", "**"), ("*", "*"), ("`", "`"), ("[", "](page.md)"), ("[[", "]]"), ("~~", "~~")], "wiki": [("'''", "'''"), ("''", "''"), ("[[", "]]"), ("<code>", "</code>")],
        "html": [("<b>", "</b>"), ('<span style="color:red">', "</span>"), ('<a href="page.html">', "</a>"), ("<em>", "</em>"), ("<code>", "</code>")], "latex": [("\\emph{", "}"), ("\\textbf{", "}"), ("\\texttt{", "}")],
    }
    a, b = r.choice(marks[style])
    words[i] = a + words[i] + b
    return " ".join(words)


def _formula(r: random.Random) -> str:
    x, n = r.choice("abcxyzuvw"), r.randint(1, 99)
    return r.choice([f"{x}^{n} + {n}", f"\\frac{{{x}}}{{{n}}}", f"{x}_{{{n}}} = \\sum_{{i=1}}^{{{n}}} x_i", f"\\alpha \\le {x}", f"O(n^{n})", f"\\sqrt{{{x}^2 + {n}}}", f"f({x}) = {n}", x])


def _code_line(r: random.Random) -> str:
    a, b, n = r.choice(WORDS), r.choice(WORDS), r.randint(1, 999)
    return r.choice([
        f"def {a}_{b}(x):", f"    return x + {n}", f"# {a} {b} {n}", f"## {a} {b}", f"- {a}: {b} {n}", f"* {a} {n}", f"{n}. {a}", f"SELECT {a} FROM {b} WHERE {a} > {n}",
        f"{a} = load('{b}.txt')", f"<div class='{a}'>{b}</div>", f"\\frac{{{a}}}{{{n}}}", f"{a}.{b}({n}) && {n} < 3", f"$ {a} --{b} {n}", f"== {a} ==", f"echo ${a}", "", f"// {a}",
    ])


def _attributes(r: random.Random) -> str:
    """Attributes that say nothing of what an element is: names of all kinds."""
    name = lambda: "".join(r.choices("abcdefghiklmnoprstuvwxyz", k=r.randint(1, 8)))
    return r.choice(["", "", f' id="{name()}{r.randint(1, 99)}"', f' class="{name()}"', f' class="{name()} {name()}"', f' class="{name()}" id="{name()}{r.randint(1, 99)}"', f' style="color:{name()}"'])


def _heading(note: _Note, style: str) -> None:
    r = note.rng
    t = _inline(r, _title(r), style)
    n = r.randint(1, 4)
    if style == "markdown":
        if r.random() < 0.35:
            note.put(f"{t}\n{r.choice('-=') * r.randint(3, 12)}", HEADING)
        else:
            note.put(f"{'#' * n} {t}{r.choice(['', '', ' ' + '#' * n])}", HEADING)
    elif style == "wiki":
        n = r.randint(2, 4)
        gap = r.choice(["", " "])
        note.put(f"{'=' * n}{gap}{t}{gap}{'=' * n}", HEADING)
    elif style == "html":
        tag = r.choice(["h1", "h2", "h3", "h4", "H2", "H3"])
        attrs = _attributes(r)
        nl = r.choice(["", "", "\n"])
        note.put(f"<{tag}{attrs}>{nl}{t}{nl}</{tag}>", HEADING)
    else:
        note.put(f"\\{r.choice(['section', 'subsection', 'subsubsection', 'paragraph', 'chapter'])}{r.choice(['', '*'])}{{{t}}}", HEADING)


def _list(note: _Note, style: str) -> None:
    r = note.rng
    rows = [_inline(r, r.choice([_title, _sentence])(r), style) for _ in range(r.randint(1, 6))]
    if style in ("markdown", "wiki"):
        mark = r.choice(["-", "*", "+", "1"]) if style == "markdown" else "*"
        boxes = mark in "-*" and style == "markdown" and r.random() < 0.3
        deep = 0
        for i, row in enumerate(rows):
            deep = r.choice([0, deep, 1]) if i else 0
            box = r.choice(["[ ] ", "[x] "]) if boxes else ""
            lead = ("  " * deep + (f"{i + 1}." if mark == "1" else mark)) if style == "markdown" else "*" * (deep + 1)
            note.put(f"{lead} {box}{row}", ITEM)
            if i + 1 < len(rows):
                note.put("\n")
    elif style == "html":
        tag, close = r.choice(["ul", "ol"]), r.random() < 0.6
        nl = r.choice(["\n", "\n", ""])
        note.put(f"<{tag}{_attributes(r)}>{nl}")
        for row in rows:
            note.put(f"<li{_attributes(r)}>{row}", ITEM)
            _nested(note, style)
            note.put(f"{'</li>' if close else ''}{nl}")
        note.put(f"</{tag}>")
    else:
        env = r.choice(["itemize", "enumerate"])
        note.put(f"\\begin{{{env}}}\n")
        for row in rows:
            lead = r.choice(["", "  "])
            note.put(f"{lead}\\item {row}", ITEM, len(lead))
            _nested(note, style)
            note.put("\n")
        note.put(f"\\end{{{env}}}")


def _nested(note: _Note, style: str) -> None:
    """Now and then a formula, code or a list inside an entry."""
    r = note.rng
    kind = r.random()
    if kind < 0.08:
        a, b = r.choice([("$", "$"), ("\\(", "\\)"), ("\\[ ", " \\]")])
        note.put(" so ")
        note.put(f"{a}{_formula(r)}{b}", FORMULA)
    elif kind < 0.16 and style == "html":
        note.put(" ")
        body = "\n".join(r.choices([r.choice("abcxy"), f" {r.choice(WORDS)}", "run()", f"{r.choice(WORDS)} = {r.randint(1, 9)}"], k=r.randint(1, 3)))
        note.put(f"<pre>{body}</pre>", CODE)
    elif kind < 0.22 and style == "html":
        note.put("<ul>")
        for _ in range(r.randint(1, 3)):
            note.put(f"<li>{_title(r)}</li>", ITEM)
        note.put("</ul>")


def _code(note: _Note, style: str) -> None:
    r = note.rng
    body = "\n".join(_code_line(r) for _ in range(r.randint(1, 7) if r.random() < 0.9 else r.randint(20, 90)))
    if not body.strip():
        body = "run()"
    if style == "markdown" and r.random() < 0.2:  # indented
        note.put("\n".join("    " + r.choice([f"{a} = load('{b}.txt')", f"{a}.{b}({r.randint(1, 99)});", f"int {a} = {b}[0];", f"if ({a} < {b}) {{ {a}(); }}", f"    return {a}_{b}(x);"]) for a, b in (r.choices(WORDS, k=2) for _ in range(r.randint(1, 5)))), CODE)
    elif style == "markdown":
        f = r.choice(["```", "~~~", "````"])
        note.put(f"{f}{r.choice(['', 'python', 'text'])}\n{body}\n{f}", CODE)
    elif style == "wiki":
        note.put(f'<syntaxhighlight lang="{r.choice(["text", "python"])}">\n{body}\n</syntaxhighlight>', CODE)
    elif style == "html":
        b = body.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        note.put(r.choice([f"<pre><code>{b}</code></pre>", f'<pre{r.choice([_attributes(r), " class=" + chr(34) + "src" + chr(34)])}>\n{b}\n</pre>']), CODE)
    else:
        env = r.choice(["verbatim", "lstlisting"])
        note.put(f"\\begin{{{env}}}\n{body}\n\\end{{{env}}}", CODE)


def _math(note: _Note, style: str) -> None:
    r = note.rng
    note.put(_phrase(r).capitalize() + " ") if r.random() < 0.6 else None
    f = _formula(r)
    if style == "wiki":
        note.put(f"<math>{f}</math>", FORMULA)
    elif style == "html":
        note.put('<span class="math">')
        note.put(f"\\({f}\\)", FORMULA)
        note.put("</span>")
    elif style == "markdown":
        note.put(r.choice([f"${f}$", f"${f}$", f"$$\n{f}\n$$"]), FORMULA)
    else:
        note.put(r.choice([f"${f}$", f"\\[ {f} \\]", f"\\begin{{equation}}\n  {f}\n\\end{{equation}}"]), FORMULA)
    if r.random() < 0.6:
        note.put(" " + _sentence(r))


def _traps(r: random.Random) -> str:
    """Text that begins like markup of some form but isn't."""
    a, b, n, m = r.choice(WORDS), r.choice(WORDS), r.randint(2, 99), r.randint(2, 99)
    lines = lambda k: "\n".join("    " + _sentence(r) for _ in range(k))
    return r.choice([
        f"#{a}", f"#{a} #{b}", f"#{a}/{b} {_phrase(r)}", f"#{n} {_phrase(r)}", f"= {n}", f"== {_phrase(r)}", f"=> {_sentence(r)}", f"=~ {a}", "- - -", "* * *", "+ + +", f"+ {n} - {m} = {n - m}", f"- {n} / {m} = {n // m}",
        f"* {n} * {m} = {n * m}", f"{r.randint(1900, 2030)}. {a} 5 - 3", f"{r.randint(1900, 2030)}. {_sentence(r)}", f"<p>{_sentence(r)}</p>\n---", f"| {a} | {b} |\n-----", lines(r.randint(1, 4)),
        f"Use the <li> tag for {_phrase(r)}.", f"Put <li> before the {a} and {b}.", f'<pre class="{r.choice(["poem", "verse"])}">\n{_sentence(r)}\n{_sentence(r)}\n</pre>', f'<h{r.randint(2, 4)} class="{r.choice(["advert", "banner"])}">{_title(r)}</h2>',
        f"Set ${a.upper()}/{b}:${b.upper()} before the {a}.", f"Prices: ${n}/kg, ${m}/kg and ${n}/t.", f"The ${n} {a} and the ${m} {b}.",
    ]).replace("</h2>", "</h2>")


def _other(note: _Note, style: str) -> None:
    r = note.rng
    a, b = r.choice(WORDS), r.choice(WORDS)
    if r.random() < 0.6:
        trap = _traps(r)
        note.put(re.sub(r"<h(\d)([^<>]*)>(.*)</h2>", r"<h\1\2>\3</h\1>", trap))
        if "<li>" in trap:
            note.put("\n\n" + _sentence(r))
        return
    note.put(r.choice([
        "***", "---\n\n" + _sentence(r), f"> {_sentence(r)}", f"| {a} | {b} |\n|---|---|\n| {b} | 4 |", f"<!-- {a} {b} -->\n{_sentence(r)}", "{{" + f"Box|name={a}" + "}}",
        '{| class="plain"\n! ' + a + "\n|-\n| " + b + "\n|}", f"<p>{_sentence(r)}</p>", f"<div>{_sentence(r)}<br/></div>", f"<p>#{a} #{b}</p>",
    ]))


def labelled_notes(count: int, seed: int) -> list[tuple[str, dict[int, int]]]:
    """``count`` notes with the labels of their elements, by the position at which each begins."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        note = _Note(rng)
        mixed = rng.random() < 0.5
        style = rng.choice(STYLES)
        if rng.random() < 0.7:
            note.put(f"# {_title(rng)}", HEADING)
            note.put("\n\n")
        for _ in range(rng.randint(2, 9)):
            s = rng.choice(STYLES) if mixed else style
            block = rng.choices([None, _heading, _list, _code, _math, _other], [4, 2, 2, 1, 1, 2])[0]
            if block:
                block(note, s)
            else:
                note.put(_paragraph(rng))
            note.put("\n\n")
        out.append(("".join(note.parts), note.truth))
    return out
