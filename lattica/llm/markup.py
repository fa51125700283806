"""Markup residue: from Markdown, wiki, HTML and LaTeX, alone or mixed, to structure and clean text.

A text is read into a tree of nodes that may be structural: whatever looks like markup at first sight, prices between dollar
signs, hash tags, years with a full stop and indented verse included. Gradient-boosted trees judge each node by features of
the node, its subtree, attributes, depth and siblings; a hierarchical decoder then picks the most likely labels of
the whole tree that don't contradict each other, such as a list item inside a code block or two formulas that share a sign.
"""

from __future__ import annotations

import bisect
import functools
import html
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.gbt import BoostedTrees

LABELS = ("none", "heading", "item", "code", "formula")
FORMS = (
    "hash", "setext", "equals", "htag", "section", "bullet", "stars", "number", "li", "item", "fence", "pre", "highlight", "verbatim", "indent",
    "dollar", "dollars", "paren", "bracket", "equation", "math",
)
_FORM = {f: i for i, f in enumerate(FORMS)}
_HEADINGS, _ITEMS, _CODES = {0, 1, 2, 3, 4}, {5, 6, 7, 8, 9}, {10, 11, 12, 13, 14}

# Environments and tags with a meaning of their own.
VERBATIM = {"verbatim", "lstlisting", "minted", "alltt", "Verbatim"}
EQUATIONS = {"equation", "align", "gather", "displaymath", "math", "eqnarray", "multline", "alignat", "flalign"}
LISTS = {"itemize", "enumerate", "description"}

_LINE = re.compile(
    r"[ \t]*(?:>[ ]?)*[ \t]*(?:"
    r"(?P<fence>`{3,}(?=[^`\n]*$)|~{3,})"
    r"|(?P<hash>\#{1,6})(?:[ \t]+(?=\S)|(?=[^\s\#]))"
    r"|(?P<equals>={1,6})(?=[ \t]*[^=\s])"
    r"|(?P<rule>-{3,}|={3,})[ \t]*$"
    r"|(?P<stars>\*{2,6})[ \t]+(?=\S)"
    r"|(?P<bullet>[-+*])[ \t]+(?=\S)"
    r"|(?P<number>\d{1,9}[.)])[ \t]+(?=\S)"
    r")", re.M)
_STARTS = frozenset("`~#=-+*>0123456789")
_INLINE = re.compile(
    r"<!--|<(?P<close>/?)(?P<tag>h[1-6]|ul|ol|li|pre|syntaxhighlight|source|code|tt|math|script|style|nowiki)\b(?P<attrs>[^<>]*)>"
    r"|\\(?P<be>begin|end)\{(?P<env>[A-Za-z]+)\*?\}"
    r"|\\(?P<item>item)\b(?:\[[^\]\n]*\])?"
    r"|\\(?P<sec>(?:sub)*section|chapter|part|(?:sub)?paragraph|title)\*?[ \t]*(?:\[[^\]\n]*\])?\{"
    r"|(?P<open>\\[(\[])|\\."
    r"|(?P<dollars>\$\$?)|(?P<tick>`+)|(?P<brace>\{\{|\{\|)", re.I | re.S)
_SPECIAL = re.compile(r"[<$\\`{]")
_BLANK = re.compile(r"\n[ \t]*\n")


class Node:
    __slots__ = ("form", "start", "end", "cs", "ce", "parent", "level", "attrs", "closed", "indent")

    def __init__(self, form, start, end, cs, ce, parent, level=0, attrs="", closed=True, indent=0):
        self.form, self.start, self.end, self.cs, self.ce, self.parent = form, start, end, cs, ce, parent
        self.level, self.attrs, self.closed, self.indent = level, attrs, closed, indent


_BRACES = re.compile(r"\\.|[{}]|\n[ \t]*\n", re.S)


def _brace_ends(text: str) -> dict[int, int]:
    """For the position after each opening brace, that of the brace that closes it in the same paragraph."""
    ends, opened = {}, []
    for m in _BRACES.finditer(text):
        g = m.group()
        if g == "{":
            opened.append(m.end())
        elif g == "}":
            if opened:
                ends[opened.pop()] = m.start()
        elif g[0] == "\n":
            opened = []
    return ends


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^<>]*>?", re.I)


def _is_block(text: str, m: re.Match | None, eol: int) -> bool:
    """Whether a line begins a block of its own; tags and lines with a lone equals sign at the start may still belong to a paragraph."""
    if m is None or m.lastgroup == "hash":
        return m is not None and text[m.end() - 1] in " \t"
    return m.lastgroup != "equals" or text[m.end() : eol].rstrip().endswith("=")


def _find_close(text: str, tag: str, pos: int) -> tuple[int, int, bool]:
    m = _closing(tag).search(text, pos)
    return (m.start(), m.end(), True) if m else (len(text), len(text), False)


def parse(text: str) -> list[Node]:
    """Nodes of ``text`` in order of their start. ``parent`` is the index of the nearest node around one, or -1."""
    nodes: list[Node] = []
    _scan(text, 0, len(text), -1, nodes, False)
    return nodes


def _close_list(open_: list[int], nodes: list[Node], at: int) -> None:
    """Ends the innermost list at ``at``, and its last entry with it."""
    while open_:
        i = open_.pop()
        if i == -2:
            return
        if nodes[i].ce < 0:
            nodes[i].ce = at
        nodes[i].end = at


def _scan(text: str, pos: int, stop: int, top: int, nodes: list[Node], lines_only: bool) -> None:
    open_: list[int] = []  # open li and \item nodes, -2 for lists
    unclosed: set[str] = set()  # tags that are not closed any more
    items: list[int] = []  # Markdown and wiki items that the next item may belong to
    para = -1  # start of the current paragraph
    plain = 0  # lines it has
    braces: dict[int, int] | None = None  # found when first needed
    if pos == 0 and text.startswith("---\n"):
        end = re.compile(r"^---[ \t]*$", re.M).search(text, 4)
        blank = _BLANK.search(text, 3)
        if end and (not blank or end.start() < blank.start()):
            pos = end.end()

    def add(form: str, start: int, end: int, cs: int, ce: int, **kw) -> int:
        inside = next((i for i in reversed(open_) if i >= 0), top)
        nodes.append(Node(_FORM[form], start, end, cs, ce, kw.pop("parent", inside), **kw))
        return len(nodes) - 1

    def code(form: str, start: int, end: int, cs: int, ce: int, **kw) -> None:
        i = add(form, start, end, cs, ce, **kw)
        if not lines_only:
            _scan(text, cs, ce, i, nodes, True)

    def close_entry(at: int) -> None:
        if open_ and open_[-1] >= 0:
            node = nodes[open_[-1]]
            if node.ce < 0:
                node.ce = at

    begin_line = True
    while pos < stop:
        eol = text.find("\n", pos, stop)
        if eol < 0:
            eol = stop
        if begin_line:
            line = text[pos:eol]
            head = line.lstrip()
            if not head:
                para, plain, items = -1, 0, []
                if open_ and -2 not in open_:  # an entry outside any list ends with its paragraph
                    _close_list(open_, nodes, pos)
                pos = eol + 1
                continue
            if head[0] in _STARTS and (m := _LINE.match(text, pos, eol)):
                kind = m.lastgroup
                indent = len(line) - len(head)
                if kind == "fence":
                    mark = m.group("fence")
                    close = re.compile(rf"^[ \t]*(?:>[ ]?)*[ \t]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, eol + 1, stop) if eol < stop else None
                    cs = min(eol + 1, stop)
                    ce, end = (close.start(), close.end()) if close else (stop, stop)
                    code("fence", pos, end, cs, max(cs, ce), level=len(mark), attrs=text[m.end() : eol].strip(), closed=bool(close), indent=indent)
                    pos, para, items = end + 1, -1, []
                    continue
                if kind == "hash" or kind == "equals":
                    block = _is_block(text, m, eol)
                    add(kind, pos, eol, m.end(), eol, level=len(m.group(kind)), indent=indent, closed=block)
                    if block:
                        items, para = [], -1
                    elif para < 0:
                        para, plain = pos, 1
                elif kind == "rule":
                    if para >= 0:
                        add("setext", para, eol, para, pos - 1, level=1 if head[0] == "=" else 2, indent=indent)
                    pos, para = eol + 1, -1
                    continue
                elif kind:
                    level = len(m.group("stars")) if kind == "stars" else 1
                    rank = level * 100 if kind == "stars" else 100 + indent
                    while items and nodes[items[-1]].level >= rank:
                        items.pop()
                    i = add(kind, pos, eol, m.end(), eol, level=rank, indent=indent, attrs=head[0], **({"parent": items[-1]} if items else {}))
                    nxt = eol + 1
                    while nxt < stop:  # indented continuation lines
                        e = text.find("\n", nxt, stop)
                        e = stop if e < 0 else e
                        more = text[nxt:e]
                        if len(more) - len(more.lstrip()) < indent + 2 or not more.strip() or _is_block(text, _LINE.match(text, nxt, e), e):
                            break
                        nodes[i].ce = nodes[i].end = e
                        nxt = e + 1
                    items.append(i)
                    para = -1
            elif not lines_only and para < 0 and not items and not open_ and (line.startswith("    ") or line[0] == "\t") and (pos == 0 or text[max(0, pos - 2) : pos] == "\n\n"):
                end = eol
                while True:
                    e = text.find("\n", end + 1, stop)
                    e = stop if e < 0 else e
                    more = text[end + 1 : e]
                    if end >= stop or not (more.startswith("    ") or more[:1] == "\t"):
                        break
                    end = e
                code("indent", pos, end, pos, end)
                pos = end + 1
                continue
            elif para < 0:
                para, plain = pos, 1 if head[0] not in "<|\\{" else 0
            begin_line = False
        if lines_only:
            pos, begin_line = eol + 1, True
            continue
        # inline constructs in the rest of the line; one that ends in a later line moves on to there
        at = pos
        jumped = False
        if _SPECIAL.search(text, pos, eol):
            while m := _INLINE.search(text, at, min(eol + 1, stop)):
                s, e = m.start(), m.end()
                if s >= eol:
                    break
                g = m.group()
                if g == "<!--":
                    x = text.find("-->", e, stop)
                    e = x + 3 if x >= 0 else e
                elif tag := m.group("tag"):
                    tag = tag.lower()
                    shut = m.group("close")
                    attrs = m.group("attrs")
                    if tag[0] == "h" and len(tag) == 2:
                        if not shut:
                            ce, e, ok = (e, e, False) if tag in unclosed else _find_close(text, tag, e)
                            if ok:
                                add("htag", s, e, m.end(), ce, level=int(tag[1]), attrs=attrs)
                            else:
                                unclosed.add(tag)
                                e = m.end()
                    elif tag in ("ul", "ol"):
                        if not shut:
                            close_entry(s)
                            open_.append(-2)
                        else:
                            _close_list(open_, nodes, s)
                    elif tag == "li":
                        if open_ and open_[-1] >= 0 and nodes[open_[-1]].form == _FORM["li"]:
                            close_entry(s)
                            nodes[open_.pop()].end = s
                        if not shut:
                            open_.append(add("li", s, stop, e, -1, attrs=attrs, level=open_.count(-2)))
                    elif not shut:
                        if tag == "pre":
                            ce, e, ok = _find_close(text, tag, e)
                            code("pre", s, e, m.end(), ce, attrs=attrs, closed=ok)
                        elif tag in ("syntaxhighlight", "source"):
                            ce, e, ok = _find_close(text, tag, e)
                            code("highlight", s, e, m.end(), ce, attrs=attrs, closed=ok)
                        elif tag == "math":
                            ce, e, ok = _find_close(text, tag, e)
                            add("math", s, e, m.end(), ce, attrs=attrs, closed=ok)
                        else:  # inline code, scripts and the like: nothing inside counts
                            ce, x, ok = (e, e, False) if tag in unclosed else _find_close(text, tag, e)
                            if not ok:
                                unclosed.add(tag)
                            elif tag in ("script", "style") or not _BLANK.search(text, e, ce):
                                e = x
                elif env := m.group("env"):
                    if m.group("be") == "begin":
                        if env in VERBATIM or env in EQUATIONS:
                            close = re.compile(rf"\\end\{{{env}\*?\}}").search(text, e, stop)
                            ce, e = (close.start(), close.end()) if close else (stop, stop)
                            if env in VERBATIM:
                                code("verbatim", s, e, m.end(), ce, closed=bool(close))
                            else:
                                add("equation", s, e, m.end(), ce, closed=bool(close))
                        elif env in LISTS:
                            close_entry(s)
                            open_.append(-2)
                    elif env in LISTS:
                        _close_list(open_, nodes, s)
                elif m.group("item"):
                    if open_ and open_[-1] >= 0:
                        close_entry(s)
                        nodes[open_.pop()].end = s
                    open_.append(add("item", s, stop, e, -1, level=open_.count(-2)))
                elif m.group("sec"):
                    braces = _brace_ends(text) if braces is None else braces
                    x = braces.get(e, -1)
                    if x >= 0:
                        add("section", s, x + 1, e, x, level=g.count("sub") + 1)
                        e = x + 1
                elif o := m.group("open"):
                    x = text.find("\\)" if o == "\\(" else "\\]", e, stop)
                    if x >= 0 and not _BLANK.search(text, e, x):
                        add("paren" if o == "\\(" else "bracket", s, x + 2, e, x)
                        e = x + 2
                elif d := m.group("dollars"):
                    x = text.find(d, e, stop)
                    if d == "$$":
                        if x > e and not _BLANK.search(text, e, x):
                            add("dollars", s, x + 2, e, x)
                            e = x + 2
                    elif x > e and text[x - 1] != "\\" and not _BLANK.search(text, e, x):
                        add("dollar", s, x + 1, e, x)
                        # where the signs can't enclose, the second may open what follows
                        if text[e] not in " \t\n" and text[x - 1] not in " \t\n" and not text[x + 1 : x + 2].isdigit():
                            e = x + 1
                elif tick := m.group("tick"):
                    blank = text.find("\n\n", e, stop)
                    x = re.compile(rf"(?<!`){tick}(?!`)").search(text, e, blank if blank >= 0 else stop)
                    if x and not _BLANK.search(text, e, x.start()):
                        e = x.end()
                elif brace := m.group("brace"):
                    x = text.find("}}" if brace == "{{" else "\n|}", e, stop)
                    if x >= 0 and (brace == "{|" or not _BLANK.search(text, e, x)):
                        e = x + (2 if brace == "{{" else 3)
                at = e
                if at > eol:
                    jumped = True
                    break
        if jumped:
            pos = at
            if pos < stop and text[pos - 1] == "\n":
                begin_line, para = True, -1
            continue
        pos, begin_line = eol + 1, True
    for i in open_:
        if i >= 0 and nodes[i].ce < 0:
            nodes[i].ce = stop
    if not lines_only:  # else entries around the code are still open
        for node in nodes:
            if node.ce < 0:
                node.ce = node.end


# ---------------------------------------------------------------- features

#: Buckets that attribute tokens are hashed into.
ATTR_BUCKETS = 32
FEATURES = 37 + ATTR_BUCKETS
_ATTR = re.compile(r"[A-Za-z]+")
#: Classes of characters that are counted in a node, by code point; those above are letters or digits if Unicode says so.
_KINDS = ("letter", "digit", "symbol", "bracket", "line", "space")


@functools.cache
def _char_kinds() -> np.ndarray:
    """For each code point a bit mask over ``_KINDS``."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        out[i] = 1 if c.isalpha() else 2 if c.isdigit() else 4 if c in "\\{}^_=()<>;|&" else 0
        if c == "[":
            out[i] |= 8
        if c == "\n":
            out[i] |= 16
        if c.isspace():
            out[i] |= 32
    return out


def _prefix_counts(text: str) -> np.ndarray:
    """Running counts of each kind of character and of words begun, so that any stretch is counted at once."""
    kinds = _char_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    bits = ((kinds[None, :] >> np.arange(len(_KINDS), dtype=np.uint8)[:, None]) & 1).astype(np.int32)
    space = bits[5].astype(bool)
    begun = ~space & np.r_[True, space[:-1]]
    return np.concatenate([np.zeros((len(_KINDS) + 1, 1), np.int64), np.cumsum(np.vstack([bits, begun]), axis=1)], axis=1)


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """One row per node: form, attributes, depth, density of the whole node, neighbours in the text and among siblings."""
    n = len(nodes)
    out = np.zeros((n, FEATURES))
    counts = [0] * len(FORMS)
    for x in nodes:
        counts[x.form] += 1
    families = [sum(counts[i] for i in g) for g in ((0, 1, 5, 10), (2, 6, 12, 20), (3, 8, 11), (4, 9, 13, 19))]
    whole = max(1, sum(families))
    depth, kids, covered, in_code = [0] * n, [0] * n, [0] * n, [0] * n
    last_child: dict[int, int] = {}
    size = max(1, len(text))
    cs = np.array([min(x.cs, len(text)) for x in nodes])
    ce = np.maximum(cs, [min(x.ce, len(text)) for x in nodes])
    run = _prefix_counts(text)
    within = run[:, ce] - run[:, cs]
    length = np.maximum(1, ce - cs)
    for i, x in enumerate(nodes):
        p = x.parent
        if p >= 0:
            depth[i] = depth[p] + 1
            kids[p] += 1
            covered[p] += x.end - x.start
            in_code[i] = in_code[p] or nodes[p].form in _CODES
        prev = last_child.get(p, -1)
        last_child[p] = i
        before, after = text[max(0, x.start - 2) : x.start], text[x.end : x.end + 2]
        first, last = text[x.cs : x.cs + 1], text[x.ce - 1 : x.ce] if x.ce > x.cs else ""
        mark = text[x.start : x.cs].strip()
        number = int(mark[:-1]) if x.form == 7 and mark[:-1].isdigit() else -1
        row = out[i]
        row[0], row[1], row[2], row[3] = x.form, x.level, depth[i], in_code[i]
        row[4] = nodes[p].form if p >= 0 else -1
        row[12], row[13] = before == "\n\n" or x.start == 0, after == "\n\n" or x.end >= size
        row[14] = prev >= 0 and nodes[prev].form == x.form and x.start - nodes[prev].end <= 2
        row[15] = prev >= 0 and x.start - nodes[prev].end
        row[16], row[18] = x.closed, x.indent
        lead = text[x.cs : x.cs + 40].lstrip()[:1]
        tail = text[max(x.cs, x.ce - 40) : x.ce].rstrip()[-1:]
        row[36] = lead != "" and lead in "<|"
        row[19], row[20] = lead.isupper(), bool(tail) and tail in ".!?:;,"
        row[21], row[22] = families[0] / whole, families[1] / whole
        row[23], row[24] = families[2] / whole, families[3] / whole
        row[26] = x.cs - x.start - len(mark)  # blanks around the mark
        row[27], row[28] = first.isspace(), last.isspace()
        row[29], row[30] = after[:1].isdigit(), after[:1].isalnum()
        row[31], row[32] = before[-1:].isalnum(), not before or before[-1] == "\n"
        row[33] = number
        row[34] = number == 1 or (row[14] > 0 and number >= 0 and number == out[prev, 33] + 1)
        if x.attrs:
            tokens = _ATTR.findall(x.attrs)
            row[17] = len(tokens)
            for t in tokens:
                row[37 + zlib.crc32(t.lower().encode()) % ATTR_BUCKETS] += 1
    out[:, 25], out[:, 35] = kids, np.array(covered) / length
    out[:, 5], out[:, 6], out[:, 7] = np.log1p(ce - cs), within[4], within[6]
    out[:, 8], out[:, 9], out[:, 10], out[:, 11] = within[0] / length, within[1] / length, within[2] / length, within[3] / length
    for i in range(n - 1):  # a sibling that follows at once
        if nodes[i + 1].form == nodes[i].form and nodes[i + 1].parent == nodes[i].parent and nodes[i + 1].start - nodes[i].end <= 2:
            out[i, 14] += 2
    return out


# ---------------------------------------------------------------- decoding

#: Labels that may stand anywhere below each label.
_BELOW = {0: (0, 1, 2, 3, 4), 1: (0, 4), 2: (0, 2, 3, 4), 3: (0,), 4: (0,)}
#: The sets of labels that remain below some chain of ancestors, from most to least; closed under intersection.
_SCOPES = ((0, 1, 2, 3, 4), (0, 2, 3, 4), (0, 4), (0,))
_SCOPE = {(scope, k): next(i for i, s in enumerate(_SCOPES) if set(s) == set(_SCOPES[scope]) & set(_BELOW[k])) for scope in range(4) for k in _SCOPES[scope]}


def decode(parents: list[int], log_p: np.ndarray) -> list[int]:
    """The labels of largest joint probability such that every node's label may stand below all its ancestors' labels."""
    n = len(parents)
    if all(p < 0 for p in parents):
        return log_p.argmax(1).tolist() if n else []
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
    best = [[0.0] * n for _ in _SCOPES]  # of the subtree, within each scope
    pick = [[0] * n for _ in _SCOPES]
    for i in range(n - 1, -1, -1):  # parents come before their children
        sums = [sum(best[s][c] for c in children[i]) for s in range(len(_SCOPES))]
        for s, labels in enumerate(_SCOPES):
            k = max(labels, key=lambda k: log_p[i, k] + sums[_SCOPE[s, k]])
            pick[s][i], best[s][i] = k, log_p[i, k] + sums[_SCOPE[s, k]]
    out, scope = [0] * n, [0] * n
    for i, p in enumerate(parents):
        scope[i] = _SCOPE[scope[p], out[p]] if p >= 0 else 0
        out[i] = pick[scope[i]][i]
    return out


def _apart(nodes: list[Node], labels: list[int], log_p: np.ndarray) -> list[int]:
    """``labels`` without the less likely of two formulas that share a dollar sign."""
    last = -1
    for i, x in enumerate(nodes):
        if labels[i] and FORMS[x.form] == "dollar":
            if last >= 0 and x.start < nodes[last].end:
                a, b = (log_p[j, labels[j]] - log_p[j, 0] for j in (last, i))
                labels[last if b > a else i] = 0
                last = i if b > a else last
            else:
                last = i
    return labels


# ---------------------------------------------------------------- content

_MARKED = re.compile(r"[*_~=`'\[\]<>&\\{}!|]")
_DROP = re.compile(r"(?P<note><!--)|<ref\b[^<>]*/>|(?P<ref><ref\b[^<>]*>)|\{\{[^{}]*\}\}|\\(?:cite[a-z]*|label|ref|footnote)\s*(?:\[[^\]]*\])?\{[^{}]*\}|\[\^[^\]\s]+\]", re.S | re.I)
_LINKS = re.compile(r"!?\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]|!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|\[(?:https?|mailto|ftp):\S*\s+([^\[\]]*)\]")
_COMMAND = re.compile(r"\\(?:textbf|textit|texttt|emph|underline|textsc|textsf|textrm|text|mbox|url|uline)\s*\{([^{}]*)\}|\\href\s*\{[^{}]*\}\{([^{}]*)\}")
_QUOTES = re.compile(r"'{2,5}")
_REF_END = re.compile(r"</ref>", re.I)
_MARK = re.compile(r"[*_]|~~|==")
# where a mark may close, by the mark; "**" has a second, looser form
_ENDS = {m: re.compile(rf"(?<=\S)(?={re.escape(m)}{after})") for marks, after in ((("***", "**", "*"), r"(?!\*)"), (("___", "__", "_"), r"(?!\w)"), (("~~", "=="), "")) for m in marks} | {"loose": re.compile(r"(?<=\S)(?=\*\*)")}
_BREAK = re.compile(r"<br\s*/?>|\\\\(?:\[[^\]]*\])?|\\newline\b", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TICKS = re.compile(r"`+")
_BOX = re.compile(r"^\[[ xX]\]\s+")
_ESCAPE = re.compile(r"\\([%&$#_{}!\"'()*+,\-./:;<=>?@\[\]^`|~])")


def _drop(s: str, keep: bool = False) -> str:
    """``s`` without comments, references and templates. A kind of end that is missing once is not searched for again.

    With ``keep`` the words of notes, references and templates stay, in brackets; marks and keys that only refer elsewhere go.
    """
    parts, last, pos, missing = [], 0, 0, set()
    while m := _DROP.search(s, pos):
        end, kind = m.end(), m.lastgroup
        words = ""
        if kind:
            end = -1
            if kind not in missing:
                if kind == "note":
                    x = s.find("-->", m.end())
                    end = x + 3 if x >= 0 else -1
                elif x := _REF_END.search(s, m.end()):
                    end, words = x.end(), s[m.end() : x.start()]
            if end < 0:
                missing.add(kind)
                pos = m.start() + 1
                continue
        elif keep and m.group()[0] == "{":  # a template: its name and the values of its parameters
            words = ", ".join(x for x in (p.rsplit("=", 1)[-1].strip() for p in m.group()[2:-2].split("|")) if x)
        elif keep and m.group().startswith("\\footnote"):
            words = m.group()[m.group().index("{") + 1 : -1]
        parts.append(s[last : m.start()])
        if keep and words.strip():
            parts.append(f" ({words.strip()})")
        last = pos = end
    return "".join(parts) + s[last:]


def _emphasis(s: str) -> str:
    """``s`` without one level of emphasis. Ends of each mark are found once, then bisected."""
    ends: dict[str, list[int]] = {}

    def close(kind: str, at: int) -> int:
        if kind not in ends:
            ends[kind] = [m.start() for m in _ENDS[kind].finditer(s)]
        i = bisect.bisect_left(ends[kind], at)
        return ends[kind][i] if i < len(ends[kind]) else -1

    parts, last, pos = [], 0, 0
    while m := _MARK.search(s, pos):
        p, c = m.start(), m.group()
        before = s[p - 1] if p else " "
        word = before.isalnum() or before == "_"
        if len(c) == 2:
            kinds = [(c, 2)]
        elif word or c == before == "*":
            kinds = []
        else:
            kinds = [(c * n, n) for n in (3, 2, 1) if s.startswith(c * n, p)]
        if c == "*" and s.startswith("**", p):
            kinds.append(("loose", 2))
        pos = p + 1
        for kind, n in kinds:
            if p + n < len(s) and not s[p + n].isspace() and (q := close(kind, p + n + 1)) >= 0:
                parts += [s[last:p], s[p + n : q]]
                last = pos = q + n
                break
    return "".join(parts) + s[last:]


def _code_spans(s: str) -> list[tuple[int, int, int, int]]:
    """(start, end, content start, content end) of code spans: a run of backticks up to the next run of as many, else of fewer."""
    runs = [m.span() for m in _TICKS.finditer(s)]
    starts: dict[int, list[int]] = {}
    for a, b in runs:
        starts.setdefault(b - a, []).append(a)
    spans, last = [], 0
    for a, b in runs:
        if a < last:
            continue
        for n in range(b - a, 0, -1):
            ends = starts.get(n, [])
            if (i := bisect.bisect_left(ends, b)) < len(ends):
                last = ends[i] + n
                spans.append((a, last, a + n, ends[i]))
                break
    return spans


def _plain(s: str, tex: bool, keep: bool) -> str:
    s = _BREAK.sub(" ", s)
    if "{" in s or "[" in s or "<" in s:
        s = _drop(s, keep)
        s = _LINKS.sub(lambda m: next((x for x in (m.group(2), m.group(3), m.group(4), m.group(1)) if x), ""), s)
    if "\\" in s:
        while (t := _COMMAND.sub(lambda m: m.group(1) or m.group(2) or "", s)) != s:
            s = t
    if "''" in s:
        s = _QUOTES.sub("", s)
    if tex:
        s = s.replace("~", " ")
    for _ in range(3):
        t = _emphasis(s)
        if t == s:
            break
        s = t
    s = _TAG.sub("", s)
    return _ESCAPE.sub(r"\1", s) if "\\" in s else s


def inline_text(s: str, tex: bool = False, keep: bool = False) -> str:
    """Plain text of a heading, list entry or paragraph: no inline marks, references decoded, blanks joined.

    With ``keep`` the words of footnotes, references and templates stay.
    """
    if _MARKED.search(s) or (tex and "~" in s):
        if "`" in s:
            parts, last = [], 0
            for start, end, a, b in _code_spans(s):
                parts += [_plain(s[last:start], tex, keep), s[a:b]]
                last = end
            s = "".join(parts) + _plain(s[last:], tex, keep)
        else:
            s = _plain(s, tex, keep)
        if "&" in s:
            s = html.unescape(s)
    return " ".join(s.split())


def content(text: str, node: Node, label: int) -> str:
    """What an element holds, by its form."""
    return _shown(text[node.cs : node.ce], node, label)


def _shown(s: str, node: Node, label: int, keep: bool = False) -> str:
    form = FORMS[node.form]
    if label == 1:
        if form == "hash":
            s = re.sub(r"\s+#+\s*$", "", s)
        elif form == "equals":
            s = re.sub(r"=+\s*$", "", s) if not node.level else re.sub(rf"={{1,{node.level}}}\s*$", "", s)
        return inline_text(s, form == "section", keep)
    if label == 2:
        return inline_text(_BOX.sub("", s.lstrip()), form == "item", keep)
    if label == 3:
        if form == "pre":
            s = html.unescape(re.sub(r"</?code\b[^<>]*>", "", s, flags=re.I))
    elif form in ("math", "paren", "bracket") and "&" in s:
        s = html.unescape(s)
    return " ".join(s.split())


# ---------------------------------------------------------------- model


#: Labelled notes that the trees are fitted on.
NOTES = 1000


@functools.cache
def model(notes: int = NOTES, seed: int = 7) -> BoostedTrees:
    """Trees fitted on a bounded sample: ``notes`` labelled notes that :mod:`markup_training` writes from ``seed``."""
    from lattica.llm.markup_training import labelled_notes

    xs, ys = [], []
    for text, truth in labelled_notes(notes, seed):
        nodes = parse(text)
        if nodes:
            xs.append(features(text, nodes))
            ys += [truth.get(x.start, 0) for x in nodes]
    return BoostedTrees(len(LABELS), rounds=20, depth=5).fit(np.vstack(xs), np.array(ys))


def label_notes(texts: list[str], trees: BoostedTrees) -> list[list[tuple[Node, int]]]:
    """Nodes with their decoded labels, for each text."""
    parsed = [parse(t) for t in texts]
    rows = [features(t, ns) for t, ns in zip(texts, parsed) if ns]
    log_p = trees.log_proba(np.vstack(rows)) if rows else None
    out, at = [], 0
    for ns in parsed:
        labels = _apart(ns, decode([x.parent for x in ns], log_p[at : at + len(ns)]), log_p[at : at + len(ns)]) if ns else []
        at += len(ns)
        out.append(list(zip(ns, labels)))
    return out


def elements(texts: list[str], trees: BoostedTrees) -> list[list[tuple[str, str]]]:
    """Distinct (kind, content) of each text's structural elements; elements without content are none."""
    return [_elements(text, labelled) for text, labelled in zip(texts, label_notes(texts, trees))]


def _elements(text: str, labelled: list[tuple[Node, int]]) -> list[tuple[str, str]]:
    found = {(LABELS[k], content(text, x, k)) for x, k in labelled if k}
    return sorted(f for f in found if f[1])


_HEADER = re.compile(r"\\documentclass[^\n]*\n|\\usepackage[^\n]*\n|\\(?:begin|end)\{[A-Za-z]+\*?\}[ \t]*\n?|</?(?:ul|ol|p|div|table|tr|section|article)\b[^<>]*>|^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$", re.M | re.S | re.I)
#: Source that is no text of the note.
_SOURCE = re.compile(r"<(?P<tag>script|style)\b[^<>]*>.*?</(?P=tag)\s*>", re.S | re.I)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}", re.M | re.S)
_CELLS = re.compile(r"^[ \t]*(\|-|\|\+|[|!])(.*)$", re.M)
_CELL_ATTRS = re.compile(r"^[^|\[\]{}]*=[^|\[\]{}]*\|(?!\|)")
_TABLE_ROW = re.compile(r"^[ \t]*\|(.*)\|[ \t]*$", re.M)
_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|[ \t]*$", re.M)
_BAR = re.compile(r"\|(?![^\[\]]*\]\])")
_HTML_CELL = re.compile(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", re.I)


def _wiki_rows(m: re.Match) -> str:
    """The cells of a wiki table, one row in a line."""
    rows: list[list[str]] = [[]]
    for mark, rest in _CELLS.findall(m.group(1)):
        if mark == "|-":
            rows.append([])
        elif mark == "|+":
            rows += [[rest], []]
        else:
            rows[-1] += [_CELL_ATTRS.sub("", cell) for cell in re.split(r"\|\||!!" if mark == "!" else r"\|\|", rest)]
    return "\n\n" + "\n\n".join(" ¦ ".join(c.strip() for c in r) for r in rows if any(c.strip() for c in r)) + "\n\n"


def _tables(s: str) -> str:
    """``s`` with the rows of its tables as paragraphs, cells told apart by bars, rules between rows left out."""
    if "|" in s:
        s = _WIKI_TABLE.sub(_wiki_rows, s)
        s = _TABLE_RULE.sub("", s)
        s = _TABLE_ROW.sub(lambda m: "\n" + " ¦ ".join(c.strip() for c in _BAR.split(m.group(1))) + "\n", s)
    return _HTML_CELL.sub(" ¦ ", s)


def clean_text(text: str, labelled: list[tuple[Node, int]]) -> str:
    """The text without markup: headings as '#' lines, entries as '-' lines, code in fences, formulas between '$'.

    Words of tables (a row in a line, cells between bars), templates, footnotes and references stay; comments and the source of scripts
    and styles go. Formulas inside an entry or heading stay in its line; code and other elements there follow as blocks of their own, and
    what comes after them as a new line.
    """
    out, pos = [], 0
    stop = lambda x, k: x.ce if k == 2 else x.end
    marked = sorted(((x, k) for x, k in labelled if k), key=lambda p: (p[0].start, -stop(*p)))
    # stands for an element while its surroundings are read as text
    sign = next(c for c in map(chr, itertools.chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE))) if c not in text) if marked else ""

    def prose(a: int, b: int) -> None:
        for part in _BLANK.split(_HEADER.sub("\n\n", _tables(_SOURCE.sub(" ", text[a:b])))):
            if line := inline_text(part, keep=True):
                out.append(line.replace(" ¦ ", " | ") + "\n")

    def emit(i: int, into: list[str]) -> int:
        """Shows element ``i`` and those inside; the index after them."""
        nonlocal pos
        x, k = marked[i]
        end, i = stop(x, k), i + 1
        pos = max(pos, end)
        if k > 2:
            if k == 3:
                s = text[x.cs : x.ce]
                into.append(f"```\n{(html.unescape(re.sub(r'</?code[^<>]*>', '', s, flags=re.I)) if FORMS[x.form] == 'pre' else s).strip(chr(10))}\n```\n")
            else:
                into.append(f"${content(text, x, k)}$\n")
            while i < len(marked) and marked[i][0].start < end:
                i += 1
            return i
        parts, inner, at = [], [], x.cs
        while i < len(marked) and marked[i][0].start < end:
            y, label = marked[i]
            shown: list[str] = []
            i = emit(i, shown)
            parts += [text[at : min(y.start, x.ce)], f"{sign}{len(inner)}{sign}"]
            inner.append((label, shown))
            at = max(at, stop(y, label))
        pieces = re.split(f"{sign}(\\d+){sign}", _shown("".join(parts) + text[at : x.ce], x, k, keep=True))
        for j in sorted({*range(len(inner))} - {*map(int, pieces[1::2])}):  # inside a note or link that is left out
            pieces += [str(j), ""]
        level = x.level if FORMS[x.form] in ("hash", "equals", "htag", "setext") else max(1, x.level)
        prefix, line = "- " if k == 2 else f"{'#' * max(1, min(6, level))} ", pieces[0]
        for j, after in zip(map(int, pieces[1::2]), pieces[2::2]):
            label, shown = inner[j]
            if label == 4:
                line += shown[0].rstrip("\n") + after
                continue
            if prefix or line.strip():
                into.append(f"{prefix}{line.strip()}".rstrip() + "\n")
            into += shown
            prefix, line = "", after
        if prefix:
            into.append(f"{prefix}{line}\n")
        elif line.strip():
            into.append(line.strip() + "\n")
        return i

    i = 0
    while i < len(marked):
        if marked[i][0].start > pos:
            prose(pos, marked[i][0].start)
        i = emit(i, out)
    prose(pos, len(text))
    return "\n".join(out)


def structure(rows: DataFrame, key: str, text: str, notes: int = NOTES, with_text: bool = False) -> DataFrame:
    """(key, elements[, clean]) of each row with a non-null text; elements is an array of (kind, content).

    The trees are fitted once on the driver, on ``notes`` labelled notes, and sent to the workers; texts go to Python whole, in
    Arrow batches, and nothing is shuffled. Empty texts have no elements. Keys need not be unique; other columns are dropped.
    """
    trees = model(notes)
    kind = "array<struct<kind:string,content:string>>"
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, elements {kind}" + (", clean string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                texts = part[text].tolist()
                labelled = label_notes(texts, trees)
                out = pd.DataFrame({key: part[key].to_numpy(), "elements": [[{"kind": k, "content": c} for k, c in _elements(t, ns)] for t, ns in zip(texts, labelled)]})
                if with_text:
                    out["clean"] = [clean_text(t, ns) for t, ns in zip(texts, labelled)]
                yield out

    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)
