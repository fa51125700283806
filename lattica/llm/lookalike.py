"""Visually identical text with different characters, brought to one form.

Normalization quick-check properties find the unstable characters; only the segments around them, with the
starter before them as boundary context, are normalised, and spliced back into the unchanged rest.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("form", "combining", "invisible", "space", "lookalike")

# Letters of other scripts and the Latin letters that they are drawn like. Letters that only resemble one
# (Cyrillic к, м, н, т, в in lower case, и, п, З; Greek η, σ, τ, ω) are left out.
LOOKALIKES = {
    "CYRILLIC": {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
        "ӏ": "l", "ѵ": "v", "ё": "ë", "ү": "y", "ѐ": "è", "ӑ": "ă", "ӓ": "ä", "ӗ": "ĕ", "ӧ": "ö", "ӱ": "ÿ", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
        "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V", "Ё": "Ë", "Ү": "Y",
        "Ѐ": "È", "Ӑ": "Ă", "Ӓ": "Ä", "Ӗ": "Ĕ", "Ӧ": "Ö",
    },
    "GREEK": {
        "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "ά": "á", "ί": "í", "ό": "ó", "ύ": "ú", "ϊ": "ï", "ϋ": "ü",
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϊ": "Ï", "Ϋ": "Ÿ",
    },
    "ARMENIAN": {"օ": "o", "ս": "u", "հ": "h", "ց": "g", "ո": "n", "Օ": "O", "Ս": "U"},
    "CHEROKEE": {
        "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    },
}

# Characters that show nothing, besides those of general category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠎"
#: Visible or structural Cf characters stay: Arabic number signs and the like, and emoji tags.
_KEEP_CF = re.compile("[؀-؅۝܏࣢࢐࢑\U000110bd\U000110cd\U000e0020-\U000e007f]")
#: Signs that NFKC would turn into letters of another script or alphabet.
_KEEP_FORM = "µªº"
_EMOJI = "©®‼-⯿〰〽㊗㊙\U0001f000-\U0001faff️⃣"
_ZWJ = re.compile(f"(?<=[{_EMOJI}])[‍️](?=[{_EMOJI}])|(?<=[{_EMOJI}])️")


@functools.cache
def _class(c: str) -> str:
    """Quick-check class of a character: stable '', form, styled, invisible, space, mark, or other script's letter."""
    cat = ud.category(c)
    if cat == "Zs":
        return "space" if c != " " else ""
    if (cat == "Cf" and not _KEEP_CF.match(c)) or c in INVISIBLE:
        return "invisible"
    if cat[0] == "M" or "\u1160" <= c <= "\u11ff":
        return "mark"
    if not ud.is_normalized("NFKC", c) and c not in _KEEP_FORM:
        kind = ud.decomposition(c)
        return "styled" if kind.startswith("<") and not kind.startswith("<noBreak") and ud.normalize("NFKC", c).isalnum() else "form"
    if cat[0] == "L" and cat != "Lm" and c > "\u024f" and _script(c) != "LATIN":
        return "other"
    return ""


@functools.cache
def _script(c: str) -> str:
    """The script of a letter, by the first word of its name."""
    return ud.name(c, "?").split(" ", 1)[0].split("-", 1)[0]


@functools.lru_cache(4096)
def _segments(unstable: frozenset[str]) -> re.Pattern:
    """Runs of unstable characters with the character before them."""
    return re.compile(f"(?s).?[{re.escape(''.join(sorted(unstable)))}]+")


@functools.lru_cache(4096)
def _marked(marks: frozenset[str]) -> re.Pattern:
    return re.compile(f"[^\\W\\d_][{re.escape(''.join(sorted(marks)))}]+")


_LATIN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]")
_WORD = re.compile(r"[^\W_]+")
#: A word with the marks that stand on its letters.
_MARKED_WORD = re.compile("[^\\W_]+(?:[\u0300-\u036f]+[^\\W_]*)*")
_TO_LATIN = {c: latin for twins in LOOKALIKES.values() for c, latin in twins.items()}
_FROM_LATIN = {script: {latin: c for c, latin in reversed(twins.items())} for script, twins in LOOKALIKES.items()}
#: Words on each side that speak for a script where a word's own letters leave several.
NEIGHBOURS = 3


def _in_script(word: str, script: str) -> str | None:
    """``word`` with all its letters in ``script``, or None where one has no twin there."""
    out = []
    for c in word:
        own = _script_of(c)
        if own and own != script:
            latin = _TO_LATIN.get(c, c if own == "LATIN" else None)
            c = latin if script == "LATIN" else _FROM_LATIN.get(script, {}).get(latin)
            if c is None:
                return None
        out.append(c)
    return "".join(out)


def _script_of(c: str) -> str:
    """Script of a letter, '' for digits, marks and modifiers."""
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return "LATIN"
    return _script(c) if (cat := ud.category(c))[0] == "L" and cat != "Lm" and c not in _KEEP_FORM else ""


def _one_script(text: str, start: int, word: str) -> str:
    """A mixed word of ``text`` in one of its own scripts, chosen by its letters and, where these leave several, by its neighbours.

    A script is possible if all letters of the others have a twin in it; a word for which none is possible stays as it is. Else
    the script of most letters in the nearest words of one script wins, then that of most letters of the word, then Latin.
    """
    counts: dict[str, int] = {}
    for c in word:
        if k := _script_of(c):
            counts[k] = counts.get(k, 0) + 1
    forms = {k: f for k in sorted(counts, key=lambda k: (k != "LATIN", k)) if (f := _in_script(word, k)) is not None}
    if len(forms) < 2:
        return next(iter(forms.values()), word)
    near = dict.fromkeys(forms, 0)
    for words_near in (_WORD.findall(text, max(0, start - 200), start)[-NEIGHBOURS:], _WORD.findall(text, start + len(word), start + len(word) + 200)[:NEIGHBOURS]):
        for w in words_near:
            kinds = {k for c in w if (k := _script_of(c))}
            if len(kinds) == 1 and (k := kinds.pop()) in near:
                near[k] += len(w)
    return forms[max(forms, key=lambda k: (near[k], counts[k]))]


def unify(text: str) -> tuple[str, list[str]]:
    """The text in one form, and which kinds of change it needed, in the order of ``KINDS``.

    ASCII text and text without any unstable character or letter of a look-alike script is returned as it is.
    Composed letters, emoji sequences, marks without a composed form and whole words of another script stay; so do
    mixed words that can't be written in one of their scripts, though they are reported.
    """
    if text.isascii():
        return text, []
    classes = {c: k for c in set(text) if c > "\x7f" and (k := _class(c))}
    if not classes:
        return text, []
    kinds: set[str] = set()
    others = {c for c, k in classes.items() if k == "other"}
    unstable = frozenset(c for c, k in classes.items() if k != "other")
    if unstable:
        joiners = {m.start() for m in _ZWJ.finditer(text)} if "\u200d" in unstable or "\ufe0f" in unstable else ()
        marks = frozenset(c for c in unstable if classes[c] == "mark")

        def canonical(m: re.Match) -> str:
            seg, start = m.group(), m.start()
            out = []
            for i, c in enumerate(seg):
                k = classes.get(c)
                if k == "invisible":
                    if start + i in joiners:
                        out.append(c)
                    else:
                        kinds.add("invisible")
                elif k == "space":
                    kinds.add("space")
                    out.append(" ")
                elif k == "styled" or k == "form":
                    if k == "styled":
                        kinds.add("form")
                    out.append(ud.normalize("NFKC", c))
                else:
                    out.append(c)
            plain = "".join(out)
            composed = ud.normalize("NFC", plain)
            if marks and len(composed) < len(plain) and any(len(ud.normalize("NFC", s)) < len(s) for s in _marked(marks).findall(plain)):
                kinds.add("combining")
            return composed

        text = _segments(unstable).sub(canonical, text)
        others = {c for c in set(text) if c > "\x7f" and _class(c) == "other"}
    if others and _LATIN.search(text):

        def one(m: re.Match) -> str:
            w = m.group()
            if w.isascii() or others.isdisjoint(w) or not _LATIN.search(w):
                return w
            kinds.add("lookalike")
            # a mark may have waited for the letter that it composes with
            return ud.normalize("NFC", _one_script(m.string, m.start(), w))

        text = _MARKED_WORD.sub(one, text)
    return text, [k for k in KINDS if k in kinds]


def words(text: str) -> list[str]:
    """Runs of letters and digits of the unified text, without case."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unify(text)[0].casefold())


_ASCII_WORD = re.compile(r"[a-z0-9]+")


def unify_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, [text,] kinds) for each row of ``docs``; null texts give a null text and no kinds.

    Rows whose text is pure ASCII, seen by its byte length, are answered in the JVM; only the others go to Python
    in Arrow batches. Keys need not be unique; nothing is shuffled. Other columns are dropped.
    """
    key_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), *([T.StructField(text, T.StringType())] if with_text else []), T.StructField("kinds", T.ArrayType(T.StringType()))])
    rows = docs.select(key, text)
    plain = F.col(text).isNull() | (F.octet_length(text) == F.char_length(text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [unify(x) for x in b[text]]
            out = {key: b[key], "kinds": [k for _, k in done]}
            if with_text:
                out[text] = [x for x, _ in done]
            yield pd.DataFrame(out)[schema.names]

    changed = rows.where(~plain).mapInPandas(run, schema)
    same = rows.where(plain).select(key, *([text] if with_text else []), F.array().cast("array<string>").alias("kinds"))
    return same.unionByName(changed)
