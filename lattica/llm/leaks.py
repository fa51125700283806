"""Evaluation texts leaking into training text.

MinHash containment search over size partitions. Both sides are cut into windows of the words that a leak needs at
least, each a set of word shingles; items are partitioned by size, as an item's size decides how long its windows
are. Of each window the minimum shingle hashes under a few permutations are its signature. A window that lies
wholly in the other text has the same signature there, so equal signatures within a partition find every contained
window, however long the document; candidates are verified by exact containment of all shingles in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.lookalike import words
from lattica.session import materialize

SHINGLE_WORDS = 5
#: Minimum hashes, under as many permutations, that make up one signature.
PERMUTATIONS = 3
RUN_WORDS = 20
#: Each size partition reaches to this many times its smallest size.
SIZE_STEP = 2
#: Distinct words whose hashes a worker remembers before it starts anew.
CACHE_WORDS = 500_000
#: Items whose words and signatures take at most this many bytes in all are sent to every worker; larger ones are joined.
BROADCAST_BYTES = 64 << 20

_cache: dict[str, int] = {}


def word_hashes(tokens: list[str]) -> list[int]:
    """64-bit hashes of words, remembered by word."""
    get, out = _cache.get, []
    add = out.append
    for w in tokens:
        h = get(w)
        if h is None:
            if len(_cache) > CACHE_WORDS:
                _cache.clear()
            h = _cache[w] = xxhash.xxh64_intdigest(w)
        add(h)
    return out


def run_for_size(size: int, run: int = RUN_WORDS, share: float = 0.0) -> int:
    """Words that a leak of an item of ``size`` words needs: the bound of the size partition that ``size`` falls into.

    Partition i holds sizes from run * SIZE_STEP**i on; its items need ``share`` of its smallest size, and ``run`` at least.
    """
    low = run
    while low * SIZE_STEP <= size:
        low *= SIZE_STEP
    return max(run, math.ceil(share * low))


def shingle_hashes(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words."""
    m = len(hashes) - shingle + 1
    s = np.zeros(max(0, m), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(shingle if m > 0 else 0):
            s = s * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + m]
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
    return s


def window_signatures(shingles: np.ndarray, owner: np.ndarray, shingle: int, run: int, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, position) of all windows of ``run`` words; of equal ones in a row only the first.

    ``shingles`` are those of many texts one after another, ``owner`` the position of each word's text.
    """
    n = len(owner) - run + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    need = run - shingle + 1
    low = None
    for p in range(permutations):
        # another order of the same shingles: multiply by an odd number and mix
        with np.errstate(over="ignore"):
            h = shingles * np.uint64(2 * (0x5851F42D4C957F2D * (p + 1) % 2**61) + 1)
            h ^= h >> np.uint64(32)
        width = 1
        while width < need:
            step = min(width, need - width)
            h = np.minimum(h[: len(h) - step], h[step:])
            width += step
        with np.errstate(over="ignore"):
            low = h if low is None else low * np.uint64(0x9E3779B97F4A7C15) + h
    keep = np.flatnonzero(owner[:n] == owner[run - 1 :])
    o, v = owner[keep], low[keep].view(np.int64)
    if len(o):
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
        o, v, keep = o[new], v[new], keep[new]
    return o, v, keep


def _flat(texts, shingle: int) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of each text, their shingle hashes one text after another, and the text of each word."""
    tokens = [words(t) for t in texts]
    flat = np.array(word_hashes([w for t in tokens for w in t]), np.uint64)
    return tokens, shingle_hashes(flat, shingle), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])


def contains_run(document: list[str], item: list[str], run: int) -> bool:
    """Whether ``run`` consecutive words of ``item`` stand in ``document``, in order."""
    hay = f" {' '.join(document)} "
    return any(f" {' '.join(item[i : i + run])} " in hay for i in range(len(item) - run + 1))


def _item_windows(items: DataFrame, key: str, text: str, shingle: int, run: int, share: float) -> DataFrame:
    """(key, size, run, sigs) of the items long enough to leak: words, words needed by the size partition, signatures."""
    schema = f"{key} {items.schema[key].dataType.simpleString()}, size int, run int, sigs array<long>"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                tokens, s, owner = _flat([t], shingle)
                n = len(tokens[0])
                need = run_for_size(n, run, share)
                if n >= need:
                    rows.append((k, n, need, sorted(set(window_signatures(s, owner, shingle, need)[1].tolist()))))
            yield pd.DataFrame(rows, columns=[key, "size", "run", "sigs"])

    return items.where(F.col(text).isNotNull()).mapInPandas(build, schema)


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", shingle: int = SHINGLE_WORDS, run: int = RUN_WORDS, share: float = 0.0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_key, item_key) of each document with each item of which it holds enough consecutive words.

    An item needs ``run`` words, or ``share`` of the least size of its size partition if that is more. Items whose
    measured size is within ``broadcast_bytes`` go to every worker, and each document is read once, searched and verified
    there, without any shuffle of texts. Larger sets of items are joined by partition and signature, and texts of
    candidates are fetched by a second join, whose strategy Spark picks by the size of the candidates, written before.
    Null keys or texts give no row; repeated rows count once; items shorter than needed can't leak.
    """
    if not 1 <= shingle <= run:
        raise ValueError("a shingle must have at least one word and fit into the run")
    whole = items.select(item_key, text).where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).distinct()
    windows = materialize(_item_windows(whole, item_key, text, shingle, run, share), "items")
    facts = windows.agg(F.sum(F.size("sigs") * 8 + F.col("size") * 64).alias("bytes"), F.collect_set("run").alias("runs")).first()
    runs = sorted(facts["runs"])  # one for each size partition: logarithmic in the largest size
    schema = f"{doc_key} {docs.schema[doc_key].dataType.simpleString()}, {item_key} {items.schema[item_key].dataType.simpleString()}"
    texts = docs.select(doc_key, text).where(F.col(doc_key).isNotNull() & F.col(text).isNotNull())
    if not runs:
        return docs.sparkSession.createDataFrame([], schema)
    if facts["bytes"] <= broadcast_bytes:
        return _search(texts, whole, doc_key, item_key, text, shingle, run, share, schema)

    sig_schema = f"{doc_key} {docs.schema[doc_key].dataType.simpleString()}, run int, sig long"

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, s, owner = _flat(b[text], shingle)
            for need in runs:
                o, v, _ = window_signatures(s, owner, shingle, need)
                yield pd.DataFrame({doc_key: b[doc_key].to_numpy()[o], "run": need, "sig": v})

    want = windows.select(item_key, "run", F.explode("sigs").alias("sig")).distinct()
    pairs = texts.mapInPandas(build, sig_schema).join(want, ["run", "sig"]).select(doc_key, item_key, "run").distinct()
    pairs = materialize(pairs, "candidates")
    held = pairs.join(whole.withColumnRenamed(text, "_item"), item_key).join(texts.withColumnRenamed(text, "_doc"), doc_key)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [contains_run(words(d), words(i), r) for d, i, r in zip(b["_doc"], b["_item"], b["run"])]
            yield b.loc[ok, [doc_key, item_key]]

    return held.mapInPandas(verify, schema).distinct()


def _search(texts: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, shingle: int, run: int, share: float, schema: str) -> DataFrame:
    """Every document against the signatures of all ``items``, whose size is bounded by the caller."""
    rows = items.collect()
    spread: dict[int, list[tuple[int, int]]] = {}  # by partition: (signature, item)
    tokens: list[list[str]] = []
    for i, r in enumerate(rows):
        found, s, owner = _flat([r[text]], shingle)
        tokens += found
        need = run_for_size(len(found[0]), run, share)
        if len(found[0]) >= need:
            spread.setdefault(need, []).extend((v, i) for v in set(window_signatures(s, owner, shingle, need)[1].tolist()))
    tables = {}
    for need, pairs in spread.items():
        pairs.sort()
        tables[need] = (np.array([v for v, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64))
    shared = texts.sparkSession.sparkContext.broadcast((tables, tokens, [r[item_key] for r in rows]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, tokens, keys = shared.value
        for b in batches:
            found: set[tuple[int, int]] = set()
            held, s, owner = _flat(b[text], shingle)
            for need, (sigs, who) in tables.items():
                o, v, _ = window_signatures(s, owner, shingle, need)
                first = np.searchsorted(sigs, v)
                hit = np.flatnonzero((first < len(sigs)) & (sigs[np.minimum(first, len(sigs) - 1)] == v))
                last = np.searchsorted(sigs, v[hit], "right")
                candidates = {(d, i) for d, a, z in zip(o[hit].tolist(), first[hit].tolist(), last.tolist()) for i in who[a:z].tolist()}
                found |= {(d, i) for d, i in candidates if contains_run(held[d], tokens[i], need)}
            at = sorted(found)
            docs = b[doc_key].to_numpy()
            yield pd.DataFrame({doc_key: docs[[d for d, _ in at]], item_key: [keys[i] for _, i in at]})

    return texts.mapInPandas(search, schema).distinct()
