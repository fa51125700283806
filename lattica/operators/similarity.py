"""Note vectors, vector search, semantic edges and embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import chunk_text, match_band, note_path
from lattica.operators.graph import _both_ways, top_pairs


class Embedder(Protocol):
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic offline embedder: words hashed to signed dimensions, scaled to length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def usable_chunks(vectors: DataFrame, dim: int, key: str = "path", vector: str = "embedding") -> DataFrame:
    """(key, note, v): distinct chunk vectors of the right length, finite and not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & (F.size(v) == dim)).where(fine).select(F.col(key).alias("key"), note_path(F.col(key)).alias("note"), v.alias("v")).distinct()


def note_vectors(chunks: DataFrame) -> DataFrame:
    """(note, pos, x): element-wise mean over a note's chunks, in long form so that it combines on the map side."""
    return chunks.select("note", F.posexplode(F.transform("v", lambda x: x.cast("double"))).alias("pos", "x")).groupBy("note", "pos").agg(F.avg("x").alias("x"))


def embed_status(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total_notes, embedded_notes, chunks, coverage_pct, ready."""
    total = nodes.agg(F.count(F.lit(1))).scalar()
    both = chunks.agg(F.countDistinct("note").alias("embedded_notes"), F.count(F.lit(1)).alias("chunks")).withColumn("total_notes", total)
    pct = F.when(F.col("total_notes") > 0, F.round(100.0 * F.col("embedded_notes") / F.col("total_notes"), 1)).otherwise(0.0)
    return both.select("total_notes", "embedded_notes", "chunks").withColumn("coverage_pct", pct).withColumn("ready", (F.col("embedded_notes") > 0) & (F.col("coverage_pct") >= 80))


def semantic_search(chunks: DataFrame, query: list[float], nodes: DataFrame, limit: int = 10, subfolder: str = "", prefilter: bool = False) -> DataFrame:
    """(path, title, distance, match): notes by the L2 distance of their nearest chunk.

    The nearest 3 x limit chunks are taken and then kept if their note starts with ``subfolder``, so a scoped search may give
    fewer than ``limit``; with ``prefilter`` the scope comes first.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.sqrt(F.aggregate(F.zip_with("v", q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    pool = chunks.where(F.col("note").startswith(subfolder)) if subfolder and prefilter else chunks
    near = pool.select("key", "note", d.alias("d")).orderBy("d", "key").limit(3 * limit)
    best = near.where(F.col("note").startswith(subfolder)).groupBy("note").agg(F.min("d").alias("d")).orderBy("d", "note").limit(limit)
    titled = best.join(nodes.select(F.col("path").alias("note"), "title"), "note", "left")
    return titled.select(F.col("note").alias("path"), F.coalesce("title", "note").alias("title"), F.round("d", 4).alias("distance"), match_band(F.col("d")).alias("match")).orderBy("distance", "path")


def semantic_pairs(chunks: DataFrame, min_similarity: float = 0.75, block_rows: int = 2048) -> DataFrame:
    """(a, b, similarity) of notes whose mean vectors have a cosine of at least ``min_similarity``.

    Blocks of vectors are multiplied as matrices, one pair of blocks a task; nothing wider than two blocks is held.
    """
    rows = note_vectors(chunks).groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda t: t["x"]).alias("v"))
    n = chunks.select("note").distinct().count()
    blocks = max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64("note"), F.lit(blocks)).cast("int")
    packed = rows.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("note", "v")).alias("rows"))  # about block_rows each
    left = packed.select(F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"), F.col("rows").alias("left_rows"))
    right = packed.select(F.col("block").alias("rj"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("ri"), F.col("rows").alias("right_rows"))

    def unit(rows) -> tuple[list[str], np.ndarray]:
        x = np.array([list(r["v"]) for r in rows])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return [r["note"] for r in rows], x / np.where(norm > 0, norm, 1)

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str), "similarity": pd.Series(dtype=float)})
        (na, xa), (nb, xb) = unit(a["left_rows"].iloc[0]), unit(b["right_rows"].iloc[0])
        s = xa @ xb.T
        r, c = np.nonzero(s >= min_similarity)
        pairs = [(min(na[i], nb[j]), max(na[i], nb[j]), s[i, j]) for i, j in zip(r, c) if na[i] != nb[j]]
        return pd.DataFrame(pairs, columns=["a", "b", "similarity"]).drop_duplicates(["a", "b"])

    return left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInPandas(multiply, "a string, b string, similarity double")


def semantic_edges(chunks: DataFrame, nodes: DataFrame, min_similarity: float = 0.75, top: int = 10, weight: float = 0.8) -> DataFrame:
    """(src, dst, type, weight) both ways between similar known notes; a pair stays if it is among the ``top`` of either end."""
    known = chunks.join(nodes.select(F.col("path").alias("note")), "note", "left_semi")
    pairs = semantic_pairs(known, min_similarity).select("a", "b", (F.col("similarity") * weight).alias("weight"))
    return _both_ways(top_pairs(pairs, top), "semantic_similarity")


def embed_notes(notes: DataFrame, done: DataFrame, embedder: Embedder, batch: int = 8, force: bool = False, size: int = 1600, overlap: int = 200) -> DataFrame:
    """(note_path, chunk_no, embedding) of notes without vectors in ``done(note_path)``, or of all with ``force``.

    The text is the body, else title and headings. A vector of another length fails the task.
    """
    todo = notes if force else notes.join(done.select(F.col("note_path").alias("path")).distinct(), "path", "left_anti")
    text = F.when(F.coalesce(F.trim("body"), F.lit("")) != "", F.col("body")).otherwise(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("headings", F.array().cast("array<string>")), "\n")))
    chunks = todo.select(F.col("path").alias("note_path"), F.posexplode(chunk_text(text, size, overlap)).alias("chunk_no", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[list[float]] = []
            texts = b["text"].tolist()
            for i in range(0, len(texts), batch):
                out += embedder.embed_batch(texts[i : i + batch])
            if any(len(v) != embedder.dimension for v in out):
                raise ValueError(f"the embedder gave vectors that don't have {embedder.dimension} values")
            yield pd.DataFrame({"note_path": b["note_path"], "chunk_no": b["chunk_no"], "embedding": out})

    return chunks.mapInPandas(run, "note_path string, chunk_no int, embedding array<float>")
