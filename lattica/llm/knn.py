"""Most similar vectors for every vector, by exact L2 distance.

Block matrix join: vectors are quantised to int8 with one scale each and placed in blocks around pivots. Tiles of int8
products give distances that are off by at most the two quantisation errors. A vector's own block bounds the distance of
its k-th neighbour; it then visits only the blocks that the triangle inequality can't rule out by that bound. Pairs
that the error bounds can't rule out are narrowed by a second int8 plane, which holds what the first one lost; the few that are
left are recomputed in float and merged per vector. Sums of int8 products are below 2**24, so float32 holds them exactly and the tile is
taken by the float matrix product, which NumPy runs 9 to 26 times faster than its integer ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import materialize

#: Most vectors of a block; a pivot with more has several blocks.
BLOCK_ROWS = 8192
#: Most visitors that a task holds against a block.
VISITORS = 16384
#: Vectors for each pivot, pivots at most, and vectors that pivots are drawn and fitted from. They decide the speed only.
PIVOT_ROWS = 800
MAX_PIVOTS = 4096
SAMPLE_ROWS = 20_000
#: Rows and columns of one tile, and pairs that are narrowed at once: these bound a task's memory.
TILE_ROWS = 4096
TILE_COLUMNS = 2048
NARROW_PAIRS = 100_000
#: Steps of the second plane in one of the first.
FINER = 254


def usable_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v, h1, h2): usable rows and a 128-bit hash of their vectors.

    Null keys and vectors, other lengths, null or non-finite values and zero vectors are left out. 0.0 and -0.0 hash alike.
    """
    v = F.col(vector)
    top, bottom = F.array_max(v), F.array_min(v)  # NaN counts as larger than infinity
    fine = (F.size(F.array_compact(v)) == dim) & (top < float("inf")) & (bottom > float("-inf")) & ((top != 0) | (bottom != 0))
    return rows.where(F.col(key).isNotNull() & (F.size(v) == dim)).where(fine).select(key, v.cast("array<float>").alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"))


def vector_groups(vectors: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Exact copies in one group: (vid, v, n, heads) and, of groups with several keys, (vid, key).

    A key with several vectors counts with that of the smallest hash. vid follows the order of the groups' first keys;
    heads are the first k + 1 keys of a group. Grouping moves keys and hashes; vectors are shuffled once.
    """
    vectors = materialize(vectors, "vectors")
    members = materialize(vectors.groupBy(key).agg(F.min_by("h2", "h1").alias("h2"), F.min("h1").alias("h1")), "members")
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(key))).where(F.col("_r") <= k + 1)
    heads = first.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(key)).alias("heads"))
    counts = members.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    light = heads.join(counts, ["h1", "h2"]).withColumn("_first", F.col("heads")[0])
    filled = vectors.select(F.col(key).alias("_first"), "h1", "h2", "v").join(light, ["_first", "h1", "h2"]).dropDuplicates(["_first"])
    groups = materialize(filled.orderBy("_first").select(F.monotonically_increasing_id().alias("vid"), "v", "n", "heads", "h1", "h2"), "groups")
    return groups, members.join(groups.where("n > 1").select("h1", "h2", "vid"), ["h1", "h2"]).select("vid", key)


def _pivots(groups: DataFrame, count: int, dim: int) -> np.ndarray:
    """Centres of a bounded sample: at most ``MAX_PIVOTS``, one for about ``PIVOT_ROWS`` vectors."""
    want = int(np.clip(count // PIVOT_ROWS, 1, MAX_PIVOTS))
    rows = groups.select("v", F.xxhash64("vid").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("v").collect()
    x = np.array([r["v"] for r in rows], np.float64).reshape(-1, dim)
    centres = x[:want]
    for _ in range(4):
        nearest = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


_CODED = "vid long, codes binary, fine binary, scale float, err double, fine_err double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two planes of int8 codes, scales, and what is lost after the first and after the second plane."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    scale = np.where(scale > 0, scale, np.float32(1e-38)).astype(np.float32)
    step = scale[:, None].astype(np.float64)
    codes = np.clip(np.rint(x / step), -127, 127).astype(np.int8)
    rest = x - codes * step
    fine = np.clip(np.rint(rest / (step / FINER)), -127, 127).astype(np.int8)
    size = lambda v: np.linalg.norm(v, axis=1) * (1 + 1e-9)
    return codes, fine, scale, size(rest), size(rest - fine * (step / FINER))


class _Block:
    """Quantised vectors: ids, int8 codes, scales, half squared norms and errors; ``near`` adds the second plane."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.ids = pdf["vid"].to_numpy(np.int64)
        n = len(self.ids)
        self.scale = pdf["scale"].to_numpy(np.float32)
        self.codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(n, dim).astype(np.float32)
        x = self.codes * self.scale[:, None]
        self.near = x + np.frombuffer(b"".join(pdf["fine"]), np.int8).reshape(n, dim).astype(np.float32) * (self.scale[:, None] / np.float32(FINER))
        self.half = (x.astype(np.float64) ** 2).sum(1) / 2
        self.norm = np.sqrt(2 * self.half)
        self.err, self.near_err = pdf["err"].to_numpy(np.float64), pdf["fine_err"].to_numpy(np.float64)


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Position of each element within its run of equal, sorted rows."""
    start = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, bool)
    at = np.flatnonzero(start)
    return np.arange(len(rows)) - np.repeat(at, np.diff(np.r_[at, len(rows)]))


def _narrow(q: _Block, c: _Block, r: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the true distances of pairs, from both planes."""
    low, high = np.empty(len(r)), np.empty(len(r))
    for a in range(0, len(r), NARROW_PAIRS):
        i, k = r[a : a + NARROW_PAIRS], j[a : a + NARROW_PAIRS]
        diff = q.near[i] - c.near[k]
        d = np.sqrt(np.einsum("ij,ij->i", diff, diff).astype(np.float64))
        # rounding of float32 values, differences and sums
        e = q.near_err[i] + c.near_err[k] + 4e-7 * (q.norm[i] + c.norm[k]) + 1e-5 * d
        low[a : a + NARROW_PAIRS], high[a : a + NARROW_PAIRS] = d - e, d + e
    return low, high


def tile_candidates(q: _Block, c: _Block, k: int, bound: np.ndarray) -> pd.DataFrame:
    """Pairs (vid, other, low, high, kth) of queries and a block that the error bounds can't rule out.

    low and high bound the true distance. ``bound`` is an upper bound of each query's k-th distance, infinite if not known; it
    shrinks to the k-th smallest upper bound seen, returned as kth, and a pair goes on only if its lower bound is not above it.
    """
    parts = []
    slack_c = c.norm.max(initial=0)
    where = pd.Series(np.arange(len(c.ids)), c.ids).reindex(q.ids).fillna(-1).to_numpy(np.int64)  # a query's own column
    for top in range(0, len(q.ids), TILE_ROWS):
        at_rows = np.arange(top, min(top + TILE_ROWS, len(q.ids)))
        best = bound[at_rows].astype(np.float64)
        half, err, scale = q.half[at_rows], q.err[at_rows], q.scale[at_rows]
        # rounding of float32 sums and of their scaling
        slack = 4e-6 * q.codes.shape[1] ** 0.5 * (q.norm[at_rows] + slack_c) ** 2
        rows, other, low, high = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        for left in range(0, len(c.ids), TILE_COLUMNS):
            columns = slice(left, min(left + TILE_COLUMNS, len(c.ids)))
            score = q.codes[at_rows] @ c.codes[columns].T  # whole numbers: sums of int8 products
            score *= c.scale[columns]
            score *= scale[:, None]
            score -= c.half[columns].astype(np.float32)
            own = np.flatnonzero((where[at_rows] >= left) & (where[at_rows] < columns.stop))
            score[own, where[at_rows][own] - left] = -np.inf
            most = c.err[columns].max()
            if not np.isfinite(best).all() and score.shape[1] > k:
                part = score[:, : max(512, 4 * k)]
                kth = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k].astype(np.float64)
                d2 = np.maximum(2 * half - 2 * kth, 0) + slack
                best = np.minimum(best, np.where(np.isfinite(kth), np.sqrt(d2) + err + most, np.inf))
            reach = best + err + most
            floor = np.where(np.isfinite(reach), half - (reach**2 + slack) / 2, -np.inf)
            floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
            r, j = np.divmod(np.flatnonzero(score >= floor[:, None]), score.shape[1])
            ok = np.isfinite(score[r, j])
            r, j = r[ok], j[ok] + left
            lo, hi = _narrow(q, c, at_rows[r], j)
            rows, other, low, high = np.r_[rows, r], np.r_[other, c.ids[j]], np.r_[low, lo], np.r_[high, hi]
            order = np.lexsort((high, rows))
            rows, other, low, high = rows[order], other[order], low[order], high[order]
            kth_at = np.flatnonzero(_ranks(rows) == k - 1)
            best[rows[kth_at]] = np.minimum(best[rows[kth_at]], high[kth_at])
            keep = low <= best[rows]
            rows, other, low, high = rows[keep], other[keep], low[keep], high[keep]
        parts.append(pd.DataFrame({"vid": q.ids[at_rows][rows], "other": other, "low": low, "high": high, "kth": best[rows]}))
    return pd.concat(parts) if parts else pd.DataFrame({"vid": [], "other": [], "low": [], "high": [], "kth": []})


def _float_distances(pairs: DataFrame, groups: DataFrame, dim: int) -> DataFrame:
    """(vid, other, d2): squared distances of candidate pairs, from the float vectors in double precision."""
    v = groups.select("vid", "v")
    both = pairs.join(v.withColumnRenamed("vid", "other").withColumnRenamed("v", "_b"), "other").join(v.withColumnRenamed("v", "_a"), "vid").select("vid", "other", "_a", "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(((x[0] - x[1]) ** 2).sum(1))], names=["vid", "other", "d2"])

    return both.mapInArrow(run, "vid long, other long, d2 double")


_FOUND = "vid long, other long, low double, high double, kth double"


def nearest_groups(groups: DataFrame, k: int, dim: int, block_rows: int = BLOCK_ROWS, visitors: int = VISITORS) -> DataFrame:
    """(vid, other, d2): the k nearest other groups of each group; ties by vid.

    Pivots are at most ``MAX_PIVOTS``; they, their radii and sizes are all that the driver holds and sends out.
    """
    spark = groups.sparkSession
    count = groups.count()
    if not count:
        return spark.createDataFrame([], "vid long, other long, d2 double")
    centres = _pivots(groups, count, dim)
    half = (centres**2).sum(1) / 2

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(np.float64)
            pivot = (x @ centres.T - half).argmax(1)
            codes, fine, scale, err, fine_err = quantise(x)
            away = np.linalg.norm(x - centres[pivot], axis=1)
            yield pd.DataFrame({"vid": b["vid"], "codes": [r.tobytes() for r in codes], "fine": [r.tobytes() for r in fine], "scale": scale, "err": err, "fine_err": fine_err, "pivot": pivot, "away": away})

    coded = materialize(groups.select("vid", "v").mapInPandas(place, f"{_CODED}, pivot int, away double"), "coded")
    about = {r["pivot"]: r for r in coded.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    size = np.array([about[i]["n"] if i in about else 0 for i in range(len(centres))])
    radius = np.array([about[i]["radius"] if i in about else 0.0 for i in range(len(centres))]) * (1 + 1e-9)
    parts = -(-size // block_rows)
    parts_map = F.create_map(*[x for i in range(len(centres)) for x in (F.lit(i), F.lit(int(max(1, parts[i]))))])
    placed = coded.withColumn("part", F.pmod(F.xxhash64("vid"), parts_map[F.col("pivot")]).cast("int")).drop("away")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, dim)
        return tile_candidates(block, block, k, np.full(len(block.ids), np.inf))

    first = materialize(placed.groupBy("pivot", "part").applyInPandas(own, _FOUND), "own")
    bounds = first.groupBy("vid").agg(F.min("kth").alias("kth"))
    asking = materialize(placed.join(bounds, "vid", "left"), "asking")
    gap = np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1), 0))

    def targets(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, pivot, part) of the blocks that each row has to visit, and the upper bounds of the rows' k-th distances."""
        block, kth = _Block(b, dim), b["kth"].fillna(np.inf).to_numpy(np.float64)
        x = block.near.astype(np.float64)
        lost = block.near_err + 1e-6 * (block.norm + 1e-30)  # the codes are this far from the vector
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0))
        slack = (lost + 1e-7 * (block.norm + np.abs(centres).max(initial=0) * dim**0.5))[:, None]
        if (size > k).any():  # any pivot with more than k vectors bounds the k-th distance
            kth = np.minimum(kth, (d + radius + slack)[:, size > k].min(1))
        mine = b["pivot"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            # vectors of another pivot lie beyond the plane between the two pivots
            beyond = (d**2 - d[np.arange(len(d)), mine][:, None] ** 2) / (2 * gap[mine])
        beyond = np.where(gap[mine] > 0, beyond - slack * (2 + 4 * (d + slack) / np.maximum(gap[mine], 1e-30)), -np.inf)
        low = np.maximum(d - radius - slack, beyond)
        r, p = np.nonzero((low <= kth[:, None]) & (size > 0))
        n = parts[p]
        r, p = np.repeat(r, n), np.repeat(p, n)
        part = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        other = (p != mine[r]) | (part != b["part"].to_numpy()[r])
        return r[other], p[other], part[other], kth

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, p, part, _ = targets(b)
            yield pd.DataFrame({"p": p, "part": part}).groupby(["p", "part"]).size().rename("n").reset_index().astype("int64")

    coming = {(r["p"], r["part"]): r["n"] for r in asking.mapInPandas(tally, "p long, part long, n long").groupBy("p", "part").agg(F.sum("n").alias("n")).collect()}
    rooms = {b: int(-(-n // visitors)) for b, n in coming.items()}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r, p, part, kth = targets(b)
            out = b[["vid", "codes", "fine", "scale", "err", "fine_err"]].iloc[r].reset_index(drop=True)
            room = out["vid"].to_numpy() * 2654435761 % 2**31 % np.array([rooms[x] for x in zip(p.tolist(), part.tolist())], np.int64) if len(r) else np.empty(0, np.int64)
            yield out.assign(kth=kth[r], p=p, part=part, room=room)

    if not rooms:
        found = first
    else:
        blocks = spark.createDataFrame([(int(p), int(i), n) for (p, i), n in rooms.items()], "pivot int, part int, rooms int")
        stored = placed.join(F.broadcast(blocks), ["pivot", "part"]).select("vid", "codes", "fine", "scale", "err", "fine_err", F.col("pivot").cast("long").alias("p"), F.col("part").cast("long").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms").cast("long") - 1)).alias("room"))
        visiting = asking.mapInPandas(visit, f"{_CODED}, kth double, p long, part long, room long")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame({"vid": [], "other": [], "low": [], "high": [], "kth": []}).astype({"vid": "int64", "other": "int64"})
            return tile_candidates(_Block(left, dim), _Block(right, dim), k, left["kth"].to_numpy(np.float64))

        met = visiting.groupBy("p", "part", "room").cogroup(stored.groupBy("p", "part", "room")).applyInPandas(meet, _FOUND)
        found = materialize(first.unionByName(met), "candidates")
        # what is left per vector is a few pairs for each block that it visited
        kth = found.withColumn("_r", F.row_number().over(Window.partitionBy("vid").orderBy("high"))).where(F.col("_r") == k).select("vid", F.col("high").alias("_kth"))
        found = found.join(kth, "vid", "left").where("_kth is null or low <= _kth")
    exact = _float_distances(found.select("vid", "other"), groups, dim)
    return exact.withColumn("_r", F.row_number().over(Window.partitionBy("vid").orderBy("d2", "other"))).where(F.col("_r") <= k).select("vid", "other", "d2")


def nearest_vectors(rows: DataFrame, key: str, vector: str, k: int, dim: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, neighbour, distance): the k nearest other usable keys of each usable key; ties by key.

    Copies of one vector are searched once: a key whose group has others takes those first, in key order, and what
    it still lacks from the nearest groups. Fewer than k others give fewer rows, an empty table none.
    """
    groups, members = vector_groups(usable_vectors(rows, key, vector, dim), key, k)
    near = nearest_groups(groups, k, dim, block_rows)
    heads = groups.select(F.col("vid").alias("other"), F.explode(F.slice("heads", 1, k)).alias("neighbour"))
    lacking = groups.where(F.col("n") <= k).select("vid", "n", F.col("heads").alias("_own"))
    w = Window.partitionBy("vid").orderBy("d2", "neighbour")
    outside = (
        near.join(lacking, "vid").join(heads, "other").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1 - F.col("n"))
        .select(F.explode("_own").alias(key), "neighbour", F.sqrt("d2").alias("distance"))
    )
    copies = members.join(groups.where("n > 1").select("vid", "heads"), "vid")
    rest = F.slice(F.filter("heads", lambda h: h != F.col(key)), 1, k)
    inside = copies.select(key, F.explode(rest).alias("neighbour"), F.lit(0.0).alias("distance"))
    return outside.unionByName(inside)
