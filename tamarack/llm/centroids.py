"""Centroid clustering by kd-tree filtering: Lloyd's rounds in exact integers.

Vectors become integers. Each partition's vectors go, CHUNK at a time, into kd-trees whose nodes hold the
count, the integer sum and the bounding box of what is below them; the trees are written once, as
rows, and every round reads them. A round passes the centroids down each tree. At a node the
centroid nearest to the middle of the box is held against the others, and one that is farther
from every point of the box, which its corner in the other's direction shows, is pruned. Only
strictly farther ones go, so no tie is lost. Where one centroid is left the whole node is its own, by count and sum;
at leaves that keep several, distances to those decide exactly. What comes to the driver is one count
and one sum a component for each centroid, whatever the input.

The tree of n vectors is complete: level l cuts its order at i * n / 2**l, so that copies, however many, split evenly.

Defined results: only vectors with exactly `dims` components, none null, NaN or infinite, are kept,
and none with a component beyond WIDEST after scaling, as a long couldn't hold its distances. Ties
go to the smaller number. Repeated rows count each and give a row each; of rows with the same starting hash the smaller vector starts
first. A null vec_id is clustered, but starts no centroid. Fewer kept vectors than centroids give fewer centroids; none to start with,
as in an empty table, gives an empty result. A total that a long can't hold is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm._shared import cut

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Largest integer component: 64 squares of twice that sum to less than 2 ** 63.
WIDEST = 1 << 27
#: Vectors of one tree, and of a leaf at most.
CHUNK, LEAF = 4096, 16
#: Integers up to which products of two components, summed over 64, are exact as doubles.
_EXACT = 1 << 22


def kept(vectors: DataFrame, *, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integer components, of the vectors that count."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) <= WIDEST), F.lit(False)))
    rows = vectors.where((F.size("embedding") == dims) & fine)
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v).cast("int")).alias("x"))


def start(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The first k vectors by the SHA-256 of seed:vec_id."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.where("vec_id IS NOT NULL").select(place.alias("place"), "x").orderBy("place", "x").limit(k)
    return [list(r["x"]) for r in first.collect()]


def _levels(n: int) -> int:
    levels = 0
    while n > LEAF << levels:
        levels += 1
    return levels


def _edges(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


class Tree:
    """Vectors in the order of a kd-tree's leaves; of each level's nodes boxes and sums."""

    def __init__(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.x, self.lo, self.hi, self.sums = x, lo, hi, sums
        self.levels = _levels(len(x))

    @staticmethod
    def built(x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order in which it holds the rows of x (int32)."""
        n, levels = len(x), _levels(len(x))
        order = np.arange(n)
        for level in range(levels):
            edges, cuts = _edges(n, level), _edges(n, level + 1)[1::2]
            for a, m, b in zip(edges[:-1].tolist(), cuts.tolist(), edges[1:].tolist(), strict=True):
                own = order[a:b]
                held = x[own]
                widest = int(np.argmax(held.max(axis=0).astype(np.int64) - held.min(axis=0)))
                order[a:b] = own[np.argpartition(held[:, widest], m - a)]
        x = x[order]
        parts: tuple[list, list, list] = ([], [], [])
        for level in range(levels + 1):
            at = _edges(n, level)[:-1]
            for part, of in zip(parts, (np.minimum, np.maximum, np.add), strict=True):
                part.append(of.reduceat(x.astype(np.int64) if of is np.add else x, at, axis=0))
        return Tree(x, *(np.concatenate(p) for p in parts)), order

    def filtered(self, centroids: np.ndarray):
        """(nodes that go whole to one centroid, their centroids), (rows at mixed leaves, their centroids).

        centroids: [k, dims] int64. A node is (first row, row after the last, place among all nodes).
        """
        n, k = len(self.x), len(centroids)
        exact = max(int(np.abs(centroids).max()), -int(self.lo[0].min()), int(self.hi[0].max())) < _EXACT
        kind = np.float64 if exact else np.int64
        c = centroids.astype(kind)
        norms = (c * c).sum(axis=1)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        whole, single = [], []
        for level in range(self.levels + 1):
            at = nodes + (1 << level) - 1
            lo, hi = self.lo[at].astype(kind), self.hi[at].astype(kind)
            near = np.where(open_, norms - (lo + hi) @ c.T, np.inf if exact else np.iinfo(np.int64).max).argmin(axis=1)
            for z in np.unique(near):
                own = np.flatnonzero(near == z)
                toward = c - c[z]
                reach = hi[own] @ np.maximum(toward, 0).T + lo[own] @ np.minimum(toward, 0).T
                open_[own] &= norms - norms[z] - 2 * reach <= 0  # the others are farther from all of the box
            done = open_.sum(axis=1) == 1
            edges = _edges(n, level)
            whole.append(np.stack([edges[nodes[done]], edges[nodes[done] + 1], at[done]]))
            single.append(near[done])
            nodes, open_ = nodes[~done], open_[~done]
            if level < self.levels:
                nodes, open_ = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1), np.repeat(open_, 2, axis=0)
        sizes = edges[nodes + 1] - edges[nodes]
        rows = np.repeat(edges[nodes] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        far = norms - 2 * (self.x[rows].astype(kind) @ c.T)
        picked = np.where(np.repeat(open_, sizes, axis=0), far, np.inf if exact else np.iinfo(np.int64).max).argmin(axis=1)
        return (np.concatenate(whole, axis=1), np.concatenate(single)), (rows, picked)

    def totals(self, centroids: np.ndarray) -> np.ndarray:
        """[k, 1 + dims]: the count and the sums of what is nearest to each centroid."""
        (whole, single), (rows, picked) = self.filtered(centroids)
        out = np.zeros((len(centroids), 1 + centroids.shape[1]), np.int64)
        np.add.at(out[:, 0], single, whole[1] - whole[0])
        np.add.at(out[:, 1:], single, self.sums[whole[2]])
        out[:, 0] += np.bincount(picked, minlength=len(centroids))
        order = np.argsort(picked, kind="stable")
        if len(order):
            first = np.flatnonzero(np.diff(picked[order], prepend=-1))
            out[picked[order[first]], 1:] += np.add.reduceat(self.x[rows[order]].astype(np.int64), first, axis=0)
        return out

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's centroid and its squared distance."""
        (whole, single), (rows, picked) = self.filtered(centroids)
        found = np.empty(len(self.x), np.int64)
        for a, b, z in zip(whole[0].tolist(), whole[1].tolist(), single.tolist(), strict=True):
            found[a:b] = z
        found[rows] = picked
        apart = self.x - centroids[found]
        return found, (apart * apart).sum(axis=1)


def _schema(points: DataFrame) -> str:
    return points.schema["vec_id"].dataType.simpleString()


def trees(points: DataFrame) -> DataFrame:
    """A row for each kd-tree: its vec_ids, and as bytes its vectors, boxes and sums."""
    kinds = ("x", "lo", "hi", "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                x = piece.column(1).flatten().to_numpy(zero_copy_only=False)
                tree, order = Tree.built(x.reshape(piece.num_rows, -1))
                ids = piece.column(0).take(pa.array(order))
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                arrays += [pa.array([np.ascontiguousarray(getattr(tree, k)).tobytes()], pa.binary()) for k in kinds]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", *kinds])

    return points.select("vec_id", "x").mapInArrow(run, f"ids array<{_schema(points)}>, x binary, lo binary, hi binary, sums binary")


def _trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        x, lo, hi = (np.frombuffer(batch.column(k)[i].as_buffer(), np.int32).reshape(-1, dims) for k in ("x", "lo", "hi"))
        yield batch.column("ids")[i].values, Tree(x, lo, hi, np.frombuffer(batch.column("sums")[i].as_buffer(), np.int64).reshape(-1, dims))


def moved(grown: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the centroids after every vector of the trees went to its nearest one."""
    held = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(held), 1 + held.shape[1]), np.int64)
        for batch in batches:
            for _, tree in _trees_of(batch, held.shape[1]):
                total += tree.totals(held)
        cluster, part = (a.astype(np.int32) for a in np.nonzero(total))
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(part), pa.array(total[cluster, part])], ["cluster", "part", "total"])

    partial = grown.mapInArrow(run, "cluster int, part int, total long")
    summed = partial.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(r["cluster"], r["part"]): int(r["total"]) for r in summed}
    out = []
    for z, old in enumerate(centroids):
        n = totals.get((z, 0), 0)
        out.append([totals.get((z, 1 + i), 0) // n for i in range(len(old))] if n else old)
    return out


def assigned(grown: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector of the trees."""
    held = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees_of(batch, held.shape[1]):
                found, apart = tree.nearest(held)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array(apart)], ["vec_id", "cluster", "distance"])

    kind = grown.schema["ids"].dataType.elementType.simpleString()
    return grown.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    vectors: vec_id, embedding. The centroids move `rounds` times; then the vectors are assigned once more.
    """
    spark = vectors.sparkSession
    points = kept(vectors, dims=dims, scale=scale)
    centroids = start(points, k, seed)
    grown = cut(trees(points), "trees")
    for _ in range(rounds if centroids else 0):
        centroids = moved(grown, centroids)
    if not centroids:
        return points.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in _TOLD.items()])
    found = cut(assigned(grown, centroids), "assigned")
    rows = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    inertia = {r["cluster"]: int(r["d"]) for r in rows}
    whole = sum(inertia.values())
    told = [(z, _long(d), _long(whole), hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()) for z, d in sorted(inertia.items())]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", *_TOLD)


_TOLD = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None
