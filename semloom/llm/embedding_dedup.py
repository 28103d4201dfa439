"""Near-duplicate embeddings: coarse inverted lists, product-quantised residuals, asymmetric distances, exact cosine.

Vectors are scaled to length 1, so a cosine of at least t is a distance of at most r = sqrt(2 - 2 t). Coarse and subspace centroids
are fitted to all vectors by Lloyd's steps, each one pass with small sums. Every vector is a query: it probes each list whose border with
its own is at most r / 2 away, as one of any two vectors within r does, its distances to the list's members are looked up from tables over
their codes, and those that are at most r more than what the codes miss are compared exactly. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .components import report

THRESHOLD = 0.9
SUBSPACES, CODES = 8, 256
COARSE_STEPS, CODE_STEPS = 4, 4
#: Cosines of vectors in single precision this near the threshold are computed again, from the embeddings as given.
UNSURE = 1e-6
#: Members and queries that meet in one task; larger lists are split into blocks of each.
BLOCK = 8192


def distance(threshold: float) -> float:
    """How far apart two vectors of the threshold are at most, in single precision."""
    return sqrt(max(0.0, 2 - 2 * (threshold - UNSURE)))


def margins(x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How far vectors lie from the border between their own and other centroids (a row each); the same wherever it is computed."""
    x, own, other = (v.astype(np.float64) for v in (x, own, other))
    apart = own - other
    return ((x * apart).sum(1) + ((other**2).sum(1) - (own**2).sum(1)) / 2) / np.sqrt(np.maximum((apart**2).sum(1), 1e-300))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _parts(x: np.ndarray, coarse: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Residuals, cut into subspaces: (subspace, vector, dimension)."""
    return (x - coarse[lists]).reshape(len(x), SUBSPACES, -1).transpose(1, 0, 2)


def encode(x: np.ndarray, coarse: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, length of what the codes miss) of each vector."""
    lists = _nearest(x, coarse)
    r = _parts(x, coarse, lists)
    codes = np.stack([_nearest(r[m], books[m]) for m in range(SUBSPACES)], 1)
    missed = np.sqrt(sum(((r[m] - books[m][codes[:, m]]) ** 2).sum(1) for m in range(SUBSPACES)))
    return lists, codes.astype(np.uint8), missed


def _sums(dim: int, value):
    """Per task: sums and numbers of vectors by (subspace, centroid); value(x) gives (subspace, centroids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for m, to, v in value(matrix(batch.column(0), dim)):
                n = int(to.max()) + 1
                many = np.bincount(to, minlength=n)
                sums = np.stack([np.bincount(to, v[:, k], n) for k in range(v.shape[1])] + [many], 1)
                for c in np.flatnonzero(many):
                    total[m, int(c)] = total.get((m, int(c)), 0) + sums[c]
        keys = sorted(total)
        yield pa.record_batch(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))],
            names=["m", "c", "sums"],
        )

    return run


def _lloyd(vectors: DataFrame, dim: int, centers: np.ndarray, value) -> np.ndarray:
    """One step: (subspace, centroid, dimension) centroids from all vectors; one without vectors stays."""
    width = centers.shape[2] + 1
    parts = vectors.select("x").mapInArrow(_sums(dim, value), "m int, c int, sums array<double>")
    got = parts.groupBy("m", "c").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]).toArrow()
    centers = centers.copy()
    if got.num_rows:
        sums = np.stack([got[f"s{k}"].to_numpy() for k in range(width)], 1)
        centers[got["m"].to_numpy(), got["c"].to_numpy()] = sums[:, :-1] / sums[:, -1:]
    return centers


def fit(vectors: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(coarse centroids, code books) for ``vectors`` (id, x): Lloyd's steps over all, from those of least hash."""
    k = max(1, ceil(sqrt(n)))
    first = vectors.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(max(k, CODES)).toArrow()
    start = matrix(first["x"], dim)
    coarse = start[:k]
    for _ in range(COARSE_STEPS):
        coarse = _lloyd(vectors, dim, coarse[None], lambda x, c=coarse: [(0, _nearest(x, c), x)])[0]
    coarse = coarse.astype(np.float32)
    books = _parts(start, coarse, _nearest(start, coarse))[:, :CODES].astype(np.float32)

    def assign(x, books):
        r = _parts(x, coarse, _nearest(x, coarse))
        return [(m, _nearest(r[m], books[m]), r[m]) for m in range(SUBSPACES)]

    for _ in range(CODE_STEPS):
        books = _lloyd(vectors, dim, books, lambda x, b=books: assign(x, b)).astype(np.float32)
    return coarse, books


def probes(x: np.ndarray, lists: np.ndarray, coarse: np.ndarray, radius: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) for all lists that the vector probes: those whose border with its own is at most ``r`` / 2 away, and that have a
    vector at most ``radius`` from their centroid, hence maybe one at most ``r`` from this. Of vectors on both sides of a border the
    distances from it add up to at most their own, so one of two within ``r`` probes the other's list."""
    who, what = [], []
    exact = coarse.astype(np.float64)
    for i in range(0, len(x), 1024):
        d = squared(x[i : i + 1024], coarse)
        own = lists[i : i + 1024]
        each, which = np.unique(own, return_inverse=True)
        apart = np.sqrt(squared(exact[each], exact))[which]
        hit = d - d[np.arange(len(own)), own][:, None] <= r * apart + 1e-5
        hit &= np.sqrt(d) <= radius + r + 1e-3
        hit[np.arange(len(own)), own] = True
        a, b = np.nonzero(hit)
        who.append(a + i)
        what.append(b)
    return np.concatenate(who), np.concatenate(what)


def _indexed(dim: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = sent.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), dim)
                lists, codes, missed = encode(x, coarse, books)
                radius = np.sqrt(((x - coarse[lists]) ** 2).sum(1))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed.astype(np.float64)), pa.array(radius.astype(np.float64))], names=["id", "x", "list", "codes", "missed", "radius"])

    return run


def _probing(dim: int, r: float, sent, radii):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, _ = sent.value
        for batch in batches:
            if batch.num_rows:
                who, what = probes(matrix(batch.column("x"), dim), batch.column("list").to_numpy(), coarse, radii.value, r)
                for i in range(0, len(who), 1 << 14):
                    got = batch.select(["id", "x", "list"]).take(pa.array(who[i : i + (1 << 14)]))
                    yield pa.record_batch([got.column(0), got.column(1), got.column(2), pa.array(what[i : i + (1 << 14)].astype(np.int32))], names=["id", "x", "own", "list"])

    return run


class Classes:
    """Components of numbers below ``n``."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _root(self, a: int) -> int:
        while (b := int(self.parent[a])) != a:
            a = b
        return a

    def unite(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Connects pairs; gives those of them that connected what wasn't."""
        out = []
        while True:
            apart = self.parent[a] != self.parent[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return out
            for s, t in zip(a[:1024].tolist(), b[:1024].tolist()):
                u, v = self._root(s), self._root(t)
                if u != v:
                    self.parent[max(u, v)] = min(u, v)
                    out.append((s, t))
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, missed: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_own: np.ndarray, own: int, coarse: np.ndarray, books: np.ndarray, threshold: float) -> tuple[list[tuple[int, int]], dict[int, int], list[tuple[int, int]]]:
    """Of the members of list ``own`` and queries of the lists ``q_own``: (pairs of at least the threshold that connect all such pairs; in how
    many such pairs each is; pairs too near the threshold to tell).

    A pair counts where the query is the nearer one to the border of their lists, within a list where it has the lower id: once altogether."""
    limit = (missed + distance(threshold)) ** 2 + 1e-5
    every, number = np.unique(np.r_[ids, q_ids], return_inverse=True)
    member, query = number[: len(ids)], number[len(ids) :]
    classes, degree = Classes(len(every)), np.zeros(len(every), np.int64)
    edges, unsure = [], []
    for i in range(0, len(q), 256):
        part = (q[i : i + 256] - coarse[own]).reshape(-1, SUBSPACES, books.shape[2])
        tables = [squared(part[:, m], books[m]) for m in range(SUBSPACES)]
        looked_up = tables[0][:, codes[:, 0]]
        for m in range(1, SUBSPACES):
            looked_up += tables[m][:, codes[:, m]]
        a, b = np.nonzero(looked_up <= limit)
        for j in range(0, len(a), 1 << 15):  # exact, a bounded number at a time
            aa, bb = i + a[j : j + (1 << 15)], b[j : j + (1 << 15)]
            cosine = np.einsum("ij,ij->i", q[aa].astype(np.float64), x[bb].astype(np.float64))
            near = np.flatnonzero(cosine >= threshold - UNSURE)
            aa, bb, cosine = aa[near], bb[near], cosine[near]
            home = np.broadcast_to(coarse[own], q[aa].shape)
            mine, its = margins(q[aa], coarse[q_own[aa]], home), margins(x[bb], home, coarse[q_own[aa]])
            counts = np.where(q_own[aa] == own, q_ids[aa] < ids[bb], (mine < its) | ((mine == its) & (q_own[aa] < own)))
            aa, bb, sure = query[aa[counts]], member[bb[counts]], cosine[counts] >= threshold + UNSURE
            unsure += zip(every[aa[~sure]].tolist(), every[bb[~sure]].tolist())
            aa, bb = aa[sure], bb[sure]
            if len(aa):
                degree += np.bincount(np.r_[aa, bb], minlength=len(every))
                edges += [(int(every[s]), int(every[t])) for s, t in classes.unite(aa, bb)]
    linked = np.flatnonzero(degree)
    return edges, dict(zip(every[linked].tolist(), degree[linked].tolist())), unsure


EDGE, DEGREE, OPEN = 0, 1, 2  # kinds of what a search finds: (one, other), (one, its number of links), (one, other) to be told from the embeddings


def _searched(dim: int, threshold: float, sent):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        coarse, books = sent.value
        found: tuple = [], {}, []
        if members.num_rows and queries.num_rows:
            codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(-1, SUBSPACES)
            found = search_block(
                members["id"].to_numpy(), matrix(members["x"], dim), codes, members["missed"].to_numpy(), queries["id"].to_numpy(), matrix(queries["x"], dim),
                queries["own"].to_numpy(), members["list"][0].as_py(), coarse, books, threshold,
            )
        rows = [(kind, *p) for kind, pairs in ((EDGE, found[0]), (DEGREE, found[1].items()), (OPEN, found[2])) for p in pairs]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())))})

    return run


def near_duplicate_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, class_id, n_links) of each vector of ``rows`` (vec_id, embedding) linked to another by a cosine of at least ``threshold``.

    A class is a connected component, class_id its smallest vec_id; n_links is the number of different vectors that it is linked to, each
    once however many ids have it, and of other ids that have an equal one. Every vector is a query, no list, probe or candidate is capped,
    and no link is left out. Vectors of length 1 that are equal in single precision are equal.

    A null vec_id, a null or empty embedding, one with a null, NaN or infinite element, of length 0, or of another dimension than most (of
    equally frequent ones the largest) is in no class. Repeated rows and equal vectors are linked; a vec_id alone is no class however
    often it comes. An empty table gives no rows. Columns but vec_id and embedding are not looked at.
    """
    spark = storage.bounded(rows).sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    known = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & finite)
    most = known.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    empty = spark.createDataFrame([], "a bigint, b bigint")
    if not most:
        return report(empty.toDF("vec_id", "node"), empty, "vec_id")
    dim = most[0]["dim"]
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    # dimensions that the subspaces don't divide get zeros at the end
    wide = -(-dim // SUBSPACES) * SUBSPACES
    unit = F.transform(F.concat("embedding", F.array_repeat(F.lit(0.0), wide - dim)), lambda v: (v / F.col("norm")).cast("float"))
    units = known.where(F.size("embedding") == dim).withColumn("norm", norm).where("norm > 0 AND norm < double('Infinity')").select("vec_id", unit.alias("x"), "embedding")
    nodes = units.groupBy("x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    nodes = storage.cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    n = nodes.count()
    if n < 2:
        links, degree = empty, empty.toDF("node", "degree")
    else:
        found = _found(nodes.select("id", "x"), n, wide, threshold)
        links, degree = _links(found, nodes, units, threshold)
    single = nodes.where("n = 1").join(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    several = units.drop("embedding").join(storage.small(nodes.where("n > 1").select("x", "id")), "x")
    return report(single.select("vec_id", F.col("id").alias("node")).union(several.select("vec_id", F.col("id").alias("node"))), links, "vec_id", degree)


def _links(found: DataFrame, nodes: DataFrame, units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((a, b): linked vectors, as many pairs as connect them; (node, degree): the number of vectors that each is linked to)."""
    links, degree = found.where(F.col("kind") == EDGE).select("a", "b"), found.where(F.col("kind") == DEGREE).select(F.col("a").alias("node"), F.col("b").alias("degree"))
    near = found.where(F.col("kind") == OPEN).select("a", "b")
    if not near.isEmpty():
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        given = storage.cut(nodes.join(ids, "id").select("id", "x").join(units, "x").groupBy("id").agg(F.min("embedding").alias("e")))
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        both = near.join(given.toDF("a", "u"), "a").join(given.toDF("b", "v"), "b")
        more = storage.cut(both.where(dot("u", "v") / (F.sqrt(dot("u", "u")) * F.sqrt(dot("v", "v"))) >= threshold).select("a", "b"))
        links = links.union(more)
        degree = degree.union(more.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("bigint").alias("degree")))
    return links, degree.groupBy("node").agg(F.sum("degree").alias("degree"))


def _found(vectors: DataFrame, n: int, wide: int, threshold: float) -> DataFrame:
    """(kind, a, b): what ``search_block`` finds of different vectors."""
    sc = vectors.sparkSession.sparkContext
    sent = sc.broadcast(fit(vectors, n, wide))  # centroids: the square root of the number of vectors
    members = storage.cut(vectors.mapInArrow(_indexed(wide, sent), "id bigint, x array<float>, list int, codes binary, missed double, radius double"))
    radius = np.zeros(len(sent.value[0]))
    for r in members.groupBy("list").agg(F.max("radius").alias("radius")).collect():
        radius[r["list"]] = r["radius"]
    probing = _probing(wide, distance(threshold), sent, sc.broadcast(radius))
    asking = storage.cut(members.select("id", "x", "list").mapInArrow(probing, "id bigint, x array<float>, own int, list int"))
    members = members.drop("radius")
    sizes = members.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks")).join(asking.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")), "list")
    blocks = storage.small(storage.cut(sizes))
    side = lambda df, own, other: df.join(blocks, "list").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).drop("m_blocks", "q_blocks")
    keys = ["list", "m", "q"]
    pairs = side(members, "m", "q").groupBy(*keys).cogroup(side(asking, "q", "m").groupBy(*keys)).applyInArrow(_searched(wide, threshold, sent), "kind int, a bigint, b bigint")
    return storage.cut(pairs)
