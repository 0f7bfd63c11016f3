"""Vectors: normalisation, mean, exact nearest neighbours, and clustering of a case's template vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a case in a block; one task compares two blocks, some rows at a time.
BLOCK, TILE = 8192, 512
#: Cosine distance at which average linkage is cut.
THRESHOLD = 0.3
#: What a matrix product of unit vectors may be off by, with room to spare.
_SLACK = 1e-12


def l2_normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Unit vectors; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("_n", norm).withColumn(column, F.transform(column, lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(F.lit(0.0)))).drop("_n")


def mean_vector(df: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: the mean of the vectors, position by position."""
    long = df.select(F.posexplode(column).alias("pos", "x"))
    return long.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(column))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors nearest to the query by Euclidean distance, exactly; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    squares = F.aggregate(F.zip_with(column, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("distance", F.sqrt(squares)).orderBy("distance", id_col).limit(k)


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows i of x and j of y, always summed in the same way."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(axis=1))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    up = np.arange(n)
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(up, high[open_], low[open_])
        while (up[up] != up).any():
            up = up[up]
        a, b = a[open_], b[open_]
    return up


def _lightest(part: np.ndarray, other: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of edges between components: the numbers of those that are some component's edge of least rank."""
    both, again = np.concatenate([part, other]), np.tile(np.arange(len(part)), 2)
    order = np.lexsort((rank[again], both))
    first = np.concatenate([[True], both[order][1:] != both[order][:-1]])
    return np.unique(again[order[first]])


def spanning(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of the edges (a < b) of a minimum spanning forest; edges are ordered by (d, a, b), so it is unique."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    rank = np.empty(len(d), dtype=np.int64)
    rank[np.lexsort((b, a, d))] = np.arange(len(d))
    taken, left, part = [np.empty(0, dtype=np.int64)], np.arange(len(d)), np.arange(len(names))
    while len(left := left[part[i[left]] != part[j[left]]]):
        some = left[_lightest(part[i[left]], part[j[left]], rank[left])]
        taken.append(some)
        part = _roots(len(names), part[i[some]], part[j[some]])[part]
    return np.sort(np.concatenate(taken))


def _first_copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of the first copy of each row, and the rows that are first copies."""
    rows = np.ascontiguousarray(x + 0.0)
    _, first, which = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    copy_of = first[which.ravel()]
    return copy_of, np.flatnonzero(copy_of == np.arange(len(x)))


def _nearest_others(x: np.ndarray, y: np.ndarray, part_x: np.ndarray, part_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, i, j): pairs of rows of two components, among them each row's nearest with all ties, on either side.

    A matrix product finds what may be nearest; of those the distances are taken row by row.
    """
    half_x, half_y = (x * x).sum(axis=1) / 2, (y * y).sum(axis=1) / 2
    slack = _SLACK * max(half_x.max(), half_y.max(), 1e-300)
    best, out = np.full(len(y), np.inf), []
    for at in range(0, len(x), TILE):
        rows = slice(at, at + TILE)
        h = half_y - x[rows] @ y.T
        h += half_x[rows, None]
        h[part_x[rows, None] == part_y] = np.inf
        best = np.minimum(best, h.min(axis=0))
        i, j = np.nonzero(((h <= h.min(axis=1)[:, None] + slack) | (h <= best + slack)) & (h < np.inf))
        i += at
        d = _distances(x, y, i, j)
        # Copies of a nearest row may be many: each row keeps its first ones in the order of distances and rows.
        order = np.lexsort((j, i, d))
        keep = order[np.unique(np.concatenate([np.unique(side[order], return_index=True)[1] for side in (i, j)]))]
        out.append((d[keep], i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def forest(x: np.ndarray, y: np.ndarray | None = None, at_x: np.ndarray | None = None, at_y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (d, a, b), a < b, of the minimum spanning tree of x, or of the pairs of a row of x and one of y.

    at_x, at_y: the rows' names, ascending and those of x before those of y. Of equal rows of a side only the first takes part; in the tree of x its copies hang on it.
    """
    at_x = np.arange(len(x)) if at_x is None else at_x
    copy_of, first = _first_copies(x)
    alone = y is None
    later = np.flatnonzero(copy_of != np.arange(len(x))) if alone else first[:0]
    edges = [(np.zeros(len(later)), at_x[copy_of[later]], at_x[later])]
    x, at_x = x[first], at_x[first]
    if alone:
        y, at_y, base = x, at_x, 0
    else:
        first = _first_copies(y)[1]
        y, at_y, base = y[first], at_y[first], len(x)
    part = np.arange(base + len(y))
    while len(np.unique(part)) > 1:
        d, i, j = _nearest_others(x, y, part[: len(x)], part[base:])
        a, b = np.minimum(at_x[i], at_y[j]), np.maximum(at_x[i], at_y[j])
        rank = np.empty(len(d), dtype=np.int64)
        rank[np.lexsort((b, a, d))] = np.arange(len(d))
        some = _lightest(part[i], part[base + j], rank)
        edges.append((d[some], a[some], b[some]))
        part = _roots(len(part), part[i[some]], part[base + j[some]])[part]
    d, a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
    # In a tree of x a pair may have been seen from both of its rows.
    _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
    return d[once], a[once], b[once]


def hdbscan(x: np.ndarray, min_cluster_size: int = 2) -> np.ndarray:
    """Density clusters with core distance zero: minimum spanning tree, condensed tree, excess of mass; -1 is noise."""
    n = len(x)
    if n < min_cluster_size:
        return np.full(n, -1)
    return condensed(n, *forest(x), min_cluster_size)


def condensed(n: int, d: np.ndarray, a: np.ndarray, b: np.ndarray, min_cluster_size: int = 2) -> np.ndarray:
    """The density clusters of n points with these edges of their minimum spanning tree."""
    if n < min_cluster_size:
        return np.full(n, -1)
    order = np.lexsort((b, a, d))
    edges = zip(d[order].tolist(), a[order].tolist(), b[order].tolist(), strict=True)
    up, size, kids, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}, {}

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for m, (d, a, b) in enumerate(edges):
        a, b, node = find(a), find(b), n + m
        kids[node], height[node], size[node] = (a, b), d, size[a] + size[b]
        up[a] = up[b] = node
    lam = lambda node: 1 / max(height[node], 1e-12)

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            todo.extend(kids[v]) if v in kids else out.append(v)
        return out

    clusters, members, stability, children = [0], {0: []}, {0: 0.0}, {0: []}
    births, todo = {0: 0.0}, [(2 * n - 2, 0)] if n > 1 else []
    while todo:
        node, c = todo.pop()
        if node not in kids:
            continue
        at_l = lam(node)
        big = [k for k in kids[node] if size[k] >= min_cluster_size]
        for k in kids[node]:
            if size[k] < min_cluster_size:
                own = leaves(k)
                members[c] += own
                stability[c] += len(own) * (at_l - births[c])
        if len(big) == 2:
            for k in big:
                stability[c] += size[k] * (at_l - births[c])
                new = len(clusters)
                clusters.append(new)
                members[new], stability[new], births[new], children[new] = [], 0.0, at_l, []
                children[c].append(new)
                todo.append((k, new))
        elif big:
            todo.append((big[0], c))
    chosen, value = set(), {}
    for c in reversed(clusters):
        below = sum(value[k] for k in children[c])
        if c and (not children[c] or stability[c] >= below):
            value[c] = stability[c]
            chosen.add(c)
        else:
            value[c] = below
    labels = np.full(n, -1)
    pending = [(0, -1)]
    while pending:
        c, label = pending.pop()
        if label < 0 and c in chosen:
            label = c
        labels[members[c]] = label
        pending += [(k, label) for k in children[c]]
    return labels


def agglomerative(x: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Average linkage on cosine distance, cut at a threshold, by chains of nearest neighbours: quadratic in time, linear in memory.

    The mean cosine of two groups is the product of their sums of unit vectors over that of their sizes. Labels are first members.
    """
    n = len(x)
    sums, size, name, merges = _unit(x), np.ones(n), np.arange(n), []
    live, count = np.ones(n, dtype=bool), n
    chain: list[int] = []
    while count > 1:
        if count < len(sums) // 2:
            kept = np.flatnonzero(live)
            place = np.cumsum(live) - 1
            sums, size, name, live, chain = sums[kept], size[kept], name[kept], live[kept], place[chain].tolist()
        if not chain:
            chain.append(int(live.argmax()))
        while True:
            top = chain[-1]
            row = np.where(live, 1 - (sums @ sums[top]) / (size * size[top]), np.inf)
            row[top] = np.inf
            near = int(row.argmin())
            # A tie with the one before ends the chain, so that it cannot run in a circle; rounding of the product must not tell ties apart.
            if len(chain) > 1 and row[chain[-2]] <= row[near] + _SLACK:
                break
            chain.append(near)
        b, a = chain.pop(), chain.pop()
        merges.append((row[a], *sorted((int(name[a]), int(name[b])))))
        a, b = min(a, b), max(a, b)
        sums[a] += sums[b]
        size[a] += size[b]
        live[b] = False
        count -= 1
    return _roots(n, *(np.array([m[k] for m in merges if m[0] <= threshold], dtype=np.int64) for k in (1, 2)))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _tree(rows: DataFrame, by: str) -> DataFrame:
    """(case, d, a, b): the minimum spanning tree of each case's unit vectors. rows: (case, pos, n, vector), pos from 0 to n - 1.

    A task compares two blocks of a case and keeps their pairs' spanning forest; the tree of all lies in the union of the forests.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))
    own = F.floor(F.col("pos") / BLOCK).cast("int")
    sent = rows.select(by, "pos", "vector", own.alias("own"), F.explode(blocks).alias("other")).select(by, "pos", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        x, pos, low = _unit(np.array(frame["vector"].tolist(), dtype=np.float64)), frame["pos"].to_numpy(), (frame["own"] == frame["i"]).to_numpy()
        d, a, b = forest(x, None, pos) if low.all() else forest(x[low], x[~low], pos[low], pos[~low])
        return pd.DataFrame({by: frame[by].iloc[0], "i": frame["i"].iloc[0] // 8, "j": frame["j"].iloc[0] // 8, "d": d, "a": a, "b": b})

    def lightest(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[spanning(*(frame[c].to_numpy() for c in "dab"))]

    kind = f"{by} string, i int, j int, d double, a int, b int"
    found = sent.groupBy(by, "i", "j").applyInPandas(edges, kind)
    # Forests of neighbouring blocks first, so that no task gets those of all.
    return found.groupBy(by, "i", "j").applyInPandas(lightest, kind).groupBy(by).applyInPandas(lightest, kind).select(by, "d", "a", "b")


def cluster(vectors: DataFrame, method: str = "hdbscan", id_col: str = "vec_id", column: str = "embedding", by: str = "case_id") -> DataFrame:
    """(case, id, cluster_id) of a case's vectors; noise is a cluster of its own, and ids follow first appearance.

    The vectors of a case (its distinct templates, not its events) are compared block by block, in many tasks, whatever their number. What one task
    holds of a case grows with its number of vectors, not with its square: a few numbers for each, and for average linkage the
    vectors of a component, within which all of its clusters lie.
    """
    order = Window.partitionBy(by)
    rows = vectors.select(F.col(by).cast("string").alias(by), F.col(id_col).cast("long").alias(id_col), F.col(column).alias("vector"))
    rows = rows.withColumn("pos", F.row_number().over(order.orderBy(id_col, "vector")) - 1).withColumn("n", F.count(F.lit(1)).over(order))
    edges = _tree(rows, by).withColumn("id", F.lit(None).cast("long"))
    nodes = rows.select(by, F.lit(None).cast("double").alias("d"), F.col("pos").alias("a"), F.lit(-1).alias("b"), F.col(id_col).alias("id"))

    def run(named: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def each(frame: pd.DataFrame) -> pd.DataFrame:
            node = (frame["b"] < 0).to_numpy()
            points, tree = frame[node].sort_values("a"), frame[~node]
            labels = named(len(points), *(tree[c].to_numpy() for c in "dab"))
            return pd.DataFrame({by: points[by].to_numpy(), id_col: points["id"].to_numpy(), "pos": points["a"].to_numpy(), "cluster_id": labels})

        return each

    kind = f"{by} string, {id_col} long, pos int, cluster_id long"
    whole = nodes.unionByName(edges).groupBy(by)
    if method == "hdbscan":
        return whole.applyInPandas(run(lambda *tree: _by_appearance(condensed(*tree))), kind).drop("pos")
    # Two groups whose mean distance is within the threshold have a pair within it, so no group reaches over two components of such pairs.
    # For unit vectors the cosine distance is half the square of the Euclidean one; a little slack joins components, which costs no result.
    found = whole.applyInPandas(run(lambda n, d, a, b: _roots(n, a[d * d / 2 <= THRESHOLD + 1e-9], b[d * d / 2 <= THRESHOLD + 1e-9])), kind)
    found = found.withColumnRenamed("cluster_id", "part").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(by, "part")))
    several = found.where("size > 1").alias("f").join(rows.alias("r"), F.expr(f"f.`{by}` <=> r.`{by}` AND f.pos = r.pos")).select("f.*", "r.vector")

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        pos = frame["pos"].to_numpy()
        return frame[[by, id_col, "pos"]].assign(cluster_id=pos[agglomerative(np.array(frame["vector"].tolist(), dtype=np.float64))])

    first = several.groupBy(by, "part").applyInPandas(linked, kind).unionByName(found.where("size = 1").select(by, id_col, "pos", F.col("part").alias("cluster_id")))
    return first.select(by, id_col, (F.dense_rank().over(order.orderBy("cluster_id")) - 1).cast("long").alias("cluster_id"))


def _by_appearance(labels: np.ndarray) -> np.ndarray:
    """Cluster ids in the order of first appearance; each -1 is a cluster of its own."""
    names = np.where(labels < 0, -1 - np.arange(len(labels)), labels)
    _, first, which = np.unique(names, return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[which]
