"""Embedding near-dedup: exact threshold pairs by cover trees, traversed in pairs.

Vectors of one label are put on the unit sphere, where cosine >= t is distance
<= sqrt(2 - 2t).

1. The upper levels: per label a net of centres, farthest point first, so that
   the radius halves from level to level; as many centres as the label has
   parts, at most ``MAX_CENTRES``, taken from a bounded sample.  Every vector
   goes to its nearest centre.  A centre's vectors are dealt into parts of
   about ``PART_ROWS``, whatever their number, and each part has a covering
   radius, the largest distance of its vectors to the centre.
2. Pairs of parts of one label are pruned by their covering radii:
   d(centres) > r + r' + threshold.
3. For each pair left, a task builds the lower levels as cover trees (nested
   nodes with halving radii and exact covering radii) and walks both together:
   a pair of nodes is pruned by the same bound, accepted as a whole if
   d + r + r' is below the threshold, or opened; what is left are exact cosines
   in double precision.  Only counts and a spanning forest of the links leave
   the task, so a large group of copies stays linear.
4. Components of the forests (alternating stars).

Cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label, link with nothing and keep themselves.  Vectors of
different length do not link.  Rows that repeat an id count as one, the
smallest (label, vector).  A row without an id links with nothing, has no component
and is not kept.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import matrix, usable
from .common import cut_lineage, read_table
from .components import components
from .pii import sample_by_hash

COSINE = 0.98
PART_ROWS, MAX_CENTRES, SAMPLE_ROWS = 2_000, 256, 20_000
LEAF = 16
MARGIN = 1e-7


# ------------------------------------------------------------------ local trees
class CoverTree:
    """Nested nets: a node's children are a net of its points at half its
    radius, the node's own centre first; ``order`` lists points so that every
    node is a range."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.square = (x * x).sum(axis=1)
        self.order = np.arange(len(x))
        self.centre, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        if len(x):
            self._grow()

    def _node(self, centre: int, lo: int, hi: int) -> int:
        d = np.linalg.norm(self.x[self.order[lo:hi]] - self.x[centre], axis=1)
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append([])
        return len(self.centre) - 1

    def _grow(self) -> None:
        stack = [self._node(0, 0, len(self.x))]
        while stack:
            node = stack.pop()
            lo, hi, r = self.lo[node], self.hi[node], self.radius[node]
            if hi - lo <= LEAF or r < 1e-6:
                continue
            own, target = self.order[lo:hi], r / 2
            # distances to a centre from one product each; off by rounding only,
            # and the nodes' radii are taken exactly afterwards
            x, sq = self.x[own], self.square[own]
            to = lambda c: np.sqrt(np.maximum(0.0, sq + self.square[c] - 2 * (x @ self.x[c])))
            near = to(self.centre[node])
            of = np.zeros(len(own), np.int64)
            centres = [self.centre[node]]
            while True:
                far = int(near.argmax())
                if near[far] <= target:
                    break
                d = to(own[far])
                d[far] = 0.0
                closer = d < near
                near[closer], of[closer] = d[closer], len(centres)
                centres.append(int(own[far]))
            by = np.argsort(of, kind="stable")
            self.order[lo:hi] = own[by]
            ends = lo + np.cumsum(np.bincount(of, minlength=len(centres)))
            for c, a, b in zip(centres, np.append(lo, ends[:-1]), ends):
                if b > a:
                    kid = self._node(c, int(a), int(b))
                    self.kids[node].append(kid)
                    stack.append(kid)

    def points(self, node: int) -> np.ndarray:
        return self.order[self.lo[node]:self.hi[node]]


class Links:
    """Counts per point and a spanning forest over the points of two sides."""

    def __init__(self, n: int, m: int):
        self.count = [np.zeros(n, np.int64), np.zeros(m, np.int64)]
        self.parent = list(range(n + m))
        self.n = n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def whole(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[0][a] += len(b)
        self.count[1][b] += len(a)
        for i in a.tolist():
            self.join(i, self.n + int(b[0]))
        for j in b.tolist():
            self.join(int(a[0]), self.n + j)

    def some(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        """Links of a block; labels spread over the block until they settle."""
        self.count[0][a] += hit.sum(axis=1)
        self.count[1][b] += hit.sum(axis=0)
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        h = hit[np.ix_(rows, cols)]
        big = len(rows)
        mark = np.arange(big)
        while True:
            col = np.where(h, mark[:, None], big).min(axis=0)
            new = np.where(h, col[None, :], big).min(axis=1)
            if (new == mark).all():
                break
            mark = new
        for i, r in zip(rows.tolist(), mark.tolist()):
            self.join(int(a[i]), int(a[rows[r]]))
        for j, r in zip(cols.tolist(), col.tolist()):
            self.join(self.n + int(b[j]), int(a[rows[r]]))


def dual_traversal(s: CoverTree, t: CoverTree, exact_s: np.ndarray, exact_t: np.ndarray,
                   cosine: float) -> Links:
    """All pairs of s and t with cosine at or above the threshold.  ``exact_*``
    are the original vectors; tree points are their unit vectors."""
    bound = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    links = Links(len(s.x), len(t.x))
    ns, nt = (np.sqrt((z * z).sum(axis=1)) for z in (exact_s, exact_t))
    if not len(s.x) or not len(t.x):
        return links
    sc, tc = np.array(s.centre), np.array(t.centre)
    sr, tr = np.array(s.radius), np.array(t.radius)
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def leaf(a, b):
        for lo in range(0, len(a), 1024):
            p = a[lo:lo + 1024]
            cos = (exact_s[p] @ exact_t[b].T) / (ns[p][:, None] * nt[b][None, :])
            hit = cos >= cosine
            if hit.any():
                links.some(p, b, hit)

    while stack:
        u, v = stack.pop()
        # distances of all node pairs of two sibling lists at once
        dot = s.x[sc[u]] @ t.x[tc[v]].T
        d = np.sqrt(np.maximum(0.0, 2 - 2 * dot))
        reach = sr[u][:, None] + tr[v][None, :]
        open_ = d - reach <= bound + MARGIN
        # single points on both sides of a sibling pair: one exact block
        lone_u = np.array([s.hi[x] - s.lo[x] == 1 for x in u])
        lone_v = np.array([t.hi[x] - t.lo[x] == 1 for x in v])
        lone = open_ & lone_u[:, None] & lone_v[None, :]
        if lone.any():
            i, j = np.flatnonzero(lone.any(axis=1)), np.flatnonzero(lone.any(axis=0))
            leaf(sc[u[i]], tc[v[j]])       # the bound only leaves out pairs that do not link
            open_ &= ~(lone_u[:, None] & lone_v[None, :])
        for i, j in zip(*np.nonzero(open_)):
            a, b = int(u[i]), int(v[j])
            if d[i, j] + reach[i, j] <= bound - MARGIN:
                links.whole(s.points(a), t.points(b))
                continue
            ka, kb = s.kids[a], t.kids[b]
            if not ka and not kb:
                leaf(s.points(a), t.points(b))
            else:
                # open the wider node, or both
                left = np.array(ka if ka and (not kb or s.radius[a] >= t.radius[b] / 2) else [a])
                right = np.array(kb if kb and (not ka or t.radius[b] >= s.radius[a] / 2) else [b])
                stack.append((left, right))
    return links


# -------------------------------------------------------------------- in Spark
def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k centres, each the point farthest from those before: nested nets."""
    pick = [0]
    near = np.linalg.norm(x - x[0], axis=1)
    while len(pick) < min(k, len(x)):
        far = int(near.argmax())
        if near[far] <= 0:
            break
        pick.append(far)
        near = np.minimum(near, np.linalg.norm(x - x[far], axis=1))
    return x[pick]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _to_centres(centres: dict):
    def run(batches):
        for b in batches:
            group = b["grp"].to_pylist()
            cell, dist = np.zeros(len(group), np.int32), np.zeros(len(group))
            for name in set(group):
                at = np.array([i for i, g in enumerate(group) if g == name])
                x = _unit(np.array([b["v"][int(i)].as_py() for i in at]))
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ centres[name].T))
                cell[at] = d.argmin(axis=1)
                dist[at] = d.min(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "grp": b["grp"], "v": b["v"],
                                              "cell": pa.array(cell), "dist": pa.array(dist)})
    return run


def _pair_links(cosine: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids = table["vec_id"].to_numpy()
        dim = len(table["v"][0])
        x = matrix(table["v"], dim)
        own = key[0].as_py() == key[1].as_py()
        a = np.flatnonzero(side == 0)
        b = a if own else np.flatnonzero(side == 1)
        s = CoverTree(_unit(x[a]))
        t = s if own else CoverTree(_unit(x[b]))
        links = dual_traversal(s, t, x[a], x[b], cosine)
        if own:
            for i in range(len(a)):
                links.join(i, links.n + i)
            count, member = links.count[0] - 1, ids[a]
            root = [links.find(i) for i in range(len(a))]
        else:
            count, member = np.concatenate(links.count), np.concatenate([ids[a], ids[b]])
            root = [links.find(i) for i in range(len(member))]
        name = np.concatenate([ids[a], ids[b]])[root] if len(root) else ids[:0]
        some = count > 0
        return pa.table({"vec_id": pa.array(member[some]), "n": pa.array(count[some]),
                         "root": pa.array(name[some])})
    return run


def near_pairs(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n, root: per part pair a vector's number of links and a vector
    it is connected with."""
    part_kind = "vec_id long, grp string, v array<double>, cell int, dist double"
    ok = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = (table.filter(F.col("vec_id").isNotNull()).groupBy("vec_id")
            .agg(F.min(F.struct("label", F.col("embedding").cast("array<double>").alias("embedding")))
                 .alias("m")).select("vec_id", "m.*").filter(ok)
            .select("vec_id", F.concat_ws(":", F.size("embedding").cast("string"),
                                          F.col("label").cast("string")).alias("grp"),
                    F.col("embedding").alias("v")))
    rows = cut_lineage(rows)
    sizes = {r.grp: r.n for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    sample: dict[str, list] = {}
    for r in (sample_by_hash(rows, F.concat(F.lit("cover:"), F.col("vec_id").cast("string")),
                             SAMPLE_ROWS).orderBy("vec_id").limit(2 * SAMPLE_ROWS).toLocalIterator()):
        sample.setdefault(r.grp, []).append(r.v)
    centres = {}
    for name, n in sizes.items():
        dim = int(name.split(":")[0])
        x = _unit(np.array(sample[name])) if name in sample else np.eye(1, dim)
        centres[name] = farthest_first(x, min(MAX_CENTRES, -(-n // PART_ROWS)))
    put = cut_lineage(rows.mapInArrow(_to_centres(centres), part_kind))
    cells = put.groupBy("grp", "cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    dealt = (put.join(F.broadcast(cells) if len(sizes) * MAX_CENTRES <= 100_000 else cells,
                      ["grp", "cell"])
             .withColumn("part", F.concat_ws("/", "grp", "cell", F.pmod(F.xxhash64("vec_id"), parts))))
    where = [(g, i, c.tolist()) for g, cs in centres.items() for i, c in enumerate(cs)]
    spots = table.sparkSession.createDataFrame(where, "grp string, cell int, c array<double>")
    balls = (dealt.groupBy("grp", "cell", "part").agg(F.max("dist").alias("r"))
             .join(spots, ["grp", "cell"]).select("grp", "part", "r", "c"))
    balls = cut_lineage(balls)
    bound = float(np.sqrt(2 - 2 * cosine)) + MARGIN
    a = balls.select("grp", F.col("part").alias("p"), F.col("r").alias("ra"), F.col("c").alias("ca"))
    b = balls.select("grp", F.col("part").alias("q"), F.col("r").alias("rb"), F.col("c").alias("cb"))
    gap = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                             lambda s, x: s + x))
    pairs = (a.join(b, "grp").filter("p <= q").filter(gap <= F.col("ra") + F.col("rb") + bound)
             .select("p", "q"))
    pairs = cut_lineage(pairs)
    left = pairs.withColumn("part", F.col("p")).withColumn("side", F.lit(0))
    right = pairs.filter("p <> q").withColumn("part", F.col("q")).withColumn("side", F.lit(1))
    work = left.unionAll(right).join(dealt.select("part", "vec_id", "v"), "part")
    return (work.select("p", "q", "side", "vec_id", "v").groupBy("p", "q")
            .applyInArrow(_pair_links(cosine), "vec_id long, n long, root long"))


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for all rows (vec_id, label, embedding)."""
    found = cut_lineage(near_pairs(table.select("vec_id", "label", "embedding"), cosine))
    counted = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    ids = table.select("vec_id").filter("vec_id IS NOT NULL").distinct()
    out = (ids.join(counted, "vec_id", "left")
           .join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
           .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                   F.coalesce("component", "vec_id").alias("component_id")))
    bare = table.filter("vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionAll(bare).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
