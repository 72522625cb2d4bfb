"""Vector code compression: codebooks by exact k-means over anchors-hierarchy trees of the parts.

Components become integers floor(256 x) and vectors are cut into equal parts; each
position has a codebook, which starts as that part of the vectors of smallest id.

1. Vectors are packed in blocks of up to BLOCK, as they lie. For each position a block
   has a metric tree of its parts, built middle-out: anchors are taken farthest first
   and take over the points that are nearer to them (only those farther from their
   anchor than half the way to the new one are looked at); the anchors' balls are
   merged upwards, the pair of smallest common ball first, and split downwards in the
   same way until a ball has LEAF points. Each ball caches the sum and number of its
   points. Trees are written once and read by every round.
2. A round sends the codebooks (fixed size) to the blocks. A ball inherits the entries
   that its parent could not rule out, and rules out those beyond whose bisecting plane
   with the nearest entry it lies as a whole. A ball with one entry left is wholly owned
   and adds its cached sum; in leaves with more, points are compared in integers.
3. The sums of all blocks, an array of fixed size, are added by Spark. After the last
   round parts are assigned again, and codes and errors leave the blocks.

Vectors that are null, empty, or have null or non-finite components are dropped, and so
are those of another length than the vector of the smallest id. Components are held
within -2^24 to 2^24 after scaling. Null ids come after all others; of equal ids the
lesser vector comes first. Equal vectors get equal codes, ties go to the lower entry,
entries without parts stay as they are. Fewer vectors than entries make shorter
codebooks, none an empty result. Other columns are ignored. Jobs run while the result is
built; the trees are dropped then.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .arrays import emit, total

BLOCK, LEAF = 4096, 16
#: Scaled components lie within plus and minus this.
MOST = 1 << 24
#: Parts that the vectors of a common label are spread over where its sum is joined to them.
SALTS = 8


def length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...j,...j->...", v, v))


def _first(hit: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first index of `hit` (ascending) in each group that begins at `start`."""
    return hit[np.searchsorted(hit, start)]


def anchors(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The number of the anchor that owns each point, in its group off[g]:off[g+1]; about the root of the group's size, fewer where points are equal."""
    size, start = np.diff(off), off[:-1]
    want = np.ceil(np.sqrt(size)).astype(np.int64)
    group = np.repeat(np.arange(len(size)), size)
    owner = np.zeros(len(x), np.int64)
    pivots = np.zeros((len(size), int(want.max()), x.shape[1]))
    pivots[:, 0] = x[start]
    away = length(x - x[start][group])
    for k in range(1, pivots.shape[1]):
        radius = np.maximum.reduceat(away, start)
        live = (radius > 0) & (k < want)
        if not live.any():
            break
        new = x[_first(np.flatnonzero(away == radius[group]), start)]
        pivots[:, k] = new
        half = length(pivots[:, :k] - new[:, None]) / 2
        half[~live] = np.inf
        near = np.flatnonzero(away > half[group, owner])
        there = length(x[near] - new[group[near]])
        taken = there < away[near]
        owner[near[taken]], away[near[taken]] = k, there[taken]
    return owner


class Tree:
    """Balls of several groups of points, one root for each; arrays by ball, and `order` of the points."""

    FIELDS = ("order", "points", "root", "part", "left", "right", "lo", "hi", "total", "count", "radius")

    def __init__(self, **fields: np.ndarray):
        self.__dict__.update(fields)
        self.centre = self.total / self.count[:, None]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as x:
            return cls(**{k: x[k] for k in cls.FIELDS})

    @classmethod
    def build(cls, points: np.ndarray, off: np.ndarray) -> Tree:
        """Of int points; group g, which is part g, has off[g]:off[g+1] (none is empty)."""
        order, x = np.arange(len(points)), points.astype(np.float64)
        nodes = {k: [] for k in ("part", "left", "right", "lo", "hi", "total", "count", "radius")}
        n_nodes = 0

        def add(**columns: np.ndarray) -> np.ndarray:
            nonlocal n_nodes
            n = len(columns["part"])
            for k in nodes:
                nodes[k].append(columns.get(k, np.full(n, -1)))
            n_nodes += n
            return np.arange(n_nodes - n, n_nodes)

        def balls(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sums, counts and radii of spans of the points that follow one another."""
            at = order[np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])]
            size = hi - lo
            cut = np.concatenate([[0], np.cumsum(size)[:-1]])
            sums = np.add.reduceat(points[at].astype(np.int64), cut, axis=0)
            away = length(x[at] - np.repeat(sums / size[:, None], size, axis=0))
            return sums, size, np.maximum.reduceat(away, cut)

        def root_of(lo, hi, part) -> np.ndarray:
            s, n, r = balls(lo, hi)
            return add(part=part, lo=lo, hi=hi, total=s, count=n, radius=r)

        lo, hi, part = off[:-1].copy(), off[1:].copy(), np.arange(len(off) - 1)
        root = node = root_of(lo, hi, part)
        children: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        radius = nodes["radius"][0]
        while True:
            big = np.flatnonzero((hi - lo > LEAF) & (radius > 0))
            if not len(big):
                break
            lo, hi, part, node = lo[big], hi[big], part[big], node[big]
            size = hi - lo
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            group = np.repeat(np.arange(len(lo)), size)
            owner = anchors(x[order[at]], np.concatenate([[0], np.cumsum(size)]))
            key = group * (int(owner.max()) + 1) + owner
            by = np.argsort(key, kind="stable")
            order[at] = order[at[by]]
            edge = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
            of = group[by][edge]
            new_lo = at[edge]
            new_hi = at[np.append(edge[1:], len(by)) - 1] + 1
            s, n, r = balls(new_lo, new_hi)
            ids = add(part=part[of], lo=new_lo, hi=new_hi, total=s, count=n, radius=r)
            children += cls._merge(add, node, part, of, ids, s, n, r)
            lo, hi, part, node, radius = new_lo, new_hi, part[of], ids, r
        found = {k: np.concatenate(v) for k, v in nodes.items()}
        for at, left, right in children:
            found["left"][at], found["right"][at] = left, right
        small = np.int16 if len(points) and np.abs(points).max() < 1 << 15 else np.int32
        found |= {k: found[k].astype(np.int32) for k in ("left", "right", "lo", "hi", "count")} | {"part": found["part"].astype(np.int16)}
        found["total"] = found["total"].astype(np.int32 if np.abs(found["total"]).max() < 1 << 31 else np.int64)
        # rounded up, so that no ball is taken for smaller than it is
        found["radius"] = np.nextafter(found["radius"].astype(np.float32), np.float32(np.inf))
        return cls(order=order.astype(np.int32), points=points.astype(small), root=root, **found)

    @staticmethod
    def _merge(add, node, part, of, ids, sums, count, radius) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merges the balls of each group in pairs up to its own ball `node`; (balls, left, right) of each step."""
        start = np.searchsorted(of, np.arange(len(node)))
        k = np.diff(np.append(start, len(of)))
        g, most, d = len(node), int(k.max()), sums.shape[1]
        slot = np.arange(len(of)) - start[of]
        ball, s, c, r = np.full((g, most), -1), np.zeros((g, most, d), np.int64), np.zeros((g, most), np.int64), np.zeros((g, most))
        ball[of, slot], s[of, slot], c[of, slot], r[of, slot] = ids, sums, count, radius

        def common(a_s, a_c, a_r, b_s, b_c, b_r):
            n = np.maximum(a_c + b_c, 1)[..., None]
            mid = (a_s + b_s) / n
            far = lambda t, m, q: length(mid - t / np.maximum(m, 1)[..., None]) + q
            return np.maximum(far(a_s, a_c, a_r), far(b_s, b_c, b_r))

        cost = common(s[:, :, None], c[:, :, None], r[:, :, None], s[:, None], c[:, None], r[:, None])
        there = ball >= 0
        cost[~(there[:, :, None] & there[:, None])] = np.inf
        cost[:, np.arange(most), np.arange(most)] = np.inf
        out = []
        for step in range(most - 1):
            # groups that still have two balls or more
            w = np.flatnonzero(k - step > 1)
            i, j = np.divmod(cost[w].reshape(len(w), -1).argmin(1), most)
            rad, pair = cost[w, i, j], (ball[w, i], ball[w, j])
            s[w, i] += s[w, j]
            c[w, i] += c[w, j]
            r[w, i] = rad
            last = k[w] - step == 2
            new = node[w].copy()
            if (~last).any():
                v = w[~last]
                new[~last] = add(part=part[v], total=s[v, i[~last]], count=c[v, i[~last]], radius=rad[~last])
            ball[w, i], ball[w, j] = new, -1
            out.append((new, *pair))
            cost[w, j, :] = cost[w, :, j] = np.inf
            row = common(s[w, i][:, None], c[w, i][:, None], r[w, i][:, None], s[w], c[w], r[w])
            row[ball[w] < 0] = np.inf
            row[np.arange(len(w)), i] = np.inf
            cost[w, i, :] = cost[w, :, i] = row
        return out

    def assign(self, entries: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest of entries (part, entry, component): (balls, entries) wholly owned and (points, entries) of leaves. `whole`: every point is returned."""
        n = entries.shape[1]
        wide = entries.astype(np.float64)
        gap = length(wide[:, :, None] - wide[:, None])
        # of equal entries the lowest stands for all
        single = ~((gap == 0) & (np.arange(n)[:, None] > np.arange(n)[None])).any(2)
        node = self.root
        mask = single[self.part[node]]
        count, cand = mask.sum(1), np.nonzero(mask)[1]
        balls, points = [], []
        while len(node):
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            rep = np.repeat(np.arange(len(node)), count)
            at = node[rep]
            apart = self.centre[at] - wide[self.part[at], cand]
            far = np.einsum("ij,ij->i", apart, apart)
            low = np.minimum.reduceat(far, start)
            best = cand[_first(np.flatnonzero(far == low[rep]), start)]
            reach = 2 * gap[self.part[at], best[rep], cand] * self.radius[at]
            kept = far - low[rep] <= reach * (1 + 1e-9) + 1e-9 * (far + 1)
            count, cand, rep = np.add.reduceat(kept.astype(np.int64), start), cand[kept], rep[kept]
            inner, one = self.left[node] >= 0, count == 1
            if not whole:
                balls.append((node[one], best[one]))
                go = ~one
            else:
                go = np.ones(len(node), bool)
            leaf = np.flatnonzero(go & ~inner)
            if len(leaf):
                begin = np.concatenate([[0], np.cumsum(count)[:-1]])
                points.append(self._leaves(entries, node[leaf], begin[leaf], count[leaf], cand))
            down = np.flatnonzero(go & inner)
            lists = cand[(go & inner)[rep]]
            node = np.concatenate([self.left[node[down]], self.right[node[down]]])
            count, cand = np.tile(count[down], 2), np.tile(lists, 2)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        join = lambda x: tuple(np.concatenate(c) for c in zip(*(x or [none]), strict=True))
        return *join(balls), *join(points)

    def _leaves(self, entries, node, begin, count, cand) -> tuple[np.ndarray, np.ndarray]:
        """Each point of the leaves against the entries left there, in integers; lists are ascending, so ties go to the lower entry."""
        size = self.hi[node] - self.lo[node]
        point = self.order[np.repeat(self.lo[node] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        each = np.repeat(count, size)
        start = np.concatenate([[0], np.cumsum(each)[:-1]])
        rep = np.repeat(np.arange(len(point)), each)
        c = cand[np.repeat(np.repeat(begin, size) - start, each) + np.arange(len(rep))]
        apart = self.points[point[rep]].astype(np.int64) - entries[np.repeat(np.repeat(self.part[node], size), each), c]
        far = np.einsum("ij,ij->i", apart, apart)
        low = np.minimum.reduceat(far, start)
        return point, c[_first(np.flatnonzero(far == low[rep]), start)]


def block_sums(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """(part, entry, components and a count at the end): sums of the parts nearest to each entry."""
    parts, n, d = entries.shape
    ball, of, point, to = tree.assign(entries, whole=False)
    per = len(tree.points) // parts
    key = np.concatenate([tree.part[ball].astype(np.int64) * n + of, point // per * n + to])
    values = np.concatenate([np.column_stack([tree.total[ball], tree.count[ball]]), np.column_stack([tree.points[point], np.ones(len(point), np.int64)])])
    out = np.zeros((parts * n, d + 1), np.int64)
    np.add.at(out, key, values.astype(np.int64))
    return out


def block_codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector, part) and errors by vector."""
    parts = entries.shape[0]
    _, _, point, to = tree.assign(entries, whole=True)
    code = np.empty(len(tree.points), np.int64)
    code[point] = to
    code = code.reshape(parts, -1)
    apart = tree.points.reshape(parts, code.shape[1], -1).astype(np.int64) - entries[np.arange(parts)[:, None], code]
    return code.T.astype(np.uint8), (apart * apart).sum((0, 2))


def scaled(vector: Column) -> Column:
    """floor(256 x) of each component; null for vectors that are dropped."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(wide, lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return F.when(fine & (F.size(wide) > 0), whole)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, code, error) under their own names for each kept row, and the codebooks (part, entry, component); None without rows. The rows are a table in the shared folder."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    types = {c: df.schema[c].dataType for c in (id_col, label_col)}
    rows = df.select(df[id_col].alias("id"), df[label_col].alias("label"), scaled(df[vector_col]).alias("x")).where("x is not null")
    scratch = Scratch(df.sparkSession)
    least = [F.asc_nulls_last("id"), F.asc("x")]
    first = rows.orderBy(*least).select("x").limit(1).collect()
    out = f"id {types[id_col].simpleString()}, label {types[label_col].simpleString()}, code string, error bigint"
    if not first:
        return df.sparkSession.createDataFrame([], out), None
    dim = len(first[0]["x"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("x") == dim)
    seeds = np.array([r["x"] for r in rows.orderBy(*least).select("x").limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    shape = books.shape

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, parts, -1)
                points = np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(parts * batch.num_rows, -1)
                tree = Tree.build(points, np.arange(parts + 1) * batch.num_rows)
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([tree.pack()], pa.binary())], names=["ids", "labels", "tree"])

    trees = scratch.write(rows.mapInArrow(build, f"ids array<{types[id_col].simpleString()}>, labels array<{types[label_col].simpleString()}>, tree binary"))
    context = df.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((shape[0] * shape[1], shape[2] + 1), np.int64)
            for batch in batches:
                for data in batch.column(0):
                    acc += block_sums(Tree.unpack(data.as_py()), shared.value)
            found = emit(acc.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "task", "data"])

        acc = total(trees.select("tree").mapInArrow(sums, "part int, task int, data binary"), shape[0] * shape[1] * (shape[2] + 1)).reshape(*shape[:2], -1)
        used = acc[..., -1:] > 0
        books = np.where(used, acc[..., :-1] // np.maximum(acc[..., -1:], 1), books)
    shared = context.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                code, error = block_codes(Tree.unpack(batch.column(2)[k].as_py()), shared.value)
                text = code.tobytes().hex()
                wide = 2 * parts
                words = [text[a : a + wide] for a in range(0, len(text), wide)]
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), row.column(1).flatten(), pa.array(words, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    found = scratch.write(trees.mapInArrow(codes, out))
    scratch.drop(trees)
    return found, books


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal text, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def labelled_errors(found: DataFrame) -> DataFrame:
    """Adds label_error, the sum of `error` over rows of equal label, nulls together. The rows of a common label stay spread out."""
    salted = found.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.hash("label")).withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = sums.select(F.col("label").alias("_l"), F.col("label").isNull().alias("_none"), F.hash("label").alias("_label"), "_salt", "label_error")
    return salted.join(sums, ["_label", "_none", "_salt"]).where(F.col("label").eqNullSafe(F.col("_l"))).select("id", "label", "code", "error", "label_error")
