"""Exact nearest neighbours and near pairs of unit vectors, with pruning by angles.

1. Equal vectors meet as one, by their smallest id; zero vectors take no part.
2. Jobs of more than `plain` vectors are cut into tight blocks: in each round LEADERS
   vectors that no block holds yet lead one each, of those within NEAR (an angle) of them.
   Rounds end when one more catches little. Vectors that no leader is near to, and those
   of blocks of under SMALL, go to loose blocks, by the nearest of a few leaders. Blocks are
   split by hash down to about BLOCK. Other jobs have loose blocks by hash alone.
3. Each block is compared with itself. That gives every vector a lower bound of its
   maximum, and every block a centre and a radius.
4. By the triangle inequality of angles a vector can't be nearer to any vector of a block
   than its angle to the centre less the radius. Two blocks are compared if, by that, some
   vector of one may find a pair or a better maximum in the other; whole blocks are ruled
   out by their centres first, then by each vector.

Nothing is left to chance: what is pruned can't change a result, so pairs and maxima are
those of the comparison of all pairs. How much is pruned depends on the data. Copies and
near copies lie in tight blocks with high bounds, and then the comparisons left are about
as many as the blocks; of vectors without anything near them (random ones of many
dimensions) each has to be held against all, which no exact search avoids. Centres are
compared block by block, at a hundredth of the vectors' pairs or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .shares import SALTS, SHARES, dealt, met, of_job, share, share_counts

BLOCK, LEADERS, SMALL = 1024, 2048, 16
#: Radians around a leader; rounds of leaders at most; what a round has to catch for another.
NEAR, ROUNDS, CATCH = 0.4, 6, 0.05
#: Vectors of a job up to which all its blocks are compared without leaders.
PLAIN = 16 * BLOCK
#: Centres that a task holds.
CENTRES = 4096
#: Slack of bounds against rounding.
SLACK = 1e-9

_FOUND = "job_ref string, block long, a long, b long, sim double, centre array<double>, radius double, least double"


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _table(job: str, block: int, a, b, sim, centre=None, radius=None, least=None) -> pa.Table:
    n = len(a)
    many = lambda x, kind: pa.array([x] * n, kind)
    return pa.table({"job_ref": many(job, pa.string()), "block": many(block, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64()), "centre": many(centre, pa.list_(pa.float64())), "radius": many(radius, pa.float64()), "least": many(least, pa.float64())})


def _near(job: str | None, a, b, sim) -> pa.Table:
    return pa.table({"job_ref": pa.array([job] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _own(table: pa.Table, best: bool = True) -> pa.Table:
    """Of one block: pairs (b not null), the maximum of each vector (b null), and a row with centre and radius (a null). Where only pairs are wanted, a vector needs no other block below the threshold."""
    n = table.num_rows
    job, block, cut = (table.column(c)[0].as_py() for c in ("job_ref", "block", "cut"))
    ids, x = table.column("id").to_numpy(), matrix(table.column("features"), n)
    sim = x @ x.T
    i, j = np.nonzero(np.triu(sim >= cut, 1))
    np.fill_diagonal(sim, -1.0)
    top = sim.max(1)
    centre = x.mean(0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-9 else x[0]
    radius = float(_angle(x @ centre).max())
    return pa.concat_tables([
        _table(job, block, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), sim[i, j]),
        _table(job, block, ids, [None] * n, top),
        _table(job, block, [None], [None], [None], centre.tolist(), radius, float(np.minimum(top, cut).min()) if best else cut),
    ])


def _two(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
    """Of the block pairs (a, b) wanted of two shares: near pairs (b not null) and the maximum of each vector (b null)."""
    if not wanted.num_rows or not vectors.num_rows:
        return _near(None, [], [], [])
    job, cut = (vectors.column(c)[0].as_py() for c in ("job_ref", "cut"))
    block = vectors.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    block, ids, x = block[order], vectors.column("id").to_numpy()[order], matrix(vectors.column("features"), len(order))[order]
    del vectors
    a, b = wanted.column("a").to_numpy(), wanted.column("b").to_numpy()
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    top, found = np.full(len(ids), -1.0), []
    for own in np.unique(a):
        rows = slice(*(int(np.searchsorted(block, own, side)) for side in ("left", "right")))
        others = b[slice(*(np.searchsorted(a, own, side) for side in ("left", "right")))]
        ends = [np.arange(*(int(np.searchsorted(block, k, side)) for side in ("left", "right"))) for k in others]
        columns = np.concatenate(ends)
        for at in range(0, len(columns), 4 * BLOCK):
            j = columns[at : at + 4 * BLOCK]
            sim = x[rows] @ x[j].T
            if not sim.size:
                continue
            top[rows] = np.maximum(top[rows], sim.max(1))
            top[j] = np.maximum(top[j], sim.max(0))
            hit, column = np.nonzero(sim >= cut)
            if len(hit):
                one, two = ids[rows][hit], ids[j[column]]
                found.append((np.minimum(one, two), np.maximum(one, two), sim[hit, column]))
    pairs = [_near(job, *(np.concatenate(k) for k in zip(*found, strict=True)))] if found else []
    return pa.concat_tables([*pairs, _near(job, ids, [None] * len(ids), top)])


def _led(rows: DataFrame, leaders: np.ndarray) -> DataFrame:
    """Adds `leader` (-1: none within NEAR) and `home`, the nearest of the first leaders, one for each BLOCK of the n vectors, to (.., features, n)."""
    shared = rows.sparkSession.sparkContext.broadcast(leaders)
    f, n = rows.columns.index("features"), rows.columns.index("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sim = matrix(part.column(f), part.num_rows) @ shared.value.T
                best = sim.argmax(1)
                leader = np.where(_angle(sim[np.arange(len(sim)), best]) <= NEAR, best, -1)
                some = np.ceil(part.column(n).to_numpy() / BLOCK)
                sim[np.arange(sim.shape[1]) >= some[:, None]] = -np.inf
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leader.astype(np.int32)), pa.array(sim.argmax(1).astype(np.int32))], names=[*part.schema.names, "leader", "home"])

    return rows.mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema) + ", leader int, home int")


def _leaders(rows: DataFrame) -> np.ndarray:
    """Features of LEADERS rows of least hash, an array of bounded size; of those within NEAR of each other the first stays."""
    found = rows.orderBy(F.xxhash64("job_ref", "id"), "job_ref", "id").select("features").limit(LEADERS).toArrow().column("features")
    x = matrix(found, len(found))
    near = _angle(x @ x.T) <= NEAR
    kept: list[int] = []
    covered = np.zeros(len(x), bool)
    for k in range(len(x)):
        if not covered[k]:
            kept.append(k)
            covered |= near[k]
    return x[kept]


def _split(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds `block`: rows of equal key, in parts of about BLOCK by hash."""
    parts = rows.groupBy("job_ref", *key).agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    salt = F.pmod(F.xxhash64("id"), F.col("_parts"))
    spread = parts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["job_ref", *key, "_salt"]).withColumn("block", F.xxhash64(*key, salt)).select("job_ref", "id", "features", "cut", "block")


def blocks(rows: DataFrame, plain: int, scratch: Scratch) -> DataFrame:
    """(job_ref, id, features, cut, block) of (job_ref, id, features, cut)."""
    with_size = lambda d: of_job(d, d.groupBy("job_ref").agg(F.count("*").alias("n")))
    sized = with_size(rows)
    small = _split(sized.where(F.col("n") <= plain).withColumn("kind", F.lit(-1)), ["kind"])
    left, done = sized.where(F.col("n") > plain).drop("n"), []
    n_left = left.count()
    if not n_left:
        return small
    for k in range(ROUNDS):
        led = scratch.write(_led(with_size(left).select("job_ref", "id", "features", "cut", "n"), _leaders(left)))
        counts = led.where("leader >= 0").groupBy("job_ref", "leader").agg(F.count("*").alias("_n")).where(F.col("_n") >= SMALL)
        caught = led.join(counts, ["job_ref", "leader"], "left_semi").withColumn("kind", F.lit(k))
        done.append(_split(caught, ["kind", "leader"]))
        rest = led.join(counts, ["job_ref", "leader"], "left_anti")
        left = rest.select("job_ref", "id", "features", "cut")
        before, n_left = n_left, left.count()
        if n_left == 0 or before - n_left < CATCH * before:
            break
    out = small.union(_split(rest.withColumn("kind", F.lit(-2)), ["kind", "home"]))
    for x in done:
        out = out.union(x)
    return out


def _block_pairs(found: DataFrame) -> DataFrame:
    """(job_ref, a, b) of blocks a < b that their centres don't rule out."""
    centres = found.where("a is null").select("job_ref", "block", "centre", "radius", "least")
    n = centres.groupBy("job_ref").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    c = of_job(centres, n, "block").withColumn("_part", F.pmod(F.xxhash64("block"), F.col("_n")).cast("int"))
    c = c.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("job_ref", F.least("_part", "_other").alias("low"), F.greatest("_part", "_other").alias("high"), "_part", "block", "centre", "radius", "least")

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        x, (r, need) = matrix(table.column("centre"), n), (table.column(k).to_numpy() for k in ("radius", "least"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        part, block = table.column("_part").to_numpy(), table.column("block").to_numpy()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        apart = _angle(x[left] @ x[right].T) - r[left][:, None] - r[right]
        go = np.cos(np.maximum(apart, 0)) >= np.minimum(need[left][:, None], need[right]) - SLACK
        i, j = np.nonzero(go)
        a, b = block[left[i]], block[right[j]]
        keep = a < b if low == high else np.ones(len(a), bool)
        a, b = a[keep], b[keep]
        return pa.table({"job_ref": pa.array([table.column("job_ref")[0].as_py()] * len(a), pa.string()), "a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return c.groupBy("job_ref", "low", "high").applyInArrow(run, "job_ref string, a long, b long")


def _needed(pairs: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of block pairs (job_ref, a, b) those that some vector of either needs, by its own angle to the other's centre; rows have `least`."""
    centres = found.where("a is null").select("job_ref", F.col("block").alias("other"), "centre", "radius")
    both = pairs.select("job_ref", F.col("a").alias("block"), F.col("b").alias("other")).union(pairs.select("job_ref", "b", "a"))
    parts = both.groupBy("job_ref", "block").agg(F.ceil(F.count("*") / CENTRES).cast("int").alias("_n"))
    one = both.join(centres, ["job_ref", "other"]).join(parts, ["job_ref", "block"]).withColumn("_part", F.pmod(F.xxhash64("other"), F.col("_n")).cast("int"))
    two = rows.join(parts, ["job_ref", "block"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def run(centre: pa.Table, vector: pa.Table) -> pa.Table:
        n, m = centre.num_rows, vector.num_rows
        go = np.zeros(n, bool)
        if n and m:
            apart = _angle(matrix(vector.column("features"), m) @ matrix(centre.column("centre"), n).T) - centre.column("radius").to_numpy()
            go = (np.cos(np.maximum(apart, 0)) >= vector.column("least").to_numpy()[:, None] - SLACK).any(0)
        block, other = centre.column("block").to_numpy()[go], centre.column("other").to_numpy()[go]
        job = centre.column("job_ref")[0].as_py() if n else None
        return pa.table({"job_ref": pa.array([job] * len(block), pa.string()), "a": pa.array(np.minimum(block, other), pa.int64()), "b": pa.array(np.maximum(block, other), pa.int64())})

    left = one.select("job_ref", "block", "_part", "other", "centre", "radius").groupBy("job_ref", "block", "_part")
    return left.cogroup(two.select("job_ref", "block", "_part", "features", "least").groupBy("job_ref", "block", "_part")).applyInArrow(run, "job_ref string, a long, b long").distinct()


def _across(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(job_ref, a, b, sim) of block pairs (job_ref, a, b), as in _two.

    Blocks are dealt to shares (operators.shares), and pairs of them are compared where their shares meet: a vector is sent
    once for each pair of shares that needs it, not once for each block that its own is compared with.
    """
    counts = share_counts(rows, BLOCK)
    placed = of_job(pairs, counts, "a").select("job_ref", *met(share("a"), share("b")), "a", "b")
    keys = ("job_ref", "low", "high")
    # columns of their own, as both sides meet again below
    needs = placed.select(*(F.col(k).alias(k) for k in keys), F.explode(F.array("a", "b")).alias("block")).distinct()
    vectors = dealt(rows.join(needs, ["job_ref", "block"]).select(*keys, "block", "id", "features", "cut"), *keys, least=2 * SHARES * SHARES)
    return vectors.groupBy(*keys).cogroup(dealt(placed, *keys, least=2 * SHARES * SHARES).groupBy(*keys)).applyInArrow(_two, "job_ref string, a long, b long, sim double")


def _searched(scratch: Scratch, first: DataFrame, plain: int, best: bool = True) -> tuple[DataFrame, DataFrame]:
    """((job_ref, a, b, sim) of near pairs, b null for maxima within a search; block pairs compared) of different vectors (job_ref, id, features, cut)."""
    rows = scratch.write(blocks(first, plain, scratch))
    found = scratch.write(rows.groupBy("job_ref", "block").applyInArrow(lambda table: _own(table, best), _FOUND))
    top = found.where("a is not null and b is null").select("job_ref", F.col("a").alias("id"), "sim")
    bound = scratch.write(rows.join(top, ["job_ref", "id"]).select("job_ref", "id", "features", "cut", "block", F.least("sim", "cut").alias("least"))) if best else rows.withColumn("least", F.col("cut"))
    pairs = scratch.write(_needed(_block_pairs(found), bound, found))
    more = scratch.write(_across(rows, pairs))
    return found.where("a is not null").select("job_ref", "a", "b", "sim").union(more), pairs


def near_pairs(first: DataFrame, plain: int = PLAIN) -> DataFrame:
    """(job_ref, a, b, sim): all near pairs of (job_ref, id, features of unit length, all different, cut). Blocks are pruned by the cut alone, as no maxima are wanted."""
    both, _ = _searched(Scratch(first.sparkSession), first.select("job_ref", "id", "features", "cut"), plain, best=False)
    return both.where("b is not null")


def compare(df: DataFrame, threshold: Column, plain: int = PLAIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, best, block pairs compared) of (job_ref, id, features of unit length): (job_ref, a, b, sim) and (job_ref, id, max_sim); `threshold` is above 0 and the same in all rows of a job.

    Copies are paired with the smallest id of equal vectors; their maximum is 1. A zero vector is near nothing, its maximum is 0.
    """
    scratch = Scratch(df.sparkSession)
    d = df.select("job_ref", F.col("id").cast("long").alias("id"), "features", threshold.cast("double").alias("cut"))
    d = scratch.write(d.withColumn("zero", F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x) < 0.5))
    first = scratch.write(d.where("not zero").groupBy("job_ref", "features").agg(F.min("id").alias("id"), F.max("cut").alias("cut"), F.count("*").alias("copies")))
    both, pairs = _searched(scratch, first.drop("copies"), plain)
    best = both.where("b is null").groupBy("job_ref", F.col("a").alias("id")).agg(F.max("sim").alias("max_sim"))
    firsts = first.select("job_ref", "features", F.col("id").alias("a"), "copies")
    members = d.join(firsts, ["job_ref", "features"], "left")
    copies = members.where(F.col("id") != F.col("a")).select("job_ref", "a", F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    best = members.select("job_ref", "id", F.col("a").alias("first"), "copies").join(best.withColumnRenamed("id", "first"), ["job_ref", "first"], "left")
    best = best.select("job_ref", "id", F.when(F.col("copies") > 1, 1.0).otherwise(F.greatest(F.coalesce("max_sim", F.lit(0.0)), F.lit(0.0))).alias("max_sim"))
    return both.where("b is not null").select("job_ref", "a", "b", "sim").union(copies), best, pairs
