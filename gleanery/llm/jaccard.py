"""N-gram Jaccard join: near duplicates by T-occurrence search.

Every text is the set of its distinct word shingles, as 64-bit hashes; texts with
equal sets are one node, named by a hash of the set, so copies cost nothing more.
1. A pass over the texts finds the nodes and fills counting sketches of fixed size,
   of shingles and of words. They set the order of shingles (rare first) and nothing
   else. What common words make by chance is added to a shingle's counter with weight,
   so it is known for common at any size, when the load of the counters has long hidden it.
2. Two sets that link share at least l of their first n - ceil(0.8 n) + l
   shingles in that order; l is 1 and a twentieth of the set. These prefixes are
   dealt by shingle. Nodes that share a shingle are candidates: in runs of up to
   SMALL nodes by pair, counted over all shingles; longer runs become stars
   between nodes of fitting size, so no run makes more rows than a multiple of
   its length. How often a node is in longer runs is counted, and one with fewer of
   them than l stays out of stars: a passage in many long texts connects none of them.
3. Connected candidates are a family. Only their texts are read again (a bitmap of
   fixed size tells most others apart before the join). Its whole sets go to one task, and a
   T-occurrence search with DivideSkip finds links: short inverted lists are merged
   by a heap, long ones probed by binary search, and texts that reach the overlap
   are united. Nodes already united with the first one needn't be searched for
   again, so a large group of near copies takes few searches.
   A family beyond BLOCK nodes or CELLS shingles is cut into blocks. Each block names
   the node whose shingles are most common in it, and the best few of these (hubs)
   meet all blocks; what links to the best hub is one group already. Only the rest is
   searched for against all blocks, so a large group of near copies of one text costs
   about its size; a family in which little links to a hub costs the square of its
   number of blocks.
4. Components of the links give each text the smallest doc_id that it reaches.

Sets are compared by 64-bit hashes, whose chance of a false match is about the
number of compared shingles over 2**64. Rows with equal doc_id are separate rows.
Null and empty texts have no shingles, link with nothing and keep their own
doc_id; a null doc_id takes no part and has a null component. Other columns are
ignored. Jobs run while the result is built, for sketches, components and families.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.lineage import Scratch
from .arrays import by_key, emit, packed, total
from .textbytes import BLANK, LOWER, Texts, column, forget, mix, pieces, shingle_sequence, weighed_shingles

#: Counters of shingles and of words, and bits of the bitmap of texts that are read again.
SKETCH, WORDS, FLAGS = 1 << 20, 1 << 18, 1 << 22
#: Steps of a logarithm for each doubling, weight of a count by chance beside that of a counter, and the largest count.
STEPS, CHANCE, _MOST = 16, 16, (1 << 24) - 1
SMALL, BLOCK = 8, 512
#: Shingles in a block, and nodes of a family that its blocks meet first.
CELLS, HUBS = 1 << 19, 3
#: Parts that a large group is spread over in joins.
SALTS = 8
#: Entries of prefixes (15 bytes) in a bucket.
BUCKET = 1 << 19
_ENTRY, _PAIR, _STAR, _OFTEN = range(4)
#: Prefix entries that a task holds before it sends them.
_FLUSH = 400_000


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def shared_prefix(n):
    """l: how many shingles of the prefix a pair has to share at least (of the smaller set)."""
    return 1 + n // 20


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    x = mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of batches with their texts (column 1)."""
    for batch in batches:
        buf, off = column(batch.column(1))
        for lo, hi in pieces(off):
            yield batch.slice(lo, hi - lo), Texts(LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1])


def _sets(g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [np.unique(g[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def by_chance(words: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logarithms of the words' shares, STEPS for each doubling; counters of shingles) of the sums of all tasks."""
    word = np.round(STEPS * (np.log2(np.maximum(words, 1)) - np.log2(max(int(words.sum()), 1))))
    return word.astype(np.int16), np.minimum(counter, _MOST).astype(np.uint32)


def ranks(s: np.ndarray, chance: np.ndarray, counter: np.ndarray, n: int) -> np.ndarray:
    """The order of shingles: rare first, by their counter and how often their words make them by chance among n; of equal ones by hash."""
    often = counter[(s & np.uint64(len(counter) - 1)).astype(np.int64)] + CHANCE * n * np.exp2(chance / STEPS)
    return (np.minimum(often, _MOST).astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))


def links(sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """Pairs that connect all sets (sorted distinct hashes) which links connect: T-occurrence search with DivideSkip."""
    count = len(sets)
    size = [len(s) for s in sets]
    off = np.concatenate([[0], np.cumsum(size)])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.concatenate([np.flatnonzero(new), [len(every)]])
    owner = np.repeat(np.arange(count), size)[order].tolist()
    list_of = np.empty(len(every), np.int64)
    list_of[order] = np.cumsum(new) - 1
    length = np.diff(at)
    begin = at.tolist()
    parent = list(range(count))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    weight = [int(length[list_of[off[x] : off[x + 1]]].sum()) for x in range(count)]
    first = max(range(count), key=lambda x: (weight[x], -x))
    for x in sorted(range(count), key=lambda x: (x != first, -weight[x], x)):
        if x != first and root(x) == root(first):
            continue  # what it links to is found from the other side
        least = needed(size[x], percent)
        mine = list_of[off[x] : off[x + 1]]
        mine = mine[length[mine] > 1]
        if len(mine) < least:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")].tolist()
        longest = int(length[mine[-1]])
        n_long = min(least - 1, int(least / (0.01 * log2(longest) + 1)))
        short, long = mine[: len(mine) - n_long], mine[len(mine) - n_long :][::-1]
        seen: dict[int, int] = {}
        for y in heapq.merge(*(owner[begin[t] : begin[t + 1]] for t in short)):
            seen[y] = seen.get(y, 0) + 1
        for y, hits in seen.items():
            if hits < least - n_long or y == x or root(y) == root(x):
                continue
            both = percent * (size[x] + size[y])
            target = max(-(-both // (100 + percent)), 1)
            if target > min(size[x], size[y]):
                continue
            left = len(long)
            for t in long:
                if hits >= target or hits + left < target:
                    break
                left -= 1
                i = bisect_left(owner, y, begin[t], begin[t + 1])
                hits += i < begin[t + 1] and owner[i] == y
            if hits >= target:
                parent[root(y)] = root(x)
                found.append((x, y))
    return found


def links_to(hubs: list[np.ndarray], sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """(k, i) where hub k and set i link."""
    found = []
    for k, h in enumerate(hubs):
        for i, s in enumerate(sets):
            if 100 * min(len(h), len(s)) >= percent * max(len(h), len(s)):
                both = int((h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s).sum())
                if 100 * both >= percent * (len(h) + len(s) - both):
                    found.append((k, i))
    return found


def _near_stars(size: np.ndarray, percent: int) -> np.ndarray:
    """For sizes in order: the first place of each stretch in which every next set is near enough in size."""
    near = 100 * size[:-1] >= percent * size[1:]
    return np.maximum.accumulate(np.concatenate([[0], np.where(near, 0, np.arange(1, len(size)))]))


def _cover(size: np.ndarray) -> np.ndarray:
    """Places that stand for sizes in order: next ones differ by a tenth at most, or nothing lies between them."""
    at = [0]
    while at[-1] < len(size) - 1:
        i = at[-1]
        at.append(max(i + 1, int(np.searchsorted(size, size[i] / 0.9, "right")) - 1))
    return np.array(at)


def _joint(node: np.ndarray) -> np.ndarray:
    """Names of the joints through which long runs connect their texts, by the first text of each."""
    return mix(node.view(np.uint64) ^ np.uint64(0x8CB92BA72F3D8DD7)).view(np.int64)


def _stars(joint: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (joint, node), without those of a joint with itself."""
    pairs = np.unique(np.stack([joint, node], 1)[joint != node], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _often(node: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, how many entries, how many shingles it shares at least with any text that it links to)."""
    name, at, count = np.unique(node, return_index=True, return_counts=True)
    return name, count, shared_prefix(needed(size[at].astype(np.int64), percent))


def _ahead(tok: np.ndarray, node: np.ndarray, size: np.ndarray, percent: int) -> tuple[tuple[np.ndarray, ...], ...]:
    """Of a task's prefix entries those to send, and whether they stand for a long run; the stars of long runs; and how often texts are in them.

    A shingle that many texts of a task have goes on by a few joints that cover their sizes, so what a very common
    one sends grows with the tasks and not with the texts.
    """
    order = np.lexsort((node, size, tok))
    tok, node, size = tok[order], node[order], size[order].astype(np.int64)
    fresh = np.ones(len(tok), bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
    tok, node, size = tok[fresh], node[fresh], size[fresh]
    start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    run = np.diff(np.append(start, len(tok)))
    hot = np.repeat(run > SMALL, run)
    send, name = ~hot, node.copy()
    for s, k in zip(start[run > SMALL].tolist(), run[run > SMALL].tolist(), strict=True):
        name[s : s + k] = _joint(node[_near_stars(size[s : s + k], percent) + s])
        send[s + _cover(size[s : s + k])] = True
    return (tok[send], name[send], size[send].astype(np.uint16), hot[send]), _stars(name[hot], node[hot]), _often(node[hot], size[hot], percent)


def _candidates(tok: np.ndarray, node: np.ndarray, size: np.ndarray, hot: np.ndarray, percent: int) -> tuple[tuple[np.ndarray, ...], ...]:
    """Of prefix entries of one bucket: pairs a < b of short runs, how many shingles speak for each, how many must; the stars of long runs; and how often texts are in them."""
    order = np.argsort(tok, kind="stable")
    t = tok[order]
    same = t[1:] == t[:-1]
    twice = np.zeros(len(t), bool)
    twice[1:] |= same
    twice[:-1] |= same
    order = order[twice]
    tok, node, size, hot = tok[order], node[order], size[order].astype(np.int64), hot[order]
    order = np.lexsort((~hot, node, size, tok))
    tok, node, size, hot = tok[order], node[order], size[order], hot[order]
    fresh = np.ones(len(tok), bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
    tok, node, size, hot = tok[fresh], node[fresh], size[fresh], hot[fresh]
    start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate([start, [len(tok)]]))
    long = (run > SMALL) | np.logical_or.reduceat(hot, start) if len(start) else np.zeros(0, bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(2, SMALL + 1):
        at = start[(run == k) & ~long]
        for i in range(k):
            for j in range(i + 1, k):
                left.append(at + i)
                right.append(at + j)
    left, right = np.concatenate(left), np.concatenate(right)
    fits = (100 * size[left] >= percent * size[right]) | (size[right] == 0xFFFF)
    left, right = left[fits], right[fits]
    need = shared_prefix(np.minimum(size[left], size[right]))
    a, b = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    pairs = a[head], b[head], np.diff(np.append(head, len(a))), need[head]
    name = node.copy()
    for s, k in zip(start[long].tolist(), run[long].tolist(), strict=True):
        head = _near_stars(size[s : s + k], percent) + s
        name[s : s + k] = np.where(hot[head], node[head], _joint(node[head]))
    whole = np.repeat(long, run)
    plain = whole & ~hot
    return pairs, _stars(name[whole], node[whole]), _often(node[plain], size[plain], percent)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) for each row of `df`."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))

    def name(batches):
        forget()
        counters = [np.zeros(n, np.int64) for n in (SKETCH, WORDS)]
        waiting: tuple[list[np.ndarray], ...] = ([], [])

        def count(least: int) -> None:
            for counter, held in zip(counters, waiting, strict=True):
                if held and sum(map(len, held)) >= least:
                    np.add(counter, np.bincount((np.concatenate(held) & np.uint64(len(counter) - 1)).astype(np.int64), minlength=len(counter)), out=counter)
                    held.clear()

        names = ["doc_id", "n_shingles", "node", "kind", "part", "task", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch, t in _texts(batches):
            in_words: list[np.ndarray] = []
            sets = _sets(*shingle_sequence(t, BLANK, words, in_words))
            waiting[0].extend(sets)
            waiting[1].append(in_words[0])
            count(SKETCH // 2)
            n = len(sets)
            columns = [batch.column(0), [len(s) for s in sets], [node_of(s) for s in sets], *([None] * n for _ in range(4))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        count(0)
        for kind, counter in enumerate(counters):
            for row in emit(counter):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([None], [None], [None], [kind], *([x] for x in row)), kinds, strict=True)], names=names)

    both = scratch.write(docs.mapInArrow(name, "doc_id long, n_shingles long, node long, kind int, part int, task int, data binary"))
    named = both.where("part is null").select("doc_id", "n_shingles", "node")
    of_words, of_shingles = (total(both.where(F.col("kind") == k), n) for k, n in ((1, WORDS), (0, SKETCH)))
    sketch = spark.sparkContext.broadcast(by_chance(of_words, of_shingles))
    n_shingles = named.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) + n_shingles * (100 - percent + 5) // 100 // BUCKET

    def prefixes(batches):
        word, counter = sketch.value
        held: list[tuple] = []
        n_held = 0

        def flush():
            entries, stars, often = _ahead(*(np.concatenate(x) for x in zip(*held, strict=True)), percent)
            held.clear()
            tok, *rest = entries
            rows = packed(_ENTRY, (tok >> np.uint64(32)) % np.uint64(buckets), (tok.astype(np.uint32), *rest))
            for kind, columns in ((_STAR, stars), (_OFTEN, often)):
                rows += packed(kind, columns[0].view(np.uint64) % np.uint64(buckets), columns)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])

        for batch, t in _texts(batches):
            valid = batch.column(0).is_valid().to_pylist()
            for ok, (s, chance) in zip(valid, weighed_shingles(t, lambda h: word[(h & np.uint64(WORDS - 1)).astype(np.int64)], k=words), strict=True):
                n = len(s)
                if not n or not ok:
                    continue
                most = min(n, n - needed(n, percent) + shared_prefix(n))
                head = np.argsort(ranks(s, chance, counter, n_shingles), kind="stable")[:most]
                held.append((mix(s[head]), np.full(most, node_of(s), np.int64), np.full(most, min(n, 0xFFFF), np.uint16)))
                n_held += most
            if n_held > _FLUSH:
                yield flush()
                n_held = 0
        if held:
            yield flush()

    def meet(key, table):
        entries: list[tuple] = []
        found: dict[int, list[tuple]] = {_PAIR: [], _STAR: [], _OFTEN: []}
        for kind, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
            if kind != _ENTRY:
                found[kind].append(tuple(np.frombuffer(d, np.int64).reshape(2 if kind == _STAR else 3, -1)))
                continue
            m = len(d) // 15
            part = lambda n, at, t: np.frombuffer(d, np.uint8, n * m, at * m).copy().view(t)  # noqa: B023, E731
            entries.append((part(4, 0, np.uint32), part(8, 4, np.int64), part(2, 12, np.uint16), part(1, 14, bool)))
        if entries:
            for kind, columns in zip(found, _candidates(*(np.concatenate(x) for x in zip(*entries, strict=True)), percent), strict=True):
                found[kind].append(columns)
        for kind, some in found.items():
            columns = [np.concatenate(x) for x in zip(*some, strict=True)]
            if kind == _STAR and some:
                columns = _stars(*columns)
            if kind == _OFTEN and some:
                columns.insert(1, np.zeros(len(columns[0]), np.int64))
            for i in range(0, len(columns[0]) if some else 0, 100_000):
                part = [pa.array(x[i : i + 100_000]) for x in columns]
                n = len(part[0])
                part += [pa.array(np.zeros(n, np.int64))] * (4 - len(part))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *part], names=["kind", "a", "b", "weight", "need"])

    met = scratch.write(by_key(docs.mapInArrow(prefixes, "bucket int, kind int, data binary"), ["bucket"], meet, "kind int, a long, b long, weight long, need long"))
    family = scratch.write(connected_components(_candidate_edges(met), "a", "b"))
    scratch.drop(met)
    of_node = named.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"))
    members = family.join(of_node, "node")
    blocks = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / CELLS)).cast("int").alias("n_blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = members.join(blocks, "component").select("node", "component", "n_blocks", "doc_id", _place("node", "n_blocks").alias("block"))

    def mark(batches):
        marked = np.zeros(FLAGS, np.int32)
        for batch in batches:
            marked[(mix(batch.column(0).to_numpy().astype(np.uint64)) & np.uint64(FLAGS - 1)).astype(np.int64)] = 1
        rows = list(zip(*emit(marked), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "task", "data"])

    flags = spark.sparkContext.broadcast(total(members.select("doc_id").mapInArrow(mark, "part int, task int, data binary"), FLAGS, np.int32) > 0)

    def wanted(batches):
        """Texts of members, and few others."""
        flag = flags.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.uint64)
            yield batch.filter(pa.array(flag[(mix(ids) & np.uint64(FLAGS - 1)).astype(np.int64)]))

    def whole_sets(batches):
        for batch, t in _texts(batches):
            sets = _sets(*shingle_sequence(t, BLANK, words))
            keep = [i for i, (s, x) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if node_of(s) == x]
            out = batch.select(["component", "n_blocks", "block", "node"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["component", "n_blocks", "block", "node", "data"])

    sets = docs.mapInArrow(wanted, docs.schema).join(members, "doc_id").select("doc_id", "text", "component", "n_blocks", "block", "node").mapInArrow(whole_sets, "component long, n_blocks int, block int, node long, data binary")
    sets = scratch.write(sets)
    scratch.drop(family)
    met, searched = _blocks(scratch, sets, percent)

    def search(key, table):
        node = table.column("node").to_pylist()
        data = {x: np.frombuffer(d, np.uint64) for x, d in zip(node, table.column("data").to_pylist(), strict=True)}
        node = sorted(data)
        found = links([data[x] for x in node], percent) if len(node) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], names=["src", "dst"])

    found = by_key(searched, ["component", "low", "high"], search, "src long, dst long")
    component = connected_components(found.union(met.select(F.col("hub").alias("src"), F.col("node").alias("dst"))))
    scratch.drop(sets)
    # large groups are spread; texts that are alone need no join but the first
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rooted = salted.join(spread(component), ["node", "salt"], "left").select("doc_id", "n_shingles", "node", "salt", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("root"))
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = rooted.join(spread(least), ["root", "salt"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id"), "node")


def _candidate_edges(met: DataFrame) -> DataFrame:
    """(a, b): edges that connect all texts that may link, of pairs, stars and counts (kind, a, b, weight, need).

    A text that is in fewer long runs than it shares shingles with any text it links to (poor) can't link by these alone:
    it stays out of stars, and its pairs speak for themselves with what long runs may add to them.
    """
    often = met.where(F.col("kind") == _OFTEN).groupBy("a").agg(F.sum("weight").alias("n"), F.max("need").alias("need"))
    often = often.select(F.col("a").alias("node"), "n", (F.col("n") >= F.col("need")).alias("rich"))
    star, pair = (met.where(F.col("kind") == k) for k in (_STAR, _PAIR))
    poor = often.where("not rich").select(F.col("node").alias("b"))
    stars = star.select("a", "b").distinct().join(poor, "b", "left_anti").select("a", "b")
    pairs = pair.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.min("need").alias("need"))
    for c in ("a", "b"):
        pairs = pairs.join(often.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("rich").alias(f"rich_{c}")), c, "left")
        pairs = pairs.where(F.col("weight") + F.coalesce(f"n_{c}", F.lit(0)) >= F.col("need"))
    both = F.coalesce("rich_a", F.lit(False)) & F.coalesce("rich_b", F.lit(False))
    return pairs.where((F.col("weight") >= F.col("need")) | ~both).select("a", "b").union(stars)


def _place(node: str, n_blocks: str) -> Column:
    """The block of a node."""
    return F.when(F.col(n_blocks) == 1, 0).otherwise(F.pmod(F.xxhash64(node), F.col(n_blocks)).cast("int"))


def _blocks(scratch: Scratch, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (hub, node) of large families to their best hub; and (component, low, high, node, data): the sets of each search."""
    one = sets.where("n_blocks = 1").select("component", F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "data")
    large = sets.where("n_blocks > 1")

    def weigh(key, table):
        node, data = table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
        _, which, count = np.unique(np.concatenate(data), return_inverse=True, return_counts=True)
        weight = np.add.reduceat(count[which], np.concatenate([[0], np.cumsum([len(x) for x in data])[:-1]])) / len(data)
        k = min(range(len(node)), key=lambda i: (-weight[i], node[i]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([node[k]], pa.int64()), pa.array([weight[k]], pa.float64())], names=["component", "node", "weight"])

    picked = by_key(large.select("component", "block", "node", "data"), ["component", "block"], weigh, "component long, node long, weight double")
    picked = picked.groupBy("component").agg(F.collect_list(F.struct("weight", "node")).alias("x")).select(F.explode(F.slice(F.sort_array("x", False), 1, HUBS)).alias("x")).select("x.node")
    hubs = large.join(picked, "node").select("component", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "node", "data", F.lit(True).alias("hub"))

    def meet(key, table):
        node, data = table.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
        is_hub = table.column("hub").to_pylist()
        hub, other = ([i for i, h in enumerate(is_hub) if h == kind] for kind in (True, False))
        found = [(node[hub[k]], node[other[i]]) for k, i in links_to([data[i] for i in hub], [data[i] for i in other], percent)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), *(pa.array([x[c] for x in found], pa.int64()) for c in range(2))], names=["component", "hub", "node"])

    met = scratch.write(by_key(large.select("component", "block", "node", "data", F.lit(False).alias("hub")).union(hubs), ["component", "block"], meet, "component long, hub long, node long"))
    best = met.groupBy("component", "hub").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    # a hub links to itself, so it is among those that are met
    met = met.join(best, ["component", "hub"])
    united = met.select("node")
    left = large.join(united, "node", "left_anti")
    n_left = left.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("data")) / (8 * CELLS))).cast("int").alias("n_left"))
    rest = left.join(n_left, "component").withColumn("own", _place("node", "n_left"))
    among = rest.select("component", "node", "data", "own", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("other"))
    among = among.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "data")
    # the texts that are one group already, in blocks of their own
    others = large.join(united, "node", "left_semi").select("component", "node", "data").join(n_left, "component")
    n_met = others.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("data")) / (8 * CELLS))).cast("int").alias("n_met"))
    to_met = rest.join(n_met, "component").select("component", F.col("own").alias("low"), F.explode(F.sequence(F.col("n_left"), F.col("n_left") + F.col("n_met") - 1)).alias("high"), "node", "data")
    others = others.join(n_met, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("low"), (F.col("n_left") + _place("node", "n_met")).alias("high"), "node", "data")
    return met, one.union(among).union(to_met).union(others)
