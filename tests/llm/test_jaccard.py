import random

import numpy as np
import pytest
from helpers import components, shingle_set
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import jaccard
from gleanery.operators.graph import connected_components


def brute_links(sets, percent=80):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if 100 * n >= percent * (len(a) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    return [root(x) for x in range(len(sets))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 24), min_size=1), min_size=2, max_size=12), st.sampled_from([50, 80]))
def test_links_connect_like_brute_force(found, percent):
    sets = [np.array(sorted(s), np.uint64) for s in found]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in jaccard.links(sets, percent):
        parent[root(i)] = root(j)
    assert same_partition([root(x) for x in range(len(sets))], brute_links(sets, percent))


def corpus(n=220, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)]
    rows, texts = [], []
    passage = " ".join(r.choice(vocab) for _ in range(30))
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            w = r.choice(texts[-12:]).split()
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.6:
            t = " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5])))
        else:
            t = " ".join(r.choice(vocab) for _ in range(r.randint(6, 120))) + (" " + passage if kind > 0.8 else "")
        if r.random() < 0.2:
            t = t.upper().replace(" ", "\n")
        texts.append(t)
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, texts[5]), (7, texts[3]), (7, texts[3]), (503, "x " * 30000)]
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, node string, component_id int")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()]
    comp, size = components(rows)
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(got, key=key) == sorted(((r[0], n, c) for r, n, c in zip(rows, size, comp, strict=True)), key=key)


def test_components_like_brute_force(spark):
    check(spark, corpus())


def test_large_groups_go_in_blocks(spark, monkeypatch):
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    check(spark, rows)


def test_many_rows_of_near_copies_of_several_lengths(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(300)}" for _ in range(160)]
    rows = []
    for i in range(260):
        w = base[: r.choice([90, 96, 104, 118, 131, 150, 160])]
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_covers_keep_neighbours_near():
    r = random.Random(3)
    for _ in range(200):
        size = np.sort(np.array([r.choice([5, 6, 7, 100, r.randint(1, 2000)]) for _ in range(r.randint(1, 60))]))
        at = jaccard._cover(size)
        assert at[0] == 0 and at[-1] == len(size) - 1 and (np.diff(at) > 0).all()
        assert all(j == i + 1 or size[j] * 0.9 <= size[i] for i, j in zip(at[:-1], at[1:], strict=True))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).count() == 0


def test_large_families_of_several_groups(spark, monkeypatch):
    """Families in which little links to a hub: chains, several lengths, and two groups held together by a common passage."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "CELLS", 700)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(400)}"
    chain, rows = [word() for _ in range(100)], []
    for i in range(40):
        chain = [*chain[4:], *(word() for _ in range(4))]
        rows.append((i, " ".join(chain)))
    passage = [word() for _ in range(60)]
    for g in range(3):
        base = [word() for _ in range(40)]
        for i in range(12):
            w = [*base, *passage]
            w[r.randrange(40)] = f"x{r.randrange(10**6)}"
            rows.append((1000 + 100 * g + i, " ".join(w)))
    check(spark, rows)
    check(spark, corpus(120, 5))


def test_long_texts_with_a_common_passage_are_no_family(spark, monkeypatch):
    """Only texts that may link have their sets read again and sent, though no counter tells the passage from what is rare."""
    r = random.Random(5)
    word = lambda: r.choice(["the", "of", "and"]) if r.random() < 0.5 else f"w{r.randrange(10**6)}"
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(700)) + " " + passage) for i in range(60)]
    near = [(100 + i, t.replace("the", "a", 3)) for i, t in rows[:2]]
    total = jaccard.total
    monkeypatch.setattr(jaccard, "total", lambda rows, size, *kind: np.full(size, 5000) if size == jaccard.SKETCH else total(rows, size, *kind))
    read, real = [], jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda scratch, sets, percent: read.append(sets.count()) or real(scratch, sets, percent))
    check(spark, rows + near)
    assert read == [4]


def test_ranks_put_rare_words_first_when_counters_are_full():
    """Every counter holds the same load; the words tell what is common by chance."""
    words = np.full(jaccard.WORDS, 3)
    words[7] = 10**7
    of_words, counter = jaccard.by_chance(words, np.full(1 << 10, 5000))
    s = np.arange(1, 5, dtype=np.uint64) << np.uint64(50)
    chance = np.array([5 * of_words[7], 5 * of_words[1], 4 * of_words[7] + of_words[1], 5 * of_words[1]], np.int64)
    order = np.argsort(jaccard.ranks(s, chance, counter, 5_000_000), kind="stable").tolist()
    assert order == [1, 3, 2, 0]


@pytest.mark.parametrize("small", [1, 2, 4])
def test_candidates_connect_all_that_link(spark, monkeypatch, small):
    """Runs of any length count as long ones, in tasks and in buckets; what links is connected by pairs, by joints, or by both together."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    r, named = random.Random(small), {}
    texts = []
    for _ in range(14):
        base = [f"w{r.randrange(60)}" for _ in range(r.randint(30, 130))]
        for _ in range(9):
            w = base[r.randint(0, 3) :]
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w + (["p"] * r.randint(0, 2) + [f"p{k}" for k in range(12)]) * (r.random() < 0.5)))
    sets = [np.array(sorted(named.setdefault(x, r.getrandbits(64)) for x in sorted(shingle_set(t))), np.uint64) for t in texts]
    sets = list({s.tobytes(): s for s in sets}.values())
    name = [jaccard.node_of(s) for s in sets]
    rows, entries = [], []
    for task in range(3):
        held = []
        for k in range(task, len(sets), 3):
            n = len(sets[k])
            most = min(n, n - jaccard.needed(n, 80) + jaccard.shared_prefix(n))
            held.append((sets[k][:most], np.full(most, name[k]), np.full(most, n, np.uint16)))
        sent, stars, often = jaccard._ahead(*(np.concatenate(x) for x in zip(*held, strict=True)), 80)
        entries.append(sent)
        rows += [(2, int(a), int(b), 0, 0) for a, b in zip(*stars, strict=True)] + [(3, int(a), 0, int(n), int(x)) for a, n, x in zip(*often, strict=True)]
    pairs, stars, often = jaccard._candidates(*(np.concatenate(x) for x in zip(*entries, strict=True)), 80)
    rows += [(1, *map(int, x)) for x in zip(*pairs, strict=True)] + [(2, int(a), int(b), 0, 0) for a, b in zip(*stars, strict=True)] + [(3, int(a), 0, int(n), int(x)) for a, n, x in zip(*often, strict=True)]
    met = spark.createDataFrame(rows, "kind int, a long, b long, weight long, need long")
    root = {x["node"]: x["component"] for x in connected_components(jaccard._candidate_edges(met), "a", "b").collect()}
    linked = brute_links(sets)
    assert 14 <= len(set(linked)) < len(sets) - 40
    assert all(root.get(name[i]) == root.get(name[linked[i]], 0) for i in range(len(sets)) if linked[i] != i)
