import random

from helpers import shingle_set

from gleanery.llm import decontaminate


def make(seed=5):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([2, 4, 6, 9, 15, 25, 40, 57, 90])))) for i in range(40)]
    docs = []
    for i in range(160):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 30, 300, 3000]))]
        for _ in range(r.choice([0, 1, 2])):
            q = r.choice(items)[1].split()
            if r.random() < 0.4:
                q[r.randrange(len(q))] = "changed"
            if r.random() < 0.2:
                q = q[len(q) // 2 :]
            p = r.randint(0, len(w))
            w[p:p] = q
        docs.append((i, " ".join(w).title()))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[3][1])]
    return docs, items + [(77, None), (78, ""), (79, items[4][1])]


def brute(docs, items, percent=80):
    out = []
    sets = [(i, shingle_set(t)) for i, t in items]
    for d, t in docs:
        mine = shingle_set(t)
        out += [(d, i, len(s), len(s & mine)) for i, s in sets if s and 100 * len(s & mine) >= percent * len(s)]
    return out


def test_like_brute_force(spark, monkeypatch):
    docs, items = make()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=repr)
    get = lambda: sorted([(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in decontaminate.contained(d, q).collect()], key=repr)
    assert get() == want and len(want) > 50
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 15)
    assert get() == want
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2000)
    assert get() == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(d, none).count() == 0
    assert decontaminate.contained(none.withColumnRenamed("item_id", "doc_id"), d.withColumnRenamed("doc_id", "item_id")).count() == 0
