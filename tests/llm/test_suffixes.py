import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import suffixes
from gleanery.llm.suffixes import first_places, suffix_dedup


def brute(rows, length):
    """rows: (doc_id, text) with distinct ids. {doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(2, 6), st.randoms())
def test_two_stage_suffix_array(strings, length, r):
    text = np.frombuffer(b"".join(strings), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    key = list(range(len(text)))
    r.shuffle(key)
    place, gone = first_places(text, off, np.array(key), length)
    want = {}
    for k, s in enumerate(strings):
        for i in range(len(s) - length + 1):
            want.setdefault(s[i : i + length], []).append(int(off[k]) + i)
    assert sorted(place.tolist()) == sorted(p for x in want.values() for p in x)
    lost = {p for x in want.values() for p in x if key[p] != min(key[q] for q in x)}
    assert set(place[gone].tolist()) == lost


def make(seed=3, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé\n") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(r.choice([0, 2, 10, 60, 200])))
        for _ in range(r.choice([0, 0, 1, 2])):
            p, q = r.choice(passages), r.randint(0, len(t))
            t = t[:q] + p[r.randint(0, 60) : len(p) - r.randint(0, 60)] + t[q:]
        if rows and r.random() < 0.2:
            t = r.choice(rows)[1]
        if rows and r.random() < 0.1:
            t = r.choice(rows)[1] + "!"
        rows.append((i, t))
    rows += [(900, "a" * 350), (901, "ab" * 200), (902, "x" * 100), (903, "x" * 100), (904, "x" * 99), (905, ""), (906, None), (907, "\x00" * 150 + "z"), (908, "q\x00" * 90), (909, "y" * 101)]
    return rows


def test_like_brute_force(spark):
    rows = make()
    for length in (100, 40):
        df = spark.createDataFrame([(t, d, "m", 1) for d, t in rows], "text string, doc_id long, mark string, bucket int")
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(df, length=length).collect()}
        assert got == brute(rows, length)


def test_odd_rows(spark):
    r = random.Random(1)
    t = "".join(r.choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t), (2, "y" + t)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup(df).collect()), key=repr)
    assert got == sorted([(None, 300, 0), (1, 300, 0), (1, 300, 0), (2, 300, 300), (2, 301, 300)], key=repr)
    assert suffix_dedup(df.limit(0)).count() == 0


def test_long_texts_and_many_buckets(spark, monkeypatch):
    """Texts longer than a piece, with passages that stand far apart; small buckets and slices give the same."""
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz \n") for _ in range(n))
    passage, again = noise(700), noise(100)
    a = noise(900_000)
    rows = [(1, a[:450_000] + passage + a[450_000:] + again), (2, passage[10:650] + noise(700_000) + again + passage), (3, a[100_000:700_000]), (4, noise(50) + passage * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 100)
    assert want[3][1] == 600_000 and want[2][1] > 1400
    for bucket, part in ((suffixes.BUCKET, suffixes._SLICE), (4096, 50)):
        monkeypatch.setattr(suffixes, "BUCKET", bucket)
        monkeypatch.setattr(suffixes, "_SLICE", part)
        assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup(df).collect()} == want
