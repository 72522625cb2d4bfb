import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import collocations as C
from gleanery.llm.collocations import collocations, frequent_phrases


def grams(text, most):
    low = (text or "").encode().lower().decode()  # bytes: A-Z only
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
        w = re.findall(r"[^\x20\x09]+", piece)
        for k in range(1, most + 1):
            for i in range(len(w) - k + 1):
                yield tuple(w[i : i + k])


def brute(rows, most=3, least=10, inside=50, top=2000):
    """rows: (lang, text)."""
    f = {}
    for lang, text in rows:
        f.setdefault(lang or "und" if lang != "" else "", Counter()).update(grams(text, most))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: v for g, v in c.items() if len(g) > 1 and v >= least}
        found = []
        for g, a in cand.items():
            if any(len(x) > len(g) and 100 * v >= inside * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, v in cand.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-s, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed=3):
    r = random.Random(seed)
    vocab = ["The", "the", "of", "Élan", "élan", "x", "new", "york", "city", "a\x00b", "ß", " ", "東京", "'s"]
    weights = [9, 9, 9, 1, 1, 3, 4, 4, 4, 1, 1, 1, 1, 2]
    rows = []
    for _ in range(160):
        words = []
        for _ in range(r.choice([0, 1, 5, 40])):
            words += r.choice([["new", "york", "city"], ["New", "York"], *[[r.choices(vocab, weights)[0]] for _ in range(6)]])
        rows.append((r.choice(["en", "en", "en", "de", None, "und", ""]), "".join(w + r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?"]) for w in words)))
    rows += [("en", None), ("de", ""), (None, " .,; "), ("en", "same same same same " * 60), ("en", "one very common line " * 5)] + [("fr", "copies of a text")] * 12
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*x, 1) for x in corpus()], "lang string, text string, phrase int").repartition(5).cache()


@pytest.mark.parametrize("share", [0.0, 0.25, 1.0])
def test_like_brute_force_whatever_the_sample(table, share):
    assert sorted(map(tuple, collocations(table, share=share).collect())) == brute(corpus())


@pytest.mark.parametrize(("most", "least", "inside", "top"), [(2, 3, 50, 5), (4, 3, 100, 2000), (5, 2, 1, None)])
def test_other_lengths_and_limits(table, most, least, inside, top):
    got = collocations(table, most_words=most, least=least, inside=inside, top=top)
    assert sorted(map(tuple, got.collect())) == brute(corpus(), most, least, inside, top or 10**9)


def test_border_failures_lead_to_further_passes(table):
    """Without a sample every word is border; pairs and triples follow in passes of their own, each phrase in one of them."""
    texts = table.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    none, passes = frequent_phrases(texts, share=0.0)
    assert passes == 3
    whole, once = frequent_phrases(texts, least=2, share=1.0)
    assert once == 1
    assert none.groupBy("lang", "phrase").count().where("count > 1").count() == 0
    assert {tuple(x) for x in none.select("lang", "phrase", "n").collect()} <= {tuple(x) for x in whole.select("lang", "phrase", "n").collect()}


def test_few_failures_of_the_sample_need_no_further_pass(spark):
    """What the sample never saw is spelled out and counted in the last pass, longer phrases of such words too."""
    common = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([("en", f"{common}. rare pair here. id{i}") for i in range(80)], "lang string, text string")
    unseen = rows.where(F.xxhash64("text", "lang").bitwiseAND((1 << 30) - 1) >= 1 << 28).limit(10)
    plain = spark.createDataFrame([("en", f"{common}. no{i}") for i in range(80)], "lang string, text string")
    texts = spark.createDataFrame([tuple(x) for x in unseen.union(plain).collect()], "lang string, text string")
    _, passes = frequent_phrases(texts)
    assert passes == 1
    got = sorted(map(tuple, collocations(texts).collect()))
    assert got == brute([tuple(x) for x in texts.collect()])
    assert ("rare pair here", 10, 10, 10) in {x[2:6] for x in got}


def test_many_ranges_and_short_buffers(table, monkeypatch):
    """Hashes in many ranges, sent after every piece, and phrases that a task sends several times."""
    monkeypatch.setattr(C, "RANGE", 64)
    monkeypatch.setattr(C, "HASHES", 100)
    monkeypatch.setattr(C, "HELD", 1000)
    assert sorted(map(tuple, collocations(table).collect())) == brute(corpus())


def test_scores_of_large_counts_are_exact(spark):
    """a * a * 10^6 passes 64 bits."""
    a = 5_000_003
    n = spark.range(1).select(F.lit("en").alias("lang"), F.concat(F.repeat(F.lit("p q. "), a), F.repeat(F.lit("p. "), 7)).alias("text"))
    got = [tuple(x) for x in collocations(n).collect()]
    assert got == [("en", 1, "p q", a, a + 7, a, 2 * a + 7, 1_000_000 * a * a // ((a + 7) * a))]


def test_empty_and_wordless(spark, table):
    assert collocations(table.limit(0)).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("x", " ")], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations(table, most_words=1)
