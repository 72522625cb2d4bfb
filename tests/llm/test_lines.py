import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import lines
from gleanery.llm.lines import line_dedup, positions


def brute(rows, min_words=50):
    """rows: (doc_id, text), ids distinct. {doc_id: text that stays, lines, lines that go}. All runs, by the definition."""
    seen, out = set(), {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        full = [i for i, n in enumerate(words) if n]
        gone = set()
        for j in range(len(full)):
            total = 0
            for k in range(j, len(full)):
                total += words[full[k]]
                if total >= min_words:
                    run = tuple(lines[i] for i in full[j : k + 1])
                    if run in seen:
                        gone |= set(full[j : k + 1])
                    seen.add(run)
        for x, y in zip(full[:-1], full[1:]):  # blank lines between two that go
            if x in gone and y in gone:
                gone |= set(range(x, y))
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def make(seed=1, n=150):
    r = random.Random(seed)
    pool = [f"line {i} {'x ' * r.choice([0, 3, 10, 60])}" for i in range(60)] + ["", "  ", "\t", "common"]
    some = ["\n".join(r.choice(pool) for _ in range(12)) for _ in range(9)]
    line = lambda i: r.choice(some) if r.random() < 0.2 else r.choice(pool) if r.random() < 0.7 else f"own {i} {r.random()}"
    return [(i, "\n".join(line(i) for _ in range(r.choice([0, 1, 2, 5, 12, 40])))) for i in range(n)]


def test_like_brute_force(spark):
    rows = make()
    rows += [(1000, rows[5][1]), (1001, "a\na\na\na"), (1002, None), (1003, ""), (1004, "\n\n"), (1005, "many\n" * 150), (1006, "é\nß\n\né\nß"), (1007, "a\tb " * 40_000), (1008, "y\n" + "a\tb " * 40_000 + "\n" + "a\tb " * 40_000)]
    for w in (1, 2, 7, 50):
        df = spark.createDataFrame([(t, d, "x", 3) for d, t in rows], "text string, doc_id long, doc string, mark int")
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(df, min_words=w).collect()}
        want = brute(rows, w)
        assert {d: got[d] for d in want} == want
        assert got[1002] == (None, 0, 0)
    assert sum(x[2] for x in want.values()) > 100
    assert line_dedup(df).columns == ["text", "doc_id", "doc", "mark", "n_lines", "n_removed"]


def test_matches_reach_both_ways(spark):
    """A run is followed to lines that begin or end no window of their own; separators other than blanks part words."""
    long, a, b = "w\t" * 60, "lead in", "tail of it"
    many = line_dedup(spark.createDataFrame([(1, "many\n" * 5000)], "doc_id long, text string")).first()
    assert (many["text"], many["n_lines"], many["n_removed"]) == ("many\n", 5001, 4999)
    rows = [(1, f"one\n{a}\n{long}\n{b}\nx1"), (2, f"two\n{a}\n{long}\n{b}\nx2"), (3, f"{' ' * 60}v"), (4, f"{' ' * 60}v")]
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 2: "two\nx2"}


def test_fingerprints_are_sparse(spark):
    """In text of short lines few lines are fingerprints, and every shared run has one in common."""
    r = random.Random(7)
    run = [f"{r.random()} {r.random()}" for _ in range(25)]
    docs = [(i, [f"{r.random()} z" for _ in range(100)] + run + [f"{r.random()} z" for _ in range(100)]) for i in range(2)]
    df = spark.createDataFrame([(i, 0, x) for i, x in docs], "doc_id long, mark long, lines array<string>")
    found = positions(df, 50).select("doc_id", "fp", "at").distinct().collect()
    assert len(found) < 0.2 * sum(len(x) for _, x in docs)
    inside = [{x["fp"] for x in found if x["doc_id"] == i and 100 <= x["at"] < 125} for i in range(2)]
    assert inside[0] & inside[1]


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b\nc d"), (1, "a b\nc d"), (1, "a b\nc d"), (2, "x\na b\nc d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup(df, min_words=4).collect()), key=repr)
    assert got == sorted([(None, "a b\nc d"), (1, "a b\nc d"), (1, "a b\nc d"), (2, "x")], key=repr)
    assert line_dedup(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(make(n=5), "doc_id long, text string")
    plan = line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_positions_hold_the_least_line_of_each_window(spark):
    r = random.Random(11)
    text = [f"{r.random()} " + "w " * r.randint(0, 9) for _ in range(700)]
    df = spark.createDataFrame([(1, 0, text)], "doc_id long, mark long, lines array<string>")
    h = [x[0] for x in df.select(F.explode("lines").alias("x")).select(F.xxhash64("x")).collect()]
    words = [len(x.split()) for x in text]
    seen = {}
    for p in positions(df, 50).collect():
        assert h[p["at"]] == p["fp"] and p["lines"] == h[p["first"] : p["first"] + len(p["lines"])]
        for k, w in enumerate(p["windows"]):
            a = p["first"] + k
            assert sum(words[a : w["end"]]) < 50 <= sum(words[a : w["end"] + 1]) and p["fp"] == min(h[a : w["end"] + 1])
            assert a <= p["at"] <= w["end"] < p["first"] + len(p["lines"])
            seen[a] = seen.get(a, 0) + 1
    whole = max(a for a in range(700) if sum(words[a:]) >= 50)
    assert seen == dict.fromkeys(range(whole + 1), 1)


def test_nothing_is_found_without_fingerprints(spark, monkeypatch):
    """Matches begin at positions with a shared fingerprint: with fingerprints that are no lines' hashes but places', no run is found."""
    rows = [(1, "q1\n" + "w " * 60 + "\nr1"), (2, "q2\n" + "w " * 60 + "\nr2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup(df).orderBy("doc_id").collect()] == [0, 1]
    own = lines.positions
    monkeypatch.setattr(lines, "positions", lambda docs, n: own(docs, n).withColumn("fp", F.xxhash64("doc_id", "at")))
    assert [r["n_removed"] for r in line_dedup(df).orderBy("doc_id").collect()] == [0, 0]


@pytest.mark.parametrize("n", [100_000])
def test_texts_of_very_many_lines(spark, n):
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.concat(F.lit("k"), x.cast("string"))), "\n")).alias("text"))
    got = line_dedup(df).select("doc_id", "n_lines", "n_removed", F.length("text").alias("left")).orderBy("doc_id").collect()
    assert [tuple(x)[1:3] for x in got] == [(n + 1, 0), (n + 1, n)] and got[1]["left"] == 1
