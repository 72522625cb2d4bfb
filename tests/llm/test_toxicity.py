import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import toxicity as tox
from gleanery.llm.toxicity import ADDRESSED, ANNOUNCED, DIRECTED, INSULT, INTENSIFIER, MODAL, NEGATED, NEGATION, OTHER, REPORT, REPORTED, STRONG, TARGET, THREAT, THREAT_NEGATED, THREAT_REPORTED, Lexicon, Machine


def cascade(symbols):
    """The transducers one after another, each over what the one before wrote."""
    weight = [0.0] * len(symbols)
    for t in (tox.negation(), tox.reported_speech(), tox.insults(), tox.threats(), tox.targets()):
        out = t.run(symbols)
        symbols = [y for y, _ in out]
        weight = [a + w for a, (_, w) in zip(weight, out, strict=True)]
    return list(zip(symbols, weight, strict=True))


def test_composition_is_the_cascade():
    machine = tox.grammar()
    for n in range(1, 6):
        for x in itertools.product(range(8), repeat=n) if n < 5 else [tuple(random.Random(n * k).choices(range(8), k=12)) for k in range(3000)]:
            assert machine.read(list(x)) == cascade(list(x))
    assert len(machine.table) < 500


@pytest.mark.parametrize(
    ("read", "write"),
    [
        ([OTHER, INSULT], [OTHER, INSULT]),
        ([TARGET, OTHER, INSULT], [TARGET, OTHER, DIRECTED]),
        ([NEGATION, OTHER, INSULT, INSULT], [NEGATION, OTHER, NEGATED, INSULT]),
        ([NEGATION, OTHER, OTHER, OTHER, INSULT], [NEGATION, OTHER, OTHER, OTHER, INSULT]),
        ([INTENSIFIER, INSULT], [INTENSIFIER, STRONG]),
        ([TARGET, REPORT, OTHER, INSULT], [TARGET, REPORT, OTHER, REPORTED]),
        ([REPORT, MODAL, THREAT, TARGET], [REPORT, MODAL, THREAT_REPORTED, TARGET]),
        ([TARGET, MODAL, THREAT, TARGET], [TARGET, MODAL, ANNOUNCED, TARGET]),
        ([THREAT], [THREAT]),
        ([MODAL, NEGATION, THREAT], [MODAL, NEGATION, THREAT_NEGATED]),
        ([INSULT, TARGET], [INSULT, ADDRESSED]),
    ],
)
def test_readings_of_a_clause(read, write):
    assert [y for y, _ in tox.grammar().read(read)] == write


def scored(texts, lexicon=None, weights=tox.PRIOR):
    raw = [(t or "").encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    x = tox.features(np.frombuffer(b"".join(raw), np.uint8), off, (lexicon or Lexicon(tox.hand_written())).compiled(), tox.grammar())
    return tox.Model(None, weights).score(x).tolist()


def test_clauses_not_words_decide():
    plain, negated, reported, quoted, apart, strong = scored(["You are an idiot.", "You are not an idiot.", "He said they were an idiot.", 'Then came "idiot" again.', "You are late. Not an idiot.", "You are such an IMBÉCILE"])
    assert plain > 0.8 and strong > 0.5 and max(negated, reported, quoted, apart) < 0.5
    threat, bare, denied = scored(["we will kill you all", "a moth dies and they kill the light", "I will never hurt you"])
    assert threat > bare > denied and threat > 0.5 > bare
    assert scored([None, "", "nothing here", " \n.. !"]) == scored([None] * 4)


def test_clauses_come_out_with_their_text(spark):
    df = spark.createDataFrame([(1, "Fine. You ÉCRIT idiot! Good\nno harm"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(x) for x in tox.toxic_clauses(df, Lexicon(tox.hand_written())).collect()]
    assert [(d, c, [tox.MARKS[m] for m in marks]) for d, c, _, marks in got] == [(1, "You ÉCRIT idiot", [REPORTED])]


def corpus(n=900, seed=5):
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "ung", "en", "so", "ri", "ta", "bel"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    rows = []
    for k in range(n):
        bad = r.random() < 0.25
        words = [word() + r.choice(["", "", "", ".", "\n"]) for _ in range(r.choice([12, 60, 300]))]
        for i in range(len(words)):
            if bad and r.random() < 0.06 or i == 0 and bad:
                words[i] = r.choice(["blork", "zwuck" + r.choice(syllables), "idiot"])
        rows.append((k, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t, _ in rows], "doc_id long, text string, lang string, label int").repartition(4).cache()
    labels = spark.createDataFrame([(d, y, 1) for d, _, y in rows], "doc_id long, toxic int, quality int").cache()
    return docs, labels, {d: y for d, _, y in rows}


def test_held_out_accuracy_and_learned_words(tables):
    docs, labels, truth = tables
    model = tox.train(docs, labels)
    assert model.lexicon.words["blork"][0] == INSULT and any(s.startswith("zwuck") for s in model.lexicon.stems)
    assert not any(w in model.lexicon.words for w in ("ka", "lo", "kalo", "ung"))
    got = tox.toxicity_scores(docs, labels).collect()
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x["held_out"]]
    assert len(held) > 100 and sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)


def test_nothing_is_learned_from_rows_set_aside(tables):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tox.train(docs, labels), tox.train(docs, turned)
    assert a.lexicon == b.lexicon and np.array_equal(a.weights, b.weights)


def test_copies_are_one_witness(spark, tables):
    """A text copied 200 times teaches its words no better than once."""
    docs, labels, _ = tables
    copies = spark.range(10_000, 10_200).select(F.col("id").alias("doc_id"), F.lit("quite harmless gremmelkin words stand here").alias("text"), F.lit("x").alias("lang"), F.lit(0).alias("label"))
    more = labels.unionByName(copies.select("doc_id", F.lit(1).alias("toxic"), F.lit(1).alias("quality")))
    model = tox.train(docs.unionByName(copies), more)
    assert "gremmelkin" not in model.lexicon.words and not any("gremmelkin".startswith(s) for s in model.lexicon.stems)


def test_odd_rows_and_few_labels(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(None, "you idiot"), (3, None), (3, None), (4, ""), (5, "you idiot " * 60_000), (6, "word " * 300_000)], "doc_id long, text string")
    none = labels.limit(0)
    got = {x["doc_id"]: x for x in tox.toxicity_scores(odd, none).collect()}
    assert got[None]["predicted"] == 1 and not got[None]["held_out"] and got[3]["score"] == got[4]["score"] == got[6]["score"] < 0.5 < got[5]["score"]
    assert tox.toxicity_scores(odd, none).count() == 6 and tox.toxicity_scores(odd.limit(0), labels).count() == 0
    strange = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert tox.toxicity_scores(odd, strange).count() == 6
    assert Machine(tox.negation()).read([NEGATION, INSULT])[1][0] == NEGATED
