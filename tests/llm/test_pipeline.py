import random

import pytest
from pyspark.sql import functions as F
from helpers import components, shingle_set
from test_decontaminate import brute as brute_contained
from test_lines import brute as brute_lines

import corpus_pipeline as cp
from gleanery.llm.quality import quality_scores


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: ". ".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(n))
    bench = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(6)]
    docs, shared = [], [text(3) + "\n" + text(3) for _ in range(3)]
    for i in range(160):
        t = "\n".join(text(1) for _ in range(r.randint(3, 9)))
        kind = r.random()
        if kind < 0.25:
            t = " ".join(w + "$$$" for w in t.split(" "))
        elif kind < 0.4 and docs:
            w = docs[-1][1].split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        elif kind < 0.45:
            long = text(10).split(" ")
            docs.append((1000 + i, " ".join(long), "en", "src2", 1))
            long[60] = "edited"
            t = " ".join(long)
        elif kind < 0.5:
            t += "\n" + r.choice(shared)
        elif kind < 0.6:
            t += "\n" + r.choice(bench)[1]
        docs.append((i, t, "en", "src0", len(t)))
    labelled = len(docs)
    docs += [(900, docs[0][1], "en", "src1", 5), (901, "", "en", "src1", 0), (902, None, None, None, None), (None, "no id", "en", "x", 5)]
    labels = [(i, 0 if "$$$" in t else 1, 0) for i, t, *_ in docs[:labelled]]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_like_plain_versions(spark, sf_dir):
    docs = cp.table(spark, sf_dir, "documents")
    before = rows(docs)
    scores = {r["doc_id"]: r["predicted"] for r in quality_scores(docs, cp.table(spark, sf_dir, "labels")).collect()}
    bench = [(r["item_id"], r["text"]) for r in cp.table(spark, sf_dir, "benchmark").collect()]
    seen = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            after = rows(out)
        if name == "quality":
            assert after == {d: t for d, t in before.items() if scores[d]}
            assert 0 < len(after) < len(before) and not any("$$$" in (t or "") for t in after.values())
        elif name == "lines":
            want = {d: t for d, (t, _, n) in brute_lines(list(before.items())).items() if not (n and not shingle_set(t))}
            assert after == want | {d: t for d, t in before.items() if d is None or t is None} and after != before
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] and before[r["doc_id"]] != r["text"])
        elif name == "near_duplicates":
            pairs = list(before.items())
            first, _ = components(pairs)
            assert after == {d: t for (d, t), c in zip(pairs, first, strict=True) if c == d} and len(after) < len(before)
        elif name == "decontamination":
            hit = {x[0] for x in brute_contained(list(before.items()), bench)}
            assert after == {d: t for d, t in before.items() if d not in hit} and len(after) < len(before)
        else:
            got = out.collect()
            assert {r["doc_id"] for r in got} == set(before) and all(r["round_trip"] for r in got)
            assert all((r["n_pieces"] is None) == (before[r["doc_id"]] is None) for r in got)
        seen.append(name)
        before, docs = after, out
    assert seen == ["quality", "lines", "near_duplicates", "decontamination", "encoding"]


def test_run(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_pieces", "ids_sha256", "round_trip", "ids"]
    assert 0 < got.count() < len(rows(cp.table(spark, sf_dir, 'documents')))


def test_rows_of_equal_and_null_ids(spark, sf_dir):
    r = random.Random(4)
    text = lambda: " ".join(r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    item = cp.table(spark, sf_dir, "benchmark").first()["text"]
    same = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda stage, rows: sorted(((x["doc_id"], x["text"]) for x in stage(spark, same(rows), sf_dir).collect()), key=repr)
    rows = [(5, a), (5, a), (3, b), (7, b), (7, c), (None, d), (None, d), (None, a), (8, ""), (8, ""), (9, None)]
    assert got(cp.near_duplicates, rows) == sorted([(5, a), (3, b), (7, c), (None, d), (8, ""), (8, ""), (9, None)], key=repr)
    rows = [(1, a), (1, b + " " + item), (None, item), (None, c), (2, item), (2, item), (4, None)]
    assert got(cp.decontamination, rows) == sorted([(1, a), (None, c), (4, None)], key=repr)


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    # nothing to learn from and no item: only copies go
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_further_columns_stay(spark, sf_dir):
    names = ["row", "_row", "_of", "_key", "mark", "lines", "kept", "runs", "n_lines", "n_removed", "component_id", "node", "item_id", "ids", "score", "features"]
    plain = cp.table(spark, sf_dir, "documents")
    docs = plain.select("*", *(F.concat(F.lit(n + " "), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in names))
    for name, stage in cp.STAGES:
        out, want = stage(spark, docs, sf_dir), stage(spark, plain, sf_dir)
        if name == "encoding":
            assert out.count() == want.count()
            break
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert out.where(" or ".join(f"`{n}` != concat('{n} ', coalesce(doc_id, -1))" for n in names)).count() == 0
        docs, plain = out, want


def test_near_duplicates_write_texts_once(spark, monkeypatch):
    written, real = [], cp.Scratch.write
    monkeypatch.setattr(cp.Scratch, "write", lambda self, df: written.append(df.schema.simpleString()) or real(self, df))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in cp.near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert written[0].count("text:string") == 1
