"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are what `\\n` separates, words `[^\\x20\\x09-\\x0D]+`; lines without a word are
skipped over. A run is some lines in a row with `min_words` words or more. A line is
deleted where it lies in a run that also stands earlier: in a document with a
smaller doc_id, or earlier in the same one. Blank lines go that stand between two
lines that go. All is judged on the input, so the first place of a run stays whole.

1. A window begins at each line and takes lines until it has `min_words` words. The
   least line hash in it (of equal ones the last) is its fingerprint. Fingerprints move
   forward only, so the windows of one lie side by side: a position holds a fingerprint,
   its windows and the line hashes around it as far as these reach. Any run that two
   places share has a window in common, and so a position with the same fingerprint at the
   same line of the run. Nothing but positions goes on.
2. Positions are joined by fingerprint: those whose fingerprint stands at two places stay.
3. Each is extended both ways from the fingerprint: line by line to the left up to where a
   window of it begins, and to the right up to that window's end and on to where the next
   window is whole (from there that one goes on). Every extension is a match key, hashed
   outwards from the fingerprint, and joined to the first position with the same one. So
   a run is followed even where it is continued in another document than it began in, and
   positions meet their first one only: a very common line costs no more than its number
   of places. Joins are salted.
4. What also stands earlier is joined to stretches, and these go.

Texts are read in stretches of STRETCH lines, so a text of a million lines is no larger in
memory than its lines.

Null ids and null texts are left as they are and compared with nothing; texts with
fewer words than a run, and empty ones, stay. Rows with equal doc_id are ordered by a
hash of the text, and equal rows are one document. All columns of the table stay;
`n_lines` and `n_removed` are added, over columns of that name. Jobs run while the
result is built; what they wrote is dropped but for the runs that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch

WORD = r"[^\x20\x09-\x0D]"
#: Parts that a common fingerprint or window is spread over in joins.
SALTS = 8
#: Lines that a text is read in at once, and lines that mostly hold a window and what it is extended by.
STRETCH, FEW = 256, 8


def _window(piece: Column, i: Column, min_words: int) -> Column:
    """The window that begins at line i of the lines (h, words): end, lines after it up to where the next window is whole, fingerprint and its place; null where the text ends before."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("end"), F.lit(0).alias("more"), F.lit((1 << 63) - 1).alias("fp"), F.lit(0).alias("fp_at"), F.lit(0).alias("n"))

    def read(s: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            words = a["words"] + x["words"]
            open_ = a["words"] < min_words
            least = open_ & (x["h"] <= a["fp"])
            # a line after the window makes a longer run until the next window is whole
            longer = ~open_ & (words - s[0]["words"] < min_words)
            return F.struct(
                words.alias("words"),
                F.when(open_, a["n"]).otherwise(a["end"]).alias("end"),
                (a["more"] + longer.cast("int")).alias("more"),
                F.when(least, x["h"]).otherwise(a["fp"]).alias("fp"),
                F.when(least, a["n"]).otherwise(a["fp_at"]).alias("fp_at"),
                (a["n"] + 1).alias("n"),
            )

        done = lambda a: F.struct((i + a["end"]).alias("end"), a["more"].alias("more"), a["fp"].alias("fp"), (i + a["fp_at"]).alias("fp_at"))
        return F.aggregate(s, zero, step, lambda a: F.when(a["words"] >= min_words, done(a)))

    # a window and what it is extended by have at most min_words + 1 lines, as each has a word; mostly FEW do
    few = F.slice(piece, i + 1, FEW)
    enough = F.aggregate(few, F.lit(0), lambda a, x: a + x["words"]) - piece[i]["words"] >= min_words
    return F.when(enough, read(few)).otherwise(read(F.slice(piece, i + 1, min_words + 1)))


def positions(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, mark, fp, at, first, lines, windows) of docs (doc_id, mark, lines): positions of fingerprints.

    Lines with a word are numbered from 0. A position's windows begin at the lines from `first` on; `lines` are the hashes
    from there on, as far as they reach, and windows have their end and the number of lines after it.
    """
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD + "+")).alias("words"))
    d = docs.select("doc_id", "mark", F.filter(F.transform("lines", line), lambda x: x["words"] > 0).alias("seq")).where(F.size("seq") > 0)
    n = F.size("seq")
    stretch = lambda c: F.struct(c.alias("base"), F.slice("seq", c + 1, F.lit(STRETCH + min_words + 1)).alias("piece"), F.least(F.lit(STRETCH), n - c).alias("n"))
    d = d.select("doc_id", "mark", F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(STRETCH)), stretch)).alias("s")).select("doc_id", "mark", "s.*")
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _window(F.col("piece"), i, min_words))
    d = d.select("doc_id", "mark", "base", "piece", F.filter(every, lambda w: w.isNotNull()).alias("w")).where(F.size("w") > 0)
    w = F.col("w")
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (w[i]["fp_at"] != w[F.greatest(i - 1, F.lit(0))]["fp_at"]))
    d = d.withColumn("begins", begins)

    def position(i: Column, k: Column) -> Column:
        to = F.coalesce(F.get("begins", k + 1), F.size("w"))
        end = w[to - 1]["end"] + w[to - 1]["more"]
        reach = F.array_max(F.transform(F.slice(w, i + 1, to - i), lambda x: x["end"] + x["more"]))
        own = F.transform(F.slice(w, i + 1, to - i), lambda x: F.struct((F.col("base") + x["end"]).alias("end"), x["more"].alias("more")))
        hashes = F.transform(F.slice("piece", i + 1, F.greatest(end, reach) - i + 1), lambda x: x["h"])
        return F.struct(w[i]["fp"].alias("fp"), (F.col("base") + w[i]["fp_at"]).alias("at"), (F.col("base") + i).alias("first"), hashes.alias("lines"), own.alias("windows"))

    return d.select("doc_id", "mark", F.explode(F.transform("begins", position)).alias("p")).select("doc_id", "mark", "p.*")


def extended(shared: DataFrame) -> DataFrame:
    """(doc_id, mark, salt, fp, a, b, key): each extension of a position to lines a to b, with a key that is hashed outwards from the fingerprint."""
    w = shared.select("doc_id", "mark", "salt", "fp", "at", "first", "lines", F.posexplode("windows").alias("k", "w")).withColumn("a", F.col("first") + F.col("k"))
    place = F.col("at") - F.col("first")
    left = F.reverse(F.slice("lines", F.col("k") + 1, place - F.col("k")))
    right = F.slice("lines", place + 2, F.col("w")["end"] + F.col("w")["more"] - F.col("at"))
    start = F.aggregate(left, F.xxhash64("fp", place - F.col("k")), lambda s, x: F.xxhash64(s, x))
    none = F.array().cast("array<bigint>")
    whole = F.col("w")["end"] - F.col("at")

    def step(s: Column, x: Column) -> Column:
        key = F.xxhash64(s["key"], x)
        return F.struct(key.alias("key"), (s["n"] + 1).alias("n"), F.when(s["n"] + 1 >= whole, F.array_append(s["keys"], key)).otherwise(s["keys"]).alias("keys"))

    zero = F.struct(start.alias("key"), F.lit(0).alias("n"), F.when(whole == 0, F.array(start)).otherwise(none).alias("keys"))
    keys = F.aggregate(right, zero, step, lambda s: s["keys"])
    w = w.select("doc_id", "mark", "salt", "fp", "a", F.col("w")["end"].alias("end"), F.posexplode(keys).alias("more", "key"))
    return w.select("doc_id", "mark", "salt", "fp", "a", (F.col("end") + F.col("more")).alias("b"), "key")


def _salted(df: DataFrame) -> DataFrame:
    """Rows once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def later_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, mark, a, b): spans of numbered lines a to b that also stand earlier; written to a table."""
    scratch = Scratch(docs.sparkSession)
    # written once: the texts are split and hashed a single time
    every = scratch.write(positions(docs, min_words).withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS)).cast("int")))
    place = F.xxhash64("doc_id", "mark", "at")
    shared = every.groupBy("fp").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y").select("fp")
    matches = scratch.write(extended(every.join(_salted(shared), ["fp", "salt"], "left_semi")))
    scratch.drop(every)
    place = F.struct("doc_id", "mark", "a")
    earliest = matches.groupBy("key").agg(F.min(place).alias("e"), F.max(place).alias("l")).where("e != l").select("key", "e")
    runs = scratch.write(matches.join(_salted(earliest), ["key", "salt"]).where(place != F.col("e")).select("doc_id", "mark", "a", "b").distinct())
    scratch.drop(matches)
    return runs


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """`df` with the lines that stay in `text_col`, and n_lines, n_removed of the text as it was."""
    if min_words < 1:
        raise ValueError("a window has a word at least")
    docs = df.select(F.struct(*df.columns).alias("row"), df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text")).withColumn("lines", F.split("text", "\n"))
    later = later_runs(docs.where("doc_id is not null and text is not null"), min_words)
    # stretches: spans that touch or overlap, in order of their start
    order = Window.partitionBy("doc_id", "mark").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = later.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("doc_id", "mark", "stretch").agg(F.struct(F.min("a").alias("a"), F.max("b").alias("b")).alias("run"))
    runs = runs.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    both = docs.join(runs, ["doc_id", "mark"], "left")
    # from numbered lines to all lines, blank ones between two that go with them
    places = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(WORD), i)))
    whole = F.transform(F.array(places), lambda p: F.transform("runs", lambda r: F.struct(p[r["a"]].alias("a"), p[r["b"]].alias("b"))))[0]
    both = both.withColumn("runs", F.when(F.col("runs").isNotNull(), whole))
    n = F.size("lines")
    ends = F.array(F.struct(n.alias("a"), n.alias("b")))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.col("runs")[i - 1]["b"] + 1)
    kept = F.flatten(F.transform(F.concat("runs", ends), lambda r, i: F.slice("lines", start(i) + 1, r["a"] - start(i))))
    both = both.withColumn("kept", F.when(F.col("runs").isNotNull(), kept))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    counts = {"n_lines": F.when(F.col("text").isNotNull(), n).otherwise(0).cast("long"), "n_removed": F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept")).cast("long")}
    names = [c for c in df.columns if c not in counts]
    return both.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names), *(x.alias(c) for c, x in counts.items()))
