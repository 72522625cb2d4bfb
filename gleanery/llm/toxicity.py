"""Toxicity by a weighted finite-state grammar over clauses.

A clause is the words between `.`, `!`, `?`, `;` and line ends. Each word has a class by
the lexicon: insult, threat, target, negation, report, intensifier, modal or other.

1. Five letter-to-letter transducers read classes and write classes: negation turns
   insults and threats after it into negated ones, reported speech those after a verb of
   saying or a quotation mark, the insult transducer marks strengthened ones, the threat
   transducer tells an announced deed from a bare verb, the target transducer marks
   insults near a person spoken to or of. Each has few states; they are composed into one
   machine (`compose`), which runs over clauses that hold an insult or a threat: any other
   clause has no output and weighs nothing.
2. What comes out of a clause are marked words; the lexical weight of each counts for its
   mark. A document's features are the weights by mark, their density, its heaviest
   clause and the share of clauses that matched: no word counts outside of a clause.
3. The lexicon is hand-written and extended by words and stems that labelled documents
   show in clearly more contexts of label 1 than of label 0. Contexts are distinct (word
   before, word after), so that copies of a text are one witness. Of stems that hold the
   same words only the longest is kept. It has MOST_LEARNED entries at most.
4. A logistic regression, drawn to hand-set weights, is fitted to the labelled documents.

Learned from are the documents of at most MOST_LABELLED labelled ids (of least hash; the
only bound on rows). Ids, languages, sources and labels are no inputs of a score. Null and
empty texts score like texts without a match. Null ids are scored, never learned from; an
id labelled twice counts with its smaller label, null labels not at all; repeated rows of
an id are learned once. Without labels of both kinds the hand-set weights stay. Other
columns are ignored; an empty table gives an empty result. Jobs run while the result is
built; the table of labelled texts is dropped then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .textbytes import LOWER, NOT_ALNUM, PIECE, Texts, column, mix, pieces

MOST_LABELLED, MOST_LEARNED = 20_000, 4_000
#: A learned word or stem: contexts in documents of label 1 at least, by how much more often than in others, and how many deviations above chance.
LEAST_SEEN, LEAST_TIMES, LEAST_DEVIATIONS = 5, 4.0, 6.0
STEM = range(4, 11)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENSIFIER, MODAL = range(8)
NEGATED, REPORTED, STRONG, DIRECTED, ANNOUNCED, THREAT_NEGATED, THREAT_REPORTED, ADDRESSED = range(8, 16)
SYMBOLS = 16

# The hand-written lexicon (English, German, French, Spanish).
LEXICON = {
    INSULT: """idiot idiots moron morons stupid dumb fool loser losers scum trash clown worthless pathetic disgusting imbecile jerk bastard bitch asshole cretin
        vermin filth garbage freak coward liar parasite subhuman dummkopf trottel arschloch abschaum versager wertlos erbärmlich widerlich schwachkopf depp hurensohn
        imbécile crétin connard salaud ordure débile pathétique dégoûtant minable abruti idiota imbécil estúpido estúpida basura escoria patético asqueroso
        gilipollas cabrón payaso""",
    THREAT: """kill hurt destroy punch shoot stab strangle crush murder töten umbringen vernichten verprügeln erschießen tuer frapper détruire égorger matar
        mataré golpear destruir quemar""",
    TARGET: "you your yours yourself u they them their he him she her du dich dir dein deine euch tu toi te vous ton ta votre tú usted ustedes eres vosotros",
    NEGATION: "not no never nobody isn aren wasn don nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás tampoco",
    REPORT: "said says say saying called calls wrote writes told claims claimed quoted sagte sagt nannte schrieb dit disait écrit appelle dijo dice llamó escribió",
    INTENSIFIER: "such so very total complete absolute utter damn bloody fucking völlig verdammter so total tellement sale gros muy tan maldito puto",
    MODAL: "will ll gonna going should must want shall werde werden soll sollte vais va allons devrait faut voy vamos debería",
}
#: Weight of a hand-written insult or threat that no labelled document holds; the most that one word weighs.
HAND, HEAVIEST = 2.5, 5.0
MARKS = (INSULT, STRONG, DIRECTED, NEGATED, REPORTED, THREAT, ANNOUNCED, THREAT_NEGATED, THREAT_REPORTED, ADDRESSED)
#: Hand-set weights of the marks, in that order.
BY_MARK = np.array([1.0, 1.3, 1.6, 0.2, 0.3, 0.3, 1.5, 0.1, 0.2, 0.5])
#: Then of the density, the heaviest clause, the share of clauses; and the constant.
PRIOR = np.concatenate([BY_MARK, [0.6, 0.3, 0.5], [-3.5]])

_STOP = np.zeros(256, bool)
_STOP[[*b".!?;\n\r"]] = True
_QUOTE = np.zeros(256, bool)
_QUOTE[ord('"')] = True


# ---- transducers


@dataclass
class Transducer:
    """Deterministic, letter to letter: (state, symbol) to (state, symbol, weight). State 0 begins a clause."""

    states: int
    step: Callable[[int, int], tuple[int, int, float]]

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        s, out = 0, []
        for x in symbols:
            s, y, w = self.step(s, x)
            out.append((y, w))
        return out


def negation() -> Transducer:
    """States: words that a negation still reaches."""

    def step(s: int, x: int) -> tuple[int, int, float]:
        if x == NEGATION:
            return 3, x, 0.0
        if s and x in (INSULT, THREAT):
            return 0, NEGATED if x == INSULT else THREAT_NEGATED, 0.0
        return max(s - 1, 0), x, 0.0

    return Transducer(4, step)


def reported_speech() -> Transducer:
    """State 1: after a verb of saying, up to the end of the clause."""

    def step(s: int, x: int) -> tuple[int, int, float]:
        if x == REPORT:
            return 1, x, 0.0
        return s, {INSULT: REPORTED, THREAT: THREAT_REPORTED}.get(x, x) if s else x, 0.0

    return Transducer(2, step)


def insults() -> Transducer:
    """State 1: after an intensifier; insults in a row strengthen each other."""

    def step(s: int, x: int) -> tuple[int, int, float]:
        if x == INSULT:
            return 1, STRONG if s else x, 0.0
        return int(x == INTENSIFIER), x, 0.0

    return Transducer(2, step)


def threats() -> Transducer:
    """States: words that a modal still reaches; a deed after it is announced."""

    def step(s: int, x: int) -> tuple[int, int, float]:
        if x == MODAL:
            return 3, x, 0.0
        return max(s - 1, 0), ANNOUNCED if x == THREAT and s else x, 0.0

    return Transducer(4, step)


def targets() -> Transducer:
    """States 1 to 4: words that a target still reaches; 5 and 6: that an insult does, which a target then takes up."""

    def step(s: int, x: int) -> tuple[int, int, float]:
        if x == TARGET:
            return 4, ADDRESSED if s >= 5 else x, 1.0 if s >= 5 else 0.0
        if x in (INSULT, STRONG):
            return (6, DIRECTED, 0.5) if 1 <= s <= 4 else (6, x, 0.0)
        return (s - 1 if s not in (0, 5) else 0), x, 0.0

    return Transducer(7, step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that reads as `first` and writes what `second` makes of that; weights add up."""

    def step(s: int, x: int) -> tuple[int, int, float]:
        a, b = divmod(s, second.states)
        a, y, v = first.step(a, x)
        b, z, w = second.step(b, y)
        return a * second.states + b, z, v + w

    return Transducer(first.states * second.states, step)


class Machine:
    """A transducer as tables over the states that can be reached."""

    def __init__(self, t: Transducer):
        number, todo, rows = {0: 0}, [0], []
        while todo:
            s = todo.pop(0)
            row = []
            for x in range(ADDRESSED + 1):
                to, y, w = t.step(s, x)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], y, w))
            rows.append(row)
        self.table = rows

    def read(self, symbols: list[int]) -> list[tuple[int, float]]:
        table, s, out = self.table, 0, []
        for x in symbols:
            s, y, w = table[s][x]
            out.append((y, w))
        return out


def grammar() -> Machine:
    whole = negation()
    for part in (reported_speech(), insults(), threats(), targets()):
        whole = compose(whole, part)
    return Machine(whole)


# ---- words and their classes


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case."""
    low = LOWER[buf]
    if len(low) > 1:
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[at] += 0x20
    return low


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(raw), np.uint8), off).hashes(off[:-1], off[1:])


@dataclass
class Lexicon:
    """Classes and weights of words, weights of insult stems."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, float] = field(default_factory=dict)

    def compiled(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes of the stem, or 0 for whole words; sorted hashes, classes, weights), stems first, longer ones after shorter ones."""
        groups: dict[int, list[tuple[str, int, float]]] = {}
        for s, w in self.stems.items():
            groups.setdefault(len(s.encode()), []).append((s, INSULT, w))
        groups = dict(sorted(groups.items())) | {0: [(x, c, w) for x, (c, w) in self.words.items()]}
        out = []
        for size, rows in groups.items():
            h = _hash([r[0] for r in rows])
            order = np.argsort(h)
            out.append((size, h[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows], float)[order]))
        return out


def hand_written() -> dict[str, tuple[int, float]]:
    return {w: (c, HAND if c in (INSULT, THREAT) else 0.0) for c, text in reversed(LEXICON.items()) for w in text.split()}


def classes(t: Texts, start: np.ndarray, end: np.ndarray, compiled: list) -> tuple[np.ndarray, np.ndarray]:
    """Class and weight of each word."""
    kind, weight = np.zeros(len(start), np.int64), np.zeros(len(start))
    for size, h, c, w in compiled:
        at = np.flatnonzero(end - start > size) if size else np.arange(len(start))
        if not len(at) or not len(h):
            continue
        found = t.hashes(start[at], start[at] + size if size else end[at])
        place = np.minimum(np.searchsorted(h, found), len(h) - 1)
        hit = h[place] == found
        kind[at[hit]], weight[at[hit]] = c[place[hit]], w[place[hit]]
    return kind, weight


N_FEATURES = len(MARKS) + 3
_MARK = {m: k for k, m in enumerate(MARKS)}


def _clauses(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, offsets by row, and the clause of each word (ascending over all rows)."""
    start, end, off = t.words(NOT_ALNUM)
    stops = np.concatenate([[0], np.cumsum(_STOP[t.buf])])
    key = stops[start] + np.repeat(np.arange(len(off) - 1), np.diff(off))
    return start, end, off, np.cumsum(np.append(0, np.diff(key) > 0)) if len(key) else key


def matched(buf: np.ndarray, off: np.ndarray, compiled: list, machine: Machine) -> Iterator[tuple[int, int, int, list[tuple[int, int, float]]]]:
    """(row, first and last byte, [(byte, mark, weight)]) of each clause with a marked word; `buf` is in lower case."""
    t = Texts(buf, off)
    start, end, at, clause = _clauses(t)
    kind, weight = classes(t, start, end, compiled)
    hit = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    quotes = np.concatenate([[0], np.cumsum(_QUOTE[buf])])
    row_of = np.searchsorted(at, hit, "right") - 1
    last = -1
    for k, row in zip(hit.tolist(), row_of.tolist(), strict=True):
        if clause[k] == last:
            continue
        last = clause[k]
        lo, hi = int(np.searchsorted(clause, last)), int(np.searchsorted(clause, last, "right"))
        symbols = kind[lo:hi].tolist()
        # a quotation mark before a word reads as a verb of saying in its place
        quoted = np.diff(quotes[start[lo:hi]], prepend=quotes[start[lo]]) > 0
        read, place = [], []
        for j, x in enumerate(symbols):
            if quoted[j]:
                read.append(REPORT)
                place.append(-1)
            read.append(x)
            place.append(lo + j)
        marks = []
        for (y, extra), p in zip(machine.read(read), place, strict=True):
            if p >= 0 and y in _MARK:
                marks.append((int(start[p]), y, float(weight[p]) + extra))
        if marks:
            yield row, int(start[lo]), int(end[hi - 1]), marks


def features(buf: np.ndarray, off: np.ndarray, compiled: list, machine: Machine) -> np.ndarray:
    """A row for each text: weights by mark, density, heaviest clause, share of clauses. `buf` as it is."""
    low = lowered(buf)
    t = Texts(low, off)
    _, _, at, clause = _clauses(t)
    n_words = np.diff(at)
    n = len(n_words)
    edges = np.append(True, np.diff(clause) > 0)[: len(clause)]
    sums = np.concatenate([[0], np.cumsum(edges)])
    n_clauses = sums[at[1:]] - sums[at[:-1]]
    by_mark, most, clauses = np.zeros((n, len(MARKS))), np.zeros(n), np.zeros(n)
    for row, _, _, marks in matched(low, off, compiled, machine):
        weight = 0.0
        for _, mark, w in marks:
            by_mark[row, _MARK[mark]] += w
            weight += BY_MARK[_MARK[mark]] * w
        most[row] = max(most[row], weight)
        clauses[row] += 1
    whole = by_mark @ BY_MARK
    return np.column_stack([np.log1p(by_mark), np.log1p(100 * whole / (n_words + 20)), np.log1p(most), clauses / np.maximum(n_clauses, 1)])


# ---- learning


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, draw: float = 2.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to `prior` (its last is the constant); the prior itself where there is one label."""
    if not len(y) or y.min() == y.max():
        return prior.copy()
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = prior.copy(), np.append(np.full(len(prior) - 1, draw), 0.01)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        # long steps are cut, so that far rows can't throw it off
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def contexts(train: DataFrame) -> DataFrame:
    """(word, pos, neg): distinct contexts of each word in texts of (label, text) by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off, PIECE):
                low = lowered(buf[off[lo] : off[hi]])
                t = Texts(low, off[lo : hi + 1])
                start, end, at, clause = _clauses(t)
                if not len(start):
                    continue
                h = t.hashes(start, end)
                joined = clause[1:] == clause[:-1]
                before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
                before[1:][joined], after[:-1][joined] = h[:-1][joined], h[1:][joined]
                y = np.repeat(label[lo:hi], np.diff(at))
                around = mix(before * np.uint64(3) + mix(after))
                _, first = np.unique(mix(h ^ mix(around + y.astype(np.uint64))), return_index=True)
                size = (end - start)[first]
                stop = np.cumsum(size)
                where = np.repeat(start[first] - (stop - size), size) + np.arange(stop[-1])
                words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(0, stop).astype(np.int64).tobytes()), pa.py_buffer(low[where].tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(y[first].astype(np.int32)), pa.array(around[first].view(np.int64))], names=["word", "label", "around"])

    rows = train.select("label", "text").mapInArrow(run, "word string, label int, around long").where(F.col("word").rlike("^[^0-9]{3,40}$")).distinct()
    return rows.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def _clear(rows: DataFrame, p: float, n: float) -> DataFrame:
    """Adds `z`; what is seen clearly more often with label 1."""
    pos, neg = F.col("pos"), F.col("neg")
    chance = (pos + neg) * p / (p + n)
    rows = rows.where((pos >= LEAST_SEEN) & (pos * n >= LEAST_TIMES * neg * p)).withColumn("z", (pos - chance) / F.sqrt(chance))
    return rows.where(F.col("z") >= LEAST_DEVIATIONS)


def learn_lexicon(train: DataFrame) -> Lexicon:
    """The hand-written lexicon with weights by the texts of (label, text), and what they teach."""
    words = hand_written()
    scratch = Scratch(train.sparkSession)
    seen = scratch.write(contexts(train))
    p, n = (float(x or 0) for x in seen.agg(F.sum("pos"), F.sum("neg")).first())
    if not p or not n:
        scratch.drop(seen)
        return Lexicon(words)
    odds = lambda pos, neg, hand: float(np.clip(np.log((pos + 0.5) / p) - np.log((neg + 0.5 * n / p * np.exp(-hand)) / n), 0.0, HEAVIEST))
    known = {r["word"]: r for r in seen.where(F.col("word").isin([w for w, (c, _) in words.items() if c in (INSULT, THREAT)])).collect()}
    for w, (c, _) in list(words.items()):
        if c in (INSULT, THREAT) and w in known:
            words[w] = (c, odds(known[w]["pos"], known[w]["neg"], HAND))
    fresh = seen.where(~F.col("word").isin(list(words)))
    most = [F.desc("z"), F.asc("word")]
    for r in _clear(fresh, p, n).orderBy(*most).limit(MOST_LEARNED).collect():
        words[r["word"]] = (INSULT, odds(r["pos"], r["neg"], 0.0))
    cut = fresh.select("word", "pos", "neg", F.explode(F.sequence(F.lit(STEM[0]), F.lit(STEM[-1]))).alias("size")).where(F.char_length("word") > F.col("size"))
    stems = cut.groupBy(F.expr("left(word, size)").alias("word")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("members")).where("members >= 3")
    found = {r["word"]: r for r in _clear(stems, p, n).orderBy(*most).limit(MOST_LEARNED).collect()}
    scratch.drop(seen)
    # a stem goes where a longer one is as clear, or a shorter one clearer
    kept: dict[str, float] = {}
    for s, r in sorted(found.items(), key=lambda x: (-x[1]["z"], -len(x[0]), x[0])):
        if not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept[s] = odds(r["pos"], r["neg"], 0.0)
    return Lexicon(words, kept)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED, aside: Callable[[Column], Column] = held_out) -> Model:
    """Lexicon and weights from labelled documents whose id isn't set aside; labels are joined by doc_id."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna().where(~aside(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    # at most `most_labelled` ids and labels: few MB
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(texts.join(F.broadcast(known), "doc_id"))
    lexicon = learn_lexicon(rows)
    found = featured(rows, lexicon).groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").select("x", "label").collect()
    scratch.drop(rows)
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float64).reshape(len(found), N_FEATURES)
    return Model(lexicon, fit(x, np.array([r["label"] for r in found], np.float64)))


def featured(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, x) of (doc_id, text): features as 64-bit floats."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.compiled(), grammar()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, machine = shared.value
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                x = features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], compiled, machine)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def toxic_clauses(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clause, weight, marks) of each clause with a marked word, weighed by the hand-set weights; marks as numbers of MARKS."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.compiled(), grammar()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, machine = shared.value
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                raw = buf[off[lo] : off[hi]]
                rows = [(batch.column(0)[lo + r].as_py(), raw[a:b].tobytes().decode(), float(sum(BY_MARK[_MARK[m]] * w for _, m, w in marks)), [_MARK[m] for _, m, _ in marks]) for r, a, b, marks in matched(lowered(raw), off[lo : hi + 1] - off[lo], compiled, machine)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], k) for c, k in enumerate((pa.int64(), pa.string(), pa.float64(), pa.list_(pa.int32())))], names=["doc_id", "clause", "weight", "marks"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, clause string, weight double, marks array<int>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`; labels are joined by doc_id."""
    model = train(docs, labels, id_col, text_col, label_col, most_labelled)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.lexicon.compiled(), grammar()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, compiled, machine = shared.value
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off):
                score = model.score(features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], compiled, machine))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
