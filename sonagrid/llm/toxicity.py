"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer maps words to weighted symbols: insults and threats (fixed seeds, and words and word stems learned
from labelled rows), targets, negations, reported speech, and the words that patterns are made of. Two pattern
transducers read the symbols of a clause and emit weighted hits: INSULT for an insult, more for one said of a target
("you are such a ..."), and for fixed idioms; THREAT for a threat verb, more after a will to act, and for a target that a
consequence is promised to. Three further transducers read the same symbols and the hits, and mark them: negation and
reported speech mark hits that follow in the clause, a target marks hits after it and, through a pending state, the hit
before it. All five are composed into one table over the product of their states. A clause's weight for each kind of
mark is that of its heaviest hit, so isolated repeats inside a clause don't add up; a document's features are sums over
clauses on a logarithmic scale, weighed by a logistic model.

Learning uses a bounded sample of labelled rows (max_train_rows; the default is a documented parameter), spread over all
by a hash of their ids, without near copies (equal least and greatest hash of a word pair). Words and stems count by documents;
an entry's weight is the lower bound of its log odds. A learned word is a threat if most toxic documents that have it
have it after a will to act, else an insult. The logistic weights are fitted on one half of the sample with the lexicon
of the other half, and drawn towards defaults, which stand alone where labels lack a class.

Edge cases: a null or empty text has no clause and scores as such; rows without label are scored like others; a null
label is no label; of several labels of an id the highest counts; a null id counts as the empty string for the fold;
repeated rows have equal scores; very long texts are read whole, a clause at a time; an empty table gives an empty
result; other columns stay as they are, whatever their names, but for one called as the score, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cache_of, fresh, let, named, release, scratch, table, whole_text, written

SLICE = 256
SEEDS = {
    "insult": "idiot moron stupid scum loser worthless pathetic disgusting trash clown fool jerk imbecile dumb idiota estúpido imbécil basura idiote débile ordure dumm dummkopf abschaum",
    "threat": "kill hurt destroy beat stab shoot strangle töten umbringen tuer frapper matar golpear",
    "target": "you your yours yourself he she they them him her du dich dir euch ihr tu toi vous lui usted ustedes ellos ella",
    "negation": "not never neither nor cannot n't nicht kein keine nie jamais aucun nunca tampoco",
    "report": "said says say claimed claims wrote quoted reported sagte schrieb dit écrit dijo escribió",
    "copula": "are is am were bist seid sind eres es son êtes est",
    "intent": "will would gonna going shall want werde werden wollen vais veux allons voy vamos quiero",
    "consequence": "regret suffer bleed bereuen leiden sterben regretter souffrir sufrir morir",
    "opener": "shut drop halt ferme cierra",
    "closer": "up dead maul gueule boca",
}
#: Symbols without which a clause has no hit.
TRIGGERS = ("insult", "threat", "consequence", "closer")
STEMS = (4, 5, 6)
#: The marks that a hit can carry, in the order of the features.
MARKS = ("plain", "target", "negation", "report")
KINDS = tuple(product(("insult", "threat"), MARKS))
#: The logistic model without labels: the constant, then a weight for each of KINDS.
DEFAULT = np.array([-3.0, 4.0, 5.0, 1.0, 1.5, 0.5, 5.0, 0.2, 0.5])
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")


# ---- transducers ----

@dataclass(frozen=True)
class Transducer:
    """States are numbers from 0, the start; arcs[(state, symbol)] = (next state, output or None)."""

    n_states: int
    arcs: dict[tuple[int, str], tuple]

    def step(self, state: int, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, None))


HIT = ("insult", "threat")
#: State 1: a target came. 2: it is said to be something. 3: an idiom began. An insult's factor grows on the way.
INSULT = Transducer(4, {
    **{(q, "target"): (1, None) for q in range(4)}, (1, "copula"): (2, None), **{(q, "opener"): (3, None) for q in range(4)},
    **{(q, "insult"): (q, ("insult", factor)) for q, factor in enumerate((1.0, 1.2, 1.5, 1.0))}, (3, "closer"): (0, ("insult", 1.0)),
})
#: State 1: a will to act. 2: a target came. 3: a target, then what will come to it. A bare verb weighs half.
THREAT = Transducer(4, {
    (0, "intent"): (1, None), (2, "intent"): (3, None), **{(q, "target"): (q | 2 if q != 1 else 1, None) for q in range(4)},
    **{(q, "threat"): (q, ("threat", factor)) for q, factor in enumerate((0.5, 1.0, 0.5, 1.0))}, (3, "consequence"): (3, ("threat", 1.5)),
})
#: Once read, a negation or a report marks every hit in the rest of the clause.
NEGATION = Transducer(2, {(0, "negation"): (1, None), (1, "hit"): (1, "negation")})
REPORT = Transducer(2, {(0, "report"): (1, None), (1, "hit"): (1, "report")})
#: State 1: a target came before. State 2: a hit waits for one; the target after it marks it belatedly.
TARGET = Transducer(3, {(0, "target"): (1, None), (1, "hit"): (1, "target"), (0, "hit"): (2, None), (2, "target"): (1, "late")})


def compose(patterns: tuple[Transducer, ...], marks: tuple[Transducer, ...]) -> dict[tuple[tuple[int, ...], str], tuple]:
    """One table over the product of the states: (next states, hit or None, its mark).

    The patterns' output is the marks' input: they read "hit" where a pattern emits one (the first that does), else the
    symbol. The first machine that marks decides the mark.
    """
    out, n = {}, len(patterns)
    for states in product(*(range(m.n_states) for m in (*patterns, *marks))):
        for symbol in SEEDS:
            found = [m.step(q, symbol) for m, q in zip(patterns, states[:n], strict=True)]
            hit = next((x for _, x in found if x), None)
            marked = [m.step(q, "hit" if hit else symbol) for m, q in zip(marks, states[n:], strict=True)]
            mark = next((x for _, x in marked if x), "plain" if hit else None)
            out[states, symbol] = tuple(q for q, _ in (*found, *marked)), hit, mark
    return out


GRAMMAR = compose((INSULT, THREAT), (REPORT, NEGATION, TARGET))
START = (0, 0, 0, 0, 0)


@dataclass
class Lexicon:
    """Words and stems with their classes and weights; a word counts before its stems, a longer stem before a shorter."""

    words: dict[str, tuple[str, float]]
    stems: dict[str, float] = field(default_factory=dict)
    seen: dict[str, tuple[str, float] | None] = field(default_factory=dict)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "seen": {}}

    def of(self, word: str) -> tuple[str, float] | None:
        try:
            return self.seen[word]
        except KeyError:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.words.get(word)
            if found is None:
                found = next((("insult", self.stems[word[:k]]) for k in reversed(STEMS) if len(word) >= k and word[:k] in self.stems), None)
            self.seen[word] = found
            return found


def seed_lexicon() -> dict[str, tuple[str, float]]:
    return {w: (kind, 2.0 if kind in TRIGGERS else 0.0) for kind, words in SEEDS.items() for w in words.split()}


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """The weight of each of KINDS: log(1 + the sum over clauses of the heaviest hit)."""
    x = np.zeros(len(KINDS))
    text = text.lower()
    of = lexicon.of
    if not any((c := of(w)) and c[0] in TRIGGERS for w in set(WORD.findall(text))):
        return x
    for clause in CLAUSE.split(text):
        state, hits = START, []
        for word in WORD.findall(clause):
            found = of(word)
            if found is None:
                continue
            symbol, weight = found
            state, hit, mark = GRAMMAR[state, symbol]
            if hit:
                hits.append([hit[0], mark, weight * hit[1]])
            elif mark == "late" and hits and hits[-1][1] == "plain":
                hits[-1][1] = "target"
        best: dict[tuple[str, str], float] = {}
        for symbol, mark, weight in hits:
            best[symbol, mark] = max(best.get((symbol, mark), 0.0), weight)
        for kind, weight in best.items():
            x[KINDS.index(kind)] += weight
    return np.log1p(x)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to DEFAULT; hits never lower a score."""
    w = DEFAULT.copy()
    if not len(y) or y.min() == y.max():
        return w
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + pull * (w - DEFAULT)
        hess = (design * (p * (1 - p))[:, None]).T @ design + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---- learning ----

def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(y, half, text): a bounded sample of labelled rows outside the held-out fold, without near copies."""
    known = labels.filter(named(label_col).isNotNull() & ~held_out(id_col)).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col)).alias("y"))
    n = known.count()
    share = min(1.0, max_train_rows / max(n, 1))
    known = known.filter(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # the sample's size is bounded by max_train_rows, so it may be broadcast; documents are read without a shuffle
    rows = docs.select(named(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(known), "id")
    pairs = lambda ws: F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.xxhash64(a, b))
    hashes = let(F.split(F.lower("text"), r"[^\p{L}]+"), pairs)
    near = rows.withColumn("near", let(hashes, lambda h: F.xxhash64(F.array_min(h), F.array_max(h))))
    own = near.groupBy("near", "y").agg(F.min("id").alias("id"))
    return near.join(F.broadcast(own), ["near", "y", "id"]).select((F.col("y") > 0).cast("int").alias("y"), F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int").alias("half"), "text")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text leaves 0 modulo 5."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def entry_counts(rows: DataFrame) -> DataFrame:
    """(entry, t0, f0, t1, f1, after): toxic and clean documents of each half that have a word, or a stem (with a star).

    after: the toxic documents that have the word after a will to act in its clause.
    """
    will = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\p{L})(?:" + "|".join(SEEDS["intent"].split()) + r")(?!\p{L})([^.!?;:\n]*)"), F.lit(1))
    after = F.array_distinct(F.flatten(F.transform(will, lambda c: F.split(c, r"[^\p{L}]+"))))
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))

    def stems(ws, k: int):
        return F.transform(F.filter(ws, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    entries = let(words, lambda ws: F.array_distinct(F.concat(ws, *(stems(ws, k) for k in STEMS))))
    each = rows.select("y", "half", after.alias("after"), entries.alias("entries"))
    each = each.select("y", "half", F.explode(F.transform("entries", lambda e: F.struct(e.alias("entry"), F.array_contains("after", e).alias("late")))).alias("x")).select("y", "half", "x.*")
    sums = [F.sum(((F.col("y") == y) & (F.col("half") == h)).cast("long")).alias(f"{n}{h}") for h in (0, 1) for n, y in (("t", 1), ("f", 0))]
    return each.groupBy("entry").agg(*sums, F.count_if(F.col("late") & (F.col("y") == 1)).alias("after"))


def lexicon_of(counts: list, n_toxic: float, n_clean: float, halves: tuple[int, ...]) -> Lexicon:
    """Seeds, and entries whose log odds are high even at their lower bound (1.64 s.d.): over 2 for words, 3 for stems."""
    words, stems = seed_lexicon(), {}
    for row in counts:
        t, f = (sum(row[f"{n}{h}"] for h in halves) for n in "tf")
        odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((f + 0.5) / (n_clean + 1))
        bound = odds - 1.64 * np.sqrt(1 / (t + 0.5) + 1 / (f + 0.5))
        entry = row["entry"]
        if entry.endswith("*"):
            if t >= 5 and f <= 0.02 * t and bound > 3:
                stems[entry[:-1]] = float(bound)
        elif entry in words:
            if words[entry][0] in HIT and t + f >= 5:
                words[entry] = (words[entry][0], float(np.clip(odds, 0.0, 8.0)))
        elif t >= 3 and f <= 0.05 * t and bound > 2:
            words[entry] = ("threat" if 2 * row["after"] > row["t0"] + row["t1"] else "insult", float(bound))
    return Lexicon(words, stems)


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 30_000, **columns: str) -> Model:
    """The model of a sample bounded by max_train_rows; the driver gets the entries that it makes likely."""
    with scratch(docs.sparkSession):
        return _fitted(written(training_rows(docs, labels, max_train_rows, **columns), "toxic-sample"))


def _fitted(rows: DataFrame) -> Model:
    sizes = {(r["y"], r["half"]): r["n"] for r in rows.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([sizes.get((y, h), 0) for h in (0, 1)] for y in (1, 0))
    if not sum(toxic) or not sum(clean):
        return Model(Lexicon(seed_lexicon()), DEFAULT.copy())
    t, f = F.col("t0") + F.col("t1"), F.col("f0") + F.col("f1")
    seeds = F.col("entry").isin(*seed_lexicon())
    likely = entry_counts(rows).filter(((t >= 3) & (f <= 0.05 * t)) | seeds)
    counts = likely.collect()
    half = lexicon_of(counts, toxic[0], clean[0], (0,))
    fitted = rows.filter("half = 1").mapInArrow(_feature_rows(half), "y int, x array<double>").collect()  # numbers of the bounded sample
    x = np.array([r["x"] for r in fitted]).reshape(-1, len(KINDS))
    weights = fit_weights(x, np.array([r["y"] for r in fitted], dtype=float))
    return Model(lexicon_of(counts, sum(toxic), sum(clean), (0, 1)), weights)


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.field("element", pa.float64())))], names=["y", "x"])

    return run


# ---- scoring ----

def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with their score from 0 to 1 as score_col; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name.lower() != score_col.lower()]
    schema = T.StructType([*kept, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("toxicity")
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = np.array([features(t or "", model.lexicon) for t in batch.column(text_col).to_pylist()]).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, score_col])
        model.lexicon.seen.clear()
        release()

    return docs.select(*(named(f.name) for f in kept)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at least the threshold."""
    score_col = fresh(docs, "toxicity")[0]
    return score(docs, model, text_col, score_col).filter(F.col(score_col) < threshold).drop(score_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every text of documents, by a model of the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, score_col="score")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
