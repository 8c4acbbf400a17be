"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become symbols: insult, threat, target, negation, reported speech, other. Five
weighted transducers over these symbols each say one thing about a clause: an insult counts, more so
when another stands near or its target follows; a threat counts little until its target follows; a
target before raises both; a negation or reported speech before lowers both. They are composed into
one transition table; the weight of a clause's path through it, with the weights of its insults and
threats, is the clause's score. A clause is matched when that reaches MATCH, and a document's score
is a logistic function of its matched clauses' scores only: a word outside a matched clause is nothing.

Insults and threats have fixed seeds and learnt terms: words, and beginnings of five letters or more
shared by several words, that mark toxic documents among at most about SAMPLE labelled rows of each
class outside the held-out quarter. A learnt word is a threat when a target mostly follows it, else
an insult. Its weight is the lower bound of its log-odds. The logistic weights are learnt from the
same rows.

Defined results: a null text is an empty text; a text without a matched clause has the lowest score,
the same for all; rows that repeat are scored alike; labels of rows that share an id are one label,
the largest; without labels, fixed weights are used; other columns pass through, but a column with
the score's name is replaced.
"""

from __future__ import annotations

import collections
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import broadcast_if_small, held_out, text_batches, with_columns

SAMPLE, LEXICON, THRESHOLD = 6000, 4000, 0.3
#: Lengths of the word beginnings that may be learnt, and how many words of toxic documents share one at least.
STEMS, SHARED = range(5, 9), 3
#: Learnt terms are met in so many toxic documents, with so large a lower bound of the log-odds of being there, SURE standard errors below.
LEAST, ODDS, SURE = 4, 1.0, 1.64
#: Largest weight of a term; weight from which a clause is matched.
MOST, MATCH = 4.0, 1.0
REMEMBERED = 150_000
#: Terms that a task counts before it emits them.
COUNTED = 300_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb imbecile fool filth garbage vermin ugly",
    THREAT: "kill hurt destroy beat smash shoot stab punch burn hunt strangle crush attack",
    TARGET: "you your yours yourself u they them their he him his she her these those du dich dir ihr vous tu toi tus usted ustedes",
    NEGATION: "not never no isn aren wasn don doesn didn won without nicht kein keine pas jamais ni nunca",
    REPORT: "said says wrote writes claimed quoted reported called according told sagte dit dijo",
}
SEED_WEIGHT = 2.0
NOTHING = (OTHER, 0.0)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")

#: What the transducers add to a path, in units of a term's log-odds.
WEIGHTS = {"again": 1.5, "insult_target": 0.5, "threat": -1.5, "threat_target": 2.5, "target": 0.7, "negated": -4.0, "reported": -2.0}
#: Words over which each of them looks back.
REACH = {"insult": 4, "threat": 4, "target": 5, "negation": 3, "report": 12}


class Transducer:
    """step[state][symbol] -> state; weight[state][symbol]: weight of that arc. State 0 is where a clause begins."""

    def __init__(self, step: list[list[int]], weight: list[list[float]]):
        self.step, self.weight = step, weight

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: their arcs' weights add up. Only states that can be reached are kept."""
        found, step, weight = {(0, 0): 0}, [], []
        queue = collections.deque(found)
        while queue:
            a, b = queue.popleft()
            arcs = [(self.step[a][s], other.step[b][s]) for s in SYMBOLS]
            for arc in arcs:
                if arc not in found:
                    found[arc] = len(found)
                    queue.append(arc)
            step.append([found[arc] for arc in arcs])
            weight.append([self.weight[a][s] + other.weight[b][s] for s in SYMBOLS])
        return Transducer(step, weight)

    def path(self, symbols: list[int]) -> float:
        state, total = 0, 0.0
        for s in symbols:
            total += self.weight[state][s]
            state = self.step[state][s]
        return total


def within(symbol: int, reach: int, near: dict[int, float], far: dict[int, float], ends: tuple = ()) -> Transducer:
    """Up to ``reach`` words after ``symbol``, arcs weigh ``near``, else ``far``; symbols of ``ends`` end that sooner."""
    step = [[reach if s == symbol else 0 if s in ends else max(0, k - 1) for s in SYMBOLS] for k in range(reach + 1)]
    return Transducer(step, [[(near if k else far).get(s, 0.0) for s in SYMBOLS] for k in range(reach + 1)])


def transducers(weights: dict[str, float] = WEIGHTS, reach: dict[str, int] = REACH) -> dict[str, Transducer]:
    w = weights
    return {
        "insult": within(INSULT, reach["insult"], {INSULT: w["again"], TARGET: w["insult_target"]}, {}, (TARGET,)),
        "threat": within(THREAT, reach["threat"], {THREAT: w["threat"], TARGET: w["threat_target"]}, {THREAT: w["threat"]}, (TARGET,)),
        "target": within(TARGET, reach["target"], {INSULT: w["target"], THREAT: w["target"]}, {}),
        "negation": within(NEGATION, reach["negation"], {INSULT: w["negated"], THREAT: w["negated"]}, {}),
        "report": within(REPORT, reach["report"], {INSULT: w["reported"], THREAT: w["reported"]}, {}),
    }


def grammar(weights: dict[str, float] = WEIGHTS) -> Transducer:
    """All five composed."""
    first, *others = transducers(weights).values()
    for other in others:
        first = first.compose(other)
    return first


class Scorer:
    """``learnt`` gives each learnt term, a beginning ending in *, its symbol and weight."""

    def __init__(self, learnt: dict[str, tuple[int, float]], weights: dict[str, float] = WEIGHTS):
        self.exact = {w: (s, SEED_WEIGHT if s in (INSULT, THREAT) else 0.0) for s, ws in SEEDS.items() for w in ws.split()}
        self.exact |= {w: (self.exact.get(w, NOTHING)[0] or s, x) for w, (s, x) in learnt.items() if not w.endswith("*") and self.exact.get(w, NOTHING)[0] in (OTHER, INSULT, THREAT)}
        self.stems = {w[:-1]: x for w, (_, x) in learnt.items() if w.endswith("*")}
        self.known: dict[str, tuple[int, float]] = {}
        self.grammar = grammar(weights)

    def look(self, word: str) -> tuple[int, float]:
        if (got := self.known.get(word)) is None:
            got = self.exact.get(word)
            if got is None:
                x = max((self.stems.get(word[:n], 0.0) for n in STEMS if n <= len(word)), default=0.0) if self.stems else 0.0
                got = (INSULT, x) if x else NOTHING
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def clause(self, words: list[str]) -> float:
        """The weight of its path through the grammar and of its terms."""
        step, weight, state, total = self.grammar.step, self.grammar.weight, 0, 0.0
        for w in words:
            s, x = self.look(w)
            total += x + weight[state][s]
            state = step[state][s]
        return total

    def matches(self, text: str | None) -> tuple[list[float], int]:
        """Scores of the matched clauses, and how many clauses there are (0 if no word is a term)."""
        low = (text or "").lower()
        marks = {w for w in set(WORD.findall(low)) if self.look(w)[1]}
        if not marks:
            return [], 0
        found, clauses = [], 0
        for part in CLAUSE.split(low):
            words = WORD.findall(part)
            clauses += bool(words)
            if not marks.isdisjoint(words) and (s := self.clause(words)) >= MATCH:
                found.append(s)
        return found, clauses

    def features(self, text: str | None) -> list[float]:
        found, clauses = self.matches(text)
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        return [math.log1p(sum(found)), min(max(found), 10.0), math.log1p(len(found)), 10 * len(found) / max(10, clauses)]


#: Bias and weights of the features without labels to learn from.
UNLEARNT = [-4.0, 0.8, 0.5, 0.5, 0.1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, tuple[int, float]], list[float]]:
    """(learnt terms, logistic weights) from labelled rows that aren't held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}, UNLEARNT
    share = F.when(F.col("y") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(broadcast_if_small(picked, picked.count(), 24), "id")
    # of rows that share an id, the smallest text
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).cache()
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    t_all, c_all = counts.get(1, 0), counts.get(0, 0)
    if not t_all or not c_all:
        rows.unpersist()
        return {}, UNLEARNT
    learnt = terms(rows, t_all, c_all)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(learnt)
        for batch in batches:
            f = [scorer.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], ["y", "f"])

    made = text_batches(rows.select("y", "text")).mapInArrow(run, "y int, f array<double>").collect()
    rows.unpersist()
    x, y = np.array([r["f"] for r in made]), np.array([r["y"] for r in made], dtype=float)
    # back to the share of each class among all labels
    fitted = logistic(x, y)
    fitted[0] += math.log(sizes[1] / t_all) - math.log(sizes[0] / c_all)
    return learnt, fitted


def terms(rows: DataFrame, t_all: int, c_all: int) -> dict[str, tuple[int, float]]:
    """Words and beginnings of ``rows`` (y, text) that mark y = 1, with symbol and weight."""

    def count(batches):
        import pyarrow as pa

        found: dict[str, list[int]] = {}
        targets = set(SEEDS[TARGET].split())

        def table():
            made = pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(c, pa.int64()) for c in zip(*found.values(), strict=True)]], ["e", "t", "c", "n", "led"])
            found.clear()
            return made

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = WORD.findall((text.as_py() or "").lower())
                distinct = set(words)
                # once per document; n and led count a word's places in toxic documents, and those that a target follows
                for e in distinct | {w[:n] + "*" for w in distinct for n in STEMS if n <= len(w)}:
                    found.setdefault(e, [0, 0, 0, 0])[1 - y] += 1
                if y:
                    for k, w in enumerate(words):
                        found[w][2] += 1
                        found[w][3] += not targets.isdisjoint(words[k + 1 : k + 1 + REACH["threat"]])
                if len(found) > COUNTED:
                    yield table()
        if found:
            yield table()

    part = text_batches(rows.select("y", "text")).mapInArrow(count, "e string, t long, c long, n long, led long")
    total = part.groupBy("e").agg(*[F.sum(c).alias(c) for c in ("t", "c", "n", "led")]).where("t > 0").cache()
    odds = F.log((F.col("t") + 0.5) / (t_all + 1)) - F.log((F.col("c") + 0.5) / (c_all + 1))
    low = odds - SURE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    good = total.where(F.col("t") >= LEAST).withColumn("low", low).where(F.col("low") >= ODDS)
    lengths = F.filter(F.array(*[F.lit(n) for n in STEMS]), lambda n: n <= F.char_length("e"))
    stems = F.transform(lengths, lambda n: F.concat(F.substring("e", F.lit(1), n), F.lit("*")))
    shared = total.where("not endswith(e, '*')").select(F.explode(stems).alias("e")).groupBy("e").count().where(F.col("count") >= SHARED).select("e")
    good = good.where("not endswith(e, '*')").unionByName(good.join(shared, "e", "left_semi"))
    best = good.orderBy(F.desc(F.col("t") * F.col("low")), "e").limit(LEXICON).collect()
    total.unpersist()
    return {r["e"]: (THREAT if r["n"] and 2 * r["led"] >= r["n"] else INSULT, min(MOST, r["low"])) for r in best}


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "toxicity", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``docs`` with a score from 0 to 1. Other ``weights`` than the grammar's own are for ablations."""
    learnt, fitted = model

    def start():
        scorer = Scorer(learnt, weights)

        def run(texts):
            x = [fitted[0] + sum(a * b for a, b in zip(fitted[1:], scorer.features(t.as_py()), strict=True)) for t in texts]
            return [1 / (1 + np.exp(-np.clip(np.array(x, dtype=float), -30, 30)))]

        return run

    return with_columns(docs, text_col, start, {score_col: "double"})


def drop_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return score(rows, model).where(F.col("toxicity") < threshold).select("row.*")


def op3_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
