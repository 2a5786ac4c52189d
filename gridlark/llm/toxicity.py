"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters are words (a short fixed list, and words and word beginnings that the
labelled training rows show far more often in toxic texts) and patterns (address, shouting,
exclamation, masked letters). A voter votes by standing in the text and else
abstains; the label of a training row is one more voter that can be wrong. The
label model is a two-class mixture fitted by expectation maximisation. Its
parameters are how often each voter votes in either class (its accuracy) and,
for voters that go together, how often one votes beside the vote of the other in
either class (their correlation): within a class the voters form a forest, the
one that explains most of their mutual information, so a voter that repeats
another adds little.

A logistic regression is then trained on the posterior labels. It does not see
the votes: its inputs are words, word beginnings and four-letter sequences
(``^`` and ``$`` mark a word's edges), chosen from counts over all labelled
training rows, and the patterns.

Counts of words read every labelled row of the training folds. The label model
and the classifier read at most ``SAMPLE`` of them, the first by a hash of the
id; voters, inputs, posteriors and weights are of fixed size. Every document is
then scored by the classifier in one pass without a shuffle.

Cases: null and empty texts have no inputs and get the classifier's base score;
rows of ``labels`` with a null id or label are left out, and of several labels
of one document the highest counts; with no labels at all the fixed words and
prior beliefs are the model; documents that repeat are scored one by one, and
those with a null id are scored but never learned from; ties
between inputs go by the alphabet; texts are read whole whatever their length;
an empty table gives no rows; other columns, of any name, are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import broadcast_if_small, checkpointed, fold, map_texts

SAMPLE = 20_000
#: Learned voters: how many at most, the documents that hold one at least, and the least standard score of its toxic ones.
LEARNED, LEAST_DOCS, SURE = 160, 5, 5.0
#: The classifier's inputs: how many at most, and their least standard score.
INPUTS, LIKELY = 600, 4.0
#: Lengths of word beginnings that can be voters and inputs beside whole words, and of letter sequences that can be inputs.
STEMS, GRAM = (4, 5), 4
#: Numbers of distinct words with the same beginning that are inputs of their own.
MANY = (2, 3, 4)
#: Mutual information, in nats, from which two voters are correlated.
CORRELATED = 1e-4
#: Fixed word list.
WORDS = (
    "arschloch bastard bitch clown connard cretin damn disgusting dumb dumbass estupido fuck garbage hate hdp idiot idiota imbecile "
    "jerk kill loser moron nazi pathetic pendejo puta salaud scum shit shut stupid trash ugly vermin worthless"
).split()
PATTERNS = {
    "addressed": re.compile(r"\byou(?:'re| are)? (?:\w+ ){0,2}(?:idiot|moron|loser|trash|scum|stupid|pathetic|worthless)", re.I | re.A),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[ !?.,]+){4}", re.A),
    "exclaiming": re.compile(r"!{3,}"),
    "masked": re.compile(r"\b[a-z]+[*@#$]{1,4}[a-z]+\b", re.I | re.A),
}
#: Terms that are no voters: letter sequences, and beginnings with a number.
PART = r"^~|\*\d$"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LABEL_RIGHT = ((0.95, 0.995), (0.001, 0.02))  # how often a label is 1 in toxic and in other texts
PRIOR_VOTE = (0.3, 0.02)  # belief, before any data, that a voter votes in toxic and in other texts


#: A sign without which a pattern cannot stand in a text, tested first.
_SIGNS = {"addressed": re.compile(r"you", re.I | re.A), "shouting": re.compile(r"[A-Z]{3}"), "masked": re.compile(r"[*@#$]"), "exclaiming": re.compile(r"!!!")}
#: A pattern of words: one letter four times in a row. Patterns are numbered in order, this one last.
DRAWN_OUT = tuple(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")
N_PATTERNS = len(PATTERNS) + 1


def _found_patterns(text: str) -> set[int]:
    """Numbers of the patterns that stand in a text, without ``DRAWN_OUT``."""
    return {i for i, (name, p) in enumerate(PATTERNS.items()) if _SIGNS[name].search(text) and p.search(text)}


def votes(text: str | None, words: dict[str, int]) -> list[int]:
    """Numbers of the voters that vote; patterns follow the words."""
    if not text:
        return []
    distinct = set(_WORD.findall(text.lower()))
    terms = distinct.union(*[{w[:n] + "*" for w in distinct if len(w) >= n} for n in STEMS])
    found = {words[w] for w in words.keys() & terms} | {len(words) + i for i in _found_patterns(text)}
    if any(run in w for w in distinct for run in DRAWN_OUT if run[0] in w and len(w) > 3):
        found.add(len(words) + N_PATTERNS - 1)
    return sorted(found)


def grams(word: str) -> set[str]:
    """What a word can be known by: itself, its beginnings, and its letter sequences with their edges marked."""
    edged = f"^{word}$"
    return {word, *[word[:n] + "*" for n in STEMS if len(word) >= n], *[f"~{edged[i : i + GRAM]}" for i in range(len(edged) - GRAM + 1)]}


class Terms:
    """What can be an input: all that the distinct words of a text are known by, and beginnings that several of them share, with how many (``abcd*2``); with a bounded memory of words."""

    def __init__(self, remembered: int = 100_000) -> None:
        self.remembered, self.memo = remembered, {}

    def of(self, text: str | None) -> set[str]:
        """The distinct terms of a text."""
        if len(self.memo) > self.remembered:
            self.memo.clear()
        found: set[str] = set()
        stems: list[str] = []
        for w in set(_WORD.findall((text or "").lower())):
            held = self.memo.get(w)
            if held is None:
                held = self.memo[w] = (tuple(grams(w)), tuple(w[:n] for n in STEMS if len(w) >= n))
            found.update(held[0])
            stems += held[1]
        found.update(f"{s}*{k}" for s, n in Counter(stems).items() if n >= MANY[0] for k in MANY if n >= k)
        return found


def term_counts(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """(term, df, hit): in how many rows of (text, toxic) each term stands, and in how many toxic ones.

    A task adds up its rows first and hands its sums on whenever it holds ``most`` terms.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sums = Terms(), (Counter(), Counter())

        def handed() -> pa.RecordBatch:
            held = list(sums[0].keys() | sums[1].keys())
            hit = [sums[1][t] for t in held]
            made = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([sums[0][t] + h for t, h in zip(held, hit, strict=True)], pa.int64()), pa.array(hit, pa.int64())], names=["term", "df", "hit"])
            sums[0].clear()
            sums[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[toxic > 0].update(terms.of(text))
                if len(sums[0]) + len(sums[1]) >= most:
                    yield handed()
        yield handed()

    parts = rows.select(F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "term string, df long, hit long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))


class Inputs:
    """Numbers of the known ``Terms`` of a text, patterns after them.

    All known terms are found in one walk over the text's distinct words, side
    by side with blanks between: a blank is an edge, so a beginning is a blank
    and its letters, and stands once for each distinct word that has it.
    """

    def __init__(self, known: dict[str, int]) -> None:
        self.known, self.walker = known, None

    def _built(self) -> ahocorasick.Automaton:
        found = {run: [(len(self.known) + N_PATTERNS - 1, 1)] for run in DRAWN_OUT}
        for term, no in self.known.items():
            head, star, many = term.partition("*")
            if star:
                found.setdefault(f" {head}", []).append((no, int(many or 1)))
            elif term[0] == "~":
                found.setdefault(term[1:].replace("^", " ").replace("$", " "), []).append((no, 1))
            else:
                found.setdefault(f" {term} ", []).append((no, 1))
        walker = ahocorasick.Automaton()
        for letters, held in found.items():
            walker.add_word(letters, (tuple(x for x, least in held if least == 1), tuple(h for h in held if h[1] > 1)))
        walker.make_automaton()
        return walker

    def of(self, text: str | None) -> list[int]:
        """Numbers of the inputs that stand in a text."""
        if not text:
            return []
        if self.walker is None:  # in the task, so that the numbers alone are sent there
            self.walker = self._built()
        found = {len(self.known) + i for i in _found_patterns(text)}
        shared: Counter = Counter()
        for _, (once, several) in self.walker.iter(f" {' '.join(set(_WORD.findall(text.lower())))} "):
            found.update(once)
            if several:
                shared[several] += 1
        found.update(no for several, n in shared.items() for no, least in several if n >= least)
        return sorted(found)


@dataclass
class LabelModel:
    """The share of toxic texts, how often each voter votes in the two classes (toxic, other), each voter's parent in the forest (-1: none), and how often it votes beside its parent's vote or silence."""

    prior: float
    rate: np.ndarray  # class, voter
    parent: np.ndarray  # voter
    beside: np.ndarray  # class, parent's vote, voter

    def posterior(self, matrix: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of votes; a voter that abstains says nothing, but the label's 0 does."""
        has = self.parent >= 0
        led = np.where(has, matrix[:, np.maximum(self.parent, 0)], 0).astype(int)
        odds = np.where(has, np.log(self.beside[0] / self.beside[1])[led, np.arange(matrix.shape[1])], np.log(self.rate[0] / self.rate[1]))
        z = np.log(self.prior / (1 - self.prior)) + (matrix * odds).sum(axis=1)
        z += (1 - matrix[:, -1]) * np.log((1 - self.rate[0, -1]) / (1 - self.rate[1, -1]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def voter_forest(matrix: np.ndarray, weights: list[np.ndarray], least: float = CORRELATED) -> np.ndarray:
    """Each voter's parent in the forest of most mutual information within the classes; the last two columns stay alone."""
    n = matrix.shape[1] - 2
    votes_, total = matrix[:, :n], sum(w.sum() for w in weights)
    shared = np.zeros((n, n))
    for w in weights:
        k = max(w.sum(), 1e-9)
        both, one = (votes_ * w[:, None]).T @ votes_ / k, votes_.T @ w / k
        for p, a, b in ((both, one, one), (one[:, None] - both, one, 1 - one), (one[None, :] - both, 1 - one, one), (1 - one[:, None] - one[None, :] + both, 1 - one, 1 - one)):
            p = np.maximum(p, 1e-12)
            shared += k / total * p * np.log(p / np.maximum(np.outer(a, b), 1e-12))
    parent, best, link, out = np.full(matrix.shape[1], -1), np.full(n, -np.inf), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(out, best, -np.inf))) if (best[out] > least).any() else int(np.argmax(out))
        parent[at], out[at] = (link[at] if best[at] > least else -1), False
        nearer = out & (shared[at] > best)
        best[nearer], link[nearer] = shared[at][nearer], at
    return parent


def fit_label_model(matrix: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 12) -> LabelModel:
    """Expectation maximisation over distinct vote rows with their counts, from first beliefs about each row.

    The last column is the training label, the one before it silence (no voter
    votes). Labels are mostly right, so their rates stay within LABEL_RIGHT.
    """
    belief = start
    parent = voter_forest(matrix, [weight * start, weight * (1 - start)])
    led = matrix[:, np.maximum(parent, 0)]
    model = None
    for _ in range(rounds):
        sums = [weight * belief, weight * (1 - belief)]
        n = [max(float(w.sum()), 1e-9) for w in sums]
        rate = np.array([(matrix.T @ w + 4 * p) / (k + 4) for w, k, p in zip(sums, n, PRIOR_VOTE, strict=True)])
        rate[:, -1] = [min(high, max(low, r)) for r, (low, high) in zip(rate[:, -1], LABEL_RIGHT, strict=True)]
        beside = np.array([[(matrix * where * w[:, None]).sum(axis=0) + 4 * r for where in (1 - led, led)] for w, r in zip(sums, rate, strict=True)])
        seen = np.array([[(where * w[:, None]).sum(axis=0) + 4 for where in (1 - led, led)] for w in sums])
        model = LabelModel(min(0.9, max(0.005, n[0] / sum(n))), rate, parent, beside / seen)
        belief = model.posterior(matrix)
    return model


def fit_classifier(rows: list[list[int]], n: int, weight: np.ndarray, target: np.ndarray, ridge: float = 1.0, block: int = 2048) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, the last for the constant; Newton steps over blocks of rows."""
    penalty = np.append(np.full(n, ridge), 1e-3)
    w = np.zeros(n + 1)
    for _ in range(25):
        slope, bend = penalty * w, np.diag(penalty)
        for at in range(0, len(rows), block):
            part = rows[at : at + block]
            x = np.zeros((len(part), n + 1))
            x[:, n] = 1
            for i, held in enumerate(part):
                x[i, held] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            k, t = weight[at : at + block], target[at : at + block]
            slope += x.T @ (k * (p - t))
            bend += (x * (k * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of every labelled document of the training folds."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    return docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id")


def sampled_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` of these documents, the first by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    first = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").select("text", "toxic")


def learned_terms(rows: DataFrame) -> list[tuple[str, float, float]]:
    """(term, standard score, how many times more often in toxic texts) of the terms that stand in toxic texts more often than by chance.

    The counts are over every row. What comes back is bounded by ``LEARNED`` and ``INPUTS``.
    """
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = sums["n"], sums["t"] or 0
    if not 0 < t < n:
        return []
    counted = term_counts(rows).where(F.col("df") >= LEAST_DOCS)
    a, b = (F.col("hit") + 0.5) / (t + 1), (F.col("df") - F.col("hit") + 0.5) / (n - t + 1)
    expected = F.col("df") * (t / n)
    sure = (F.col("hit") - expected) / F.sqrt(expected * (1 - t / n))
    scored = checkpointed(counted.select("term", sure.alias("sure"), (a / b).alias("times")).where((F.col("sure") >= LIKELY) & (F.col("times") >= 2)))
    best = lambda df, k: df.orderBy(F.desc("sure"), "term").limit(k)
    whole = best(scored.where((F.col("sure") >= SURE) & (F.col("times") >= 4) & ~F.col("term").rlike(PART)), LEARNED)
    return [tuple(r) for r in best(scored, INPUTS).union(whole).distinct().orderBy(F.desc("sure"), "term").collect()]


@dataclass
class Scorer:
    """The classifier's inputs by number and its weights (words, patterns, constant)."""

    known: dict[str, int]
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Voters from the labels, a label model over their votes, and a classifier on its posteriors."""
    found = learned_terms(labelled_rows(docs, labels).select("text", "toxic"))
    voters = [w for w, sure, times in found if sure >= SURE and times >= 4 and not re.search(PART, w)][:LEARNED]
    words = {w: i for i, w in enumerate(dict.fromkeys([*WORDS, *voters]))}
    known = {w: i for i, w in enumerate(dict.fromkeys([*WORDS, *[w for w, *_ in found[:INPUTS]]]))}
    rows = sampled_rows(docs, labels, sample)
    inputs = Inputs(known)
    cast = map_texts(rows, lambda texts: [(",".join(map(str, votes(t, words))), ",".join(map(str, inputs.of(t)))) for t in texts], "votes string, inputs string", ["toxic"])
    counted = cast.groupBy("toxic", "votes", "inputs").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "votes", "inputs").collect()
    if not counted:
        return Scorer(known, np.concatenate([np.full(len(known), 3.0), np.full(N_PATTERNS, 0.3), [-3.0]]))
    n = len(words) + N_PATTERNS + 1
    numbers = lambda text: [int(v) for v in text.split(",") if v]
    matrix = np.zeros((len(counted), n + 1))
    for i, r in enumerate(counted):
        matrix[i, numbers(r["votes"])] = 1
        matrix[i, n - 1 :] = not r["votes"], r["toxic"]
    weight = np.array([r["n"] for r in counted], float)
    model = fit_label_model(matrix, weight, np.where(matrix[:, n] > 0, 0.9, 0.02))
    target = model.posterior(matrix)
    return Scorer(known, fit_classifier([numbers(r["inputs"]) for r in counted], len(known) + N_PATTERNS, weight, target))


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id) and ``score`` of every row."""
    plain, inputs = scorer.weights.tolist(), Inputs(scorer.known)

    def run(texts: list[str | None]) -> list[tuple]:
        return [(float(1 / (1 + np.exp(-max(-30.0, min(30.0, plain[-1] + sum(plain[v] for v in inputs.of(t))))))),) for t in texts]

    return map_texts(docs, run, "score double", keep)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    found = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
