"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound as the
product of its letters' vectors, each permuted by its place; a text is the
bundle (sum) of its trigrams, and a language is the bundle of all its training
texts. A text gets the language whose prototype has the highest cosine.

Training reads every document of the training folds. Each task sends one
partial bundle per language, which are summed by language and dimension; the
prototypes (``DIM`` numbers for each language) are all that reaches the driver.

Cases: a null text, or one without a letter (marks alone are none), is ``und``
with score 0; so is
every text when nothing could be learned; ties go to the first language in
alphabetical order; documents without a lang are never learned from; texts are
read whole; repeated rows are read one by one; a null id passes through, in the
fold of the empty text; other columns, of any name, are not looked at; an empty
table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import fold, map_texts

DIM = 512
#: Trigram vectors that a worker remembers, and languages for which a task keeps partial bundles at once.
MEMO, PARTIAL = 50_000, 256
SPACE = 32


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code point to its lower-cased letter, the mark that it is (vowel signs and accents belong to words), or a space; and which are letters."""
    table, letter = np.full(0x110000, SPACE, np.int64), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c], letter[c] = ord(low) if len(low) == 1 else c, True
        elif unicodedata.category(chr(c)) in ("Mn", "Mc"):
            table[c] = c
    return table, letter


class Space:
    """Letter and trigram vectors, the same in every process."""

    def __init__(self) -> None:
        self.table, self.letter_at = _letters()
        self.letters: dict[int, np.ndarray] = {}
        self.places: dict[int, int] = {}
        self.vectors = np.empty((1024, DIM), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([7, point]).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)
        return self.letters[point]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The vector of each trigram."""
        if len(self.places) > MEMO:
            self.places = {}
        rows = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = self.places.get(g)
            if at is None:
                at = self.places[g] = len(self.places)
                if at >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
                self.vectors[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            rows[i] = at
        return self.vectors[rows]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and their counts; words are set off by single spaces."""
        if not text:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        blank = points == SPACE
        if blank.all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = points[~(blank & np.append(True, blank[:-1]))]
        points = np.concatenate(([SPACE], points, [SPACE])) if points[-1] != SPACE else np.append(SPACE, points)
        return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)

    def bundles(self, texts: list[str | None], groups: np.ndarray | None = None, n: int = 0) -> np.ndarray:
        """One bundle per text, or per group of texts."""
        each = [self.grams(t) for t in texts]
        n = n or len(texts)
        owners = np.repeat(np.arange(len(texts)) if groups is None else groups, [len(g) for g, _ in each])
        grams = np.concatenate([np.empty(0, np.int64), *[g for g, _ in each]])
        counts = np.concatenate([np.empty(0, np.int64), *[c for _, c in each]])
        out = np.zeros((n, DIM))
        distinct, place = np.unique(grams, return_inverse=True)
        for at in range(0, len(distinct), 8192):
            part = (place >= at) & (place < at + 8192)
            width = min(8192, len(distinct) - at)
            dense = np.bincount(owners[part] * width + place[part] - at, counts[part], n * width).reshape(n, width)
            vectors = self.of(distinct[at : at + width])
            out += dense.astype(np.float32) @ vectors.astype(np.float32) if counts.max() < 4096 else dense @ vectors.astype(float)
        return out


_space: list[Space] = []


def _worker() -> Space:
    if not _space:
        _space.append(Space())
    return _space[0]


def learn(docs: DataFrame) -> DataFrame:
    """(lang, dim, v): the bundle of each language over all rows of ``docs`` that have text and lang."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            langs = list(sums)
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array([sums[k].astype(np.int64).tolist() for k in langs], pa.list_(pa.int64()))], names=["lang", "v"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                langs = whole.column(0).slice(at, 256).to_pylist()
                known = {k: i for i, k in enumerate(dict.fromkeys(langs))}
                made = _worker().bundles(whole.column(1).slice(at, 256).to_pylist(), np.array([known[k] for k in langs]), len(known))
                for k, i in known.items():
                    sums[k] = sums.get(k, 0) + made[i]
            if len(sums) > PARTIAL:
                yield sent()
                sums.clear()
        if sums:
            yield sent()

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    parts = rows.mapInArrow(partial, "lang string, v array<bigint>")
    return parts.select("lang", F.posexplode("v").alias("dim", "v")).groupBy("lang", "dim").agg(F.sum("v").alias("v"))


def predict(docs: DataFrame, prototypes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id), ``lang_pred`` and ``score`` (the cosine, 0 at least) of every row."""
    rows = prototypes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in rows]
    matrix = np.array([[x["v"] for x in r["v"]] for r in rows], float).reshape(len(rows), DIM)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix / np.where(norms > 0, norms, 1)))

    def run(texts: list[str | None]) -> list[tuple]:
        langs, matrix = shared.value
        if not langs:
            return [("und", 0.0)] * len(texts)
        space = _worker()
        made = space.bundles(texts)
        size = np.linalg.norm(made, axis=1)
        cosine = made @ matrix.T / np.where(size > 0, size, 1)[:, None]
        best = cosine.argmax(axis=1)
        lettered = [bool(t) and bool(space.letter_at[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any()) for t in texts]
        return [(langs[b], float(min(1.0, max(0.0, c[b])))) if ok else ("und", 0.0) for b, c, ok in zip(best, cosine, lettered, strict=True)]

    return map_texts(docs, run, "lang_pred string, score double", keep)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learned from the rows whose fold is not 0."""
    named = docs.select("doc_id", "text", "lang", fold(F.col("doc_id")).alias("fold"))
    found = predict(named, learn(named.where("fold <> 0")), ["doc_id", "fold"])
    return found.select("doc_id", (F.col("fold") == 0).alias("held_out"), "lang_pred", "score")
