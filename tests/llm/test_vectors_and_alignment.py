"""Neighbours, alignment and whitening against plain versions, the tokenizer libraries and odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlark.llm import alignment, neighbours, queries, whitening

SF = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int, score int, rank string"


def plain_neighbours(rows, k=5):
    """Every pair in double precision."""
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = [(i, v / np.abs(v).max()) for i, v in fine]
    out = {}
    for i, q in unit:
        if i % 50 == 0:
            best = out.setdefault(i, {})
            for j, v in unit:
                if j != i and len(v) == len(q):
                    score = float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())))
                    best[j] = max(best.get(j, -2), score)
    return {i: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for i, best in out.items()}


def found_neighbours(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_equal_all_pairs(spark):
    table = queries.table(spark, SF, "embeddings")
    got, want = found_neighbours(queries.op11_nearest_neighbours(spark, SF)), plain_neighbours([(r.vec_id, r.embedding) for r in table.collect()])
    assert got.keys() == want.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.98 * 5 * len(want)
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[v]) < 1e-14 for v, s in got[q] if v in scores)


def test_recall_over_many_random_vectors(spark):
    random = np.random.default_rng(3)
    data = [(i, v.tolist()) for i, v in enumerate(random.standard_normal((3000, 24)))]
    got = found_neighbours(neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    want = plain_neighbours(data)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.98 * 5 * len(want)


def test_error_bounds_hold():
    random = np.random.default_rng(5)
    block = neighbours.Block(np.arange(4000), random.standard_normal((4000, 96)).astype(np.float32))
    query = random.standard_normal((20, 96))
    estimates = block.estimates(neighbours._unit(query) @ neighbours.rotation(96))
    exact = np.array([neighbours.cosines(block.vectors.astype(np.float64), q) for q in query])
    assert (np.abs(estimates - exact) > block.bound).mean() < 0.01
    assert abs((estimates - exact).mean()) < 0.002


ODD = [
    (0, [1.0, 0.0, 0.0], 1, 1, "x"),
    (0, [1.0, 0.0, 0.0], 1, 1, "x"),
    (0, [0.0, 1.0, 0.0], 1, 1, "x"),
    (1, [2.0, 0.0, 0.0], 1, None, None),
    (1, [2.0, 0.0, 0.0], 1, 1, "x"),
    (1, [0.0, 2.0, 1.0], 1, 1, "x"),
    (2, [4.0, 0.0, 0.0], None, 1, "x"),
    (3, None, 1, 1, "x"),
    (4, [None, 1.0, 1.0], 1, 1, "x"),
    (5, [float("nan"), 1.0, 1.0], 1, 1, "x"),
    (6, [float("inf"), 1.0, 1.0], 1, 1, "x"),
    (7, [0.0, 0.0, 0.0], 1, 1, "x"),
    (8, [], 1, 1, "x"),
    (None, [1.0, 1.0, 1.0], 1, 1, "x"),
    (-50, [1.0, 1.0, 0.0], 1, 1, "x"),
    (9, [1.0, 1.0], 1, 1, "x"),
    (100, [3.0, 1.0], 1, 1, "x"),
    (10, [1e-30, 1e-30, 1e-30], 1, 1, "x"),
    (11, [1e38, 1e38, -1e38], 1, 1, "x"),
]


def test_neighbours_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, VECTORS)
    got, want = found_neighbours(neighbours.nearest(df)), plain_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys() == {0, -50, 100}
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-14)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_many_equal_vectors_tie_by_id(spark):
    data = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [float(i), 1.0, -1.0, 0.5]) for i in range(2000)]
    got = found_neighbours(neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>")))
    assert [v for v, _ in got[50]] == [1, 2, 4, 5, 7]
    assert {q: [v for v, _ in got[q]] for q in got} == {q: [v for v, _ in r] for q, r in plain_neighbours(data).items()}


def plain_whitening(rows, components=8):
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    size = max(Counter(len(v) for _, v in fine).items(), key=lambda x: (x[1], x[0]))[0] if fine else 0
    fine = [(i, [math.floor(1024 * float(c)) + 100000 for c in v]) for i, v in fine if len(v) == size]
    if not fine:
        return [], 0
    n, x = len(fine), np.array([v for _, v in fine], np.int64)
    sums = [sum(v[d] for _, v in fine) for d in range(size)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for _, v in fine]
    centred = x - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    return [(i, d, (c @ vectors[:, :k] / np.sqrt(values[:k])).tolist(), (values[:k] / np.trace(centred.T @ centred / n)).tolist()) for (i, _), d, c in zip(fine, deviation, centred)], n


def whitened_equal(spark, df):
    want, n = plain_whitening([(r.vec_id, r.embedding) for r in df.collect()])
    got = whitening.whiten(df).collect()
    by = defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-8
        by[r.component].append(r)
    assert len(got) == sum(len(w[2]) for w in want)
    key = lambda i: (i is None, i)
    for k, part in by.items():
        own = sorted(((key(r.vec_id), r.deviation, abs(r.whitened)) for r in part))
        plain = sorted((key(i), d, abs(w[k - 1])) for i, d, w, _ in want)
        assert [x[:2] for x in own] == [x[:2] for x in plain]
        assert np.allclose([x[2] for x in own], [x[2] for x in plain], atol=1e-6)
        assert all(abs(r.explained / want[0][3][k - 1] - 1) < 1e-9 for r in part)
        signs = {r.vec_id: r.whitened for r in part}
        turned = sum(signs[i] * w[k - 1] for i, _, w, _ in want if i in signs)
        assert abs(turned) > 0
    return got


def test_whitening_equals_eigenvectors(spark):
    whitened_equal(spark, queries.table(spark, SF, "embeddings"))


def test_whitening_of_odd_rows(spark):
    df = spark.createDataFrame([r for r in ODD if not (r[1] and any(c and abs(c) > 1e6 for c in r[1] if c and math.isfinite(c)))], VECTORS)
    got = whitened_equal(spark, df)
    assert {r.component for r in got} == {1, 2, 3} and {r.vec_id for r in got} == {0, 1, 2, 7, None, -50, 10}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 2")).count() == 0  # one vector has no variance
    wide = spark.createDataFrame([(i, [float(i * 10**11), float(-i)]) for i in range(40)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(wide).where("component = 1").orderBy("vec_id").collect()
    assert rows[0].deviation is None and rows[0].n == 40  # beyond 64 bits


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    made = []
    for text in texts:
        if not text:
            made.append(None)
            continue
        a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            made.append(None)
            continue
        groups, a_at, b_at = [([], [])], 0, 0
        while a or b:
            if a_at <= b_at and a:
                i, x = a.pop(0)
                groups[-1][0].append(i)
                a_at += len(x)
            else:
                i, x = b.pop(0)
                groups[-1][1].append(i)
                b_at += len(x)
            if a_at == b_at and groups[-1][0] and groups[-1][1]:
                groups.append(([], []))
        made.append(groups[:-1])
    counts = Counter(p for groups in made if groups for p in {(i, j) for a, b in groups for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for groups in made:
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [counts[i, j] == best[i] and (counts[i, j], 1) or (counts[i, j], 0) for a, b in groups for i in a for j in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(x[1] for x in links), sum(x[0] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts, best


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_libraries(spark):
    docs = queries.table(spark, SF, "documents").orderBy("doc_id").collect()
    want, _, _ = plain_alignment([d.text for d in docs])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_cross_tokenizer_alignment(spark, SF).collect()}
    assert len(got) == len(docs)
    assert [got[d.doc_id] for d in docs] == want


PARTS = ["hello", " world", "  ", "\n", "\n\n  x", "\t", "　", "\xa0", " \xa0", "é", "ab c", "日本語", "👍🏽", "don't", "don 't", "<|endoftext|>", "<s>", "▁", "a" * 40, "123456", "...", "\r\n", "\x0b y", "\x00", "﻿", "ﬁ", " the", "the", " ", "x　  y", "ß" * 9]


@pytest.fixture(scope="module")
def pair():
    return alignment.load(A, B)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
def test_texts_align_like_libraries(pair, texts):
    want, counts, _ = plain_alignment(texts)
    rows, links = alignment.Aligner(pair).align(texts)
    assert [(*r[:4], r[4]) for r in rows] == [(*w[:4], w[6]) for w in want]
    got = Counter()
    for stripe, cells, n, _, _ in links:
        for cell, count in zip(np.cumsum(alignment.unpacked(cells)).tolist(), alignment.unpacked(n).tolist()):
            got[cell // len(pair.b_sizes) * pair.stripes + int(stripe), cell % len(pair.b_sizes)] += count
    assert got == counts


def test_alignment_of_odd_rows(spark, monkeypatch):
    texts = [None, "", " ", "hello world", "hello world", "▁", "a▁b", "x" * 90_000, "hello　 world\n\n  again", "éé " * 3000]
    df = spark.createDataFrame([(i if i != 4 else None, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, batch int, kind string")
    want, counts, best = plain_alignment(texts)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(df.repartition(3), A, B).collect()}
    assert [got[i if i != 4 else None] for i in range(len(texts))] == want
    pairs = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in alignment.pair_counts(df, A, B).collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in counts.items()}
    assert alignment.align(df.limit(0), A, B).count() == 0
    monkeypatch.setattr(alignment, "PART_BYTES", 8)  # every stripe in several parts
    again = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(df.repartition(5), A, B).collect()}
    assert again == got


def test_packing():
    for numbers in ([], [0], [255, 1], [65_536, 3], [1 << 40, 7]):
        assert alignment.unpacked(alignment.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_extra_columns_pass(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "a"), (50, [2.0, 1.0], "b")], "vec_id long, embedding array<double>, `odd.name` string").withColumn("block", F.lit(1))
    assert neighbours.nearest(df).count() == 2
