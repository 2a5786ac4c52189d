"""The pipeline against a plain Python version, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import pandas as pd
import public_tokenizers
import sentencepiece

import corpus_pipeline
from gridlark.llm import queries, secrets
from tests.llm.test_operators import ODD_DOCS, SCHEMA, plain_components, plain_fingerprint, plain_measures

SMALL = "/root/testdata/sf0.001"


def plain_kept(text):
    """The rules, written anew."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat = plain_measures(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    upper = sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words)
    if n < 50 or repeat > n / 2 or symbols > n / 5 or (dup >= 3 and dup > lines / 2) or upper > n / 2:
        return False
    return 2 * n <= chars <= 25 * n and len(set(words)) ** 2 >= n


def plain_leaks(docs, items):
    """Ids of documents that hold an item: every window of the item's length, shingle by shingle."""
    cut = lambda t: [m.lower() for m in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
    shingles = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    known = {tuple(cut(t)) for t in items} - {()}
    held = {k: shingles(k, min(5, len(k))) for k in known}
    count = Counter(s for k in known for s in set(held[k]))
    weight = {s: 1000 // n.bit_length() for s, n in count.items()}
    found = set()
    for d, t in docs:
        words = cut(t)
        for size in {min(5, len(k)) for k in known}:
            own = shingles(words, size)
            shared = [(i, s) for i, s in enumerate(own) if s in weight]
            for k in known if shared else ():
                if min(5, len(k)) == size:
                    mine, total = set(held[k]), sum(weight[s] for s in set(held[k]))
                    for i, s in shared:
                        if s in mine and sum(weight[x] for x in mine & set(own[i : i + len(held[k])])) / total >= 0.8:
                            found.add(d)
    return found


def plain_redacted(text):
    """The spans that the scan reports, cut out by hand."""
    hidden = [False] * len(text)
    for a, b, _ in secrets.find(text)[1]:
        hidden[a:b] = [True] * (b - a)
    spans = sorted((a, b) for a, b, _ in secrets.find(text)[1])
    out, i = "", 0
    while i < len(text):
        if hidden[i]:
            end = i
            for a, b in spans:
                if a <= end and b > end and (a < end or a == i):
                    end = b
            out, i = out + "[SECRET]", end
        else:
            out, i = out + text[i], i + 1
    return out


def test_pipeline_matches_plain_version(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    docs = docs[[plain_kept(t) for t in docs.text]]
    roots = plain_components({d: plain_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)})
    docs = docs[[roots[d] == d for d in docs.doc_id]]
    leaked = plain_leaks(zip(docs.doc_id, docs.text, strict=True), pd.read_parquet(f"{SMALL}/benchmark.parquet").text)
    docs = docs[~docs.doc_id.isin(leaked)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = sp.encode(plain_redacted(t))
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_stages_on_odd_rows(spark):
    for data in (ODD_DOCS, []):
        docs = spark.createDataFrame([(*d, 1, 2, 3) for d in data], SCHEMA + ", _row int, _leaked int, `a.b` int")
        for name, stage in corpus_pipeline.STAGES:  # ids 1 and 2 share a group, the two texts under id 4 are a group each, the row without an id stays
            out = stage(spark, docs, SMALL)
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
            n = {"quality rules": (0, 0), "near-duplicate removal": (5, 0)}.get(name, (7, 0))[not data]
            assert len(out.collect()) == n, name


def test_rows_without_or_under_one_id(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    passage, a, b, c, d = (text() for _ in range(5))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda data: spark.createDataFrame(data, "doc_id long, text string")
    found = lambda df: sorted(((r["doc_id"] or 0), r["text"]) for r in df.collect())
    clean = corpus_pipeline.decontamination_stage(spark, frame([(None, passage), (None, a), (7, passage), (7, b), (8, c)]), str(tmp_path))
    assert found(clean) == sorted([(0, a), (7, b), (8, c)])
    kept = corpus_pipeline.near_dedup_stage(spark, frame([(None, a), (None, a), (None, b), (None, c), (3, c), (4, c), (5, d)]), str(tmp_path))
    assert found(kept) == sorted([(0, a), (0, b), (3, c), (5, d)])
    # id 3 keeps the text that it stands for, not the one that repeats document 1
    kept = corpus_pipeline.near_dedup_stage(spark, frame([(1, min(a, b)), (3, min(a, b)), (3, max(a, b)), (4, max(a, b))]), str(tmp_path))
    assert found(kept) == [(1, min(a, b)), (3, max(a, b))]


def test_encoded_text_is_delivered(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.createDataFrame([(1, "some words  stand here é☃"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.encode_stage(spark, docs, SMALL).collect()}
    ids = sp.encode("some words  stand here é☃")
    assert got[1]["ids"] == ",".join(map(str, ids)) and got[1]["decoded"] == sp.decode(ids) and got[1]["n_tokens"] == len(ids)
    assert got[1]["ids_sha256"] == hashlib.sha256(got[1]["ids"].encode()).hexdigest()
    assert (got[2]["ids"], got[2]["decoded"], got[2]["n_tokens"]) == ("", "", 0)


def test_queries_module_has_all_thirteen():
    assert [int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")] == list(range(1, 14))
