"""How the tokens of two tokenizers correspond, over a whole corpus.

Byte offsets where a token of either side ends cut a text into groups; all
pairs of an A token and a B token of a group are linked. A pair of ids counts
the documents that hold it linked, and a link is best if no other partner of
its A id has a higher count.

Counts stand in dense matrices of bounded size, one for each stripe of A ids
(id modulo the number of stripes, so frequent neighbours fall apart). Documents
are encoded once, a batch at a time, and what they hold is written to the
shared folder as one packed row for each batch and stripe. A first pass adds up
the batches' own counts stripe by stripe; a second brings links and the counts
of their stripe together, large stripes in several parts, and scores them there;
a third adds up the scores of each batch's documents.

Cases: a null or empty text, and one whose joined tokens are not its own bytes
(it holds U+2581), has no tokens and zeros in every count; texts go through
whole; very long runs without white space are one segment; equal texts are
counted as often as they stand; ties for the best partner are all best; null
ids pass through; an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm import pieces, tokens
from gridlark.llm.common import quoted, shared_folder

#: Cells of a stripe's count matrix, eight bytes each.
STRIPE_CELLS = 4_000_000
#: Characters and documents of a batch (its documents are numbered in 16 bits), and segments a worker remembers between batches.
BATCH_CHARS, BATCH_DOCS, MEMO = 1_000_000, 65_000, 150_000
#: Packed bytes of a stripe's links that go to one part, and bytes of sums that a task holds.
PART_BYTES, HELD_BYTES = 64 << 20, 64 << 20
#: White space as byte-level vocabularies see it.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

LINKS = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("doc", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType()), T.StructField("stripe", T.IntegerType()), T.StructField("n_docs", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("cells", "counts", "docs", "times")]
)

ARROW = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 4]


@dataclass(repr=False)
class Pair:
    """Both vocabularies, the byte length of every id, and where texts can be cut for both."""

    a: tokens.Vocabulary
    b: pieces.Vocabulary
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    cut: str
    stripes: int

    @property
    def rows(self) -> int:
        """Rows of a stripe's matrix."""
        return -(-len(self.a_sizes) // self.stripes)


def load(a_path: str, b_path: str) -> Pair:
    """Read a byte-level ``.json`` and a ``.model`` vocabulary.

    A text is cut before white space that follows other characters, if the white
    space begins with a blank (no piece of B reaches across) or with a character
    that no piece of B holds. A's pre-tokens never reach across either.
    """
    a, b = tokens.load(a_path), pieces.load(b_path)
    with open(a_path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    a_sizes = np.zeros(max(ids.values()) + 1, np.int64)
    for token, i in ids.items():
        a_sizes[i] = len(token)  # one stand-in letter for each byte
    held = set(b.chars.tolist())
    unsafe = "".join(c for c in SPACE if c != " " and ord(c) in held)
    cut = f"[{SPACE}]*[^{SPACE}]+" + (f"(?:[{unsafe}][{SPACE}]*[^{SPACE}]*)*" if unsafe else "") + f"|[{SPACE}]+"
    b_sizes = np.array([len(t) for t in b.texts])
    if len(a_sizes) * len(b_sizes) >= 1 << 31:
        raise ValueError("two vocabularies of under 2**31 pairs of ids are asked for")
    return Pair(a, b, a_sizes, b_sizes, cut, max(1, math.ceil(len(a_sizes) * len(b_sizes) / STRIPE_CELLS)))


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, in the narrowest width."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` was given."""
    width, size = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.Codec("zstd").decompress(data[9:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


class Aligner:
    """Aligns batches of texts, remembering segments up to a fixed number."""

    def __init__(self, pair: Pair):
        self.pair, self.cut = pair, re.compile(pair.cut)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.ends, self.codes, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encode and align segments that are not known yet."""
        if not new:
            return
        p = self.pair
        a_ids, a_own = self._a_tokens(new)
        encoded = pieces.encode_segments([s.replace(" ", pieces.MARK) for s in new], p.b)
        b_ids = np.fromiter(chain.from_iterable(encoded), np.int64)
        b_own = np.repeat(np.arange(len(new)), [len(x) for x in encoded])
        a_end, b_end = np.cumsum(p.a_sizes[a_ids]), np.cumsum(p.b_sizes[b_ids])
        both = a_end[np.isin(a_end, b_end, assume_unique=True)]
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        owner = a_own[np.searchsorted(a_end, both)]  # of each group

        ua, ca = np.unique(a_group << 32 | a_ids, return_counts=True)
        ub, cb = np.unique(b_group << 32 | b_ids, return_counts=True)
        partners = np.bincount(ub >> 32, minlength=len(both))
        first = np.cumsum(partners) - partners
        n = partners[ua >> 32]
        left = np.repeat(np.arange(len(ua)), n)
        right = np.repeat(first[ua >> 32], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a, b = ua[left] & 0xFFFFFFFF, ub[right] & 0xFFFFFFFF
        code = (a % p.stripes) * (p.rows * len(p.b_sizes)) + (a // p.stripes) * len(p.b_sizes) + b

        held = owner[ua[left] >> 32]
        size = len(new)
        links = np.bincount(a_group, minlength=len(both)) * np.bincount(b_group, minlength=len(both))
        per = np.zeros((size, 4), np.int64)
        per[:, 0], per[:, 1], per[:, 2] = np.bincount(a_own, minlength=size), np.bincount(b_own, minlength=size), np.bincount(owner, minlength=size)
        np.add.at(per[:, 3], owner, links)
        self.known.update(zip(new, range(len(self.texts), len(self.texts) + size), strict=True))
        self.texts += self._written(a_ids, a_group, b_ids, b_group, owner, size)
        self.sizes = np.concatenate([self.sizes, per])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(held, minlength=size))])
        self.codes, self.times = np.concatenate([self.codes, code]), np.concatenate([self.times, ca[left] * cb[right]])

    def _a_tokens(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [tokens.pretokens(s) for s in new]
        data = [w.encode() for w in chain.from_iterable(cut)]
        symbols = self.pair.a.first[np.frombuffer(b"".join(data), np.uint8)]
        ids, words = tokens.merge_rounds(symbols, np.repeat(np.arange(len(data)), [len(d) for d in data]), self.pair.a.merges)
        return ids, np.repeat(np.arange(len(new)), [len(c) for c in cut])[words]

    @staticmethod
    def _written(a_ids, a_group, b_ids, b_group, owner, size) -> list[str]:
        """The groups of each segment as ``a1,a2|b1;a3|b2``."""
        a_text, b_text = a_ids.astype(str).tolist(), b_ids.astype(str).tolist()
        groups = np.arange(len(owner))
        a_at, b_at = (np.append(np.searchsorted(g, groups), len(g)).tolist() for g in (a_group, b_group))
        made = [
            f"{a_text[i]}|{b_text[k]}" if j - i == 1 == m - k else ",".join(a_text[i:j]) + "|" + ",".join(b_text[k:m])
            for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)
        ]
        ends = np.cumsum(np.bincount(owner, minlength=size)).tolist()
        return [made[i] if j - i == 1 else ";".join(made[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def align(self, texts: list[str | None]) -> tuple[list[tuple], list[tuple]]:
        """A row of counts for each text, and packed links for each stripe of the batch."""
        if len(self.texts) > MEMO:
            self.forget()
        cut = [self.cut.findall(" " + t) if t and pieces.MARK not in t else [] for t in texts]
        known = self.known
        self.learn(list({s for segments in cut for s in segments if s not in known}))
        numbered = [[known[s] for s in segments] for segments in cut]
        ids = np.fromiter(chain.from_iterable(numbered), np.int64)
        lengths = np.array([len(x) for x in numbered])
        bounds = np.append(0, np.cumsum(lengths))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[ids], axis=0)])
        sums = np.diff(sums[bounds], axis=0).tolist()
        shas = [hashlib.sha256(";".join([self.texts[i] for i in own]).encode()).hexdigest() if own else "" for own in numbered]
        return [(*s, sha) for s, sha in zip(sums, shas, strict=True)], self._links(ids, np.repeat(np.arange(len(texts)), lengths))

    def _links(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple]:
        n = self.ends[ids + 1] - self.ends[ids]
        at = np.repeat(self.ends[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        code, times, doc = self.codes[at], self.times[at], np.repeat(doc, n)
        if len(times) and times.max() > 0xFFFF:  # in portions, so that code, document and times fit into one number
            split = -(-times // 0xFFFF)
            last = np.cumsum(split) - 1
            code, doc, rest = np.repeat(code, split), np.repeat(doc, split), times - (split - 1) * 0xFFFF
            times = np.full(len(code), 0xFFFF)
            times[last] = rest
        one = np.sort(code << 32 | doc << 16 | times)
        key, times = one >> 16, one & 0xFFFF
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times, key = np.add.reduceat(times, first) if len(first) else times, key[first]
        code, doc = key >> 16, key & 0xFFFF
        stripe_cells = self.pair.rows * len(self.pair.b_sizes)
        stripe = code // stripe_cells
        out = []
        for k, begin, end in zip(*_runs(stripe), strict=True):
            cells = code[begin:end] - k * stripe_cells
            which, a, b = _runs(cells)
            out.append((k, packed(np.diff(which, prepend=0)), packed(b - a), packed(doc[begin:end]), packed(times[begin:end])))
        return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run of equal values: the value, where it begins and ends."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.zeros(0, np.int64)
    first = np.append(0, ends[:-1])[: len(ends)].astype(np.int64)
    return values[first], first, ends


_workers: dict[str, Aligner] = {}


def _slices(table: pa.RecordBatch, texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BATCH_CHARS or i + 1 - begin >= BATCH_DOCS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < table.num_rows:
        yield begin, table.num_rows


def encoded(docs: DataFrame, a_path: str, b_path: str, keep: list[str]) -> tuple[DataFrame, Pair]:
    """Rows of kind 1 for documents and of kind 0 for the links of a batch in a stripe, written to the shared folder."""
    spark = docs.sparkSession
    pair = load(a_path, b_path)
    shared, key = spark.sparkContext.broadcast(pair), f"{a_path}\n{b_path}"
    own = [f"k{i}" for i in range(len(keep))]
    kept = docs.select(*[quoted(c).alias(n) for c, n in zip(keep, own, strict=True)], quoted("text").cast("string").alias("text"))
    schema = T.StructType([f for f in kept.schema if f.name != "text"] + LINKS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _workers.get(key) or _workers.setdefault(key, Aligner(shared.value))
        at = TaskContext.get().partitionId() << 32
        for table in batches:
            texts = table.column(len(own)).to_pylist()
            for begin, end in _slices(table, texts):
                docs_rows, links = aligner.align(texts[begin:end])
                n, m = end - begin, len(links)
                columns = [pa.concat_arrays([table.column(i).slice(begin, n), pa.nulls(m, table.column(i).type)]) for i in range(len(own))]
                made = [[1] * n + [0] * m, [at] * (n + m), [*range(n)] + [None] * m]
                made += [[r[i] for r in docs_rows] + [None] * m for i in range(5)]
                made += [[None] * n + [int(r[0]) for r in links], [None] * n + [n] * m]
                made += [[None] * n + [r[i] for r in links] for i in range(1, 5)]
                columns += [pa.array(x, t) for x, t in zip(made, ARROW, strict=True)]
                at += 1
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *LINKS.names])

    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    kept.mapInArrow(run, schema).write.parquet(folder)
    return spark.read.parquet(folder), pair


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def counted(links: DataFrame, pair: Pair) -> DataFrame:
    """A row for each stripe: its ``cells`` that hold a count, the ``counts``, and whether each is its row's largest (``best``)."""
    rows, width = pair.rows, len(pair.b_sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = None, None

        def made() -> pa.RecordBatch:
            cells = np.flatnonzero(matrix)
            best = matrix[cells] == matrix.reshape(rows, width).max(axis=1)[cells // width]
            data = [packed(np.diff(cells, prepend=0)), packed(matrix[cells]), packed(best.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], names=["stripe", "cells", "counts", "best"])

        for stripe, cells, counts in _rows(batches):
            if stripe != now:
                if now is not None:
                    yield made()
                matrix, now = np.zeros(rows * width, np.int64), stripe
            np.add.at(matrix, np.cumsum(unpacked(cells)), unpacked(counts))
        if now is not None:
            yield made()

    parts = links.select("stripe", "cells", "counts").repartition("stripe").sortWithinPartitions("stripe")
    return parts.mapInArrow(run, "stripe int, cells binary, counts binary, best binary")


def scored(links: DataFrame, counts: DataFrame, pair: Pair) -> DataFrame:
    """Sums of each batch's documents, from links beside the counts of their stripe: ``batch``, and packed ``docs``, ``n_best`` and ``count_sum``."""
    cells_of = pair.rows * len(pair.b_sizes)
    size = F.sum(F.length("docs") + F.length("times") + F.length("cells"))
    parts = F.broadcast(links.groupBy("stripe").agg(F.floor(size / PART_BYTES).cast("int").alias("more")))  # one row for each stripe
    left = counts.join(parts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("n_docs"), "cells", "counts", F.col("best").alias("docs"), F.lit(None).cast("binary").alias("times"))
    right = links.join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("batch"), F.col("more") + 1).cast("int").alias("part"), F.lit(1).alias("kind"), "batch", "n_docs", "cells", "counts", "docs", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = np.zeros(cells_of, np.int64), np.zeros(cells_of, bool)
        filled = np.zeros(0, np.int64)
        sums: dict[int, np.ndarray] = {}
        held = 0

        def made() -> pa.RecordBatch:
            data = []
            for batch, (n_best, total) in sums.items():
                docs = np.flatnonzero(total)
                data.append((batch, packed(docs), packed(n_best[docs]), packed(total[docs])))
            columns = list(zip(*data, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["batch", "docs", "n_best", "count_sum"])

        for _, _, kind, batch, n_docs, cells, counts, docs, times in _rows(batches):
            at = np.cumsum(unpacked(cells))
            if kind == 0:
                count[filled], best[filled], filled = 0, False, at
                count[at], best[at] = unpacked(counts), unpacked(docs) == 1
                continue
            n, doc, times = unpacked(counts), unpacked(docs), unpacked(times)
            if batch not in sums:
                sums[batch] = np.zeros((2, n_docs), np.int64)
                held += sums[batch].nbytes
            np.add.at(sums[batch][0], doc, times * np.repeat(best[at], n))
            np.add.at(sums[batch][1], doc, times * np.repeat(count[at], n))
            if held > HELD_BYTES:
                yield made()
                sums, held = {}, 0
        yield made()

    both = left.unionByName(right).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    return both.mapInArrow(run, "batch long, docs binary, n_best binary, count_sum binary")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The linked pairs of ids of all documents: ``a_id``, ``b_id``, ``n_docs`` and whether ``b_id`` is a ``best`` partner of ``a_id``."""
    written, pair = encoded(docs, a_path, b_path, [])
    width, stripes = len(pair.b_sizes), pair.stripes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stripe, cells, counts, best in _rows(batches):
            at = np.cumsum(unpacked(cells))
            data = [at // width * stripes + stripe, at % width, unpacked(counts), unpacked(best) == 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["a_id", "b_id", "n_docs", "best"])

    return counted(written.where("kind = 0"), pair).mapInArrow(run, "a_id long, b_id long, n_docs long, best boolean")


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every document.

    The paths are read on the driver; workers get both vocabularies as a
    broadcast of fixed size.
    """
    keep = ["doc_id"] if keep is None else keep
    written, pair = encoded(docs, a_path, b_path, keep)
    links = written.where("kind = 0")
    sums = scored(links, counted(links, pair), pair)
    own = [f"k{i}" for i in range(len(keep))]
    plain = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    left = sums.select("batch", F.lit(0).alias("kind"), *[F.lit(None).cast(written.schema[c].dataType).alias(c) for c in own + plain], "docs", "n_best", "count_sum")
    right = written.where("kind = 1").select("batch", "kind", *own, *plain, *[F.lit(None).cast("binary").alias(c) for c in ("docs", "n_best", "count_sum")])
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, BATCH_DOCS + 1), np.int64)
        for table in batches:
            where, out = [], []
            for i, (batch, kind, doc, docs, n_best, total) in enumerate(_rows([table.select([0, 1, n + 2, n + 8, n + 9, n + 10])])):
                if batch != now:
                    now, sums = batch, np.zeros((2, BATCH_DOCS + 1), np.int64)
                if kind == 0:
                    np.add.at(sums[0], at := unpacked(docs), unpacked(n_best))
                    np.add.at(sums[1], at, unpacked(total))
                else:
                    where.append(i)
                    out.append(sums[:, doc])
            made = np.array(out, np.int64).reshape(-1, 2)
            kept = table.take(pa.array(where, pa.int64()))
            columns = [kept.column(i) for i in (*range(2, n + 2), *range(n + 3, n + 8))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made[:, 0]), pa.array(made[:, 1])], names=[*own, *plain[1:], "n_best", "count_sum"])

    both = left.unionByName(right).repartition("batch").sortWithinPartitions("batch", "kind")
    schema = T.StructType([f for f in right.select(*own, *plain[1:]).schema] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])
    done = both.mapInArrow(run, schema)
    order = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return done.select(*[F.col(o).alias(k) for o, k in zip(own, keep, strict=True)], *order)
