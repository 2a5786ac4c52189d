"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where no vocabulary piece can reach across (before each run of
word-boundary marks; this is proved when the vocabulary is read), so each
distinct segment of a batch is encoded once, all of them together in the merge
rounds of ``merging``.

Cases: null is read like an empty text, which has no ids and decodes to an
empty text; characters outside the vocabulary become byte pieces; texts are
encoded whole; repeated rows are encoded one by one; an empty table gives no
rows; a null id passes through; other columns, of any name, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from gridlark.llm.common import map_texts
from gridlark.llm.merging import Merges, merge_rounds

MARK = "▁"
#: Segments that a worker remembers, and the longest that it remembers.
MEMO, MEMO_CHARS = 100_000, 32
_SEGMENTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Vocabulary:
    """Characters as sorted arrays, the merges, byte pieces, and what each id decodes to."""

    chars: np.ndarray
    char_ids: np.ndarray
    merges: Merges
    byte_ids: list[int]
    texts: list[bytes]


def load(path: str) -> Vocabulary:
    """Read a BPE ``.model`` file and prove what the rounds rely on."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
    if not plain or train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces):
        raise ValueError(f"{path} is not a plain BPE vocabulary with byte fallback")
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
        raise ValueError(f"{path} has pieces across word boundaries")
    scores = sorted({s for _, s in normal.values()}, reverse=True)
    rank_of = {s: r for r, s in enumerate(scores)}
    pairs, made, ranks = [], [], []
    for piece, (i, score) in normal.items():
        for cut in range(1, len(piece)):
            a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
            if a and b:
                pairs.append(a[0] << 32 | b[0])
                made.append(i)
                ranks.append(rank_of[score])
    chars = sorted((ord(p), i) for p, (i, _) in normal.items() if len(p) == 1)
    byte_ids = [0] * 256
    texts = [b""] * len(model.pieces)
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte = int(p.piece[1:-1], 16)
            byte_ids[byte], texts[i] = i, bytes([byte])
        elif p.type == 1:
            texts[i] = p.piece.replace(MARK, " ").encode()
        elif p.type == 2:
            texts[i] = train.unk_surface.encode()
    return Vocabulary(np.array([c for c, _ in chars]), np.array([i for _, i in chars]), Merges(pairs, made, ranks), byte_ids, texts)


def encode_segments(segments: list[str], v: Vocabulary) -> list[list[int]]:
    """The ids of each non-empty segment."""
    points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    owner = np.repeat(np.arange(len(segments)), sizes)
    at = np.minimum(np.searchsorted(v.chars, points), len(v.chars) - 1)
    symbols = np.where(v.chars[at] == points, v.char_ids[at], -1 - points)
    flat, owners = merge_rounds(symbols, owner, v.merges)
    flat, ends = flat.tolist(), np.cumsum(np.bincount(owners, minlength=len(segments))).tolist()
    out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [ids if min(ids) >= 0 else _with_bytes(ids, v) for ids in out]


def _with_bytes(ids: list[int], v: Vocabulary) -> list[int]:
    out = []
    for i in ids:
        out += [i] if i >= 0 else [v.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
    return out


class Codec:
    """Encodes batches of texts, remembering short segments up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, tuple[str, int, str]] = {}

    def rows(self, texts: list[str | None]) -> list[tuple[str, int, str]]:
        """Comma-joined ids, their number, and the decoded text of each text."""
        cut = [_SEGMENTS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > MEMO:
            self.known = {}
        known, pieces = self.known, self.v.texts
        new = list({s for segments in cut for s in segments if s not in known})
        for s, ids in zip(new, encode_segments(new, self.v) if new else [], strict=True):
            known[s] = (",".join(map(str, ids)), len(ids), b"".join([pieces[i] for i in ids]).decode("utf-8", "replace"))
        out = []
        for segments in cut:
            parts = [known[s] for s in segments]
            text = "".join([p[2] for p in parts])
            out.append((",".join([p[0] for p in parts]), sum([p[1] for p in parts]), text[1:]))
        for s in new:
            if len(s) > MEMO_CHARS:
                del known[s]
        return out


_workers: dict[str, Codec] = {}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, digest: bool = True) -> DataFrame:
    """The columns ``keep`` (the id), ``n_tokens``, and the ids and decoded text, or SHA-256 of both.

    ``path`` is read on the driver; workers get the vocabulary as a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(texts: list[str | None]) -> list[tuple]:
        codec = _workers.get(path) or _workers.setdefault(path, Codec(shared.value))
        rows = codec.rows(texts)
        return [(n, _sha(ids), _sha(text)) if digest else (n, ids, text) for ids, n, text in rows]

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    return map_texts(docs, run, f"n_tokens long, {names[0]} string, {names[1]} string", keep)
