"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

Merging is needed only where a pre-token does not already stand in the
vocabulary as something that its own merges rebuild. Which vocabulary strings
do is proved once on the driver: each is merged alone and must end as a single
token. Those count as one by a set lookup; only the rest is merged, and what a
worker has merged it remembers, up to a fixed number of entries.

Cases: a null text counts like an empty one (0 bytes, 0 tokens); added special
tokens inside a text count as one token each, as the library's default has it;
very long pre-tokens are merged in the same rounds; repeated rows are counted one by
one; a null id passes through; other columns, of any name, are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import map_texts
from gridlark.llm.merging import Merges, merge_rounds

#: How byte-level vocabularies cut a text before merging (a fixed value of that family).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
LIMIT = 1024
#: Pre-tokens that a worker remembers, and the longest that it remembers.
MEMO, MEMO_CHARS = 600_000, 48


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, inverted."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What a worker needs: first symbols of the bytes, merges, whole tokens, special strings."""

    first: np.ndarray
    merges: Merges
    whole: frozenset[str] = frozenset()
    special: tuple[str, ...] = ()


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE ``.json`` file and prove its whole tokens."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw["model"]["type"] != "BPE" or raw["pre_tokenizer"]["type"] != "ByteLevel" or raw["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in raw["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take in their surroundings")
    ids, letters = raw["model"]["vocab"], byte_letters()
    pairs, made = [], []
    for pair in raw["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        pairs.append(ids[left] << 32 | ids[right])
        made.append(ids[left + right])
    first = np.zeros(256, np.int64)
    for letter, b in letters.items():
        first[b] = ids[letter]
    found = Vocabulary(first, Merges(pairs, made, list(range(len(pairs)))), special=tuple(t["content"] for t in raw["added_tokens"]))
    alone = []
    for token in ids:
        try:
            if set(token) <= letters.keys():
                alone.append(bytes(letters[c] for c in token).decode())
        except UnicodeDecodeError:  # never a whole pre-token of a text
            continue
    found.whole = frozenset(t for t, n in zip(alone, merged(alone, found), strict=True) if n == 1)
    return found


def merged(pieces: list[str], vocabulary: Vocabulary) -> list[int]:
    """How many symbols are left of each piece when no pair merges any more."""
    if not pieces:
        return []
    data = [p.encode("utf-8", "surrogatepass") for p in pieces]
    symbols = vocabulary.first[np.frombuffer(b"".join(data), np.uint8)]
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    return np.bincount(merge_rounds(symbols, owner, vocabulary.merges)[1], minlength=len(data)).tolist()


_PIECES = regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    """The pieces of a text that merge apart from each other."""
    return _PIECES.findall(text)


class Counter:
    """Counts batches of texts, remembering what it has merged up to a fixed number of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = dict.fromkeys(vocabulary.whole, 1)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        if len(self.known) > MEMO:
            self.known = dict.fromkeys(self.vocabulary.whole, 1)
        known, cut, out = self.known, [], []
        for text in texts:
            parts = [text or ""]
            for token in self.vocabulary.special:
                parts = [x for part in parts for x in part.split(token)]
            cut.append((len(parts) - 1, [p for part in parts for p in _PIECES.findall(part)]))
        new = list({p for _, pieces in cut for p in pieces if p not in known})
        known.update(zip(new, merged(new, self.vocabulary), strict=True))
        for special, pieces in cut:
            out.append(special + sum([known[p] for p in pieces]))
        for p in new:
            if len(p) > MEMO_CHARS:
                del known[p]
        return out


_workers: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id), ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``path`` is read on the driver; workers get it as a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def measure(texts: list[str | None]) -> list[tuple]:
        counter = _workers.get(path) or _workers.setdefault(path, Counter(shared.value))
        return [(len((t or "").encode("utf-8", "surrogatepass")), n) for t, n in zip(texts, counter.counts(texts), strict=True)]

    rows = map_texts(docs, measure, "n_bytes long, n_tokens long", keep)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
