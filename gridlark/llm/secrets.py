"""Secrets in text: three base patterns, and an assignment-aware lexer beside them.

The lexer cuts source and configuration into tokens (strings with escapes and
triple quotes, names, bare values, ``${name}`` references, operators, tags) and
reads bindings from them: ``name = value``, ``name: value``, ``name: type =
value``, quoted names as in JSON, subscripts (``environ["NAME"] = value``), and
``<name>value</name>``. A value is a sum of terms: literals, other names, and
what stands in a call's brackets.

Constants are propagated over the whole text, in either direction: a name is as
sensitive as the most sensitive name that its value flows into, and a literal
as the most sensitive name that it reaches. A literal that looks like a secret
value (by length, variety and classes of characters; the parts of a sum are
also judged together) under such a name is a span of kind ``named``, unless it
lies inside a base span.

Every step is linear in the text (sorting spans aside): tokens are read once,
sensitivity flows along each binding once, literals are measured once.

Cases: a null text is read like an empty one; texts are read whole whatever
their length; repeated rows are scanned one by one; a literal bound several
times counts once, at its highest score; a null id passes through; an empty
table gives no rows; other columns, of any name, are never looked at and stay
in ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gridlark.llm.common import map_texts, quoted

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "named")

#: How sensitive a name is that holds these parts, and parts that say it names something about a secret instead.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("pwd",): 0.9, ("passphrase",): 1.0, ("secret",): 0.9, ("token",): 0.8, ("apikey",): 0.9,
    ("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9,
    ("auth", "key"): 0.9, ("credential",): 0.9, ("credentials",): 0.9, ("bearer",): 0.8, ("authorization",): 0.7,
}
HARMLESS = {"count", "length", "len", "hint", "url", "uri", "path", "file", "name", "type", "id", "limit", "max", "min", "size", "policy", "field", "label"}
PLACEHOLDERS = re.compile(r"changeme|example|placeholder|your[-_ ]|dummy|redacted|xxxx|\*{3}|^<.*>$|^(true|false|none|null|undefined)$", re.I | re.A)
THRESHOLD = 0.6
SCALE, LEAST_LENGTH = 1.25, 8

_HINT = re.compile(r"pass|pwd|secret|token|key|credential|bearer|authorization", re.I | re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.A)
#: One token; of alternatives the first that fits. Quotes after a word character are apostrophes, unless a string prefix stands before them.
_TOKEN = re.compile(
    r'''
    (?P<long>(?:(?<!\w)[bBrRuUfF]{1,2})?(?:"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'))
  | (?P<string>(?<!\w)(?:[bBrRuUfF]{1,2})?(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|"(?:[^"\\\n]|\\.)*")
  | (?P<close></[A-Za-z_][\w.:\-]*\s*>)
  | (?P<tag><[A-Za-z_][\w.:\-]*(?=[\s>]))
  | (?P<ref>\$\{[\w.\-]+\}|\$[A-Za-z_]\w*|\{\{\s*[\w.\-]+\s*\}\})
  | (?P<bind>:=|=>|(?<![=!<>])=(?![=~])|:(?![:/]))
  | (?P<skip>\\\r?\n)
  | (?P<name>(?:--?)?[A-Za-z_]\w*(?:[.\-][A-Za-z_]\w*)*(?![\w+/.\-@%&*!?|~^]))
  | (?P<bare>[^\s"'`(){}\[\],;<>=:+]+(?:[+=:][^\s"'`(){}\[\],;<>+]+)*=*)
  | (?P<plus>\+|(?<=\s)\.(?=\s))
  | (?P<open>[(\[{])
  | (?P<shut>[)\]}])
  | (?P<end>[\n;,])
  | (?P<gt>>)
    ''',
    re.A | re.X | re.S,
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """0 to 1: how likely what ``name`` holds is secret."""
    parts = {p.lower() for p in _PARTS.findall(name)}
    best = max((w for need, w in SENSITIVE.items() if parts.issuperset(need)), default=0.0)
    return best * 0.3 if parts & HARMLESS else best


def literal_score(counts: Counter) -> float:
    """0 to 1: how far characters look like those of a secret value, by length, variety and classes."""
    n = counts.total()
    if n < LEAST_LENGTH or any(c.isspace() for c in counts):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    ascii_ = [c for c in counts if c.isascii()]
    classes = any(c.islower() for c in ascii_) + any(c.isupper() for c in ascii_) + any(c.isdigit() for c in ascii_) + any(not (c.isascii() and c.isalnum()) for c in counts)
    return min(1.0, entropy / 4) * (0.55 + 0.15 * classes)


@dataclass
class Binding:
    """One ``name = value``: the literals of the value as (start, end), and the names in it."""

    name: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    bare: list[tuple[int, int]] = field(default_factory=list)


def _content(m: re.Match) -> tuple[int, int]:
    """Where the content of a string token stands, without prefix and quotes."""
    token, width = m.group(), 3 if m.lastgroup == "long" else 1
    begin = m.start() + len(token) - len(token.lstrip("bBrRuUfF"))
    return begin + width, m.end() - width


def bindings(text: str) -> list[Binding]:
    """The bindings of a text, by one walk over its tokens.

    ``target`` is what would be bound if an operator came next; ``value`` is the
    binding whose value is being read, until a line or an argument ends, or the
    bracket in which it began shuts. Terms follow a ``+`` or open a value.
    """
    made: list[Binding] = []
    target: str | None = None
    value: Binding | None = None
    expects, depth, began, inside = False, 0, 0, False
    subscript: str | None = None
    tag: tuple[str, int] | None = None
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":  # a line that goes on
            continue
        if kind in ("long", "string"):
            a, b = _content(m)
            if value is not None and (expects or depth > began):
                value.literals.append((a, b))
                expects = False
            else:
                value = None
            target = subscript = text[a:b]
        elif kind == "ref":
            if value is not None and (expects or depth > began):
                value.names.append(m.group().strip("${ }"))
                expects = False
            target = None
        elif kind == "name":
            if value is not None and (expects or depth > began):
                value.names.append(m.group())
                value.bare.append(m.span())
                expects = False
            else:
                value = None
            target = m.group().lstrip("-")
        elif kind == "bare":
            if value is not None and expects:
                value.bare.append(m.span())
                expects = False
            elif depth <= began:
                value = None
            target = None
        elif kind == "bind":
            if target is not None:
                if value is not None and value.names == [target] and not value.literals and m.group() == "=":
                    value.names.clear()  # ``name: type = value``, or a word and a colon before ``name = value``: the value is bound to both
                    value.bare.clear()
                    made.append(Binding(target, value.literals, value.names, value.bare))
                else:
                    value = Binding(target)
                    made.append(value)
                    began = depth
                expects = True
            target = None
        elif kind == "plus":
            expects = value is not None
            target = None
        elif kind == "open":
            depth += 1
            if value is not None and m.group() != "(" and expects:
                value = None  # a list or an object: its members are bindings of their own
            target = None
        elif kind == "shut":
            depth -= 1
            if value is not None and depth < began:
                value = None
            target = subscript if m.group() == "]" else None
        elif kind == "tag":
            tag, inside, target = (m.group()[1:], m.end()), True, None
        elif kind == "gt":
            if inside and tag:
                tag, inside = (tag[0], m.end()), False
            value = target = None
        elif kind == "close":
            if tag and not inside and tag[0] == m.group()[2:-1].strip():
                a, b = tag[1], m.start()
                made.append(Binding(tag[0], [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip()))]))
            tag = value = target = None
        elif m.group() == ",":
            if depth <= began:
                value = None
            target = None
        elif not (expects or depth > began):  # a line or a statement ends; an open bracket or a dangling ``+`` goes on
            value = target = None
        else:
            expects = expects and m.group() == "\n" and value is not None and bool(value.literals or value.names)
            if not expects and depth <= began:
                value = None
            target = None
    return made


def sensitivities(made: list[Binding]) -> dict[str, float]:
    """For each name the score of the most sensitive name that its value flows into, itself included.

    Names are taken from the most sensitive down and each is reached once, so the
    first score that arrives is the highest.
    """
    sources: dict[str, list[str]] = {}
    for b in made:
        sources.setdefault(b.name, []).extend(b.names)
    reached: dict[str, float] = {}
    for name in sorted(sources, key=lambda n: (-name_score(n), n)):
        score, stack = name_score(name), [name]
        while score and stack:
            at = stack.pop()
            if at not in reached:
                reached[at] = score
                stack += sources.get(at, ())
    return reached


def named_literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of each literal that reaches a sensitive name, by start."""
    if not _HINT.search(text):
        return []
    made = bindings(text)
    reached = sensitivities(made)
    if not reached:
        return []
    bound = {b.name for b in made}
    counts: dict[tuple[int, int], Counter | None] = {}

    def measured(a: int, b: int) -> Counter | None:
        if (a, b) not in counts:
            counts[a, b] = None if b <= a or PLACEHOLDERS.search(text, a, b) or PLACEHOLDERS.fullmatch(text[a:b]) else Counter(text[a:b])
        return counts[a, b]

    first: dict[str, tuple[int, int]] = {}
    for b in made:
        if b.literals and b.name not in first:
            first[b.name] = b.literals[0]
    scores: dict[tuple[int, int], float] = {}
    for b in made:
        sensitive = reached.get(b.name, 0.0)
        if not sensitive:
            continue
        own = b.literals + [(x, y) for x, y in b.bare if text[x:y] not in bound and text[y : y + 1] != "(" and _valued(text[x:y])]
        others = [first[n] for n in b.names if n in first]
        parts = list(dict.fromkeys(own + others))
        known = [c for c in (measured(x, y) for x, y in parts) if c is not None]
        together = literal_score(sum(known, Counter())) if len(known) > 1 else 0.0
        for x, y in own + (others if len(parts) > 1 else []):
            alone = measured(x, y)
            if alone is not None:
                score = min(1.0, sensitive * max(literal_score(alone), together) * SCALE)
                if score >= THRESHOLD:
                    scores[x, y] = max(score, scores.get((x, y), 0.0))
    return sorted((a, b, s) for (a, b), s in scores.items())


def _valued(bare: str) -> bool:
    """Whether an unquoted word reads as a value, not as a name in code: it holds a digit."""
    return any("0" <= c <= "9" for c in bare)


def find(text: str | None) -> tuple[list[Span], list[Span], float]:
    """Base spans, all spans, and the highest score of a named literal."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=order)
    named = named_literals(text)
    new: list[Span] = []
    at, reach = 0, -1  # the furthest end of the base spans that begin up to the literal
    for a, b, _ in named:
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][1])
            at += 1
        if reach < b:
            new.append((a, b, "named"))
    return base, sorted(base + new, key=order), max((s for *_, s in named), default=0.0)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _row(text: str | None) -> tuple:
    base, spans, score = find(text)
    kinds = Counter(k for *_, k in base)
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return kinds["assign"], kinds["access"], kinds["hex"], digest, _joined(spans), score


def secret_spans(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (the id), counts of base spans, their digest, all spans and the named literals' highest score."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, score double"
    return map_texts(docs, lambda texts: [_row(t) for t in texts], schema, keep, text_col)


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by ``[SECRET]``; overlapping spans become one."""
    if not text or not (spans := find(text)[1]):
        return text
    out, at, last = [], 0, -1
    for a, b, _ in spans:
        if a >= last:
            out += [text[at:a], "[SECRET]"]
        last = at = max(last, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; every other column stays as it is."""
    others = [c for c in docs.columns if c != text_col]
    done = map_texts(docs, lambda texts: [(redact_text(t),) for t in texts], f"{text_col} string", others, text_col)
    return done.select(*[quoted(c) for c in docs.columns])
