"""Licence statements by a positional index over rare words.

Templates are word sequences: base phrases, short notices, and the paragraphs
of whole licence texts, so a licence that is cut or whose paragraphs stand apart
is still found by those that are left. For each template the corpus decides
which of its words are rare: document frequencies of all template words are
counted over every document (a sum that combines before the shuffle; the result
is bounded by the templates).

A template that must agree in ``k`` of its ``n`` words is indexed under its
``n - k + 2`` words of highest inverse document frequency (all, if it has fewer):
whoever agrees in ``k`` words holds at least ``r - (n - k)`` of these ``r``, two
as a rule, so the index loses nothing. A file's words that stand in the index
give postings; a posting and its word's place give a template's start, and the
postings are intersected by that relative position: a start counts when enough
of its indexed words point at it. Such starts are then verified word by word,
with the template's mandatory phrases. All of this happens inside one row with
built-in functions, and costs no more than sorting the file's postings.

Cases: a null text has no words (n_words 0, no labels, score 0); null ids pass
through; repeated rows are read one by one; an empty table gives no rows (all
words then tie as rarest and the alphabet decides); texts are read whole
whatever their length; other columns, of any name, are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import plain_words


@dataclass(frozen=True)
class Template:
    """Words, the label they mean, the share that must agree, and phrases that must stand in the agreeing place."""

    label: str
    words: str
    share: float = 1.0
    phrases: tuple[str, ...] = ()
    base: bool = False


#: Base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: The method's own templates: notices that name a licence.
NOTICES = (
    Template("cc-by-nc", "licensed under cc by nc 4 0", 0.7, ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 0.7, ("cc by sa",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.75, ("apache license", "version 2")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", 0.7, ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", 0.7, ("gnu general public license", "version 2")),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", 0.75, ("mozilla public license",)),
    Template("cc0", "cc0 1 0 universal"),
    Template("bsl-1.0", "boost software license version 1 0", 0.8, ("boost software license",)),
    Template("epl-2.0", "eclipse public license v 2 0", 0.8, ("eclipse public license",)),
)
_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_WARRANTY = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
    "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
#: Whole licence texts, by paragraph, with the share of words that must agree in place.
TEXTS = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
             "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
             "permit persons to whom the software is furnished to do so subject to the following conditions", 0.7, ("permission is hereby granted",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.75, ("free of charge", "person obtaining a copy")),
    Template("mit", _NOTICE, 0.75, ("this permission notice",)),
    Template("mit", _NO_WARRANTY, 0.7, ("without warranty of any kind",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.75, ("source and binary forms",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.75, ("redistributions of source code",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
             "materials provided with the distribution", 0.75, ("redistributions in binary form",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
             "specific prior written permission", 0.75, ("endorse or promote",)),
    Template("bsd", _BSD_WARRANTY, 0.7, ("are disclaimed",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
             "permission notice appear in all copies", 0.75, ("with or without fee",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.75, ("with or without fee",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.75, ("in compliance with the license",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
             "of any kind either express or implied", 0.7, ("on an as is basis",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.75,
             ("free software foundation",)),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
             "purpose", 0.75, ("in the hope that it will be useful",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", 0.75,
             ("mozilla public license",)),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 0.75, ("alter it and redistribute it freely",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.75, ("public domain",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non "
             "commercial and by any means", 0.75, ("is free to copy modify publish",)),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 0.75, ("as long as the name is changed",)),
)
OWN = NOTICES + TEXTS
TEMPLATES = BASE + OWN


def agreeing(template: Template) -> int:
    """How many words must agree."""
    return math.ceil(template.share * len(template.words.split()) - 1e-9)


def _strings(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of ``vocabulary`` stands; ``words`` has the array ``words``."""
    found = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def indexed(template: Template) -> int:
    """How many positions of a template are indexed: two more than may disagree, or all."""
    n = len(template.words.split())
    return min(n, n - agreeing(template) + 2)


def support(template: Template) -> int:
    """How many of its indexed positions any agreeing place holds at least."""
    return indexed(template) - len(template.words.split()) + agreeing(template)


def rare_index(frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Word to (template, offset) for each template's positions of highest inverse document frequency."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        words = template.words.split()
        rarest = sorted(range(len(words)), key=lambda i: (frequencies.get(words[i], 0), words[i], i))
        for at in rarest[: indexed(template)]:
            index.setdefault(words[at], []).append((t, at))
    return index


def matches(words: Column, index: dict[str, list[tuple[int, int]]], templates: tuple[Template, ...] = TEMPLATES) -> Column:
    """Array of (t, start, share) of the verified places of templates among ``words``."""
    near = F.when(F.arrays_overlap(words, _strings(list(index))), words).otherwise(F.array().cast("array<string>"))
    hits = F.filter(F.transform(near, lambda w, i: F.when(w.isin(list(index)), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    postings = F.map_from_arrays(
        _strings(list(index)),
        F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in index[w]]) for w in index]),
    )
    starts = F.transform(
        hits,
        lambda h: F.filter(F.transform(postings[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["o"]).alias("start"))), lambda p: p["start"] >= 0),
    )
    needs = F.array(*[F.lit(support(t)) for t in templates])

    def intersected(sorted_places: Column) -> Column:
        """Starts that as many postings agree on as their template needs, once each: equal ones stand side by side."""
        fresh = lambda p, i: (i == 0) | (F.get(sorted_places, i - 1) != p)
        return F.filter(sorted_places, lambda p, i: fresh(p, i) & F.coalesce(F.get(sorted_places, i + needs[p["t"]] - 1) == p, F.lit(False)))

    places = F.flatten(F.transform(F.array(F.array_sort(F.flatten(starts))), intersected))
    known = F.array(*[_strings(t.words.split()) for t in templates])
    phrases = F.array(*[F.array(*[F.lit(f" {p} ") for p in t.phrases]).cast("array<string>") for t in templates])
    least = F.array(*[F.lit(agreeing(t)) for t in templates])

    def verified(p: Column) -> Column:
        template = known[p["t"]]
        agree = F.aggregate(
            F.sequence(F.lit(0), F.size(template) - 1),
            F.lit(0),
            lambda n, j: n + F.when(F.get(words, p["start"] + j) == F.get(template, j), 1).otherwise(0),
        )
        return F.struct(p["t"].alias("t"), p["start"].alias("start"), agree.alias("agree"), F.size(template).alias("n"))

    def whole(v: Column) -> Column:
        place = F.concat(F.lit(" "), F.array_join(F.slice(words, F.greatest(v["start"], F.lit(0)) + 1, v["n"]), " "), F.lit(" "))
        return (v["agree"] >= least[v["t"]]) & F.forall(phrases[v["t"]], lambda s: place.contains(s))

    checked = F.filter(F.transform(places, verified), whole)
    return F.transform(checked, lambda v: F.struct(v["t"].alias("t"), v["start"].cast("long").alias("start"), (v["agree"] / v["n"]).alias("share")))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, base places, labels and a score."""
    words = docs.select(F.col(id_col), plain_words(F.col(text_col)).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    index = rare_index(document_frequencies(words, vocabulary), templates)
    found = words.select(id_col, F.size("words").cast("long").alias("n_words"), matches(F.col("words"), index, templates).alias("found"))
    base = F.filter("found", lambda m: m["t"].isin([i for i, t in enumerate(templates) if t.base] or [-1]))
    labels = F.array(*[F.lit(t.label) for t in templates])
    named = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: labels[m["t"]]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A word of a text, as DuckDB writes the pattern.
WORD_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same scan without an index, as DuckDB SQL over ``documents``."""
    rows = ", ".join(
        f"({t}, {_quoted(x.label)}, {str(x.base).lower()}, {agreeing(x)}, {len(x.words.split())}, "
        f"[{', '.join(_quoted(w) for w in x.words.split())}], [{', '.join(_quoted(f' {p} ') for p in x.phrases)}]::varchar[])"
        for t, x in enumerate(templates)
    )
    return f"""
WITH d AS (SELECT doc_id, {WORD_SQL} AS words FROM documents),
t(t, label, base, least, n, tw, phrases) AS (VALUES {rows}),
tw AS (SELECT t, unnest(tw) AS w, generate_subscripts(tw, 1) AS o FROM t),
dw AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
hit AS (SELECT doc_id, t, i - o AS start, count(*) AS agree FROM dw JOIN tw USING (w) GROUP BY ALL),
ok AS (
  SELECT hit.doc_id, t.label, t.base, start, agree / t.n AS share
  FROM hit JOIN t USING (t) JOIN d USING (doc_id)
  WHERE agree >= least AND start >= 0
    AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(words[start + 1:start + n], ' ') || ' ', p))) = 0),
s AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM ok GROUP BY doc_id)
SELECT d.doc_id, len(words)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM d LEFT JOIN s USING (doc_id)
"""
