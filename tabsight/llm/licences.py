"""Licence scan by a positional rare-token index. DataFrame functions only.

Words of the templates are ranked by how many documents hold them (inverse document frequency). In each file the licence words of highest rank are looked
up, for each template the rarest words of its mandatory phrases; a file that lacks one of them can't hold the template. The places of these words, less their
places in the template, are intersected: what is left are positions where all of them stand in their relative places. A position counts when all mandatory
phrases stand there, and its score is the share of template words that stand at theirs. As every accepted position holds the looked-up words, nothing else in
a file can hide one. A template without such phrases is looked up by so many of its rarest words that two or more of them agree wherever enough of the
template stands. Plain phrases are found from their rarest word, wherever they occur.
"""

import re
from functools import reduce
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RARE, VOTES, LEAST_SHARE = 3, 2, 0.5


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    mandatory: tuple[tuple[int, tuple[str, ...]], ...]  # (place in the template, words)


def template(label: str, text: str, *mandatory: str) -> Template:
    words, found = tuple(re.findall("[0-9a-z]+", text.lower())), []
    for phrase in mandatory:
        m = tuple(phrase.split())
        found.append((next(i for i in range(len(words)) if words[i:i + len(m)] == m), m))
    return Template(label, words, tuple(found))


# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences of public licences and of the usual notices.
TEMPLATES = (
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
             "to deal in the software without restriction", "permission is hereby granted free of charge", "to deal in the software without restriction"),
    template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             "redistribution and use in source and binary forms"),
    template("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
             "either version 3 of the license or at your option any later version", "gnu general public license", "either version 3 of the license"),
    template("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
             "either version 2 of the license or at your option any later version", "gnu general public license", "either version 2 of the license"),
    template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
)
# Short notices that name a licence.
NOTICES = (
    template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-3", "licensed under the gnu gpl version 3", "gnu gpl version 3"),
    template("gpl-3", "licensed under the gnu gpl v3", "gnu gpl v3"),
    template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("gpl-2", "licensed under the gnu gpl version 2", "gnu gpl version 2"),
    template("gpl-2", "licensed under the gnu gpl v2", "gnu gpl v2"),
    template("mit", "licensed under the mit license", "under the mit license"),
    template("apache-2", "licensed under the apache license 2 0", "apache license 2 0"),
    template("bsd", "licensed under the bsd license", "under the bsd license"),
    template("bsd", "licensed under the bsd 3 clause license", "bsd 3 clause license"),
    template("bsd", "licensed under the bsd 2 clause license", "bsd 2 clause license"),
    template("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
)
# Whole texts of short public licences.
TEXTS = (
    template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "without limitation the rights to use copy modify merge publish distribute sublicense"),
    template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "for any purpose with or without fee is hereby granted"),
    template("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistribution and use in source and binary forms", "other materials provided with the distribution this software is provided by"),
    template("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistribution and use in source and binary forms", "to endorse or promote products derived from this software"),
    template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from
        any source distribution.""", "to alter it and redistribute it freely", "altered source versions must be plainly marked as such"),
    template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "free and unencumbered software released into the public domain"),
)
ALL = TEMPLATES + NOTICES + TEXTS


def words_of(text: Column) -> Column:
    """The words of a text in lower case (A-Z only): runs of ASCII letters and digits and of everything beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), *LETTERS)
    # white space for every gap first: a split at one character is the fast one
    return F.filter(F.split(F.regexp_replace(lower, GAP, " "), " "), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _array(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ")  # a constant; one expression however many words


def _seeds(t: Template, rank: dict[str, int], rare: int, votes: int, least: float) -> tuple[list[tuple[str, int]], int]:
    """Postings (word, place in the template) of the words a template is looked up by, the rarest first, and how many must agree on a position. With mandatory
    phrases the ``rare`` rarest of their words, which all stand at every accepted position. Else the rarest words at all their places: at most ``len - need``
    places of an accepted position differ, so ``votes`` of them stand."""
    if t.mandatory:
        places: dict[str, int] = {}
        for at, phrase in t.mandatory:
            for j, x in enumerate(phrase):
                places.setdefault(x, at + j)
        chosen = sorted(places.items(), key=lambda p: rank[p[0]])[:rare]
        return chosen, len(chosen)
    need = max(1, next(k for k in range(len(t.words) + 1) if k / len(t.words) >= least))
    votes, chosen, words = min(votes, need), [], sorted(set(t.words), key=rank.__getitem__)
    for x in words:
        if len(chosen) >= len(t.words) - need + votes:
            break
        chosen += [(x, j) for j, y in enumerate(t.words) if y == x]
    return chosen, votes


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the templates occurs, over all of them. At most one row per template word comes back."""
    present = F.explode(F.array_intersect(words_of(F.col(text_col)), _array(vocabulary)))
    found = docs.select(present.alias("w")).groupBy("w").count().collect()
    return {w: 0 for w in vocabulary} | {r["w"]: r["count"] for r in found}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: tuple[Template, ...] = ALL, rare: int = RARE, votes: int = VOTES, least: float = LEAST_SHARE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base (places of the phrases), first_word and last_word (smallest and largest of these places, else null),
    base_labels, labels (those and the templates'), places (template label, first word, share of its words found) and score (1 with a phrase,
    else the best template's share, else 0).

    Null and empty texts have no words, empty labels and score 0. Ids may be null or repeat. Equal rows have equal results. Phrases may overlap. An empty table
    gives no rows. Other columns are not read. Whole texts are scanned and every position of a template counts, however many licences a file has; the tables of
    phrases and templates go into the plan as literals.
    """
    phrases = [(tuple(p.split()), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    vocabulary = sorted({w for p, _ in phrases for w in p} | {w for t in templates for w in t.words})
    frequency = document_frequencies(docs, text_col, vocabulary)
    by_idf = sorted(vocabulary, key=lambda w: (frequency[w], w))
    rank = {w: i for i, w in enumerate(by_idf)}
    rarest = lambda words: min(words, key=rank.__getitem__)
    seeds = {t: _seeds(t, rank, rare, votes, least) for t in templates}
    own = {t: sorted({x for x, _ in postings}, key=rank.__getitem__) for t, (postings, _) in seeds.items()}
    phrase_anchors = {rarest(p) for p, _ in phrases}
    anchors = sorted(phrase_anchors | {x for words in own.values() for x in words}, key=rank.__getitem__)

    def looked_up(present):
        """Of the file's licence words (``present``, highest rank first) those that some template it may hold, or a phrase, is looked up by."""
        groups = [F.when(_may_hold(t, present), _array(own[t])) for t in templates]
        groups += [F.filter(_array(sorted(phrase_anchors)), lambda x: F.array_contains(present, x))] if phrase_anchors else []
        return F.array_distinct(F.flatten(F.filter(F.array(*groups), lambda g: g.isNotNull())))

    def _may_hold(t, present):
        if t.mandatory:
            return F.forall(_array(own[t]), lambda x: F.array_contains(present, x))
        return F.exists(_array(own[t]), lambda x: F.array_contains(present, x))

    def examine(w, present):
        places = _let(looked_up(present), lambda chosen: F.when(F.size(chosen) > 0, F.filter(
            F.transform(w, lambda x, i: F.when(F.array_contains(chosen, x), F.struct(i.alias("i"), x.alias("w")))), lambda s: s.isNotNull())))
        return _let(places, lambda p: F.when(p.isNotNull(), found(w, present, p)))

    def found(w, present, places):
        base = []
        for words, _ in phrases:
            anchor = rarest(words)
            at = words.index(anchor)
            base.append(F.filter(_starts(places, anchor, at), _stands(w, words)))
        hits = [F.when(_may_hold(t, present), _matches(w, places, t)) for t in templates]
        return F.struct(*[b.alias(f"b{i}") for i, b in enumerate(base)], *[h.alias(f"t{i}") for i, h in enumerate(hits)])

    def _starts(places, anchor, at):
        return F.transform(F.filter(places, lambda s: s["w"] == anchor), lambda s: s["i"] - at)

    def _stands(w, words):
        return lambda o: (o >= 0) & (F.slice(w, F.greatest(o, F.lit(0)) + 1, len(words)) == _array(words))

    def _matches(w, places, t):
        """(place, share) of the template's accepted positions."""
        postings, needed = seeds[t]
        if t.mandatory:
            agreed = reduce(F.array_intersect, [_starts(places, x, at) for x, at in postings])
        else:
            table = F.array(*[F.struct(F.lit(x).alias("w"), F.lit(j).alias("j")) for x, j in postings])
            proposed = F.flatten(F.transform(F.filter(places, lambda s: s["w"].isin(own[t])), lambda s: F.transform(
                F.filter(table, lambda y: y["w"] == s["w"]), lambda y: s["i"] - y["j"])))
            # sorted, so that positions with enough votes are those with an equal one ``needed - 1`` before
            agreed = _let(F.array_sort(proposed), lambda s: F.filter(s, lambda o, i: (F.get(s, i - (needed - 1)) == o) & F.coalesce(F.get(s, i - needed) != o, F.lit(True))))
        verified = agreed
        for at, m in t.mandatory:
            verified = F.filter(verified, _phrase_at(w, at, m))
        zero, whole = F.lit(0), F.lit(len(t.words))
        equal = lambda o: F.zip_with(F.slice(w, F.greatest(o, zero) + 1, whole), F.slice(_array(t.words), F.greatest(-o, zero) + 1, whole), lambda x, y: x == y)
        share = lambda o: F.size(F.filter(equal(o), lambda e: e)) / F.lit(float(len(t.words)))
        return F.filter(F.transform(verified, lambda o: F.struct(o.cast("long").alias("word"), share(o).alias("share"))), lambda m: m["share"] >= least)

    def _phrase_at(w, at, m):
        return lambda o: _stands(w, m)(o + at)

    shape = "struct<" + ",".join([f"b{i}:array<int>" for i in range(len(phrases))] + [f"t{i}:array<struct<word:bigint,share:double>>" for i in range(len(templates))]) + ">"
    row = _let(words_of(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), _let(F.array_intersect(_array(anchors), w), lambda present: F.when(F.size(present) > 0, examine(w, present))).cast(shape).alias("f")))
    base = [F.coalesce(F.col(f"r.f.b{i}"), F.array().cast("array<int>")) for i in range(len(phrases))]
    hits = [F.coalesce(F.col(f"r.f.t{i}"), F.array().cast("array<struct<word:bigint,share:double>>")) for i in range(len(templates))]
    n_base = sum((F.size(b) for b in base), F.lit(0)).cast("long")
    starts = F.concat(*base)
    named = lambda pairs: F.array_distinct(F.array_sort(F.filter(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, label in pairs]), lambda s: s.isNotNull())))
    base_pairs = [(b, label) for b, (_, label) in zip(base, phrases)]
    all_pairs = base_pairs + [(h, t.label) for h, t in zip(hits, templates)]
    spots = F.concat(*[F.transform(h, _labelled(t.label)) for h, t in zip(hits, templates)])
    out = docs.select(F.col(id_col).alias("_id"), row.alias("r")).select(
        F.col("_id").alias(id_col), F.col("r.n").alias("n_words"), n_base.alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_join(named(base_pairs), ",").alias("base_labels"),
        F.array_join(named(all_pairs), ",").alias("labels"), spots.alias("places"))
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
    return out.withColumn("score", F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best))


def _labelled(label: str):
    return lambda m: F.struct(F.lit(label).alias("label"), m["word"].alias("word"), m["share"].alias("share"))


def oracle_sql(phrases: dict[str, str] = PHRASES, templates: tuple[Template, ...] = ALL, least: float = LEAST_SHARE) -> str:
    """The same result without ``places`` as DuckDB SQL over ``documents``; ids must be distinct and templates have mandatory phrases."""
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    postings = ", ".join(f"({k}, {j}, '{x}')" for k, t in enumerate(templates) for j, x in enumerate(t.words))
    needed = " UNION ALL ".join(f"SELECT {k} AS t, {at} AS place, {quote(m)} AS m" for k, t in enumerate(templates) for at, m in t.mandatory)
    labels = ", ".join(f"({k}, '{t.label}', {len(t.words)}, {len(t.mandatory)})" for k, t in enumerate(templates))
    base = " UNION ALL ".join(f"SELECT {quote(p.split())} AS p, '{label}' AS label" for p, label in phrases.items())
    gap = GAP.replace("\\\\", "\\")
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{LETTERS[0]}', '{LETTERS[1]}'), '{gap}', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w),
base AS ({base}),
b AS (SELECT pos.doc_id, label, i AS o FROM pos JOIN base ON pos.x = p[1] JOIN w ON w.doc_id = pos.doc_id WHERE w.w[i + 1 : i + len(p)] = p),
post(t, j, x) AS (VALUES {postings}),
need AS ({needed}),
lab(t, label, n, phrases) AS (VALUES {labels}),
good AS (SELECT c.doc_id, c.t, c.o FROM (SELECT pos.doc_id, need.t, i - place AS o FROM pos JOIN need ON pos.x = m[1] JOIN w ON w.doc_id = pos.doc_id WHERE w.w[i + 1 : i + len(m)] = m) c
  JOIN lab USING (t) GROUP BY c.doc_id, c.t, c.o, lab.phrases HAVING count(*) = lab.phrases),
hits AS (SELECT g.doc_id, lab.label, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM good g JOIN lab USING (t) JOIN post USING (t)
  JOIN pos ON pos.doc_id = g.doc_id AND pos.i = g.o + post.j AND pos.x = post.x GROUP BY g.doc_id, g.t, g.o, lab.label HAVING share >= {least}),
bs AS (SELECT doc_id, count(*) AS n, min(o) AS f, max(o) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM hits) GROUP BY 1),
hs AS (SELECT doc_id, max(share) AS s FROM hits GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(bs.n, 0) AS n_base, f AS first_word, l AS last_word, coalesce(bs.labels, '') AS base_labels,
  coalesce(al.labels, '') AS labels, CASE WHEN bs.n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(s, CAST(0 AS DOUBLE)) END AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN hs USING (doc_id)"""
