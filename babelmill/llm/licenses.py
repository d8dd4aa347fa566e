"""Operator 8, license scans: an exact set-similarity join of text blocks with license templates.

Blocks of a template are twice its stride long and begin every stride words of a whole text (the last ones shorter); its
stride is STRIDE words, doubled until the template is no longer than that, so any passage as long as the template lies
whole in a block, be it one sentence or a full license text. A block meets a template if it holds at least THRESHOLD of the template's distinct words.
Tokens are ordered by their frequency in the whole corpus, rarest first. The length filter drops blocks with fewer
template words than a template needs; the prefix filter keeps the blocks that hold one of the |T| - need + 1 rarest
words of a template T; the positional filter drops those whose first shared word stands too late in either for the
rest to suffice; the survivors' overlaps are counted. All filters are exact. The templates are a fixed list, so their
vocabulary and frequencies go to every task. score and n_blocks are those of the join.

Labels come from the same join over blocks twice as long, so that any words as many as a block's, wherever they begin, lie
whole in one. In the blocks that meet a template there, some such words must hold as many of the template's words as it
needs and, as consecutive words, a phrase of each group of NAMES: a license must be named. The SQL has the same rule, without filters.
Base phrases are found as consecutive words and their labels always stay.

Defined cases: null text is empty, has no words and no labels; repeated rows are judged one by one; a very long text is
judged whole; tokens of one frequency are ordered by spelling, which changes no result; a null doc_id is kept; an empty table gives an empty result (and an order by the tokens' spelling); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm import textnum as tn
from babelmill.llm.common import table

STRIDE, THRESHOLD = 32, 0.8
#: Words of the shortest blocks.
BLOCK = 2 * STRIDE

# Phrases of the base rule with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Sentences and full texts of public licenses and notices, lower-cased, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
        "a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see "
        "the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as "
        "is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
        "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for "
        "any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
        "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ),
)

# By template, groups of phrases that name its license; one of each group must stand in the text.
NAMES = dict(zip((t for _, t in TEMPLATES), (
    (("apache license version 2 0", "apache license v 2 0", "apache license v2 0", "apache license 2 0", "apache 2 0 license"),),
    (("apache license", "apache org"),),
    (("source and binary forms", "source or binary forms"),),
    (("cc by nc",),),
    (("attribution sharealike", "attribution share alike"),),
    (("gnu general public license version 3", "gnu general public license v 3", "gnu general public license v3", "gnu general public license 3"),),
    (("gnu general public license",), ("version 3", "v 3", "v3", "license 3")),
    (("mit license",),),
    (("associated documentation files",),),
    (("mozilla public license v 2", "mozilla public license version 2", "mozilla public license 2"),),
    (("free and unencumbered software",),),
    (("gnu lesser general public license", "gnu library general public license"),),
    (("gnu affero general public license",),),
    (("eclipse public license 2", "eclipse public license v 2", "eclipse public license v2", "eclipse public license version 2"),),
    (("in no event will the authors",),),
    (("apache license", "apache org"),),
    (("source and binary forms", "source or binary forms"),),
    (("permission to use copy modify",),),
    (("associated documentation files", "permission is hereby granted free of charge"),),
), strict=True))
# Longer names of other licenses that begin with one of NAMES.
OTHER_NAMES = {"cc by nc": ("cc by nc sa", "cc by nc nd")}


def vocabulary(templates: tuple = TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def need(n: int) -> int:
    return ceil(THRESHOLD * n - 1e-9)


def stride(template: str) -> int:
    """Words between the beginnings of a template's blocks; a block is twice as long."""
    n = STRIDE
    while n < len(template.split()):
        n *= 2
    return n


def hashed_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes, and where each row's words begin."""
    for first_row, offsets, data in tn.chunks(batch.column("text")):
        starts, ends, first = tn.word_spans(data, offsets, tn.ALNUM)
        yield first_row, tn.word_hashes(data, starts, ends), first


def token_order(docs: DataFrame, words: list[str]) -> list[str]:
    """words by their frequency in the corpus, rarest first (then by spelling)."""
    hashes = np.array([tn.hash_word(w) for w in words], np.uint64)
    by_hash = np.argsort(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, h, _ in hashed_words(batch):
                at = np.minimum(np.searchsorted(hashes[by_hash], h), len(words) - 1)
                total += np.bincount(by_hash[at[hashes[by_hash][at] == h]], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(total)], ["word", "n"])

    # One row a word of the fixed list.
    found = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return sorted(words, key=lambda w: (found.get(words.index(w), 0), w))


class Matcher:
    def __init__(self, ordered: list[str], templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> None:
        rank = {w: i for i, w in enumerate(ordered)}
        hashes = np.array([tn.hash_word(w) for w in ordered], np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.labels = [label for label, _ in templates]
        self.sets = [np.array(sorted({rank[w] for w in t.split()})) for _, t in templates]
        self.needs = np.array([need(len(s)) for s in self.sets])
        self.strides = np.array([stride(t) for _, t in templates])
        self.members = np.zeros((len(ordered), len(templates)), np.int32)
        self.prefix = {n: np.zeros(len(ordered), bool) for n in set(self.strides.tolist())}
        for i, s in enumerate(self.sets):
            self.members[s, i] = 1
            self.prefix[int(self.strides[i])][s[: len(s) - self.needs[i] + 1]] = True
        self.sizes = np.array([len(s) for s in self.sets])
        self.phrases = [(label, hashed(p)) for p, label in phrases]
        self.terms = [np.array(sorted({tn.hash_word(w) for w in t.split()}), np.uint64) for _, t in templates]
        self.names = [[[(hashed(p), [hashed(o) for o in OTHER_NAMES.get(p, ())]) for p in group] for group in NAMES.get(t, ())] for _, t in templates]

    def blocks(self, words: np.ndarray, first: np.ndarray, wide: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, step, template, overlap) of every block that meets a template; strides and blocks are `wide` times as long."""
        none = np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == words)
        if not len(place):
            return none, none, none, none
        token = self.by_hash[at[place]]
        row = np.searchsorted(first, place, "right") - 1
        out = [self.met(n, n * wide, token, row, place - first[row]) for n in sorted(self.prefix)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def met(self, n: int, apart: int, token: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """blocks() for the templates of stride n, with blocks that begin every `apart` words, from the template words of texts:
        which, in which row, where."""
        none = np.zeros(0, np.int64)
        of = np.flatnonzero(self.strides == n)
        used = self.members[:, of].any(axis=1)[token]
        token, row, step = token[used], row[used], place[used] // apart
        if not len(token):
            return none, none, none, none
        # A place lies in the block that begins at its stride and in the one before.
        earlier = step > 0
        row, token = np.concatenate([row, row[earlier]]), np.concatenate([token, token[earlier]])
        step = np.concatenate([step, step[earlier] - 1])
        steps = int(step.max()) + 1
        key = np.unique((row * steps + step) * len(self.hashes) + token)  # each block's distinct words, rarest first
        block, token = key // len(self.hashes), key % len(self.hashes)
        begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        length = np.diff(np.append(begin, len(block)))
        # Length and prefix filters: enough template words, and one of a template's rarest.
        some = np.add.reduceat(self.prefix[n][token].astype(np.int64), begin) > 0
        live = np.flatnonzero(some & (length >= self.needs[of].min()))
        if not len(live):
            return none, none, none, none
        keep = np.repeat(np.isin(np.arange(len(begin)), live), length)
        index = np.repeat(np.arange(len(live)), length[live])
        token = token[keep]
        nth = np.arange(len(token)) - np.repeat(np.cumsum(length[live]) - length[live], length[live])
        out = []
        for t in of:
            s = self.sets[t]
            ahead = s[: len(s) - self.needs[t] + 1]
            hit = np.isin(token, ahead)
            who, where = np.unique(index[hit], return_index=True)
            # Positional filter: what follows the first shared word must suffice in both.
            in_template = np.searchsorted(s, token[hit][where])
            in_block = length[live][who] - nth[hit][where]
            who = who[np.minimum(len(s) - in_template, in_block) >= self.needs[t]]
            if len(who):
                overlap = np.bincount(index, weights=self.members[token, t], minlength=len(live)).astype(np.int64)[who]
                ok = overlap >= self.needs[t]
                here = block[begin[live[who[ok]]]]
                out.append((here // steps, here % steps, np.full(ok.sum(), t), overlap[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none)

    def places(self, words: np.ndarray, first: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(label, row, word) of every place of every phrase."""
        out = []
        for label, p in self.phrases:
            row, at = phrase_places(p, words, first)
            out.append((label, row, at - first[row]))
        return out

    def named(self, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, template) of the joined blocks, twice as long, in which some consecutive words, as many as a block's, hold
        enough of the template and a phrase of each of its groups."""
        out: set[tuple[int, int]] = set()
        for row, step, t, _ in zip(*(x.tolist() for x in self.blocks(words, first, 2)), strict=True):
            if (row, t) in out or not self.names[t]:
                continue
            n = int(self.strides[t])
            a = int(first[row]) + 2 * n * step
            if self.confirmed(t, words[a : min(a + 4 * n, int(first[row + 1]))], 2 * n):
                out.add((row, t))
        return out

    def confirmed(self, t: int, words: np.ndarray, size: int) -> bool:
        """Whether some `size` consecutive words of a block hold enough of template t and a phrase of each of its groups."""
        edges = np.array([0, len(words)])
        at, term = term_places(self.terms[t], words)
        ok = began(len(words), np.maximum(at - size, previous(term, at)) + 1, at) >= self.needs[t]
        for group in self.names[t]:
            low, high = [], []
            for p, others in group:
                found = phrase_places(p, words, edges)[1]
                for o in others:
                    found = found[~np.isin(found, phrase_places(o, words, edges)[1])]
                low.append(found + len(p) - size), high.append(found)
            ok &= began(len(words), np.concatenate(low), np.concatenate(high)) > 0
        return bool(ok.any())


def hashed(phrase: str) -> np.ndarray:
    return np.array([tn.hash_word(w) for w in phrase.split()], np.uint64)


def phrase_places(p: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place among all words of each occurrence of a phrase."""
    at = np.flatnonzero(words[: max(0, len(words) - len(p) + 1)] == p[0])
    for i in range(1, len(p)):
        at = at[words[at + i] == p[i]]
    row = np.searchsorted(first, at, "right") - 1
    inside = at + len(p) <= first[row + 1]
    return row[inside], at[inside]


def term_places(terms: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a row's words that are terms (in order), and which term."""
    term = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    at = np.flatnonzero(terms[term] == words)
    return at, term[at]


def previous(term: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place before of the same term, or -1."""
    order = np.argsort(term, kind="stable")
    out = np.full(len(at), -1)
    same = np.flatnonzero(term[order][1:] == term[order][:-1]) + 1
    out[order[same]] = at[order[same - 1]]
    return out


def began(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each of n beginnings, in how many of the ranges low to high, both included, it lies."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(low, 0), 1)
    np.add.at(step, high + 1, -1)
    return np.cumsum(step)[:n]


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """FOUND for every row of docs(doc_id, text)."""
    ordered = token_order(docs, vocabulary(templates))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(ordered, templates, phrases)
        for batch in batches:
            ids = batch.column("doc_id")
            for first_row, words, first in hashed_words(batch):
                n = len(first) - 1
                base: list[set] = [set() for _ in range(n)]
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                score, blocks = np.zeros(n), np.zeros(n, np.int64)
                for label, row, word in m.places(words, first):
                    np.add.at(n_base, row, 1)
                    np.minimum.at(low, row, word)
                    np.maximum.at(high, row, word)
                    for r in np.unique(row):
                        base[r].add(label)
                every = [set(b) for b in base]
                row, _, template, overlap = m.blocks(words, first)
                np.add.at(blocks, row, 1)
                np.maximum.at(score, row, overlap / m.sizes[template] if len(row) else score[:0])
                unnamed = {(r, t) for r, t in zip(row.tolist(), template.tolist(), strict=True) if not m.names[t]}
                for r, t in unnamed | m.named(words, first):
                    every[r].add(m.labels[t])
                score[n_base > 0] = 1.0
                nil = n_base == 0
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first_row, n).cast(pa.int64()), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=nil), pa.array(high, mask=nil),
                    pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b)) for b in every]), pa.array(score), pa.array(blocks),
                ], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(find, FOUND)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same result in SQL, without filters. Words of a block's number that can hold what a label needs begin at one of them."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    tokens = ", ".join(f"({i}, '{label}', '{w}', {need(len(set(t.split())))}, {len(set(t.split()))}, {stride(t)})" for i, (label, t) in enumerate(TEMPLATES) for w in sorted(set(t.split())))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    named = [(i, g, p) for i, (_, t) in enumerate(TEMPLATES) for g, group in enumerate(NAMES[t]) for p in group]
    names = ", ".join(f"({i}, {g}, '{p}', '{p.split()[0]}', {len(p.split())}, {len(NAMES[TEMPLATES[i][1]])})" for i, g, p in named)
    longer = ", ".join(f"('{p}', '{o}', {len(o.split())})" for p, others in OTHER_NAMES.items() for o in others)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), p(phrase, label, k) AS (VALUES {phrases}
), t(t, label, word, need, size, stride) AS (VALUES {tokens}
), tok AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d
), base AS (SELECT r, i, label FROM tok, p WHERE i + k <= len(w) AND array_to_string(w[i + 1:i + k], ' ') = phrase
), b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY r
), hit AS (SELECT r, i, t, label, word, need, size, stride FROM tok JOIN t ON w[i + 1] = word
), inb AS (SELECT *, i // stride AS b FROM hit UNION ALL SELECT *, i // stride - 1 FROM hit WHERE i >= stride
), blk AS (SELECT r, b, t, label, count(DISTINCT word) AS n, any_value(need) AS need, any_value(size) AS size FROM inb GROUP BY r, b, t, label
), met AS (SELECT r, b, t, label, n * 1.0::DOUBLE / size AS c FROM blk WHERE n >= need
), names(t, g, phrase, word, k, n_groups) AS (VALUES {names}
), longer(phrase, other, k) AS (VALUES {longer}
), said AS (
  SELECT r, t, g, i, k, n_groups FROM tok JOIN names ON w[i + 1] = word WHERE array_to_string(w[i + 1:i + k], ' ') = phrase
  AND NOT EXISTS (SELECT 1 FROM longer WHERE longer.phrase = names.phrase AND array_to_string(tok.w[i + 1:i + longer.k], ' ') = other)
), cand AS (SELECT r, t, n_groups FROM said GROUP BY r, t, n_groups HAVING count(DISTINCT g) = n_groups
), near AS (SELECT hit.* FROM hit JOIN cand ON hit.r = cand.r AND hit.t = cand.t
), start AS (SELECT r, t, i AS a FROM near UNION SELECT said.r, said.t, i FROM said JOIN cand ON said.r = cand.r AND said.t = cand.t
), enough AS (
  SELECT s.r, s.t, s.a, any_value(label) AS label, any_value(stride) AS stride FROM start s JOIN near h ON h.r = s.r AND h.t = s.t AND h.i >= s.a AND h.i < s.a + 2 * h.stride
  GROUP BY s.r, s.t, s.a HAVING count(DISTINCT word) >= any_value(need)
), told AS (
  SELECT e.r, e.label FROM enough e JOIN said ON said.r = e.r AND said.t = e.t AND said.i >= e.a AND said.i + said.k <= e.a + 2 * e.stride
  GROUP BY e.r, e.t, e.a, e.label HAVING count(DISTINCT g) = any_value(n_groups)
), m AS (SELECT r, count(*) AS n_blocks, max(c) AS c FROM met GROUP BY r
), bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT r, label FROM base) GROUP BY r
), al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION SELECT r, label FROM told) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN b ON d.r = b.r LEFT JOIN m ON d.r = m.r LEFT JOIN bl ON d.r = bl.r LEFT JOIN al ON d.r = al.r
"""
