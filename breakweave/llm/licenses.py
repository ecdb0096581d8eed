"""Licence scans by sentence rules.

A text is cut at line ends, at semicolons and at full stops, question or exclamation marks before white space (not inside "v. 2.0").
A sentence is a piece, without a list mark, or several pieces that follow each other over single line ends, so that wrapped sentences are whole; the longest
known one counts. Blank lines end sentences. A normalised sentence (lower case, every run of other than letters and digits one space) may be the known sentence of a licence, which has an
identifier. A document's sequence of identifiers is matched against ordered rules: the identifiers of a
rule, in order, each at most GAP sentences, wrapped ones joined, after the one before. Rules come in a fixed order; sentences that a rule has matched are not
matched again by later ones.

Null, empty or blank text: no licence. Repeated rows: equal results. Ties: the earlier rule, then the earlier sentence. Texts without a known
sentence give a row with an empty list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

#: Identifier and normalised sentence of public licence texts and notices.
SENTENCES = (
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "licensed under the apache license version 2 0 the license"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-notice", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-include", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("gpl-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl-work", "this program is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("bsd-redistribute", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-source", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)
#: Canonical sentences in full, which SQL over notices alone doesn't need.
FULL = (
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd-neither", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)
#: Licence, sequence of identifiers; in order of precedence.
RULES = (
    ("MIT", ("mit-grant", "mit-include", "as-is")),
    ("MIT", ("mit-grant", "mit-include")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-neither")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl-work",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("MPL-2.0", ("mpl-source",)),
    ("all-rights-reserved", ("reserved",)),
)
#: Rules of the sentences in FULL alone; they come after the others.
FULL_RULES = (("GPL-2.0", ("gpl2-free",)),)
GAP = 4
_CUT = re.compile(r"\r?\n|\r|;|[!?](?=\s|$)|\.(?=\s|$)(?!(?<=\b[vV]\.)\s[\W_]{0,12}\d)")
_MARK = re.compile(r"(?:\d{1,2}|[a-z]) ")
_OTHER = re.compile(r"[^a-z0-9]+")


@lru_cache(maxsize=8)
def _beginnings(sentences: frozenset[str]) -> frozenset[str]:
    """What a known sentence may begin with: all its runs of first words but the whole."""
    return frozenset(s[: m.start()] for s in sentences for m in re.finditer(" ", s))


def sentence_ids(text: str, known: dict[str, str], longest: int, hint: re.Pattern) -> list[tuple[int, str, int, int]]:
    """(number, identifier, start, end) of the known sentences; start and end are positions in the text."""
    if not hint.search(text):
        return []
    # pieces: number of the sentence, normalised words, start, end
    pieces, at, number, lines, fresh = [], 0, 0, 0, True
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        words = (_OTHER.sub(" ", part.lower()).strip() if len(part) <= longest else None) if part and not part.isspace() else ""
        if words != "":
            if lines > 1 and not fresh:
                number += 1
            pieces.append((number, words, at, end))
            lines, fresh = 0, False
        if m and m[0] in ("\n", "\r", "\r\n"):
            lines += 1
        elif m and not fresh:
            number, fresh = number + 1, True
        at = m.end() if m else end
    out, i, begun = [], 0, _beginnings(frozenset(known))
    while i < len(pieces):
        n, words, start, _ = pieces[i]
        best, last = None, i
        mark = _MARK.match(words) if words else None
        for sofar in (words, words[mark.end() :]) if mark else (words,):
            j = i
            while sofar:
                if sofar in known:
                    best, last = known[sofar], j
                j += 1
                if sofar not in begun or j == len(pieces) or pieces[j][0] != n or not pieces[j][1]:
                    break
                sofar = f"{sofar} {pieces[j][1]}"
            if best:
                break
        if best:
            out.append((n, best, start, pieces[last][3]))
        i = last + 1
    return out


def match_rules(ids: list[tuple[int, str, int, int]], rules=RULES, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, start, end) in order of start."""
    out, used = [], set()
    for licence, sequence in rules:
        for i in range(len(ids)):
            if i in used or ids[i][1] != sequence[0]:
                continue
            path = [i]
            for want in sequence[1:]:
                nxt = next((j for j in range(path[-1] + 1, len(ids)) if j not in used and ids[j][1] == want and ids[j][0] - ids[path[-1]][0] <= gap), None)
                if nxt is None:
                    break
                path.append(nxt)
            if len(path) == len(sequence):
                used.update(path)
                out.append((licence, ids[path[0]][2], ids[path[-1]][3]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, sentences=SENTENCES + FULL, rules=RULES + FULL_RULES, gap: int = GAP) -> DataFrame:
    """(doc_id, sentence_ids, licenses, spans) of every row: identifiers in order, distinct licences, and each match's licence and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {s: i for i, s in sentences}
        longest = 4 * max(map(len, known))
        # a known sentence has one of these words: texts without any have none
        words = {max(s.split(), key=len) for s in known}
        hint = re.compile("|".join(sorted(words, key=lambda w: (-len(w), w))), re.IGNORECASE)
        for pdf in batches:
            ids = [sentence_ids(t, known, longest, hint) for t in pdf["text"]]
            spans = [match_rules(x, rules, gap) for x in ids]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "sentence_ids": [[i for _, i, _, _ in x] for x in ids],
                "licenses": [sorted({s[0] for s in x}) for x in spans], "spans": spans,
            })

    return texts(docs).mapInPandas(run, "doc_id long, sentence_ids array<string>, licenses array<string>, spans array<struct<license:string,start:long,end:long>>")


_LIST = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
#: Holds as long as documents have notices alone, whose rules have one sentence each: then a document's licences are its sentences' ones.
_SINGLE = ", ".join(f"('{r[0]}', '{r[1][0]}')" for r in RULES if len(r[1]) == 1)
SQL = rf"""
with known(id, sentence) as (values {_LIST}), rule(license, id) as (values {_SINGLE}),
s as (select doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.!?](\s|$)', chr(10) || '\1', 'g'), '[\n\r;]')) as part from documents),
n as (select doc_id, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) as sentence from s where length(part) < 2000),
m as (select doc_id, r.license from n join known k on n.sentence = k.sentence join rule r on r.id = k.id),
g as (select doc_id, array_to_string(list_sort(list(distinct license)), ',') as licenses, count(*) as n_matches from m group by 1)
select d.doc_id, coalesce(g.licenses, '') as licenses, coalesce(g.n_matches, 0) as n_matches from documents d left join g on d.doc_id = g.doc_id
"""
