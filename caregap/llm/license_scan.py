"""Licence scans by sentence rules: known sentences become identifiers, ordered rules read their sequence."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caregap.llm.common import map_texts, texts_only

# Sentences of public licence texts and notices, normalised (lower case, words only), by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-2-ref": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license",
        "released under the apache license version 2.0",
        "this work is licensed under the apache license version 2.0",
    ),
    "apache-2-comply": ("you may not use this file except in compliance with the license",),
    "license-copy-at": ("you may obtain a copy of the license at",),
    "asis-unless-required": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
        " on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "see-license": (
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "mit-ref": (
        "released under the mit license",
        "licensed under the mit license",
        "this work is licensed under the mit license",
        "this project is licensed under the mit license",
        "distributed under the mit license",
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the software",
    ),
    "mit-asis": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "isc-asis": (
        "the software is provided as is and the author disclaims all warranties with regard to this software including all"
        " implied warranties of merchantability and fitness",
    ),
    "bsd-ref": ("licensed under the bsd license", "released under the bsd license"),
    "bsd-3-ref": ("licensed under the 3 clause bsd license", "released under the 3 clause bsd license"),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following"
        " disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
        " disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    ),
    "gpl-3-ref": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ),
    "gpl-2-ref": (
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
    ),
    "gpl-3-only": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation version 3",
    ),
    "gpl-3-later": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later"
        " version",
    ),
    "gpl-2-later": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 2 of the license or at your option any later"
        " version",
    ),
    "gpl-nowarranty": tuple(
        f"this {subject} is distributed in the hope that it will be useful but without any warranty without even the implied"
        " warranty of merchantability or fitness for a particular purpose"
        for subject in ("program", "library", "file", "software", "work", "package", "module", "project")
    ),
    "gpl-see": tuple(f"see the gnu {kind}general public license for more details" for kind in ("", "lesser ", "library ", "affero ")),
    "lgpl-3-ref": ("licensed under the gnu lesser general public license version 3",),
    "lgpl-21-ref": ("licensed under the gnu lesser general public license version 2.1",),
    "agpl-3-ref": ("licensed under the gnu affero general public license version 3",),
    "mpl-2-ref": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ),
    "mpl-2-copy": (
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    ),
    "cc-by-nc-4-ref": (
        "licensed under cc by nc 4.0",
        "this work is licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ),
    "cc-by-4-ref": (
        "licensed under cc by 4.0",
        "this work is licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ),
    "cc-by-sa-4-ref": (
        "licensed under cc by sa 4.0",
        "this work is licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ),
    "unlicense-pd": ("this is free and unencumbered software released into the public domain",),
}
# Rules in the order they are tried: licence, then sentence identifiers in sequence ("?" marks optional ones).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-2-ref", "apache-2-comply", "license-copy-at?", "asis-unless-required?", "see-license?")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("MIT", ("mit-ref?", "mit-grant", "mit-notice", "mit-asis?")),
    ("MIT", ("mit-ref",)),
    ("ISC", ("isc-grant", "isc-asis?")),
    ("BSD-3-Clause", ("bsd-3-ref?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("BSD-2-Clause", ("bsd-ref?", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-ref",)),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-nowarranty?", "gpl-see?")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-nowarranty?", "gpl-see?")),
    ("GPL-3.0-only", ("gpl-3-only", "gpl-nowarranty?", "gpl-see?")),
    *(
        (f"{kind}-{version}-{form}", (f"{kind.lower()}-{short}-{'later' if form == 'or-later' else 'ref'}", "gpl-nowarranty?", "gpl-see?"))
        for kind, versions in {"GPL": ("3.0", "2.0"), "LGPL": ("3.0", "2.1", "2.0"), "AGPL": ("3.0",)}.items()
        for version in versions
        for short in (version.replace(".0", "").replace(".", ""),)
        for form in ("only", "or-later")
    ),
    ("MPL-2.0", ("mpl-2-ref", "mpl-2-copy?")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("Unlicense", ("unlicense-pd",)),
    ("ISC", ("isc-ref",)),
    ("BSD-2-Clause", ("bsd-2-ref",)),
    ("Unlicense", ("unlicense-ref",)),
)
# Names that may follow "under the (terms of the)" anywhere in a sentence, or stand in an SPDX line, and their identifiers.
# "~" is white space, comment marks, commas, brackets and the like, but no end of a sentence.
_GAP = r"(?:[^a-z0-9.;:!?]{1,40})"
_V2, _V4 = r"(?:~(?:version~|v\.?~?)?)2(?:\.0)?(?!\.?[0-9])", r"~4(?:\.0)?(?!\.?[0-9])"
_LATER = r"(?P<later>~?\+|~or~(?:at~your~option~)?(?:any~)?(?:later|newer)(?:~version)?)?"
_NUMBER = r"(?P<number>[123](?:\.[01])?)(?!\.?[0-9])"
_NAMES = tuple(
    (re.compile(pattern.replace("~", _GAP), re.ASCII), name)
    for pattern, name in (
        (rf"apache(?:~software)?(?:~licen[cs]e)?{_V2}(?:~licen[cs]e)?", "apache-2-ref"),
        (r"(?:mit|expat)~licen[cs]e\b", "mit-ref"),
        (r"isc~licen[cs]e\b", "isc-ref"),
        (r"(?:(?:3|three)~clause~|new~|modified~|revised~)bsd(?:~licen[cs]e)?\b|bsd~(?:3|three)~clause(?:~licen[cs]e)?\b", "bsd-3-ref"),
        (r"(?:(?:2|two)~clause~|simplified~)bsd(?:~licen[cs]e)?\b|bsd~(?:2|two)~clause(?:~licen[cs]e)?\b", "bsd-2-ref"),
        (r"bsd~licen[cs]e\b", "bsd-ref"),
        (rf"(?:gnu~)?(?:(?P<kind>lesser|library|affero)~)?general~public~licen[cs]e(?:~[al]?gpl)?(?:~as~published~by~the~free~software~foundation[;:]?)?"
         rf"(?:~either)?(?:~version~|~v\.?~?|~){_NUMBER}(?:~of~the~licen[cs]e)?{_LATER}", "gpl"),
        (rf"(?:gnu~)?(?P<kind>l|a)?gpl(?:~version~|~?v\.?~?|~)?{_NUMBER}{_LATER}", "gpl"),
        (rf"(?:mozilla~public~licen[cs]e|mpl){_V2}", "mpl-2-ref"),
        (rf"(?:creative~commons|cc)~(?:by|attribution)~(?:nc|non~?commercial){_V4}", "cc-by-nc-4-ref"),
        (rf"(?:creative~commons|cc)~(?:by|attribution)~(?:sa|share~?alike){_V4}", "cc-by-sa-4-ref"),
        (rf"(?:creative~commons|cc)~(?:by|attribution){_V4}", "cc-by-4-ref"),
        (r"unlicense\b", "unlicense-ref"),
    )
)
_KINDS = {"lesser": "lgpl", "library": "lgpl", "l": "lgpl", "affero": "agpl", "a": "agpl", None: "gpl"}
_UNDER = re.compile(r"\b(?:under|subject~to)~(?:the~)?(?:terms~(?:and~conditions~)?of~)?(?:(?:the|an?)~)?".replace("~", _GAP), re.ASCII)
_AND = re.compile(r"~(?:and~or|and|or)~(?:(?:the|an?)~)?".replace("~", _GAP), re.ASCII)
_NOT = re.compile(r"\b(?:not|never)\b[^.;:!?]{0,30}\Z")
_SPDX = re.compile(r"\bspdx-license-identifier:[ \t]*([^\r\n]*)", re.ASCII)
_SPDX_WORD = re.compile(r"[a-z0-9.+-]+", re.ASCII)
_SPDX_NAMES = {
    "apache-2.0": "apache-2-ref", "mit": "mit-ref", "isc": "isc-ref", "bsd-3-clause": "bsd-3-ref", "bsd-2-clause": "bsd-2-ref",
    "mpl-2.0": "mpl-2-ref", "unlicense": "unlicense-ref", "cc-by-4.0": "cc-by-4-ref", "cc-by-sa-4.0": "cc-by-sa-4-ref",
    "cc-by-nc-4.0": "cc-by-nc-4-ref",
    **{
        f"{kind}-{version}{end}": f"{kind}-{version.replace('.0', '').replace('.', '')}-{form}"
        for kind, versions in {"gpl": ("3.0", "2.0"), "lgpl": ("3.0", "2.1", "2.0"), "agpl": ("3.0",)}.items()
        for version in versions
        for end, form in (("", "ref"), ("-only", "ref"), ("+", "later"), ("-or-later", "later"))
    },
}
_KNOWN = {text: name for name, texts in SENTENCES.items() for text in texts}
_MOST_WORDS = max(len(t.split()) for t in _KNOWN)
# Words of which every known sentence holds one (checked below); a text without any of them holds no known sentence.
_TRIGGER = re.compile(
    rb"licen[cs]e|permission|copyright|warrant|redistribut|mozilla|public\W+domain|\bmpl\b|gpl|\bapache\b|\bbsd\b|creative\W+commons|\bcc\W+by\b",
    re.IGNORECASE
)
assert all(_TRIGGER.search(t.encode()) for t in _KNOWN), "every known sentence must hold a trigger"
_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*", re.ASCII)
_COMMENT = re.compile(r"^[ \t]*(?://+|#+|\*+|--+|;+|/\*+)?[ \t]*", re.MULTILINE)
# A sentence ends at a mark followed by white space or the end. A line end may be one too.
_END = re.compile(r"[.;:!?]+[\"')\]]*(?=\s|\Z)|\n|\Z")


def _name_at(lowered: str, at: int) -> tuple[str, int] | None:
    """(identifier, end) of the licence name that starts at ``at``."""
    for pattern, name in _NAMES:
        m = pattern.match(lowered, at)
        if m and name != "gpl":
            return name, m.end()
        if m:
            number = m["number"].replace(".0", "").replace(".", "")
            name = f"{_KINDS[m['kind']]}-{number}-{'later' if m['later'] else 'ref'}"
            if name in _READ:
                return name, m.end()
    return None


_READ = {step.rstrip("?") for _, rule in RULES for step in rule}


def mentions_of(lowered: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of licences named behind "under the (terms of the)" and in SPDX lines, in order."""
    found = []
    for m in _UNDER.finditer(lowered):
        if _NOT.search(lowered, max(0, m.start() - 60), m.start()):
            continue
        start, named = m.start(), _name_at(lowered, m.end())
        while named:
            found.append((named[0], start, named[1]))
            more = _AND.match(lowered, named[1])
            start, named = (more.end(), _name_at(lowered, more.end())) if more else (0, None)
    for m in _SPDX.finditer(lowered):
        for word in _SPDX_WORD.finditer(lowered, m.start(1), m.end(1)):
            if word[0] in _SPDX_NAMES:
                found.append((_SPDX_NAMES[word[0]], word.start(), word.end()))
    return sorted(found, key=lambda x: x[1:])


def sentences_of(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences, in order.

    A sentence starts behind a sentence or line end and ends at one; it may run
    over several lines, so from every start the following ends are tried, as far
    as the longest known sentence goes. The longest match counts. Licences named
    elsewhere (``mentions_of``) count where no known sentence stands.
    """
    lowered = text.encode().lower().decode()  # A-Z only: the length stays
    marks = [(m.start(), m.end()) for m in _END.finditer(lowered)]
    starts = [0, *(e for _, e in marks[:-1])]
    found: list[tuple[str, int, int]] = []
    k = 0
    while k < len(starts):
        words: list[str] = []
        best = None
        for j in range(k, len(marks)):
            begin = starts[k] if j == k else starts[j]
            words += _WORD.findall(_COMMENT.sub(" ", lowered[begin : marks[j][0]]))
            if len(words) > _MOST_WORDS:
                break
            name = _KNOWN.get(" ".join(words))
            if name:
                best = (name, starts[k], marks[j][1], j)
        if best:
            found.append(best[:3])
            k = best[3] + 1
        else:
            k += 1
    ends = [end for _, _, end in found]
    for one in mentions_of(lowered):
        at = bisect_right(ends, one[1])
        if at == len(ends) or found[at][1] >= one[2]:
            found.insert(at, one)
            ends.insert(at, one[2])
    return found


def licences_of(names: list[str]) -> list[tuple[str, int, int]]:
    """(licence, first, end) over a sequence of sentence identifiers: at each place the first rule that fits."""
    found, at = [], 0
    while at < len(names):
        for licence, rule in RULES:
            end = at
            for step in rule:
                optional = step.endswith("?")
                if end < len(names) and names[end] == step.rstrip("?"):
                    end += 1
                elif not optional:
                    end = -1
                    break
            if end > at:
                found.append((licence, at, end))
                at = end
                break
        else:
            at += 1
    return found


_SCHEMA = (
    "doc_id bigint, n_sentences bigint, licences string, n_matches bigint, unresolved bigint, "
    "matches array<struct<licence:string,first_byte:int,end_byte:int>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named or quoted in every whole text.

    Returns doc_id, n_sentences (known licence sentences), licences (distinct, in
    order, comma-joined), n_matches, unresolved (known sentences that no rule
    took) and the matches with their byte spans. One map over the rows. Defined
    cases: null and empty texts have none; a sentence that occurs again counts
    again; null and repeated ids keep their rows; an empty table gives no rows;
    other columns are not read.
    """

    def work(ids: pa.Array, texts: list[bytes | None]):
        out: dict[str, list] = {k: [] for k in ("n_sentences", "licences", "n_matches", "unresolved", "matches")}
        for data in texts:
            known, matches, taken = [], [], 0
            if data and _TRIGGER.search(data):
                text = data.decode("utf-8", "replace")
                known = sentences_of(text)
                for licence, a, b in licences_of([s[0] for s in known]):
                    taken += b - a
                    first, end = known[a][1], known[b - 1][2]
                    at = len(text[:first].encode())
                    matches.append({"licence": licence, "first_byte": at, "end_byte": at + len(text[first:end].encode())})
            out["n_sentences"].append(len(known))
            out["licences"].append(",".join(dict.fromkeys(m["licence"] for m in matches)))
            out["n_matches"].append(len(matches))
            out["unresolved"].append(len(known) - taken)
            out["matches"].append(matches)
        yield {"doc_id": ids, **out}

    return map_texts(texts_only(docs, id_col, text_col), work, _SCHEMA)
