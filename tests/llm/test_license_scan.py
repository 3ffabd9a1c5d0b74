"""Licence notices that the given documents do not hold."""

import pytest

from caregap.llm import license_scan

HEADER = """ * {} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {}General Public License
 * as published by the Free Software Foundation; {}
 *
 * This {} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * {}General Public License for more details."""


def licences(text):
    return [x for x, _, _ in license_scan.licences_of([n for n, _, _ in license_scan.sentences_of(text)])]


def test_capital_dotted_i_keeps_the_rest():
    assert licences("\u0130stanbul. Released under the MIT License.") == ["MIT"]


@pytest.mark.parametrize("kind,words", [("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")])
@pytest.mark.parametrize("subject", ["program", "library", "file"])
def test_standard_headers(kind, words, subject):
    later = "either version 3 of the License, or (at your option) any later version."
    assert licences(HEADER.format(f"This {subject}", words, later, subject, words)) == [f"{kind}-3.0-or-later"]
    assert licences(HEADER.format(f"This {subject}", words, "version 3 of the License.", subject, words)) == [f"{kind}-3.0-only"]


def test_older_headers():
    text = HEADER.format("Foo", "Lesser ", "either\n * version 2.1 of the License, or (at your option) any later version.", "library", "Lesser ")
    assert licences(text) == ["LGPL-2.1-or-later"]
    assert licences(HEADER.format("Foo", "", "version 2.", "program", "")) == ["GPL-2.0-only"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("This file is licensed under the MIT License", ["MIT"]),
        ("The code, which is available under the terms of the ISC License, comes from elsewhere.", ["ISC"]),
        ("It is dual licensed under the Apache License, Version 2.0 or the MIT license, as you like.", ["Apache-2.0", "MIT"]),
        ("All of it is released under GPLv2+, they say.", ["GPL-2.0-or-later"]),
        ("We publish under CC BY-SA 4.0 and under a Creative Commons Attribution 4.0 International License here.", ["CC-BY-SA-4.0", "CC-BY-4.0"]),
        ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause)", ["GPL-2.0-only", "BSD-2-Clause"]),
        ("# SPDX-License-Identifier: LGPL-2.1-or-later\nimport os", ["LGPL-2.1-or-later"]),
        ("It is not licensed under the MIT License. It is under water.", []),
        ("Under the general public there is the licence 2.", []),
    ],
)
def test_names_inside_sentences(text, want):
    assert licences(text) == want
    assert all(license_scan._TRIGGER.search(text.encode()) for _ in want)


def test_every_licence_has_an_spdx_name_and_a_rule():
    for name, one in license_scan._SPDX_NAMES.items():
        assert licences(f"SPDX-License-Identifier: {name}") and one in license_scan._READ
    assert {x for x, _ in license_scan.RULES} - {"BSD"} == {licences(f"SPDX-License-Identifier: {n}")[0] for n in license_scan._SPDX_NAMES}


def test_spans_do_not_overlap():
    text = "Licensed under the Apache License, Version 2.0. " * 3 + "x is under the MIT License and under the BSD license."
    spans = [(a, b) for _, a, b in license_scan.sentences_of(text)]
    assert len(spans) == 5 and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
