"""The headers that licences ask for, wrapped at any width, are told under any frequencies of words."""

import textwrap

import pytest

from tarnscape.llm import license_scan


def gnu(what, name, version, mark):
    return (
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details.\n\n"
        f"You should have received a copy of the GNU {name}General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


HEADERS = {
    "GPL-2.0": [gnu("program", "", "2", ";")], "GPL-3.0": [gnu("program", "", "3", ":")], "LGPL-2.1": [gnu("library", "Lesser ", "2.1", ";")], "LGPL-3.0": [gnu("program", "Lesser ", "3", ":"), gnu("library", "Lesser ", "3", ":")], "AGPL-3.0": [gnu("program", "Affero ", "3", ":")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.'],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."],
    "ISC": [license_scan.WHOLE["ISC"]], "MIT": [license_scan.WHOLE["MIT"], "Released under the MIT License."], "BSD-2-Clause": [license_scan.WHOLE["BSD-2-Clause"]], "BSD-3-Clause": [license_scan.WHOLE["BSD-3-Clause"]],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "Proprietary": ["All rights reserved. No part of this work may be reproduced without written permission."],
}
for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    HEADERS[f"CC-{short}-4.0"] = [f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"Licensed under CC {short} 4.0."]

V = license_scan.VOCABULARY
FREQUENCIES = {
    "equal": {}, "words common": {t: 900 for t in V if " " not in t}, "what tells apart is common": {t: 990 if any(x in t for x in ("affero", "lesser", "version", "license", "neither", "noncommercial")) else 3 for t in V},
    "any": {t: (i * 7919) % 997 for i, t in enumerate(V)},
}


def test_every_licence_has_a_header():
    assert set(HEADERS) == set(license_scan.TEMPLATES)


@pytest.mark.parametrize("frequencies", FREQUENCIES)
def test_headers_are_told(frequencies):
    t = license_scan.Templates(FREQUENCIES[frequencies], 1000)
    for licence, texts in HEADERS.items():
        for text in texts:
            for width in (40, 60, 72, 80, 100, 10_000):
                for mark in ("", "# ", " * ", "// "):
                    wrapped = "\n".join(mark + line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""]))
                    got, cosine = t.best(f"import x\n{wrapped}\ndef main(): pass")
                    assert (got, cosine >= 0.6) == (licence, True), (licence, width, mark, got, cosine)


def test_a_name_without_its_version_tells_nothing():
    t = license_scan.Templates({}, 1000)
    assert t.best("no words of a kind")[0] is None and t.best("")[0] is None and t.best(None)[0] is None
    assert t.best("CC BY: see the licence of the photographer")[1] < 0.6
