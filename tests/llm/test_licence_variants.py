"""Denied licences, other versions and variants are no family; whole headers confirm."""

from veilframe.llm import licenses

NONE = [
    "This project is not licensed under the MIT license.", "It isn't released under the Apache License, Version 2.0.", "The code is no longer available under CC BY 4.0.", "Licensed under the MIT No Attribution License.", "SPDX-License-Identifier: MIT-0",
    "Licensed under the BSD 4-Clause License.", "Licensed under the Mozilla Public License 1.1.", "Licensed under the GNU General Public License, version 1.", "Licensed under the Apache License, Version 1.1.",
]
SOME = {
    "MIT": "This project is licensed under the MIT license, and not for sale.",
    "Apache-2.0": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "GPL-3.0": "Licensed under the GNU General Public License v3.0.",
}


def test_denials_and_variants(spark, docs):
    rows = [(i, t) for i, t in enumerate([*NONE, *SOME.values()])]
    got = {r.doc_id: r.families for r in licenses.scan_licences(docs(rows)).collect()}
    assert [got[i] for i in range(len(NONE))] == [""] * len(NONE)
    assert [got[len(NONE) + i] for i in range(len(SOME))] == list(SOME)
