"""Licence notices wrapped over lines, plain and in comments."""

import textwrap

import pytest

from veilframe.llm import licenses

TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Apache-2.0": '''Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.''',
}


@pytest.mark.parametrize("leader", ["", " * ", "# ", "// ", "dnl "])
def test_wrapped_notices(spark, docs, leader):
    wrap = lambda t: "\n".join((leader + x).rstrip() for p in t.split("\n\n") for x in [*textwrap.wrap(p, 72), ""])
    rows = [(i, "Some prose first.\n\n" + wrap(t)) for i, t in enumerate(TEXTS.values())]
    got = {r.doc_id: r for r in licenses.scan_licences(docs(rows)).collect()}
    assert [got[i].families for i in range(len(rows))] == list(TEXTS)
    assert all(got[i].n_confirmed >= t.count("\n\n") for i, t in enumerate(TEXTS.values()))


def test_blocks_count_once(spark, docs):
    rows = [(1, "prose above\nReleased under the MIT License.\nprose below"), (2, "\n" * 20000 + "the license plate\nof the car"), (3, "Released under the\n\nMIT License.")]
    got = {r.doc_id: (r.n_confirmed, r.families) for r in licenses.scan_licences(docs(rows)).collect()}
    assert got == {1: (1, "MIT"), 2: (0, ""), 3: (0, "")}
