import re

import duckdb
import pandas as pd
import pytest

from evidra.llm import license_scan
from evidra.llm.license_scan import RULES, SENTENCES

OF = {form: name for name, forms in SENTENCES.items() for form in forms}
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n"
    "See the License for the specific language governing permissions and limitations under the License.")
GRANT, KEEP, ASIS = (SENTENCES[i][0] for i in ("mit-grant", "mit-keep", "mit-asis"))
WRAPPED = GRANT.replace(" copies of ", " copies\n of ").capitalize() + ":\n\n" + KEEP.replace(" all ", "\nall ") + ".\n\n" + ASIS.upper() + "."
ROWS = [
    (1, APACHE), (2, WRAPPED), (3, None), (4, ""), (5, "no licence here. Just prose!"), (None, "Released under the MIT License."),
    (6, "Released under the MIT License.\nLicensed under CC-BY 4.0."), (7, "Licensed under CC-BY 4.0.\nReleased under the MIT License."),
    (8, "This program is free software."), (8, "This program is free software."),  # known sentence, no rule; a repeated row
    (9, f"{ASIS}\n{KEEP}\n{GRANT}"),  # the sentences of a rule in the wrong order
    (10, "word " * 400_000 + "\nMIT License\n" + "x" * 1_000_000), (11, "\r\n \t.;!?"), (12, "released under the mit licence"),
    (13, "İ MIT License\nmit-LICENSE\r\n<mit-title>%_"), (14, "MIT License\n" * 500),
]


def brute(key, text):
    def ids(splitter):
        forms = (re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), s)).strip() for s in re.split(splitter, text or ""))
        return [OF[f] for f in forms if f in OF]

    def holds(sequence, needed):
        rest = iter(sequence)
        return all(any(n == found for found in rest) for n in needed)

    lines, unwrapped = ids(license_scan.LINES), ids(license_scan.STRETCHES)
    held = [(name, rule) for name, rule, needed in RULES if holds(lines, needed) or holds(unwrapped, needed)]
    every = [n for n in dict.fromkeys(r[0] for r in RULES) if n in {h[0] for h in held}]
    first = held[0] if held else ("unmatched",) * 2 if lines or unwrapped else ("", "")
    return key, len(lines), "".join(f"<{i}>" for i in lines), *first, ";".join(every)


@pytest.fixture(scope="module")
def found(docs_of):
    return sorted((tuple(r) for r in license_scan.scan(docs_of(ROWS)).collect()), key=repr)


def test_against_brute_force(found):
    assert found == sorted((brute(*row) for row in ROWS), key=repr)


def test_what_the_rules_decide(found):
    of = {r[0]: r[3:] for r in found}
    assert of[1] == ("Apache-2.0", "header", "Apache-2.0") and of[2][:2] == ("MIT", "text") and of[None][0] == "MIT"
    assert of[3] == of[4] == of[5] == of[12] == ("", "", "") and of[8][:2] == of[9][:2] == ("unmatched", "unmatched")
    assert of[6] == of[7] == ("MIT", "notice", "MIT;CC-BY-4.0") and of[10][:2] == ("MIT", "title")


def test_sql_gives_the_same_rows(found):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([i for i, _ in ROWS], dtype="Int64"), "text": [t for _, t in ROWS]}))
    rows = con.execute(license_scan.scan_sql()).fetchall()
    assert sorted(rows, key=repr) == found


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).collect() == []
    clash = spark.createDataFrame([(1, "MIT License", 7, "x", "y", "z")], "id long, body string, n_known int, license string, _lines string, _key string")
    assert [tuple(r) for r in license_scan.scan(clash, "id", "body").collect()] == [(1, 1, "<mit-title>", "MIT", "title", "MIT")]


def test_plan_is_native_and_without_shuffle(spark, capsys):
    license_scan.scan(spark.range(9).selectExpr("id AS doc_id", "concat('MIT License ', id) AS text")).explain("formatted")
    plan = capsys.readouterr().out
    assert "Project" in plan and not re.search("Python|Pandas|Arrow|MapIn|Exchange", plan)


MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
       "file, You can obtain one at https://mozilla.org/MPL/2.0/.")
MPL_WRAPPED = ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"
               " * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n")
GPL = ("This program is free software{mark} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
       "the Free Software Foundation{comma} either version {n} of the License, or\n(at your option) any later version.\n\n"
       "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
       "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
       "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
       "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
       "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
       "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n"
       "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE")
BSD = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
       "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
       "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
       "   and/or other materials provided with the distribution.\n\n{third}"
       "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\n"
       "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED. IN NO EVENT")
THIRD = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
         "   this software without specific prior written permission.\n\n")
ISC = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
       "copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\n"
       "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT")
PUBLISHED = [
    ("Apache-2.0", "header", APACHE), ("MIT", "text", MIT), ("GPL-3.0-or-later", "header", GPL.format(mark=":", comma=",", n=3)),
    ("GPL-2.0-or-later", "header", GPL.format(mark=";", comma=";", n=2)), ("BSD-3-Clause", "text", BSD.format(third=THIRD)),
    ("BSD-2-Clause", "text", BSD.format(third="")), ("ISC", "text", ISC), ("MPL-2.0", "header", MPL), ("MPL-2.0", "header", MPL_WRAPPED),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."), ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "title", "MIT License\n\nCopyright (c) 2020 A"), ("GPL-3.0-only", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "notice", "Licensed under the GNU General Public License, version 2."),
    ("LGPL", "notice", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
]


def test_every_rule_holds_on_its_published_text(docs_of):
    got = {r.doc_id: (r.license, r.rule) for r in license_scan.scan(docs_of([(i, t) for i, (*_, t) in enumerate(PUBLISHED)])).collect()}
    assert got == {i: (name, rule) for i, (name, rule, _) in enumerate(PUBLISHED)}
    assert {(name, rule) for name, rule, _ in PUBLISHED} == {(name, rule) for name, rule, _ in RULES}


def test_sql_reads_the_published_texts_alike(docs_of):
    """The forms with a mark inside a sentence among them."""
    texts = [t for *_, t in PUBLISHED] + ["Public License, v.\n# 2.0. If a copy", "Software Foundation;\n// either version 2", "v. x. Foundation; neither", None, ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = con.execute(license_scan.scan_sql()).fetchall()
    assert sorted(found) == sorted(tuple(r) for r in license_scan.scan(docs_of(list(enumerate(texts)))).collect())
