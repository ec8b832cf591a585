"""Licence recognition by sentences: known sentences become identifiers, identifier sequences meet ordered rules.

Built-in column functions only: one pass over the texts, no shuffle, no Python on executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (lower case, runs of other
# characters than letters and digits as one space), by identifier.
SENTENCES = {
    "apache2-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache2-use": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0",
                     "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache2-asis": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "distributed under the mit license",
                   "this project is licensed under the mit license"],
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
        "furnished to do so subject to the following conditions"],
    "mit-keep": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3",
                    "licensed under the gnu general public license version 3",
                    "this program is licensed under the gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2",
                    "licensed under the gnu general public license version 2"],
    "gpl-free": ["this program is free software"],
    "gpl3-modify": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version"],
    "gpl2-modify": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": [
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-details": ["see the gnu general public license for more details"],
    "lgpl-notice": ["licensed under the gnu lesser general public license version 2 1", "licensed under the gnu lesser general public license version 3"],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met"],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission"],
    "bsd-asis": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
        "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd3-notice": ["released under the bsd 3 clause license", "licensed under the bsd 3 clause license"],
    "bsd2-notice": ["released under the bsd 2 clause license", "licensed under the bsd 2 clause license"],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies"],
    "isc-asis": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
                  "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "ccby4-notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa4-notice": ["licensed under cc by sa 4 0",
                       "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync4-notice": ["licensed under cc by nc 4 0",
                       "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0-notice": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0"],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
}

# Ordered rules. A rule holds when its identifiers occur in this order, others may stand between.
RULES = [
    ("Apache-2.0", "header", ["apache2-notice", "apache2-use", "apache2-asis", "apache2-see"]),
    ("MIT", "text", ["mit-grant", "mit-keep", "mit-asis"]),
    ("GPL-3.0-or-later", "header", ["gpl-free", "gpl3-modify", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", "header", ["gpl-free", "gpl2-modify", "gpl-hope", "gpl-details"]),
    ("BSD-3-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"]),
    ("BSD-2-Clause", "text", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("ISC", "text", ["isc-grant", "isc-asis"]),
    ("MPL-2.0", "header", ["mpl2-notice", "mpl2-copy"]),
    ("Unlicense", "text", ["unlicense-grant"]),
    ("Apache-2.0", "notice", ["apache2-notice"]),
    ("MIT", "notice", ["mit-notice"]),
    ("MIT", "title", ["mit-title"]),
    ("GPL-3.0-only", "notice", ["gpl3-notice"]),
    ("GPL-2.0-only", "notice", ["gpl2-notice"]),
    ("LGPL", "notice", ["lgpl-notice"]),
    ("BSD-3-Clause", "notice", ["bsd3-notice"]),
    ("BSD-2-Clause", "notice", ["bsd2-notice"]),
    ("MPL-2.0", "notice", ["mpl2-notice"]),
    ("CC-BY-NC-4.0", "notice", ["ccbync4-notice"]),
    ("CC-BY-SA-4.0", "notice", ["ccbysa4-notice"]),
    ("CC-BY-4.0", "notice", ["ccby4-notice"]),
    ("CC0-1.0", "notice", ["cc0-notice"]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is a sentence; so is a stretch of unwrapped text up to a sentence mark or blank line.
LINES, STRETCHES = r"[\r\n]+|[.!?;][ \t]+", r"\r?\n[ \t]*\r?\n|[.!?;:][ \t\r\n]+"
#: Marks inside a sentence, the next line's comment signs allowed: "v. 2.0", and "Free Software Foundation; either version 2".
#: The SQL counterpart, whose expressions know no look-behind, blanks these marks before it splits.
NO_END = r"(?!(?<=\b[vV]\.)[ \t\r\n/*#]+[0-9]|(?<=[fF]oundation;)[ \t\r\n/*#]+either version)"
WHOLE_LINES, WHOLE_STRETCHES = (p.replace("?;]", f"?;]{NO_END}").replace("?;:]", f"?;:]{NO_END}") for p in (LINES, STRETCHES))


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def _identifiers(text: Column, splitter: str, known: Column) -> Column:
    ids = F.transform(F.split(text, splitter), lambda s: F.try_element_at(known, normalised(s)))
    return F.filter(ids, lambda i: i.isNotNull())


def _holds(sequence: Column, needed: list[str]) -> Column:
    return sequence.like("%" + "%".join(f"<{i}>" for i in needed) + "%")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, list[str]] | None = None,
         rules: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Per row: key, n_known long, sentence_ids string, license string, rule string, licenses string.

    ``sentence_ids`` are the identifiers found line by line, in order, each as ``<id>``; ``license`` and ``rule``
    belong to the first rule that holds in the lines or in the unwrapped text, ``licenses`` names all that hold
    (in the order of their first rules, joined by ``;``). Rows without a known sentence, null and empty texts have
    0 and empty strings; known sentences that satisfy no rule give the licence ``unmatched``. A null key stays;
    repeated rows give repeated results; other columns of the input are ignored.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = F.create_map(*[F.lit(x) for i, forms in sentences.items() for s in forms for x in (s, i)])
    body = F.coalesce(F.col(text), F.lit(""))
    tagged = lambda ids: F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    found = docs.select(
        F.col(key).alias("_key"),
        tagged(_identifiers(body, WHOLE_LINES, known)).alias("_lines"), tagged(_identifiers(body, WHOLE_STRETCHES, known)).alias("_unwrapped"),
        )
    holds = [_holds(F.col("_lines"), ids) | _holds(F.col("_unwrapped"), ids) for _, _, ids in rules]
    first = lambda part: reduce(
        lambda rest, i: F.when(holds[i], F.lit(rules[i][part])).otherwise(rest), range(len(rules) - 1, -1, -1),
        F.when(F.concat("_lines", "_unwrapped") != "", F.lit("unmatched")).otherwise(F.lit("")))
    names = list(dict.fromkeys(r[0] for r in rules))
    every = F.concat_ws(";", *[
        F.when(reduce(lambda x, y: x | y, [h for h, r in zip(holds, rules, strict=True) if r[0] == n]), F.lit(n)) for n in names])
    return found.select(
        F.col("_key").alias(key),
        (F.length("_lines") - F.length(F.translate("_lines", "<", ""))).cast("long").alias("n_known"),
        F.col("_lines").alias("sentence_ids"), first(0).alias("license"), first(1).alias("rule"), every.alias("licenses"))


def scan_sql() -> str:
    """The same on DuckDB. The marks of ``NO_END`` are blanked first: no sentence keeps its marks anyway."""
    after = r"([ \t\r\n/*#]+"
    body = "coalesce(text, '')"
    for mark in (rf"\b([vV])\.{after}[0-9])", rf"([fF]oundation);{after}either version)"):
        body = rf"regexp_replace({body}, '{mark}', '\1 \2', 'g')"
    pairs = [(s, i) for i, forms in SENTENCES.items() for s in forms]
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    norm = f"trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    ids = lambda splitter: (
        f"list_aggregate(list_prepend('', list_transform(list_filter(list_transform(string_split_regex({body}, '{splitter}'), "
        f"lambda s: {norm}), lambda s: list_contains({quoted(s for s, _ in pairs)}, s)), "
        f"lambda s: '<' || {quoted(i for _, i in pairs)}[list_position({quoted(s for s, _ in pairs)}, s)] || '>')), 'string_agg', '')")
    like = lambda r: "'%" + "%".join(f"<{i}>" for i in r[2]) + "%'"
    holds = [f"(l LIKE {like(r)} OR u LIKE {like(r)})" for r in RULES]
    first = lambda part: "CASE " + " ".join(f"WHEN {h} THEN '{r[part]}'" for h, r in zip(holds, RULES, strict=True)) + \
        " WHEN l || u <> '' THEN 'unmatched' ELSE '' END"
    names = list(dict.fromkeys(r[0] for r in RULES))
    every = [" OR ".join(h for h, r in zip(holds, RULES, strict=True) if r[0] == n) for n in names]
    joined = "concat_ws(';', " + ", ".join(f"CASE WHEN {e} THEN '{n}' END" for n, e in zip(names, every, strict=True)) + ")"
    return (f"WITH t AS (SELECT doc_id, {ids(LINES)} AS l, {ids(STRETCHES)} AS u FROM documents) "
            f"SELECT doc_id, CAST(length(l) - length(replace(l, '<', '')) AS BIGINT) AS n_known, l AS sentence_ids, {first(0)} AS license, "
            f"{first(1)} AS rule, {joined} AS licenses FROM t")
