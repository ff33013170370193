"""Licence recognition by sentences and rules, in built-in functions only.

Known sentences that run over line ends or colons are joined first. A text is cut into sentences; each is normalised and mapped to the identifier of a known licence sentence, or to ``?``. Then
ordered rules, longer ones first, look for their sequence of identifiers; a rule that matches takes its identifiers out, so
that a later, shorter rule does not match the same sentences. No shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import ASCII_LOWER, ASCII_UPPER, column, fresh, lower_ascii

# Normalised sentences (a-z and digits, single spaces) and the identifiers of what they say.
SENTENCES = {
    "licensed under cc by nc 4 0": "CC-BY-NC-4.0-ref",
    "licensed under cc by 4 0": "CC-BY-4.0-ref",
    "licensed under cc by sa 4 0": "CC-BY-SA-4.0-ref",
    "this work is licensed under the gnu general public license version 3": "GPL-3.0-ref",
    "this work is licensed under the gnu general public license version 2": "GPL-2.0-ref",
    "licensed under the apache license version 2 0": "Apache-2.0-ref",
    "licensed under the apache license version 2 0 the license": "Apache-2.0-ref",
    "you may not use this file except in compliance with the license": "Apache-compliance",
    "you may obtain a copy of the license at": "Apache-copy",
    "released under the mit license": "MIT-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MIT-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-notice",
    "the software is provided as is without warranty of any kind express or implied": "MIT-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-endorse",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL-3.0-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GPL-warranty",
    "all rights reserved": "reserved",
}
# Sentences as the full licence texts have them. OP2_SQL knows only those above, on one line each.
WHOLE = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3": "GPL-3.0-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "GPL-3.0-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2": "GPL-2.0-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "GPL-2.0-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL-2.0-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL-2.1-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL-3.0-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL-3.0-later",
    "this source code form is subject to the terms of the mozilla public license v": "MPL-2.0-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-grant",
    "this is free and unencumbered software released into the public domain": "Unlicense-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-grant",
}
KNOWN = SENTENCES | WHOLE
# Sentences with a name of their own, ``*``, and the known sentence that they are.
NAMED = {
    "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
# Rules in the order in which they are tried.
RULES = [
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty"]),
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("GPL-3.0-or-later", ["GPL-3.0-later", "GPL-warranty"]),
    ("Apache-2.0", ["Apache-2.0-ref", "Apache-compliance", "Apache-copy"]),
    ("GPL-3.0-or-later", ["GPL-3.0-later"]),
    ("GPL-2.0-or-later", ["GPL-2.0-later"]),
    ("LGPL-2.1-or-later", ["LGPL-2.1-later"]),
    ("LGPL-3.0-or-later", ["LGPL-3.0-later"]),
    ("AGPL-3.0-or-later", ["AGPL-3.0-later"]),
    ("MPL-2.0", ["MPL-2.0-notice"]),
    ("ISC", ["ISC-grant"]),
    ("0BSD", ["0BSD-grant"]),
    ("GPL-3.0-only", ["GPL-3.0-ref"]),
    ("GPL-2.0-only", ["GPL-2.0-ref"]),
    ("Apache-2.0", ["Apache-2.0-ref"]),
    ("MIT", ["MIT-ref"]),
    ("MIT-like", ["MIT-grant"]),
    ("Unlicense", ["Unlicense-notice"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC-4.0-ref"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA-4.0-ref"]),
    ("CC-BY-4.0", ["CC-BY-4.0-ref"]),
    ("all-rights-reserved", ["reserved"]),
]
# Every known sentence has one of these words, so a text without them needs no cutting.
HINTS = ["licen", "permission", "warranty", "redistribut", "copyright", "reserved", "endorse", "unencumbered"]
BREAK = "[.!?;:]+[ \t\r]+|[\n]+"
NOT_WORD = "[^a-z0-9]+"
# A joined sentence begins and ends where BREAK cuts; a list number before it goes. Its words are apart by anything but a sentence end or a blank line.
BEGIN = r"(?<=^|\n|[.!?;:][ \t\r])[^a-z0-9\n]*(?:(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[.)][ \t]+)?[^a-z0-9\n]*"
BETWEEN = r"(?![^a-z0-9]*?(?:[.!?][ \t\r\n]|\n[ \t\r]*\n))[^a-z0-9]++"
NAME = r"[^\n!?;:]*?(?:\n(?![ \t\r]*\n)[^\n!?;:]*?){0,5}?"
END = r"(?=[^a-z0-9]*?(?:[.!?;:][ \t\r]|\n|\z))"


def _joined(lowered: Column, sentences: dict[str, str]) -> Column:
    """The text with each known sentence on one line, longer ones first; only those whose longest word it has are looked for."""
    lines = {s: s for s in sentences} | {s: line for s, line in NAMED.items() if line in sentences}
    longest_first = sorted(lines, key=lambda s: (-len(s), s))
    patterns = {s: BEGIN + BETWEEN.join(NAME if w == "*" else w for w in s.split()) + END for s in lines}
    table = F.array(*[F.struct(F.lit(max(s.split(), key=len)).alias("word"), F.lit(patterns[s]).alias("pattern"), F.lit(lines[s]).alias("line")) for s in longest_first])
    return F.aggregate(table, lowered, lambda acc, r: F.when(F.contains(acc, r["word"]), F.regexp_replace(acc, r["pattern"], r["line"])).otherwise(acc))


def _ids(text: Column, sentences: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    lowered = _joined(lower_ascii(text), sentences)
    said = F.transform(F.split(lowered, BREAK), lambda s: F.trim(F.regexp_replace(s, NOT_WORD, " ")))
    said = F.filter(said, lambda s: s != "")
    return F.transform(said, lambda s: F.coalesce(F.try_element_at(known, s), F.lit("?")))


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, sentences: dict[str, str] = KNOWN, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """The columns ``keep`` (all, unless given) and: n_known (licence sentences), sequence (their identifiers with ``?`` for runs of others, between commas) and licenses (the names of
    the rules that match, in their order, without repetition, between commas).

    One row per row. A null, empty or blank text has no sentence: 0, ``,`` and an empty string, as has a text without licence sentences but for its
    ``?``. Whole texts are read. A rule that occurs twice counts once. Names that are taken are lengthened by ``_``. No rows: no rows.
    """
    for s in sentences:
        if not any(h in s for h in HINTS):
            raise ValueError(f"no hint finds {s!r}")
    kept = docs.columns if keep is None else keep
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    lowered = F.translate(text, ASCII_UPPER, ASCII_LOWER)
    hinted = F.lit(False)
    for h in HINTS:
        hinted = hinted | F.contains(lowered, F.lit(h))
    names, taken = {}, [*kept]
    for n in ("n_known", "sequence", "licenses", "ids"):
        names[n] = fresh(taken, n)
        taken.append(names[n])
    blank = F.rlike(text, F.lit("[A-Za-z0-9]"))
    out = docs.select(*[column(docs, c) for c in kept], F.when(hinted, _ids(text, sentences)).when(blank, F.array(F.lit("?"))).otherwise(F.array().cast("array<string>")).alias(names["ids"]))
    ids = F.col(names["ids"])
    merged = F.aggregate(ids, F.lit(","), lambda acc, x: F.when((x == "?") & acc.endswith(",?,"), acc).otherwise(F.concat(acc, x, F.lit(","))))
    out = out.select(*[column(out, c) for c in kept], F.size(F.filter(ids, lambda x: x != "?")).cast("long").alias(names["n_known"]), merged.alias(names["sequence"]))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(seq) + ",").alias("seq")) for name, seq in rules])
    start = F.struct(F.col(names["sequence"]).alias("rest"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(
        table,
        start,
        lambda acc, r: F.when(F.contains(acc["rest"], r["seq"]), F.struct(F.replace(acc["rest"], r["seq"], F.lit(",")).alias("rest"), F.array_union(acc["found"], F.array(r["name"])).alias("found"))).otherwise(acc),
        lambda acc: F.array_join(acc["found"], ","),
    )
    return out.withColumn(names["licenses"], F.when(F.col(names["n_known"]) > 0, found).otherwise(F.lit("")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = [], "s0"
    for k, (name, seq) in enumerate(RULES, 1):
        pat = "," + ",".join(seq) + ","
        steps.append(
            f"s{k} as (select doc_id, n_known, sequence, replace(rest, '{pat}', ',') as rest, case when contains(rest, '{pat}') and not list_contains(found, '{name}') then list_append(found, '{name}') else found end as found from {last})"
        )
        last = f"s{k}"
    return f"""
with known(sentence, id) as (values {known}),
m as (select map(list(sentence), list(id)) as known from known),
parts as (
  select doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.!?;:]+[ \\t\\r]+|[\\n]+'),
    lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') as sentences from documents
),
ids as (
  select doc_id, list_transform(sentences, lambda s: coalesce(known[s], '?')) as ids from parts, m
),
s0 as (
  select doc_id, len(list_filter(ids, lambda x: x <> '?')) as n_known,
    regexp_replace(concat(',', array_to_string(ids, ','), case when len(ids) > 0 then ',' else '' end), ',[?](,[?])+,', ',?,', 'g') as sequence,
    regexp_replace(concat(',', array_to_string(ids, ','), case when len(ids) > 0 then ',' else '' end), ',[?](,[?])+,', ',?,', 'g') as rest, cast([] as varchar[]) as found
  from ids
),
{", ".join(steps)}
select doc_id, n_known, sequence, array_to_string(found, ',') as licenses from {last}
"""


OP2_SQL = _sql()
