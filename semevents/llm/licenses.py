"""License scans by sentence rules (DataFrame functions only).

Each text is cut into sentences: after a full stop, colon, semicolon, question or exclamation mark that white space
follows (but not in "v. 2"), and at lines without a letter or digit, so that wrapped lines and the marks of comments don't
matter. A sentence is normalised (lower case, runs of anything but a-z and 0-9 become one space), known sentences become
identifiers, and the identifier sequence of the document is matched against ordered rules. A sentence that is not known is
looked up line by line, as notices also stand on a line of their own. It is one narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "licensed under the apache license version 2 0",
    4: "this work is licensed under the gnu general public license version 3",
    5: "licensed under cc by nc 4 0",
    6: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    7: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    8: "you may not use this file except in compliance with the license",
    9: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    10: "you may obtain a copy of the license at",
    11: "you should have received a copy of the gnu general public license along with this program",
    12: "this work is licensed under a creative commons attribution 4 0 international license",
    13: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    14: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    15: "this source code form is subject to the terms of the mozilla public license v 2 0",
    16: "all rights reserved",
    17: "http www apache org licenses license 2 0",
    18: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    19: "licensed under the apache license version 2 0 the license",
    20: "the asf licenses this file to you under the apache license version 2 0 the license",
    21: "this program is free software",
    22: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    23: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    24: "either version 2 of the license or at your option any later version",
    25: "either version 3 of the license or at your option any later version",
    26: "this library is free software",
    27: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    28: "either version 2 1 of the license or at your option any later version",
    29: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    30: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    31: "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    32: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    33: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    34: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    35: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    36: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    37: "this is free and unencumbered software released into the public domain",
    38: "distributed under the boost software license version 1 0",
    39: "this software is provided as is without any express or implied warranty",
    40: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    41: "this work is licensed under the creative commons attribution 4 0 international license",
    42: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    43: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
}
# Fixed values: (licence, identifiers in order), the most specific first.
RULES = [
    ("mit", [6, 7]),
    ("bsd-3-clause", [13, 32, 33, 14]),
    ("bsd-3-clause", [13, 14]),
    ("bsd-2-clause", [13, 32, 33]),
    ("apache-2.0", [19, 8, 10, 17, 18]),
    ("apache-2.0", [19, 8, 9]),
    ("apache-2.0", [20, 8]),
    ("apache-2.0", [19, 8]),
    ("apache-2.0", [3, 8]),
    ("gpl-3.0-or-later", [21, 22, 11]),
    ("gpl-3.0-or-later", [21, 22]),
    ("gpl-3.0-or-later", [23, 25]),
    ("gpl-2.0-or-later", [21, 23, 24]),
    ("gpl-2.0-or-later", [23, 24]),
    ("gpl-2.0-only", [31]),
    ("lgpl-2.1-or-later", [26, 27, 28]),
    ("lgpl-3.0-or-later", [29]),
    ("agpl-3.0-or-later", [21, 30]),
    ("mpl-2.0", [15, 34]),
    ("mpl-2.0", [15, 35]),
    ("zlib", [39, 40]),
    ("isc", [36]),
    ("unlicense", [37]),
    ("bsl-1.0", [38]),
    ("epl-2.0", [43]),
    ("mit", [1]),
    ("mit", [2]),
    ("mit", [6]),
    ("apache-2.0", [3]),
    ("apache-2.0", [19]),
    ("apache-2.0", [9]),
    ("gpl-3.0", [4]),
    ("gpl-3.0-or-later", [22]),
    ("agpl-3.0-or-later", [30]),
    ("cc-by-nc-4.0", [5]),
    ("cc-by-4.0", [12]),
    ("cc-by-4.0", [41]),
    ("cc-by-sa-4.0", [42]),
    ("bsd-2-clause", [13]),
    ("mpl-2.0", [15]),
    ("all-rights-reserved", [16]),
]
#: Where a lower-case text is cut into sentences.
CUT = r"""(?:[!?:;]|(?<!(?:^|[^a-z0-9])(?:v|ver|e\.g|i\.e))\.)["')\]]*[ \t\r\n]+|\n[^a-z0-9\n]*\n"""


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_sentences, sentence_ids, licenses, license.

    ``sentence_ids`` joins the identifiers of known sentences in text order; sentences that are not known stand
    between them without breaking a sequence. ``licenses`` joins, in rule order, the licences whose rule's
    identifiers follow each other; identifiers that a longer rule has taken don't match a later rule again.
    ``license`` is the first of them. Null and empty texts have 0 sentences and empty strings, license null.
    Repeated rows give repeated results; other columns are ignored.
    """
    known, rules = sentences or SENTENCES, rules or RULES
    look = F.create_map(*[x for i, s in known.items() for x in (F.lit(s), F.lit(str(i)))])
    names = list(known.values())
    raw = docs.select(F.col(id_col), F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), CUT).alias("raw"))
    # a sentence of several lines keeps them, for the case that only one of them is known
    cut = raw.select(id_col, F.filter(F.transform("raw", lambda s: F.struct(_normal(s).alias("s"), F.when(s.contains("\n"), s).alias("lines"))), lambda x: x["s"] != "").alias("x"))
    some = F.transform(
        F.filter("x", lambda x: x["s"].isin(names) | x["lines"].isNotNull()),
        lambda x: F.when(x["s"].isin(names), F.array(x["s"])).otherwise(F.filter(F.transform(F.split(x["lines"], "\n"), _normal), lambda s: s.isin(names))),
    )
    ids = cut.select(F.col(id_col), F.size("x").cast("long").alias("n_sentences"), F.transform(F.flatten(some), lambda s: F.element_at(look, s)).alias("ids"))
    joined = ids.select(
        id_col, "n_sentences", F.array_join("ids", ",").alias("sentence_ids"),
        F.when(F.size("ids") > 0, F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(","))).otherwise(F.lit("")).alias("left_0"),
    )
    # Each rule takes what it matches out of the sequence ("|" keeps its neighbours apart); a few short strings per
    # document, as most have no known sentence at all.
    out, hits = joined, []
    for k, (name, seq) in enumerate(rules):
        pattern = "".join(f",{i}," for i in seq)
        hits.append(F.when(F.contains(F.col(f"left_{k}"), F.lit(pattern)), F.lit(name)))
        out = out.withColumn(f"left_{k + 1}", F.replace(F.col(f"left_{k}"), F.lit(pattern), F.lit("|")))
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return out.select(
        id_col, "n_sentences", "sentence_ids", F.array_join(found, ",").alias("licenses"),
        F.when(F.size(found) > 0, F.element_at(found, 1)).alias("license"),
    )


def oracle(table: str = "documents") -> str:
    """The same scan in DuckDB's SQL: sentences and lines as rows, joined with the known ones; rules by recursion over them."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {q(s)})" for i, s in SENTENCES.items())
    rules = ", ".join(f"({k}, {q(name)}, {q(''.join(f',{i},' for i in seq))})" for k, (name, seq) in enumerate(RULES))
    short = "regexp_replace({}, '(^|[^a-z0-9])(v|ver|e\\.g|i\\.e)\\.([ \\t\\r\\n])', '\\1\\2 \\3', 'g')"
    return f"""WITH RECURSIVE known(id, s) AS (VALUES {known}), rules(k, name, p) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, {short.format(short.format("lower(coalesce(text, ''))"))} AS t FROM {table}),
raw AS (SELECT r, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM (SELECT r, string_split_regex(t, '[.!?:;]["\x27\x27)\\]]*[ \\t\\r\\n]+|\\n[^a-z0-9\\n]*\\n') AS l FROM d)),
sentence AS (SELECT r, p, x, trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) AS s FROM raw),
line AS (SELECT r, p, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM (SELECT r, p, string_split(x, chr(10)) AS l FROM sentence WHERE contains(x, chr(10)) AND s NOT IN (SELECT s FROM known))),
hit AS (SELECT r, p, 0 AS n, id FROM sentence JOIN known USING (s)
  UNION ALL SELECT r, p, n, id FROM line JOIN known ON known.s = trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))),
ids AS (SELECT r, string_agg(id, ',' ORDER BY p, n) AS ids, ',' || string_agg(id, ',,' ORDER BY p, n) || ',' AS l FROM hit GROUP BY r),
step AS (SELECT r, 0 AS k, l, CAST([] AS VARCHAR[]) AS f FROM ids
  UNION ALL SELECT r, step.k + 1, replace(l, p, '|'), CASE WHEN contains(l, p) AND NOT list_contains(f, name) THEN list_append(f, name) ELSE f END FROM step JOIN rules USING (k))
SELECT d.doc_id, coalesce(c.n, 0) AS n_sentences, coalesce(ids.ids, '') AS sentence_ids, coalesce(array_to_string(f, ','), '') AS licenses, CASE WHEN len(f) > 0 THEN f[1] END AS license
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM sentence WHERE s <> '' GROUP BY r) c USING (r) LEFT JOIN ids USING (r) LEFT JOIN (SELECT r, f FROM step WHERE k = {len(RULES)}) e USING (r)"""
