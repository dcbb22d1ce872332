"""Licence scans by sentence rules.

A text is normalised first: marks of comments at line starts and ends go, A-Z
is lower-cased, and everything between two words, numbers included, becomes one
gap. A gap is an end (a blank line, a line of marks alone, or a full stop,
semicolon, colon, question or exclamation mark before white space or the text's
end), a line end, or a blank. A sentence begins and stops at an end, a line end
or the edge of the text; line ends inside may be wraps. Each known sentence has
an identifier; of those that begin at one place the longest is taken, and the
scan goes on behind it. The identifiers of a text, in order, are matched
against ordered rules: a rule names a licence and a run of identifiers, longer
and more specific rules come first, and what a rule has matched is used up.
Identifiers that no rule takes are counted as unmatched.

All of it runs in DataFrame functions: no shuffle, one pass. Texts without one
of the words that every known sentence has one of (`HINTS`) are not normalised,
as nothing can be found in them.

Defined cases: null and empty texts have no sentences and no licences. Unknown
sentences are skipped, they don't break a run. A licence found several times is
listed once, with the number of its matches in `n_matches`. Quotation marks,
brackets and commas don't count, nor does the length of a line or a sentence.
Repeated rows give one result row each; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import lower_ascii

#: Normalised sentence -> identifier. The wording of the licences.
SENTENCES: dict[str, str] = {
    "licensed under cc by-nc 4.0": "CcByNc4",
    "licensed under cc by 4.0": "CcBy4",
    "licensed under cc by-sa 4.0": "CcBySa4",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4",
    "this work is licensed under the creative commons attribution 4.0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CcBySa4",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CcByNc4",
    "cc0 1.0 universal": "Cc0",
    "this work is licensed under the gnu general public license version 3": "Gpl3Work",
    "this work is licensed under the gnu general public license version 2": "Gpl2Work",
    "this program is free software": "GplFree",
    "this library is free software": "LgplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplRedistribute",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Terms",
    "it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Only",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Only",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplRedistribute",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Terms",
    "either version 3 of the license or at your option any later version": "Gpl3Later",
    "either version 2 of the license or at your option any later version": "Gpl2Later",
    "either version 2.1 of the license or at your option any later version": "Lgpl21Later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GplImplied",
    "see the gnu general public license for more details": "GplDetails",
    "see the gnu lesser general public license for more details": "LgplDetails",
    "see the gnu affero general public license for more details": "AgplDetails",
    "licensed under the apache license version 2.0": "Apache2",
    "licensed under the apache license version 2.0 the license": "Apache2",
    "apache license version 2.0": "Apache2Name",
    "you may not use this file except in compliance with the license": "ApacheCompliance",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheLimits",
    "released under the mit license": "MitName",
    "licensed under the mit license": "MitName",
    "the mit license": "MitTitle",
    "the mit license mit": "MitTitle",
    "mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "MitPermission",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitPermission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied": "MitWarranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscPermission",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscPermission",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdForms",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "Mpl2",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this software is provided as-is without any express or implied warranty": "ZlibWarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibPermission",
    "all rights reserved": "AllRights",
}

#: Licence, run of identifiers; the first that matches takes them. Fixed order.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3Terms", "GplHope", "GplImplied", "AgplDetails")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Terms", "GplHope", "GplImplied", "GplDetails")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Terms", "GplHope", "GplImplied", "GplDetails")),
    ("GPL-2.0-or-later", ("GplFree", "GplRedistribute", "Gpl2Later", "GplHope", "GplImplied", "GplDetails")),
    ("MIT", ("MitTitle", "MitPermission", "MitNotice", "MitWarranty", "MitLiability")),
    ("MIT", ("MitPermission", "MitNotice", "MitWarranty", "MitLiability")),
    ("Apache-2.0", ("Apache2", "ApacheCompliance", "ApacheCopy", "ApacheWarranty", "ApacheLimits")),
    ("BSD-3-Clause", ("BsdForms", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3Terms")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Terms")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Terms")),
    ("GPL-3.0-or-later", ("GplFree", "GplRedistribute", "Gpl3Later")),
    ("GPL-2.0-or-later", ("GplFree", "GplRedistribute", "Gpl2Later")),
    ("GPL-2.0-only", ("GplFree", "Gpl2Only")),
    ("LGPL-3.0-or-later", ("LgplFree", "Lgpl3Terms")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplRedistribute", "Lgpl21Later")),
    ("MIT", ("MitPermission", "MitNotice", "MitWarranty")),
    ("BSD-2-Clause", ("BsdForms", "BsdSource", "BsdBinary")),
    ("Apache-2.0", ("Apache2", "ApacheCompliance", "ApacheCopy")),
    ("Zlib", ("ZlibWarranty", "ZlibPermission")),
    ("MIT", ("MitPermission", "MitNotice")),
    ("ISC", ("IscPermission",)),
    ("MPL-2.0", ("Mpl2",)),
    ("Unlicense", ("Unlicense",)),
    ("GPL-3.0-only", ("Gpl3Work",)),
    ("GPL-2.0-only", ("Gpl2Work",)),
    ("Apache-2.0", ("Apache2",)),
    ("MIT", ("MitName",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
]

#: Every known sentence has a word with one of these in it.
HINTS = ("licen", "software", "permission", "redistribut", "universal", "warrant", "version", "reserved")
#: Marks of comments at the start of a line, and at its end.
LINE_START = r"(?m)^[ \t]*(?:(?:/\*+|\*+/|<!--|-->|//+|#+|\*+|;+|%+|--+|rem |dnl |\.\\\")[ \t]*)+"
LINE_END = r"(?m)[ \t]*(?:\*+/?|-->|#+|//+)[ \t]*$"
#: What is put for what, in this order; | is an end of a sentence.
STEPS: list[tuple[str, str]] = [
    (r"[|]", " "),
    (LINE_START, ""),
    (LINE_END, ""),
    (r"[.;:?!]+[\"')\]]*(\s|$)", r"|\1"),
    (r"(?:\r?\n[ \t]*){2,}", "|"),
    (r"[^a-z0-9.\-|\n]+", " "),
    (r"(^|[ |\n])[.\-]+", r"\1"),
    (r"[.\-]+($|[ |\n])", r"\1"),
    (r"[ \n]*[|][ |\n]*", "|"),
    (r" *\n[ \n]*", "\n"),
    (r"^ +| +$", ""),
]


def normalised(text: Column) -> Column:
    """Words apart by one gap: an end (|), a line end or a blank."""
    out = lower_ascii(text)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\1", "$1"))
    return out


def _pattern(sentences: dict[str, str]) -> str:
    """Any known sentence, the longest first, from one edge to another."""
    ordered = sorted(sentences, key=lambda s: (-len(s), s))
    return r"(?<![^|\n])(?:" + "|".join(s.replace(".", r"\.").replace(" ", r"[ \n]") for s in ordered) + r")(?![^|\n])"


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """The identifiers of a text's known sentences, in order."""
    hints = HINTS if sentences is None else ("",)
    sentences = SENTENCES if sentences is None else sentences
    table = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    found = F.regexp_extract_all(normalised(text), F.lit(f"({_pattern(sentences)})"), 1)
    ids = F.transform(found, lambda s: F.element_at(table, F.replace(s, F.lit("\n"), F.lit(" "))))
    return F.when(lower_ascii(text).rlike("|".join(hints)), ids).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """A row per input row: doc_id, sentence_ids and licences (comma-joined),
    n_matches, n_unmatched."""
    rules = RULES if rules is None else rules
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), sentence_ids(text, sentences).alias("ids"))
    names = list(dict.fromkeys(name for name, _ in rules))

    def used(state: Column, wanted: Column) -> Column:
        # a mark as long as one character stands for what was taken
        left = F.replace(state.rest, wanted, F.lit("!"))
        times = ((F.length(state.rest) - F.length(left)) / (F.length(wanted) - 1)).cast("long")
        return F.struct(left.alias("rest"), F.concat(state.taken, F.array(times)).alias("taken"))

    runs = F.array(*(F.lit("".join(f"<{i}>" for i in run)) for _, run in rules))
    marked = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    matched = F.aggregate(runs, F.struct(marked.alias("rest"), F.array().cast("array<bigint>").alias("taken")), used)
    state = ids.select("doc_id", "ids", F.when(F.size("ids") > 0, matched).alias("m"))
    per_name = [F.when(sum(F.get(F.col("m.taken"), F.lit(k)) for k, (other, _) in enumerate(rules) if other == name) > 0, F.lit(name)) for name in names]
    return state.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.when(F.size("ids") > 0, F.concat_ws(",", *per_name)).otherwise("").alias("licences"),
        F.coalesce(F.aggregate("m.taken", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.length("m.rest") - F.length(F.replace(F.col("m.rest"), F.lit("<"), F.lit(""))), F.lit(0)).cast("long").alias("n_unmatched"),
    )


def oracle() -> str:
    """The same scan in DuckDB SQL, without the pattern of all sentences: runs
    of lines are joined and looked up."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SENTENCES.items())
    clean = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for pattern, to in STEPS:
        clean = f"regexp_replace({clean}, {quoted(pattern)}, {quoted(to)}, 'g')"
    most = max(len(s.split()) for s in SENTENCES)
    steps, last = [], "s0"
    for k, (_, run) in enumerate(RULES):
        wanted = quoted("".join(f"<{i}>" for i in run))
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (rest), CAST((length(rest) - length(replace(rest, {wanted}, '!'))) / (length({wanted}) - 1) AS BIGINT) AS m{k}, replace(rest, {wanted}, '!') AS rest FROM {last})")
        last = f"s{k + 1}"
    names = list(dict.fromkeys(name for name, _ in RULES))
    listed = ", ".join("CASE WHEN " + " + ".join(f"m{k}" for k, (other, _) in enumerate(RULES) if other == name) + f" > 0 THEN {quoted(name)} END" for name in names)
    return f"""
        WITH known(sentence, id) AS (VALUES {pairs}),
        clean AS (
            SELECT doc_id, string_split({clean}, '|') AS pieces FROM documents
        ), numbered AS (
            SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM clean
        ), able AS (
            SELECT DISTINCT doc_id, pos, string_split(piece, chr(10)) AS lines FROM numbered JOIN known ON contains(replace(piece, chr(10), ' '), sentence)
        ), starts AS (
            SELECT doc_id, pos, lines, unnest(range(1, len(lines) + 1)) AS i FROM able
        ), runs AS (
            SELECT doc_id, pos, lines, i, unnest(range(i, least(i + {most}, len(lines) + 1))) AS j FROM starts
        ), found AS (
            SELECT doc_id, pos, i, j, id FROM runs JOIN known ON array_to_string(lines[i:j], ' ') = sentence
        ), taken AS (
            SELECT * FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.pos = b.pos AND ((b.i < a.i AND b.j >= a.i) OR (b.i = a.i AND b.j > a.j)))
        ), listed AS (
            SELECT doc_id, string_agg(id, ',' ORDER BY pos, i) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY pos, i) AS rest FROM taken GROUP BY doc_id
        ), s0 AS (
            SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rest, '') AS rest FROM documents d LEFT JOIN listed f ON d.doc_id = f.doc_id
        ), {", ".join(steps)}
        SELECT doc_id, sentence_ids, concat_ws(',', {listed}) AS licences, CAST({" + ".join(f"m{k}" for k in range(len(RULES)))} AS BIGINT) AS n_matches,
            CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unmatched
        FROM {last}
    """
