"""Operator 6, licence scan by sentence rules.

Texts are normalised: A-Z lowered, and every run of ASCII characters that are neither
letters nor digits (comment leaders with them) becomes one mark that says what it holds: a
sentence end (``. ! ?`` before white space, or a blank line), ``; :``, a line end, or none of
these.  A known licence sentence may be wrapped over lines; it begins and ends at any of the
three former marks.  Grants and notices may have a subject of their own (``Foo is free software ...``), a
notice may name several licences (``either of ... or ...``), and a name has room for any holder.  Each
sentence found is mapped to its identifier, a notice to one for each licence that it names.
SPDX expressions are read licence by licence; their identifiers stand behind those of the sentences.

The identifiers of a document, in text order, are matched against ordered rules, the longest first.  A rule
holds when its identifiers occur in its order, other ones between them or not, and takes them away, so that what is part of a
longer text does not count again.  Identifiers that name a licence by themselves need no rule.  Licences are named as SPDX does,
each in one way.  Sentences that speak of a licence but are not known are reported.

DataFrame functions only: one projection over the scan, without a shuffle, so neither hot
sources nor groups of copies matter.  Only texts that hold one of a few anchor words are
cut; every known sentence holds one, so no match is lost.

Defined cases: null and empty texts match nothing; each row gives one row, repeated rows
and null ids too; very long texts are read whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import documents, lower_az

#: Normalised sentences of public licence texts, by identifier, without subjects; * stands for one to eight words.
SENTENCES = {
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "you may not use this file except in compliance with the license",
    8: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    11: "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    15: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    16: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    17: "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    19: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    20: "apache license version 2 0 january 2004 http www apache org licenses",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    24: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    26: "gnu general public license version 3 29 june 2007",
    27: "gnu general public license version 2 june 1991",
    30: "gnu lesser general public license version 3 29 june 2007",
    31: "gnu lesser general public license version 2 1 february 1999",
    35: "gnu affero general public license version 3 19 november 2007",
    37: "this source code form is subject to the terms of the mozilla public license v 2 0",
    38: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    39: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    40: "mozilla public license version 2 0",
    42: "this is free and unencumbered software released into the public domain",
    43: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    44: "this software is provided as is without any express or implied warranty",
    45: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    46: "boost software license version 1 0 august 17th 2003",
    55: "mit license",
    56: "the mit license mit",
    57: "isc license",
    58: "bsd 2 clause license",
    59: "bsd 3 clause license",
}
#: Licence names, in order of the identifiers that name them.
NAMES = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0"]
GRANTED, NOTED, TAGGED, RULED = 200, 300, 100, 500  # identifiers from here on: grants, notices, SPDX expressions, rules that held
#: Public licences of one family, with their versions.
FAMILIES = [("GPL", "general public license", ("2", "3")), ("LGPL", "library general public license", ("2",)), ("LGPL", "lesser general public license", ("2 1", "3")), ("AGPL", "affero general public license", ("3",))]
#: Other names of licences in notices.
ALIASES = {
    "MIT": ["mit license", "mit", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache license v2", "apache 2 0 license", "apache 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "CC0-1.0": ["cc0 1 0", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "BSL-1.0": ["boost software license version 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
}
#: Ordered rules, licence name and the identifiers in order.
RULES = [
    ("BSD-3-Clause", [15, 16, 22, 17]),
    ("BSD-3-Clause", [15, 16, 17]),
    ("MIT", [55, 3, 4]),
    ("MIT", [56, 3, 4]),
    ("BSD-2-Clause", [15, 16, 22]),
    ("MIT", [3, 4]),
    ("MIT", [55, 3]),
    ("MIT", [56, 3]),
    ("BSD-3-Clause", [15, 17]),
    ("BSD-3-Clause", [59, 15]),
    ("BSD-2-Clause", [58, 15]),
    ("BSD-2-Clause", [15, 16]),
    ("MPL-2.0", [37, 38]),
    ("MPL-2.0", [37, 39]),
    ("Unlicense", [42, 43]),
    ("Zlib", [44, 45]),
    ("Apache-2.0", [20]),
    ("ISC", [24]),
    ("GPL-3.0-only", [26]),
    ("GPL-2.0-only", [27]),
    ("LGPL-3.0-only", [30]),
    ("LGPL-2.1-only", [31]),
    ("AGPL-3.0-only", [35]),
    ("MPL-2.0", [40]),
    ("BSL-1.0", [46]),
]
assert all(len(a) >= len(b) for (_, a), (_, b) in zip(RULES, RULES[1:]))


def release(version: str) -> str:
    return version.replace(" ", ".") if " " in version else f"{version}.0"


def grants() -> dict[str, str]:
    """Normalised grants of the families of public licences, behind "free software ... under the terms of", with the licence."""
    out, by = {}, " as published by the free software foundation"
    for short, long, versions in FAMILIES:
        for v in versions:
            of, name = f"the gnu {long}", f"{short}-{release(v)}"
            for text in (f"{of}{by} either version {v} of the license or at your option any later version", f"{of}{by} either version {v} or at your option any later version", f"{of} version {v} or at your option any later version{by}", f"{of} either version {v} of the license or at your option any later version", f"{of} version {v} or at your option any later version"):
                out[text] = f"{name}-or-later"
            for text in (f"{of}{by} version {v} of the license", f"{of}{by} version {v}", f"{of}{by} version {v} only", f"{of}{by} version {v} of the license only", f"{of} version {v}{by}", f"{of} version {v} only{by}", f"{of} version {v}", f"{of} version {v} only", f"version {v} of {of}{by}", f"version {v} of {of}"):
                out[text] = f"{name}-only"
    return out


def aliases() -> dict[str, str]:
    """What notices call a licence, with its name."""
    out = {a: name for name, called in ALIASES.items() for a in called}
    for short, long, versions in FAMILIES:
        low = short.lower()
        for v in versions:
            for called in (f"gnu {long} version {v}", f"gnu {long} v{v}", f"gnu {low} v{v}", f"gnu {low} version {v}", f"{low} v{v}", f"{low}v{v}", f"gnu {low}v{v}", f"{low} version {v}", f"{long} version {v}"):
                for zero in ("", " 0") if " " not in v else ("",):
                    out[called + zero] = out[called + zero + " only"] = f"{short}-{release(v)}-only"
                    for later in (" or later", " or any later version", " or at your option any later version"):
                        out[called + zero + later] = f"{short}-{release(v)}-or-later"
    return out


GRANT = "free software you can redistribute it and or modify it under the terms of "
GRANTS, CALLED = grants(), aliases()
WHOLE = {s: f"<{i}>" for i, s in SENTENCES.items() if "*" not in s} | {GRANT + s: f"<{GRANTED + NAMES.index(n)}>" for s, n in GRANTS.items()}
SLOTTED = {s: f"<{i}>" for i, s in SENTENCES.items() if "*" in s}
#: Identifiers that name a licence by themselves, and rules that held.
NAMED = {f"{at + i}": name for at in (GRANTED, NOTED, TAGGED) for i, name in enumerate(NAMES)} | {f"{RULED + i}": name for i, (name, _) in enumerate(RULES)}
#: SPDX identifiers, lowered, with those that SPDX has given up.
TAGS = {name.lower(): name for name in NAMES} | {f"{short}-{release(v)}{plus}".lower(): f"{short}-{release(v)}{kind}" for short, _, versions in FAMILIES for v in versions for plus, kind in (("", "-only"), ("+", "-or-later"))}
ANCHORS = ("licen", "copyright", "permission", "warranty", "redistribution", "mozilla", "public domain", "anyone is free", " under ", "under\n")
assert all(any(a in s for a in ANCHORS) for s in SENTENCES.values())

ONE_OF = lambda texts: "|".join(sorted(texts, key=lambda t: (-len(t), t)))  # noqa: E731  the longest first
WORD = "[a-z0-9]+"
#: A notice, in normalised words; the licences that it names are found in it by ALIAS.
ALIAS = f"(?:{ONE_OF(CALLED)})"
NOTICE = f"(?:dual )?(?:licensed|released|distributed|available|published|provided) under (?:either )?(?:of )?(?:the )?(?:terms of )?(?:either )?(?:the )?{ALIAS}(?:(?: or| and)(?: under)?(?: the)? {ALIAS})*(?: license| licenses)?(?: the license)?(?: at your option)?"
SUBJECT = f"(?:(?:{WORD} ){{1,8}}?(?:is|are) (?=licensed|released|distributed|available|published|provided|dual|free))?"
#: An SPDX expression; an exception behind WITH is no licence.
TAG_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
EXPRESSION = rf"(?i)SPDX-License-Identifier:[ \t]*(\(*{TAG_ID}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{TAG_ID}\)*)*)"


def slot(text: str, gap: str = " ") -> str:
    """The pattern of a text with a name in it; a name may have full stops, which a gap stands for."""
    return text.replace(" * ", f"{gap}{WORD}(?:{gap}{WORD}){{0,7}}?{gap}")


def sentence_pattern() -> str:
    """Matches any known sentence in normalised text; group 1 is the sentence without its subject."""
    texts = [s for s in WHOLE if not s.startswith(GRANT)]
    every = f"{GRANT}(?:{ONE_OF(GRANTS)})|{NOTICE}|{ONE_OF([*texts, *(slot(t, "~") for t in SLOTTED)])}"
    # words may stand on lines of their own; an address may stand in a paragraph of its own; "v. 2" ends no sentence
    wrapped = lambda t: t.replace(" ", "[ CL]").replace("[ CL]http", "[ CLS]http").replace("[ CL]v[ CL]", "[ CL]v[ CLS]").replace("~", "[ CLS]")
    return rf"(?<![^SCL]){SUBJECT.replace(' ', '[ CL]')}({wrapped(every)})(?![^SCL])"


def identifiers(s: Column) -> Column:
    """The identifiers of a known sentence: its own, or those of the licences that a notice names."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    out = F.when(s.startswith("neither"), F.lit(next(iter(SLOTTED.values()))))
    called = table({a: f"<{NOTED + NAMES.index(n)}>" for a, n in CALLED.items()})
    noted = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(ALIAS), F.lit(0)), lambda a: F.try_element_at(called, a)), "")
    return out.otherwise(F.coalesce(F.try_element_at(table(WHOLE), s), noted))


def tag_ids(text: Column) -> Column:
    """(identifiers of the licences of SPDX expressions, tags that are not known), as texts."""
    found = F.array_join(F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(1)), " ")
    bare = F.regexp_replace(found, rf"(?i)[ \t]WITH[ \t]+\(*{TAG_ID}", "")
    tags = F.filter(F.regexp_extract_all(bare, F.lit(TAG_ID), F.lit(0)), lambda t: ~F.lower(t).isin("and", "or", "with"))
    known = F.create_map(*[F.lit(x) for t, n in TAGS.items() for x in (t, f"<{TAGGED + NAMES.index(n)}>")])
    ids = F.array_join(F.transform(tags, lambda t: F.coalesce(F.try_element_at(known, F.lower(t)), F.lit(""))), "")
    return F.struct(ids.alias("ids"), F.filter(tags, lambda t: F.try_element_at(known, F.lower(t)).isNull()).alias("unknown"))


def marked_text(text: Column) -> Column:
    """The text in lower case, in which S, C, L and spaces stand for what is between words."""
    low = marked = lower_az(text)
    for found, mark in (
        (r"[.!?][\"')\]]*(?=\s|$)", "S"),
        (r"\n[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?=\n)", "S"),
        (r"[;:](?=\s|$)", "C"),
        (r"\n", "L"),
        (r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "),
        (r"[ CL]*+S[ CLS]*+", "S"),
        (r"[ L]*+C[ CL]*+", "C"),
        (r" *+L[ L]*+", "L"),
        (r"^ | $", ""),
    ):
        marked = F.regexp_replace(marked, found, mark)
    return marked


def licenses(ids: Column) -> Column:
    """The licences of the identifiers: rules take theirs away, the longest first; then each identifier that names a licence counts."""
    for k, (_, rule) in enumerate(RULES):
        found = "(.*?)".join(f"<{i}>" for i in rule)
        ids = F.regexp_replace(ids, found, "".join(f"${j}" for j in range(1, len(rule))) + f"<{RULED + k}>")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    each = F.transform(F.regexp_extract_all(ids, F.lit("<([0-9]+)>"), F.lit(1)), lambda i: F.try_element_at(names, i))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(each))), ",")


UNKNOWN = "((?:licensed|released|distributed|available)[ CL]under[ CL][^SCL]{1,200})"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_sentences (identifiers, repeats counted), sentence_ids, licenses, unknown (notices and tags that are not known)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    anchored = None
    for a in ANCHORS:
        anchored = F.contains(low, F.lit(a)) if anchored is None else anchored | F.contains(low, F.lit(a))
    nothing = F.array().cast("array<string>")
    marks = F.when(anchored, marked_text(F.col(text_col)))
    rows = docs.select(F.col(id_col), marks.alias("_m"), F.when(F.contains(low, F.lit("spdx-license-identifier")), tag_ids(text)).alias("_t"))
    pattern = F.lit(sentence_pattern())
    plain = lambda s: F.translate(s, "SCL", "   ")
    hits = F.transform(F.regexp_extract_all("_m", pattern, F.lit(1)), lambda s: identifiers(plain(s)))
    speaks = F.transform(F.regexp_extract_all(F.regexp_replace("_m", pattern, F.lit("")), F.lit(UNKNOWN), F.lit(1)), plain)
    ids = F.concat(F.coalesce(F.array_join(hits, ""), F.lit("")), F.coalesce("_t.ids", F.lit("")))
    found = rows.select(id_col, ids.alias("sentence_ids"), F.concat(F.coalesce(speaks, nothing), F.coalesce("_t.unknown", nothing)).alias("unknown"))
    return found.select(id_col, F.regexp_count("sentence_ids", F.lit("<")).cast("long").alias("n_sentences"), "sentence_ids", F.when(F.col("sentence_ids") == "", "").otherwise(licenses(F.col("sentence_ids"))).alias("licenses"), "unknown")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).select("doc_id", "n_sentences", "sentence_ids", "licenses")


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


def _ruled(ids: str) -> str:
    for k, (_, rule) in enumerate(RULES):
        found = "(.*?)".join(f"<{i}>" for i in rule)
        ids = f"regexp_replace({ids}, '{found}', '{''.join(f'{chr(92)}{j}' for j in range(1, len(rule)))}<{RULED + k}>', 'g')"
    return ids


_BARE = SUBJECT.split("(?=")[0].removeprefix("(?:")
#: Sentences on lines of their own only; on the given tables its rows are those of the query.
SQL = rf"""
WITH known(s, id) AS (VALUES {_values(WHOLE)}), called(c, id) AS (VALUES {_values({a: f"<{NOTED + NAMES.index(n)}>" for a, n in CALLED.items()})}),
tags(tag, id) AS (VALUES {_values({t: f"<{TAGGED + NAMES.index(n)}>" for t, n in TAGS.items()})}), names(id, name) AS (VALUES {_values(NAMED)}),
docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?])[ \t\r\f\x0B]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
sent AS (SELECT rid, pos, trim(regexp_replace(part, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS line FROM (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM docs)),
bare AS (SELECT rid, pos, regexp_replace(line, '^{_BARE}((?:licensed|released|distributed|available|published|provided|dual|free) )', '\1') AS s FROM sent),
hits AS (SELECT rid, pos, 0 AS k, id FROM bare JOIN known USING (s) UNION ALL SELECT rid, pos, 0, '{next(iter(SLOTTED.values()))}' FROM bare WHERE s LIKE 'neither the name of %' AND regexp_full_match(s, '{slot(next(iter(SLOTTED)))}')
  UNION ALL SELECT rid, pos, k, id FROM (SELECT rid, pos, unnest(found) AS c, generate_subscripts(found, 1) AS k FROM (SELECT rid, pos, regexp_extract_all(s, '{ALIAS}') AS found FROM bare WHERE s LIKE '% under %' AND regexp_full_match(s, '{NOTICE}'))) JOIN called USING (c)
  UNION ALL SELECT rid, 1000000000, k, id FROM (SELECT rid, lower(unnest(found)) AS tag, generate_subscripts(found, 1) AS k FROM (SELECT rid, regexp_extract_all(regexp_replace(array_to_string(regexp_extract_all(text, '{EXPRESSION}', 1), ' '), '(?i)[ \t]WITH[ \t]+\(*{TAG_ID}', '', 'g'), '{TAG_ID}') AS found FROM docs WHERE contains(lower(text), 'spdx-license-identifier'))) JOIN tags USING (tag)),
ids AS (SELECT rid, string_agg(id, '' ORDER BY pos, k) AS ids, count(*) AS n FROM hits GROUP BY rid),
named AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT rid, unnest(regexp_extract_all({_ruled('ids')}, '<([0-9]+)>', 1)) AS id FROM ids) JOIN names USING (id) GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(names, '') AS licenses FROM docs LEFT JOIN ids USING (rid) LEFT JOIN named USING (rid)
"""
