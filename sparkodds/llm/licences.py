"""Licences of documents, by sentence recognition and ordered rules.

A document's sentences are normalised (case, punctuation, names of the work and
of holders), looked up in a table of known licence sentences and replaced by
their identifiers; others that speak of licences become <Unknown>. Rules then match sequences of
identifiers, in order: a rule takes its sentences away from later ones, so that a
full text wins over a mention and "any later version" over the version alone.

All of it is one projection of DataFrame functions: nothing is shuffled, and the
tables are constants of the plan.

Defined results: null and empty texts have no licences; a licence sentence that
isn't known, or that no rule uses, is counted as ``unmatched``; a licence found
several times is listed once, in alphabetical order. Only doc_id and text are
read, and the columns asked for are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkodds.llm.common import read

#: Sentences that hold one of these speak of a licence, known or not.
SPEAKS = (
    r"(?i)licen[cs]e|copyright|spdx|permission|redistribut|warrant|public domain|general public|creative commons"
    r"|endorse|free software|gnu.org"
)

#: Written otherwise before cutting, since a colon ends a sentence.
TAG = (r"SPDX-License-Identifier:[ \t]*", "SPDX-License-Identifier ")

#: Where a text is cut: after the end of a sentence, at empty lines, and before a
#: line that opens a licence. (pattern, what stands before and after the cut)
CUTS = [
    (r"([.;:!?])[ \t\r\n]+", r"\1", ""),
    (r"\n[ \t\r]*\n", "", ""),
    (r"\n[ \t/*#-]*(Licensed|Released|Distributed|Permission|Copyright|SPDX|This work|This program|This software)", "", r"\1"),
]
CUT = "¶"

#: Normalisation, in order, of a lower-cased sentence.
NORMAL = [
    (r"licence", "license"),
    (r"[^a-z0-9.+/-]+", " "),
    (r"^[ ./*#-]*(c )?", ""),
    (r"[ ./-]+$", ""),
    (r"\b(this|the) (program|software|library|package|work|file|document|code|project|text|source code)\b", "this work"),
    (r"^(all )?copyright .*$", "copyright"),
    (r"^neither the names? of .* nor the names of", "neither the name of holder nor the names of"),
    (r"^(this work |it )?(is )?(hereby )?(licensed|released|distributed|available|published|provided) under (the )?(terms of )?(the )?", "under "),
    (r"^spdx-license-identifier ", "spdx "),
    (r"\b(v|ver|version) ?([0-9])", "version $2"),
    (r"\b(gnu )?(l|a)?gpl\b", "$2gpl"),
    (r"\bgnu lesser general public license\b", "lgpl"),
    (r"\bgnu affero general public license\b", "agpl"),
    (r"\bgnu general public license\b", "gpl"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r" +", " "),
]

# Known licence sentences, normalised, by identifier.
SENTENCES = {
    "Copyright": ["copyright"],
    "AllRights": ["all rights reserved"],
    "ApacheRef": [
        "under apache license version 2.0",
        "under apache license 2.0",
        "under apache 2.0 license",
        "under apache-2.0",
        "spdx apache-2.0",
    ],
    "ApacheGrant": ["under apache license version 2.0 the license"],
    "ApacheUse": ["you may not use this work except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at"],
    "ApacheAt": ["http //www.apache.org/licenses/license-2.0", "https //www.apache.org/licenses/license-2.0"],
    "ApacheAsIs": [
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "ApacheSee": [
        "see the license for the specific language governing permissions and limitations under the license"
    ],
    "MITRef": ["under mit license", "mit license", "under mit", "the mit license", "the mit license mit", "spdx mit"],
    "MITGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this work and associated"
        " documentation files this work to deal in this work without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and/or sell copies of this work and to permit"
        " persons to whom this work is furnished to do so subject to the following conditions"
    ],
    "MITNotice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of this work"
    ],
    "MITAsIs": [
        "this work is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "MITLiable": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with this work or"
        " the use or other dealings in this work"
    ],
    "ISCGrant": [
        "permission to use copy modify and/or distribute this work for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "ISCRef": ["under isc license", "spdx isc"],
    "BSD2Ref": ["under bsd 2-clause license", "under 2-clause bsd license", "spdx bsd-2-clause"],
    "BSD3Ref": ["under bsd 3-clause license", "under 3-clause bsd license", "under new bsd license", "spdx bsd-3-clause"],
    "BSDRef": ["under bsd license", "under bsd-style license"],
    "BSDGrant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met"
    ],
    "BSDSource": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer"
    ],
    "BSDBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "BSDEndorse": [
        "neither the name of holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this work without specific prior written permission"
    ],
    "BSDAsIs": [
        "this work is provided by the copyright holders and contributors as is and any express or implied warranties"
        " including but not limited to the implied warranties of merchantability and fitness for a particular purpose"
        " are disclaimed"
    ],
    "GPL2Ref": ["under gpl version 2", "under gpl version 2.0", "spdx gpl-2.0", "spdx gpl-2.0-only"],
    "GPL2PlusRef": ["under gpl version 2 or later", "under gpl version 2 or any later version", "spdx gpl-2.0-or-later"],
    "GPL3Ref": ["under gpl version 3", "under gpl version 3.0", "spdx gpl-3.0", "spdx gpl-3.0-only"],
    "GPL3PlusRef": ["under gpl version 3 or later", "under gpl version 3 or any later version", "spdx gpl-3.0-or-later"],
    "LGPL21Ref": ["under lgpl version 2.1", "spdx lgpl-2.1", "spdx lgpl-2.1-only"],
    "LGPL3Ref": ["under lgpl version 3", "under lgpl version 3.0", "spdx lgpl-3.0", "spdx lgpl-3.0-only"],
    "AGPL3Ref": ["under agpl version 3", "under agpl version 3.0", "spdx agpl-3.0", "spdx agpl-3.0-only"],
    "FreeSoftware": ["this work is free software"],
    "GPL2PlusTerms": [
        "you can redistribute it and/or modify it under the terms of the gpl as published by the free software"
        " foundation either version 2 of the license or at your option any later version"
    ],
    "GPL3PlusTerms": [
        "you can redistribute it and/or modify it under the terms of the gpl as published by the free software"
        " foundation either version 3 of the license or at your option any later version"
    ],
    "GPLNoWarranty": [
        "this work is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "GPLSee": ["see the gpl for more details"],
    "GPLReceived": ["you should have received a copy of the gpl along with this work"],
    "GPLAt": ["if not see http //www.gnu.org/licenses", "if not see https //www.gnu.org/licenses"],
    "MPLRef": ["under mozilla public license version 2.0", "under mozilla public license 2.0", "spdx mpl-2.0"],
    "MPLSubject": ["this source code form is subject to the terms of the mozilla public license version 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "spdx unlicense"],
    "PublicDomain": ["this work is in the public domain", "released into the public domain"],
    "CC0Ref": ["under cc0 1.0", "under cc0 1.0 universal", "spdx cc0-1.0"],
    "CCBYRef": ["under cc by 4.0", "under cc by 4.0 international license", "spdx cc-by-4.0"],
    "CCBYSARef": ["under cc by-sa 4.0", "under cc by-sharealike 4.0 international license", "spdx cc-by-sa-4.0"],
    "CCBYNCRef": ["under cc by-nc 4.0", "under cc by-noncommercial 4.0 international license", "spdx cc-by-nc-4.0"],
    "CCBYNDRef": ["under cc by-nd 4.0", "spdx cc-by-nd-4.0"],
    "CCBYNCSARef": ["under cc by-nc-sa 4.0", "spdx cc-by-nc-sa-4.0"],
}

# Ordered rules. (licence, identifiers in order; ? may be missing)
RULES = [
    ("Apache-2.0", "ApacheGrant ApacheUse ApacheCopy? ApacheAt? ApacheAsIs? ApacheSee?"),
    ("MIT", "MITRef? Copyright? AllRights? MITGrant MITNotice MITAsIs? MITLiable?"),
    ("ISC", "ISCRef? Copyright? ISCGrant"),
    ("BSD-3-Clause", "BSD3Ref? Copyright? AllRights? BSDGrant BSDSource BSDBinary BSDEndorse BSDAsIs?"),
    ("BSD-2-Clause", "BSD2Ref? Copyright? AllRights? BSDGrant BSDSource BSDBinary BSDAsIs?"),
    ("GPL-3.0-or-later", "FreeSoftware GPL3PlusTerms GPLNoWarranty? GPLNoWarranty? GPLSee? GPLReceived? GPLAt?"),
    ("GPL-2.0-or-later", "FreeSoftware GPL2PlusTerms GPLNoWarranty? GPLNoWarranty? GPLSee? GPLReceived? GPLAt?"),
    ("Apache-2.0", "ApacheGrant"),
    ("Apache-2.0", "ApacheRef"),
    ("MIT", "MITRef"),
    ("ISC", "ISCRef"),
    ("BSD-2-Clause", "BSD2Ref"),
    ("BSD-3-Clause", "BSD3Ref"),
    ("BSD", "BSDRef"),
    ("GPL-3.0-or-later", "GPL3PlusRef"),
    ("GPL-3.0-only", "GPL3Ref"),
    ("GPL-2.0-or-later", "GPL2PlusRef"),
    ("GPL-2.0-only", "GPL2Ref"),
    ("LGPL-2.1-only", "LGPL21Ref"),
    ("LGPL-3.0-only", "LGPL3Ref"),
    ("AGPL-3.0-only", "AGPL3Ref"),
    ("MPL-2.0", "MPLRef"),
    ("MPL-2.0", "MPLSubject"),
    ("Unlicense", "Unlicense"),
    ("Public-Domain", "PublicDomain"),
    ("CC0-1.0", "CC0Ref"),
    ("CC-BY-4.0", "CCBYRef"),
    ("CC-BY-SA-4.0", "CCBYSARef"),
    ("CC-BY-NC-4.0", "CCBYNCRef"),
    ("CC-BY-ND-4.0", "CCBYNDRef"),
    ("CC-BY-NC-SA-4.0", "CCBYNCSARef"),
    ("", "Copyright"),
    ("", "AllRights"),
]


def java(replacement: str) -> str:
    return replacement.replace("\\1", "$1")


def rule_pattern(names: str) -> str:
    return "".join(f"(?:<{n[:-1]}>)?" if n.endswith("?") else f"<{n}>" for n in names.split())


def sentences(text: Column) -> Column:
    text = F.regexp_replace(text, *TAG)
    for pattern, before, after in CUTS:
        text = F.regexp_replace(text, pattern, java(before) + CUT + java(after))
    return F.split(text, CUT)


def normal(sentence: Column) -> Column:
    s = F.lower(sentence)
    for pattern, replacement in NORMAL:
        s = F.regexp_replace(s, pattern, replacement)
    return F.trim(s)


def identifiers(text: Column) -> Column:
    """The identifiers of a text's licence sentences in order, as <A><B>; <Unknown>
    for those that aren't known but speak of licences."""
    known = F.create_map(*(F.lit(x) for name, all_of in SENTENCES.items() for s in all_of for x in (s, f"<{name}>")))
    unknown = lambda s: F.when(s.rlike(SPEAKS), "<Unknown>").otherwise("")
    return F.array_join(F.transform(sentences(text), lambda s: F.coalesce(F.element_at(known, normal(s)), unknown(s))), "")


def apply_rules(ids: Column) -> Column:
    """Sequences that rules match, replaced by =licence=."""
    for licence, names in RULES:
        ids = F.regexp_replace(ids, rule_pattern(names), f"={licence}=" if licence else "")
    return ids


def scan(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """``keep`` columns, sentence_ids, licences (joined by a comma) and unmatched."""
    found = F.sort_array(F.array_distinct(F.regexp_extract_all("__ruled", F.lit("=([^=]+)="), F.lit(1))))
    ided = docs.select(F.struct(*keep).alias("__kept"), F.coalesce(identifiers(F.col("text")), F.lit("")).alias("__ids"))
    return ided.withColumn("__ruled", apply_rules(F.col("__ids"))).select(
        "__kept.*",
        F.col("__ids").alias("sentence_ids"),
        F.array_join(found, ",").alias("licences"),
        F.regexp_count("__ruled", F.lit("<")).cast("long").alias("unmatched"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), ["doc_id"])


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    """The same tables as DuckDB SQL."""
    cut = f"regexp_replace(text, {_quoted(TAG[0])}, {_quoted(TAG[1])}, 'g')"
    for pattern, before, after in CUTS:
        cut = f"regexp_replace({cut}, {_quoted(pattern)}, {_quoted(before + CUT + after)}, 'g')"
    normal_sql = "lower(s)"
    for pattern, replacement in NORMAL:
        normal_sql = f"regexp_replace({normal_sql}, {_quoted(pattern)}, {_quoted(replacement.replace('$', chr(92)))}, 'g')"
    ruled = "ids"
    for licence, names in RULES:
        ruled = f"regexp_replace({ruled}, {_quoted(rule_pattern(names))}, {_quoted(f'={licence}=' if licence else '')}, 'g')"
    values = ", ".join(f"({_quoted(s)}, {_quoted(f'<{name}>')})" for name, all_of in SENTENCES.items() for s in all_of)
    return f"""
WITH known(s, id) AS (VALUES {values}),
cut AS (
  SELECT doc_id, generate_subscripts(p, 1) AS nth, unnest(p) AS s
  FROM (SELECT doc_id, string_split({cut}, {_quoted(CUT)}) AS p FROM documents)),
named AS (
  SELECT doc_id, string_agg(CASE WHEN id IS NOT NULL THEN id WHEN speaks THEN '<Unknown>' ELSE '' END, '' ORDER BY nth) AS ids
  FROM (SELECT doc_id, nth, trim({normal_sql}) AS s, regexp_matches(s, {_quoted(SPEAKS)}) AS speaks FROM cut)
    LEFT JOIN known USING (s)
  GROUP BY doc_id),
ruled AS (SELECT doc_id, ids, {ruled} AS r FROM named)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(r, '=([^=]+)=', 1))), ','), '') AS licences,
       coalesce(len(regexp_extract_all(r, '<')), 0)::BIGINT AS unmatched
FROM documents d LEFT JOIN ruled USING (doc_id)
"""


OP3_SQL = _sql()
