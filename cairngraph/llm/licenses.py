"""License scans by sentence rules.

Texts are read in two ways at once: with single line ends as spaces (wrapped
licence texts) and, where such a sentence is not known, with every line end as a
sentence end (licence lines in code or prose).  A normalised sentence that is known stands for an identifier; the
identifiers of a document, in order, are matched against ordered rules.  A rule
holds where its identifiers occur one after another, with no other known sentence
between; a longer rule hides the shorter ones it contains.

DataFrame functions only.  One pass over the texts, no shuffle, no broadcast but
the constant tables below.  Defined cases: null and empty texts have no sentence
and no licence; texts are scanned whole; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: identifier -> normalised sentence (A-Z lowered, every run of other characters than a-z and 0-9 one space), as the
#: splitter below cuts it: after every . ! ? ; : before white space, "v. 2.0" and "WARRANTY; without" too.
SENTENCES = {
    "mit_short": "released under the mit license",
    "mit_short_2": "licensed under the mit license",
    "mit_title": "the mit license mit",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is_mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache_short": "licensed under the apache license version 2 0",
    "apache_license": "licensed under the apache license version 2 0 the license",
    "apache_asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_at": "you may obtain a copy of the license at",
    "apache_url": "http www apache org licenses license 2 0",
    "apache_urls": "https www apache org licenses license 2 0",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_copys": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    # in comments the lines around the address are not blank, and it ends in no mark
    "apache_rest": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_rests": "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_details": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_short": "this work is licensed under the gnu general public license version 3",
    "gpl_program": "this program is free software",
    "gpl_free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_redist": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3_later": "either version 3 of the license or at your option any later version",
    "gpl2_later": "either version 2 of the license or at your option any later version",
    "gpl3_version": "version 3 of the license",
    "gpl2_version": "version 2 of the license",
    "gpl3_only": "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl2_only": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the gnu general public license for more details",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl_terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl_terms_2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl_copys": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "bsd_redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
}

#: (rule, licence, category, sentence identifiers in order); longer rules first.
RULES = [
    ("mit-full", "MIT", "permissive", ["mit_grant", "mit_notice", "as_is_mit"]),
    ("apache-header", "Apache-2.0", "permissive", ["apache_license", "apache_use", "apache_at", "apache_url", "apache_as_is", "apache_details"]),
    ("apache-header-https", "Apache-2.0", "permissive", ["apache_license", "apache_use", "apache_at", "apache_urls", "apache_as_is", "apache_details"]),
    ("apache-comment", "Apache-2.0", "permissive", ["apache_license", "apache_use", "apache_rest", "apache_details"]),
    ("apache-comment-https", "Apache-2.0", "permissive", ["apache_license", "apache_use", "apache_rests", "apache_details"]),
    ("apache-line", "Apache-2.0", "permissive", ["apache_license", "apache_use", "apache_copy", "apache_as_is", "apache_details"]),
    ("apache-line-https", "Apache-2.0", "permissive", ["apache_license", "apache_use", "apache_copys", "apache_as_is", "apache_details"]),
    ("gpl3-header", "GPL-3.0-or-later", "copyleft", ["gpl_program", "gpl_free", "gpl_hope", "gpl_warranty", "gpl_details", "gpl_copy"]),
    ("gpl3-header-semicolon", "GPL-3.0-or-later", "copyleft", ["gpl_program", "gpl_redist", "gpl3_later", "gpl_hope", "gpl_warranty", "gpl_details", "gpl_copy"]),
    ("gpl2-header", "GPL-2.0-or-later", "copyleft", ["gpl_program", "gpl2_free", "gpl_hope", "gpl_warranty", "gpl_details", "gpl_copy"]),
    ("gpl2-header-semicolon", "GPL-2.0-or-later", "copyleft", ["gpl_program", "gpl_redist", "gpl2_later", "gpl_hope", "gpl_warranty", "gpl_details", "gpl_copy"]),
    ("bsd-3", "BSD-3-Clause", "permissive", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("bsd-2", "BSD-2-Clause", "permissive", ["bsd_redist", "bsd_source", "bsd_binary"]),
    ("apache-short", "Apache-2.0", "permissive", ["apache_short"]),
    ("mit-terms", "MIT", "permissive", ["mit_notice", "as_is_mit"]),
    ("apache-license", "Apache-2.0", "permissive", ["apache_license"]),
    ("apache-asf", "Apache-2.0", "permissive", ["apache_asf"]),
    ("mit-short", "MIT", "permissive", ["mit_short"]),
    ("mit-short-2", "MIT", "permissive", ["mit_short_2"]),
    ("mit-grant", "MIT", "permissive", ["mit_grant"]),
    ("gpl3-short", "GPL-3.0-only", "copyleft", ["gpl3_short"]),
    ("gpl3-free", "GPL-3.0-or-later", "copyleft", ["gpl_free"]),
    ("gpl2-free", "GPL-2.0-or-later", "copyleft", ["gpl2_free"]),
    ("gpl3-semicolon", "GPL-3.0-or-later", "copyleft", ["gpl_redist", "gpl3_later"]),
    ("gpl2-semicolon", "GPL-2.0-or-later", "copyleft", ["gpl_redist", "gpl2_later"]),
    ("gpl3-version", "GPL-3.0-only", "copyleft", ["gpl_redist", "gpl3_version"]),
    ("gpl2-version", "GPL-2.0-only", "copyleft", ["gpl_redist", "gpl2_version"]),
    ("gpl3-only", "GPL-3.0-only", "copyleft", ["gpl3_only"]),
    ("gpl2-only", "GPL-2.0-only", "copyleft", ["gpl2_only"]),
    ("mpl-header", "MPL-2.0", "weak-copyleft", ["mpl_terms", "mpl_copy"]),
    ("mpl-header-https", "MPL-2.0", "weak-copyleft", ["mpl_terms", "mpl_copys"]),
    ("mpl", "MPL-2.0", "weak-copyleft", ["mpl_terms"]),
    ("mpl-2", "MPL-2.0", "weak-copyleft", ["mpl_terms_2"]),
    ("mpl-copy", "MPL-2.0", "weak-copyleft", ["mpl_copy"]),
    ("mpl-copy-https", "MPL-2.0", "weak-copyleft", ["mpl_copys"]),
    ("isc", "ISC", "permissive", ["isc_grant"]),
    ("isc-2", "ISC", "permissive", ["isc_grant_2"]),
    ("unlicense", "Unlicense", "public-domain", ["unlicense"]),
    ("cc-by-nc", "CC-BY-NC-4.0", "non-commercial", ["cc_by_nc"]),
    ("cc-by", "CC-BY-4.0", "permissive", ["cc_by"]),
    ("cc-by-sa", "CC-BY-SA-4.0", "copyleft", ["cc_by_sa"]),
    ("cc0", "CC0-1.0", "public-domain", ["cc0"]),
]
#: SPDX identifier, in lower case -> (licence, category).  These are read from their own lines, not as sentences.
SPDX = {
    "mit": ("MIT", "permissive"),
    "apache-2.0": ("Apache-2.0", "permissive"),
    "gpl-3.0-or-later": ("GPL-3.0-or-later", "copyleft"),
    "gpl-3.0+": ("GPL-3.0-or-later", "copyleft"),
    "gpl-3.0-only": ("GPL-3.0-only", "copyleft"),
    "gpl-3.0": ("GPL-3.0-only", "copyleft"),
    "gpl-2.0-or-later": ("GPL-2.0-or-later", "copyleft"),
    "gpl-2.0+": ("GPL-2.0-or-later", "copyleft"),
    "gpl-2.0-only": ("GPL-2.0-only", "copyleft"),
    "gpl-2.0": ("GPL-2.0-only", "copyleft"),
    "mpl-2.0": ("MPL-2.0", "weak-copyleft"),
    "bsd-3-clause": ("BSD-3-Clause", "permissive"),
    "bsd-2-clause": ("BSD-2-Clause", "permissive"),
    "isc": ("ISC", "permissive"),
    "unlicense": ("Unlicense", "public-domain"),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", "non-commercial"),
    "cc-by-4.0": ("CC-BY-4.0", "permissive"),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", "copyleft"),
    "cc0-1.0": ("CC0-1.0", "public-domain"),
}
SPDX_MARK = "SPDX-License-Identifier:"
SPDX_LINE = SPDX_MARK + r"[ \t(]*([A-Za-z0-9.+-]+(?:[ \t()]+(?:OR|AND|WITH)[ \t()]+[A-Za-z0-9.+-]+)*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _known() -> Column:
    return F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text in both readings, in order.

    A wrapped unit ends only where a line unit ends too; one that is not known gives the known among its lines.
    """
    plain = F.translate(text, UPPER, LOWER)
    # Ends of wrapped units become \x01, the other line ends \x02, every other run a space.
    plain = F.regexp_replace(plain, r"\n[ \t\r]*\n", "\x01")
    marked = F.translate(F.regexp_replace(plain, r"[.!?;:][ \t\r\n]+", "\x01"), "\n", "\x02")
    units = F.split(F.regexp_replace(marked, r"[^a-z0-9\x01\x02]+", " "), "\x01")
    known = lambda s: F.try_element_at(_known(), F.trim(s))
    by_line = lambda u: F.transform(F.split(u, "\x02"), known)
    wrapped = lambda u: F.array(known(F.regexp_replace(u, r"[ \x02]+", " ")))
    both = lambda u: F.flatten(F.transform(wrapped(u), lambda w: F.when(w.isNull(), by_line(u)).otherwise(F.array(w))))
    found = F.transform(units, lambda u: F.when(F.contains(u, F.lit("\x02")), both(u)).otherwise(F.array(known(u))))
    return F.array_compact(F.flatten(found))


def spdx_rules(text: Column) -> Column:
    """A rule "spdx-..." for each known identifier in the SPDX lines of a text."""
    named = F.split(F.array_join(F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1)), " "), r"[ \t()]+")
    rules = F.array_compact(F.array_distinct(F.transform(named, lambda t: F.try_element_at(F.create_map(*[F.lit(x) for i in SPDX for x in (i, f"spdx-{i}")]), F.btrim(F.lower(t), F.lit("."))))))
    return F.when(F.contains(text, F.lit(SPDX_MARK)), rules).otherwise(F.array().cast("array<string>"))


def _sequence(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "")


def _needle(ids: list[str]) -> str:
    return "".join(f"|{i}|" for i in ids)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, sentence_ids, rules, licenses, categories), lists joined by commas, in one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", sentence_ids(text).alias("ids"), spdx_rules(text).alias("spdx"))
    found = found.withColumn("sequence", _sequence(F.col("ids")))
    hits: list[Column] = []
    rest = F.col("sequence")
    for rule, _, _, ids in RULES:
        needle = _needle(ids)
        hits.append(F.when(F.contains(rest, F.lit(needle)), F.lit(rule)))
        if len(ids) > 1:  # what a longer rule has matched is not matched again
            rest = F.replace(rest, F.lit(needle), F.lit("#"))
    found = found.withColumn("rules", F.concat(F.array_compact(F.array(*hits)), F.col("spdx")))
    named = [(rule, name, kind) for rule, name, kind, _ in RULES] + [(f"spdx-{i}", *of) for i, of in SPDX.items()]
    license_of = F.create_map(*[F.lit(x) for rule, name, _ in named for x in (rule, name)])
    category_of = F.create_map(*[F.lit(x) for rule, _, kind in named for x in (rule, kind)])
    names = lambda table: F.array_join(F.array_sort(F.array_distinct(F.transform("rules", lambda r: F.element_at(table, r)))), ",")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("rules", ",").alias("rules"),
        names(license_of).alias("licenses"),
        names(category_of).alias("categories"),
    )


def oracle() -> str:
    """The same rows in DuckDB SQL, for texts without SPDX lines whose known sentences are all found in one reading."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(n)})" for n, s in SENTENCES.items())
    rules = ", ".join(f"({i}, {q(r)}, {q(n)}, {q(k)}, {q(_needle(ids))}, {len(ids)})" for i, (r, n, k, ids) in enumerate(RULES))
    rest = "seq"
    columns = []
    for rule, _, _, ids in RULES:
        needle = q(_needle(ids))
        columns.append(f"CASE WHEN contains({rest}, {needle}) THEN {q(rule)} END")
        if len(ids) > 1:
            rest = f"replace({rest}, {needle}, '#')"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    unit = lambda marked: f"string_split(regexp_replace({marked}, '[^a-z0-9\\x01]+', ' ', 'g'), chr(1))"
    by_line = unit(f"regexp_replace({low}, '[.!?;:][ \\t\\r\\n]+|\\n', chr(1), 'g')")
    by_wrap = unit(f"regexp_replace(regexp_replace({low}, '\\n[ \\t\\r]*\\n', chr(1), 'g'), '[.!?;:][ \\t\\r\\n]+', chr(1), 'g')")
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rule(i, rule, license, category, needle, n) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
unit AS (
  SELECT r, 0 AS wrapped, unnest({by_line}) AS s, generate_subscripts({by_line}, 1) AS pos FROM docs
  UNION ALL SELECT r, 1, unnest({by_wrap}), generate_subscripts({by_wrap}, 1) FROM docs),
hit AS (SELECT r, wrapped, count(*) AS n, list(id ORDER BY pos) AS ids FROM unit JOIN known ON trim(s, ' ') = sentence GROUP BY r, wrapped),
best AS (SELECT r, arg_max(ids, n * 2 - wrapped) AS ids FROM hit GROUP BY r),
seq AS (SELECT doc_id, coalesce(ids, []) AS ids, array_to_string(list_transform(coalesce(ids, []), lambda x: '|' || x || '|'), '') AS seq FROM docs LEFT JOIN best USING (r)),
ruled AS (SELECT doc_id, ids, list_filter([{', '.join(columns)}], lambda x: x IS NOT NULL) AS rules FROM seq)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(rules, ',') AS rules,
  coalesce((SELECT string_agg(license, ',' ORDER BY license) FROM (SELECT DISTINCT license FROM rule WHERE list_contains(rules, rule.rule))), '') AS licenses,
  coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM (SELECT DISTINCT category FROM rule WHERE list_contains(rules, rule.rule))), '') AS categories
FROM ruled"""
