"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, sentences are reduced to lower-case words, and each is looked up among known licence sentences, version
numbers aside. The identifiers found, in order, are matched against ordered rules: a rule is a sequence of identifiers, and longer or
more specific rules come first. Everything happens inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences by identifier, "#" for a version number. Words only; case and punctuation do not matter.
SENTENCES = {
    "mit_line": "Released under the MIT License",
    "mit_line2": "Licensed under the MIT License",
    "mit_title": "The MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache_line": "Licensed under the Apache License, Version #",
    "apache_header": "Licensed under the Apache License, Version # (the \"License\"); you may not use this file except in compliance with the License.",
    "apache_limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl_line": "This work is licensed under the GNU General Public License, version #",
    "gpl_line2": "Licensed under the GNU General Public License, version #",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc_by_line": "Licensed under CC BY #",
    "cc_by_sa_line": "Licensed under CC BY-SA #",
    "cc_by_nc_line": "Licensed under CC BY-NC #",
    "cc_by_nc_sa_line": "Licensed under CC BY-NC-SA #",
    "cc_by_nd_line": "Licensed under CC BY-ND #",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_as_is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd_line": "Licensed under the BSD #-Clause License",
    "bsd_title": "BSD #-Clause License",
    "bsd_title2": "The BSD #-Clause License",
    "mit_name": "MIT License",
    "mit_name2": "The MIT License (MIT)",
    "mpl_line": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl_line2": "Licensed under the Mozilla Public License, Version #",
    "mpl_line3": "Licensed under the Mozilla Public License #",
    "apache_line2": "Licensed under the Apache License #",
    "apache_title": "Apache License, Version #",
    "apache_title2": "Apache License #",
    "apache_whole": "Apache License Version #, January # http://www.apache.org/licenses/",
    "lesser_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version.",
    "lesser_free2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version # of the License, or (at your option) any later version.",
    "lesser_warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lesser_line": "This work is licensed under the GNU Lesser General Public License, version #",
    "lesser_line2": "Licensed under the GNU Lesser General Public License, version #",
    "affero_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version # of the License, or (at your option) any later version.",
    "affero_line": "This work is licensed under the GNU Affero General Public License, version #",
    "affero_line2": "Licensed under the GNU Affero General Public License, version #",
    "isc_title": "ISC License",
    "isc_title2": "The ISC License",
    "isc_line": "Licensed under the ISC License",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_grant2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "unlicense_line": "Licensed under the Unlicense",
    "cc0_title": "CC0 # Universal",
    "cc0_line": "Licensed under CC0 #",
    "cc0_line2": "Licensed under CC0 # Universal",
    "epl_2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License # which is available at https://www.eclipse.org/legal/epl-#/",
    "epl_v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v.",
    "epl_1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License # which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-#.html",
    "epl_line": "Licensed under the Eclipse Public License, Version #",
    "epl_line2": "Licensed under the Eclipse Public License #",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib_title": "zlib License",
    "zlib_title2": "The zlib License",
    "zlib_line": "Licensed under the zlib License",
    "boost_title": "Boost Software License - Version # - August 17th, #",
    "boost_line": "Distributed under the Boost Software License, Version #",
    "boost_line2": "Licensed under the Boost Software License, Version #",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc_by_nc_nd_line": "Licensed under CC BY-NC-ND #",
}
# Ordered rules, each a sequence of sentence identifiers with the licence it stands for; "#" is the version of the first
# sentence that has one. The first rule that matches at a place wins.
RULES = (
    ("mit_title mit_grant mit_notice mit_as_is", "MIT"),
    ("mit_grant mit_notice mit_as_is", "MIT"),
    ("bsd_grant bsd_source bsd_binary bsd_names", "BSD-3-Clause"),
    ("bsd_grant bsd_source bsd_binary", "BSD-2-Clause"),
    ("apache_header apache_limits", "Apache-#"),
    ("apache_line", "Apache-#"),
    ("apache_header", "Apache-#"),
    ("gpl_free gpl_warranty", "GPL-#-or-later"),
    ("gpl_free", "GPL-#-or-later"),
    ("gpl_line", "GPL-#"),
    ("gpl_line2", "GPL-#"),
    ("cc_by_nc_sa_line", "CC-BY-NC-SA-#"),
    ("cc_by_nc_line", "CC-BY-NC-#"),
    ("cc_by_sa_line", "CC-BY-SA-#"),
    ("cc_by_nd_line", "CC-BY-ND-#"),
    ("cc_by_line", "CC-BY-#"),
    ("mpl_line", "MPL-2.0"),
    ("mit_line", "MIT"),
    ("mit_line2", "MIT"),
    ("mit_title", "MIT"),
    ("mit_name", "MIT"),
    ("mit_name2", "MIT"),
    ("bsd_line", "BSD-#-Clause"),
    ("bsd_title", "BSD-#-Clause"),
    ("bsd_title2", "BSD-#-Clause"),
    ("mpl_line2", "MPL-#"),
    ("mpl_line3", "MPL-#"),
    ("apache_line2", "Apache-#"),
    ("apache_title", "Apache-#"),
    ("apache_title2", "Apache-#"),
    ("apache_whole", "Apache-#"),
    ("lesser_free gpl_warranty", "LGPL-#-or-later"),
    ("lesser_free", "LGPL-#-or-later"),
    ("lesser_free2 lesser_warranty", "LGPL-#-or-later"),
    ("lesser_free2", "LGPL-#-or-later"),
    ("lesser_line", "LGPL-#"),
    ("lesser_line2", "LGPL-#"),
    ("affero_free gpl_warranty", "AGPL-#-or-later"),
    ("affero_free", "AGPL-#-or-later"),
    ("affero_line", "AGPL-#"),
    ("affero_line2", "AGPL-#"),
    ("isc_title isc_grant", "ISC"),
    ("isc_title isc_grant2", "ISC"),
    ("isc_grant", "ISC"),
    ("isc_grant2", "ISC"),
    ("isc_title", "ISC"),
    ("isc_title2", "ISC"),
    ("isc_line", "ISC"),
    ("zero_grant", "0BSD"),
    ("unlicense_free", "Unlicense"),
    ("unlicense_line", "Unlicense"),
    ("cc0_title", "CC0-#"),
    ("cc0_line", "CC0-#"),
    ("cc0_line2", "CC0-#"),
    ("epl_2", "EPL-#"),
    ("epl_v", "EPL-2.0"),
    ("epl_1", "EPL-#"),
    ("epl_line", "EPL-#"),
    ("epl_line2", "EPL-#"),
    ("zlib_title zlib_as_is zlib_grant", "Zlib"),
    ("zlib_as_is zlib_grant", "Zlib"),
    ("zlib_grant", "Zlib"),
    ("zlib_title", "Zlib"),
    ("zlib_title2", "Zlib"),
    ("zlib_line", "Zlib"),
    ("boost_title boost_grant", "BSL-#"),
    ("boost_title", "BSL-#"),
    ("boost_line", "BSL-#"),
    ("boost_line2", "BSL-#"),
    ("boost_grant", "BSL-1.0"),
    ("cc_by_nc_nd_line", "CC-BY-NC-ND-#"),
)
# Titles before a whole text, which is one licence together with it.
RULES = (
    ("mit_name mit_grant mit_notice mit_as_is", "MIT"),
    ("mit_name2 mit_grant mit_notice mit_as_is", "MIT"),
    *[(f"{title} bsd_grant bsd_source bsd_binary{names}", f"BSD-{n}-Clause") for names, n in ((" bsd_names", 3), ("", 2)) for title in ("bsd_title", "bsd_title2")],
    ("isc_title2 isc_grant", "ISC"),
    ("isc_title2 isc_grant2", "ISC"),
    ("zlib_title2 zlib_as_is zlib_grant", "Zlib"),
    *RULES,
)
# The notices of Creative Commons, and SPDX identifiers, each as a sentence with its rule.
CREATIVE = {
    "": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike", "-ND": "-NoDerivatives",
    "-NC-ND": "-NonCommercial-NoDerivatives",
}
SPDX = (
    "MIT", "MIT-#", "Apache-#", "BSD-#-Clause", "0BSD", "ISC", "Zlib", "BSL-#", "EPL-#", "MPL-#", "Unlicense", "CC0-#", *[f"CC-BY{k}-#" for k in CREATIVE],
    *[f"{kind}GPL-#{tail}" for kind in ("", "L", "A") for tail in ("", "-only", "-or-later")], "Artistic-#", "PSF-#", "OFL-#", "EUPL-#", "CDDL-#", "WTFPL",
    "PostgreSQL", "NCSA", "MS-PL",
)
for _code, _words in CREATIVE.items():
    for _article in ("a", "the"):
        _key = f"creative_{_article}{_code.lower().replace('-', '_')}"
        SENTENCES[_key] = f"This work is licensed under {_article} Creative Commons Attribution{_words} # International License."
        RULES += ((_key, f"CC-BY{_code}-#"),)
for _n, _spdx in enumerate(SPDX):
    SENTENCES[f"spdx_{_n}_id"] = f"SPDX-License-Identifier: {_spdx}"
    RULES += ((f"spdx_{_n}_id", _spdx),)
# Every licence sentence has one of these words; texts without any are not cut into sentences.
ANCHORS = ("licen", "permission", "copyright", "warrant", "redistribut", "software", "cc0")

#: where a sentence ends: closing punctuation with white space after it, and a line break unless lines are wrapped
BREAK = r"([.!?])[\x20\x09-\x0D]+"
#: where a sentence of wrapped lines ends besides: a blank line, and a colon at the end of a line
WRAP_BREAK = r"(:|\n)[\x20\x09\x0D]*\n"
#: stands between the sentences of wrapped lines
END = "\x01"
#: a version; a number in a word is none
VERSION = r"(^| )v?([0-9]+( [0-9]+)*)( |$)"

#: the plus of an SPDX identifier, as in GPL-2.0+
LATER = r"(license-identifier:.*gpl-[0-9.]+)\+"


def plain_words(sentence: str) -> str:
    """The normal form of a fixed sentence."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c == "#") else " " for c in sentence.lower())
    return " ".join(kept.split())


def _check_tables() -> None:
    for key, sentence in SENTENCES.items():
        if not any(a in sentence.lower() for a in ANCHORS):
            raise ValueError(f"{key} has no anchor")
    for rule, _ in RULES:
        if not set(rule.split()) <= set(SENTENCES):
            raise ValueError(f"{rule} names an unknown sentence")
    if len({plain_words(s) for s in SENTENCES.values()}) < len(SENTENCES):
        raise ValueError("a sentence stands in the table twice")
    if any(a != b and a.endswith(b) for a in SENTENCES for b in SENTENCES):
        raise ValueError("an identifier ends with another one")  # rule_pattern() would find it inside


_check_tables()


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def anchored(text: Column) -> Column:
    return text.rlike("|".join(ANCHORS))


def passages(text: Column) -> Column:
    """Sentences of a lower-case text with its lines joined; those without an anchor are left out, line breaks inside stay."""
    cut = F.regexp_replace(F.regexp_replace(F.translate(text, END, ","), WRAP_BREAK, END), BREAK, f"$1{END}")
    return F.filter(F.split(cut, END), anchored)


def identifiers(text: Column) -> Column:
    """Known sentences of a text in order, as ``identifier@version``; the version is empty where there is none.

    A text may mix wrapped sentences and sentences that end with their line. Every break of the wrapped reading is one of the other reading
    too, so a sentence of the former is a run of whole lines: it counts if it is known, and else those of its lines do that are.
    """
    known = F.create_map(*[F.lit(x) for key, value in SENTENCES.items() for x in (plain_words(value), key)])

    def name(sentence: Column) -> Column:
        later = F.regexp_replace(sentence, LATER, "$1 or later")
        words = F.trim(F.regexp_replace(later, "[^0-9a-z]+", " "))
        key = F.regexp_replace(words, VERSION, "$1#$4")
        version = F.translate(F.regexp_extract(words, VERSION, 2), " ", ".")
        return F.concat(F.try_element_at(known, key), F.lit("@"), version)

    def by_line(passage: Column) -> Column:
        return F.filter(F.transform(F.filter(F.split(passage, "\n"), anchored), name), lambda s: s.isNotNull())

    text = lower(text)
    read = F.transform(passages(text), lambda s: F.struct(s.alias("passage"), name(s).alias("id")))
    found = F.flatten(F.transform(read, lambda s: F.when(s["id"].isNotNull(), F.array(s["id"])).otherwise(by_line(s["passage"]))))
    return F.when(anchored(text), found).otherwise(F.array().cast("array<string>"))


def rule_pattern() -> str:
    """One pattern that tries the rules in order at each place of the joined identifiers."""
    return "(" + "|".join(" ".join(f"{i}@[0-9.]*" for i in rule.split()) for rule, _ in RULES) + ")(?= |$)"


def licences(ids: Column) -> Column:
    """Licences of an identifier sequence in order: the leftmost matches of the rules that do not overlap."""
    matched = F.regexp_extract_all(F.array_join(ids, " "), F.lit(rule_pattern()), 1)
    by_rule = F.create_map(*[F.lit(x) for rule, name in RULES for x in (rule, name)])

    def name(found: Column) -> Column:
        rule = F.regexp_replace(found, "@[0-9.]*", "")
        version = F.regexp_extract(found, "@([0-9.]+)", 1)
        return F.replace(F.try_element_at(by_rule, rule), F.lit("#"), version)

    return F.transform(matched, name)


def scan(docs: DataFrame) -> DataFrame:
    """Licences of every whole text: ``doc_id``, ``n_sentences`` known ones, ``sentence_ids``, ``licenses`` in order, ``license``.

    ``license`` is the licence if the text has exactly one, ``several`` for different ones and null for none. Null and empty texts have no
    sentences; null ids and repeated rows are scanned like any other; other columns are not looked at; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", identifiers(F.col("text")).alias("ids"))
    named = found.select("doc_id", "ids", F.when(F.size("ids") > 0, licences(F.col("ids"))).otherwise(F.array().cast("array<string>")).alias("names"))
    different = F.size(F.array_distinct("names"))
    return named.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join("names", ",").alias("licenses"),
        F.when(different == 1, F.try_element_at("names", F.lit(1))).when(different > 1, F.lit("several")).alias("license"),
    )


def scan_sql() -> str:
    """The same in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(plain_words(v))}: {quote(k)}" for k, v in SENTENCES.items()) + "}"
    rules = "MAP {" + ", ".join(f"{quote(r)}: {quote(n)}" for r, n in RULES) + "}"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    anchors = "|".join(ANCHORS)
    pattern = "(" + "|".join(" ".join(f"{i}@[0-9.]*" for i in rule.split()) for rule, _ in RULES) + ")( |$)"
    key = f"regexp_replace(w, '{VERSION}', '\\1#\\4', 'g')"
    version = f"replace(regexp_extract(w, '{VERSION}', 2), ' ', '.')"
    words = "trim(regexp_replace(regexp_replace({}, '" + LATER + "', '\\1 or later', 'g'), '[^0-9a-z]+', ' ', 'g'))"
    named = lambda sentences: f"""list_transform(list_transform({sentences}, lambda s: {words.format("s")}), lambda w: {known}[{key}] || '@' || {version})"""
    by_line = f"list_filter({named(f"""list_filter(string_split(p, chr(10)), lambda l: regexp_matches(l, '{anchors}'))""")}, lambda i: i IS NOT NULL)"
    return f"""
    WITH low AS (
      SELECT doc_id, replace({lower("coalesce(text, '')")}, chr(1), ',') AS t FROM documents
    ), cut AS (
      SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(t, '{WRAP_BREAK}', chr(1), 'g'), '{BREAK}', '\\1' || chr(1), 'g'), chr(1)),
        lambda p: regexp_matches(p, '{anchors}')) AS passages FROM low
    ), chosen AS (
      SELECT doc_id, flatten(list_transform(passages, lambda p: CASE WHEN ({named("[p]")})[1] IS NOT NULL THEN {named("[p]")} ELSE {by_line} END)) AS ids FROM cut
    ), matched AS (
      SELECT doc_id, ids, list_transform(regexp_extract_all(array_to_string(ids, ' '), '{pattern}', 1), lambda m:
        replace({rules}[regexp_replace(m, '@[0-9.]*', '', 'g')], '#', regexp_extract(m, '@([0-9.]+)', 1))) AS names FROM chosen
    )
    SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses,
      CASE WHEN len(list_distinct(names)) = 1 THEN names[1] WHEN len(list_distinct(names)) > 1 THEN 'several' END AS license
    FROM matched"""
