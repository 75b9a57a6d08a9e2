"""License scans by sentence rules, DataFrame operations only.

Texts are cut into sentences, which are normalised and looked up in a fixed
table of known licence sentences. The identifiers found, in the order of the
text, are matched against ordered licence rules: sequences of identifiers that
must occur in that order, other sentences between them allowed. Cutting is
tried both with line ends as sentence ends and with them as spaces, so wrapped
sentences and unpunctuated headings are both recognised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("notice-mit", "Released under the MIT License"),
    ("notice-mit", "Licensed under the MIT License"),
    ("notice-mit", "This project is licensed under the MIT License"),
    ("notice-mit", "SPDX-License-Identifier: MIT"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("notice-apache-2", "Licensed under the Apache License, Version 2.0"),
    ("notice-apache-2", "This project is licensed under the Apache License, Version 2.0"),
    ("notice-apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-grant", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("notice-gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("notice-gpl-3", "Licensed under the GNU General Public License, version 3"),
    ("notice-gpl-3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("notice-gpl-3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("notice-bsd-3", "Licensed under the BSD 3-Clause License"),
    ("notice-bsd-3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-grant", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("notice-cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("notice-cc-by-4", "Licensed under CC BY 4.0"),
    ("notice-cc-by-sa-4", "Licensed under CC BY-SA 4.0"),
    ("notice-cc0", "Licensed under CC0 1.0"),
    ("notice-cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice-cc-by-nc-4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("all-rights", "All rights reserved"),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("apache-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("apache-copyright", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("apache-limits", "See the License for the specific language governing permissions and limitations under the License"),
    ("gnu-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl3-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("gpl2-preamble", "The licenses for most software are designed to take away your freedom to share and change it"),
    ("agpl-preamble", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl3-preamble", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("gpl2-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("agpl-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl3-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl21-grant", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("notice-gpl-2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("notice-gpl-2", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("notice-agpl-3", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("notice-agpl-3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("notice-lgpl-3", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("notice-lgpl-3", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("notice-lgpl-21", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("notice-lgpl-21", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("bsd-liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("notice-bsd-2", "Licensed under the BSD 2-Clause License"),
    ("notice-bsd-2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("notice-isc", "SPDX-License-Identifier: ISC"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("notice-mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution"),
    ("notice-zlib", "SPDX-License-Identifier: Zlib"),
    ("boost-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("notice-boost", "Distributed under the Boost Software License, Version 1.0"),
    ("notice-boost", "SPDX-License-Identifier: BSL-1.0"),
    ("epl-grant", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("notice-epl-2", "SPDX-License-Identifier: EPL-2.0"),
    ("artistic-preamble", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("notice-artistic-2", "SPDX-License-Identifier: Artistic-2.0"),
    ("unlicense-use", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("notice-unlicense", "SPDX-License-Identifier: Unlicense"),
    ("notice-cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("notice-cc-by-4", "SPDX-License-Identifier: CC-BY-4.0"),
    ("notice-cc-by-sa-4", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("notice-cc-by-sa-4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]

# Licence rules, in order; the first that matches names the document's licence.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-terms", "apache-copyright"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("AGPL-3.0", ["gnu-verbatim", "agpl-preamble"]),
    ("LGPL-3.0", ["gnu-verbatim", "lgpl3-preamble"]),
    ("GPL-3.0", ["gnu-verbatim", "gpl3-preamble"]),
    ("GPL-2.0", ["gnu-verbatim", "gpl2-preamble"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-grant"]),
    ("Zlib", ["zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("BSL-1.0", ["boost-grant"]),
    ("EPL-2.0", ["epl-grant"]),
    ("Artistic-2.0", ["artistic-preamble"]),
    ("Unlicense", ["unlicense"]),
    ("GPL-3.0", ["notice-gpl-3"]),
    ("GPL-2.0", ["notice-gpl-2"]),
    ("AGPL-3.0", ["notice-agpl-3"]),
    ("LGPL-3.0", ["notice-lgpl-3"]),
    ("LGPL-2.1", ["notice-lgpl-21"]),
    ("CC-BY-NC-4.0", ["notice-cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["notice-cc-by-sa-4"]),
    ("Apache-2.0", ["notice-apache-2"]),
    ("Apache-2.0", ["apache-grant"]),
    ("BSD-3-Clause", ["notice-bsd-3"]),
    ("BSD-2-Clause", ["notice-bsd-2"]),
    ("MIT", ["notice-mit"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["notice-isc"]),
    ("MPL-2.0", ["notice-mpl-2"]),
    ("Zlib", ["notice-zlib"]),
    ("BSL-1.0", ["notice-boost"]),
    ("EPL-2.0", ["notice-epl-2"]),
    ("Artistic-2.0", ["notice-artistic-2"]),
    ("Unlicense", ["notice-unlicense"]),
    ("CC-BY-4.0", ["notice-cc-by-4"]),
    ("CC0-1.0", ["notice-cc0"]),
    ("Proprietary", ["all-rights"]),
]

_WRAPPED = r"[.!?]+(?:[ \t\r\n]+|\z)|[:;][ \t\r]*\n+"
_LINES = _WRAPPED + r"|\n+"


def _normal(text: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text)
    return " ".join(kept.lower().split())


def known_sentences(sentences: list[tuple[str, str]] = SENTENCES) -> list[tuple[str, str]]:
    """(identifier, normalised sentence), each sentence as the cutting leaves it: a sentence with an inner end is known by its first part."""
    import re

    out: dict[str, str] = {}
    for key, text in sentences:
        first = next(x for x in re.split(_WRAPPED.replace(r"\z", r"\Z"), text) if _normal(x))
        out.setdefault(_normal(first), key)
    return [(key, s) for s, key in out.items()]


def _normalised(s: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(id, license, rules, sentence_ids) of each document with a known licence sentence.

    sentence_ids are the identifiers in the text's order, joined by spaces; of
    the two cuttings the one that finds more counts (at a tie the one by lines).
    rules are the names of all rules that match, in rule order, joined by
    commas; license is the first of them, null if only parts of rules are there.
    Null, empty and other texts give no row; texts of any length are scanned
    whole. Repeated rows give one result; a null id is a value like others.
    Other columns are ignored; an empty table gives no rows. The sentence table
    is fixed, so it is broadcast.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(known_sentences(sentences), "key string, s string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    hits = []
    for cut, pattern in (("0", _LINES), ("1", _WRAPPED)):
        own = rows.select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", pattern)).alias("pos", "raw"))
        own = own.where(F.length("raw") >= min(len(s) for _, s in known_sentences(sentences)))
        own = own.select("id", "t", F.lit(cut).alias("cut"), "pos", _normalised(F.col("raw")).alias("s"))
        hits.append(own.join(F.broadcast(known), "s").select("id", "t", "cut", "pos", "key"))
    found = hits[0].union(hits[1]).distinct().groupBy("id", "t", "cut").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("l"))
    found = found.select("id", "t", F.struct((-F.size("l")).alias("less"), "cut", F.array_join(F.transform("l", lambda x: x["key"]), " ").alias("ids")).alias("x"))
    found = found.groupBy("id", "t").agg(F.min("x").alias("x")).select("id", F.col("x.ids").alias("sentence_ids")).distinct()
    padded = F.concat(F.lit(" "), "sentence_ids", F.lit(" "))
    matched = F.array(*(F.when(F.regexp_like(padded, F.lit(" " + "(?: [^ ]+)* ".join(keys) + " ")), F.lit(name)) for name, keys in rules))
    names = F.array_distinct(F.array_compact(matched))
    return found.select(F.col("id").alias(id_col), F.try_element_at(names, F.lit(1)).alias("license"), F.array_join(names, ",").alias("rules"), "sentence_ids")


def scan_licenses_sql() -> str:
    """DuckDB SQL of ``scan_licenses`` over documents with the built-in tables."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(k)}, {quoted(s)})" for k, s in known_sentences())
    rules = ", ".join(f"({i}, {quoted(name)}, {quoted(' ' + '(?: [^ ]+)* '.join(keys) + ' ')})" for i, (name, keys) in enumerate(RULES))
    return f"""
with known(key, s) as (values {known}),
rules(i, name, pattern) as (values {rules}),
cuts(cut, pattern) as (values ('0', '{_LINES}'), ('1', '{_WRAPPED}')),
parts as (select doc_id, text, '0' as cut, regexp_split_to_array(text, '{_LINES}') as p from documents where text is not null
  union all select doc_id, text, '1', regexp_split_to_array(text, '{_WRAPPED}') from documents where text is not null),
each as (select distinct doc_id, text, cut, i, trim(lower(regexp_replace(p[i], '[^A-Za-z0-9]+', ' ', 'g'))) as s from parts, unnest(range(1, len(p) + 1)) as g(i)),
seqs as (select doc_id, text, cut, count(*) as n, string_agg(key, ' ' order by i, key) as ids from each join known using (s) group by doc_id, text, cut),
best as (select distinct doc_id, ids from (select *, row_number() over (partition by doc_id, text order by n desc, cut, ids) as r from seqs) where r = 1),
hit as (select doc_id, ids, name, min(i) as i from best join rules on regexp_matches(' ' || ids || ' ', pattern) group by doc_id, ids, name)
select b.doc_id, any_value(h.first) as license, coalesce(any_value(h.names), '') as rules, b.ids as sentence_ids
from best b left join (select doc_id, ids, arg_min(name, i) as first, string_agg(name, ',' order by i) as names from hit group by doc_id, ids) h on b.doc_id is not distinct from h.doc_id and b.ids = h.ids
group by b.doc_id, b.ids"""
