"""License scans by sentence rules.

A text is cut into sentences; each is normalised (case, space, quotes, comment marks, punctuation at its ends) and mapped to
the identifier of a known licence sentence, by a table of patterns.  Ordered rules then match runs of identifiers: the first
rule that fits names the licence and uses up its sentences; the rest goes on with the later rules.  Sentences that speak of
licensing but are not known are reported as UNKNOWN, and a text without either as NONE.

One narrow pass; only texts that hold a licence word, or how a known sentence without one begins, are cut into sentences.

Cases: null or empty text: NONE, no sentences; sentences that are wrapped over lines are joined; ids may be null or repeat;
texts of any length are read whole; only the named columns are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

# Sentences of public licences and notices, normalised, by identifier; `{any}` stands for names, years and such.
SENTENCES = {
    "copyright": ["copyright {any}", "(c) {any}", "© {any}"],
    "all_rights": ["all rights reserved"],
    "mit_title": ["the mit license", "mit license", "the mit license (mit)"],
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this {any} is licensed under the mit license", "distributed under the mit license", "license: mit"],
    "mit_grant": [
        'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions'
    ],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is_software": [
        'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
    ],
    "no_liability": ["in no event shall the {any} be liable for any {any}"],
    "isc_grant": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_warranty": ['the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'],
    "apache2_ref": [
        'licensed under the apache license, version 2.0 (the "license")',
        "licensed under the apache license, version 2.0",
        "licensed under the apache license version 2.0",
        "released under the apache license, version 2.0",
        "this {any} is licensed under the apache license, version 2.0",
    ],
    "apache2_may": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at {any}"],
    "apache2_as_is": [
        'unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied'
    ],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_details": ["see the gnu general public license for more details"],
    "gpl_copy": ["you should have received a copy of the gnu general public license along with this program{any}"],
    "gpl_not": ["if not, see {any}", "if not, write to {any}"],
    "mpl2_ref": ["this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license, version 2.0"],
    "mpl2_copy": ["if a copy of the mpl was not distributed with this file, you can obtain one at {any}"],
    "bsd_grant": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_names": ["neither the name of {any} nor the names of {any} may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd_as_is": ['this software is provided by the {any} "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed'],
    "bsd3_ref": ["licensed under the bsd 3-clause license", "released under the bsd 3-clause license"],
    "bsd2_ref": ["licensed under the bsd 2-clause license", "released under the bsd 2-clause license"],
    "cc0_ref": ["this work is dedicated to the public domain", "licensed under cc0 1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib_as_is": ["this software is provided 'as-is', without any express or implied warranty"],
    "zlib_liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib_origin": ["the origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "zlib_altered": ["altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
    "zlib_notice": ["this notice may not be removed or altered from any source distribution"],
    "bsl_grant": [
        'permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following'
    ],
    "bsd0_grant": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "cddl_notice": ["the contents of this file are subject to the terms of the common development and distribution license (the license)"],
    "epl2_notice": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at {any}"],
    "spdx": ["spdx-license-identifier: {any}"],
}

# How a reference to a licence begins, and the names of licences; `{v}` stands for a version.
LEADS = (
    "licensed under", "released under", "distributed under", "available under", "published under", "provided under", "this work is licensed under", "this project is licensed under", "this software is licensed under",
    "this program is licensed under", "this library is licensed under", "this file is licensed under", "this code is licensed under", "licensed under the terms of", "released under the terms of", "distributed under the terms of",
    "made available under the terms of", "license:", "licence:",
)
NAMES = {
    "mit_ref": ("MIT", "the mit license", "mit license", "the mit licence", "mit"),
    "isc_ref": ("ISC", "the isc license", "isc license", "isc"),
    "apache2_ref": ("Apache-2.0", "the apache license, version 2.0", "the apache license version 2.0", "the apache license 2.0", "apache license, version 2.0", "apache license 2.0", "the apache 2.0 license", "apache 2.0", "apache-2.0"),
    "apache11_ref": ("Apache-1.1", "the apache software license, version 1.1", "the apache software license 1.1", "apache-1.1"),
    "mpl2_ref": ("MPL-2.0", "the mozilla public license, version 2.0", "the mozilla public license, v. 2.0", "the mozilla public license 2.0", "mozilla public license 2.0", "mpl 2.0", "mpl-2.0"),
    "mpl11_ref": ("MPL-1.1", "the mozilla public license, version 1.1", "the mozilla public license 1.1", "mpl 1.1", "mpl-1.1"),
    "epl2_ref": ("EPL-2.0", "the eclipse public license, version 2.0", "the eclipse public license 2.0", "the eclipse public license v2.0", "epl 2.0", "epl-2.0"),
    "epl1_ref": ("EPL-1.0", "the eclipse public license, version 1.0", "the eclipse public license 1.0", "the eclipse public license v1.0", "epl 1.0", "epl-1.0"),
    "cddl1_ref": ("CDDL-1.0", "the common development and distribution license, version 1.0", "the common development and distribution license 1.0", "cddl 1.0", "cddl-1.0"),
    "cddl11_ref": ("CDDL-1.1", "the common development and distribution license, version 1.1", "the common development and distribution license 1.1", "cddl 1.1", "cddl-1.1"),
    "zlib_ref": ("Zlib", "the zlib license", "zlib license", "zlib"),
    "bsl_ref": ("BSL-1.0", "the boost software license, version 1.0", "the boost software license 1.0", "boost software license 1.0", "bsl-1.0"),
    "bsd3_ref": ("BSD-3-Clause", "the bsd 3-clause license", "bsd 3-clause license", "the 3-clause bsd license", "bsd-3-clause"),
    "bsd2_ref": ("BSD-2-Clause", "the bsd 2-clause license", "bsd 2-clause license", "the 2-clause bsd license", "the simplified bsd license", "bsd-2-clause"),
    "bsd0_ref": ("0BSD", "the bsd zero clause license", "0bsd"),
    "unlicense_ref": ("Unlicense", "the unlicense", "unlicense"),
    "wtfpl_ref": ("WTFPL", "the wtfpl", "wtfpl"),
    "artistic2_ref": ("Artistic-2.0", "the artistic license 2.0", "artistic license 2.0", "artistic-2.0"),
    "ofl_ref": ("OFL-1.1", "the sil open font license, version 1.1", "the sil open font license 1.1", "ofl-1.1"),
    "eupl_ref": ("EUPL-1.2", "the european union public licence v. 1.2", "the european union public licence 1.2", "eupl-1.2"),
    "cc0_ref": ("CC0-1.0", "cc0 1.0", "cc0 1.0 universal", "cc0-1.0"),
}
GNU = {
    "gpl": ("gnu general public license", ("1.0", "2.0", "3.0")),
    "lgpl": ("gnu lesser general public license", ("2.0", "2.1", "3.0")),
    "agpl": ("gnu affero general public license", ("3.0",)),
}
GNU_NAMES = ("the {long}, version {v}", "the {long} version {v}", "the {long} v{v}", "the {long} {v}", "{long}, version {v}", "{long} version {v}", "{long} v{v}", "{short} version {v}", "{short} v{v}", "{short}v{v}", "{short} {v}", "{short}-{v}", "the {short} v{v}", "the {short} version {v}", "the {short} {v}")
LATER = (" or later", " or any later version", " or (at your option) any later version", ", or (at your option) any later version", "+")
GNU_HEADER = "this {thing} is free software{a} you can redistribute it and/or modify it under the terms of the {long} as published by the free software foundation{b} either version {v} of the license, or (at your option) any later version"
GNU_REST = {
    "gpl_hope": "this {thing} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_details": "see the {long} for more details",
    "gpl_copy": "you should have received a copy of the {long} along with this {thing}{{any}}",
}
CREATIVE = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}
CREATIVE_NAMES = ("cc {kind} {v}", "cc-{kind}-{v}", "cc {kind} {v} international", "the creative commons {long} {v} international license", "a creative commons {long} {v} international license", "the creative commons {long} {v} license", "creative commons {long} {v} international")


def _references() -> dict[str, tuple]:
    """Licence and names by identifier: those above, and those that follow from the rules for families of licences."""
    out = dict(NAMES)
    for short, (long, versions) in GNU.items():
        for v in versions:
            plain = [n.format(long=long, short=short, v=x) for n in GNU_NAMES for x in dict.fromkeys((v, v.removesuffix(".0")))]
            out[f"{short}{v}_ref"] = (f"{short.upper()}-{v}-only", *plain)
            out[f"{short}{v}_later_ref"] = (f"{short.upper()}-{v}-or-later", *(n + x for n in plain for x in LATER))
    for kind, long in CREATIVE.items():
        for v in ("3.0", "4.0"):
            out[f"cc_{kind}_{v}_ref"] = (f"CC-{kind.upper()}-{v}", *(n.format(kind=kind, long=long, v=v) for n in CREATIVE_NAMES))
    return out


REFERENCES = _references()
for _name, (_, *_names) in REFERENCES.items():
    SENTENCES[_name] = list(dict.fromkeys(SENTENCES.get(_name, []) + [f"{lead} {n}" for lead in LEADS for n in _names]))
for _short, (_long, _versions) in GNU.items():
    for _v in _versions:
        SENTENCES[f"{_short}{_v}_free"] = [GNU_HEADER.format(thing=t, a=a, b=b, long=_long, v=x) for t in ("program", "library", "software") for a in ":;" for b in ",;" for x in dict.fromkeys((_v, _v.removesuffix(".0")))]
    for _name, _form in GNU_REST.items():
        SENTENCES[_name] = list(dict.fromkeys(SENTENCES.get(_name, []) + [_form.format(thing=t, long=_long) for t in ("program", "library", "software")]))

#: Ordered rules: the identifiers in order (optional ones end in ?), and the licence.
RULES = (
    ("BSD-3-Clause", "bsd_grant bsd_source bsd_binary bsd_names bsd_as_is? no_liability?"),
    ("BSD-2-Clause", "bsd_grant bsd_source bsd_binary bsd_as_is? no_liability?"),
    ("MIT", "mit_title? mit_grant mit_notice as_is_software? no_liability?"),
    ("ISC", "isc_grant isc_warranty? no_liability?"),
    ("0BSD", "bsd0_grant isc_warranty? no_liability?"),
    ("Zlib", "zlib_as_is? zlib_liable? zlib_grant zlib_origin? zlib_altered? zlib_notice?"),
    ("BSL-1.0", "bsl_grant as_is_software? no_liability?"),
    ("Apache-2.0", "apache2_ref apache2_may apache2_copy apache2_as_is? apache2_see?"),
    *((f"{short.upper()}-{v}-or-later", f"{short}{v}_free gpl_hope? gpl_details? gpl_copy? gpl_not?") for short, (_, versions) in GNU.items() for v in versions),
    ("MPL-2.0", "mpl2_ref mpl2_copy?"),
    ("EPL-2.0", "epl2_notice"),
    ("CDDL-1.0", "cddl_notice"),
    *((licence, name) for name, (licence, *_) in REFERENCES.items()),
    ("Unlicense", "unlicense"),
    ("MIT", "mit_title"),
    ("Proprietary", "copyright all_rights"),
    ("Proprietary", "all_rights"),
)

#: Parts of single words, and what _LICENCE finds beside them.
_WORDS = ("licen", "copyright", "permission", "warrant", "redistribut", "reserved", "spdx", "©", "(c)", "liable", "all rights", "public domain")
_LICENCE = re.compile(r"licen[cs]e|copyright|warrant(?:y|ies)|redistribut|all rights|spdx|public domain")
_PART = re.compile(r"(?:(?<=[.!?;])|(?<=\.[\"'”)]))\s+|(?<=:)[ \t]*\n\s*|\n\s*\n")
_MARKS = re.compile(r"^[\s*#/;|>\-]+")
_SPACE = re.compile(r"\s+")
_ENDS = " .,;:!*#"


def _bare(sentence: str) -> str:
    lines = (_MARKS.sub("", x) for x in sentence.lower().replace("“", '"').replace("”", '"').replace("’", "'").split("\n"))
    return _SPACE.sub(" ", " ".join(lines)).strip()


def normal(sentence: str) -> str:
    """Lower case, plain quotes, single spaces, no comment marks, no punctuation at the ends."""
    return _bare(sentence).strip(_ENDS)


def _tables():
    exact, open_, before = {}, [], {}
    for name, forms in SENTENCES.items():
        for form in forms:
            if "{any}" in form:
                open_.append((re.compile(re.escape(form).replace(re.escape("{any}"), ".*")), form.split("{any}")[0], name))
                if form.count("{any}") == 1 and form.endswith((" at {any}", " see {any}")):
                    before[form[: -len(" {any}")]] = name
            else:
                exact[form] = name
    return exact, open_, before


#: Whole forms, open forms, and forms that an address ends, which may be set apart in a paragraph of its own.
_EXACT, _OPEN, _BEFORE = _tables()
_FORMS: dict[str, list[str]] = {}
for _form in (*_EXACT, *_BEFORE):
    _FORMS.setdefault(_form.split(" ")[0], []).append(_form)
#: How a line begins with which a form can begin.
_HEAD = re.compile(r"[\s*#/;|>\-.,:!]*(?:" + "|".join(sorted({re.escape(f.split(" ")[0]) for fs in SENTENCES.values() for f in fs})) + ")", re.I)


def identify(sentence: str) -> str | None:
    """The identifier of a normalised sentence."""
    if name := _EXACT.get(sentence):
        return name
    return next((name for pattern, head, name in _OPEN if sentence.startswith(head) and pattern.fullmatch(sentence)), None)


def _openings() -> dict[str, re.Pattern]:
    """How the forms begin that need not hold a licence word within a line, as patterns over the ends of lines, by their longest words."""
    bare = {form for forms in SENTENCES.values() for form in forms if not any(w in form and " " not in w for w in _WORDS)}
    heads = {f[: f.index(" under ") + 6] if " under " in f else " ".join(f.split("{any}")[0].split()[:4]) for f in bare}
    return {max(h.split(), key=len): re.compile("|".join(r"[\s*#/;|>\-]+".join(map(re.escape, x.split())) for x in sorted(heads) if max(x.split(), key=len) == max(h.split(), key=len))) for h in heads}


_OPENINGS = _openings()


def _may_hold(text: str) -> bool:
    """False only if no sentence of the text is known or speaks of licensing."""
    lower = text.lower()
    return any(w in lower for w in _WORDS) or any(w in lower and pattern.search(lower) for w, pattern in _OPENINGS.items())


#: Open forms that end with their line.
_LINE = ("copyright", "spdx")


def _named(name: str, sentence: str) -> str:
    return "spdx:" + (sentence.split(":", 1)[1].split() or [""])[0] if name == "spdx" else name


def _run_of_lines(lines: list[str], at: int) -> tuple[str | None, int, str]:
    """The longest whole form that begins with a line, over as many lines and parts as it takes: its identifier, the line
    after it, and the form."""
    found, joined, forms = (None, at, ""), "", None
    for k in range(at, len(lines)):
        more = _bare(lines[k])
        if not more:
            continue
        joined = f"{joined} {more}" if joined else more.lstrip(_ENDS)
        if not joined:
            continue
        forms = _FORMS.get(joined.split(" ")[0], []) if forms is None else forms
        form = joined.rstrip(_ENDS)
        if form in _EXACT:
            found = (_EXACT[form], k + 1, form)
        elif form in _BEFORE:
            address = next((x for x in range(k + 1, len(lines)) if _bare(lines[x])), None)
            if address is not None and len(lines[address].strip(" \t*#/;|>").split()) == 1:
                found = (_BEFORE[form], address + 1, form)
        forms = [f for f in forms if f.startswith(joined)]
        if not forms:
            break
    return found


_FIXED = sorted({head.rstrip() for _, head, name in _OPEN if name not in _LINE})


def _fixed_words(lines: list[str], at: int, stop: int) -> str:
    """The fixed words of an open form that the lines begin with; forms that end with their line are not looked at."""
    joined, heads = "", _FIXED
    while at < stop and heads:
        joined = f"{joined} {_bare(lines[at])}".lstrip(_ENDS)
        if found := next((head for head in heads if joined.startswith(head)), ""):
            return found
        heads = [head for head in heads if head.startswith(joined)]
        at += 1
    return ""


def sentences(text: str) -> list[str]:
    """Identifiers of the licence sentences in order; UNKNOWN for those that only speak of licensing.

    A form can go over the ends of parts, since some hold a full stop or a semicolon; an open form ends with its part."""
    out, lines, stops, first = [], [], [], []
    for part in _PART.split(text):
        own = part.split("\n")
        lines += own
        stops += [len(lines)] * len(own)
        first += [True] + [False] * (len(own) - 1)
    at, missed = 0, set()  # what does not end its part from these words on does not from the same words further on
    while at < len(lines):
        if _HEAD.match(lines[at]) or first[at] and not _bare(lines[at]).strip(_ENDS):
            name, to, joined = _run_of_lines(lines, at)
            if not name:
                begins = (stops[at], _fixed_words(lines, at, stops[at]))
                if first[at] or begins[1] and begins not in missed:
                    rest = "\n".join(lines[at : stops[at]])
                    joined, to = normal(rest), stops[at]
                    name = identify(joined)
                    name = None if name in _LINE and "\n" in rest.strip() else name
                    missed.update(() if name else (begins,))
            if not name:
                joined = normal(lines[at])
                name, to = identify(joined), at + 1
            if name:
                out.append(_named(name, joined))
                at = to
                continue
        if _LICENCE.search(lines[at].lower()):
            out.append("UNKNOWN")
        at += 1
    return out


def licences(found: list[str]) -> list[str]:
    """Licences by the ordered rules, in the order of their first sentences; what no rule uses stays as UNKNOWN."""
    out, left = [(k, x[5:].upper()) for k, x in enumerate(found) if x.startswith("spdx:")], [None if x.startswith("spdx:") else x for x in found]
    for name, ids in RULES:
        steps = [(x.rstrip("?"), x.endswith("?")) for x in ids.split()]
        start = 0
        while start < len(left):
            at, used = start, []
            for x, optional in steps:
                if at < len(left) and left[at] == x:
                    used.append(at)
                    at += 1
                elif not optional:
                    used = []
                    break
            if used:
                out.append((used[0], name))
                for k in used:
                    left[k] = None
            start = at if used else start + 1
    out += [(k, "UNKNOWN") for k, x in enumerate(left) if x == "UNKNOWN"]
    return list(dict.fromkeys(name for _, name in sorted(out)))


def scan(text: str) -> tuple[list[str], list[str]]:
    """Sentence identifiers and licences of a text."""
    found = sentences(text)
    return found, licences(found) or ["NONE"]


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, sentences (array of identifiers), licences (array) of each row."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                found = [scan(text) if _may_hold(text) else ([], ["NONE"]) for text in T.column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.list_(pa.string())) for c in zip(*found, strict=True))], ["doc_id", "sentences", "licences"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, sentences array<string>, licences array<string>")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))
