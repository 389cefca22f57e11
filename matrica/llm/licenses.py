"""License scan by sentence rules.

A text is cut into sentences at ``.``, ``;`` or ``:`` before white space and at
lines without words; a sentence, or whole lines of one, normalised to
lower-case words, is looked up among the known sentences of license texts and
notices, which gives it an identifier.  A line end inside a sentence is white
space, so hard-wrapped texts, also behind comment signs, are read as others.  The identifiers of a document, in order, are matched
against ordered rules, each a run of identifiers: a rule that is found takes
its identifiers out, so a longer rule standing first (a whole license) keeps
its parts from being read as another (a shorter license sharing sentences).

All in one row by DataFrame functions: no shuffle, nothing is collected; the
tables of sentences and rules are constants of this module.

Defined cases: null or empty text gives no sentences and no license; sentences
repeated in a row count as one; a rule matched more than once is listed once;
extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier, then the sentence as normalised words.
SENTENCES: dict[str, list[str]] = {
    "mit_short": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License (MIT)", "This software is released under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "asis_mit": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache2_short": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed under the Apache License 2.0", "Apache License 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache2_use": ["you may not use this file except in compliance with the License"],
    "apache2_copy": ["You may obtain a copy of the License at"],
    "gpl3_short": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GPLv3", "GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2_short": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Licensed under the GPLv2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl_more": ["See the GNU General Public License for more details"],
    "lgpl3_short": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl3_short": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"],
    "ccby_short": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "ccbysa_short": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ccbync_short": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "ccbynd_short": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0_short": ["Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd2_short": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd3_short": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl2_short": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
}

_GPL = "you can redistribute it and/or modify it under the terms of the GNU General Public License"
_FSF = "as published by the Free Software Foundation"
#: Other wordings of notices, where what comes after a ``;`` or ``,`` says which version it is.
WORDINGS: dict[str, list[str]] = {
    "gpl_free": [f"{_GPL} {_FSF}{c} either version 3 of the License, or (at your option) any later version" for c in ",;"],
    "gpl2_free": [f"{_GPL} {_FSF}{c} either version 2 of the License, or (at your option) any later version" for c in ",;"],
    **{f"gpl{v}_only": [f"{_GPL} {x}" for x in (*(f"{_FSF}{c} version {v}{y}" for c in ",;" for y in ("", " of the License", " of the License only", " only")), f"version {v} {_FSF}", f"version {v} only {_FSF}")] for v in (2, 3)},
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
}

#: Ordered: the first rules win the identifiers they share with later ones.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit_short", "mit_grant", "mit_notice", "asis_mit"]),
    ("MIT", ["mit_grant", "mit_notice", "asis_mit"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_more"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_more"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache2_short", "apache2_use", "apache2_copy"]),
    ("Apache-2.0", ["apache2_short"]),
    ("MIT", ["mit_short"]),
    ("GPL-3.0", ["gpl3_short"]),
    ("GPL-2.0", ["gpl2_short"]),
    ("LGPL-3.0", ["lgpl3_short"]),
    ("AGPL-3.0", ["agpl3_short"]),
    ("CC-BY-4.0", ["ccby_short"]),
    ("CC-BY-SA-4.0", ["ccbysa_short"]),
    ("CC-BY-NC-4.0", ["ccbync_short"]),
    ("CC-BY-ND-4.0", ["ccbynd_short"]),
    ("CC0-1.0", ["cc0_short"]),
    ("BSD-2-Clause", ["bsd2_short"]),
    ("BSD-3-Clause", ["bsd3_short"]),
    ("MPL-2.0", ["mpl2_short"]),
    ("ISC", ["isc_grant"]),
]

#: Rules of the identifiers that only ``WORDINGS`` has; they share none with the others but the notice's end, so they stand first.
ONLY_RULES: list[tuple[str, list[str]]] = [(f"GPL-{v}.0-only", [f"gpl{v}_only", *more]) for more in (["gpl_hope", "gpl_more"], []) for v in (2, 3)]

#: How the SQL form cuts sentences: also at every line end, so it finds no sentence that is wrapped.
CUT = r"\n+|[.;:][ \t]+"
#: Every known sentence has one of these, so other texts need not be cut.
ANCHOR = r"(?i)licen[sc]|spdx|copyright|permission|redistribut|free\s+software|warrant|gplv|cc0"


def normal(sentence: str) -> str:
    """Lower-case runs of ASCII letters and digits, one space between."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier, for the SQL form: of a known sentence that the cut divides only the longest part, so it takes every SPDX line for one license."""
    out: dict[str, str] = {}
    for key, variants in SENTENCES.items():
        for v in variants:
            parts = [normal(p) for p in re.split(CUT, v) if normal(p)]
            out[max(parts, key=len)] = key
    return out


KNOWN = known_sentences()


#: What is looked for: identifier by normalised sentence, whole.
WHOLE = {normal(v): key for table in (SENTENCES, WORDINGS) for key, variants in table.items() for v in variants}
assert all(re.search(ANCHOR, s.replace(" ", "\n")) for s in WHOLE)

#: Marks in a text brought to words: a sentence's end, and an empty line.
_END, _EMPTY = "\x01", "\x02"


def _worded(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits.  Between two of them stands one mark: ``_EMPTY``
    for a line without words, else ``_END`` for a sentence's end, else a line break, else a space."""
    t = F.regexp_replace(F.lower(F.translate(text, _END + _EMPTY, "  ")), r"[.;:](?=\s|$)", _END)
    t = F.regexp_replace(F.trim(F.regexp_replace(t, rf"[^a-z0-9\n{_END}]+", " ")), rf" ?([\n{_END}]) ?", "$1")
    t = F.regexp_replace(F.regexp_replace(t, f"{_END}+", _END), rf"{_END}?\n{_END}?\n[\n{_END}]*", _EMPTY)
    return F.regexp_replace(t, rf"[\n{_END}]{{2,}}", _END)


def _pattern(sentences: list[str]) -> str:
    """Any of the sentences, the longest first, from the start of a line or sentence to the end of one.

    Lines may break between words; where the sentence itself is cut, all its parts must follow each other.
    """
    lines, parts = "[ \n]", f"[ \n{_END}]"
    forms = {parts.join(normal(p).replace(" ", lines) for p in re.split(CUT, s) if normal(p)): len(normal(s)) for s in sentences}
    return f"(?<![a-z0-9 ])(?:{'|'.join(sorted(forms, key=lambda f: -forms[f]))})(?![a-z0-9 ])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order, runs of the same one as one."""
    table = F.create_map(*[F.lit(x) for pair in WHOLE.items() for x in pair])
    known = [v for table in (SENTENCES, WORDINGS) for variants in table.values() for v in variants]
    found = F.regexp_extract_all(_worded(text), F.lit(_pattern(known)), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.translate(s, "\n" + _END, "  ")))
    once = F.transform(F.array(ids), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))[0]
    return F.when(text.rlike(ANCHOR), once).otherwise(F.array().cast("array<string>"))


def license_rules(ids: Column) -> Column:
    """Licenses of the rules found, in rule order, each once."""
    rules = F.array(*[F.struct(F.lit("," + ",,".join(seq) + ",").alias("run"), F.lit(name).alias("name")) for name, seq in ONLY_RULES + RULES])
    start = F.struct(F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit(","), x, F.lit(",")))).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.instr(acc["left"], rule["run"]) > 0
        return F.struct(
            F.when(hit, F.replace(acc["left"], rule["run"], F.lit("|"))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_union(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(rules, start, step, lambda acc: acc["found"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, sentence_ids array, licenses array)`` for every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col), sentence_ids(text).alias("sentence_ids"))
    return found.select(id_col, "sentence_ids", F.when(F.size("sentence_ids") > 0, license_rules(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")).alias("licenses"))
