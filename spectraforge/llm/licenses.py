"""Licence recognition: sentences to known identifiers, identifier sequences to ordered rules.

A text is cut into sentences twice: at sentence ends and line breaks, and at sentence ends only
(licence texts are often wrapped). Lines without a letter or digit (blank ones, comment frames)
and copyright statements end a sentence in both. Normalised sentences (a-z, 0-9 and single spaces) that are
known become identifiers, as do those that a pattern matches (a holder's name, the subject of a grant); all others
drop out. A plus sign behind a version number is read as "or later". A rule is a sequence of identifiers; it matches
where these stand in a row in one of the two sequences. The first matching rule names the licence.

Defined results
    Null or empty text: no identifiers, licence ``none``. Null ``doc_id``: a row like any other.
    Repeated rows: one row each. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import permutations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised, of public licences.
SENTENCES = {
    "apache-line": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-line-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "gpl-program": "this program is free software",
    "gpl-library": "this library is free software",
    "redistribute-gpl": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "redistribute-gpl-3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "redistribute-gpl-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "redistribute-gpl-2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "redistribute-gpl-2": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "redistribute-lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "redistribute-lgpl-3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "redistribute-lgpl-2.1-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "redistribute-agpl": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "redistribute-agpl-3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "redistribute-agpl-3-later-2": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version of the license",
    "version-2": "version 2",
    "version-2-of": "version 2 of the license",
    "version-2.1-of": "version 2 1 of the license",
    "version-3-of": "version 3 of the license",
    "version-2-later": "either version 2 of the license or at your option any later version",
    "version-2.1-later": "either version 2 1 of the license or at your option any later version",
    "version-3-later": "either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-line": "distributed under the boost software license version 1 0",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "bsd-no-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mit-line-3": "this project is licensed under the mit license",
    "mit-line-4": "this project is licensed under the mit license see the license file for details",
    "mit-line-5": "licensed under the mit license see the license file for details",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license version 2 0",
    "epl1-available": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-available-2": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    "spdx": "spdx license identifier",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-line": "licensed under cc by 4 0",
    "cc-by-sa-line": "licensed under cc by sa 4 0",
    "cc0-line": "this work is dedicated to the public domain",
    "reserved": "all rights reserved",
    "apache-title": "apache license",
    "apache-version": "version 2 0 january 2004",
    "gpl-title": "gnu general public license",
    "lgpl-title": "gnu lesser general public license",
    "agpl-title": "gnu affero general public license",
    "gpl2-version": "version 2 june 1991",
    "lgpl2.1-version": "version 2 1 february 1999",
    "gpl3-version": "version 3 29 june 2007",
    "agpl3-version": "version 3 19 november 2007",
    "mpl2-title": "mozilla public license version 2 0",
}

# What grants call the licences, normalised.
CALLED = {
    "MIT": "the mit license",
    "Apache-2.0": "the apache (software )?license (version )?(v )?2 0",
    "GPL-3.0-only": "the gnu general public license (version |v)3",
    "GPL-2.0-only": "the gnu general public license (version |v)2",
    "MPL-2.0": "the mozilla public license (version |v )2 0",
    "BSD-3-Clause": "the (bsd 3 clause|3 clause bsd) license",
    "BSD-2-Clause": "the (bsd 2 clause|2 clause bsd) license",
    "ISC": "the isc license",
    "CC-BY-4.0": "a creative commons attribution 4 0 international license",
    "CC-BY-SA-4.0": "a creative commons attribution share ?alike 4 0 international license",
    "CC-BY-NC-4.0": "a creative commons attribution non ?commercial 4 0 international license",
}

# Sentences with a holder's name or the subject of a grant, normalised; the words before each keep other sentences from the pattern.
PATTERNS = {
    "bsd-no-name": ("neither the name", r"^neither the names? of [a-z0-9 ]{1,300} nor the names of [a-z0-9 ]{1,100} may be used to endorse or promote products derived from this software without specific prior written permission$"),
} | {
    f"grant-{name}": ("ed under", rf"^((this|the) (file|code|library|package|program|project|repository|software|source code|work) is )?(licensed|released|distributed) under (the terms of )?{called}( see (the )?license( file)? for details)?$")
    for name, called in CALLED.items()
}

# Rules in order of precedence; longer sequences of a licence stand before shorter ones.
RULES = (
    ("Apache-2.0", ("apache-head", "apache-comply", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-head", "apache-comply")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("redistribute-gpl-3-later",)),
    ("GPL-3.0-or-later", ("redistribute-gpl", "version-3-later")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("redistribute-gpl-3",)),
    ("GPL-3.0-only", ("redistribute-gpl", "version-3-of")),
    ("GPL-2.0-or-later", ("redistribute-gpl-2-later",)),
    ("GPL-2.0-or-later", ("redistribute-gpl", "version-2-later")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("redistribute-gpl-2",)),
    ("GPL-2.0-only", ("redistribute-gpl", "version-2-of")),
    ("GPL-2.0-only", ("redistribute-gpl", "version-2")),
    ("AGPL-3.0-or-later", ("redistribute-agpl-3-later",)),
    ("AGPL-3.0-or-later", ("redistribute-agpl-3-later-2",)),
    ("AGPL-3.0-or-later", ("redistribute-agpl", "version-3-later")),
    ("AGPL-3.0-only", ("redistribute-agpl", "version-3-of")),
    ("LGPL-3.0-or-later", ("redistribute-lgpl-3-later",)),
    ("LGPL-3.0-or-later", ("redistribute-lgpl", "version-3-later")),
    ("LGPL-3.0-only", ("redistribute-lgpl", "version-3-of")),
    ("LGPL-2.1-or-later", ("redistribute-lgpl-2.1-later",)),
    ("LGPL-2.1-or-later", ("redistribute-lgpl", "version-2.1-later")),
    ("LGPL-2.1-only", ("redistribute-lgpl", "version-2.1-of")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("EPL-1.0", ("epl1-available",)),
    ("EPL-2.0", ("epl2-available",)),
    ("EPL-2.0", ("epl2-available-2",)),
    ("MPL-2.0", ("mpl-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl-subject", "mpl2-copy-2")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-2",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-line",)),
    ("Zlib", ("zlib-origin", "zlib-altered")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-no-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-line",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-2",)),
    ("MIT", ("mit-line-3",)),
    ("MIT", ("mit-line-4",)),
    ("MIT", ("mit-line-5",)),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC0-1.0", ("cc0-line",)),
    ("proprietary", ("reserved",)),
)
# The titles of whole texts, and grants in one sentence, stand behind the rules above.
RULES = (
    *RULES[:-1],
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("GPL-2.0-only", ("gpl-title", "gpl2-version")),
    ("GPL-3.0-only", ("gpl-title", "gpl3-version")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl2.1-version")),
    ("LGPL-3.0-only", ("lgpl-title", "gpl3-version")),
    ("AGPL-3.0-only", ("agpl-title", "agpl3-version")),
    ("MPL-2.0", ("mpl2-title",)),
    *((name, (f"grant-{name}",)) for name in CALLED),
    RULES[-1],
)

# A tag names one of the licences above: the tag's words are a sentence, the licence's name behind the colon is the next.
_NAMES = [name for name in dict.fromkeys(name for name, _ in RULES) if name != "proprietary"]
SENTENCES |= {f"spdx-{name}": re.sub(r"[^a-z0-9]+", " ", name.lower()) for name in _NAMES}
# Names without "only" are older ones of the same licences; two licences joined by a word are one sentence that names both.
_OLD = [name for name in _NAMES if name.endswith("-only")]
SENTENCES |= {f"spdx-old-{name}": SENTENCES[f"spdx-{name}"].removesuffix(" only") for name in _OLD}
_DUAL = [(a, word, b) for a, b in permutations(("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "BSD-3-Clause"), 2) for word in ("or", "and")]
SENTENCES |= {f"spdx-{a}-{word}-{b}": f"{SENTENCES[f'spdx-{a}']} {word} {SENTENCES[f'spdx-{b}']}" for a, word, b in _DUAL}
RULES = (
    *((name, ("spdx", f"spdx-{name}")) for name in _NAMES),
    *((name, ("spdx", f"spdx-old-{name}")) for name in _OLD),
    *((name, ("spdx", f"spdx-{a}-{word}-{b}")) for a, word, b in _DUAL for name in (a, b)),
    *RULES,
)


def _cover() -> list[str]:
    """Few words of which every known sentence holds one: a text without any of them has no known sentence."""
    left = {*SENTENCES.values(), *(guard for guard, _ in PATTERNS.values())}
    words: list[str] = []
    while left:
        # long words before short ones of the same reach: they are rarer
        at = {w: sum(w in s for s in left) for s in left for w in s.split() if len(w) > 5 or len(max(s.split(), key=len)) == len(w)}
        words.append(max(sorted(at), key=lambda w: (at[w], len(w))))
        left = {s for s in left if words[-1] not in s}
    return words


COVER = _cover()

_END = "\x01"
#: What ends a sentence: its marks before white space, a copyright statement, a line without a letter or digit.
ENDS = r"[.!?;:]+([ \t\n\r]|$)|copyright (\(c\)|©|[0-9])[^\n.!?;:]*|\n[^a-z0-9\n]*\n"


def _folded(lowered: Column) -> Column:
    """Lower-cased text with ends of sentences marked; everything but letters, digits, marks and line breaks is a space."""
    later = F.regexp_replace(lowered, r"([0-9])\+", "$1 or later")
    return F.regexp_replace(F.regexp_replace(later, ENDS, _END), r"[^a-z0-9\x01\n]+", " ")


def _identifiers(sentences: Column) -> Column:
    """Known sentence identifiers in order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])

    def identifier(sentence: Column) -> Column:
        named = [F.when(F.contains(sentence, F.lit(guard)) & F.rlike(sentence, F.lit(pattern)), F.lit(i)) for i, (guard, pattern) in PATTERNS.items()]
        return F.coalesce(F.try_element_at(known, sentence), *named)

    return F.filter(F.transform(F.transform(sentences, lambda s: F.trim(s)), identifier), lambda i: i.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence (first matching rule), licences (all, in rule order), sentence_ids, n_sentences.

    A text without a word of ``COVER`` has no known sentence and is not folded; rules are tested where there are identifiers, each once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lowered"))
    known = reduce(or_, [F.contains("lowered", F.lit(w)) for w in COVER])
    rows = rows.select("doc_id", F.when(known, _folded(F.col("lowered"))).otherwise("").alias("folded"))
    by_end = F.regexp_replace("folded", r"[^a-z0-9\x01]+", " ")
    rows = rows.select("doc_id", _identifiers(F.split("folded", r"[\x01\n]")).alias("by_line"), _identifiers(F.split(by_end, r"\x01")).alias("by_end"))
    rows = rows.select(
        "doc_id",
        F.when(F.size("by_end") > F.size("by_line"), F.col("by_end")).otherwise(F.col("by_line")).alias("ids"),
        F.concat(F.lit(","), F.array_join("by_line", ","), F.lit(",|,"), F.array_join("by_end", ","), F.lit(",")).alias("sequences"),
    )
    found = [F.when(F.contains("sequences", F.lit("," + ",".join(rule) + ",")), F.lit(name)) for name, rule in RULES]
    matched = F.when(F.size("ids") > 0, F.array_distinct(F.array_compact(F.array(*found)))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "ids", matched.alias("matched"))
    return rows.select(
        "doc_id",
        F.coalesce(F.get("matched", F.lit(0)), F.lit("none")).alias("licence"),
        F.array_join("matched", ",").alias("licences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"),
    )
