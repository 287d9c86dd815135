"""Licence scans by sentence rules.

A text is normalised (lower case, letters, digits, dots within numbers; single blanks) and the
known licence sentences are looked up in it, whole and wherever their lines are wrapped. A sentence
ends at a mark or a blank line, and a known one may also begin or end with a line; numerals of a
list are dropped. A notice ("licensed under" or "SPDX-License-Identifier:" and a licence's name)
may stand within a sentence. The sequence of identifiers, with unknown sentences between them as a
gap, is matched against ordered rules; a rule takes its sentences away from the rules after it.

Every pattern takes time in proportion to the text, whatever runs of marks or blanks it holds.
Null, empty and blank texts hold no sentence and no licence. A licence named twice is
listed twice, in the order of rules' places in the text. Sentences that are known but
taken by no rule are counted as left over. Of an SPDX expression the first name counts. Rows that
repeat an id stay rows of their own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweave.llm.columns import let

# Families of the GNU licences, the words before "public license" and their versions.
GNU = {
    "gpl": ("general", ("2", "3")),
    "lgpl": ("lesser general", ("2.1", "3")),
    "agpl": ("affero general", ("3",)),
}
# Known sentences, normalised, by identifier.
SENTENCES = {
    "apache2-short": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license",
    ],
    "apache2-header": [
        "licensed under the apache license version 2.0 the license you may not use this file except in"
        " compliance with the license",
        "the asf licenses this file to you under the apache license version 2.0 the license you may not"
        " use this file except in compliance with the license",
    ],
    "apache2-may-not": [
        "you may not use this file except in compliance with the license",
        "you may not use this work except in compliance with the license",
    ],
    "apache2-copy": [
        "you may obtain a copy of the license at",
        "you may obtain a copy of the license at http www apache org licenses license 2.0",
        "you may obtain a copy of the license at https www apache org licenses license 2.0",
    ],
    "apache2-url": [
        "http www apache org licenses license 2.0",
        "https www apache org licenses license 2.0",
    ],
    "apache2-basis": [
        "unless required by applicable law or agreed to in writing software distributed under the license"
        " is distributed on an as is basis without warranties or conditions of any kind either express or"
        " implied",
    ],
    "apache2-see": [
        "see the license for the specific language governing permissions and limitations under the license"
    ],
    "mit-short": [
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the mit license",
    ],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense"
        " and or sell copies of the software and to permit persons to whom the software is furnished to"
        " do so subject to the following conditions",
    ],
    "mit-notice": [
        "the above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the software",
        "the above copyright notice and this permission notice including the next paragraph shall be"
        " included in all copies or substantial portions of the software",
    ],
    "as-is": [
        "the software is provided as is without warranty of any kind express or implied",
        "this software is provided as is without warranty of any kind",
        "the software is provided as is without warranty of any kind express or implied including but"
        " not limited to the warranties of merchantability fitness for a particular purpose and"
        " noninfringement",
    ],
    "mit-liable": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other"
        " liability whether in an action of contract tort or otherwise arising from out of or in"
        " connection with the software or the use or other dealings in the software",
    ],
    "bsd-grant": [
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met"
    ],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice",
        "redistributions of source code must retain the above copyright notice this list of conditions"
        " and the following disclaimer",
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions"
        " and the following disclaimer in the documentation and or other materials provided with the"
        " distribution",
    ],
    "bsd-name": [
        f"neither the name of the {owner} nor the names of its contributors may be used{rest}"
        for owner in ("copyright holder", "copyright holders", "author", "organization", "university")
        for rest in (
            "",
            " to endorse or promote products derived from this software without specific prior written"
            " permission",
        )
    ],
    "bsd-as-is": [
        "this software is provided by the copyright holders and contributors as is and any express or"
        " implied warranties including but not limited to the implied warranties of merchantability and"
        " fitness for a particular purpose are disclaimed",
    ],
    "bsd-liable": [
        f"in no event shall the copyright {owner} or contributors be liable for any direct indirect"
        " incidental special exemplary or consequential damages including but not limited to procurement"
        " of substitute goods or services loss of use data or profits or business interruption however"
        " caused and on any theory of liability whether in contract strict liability or tort including"
        " negligence or otherwise arising in any way out of the use of this software even if advised of"
        " the possibility of such damage"
        for owner in ("holder", "holders", "owner")
    ],
    "gpl3-short": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
    ],
    "gpl-free": ["this program is free software you can redistribute it and or modify it"],
    **{
        f"{family}{version}-free": [
            f"this {work} is free software you can redistribute it and or modify it under the terms of the"
            f" gnu {name} public license as published by the free software foundation either version"
            f" {version} of the license or at your option any later version"
            for work in ("program", "library", "software")
        ]
        for family, (name, versions) in GNU.items()
        for version in versions
    },
    "gpl-hope": [
        f"this {work} is distributed in the hope that it will be useful but without any warranty without"
        " even the implied warranty of merchantability or fitness for a particular purpose"
        for work in ("program", "library", "software")
    ],
    **{
        f"{family}-see": [f"see the gnu {name} public license for more details"]
        for family, (name, _) in GNU.items()
    },
    **{
        f"{family}-copy": [
            f"you should have received a copy of the gnu {name} public license along with this {work}{rest}"
            for work in ("program", "library", "software")
            for rest in (
                "",
                " if not write to the free software foundation inc 51 franklin street fifth floor boston ma"
                " 02110 1301 usa",
            )
        ]
        for family, (name, _) in GNU.items()
    },
    "gpl-url": [
        "if not see http www gnu org licenses",
        "if not see https www gnu org licenses",
    ],
    "mpl2-terms": [
        "this source code form is subject to the terms of the mozilla public license version 2.0",
    ],
    "mpl2-copy": [
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
    ],
    "isc-grant": [
        f"permission to use copy modify and {distribute} this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all"
        " copies"
        for distribute in ("or distribute", "distribute")
    ],
    "isc-as-is": [
        f"the software is provided as is and {who} all warranties with regard to this software including all"
        " implied warranties of merchantability and fitness"
        for who in ("the author disclaims", "the authors disclaim", "isc disclaims")
    ],
    "isc-liable": [
        f"in no event shall {who} be liable for any special direct indirect or consequential damages or any"
        " damages whatsoever resulting from loss of use data or profits whether in an action of contract"
        " negligence or other tortious action arising out of or in connection with the use or performance of"
        " this software"
        for who in ("the author", "the authors", "isc")
    ],
    "zlib-as-is": ["this software is provided as is without any express or implied warranty"],
    "zlib-liable": [
        f"in no event will the {who} be held liable for any damages arising from the use of this software"
        for who in ("author", "authors")
    ],
    "zlib-grant": [
        "permission is granted to anyone to use this software for any purpose including commercial"
        " applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
    "zlib-origin": [
        "the origin of this software must not be misrepresented you must not claim that you wrote the original"
        " software",
    ],
    "zlib-thanks": [
        f"if you use this software in a product an {thanks} in the product documentation would be appreciated"
        " but is not required"
        for thanks in ("acknowledgment", "acknowledgement")
    ],
    "zlib-altered": [
        "altered source versions must be plainly marked as such and must not be misrepresented as being the"
        " original software",
    ],
    "zlib-notice": [
        f"this notice may not be removed or altered from any source {rest}" for rest in ("distribution", "code")
    ],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
    "unlicense-free": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source"
        " code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "cc0-deed": [
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving"
        " all of his or her rights to the work worldwide under copyright law including all related and"
        " neighboring rights to the extent allowed by law",
    ],
    "cc-by-nc-4": [
        "licensed under cc by nc 4.0",
        "this work is licensed under cc by nc 4.0",
    ],
    "cc-by-4": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "public-domain": ["this work is in the public domain", "released into the public domain"],
    "reserved": ["all rights reserved"],
}
# The short names of the Creative Commons licences, and their words.
COMMONS = {
    "by": "attribution",
    "by nc": "attribution noncommercial",
    "by sa": "attribution sharealike",
    "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike",
    "by nc nd": "attribution noncommercial noderivatives",
}
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def _commons(short: str, words: str, version: str) -> list[str]:
    apart = words.replace("noncommercial", "non commercial").replace("sharealike", "share alike")
    apart = apart.replace("noderivatives", "no derivatives")
    names = [f"cc {short}", f"creative commons {short}", f"creative commons {words}", f"creative commons {apart}"]
    return [f"{name}{between}{version}" for name in dict.fromkeys(names) for between in (" ", " version ", " license ")]


def _gnu(family: str, words: str, version: str) -> list[str]:
    names = [f"gnu {words} public license", f"gnu {family}", family]
    forms = [f"{name} version {version}" for name in names] + [f"{family}v{version}", f"gnu {family}v{version}"]
    whole = version if "." in version else f"{version}.0"
    more = [f"{form}.0" for form in forms if whole != version]
    return [*forms, *more, f"{family} {version}", *([f"{family} {whole}"] if whole != version else [])]


# Names of licences in a notice, normalised (a version is "version 2.0"), by identifier.
NAMES = {
    "apache2-short": [
        "apache license version 2.0", "apache license version 2", "apache license 2.0", "apache 2.0", "apache version 2.0",
    ],
    "mit-short": ["mit license", "mit licence", "mit"],
    "bsd3-short": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "bsd 3 clause license"],
    "bsd2-short": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd license", "bsd 2 clause license"],
    "isc-short": ["isc license", "isc licence", "isc"],
    "mpl2-short": [
        "mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0", "mpl version 2.0",
    ],
    "epl2-short": ["eclipse public license version 2.0", "eclipse public license 2.0", "epl 2.0", "epl version 2.0"],
    "epl1-short": ["eclipse public license version 1.0", "eclipse public license 1.0", "epl 1.0", "epl version 1.0"],
    "boost-short": ["boost software license version 1.0", "boost software license 1.0", "bsl 1.0"],
    "zlib-short": ["zlib license", "zlib"],
    "unlicense-short": ["unlicense"],
    "cc0-short": ["cc0 1.0", "cc0", "creative commons zero", "creative commons cc0", "cc0 version 1.0"],
    **{
        f"{family}{version}-short": _gnu(family, words, version)
        for family, (words, versions) in GNU.items()
        for version in versions
    },
    **{
        f"cc-{short.replace(' ', '-')}-{version.removesuffix('.0')}": _commons(short, words, version)
        for short, words in COMMONS.items()
        for version in COMMONS_VERSIONS
    },
}
# What stands before the name in a notice; words are parted by one blank.
NOTICE = (
    "(?:(?:licensed|licenced|released|distributed|available|provided|published) under"
    "(?: the terms of| the conditions of)?(?: the| a| an)?|spdx license identifier) "
)
# Licences and the sentences they consist of, tried in this order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is", "bsd-liable"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy", "apache2-url", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy", "apache2-url"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy"]),
    ("Apache-2.0", ["apache2-header"]),
    ("Apache-2.0", ["apache2-short", "apache2-may-not", "apache2-copy"]),
    ("Apache-2.0", ["apache2-short"]),
    *[
        (
            f"{family.upper()}-{version if '.' in version else version + '.0'}",
            [f"{family}{version}-free", *[part.replace("gnu", family) for part in rest]],
        )
        for family, (_, versions) in GNU.items()
        for version in reversed(versions)
        for rest in (
            ["gpl-hope", "gnu-see", "gnu-copy", "gpl-url"],
            ["gpl-hope", "gnu-see", "gnu-copy"],
            [],
        )
    ],
    ("GPL-3.0", ["gpl-free", "gpl3-short"]),
    *[
        (f"{family.upper()}-{version if '.' in version else version + '.0'}", [f"{family}{version}-short"])
        for family, (_, versions) in GNU.items()
        for version in reversed(versions)
    ],
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("MPL-2.0", ["mpl2-short"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liable"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-short"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-thanks", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("Zlib", ["zlib-short"]),
    ("Unlicense", ["unlicense-grant", "unlicense-free"]),
    ("Unlicense", ["unlicense-grant"]),
    ("Unlicense", ["unlicense-short"]),
    ("EPL-2.0", ["epl2-short"]),
    ("EPL-1.0", ["epl1-short"]),
    ("BSL-1.0", ["boost-short"]),
    ("BSD-3-Clause", ["bsd3-short"]),
    ("BSD-2-Clause", ["bsd2-short"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("CC0-1.0", ["cc0-short"]),
    ("MIT", ["mit-short"]),
    *[
        (f"CC-{short.replace(' ', '-').upper()}-{version}", [f"cc-{short.replace(' ', '-')}-{version.removesuffix('.0')}"])
        for short in COMMONS
        for version in COMMONS_VERSIONS
    ],
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["reserved"]),
]
# Every known sentence holds one of these words, so texts without them need no cutting.
CUES = (
    "(?i)licen[sc]e|permission|redistribut|warrant|liable|contributors|domain|reserved|cc[^a-z0-9]+by"
    "|mpl|gnu|misrepresented|acknowledge?ment|may not be removed|anyone is free"
    "|(?:released|distributed|available|provided|published)[^a-z0-9]+under"
)
# What becomes of a text in lower case, in this order. Blank lines are ends of sentences: so become a
# web address, the colon after a licence's conditions, the numeral of a list (dropped) at the start of a
# line or after a mark and a blank, and the marks before a blank or the end. A version keeps its number.
# Nothing here looks ahead or behind, so that any engine of regular expressions does the same.
STEPS = [
    ("\r\n?", "\n"),
    ("(^|[^a-z0-9])v\\.?[ \t]?([0-9])", "$1version $2"),
    ("version[^a-z0-9.\n]*(?:\n[^a-z0-9.\n]*)?([0-9])", "version $1"),
    ("(https?://[^ \t-\r<>]+)", "$1\n\n"),
    ("(conditions|restrictions|are[ \t-\r]{1,9}met)[ \t]?:([ \t-\r]|\\z)", "$1\n\n$2"),
    ("(^|\n)[^a-z0-9\n]*(?:[0-9]{1,2}|[a-z])[.)]([ \t])", "$1\n\n$2"),
    ("([.:;][ \t])[^a-z0-9\n.:;]*(?:[0-9]{1,2}|[a-z])[.)]([ \t])", "$1\n\n$2"),
    ("[.!?]([ \t\n]|\\z)", "\n\n$1"),
    ("[^a-z0-9.\n]+", " "),
    ("\\.{2,}", " "),
    ("\\.([^0-9]|\\z)", " $1"),
    ("(^|[^0-9])\\.", "$1 "),
    (" +", " "),
    (" ?\n ?", "\n"),
    ("\n{2,}", "|"),
    ("\n", "/"),
]


def normalised(text: Column) -> Column:
    """Lower case, anything but letters, digits and dots between digits as one blank.

    The end of a sentence is a bar, a line end within one a slash; the whole stands between bars.
    """
    plain = F.lower(text)
    for pattern, instead in STEPS:
        plain = F.regexp_replace(plain, pattern, instead)
    return F.concat(F.lit("|"), F.trim(plain), F.lit("|"))


def known_pattern(known: list[str], blank: str) -> str:
    """A pattern of any of these texts, the longest first; ``blank`` is a blank or the end of a line."""
    longest = sorted(known, key=lambda text: (-len(text), text))
    return "|".join(text.replace(".", "\\.").replace(" ", blank) for text in longest)


def sentence_ids(
    text: Column, sentences: dict[str, list[str]] = SENTENCES, names: dict[str, list[str]] = NAMES
) -> Column:
    """Identifiers of the sentences of a text in order, null for what is unknown between them.

    A known sentence begins and ends where a line or sentence does, and may be wrapped. A notice
    begins and ends with a word.
    """
    whole, named = (
        {known: name for name, listed in table.items() for known in listed} for table in (sentences, names)
    )
    tables = [F.create_map(*[F.lit(part) for pair in table.items() for part in pair]) for table in (whole, named)]
    pattern = (
        f"(?<=[|/])(?:{known_pattern(list(whole), '[ /]')})(?=[|/])"
        f"|(?<=[|/ ]){NOTICE.replace(' ', '[ /]')}(?:{known_pattern(list(named), '[ /]')})(?=[|/ ])"
    )

    def identifier(known: Column) -> Column:
        return F.coalesce(
            F.try_element_at(tables[0], known),
            F.try_element_at(tables[1], F.regexp_replace(known, f"^{NOTICE}", "")),
        )

    def placed(plain: Column) -> Column:
        gaps = F.split(plain, pattern, -1)
        found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(
            gaps,
            found,
            lambda gap, known: F.array(
                F.when(gap.rlike("[a-z0-9]"), "-"), identifier(F.translate(known, "/", " "))
            ),
        )
        return F.filter(F.flatten(pairs), lambda name: name.isNotNull())

    return F.transform(let(normalised(text), placed), lambda name: F.nullif(name, F.lit("-")))


def scan_licences(
    documents: DataFrame,
    sentences: dict[str, list[str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
    names: dict[str, list[str]] = NAMES,
) -> DataFrame:
    """Per document: doc_id, licences, n_licences, n_known and n_left (known, in no rule).

    A map over the rows: no shuffle. ``licences`` is comma-joined text, ``sentence_ids`` the
    known identifiers in order.
    """
    text = F.col("text")
    ids = F.when(text.rlike(CUES), sentence_ids(text, sentences, names)).otherwise(
        F.array().cast("array<string>")
    )
    # One name between bars each; a gap is an empty name, several gaps in a row are one.
    line = F.concat(
        F.lit("|"), F.array_join(F.transform("_ids", lambda i: F.coalesce(i, F.lit("-"))), "||"), F.lit("|")
    )
    taken = F.col("_line")
    for licence, parts in rules:
        taken = F.replace(
            taken, F.lit("".join(f"|{part}|" for part in parts)), F.lit(f"|={licence}|")
        )
    named = F.regexp_extract_all("_taken", F.lit("\\|=([^|]+)\\|"), F.lit(1))
    left = F.regexp_extract_all("_taken", F.lit("\\|([^|=-][^|]*)\\|"), F.lit(1))
    return (
        documents.select("doc_id", ids.alias("_ids"))
        .select("doc_id", F.col("_ids"), line.alias("_line"))
        .select("doc_id", "_ids", taken.alias("_taken"))
        .select(
            "doc_id",
            F.array_join(named, ",").alias("licences"),
            F.size(named).cast("long").alias("n_licences"),
            F.size(F.array_compact("_ids")).cast("long").alias("n_known"),
            F.size(left).cast("long").alias("n_left"),
            F.array_join(F.array_compact("_ids"), ",").alias("sentence_ids"),
        )
    )
