"""Licence scans by sentence rules [DataFrame functions only].

A text is normalised, and the runs of its words that are known licence sentences are mapped to
identifiers. A sentence begins and ends at closing marks or line breaks, and may run over single
line breaks, colons and semicolons, so wrapped and unwrapped texts give the same; the text's sequence of identifiers is then matched against ordered licence rules. Both tables are small
constants, so a scan is one projection over the documents: no shuffle, no Python.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Known one-line notices as normalised (lower case, letters, digits and dots inside
#: numbers, single spaces), and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-condition",
    "licensed under the apache license version 2.0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-2-condition",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it": "gpl-freedom",
    "under the terms of the gnu general public license version 3": "gpl-3-terms",
    "under the terms of the gnu general public license version 2": "gpl-2-terms",
    "licensed under cc by nc 4.0": "cc-by-nc-4-notice",
    "licensed under cc by 4.0": "cc-by-4-notice",
    "licensed under cc by sa 4.0": "cc-by-sa-4-notice",
    "redistribution and use in source and binary forms are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder may be used to endorse products": "bsd-name",
    "this work is in the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

_BSD = "redistributions {} the above copyright notice this list of conditions and the following disclaimer"
_FREE = "* is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation {}"
_VERSION = ("either version {} of the license or at your option any later version", "either version {} of the license or at your option any later version of the license", "version {} of the license", "version {}")
_CREATIVE = {"attribution": "cc-by", "attribution sharealike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "attribution noncommercial sharealike": "cc-by-nc-sa", "attribution noderivatives": "cc-by-nd", "attribution noncommercial noderivatives": "cc-by-nc-nd"}
#: Tags that files may name their licence by, and the licence.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "Zlib": "Zlib", "MPL-2.0": "MPL-2.0", "BSL-1.0": "BSL-1.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1",
    "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
#: Licences as notices name them.
_NAMED = {"mit license": "mit-notice", "mit licence": "mit-notice", "apache license version 2.0": "apache-2-notice", "apache license 2.0": "apache-2-notice"}
_APACHE = "apache license version 2.0 january 2004"

#: Sentences of the licences' full texts and headers, normalised in the same way; * stands for a
#: name of one to twelve words.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    _BSD.format("of source code must retain"): "bsd-source",
    _BSD.format("in binary form must reproduce") + " in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "licensed under the apache license version 2.0 the license": "apache-2-notice",
    _APACHE: "apache-2-title",
    _APACHE + " http www apache org licenses": "apache-2-title",
    _APACHE + " http www apache org licenses terms and conditions for use reproduction and distribution 1": "apache-2-title",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache-2-grant",
    "gnu general public license version 3 29 june 2007": "gpl-3-title",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl-3-title",
    "preamble the gnu general public license is a free copyleft license for software and other kinds of works": "gpl-3-title",
    "gnu general public license version 2 june 1991": "gpl-2-title",
    "this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it": "gpl-2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3-title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl-2.1-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3-title",
    "mozilla public license version 2.0": "mpl-2-title",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-header",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0": "mpl-2-source",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0": "mpl-2-source",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "boost software license version 1.0 august 17th 2003": "bsl-1-title",
    "distributed under the boost software license version 1.0": "bsl-1-notice",
    "to the extent possible under law * has waived all copyright and related or neighboring rights to *": "cc0-waiver",
    **{f"{begin} creative commons {kind} 4.0 {form}license": f"{name}-4-text" for kind, name in _CREATIVE.items() for begin in ("this work is licensed under a", "this work is licensed under the", "licensed under a") for form in ("international ", "international public ", "")},
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    # notices inside a longer sentence: of something, or with what follows
    **{f"{begin}licensed under the {name}{end}": i for begin in ("", "* is ", "* are ") for end in ("", " *") for name, i in _NAMED.items() if begin or end},
    # tags, alone or with what an expression adds; of alternatives the first counts
    **{f"{begin} {tag.lower().replace('-', ' ')}{end}": f"spdx-{tag.lower()}" for tag in SPDX for begin, end in (("spdx license identifier", ""), ("spdx license identifier", " *"), ("license", ""))},
    **{_FREE.format(kind, v.format(n)): f"{name}-{n}-header" for kind, name, n in (("", "gpl", "3"), ("", "gpl", "2"), ("lesser ", "lgpl", "3"), ("lesser ", "lgpl", "2.1"), ("affero ", "agpl", "3")) for v in _VERSION},
}


@dataclass(frozen=True)
class LicenceRule:
    """``sequence`` of sentence identifiers in this order, others may stand between them."""

    licence: str
    sequence: tuple[str, ...]

    def fits(self, found: Column) -> Column:
        """``found``: the identifiers with a space around each."""
        return found.rlike("(?s)" + ".*".join(f" {s} " for s in self.sequence))


#: In order: the first that fits names the licence, so fuller sequences stand before their parts.
RULES = (
    LicenceRule("GPL-3.0", ("gpl-freedom", "gpl-3-terms")),
    LicenceRule("GPL-2.0", ("gpl-freedom", "gpl-2-terms")),
    LicenceRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    LicenceRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    LicenceRule("MIT", ("mit-grant", "mit-condition")),
    LicenceRule("Apache-2.0", ("apache-2-notice", "apache-2-condition")),
    LicenceRule("GPL-3.0", ("gpl-3-notice",)),
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    LicenceRule("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    LicenceRule("CC-BY-4.0", ("cc-by-4-notice",)),
    LicenceRule("Apache-2.0", ("apache-2-notice",)),
    LicenceRule("MIT", ("mit-notice",)),
    LicenceRule("MIT", ("mit-grant",)),
    LicenceRule("public-domain", ("public-domain",)),
    LicenceRule("proprietary", ("all-rights-reserved",)),
)

#: Rules of the full texts; they stand before those of the notices. A full GNU text ends with a
#: header for programs, and the lesser and Affero ones may quote the general one.
TEXT_RULES = (
    *(LicenceRule(licence, (f"{i}-{kind}",)) for kind in ("title", "header") for licence, i in (("AGPL-3.0", "agpl-3"), ("LGPL-3.0", "lgpl-3"), ("LGPL-2.1", "lgpl-2.1"), ("GPL-3.0", "gpl-3"), ("GPL-2.0", "gpl-2"))),
    LicenceRule("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    LicenceRule("Apache-2.0", ("apache-2-title",)),
    LicenceRule("Apache-2.0", ("apache-2-grant",)),
    *(LicenceRule(licence, (f"spdx-{tag.lower()}",)) for tag, licence in SPDX.items()),
    LicenceRule("MPL-2.0", ("mpl-header", "mpl-2-source")),
    LicenceRule("MPL-2.0", ("mpl-2-title",)),
    *(LicenceRule(f"{name.upper()}-4.0", (f"{name}-4-text",)) for name in _CREATIVE.values()),
    LicenceRule("CC0-1.0", ("cc0-waiver",)),
    LicenceRule("ISC", ("isc-grant",)),
    LicenceRule("Zlib", ("zlib-grant",)),
    LicenceRule("Unlicense", ("unlicense-notice",)),
    LicenceRule("BSL-1.0", ("bsl-1-title",)),
    LicenceRule("BSL-1.0", ("bsl-1-notice",)),
)

#: Marks in normalised text: an end of a sentence, and a place where one may end or go on.
END, MAY_END = "\x01", "\x02"
#: In this order: pattern and what takes its place. No pattern repeats a group, so that a long run
#: of any character costs neither stack nor a second pass over it.
NORMALISED = (
    (r"[\x01\x02]", "-"),
    (r"\r\n?", "\n"),
    (r"[.!?]\s", END),
    (r"\n[^a-z0-9\n\x01]*+\n", END),
    (r"\n|[;:][ \t]", MAY_END),
    (r"[^a-z0-9.\x01\x02]+|\.+(?![0-9])", " "),
    (r" +", " "),
    (r"(?<! ) ?\x02[ \x02]*", MAY_END),
    (r" ?\x01[ \x01]*", END),
)


def normalised(text: Column) -> Column:
    """The words of a text with one blank, ``MAY_END`` or ``END`` marks between two of them."""
    out = F.concat(F.lit(END), F.regexp_replace(F.lower(text), NORMALISED[0][0], NORMALISED[0][1]), F.lit(END))
    for pattern, mark in NORMALISED[1:]:
        out = F.regexp_replace(out, pattern, mark)
    return out


def pattern_of(sentence: str, between: str = r"[ \x02]") -> str:
    """A known sentence in normalised text; a name at its beginning does not run over lines."""
    words = [w.replace(".", r"\.") for w in sentence.split(" ")]
    name = lambda gap: rf"(?:[a-z0-9.]+{gap}){{0,11}}?[a-z0-9.]+"
    return between.join(name(between if at else " ") if w == "*" else w for at, w in enumerate(words))


#: A cheap test first: only texts with a word of the known sentences are taken apart.
MAYBE = r"(?i)licen[sc]e|permission|redistribut|copyright|advertising|public[^a-z0-9]+domain|rights[^a-z0-9]+reserved"


def by_length(sentences: dict[str, str]) -> list[str]:
    """The longest first: where one begins another, that is the one that is meant."""
    return sorted(sentences, key=lambda x: (-len(x), x))


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order, repeats included. Where one begins
    another the longest counts."""
    sentences = {**SENTENCES, **TEXTS} if sentences is None else sentences
    maybe = text.rlike(MAYBE)
    longest = by_length(sentences)
    found = F.regexp_extract_all(normalised(text), F.lit(rf"(?<=[\x01\x02])(?:{'|'.join(map(pattern_of, longest))})(?=[\x01\x02])"), F.lit(0))
    known = F.create_map(*(F.lit(x) for x, i in sentences.items() if "*" not in x for x in (x, i)))

    def named(run: Column) -> Column:
        plain = F.translate(run, MAY_END, " ")
        of_names = [F.when(plain.rlike(f"^(?:{pattern_of(x)})$"), i) for x, i in sentences.items() if "*" in x]
        return F.coalesce(F.element_at(known, plain), *of_names)

    return F.when(maybe, F.transform(found, named)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, rules: Sequence[LicenceRule] = TEXT_RULES + RULES, sentences: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_sentences (known licence sentences), sentence_ids
    (joined by spaces) and licence: the first rule's that fits, null where none does. A null text
    has no sentences; repeated rows stay, each with its own result."""
    ids = docs.select("doc_id", F.coalesce(sentence_ids(F.col("text"), sentences), F.array().cast("array<string>")).alias("ids"))
    spaced = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    licence = F.lit(None).cast("string")
    for rule in reversed(rules):
        licence = F.when(rule.fits(F.col("spaced")), rule.licence).otherwise(licence)
    found = ids.withColumn("spaced", spaced)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), licence.alias("licence"))
