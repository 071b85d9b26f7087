"""License scans: ordered signature rules over a text's words, in DataFrame functions only.

A text is reduced to its lower-case words, joined by single spaces. Each rule is
a regex over that form with a keyword, a priority (0 is strongest) and a label.
A cheap test on the raw text and then the rule's keyword decide whether a rule
runs at all. A detection is suppressed if another of the same or a stronger
priority covers its interval; the labels of what is left are the text's.

All of it is a projection: no shuffle, no join, one row in and one row out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh

# Label, keyword, and the licence's name as a regex over words.
NAMES = [
    ("mit", "mit", "mit"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?"),
    ("gpl-2.0", "gnu", "gnu (?:general public license|gpl)(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "gnu", "gnu (?:general public license|gpl)(?: version| v)? 3(?: 0)?"),
    ("gpl-2.0", "gpl", "gpl(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "gpl", "gpl(?: version| v)? 3(?: 0)?"),
    ("gpl-2.0", "gplv2", "gplv2"),
    ("gpl-3.0", "gplv3", "gplv3"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public license(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", "lgpl", "lgpl(?: version| v)? 2 1"),
    ("lgpl-3.0", "lgpl", "lgpl(?: version| v)? 3(?: 0)?"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?"),
    ("agpl-3.0", "agpl", "agpl(?: version| v)? 3(?: 0)?"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license(?: version| v)? 1 3"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", "0bsd"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?"),
    ("mpl-2.0", "mpl", "mpl(?: version| v)? 2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1 0"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("cddl-1.0", "distribution", "common development and distribution license(?: version| v)? 1 0"),
    ("eupl-1.2", "union", "european union public licen[cs]e(?: version| v)? 1 2"),
    ("artistic-1.0", "artistic", "artistic license(?: version| v)? 1 0"),
    ("artistic-2.0", "artistic", "artistic license(?: version| v)? 2 0"),
    ("bsl-1.0", "boost", "boost software license(?: version| v)? 1 0"),
    ("busl-1.1", "business", "business source license(?: version| v)? 1 1"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2.0", "python", "python software foundation(?: license)?(?: version| v)?(?: 2)?"),
    ("ruby", "ruby", "ruby"),
    ("php-3.01", "php", "php license(?: version| v)? 3 01"),
    ("openssl", "openssl", "openssl"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version| v)? 1 1"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?"),
    ("cc0-1.0", "zero", "creative commons zero"),
    ("odbl-1.0", "database", "open (?:data commons open )?database license(?: version| v)?(?: 1 0)?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("upl-1.0", "universal", "universal permissive license(?: version| v)?(?: 1 0)?"),
    ("elastic-2.0", "elastic", "elastic license(?: version| v)?(?: 2 0)?"),
    ("sspl-1.0", "server", "server side public license(?: version| v)?(?: 1)?"),
    ("vim", "vim", "vim"),
    ("curl", "curl", "curl"),
    ("afl-3.0", "academic", "academic free license(?: version| v)? 3 0"),
    ("osl-3.0", "open", "open software license(?: version| v)? 3 0"),
]
# The Creative Commons attribution terms, as words and as a label.
CC_TERMS = {"by": "by", "by sa": "by-sa", "by nd": "by-nd", "by nc": "by-nc", "by nc sa": "by-nc-sa", "by nc nd": "by-nc-nd"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Sentences of licence texts and notices, written by hand: label, keyword, regex, priority.
SENTENCES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 1),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", 0),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 0),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license", 0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 1),
    ("boost", "boost", "distributed under the boost software license", 1),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty", 1),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential)", 2),
    ("commercial", "commercial", "(?:commercial license|licensed for commercial use)", 2),
    ("gpl", "general", "gnu general public license", 2),
    ("lgpl", "lesser", "lesser general public license", 2),
    ("agpl", "affero", "affero general public license", 2),
    ("mpl", "mozilla", "mozilla public license", 3),
    ("cc", "creative", "creative commons(?: attribution)?(?: license)?", 3),
    ("apache-2.0", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1),
    ("apache-2.0", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements", 0),
    ("apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 0),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 1),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0),
    ("mit", "noninfringement", "the warranties of merchantability fitness for a particular purpose and noninfringement", 2),
    ("mit", "liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 1),
    ("mit", "restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 0),
    ("mit-cmu", "advertising", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", 1),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising", 0),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 0),
    ("isc", "tortious", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", 1),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0),
    ("bsd-3-clause", "endorse", "neither the name of the (?:copyright holder|university|organization|author) nor the names of its contributors may be used to endorse or promote products", 0),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0),
    ("bsd", "regents", "provided by the regents and contributors as is and any express or implied warranties", 0),
    ("bsd", "style", "bsd style license", 2),
    ("bsd", "bsd", "(?:the )?bsd license", 3),
    ("gpl", "version", "either version (?:2|3) of the license or at your option any later version", 1),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this", 0),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public license along with this", 0),
    ("agpl", "received", "you should have received a copy of the gnu affero general public license along with this", 0),
    ("gpl", "hope", "distributed in the hope that it will be useful but without any warranty", 1),
    ("gpl-2.0", "gpl", "gpl 2 0 (?:only|or later)", 1),
    ("gpl-3.0", "gpl", "gpl 3 0 (?:only|or later)", 1),
    ("lgpl-2.1", "lgpl", "lgpl 2 1 (?:only|or later)", 1),
    ("lgpl-3.0", "lgpl", "lgpl 3 0 (?:only|or later)", 1),
    ("agpl-3.0", "agpl", "agpl 3 0 (?:only|or later)", 1),
    ("gpl-classpath", "classpath", "(?:gpl|general public license) with (?:the )?classpath exception", 0),
    ("gpl-classpath", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library", 0),
    ("gpl-font", "embed", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document", 0),
    ("gpl-autoconf", "autoconf", "(?:as a special exception|with) (?:the )?autoconf exception", 1),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 0),
    ("gfdl", "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0),
    ("mpl-2.0", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at", 0),
    ("mpl-1.1", "rights", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations", 1),
    ("mpl-tri", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license", 0),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0),
    ("cddl", "distribution", "common development and distribution license", 3),
    ("cddl", "cddl", "cddl", 3),
    ("cpl-1.0", "common", "common public license(?: version| v)? 1 0", 1),
    ("ipl-1.0", "ibm", "ibm public license(?: version| v)? 1 0", 1),
    ("eupl", "eupl", "licensed under the eupl", 1),
    ("cecill", "cecill", "cecill(?: [bc])?(?: license)?(?: version| v)? (?:1|2)", 1),
    ("artistic", "perl", "(?:same terms as|under the same terms as) perl itself", 0),
    ("artistic", "artistic", "the (?:clarified )?artistic license", 2),
    ("boost", "obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0),
    ("libpng", "png", "(?:the )?png reference library license", 1),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group", 0),
    ("freetype", "freetype", "(?:the )?freetype (?:project )?license", 1),
    ("icu", "icu", "icu license(?: icu 1 8 1 and later)?", 1),
    ("unicode", "unicode", "unicode (?:inc )?license agreement", 1),
    ("w3c", "w3c", "w3c software (?:and document )?notice and license", 1),
    ("openssl", "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 0),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young", 0),
    ("python-2.0", "psf", "psf license agreement for python", 0),
    ("ruby", "ruby", "(?:the )?ruby license", 2),
    ("php", "freely", "this product includes php software freely available from", 0),
    ("wtfpl", "want", "do what the fuck you want to public license", 0),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 0),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software", 0),
    ("cc0-1.0", "waived", "(?:has|have) waived all copyright and related or neighboring rights", 0),
    ("cc0-1.0", "dedicated", "dedicated (?:this work )?to the public domain by waiving all", 0),
    ("public-domain", "domain", "(?:is|are|was) (?:hereby )?in the public domain", 1),
    ("public-domain", "copyright", "the author(?:s)? disclaims? copyright to this source code", 0),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license", 0),
    ("ofl-1.1", "reserved", "with reserved font name", 1),
    ("odbl", "odbl", "open database license odbl", 1),
    ("pddl-1.0", "pddl", "(?:open data commons )?public domain dedication and license pddl", 0),
    ("odc-by", "attribution", "open data commons attribution license", 0),
    ("ogl-uk", "government", "open government licen[cs]e(?: version| v)? (?:1|2|3)", 1),
    ("etalab", "ouverte", "(?:etalab )?licence ouverte(?: open licence)?", 1),
    ("bsl", "business", "the business source license this document or the license is not an open source license", 0),
    ("sspl", "service", "if you make the functionality of the program or a modified version available to third parties as a service", 0),
    ("elastic", "hosted", "you may not provide the software to third parties as a hosted or managed service", 0),
    ("commons-clause", "commons", "commons clause(?: license condition)?(?: v1 0| version 1 0)?", 1),
    ("polyform", "polyform", "polyform (?:noncommercial|strict|shield|small business|perimeter|internal use) license", 0),
    ("rail", "rail", "(?:open|bigscience|creativeml) (?:open )?rail(?: m)?(?: license)?", 1),
    ("community", "community", "(?:this )?community license agreement", 2),
    ("research-only", "research", "(?:for )?(?:non commercial |noncommercial )?research (?:use|purposes) only", 2),
    ("non-commercial", "commercial", "for non commercial use only", 2),
    ("proprietary", "reserved", "all rights reserved(?: worldwide)?", 3),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)", 1),
    ("proprietary", "trade", "contains (?:valuable )?trade secrets", 2),
    ("proprietary", "eula", "end user license agreement eula", 1),
    ("commercial", "evaluation", "evaluation (?:version|license) only", 2),
    ("patent-grant", "patent", "additional grant of patent rights", 1),
    ("cla", "contributor", "contributor license agreement", 3),
    ("spdx-file", "spdx", "spdx filecopyrighttext", 2),
    ("see-license", "copying", "see (?:the )?(?:file )?copying(?: lesser| lib)?(?: for details)?", 3),
    ("see-license", "notice", "see (?:the )?notice file", 3),
    ("see-license", "license", "(?:see|refer to) (?:the )?license(?: file| txt| md)?(?: for (?:details|more information))?", 3),
]
# The base phrases and their labels.
BASE = [("mit", "license", "mit license"), ("apache", "license", "apache license"), ("gpl", "license", "general public license")]

#: How sure a detection of each priority is.
SURENESS = [1.0, 0.95, 0.8, 0.5]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules() -> list[dict]:
    """All rules in order: names in five forms each, Creative Commons terms and versions, sentences, base phrases."""
    names = list(NAMES)
    for words, term in CC_TERMS.items():
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            names.append((f"cc-{term}-{version}", "cc", f"cc {words} {number}"))
        spelled = words.replace("by", "attribution").replace("nc", "non ?commercial").replace("sa", "share ?alike").replace("nd", "no ?deriv(?:ative)?s")
        names.append((f"cc-{term}", "commons", f"creative commons {spelled}"))
    forms = [
        ("spdx license identifier {}", 0),
        ("(?:licensed|released|distributed|available|published|provided) (?:to you )?under (?:the )?(?:terms of the )?{}(?: licen[cs]e)?", 1),
        ("(?:subject to|governed by|covered by) (?:the )?(?:terms of the )?{}(?: licen[cs]e)?", 1),
        ("licen[cs]e {}", 2),
        ("{} licen[cs]ed?", 2),
    ]
    found = [(label, kw, form.format(name), p, False) for label, kw, name in names for form, p in forms]
    found += [(label, "cc", name, 2, False) for label, kw, name in names if kw == "cc"]
    found += [(label, kw, name, p, False) for label, kw, name, p in SENTENCES]
    found += [(label, kw, name, 3, True) for label, kw, name in BASE]
    return [{"rule": i, "label": a, "kw": k, "pattern": f" ({n})(?= )", "priority": p, "base": b} for i, (a, k, n, p, b) in enumerate(found)]


#: What a match of each form of a name holds besides the name's keyword.
CLUES = [["spdx"], ["under"], ["subject", "governed", "covered"], ["licen"], ["licen"]]


def gate(lowered: Column) -> Column:
    """Whether a text in lower case may hold a match: each rule's match holds the rule's keyword, and a name's form one of its clues."""

    def holds(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(lowered, F.lit(w))
        return found

    clues = holds(sorted({c for form in CLUES for c in form}))
    names = holds(sorted({kw for _, kw, _ in NAMES} | {"cc", "commons"}))
    others = holds(sorted({kw for _, kw, _, _ in SENTENCES} | {kw for _, kw, _ in BASE}))
    return others | (clues & names) | (F.contains(lowered, F.lit("cc")) & lowered.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))


_HIT = "struct<start:int,back:int,priority:int,rule:int,label:string,base:boolean>"
#: Neither mark is in a word.
_OPEN, _CLOSE = "\x01", "\x02"
_BLOCK = 256


def _hits(norm: Column, chosen: Column) -> Column:
    """All places of the chosen rules: word numbers from 0, ``back`` is the end (exclusive), negated for sorting.

    A rule's matches are marked in the text, so that their bounds are the numbers of the words that bear a mark.
    """
    marked = F.transform(chosen, lambda r: F.struct(r.alias("r"), F.regexp_replace(norm, r["pattern"], F.lit(f" {_OPEN}$1{_CLOSE}")).alias("text")))
    met = F.filter(marked, lambda m: F.contains(m["text"], F.lit(_OPEN)))
    worded = F.transform(met, lambda m: F.struct(m["r"].alias("r"), F.split(m["text"], " ").alias("w")))

    def numbers(m: Column, mark: str) -> Column:
        at = F.transform(m["w"], lambda w, i: F.when(F.contains(w, F.lit(mark)), i))
        return F.filter(at, lambda i: i.isNotNull())

    def bounds(m: Column) -> Column:
        return F.arrays_zip(numbers(m, _OPEN).alias("a"), numbers(m, _CLOSE).alias("b"))

    def places(m: Column) -> Column:
        r = m["r"]
        # The text begins with a blank, so that its first word has number 1 here.
        hit = lambda x: F.struct((x["a"] - 1).alias("start"), (-x["b"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["base"].alias("base"))
        return F.transform(bounds(m), hit)

    return F.flatten(F.transform(worded, places))


def _suppressed(hits: Column) -> Column:
    """Hits that no other hit of the same or a stronger priority covers. ``hits`` are sorted, so what covers one stands before it.

    They are folded in blocks: arrays grow within a block and by a block, so that the copying stays small for long texts.
    """
    levels = range(len(SURENESS))
    none = F.array().cast(f"array<{_HIT}>")
    least = [F.lit(0).alias(f"m{p}") for p in levels]

    def step(acc: Column, h: Column) -> Column:
        reach = F.element_at(F.array(*[acc[f"m{p}"] for p in levels]), h["priority"] + 1)
        grown = [F.when(h["priority"] <= p, F.greatest(acc[f"m{p}"], -h["back"])).otherwise(acc[f"m{p}"]).alias(f"m{p}") for p in levels]
        return F.struct(*grown, F.when(reach >= -h["back"], acc["out"]).otherwise(F.concat(acc["out"], F.array(h))).alias("out"))

    def fold(acc: Column, block: Column) -> Column:
        start = F.struct(*[acc["now"][f"m{p}"].alias(f"m{p}") for p in levels], none.alias("out"))
        return F.struct(F.aggregate(block, start, step).alias("now"), F.concat(acc["done"], F.array(acc["now"]["out"])).alias("done"))

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hits), F.lit(1)), F.lit(_BLOCK)), lambda i: F.slice(hits, i, _BLOCK))
    empty = F.struct(F.struct(*least, none.alias("out")).alias("now"), F.array().cast(f"array<array<{_HIT}>>").alias("done"))
    return F.aggregate(blocks, empty, fold, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]["out"]))))


#: The columns that a scan adds.
MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_hits")


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``license_hits``.

    ``license_hits`` has the detections that were not suppressed: start and end (in words), priority, rule,
    label. Base phrases count wherever their words stand consecutively, suppressed or not. A null text counts
    as empty: no words, no labels (empty strings), score 0. Of detections of one interval and priority the
    first rule's stays. Columns of ``df`` with these names are replaced, all others pass through; any number of rows, repeated or not,
    stay as they are, and an empty table stays empty. Whole texts are scanned; time grows nearly in proportion
    to a text's length (a text of a million letters with 83,000 notices takes about ten seconds).
    """
    schema = "array<struct<rule:int,label:string,kw:string,pattern:string,priority:int,base:boolean>>"
    table = F.from_json(F.lit(json.dumps(rules())), schema)
    keywords = F.lit(sorted({r["kw"] for r in rules()}))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lowered = F.translate(text, UPPER, LOWER)
    own = dict(zip(("words", "kws", "norm", "hits", "kept", "base"), fresh([*df.columns, *MADE], "words", "kws", "norm", "hits", "kept", "base")))
    out = df.withColumn("n_words", F.size(F.regexp_extract_all(text, F.lit(WORD.replace(r"\x60", r"\x40\x5B-\x60")), F.lit(0))).cast("long"))
    out = out.withColumn(own["words"], F.when(gate(lowered), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))))
    out = out.withColumn(own["kws"], F.array_intersect(own["words"], keywords))
    chosen = F.filter(table, lambda r: F.array_contains(own["kws"], r["kw"]))
    out = out.withColumn(own["norm"], F.when(F.size(own["kws"]) > 0, F.concat(F.lit(" "), F.array_join(own["words"], " "), F.lit(" "))))
    out = out.withColumn(own["hits"], F.when(F.col(own["norm"]).isNotNull(), F.array_sort(_hits(F.col(own["norm"]), chosen))))
    out = out.withColumn(own["hits"], F.coalesce(own["hits"], F.array().cast(f"array<{_HIT}>")))
    out = out.withColumn(own["kept"], _suppressed(F.col(own["hits"]))).withColumn(own["base"], F.filter(own["hits"], lambda h: h["base"]))
    labels = F.array_union(F.transform(own["kept"], lambda h: h["label"]), F.transform(own["base"], lambda h: h["label"]))
    sure = F.array(*[F.lit(s) for s in SURENESS])
    out = out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in MADE],
        "n_words",
        F.size(own["base"]).cast("long").alias("n_base"),
        F.array_min(F.transform(own["base"], lambda h: h["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(own["base"], lambda h: h["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(own["base"], lambda h: h["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(own["kept"], lambda h: F.element_at(sure, h["priority"] + 1))), F.lit(0.0)).alias("score"),
        F.transform(own["kept"], lambda h: F.struct(h["start"].alias("start"), (-h["back"]).alias("end"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label"))).alias("license_hits"),
    )
    return out
