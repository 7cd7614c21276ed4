"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased and cut into words once. Only if one of a few words is among them is it put
together again, words one space apart, and given to the rules whose own keyword it contains. Each detection is an interval of words; one that lies inside an
interval of the same or a higher priority is suppressed. One scan, no shuffle, no Python.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.columns import let, once

#: Between words of a text in lower case: ASCII characters that are neither digits nor letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted as they stand, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """regex is applied to lower-case words one space apart and must match whole words."""

    label: str
    keyword: str
    regex: str
    priority: int
    score: float


#: Licenses with versions: label stem, keyword, regex of the name, versions. Whatever the regex
#: matches contains the keyword: names without a common one are entries of their own.
VERSIONED = (
    ("apache", "apache", "apache (?:software )?license", ("1.0", "1.1", "2.0")),
    ("gpl", "gpl", "gnu gpl|gpl", ("1.0", "2.0", "3.0")),
    ("gpl", "general public", "gnu general public license", ("1.0", "2.0", "3.0")),
    ("lgpl", "gpl", "gnu lgpl|lgpl", ("2.0", "2.1", "3.0")),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public license", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", "gnu agpl|agpl", ("1.0", "3.0")),
    ("agpl", "affero", "(?:gnu )?affero general public license", ("1.0", "3.0")),
    ("gfdl", "free documentation", "(?:gnu )?free documentation license", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", "mozilla public license", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", "eclipse public license", ("1.0", "2.0")),
    ("cddl", "common development", "common development and distribution license", ("1.0", "1.1")),
    ("cpl", "common public", "common public license", ("1.0",)),
    ("eupl", "european union", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
    ("osl", "open software", "open software license", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", "academic free", "academic free license", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", "artistic license", ("1.0", "2.0")),
    ("bsl", "boost", "boost software license", ("1.0",)),
    ("ofl", "open font", "(?:sil )?open font license", ("1.0", "1.1")),
    ("cecill", "cecill", "cecill(?: free software license(?: agreement)?)?", ("1.0", "1.1", "2.0", "2.1")),
    ("ecl", "educational community", "educational community license", ("1.0", "2.0")),
    ("zpl", "zope", "zope public license", ("1.1", "2.0", "2.1")),
    ("psf", "python software", "python software foundation license", ("2.0",)),
    ("php", "php license", "php license", ("3.0", "3.01")),
    ("lppl", "latex project", "latex project public license", ("1.0", "1.1", "1.2", "1.3")),
    ("odbl", "open database", "open database license", ("1.0",)),
    ("upl", "universal permissive", "universal permissive license", ("1.0",)),
    ("rpl", "reciprocal public", "reciprocal public license", ("1.1", "1.5")),
    ("busl", "business source", "business source license", ("1.0", "1.1")),
    ("sspl", "server side public", "server side public license", ("1.0",)),
    ("elastic", "elastic", "elastic license", ("2.0",)),
)

#: Creative Commons: elements of the label, and their words.
COMMONS = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Signatures without versions: label, keyword, regex, priority, score.
SINGLE = (
    ("mit", "mit license", "(?:released |licensed |distributed )?(?:under )?(?:the )?(?:terms of the )?mit license", 60, 0.95),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 80, 1.0),
    ("mit-0", "mit no attribution", "mit no attribution", 70, 0.95),
    ("bsd", "bsd license", "bsd license", 40, 0.8),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: license)?|bsd 2 clause(?: license)?|simplified bsd license", 60, 0.95),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: license)?|bsd 3 clause(?: license)?|(?:new|modified|revised) bsd license", 60, 0.95),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: license)?|bsd 4 clause(?: license)?|original bsd license", 60, 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 50, 0.9),
    ("bsd-3-clause", "neither the name of", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse", 70, 0.95),
    ("isc", "isc license", "isc license", 60, 0.95),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose", 80, 1.0),
    ("zlib", "zlib", "zlib(?: libpng)? license", 60, 0.95),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 80, 1.0),
    ("unlicense", "unlicense", "the unlicense|unlicense org", 60, 0.95),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 80, 1.0),
    ("wtfpl", "what the fuck", "do what the fuck you want to public license", 80, 1.0),
    ("wtfpl", "wtfpl", "wtfpl", 60, 0.9),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 60, 0.95),
    ("cc0-1.0", "creative commons", "creative commons (?:zero|public domain dedication)", 60, 0.95),
    ("public-domain", "public domain", "(?:released into|placed in|dedicated to|in) the public domain", 40, 0.7),
    ("apache", "apache license", "apache license", 30, 0.8),
    ("gpl", "general public license", "general public license", 20, 0.7),
    ("gpl", "gnu general", "gnu general public license", 30, 0.8),
    ("lgpl", "general public license", "(?:gnu )?(?:lesser|library) general public license", 40, 0.85),
    ("agpl", "affero", "(?:gnu )?affero general public license", 40, 0.85),
    ("mpl", "mozilla public", "mozilla public license", 30, 0.8),
    ("epl", "eclipse public", "eclipse public license", 30, 0.8),
    ("artistic", "artistic license", "artistic license", 30, 0.8),
    ("postgresql", "postgresql", "postgresql licen[cs]e", 60, 0.95),
    ("openssl", "openssl", "openssl license", 60, 0.95),
    ("curl", "curl license", "curl license", 60, 0.95),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license", 60, 0.95),
    ("ms-pl", "microsoft public", "microsoft public license", 60, 0.95),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal license", 60, 0.95),
    ("json", "for good not evil", "the software shall be used for good not evil", 80, 1.0),
    ("beerware", "beer", "beer ?ware license|the beer ?ware", 60, 0.9),
    ("vim", "vim license", "vim license", 60, 0.95),
    ("ruby", "ruby license", "ruby license", 60, 0.9),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 10, 0.5),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 10, 0.4),
)


#: Names of licenses, written as they are said: label and words. Their first two words are the keyword.
NAMED = (
    ("aal", "attribution assurance license"), ("abstyles", "abstyles license"), ("adobe-glyph", "adobe glyph list license"), ("adobe-source", "adobe source code license"), ("afmparse", "afmparse license"),
    ("aladdin", "aladdin free public license"), ("aml", "apple mit license"), ("apafml", "adobe postscript afm license"), ("apl-1.0", "adaptive public license"), ("apsl", "apple public source license"),
    ("bahyph", "bahyph license"), ("barr", "barr license"), ("bittorrent", "bittorrent open source license"), ("blueoak", "blue oak model license"), ("borceux", "borceux license"), ("bsd-protection", "bsd protection license"),
    ("caldera", "caldera license"), ("catosl", "computer associates trusted open source license"), ("cdla-permissive", "community data license agreement permissive"), ("cdla-sharing", "community data license agreement sharing"),
    ("clartistic", "clarified artistic license"), ("commons-clause", "commons clause"), ("condor", "condor public license"), ("cpal", "common public attribution license"), ("cpol", "code project open license"),
    ("crossword", "crossword license"), ("crystalstacker", "crystal stacker license"), ("cua-opl", "cua office public license"), ("cube", "cube license"), ("d-fsl", "deutsche freie software lizenz"),
    ("d-fsl", "german free software license"), ("dotseqn", "dotseqn license"), ("dsdp", "dsdp license"), ("dvipdfm", "dvipdfm license"), ("ecos", "ecos license"), ("efl", "eiffel forum license"),
    ("entessa", "entessa public license"), ("epics", "epics open license"), ("erlpl", "erlang public license"), ("eudatagrid", "eu datagrid software license"), ("eurosym", "eurosym license"), ("fair", "fair license"),
    ("frameworx", "frameworx open license"), ("freeimage", "freeimage public license"), ("giftware", "giftware license"), ("gl2ps", "gl2ps license"), ("glulxe", "glulxe license"), ("gnuplot", "gnuplot license"),
    ("gsoap", "gsoap public license"), ("hpnd", "historical permission notice and disclaimer"), ("icu", "icu license"), ("imagemagick", "imagemagick license"), ("imatix", "imatix license"), ("imlib2", "imlib2 license"),
    ("info-zip", "info zip license"), ("intel", "intel open source license"), ("intel-acpi", "intel acpi software license"), ("interbase", "interbase public license"), ("ipa", "ipa font license"), ("ipl-1.0", "ibm public license"),
    ("jasper", "jasper license"), ("lal", "licence art libre"), ("lal", "free art license"), ("latex2e", "latex2e license"), ("leptonica", "leptonica license"), ("lgpllr", "lesser general public license for linguistic resources"),
    ("libpng", "libpng license"), ("libselinux", "libselinux license"), ("libtiff", "libtiff license"), ("lpl", "lucent public license"), ("makeindex", "makeindex license"), ("mit-cmu", "cmu license"), ("mit-feh", "feh license"),
    ("mitnfa", "mit no false attribs license"), ("motosoto", "motosoto open source license"), ("mpich2", "mpich2 license"), ("multics", "multics license"), ("mup", "mup license"), ("nasa", "nasa open source agreement"),
    ("naumen", "naumen public license"), ("nbpl", "net boolean public license"), ("net-snmp", "net snmp license"), ("netcdf", "netcdf license"), ("ngpl", "nethack general public license"), ("nokia", "nokia open source license"),
    ("nosl", "netizen open source license"), ("noweb", "noweb license"), ("npl", "netscape public license"), ("npos", "non profit open software license"), ("nrl", "nrl license"), ("ntp", "ntp license"),
    ("occt-pl", "open cascade technology public license"), ("oclc", "oclc research public license"), ("odc-by", "open data commons attribution license"), ("ogtsl", "open group test suite license"),
    ("oldap", "openldap public license"), ("opl", "open public license"), ("oset-pl", "oset public license"), ("parity", "parity public license"), ("pdm", "public domain mark"), ("plexus", "plexus classworlds license"),
    ("prosperity", "prosperity public license"), ("psutils", "psutils license"), ("qhull", "qhull license"), ("qpl", "q public license"), ("rhecos", "red hat ecos public license"), ("rpsl", "realnetworks public source license"),
    ("rscpl", "ricoh source code public license"), ("saxpath", "saxpath license"), ("scea", "scea shared source license"), ("sendmail", "sendmail license"), ("sgi-b", "sgi free software license b"),
    ("simpl", "simple public license"), ("sissl", "sun industry standards source license"), ("smppl", "secure messaging protocol public license"), ("snia", "snia public license"), ("spencer", "spencer license"),
    ("spl", "sun public license"), ("sugarcrm", "sugarcrm public license"), ("tcl", "tcl license"), ("tcl", "tcl tk license"), ("tcp-wrappers", "tcp wrappers license"), ("tmate", "tmate open source license"),
    ("torque", "torque software license"), ("tosl", "trusster open source license"), ("unicode-tou", "unicode terms of use"), ("vsl", "vovida software license"), ("x11", "x11 license"), ("x11", "x consortium license"),
    ("xerox", "xerox license"), ("xfree86", "xfree86 license"), ("xinetd", "xinetd license"), ("xnet", "x net license"), ("xpp", "xpp license"), ("xskat", "xskat license"), ("ypl", "yahoo public license"),
    ("zed", "zed license"), ("zimbra", "zimbra public license"),
)

#: Names that are said in several ways: label, keyword, regex.
SAID = (
    ("0bsd", "zero clause", "bsd zero clause license|zero clause bsd(?: license)?"), ("bsd-1-clause", "bsd", "(?:1|one) clause bsd(?: license)?|bsd 1 clause(?: license)?"),
    ("bsd-3-clause-clear", "clear", "clear bsd license|bsd 3 clause clear license"), ("bsd-2-clause-patent", "plus patent", "bsd (?:2 clause )?plus patent license"), ("bzip2", "bzip2", "bzip2(?: and libbzip2)? license"),
    ("cern-ohl", "cern open hardware", "cern open hardware licen[cs]e"), ("cern-ohl-p", "cern open hardware", "cern open hardware licen[cs]e (?:version 2 )?permissive"),
    ("cern-ohl-s", "cern open hardware", "cern open hardware licen[cs]e (?:version 2 )?strongly reciprocal"), ("cern-ohl-w", "cern open hardware", "cern open hardware licen[cs]e (?:version 2 )?weakly reciprocal"),
    ("cnri-python", "cnri", "cnri (?:python|open source)(?: gpl compatible)? license(?: agreement)?"), ("egenix", "egenix", "egenix (?:com )?public license(?: agreement)?"), ("freetype", "freetype", "freetype (?:project )?license"),
    ("glide", "glide", "(?:3dfx )?glide (?:general )?(?:public )?license"), ("haskell-report", "haskell", "haskell (?:language )?report license"), ("ijg", "independent jpeg", "independent jpeg group(?: s)? license"),
    ("ijg", "independent jpeg", "based in part on the work of the independent jpeg group"), ("liliq", "licence libre du", "licence libre du qu(?:é|e)bec"), ("linux-openib", "openib", "openib org bsd license|openib license"),
    ("miros", "miros", "miros licen[cs]e"), ("mulan", "mulan", "mulan (?:psl|permissive software license)(?: v[12])?"), ("nlod", "norwegian", "norwegian licen[cs]e for (?:open government|public) data"),
    ("ogl-uk", "open government", "(?:uk )?open government licen[cs]e"), ("pddl", "open data commons", "open data commons public domain dedication (?:and )?licen[cs]e"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) license"), ("sleepycat", "sleepycat", "sleepycat (?:software )?(?:public )?license"),
    ("smlnj", "standard ml", "standard ml of new jersey (?:copyright )?license"), ("swl", "scheme widget", "scheme widget library (?:swl )?(?:software )?license"), ("unicode", "unicode", "unicode (?:inc )?license agreement"),
    ("w3c", "w3c software", "w3c software (?:notice and license|and document license|license)"), ("watcom", "open watcom", "(?:sybase )?open watcom public license"), ("zend", "zend", "zend (?:engine )?license"),
)

#: Sentences that licenses and their notices consist of: label, keyword, regex, priority, score.
SENTENCES = (
    ("apache-2.0", "except in compliance with the license", "you may not use this file except in compliance with the license", 65, 0.9),
    ("apache-1.1", "the apache software foundation", "this product includes software developed by the apache software foundation", 65, 0.9),
    ("artistic", "a package may be copied", "the intent of this document is to state the conditions under which a package may be copied", 80, 1.0),
    ("agpl", "prominently offer", "your modified version must prominently offer all users interacting with it", 80, 1.0),
    ("beerware", "whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", 80, 1.0),
    ("blessing", "disclaims copyright", "the author disclaims copyright to this source code", 80, 1.0),
    ("blessing", "good and not evil", "may you do good and not evil", 80, 1.0),
    ("bsd", "copyright holders and contributors", "this software is provided by the (?:copyright holders and contributors|[^ ]+ and the copyright holders and contributors) as is", 45, 0.85),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software", 75, 0.97),
    ("bsl-1.0", "person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy", 85, 1.0),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related or neighboring rights", 75, 0.97),
    ("cddl", "common development", "subject to the terms of the common development and distribution license", 55, 0.9),
    ("cc", "some rights reserved", "some rights reserved", 10, 0.4),
    ("epl", "accompanying materials", "the accompanying materials are made available under the terms of the eclipse public license", 45, 0.9),
    ("fsfap", "without royalty", "permitted in any medium without royalty provided the copyright notice and this notice are preserved", 80, 1.0),
    ("fsful", "unlimited permission", "the free software foundation gives unlimited permission to copy distribute and modify it", 80, 1.0),
    ("gfdl", "free documentation", "under the terms of the (?:gnu )?free documentation license", 55, 0.9),
    ("gpl", "modify it under the terms of the gnu", "(?:redistribute it and or )?modify it under the terms of the gnu general public license", 35, 0.9),
    ("gpl", "verbatim copies", "copy and distribute verbatim copies of this license document but changing it is not allowed", 35, 0.8),
    ("hpnd", "and its documentation", "permission to use copy modify and distribute this software and its documentation for any purpose", 70, 0.95),
    ("isc", "disclaims all warranties", "the author disclaims all warranties with regard to this software", 70, 0.95),
    ("lgpl", "modify it under the terms of the gnu", "(?:redistribute it and or )?modify it under the terms of the gnu (?:lesser|library) general public license", 45, 0.9),
    ("mit", "without warranty of any kind", "the software is provided as is without warranty of any kind", 75, 0.95),
    ("mpl-1.1", "subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 80, 1.0),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", 80, 1.0),
    ("ms-pl", "license governs use", "this license governs use of the accompanying software", 70, 0.9),
    ("ofl", "this font software", "this font software is licensed under the sil open font license", 55, 0.9),
    ("openssl", "openssl project", "this product includes software developed by the openssl project", 75, 0.97),
    ("php", "of the php license", "subject to version 3 01? ?of the php license", 65, 0.95),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 15, 0.5),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 20, 0.7),
    ("psf", "license agreement for python", "psf license agreement for python", 65, 0.95),
    ("pdm", "known copyright restrictions", "free of known (?:copyright restrictions|restrictions under copyright law including known copyright restrictions)", 60, 0.9),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", 80, 1.0),
    ("wtfpl", "verbatim or modified copies", "copy and distribute verbatim or modified copies of this license document", 75, 0.97),
    ("zlib", "as is without any express", "this software is provided as is without any express or implied warranty", 75, 0.95),
)


def build_rules() -> tuple[Rule, ...]:
    """The rules in order: the signatures written above; from each versioned name one with its version,
    with "or later" and with "only"; from each label its short identifier after a tag."""
    out: list[Rule] = []
    spdx: set[str] = {x[0] for x in (*SINGLE, *NAMED, *SAID, *SENTENCES)}
    for label, keyword, name, versions in VERSIONED:
        for v in versions:
            number = v.replace(".", " ")
            short = number.removesuffix(" 0")
            said = rf"(?:{name})(?: version| v|v)? ?(?:{number}|{short})"
            out += [
                Rule(f"{label}-{v}", keyword, said, 70, 0.95),
                Rule(f"{label}-{v}-or-later", "later", rf"{said} or (?:\(?at your option\)? )?(?:any )?later(?: version)?", 75, 0.97),
                Rule(f"{label}-{v}-only", "only", rf"{said} only", 75, 0.97),
            ]
            spdx |= {f"{label}-{v}", f"{label}-{v}-or-later", f"{label}-{v}-only"}
    for label, name in COMMONS:
        for v in COMMONS_VERSIONS:
            number = v.replace(".", " ")
            out.append(Rule(f"cc-{label}-{v}", "cc by", f"cc {label.replace('-', ' ')} {number}", 70, 0.95))
            out.append(Rule(f"cc-{label}-{v}", "creative commons", rf"creative commons {name}(?: international| unported| generic)? (?:license )?(?:version |v)?{number}", 72, 0.97))
            spdx.add(f"cc-{label}-{v}")
        out.append(Rule(f"cc-{label}", "creative commons", f"creative commons {name}", 50, 0.85))
    out += [Rule(*x) for x in (*SINGLE, *SENTENCES)]
    out += [Rule(label, " ".join(name.split()[:2]), name, 60, 0.95) for label, name in NAMED]
    out += [Rule(label, keyword, name, 60, 0.95) for label, keyword, name in SAID]
    out += [Rule(x, "spdx", rf"spdx license identifier {x.replace('-', ' ').replace('.', ' ')}", 90, 1.0) for x in sorted(spdx)]
    return tuple(out)


#: A text without any of these words holds no signature.
ANCHORS = (
    "license", "licence", "permission", "redistribution", "neither", "altered", "unencumbered", "unlicense", "wtfpl", "fuck", "cc", "cc0", "creative", "domain", "spdx", "reserved", "copyright",
    "bsd", "evil", "beer", "beerware", "attribution", "clause", "lizenz", "agreement", "unicode", "jpeg", "mulan", "compliance", "copied", "prominently", "stuff", "advertising", "royalty", "verbatim",
    "warranties", "warranty", "proprietary", "unauthorized", "anyone", "openssl", "foundation",
    # A version may stand right at a name.
    *[f"{name}{version}" for name in ("license", "licence", "gpl", "lgpl", "agpl", "gplv", "lgplv", "agplv", "cecill", "agreement") for version in ("", "1", "2", "3", "v", "v1", "v2", "v3")],
)


def may_match(words: Column) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(a) for a in dict.fromkeys(ANCHORS)]))


def places(words: Column, regex: str | Column) -> Column:
    """array<struct<start, end>> of word positions where regex matches in `words`, a string of
    words one space apart with a space at either end; `end` is exclusive.

    Matches are marked in the string, so that positions are those of the marked words after one
    cut: the work follows the length of the text, not its square, however many matches it has.
    """
    pattern = F.concat(F.lit("(?<= )(?:"), regex if isinstance(regex, Column) else F.lit(regex), F.lit(")(?= )"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def numbered(marked: Column) -> Column:
        at = F.transform(F.split(F.trim(marked), " "), lambda w, i: F.struct(F.startswith(w, F.lit(_BEGIN)).alias("b"), F.endswith(w, F.lit(_END)).alias("e"), i.alias("i")))
        begins, ends = F.filter(at, lambda x: x["b"]), F.filter(at, lambda x: x["e"])
        return F.zip_with(begins, ends, lambda b, e: F.struct(b["i"].alias("start"), (e["i"] + 1).alias("end")))

    # Words hold neither mark, so a string without marks had no match.
    marked = F.regexp_replace(words, pattern, F.lit(f"{_BEGIN}$0{_END}"))
    return let(marked, lambda m: F.when(F.contains(m, F.lit(_BEGIN)), let(m, numbered)).otherwise(none))


_BEGIN, _END = "\x01", "\x02"


def unsuppressed(detections: Column, priorities: tuple[int, ...]) -> Column:
    """Those that don't lie inside one of the same or a higher priority; `priorities` are all there are.

    In order of start, longest first, whatever contains an interval stands before it. So all that
    has to be known of the earlier ones is how far those of each priority or a higher one reach.
    """
    levels = sorted(set(priorities))
    order = F.transform(
        detections,
        lambda d: F.struct(
            d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("rank"), d["ord"].alias("ord"),
            d["end"].alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score"),
        ),
    )
    kind = "array<struct<start:int,back:int,rank:int,ord:int,end:int,priority:int,label:string,score:double>>"
    none, ranks = F.array().cast(kind), F.array(*[F.lit(p) for p in levels])
    reach = F.array(*[F.lit(-1) for _ in levels])

    def step(acc: Column, d: Column) -> Column:
        inside = F.get(acc["reach"], F.array_position(ranks, d["priority"]).cast("int") - 1) >= d["end"]
        further = F.zip_with(acc["reach"], ranks, lambda r, p: F.when(p <= d["priority"], F.greatest(r, d["end"])).otherwise(r))
        return F.struct(further.alias("reach"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    # A fold that appends copies what it has: so within pieces, and then the pieces as wholes.
    def piece(acc: Column, ds: Column) -> Column:
        folded = F.aggregate(ds, F.struct(acc["reach"].alias("reach"), none.alias("kept")), step)
        return let(folded, lambda f: F.struct(f["reach"].alias("reach"), F.concat(acc["kept"], F.array(f["kept"])).alias("kept")))

    def whole(ds: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(ds) - 1) / _PIECE).cast("int")), lambda i: F.slice(ds, i * _PIECE + 1, F.lit(_PIECE)))
        folded = F.aggregate(cut, F.struct(reach.alias("reach"), F.array().cast(f"array<{kind}>").alias("kept")), piece, lambda acc: F.flatten(acc["kept"]))
        return F.when(F.size(ds) == 0, none).otherwise(folded)

    return let(F.sort_array(order), whole)


_PIECE = 128
_TABLE = "array<struct<keyword:string,rules:array<struct<label:string,regex:string,priority:int,score:double,ord:int>>>>"


def scan(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] | None = None, prefix: str = "lic_") -> DataFrame:
    """docs plus `lic_` columns: n_words, base (places of the base phrases: label, start, end),
    detections (after suppression: label, start, end, priority, score; words counted from 0),
    base_labels, labels and score (of the best detection, 0 without one).

    A null text counts as empty. Of equal intervals with the same priority the rule that stands first
    wins. Every row is scanned by itself, so repeated rows have equal results; an empty table gives no
    rows. The work on a text follows its length and the number of its matches. Input columns stay, but
    for those whose names begin with the prefix.
    """
    rules = build_rules() if rules is None else rules
    priorities = tuple(r.priority for r in rules)
    t = F.coalesce(F.col(text), F.lit(""))
    # Of letters outside A-Z only the Kelvin sign becomes an ASCII letter, a k, which no base phrase has.
    words_ = F.array_remove(F.split(F.lower(t), NOT_WORD), "")
    by_keyword: dict[str, list] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append({"label": r.label, "regex": r.regex, "priority": r.priority, "score": r.score, "ord": i})
    # One literal, which the optimizer reads once: a column for each field of each rule takes it 20 s.
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": rs} for k, rs in by_keyword.items()])), _TABLE)

    def base(words: Column) -> Column:
        def named(phrase: str, label: str) -> Column:
            return F.transform(
                places(words, phrase),
                lambda x: F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["end"].alias("end")),
            )

        return F.concat(*[named(phrase, label) for phrase, label in BASE])

    def method(words: Column) -> Column:
        gated = F.flatten(F.transform(F.filter(table, lambda r: F.contains(words, r["keyword"])), lambda r: r["rules"]))
        each = F.transform(
            gated,
            lambda r: F.transform(
                places(words, r["regex"]),
                lambda x: F.struct(
                    x["start"].alias("start"), x["end"].alias("end"), r["label"].alias("label"),
                    r["priority"].alias("priority"), r["score"].alias("score"), r["ord"].alias("ord"),
                ),
            ),
        )
        return unsuppressed(F.flatten(each), priorities)

    both = lambda text_: let(text_, lambda w: F.struct(base(w).alias("base"), method(w).alias("found")))
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    found = let(words_, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(may_match(w), both(padded(w))).alias("both")))
    rows = once(docs.drop(*[c for c in docs.columns if c.startswith(prefix)]), found, f"{prefix}found")
    q = F.col(f"{prefix}found")
    kept = F.transform(q["both"]["found"], lambda d: F.struct(*[d[k].alias(k) for k in ("label", "start", "end", "priority", "score")]))
    rows = rows.withColumns(
        {
            f"{prefix}n_words": q["n_words"],
            f"{prefix}base": F.coalesce(q["both"]["base"], F.array().cast("array<struct<label:string,start:int,end:int>>")),
            f"{prefix}detections": F.coalesce(kept, F.array().cast("array<struct<label:string,start:int,end:int,priority:int,score:double>>")),
        }
    ).drop(f"{prefix}found")
    names = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    b, d = names(F.col(f"{prefix}base")), names(F.col(f"{prefix}detections"))
    return rows.withColumns(
        {
            f"{prefix}base_labels": joined(b),
            f"{prefix}labels": joined(F.concat(b, d)),
            f"{prefix}score": F.coalesce(F.array_max(F.transform(F.col(f"{prefix}detections"), lambda x: x["score"])), F.lit(0.0)),
        }
    )
