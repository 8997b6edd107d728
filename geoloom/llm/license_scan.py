"""License detection: regex signatures as rows, gated by a keyword, then ranked and pruned by containment.

Signatures read a text as its lower-case words with one space around each, so that punctuation, URLs'
slashes and line breaks inside a notice don't matter. Hand-written ones cover notices, file headers,
addresses, tags and exceptions; names and versions of the families come from one table.

Everything here is DataFrame functions. A rule is tried on a text only if the rule's gate word is
among the text's words, which an equi-join of words with the fixed rule table decides. Detections
sort by start; running maxima of the ends seen so far, one for each priority, tell whether a better
detection contains the present one. Equal texts are scanned once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.shared import heavy_join, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrase, label.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: License families: label, word of the short name that gates its rules, name as words, short name, versions.
FAMILIES = (
    ("gpl", "gpl", "gnu general public license", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", "gnu lesser general public license", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", "gnu affero general public license", "agpl", ("1.0", "3.0")),
    ("gfdl", "gfdl", "gnu free documentation license", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache", "apache license", "apache", ("1.0", "1.1", "2.0")),
    ("mit", "mit", "mit license", "mit", ()),
    ("bsd", "bsd", "berkeley software distribution license", "bsd", ("2-clause", "3-clause", "4-clause")),
    ("isc", "isc", "isc license", "isc", ()),
    ("mpl", "mpl", "mozilla public license", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "epl", "eclipse public license", "epl", ("1.0", "2.0")),
    ("cddl", "cddl", "common development and distribution license", "cddl", ("1.0", "1.1")),
    ("cpl", "cpl", "common public license", "cpl", ("1.0",)),
    ("eupl", "eupl", "european union public licence", "eupl", ("1.1", "1.2")),
    ("osl", "osl", "open software license", "osl", ("2.1", "3.0")),
    ("afl", "afl", "academic free license", "afl", ("2.1", "3.0")),
    ("artistic", "artistic", "artistic license", "artistic", ("1.0", "2.0")),
    ("zlib", "zlib", "zlib license", "zlib", ()),
    ("bsl", "bsl", "boost software license", "bsl", ("1.0",)),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", "wtfpl", ("2.0",)),
    ("unlicense", "unlicense", "the unlicense", "unlicense", ()),
    ("cc0", "cc0", "creative commons zero", "cc0", ("1.0",)),
    ("cc-by", "cc", "creative commons attribution", "cc by", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc", "creative commons attribution sharealike", "cc by sa", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc", "creative commons attribution noncommercial", "cc by nc", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc", "creative commons attribution noderivatives", "cc by nd", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc", "creative commons attribution noncommercial sharealike", "cc by nc sa", ("3.0", "4.0")),
    ("cc-by-nc-nd", "cc", "creative commons attribution noncommercial noderivatives", "cc by nc nd", ("3.0", "4.0")),
    ("odbl", "odbl", "open database license", "odbl", ("1.0",)),
    ("odc-by", "odc", "open data commons attribution license", "odc by", ("1.0",)),
    ("pddl", "pddl", "public domain dedication and license", "pddl", ("1.0",)),
    ("ofl", "ofl", "sil open font license", "ofl", ("1.0", "1.1")),
    ("ncsa", "ncsa", "university of illinois ncsa open source license", "ncsa", ()),
    ("python", "psf", "python software foundation license", "psf", ("2.0",)),
    ("postgresql", "postgresql", "postgresql license", "postgresql", ()),
    ("ms-pl", "pl", "microsoft public license", "ms pl", ()),
    ("ms-rl", "rl", "microsoft reciprocal license", "ms rl", ()),
    ("openssl", "openssl", "openssl license", "openssl", ()),
    ("php", "php", "php license", "php", ("3.0", "3.01")),
    ("ruby", "ruby", "ruby license", "ruby", ()),
    ("x11", "x11", "x11 license", "x11", ()),
)

#: Signatures by hand: label, gate word (one that the signature requires), regex over the spaced words. Notices and headers.
NOTICES = (
    ("mit", "sublicense", r" permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell(?= )"),
    ("mit", "hereby", r" permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation(?= )"),
    ("mit", "noninfringement", r" the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement(?= )"),
    ("mit", "mit", r" (?:released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?mit(?: x11)?(?: style)? licen[sc]e(?= )"),
    ("mit", "mit", r" dual licen[sc]ed under (?:the )?mit (?:and|or) (?:the )?(?:apache|gpl|bsd)(?= )"),
    ("mit-0", "hereby", r" permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is(?: without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement)?(?= )"),
    ("x11", "consortium", r" except as contained in this notice the name of the x consortium shall not be used in advertising(?= )"),
    ("bsd", "redistribution", r" redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?(?= )"),
    ("bsd", "redistributions", r" redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?(?= )"),
    ("bsd", "redistributions", r" redistributions in binary form must reproduce the above copyright notice(?= )"),
    ("bsd", "endorse", r" neither the names? of (?:the )?\S+(?: \S+){0,8} nor the names of (?:its|the) contributors may be used to endorse or promote products(?= )"),
    ("bsd", "advertising", r" all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?= )"),
    ("bsd", "bsd", r" (?:released|distributed|available|governed|covered) (?:under|by) (?:the )?(?:terms of )?(?:an? |the )?(?:new |modified |simplified |revised )?bsd(?: style)? licen[sc]e(?= )"),
    ("bsd", "bsd", r" use of this source code is governed by a bsd style license(?: that can be found in the license file)?(?= )"),
    ("isc", "hereby", r" permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice and this permission notice appear in all copies)?(?= )"),
    ("hpnd", "hereby", r" permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted(?= )"),
    ("apache", "apache", r" licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license(?= )"),
    ("apache", "apache", r" you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt| html)?(?= )"),
    ("apache", "asf", r" licensed to the apache software foundation asf under one or more contributor license agreements(?= )"),
    ("apache", "governing", r" distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations(?= )"),
    ("apache", "apache", r" (?:released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:license )?(?:version )?v?2(?: 0)?(?: license)?(?= )"),
    ("apache", "apache", r" this product includes software developed by the apache software foundation(?= )"),
    ("gpl", "redistribute", r" this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?= )"),
    ("gpl", "redistribute", r" is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation(?= )"),
    ("gpl", "gnu", r" gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version(?= )"),
    ("gpl", "gnu", r" gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version(?= )"),
    ("gpl", "gnu", r" gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation(?= )"),
    ("gpl", "gnu", r" you should have received a copy of the gnu general public licen[sc]e along with this program(?= )"),
    ("gpl", "franklin", r" free software foundation inc 51 franklin (?:street|st) fifth floor boston ma 02110(?: 1301)?(?: usa)?(?= )"),
    ("gpl", "temple", r" free software foundation inc 59 temple place(?: suite 330)? boston ma 02111(?: 1307)?(?: usa)?(?= )"),
    ("gpl", "copyleft", r" the gnu general public license is a free copyleft license for software and other kinds of works(?= )"),
    ("gpl", "gpl", r" (?:released|distributed|available|licen[sc]ed|published|covered) under (?:the )?(?:terms of )?(?:the )?gpl ?v?(?:2|3)?(?: or later)?(?= )"),
    ("gpl-classpath-exception", "classpath", r" linking this library statically or dynamically with other modules is making a combined work based on this library(?=.* classpath )"),
    ("gpl-classpath-exception", "classpath", r" (?:with|subject to) (?:the )?(?:gnu )?classpath (?:linking )?exception(?: 2 0)?(?= )"),
    ("gpl-gcc-exception", "gcc", r" (?:with|under) (?:the )?gcc runtime library exception(?: version)?(?: 3 1| 2 0)?(?= )"),
    ("gpl-font-exception", "unaltered", r" if you create a document which uses this font and embed this font or unaltered portions of this font into the document(?= )"),
    ("gpl-bison-exception", "bison", r" as a special exception you may create a larger work that contains part or all of the bison parser skeleton(?= )"),
    ("gpl-autoconf-exception", "autoconf", r" as a special exception(?: to the gnu general public license)? if you distribute this file as part of a program that contains a configuration script generated by autoconf(?= )"),
    ("gpl-openssl-exception", "openssl", r" (?:permission|exception) to link the code of (?:portions of )?this program with the openssl library(?= )"),
    ("linux-syscall-note", "kernel", r" this copyright does not cover user programs that use kernel services by normal system calls(?= )"),
    ("linux-syscall-note", "syscall", r" (?:with )?linux syscall note(?= )"),
    ("lgpl", "lesser", r" you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e(?= )"),
    ("lgpl", "lesser", r" you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:library|program)(?= )"),
    ("lgpl", "lesser", r" gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version(?= )"),
    ("lgpl", "lesser", r" gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version(?= )"),
    ("lgpl", "gnu", r" under the terms of the gnu library general public licen[sc]e(?= )"),
    ("agpl", "affero", r" you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e(?= )"),
    ("agpl", "affero", r" you should have received a copy of the gnu affero general public licen[sc]e along with this program(?= )"),
    ("agpl", "affero", r" gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version(?= )"),
    ("gfdl", "invariant", r" permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e(?=.* invariant )"),
    ("gfdl", "gnu", r" permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e(?= )"),
    ("mpl", "mozilla", r" this source code form is subject to the terms of the mozilla public license v 2 0(?= )"),
    ("mpl", "mpl", r" if a copy of the mpl was not distributed with this file you can obtain one at(?= )"),
    ("mpl", "mozilla", r" the contents of this file are subject to the mozilla public license version 1 1(?= )"),
    ("mpl", "mozilla", r" the contents of this file are subject to the mozilla public license version 1 0(?= )"),
    ("mpl-no-copyleft", "incompatible", r" this source code form is incompatible with secondary licenses as defined by the mozilla public license(?= )"),
    ("epl", "eclipse", r" this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )? ?1 0(?= )"),
    ("epl", "eclipse", r" this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0(?= )"),
    ("cddl", "cddl", r" the contents of this file are subject to the terms of (?:either )?the common development and distribution license(?: the license)?(?=.* cddl )"),
    ("cddl", "cddl", r" this cddl header in each file(?= )"),
    ("cpl", "cpl", r" made available under the terms of the common public license v1 0(?=.* cpl )"),
    ("eupl", "eupl", r" licen[sc]ed under the eupl(?: version)?(?: v)?(?: 1 [012])?(?: or as soon they will be approved by the european commission)?(?= )"),
    ("boost", "hereby", r" permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license(?= )"),
    ("boost", "boost", r" distributed under the boost software license version 1 0(?= )"),
    ("zlib", "altered", r" altered source versions must be plainly marked as such and must not be misrepresented as being the original software(?= )"),
    ("zlib", "misrepresented", r" the origin of this software must not be misrepresented you must not claim that you wrote the original software(?= )"),
    ("libpng", "png", r" the png reference library is supplied as is(?= )"),
    ("unlicense", "unencumbered", r" this is free and unencumbered software released into the public domain(?= )"),
    ("wtfpl", "wtfpl", r" licen[sc]ed under the wtfpl(?= )"),
    ("wtfpl", "fuck", r" you just do what the fuck you want to(?= )"),
    ("cc0", "waived", r" to the extent possible under law (?:the )?\S+(?: \S+){0,10} waived all copyright and related or neighboring rights(?= )"),
    ("cc0", "cc0", r" (?:dedicated|released) (?:in)?to the public domain (?:under|using|with) (?:the )?cc0(?= )"),
    ("public-domain", "domain", r" (?:this|the) (?:file|code|software|work|program|document) (?:is|has been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain(?= )"),
    ("public-domain", "domain", r" (?:i|we|the authors?) (?:hereby )?(?:place|release|dedicate)s? (?:this|it) (?:in|into|to) the public domain(?= )"),
    ("public-domain", "disclaims", r" the author hereby disclaims copyright to this source code(?= )"),
    ("blessing", "blessing", r" the author disclaims copyright to this source code in place of a legal notice here is a blessing(?= )"),
    ("cc-by", "creative", r" (?:this )?work is licen[sc]ed under (?:a |the )?creative commons attribution (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("cc-by-sa", "sharealike", r" (?:this )?work is licen[sc]ed under (?:a |the )?creative commons attribution sharealike (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("cc-by-sa", "creative", r" (?:under|by) (?:a |the )?creative commons attribution share alike (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("cc-by-nc", "noncommercial", r" (?:this )?work is licen[sc]ed under (?:a |the )?creative commons attribution noncommercial (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("cc-by-nc-sa", "noncommercial", r" licen[sc]ed under (?:a |the )?creative commons attribution noncommercial sharealike (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("cc-by-nc-nd", "noderivatives", r" licen[sc]ed under (?:a |the )?creative commons attribution noncommercial noderivatives (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("cc-by-nd", "noderivatives", r" licen[sc]ed under (?:a |the )?creative commons attribution noderivatives (?:[1-4] \d )?(?:international |unported |generic )?licen[sc]e(?= )"),
    ("artistic", "artistic", r" (?:under|by) (?:the )?(?:terms of )?(?:either )?(?:the )?(?:perl )?artistic licen[sc]e(?: 2 0)?(?= )"),
    ("perl", "perl", r" (?:free software|library) you can redistribute it and or modify it under the same terms as perl(?: 5)?(?: itself)?(?= )"),
    ("ruby", "ruby", r" (?:distributed|copied|redistributed) under the (?:same )?terms (?:of|as) ruby(?: s license| itself)?(?= )"),
    ("python", "psf", r" python software foundation psf and the individual or organization licensee(?= )"),
    ("php", "php", r" this source file is subject to version (?:2 02|3 0|3 01) of the php license(?= )"),
    ("openssl", "openssl", r" this product includes software developed by the openssl project for use in the openssl toolkit(?= )"),
    ("ssleay", "eric", r" this product includes cryptographic software written by eric young(?= )"),
    ("ofl", "sil", r" this font software is licensed under the sil open font license(?: version 1 1)?(?= )"),
    ("ncsa", "illinois", r" university of illinois (?:ncsa )?open source license(?= )"),
    ("apache-llvm-exception", "llvm", r" apache (?:license )?(?:v|version )?2 0 (?:license )?with llvm exceptions?(?= )"),
    ("unicode", "unicode", r" permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files(?= )"),
    ("curl", "curl", r" (?:licensed|available|released) under (?:the )?curl license(?= )"),
    ("beerware", "beer", r" if we meet some day and you think this stuff is worth it you can buy me a beer(?= )"),
    ("jquery", "jquery", r" released under the mit license https? jquery org license(?= )"),
    ("sspl", "license", r" server side public license(?: version 1| v1)?(?= )"),
    ("busl", "license", r" business source license(?: 1 1| version 1 1)?(?= )"),
    ("elastic", "elastic", r" (?:under|in) (?:the )?(?:or more contributor license agreements licensed under the )?elastic license(?: 2 0| v2)?(?= )"),
    ("json", "evil", r" the software shall be used for good not evil(?= )"),
    ("commons-clause", "commons", r" (?:with|by|under) the commons clause(?: license condition)?(?= )"),
    ("proprietary", "proprietary", r" (?:this (?:software|file|document) is |contains |the )?(?:confidential and proprietary|proprietary and confidential)(?= )"),
    ("proprietary", "unauthorized", r" unauthorized copying of this (?:file|software|document)(?: via any medium)? is strictly prohibited(?= )"),
    ("free-to-use", "royalty", r" royalty free (?:perpetual )?(?:worldwide )?licen[sc]e to use(?= )"),
)

#: Addresses by hand, as words: label, gate word, regex.
ADDRESSES = (
    ("apache", "apache", r" apache org licenses license 2 0(?= )"),
    ("apache", "apache", r" apache org licenses(?= )"),
    ("mit", "opensource", r" opensource org licenses mit(?= )"),
    ("mit", "mit", r" mit licen[sc]e org(?= )"),
    ("bsd", "opensource", r" opensource org licenses bsd 2 clause(?= )"),
    ("bsd", "opensource", r" opensource org licenses bsd 3 clause(?= )"),
    ("bsd", "opensource", r" opensource org licenses bsd license(?= )"),
    ("isc", "opensource", r" opensource org licenses isc(?= )"),
    ("gpl", "opensource", r" opensource org licenses gpl 2 0(?= )"),
    ("gpl", "opensource", r" opensource org licenses gpl 3 0(?= )"),
    ("zlib", "opensource", r" opensource org licenses zlib(?= )"),
    ("artistic", "opensource", r" opensource org licenses artistic license(?: 2 0)?(?= )"),
    ("gpl", "gnu", r" gnu org licenses (?:old licenses )?gpl 2 0(?= )"),
    ("gpl", "gnu", r" gnu org licenses gpl 3 0(?= )"),
    ("gpl", "gnu", r" gnu org (?:copyleft|licenses) gpl(?= )"),
    ("lgpl", "gnu", r" gnu org licenses (?:old licenses )?lgpl 2 1(?= )"),
    ("lgpl", "gnu", r" gnu org licenses lgpl 3 0(?= )"),
    ("lgpl", "gnu", r" gnu org (?:copyleft lesser|licenses lgpl)(?= )"),
    ("agpl", "gnu", r" gnu org licenses agpl(?: 3 0)?(?= )"),
    ("gfdl", "gnu", r" gnu org (?:copyleft|licenses) fdl(?= )"),
    ("mpl", "mozilla", r" mozilla org (?:en us )?mpl 2 0(?= )"),
    ("mpl", "mozilla", r" mozilla org mpl mpl 1 1(?= )"),
    ("mpl", "mozilla", r" mozilla org mpl(?= )"),
    ("epl", "eclipse", r" eclipse org legal epl v10(?= )"),
    ("epl", "eclipse", r" eclipse org legal epl(?: v)? ?2 0(?= )"),
    ("boost", "boost", r" boost org license 1 0 txt(?= )"),
    ("unlicense", "unlicense", r" unlicense org(?= )"),
    ("wtfpl", "wtfpl", r" wtfpl net(?= )"),
    ("cc0", "creativecommons", r" creativecommons org publicdomain zero 1 0(?= )"),
    ("public-domain", "creativecommons", r" creativecommons org publicdomain mark 1 0(?= )"),
    ("cc-by", "creativecommons", r" creativecommons org licenses by [1-4] \d(?= )"),
    ("cc-by-sa", "creativecommons", r" creativecommons org licenses by sa [1-4] \d(?= )"),
    ("cc-by-nc", "creativecommons", r" creativecommons org licenses by nc [1-4] \d(?= )"),
    ("cc-by-nd", "creativecommons", r" creativecommons org licenses by nd [1-4] \d(?= )"),
    ("cc-by-nc-sa", "creativecommons", r" creativecommons org licenses by nc sa [1-4] \d(?= )"),
    ("cc-by-nc-nd", "creativecommons", r" creativecommons org licenses by nc nd [1-4] \d(?= )"),
    ("odbl", "opendatacommons", r" opendatacommons org licenses odbl(?= )"),
    ("odc-by", "opendatacommons", r" opendatacommons org licenses by(?= )"),
    ("pddl", "opendatacommons", r" opendatacommons org licenses pddl(?= )"),
    ("ofl", "sil", r" scripts sil org ofl(?= )"),
    ("php", "php", r" php net license(?= )"),
    ("python", "python", r" (?:docs )?python org (?:3 )?(?:psf )?licen[sc]e(?= )"),
    ("openssl", "openssl", r" openssl org source license(?= )"),
    ("perl", "perl", r" dev perl org licenses(?= )"),
    ("eupl", "eupl", r" joinup ec europa eu (?:\S+ ){0,4}eupl(?= )"),
)

#: Words of names that don't gate a rule by themselves; a name of such words only is gated by its "license".
ORDINARY = frozenset("license licence public the and to do what you want of general common software open source free documentation development distribution data domain union university".split())

#: What each form of rule is worth: lower priority numbers win, and the score follows.
FORM_SCORE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.7, 5: 0.5}


def rule_rows() -> list[tuple[int, str, str, int, str]]:
    """(rule id, gate word, regex over spaced lower-case words, priority, label), a fixed list.

    From strong to weak: notice, header or tag; family notice or address; name with version; name; short name.
    """
    rows = []
    for label, gate, name, short, versions in FAMILIES:
        name_gate = max((w for w in name.split() if w not in ORDINARY), key=len, default="license")
        forms = [(1, gate, rf" spdx license identifier {short}(?: \d+)*(?: only| or later| clause)*(?= )")]
        forms += [(2, name_gate, rf" licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name}(?= )"), (2, gate, rf" licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{short}(?= )")]
        for version in versions:
            spoken = version.replace(".", " ").replace("-", " ")
            major = spoken.removesuffix(" 0")
            forms += [(3, name_gate, rf" {name} (?:version |v)?{major}(?: 0)?(?= )"), (3, gate, rf" {short} (?:version |v)?{major}(?: 0)?(?: clause)?(?= )")]
        forms += [(4, name_gate, rf" {name}(?= )"), (5, gate, rf" {short} licen[sc]e(?= )")]
        rows += [(priority, word, regex, label) for priority, word, regex in forms]
    rows += [(1, gate, regex, label) for label, gate, regex in NOTICES] + [(2, gate, regex, label) for label, gate, regex in ADDRESSES]
    return [(k, word, regex, priority, label) for k, (priority, word, regex, label) in enumerate(dict.fromkeys(rows))]


def gate_words() -> list[str]:
    """Words of which a text must have one for any rule or base phrase to match."""
    gates = {r[1] for r in rule_rows()}
    return sorted(gates | {p.split()[0] for p, _ in BASE_PHRASES if not gates & set(p.split())})


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "rule_id int, gate string, regex string, priority int, label string")


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(texts: DataFrame, key: list[str], words: str) -> DataFrame:
    """All kept detections: ``key``, rule_id, label, priority, start and end in the spaced words.

    ``texts`` has the key columns and ``words``, a string of lower-case words with one space before,
    between and after them. A detection goes if one with a lower priority number contains it, or one
    of its own priority that is longer or, at the same place, has the lower rule id.
    """
    spark = texts.sparkSession
    listed = F.array(*[F.lit(w) for w in sorted({r[1] for r in rule_rows()})])
    gated = texts.select(*key, words, F.explode(F.array_intersect(F.split(words, " "), listed)).alias("gate"))
    tried = gated.join(F.broadcast(rules(spark)), "gate").filter(F.expr(f"regexp_like({words}, regex)"))
    parts = tried.withColumn("_parts", F.expr(f"transform(split({words}, regex), p -> length(p))")).withColumn("_hits", F.expr(f"transform(regexp_extract_all({words}, regex, 0), m -> length(m))"))
    found = parts.select(*key, "rule_id", "label", "priority", "_hits", F.posexplode(F.expr("slice(_parts, 1, size(_hits))")).alias("_k", "_gap"))
    order = Window.partitionBy(*key, "rule_id").orderBy("_k")
    length = F.expr("_hits[_k]")
    placed = found.withColumn("_end", F.sum(F.col("_gap") + length).over(order)).select(*key, "rule_id", "label", "priority", (F.col("_end") - length).alias("start"), F.col("_end").alias("end"))
    earlier = Window.partitionBy(*key).orderBy("start", F.desc("end"), "priority", "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    for p in FORM_SCORE:
        placed = placed.withColumn(f"_max{p}", F.max(F.when(F.col("priority") == p, F.col("end"))).over(earlier))
    hidden = reduce(lambda a, b: a | b, [(F.col("priority") >= p) & (F.coalesce(F.col(f"_max{p}"), F.lit(-1)) >= F.col("end")) for p in FORM_SCORE])
    return placed.filter(~hidden).select(*key, "rule_id", "label", "priority", "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses of every text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A word is a run of letters, digits and non-ASCII characters after lower-casing A-Z. Null and
    empty texts have no words, no labels and score 0. Rows with the same id and text get the same
    answer each; other columns are ignored. ``score`` is the value of the strongest kept detection.
    Regexes run only on texts that hold a gate word of some rule, once for equal texts; a text of any length is scanned whole.
    Texts are told apart by 128 bits of hash.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = F.regexp_extract_all(F.translate("_t", UPPER, LOWER), F.lit(WORD), F.lit(0))
    base = base.select("doc_id", "_t", F.size(found).cast("long").alias("n_words"), F.arrays_overlap(found, F.array(*[F.lit(w) for w in gate_words()])).alias("_hit"))
    spaced = F.when(F.col("_hit"), F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate("_t", UPPER, LOWER), SEPARATORS, " "), F.lit(" ")), F.lit(" ")))
    same = F.when(F.col("_hit"), F.struct(F.xxhash64("_t").alias("a"), F.xxhash64(F.lit(1), "_t").alias("b")))
    base = stage(base.select("doc_id", "n_words", same.alias("_th"), spaced.alias("_words")), "scanned")

    plain = base.filter("_th is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), *[F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")], F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    rows = base.filter("_th is not null").select("doc_id", "_th")
    texts = stage(base.filter("_th is not null").groupBy("_th").agg(F.first("_words").alias("_words"), F.first("n_words").alias("n_words"), F.count("*").alias("_n")), "license-texts")

    parts = texts.select("*", *[F.split("_words", f" {p}(?= )").alias(f"_p{k}") for k, (p, _) in enumerate(BASE_PHRASES)])
    firsts, lasts, counts = [], [], []
    for k, (phrase, _) in enumerate(BASE_PHRASES):
        p, n = F.col(f"_p{k}"), F.size(f"_p{k}") - 1
        firsts.append(F.when(n > 0, spaces(p[0])))
        lasts.append(F.when(n > 0, F.col("n_words") - len(phrase.split()) - (spaces(F.element_at(p, -1)) - 1)))
        counts.append(F.when(n > 0, n).otherwise(0))
    names = F.array_sort(F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(counts, BASE_PHRASES, strict=True)])))
    each = parts.select("_th", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), names.alias("_base"))

    score = F.max(reduce(lambda e, x: e.when(F.col("priority") == x[0], F.lit(x[1])), FORM_SCORE.items(), F))
    more = detections(texts, ["_th"], "_words").groupBy("_th").agg(F.collect_set("label").alias("_more"), score.alias("_score"))
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    floor = F.when(F.size("_base") > 0, F.lit(FORM_SCORE[4])).otherwise(F.lit(0.0))
    judged = each.join(more, "_th", "left").select("_th", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.greatest(floor, F.coalesce("_score", F.lit(0.0))).alias("score"))
    out = heavy_join(rows, judged, "_th", texts.select("_th", F.col("_n").alias("n")), "doc_id")
    return plain.union(out.select(*plain.columns))
