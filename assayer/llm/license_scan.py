"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority.

Only column functions.  Text is reduced to words joined by single spaces; a rule is a regular
expression over whole words with a keyword that every match contains.  A document without any
keyword is never matched, and a rule is tried only where its own keyword occurs.  Detections are
intervals of words.  One is suppressed where a detection of the same or a higher priority, earlier
in the order of rules where both are equal, contains it.

Defined results: a null or empty text has no words and no detections; repeated rows are judged one
by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import ascii_lower, prepare
from assayer.session import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Priorities: an identifier or a full title, a family with a version, a name in passing.
EXACT, VERSIONED, NAMED = 3, 2, 1
WEIGHTS = {EXACT: 0.95, VERSIONED: 0.8, NAMED: 0.5}


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str  # over words joined by one space; matches whole words
    keyword: str  # literal part of every match
    priority: int

    def __post_init__(self) -> None:
        if not self.keyword:
            raise ValueError(f"signature {self.label!r} has no keyword")


BASE = [
    Signature("cc-by", "cc by", "cc by", NAMED),
    Signature("gpl", "general public license", "general public license", NAMED),
    Signature("reserved", "all rights reserved", "all rights reserved", NAMED),
]

# Families: label, how the title is written, keyword, versions.
_FAMILIES = [
    ("gpl", r"(?:gnu )?general public licen[sc]e", "general public", ["1", "2", "3"]),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", ["2", "2 1", "3"]),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero", ["1", "3"]),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e", "free documentation", ["1 1", "1 2", "1 3"]),
    ("apache", r"apache (?:software )?licen[sc]e", "apache", ["1 0", "1 1", "2 0", "2"]),
    ("mpl", r"mozilla public licen[sc]e", "mozilla", ["1 0", "1 1", "2 0"]),
    ("epl", r"eclipse public licen[sc]e", "eclipse", ["1 0", "2 0"]),
    ("cpl", r"common public licen[sc]e", "common public", ["1 0"]),
    ("cddl", r"common development and distribution licen[sc]e", "common development", ["1 0", "1 1"]),
    ("eupl", r"european union public licen[sc]e", "european union", ["1 0", "1 1", "1 2"]),
    ("artistic", r"artistic licen[sc]e", "artistic", ["1 0", "2 0"]),
    ("osl", r"open software licen[sc]e", "open software", ["1 0", "2 0", "3 0"]),
    ("afl", r"academic free licen[sc]e", "academic free", ["1 2", "2 0", "3 0"]),
    ("boost", r"boost software licen[sc]e", "boost", ["1 0"]),
    ("zpl", r"zope public licen[sc]e", "zope", ["2 0", "2 1"]),
    ("php", r"php licen[sc]e", "php", ["3 0", "3 01"]),
    ("psf", r"python software foundation licen[sc]e", "python software", ["2"]),
    ("lppl", r"latex project public licen[sc]e", "latex project", ["1 0", "1 2", "1 3c"]),
    ("ofl", r"open font licen[sc]e", "open font", ["1 0", "1 1"]),
    ("odbl", r"open database licen[sc]e", "open database", ["1 0"]),
    ("upl", r"universal permissive licen[sc]e", "universal permissive", ["1 0"]),
    ("mspl", r"microsoft public licen[sc]e", "microsoft public", []),
    ("msrl", r"microsoft reciprocal licen[sc]e", "microsoft reciprocal", []),
    ("qpl", r"q public licen[sc]e", "public licen", ["1 0"]),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat", []),
    ("isc", r"isc licen[sc]e", "isc licen", []),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", []),
    ("unlicense", r"the unlicen[sc]e", "unlicen", []),
    ("wtfpl", r"do what the [^ ]+ you want to public licen[sc]e", "do what the", ["2"]),
    ("mit", r"(?:the )?(?:mit|expat|x11) licen[sc]e", "licen", []),
    ("bsd", r"(?:new |modified |simplified |revised )?bsd licen[sc]e", "bsd", []),
]
# Elements of creative commons names, as words, with their labels.
_CC = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
_CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
# Phrases of licence texts and notices.
_PHRASES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", EXACT),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", EXACT),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use", EXACT),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors", "nor the names of", VERSIONED),
    ("bsd-2-clause", "bsd 2 clause(?: licen[sc]e)?", "bsd 2", EXACT),
    ("bsd-3-clause", "bsd 3 clause(?: licen[sc]e)?", "bsd 3", EXACT),
    ("zlib", "this software is provided as is without any express or implied warranty", "provided as is", VERSIONED),
    ("public-domain", "(?:released|dedicated|placed) (?:in|in to|to|into) the public domain", "public domain", VERSIONED),
    ("public-domain", "public domain", "public domain", NAMED),
    ("unlicense", "this is free and unencumbered software", "unencumbered", EXACT),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", NAMED),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", VERSIONED),
    ("proprietary", "unauthorized copying", "unauthorized copying", VERSIONED),
    ("no-warranty", "without warranty of any kind", "warranty", NAMED),
    ("licensed", "licen[sc]ed under the [^ ]+", "ed under the", NAMED),
]

# Sentences of licence texts, notices and grants, each written by hand: label, words, keyword, priority.
_SENTENCES = [
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software", "sublicen", EXACT),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission", EXACT),
    ("mit", "the software is provided as is without warranty of any kind express or implied", "without warranty of any kind", VERSIONED),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright holders", VERSIONED),
    ("mit", "(?:distributed|released|available) under (?:the terms of )?the mit licen[sc]e", "mit licen", VERSIONED),
    ("mit-0", "mit no attribution(?: licen[sc]e)", "licen", NAMED),
    ("mit-0", "mit 0 licen[sc]e", "mit 0 licen", EXACT),
    ("mit-advertising", "the names of the copyright holders shall not be used in advertising", "copyright holders shall not be used", VERSIONED),
    ("x11", "except as contained in this notice the names? of the above copyright holders? shall not be used in advertising", "of the above copyright holder", EXACT),
    ("x11", "x consortium .{0,60}?copyright notice", "copyright notice", VERSIONED),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice", EXACT),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "must reproduce the above copyright notice", EXACT),
    ("bsd", "this software is provided by the (?:copyright holders?|author|regents) and contributors as is", "and contributors as is", VERSIONED),
    ("bsd-3-clause", "may not be used to endorse or promote products derived from this software without specific prior written permission", "promote products derived from this software", EXACT),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials mentioning features", EXACT),
    ("bsd-4-clause", "bsd 4 clause(?: licen[sc]e)?", "bsd 4", EXACT),
    ("bsd-original", "this product includes software developed by the university of california", "software developed by the university", EXACT),
    ("bsd-0-clause", "(?:bsd zero clause|zero clause bsd|0bsd)(?: licen[sc]e)?", "bsd", EXACT),
    ("bsd-patent", "bsd 2 clause plus patent", "bsd 2", EXACT),
    ("bsd-3-clause-clear", "bsd 3 clause clear", "bsd 3", EXACT),
    ("bsd-style", "bsd (?:style|like) licen[sc]e", "bsd", VERSIONED),
    ("freebsd", "the freebsd (?:copyright|licen[sc]e|documentation licen[sc]e)", "freebsd", VERSIONED),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "and this permission notice appear in all copies", EXACT),
    ("isc", "the author disclaims all warranties with regard to this software", "disclaims all warranties", VERSIONED),
    ("isc", "isc style licen[sc]e", "isc style licen", VERSIONED),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "permission to use", EXACT),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "permission to use", EXACT),
    ("hpnd", "historical permission notice and disclaimer", "permission notice and disclaimer", EXACT),
    ("apache-2.0", "you may not use this file except in compliance with the licen[sc]e", "compliance with the licen", EXACT),
    ("apache-2.0", "you may obtain a copy of the licen[sc]e at http www apache org licenses licen[sc]e 2 0", "www apache org", EXACT),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "distributed under the licen", EXACT),
    ("apache-2.0", "without warranties or conditions of any kind either express or implied see the licen[sc]e for the specific language governing permissions", "licen", VERSIONED),
    ("apache-2.0", "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "apache software foundation", EXACT),
    ("apache-2.0", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[sc]e", "royalty free irrevocable", EXACT),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation", EXACT),
    ("apache-1.1", "products derived from this software may not be called apache", "may not be called apache", EXACT),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "general public", EXACT),
    ("gpl", "(?:but )?without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "without even the implied warranty", VERSIONED),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e along with this program", "general public", EXACT),
    ("gpl", "the licenses for most software (?:and other practical works )?are designed to take away your freedom", "licenses for most software", EXACT),
    ("gpl", "gnu is not unix .{0,40}?general public licen[sc]e", "general public", NAMED),
    ("gpl-2.0", "59 temple place suite 330 boston .{0,60}?general public licen[sc]e", "general public", VERSIONED),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work .{0,80}?general public licen[sc]e", "general public", EXACT),
    ("gpl-classpath", "gpl (?:v?2 (?:0 )?)?with (?:the )?classpath exception", "gpl", EXACT),
    ("gpl-linking", "gpl (?:v?[23] (?:0 )?)?with (?:a )?linking exception", "gpl", EXACT),
    ("gpl-runtime", "gcc runtime library exception .{0,60}?gpl", "gpl", EXACT),
    ("gpl-font", "gpl with font exception", "gpl with font", EXACT),
    ("gpl-any", "(?:under|covered by) the gpl", "the gpl", NAMED),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", "general public", EXACT),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", "general public", EXACT),
    ("agpl", "you should have received a copy of the gnu affero general public licen[sc]e", "affero", EXACT),
    ("agpl", "remote network interaction use with the gnu general public licen[sc]e", "general public", EXACT),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "free documentation", EXACT),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts .{0,80}?free documentation licen[sc]e", "free documentation", EXACT),
    ("mpl", "the contents of this file are subject to the mozilla public licen[sc]e", "mozilla", EXACT),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", "mozilla", EXACT),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not distributed", EXACT),
    ("mpl-2.0", "incompatible with secondary licenses as defined by the mozilla public licen[sc]e", "mozilla", EXACT),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", "eclipse", EXACT),
    ("epl", "eclipse foundation software user agreement", "eclipse foundation", VERSIONED),
    ("edl", "eclipse distribution licen[sc]e(?: v ?1 0)?", "eclipse", EXACT),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "common development", EXACT),
    ("cddl", "when distributing the software include this licen[sc]e header notice in each file", "licen", EXACT),
    ("eupl", "licen[sc]ed under the eupl", "licen", EXACT),
    ("cecill", "cecill (?:b |c )?(?:free software )?licen[sc]e(?: agreement)?", "licen", EXACT),
    ("cecill", "governed by the cecill (?:b |c )?licen[sc]e under french law", "licen", EXACT),
    ("ms-pl", "microsoft public licen[sc]e ms pl", "microsoft public", EXACT),
    ("ms-rl", "microsoft reciprocal licen[sc]e ms rl", "microsoft reciprocal", EXACT),
    ("ms-eula", "microsoft software licen[sc]e terms", "microsoft software licen", EXACT),
    ("ms-lpl", "microsoft limited public licen[sc]e", "limited public licen", EXACT),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied .{0,80}?copyright holder", "copyright holder", EXACT),
    ("artistic", "under the same terms as perl itself .{0,40}?artistic licen[sc]e", "artistic", EXACT),
    ("artistic-perl", "dual licen[sc]ed under the (?:gpl|general public licen[sc]e) and the artistic licen[sc]e", "artistic", EXACT),
    ("boost-1.0", "boost software licen[sc]e version 1 0 august 17th 2003", "boost", EXACT),
    ("boost-1.0", "distributed under the boost software licen[sc]e", "boost", EXACT),
    ("boost-1.0", "all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code .{0,60}?licen[sc]e", "licen", VERSIONED),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software .{0,200}?altered source versions must be plainly marked as such .{0,120}?this notice may not be removed .{0,200}?licen[sc]e", "licen", EXACT),
    ("zlib", "zlib acknowledge?ment", "zlib", EXACT),
    ("zlib", "(?:under|uses) the zlib licen[sc]e", "zlib", VERSIONED),
    ("libpng", "libpng licen[sc]e(?: version 2)?", "libpng licen", EXACT),
    ("libtiff", "libtiff licen[sc]e", "libtiff licen", EXACT),
    ("libjpeg", "independent jpeg group(?: s)? .{0,40}?licen[sc]e", "licen", VERSIONED),
    ("info-zip", "info zip licen[sc]e", "info zip licen", EXACT),
    ("bzip2", "bzip2 (?:and libbzip2 )?licen[sc]e", "licen", EXACT),
    ("curl", "curl licen[sc]e", "curl licen", EXACT),
    ("openssl", "openssl licen[sc]e", "openssl licen", EXACT),
    ("ssleay", "original ssleay licen[sc]e", "ssleay licen", EXACT),
    ("openldap", "openldap public licen[sc]e(?: version)?(?: 2 [0-9])?", "openldap public licen", EXACT),
    ("postgresql", "postgresql licen[sc]e", "postgresql licen", EXACT),
    ("sqlite", "the author disclaims copyright to this source code in place of a legal notice here is a blessing", "disclaims copyright", EXACT),
    ("ruby", "ruby(?: s)? licen[sc]e", "licen", EXACT),
    ("tcl", "tcl tk licen[sc]e", "tcl tk licen", EXACT),
    ("vim", "vim licen[sc]e", "vim licen", EXACT),
    ("ncsa", "university of illinois ncsa open source licen[sc]e", "ncsa open source licen", EXACT),
    ("ecl", "educational community licen[sc]e(?: version)?(?: [12] 0)?", "educational community licen", EXACT),
    ("ipl", "ibm public licen[sc]e(?: version)?(?: 1 0)?", "ibm public licen", EXACT),
    ("intel", "intel open source licen[sc]e", "intel open source licen", EXACT),
    ("apsl", "apple public source licen[sc]e(?: version)?(?: [12] [0-2])?", "apple public source licen", EXACT),
    ("sun", "sun industry standards source licen[sc]e", "standards source licen", EXACT),
    ("spl", "sun public licen[sc]e(?: version)?(?: 1 0)?", "sun public licen", EXACT),
    ("bcl", "(?:sun microsystems|oracle) binary code licen[sc]e agreement", "binary code licen", EXACT),
    ("nposl", "non profit open software licen[sc]e(?: version)?(?: 3 0)?", "open software", EXACT),
    ("rpl", "reciprocal public licen[sc]e(?: version)?(?: 1 [15])?", "reciprocal public licen", EXACT),
    ("nokia", "nokia open source licen[sc]e", "nokia open source licen", EXACT),
    ("watcom", "sybase open watcom public licen[sc]e", "watcom public licen", EXACT),
    ("w3c", "w3c software (?:notice and )?licen[sc]e", "licen", EXACT),
    ("w3c", "w3c software and document notice and licen[sc]e", "notice and licen", EXACT),
    ("unicode", "unicode (?:inc )?licen[sc]e agreement", "licen", EXACT),
    ("icu", "icu licen[sc]e", "icu licen", EXACT),
    ("xfree86", "xfree86 licen[sc]e(?: 1 1)?", "xfree86 licen", EXACT),
    ("json", "the software shall be used for good not evil .{0,80}?copyright", "copyright", EXACT),
    ("json", "json licen[sc]e", "json licen", VERSIONED),
    ("beerware", "the beer ware licen[sc]e", "beer ware licen", EXACT),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document", "licen", EXACT),
    ("fsf", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", "licen", EXACT),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", "copyright notice and this notice are preserved", EXACT),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software .{0,300}?public domain", "public domain", EXACT),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "public domain", EXACT),
    ("cc0-1.0", "creative commons zero(?: v ?1 0)?(?: universal)?", "creative commons", EXACT),
    ("cc0-1.0", "to the extent possible under law .{0,80}?waived all copyright and related or neighbou?ring rights", "waived all copyright", EXACT),
    ("public-domain", "this (?:file|work|software|code) is (?:hereby )?(?:in|released into|placed in) the public domain", "public domain", EXACT),
    ("public-domain", "no copyright is claimed", "no copyright is claimed", VERSIONED),
    ("public-domain", "works? of the (?:us|united states) government .{0,80}?not subject to copyright", "not subject to copyright", EXACT),
    ("pddl", "open data commons public domain dedication and licen[sc]e", "public domain", EXACT),
    ("odc-by", "open data commons attribution licen[sc]e(?: v ?1 0)?", "data commons attribution licen", EXACT),
    ("odbl", "made available under the open database licen[sc]e", "open database", EXACT),
    ("dbcl", "database contents licen[sc]e(?: v ?1 0)?", "database contents licen", EXACT),
    ("ofl", "this font software is licen[sc]ed under the sil open font licen[sc]e", "open font", EXACT),
    ("ofl", "reserved font name .{0,60}?copyright", "copyright", VERSIONED),
    ("ufl", "ubuntu font licen[sc]e(?: version)?(?: 1 0)?", "ubuntu font licen", EXACT),
    ("bitstream", "bitstream vera fonts copyright", "fonts copyright", EXACT),
    ("arphic", "arphic public licen[sc]e", "arphic public licen", EXACT),
    ("ogl", "open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?", "open government licen", EXACT),
    ("ogl", "contains public sector information licen[sc]ed under", "sector information licen", EXACT),
    ("etalab", "licence ouverte(?: open licence)?", "licence ouverte", EXACT),
    ("dl-de", "datenlizenz deutschland .{0,30}?licen[sc]e", "licen", EXACT),
    ("cc-any", "some rights reserved .{0,60}?creative commons", "creative commons", VERSIONED),
    ("cc-any", "this work is licen[sc]ed under a creative commons", "creative commons", VERSIONED),
    ("cc-any", "to view a copy of this licen[sc]e visit http creativecommons org", "creativecommons", VERSIONED),
    ("cc-any", "creative commons 171 second street", "creative commons", EXACT),
    ("elastic", "elastic licen[sc]e(?: version)?(?: 2 0)?", "elastic licen", EXACT),
    ("sspl", "server side public licen[sc]e(?: version)?(?: 1)?", "side public licen", EXACT),
    ("busl", "business source licen[sc]e(?: 1 1)?", "business source licen", EXACT),
    ("busl", "additional use grant .{0,120}?change licen[sc]e", "change licen", EXACT),
    ("commons-clause", "the software is provided to you by the licensor under the licen[sc]e as defined below subject to the following condition", "licen", EXACT),
    ("commons-clause", "commons clause licen[sc]e condition", "commons clause licen", EXACT),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict) licen[sc]e", "licen", EXACT),
    ("hippocratic", "hippocratic licen[sc]e", "hippocratic licen", EXACT),
    ("anti-996", "anti 996 licen[sc]e", "anti 996 licen", EXACT),
    ("blueoak", "blue oak model licen[sc]e", "blue oak model licen", EXACT),
    ("mulan", "mulan (?:permissive software|psl) .{0,20}?licen[sc]e", "licen", EXACT),
    ("openrail", "(?:bigscience )?open ?rail (?:m )?licen[sc]e", "licen", EXACT),
    ("llama", "llama [23](?: [0-9])? community licen[sc]e agreement", "community licen", EXACT),
    ("commercial", "this software is licen[sc]ed not sold", "ed not sold", VERSIONED),
    ("commercial", "end user licen[sc]e agreement", "end user licen", VERSIONED),
    ("commercial", "by (?:installing|using|downloading) (?:this|the) software you (?:agree|accept) .{0,40}?licen[sc]e", "licen", VERSIONED),
    ("commercial", "commercial licen[sc]e (?:agreement|required|is available)", "commercial licen", VERSIONED),
    ("commercial", "you may not (?:reverse engineer|decompile|disassemble) .{0,120}?licen[sc]e", "licen", VERSIONED),
    ("non-commercial", "for (?:personal and )?non ?commercial use only .{0,60}?copyright", "copyright", VERSIONED),
    ("evaluation", "evaluation licen[sc]e(?: agreement)?", "evaluation licen", VERSIONED),
    ("freeware", "freeware licen[sc]e(?: agreement)?", "freeware licen", VERSIONED),
    ("contributor", "(?:individual |corporate )?contributor licen[sc]e agreement", "contributor licen", VERSIONED),
    ("dual", "dual licen[sc]ed under", "dual licen", NAMED),
    ("multiple", "at your option .{0,40}?(?:any later version|either) .{0,40}?licen[sc]e", "licen", NAMED),
    ("spdx", "spdx licen[sc]e identifier [^ ]+", "spdx", VERSIONED),
    ("spdx", "spdx filecopyrighttext", "spdx", VERSIONED),
    ("copyright", "copyright (?:c )?(?:by )?the (?:authors?|contributors)", "copyright", NAMED),
    ("copyright", "copyright holders?(?: and contributors)?", "copyright holder", NAMED),
    ("copyright", "copyrighted (?:material|work)", "copyrighted", NAMED),
    ("copyright", "portions copyright", "portions copyright", NAMED),
    ("no-warranty", "no warranty (?:is )?(?:expressed|express|given|provided)", "no warranty", NAMED),
    ("no-warranty", "as is (?:and )?without (?:any )?(?:express or implied )?warranty", "warranty", NAMED),
    ("no-warranty", "implied warranty of merchantability", "warranty of merchantability", NAMED),
    ("licensed", "see the (?:file )?licen[sc]e (?:file )?for (?:details|more information|the full text)", "licen", NAMED),
    ("licensed", "this (?:project|work|file|library|code) is licen[sc]ed under", "ed under", NAMED),
    ("licensed", "(?:subject to|governed by) the (?:terms of the )?licen[sc]e", "licen", NAMED),
    ("patent", "(?:a )?patent licen[sc]e", "patent licen", NAMED),
    ("royalty-free", "royalty free (?:worldwide )?licen[sc]e", "licen", NAMED),
]


def signatures() -> list[Signature]:
    """The rules in their order: base phrases first, then the families, names, phrases and sentences.

    Phrases and sentences of some hundred licences are written by hand; every family with its versions,
    in words, as an identifier (``gpl 2 0 only``) and with "version" or "v" before the number, adds to them.
    """
    rules = list(BASE)
    for label, title, keyword, versions in _FAMILIES:
        for version in versions:
            name = f"{label}-{version.replace(' ', '.')}"
            rules.append(Signature(name, rf"{title},? (?:as published .{{1,60}}? )?(?:version |v ?)?{version}", keyword, EXACT))
            rules.append(Signature(name, rf"spdx licen[sc]e identifier {label} {version}(?: 0)?(?: only| or later)?", "spdx", EXACT))
            rules.append(Signature(name, rf"{label} ?v?{version}(?: 0)?(?: only| or later)", label, EXACT))
            rules.append(Signature(name, rf"{label} (?:version |v ?){version}", label, VERSIONED))
            rules.append(Signature(f"{name}+", rf"{title} .{{0,40}}?version {version} .{{0,80}}?any later version", keyword, EXACT))
        rules.append(Signature(label, title, keyword, NAMED))
    for parts in _CC:
        label, short = "cc-" + parts.replace(" ", "-"), parts
        long = " ".join(_CC_WORDS[p] for p in parts.split())
        for version in _CC_VERSIONS:
            rules.append(Signature(f"{label}-{version.replace(' ', '.')}", rf"cc {short} {version}", "cc by", EXACT))
            rules.append(Signature(f"{label}-{version.replace(' ', '.')}", rf"creative commons {long} {version}", "creative commons", EXACT))
            rules.append(Signature(f"{label}-{version.replace(' ', '.')}", rf"creativecommons org licenses {short} {version}", "creativecommons", EXACT))
        rules.append(Signature(label, rf"creative commons {long}", "creative commons", VERSIONED))
        rules.append(Signature(label, rf"cc {short}", "cc by", NAMED))
    rules.append(Signature("cc0", r"cc0(?: 1 0)?", "cc0", VERSIONED))
    rules += [Signature(*phrase) for phrase in _PHRASES + _SENTENCES]
    return rules


# A text without any of these has no match of any rule: each keyword above contains one of them.
def gate_words(rules: Sequence[Signature]) -> list[str]:
    """Shortest literals such that every rule's keyword contains one of them."""
    out: list[str] = []
    for word in sorted({r.keyword for r in rules}, key=lambda w: (len(w), w)):
        if not any(kept in word for kept in out):
            out.append(word)
    return out


def rules_by_gate(rules: Sequence[Signature]) -> dict[str, dict[str, list[int]]]:
    """Numbers of the rules by gate word and keyword: each keyword stands below one gate word that it contains."""
    gates: dict[str, dict[str, list[int]]] = {word: {} for word in gate_words(rules)}
    for i, rule in enumerate(rules):
        gate = next(word for word in gates if word in rule.keyword)
        gates[gate].setdefault(rule.keyword, []).append(i)
    return gates


def words_of_text(text: Column) -> Column:
    """Words of the text, A-Z lower-cased."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


PLACES = "array<struct<gap:int,length:int>>"


def _places(norm: Column, pattern: Column) -> Column:
    """All matches in `` w0 w1 … ``: the words between a match and the one before, and its own number.

    ``pattern`` looks for a space before and after.  Every word is followed by one space, and a match begins after a space and ends before one.  Where
    a match begins is a running sum, taken when matches are rows: nothing grows in here.
    """
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    pieces = F.split(norm, pattern)
    return F.zip_with(
        F.slice(pieces, 1, F.size(found)), found,
        lambda piece, match: F.struct(
            _spaces(piece).cast("int").alias("gap"), (_spaces(match) + 1).cast("int").alias("length")
        ),
    )


def detect(docs: DataFrame, rules: Sequence[Signature], id_column: str, text_column: str) -> DataFrame:
    """Per document: ``row, id, n_words`` and all ``found`` intervals, before any is suppressed.

    One narrow pass over whole texts, written once; no text leaves it.  Of a text that has a gate word,
    only the keywords of its gate words are looked for, each once for all its rules.
    """
    prepare(docs.sparkSession)
    rule = lambda i: F.struct(
        F.lit(i).alias("id"), F.lit(f"(?<= )(?:{rules[i].pattern})(?= )").alias("pattern")
    )
    table = F.array(*(
        F.struct(F.lit(gate).alias("gate"), F.array(*(
            F.struct(F.lit(keyword).alias("keyword"), F.array(*(rule(i) for i in numbers)).alias("rules"))
            for keyword, numbers in keywords.items()
        )).alias("keywords"))
        for gate, keywords in rules_by_gate(rules).items()
    ))
    words = docs.select(
        F.col(f"`{id_column}`").alias("id"), words_of_text(F.col(f"`{text_column}`")).alias("words")
    )
    norm = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    gated = words.select("id", F.size("words").cast("bigint").alias("n_words"), norm.alias("norm"))
    hit = F.lit(False)
    for word in gate_words(rules):
        hit = hit | F.contains("norm", F.lit(word))
    asked = F.flatten(F.transform(F.filter(table, lambda g: F.contains("norm", g["gate"])), lambda g: g["keywords"]))
    tried = F.flatten(F.transform(F.filter(asked, lambda k: F.contains("norm", k["keyword"])), lambda k: k["rules"]))
    matched = F.filter(tried, lambda r: F.rlike("norm", r["pattern"]))
    places = F.transform(
        matched, lambda r: F.struct(r["id"].alias("rule"), _places(F.col("norm"), r["pattern"]).alias("places"))
    )
    none = F.array().cast(f"array<struct<rule:int,places:{PLACES}>>")
    return materialize(
        gated.select(
            F.monotonically_increasing_id().alias("row"), "id", "n_words",
            F.when(hit, places).otherwise(none).alias("found"),
        ),
        "detections",
    )


def surviving(detections: DataFrame, rules: Sequence[Signature]) -> DataFrame:
    """Detections ``row, rule, start, stop, stays``: a contained one does not stay.

    The widest end so far among intervals of the same or a higher priority decides, so the work
    follows the number of detections.
    """
    priority = F.array(*(F.lit(r.priority) for r in rules))
    matches = detections.select("row", F.explode("found").alias("d")).select(
        "row", "d.rule", F.posexplode("d.places").alias("nth", "p")
    )
    # the space after a match opens the next piece and is counted there
    along = Window.partitionBy("row", "rule").orderBy("nth")
    gaps = F.sum("p.gap").over(along.rowsBetween(Window.unboundedPreceding, 0))
    words = F.sum(F.col("p.length") - 1).over(along.rowsBetween(Window.unboundedPreceding, -1))
    start = (gaps + F.coalesce(words, F.lit(0)) - 1).cast("int")
    rows = matches.withColumn("start", start).select(
        "row", "rule", "start", (F.col("start") + F.col("p.length")).alias("stop"),
        F.get(priority, F.col("rule")).alias("priority"),
    )
    before = (
        Window.partitionBy("row")
        .orderBy("start", F.desc("stop"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.lit(False)
    for level in (NAMED, VERSIONED, EXACT):
        reach = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(before)
        covered = covered | ((F.col("priority") == level) & F.coalesce(reach >= F.col("stop"), F.lit(False)))
    return rows.withColumn("stays", ~covered)


def scan(
    docs: DataFrame, rules: Sequence[Signature] | None = None, base: int = len(BASE),
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Labels of every document: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The first ``base`` rules are kept whatever contains them.  ``score`` is one minus the product
    of the doubts left by the labels found, each label counted once by its best detection.
    """
    rules = list(signatures() if rules is None else rules)
    found = detect(docs, rules, id_column, text_column)
    kept = surviving(found, rules).filter(F.col("stays") | (F.col("rule") < base))
    name = F.get(F.array(*(F.lit(r.label) for r in rules)), F.col("rule"))
    doubt = F.get(F.array(*(F.lit(1 - WEIGHTS[r.priority]) for r in rules)), F.col("rule"))
    is_base = F.col("rule") < base
    labels = kept.groupBy("row", name.alias("label")).agg(
        F.min(doubt).alias("doubt"),
        F.count_if(is_base).alias("places"),
        F.min(F.when(is_base, F.col("start"))).alias("first"),
        F.max(F.when(is_base, F.col("start"))).alias("last"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    per_row = labels.groupBy("row").agg(
        F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        joined(F.collect_set(F.when(F.col("places") > 0, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        # in the order of the labels, so that the product does not depend on the order of arrival
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("label", "doubt"))), F.lit(1.0), lambda a, x: a * x["doubt"]
        ).alias("doubt"),
    )
    return found.select("row", "id", "n_words").join(per_row, "row", "left").select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        (1 - F.coalesce("doubt", F.lit(1.0))).alias("score"),
    )
