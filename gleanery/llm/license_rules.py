"""Signature rules of the license scan.

Rules are patterns over normalised text: lower-case words joined by one space, so
`Apache-2.0` reads `apache 2 0`. Each has keywords (parted by |) of which every match
holds one at least; patterns are tried only near them. Each has a label, a priority and
a score. There are names of licenses in phrases, short names, SPDX identifiers with and
without their tag, and sentences of license texts and headers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keyword, name as a pattern. `{v}` takes a version, which the label then ends with.
LICENSES = [
    ("apache", "apache", r"apache(?: software)? licen[sc]e{v}"),
    ("mit", "license|licence", r"(?:mit|expat|mit expat) licen[sc]e"),
    ("mit-x11", "x11", r"x11 licen[sc]e"),
    ("gpl", "gnu", r"gnu general public licen[sc]e{v}"),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e{v}"),
    ("lgpl", "library", r"gnu library general public licen[sc]e{v}"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e{v}"),
    ("gfdl", "gnu", r"gnu free documentation licen[sc]e{v}"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|(?:2|two) clause bsd|bsd 2 clause) licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|(?:3|three) clause bsd|bsd 3 clause) licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|(?:4|four) clause bsd|bsd 4 clause) licen[sc]e"),
    ("bsd", "bsd", r"bsd licen[sc]e"),
    ("0bsd", "0bsd", r"0bsd licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e{v}"),
    ("epl", "eclipse", r"eclipse public licen[sc]e{v}"),
    ("eupl", "union", r"european union public licen[sc]e{v}"),
    ("cddl", "distribution", r"common development and distribution licen[sc]e{v}"),
    ("cpl", "common", r"common public licen[sc]e{v}"),
    ("artistic", "artistic", r"artistic licen[sc]e{v}"),
    ("zlib", "zlib", r"zlib licen[sc]e"),
    ("bsl", "boost", r"boost software licen[sc]e{v}"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("psf", "python", r"python software foundation licen[sc]e{v}"),
    ("php", "php", r"php licen[sc]e{v}"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ofl", "sil", r"sil open font licen[sc]e{v}"),
    ("osl", "software", r"open software licen[sc]e{v}"),
    ("afl", "academic", r"academic free licen[sc]e{v}"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("apsl", "apple", r"apple public source licen[sc]e{v}"),
    ("ibm-pl", "ibm", r"ibm public licen[sc]e{v}"),
    ("qpl", "q", r"q public licen[sc]e{v}"),
    ("lppl", "latex", r"latex project public licen[sc]e{v}"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("upl", "universal", r"universal permissive licen[sc]e{v}"),
    ("bsl-business", "business", r"business source licen[sc]e{v}"),
    ("elastic", "elastic", r"elastic licen[sc]e{v}"),
    ("sspl", "server", r"server side public licen[sc]e{v}"),
    ("odbl", "database", r"open database licen[sc]e{v}"),
    ("odbl", "odbl", r"odbl{v}"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e{v}"),
    ("odc-by", "odc", r"odc attribution licen[sc]e{v}"),
    ("pddl", "dedication", r"public domain dedication and licen[sc]e{v}"),
    ("pddl", "pddl", r"pddl{v}"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd{v}"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa{v}"),
    ("cc-by-nc", "cc", r"cc by nc{v}"),
    ("cc-by-nd", "cc", r"cc by nd{v}"),
    ("cc-by-sa", "cc", r"cc by sa{v}"),
    ("cc-by", "cc", r"cc by{v}"),
    ("cc0", "cc0", r"cc0{v}"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?{v}"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike{v}"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial{v}"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?{v}"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike{v}"),
    ("cc-by", "creative", r"creative commons attribution{v}"),
    ("proprietary", "proprietary", r"proprietary licen[sc]e"),
]

#: The words around a name, with priority and score. `{name}` stands for the name.
PHRASES = [
    (r"(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 90, 1.0),
    (r"(?:is|are) (?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?{name}", 80, 0.9),
    (r"(?:see|read|under|accept|copy of) (?:the )?{name}", 60, 0.8),
    (r"{name}", 40, 0.6),
]

#: Label, keyword, a way to name a license without saying so in full.
SHORT = [
    ("gpl", "gpl", r"(?:gnu )?gpl v?{n}"),
    ("gpl", "gnu", r"gnu gpl"),
    ("gpl", "gplv1", r"gplv(1)"),
    ("gpl", "gplv2", r"(?:gnu )?gplv(2)"),
    ("gpl", "gplv3", r"(?:gnu )?gplv(3)"),
    ("gpl", "gpl", r"gpl licen[sc]ed?"),
    ("gpl", "gpl", r"(?:licensed|released|distributed) under (?:the )?gpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl v?{n}"),
    ("lgpl", "lgpl", r"gnu lgpl"),
    ("lgpl", "lgplv2", r"(?:gnu )?lgplv(2(?: 1)?)"),
    ("lgpl", "lgplv3", r"(?:gnu )?lgplv(3)"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed) under (?:the )?lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl v?{n}"),
    ("agpl", "agpl", r"gnu agpl"),
    ("agpl", "agplv3", r"(?:gnu )?agplv(3)"),
    ("apache", "apache", r"apache v?{n}"),
    ("apache", "apache", r"apache v(2)"),
    ("apache", "apache", r"apache licen[sc]ed"),
    ("apache", "asl", r"asl v?{n}"),
    ("bsd", "bsd", r"bsd style licen[sc]e"),
    ("bsd", "bsd", r"bsd licen[sc]ed"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[sc]e"),
    ("bsd-2-clause", "clause", r"(?:2|two) clause bsd"),
    ("bsd-3-clause", "clause", r"(?:3|three) clause bsd"),
    ("bsd-4-clause", "clause", r"(?:4|four) clause bsd"),
    ("mit", "style", r"mit style licen[sc]e"),
    ("mit", "licensed|licenced", r"mit licen[sc]ed"),
    ("mit", "x11", r"mit x11(?: licen[sc]e)?"),
    ("mpl", "mpl", r"mpl v?{n}"),
    ("mpl", "mplv2", r"mplv(2)"),
    ("epl", "epl", r"epl v?{n}"),
    ("eupl", "eupl", r"eupl v?{n}"),
    ("cddl", "cddl", r"cddl v?{n}"),
    ("ofl", "ofl", r"(?:sil )?ofl{v}"),
    ("bsl", "bsl", r"bsl v?{n}"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("cc0", "zero", r"(?:cc|creative commons) zero"),
    ("cc", "creative", r"creative commons licen[sc]e"),
    ("gfdl", "gfdl", r"gfdl{v}"),
    ("sspl", "sspl", r"sspl{v}"),
]

#: Identifiers of the public SPDX list that occur most.
SPDX = """
0BSD AAL AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0
CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0
CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0
EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC JSON
LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c
MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01
PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL SSPL-1.0 TCL Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.0 ZPL-2.1
""".split()

#: Sentences of license texts, headers and notices: label, keyword, pattern.
TEXTS = [
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "substantial", r"this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("hpnd", "fee", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "gnu", r"see the gnu general public licen[sc]e for more details"),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e"),
    ("gpl", "foundation", r"as published by the free software foundation either version (\d+) of the licen[sc]e"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "library", r"under the terms of the gnu library general public licen[sc]e"),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[sc]e"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("apache", "compliance", r"you may not use this (?:file|work) except in compliance with the licen[sc]e"),
    ("apache", "asf", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("apache", "governing", r"see the licen[sc]e for the specific language governing permissions and limitations"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", "distribution", r"subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", "union|eupl", r"licensed under the eupl|european union public licen[sc]e the eupl"),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty"),
    ("bsl", "boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("bsl", "organization", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0", "waived", r"to the extent possible under law (?:[0-9a-z]+ ){1,10}has waived all copyright"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by (\d \d)"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa (\d \d)"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc (\d \d)"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd (\d \d)"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa (\d \d)"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd (\d \d)"),
    ("ofl", "sil", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "font", r"the font software may not be sold by itself|the font software when distributed using a reserved font name"),
    ("psf", "python", r"python software foundation licen[sc]e version (\d)"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php", "php", r"this product includes php software"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("postgresql", "agreement", r"without a written agreement is hereby granted"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl"),
    ("bsl-business", "change", r"change licen[sc]e|change date (?:means|is)"),
    ("sspl", "functionality", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"you can buy me a beer in return|beer ware licen[sc]e"),
    ("ncsa", "illinois", r"developed by (?:[0-9a-z]+ ){1,8}university of illinois"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e ms pl"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|distribution|reproduction) (?:of this (?:file|document|software) )?(?:via any medium )?is (?:strictly )?prohibited"),
    ("noncommercial", "commercial", r"(?:for )?non commercial use only|not for commercial use"),
]

#: Rules that stand alone.
ALONE = [
    Rule("spdx", "spdx", r"spdx licen[sc]e identifier", 30, 0.5),
    Rule("reserved", "reserved", r"all rights (?:are )?reserved", 70, 0.7),
    Rule("reserved", "reserved", r"some rights reserved", 65, 0.6),
    Rule("copyright", "copyright", r"copyright(?: c)?(?: \d{4})+", 30, 0.4),
    Rule("public-domain", "domain", r"(?:in|into|to) the public domain", 50, 0.6),
    Rule("no-warranty", "warranty", r"without warranty of any kind(?: express or implied)?", 20, 0.4),
]

#: No pattern matches more words than this, but for lists of years.
MOST_WORDS = 40
_VERSION = r"(?: (?:version |v)?(\d+(?: \d+)?)(?! \d))?"
#: A version that has to be there.
_NUMBER = r"(\d(?: \d+)?)(?! \d)"
#: Words between an SPDX tag and a further identifier of its expression.
_BEFORE = r"(?:(?:[0-9a-z]+ ){1,24}(?:or|and|with) )?"
#: Identifiers that say nothing without the tag, being words or short names of other things.
_WORDS = {"hpnd", "icu", "isc", "json", "mit", "aal", "ncsa", "ruby", "tcl", "vim", "w3c", "x11", "zlib", "postgresql", "sissl"}


def _words(identifier: str) -> str:
    return identifier.lower().replace("-", " ").replace(".", " ")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order: phrases around names, short names, SPDX identifiers, sentences, and the rest."""
    made = [Rule(label, keyword, phrase.replace("{name}", name.replace("{v}", _VERSION)), priority, score) for label, keyword, name in LICENSES for phrase, priority, score in PHRASES]
    made += [Rule(label, keyword, pattern.replace("{v}", _VERSION).replace("{n}", _NUMBER), 45, 0.7) for label, keyword, pattern in SHORT]
    for x in SPDX:
        # "or later" is part of the longer identifier, which holds the shorter one
        made.append(Rule(x.lower(), "spdx", rf"spdx licen[sc]e identifier {_BEFORE}(?P<at>{_words(x)})", 95, 1.0))
        if x.lower() not in _WORDS:
            made.append(Rule(x.lower(), _words(x).split(" ")[0], _words(x), 55, 0.8))
    made += [Rule(label, keyword, pattern, 100, 1.0) for label, keyword, pattern in TEXTS]
    return (*made, *ALONE)
