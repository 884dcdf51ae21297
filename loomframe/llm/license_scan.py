"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words, which one space joins. Hundreds of hand-written signatures (names,
identifiers, grants and sentences of license texts) are regular expressions over that string. A keyword prefilter decides which may run: first a
few stems that every signature needs one of, then one Aho-Corasick pass that names the signatures whose keyword occurs.
Priorities are settled from the highest down, each in one sweep over the places: a detection that lies inside another of
its priority is suppressed (of equal ones the first signature stays), and so is one that overlaps a detection of a higher
priority.

Defined cases: a null or empty text has no words, no places and empty labels; repeated rows are judged each for itself;
very long texts take time and memory in proportion to their length; columns other than the key and the text are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words are runs of ASCII digits and letters and of all characters beyond ASCII.
_CANON = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: What stands for itself in the signatures: {I} a machine-readable identifier, {G} a grant.
PARTS = {
    "{I}": "spdx license identifier ",
    "{G}": "(?:licensed|released|distributed|available|published|provided|redistributed|covered|shared) under (?:the |an? )?(?:terms of )?(?:the |an? )?",
}

#: Signatures in their order: label; keyword; priority; weight; regular expression over canonical words. Every match holds
#: the keyword and one of `STEMS`.
SIGNATURES = r"""
mit; mit; 9; 0.99; {I}mit
mit; mit; 8; 0.95; {G}(?:expat )?mit(?: licen[sc]e)?
mit; mit; 7; 0.95; (?:the )?expat mit licen[sc]e
mit; mit; 5; 0.9; (?:the )?mit licen[sc]e
mit; mit; 4; 0.7; licen[sc]e (?:is )?mit
mit; mit; 6; 0.8; mit licen[sc]ed
mit; mit; 6; 0.85; see (?:the )?(?:accompanying )?(?:file )?licen[sc]e (?:for |with )?(?:the )?mit(?: licen[sc]e)?
mit; dual licensed; 7; 0.85; dual licensed under (?:the )?mit
mit; permission is hereby granted free of charge; 8; 0.97; permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?
mit; without limitation the rights; 8; 0.95; deal in the software without restriction including without limitation the rights to use
mit; the above copyright notice and this permission; 8; 0.9; the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies
mit; the software is provided as is; 6; 0.6; the software is provided as is without warranty of any kind
mit-modern; permission is hereby granted without written; 8; 0.9; permission is hereby granted without written agreement and without licen[sc]e or royalty fees
mit-0; mit; 9; 0.99; {I}mit 0
mit-0; mit no attribution; 8; 0.97; (?:{G})?(?:the )?mit no attribution licen[sc]e
mit-0; mit 0; 7; 0.9; mit 0 licen[sc]e
apache; apache; 9; 0.99; {I}apache(?: \d+)*
apache; apache; 8; 0.97; {G}apache(?: software)?(?: licen[sc]e)?(?: version)?(?: v?\d+)*
apache; apache; 7; 0.95; apache(?: software)? licen[sc]e(?: version)? v?\d+(?: \d+)*
apache; apache; 5; 0.9; (?:the )?apache(?: software)? licen[sc]e
apache; apache; 4; 0.7; licen[sc]e (?:is )?apache(?: \d+)*
apache; apache; 4; 0.6; apache licen[sc]ed
apache; asf; 8; 0.95; licensed to the apache software foundation asf under one or more contributor license agreements
apache; you may not use this file except in compliance; 8; 0.97; you may not use this file except in compliance with the license
apache; apache org licenses; 8; 0.95; apache org licenses license \d+ \d+
apache; unless required by applicable law; 7; 0.85; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache; terms and conditions for use reproduction; 8; 0.95; terms and conditions for use reproduction and distribution(?: \d+)? definitions license shall mean
apache-1.1; end user documentation included with the redistribution; 8; 0.9; the end user documentation included with the redistribution if any must include the following acknowledgment
gpl; gpl; 9; 0.99; {I}gpl(?: \d+)*(?: only| or later)?
gpl; gpl; 8; 0.97; {G}(?:gnu )?gpl(?: licen[sc]e)?(?: version)?(?: v?\d+)*
gpl; gplv; 8; 0.95; {G}(?:gnu )?gplv\d(?: \d)?
gpl; gplv; 5; 0.85; (?:gnu )?gplv\d(?: \d)?(?: only| or later)? licen[sc]ed?
gpl; gpl v; 4; 0.7; (?:gnu )?gpl v ?\d(?: \d)?
gpl; gpl version; 4; 0.75; (?:gnu )?gpl version \d
gpl; gpl; 5; 0.85; (?:the )?(?:gnu )?gpl licen[sc]ed?
gpl; gpl; 4; 0.7; licen[sc]e (?:is )?(?:gnu )?gpl(?:v\d)?(?: \d+)*
gpl; general public; 8; 0.97; {G}(?:gnu )?general public licen[sc]e(?: version)?(?: v?\d+)*
gpl; general public; 7; 0.95; gnu general public licen[sc]e(?: version)? v?\d+(?: \d+)*(?: only| or later| or any later version)?
gpl; general public; 5; 0.9; (?:the )?(?:gnu )?general public licen[sc]e
gpl; you can redistribute it and or modify it; 8; 0.95; this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl; the licenses for most software; 8; 0.95; the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change
gpl; you should have received a copy of the gnu general; 8; 0.95; you should have received a copy of the gnu general public license
gpl; how to apply these terms; 6; 0.8; how to apply these terms to your new programs
gpl; gnu org licenses gpl; 7; 0.9; gnu org licenses gpl(?: \d+)*
gpl; gnu org copyleft gpl; 7; 0.9; gnu org copyleft gpl
gpl-classpath-exception; classpath exception; 8; 0.95; (?:with )?(?:the )?classpath exception(?: \d \d)?
gpl-linking-exception; linking this library statically; 8; 0.95; linking this library statically or dynamically with other modules
gpl-gcc-exception; gcc runtime library exception; 8; 0.95; gcc runtime library exception
lgpl; lgpl; 9; 0.99; {I}lgpl(?: \d+)*(?: only| or later)?
lgpl; lgpl; 8; 0.97; {G}(?:gnu )?lgpl(?:v\d)?(?: licen[sc]e)?(?: version)?(?: v?\d+)*
lgpl; lgpl; 5; 0.85; (?:gnu )?lgpl(?:v\d)?(?: \d)* licen[sc]ed?
lgpl; lgplv; 4; 0.75; (?:gnu )?lgplv\d
lgpl; lgpl; 4; 0.7; licen[sc]e (?:is )?lgpl(?: \d+)*
lgpl; lesser general; 8; 0.97; {G}(?:gnu )?lesser general public licen[sc]e(?: version)?(?: v?\d+)*
lgpl; lesser general; 7; 0.95; gnu lesser general public licen[sc]e(?: version)? v?\d+(?: \d+)*
lgpl; lesser general; 6; 0.92; (?:the )?(?:gnu )?lesser general public licen[sc]e
lgpl; library general; 6; 0.92; (?:the )?gnu library general public licen[sc]e
lgpl; gnu org licenses lgpl; 7; 0.9; gnu org licenses lgpl(?: \d+)*
agpl; agpl; 9; 0.99; {I}agpl(?: \d+)*(?: only| or later)?
agpl; agpl; 8; 0.97; {G}(?:gnu )?agpl(?:v\d)?(?: licen[sc]e)?(?: version)?(?: v?\d+)*
agpl; agpl; 5; 0.85; (?:gnu )?agpl(?:v\d)?(?: \d)* licen[sc]ed?
agpl; agplv; 4; 0.75; (?:gnu )?agplv\d
agpl; agpl; 4; 0.7; licen[sc]e (?:is )?agpl(?: \d+)*
agpl; affero; 8; 0.97; {G}(?:gnu )?affero general public licen[sc]e(?: version)?(?: v?\d+)*
agpl; affero; 6; 0.92; (?:the )?(?:gnu )?affero general public licen[sc]e(?: version)?(?: v?\d+)*
agpl; remote network interaction; 7; 0.85; remote network interaction use with the gnu general public license
gfdl; gfdl; 9; 0.99; {I}gfdl(?: \d+)*(?: only| or later)?
gfdl; gfdl; 8; 0.95; {G}(?:gnu )?gfdl(?: \d+)*
gfdl; gfdl; 5; 0.85; (?:gnu )?gfdl licen[sc]e
gfdl; free documentation; 8; 0.97; {G}(?:gnu )?free documentation licen[sc]e(?: version)?(?: \d+)*
gfdl; free documentation; 6; 0.92; (?:the )?(?:gnu )?free documentation licen[sc]e
gfdl; with no invariant sections; 8; 0.95; with no invariant sections no front cover texts and no back cover texts
bsd; bsd; 8; 0.93; {G}(?:berkeley )?bsd(?: style)?(?: licen[sc]e)?
bsd; bsd; 5; 0.88; (?:the )?(?:berkeley )?bsd(?: style)? licen[sc]e
bsd; bsd; 4; 0.7; licen[sc]e (?:is )?bsd
bsd; bsd licensed; 4; 0.7; bsd licensed
bsd; redistribution and use in source and binary forms; 8; 0.97; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd; redistributions of source code must retain; 7; 0.92; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd; redistributions in binary form must reproduce; 7; 0.92; redistributions in binary form must reproduce the above copyright notice
bsd; use of this source code is governed by a bsd; 8; 0.95; use of this source code is governed by a bsd style license
bsd-2-clause; bsd; 9; 0.99; {I}bsd 2 clause
bsd-2-clause; bsd; 8; 0.97; {G}(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?
bsd-2-clause; bsd; 6; 0.93; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[sc]e
bsd-3-clause; bsd; 9; 0.99; {I}bsd 3 clause(?: clear)?
bsd-3-clause; bsd; 8; 0.97; {G}(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-3-clause; bsd; 6; 0.93; (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
bsd-3-clause; may be used to endorse or promote; 8; 0.95; neither the name (?:\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause; bsd; 9; 0.99; {I}bsd 4 clause(?: uc)?
bsd-4-clause; bsd; 6; 0.93; (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd) licen[sc]e
bsd-4-clause; all advertising materials; 8; 0.95; all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-patent; bsd; 9; 0.99; {I}bsd 2 clause patent
0bsd; 0bsd; 9; 0.99; {I}0bsd
0bsd; bsd; 8; 0.95; {G}(?:zero clause bsd|0bsd)(?: licen[sc]e)?
0bsd; bsd; 7; 0.93; (?:zero clause bsd|0bsd)(?: licen[sc]e)
mpl; mpl; 9; 0.99; {I}mpl(?: \d+)*(?: no copyleft exception)?
mpl; mpl; 8; 0.95; {G}mpl(?: licen[sc]e)?(?: version)?(?: v?\d+)*
mpl; mpl; 5; 0.85; mpl(?: v?\d+)* licen[sc]ed?
mpl; mozilla; 8; 0.97; {G}mozilla public licen[sc]e(?: version)?(?: v?\d+)*
mpl; mozilla; 7; 0.95; mozilla public licen[sc]e(?: version)? v?\d+(?: \d+)*
mpl; mozilla; 5; 0.9; (?:the )?mozilla public licen[sc]e
mpl; subject to the terms of the mozilla; 8; 0.97; this source code form is subject to the terms of the mozilla public license
mpl; mozilla org mpl; 7; 0.9; mozilla org mpl(?: \d+)*
epl; epl; 9; 0.99; {I}epl(?: \d+)*
epl; epl; 8; 0.93; {G}epl(?: v?\d+)*
epl; epl; 5; 0.85; epl(?: v?\d+)* licen[sc]e
epl; eclipse; 8; 0.97; {G}eclipse (?:public|distribution) licen[sc]e(?: version)?(?: v?\d+)*
epl; eclipse; 6; 0.92; (?:the )?eclipse public licen[sc]e(?: version)?(?: v?\d+)*
epl; accompanying materials are made available; 8; 0.95; this program and the accompanying materials are made available under the terms of the eclipse public license
cddl; cddl; 9; 0.99; {I}cddl(?: \d+)*
cddl; cddl; 8; 0.93; {G}cddl(?: v?\d+)*
cddl; cddl; 5; 0.85; cddl(?: v?\d+)* licen[sc]e
cddl; common development; 6; 0.93; common development and distribution licen[sc]e(?: version)?(?: v?\d+)*
cddl; common development; 8; 0.97; {G}common development and distribution licen[sc]e
cpl; cpl; 9; 0.99; {I}cpl(?: \d+)*
cpl; common public; 6; 0.92; common public licen[sc]e(?: version)?(?: v?\d+)*
cpl; cpl; 8; 0.9; {G}cpl(?: v?\d+)*
ipl; ibm public; 6; 0.92; ibm public licen[sc]e(?: version)?(?: v?\d+)*
eupl; eupl; 9; 0.99; {I}eupl(?: \d+)*
eupl; eupl; 8; 0.95; {G}eupl(?: v?\d+)*
eupl; eupl; 5; 0.88; (?:the )?eupl(?: v?\d+)* licen[sc]e
eupl; european union public; 6; 0.95; european union public licen[sc]e(?: version)?(?: v?\d+)*
cecill; cecill; 9; 0.99; {I}cecill(?: \S+)?(?: \d+)*
cecill; cecill; 8; 0.95; {G}cecill(?: [bc])?(?: licen[sc]e)?
cecill; cecill; 5; 0.9; cecill(?: [bc])? licen[sc]e
cecill; cecill; 6; 0.9; licence cecill
isc; isc; 9; 0.99; {I}isc
isc; isc; 8; 0.95; {G}isc licen[sc]e
isc; isc; 5; 0.9; (?:the )?isc licen[sc]e
isc; isc; 4; 0.7; licen[sc]e (?:is )?isc
isc; permission to use copy modify and or distribute; 8; 0.95; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; permission to use copy modify and distribute; 7; 0.85; permission to use copy modify and distribute this software (?:and its documentation )?for any purpose
zlib; zlib; 9; 0.99; {I}zlib
zlib; zlib; 8; 0.95; {G}zlib(?: libpng)? licen[sc]e
zlib; zlib; 5; 0.9; (?:the )?zlib(?: libpng)? licen[sc]e
zlib; the origin of this software must not be misrepresented; 8; 0.97; the origin of this software must not be misrepresented
zlib; altered source versions must be plainly marked; 8; 0.95; altered source versions must be plainly marked as such
libpng; libpng; 6; 0.9; libpng licen[sc]e(?: version)?(?: \d+)*
boost; boost; 8; 0.97; {G}boost software licen[sc]e(?: version)?(?: \d+)*
boost; boost; 6; 0.93; (?:the )?boost software licen[sc]e(?: version)?(?: \d+)*
boost; bsl 1 0; 9; 0.99; {I}bsl 1 0
boost; bsl 1 0; 6; 0.85; bsl 1 0 licen[sc]e
boost; boost org license; 7; 0.9; boost org license 1 0
boost; permission is hereby granted free of charge; 8; 0.96; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
artistic; artistic; 9; 0.99; {I}artistic(?: \S+)?(?: \d+)*
artistic; artistic; 8; 0.95; {G}(?:perl )?artistic licen[sc]e(?: version)?(?: \d+)*
artistic; artistic; 5; 0.9; (?:the )?(?:perl )?artistic licen[sc]e(?: version)?(?: \d+)*
artistic; under the same terms as perl; 8; 0.9; under the same terms as perl itself
python; psf; 9; 0.99; {I}psf(?: \d+)*
python; psf; 8; 0.92; {G}psf(?: licen[sc]e)?
python; psf; 5; 0.85; psf licen[sc]e
python; python software foundation; 6; 0.93; python software foundation licen[sc]e(?: version)?(?: \d+)*
python; python software foundation; 8; 0.95; {G}python software foundation licen[sc]e
python; python; 9; 0.99; {I}python 2 0
unlicense; unlicense; 9; 0.99; {I}unlicense
unlicense; unlicense; 8; 0.95; {G}unlicense
unlicense; unlicense; 5; 0.88; (?:the )?unlicense(?: licen[sc]e)?
unlicense; free and unencumbered software; 8; 0.97; this is free and unencumbered software released into the public domain
unlicense; anyone is free to copy modify; 8; 0.95; anyone is free to copy modify publish use compile sell or distribute this software
unlicense; unlicense org; 7; 0.9; unlicense org
wtfpl; wtfpl; 9; 0.99; {I}wtfpl
wtfpl; wtfpl; 8; 0.95; {G}wtfpl
wtfpl; wtfpl; 5; 0.9; wtfpl(?: version \d)? licen[sc]e
wtfpl; what the f; 8; 0.95; do what the f\S+ you want to public licen[sc]e
beerware; beer; 8; 0.9; (?:{G})?(?:the )?beer ?ware licen[sc]e(?: revision \d+)?
beerware; you can buy me a beer; 8; 0.9; you can buy me a beer in return(?: licen[sc]e)?
postgresql; postgresql; 9; 0.99; {I}postgresql
postgresql; postgresql; 8; 0.95; {G}postgresql licen[sc]e
postgresql; postgresql; 5; 0.9; (?:the )?postgresql licen[sc]e
ofl; ofl; 9; 0.99; {I}ofl(?: \d+)*
ofl; ofl; 8; 0.93; {G}(?:sil )?ofl(?: \d+)*
ofl; open font; 8; 0.97; {G}(?:sil )?open font licen[sc]e(?: version)?(?: \d+)*
ofl; open font; 6; 0.93; (?:the )?(?:sil )?open font licen[sc]e(?: version)?(?: \d+)*
ofl; scripts sil org ofl; 7; 0.9; licen[sc]e (?:\S+ ){0,12}scripts sil org ofl
openssl; openssl; 9; 0.99; {I}openssl
openssl; openssl; 8; 0.93; {G}openssl licen[sc]e
openssl; openssl; 5; 0.9; (?:the )?openssl licen[sc]e
openssl; openssl toolkit; 8; 0.93; this product includes software developed by the openssl project for use in the openssl toolkit(?: licen[sc]e)?
ssleay; ssleay; 6; 0.9; (?:original )?ssleay licen[sc]e
php; php; 9; 0.99; {I}php(?: \d+)*
php; php; 8; 0.93; {G}php licen[sc]e(?: version)?(?: \d+)*
php; php; 5; 0.88; (?:the )?php licen[sc]e(?: version)?(?: \d+)*
ruby; ruby; 9; 0.99; {I}ruby
ruby; ruby; 8; 0.9; {G}(?:same terms as ruby|ruby licen[sc]e)
ruby; ruby; 5; 0.88; (?:the )?ruby licen[sc]e
w3c; w3c; 9; 0.99; {I}w3c(?: \d+)*
w3c; w3c; 8; 0.93; {G}w3c(?: software)?(?: and document)?(?: notice and)? licen[sc]e
w3c; w3c; 5; 0.9; w3c(?: software)?(?: notice and)? licen[sc]e
odbl; odbl; 9; 0.99; {I}odbl(?: \d+)*
odbl; odbl; 8; 0.95; {G}(?:odc )?odbl(?: v?\d+)*
odbl; odbl; 5; 0.88; (?:odc )?odbl(?: \d+)* licen[sc]e
odbl; open database; 6; 0.93; (?:odc )?open database licen[sc]e(?: version)?(?: v?\d+)*
odc-by; open data commons attribution; 6; 0.93; open data commons attribution licen[sc]e
pddl; public domain dedication and license; 7; 0.93; (?:odc )?public domain dedication and license
ms-pl; ms; 9; 0.99; {I}ms pl
ms-rl; ms; 9; 0.99; {I}ms rl
ms-pl; ms pl; 8; 0.93; {G}ms pl
ms-pl; ms pl; 5; 0.88; ms pl licen[sc]e
ms-pl; microsoft; 6; 0.93; microsoft public licen[sc]e
ms-rl; microsoft; 6; 0.93; microsoft reciprocal licen[sc]e
ms-rl; ms rl; 5; 0.88; ms rl licen[sc]e
ms-eula; microsoft; 6; 0.9; microsoft software licen[sc]e terms
bsl; busl; 9; 0.99; {I}busl 1 1
bsl; busl; 8; 0.93; {G}busl(?: 1 1)?
bsl; bsl 1 1; 8; 0.9; {G}bsl 1 1
bsl; bsl 1 1; 5; 0.85; bsl 1 1 licen[sc]e
bsl; business source; 6; 0.93; (?:the )?business source licen[sc]e(?: version)?(?: \d+)*
sspl; sspl; 9; 0.99; {I}sspl(?: \d+)*
sspl; sspl; 8; 0.93; {G}sspl(?: v?\d+)*
sspl; server side public; 6; 0.95; server side public licen[sc]e(?: version)?(?: v?\d+)*
elastic; elastic; 9; 0.99; {I}elastic 2 0
elastic; elastic; 8; 0.93; {G}elastic licen[sc]e(?: version)?(?: v?\d+)*
elastic; elastic; 6; 0.9; (?:the )?elastic licen[sc]e(?: version)?(?: v?\d+)*
commons-clause; commons clause; 7; 0.93; (?:the )?commons clause licen[sc]e condition(?: version)?(?: v?\d+)*
polyform; polyform; 6; 0.93; polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e(?: \d+)*
cc-by; cc by; 9; 0.99; {I}cc by(?: \d+)*
cc-by-sa; cc by; 9; 0.99; {I}cc by sa(?: \d+)*
cc-by-nc; cc by; 9; 0.99; {I}cc by nc(?: \d+)*
cc-by-nd; cc by; 9; 0.99; {I}cc by nd(?: \d+)*
cc-by-nc-sa; cc by; 9; 0.99; {I}cc by nc sa(?: \d+)*
cc-by-nc-nd; cc by; 9; 0.99; {I}cc by nc nd(?: \d+)*
cc-by; cc by; 8; 0.95; {G}cc by(?: v?\d+)*(?: licen[sc]e)?
cc-by-sa; cc by; 8; 0.95; {G}cc by sa(?: v?\d+)*(?: licen[sc]e)?
cc-by-nc; cc by; 8; 0.95; {G}cc by nc(?: v?\d+)*(?: licen[sc]e)?
cc-by-nd; cc by; 8; 0.95; {G}cc by nd(?: v?\d+)*(?: licen[sc]e)?
cc-by-nc-sa; cc by; 8; 0.95; {G}cc by (?:nc sa|sa nc)(?: v?\d+)*(?: licen[sc]e)?
cc-by-nc-nd; cc by; 8; 0.95; {G}cc by (?:nc nd|nd nc)(?: v?\d+)*(?: licen[sc]e)?
cc-by; cc by; 4; 0.8; cc by(?: version)? v?\d(?: \d)?
cc-by-sa; cc by; 4; 0.8; cc by sa(?: version)? v?\d(?: \d)?
cc-by-nc; cc by; 4; 0.8; cc by nc(?: version)? v?\d(?: \d)?
cc-by-nd; cc by; 4; 0.8; cc by nd(?: version)? v?\d(?: \d)?
cc-by-nc-sa; cc by; 4; 0.8; cc by (?:nc sa|sa nc)(?: version)? v?\d(?: \d)?
cc-by-nc-nd; cc by; 4; 0.8; cc by (?:nc nd|nd nc)(?: version)? v?\d(?: \d)?
cc-by; cc by; 5; 0.85; cc by licen[sc]e
cc-by-sa; cc by sa; 5; 0.85; cc by sa licen[sc]e
cc-by-nc; cc by nc; 5; 0.85; cc by nc licen[sc]e
cc-by-nd; cc by nd; 5; 0.85; cc by nd licen[sc]e
cc-by; creative commons attribution; 6; 0.95; creative commons attribution(?: version)?(?: v?\d+)*(?: \S+){0,2} licen[sc]e
cc-by-sa; creative commons attribution; 7; 0.96; creative commons attribution share ?alike(?: v?\d+)*(?: \S+){0,2} licen[sc]e
cc-by-nc; creative commons attribution; 7; 0.96; creative commons attribution non ?commercial(?: v?\d+)*(?: \S+){0,2} licen[sc]e
cc-by-nd; creative commons attribution; 7; 0.96; creative commons attribution no ?deriv(?:ative)?s?(?: v?\d+)*(?: \S+){0,2} licen[sc]e
cc-by-nc-sa; creative commons attribution; 8; 0.97; (?:{G})?creative commons attribution (?:non ?commercial share ?alike|share ?alike non ?commercial)(?: v?\d+)*(?: \S+){0,2} licen[sc]e
cc-by-nc-nd; creative commons attribution; 8; 0.97; (?:{G})?creative commons attribution (?:non ?commercial no ?deriv(?:ative)?s?|no ?deriv(?:ative)?s? non ?commercial)(?: v?\d+)*(?: \S+){0,2} licen[sc]e
cc-by; creativecommons org licenses by; 5; 0.85; creativecommons org licenses by \d
cc-by-sa; creativecommons org licenses by; 6; 0.9; creativecommons org licenses by sa
cc-by-nc; creativecommons org licenses by; 6; 0.9; creativecommons org licenses by nc \d
cc-by-nd; creativecommons org licenses by; 6; 0.9; creativecommons org licenses by nd
cc-by-nc-sa; creativecommons org licenses by; 6; 0.9; creativecommons org licenses by nc sa
cc-by-nc-nd; creativecommons org licenses by; 6; 0.9; creativecommons org licenses by nc nd
cc0; cc0; 9; 0.99; {I}cc0(?: \d+)*
cc0; cc0; 8; 0.95; {G}(?:creative commons )?cc0(?: \d+)*(?: licen[sc]e)?
cc0; cc0; 6; 0.9; cc0 1 0 universal
cc0; cc0; 4; 0.8; cc0(?: version)? v?\d(?: \d)?
cc0; cc0; 5; 0.85; cc0 licen[sc]e
cc0; creative commons zero; 6; 0.92; creative commons zero(?: v?\d+)*(?: universal)?(?: public domain dedication)? licen[sc]e
cc0; creativecommons org publicdomain; 6; 0.9; licen[sc]e (?:\S+ ){0,12}creativecommons org publicdomain zero
cc0; waived all copyright; 7; 0.9; (?:has|have) waived all copyright and related or neighboring rights
public-domain; public domain; 8; 0.95; (?:released|dedicated|placed) (?:in)?to the public domain
public-domain; public domain; 6; 0.85; public domain dedication
public-domain; public domain; 5; 0.8; (?:is|are) in the public domain
public-domain; public domain; 6; 0.85; public domain mark(?: \d \d)?
public-domain; disclaims copyright; 7; 0.9; the author disclaims copyright to this source code
proprietary; all rights reserved; 6; 0.8; copyright (?:\S+ ){1,8}all rights reserved
proprietary; all rights reserved; 2; 0.5; all rights reserved
proprietary; proprietary; 6; 0.85; (?:confidential and proprietary|proprietary and confidential)
proprietary; proprietary; 5; 0.8; proprietary licen[sc]e
proprietary; unauthorized copying; 6; 0.85; unauthorized copying of this file via any medium is strictly prohibited(?: proprietary)?
proprietary; end user licen; 5; 0.8; end user licen[sc]e agreement
proprietary; may not be reproduced; 5; 0.75; may not be reproduced(?: \S+){0,8} without (?:the )?(?:prior )?(?:written )?permission
proprietary; no part of this; 5; 0.75; no part of this (?:book|publication|work|document) may be (?:\S+ ){0,8}without (?:the )?(?:\S+ ){0,4}permission
proprietary; commercial license; 4; 0.6; commercial license (?:is )?(?:required|available)
proprietary; used with permission; 3; 0.5; used with permission
copyright; copyright; 3; 0.5; copyright (?:c )?(?:19|20)\d\d
copyright; copyright; 2; 0.4; copyright by (?:the )?authors?
dual-license; dual licensed; 5; 0.6; (?:is )?dual licensed
dual-license; at your option; 5; 0.6; licensed under (?:\S+ ){1,6}or (?:\S+ ){1,6}at your option
osl; open software; 6; 0.92; open software licen[sc]e(?: version)?(?: v?\d+)*
osl; osl; 9; 0.99; {I}osl(?: \d+)*
afl; academic free; 6; 0.92; academic free licen[sc]e(?: version)?(?: v?\d+)*
afl; afl; 9; 0.99; {I}afl(?: \d+)*
ecl; educational community; 6; 0.92; educational community licen[sc]e(?: version)?(?: v?\d+)*
ncsa; ncsa; 6; 0.92; (?:university of illinois )?ncsa open source licen[sc]e
upl; universal permissive; 6; 0.92; universal permissive licen[sc]e(?: version)?(?: v?\d+)*
blueoak; blue oak model; 6; 0.92; blue oak model licen[sc]e(?: version)?(?: v?\d+)*
mulan; mulan; 6; 0.92; mulan (?:permissive software |psl )?licen[sc]e(?: version)?(?: v?\d+)*
vim; vim; 5; 0.85; vim licen[sc]e
tcl; tcl; 5; 0.85; tcl tk licen[sc]e
x11; x11; 5; 0.88; (?:the )?x11 licen[sc]e
x11; x consortium; 6; 0.9; x consortium licen[sc]e
unicode; unicode; 5; 0.88; unicode licen[sc]e
icu; icu; 5; 0.88; icu licen[sc]e
unicode-dfs; unicode data files; 6; 0.9; licen[sc]e (?:\S+ ){0,6}unicode data files and software
json; good not evil; 8; 0.93; the software shall be used for good not evil
apsl; apple public source; 6; 0.92; apple public source licen[sc]e(?: version)?(?: v?\d+)*
npl; netscape public; 6; 0.92; netscape public licen[sc]e(?: version)?(?: v?\d+)*
qpl; q public; 6; 0.92; q public licen[sc]e(?: version)?(?: v?\d+)*
lppl; latex project public; 6; 0.92; latex project public licen[sc]e(?: version)?(?: v?\d+)*
lppl; lppl; 9; 0.99; {I}lppl(?: \d+)*
rpl; reciprocal public; 6; 0.92; reciprocal public licen[sc]e(?: version)?(?: v?\d+)*
free-art; free art; 6; 0.9; free art licen[sc]e(?: \d \d)?
openrail; rail; 6; 0.9; (?:creativeml |bigscience )?open ?rail(?: m)? licen[sc]e
llama; llama; 6; 0.9; llama \d community licen[sc]e(?: agreement)?
ogl; open government; 6; 0.92; open government licen[sc]e(?: v?\d+)*(?: \d)?
opl; open publication; 6; 0.9; open publication licen[sc]e(?: v?\d+)*
unknown-license; licensed under; 1; 0.4; licensed under (?:the )?(?:terms of )?(?:\S+ ){0,4}licen[sc]e
unknown-license; released under; 1; 0.4; released under (?:the )?(?:\S+ ){0,4}licen[sc]e
unknown-license; license terms; 1; 0.3; see (?:the )?license terms
unknown-license; license file; 1; 0.3; see (?:the )?license file
unknown-license; distributed under; 1; 0.4; distributed under (?:the )?(?:\S+ ){0,4}licen[sc]e
"""

#: Every signature needs one of these.
STEMS = tuple(
    x.encode()
    for x in (
        "licen", "copyright", "public domain", "all rights", "ed under ", "available under ", "cc by", "cc0", "permission", "redistribut", "warranty", "gpl", "mozilla org", "copyleft", "gnu", "exception", "advertis",
        "misrepresented", "plainly marked", "without restriction", "free software", "proprietary", "invariant sections", "unencumbered", "anyone is free", "same terms", "beer", "apply these terms", "good not evil", "reproduced", "no part of", "modules", "endorse", "openssl", "prohibited",
    )
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    weight: float


@functools.cache
def rules() -> tuple[Rule, ...]:
    made = []
    for line in SIGNATURES.strip().splitlines():
        label, keyword, priority, weight, form = line.split("; ", 4)
        for name, text in PARTS.items():
            form = form.replace(name, text)
        made.append(Rule(label, keyword, re.compile(rf"\b{form}\b"), int(priority), float(weight)))
    return tuple(made)


@functools.cache
def keywords() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    for k, v in by.items():
        found.add_word(k, tuple(v))
    found.make_automaton()
    return found


def detect(canonical: str) -> list[tuple[int, int, Rule]]:
    """Accepted detections (start, end, rule) in a text's canonical string, by sweeps in the order of places."""
    wanted = sorted({i for _, own in keywords().iter(canonical) for i in own})
    levels: dict[int, list[tuple[int, int, int]]] = {}
    for i in wanted:
        levels.setdefault(rules()[i].priority, []).extend((m.start(), -m.end(), i) for m in rules()[i].pattern.finditer(canonical))
    kept: list[tuple[int, int, Rule]] = []
    taken: list[tuple[int, int]] = []  # what higher priorities cover, in order and apart
    for priority in sorted(levels, reverse=True):
        own, reach, at = [], -1, 0
        for start, end, i in sorted(levels[priority]):
            end = -end
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if end > reach and (at == len(taken) or taken[at][0] >= end):
                own.append((start, end, rules()[i]))
                reach = end
        kept += own
        taken = joined(taken + [(s, e) for s, e, _ in own])
    return sorted(kept, key=lambda x: x[:2])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def places(padded: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively; `padded` is canonical with a space at both ends."""
    out, want, at, before, seen = [], b" " + phrase + b" ", padded.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        before += padded.count(b" ", seen, at)
        seen = at
        out.append(before)
        at = padded.find(want, at + 1)
    return out


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.translate(_CANON).split()
    padded = b" " + b" ".join(words) + b" "
    if not any(stem in padded for stem in STEMS):
        return len(words), 0, None, None, "", "", 0.0
    at: list[int] = []
    base = set()
    for phrase, label in BASE:
        if own := places(padded, phrase.encode()):
            base.add(label)
            at += own
    found = detect(padded[1:-1].decode("utf-8", "replace"))
    miss = 1.0
    for _, _, rule in found:
        miss *= 1 - rule.weight
    labels = base | {rule.label for _, _, rule in found}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss


SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_licenses(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document with its places, labels and a score from 0 to 1; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                found = [scan(x.as_py()) for x in part.column("text")]
                cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(SCHEMA.types)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *cols], names=["key", *SCHEMA.names])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("key", key)
