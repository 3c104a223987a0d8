"""Signature rules of the license scan, one a line: label | priority | keyword | pattern.

Patterns are Java regular expressions over lower-cased words joined by single spaces; a pattern matches whole words. The keyword
is a plain string that every match contains, from the beginning of a word on; a rule is tried only where it occurs. Higher priorities are more specific.
"""

from __future__ import annotations

import json

#: The four phrases whose places are counted, whatever the other rules find.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_RULES = r"""
gpl-1.0 | 80 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?1(?: 0)?
gpl-2.0 | 80 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2(?: 0)?
gpl-3.0 | 80 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?
gpl-2.0+ | 85 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?any later version
gpl-3.0+ | 85 | general public | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?any later version
gpl | 60 | general public | gnu general public licen[sc]es?
gpl | 50 | general public | (?:the )?general public licen[sc]e
gpl-2.0 | 75 | gpl | gpl ?v?2(?: 0)?(?: only)?
gpl-3.0 | 75 | gpl | gpl ?v?3(?: 0)?(?: only)?
gpl-2.0+ | 77 | gpl | gpl ?v?2(?: 0)? or later
gpl-3.0+ | 77 | gpl | gpl ?v?3(?: 0)? or later
gpl | 55 | gpl | (?:licen[sc]ed )?under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl | 52 | gpl | gnu gpl
lgpl-2.0 | 82 | library general | gnu library general public licen[sc]e(?: v(?:ersion )?2(?: 0)?)?
lgpl-2.1 | 84 | lesser general | gnu lesser general public licen[sc]e v(?:ersion )?2 1
lgpl-3.0 | 84 | lesser general | gnu lesser general public licen[sc]e v(?:ersion )?3(?: 0)?
lgpl | 70 | lesser general | gnu lesser general public licen[sc]e
lgpl-2.1+ | 86 | lesser general | gnu lesser general public licen[sc]e v(?:ersion )?2 1 or (?:at your option )?any later version
lgpl-2.1 | 76 | lgpl | lgpl ?v?2 1(?: only)?
lgpl-3.0 | 76 | lgpl | lgpl ?v?3(?: 0)?(?: only)?
lgpl | 56 | lgpl | (?:gnu )?lgpl
agpl-3.0 | 84 | affero | gnu affero general public licen[sc]e v(?:ersion )?3(?: 0)?
agpl | 72 | affero | gnu affero general public licen[sc]e
agpl-1.0 | 78 | affero | affero general public licen[sc]e v(?:ersion )?1(?: 0)?
agpl-3.0 | 76 | agpl | agpl ?v?3(?: 0)?(?: only)?
agpl | 56 | agpl | (?:gnu )?agpl
gfdl-1.1 | 82 | free documentation | gnu free documentation licen[sc]e v(?:ersion )?1 1
gfdl-1.2 | 82 | free documentation | gnu free documentation licen[sc]e v(?:ersion )?1 2
gfdl-1.3 | 82 | free documentation | gnu free documentation licen[sc]e v(?:ersion )?1 3
gfdl | 70 | free documentation | gnu free documentation licen[sc]e
apache-1.0 | 80 | apache | apache (?:software )?licen[sc]e v(?:ersion )?1 0
apache-1.1 | 80 | apache | apache (?:software )?licen[sc]e v(?:ersion )?1 1
apache-2.0 | 80 | apache | apache (?:software )?licen[sc]e v(?:ersion )?2(?: 0)?
apache-2.0 | 78 | apache | apache 2(?: 0)?(?: licen[sc]ed?)?
apache-2.0 | 76 | apache | apache licen[sc]e 2(?: 0)?
apache | 60 | apache | apache (?:software )?licen[sc]e
apache-2.0 | 90 | apache org | (?:http|https) www apache org licen[sc]es licen[sc]e 2 0
apache | 58 | apache | (?:licen[sc]ed|released|distributed) under (?:the )?apache
mit | 60 | mit | (?:the )?mit licen[sc]e
mit | 58 | mit | mit licen[sc]ed
mit | 57 | mit | (?:licen[sc]ed|released|distributed) under (?:the )?(?:terms of the )?mit
mit-0 | 82 | mit | mit no attribution(?: licen[sc]e)?
mit | 88 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 80 | without restriction | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies
x11 | 70 | x11 | (?:the )?x11 licen[sc]e
expat | 70 | expat | (?:the )?expat licen[sc]e
isc | 70 | isc | (?:the )?isc licen[sc]e
isc | 86 | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-0 | 80 | bsd | (?:0 clause bsd|bsd zero clause|zero clause bsd)(?: licen[sc]e)?
bsd-1 | 80 | bsd | (?:1 clause bsd|bsd 1 clause)(?: licen[sc]e)?
bsd-2 | 80 | bsd | (?:2 clause bsd|bsd 2 clause|two clause bsd|simplified bsd)(?: licen[sc]e)?
bsd-2 | 80 | freebsd | freebsd(?: licen[sc]e)?
bsd-3 | 80 | bsd | (?:3 clause bsd|bsd 3 clause|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4 | 80 | bsd | (?:4 clause bsd|bsd 4 clause|four clause bsd|original bsd)(?: licen[sc]e)?
bsd | 60 | bsd | bsd(?: style)? licen[sc]e
bsd | 85 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | 84 | endorse or promote | (?:neither the name of|the names? of) .{1,80}? endorse or promote products derived from this software
bsd-4 | 86 | advertising materials | all advertising materials mentioning features or use of this software must display
mpl-1.0 | 80 | mozilla | mozilla public licen[sc]e v(?:ersion )?1 0
mpl-1.1 | 80 | mozilla | mozilla public licen[sc]e v(?:ersion )?1 1
mpl-2.0 | 80 | mozilla | mozilla public licen[sc]e v(?:ersion )?2(?: 0)?
mpl | 64 | mozilla | mozilla public licen[sc]e
mpl-2.0 | 74 | mpl | mpl ?v?2(?: 0)?
mpl-1.1 | 74 | mpl | mpl ?v?1 1
epl-1.0 | 80 | eclipse | eclipse public licen[sc]e v(?:ersion )?1(?: 0)?
epl-2.0 | 80 | eclipse | eclipse public licen[sc]e v(?:ersion )?2(?: 0)?
epl | 64 | eclipse | eclipse public licen[sc]e
edl-1.0 | 76 | eclipse | eclipse distribution licen[sc]e(?: v(?:ersion )?1 0)?
cddl-1.0 | 80 | common development | common development and distribution licen[sc]e v(?:ersion )?1 0
cddl-1.1 | 80 | common development | common development and distribution licen[sc]e v(?:ersion )?1 1
cddl | 64 | common development | common development and distribution licen[sc]e
cddl | 56 | cddl | cddl(?: 1 [01])?
cpl-1.0 | 76 | common public | common public licen[sc]e(?: v(?:ersion )?1 0)?
cpal-1.0 | 76 | common public attribution | common public attribution licen[sc]e(?: v(?:ersion )?1 0)?
ipl-1.0 | 76 | ibm public | ibm public licen[sc]e(?: v(?:ersion )?1 0)?
eupl-1.1 | 80 | european union public | european union public licen[sc]e v(?:ersion )?1 1
eupl-1.2 | 80 | european union public | european union public licen[sc]e v(?:ersion )?1 2
eupl | 64 | european union public | european union public licen[sc]e
eupl | 56 | eupl | eupl(?: v?1 [0-2])?
artistic-1.0 | 80 | artistic | artistic licen[sc]e v?(?:ersion )?1(?: 0)?
artistic-2.0 | 80 | artistic | artistic licen[sc]e v?(?:ersion )?2(?: 0)?
artistic | 62 | artistic | artistic licen[sc]e
perl | 72 | same terms as perl | (?:under )?the same terms as perl(?: itself)?
zlib | 70 | zlib | zlib(?: libpng)? licen[sc]e
zlib | 84 | as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 70 | libpng | libpng licen[sc]e(?: v(?:ersion )?2)?
boost-1.0 | 80 | boost | boost software licen[sc]e(?: v(?:ersion )?1 0)?
boost-1.0 | 70 | bsl 1 0 | bsl 1 0
busl-1.1 | 80 | business source | business source licen[sc]e(?: v?(?:ersion )?1 1)?
sspl-1.0 | 80 | server side public | server side public licen[sc]e(?: v(?:ersion )?1)?
elastic-2.0 | 80 | elastic | elastic licen[sc]e(?: v(?:ersion )?)?(?: ?2(?: 0)?)?
commons-clause | 78 | commons clause | commons clause(?: licen[sc]e)?(?: condition)?(?: v?1 0)?
polyform-noncommercial | 78 | polyform | polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform-small-business | 78 | polyform | polyform small business licen[sc]e(?: 1 0 0)?
unlicense | 72 | unlicense | (?:the )?unlicense
unlicense | 88 | free and unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 76 | wtfpl | wtfpl(?: v(?:ersion )?2)?
wtfpl | 84 | want to public | do what the .{1,12} you want to public licen[sc]e
beerware | 76 | beer | (?:the )?beer ?ware licen[sc]e
cc0-1.0 | 80 | cc0 | cc0(?: v?1 0)?(?: universal)?
cc0-1.0 | 82 | creative commons | creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?
cc-by-1.0 | 80 | cc by | cc by v?1 0
cc-by-2.0 | 80 | cc by | cc by v?2 0
cc-by-2.5 | 80 | cc by | cc by v?2 5
cc-by-3.0 | 80 | cc by | cc by v?3 0
cc-by-4.0 | 80 | cc by | cc by v?4 0
cc-by | 60 | cc by | cc by
cc-by-sa-1.0 | 84 | cc by sa | cc by sa v?1 0
cc-by-sa-2.0 | 84 | cc by sa | cc by sa v?2 0
cc-by-sa-2.5 | 84 | cc by sa | cc by sa v?2 5
cc-by-sa-3.0 | 84 | cc by sa | cc by sa v?3 0
cc-by-sa-4.0 | 84 | cc by sa | cc by sa v?4 0
cc-by-sa | 66 | cc by sa | cc by sa
cc-by-nd-3.0 | 84 | cc by nd | cc by nd v?3 0
cc-by-nd-4.0 | 84 | cc by nd | cc by nd v?4 0
cc-by-nd | 66 | cc by nd | cc by nd
cc-by-nc-2.0 | 84 | cc by nc | cc by nc v?2 0
cc-by-nc-3.0 | 84 | cc by nc | cc by nc v?3 0
cc-by-nc-4.0 | 84 | cc by nc | cc by nc v?4 0
cc-by-nc | 66 | cc by nc | cc by nc
cc-by-nc-sa-3.0 | 88 | cc by nc sa | cc by nc sa v?3 0
cc-by-nc-sa-4.0 | 88 | cc by nc sa | cc by nc sa v?4 0
cc-by-nc-sa | 70 | cc by nc sa | cc by nc sa
cc-by-nc-nd-3.0 | 88 | cc by nc nd | cc by nc nd v?3 0
cc-by-nc-nd-4.0 | 88 | cc by nc nd | cc by nc nd v?4 0
cc-by-nc-nd | 70 | cc by nc nd | cc by nc nd
cc-by | 68 | creative commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-sa | 74 | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nd | 74 | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc | 74 | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-sa | 78 | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc-nd | 78 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc | 50 | creative commons | (?:a |the )?creative commons licen[sc]e
cc-by | 82 | creativecommons org | (?:http|https) creativecommons org licenses by [1-4] [05]
cc-by-sa | 86 | creativecommons org | (?:http|https) creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 86 | creativecommons org | (?:http|https) creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 86 | creativecommons org | (?:http|https) creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | 90 | creativecommons org | (?:http|https) creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 90 | creativecommons org | (?:http|https) creativecommons org licenses by nc nd [1-4] [05]
cc0-1.0 | 90 | creativecommons org | (?:http|https) creativecommons org publicdomain zero 1 0
public-domain | 86 | creativecommons org | (?:http|https) creativecommons org publicdomain mark 1 0
public-domain | 55 | public domain | (?:released |placed |dedicated )?(?:in|into|to) the public domain
public-domain | 50 | public domain | public domain(?: dedication)?
odbl-1.0 | 78 | open database | open (?:data commons open )?database licen[sc]e(?: v?1 0)?
odbl-1.0 | 66 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 78 | open data commons | open data commons attribution licen[sc]e(?: v?1 0)?
pddl-1.0 | 78 | open data commons | open data commons public domain dedication and licen[sc]e(?: v?1 0)?
ogl-uk-2.0 | 78 | open government | open government licen[sc]e v(?:ersion )?2(?: 0)?
ogl-uk-3.0 | 78 | open government | open government licen[sc]e v(?:ersion )?3(?: 0)?
ogl-uk | 62 | open government | open government licen[sc]e
cdla-permissive-1.0 | 78 | community data | community data licen[sc]e agreement permissive(?: v(?:ersion )?1 0)?
cdla-permissive-2.0 | 80 | community data | community data licen[sc]e agreement permissive v(?:ersion )?2 0
cdla-sharing-1.0 | 78 | community data | community data licen[sc]e agreement sharing(?: v(?:ersion )?1 0)?
ofl-1.0 | 78 | open font | (?:sil )?open font licen[sc]e v?(?:ersion )?1 0
ofl-1.1 | 78 | open font | (?:sil )?open font licen[sc]e v?(?:ersion )?1 1
ofl | 64 | open font | (?:sil )?open font licen[sc]e
ofl-1.1 | 68 | ofl | ofl 1 1
python-2.0 | 74 | python | python software foundation licen[sc]e(?: v(?:ersion )?2)?
python-2.0 | 70 | psf | psf licen[sc]e(?: v(?:ersion )?2)?
php-3.0 | 78 | php | php licen[sc]e v(?:ersion )?3 0
php-3.01 | 80 | php | php licen[sc]e v(?:ersion )?3 01
php | 60 | php | php licen[sc]e
ruby | 68 | ruby | ruby(?: s)? licen[sc]e
postgresql | 74 | postgresql | postgresql licen[sc]e
openssl | 74 | openssl | openssl licen[sc]e
ssleay | 76 | ssleay | (?:original )?ssleay licen[sc]e
curl | 68 | curl | curl licen[sc]e
vim | 68 | vim | vim licen[sc]e
ntp | 68 | ntp | ntp licen[sc]e
ncsa | 76 | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
w3c | 76 | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
ms-pl | 76 | microsoft | microsoft public licen[sc]e
ms-rl | 76 | microsoft | microsoft reciprocal licen[sc]e
qpl-1.0 | 76 | q public | q public licen[sc]e(?: v(?:ersion )?1 0)?
osl-3.0 | 80 | open software | open software licen[sc]e v(?:ersion )?3 0
osl | 62 | open software | open software licen[sc]e(?: v(?:ersion )?[12] [01])?
afl-3.0 | 80 | academic free | academic free licen[sc]e v(?:ersion )?3 0
afl | 62 | academic free | academic free licen[sc]e(?: v(?:ersion )?[12] [0-2])?
ecl-2.0 | 76 | educational community | educational community licen[sc]e(?: v(?:ersion )?2 0)?
upl-1.0 | 76 | universal permissive | universal permissive licen[sc]e(?: v(?:ersion )?1 0)?
bsla | 66 | sleepycat | sleepycat licen[sc]e
cecill-2.1 | 78 | cecill | cecill(?: free software)?(?: licen[sc]e)?(?: v(?:ersion )?)?(?: ?2 1)
cecill-b | 76 | cecill b | cecill b(?: free software)?(?: licen[sc]e)?(?: agreement)?
cecill-c | 76 | cecill c | cecill c(?: free software)?(?: licen[sc]e)?(?: agreement)?
cecill | 62 | cecill | cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?
mulan-psl-2.0 | 78 | mulan | mulan p(?:ermissive )?s(?:oftware )?l(?:icen[sc]e)?(?: v(?:ersion )?)?(?: ?2)?
json | 76 | good not evil | (?:the software )?shall be used for good not evil
json | 62 | json | json licen[sc]e
openrail-m | 78 | openrail | (?:creativeml |bigscience |bigcode )?openrail m?(?: licen[sc]e)?
openrail-m | 78 | open rail | (?:creativeml |bigscience |bigcode )?open rail m?(?: licen[sc]e)?
rail | 66 | responsible ai | responsible ai licen[sc]e
llama-2 | 78 | llama | llama 2 community licen[sc]e(?: agreement)?
llama-3 | 78 | llama | llama 3(?: [123])? community licen[sc]e(?: agreement)?
llama | 62 | llama | llama community licen[sc]e(?: agreement)?
gemma | 66 | gemma | gemma terms of use
wordnet | 66 | wordnet | wordnet(?: 3 [01])? licen[sc]e
unicode | 70 | unicode | unicode(?: inc)? licen[sc]e(?: agreement)?
latex-1.3c | 78 | latex | latex project public licen[sc]e(?: v(?:ersion )?1 3[ac]?)?
lppl | 66 | lppl | lppl(?: v(?:ersion )?)?(?: ?1 [0-3][ac]?)?
hpnd | 74 | historical permission | historical permission notice and disclaimer
free-art-1.3 | 76 | free art | free art licen[sc]e(?: 1 [23])?
etalab-2.0 | 76 | etalab | (?:etalab open licen[sc]e|licen[sc]e ouverte etalab)(?: 2 0)?
proprietary | 60 | all rights reserved | all rights reserved
proprietary | 70 | proprietary | proprietary and confidential
proprietary | 66 | proprietary | proprietary licen[sc]e(?: agreement)?
proprietary | 72 | strictly prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|document|work|software) .{0,40}?is strictly prohibited
eula | 68 | end user | end user licen[sc]e agreement
shareware | 60 | shareware | shareware licen[sc]e
freeware | 60 | freeware | freeware licen[sc]e
evaluation | 66 | evaluation | evaluation licen[sc]e agreement
non-commercial | 64 | commercial | (?:for )?non commercial use only
non-commercial | 64 | noncommercial | (?:for )?noncommercial use only
research-only | 64 | research | (?:for )?(?:academic )?research (?:use|purposes) only
copyleft | 50 | copyleft | copyleft(?: licen[sc]ed?)?
spdx-mit | 92 | spdx | spdx licen[sc]e identifier mit
spdx-isc | 92 | spdx | spdx licen[sc]e identifier isc
spdx-apache-2.0 | 92 | spdx | spdx licen[sc]e identifier apache 2 0
spdx-bsd-2 | 92 | spdx | spdx licen[sc]e identifier bsd 2 clause
spdx-bsd-3 | 92 | spdx | spdx licen[sc]e identifier bsd 3 clause
spdx-gpl-2.0 | 92 | spdx | spdx licen[sc]e identifier gpl 2 0(?: only)?
spdx-gpl-2.0+ | 93 | spdx | spdx licen[sc]e identifier gpl 2 0 or later
spdx-gpl-3.0 | 92 | spdx | spdx licen[sc]e identifier gpl 3 0(?: only)?
spdx-gpl-3.0+ | 93 | spdx | spdx licen[sc]e identifier gpl 3 0 or later
spdx-lgpl-2.1 | 92 | spdx | spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?
spdx-lgpl-3.0 | 92 | spdx | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
spdx-agpl-3.0 | 92 | spdx | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
spdx-mpl-2.0 | 92 | spdx | spdx licen[sc]e identifier mpl 2 0
spdx-epl-2.0 | 92 | spdx | spdx licen[sc]e identifier epl 2 0
spdx-unlicense | 92 | spdx | spdx licen[sc]e identifier unlicense
spdx-cc0-1.0 | 92 | spdx | spdx licen[sc]e identifier cc0 1 0
spdx-cc-by-4.0 | 92 | spdx | spdx licen[sc]e identifier cc by 4 0
spdx-cc-by-sa-4.0 | 93 | spdx | spdx licen[sc]e identifier cc by sa 4 0
spdx-bsl-1.0 | 92 | spdx | spdx licen[sc]e identifier bsl 1 0
spdx-zlib | 92 | spdx | spdx licen[sc]e identifier zlib
spdx | 60 | spdx | spdx licen[sc]e identifier
unknown-license | 20 | license | (?:this|the) (?:work|file|document|software|program|page|text|content|dataset|model) is licensed under
unknown-license | 20 | licence | (?:this|the) (?:work|file|document|software|program|page|text|content|dataset|model) is licenced under
unknown-license | 22 | license | see (?:the )?license(?: file)?(?: for (?:more )?(?:details|information))?
unknown-license | 24 | licence | see (?:the )?licence(?: file)?(?: for (?:more )?(?:details|information))?
"""

RULES = [
    {"label": label, "priority": int(priority), "keyword": keyword, "pattern": f"(?<= )(?:{pattern})(?= )", "base": False}
    for label, priority, keyword, pattern in (map(str.strip, line.split("|", 3)) for line in _RULES.strip().splitlines())
] + [{"label": label, "priority": 0, "keyword": phrase, "pattern": f"(?<= )(?:{phrase})(?= )", "base": True} for phrase, label in BASE.items()]

#: Beginnings of words of which every match holds one.
GATE = ("licen", "unlicen", "cc by ", "gpl", "lgpl", "agpl", "copyleft", "spdx", "domain", "reserved", "apache", "mpl", "cc0", "creative", "granted", "cddl", "eupl", "bsl", "wtfpl", "commons", "odbl", "ofl", "cecill", "evil",
        "openrail", "open rail", "gemma", "mulan", "lppl", "proprietary", "prohibited", "commercial", "noncommercial", "research", "restriction", "redistribution", "endorse", "advertising", "warranty", "perl", "unencumbered", "bsd", "freebsd", "under mit ", "under the mit ", "terms of the mit ", "mit no attribution ", "permission", "clause")

#: First words of the keywords, longer ones first: a rule is tried where a word of the text begins with its keyword's.
LEADS = sorted({r["keyword"].split(" ")[0] for r in RULES}, key=lambda w: (-len(w), w))

AS_JSON = json.dumps([r | {"rule": i} for i, r in enumerate(RULES)])
