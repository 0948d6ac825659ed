"""Hand-written license signatures: notices, file headers and passages of license texts.

A signature is a regular expression over lower-case words joined by single blanks; a word stands for
itself, ``(?:a|b)`` for one of several and ``(?: x)?`` for words that may be missing.  Sections come
in the order of their priority, which is also the order in which detections suppress each other.
"""

from __future__ import annotations

#: section -> (priority, score, lines "label: pattern").
SECTIONS: dict[str, tuple[int, float, str]] = {
    # headers of files and notices that state license and version
    "notices": (1, 0.95, """
apache-2: licensed to the apache software foundation asf under one or more contributor license agreements
apache-2: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2: you may obtain a copy of the license at https? www apache org licenses license 2 0(?: txt| html)?
apache-2: apache org licenses license 2 0
apache-1.1: apache org licenses license 1 1
apache-2: the asf licenses this file to you under the apache license version 2 0
gpl-1.0: general public license as published by the free software foundation(?: either)? version 1
gpl-2.0: general public license as published by the free software foundation(?: either)? version 2
gpl-3.0: general public license as published by the free software foundation(?: either)? version 3
gpl-2.0: general public license version 2(?: only)? as published by the free software foundation
gpl-3.0: general public license version 3(?: only)? as published by the free software foundation
gpl-2.0: redistribute it and or modify it under the terms of(?: the)? gpl(?: version)? v?2
gpl-3.0: redistribute it and or modify it under the terms of(?: the)? gpl(?: version)? v?3
gpl-2.0: may be distributed under the terms of the gnu general public license(?: version| v)? 2
gpl-2.0: this file is licensed under the gpl ?v2
gpl-3.0: this file is licensed under the gpl ?v3
gpl-2.0: subject to the terms and conditions of the gnu general public license version 2
gpl-2.0: gnu org licenses old licenses gpl 2 0
gpl-1.0: gnu org licenses old licenses gpl 1 0
gpl-3.0: gnu org licenses gpl 3 0
lgpl-2.0: library general public license as published by the free software foundation(?: either)? version 2
lgpl-2.1: lesser general public license as published by the free software foundation(?: either)? version 2 1
lgpl-3.0: lesser general public license as published by the free software foundation(?: either)? version 3
lgpl-2.1: lesser general public license version 2 1(?: only)? as published by the free software foundation
lgpl-2.1: gnu org licenses old licenses lgpl 2 1
lgpl-3.0: gnu org licenses lgpl 3 0
agpl-3.0: affero general public license as published by the free software foundation(?: either)? version 3
agpl-3.0: affero general public license version 3(?: only)? as published by the free software foundation
agpl-3.0: gnu org licenses agpl 3 0
gfdl-1.1: gnu free documentation license version 1 1 or any later version published by the free software foundation
gfdl-1.2: gnu free documentation license version 1 2 or any later version published by the free software foundation
gfdl-1.3: gnu free documentation license version 1 3 or any later version published by the free software foundation
gfdl-1.3: gnu org licenses fdl 1 3
mpl-1.0: contents of this file are subject to the mozilla public license version 1 0
mpl-1.1: contents of this file are subject to the mozilla public license version 1 1
mpl-1.1: version mpl 1 1 gpl 2 0 lgpl 2 1
mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0: if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0
mpl-2.0: mozilla org mpl 2 0
mpl-1.1: mozilla org mpl mpl 1 1
npl-1.1: contents of this file are subject to the netscape public license version 1 1
epl-1.0: made available under the terms of the eclipse public license v1 0 which accompanies this distribution
epl-2.0: made available under the terms of the eclipse public license(?: v)? 2 0
epl-2.0: made available under the terms of the eclipse public license v2 0
epl-1.0: eclipse org legal epl v10
epl-2.0: eclipse org legal epl (?:2 0|v20)
edl-1.0: made available under the terms of the eclipse distribution license v(?: )?1 0
edl-1.0: eclipse org org documents edl v10
cddl-1.0: subject to the terms of the common development and distribution license version 1 0
cddl-1.0: contents of this file are subject to the terms of the common development and distribution license
cddl-1.1: opensource org licenses cddl 1 1
cpl-1.0: made available under the terms of the common public license v1 0
eupl-1.1: licensed under the eupl version 1 1
eupl-1.2: licensed under the eupl version 1 2
bsl-1.0: distributed under the boost software license version 1 0
bsl-1.0: boost org license 1 0 txt
cecill-2.0: governed by the cecill license under french law and abiding by the rules of distribution of free software
cecill-b: governed by the cecill b license under french law and abiding by the rules of distribution of free software
cecill-c: governed by the cecill c license under french law and abiding by the rules of distribution of free software
artistic-2.0: under the terms of the artistic license 2 0
perl-5: same terms as(?: the)? perl(?: 5)?(?: programming language)?(?: system)? itself
ms-pl: subject to the microsoft public license
ms-rl: subject to the microsoft reciprocal license
osl-3.0: licensed under the open software license version 3 0
afl-2.1: licensed under the academic free license version 2 1
afl-3.0: licensed under the academic free license version 3 0
ofl-1.1: this font software is licensed under the sil open font license version 1 1
ofl-1.1: scripts sil org ofl
zpl-2.1: subject to the provisions of the zope public license version 2 1
php-3.01: this source file is subject to version 3 01 of the php license
php-3.0: this source file is subject to version 3 0 of the php license
busl-1.1: use of this software is governed by the business source license
busl-1.1: licensed under the business source license 1 1
elastic-2.0: licensed under the elastic license 2 0
elastic-2.0: one or more contributor license agreements licensed under the elastic license
sspl-1.0: under the terms of the server side public license version 1
upl-1.0: licensed under the universal permissive license v ?1 0
cc-by-1.0: creativecommons org licenses by 1 0
cc-by-2.0: creativecommons org licenses by 2 0
cc-by-2.5: creativecommons org licenses by 2 5
cc-by-3.0: creativecommons org licenses by 3 0
cc-by-4.0: creativecommons org licenses by 4 0
cc-by-sa-2.0: creativecommons org licenses by sa 2 0
cc-by-sa-2.5: creativecommons org licenses by sa 2 5
cc-by-sa-3.0: creativecommons org licenses by sa 3 0
cc-by-sa-4.0: creativecommons org licenses by sa 4 0
cc-by-nc-2.0: creativecommons org licenses by nc 2 0
cc-by-nc-3.0: creativecommons org licenses by nc 3 0
cc-by-nc-4.0: creativecommons org licenses by nc 4 0
cc-by-nd-3.0: creativecommons org licenses by nd 3 0
cc-by-nd-4.0: creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0: creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0: creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
cc0-1.0: creativecommons org publicdomain zero 1 0
"""),
    # titles and opening lines of license texts
    "titles": (3, 0.95, """
apache-2: apache license version 2 0 january 2004
apache-1.1: the apache software license version 1 1 copyright
gpl-1.0: gnu general public license version 1 february 1989
gpl-2.0: gnu general public license version 2 june 1991
gpl-3.0: gnu general public license version 3 29 june 2007
lgpl-2.0: gnu library general public license version 2 june 1991
lgpl-2.1: gnu lesser general public license version 2 1 february 1999
lgpl-3.0: gnu lesser general public license version 3 29 june 2007
agpl-3.0: gnu affero general public license version 3 19 november 2007
gfdl-1.1: gnu free documentation license version 1 1 march 2000
gfdl-1.2: gnu free documentation license version 1 2 november 2002
gfdl-1.3: gnu free documentation license version 1 3 3 november 2008
mpl-2.0: mozilla public license version 2 0 1 definitions
epl-1.0: the accompanying program is provided under the terms of this eclipse public license agreement
cpl-1.0: the accompanying program is provided under the terms of this common public license agreement
bsl-1.0: boost software license version 1 0 august 17th 2003
wtfpl: do what the f[a-z]+ you want to public license version 2 december 2004
ofl-1.1: sil open font license version 1 1 26 february 2007
sspl-1.0: server side public license version 1 october 16 2018
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
upl-1.0: the universal permissive license upl version 1 0
psf-2.0: python software foundation license version 2
artistic-1.0: the artistic license preamble the intent of this document is to state the conditions
artistic-2.0: the artistic license 2 0 copyright
eupl-1.2: european union public licence v 1 2 eupl
cc0-1.0: cc0 1 0 universal
cc-by-4.0: creative commons attribution 4 0 international public license
cc-by-sa-4.0: creative commons attribution sharealike 4 0 international public license
cc-by-nc-4.0: creative commons attribution noncommercial 4 0 international public license
"""),
    # passages that only one license text holds
    "passages": (5, 0.9, """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit: to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0: to whom the software is furnished to do so the software is provided as is
x11: except as contained in this notice the name of the x consortium shall not be used in advertising
x11: except as contained in this notice the names? of the above copyright holders? shall not be used in advertising
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc: the software is provided as is and the author disclaims all warranties with regard to this software
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: without fee)? is hereby granted
bsd: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause: neither the names? of [a-z0-9 ]{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-3-clause: the names? of the authors? may not be used to endorse or promote products derived from this software
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear: no express or implied licenses to any party s patent rights are granted by this license
apache-2: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2: if the work includes a notice text file as part of its distribution
apache-1.1: products derived from this software may not be called apache nor may apache appear in their name
gpl: the licenses for most software are designed to take away your freedom to share and change it
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: you should have received a copy of the gnu general public license along with
lgpl: you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl: you should have received a copy of the gnu affero general public license along with
gpl-2.0: activities other than copying distribution and modification are not covered by this license they are outside its scope
gpl-3.0: no covered work shall be deemed part of an effective technological measure
gpl-3.0: the gnu general public license is a free copyleft license for software and other kinds of works
lgpl-2.1: a work that uses the library
lgpl-3.0: this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl-3.0: your modified version must prominently offer all users interacting with it remotely through a computer network
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: with no invariant sections no front cover texts and no back cover texts
mpl-2.0: exhibit b incompatible with secondary licenses notice
mpl: covered software is provided under this license on an as is basis
epl-2.0: secondary license means either the gnu general public license version 2 0 or any later versions
cddl: covered software is provided under this license on an as is basis without warranty of any kind either expressed or implied
eupl: the work is a work in progress which is continuously improved by numerous contributors
osl: external deployment the term external deployment means the use distribution or communication
afl: licensed under the academic free license
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib: permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng: the png reference library is supplied as is
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
cc0: the person who associated a work with this deed has dedicated the work to the public domain
cc0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives
wtfpl: you just do what the f[a-z]+ you want to
beerware: if we meet some day and you think this stuff is worth it you can buy me a beer in return
ofl: the font software may be modified altered or added to
ofl: no modified version of the font software may use the reserved font name
ncsa: neither the names of [a-z0-9 ]{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided
ncsa: to deal with the software without restriction including without limitation the rights
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
openssl: the names openssl toolkit and openssl project must not be used to endorse
ssleay: this product includes cryptographic software written by eric young
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
php: this product includes php software freely available from
python: this license agreement is between the python software foundation
python: psf is making python available to licensee on an as is basis
ruby: you may make and give away verbatim copies of the source form of the software without restriction
artistic: the copyright holder maintains some semblance of artistic control
vim: vim is charityware
w3c: by obtaining using and or copying this work you the licensee agree
icu: provided that the above copyright notice s and this permission notice appear in all copies of the software
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ijg: this software is based in part on the work of the independent jpeg group
freetype: portions of this software are copyright [a-z0-9 ]{1,30}? the freetype project
sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code
json: the software shall be used for good not evil
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ecl-2.0: licensed under the educational community license version 2 0
ms-pl: if you distribute any portion of the software in source code form you may do so only under this license
odbl: this database is made available under the open database license
odc-by: made available under the open data commons attribution license
pddl: made available under the public domain dedication and license
sspl-1.0: if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0: you may not provide the software to third parties as a hosted or managed service
busl-1.1: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause: the license does not include and the license does not grant to you the right to sell the software
polyform-nc: any noncommercial purpose is a permitted purpose
"""),
    # notices that name no license text, and claims without a version
    "claims": (14, 0.6, """
proprietary: all rights reserved unauthorized copying of this file via any medium is strictly prohibited
proprietary: this software is the confidential and proprietary information of
proprietary: proprietary and confidential
public-domain: (?:this|the) (?:file|work|code|software|text|article|document) is (?:in|part of) the public domain
public-domain: (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain: no copyright is claimed and the author disclaims copyright to this source code
public-domain: the author disclaims copyright to this source code
bsd: use of this source code is governed by a bsd style license
mit: use of this source code is governed by an mit style license
mit: this (?:project|software|package|code|library) is (?:free|open source) software under the mit
bsd: (?:licensed|released|distributed|available) under (?:the|a) bsd(?: style)? licen[sc]e
gpl: (?:licensed|released|distributed|available) under the gnu gpl
cc: (?:some rights reserved|licensed under) (?:a )?creative commons
cc-by-sa: text is available under the creative commons attribution sharealike license
cc: this work is licensed under a creative commons
free-documentation: (?:verbatim copying and distribution) of this entire article (?:is|are) permitted
freeware: this (?:program|software) is freeware
shareware: this (?:program|software) is shareware
non-commercial: for non ?commercial use only
non-commercial: may not be used for commercial purposes
no-redistribution: (?:may not be|not to be) redistributed without (?:prior )?(?:written )?permission
all-rights-reserved: copyright [a-z0-9 ]{1,60}? all rights reserved
"""),
}


def lines() -> list[tuple[str, int, float, str]]:
    """(label, priority, score, pattern) of all signatures, in order."""
    out = []
    for priority, score, body in SECTIONS.values():
        for line in body.strip().split("\n"):
            label, pattern = line.split(": ", 1)
            out.append((label, priority, score, pattern))
    return out
