"""License signatures over lower-cased words with one space between them.

One rule a line: label | priority | keywords | pattern.  A pattern is only tried
where one of its keywords (split by "|") stands as a whole word, so each of its
matches must hold one; priority 3 is a full grant or an identifier, 2 a named
license, 1 a weak hint.  SPDX identifiers give two more rules each.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LicenseRule:
    label: str
    priority: int
    keyword: str
    pattern: str
    #: Further keywords: every match of the pattern holds `keyword` or one of these.
    more: tuple[str, ...] = ()

    @property
    def keywords(self) -> tuple[str, ...]:
        return (self.keyword, *self.more)


WRITTEN = r"""
apache-2.0 | 3 | apache | licensed (?:under|by|with) (?:the )?apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0 | 2 | apache | apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0 | 2 | apache | apache 2(?: 0)? licensed?
apache-2.0 | 3 | apache | www apache org licenses license 2 0
apache-1.1 | 2 | apache | apache (?:software )?license (?:version |v)?1 1
apache-1.0 | 2 | apache | apache (?:software )?license (?:version |v)?1 0
apache | 1 | apache | apache (?:software )?license
mit | 3 | mit | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
mit | 2 | mit | (?:the )?mit (?:expat )?licen[cs]e
mit | 2 | mit | mit licensed
mit | 3 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 2 | mit | mit no attribution(?: licen[cs]e)?
isc | 3 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | (?:the )?isc licen[cs]e
bsd-3-clause | 3 | bsd | (?:licensed|released|distributed) under (?:the )?(?:3 clause|new|modified|revised) bsd licen[cs]e
bsd-3-clause | 2 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-3-clause | 3 | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-2-clause | 2 | bsd|freebsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-4-clause | 2 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd-4-clause | 3 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-0-clause | 2 | bsd|0bsd | (?:zero clause bsd|bsd zero clause|0bsd|bsd 0 clause)(?: licen[cs]e)?
bsd | 1 | bsd | bsd (?:style )?licen[cs]e
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
gpl-3.0 | 3 | gnu | licensed under (?:the )?(?:terms of the )?gnu general public license (?:version |v)3(?: 0)?
gpl-3.0 | 2 | gnu | gnu general public license (?:version |v)?3(?: 0)?
gpl-2.0 | 3 | gnu | licensed under (?:the )?(?:terms of the )?gnu general public license (?:version |v)2(?: 0)?
gpl-2.0 | 2 | gnu | gnu general public license (?:version |v)?2(?: 0)?
gpl-1.0 | 2 | gnu | gnu general public license (?:version |v)?1(?: 0)?
gpl-3.0-or-later | 3 | general | general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl-2.0-or-later | 3 | general | general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
gpl-2.0-only | 3 | general | general public license version 2 as published by the free software foundation
gpl | 1 | gnu | gnu (?:general public licen[cs]e|gpl)
gpl-3.0 | 2 | gplv3 | gplv3
gpl-2.0 | 2 | gplv2 | gplv2
gpl-3.0 | 2 | gpl | gpl (?:version |v)?3(?: 0)?
gpl-2.0 | 2 | gpl | gpl (?:version |v)?2(?: 0)?
gpl-classpath | 3 | classpath | (?:gpl|general public license) (?:version )?2(?: 0)? with (?:the )?classpath exception
lgpl-3.0 | 2 | lesser | (?:gnu )?lesser general public license (?:version |v)?3(?: 0)?
lgpl-2.1 | 2 | lesser | (?:gnu )?lesser general public license (?:version |v)?2 1
lgpl-2.0 | 2 | library | (?:gnu )?library general public license (?:version |v)?2(?: 0)?
lgpl | 1 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl-3.0 | 2 | lgplv3 | lgplv3
lgpl-2.1 | 2 | lgpl | lgpl (?:version |v)?2 1
lgpl | 1 | lgpl | lgpl
agpl-3.0 | 2 | affero | (?:gnu )?affero general public license (?:version |v)?3(?: 0)?
agpl-1.0 | 2 | affero | affero general public license (?:version |v)?1(?: 0)?
agpl | 1 | affero | (?:gnu )?affero general public licen[cs]e
agpl-3.0 | 2 | agplv3 | agplv3
agpl | 1 | agpl | agpl
gfdl-1.3 | 2 | documentation | (?:gnu )?free documentation license (?:version |v)?1 3
gfdl-1.2 | 2 | documentation | (?:gnu )?free documentation license (?:version |v)?1 2
gfdl-1.1 | 2 | documentation | (?:gnu )?free documentation license (?:version |v)?1 1
gfdl | 1 | documentation | (?:gnu )?free documentation licen[cs]e
mpl-2.0 | 2 | mozilla | mozilla public license (?:version |v)?2(?: 0)?
mpl-1.1 | 2 | mozilla | mozilla public license (?:version |v)?1 1
mpl-1.0 | 2 | mozilla | mozilla public license (?:version |v)?1 0
mpl-2.0 | 3 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl | 1 | mozilla | mozilla public licen[cs]e
epl-2.0 | 2 | eclipse | eclipse public license (?:version |v)?2(?: 0)?
epl-1.0 | 2 | eclipse | eclipse public license (?:version |v)?1(?: 0)?
epl | 1 | eclipse | eclipse public licen[cs]e
edl-1.0 | 2 | eclipse | eclipse distribution license (?:version |v)?1(?: 0)?
cpl-1.0 | 2 | common | common public license (?:version |v)?1(?: 0)?
cddl-1.0 | 2 | cddl | cddl (?:version |v)?1 0
cddl-1.1 | 2 | cddl | cddl (?:version |v)?1 1
cddl | 1 | common | common development and distribution licen[cs]e
eupl-1.2 | 2 | european | european union public licen[cs]e (?:version |v)?1 2
eupl-1.1 | 2 | european | european union public licen[cs]e (?:version |v)?1 1
eupl | 1 | eupl | eupl
artistic-2.0 | 2 | artistic | artistic license (?:version |v)?2(?: 0)?
artistic-1.0 | 2 | artistic | artistic license (?:version |v)?1(?: 0)?
artistic | 1 | artistic | (?:perl )?artistic licen[cs]e
bsl-1.0 | 2 | boost | boost software license(?: (?:version |v)?1(?: 0)?)?
zlib | 2 | zlib | zlib (?:libpng )?licen[cs]e
zlib | 3 | origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | 2 | libpng | libpng licen[cs]e
unlicense | 3 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 2 | wtfpl | wtfpl
beerware | 2 | beer|beerware | beer ?ware licen[cs]e
python-2.0 | 2 | python | python (?:software foundation )?license(?: (?:version |v)?2(?: 0)?)?
postgresql | 2 | postgresql | postgresql licen[cs]e
openssl | 2 | openssl | openssl licen[cs]e
php-3.01 | 2 | php | php license(?: (?:version |v)?3 01)?
ruby | 2 | ruby | ruby licen[cs]e
vim | 2 | vim | vim licen[cs]e
curl | 2 | curl | curl licen[cs]e
x11 | 2 | x11 | x11 licen[cs]e
ncsa | 2 | illinois|ncsa | (?:university of illinois|ncsa) (?:ncsa )?open source licen[cs]e
ms-pl | 2 | microsoft | microsoft public licen[cs]e
ms-rl | 2 | microsoft | microsoft reciprocal licen[cs]e
ofl-1.1 | 2 | sil | sil open font license(?: (?:version |v)?1 1)?
ofl-1.1 | 2 | font | open font licen[cs]e
upl-1.0 | 2 | universal | universal permissive license(?: (?:version |v)?1(?: 0)?)?
afl-3.0 | 2 | academic | academic free license(?: (?:version |v)?3(?: 0)?)?
osl-3.0 | 2 | open | open software license(?: (?:version |v)?3(?: 0)?)?
cecill | 2 | cecill | cecill(?: (?:a|b|c|free software license))?
qpl-1.0 | 2 | q | q public licen[cs]e
ipl-1.0 | 2 | ibm | ibm public licen[cs]e
apsl-2.0 | 2 | apple | apple public source license(?: 2(?: 0)?)?
w3c | 2 | w3c | w3c (?:software )?(?:notice and )?licen[cs]e
unicode | 2 | unicode | unicode (?:terms of use|license agreement|licen[cs]e)
icu | 2 | icu | icu licen[cs]e
bsl-1.1 | 2 | business | business source license(?: (?:version |v)?1 1)?
sspl-1.0 | 2 | server | server side public license(?: (?:version |v)?1(?: 0)?)?
elastic-2.0 | 2 | elastic | elastic license(?: (?:version |v)?2(?: 0)?)?
commons-clause | 2 | commons | commons clause(?: license condition)?
polyform | 2 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e
cc0-1.0 | 2 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | dedication | (?:creative commons )?(?:cc0 )?public domain dedication
cc0-1.0 | 2 | commons | creative commons zero(?: (?:version |v)?1(?: 0)?)?
cc-pdm | 2 | domain | public domain mark(?: 1(?: 0)?)?
public-domain | 1 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 1 | domain | (?:is|are) in the public domain
cc-by-nc-nd-4.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by nc nd 4(?: 0)?
cc-by-nc-nd | 2 | cc | cc by nc nd
cc-by-nc-sa-4.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by nc sa 4(?: 0)?
cc-by-nc-sa | 2 | cc | cc by nc sa
cc-by-nc-4.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by nc 4(?: 0)?
cc-by-nc | 2 | cc | cc by nc
cc-by-nd-4.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by nd 4(?: 0)?
cc-by-nd | 2 | cc | cc by nd
cc-by-sa-4.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by sa 4(?: 0)?
cc-by-sa-3.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by sa 3(?: 0)?
cc-by-sa | 2 | cc | cc by sa
cc-by-4.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by 4(?: 0)?
cc-by-3.0 | 3 | cc | licensed under (?:a )?(?:creative commons )?cc by 3(?: 0)?
cc-by-nc-nd | 2 | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa | 2 | attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc | 2 | attribution | creative commons attribution non ?commercial
cc-by-nd | 2 | attribution | creative commons attribution no ?deriv(?:ative)?s
cc-by-sa | 2 | attribution | creative commons attribution share ?alike
cc-by-nc-4.0 | 3 | attribution | creative commons attribution non ?commercial 4 0 international(?: license)?
cc-by-sa-4.0 | 3 | attribution | creative commons attribution share ?alike 4 0 international(?: license)?
cc-by-sa-3.0 | 3 | attribution | creative commons attribution share ?alike 3 0 unported(?: license)?
cc-by-4.0 | 3 | attribution | creative commons attribution 4 0 international(?: license)?
cc-by-3.0 | 3 | attribution | creative commons attribution 3 0 unported(?: license)?
creative-commons | 1 | commons | creative commons(?: licen[cs]e)?
cc-by-url | 3 | creativecommons | creativecommons org licenses by(?: \d(?: \d)?)?
cc-by-sa-url | 3 | creativecommons | creativecommons org licenses by sa(?: \d(?: \d)?)?
cc-by-nc-url | 3 | creativecommons | creativecommons org licenses by nc(?: \d(?: \d)?)?
cc-by-nc-sa-url | 3 | creativecommons | creativecommons org licenses by nc sa(?: \d(?: \d)?)?
cc-by-nc-nd-url | 3 | creativecommons | creativecommons org licenses by nc nd(?: \d(?: \d)?)?
cc-by-nd-url | 3 | creativecommons | creativecommons org licenses by nd(?: \d(?: \d)?)?
cc0-url | 3 | creativecommons | creativecommons org publicdomain zero(?: \d(?: \d)?)?
odbl-1.0 | 2 | database | open (?:data commons open )?database licen[cs]e
odc-by-1.0 | 2 | commons | open data commons attribution licen[cs]e
pddl-1.0 | 2 | domain | (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk-3.0 | 2 | government | open government licen[cs]e(?: (?:version |v)?3(?: 0)?)?
open-publication | 2 | publication | open publication licen[cs]e
proprietary | 2 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 2 | proprietary | proprietary licen[cs]e
proprietary | 2 | unauthorized | unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|work|document|software))?.{0,60}? is (?:strictly )?prohibited
reserved-copyright | 2 | reserved | copyright (?:c )?(?:\d{4} )?.{0,60}?all rights reserved
reserved-some | 1 | reserved | some rights reserved
no-redistribution | 2 | redistribute|redistributed|copied|copy|reproduce|reproduced | (?:may|must|do) not (?:be )?(?:copied|copy|redistributed?|reproduced?)(?: or (?:redistribute|republish)(?:ed)?)?
no-commercial | 1 | commercial|noncommercial | (?:for )?non ?commercial use only
no-commercial | 2 | commercial | not for commercial use
no-training | 2 | train|training | (?:may|must|do) not (?:be )?used? (?:for|to) (?:train|training)(?: .{0,40}?models?)?
personal-use | 1 | personal | (?:for )?personal use only
educational-use | 1 | educational | (?:for )?educational (?:use|purposes) only
research-use | 1 | research | (?:for )?research (?:use|purposes) only
evaluation-use | 1 | evaluation | (?:for )?evaluation (?:use|purposes) only
shareware | 1 | shareware | shareware
freeware | 1 | freeware | freeware
warranty-disclaimer | 1 | warranty | (?:is )?provided as is without warranty of any kind(?: express or implied)?
warranty-disclaimer | 1 | warranty | without any warranty without even the implied warranty of merchantability
see-license | 1 | license | see (?:the )?license(?: (?:file|txt|md))? for (?:more )?details
dual-licensed | 1 | dual | dual licen[cs]ed(?: under)?
license-granted | 1 | license|licence | licen[cs]e is (?:hereby )?granted
with-permission | 1 | permission | (?:used|reprinted|reproduced) (?:with|by) permission
copyleft | 1 | copyleft | copyleft
aal | 2 | attribution | attribution assurance licen[cs]e
afl-2.1 | 2 | academic | academic free licen[cs]e (?:version |v)?2 1
afl | 1 | academic | academic free licen[cs]e
bsd-1-clause | 2 | bsd | (?:bsd 1 clause|1 clause bsd|one clause bsd)(?: licen[cs]e)?
bsd-2-clause-patent | 2 | bsd | (?:bsd 2 clause plus patent|bsd plus patent|bsd patent)(?: licen[cs]e)?
bsd-3-clause-clear | 2 | bsd | (?:bsd 3 clause clear|clear bsd)(?: licen[cs]e)?
bsd-3-clause-clear | 3 | patent | no express or implied licenses to any party s patent rights are granted by this license
blueoak-1.0.0 | 2 | blue | blue oak model licen[cs]e(?: (?:version |v)?1 0 0)?
blueoak-1.0.0 | 3 | blueoakcouncil | blueoakcouncil org license 1 0 0
busl-1.1 | 2 | business | business source licen[cs]e (?:version |v)?1 1
busl-1.1 | 3 | mariadb | business source licen[cs]e is a trademark of mariadb
busl | 1 | business | business source licen[cs]e
cal-1.0 | 2 | cryptographic | cryptographic autonomy licen[cs]e(?: (?:version |v)?1 0)?
cdla-permissive-2.0 | 2 | community | community data licen[cs]e agreement permissive (?:version |v)?2(?: 0)?
cdla-permissive-1.0 | 2 | community | community data licen[cs]e agreement permissive (?:version |v)?1(?: 0)?
cdla-sharing-1.0 | 2 | community | community data licen[cs]e agreement sharing (?:version |v)?1(?: 0)?
cdla | 1 | cdla | cdla (?:permissive|sharing)
cecill-2.1 | 2 | cecill | cecill (?:free software licen[cs]e agreement )?(?:version |v)?2 1
cecill-b | 2 | cecill | cecill b(?: licen[cs]e)?
cecill-c | 2 | cecill | cecill c(?: licen[cs]e)?
cpal-1.0 | 2 | common | common public attribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?
ecl-2.0 | 2 | educational | educational community licen[cs]e (?:version |v)?2(?: 0)?
ecl-1.0 | 2 | educational | educational community licen[cs]e (?:version |v)?1(?: 0)?
efl-2.0 | 2 | eiffel | eiffel forum licen[cs]e (?:version |v)?2(?: 0)?
efl-1.0 | 2 | eiffel | eiffel forum licen[cs]e (?:version |v)?1(?: 0)?
eupl-1.0 | 2 | european | european union public licen[cs]e (?:version |v)?1 0
hpnd | 2 | historical | historical permission notice and disclaimer
hpnd | 3 | permission | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
icu | 3 | permission | provided that the above copyright notice s and this permission notice appear in all copies of the software
intel | 2 | intel | intel open source licen[cs]e
intel-ssl | 2 | intel | intel simplified software licen[cs]e
isc | 3 | author | the software is provided as is and the author disclaims all warranties with regard to this software
jpnic | 2 | jpnic | japan network information center licen[cs]e jpnic
json | 2 | json | json licen[cs]e
json | 3 | evil | the software shall be used for good not evil
lgpl-2.1-or-later | 3 | lesser | lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or at your option any later version
lgpl-3.0-or-later | 3 | lesser | lesser general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
lgpl-2.0-or-later | 3 | library | library general public license as published by the free software foundation either version 2(?: of the license)? or at your option any later version
agpl-3.0-or-later | 3 | affero | affero general public license as published by the free software foundation either version 3(?: of the license)? or at your option any later version
gpl-ccs | 1 | gnu | gnu gpl(?: (?:version |v)?\d)?
lpl-1.02 | 2 | lucent | lucent public licen[cs]e (?:version |v)?1 02
lpl-1.0 | 2 | lucent | lucent public licen[cs]e (?:version |v)?1 0
lppl-1.3c | 2 | latex | latex project public licen[cs]e (?:version |v)?1 3c
lppl-1.3 | 2 | latex | latex project public licen[cs]e (?:version |v)?1 3
lppl | 1 | latex | latex project public licen[cs]e
mir-os | 2 | miros | miros licen[cs]e
mpl-2.0-no-copyleft | 2 | mozilla | mozilla public licen[cs]e (?:version |v)?2 0 no copyleft exception
mpl-2.0 | 3 | mozilla | this source code form is subject to the terms of the mozilla public license (?:version |v)2 0
mpl-2.0 | 3 | mozilla | mozilla org mpl 2 0
mulanpsl-2.0 | 2 | mulan | mulan permissive software licen[cs]e (?:version |v)?2(?: 0)?
mulanpsl-1.0 | 2 | mulan | mulan permissive software licen[cs]e (?:version |v)?1(?: 0)?
mulanpsl | 1 | mulan | mulan psl(?: (?:version |v)?\d)?
naist-2003 | 2 | naist | naist licen[cs]e
nasa-1.3 | 2 | nasa | nasa open source agreement(?: (?:version |v)?1 3)?
ncsa | 3 | illinois | university of illinois ncsa open source licen[cs]e
nokia | 2 | nokia | nokia open source licen[cs]e
nosl | 2 | netizen | netizen open source licen[cs]e
npl-1.1 | 2 | netscape | netscape public licen[cs]e (?:version |v)?1 1
npl-1.0 | 2 | netscape | netscape public licen[cs]e (?:version |v)?1 0
npl | 1 | netscape | netscape public licen[cs]e
npsl | 2 | nmap | nmap public source licen[cs]e
ntp | 2 | ntp | ntp licen[cs]e
oclc-2.0 | 2 | oclc | oclc research public licen[cs]e(?: (?:version |v)?2(?: 0)?)?
ofl-1.0 | 2 | sil | sil open font licen[cs]e (?:version |v)?1 0
ofl-1.1 | 3 | sil | licensed under the sil open font license version 1 1
ogl-canada-2.0 | 2 | canada | open government licen[cs]e canada
ogl-uk-2.0 | 2 | government | open government licen[cs]e (?:version |v)2(?: 0)?
ogl-uk-1.0 | 2 | government | open government licen[cs]e (?:version |v)1(?: 0)?
openldap-2.8 | 2 | openldap | openldap public licen[cs]e(?: (?:version |v)?2 8)?
openssl-ssleay | 2 | ssleay | (?:original )?ssleay licen[cs]e
oset-pl-2.1 | 2 | oset | oset (?:foundation )?public licen[cs]e(?: (?:version |v)?2 1)?
osl-2.1 | 2 | software | open software licen[cs]e (?:version |v)?2 1
osl-1.0 | 2 | software | open software licen[cs]e (?:version |v)?1 0
osl | 1 | software | open software licen[cs]e
parity-7.0.0 | 2 | parity | parity public licen[cs]e(?: (?:version |v)?7 0 0)?
php-3.0 | 2 | php | php licen[cs]e (?:version |v)?3 0
php | 1 | php | php licen[cs]e
prosperity-3.0.0 | 2 | prosperity | prosperity public licen[cs]e(?: (?:version |v)?3 0 0)?
psf-2.0 | 2 | python | python software foundation licen[cs]e(?: (?:version |v)?2(?: 0)?)?
python-2.0.1 | 2 | python | python licen[cs]e 2 0 1
cnri-python | 2 | cnri | cnri (?:open source )?python licen[cs]e(?: agreement)?
rpl-1.5 | 2 | reciprocal | reciprocal public licen[cs]e (?:version |v)?1 5
rpl | 1 | reciprocal | reciprocal public licen[cs]e
rpsl-1.0 | 2 | realnetworks | realnetworks public source licen[cs]e(?: (?:version |v)?1 0)?
rscpl | 2 | ricoh | ricoh source code public licen[cs]e
sgi-b-2.0 | 2 | sgi | sgi free software licen[cs]e b(?: (?:version |v)?2 0)?
simpl-2.0 | 2 | simple | simple public licen[cs]e(?: (?:version |v)?2 0)?
sissl | 2 | sun | sun industry standards source licen[cs]e(?: (?:version |v)?1 [12])?
sleepycat | 2 | sleepycat | sleepycat licen[cs]e
spl-1.0 | 2 | sun | sun public licen[cs]e(?: (?:version |v)?1 0)?
sspl-1.0 | 3 | mongodb | server side public license is a trademark of mongodb
tcl | 2 | tcl | tcl tk licen[cs]e
ucl-1.0 | 2 | upstream | upstream compatibility licen[cs]e(?: (?:version |v)?1 0)?
unicode-3.0 | 2 | unicode | unicode licen[cs]e (?:version |v)?3
unicode-tou | 2 | unicode | unicode terms of use
unlicense | 3 | unlicense | for more information please refer to (?:https? )?unlicense org
upl-1.0 | 3 | permissive | universal permissive licen[cs]e (?:version |v)1 0
vovida-1.0 | 2 | vovida | vovida software licen[cs]e(?: (?:version |v)?1 0)?
vsl-1.0 | 1 | vsl | vsl 1 0
watcom-1.0 | 2 | sybase | sybase open watcom public licen[cs]e(?: (?:version |v)?1 0)?
wxwindows | 2 | wxwindows | wxwindows library licen[cs]e(?: (?:version |v)?3 1)?
xfree86-1.1 | 2 | xfree86 | xfree86 licen[cs]e(?: (?:version |v)?1 1)?
xnet | 2 | net | x net licen[cs]e
zend-2.0 | 2 | zend | zend (?:engine )?licen[cs]e(?: (?:version |v)?2(?: 0)?)?
zlib | 3 | altered | this notice may not be removed or altered from any source distribution
zlib-acknowledgement | 2 | zlib | zlib licen[cs]e with acknowledg(?:e)?ment
zpl-2.1 | 2 | zope | zope public licen[cs]e(?: zpl)? (?:version |v)?2 1
zpl-2.0 | 2 | zope | zope public licen[cs]e(?: zpl)? (?:version |v)?2 0
zpl | 1 | zope | zope public licen[cs]e
llama-community | 2 | llama | llama (?:\d |\d \d )?community licen[cs]e(?: agreement)?
openrail | 2 | rail | (?:creativeml |bigscience )?open rail(?: m)?(?: licen[cs]e)?
openrail | 2 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
etalab-2.0 | 2 | etalab | (?:licence ouverte )?etalab(?: open licence)? (?:version |v)?2 0
dl-de-by-2.0 | 2 | datenlizenz | datenlizenz deutschland namensnennung (?:version )?2 0
dl-de-zero-2.0 | 2 | datenlizenz | datenlizenz deutschland zero (?:version )?2 0
copyright-retained | 1 | copyright | (?:the )?(?:author|authors) retains? (?:the |all )?copyright
no-modification | 1 | modified|modify | (?:may|must) not be modified
attribution-required | 1 | attribution | attribution (?:is )?required
"""

#: Public identifiers, stated as the SPDX list spells them.
SPDX = """
0BSD AAL AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-2.0 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2-only GFDL-1.3-or-later
GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPL-1.02
LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0
QPL-1.0 Ruby SISSL SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1
"""


def license_rules() -> list[LicenseRule]:
    """Written rules, then for each identifier its tag and its use after "licensed under"."""
    rules = []
    for line in WRITTEN.strip().splitlines():
        label, priority, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        keyword, *more = keywords.split("|")
        rules.append(LicenseRule(label, int(priority), keyword, pattern, tuple(more)))
    for name in SPDX.split():
        words = name.lower().replace("-", " ").replace(".", " ")
        label = name.lower()
        rules.append(LicenseRule(label, 3, "spdx", f"spdx license identifier {words}"))
        rules.append(LicenseRule(label, 3, words.split()[0], f"(?:licensed|released|distributed|available|published) under (?:the )?{words}(?: licen[cs]e)?"))
    return rules
