"""License signature rules, in order: label | priority | beginnings of words that must all occur | regex.

Regexes run over the text's words (lower case, digits, letters) joined by single
blanks. Earlier rules win ties; see ``licenses`` for how overlaps are resolved.
"""

from __future__ import annotations

RULES = r"""
spdx-tag | 95 | spdx identifier | spdx license identifier [0-9a-z]+(?: [0-9]+){0,2}
spdx-ref | 90 | licenseref | licenseref [0-9a-z]+
agpl-3.0 | 92 | affero | gnu affero general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3(?: 0)?
agpl-1.0 | 90 | affero | affero general public license (?:version|v) 1
agpl | 80 | affero | (?:gnu )?affero general public license
agpl-3.0 | 85 | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
agpl | 70 | agpl | licensed under (?:the )?agpl
lgpl-2.1 | 92 | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2 1
lgpl-3.0 | 92 | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3(?: 0)?
lgpl-2.0 | 92 | library | gnu library general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2(?: 0)?
lgpl | 82 | lesser | (?:gnu )?lesser general public license
lgpl | 80 | library | gnu library general public license
lgpl-2.1 | 85 | lgpl | lgpl ?v?2 1(?: only| or later)?
lgpl-3.0 | 85 | lgpl | lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.0 | 85 | lgpl | lgpl ?v?2(?: 0)?(?: only| or later)
lgpl | 70 | lgpl | licensed under (?:the )?(?:gnu )?lgpl
gpl-2.0-only | 93 | gnu | gnu general public license(?: as published by the free software foundation)? version 2(?: 0)? only
gpl-2.0-or-later | 94 | gnu later | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | 94 | gnu later | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-1.0-or-later | 94 | gnu later | gnu general public license as published by the free software foundation either version 1 of the license or at your option any later version
gpl-2.0 | 90 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 2(?: 0)?
gpl-3.0 | 90 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 3(?: 0)?
gpl-1.0 | 90 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) 1(?: 0)?
gpl-2.0 | 85 | gpl | gpl ?v?2(?: 0)?(?: only| or later)
gpl-2.0 | 84 | gpl | gplv2
gpl-3.0 | 85 | gpl | gpl ?v?3(?: 0)?(?: only| or later)
gpl-3.0 | 84 | gpl | gplv3
gpl | 70 | gpl | licensed under (?:the )?(?:gnu )?gpl
gpl | 70 | gpl | under the terms of the (?:gnu )?gpl
gpl | 78 | gnu | under the terms of the gnu general public license
gpl | 76 | received gnu | you should have received a copy of the gnu general public license
gpl-classpath | 88 | classpath | (?:gnu )?classpath exception
gpl-autoconf | 88 | autoconf | autoconf(?: configure)? exception
gpl-bison | 88 | bison | bison exception
gpl-gcc | 88 | runtime gcc | gcc runtime library exception
gpl-font | 86 | font exception | gpl (?:with )?font exception
gpl-url | 72 | gnu gpl | (?:www )?gnu org (?:licenses|copyleft) gpl(?: [0-9]+ [0-9])?(?: html| txt| en html)?
lgpl-url | 72 | gnu lgpl | (?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [0-9]+ [0-9])?(?: html| txt)?
agpl-url | 72 | gnu agpl | (?:www )?gnu org licenses agpl(?: [0-9]+ [0-9])?(?: html| txt)?
gfdl-1.3 | 92 | documentation gnu | gnu free documentation license (?:version|v) 1 3
gfdl-1.2 | 92 | documentation gnu | gnu free documentation license (?:version|v) 1 2
gfdl-1.1 | 92 | documentation gnu | gnu free documentation license (?:version|v) 1 1
gfdl | 80 | documentation gnu | gnu free documentation license
apache-2.0 | 92 | apache | licensed under the apache license version 2 0 (?:the license )?
apache-2.0 | 90 | apache | apache license version 2(?: 0)?
apache-2.0 | 88 | apache | apache (?:license|licence) 2(?: 0)?
apache-2.0 | 86 | apache | apache 2 0(?: license| licence)
apache-2.0 | 84 | apache | apache software license version 2(?: 0)?
apache-1.1 | 88 | apache | apache (?:software )?license (?:version )?1 1
apache-1.0 | 88 | apache | apache (?:software )?license (?:version )?1 0
apache | 72 | apache | apache software license
apache-2.0-url | 80 | apache licenses | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache | 66 | asl | asl 2 0
apache-llvm | 88 | llvm apache | apache(?: license)? 2 0 with llvm exceptions?
mit | 92 | permission charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 85 | mit licen | released under the mit licen[cs]e
mit | 85 | mit licen | licensed under the mit licen[cs]e
mit | 84 | mit licen | distributed under the mit licen[cs]e
mit | 82 | mit licen | the mit licen[cs]e mit
mit | 80 | mit licen | mit style licen[cs]e
mit | 78 | mit opensource | (?:www )?opensource org licen[cs]es mit(?: license)?(?: php| html)?
mit-0 | 90 | mit attribution | mit no attribution
mit-0 | 88 | mit licen | mit 0 licen[cs]e
mit-modern | 84 | mit modern | mit license modern variant
mit-x11 | 84 | x11 | (?:mit )?x11 licen[cs]e
x11-distribute | 86 | consortium | x consortium license
expat | 86 | expat | expat licen[cs]e
mit-notice | 74 | notice substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-warranty | 62 | warranty fitness | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | 92 | permission modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | 84 | isc | isc licen[cs]e
0bsd | 90 | bsd | (?:bsd zero clause|zero clause bsd|0 clause bsd)(?: licen[cs]e)?
0bsd | 84 | 0bsd | 0bsd
bsd-4-clause | 90 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?
bsd-3-clause | 90 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-2-clause | 90 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)
bsd-2-clause | 90 | freebsd | freebsd licen[cs]e
bsd-1-clause | 90 | bsd | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
bsd-2-patent | 92 | bsd patent | bsd 2 clause plus patent(?: licen[cs]e)?
bsd-3-clear | 92 | bsd clear | bsd 3 clause clear(?: licen[cs]e)?
bsd-style | 78 | bsd | bsd style licen[cs]e
bsd | 75 | bsd | (?:released|licensed|distributed) under (?:the |a )?bsd licen[cs]e
bsd | 70 | bsd | the bsd licen[cs]e
bsd-redistribution | 76 | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-source-clause | 66 | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-binary-clause | 66 | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-endorse-clause | 66 | endorse promote | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-advert-clause | 66 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-warranty | 60 | contributors holders | this software is provided by the copyright holders and contributors as is
bsd-protection | 86 | bsd protection | bsd protection licen[cs]e
bsd-open-mpi | 86 | open mpi | open mpi licen[cs]e
mpl-2.0 | 92 | mozilla | (?:terms of the )?mozilla public license (?:version |v )?2(?: 0)?
mpl-1.1 | 92 | mozilla | mozilla public license (?:version |v )?1 1
mpl-1.0 | 92 | mozilla | mozilla public license (?:version |v )?1 0
mpl | 80 | mozilla | mozilla public license
mpl-2.0 | 84 | mpl | mpl 2 0
mpl-1.1 | 84 | mpl | mpl 1 1
mpl-2.0-url | 80 | mozilla mpl | mozilla org mpl 2 0
npl-1.1 | 88 | netscape | netscape public license (?:version )?1 1
npl-1.0 | 88 | netscape | netscape public license (?:version )?1 0
npl | 80 | netscape | netscape public license
epl-2.0 | 92 | eclipse | eclipse public license (?:version |v )?2 0
epl-1.0 | 92 | eclipse | eclipse public license (?:version |v )?1 0
epl | 80 | eclipse | eclipse public license
epl-2.0 | 84 | epl | epl 2 0
epl-1.0 | 84 | epl | epl (?:v )?1 0
edl-1.0 | 88 | eclipse | eclipse distribution license(?: (?:version |v )?1 0)?
cddl-1.1 | 92 | cddl | cddl (?:version )?1 1
cddl-1.0 | 92 | cddl | cddl (?:version )?1 0
cddl | 84 | development distribution | common development and distribution license(?: version [0-9] [0-9])?
cpl-1.0 | 86 | common | common public license(?: version)? 1 0
cpl | 78 | common | common public license
cpal-1.0 | 88 | attribution | common public attribution license(?: version)?(?: 1 0)?
ipl-1.0 | 86 | ibm | ibm public license(?: version)?(?: 1 0)?
eupl-1.2 | 92 | european | european union public licen[cs]e (?:version |v )?1 2
eupl-1.1 | 92 | european | european union public licen[cs]e (?:version |v )?1 1
eupl-1.0 | 92 | european | european union public licen[cs]e (?:version |v )?1 0
eupl | 82 | european | european union public licen[cs]e
eupl-1.2 | 84 | eupl | eupl (?:v )?1 2
cecill-2.1 | 90 | cecill | cecill (?:version |v )?2 1
cecill-2.0 | 90 | cecill | cecill (?:version |v )?2 0
cecill-b | 90 | cecill | cecill b(?: licen[cs]e)?
cecill-c | 90 | cecill | cecill c(?: licen[cs]e)?
cecill | 78 | cecill | (?:la licence )?cecill
cecill | 78 | cececill | cececill
artistic-2.0 | 90 | artistic | artistic license (?:version )?2 0
artistic-1.0 | 90 | artistic | artistic license (?:version )?1 0
artistic | 78 | artistic | (?:the |perl )artistic license
perl | 80 | perl | (?:same|under the) terms as perl(?: itself)?
psf-2.0 | 88 | python | python software foundation license(?: version 2)?
python-2.0 | 86 | python | python license (?:version )?2 0
zpl-2.1 | 90 | zope | zope public license (?:version )?2 1
zpl-2.0 | 90 | zope | zope public license (?:version )?2 0
zpl | 80 | zope | zope public license
php-3.01 | 90 | php | php license (?:version )?3 01
php-3.0 | 90 | php | php license (?:version )?3 0
ruby | 80 | ruby | (?:same terms as ruby|ruby license)
openssl | 86 | openssl | openssl licen[cs]e
ssleay | 84 | ssleay | (?:original )?ssleay licen[cs]e
zlib | 86 | zlib | zlib licen[cs]e
zlib-ack | 84 | zlib acknowledgement | zlib libpng licen[cs]e with acknowledgement
zlib-text | 84 | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 84 | libpng | (?:zlib )?libpng licen[cs]e
libtiff | 84 | libtiff | libtiff licen[cs]e
ijg | 84 | jpeg | independent jpeg group(?: s)? licen[cs]e
curl | 84 | curl | curl licen[cs]e
ncsa | 86 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
boost-1.0 | 90 | boost | boost software license(?: version)?(?: 1 0)?
boost-1.0 | 84 | bsl | bsl 1 0
busl-1.1 | 90 | business | business source license(?: (?:version )?1 1)?
unlicense | 90 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 84 | unlicense | (?:the )?unlicense
wtfpl | 88 | wtfpl | wtfpl(?: version [0-9])?
wtfpl | 88 | want | do what the f[a-z]{3} you want to public license
beerware | 86 | beer | beer ?ware licen[cs]e
postgresql | 86 | postgresql | postgresql licen[cs]e
afl-3.0 | 90 | academic | academic free license (?:version |v )?3 0
afl-2.1 | 90 | academic | academic free license (?:version |v )?2 1
afl | 80 | academic | academic free license
osl-3.0 | 90 | open software | open software license (?:version |v )?3 0
osl | 78 | open software | open software license
ecl-2.0 | 90 | educational | educational community license(?: version)? 2 0
ecl | 80 | educational | educational community license
ms-pl | 88 | microsoft | microsoft public license(?: ms pl)?
ms-rl | 88 | microsoft | microsoft reciprocal license(?: ms rl)?
ms-eula | 80 | microsoft | microsoft software license terms
apsl-2.0 | 88 | apple | apple public source license(?: (?:version )?2 0)?
qpl-1.0 | 88 | public | q public license(?: version 1 0)?
rpl-1.5 | 88 | reciprocal | reciprocal public license(?: 1 5)?
sspl-1.0 | 90 | server | server side public license(?: (?:version )?1)?
elastic-2.0 | 90 | elastic | elastic license(?: (?:version )?2 0)?
commons-clause | 88 | commons | commons clause license condition(?: v1 0)?
polyform | 86 | polyform | polyform (?:noncommercial|small business|shield|perimeter|strict) license
prosperity | 84 | prosperity | prosperity public license
parity | 84 | parity | parity public license
blueoak-1.0.0 | 90 | oak | blue oak model license(?: 1 0 0)?
upl-1.0 | 88 | universal | universal permissive license(?: (?:version |v )?1 0)?
mulan-psl-2 | 90 | mulan | mulan permissive software license(?: v2)?
mulan-publ | 88 | mulan | mulan public license
ofl-1.1 | 90 | font | sil open font license(?: version)? 1 1
ofl-1.0 | 90 | font | sil open font license(?: version)? 1 0
ofl | 80 | font | (?:sil )?open font license
bitstream-vera | 86 | vera | bitstream vera fonts? (?:copyright|licen[cs]e)
ubuntu-font | 88 | ubuntu | ubuntu font licen[cs]e(?: version)?(?: 1 0)?
gust-font | 84 | gust | gust font licen[cs]e
lppl-1.3c | 90 | latex | latex project public license (?:version )?1 3c?
lppl | 80 | latex | latex project public license
w3c | 86 | w3c | w3c software (?:notice and )?(?:and document )?licen[cs]e
w3c-doc | 84 | w3c | w3c document licen[cs]e
unicode | 88 | unicode | unicode (?:license agreement|license v3|inc license)
icu | 86 | icu | icu licen[cs]e
odbl-1.0 | 90 | database | open(?: data commons open)? database license(?: (?:version |v )?1 0)?
pddl-1.0 | 90 | dedication | (?:open data commons )?public domain dedication and license
odc-by-1.0 | 90 | commons attribution | open data commons attribution license(?: (?:version |v )?1 0)?
ogl-uk | 88 | government | open government licen[cs]e(?: v(?:ersion )?[0-9](?: [0-9])?)?
etalab-2.0 | 88 | ouverte | licence ouverte(?: open licence)?(?: 2 0)?
dl-de-by-2.0 | 88 | datenlizenz | datenlizenz deutschland namensnennung(?: (?:version )?2 0)?
cdla-permissive | 88 | data agreement | community data license agreement permissive
cdla-sharing | 88 | data agreement | community data license agreement sharing
cc0-1.0 | 92 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 90 | creative | creative commons (?:zero|cc0|public domain dedication)
cc-pdm | 88 | public mark | (?:creative commons )?public domain mark(?: 1 0)?
cc-by-nc-nd-4.0 | 94 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 4 0
cc-by-nc-sa-4.0 | 94 | creative | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-4.0 | 92 | creative | creative commons attribution non ?commercial 4 0
cc-by-nd-4.0 | 92 | creative | creative commons attribution no ?deriv(?:ative)?s? 4 0
cc-by-sa-4.0 | 92 | creative | creative commons attribution share ?alike 4 0
cc-by-sa-3.0 | 92 | creative | creative commons attribution share ?alike 3 0
cc-by-sa-2.5 | 92 | creative | creative commons attribution share ?alike 2 5
cc-by-4.0 | 90 | creative | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 90 | creative | creative commons attribution 3 0(?: unported)?
cc-by-2.5 | 90 | creative | creative commons attribution 2 5
cc-by-nc-nd | 84 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa | 84 | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc | 82 | creative | creative commons attribution non ?commercial
cc-by-nd | 82 | creative | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | 82 | creative | creative commons attribution share ?alike
cc-by | 76 | creative | creative commons attribution
creative-commons | 66 | creative | (?:licensed under|under) (?:a |the )?creative commons(?: licen[cs]e)?
cc-by-nc-nd-4.0 | 92 | cc | cc by nc nd 4 0
cc-by-nc-sa-4.0 | 92 | cc | cc by nc sa 4 0
cc-by-nc-4.0 | 90 | cc | cc by nc 4 0
cc-by-nd-4.0 | 90 | cc | cc by nd 4 0
cc-by-sa-4.0 | 90 | cc | cc by sa 4 0
cc-by-sa-3.0 | 90 | cc | cc by sa 3 0
cc-by-4.0 | 88 | cc | cc by 4 0
cc-by-3.0 | 88 | cc | cc by 3 0
cc-by-2.0 | 88 | cc | cc by 2 0
cc-by-nc-nd | 82 | cc | cc by nc nd
cc-by-nc-sa | 82 | cc | cc by nc sa
cc-by-nc | 80 | cc | cc by nc
cc-by-nd | 80 | cc | cc by nd
cc-by-sa | 80 | cc | cc by sa
cc-url | 74 | creativecommons | creativecommons org licenses by(?: nc| nd| sa){0,2}(?: [0-9] [0-9])?
cc0-url | 74 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
public-domain | 72 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 66 | public domain | this (?:file|work|software|code) is in the public domain
proprietary | 70 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 70 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
all-rights-reserved | 55 | rights reserved | all rights reserved
eula | 70 | end user | end user licen[cs]e agreement
openrail | 86 | openrail | (?:creativeml |bigscience )?openrail(?: m| s)?(?: licen[cs]e)?
openrail | 86 | open rail | (?:creativeml |bigscience )?open rail(?: m| s)?(?: licen[cs]e)?
rail | 82 | responsible ai | responsible ai licen[cs]e
llama-community | 86 | llama | llama [0-9](?: [0-9])? community license(?: agreement)?
gemma-terms | 84 | gemma | gemma terms of use
dual-mit-apache | 93 | mit apache | (?:mit or apache 2 0|apache 2 0 or mit)
dual-gpl-commercial | 80 | commercial | dual licensed under (?:the )?(?:gnu )?gpl and (?:a )?commercial licen[cs]e
sleepycat | 86 | sleepycat | sleepycat licen[cs]e
sun-bcl | 84 | sun | sun binary code license(?: agreement)?
sissl | 84 | sun | sun industry standards source license
vim | 84 | vim | vim licen[cs]e
tcl | 84 | tcl | tcl tk licen[cs]e
hpnd | 84 | historical | historical permission notice and disclaimer
ntp | 84 | ntp | ntp licen[cs]e
nasa-1.3 | 86 | nasa | nasa open source agreement(?: (?:version )?1 3)?
nist-pd | 84 | nist | nist (?:public domain notice|software licen[cs]e)
json | 84 | evil | the software shall be used for good not evil
jsr | 80 | jsr | jsr [0-9]+ specification license
fair | 82 | fair | fair license
hippocratic | 86 | hippocratic | hippocratic license(?: [0-9] [0-9])?
ncgl-uk | 86 | government | non commercial government licen[cs]e
osgi | 82 | osgi | osgi specification license
openldap-2.8 | 88 | openldap | openldap public license(?: version)?(?: 2 8)?
intel-open | 84 | intel | intel open source license
nokia | 84 | nokia | nokia open source license
realnetworks | 84 | realnetworks | realnetworks public source license
sugarcrm | 84 | sugarcrm | sugarcrm public license
vovida | 84 | vovida | vovida software license
watcom | 84 | watcom | sybase open watcom public license
xnet | 84 | net license | x net license
entessa | 84 | entessa | entessa public license
eiffel-forum-2 | 86 | eiffel | eiffel forum license(?: version)?(?: 2)?
frameworx | 84 | frameworx | frameworx open license
lucent-1.02 | 86 | lucent | lucent public license(?: version)?(?: 1 02)?
motosoto | 84 | motosoto | motosoto open source license
naumen | 84 | naumen | naumen public license
nethack | 84 | nethack | nethack general public license
oclc-2.0 | 86 | oclc | oclc research public license(?: 2 0)?
ricoh | 84 | ricoh | ricoh source code public license
simpl-2.0 | 84 | simple | simple public license(?: 2 0)?
spl-1.0 | 84 | sun | sun public license(?: (?:version |v )?1 0)?
ucl-1.0 | 84 | upstream | upstream compatibility license
liliq-p | 84 | quebec | licence libre du quebec permissive
gpl | 60 | gnu | gnu general public license
apache | 60 | apache | apache license
cc-by | 60 | cc | cc by
mit | 60 | mit licen | mit license
"""
