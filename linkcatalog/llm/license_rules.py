"""Hand-written signatures of licenses: notices, clauses, headers, addresses and identifiers.

A line is priority, label, keyword and pattern. The pattern is a regular expression over lower-case
words between single spaces (punctuation counts as a space); the keyword stands in each of its
matches. Of detections one of which contains the other that of higher priority stays, of equals the
longer one: whole clauses have 95, notices and addresses 90, identifiers 85, names 60 to 80.
"""

_LINES = r"""
95 mit | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
90 mit | without restriction including | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
90 mit | all copies or substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
90 mit | licensed under the mit | (?:is |are )?licensed under the mit(?: x11| expat)? licen[cs]e
90 mit | use of this source code is governed by an mit | use of this source code is governed by an mit style licen[cs]e
90 mit | opensource | opensource org licenses mit(?: license)?(?: php)?
85 mit | mit style | mit style licen[cs]e
95 mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)?
90 x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
95 apache-2 | you may not use this file except | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
90 apache-2 | apache | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
90 apache-2 | apache | (?:www )?apache org licenses license 2 0
90 apache-1.1 | apache | (?:www )?apache org licenses license 1 1
90 apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
95 apache-2 | terms and conditions for use reproduction | apache license version 2 0 january 2004(?: https? www apache org licenses)? terms and conditions for use reproduction and distribution
90 apache | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements
80 apache-2 | asl | asl (?:version )?2(?: 0)?
95 bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
90 bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
90 bsd | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
90 bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
95 bsd-3 | endorse or promote | neither the names? of (?:[^ ]+ ){1,20}(?:may|can) be used to endorse or promote products
95 bsd-3 | endorse or promote | the names? of (?:[^ ]+ ){1,12}may not be used to endorse or promote products derived from this software
95 bsd-4 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
95 0bsd | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
90 bsd | bsd style | (?:use of this source code is )?governed by a bsd style licen[cs]e
85 bsd | bsd style | bsd style licen[cs]e
90 bsd-2 | opensource | opensource org licenses bsd 2 clause
90 bsd-3 | opensource | opensource org licenses bsd 3 clause
90 bsd | opensource | opensource org licenses bsd license(?: php)?
80 bsd-3 | bsd | (?:3|three) clause bsd(?: licen[cs]e)?
80 bsd-2 | bsd | (?:2|two) clause bsd(?: licen[cs]e)?
80 bsd-4 | bsd | (?:4|four) clause bsd(?: licen[cs]e)?
85 bsd-3 | 3 clause | bsd 3 clause(?: clear)?(?: licen[cs]e)?
85 bsd-2 | 2 clause | bsd 2 clause(?: patent)?(?: licen[cs]e)?
85 bsd-4 | 4 clause | bsd 4 clause(?: licen[cs]e)?
95 isc | hereby granted | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
90 isc | opensource | opensource org licenses isc(?: license)?
95 ntp | hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
95 postgresql | hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
80 postgresql | postgresql | (?:the )?postgresql licen[cs]e
95 zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
90 zlib | origin of this software | the origin of this software must not be misrepresented
90 zlib | held liable for any damages | in no event will the authors be held liable for any damages arising from the use of this software
90 zlib | altered source versions | altered source versions must be plainly marked as such
65 libpng | libpng | libpng licen[cs]e(?: version 2)?
95 boost | hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
90 boost | boost software | distributed under the boost software licen[cs]e(?: version 1 0)?
90 boost | boost | (?:www )?boost org license 1 0 txt
85 boost | bsl | bsl 1 0
95 unlicense | unencumbered software | this is free and unencumbered software released into the public domain
90 unlicense | unlicense | unlicense org
90 unlicense | unlicense | anyone is free to copy modify publish use compile sell or distribute this software .{0,80}unlicense
95 wtfpl | do what the fuck | you just do what the fuck you want to
90 wtfpl | do what the fuck | do what the fuck you want to public licen[cs]e(?: version 2)?
90 wtfpl | wtfpl | (?:www )?wtfpl net
95 beerware | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
80 beerware | beer ware | (?:the )?beer ware licen[cs]e
95 json | for good not evil | the software shall be used for good not evil
95 ncsa | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .{0,200}deal with the software without restriction
80 ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
95 gpl | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license
95 gpl-3 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
95 gpl-2 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
95 gpl-2 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license (?:version 2 )?as published by the free software foundation version 2
95 lgpl | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
95 lgpl-3 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
95 lgpl-2.1 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
95 lgpl-2 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2
95 agpl | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu affero general public license
95 agpl-3 | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
95 gpl-3 | 29 june 2007 | gnu general public license version 3 29 june 2007
95 gpl-2 | june 1991 | gnu general public license version 2 june 1991
95 gpl-1 | february 1989 | gnu general public license version 1 february 1989
95 lgpl-3 | 29 june 2007 | gnu lesser general public license version 3 29 june 2007
95 lgpl-2.1 | february 1999 | gnu lesser general public license version 2 1 february 1999
95 lgpl-2 | june 1991 | gnu library general public license version 2 june 1991
95 agpl-3 | 19 november 2007 | gnu affero general public license version 3 19 november 2007
95 gfdl-1.3 | 3 november 2008 | gnu free documentation license version 1 3 3 november 2008
95 gfdl-1.2 | november 2002 | gnu free documentation license version 1 2 november 2002
90 gpl | received a copy of the gnu | you should have received a copy of the gnu general public license along with this (?:program|software|file|library)
90 lgpl | received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|software|file|library)
90 agpl | received a copy of the gnu | you should have received a copy of the gnu affero general public license along with this (?:program|software|file|library)
90 gpl | either version | gnu general public license either version
90 gpl | gnu | (?:www )?gnu org licenses gpl(?: html| txt)?
90 gpl-3 | gnu | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
90 gpl-2 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
90 lgpl | gnu | (?:www )?gnu org licenses lgpl(?: html| txt)?
90 lgpl-3 | gnu | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
90 lgpl-2.1 | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
90 agpl-3 | gnu | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
90 gfdl | gnu | (?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?
85 gpl-3-or-later | or later | gpl 3 0 or later
85 gpl-2-or-later | or later | gpl 2 0 or later
85 lgpl-3-or-later | or later | lgpl 3 0 or later
85 lgpl-2.1-or-later | or later | lgpl 2 1 or later
85 agpl-3-or-later | or later | agpl 3 0 or later
85 gpl-3-only | 0 only | gpl 3 0 only
85 gpl-2-only | 0 only | gpl 2 0 only
85 lgpl-3-only | 0 only | lgpl 3 0 only
85 lgpl-2.1-only | 1 only | lgpl 2 1 only
85 agpl-3-only | 0 only | agpl 3 0 only
90 gpl-classpath | classpath exception | (?:gpl 2 0 )?with classpath exception(?: 2 0)?
90 gpl-linking | linking this library | linking this library statically or dynamically with other modules is making a combined work
95 gfdl | copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
90 gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
95 mpl-2 | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
90 mpl-2 | was not distributed with this file | if a copy of the mpl was not distributed with this file you can obtain one at
90 mpl-2 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
90 mpl-1.1 | mozilla | (?:www )?mozilla org (?:en us )?mpl(?: mpl)? 1 1
95 mpl-1.1 | contents of this file are subject | the contents of this file are subject to the mozilla public license version 1 1
95 mpl-1.0 | contents of this file are subject | the contents of this file are subject to the mozilla public license version 1 0
95 npl | contents of this file are subject | the contents of this file are subject to the netscape public license(?: version 1 [01])?
95 cddl | contents of this file are subject | the contents of this file are subject to the terms of the common development and distribution license
95 epl-1.0 | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0
95 epl-2.0 | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
90 epl | eclipse | (?:www )?eclipse org legal epl (?:v10|2 0)(?: html)?
80 edl | eclipse distribution | eclipse distribution licen[cs]e(?: v ?1 0)?
95 cpl | accompanying materials are made available | this program and the accompanying materials are made available under the terms of the common public license v ?1 0
80 ipl | ibm public | ibm public licen[cs]e(?: version 1 0| v ?1 0)?
90 eupl | european union | (?:licensed under the )?european union public licen[cs]e(?: version 1 [012]| v ?1 [012])?
85 eupl | eupl | eupl (?:version |v ?)?1 [012]
80 ms-pl | microsoft public | microsoft public licen[cs]e(?: ms pl)?
80 ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)?
85 ms-pl | ms pl | ms pl
80 artistic-2 | artistic | (?:the )?artistic licen[cs]e (?:version )?2 0
90 artistic | same terms as perl | (?:you can|you may) redistribute it and or modify it under the same terms as perl(?: itself)?
90 artistic | artistic | perlfoundation org artistic license 2 0
80 python | python software foundation | python software foundation licen[cs]e(?: version 2)?
95 python | psf | psf is making python available to licensee on an as is basis
80 ruby | ruby | ruby s? ?licen[cs]e|ruby licen[cs]e
80 php | php | (?:the )?php licen[cs]e(?: (?:version )?(?:v ?)?3 01?)?
90 php | php | subject to version 3 01? of the php license
80 openssl | openssl | openssl (?:ssleay )?licen[cs]e|dual openssl ssleay licen[cs]e
95 openssl | openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
80 qpl | q public | (?:the )?q public licen[cs]e(?: version 1 0)?
95 sspl | server side public | server side public licen[cs]e(?: version 1| v ?1)?
85 sspl | sspl | sspl 1 0
95 busl | business source | business source licen[cs]e(?: version)? 1 1
85 busl | busl | busl 1 1
90 elastic-2 | elastic | elastic licen[cs]e(?: version)? 2 0
95 commons-clause | commons clause | commons clause licen[cs]e condition(?: v ?1 0)?
80 commons-clause | commons clause | commons clause
95 polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|free trial) licen[cs]e(?: 1 0 0)?
95 fair-source | functional source | functional source licen[cs]e(?: version 1 1)?
95 openrail | rail | (?:creativeml |bigscience )?open rail m(?: licen[cs]e)?|bigscience rail license
90 llama | llama | llama (?:2|3|3 1|3 2|3 3)? ?community licen[cs]e(?: agreement)?
90 gemma | gemma | gemma terms of use
95 ofl | sil open font | this font software is licensed under the sil open font license(?: version 1 1)?
90 ofl | scripts sil org | scripts sil org ofl
90 ofl | reserved font name | with reserved font names?
85 ofl | ofl | ofl 1 1
80 ubuntu-font | ubuntu font | ubuntu font licen[cs]e(?: version 1 0)?
95 cc0 | cc0 | to the extent possible under law .{0,160}has waived all copyright and related or neighboring rights .{0,80}cc0|cc0 1 0 universal(?: public domain dedication)?
90 cc0 | publicdomain | creativecommons org publicdomain zero 1 0
90 public-domain-mark | publicdomain | creativecommons org publicdomain mark 1 0
85 cc0 | cc0 | cc0(?: 1 0)?
90 cc0 | waived all copyright | waived all copyright and related (?:or|and) neighboring rights
90 cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd(?: [0-9] [0-9])?
90 cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa(?: [0-9] [0-9])?
90 cc-by-nc | creativecommons | creativecommons org licenses by nc(?: [0-9] [0-9])?
90 cc-by-sa | creativecommons | creativecommons org licenses by sa(?: [0-9] [0-9])?
90 cc-by-nd | creativecommons | creativecommons org licenses by nd(?: [0-9] [0-9])?
90 cc-by | creativecommons | creativecommons org licenses by(?: [0-9] [0-9])?
90 cc-by | creative commons | licensed under a creative commons attribution (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e
90 cc-by-sa | creative commons | licensed under a creative commons attribution share ?alike (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e
90 cc-by-nc | creative commons | licensed under a creative commons attribution non ?commercial (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e
90 cc-by-nd | creative commons | licensed under a creative commons attribution no ?deriv(?:s|atives) (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e
90 cc-by-nc-sa | creative commons | licensed under a creative commons attribution non ?commercial share ?alike (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e
90 cc-by-nc-nd | creative commons | licensed under a creative commons attribution non ?commercial no ?deriv(?:s|atives) (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[cs]e
85 cc-by-nc-nd | cc by | cc by nc nd(?: [0-9] [0-9])?
85 cc-by-nc-sa | cc by | cc by nc sa(?: [0-9] [0-9])?
85 cc-by-nc | cc by | cc by nc(?: [0-9] [0-9])?
85 cc-by-sa | cc by | cc by sa(?: [0-9] [0-9])?
85 cc-by-nd | cc by | cc by nd(?: [0-9] [0-9])?
80 cc-by | cc by | cc by(?: [0-9] [0-9])?
70 cc | some rights reserved | some rights reserved
90 cc-by-sa | wikipedia | text is available under the creative commons attribution share ?alike licen[cs]e .{0,120}wikipedia
90 odbl | open database | (?:open data commons )?open database licen[cs]e(?: odbl)?(?: v ?1 0)?
85 odbl | odbl | odbl(?: 1 0)?
90 odc-by | open data commons | open data commons attribution licen[cs]e(?: v ?1 0)?
90 pddl | open data commons | open data commons public domain dedication and licen[cs]e(?: pddl)?
90 cdla | community data | community data licen[cs]e agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?
90 ogl-uk | open government | (?:contains public sector information licensed under the )?open government licen[cs]e(?: v ?[123](?: 0)?)?
90 etalab | etalab | (?:licence ouverte|open licence) (?:[^ ]+ ){0,3}etalab(?: 2 0)?
90 dl-de | datenlizenz | datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?
90 public-domain | public domain | (?:is|are|been|was|were) (?:released |placed |dedicated )?(?:in|into|to) the public domain
85 public-domain | public domain | this (?:work|file|software|text|image|document) is in the public domain
85 public-domain | public domain | public domain (?:dedication|software|licen[cs]e)
80 public-domain | united states government | work of the united states government
75 public-domain | no copyright | no copyright (?:reserved|restrictions|is claimed)
80 public-domain | gutenberg | project gutenberg licen[cs]e
90 proprietary | strictly prohibited | unauthori[sz]ed (?:copying|reproduction|use|distribution) of (?:this|these) (?:[^ ]+ ){1,12}is strictly prohibited
90 proprietary | proprietary and confidential | (?:this [^ ]+ is )?proprietary and confidential
85 proprietary | prior written permission | (?:may not|no part of this [^ ]+ may) be (?:reproduced|copied|distributed|transmitted) (?:[^ ]+ ){0,14}without (?:the )?prior written permission|without prior written permission of
80 proprietary | all rights reserved | all rights reserved
75 proprietary | tous droits | tous droits r[^ ]+serv[^ ]+s
75 proprietary | alle rechte | alle rechte vorbehalten
75 proprietary | todos los derechos | todos los derechos reservados
80 proprietary | end user license agreement | end user license agreement
75 proprietary | evaluation purposes only | for evaluation purposes only
75 freeware | freeware | (?:this (?:software|program) is |licensed as )freeware
75 shareware | shareware | (?:this (?:software|program) is |licensed as )shareware
80 non-commercial | use only | for (?:personal and )?non ?commercial use only
80 non-commercial | commercial | free for (?:personal|academic|research|non ?commercial) (?:and non ?commercial )?use (?:[^ ]+ ){0,6}commercial
80 research-only | research purposes only | for (?:academic |non commercial )?research purposes only
70 unknown-copyleft | free software foundation | as published by the free software foundation
70 permissive-notice | provided as is | (?:the|this) software is provided as is without (?:warranty|any express or implied warranty)
75 cecill | cecill | (?:licence |license )?cecill(?: (?:b|c))?(?: (?:version )?[12](?: [01])?)?
75 osl | open software | open software licen[cs]e(?: version)?(?: v ?)? ?3 0
75 afl | academic free | academic free licen[cs]e(?: version)?(?: v ?)? ?[23] [01]
75 upl | universal permissive | universal permissive licen[cs]e(?: v ?1 0)?
75 mulan-2 | mulan | mulan p?sl ?v2|mulan permissive software licen[cs]e(?: v ?2)?
75 blueoak | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
75 hippocratic | hippocratic | hippocratic licen[cs]e(?: version)?(?: [123] [01])?
75 parity | parity public | parity public licen[cs]e(?: 7 0 0)?
75 vim | vim | vim licen[cs]e
75 tcl | tcl tk | tcl tk licen[cs]e
75 w3c | w3c | w3c (?:software|document)(?: notice and)? licen[cs]e
75 unicode | unicode | unicode(?: inc)?(?: data files and software)? licen[cs]e(?: agreement)?
75 curl | curl | curl licen[cs]e
75 icu | icu | icu licen[cs]e
75 ftl | freetype | freetype (?:project )?licen[cs]e
75 ijg | independent jpeg | based in part on the work of the independent jpeg group
75 imagemagick | imagemagick | imagemagick licen[cs]e
75 lppl | latex project | latex project public licen[cs]e(?: version)?(?: 1 3[ac]?)?
75 sleepycat | sleepycat | sleepycat (?:public )?licen[cs]e
75 watcom | watcom | sybase open watcom public licen[cs]e
75 zpl | zope public | zope public licen[cs]e(?: version)?(?: 2 [01])?
75 apsl | apple public | apple public source licen[cs]e(?: version)?(?: 2 0)?
75 cern-ohl | cern open hardware | cern open hardware licen[cs]e(?: version)?(?: [12](?: [012])?)?
"""

#: (priority, label, keyword, pattern)
SIGNATURES = tuple(
    (int(head.split()[0]), head.split()[1], f" {keyword.strip()} ", pattern.strip())
    for head, keyword, pattern in (line.split("|", 2) for line in _LINES.strip().splitlines())
)
