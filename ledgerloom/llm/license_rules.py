"""Signature rules of the license scan, written out one by one.

A line holds: priority | keyword | label | pattern. Patterns run over words in lower case joined by single spaces and
match whole words. The keyword stands in every match. Order matters: of rules that match the same words with the same
priority, the earlier one stands.
"""

TEXT = r"""
2 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
2 | copyright | copyright | copyright c [a-z]+
6 | public domain | public-domain | (?:released|dedicated|placed) (?:in|in to|into|to) the public domain
6 | public domain | public-domain | (?:is|are) in the public domain
6 | public domain | public-domain | public domain dedication
6 | unencumbered | unlicense | this is free and unencumbered software
7 | unlicense | unlicense | (?:licensed|released|distributed|available|published) under (?:the )?unlicense
9 | unlicense | unlicense | spdx license identifier unlicense
1 | warrant | warranty | without warrant(?:y|ies) (?:or conditions )?of any kind
1 | warrant | warranty | without any warranty
1 | warrant | warranty | implied warrant(?:y|ies) of merchantability
1 | as is | warranty | provided as is without
1 | as is | warranty | on an as is basis
4 | confidential | proprietary | proprietary and confidential
4 | proprietary | proprietary | proprietary licen[sc]e
4 | permission | proprietary | without (?:the )?(?:prior|express) written permission
4 | evaluation | evaluation | for evaluation purposes only
4 | commercial | non-commercial | for non ?commercial use only
4 | commercial | non-commercial | not for commercial use
4 | research | research-only | for research (?:purposes|use) only
4 | shareware | shareware | this (?:software|program) is shareware
4 | freeware | freeware | this (?:software|program) is freeware
1 | licensed under | any-license | licensed under (?:the )?terms
1 | dual licensed | any-license | dual licensed
1 | license agreement | any-license | end user license agreement
5 | cc by | cc-by-sa | cc by sa
7 | cc by | cc-by-sa-2.0 | cc by sa 2 0
7 | cc by | cc-by-sa-2.5 | cc by sa 2 5
7 | cc by | cc-by-sa-3.0 | cc by sa 3 0
7 | cc by | cc-by-sa-4.0 | cc by sa 4 0
6 | cc by | cc-by-nc-sa | cc by nc sa
8 | cc by | cc-by-nc-sa-3.0 | cc by nc sa 3 0
8 | cc by | cc-by-nc-sa-4.0 | cc by nc sa 4 0
6 | cc by | cc-by-nc-nd | cc by nc nd
8 | cc by | cc-by-nc-nd-3.0 | cc by nc nd 3 0
8 | cc by | cc-by-nc-nd-4.0 | cc by nc nd 4 0
5 | cc by | cc-by-nc | cc by nc
7 | cc by | cc-by-nc-3.0 | cc by nc 3 0
7 | cc by | cc-by-nc-4.0 | cc by nc 4 0
5 | cc by | cc-by-nd | cc by nd
7 | cc by | cc-by-nd-3.0 | cc by nd 3 0
7 | cc by | cc-by-nd-4.0 | cc by nd 4 0
4 | cc by | cc-by-2.0 | cc by 2 0
4 | cc by | cc-by-2.5 | cc by 2 5
4 | cc by | cc-by-3.0 | cc by 3 0
4 | cc by | cc-by-4.0 | cc by 4 0
5 | attribution | cc-by | creative commons attribution(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: licen[sc]e)?
6 | alike | cc-by-sa | creative commons attribution share ?alike(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: licen[sc]e)?
6 | attribution | cc-by-nc | creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: licen[sc]e)?
7 | alike | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: licen[sc]e)?
6 | attribution | cc-by-nd | creative commons attribution no ?deriv(?:ative|atives|s)?(?: works)?(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: licen[sc]e)?
7 | attribution | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)?(?: works)?(?: [0-9] [0-9])?(?: international| unported)?(?: licen[sc]e)?
4 | creative commons | cc | (?:under|with) a creative commons licen[sc]e
7 | cc0 | cc0-1.0 | cc0(?: 1 0)?
8 | cc0 | cc0-1.0 | creative commons cc0(?: 1 0)?(?: universal)?
7 | zero | cc0-1.0 | creative commons zero(?: 1 0)?(?: universal)?(?: licen[sc]e)?
9 | cc by | cc-by-4.0 | spdx license identifier cc by 4 0
9 | cc by | cc-by-3.0 | spdx license identifier cc by 3 0
9 | cc by | cc-by-sa-4.0 | spdx license identifier cc by sa 4 0
9 | cc by | cc-by-sa-3.0 | spdx license identifier cc by sa 3 0
9 | cc by | cc-by-nc-4.0 | spdx license identifier cc by nc 4 0
9 | cc0 | cc0-1.0 | spdx license identifier cc0 1 0
5 | apache | apache | apache(?: software)?(?: foundation)? licen[sc]e
6 | apache | apache | terms of (?:the )?apache licen[sc]e
7 | apache | apache | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?apache(?: software)?(?: licen[sc]e)?
8 | apache | apache-1.1 | apache(?: software)? licen[sc]e(?: version)? (?:v ?)?1 1
8 | apache | apache-2.0 | (?:(?:licensed|released|distributed|available|published) under (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version)? (?:v ?)?2(?: 0)?
8 | asl | apache-2.0 | asl 2 0
9 | apache | apache-2.0 | spdx license identifier apache 2 0
9 | apache | apache-1.1 | spdx license identifier apache 1 1
5 | mit | mit | mit licen[sc]e
5 | mit | mit | mit x11(?: style)? licen[sc]e
6 | mit | mit | terms of (?:the )?mit licen[sc]e
7 | mit | mit | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?
7 | mit | mit | licen[sc]e(?: is)? mit
8 | free of charge | mit | permission is hereby granted free of charge to any person obtaining a copy
9 | mit | mit | spdx license identifier mit
9 | mit | mit-0 | spdx license identifier mit 0
6 | no attribution | mit-0 | mit no attribution(?: licen[sc]e)?
5 | bsd | bsd | bsd(?: style)? licen[sc]e
6 | bsd | bsd | terms of (?:the )?bsd licen[sc]e
7 | bsd | bsd | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[sc]e)?
8 | bsd | bsd-2-clause | (?:2|two) clause bsd(?: licen[sc]e)?
8 | bsd | bsd-2-clause | (?:(?:licensed|released|distributed|available|published) under (?:the )?)?bsd (?:2|two) clause(?: licen[sc]e)?
8 | bsd | bsd-3-clause | (?:3|three) clause bsd(?: licen[sc]e)?
8 | bsd | bsd-3-clause | (?:(?:licensed|released|distributed|available|published) under (?:the )?)?bsd (?:3|three) clause(?: licen[sc]e)?
8 | bsd | bsd-4-clause | (?:4|four) clause bsd(?: licen[sc]e)?
8 | bsd | bsd-4-clause | (?:(?:licensed|released|distributed|available|published) under (?:the )?)?bsd (?:4|four) clause(?: licen[sc]e)?
7 | bsd | bsd-2-clause | simplified bsd(?: licen[sc]e)?
7 | bsd | bsd-3-clause | (?:new|modified|revised) bsd(?: licen[sc]e)?
7 | freebsd | bsd-2-clause | freebsd licen[sc]e
7 | redistribution | bsd | redistribution and use in source and binary forms with or without modification are permitted
9 | bsd | bsd-2-clause | spdx license identifier bsd 2 clause
9 | bsd | bsd-3-clause | spdx license identifier bsd 3 clause
9 | bsd | bsd-4-clause | spdx license identifier bsd 4 clause
9 | 0bsd | 0bsd | spdx license identifier 0bsd
7 | 0bsd | 0bsd | (?:licensed|released|distributed|available|published) under (?:the )?0bsd(?: licen[sc]e)?
5 | mozilla | mpl | mozilla public licen[sc]e
7 | mozilla | mpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mozilla public licen[sc]e
8 | mozilla | mpl-1.0 | mozilla public licen[sc]e(?: version)? (?:v ?)?1 0
8 | mozilla | mpl-1.1 | mozilla public licen[sc]e(?: version)? (?:v ?)?1 1
8 | mozilla | mpl-2.0 | mozilla public licen[sc]e(?: version)? (?:v ?)?2(?: 0)?
6 | mpl | mpl-2.0 | mpl (?:v ?)?2 0
7 | mpl | mpl-2.0 | (?:licensed|released|distributed|available|published) under (?:the )?mpl(?: version)? (?:v ?)?2(?: 0)?
9 | mpl | mpl-1.1 | spdx license identifier mpl 1 1
9 | mpl | mpl-2.0 | spdx license identifier mpl 2 0
5 | eclipse | epl | eclipse public licen[sc]e
7 | eclipse | epl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?eclipse public licen[sc]e
8 | eclipse | epl-1.0 | eclipse public licen[sc]e(?: version)? (?:v ?)?1 0
8 | eclipse | epl-2.0 | eclipse public licen[sc]e(?: version)? (?:v ?)?2 0
6 | eclipse | edl-1.0 | eclipse distribution licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | epl | epl-1.0 | spdx license identifier epl 1 0
9 | epl | epl-2.0 | spdx license identifier epl 2 0
5 | gnu | gpl | gnu general public licen[sc]e
5 | gpl | gpl | gpl licen[sc]e
6 | gnu | gpl | terms of (?:the )?gnu general public licen[sc]e
7 | gnu | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gnu (?:gpl|general public licen[sc]e)
7 | gpl | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?gpl
8 | general public | gpl-1 | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?1(?: 0)?(?: only| or later)?
8 | general public | gpl-2 | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?2(?: 0)?(?: only| or later)?
8 | general public | gpl-3 | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v ?)?3(?: 0)?(?: only| or later)?
7 | gplv2 | gpl-2 | gplv2(?: only| or later)?
7 | gplv3 | gpl-3 | gplv3(?: only| or later)?
7 | gpl | gpl | licen[sc]e(?: is)? gpl
7 | gpl | gpl-2 | gpl(?: version)? (?:v ?)?2(?: 0)?(?: only| or later)?
7 | gpl | gpl-3 | gpl(?: version)? (?:v ?)?3(?: 0)?(?: only| or later)?
9 | gpl | gpl-1 | spdx license identifier gpl 1 0(?: only| or later)?
9 | gpl | gpl-2 | spdx license identifier gpl 2 0(?: only| or later)?
9 | gpl | gpl-3 | spdx license identifier gpl 3 0(?: only| or later)?
6 | general public | lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e
7 | general public | lgpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser|library) general public licen[sc]e
8 | general public | lgpl-2 | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v ?)?2(?: 0)?(?: only| or later)?
9 | general public | lgpl-2.1 | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v ?)?2 1(?: only| or later)?
8 | general public | lgpl-3 | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version)? (?:v ?)?3(?: 0)?(?: only| or later)?
7 | lgpl | lgpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?lgpl
7 | lgplv2 | lgpl-2.1 | lgplv2 1(?: only| or later)?
7 | lgplv3 | lgpl-3 | lgplv3(?: only| or later)?
7 | lgpl | lgpl-2.1 | lgpl(?: version)? (?:v ?)?2 1(?: only| or later)?
7 | lgpl | lgpl-3 | lgpl(?: version)? (?:v ?)?3(?: 0)?(?: only| or later)?
9 | lgpl | lgpl-2 | spdx license identifier lgpl 2 0(?: only| or later)?
9 | lgpl | lgpl-2.1 | spdx license identifier lgpl 2 1(?: only| or later)?
9 | lgpl | lgpl-3 | spdx license identifier lgpl 3 0(?: only| or later)?
6 | affero | agpl | (?:gnu )?affero general public licen[sc]e
8 | affero | agpl-1 | (?:gnu )?affero general public licen[sc]e(?: version)? (?:v ?)?1(?: 0)?
8 | affero | agpl-3 | (?:gnu )?affero general public licen[sc]e(?: version)? (?:v ?)?3(?: 0)?(?: only| or later)?
7 | affero | agpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[sc]e
7 | agpl | agpl | (?:licensed|released|distributed|available|published) under (?:the )?agpl
7 | agplv3 | agpl-3 | agplv3(?: only| or later)?
7 | agpl | agpl-3 | agpl(?: version)? (?:v ?)?3(?: 0)?(?: only| or later)?
9 | agpl | agpl-3 | spdx license identifier agpl 3 0(?: only| or later)?
5 | documentation | gfdl | (?:gnu )?free documentation licen[sc]e
8 | documentation | gfdl-1.1 | (?:gnu )?free documentation licen[sc]e(?: version)? (?:v ?)?1 1
8 | documentation | gfdl-1.2 | (?:gnu )?free documentation licen[sc]e(?: version)? (?:v ?)?1 2
8 | documentation | gfdl-1.3 | (?:gnu )?free documentation licen[sc]e(?: version)? (?:v ?)?1 3
9 | gfdl | gfdl-1.3 | spdx license identifier gfdl 1 3(?: only| or later)?
5 | isc | isc | isc licen[sc]e
7 | isc | isc | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?isc(?: licen[sc]e)?
7 | without fee | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
9 | isc | isc | spdx license identifier isc
5 | zlib | zlib | zlib(?: libpng)? licen[sc]e
7 | zlib | zlib | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?zlib(?: licen[sc]e)?
9 | zlib | zlib | spdx license identifier zlib
5 | libpng | libpng | libpng licen[sc]e
9 | libpng | libpng | spdx license identifier libpng(?: 2 0)?
5 | artistic | artistic | artistic licen[sc]e
8 | artistic | artistic-1.0 | artistic licen[sc]e(?: version)? (?:v ?)?1 0
8 | artistic | artistic-2.0 | artistic licen[sc]e(?: version)? (?:v ?)?2(?: 0)?
7 | artistic | artistic | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?artistic licen[sc]e
7 | perl | perl | under the same terms as perl(?: itself)?
9 | artistic | artistic-2.0 | spdx license identifier artistic 2 0
9 | artistic | artistic-1.0 | spdx license identifier artistic 1 0
5 | boost | bsl-1.0 | boost software licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
7 | boost | bsl-1.0 | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?boost software licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | bsl | bsl-1.0 | spdx license identifier bsl 1 0
6 | business source | busl-1.1 | business source licen[sc]e(?: version)?(?: (?:v ?)?1 1)?
9 | busl | busl-1.1 | spdx license identifier busl 1 1
5 | european | eupl | european union public licen[sc]e
8 | european | eupl-1.1 | european union public licen[sc]e(?: version)? (?:v ?)?1 1
8 | european | eupl-1.2 | european union public licen[sc]e(?: version)? (?:v ?)?1 2
9 | eupl | eupl-1.1 | spdx license identifier eupl 1 1
9 | eupl | eupl-1.2 | spdx license identifier eupl 1 2
5 | font | ofl | (?:sil )?open font licen[sc]e
8 | font | ofl-1.0 | (?:sil )?open font licen[sc]e(?: version)? (?:v ?)?1 0
8 | font | ofl-1.1 | (?:sil )?open font licen[sc]e(?: version)? (?:v ?)?1 1
9 | ofl | ofl-1.1 | spdx license identifier ofl 1 1
5 | postgresql | postgresql | postgresql licen[sc]e
9 | postgresql | postgresql | spdx license identifier postgresql
5 | python | psf | python software foundation licen[sc]e(?: version)?(?: (?:v ?)?2(?: 0)?)?
7 | psf | psf | (?:licensed|released|distributed|available|published) under (?:the )?psf(?: licen[sc]e)?
9 | python | python-2.0 | spdx license identifier python 2 0
9 | psf | psf-2.0 | spdx license identifier psf 2 0
5 | ruby | ruby | ruby licen[sc]e
9 | ruby | ruby | spdx license identifier ruby
5 | php | php | php licen[sc]e
8 | php | php-3.0 | php licen[sc]e(?: version)? (?:v ?)?3 0
8 | php | php-3.01 | php licen[sc]e(?: version)? (?:v ?)?3 01
9 | php | php-3.01 | spdx license identifier php 3 01
5 | openssl | openssl | openssl licen[sc]e
9 | openssl | openssl | spdx license identifier openssl
5 | x11 | x11 | x11 licen[sc]e
9 | x11 | x11 | spdx license identifier x11
5 | microsoft | ms-pl | microsoft public licen[sc]e
9 | ms pl | ms-pl | spdx license identifier ms pl
5 | reciprocal | ms-rl | microsoft reciprocal licen[sc]e
9 | ms rl | ms-rl | spdx license identifier ms rl
5 | distribution | cddl | common development and distribution licen[sc]e
8 | distribution | cddl-1.0 | common development and distribution licen[sc]e(?: version)? (?:v ?)?1 0
8 | distribution | cddl-1.1 | common development and distribution licen[sc]e(?: version)? (?:v ?)?1 1
9 | cddl | cddl-1.0 | spdx license identifier cddl 1 0
5 | common public | cpl-1.0 | common public licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | cpl | cpl-1.0 | spdx license identifier cpl 1 0
5 | ibm | ipl-1.0 | ibm public licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | ipl | ipl-1.0 | spdx license identifier ipl 1 0
5 | apple | apsl | apple public source licen[sc]e
8 | apple | apsl-2.0 | apple public source licen[sc]e(?: version)? (?:v ?)?2 0
9 | apsl | apsl-2.0 | spdx license identifier apsl 2 0
5 | w3c | w3c | w3c(?: software)?(?: and document)?(?: notice and)? licen[sc]e
9 | w3c | w3c | spdx license identifier w3c
5 | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
9 | ncsa | ncsa | spdx license identifier ncsa
5 | academic | afl | academic free licen[sc]e
8 | academic | afl-2.1 | academic free licen[sc]e(?: version)? (?:v ?)?2 1
8 | academic | afl-3.0 | academic free licen[sc]e(?: version)? (?:v ?)?3 0
9 | afl | afl-3.0 | spdx license identifier afl 3 0
6 | educational | ecl-2.0 | educational community licen[sc]e(?: version)?(?: (?:v ?)?2 0)?
9 | ecl | ecl-2.0 | spdx license identifier ecl 2 0
5 | open software | osl | open software licen[sc]e
8 | open software | osl-3.0 | open software licen[sc]e(?: version)? (?:v ?)?3 0
9 | osl | osl-3.0 | spdx license identifier osl 3 0
5 | database | odbl-1.0 | open (?:data commons open )?database licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | odbl | odbl-1.0 | spdx license identifier odbl 1 0
5 | open data commons | odc-by-1.0 | open data commons attribution licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | odc by | odc-by-1.0 | spdx license identifier odc by 1 0
6 | open data commons | pddl-1.0 | open data commons public domain dedication(?: and)?(?: licen[sc]e)?
9 | pddl | pddl-1.0 | spdx license identifier pddl 1 0
6 | open government | ogl | open government licen[sc]e
8 | open government | ogl-3.0 | open government licen[sc]e(?: version)? (?:v ?)?3 0
9 | ogl | ogl-3.0 | spdx license identifier ogl uk 3 0
5 | zope | zpl | zope public licen[sc]e
8 | zope | zpl-2.1 | zope public licen[sc]e(?: version)? (?:v ?)?2 1
9 | zpl | zpl-2.1 | spdx license identifier zpl 2 1
5 | q public | qpl-1.0 | q public licen[sc]e(?: version)?(?: (?:v ?)?1 0)?
9 | qpl | qpl-1.0 | spdx license identifier qpl 1 0
5 | vim | vim | vim licen[sc]e
9 | vim | vim | spdx license identifier vim
5 | sleepycat | sleepycat | sleepycat licen[sc]e
9 | sleepycat | sleepycat | spdx license identifier sleepycat
5 | curl | curl | curl licen[sc]e
9 | curl | curl | spdx license identifier curl
5 | json | json | (?:the )?json licen[sc]e
9 | json | json | spdx license identifier json
5 | unicode | unicode | unicode(?: inc)? licen[sc]e(?: agreement)?
9 | unicode | unicode | spdx license identifier unicode(?: dfs)?(?: [0-9]+| tou)?
6 | wtfpl | wtfpl | wtfpl
6 | beerware | beerware | beerware(?: licen[sc]e)?
6 | server side | sspl-1.0 | server side public licen[sc]e(?: version)?(?: (?:v ?)?1)?
9 | sspl | sspl-1.0 | spdx license identifier sspl 1 0
6 | elastic | elastic-2.0 | elastic licen[sc]e(?: version)?(?: (?:v ?)?2(?: 0)?)?
9 | elastic | elastic-2.0 | spdx license identifier elastic 2 0
6 | commons clause | commons-clause | commons clause(?: licen[sc]e)?(?: condition)?
6 | llama | llama | llama(?: [0-9])?(?: [0-9])? community licen[sc]e(?: agreement)?
6 | rail | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?
5 | mulan | mulanpsl-2.0 | mulan permissive software licen[sc]e(?: version)?(?: (?:v ?)?2)?
9 | mulanpsl | mulanpsl-2.0 | spdx license identifier mulanpsl 2 0
5 | cecill | cecill | cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?(?: agreement)?
9 | cecill | cecill-2.1 | spdx license identifier cecill 2 1
5 | universal permissive | upl-1.0 | universal permissive licen[sc]e(?: upl)?(?: version)?(?: (?:v ?)?1 0)?
9 | upl | upl-1.0 | spdx license identifier upl 1 0
5 | freetype | ftl | freetype(?: project)? licen[sc]e
9 | ftl | ftl | spdx license identifier ftl
5 | imagemagick | imagemagick | imagemagick licen[sc]e
9 | imagemagick | imagemagick | spdx license identifier imagemagick
5 | latex | lppl | latex project public licen[sc]e
8 | latex | lppl-1.3c | latex project public licen[sc]e(?: version)? (?:v ?)?1 3c?
9 | lppl | lppl-1.3c | spdx license identifier lppl 1 3c
5 | licen | ijg | (?:ijg|independent jpeg group) licen[sc]e
9 | ijg | ijg | spdx license identifier ijg
5 | info zip | info-zip | info zip licen[sc]e
9 | info zip | info-zip | spdx license identifier info zip
"""


def rows() -> list[tuple[int, str, str, str]]:
    """Priority, keyword, label and pattern of each line."""
    out = []
    for line in TEXT.strip().splitlines():
        priority, keyword, label, pattern = line.split(" | ")
        out.append((int(priority), keyword, label, pattern))
    return out
