"""Ordered signature rules for licences, written by hand.

A pattern is matched against the words of a text (lower case, joined by one space), from a keyword on: its first word. Rules come
in order of priority: notices that put something under a licence, names with a version, sentences of licence texts, plain
names, identifiers, signs of ownership. A rule keeps what a later one finds inside its words from being told.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Strength of the evidence, then one rule a line: label and pattern.
SIGNATURES = (
    (0.95, """
gpl        licensed under (the )?(terms of )?(the )?gnu (general public licen[sc]e|gpl)( as published by the free software foundation)?( either)?( version| v)? ?[123]?( 0)?( only| or (at your option )?(any )?later( version)?)?
lgpl       licensed under (the )?(terms of )?(the )?gnu (lesser|library) general public licen[sc]e( as published by the free software foundation)?( either)?( version| v)? ?[23]?( [01])?( only| or (at your option )?(any )?later( version)?)?
agpl       licensed under (the )?(terms of )?(the )?(gnu )?affero general public licen[sc]e( as published by the free software foundation)?( either)?( version| v)? ?3?( 0)?( only| or (at your option )?(any )?later( version)?)?
gpl        licensed under (the )?gpl( ?v?[123])?( 0)?( only| or later)?
lgpl       licensed under (the )?lgpl( ?v?[23])?( [01])?( only| or later)?
agpl       licensed under (the )?agpl( ?v?3)?( 0)?( only| or later)?
apache     licensed under (the )?(terms of )?(the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?( the licen[sc]e)?
apache     licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
mit        licensed under (the )?(terms of )?(the )?(mit|expat) licen[sc]e( see licen[sc]e)?
mit        licensed under (the )?mit
bsd        licensed under (the )?(terms of )?(the )?(new |modified |revised |simplified )?bsd( [0234] clause)?( style)? licen[sc]e
bsd        licensed under (the )?bsd [0234] clause
bsd        licensed under (a|the) [234] clause bsd( style)? licen[sc]e
isc        licensed under (the )?(terms of )?(the )?isc licen[sc]e
mpl        licensed under (the )?(terms of )?(the )?mozilla public licen[sc]e( version| v)?( [12])?( [01])?
epl        licensed under (the )?(terms of )?(the )?eclipse (public|distribution) licen[sc]e( version| v)?( [12])?( 0)?
eupl       licensed under (the )?(terms of )?(the )?(eupl|european union public licen[sc]e)( version| v)?( 1)?( [0-9])?
cddl       licensed under (the )?(terms of )?(the )?(cddl|common development and distribution licen[sc]e)( version)?( 1)?( [01])?
cecill     licensed under (the )?(terms of )?(the )?cecill( free software)?( licen[sc]e)?
artistic   licensed under (the )?(terms of )?(the )?artistic licen[sc]e( version)?( [12])?( 0)?
boost      licensed under (the )?(terms of )?(the )?boost software licen[sc]e( version)?( 1)?( 0)?
zlib       licensed under (the )?(terms of )?(the )?zlib (libpng )?licen[sc]e
psf        licensed to psf under a contributor agreement
ofl        licensed under (the )?(terms of )?(the )?(sil )?open font licen[sc]e( version)?( 1)?( [01])?
odbl       licensed under (the )?(terms of )?(the )?(open data commons )?open database licen[sc]e
unlicense  licensed under (the )?unlicense
wtfpl      licensed under (the )?wtfpl( version)?( 2)?
cc-by-sa   licensed under (a |the )?creative commons attribution share ?alike( [1234] [0-9])?( international| unported)?( licen[sc]e)?
cc-by-nc   licensed under (a |the )?creative commons attribution non ?commercial( share ?alike| no ?deriv(ative)?s)?( [1234] [0-9])?( international| unported)?( licen[sc]e)?
cc-by-nd   licensed under (a |the )?creative commons attribution no ?deriv(ative)?s( [1234] [0-9])?( international| unported)?( licen[sc]e)?
cc-by      licensed under (a |the )?creative commons attribution( [1234] [0-9])?( international| unported)?( licen[sc]e)?
cc-by-sa   licensed under (a |the )?cc by sa( [1234] [0-9])?
cc-by-nc   licensed under (a |the )?cc by nc( sa| nd)?( [1234] [0-9])?
cc-by      licensed under (a |the )?cc by( [1234] [0-9])?
cc0        licensed under (the )?cc0( 1 0)?
gpl        released under (the )?(terms of )?(the )?gnu (general public licen[sc]e|gpl)( version| v)? ?[123]?( only| or (any )?later( version)?)?
lgpl       released under (the )?(terms of )?(the )?gnu (lesser|library) general public licen[sc]e( version| v)? ?[23]?( [01])?
gpl        released under (the )?gpl( ?v?[123])?
apache     released under (the )?(terms of )?(the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
mit        released under (the )?(terms of )?(the )?(mit|expat) licen[sc]e
bsd        released under (the |a )?(terms of )?(the )?(new |modified |revised |simplified )?bsd( [0234] clause)?( style)? licen[sc]e
mpl        released under (the )?(terms of )?(the )?mozilla public licen[sc]e( version| v)?( [12])?( [01])?
cc-by      released under (a |the )?creative commons attribution( [1234] [0-9])?( international| unported)?( licen[sc]e)?
cc-by-sa   released under (a |the )?creative commons attribution share ?alike( [1234] [0-9])?( licen[sc]e)?
cc0        released under (the )?cc0( 1 0)?
unlicense  released into the public domain
public-domain placed in the public domain
gpl        distributed under (the )?(terms of )?(the )?gnu (general public licen[sc]e|gpl)( version| v)? ?[123]?( only| or (any )?later( version)?)?
lgpl       distributed under (the )?(terms of )?(the )?gnu (lesser|library) general public licen[sc]e( version| v)? ?[23]?( [01])?
agpl       distributed under (the )?(terms of )?(the )?(gnu )?affero general public licen[sc]e( version| v)? ?3?
apache     distributed under (the )?(terms of )?(the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
mit        distributed under (the )?(terms of )?(the )?(mit|expat) licen[sc]e
bsd        distributed under (the |a )?(terms of )?(the )?(new |modified |revised |simplified )?bsd( [0234] clause)?( style)? licen[sc]e
boost      distributed under the boost software licen[sc]e( version)?( 1)?( 0)?
artistic   distributed under the same terms as perl( itself)?
apache     distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl        distributed in the hope that it will be useful but without any warranty
apache     available under (the )?(terms of )?(the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
mit        available under (the )?(terms of )?(the )?(mit|expat) licen[sc]e
gpl        available under (the )?(terms of )?(the )?gnu (general public licen[sc]e|gpl)( version| v)? ?[123]?
bsd        available under (the |a )?(terms of )?(the )?(new |modified |revised |simplified )?bsd( [0234] clause)?( style)? licen[sc]e
cc-by      available under (a |the )?creative commons attribution( [1234] [0-9])?( international| unported)?( licen[sc]e)?
cc-by-sa   available under (a |the )?creative commons attribution share ?alike( [1234] [0-9])?( licen[sc]e)?
epl        available under the terms of the eclipse public licen[sc]e( version| v)?( [12])?( 0)?
epl        made available under the terms of the eclipse public licen[sc]e( version| v)?( [12])?( 0)?
gpl        published under (the )?(terms of )?(the )?gnu (general public licen[sc]e|gpl)( version| v)? ?[123]?
mit        published under (the )?(terms of )?(the )?(mit|expat) licen[sc]e
apache     published under (the )?(terms of )?(the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
cc-by      published under (a |the )?creative commons attribution( [1234] [0-9])?( licen[sc]e)?
mpl        subject to the terms of the mozilla public licen[sc]e( version| v)?( [12])?( [01])?
mpl        subject to the mozilla public licen[sc]e( version| v)?( [12])?( [01])?
cddl       subject to the terms of the common development and distribution licen[sc]e
apache     subject to the (terms of the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
mit        subject to the (terms of the )?mit licen[sc]e
gpl        governed by the (terms of the )?gnu general public licen[sc]e( version| v)? ?[123]?
apache     governed by the (terms of the )?apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
bsd        governed by a bsd style licen[sc]e
mit        governed by (an|the) mit( style)? licen[sc]e
gpl        covered by the gnu (general public licen[sc]e|gpl)( version| v)? ?[123]?
apache     covered by the apache( software)? licen[sc]e( version| v)?( 2)?( 0)?
gpl        redistribute it and or modify it under the terms of the gnu general public licen[sc]e( as published by the free software foundation)?( either)?( version [123])?( of the licen[sc]e)?( or at your option any later version)?
lgpl       redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[sc]e( as published by the free software foundation)?( either)?( version [23]( 1)?)?( of the licen[sc]e)?
agpl       redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e( as published by the free software foundation)?( either)?( version 3)?( of the licen[sc]e)?
artistic   redistribute it and or modify it under the same terms as perl( itself)?
gpl        dual licensed under (the )?mit and gpl( licen[sc]es)?
mit        dual licensed under (the )?(terms of )?(the )?mit (licen[sc]e )?(and|or) (the )?apache( licen[sc]e)?( version)?( 2)?( 0)?
apache     dual licensed under (the )?(terms of )?(the )?apache( licen[sc]e)?( version)?( 2)?( 0)? (and|or) (the )?mit( licen[sc]e)?
spdx       spdx licen[sc]e identifier [a-z0-9]+( [0-9]+)*( only| or later)?( with [a-z]+ exception)?
"""),
    (0.85, """
gpl        gnu general public licen[sc]e( as published by the free software foundation)?( either)?( version| v)? ?[123]( 0)?( only| or (at your option )?(any )?later( version)?)?
gpl        gnu gpl( version| v)? ?[123]( 0)?( only| or (any )?later( version)?)?
lgpl       gnu lesser general public licen[sc]e( as published by the free software foundation)?( either)?( version| v)? ?[23]( [01])?( only| or (any )?later( version)?)?
lgpl       gnu library general public licen[sc]e( version| v)? ?2( 0)?( only| or (any )?later( version)?)?
lgpl       gnu lgpl( version| v)? ?[23]( [01])?( only| or (any )?later( version)?)?
agpl       gnu affero general public licen[sc]e( version| v)? ?3( 0)?( only| or (any )?later( version)?)?
agpl       gnu agpl( version| v)? ?3( 0)?( only| or (any )?later( version)?)?
gfdl       gnu free documentation licen[sc]e( version| v)? ?1( [0123])?( or any later version)?
apache     apache software licen[sc]e( version| v)? ?[12]( [01])?
apache     apache licen[sc]e( version| v)? ?2( 0)?
apache     apache 2( 0)? licen[sc]e
mpl        mozilla public licen[sc]e( version| v)? ?[12]( [01])?
epl        eclipse public licen[sc]e( version| v)? ?[12]( 0)?
edl        eclipse distribution licen[sc]e( version| v)? ?1( 0)?
cddl       common development and distribution licen[sc]e( version| v)? ?1( [01])?
cpl        common public licen[sc]e( version| v)? ?[01]( [05])?
ipl        ibm public licen[sc]e( version| v)? ?1( 0)?
eupl       european union public licen[sc]e( version| v)? ?1( [0-9])?
osl        open software licen[sc]e( version| v)? ?[123]( [01])?
afl        academic free licen[sc]e( version| v)? ?[123]( [012])?
artistic   artistic licen[sc]e( version| v)? ?[12]( 0)?
boost      boost software licen[sc]e( version| v)? ?1( 0)?
psf        python software foundation licen[sc]e( version| v)? ?2
ofl        sil open font licen[sc]e( version| v)? ?1( [01])?
ofl        open font licen[sc]e( version| v)? ?1( [01])?
odbl       open database licen[sc]e( version| v)? ?1( 0)?
php        php licen[sc]e( version| v)? ?[23]( 0)?( 1)?
zpl        zope public licen[sc]e( version| v)? ?[12]( [01])?
lppl       latex project public licen[sc]e( version| v)? ?1( [0-3])?
qpl        q public licen[sc]e( version| v)? ?1( 0)?
apsl       apple public source licen[sc]e( version| v)? ?[12]( [012])?
w3c        w3c software (notice and )?(document )?licen[sc]e( [12][0-9]{3})?
bsl        business source licen[sc]e( version| v)? ?1( [01])?
sspl       server side public licen[sc]e( version| v)? ?1
elastic    elastic licen[sc]e( version| v)? ?2( 0)?
unicode    unicode licen[sc]e( version| v)? ?3
mulan      mulan psl( version| v)? ?[12]
cc-by-sa   creative commons attribution share ?alike [1234] [0-9]( international| unported)?( licen[sc]e)?
cc-by-nc   creative commons attribution non ?commercial( share ?alike| no ?deriv(ative)?s)? [1234] [0-9]( international| unported)?( licen[sc]e)?
cc-by-nd   creative commons attribution no ?deriv(ative)?s [1234] [0-9]( international| unported)?( licen[sc]e)?
cc-by      creative commons attribution [1234] [0-9]( international| unported)?( licen[sc]e)?
cc0        creative commons (zero|cc0)( v?1 0)?( universal)?( public domain dedication)?
cc-by-sa   cc by sa [1234] [0-9]
cc-by-nc   cc by nc( sa| nd)? [1234] [0-9]
cc-by-nd   cc by nd [1234] [0-9]
cc-by      cc by [1234] [0-9]
cc0        cc0 1 0( universal)?
gpl        gpl( version| v)? ?[123]( 0)?( only| or (any )?later( version)?)
lgpl       lgpl( version| v)? ?[23]( [01])?( only| or (any )?later( version)?)
agpl       agpl( version| v)? ?3( 0)?( only| or (any )?later( version)?)
bsd        bsd [0234] clause( new| revised| simplified)?( or| and)?( licen[sc]e)?
"""),
    (0.8, """
mit        permission is hereby granted free of charge to any person obtaining a copy( of this software and associated documentation files)?
ofl        permission is hereby granted free of charge to any person obtaining a copy of the font software
x11        permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
isc        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc        permission to use copy modify and or distribute this software
hpnd       permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
zlib       permission is granted to anyone to use this software for any purpose( including commercial applications)?
gfdl       permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gpl        everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document( but changing it is not allowed)?
mit        above copyright notice and this permission notice shall be included in all copies( or substantial portions of the software)?
x11        above copyright notice appear in all copies
bsd        redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?
bsd        redistribution and use in source and binary forms
bsd        redistributions of source code must retain the above copyright notice
bsd        redistributions in binary form must reproduce the above copyright notice
bsd        neither the name of( the)? [a-z0-9]+( nor| and)?( the names of its contributors)?
bsd        advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
apache     unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache     except in compliance with the licen[sc]e
apache     grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e
apache     terms and conditions for use reproduction and distribution
gpl        terms and conditions for copying distribution and modification
gpl        received a copy of the gnu general public licen[sc]e( along with this program)?
lgpl       received a copy of the gnu lesser general public licen[sc]e( along with this library)?
agpl       received a copy of the gnu affero general public licen[sc]e( along with this program)?
gpl        free software foundation inc 5[19] (franklin street|temple place)
gpl        without even the implied warranty of merchantability or fitness for a particular purpose
gpl        program is free software you can redistribute it and or modify it
lgpl       library is free software you can redistribute it and or modify it
mpl        source code form is subject to the terms of the mozilla public licen[sc]e( v)?( 2)?( 0)?
mpl        contents of this file are subject to the mozilla public licen[sc]e( version)?( 1)?( 1)?
npl        contents of this file are subject to the netscape public licen[sc]e( version)?( 1)?( [01])?
zlib       altered source versions must be plainly marked as such
zlib       origin of this software must not be misrepresented
zlib       event will the authors be held liable for any damages arising from the use of this software
boost      boost software licen[sc]e version 1 0 august 17th 2003
unlicense  free and unencumbered software released into the public domain
unlicense  anyone is free to copy modify publish use compile sell or distribute this software
wtfpl      fuck you want to public licen[sc]e
beerware   retain this notice you can do whatever you want with this stuff
beerware   beer ware licen[sc]e
json       shall be used for good not evil
cc0        waived all copyright and related or neighboring rights
openssl    includes software developed by the openssl project
bsd        includes software developed by the university of california
php        includes php software freely available from
epl        accompanying program is provided under the terms of this eclipse public licen[sc]e
cecill     logiciel est r[ée]gi par la licen[sc]e cecill
cecill     governed by the cecill( [a-c])? licen[sc]e
eupl       unless required by applicable law or agreed to in writing software distributed under the eupl
artistic   intent of this document is to state the conditions under which a package may be copied
lppl       work may be distributed and or modified under the conditions of the latex project public licen[sc]e
proprietary software is proprietary and confidential
proprietary unauthorized copying of this file via any medium is strictly prohibited
proprietary proprietary and confidential
commercial commercial licen[sc]e agreement
commercial end user licen[sc]e agreement
"""),
    (0.7, """
gpl        gnu general public licen[sc]e
gpl        gnu gpl
lgpl       gnu lesser general public licen[sc]e
lgpl       gnu library general public licen[sc]e
lgpl       gnu lgpl
agpl       gnu affero general public licen[sc]e
agpl       affero general public licen[sc]e
agpl       gnu agpl
gfdl       gnu free documentation licen[sc]e
gpl        general public licen[sc]e
lgpl       lesser general public licen[sc]e
apache     apache software licen[sc]e
apache     apache licen[sc]e
mit        mit licen[sc]e
mit        mit style licen[sc]e
mit        expat licen[sc]e
x11        x11 licen[sc]e
bsd        bsd licen[sc]e
bsd        bsd style licen[sc]e
bsd        simplified bsd licen[sc]e
bsd        revised bsd licen[sc]e
bsd        modified bsd licen[sc]e
bsd        new bsd licen[sc]e
bsd        freebsd licen[sc]e
isc        isc licen[sc]e
mpl        mozilla public licen[sc]e
epl        eclipse public licen[sc]e
edl        eclipse distribution licen[sc]e
cddl       common development and distribution licen[sc]e
cpl        common public licen[sc]e
ipl        ibm public licen[sc]e
eupl       european union public licen[sc]e
cecill     cecill( free software)? licen[sc]e( agreement)?
osl        open software licen[sc]e
afl        academic free licen[sc]e
artistic   artistic licen[sc]e
artistic   perl artistic licen[sc]e
boost      boost software licen[sc]e
boost      boost licen[sc]e
zlib       zlib (libpng )?licen[sc]e
libpng     libpng licen[sc]e
psf        python software foundation licen[sc]e
psf        psf licen[sc]e
ruby       ruby licen[sc]e
php        php licen[sc]e
ofl        sil open font licen[sc]e
ofl        open font licen[sc]e
odbl       open database licen[sc]e
odc-by     open data commons attribution licen[sc]e
pddl       open data commons public domain dedication and licen[sc]e
ms-pl      microsoft public licen[sc]e
ms-rl      microsoft reciprocal licen[sc]e
postgresql postgresql licen[sc]e
openssl    openssl licen[sc]e
curl       curl licen[sc]e
vim        vim licen[sc]e
ncsa       university of illinois ncsa open source licen[sc]e
ncsa       ncsa open source licen[sc]e
upl        universal permissive licen[sc]e
npl        netscape public licen[sc]e
zpl        zope public licen[sc]e
lppl       latex project public licen[sc]e
json       json licen[sc]e
bsl        business source licen[sc]e
sspl       server side public licen[sc]e
elastic    elastic licen[sc]e
hippocratic hippocratic licen[sc]e
unlicense  unlicense
wtfpl      wtfpl
cc-by-sa   creative commons attribution share ?alike( licen[sc]e)?
cc-by-nc   creative commons attribution non ?commercial( licen[sc]e)?
cc-by-nd   creative commons attribution no ?deriv(ative)?s( licen[sc]e)?
cc-by      creative commons attribution( licen[sc]e)?
cc         creative commons licen[sc]e
cc-by-sa   cc by sa
cc-by-nc   cc by nc( sa| nd)?
cc-by-nd   cc by nd
cc-by      cc by
cc0        cc0
public-domain public domain dedication
public-domain public domain
"""),
    (0.5, """
gpl        gpl( ?v?[123]( 0)?)?
gpl        gplv[123]
lgpl       lgpl( ?v?[23]( [01])?)?
lgpl       lgplv[23]
agpl       agpl( ?v?3( 0)?)?
agpl       agplv3
mpl        mpl [12] [01]
mpl        mplv2
epl        epl [12] 0
eupl       eupl 1 [0-9]
cddl       cddl( 1 [01])?
apache     apache 2 0
apache     asl 2 0
bsd        bsd [0234] clause
ofl        ofl 1 [01]
warranty   software is provided as is without warranty of any kind( express or implied)?
warranty   software is provided as is without any express or implied warranty
warranty   software is provided by the copyright holders and contributors as is
warranty   warranties or conditions of any kind
warranty   merchantability or fitness for a particular purpose
warranty   merchantability fitness for a particular purpose( and noninfringement)?
copyright  copyright (c )?[12][0-9]{3}( [12][0-9]{3})?
copyright  copyright by [a-z]+
copyright  copyrighted material
copyright  rights reserved
"""),
)
#: Places of a phrase's words, counted in every text: (phrase, label).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    rank: int  # order of priority; a lower one suppresses what it contains
    label: str
    keywords: tuple[str, ...]
    pattern: str
    strength: float


def _keywords(pattern: str) -> tuple[str, ...]:
    first = pattern.split(" ")[0].split("(")[0]
    if "gplv" in first or "mplv" in first:
        stem, _, versions = first.partition("[")
        return tuple(stem + v for v in versions.rstrip("]")) or (first,)
    return (first.replace("[sc]", "c"), first.replace("[sc]", "s")) if "[sc]" in first else (first,)


def default_rules() -> tuple[Rule, ...]:
    """All rules, in order of priority."""
    lines = [(line.split(None, 1), strength) for strength, block in SIGNATURES for line in block.strip().split("\n")]
    return tuple(Rule(i, label, _keywords(p.strip()), f"^{p.strip()}(?= |$)", s) for i, ((label, p), s) in enumerate(lines))
