"""Signatures of licences, as ordered rules over texts of lower-case words joined by single spaces.

A line is ``label: pattern``; in patterns ``#`` stands for a version, which joins the label, as do the groups ``p``
(elements) and ``later``. Texts spell ``license``. Every pattern starts with literal letters: they are its keyword. Earlier
lines go before later ones of the same tier.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Sentences of the licences' own texts.
TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software (?:\\S+ ){0,40}?without restriction(?: \\S+){0,40}? to whom the software is furnished to do so the software is provided
x11: except as contained in this notice the name of the (?:x consortium|copyright holders?|authors?) shall not be used in advertising
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd: redistribution and use in source and binary forms with or without modification are permitted provided
bsd-2-clause: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause: neither the name of (?:\\S+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0: you may not use this file except in compliance with the license you may obtain a copy of the license
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1: the end user documentation included with the redistribution if any must include the following acknowledge?ment
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either)?(?:#)?(?P<later> of the license or at your option any later version)?
lgpl: this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?:#)?(?P<later> of the license or at your option any later version)?
agpl: this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?(?: either)?(?:#)?(?P<later> of the license or at your option any later version)?
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: you should have received a copy of the gnu general public license
lgpl: you should have received a copy of the gnu (?:lesser|library) general public license
agpl: you should have received a copy of the gnu affero general public license
gpl: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?:#)?
mpl: this source code form is subject to the terms of the mozilla public license(?:#)?
mpl: the contents of this file are subject to the mozilla public license(?:#)?
epl: this program and the accompanying materials are made available under the terms of the eclipse public license(?:#)?
cddl: the contents of this file are subject to the terms of the common development and distribution license(?:#)?
cpl: this program and the accompanying materials are made available under the terms of the common public license(?:#)?
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: altered source versions must be plainly marked as such and must not be misrepresented
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document
wtfpl: you just do what the \\S+ you want to
cc0-1.0: the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0: to the extent possible under law (?:\\S+ ){1,12}?has waived all copyright and related or neighbou?ring rights
cc-by: you are free to share copy and redistribute the material in any medium or format
cc-by: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc: you may not use the material for commercial purposes
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
public-domain: this (?:work|file|software|document|text|code) is (?:in|part of|released into|dedicated to) the public domain
public-domain: the authors? (?:hereby )?disclaims? copyright to this source code
public-domain: no rights reserved
artistic: this package is free software you may redistribute it and or modify it under the same terms as perl
python-2.0: this license agreement is between the python software foundation
openssl: this product includes software developed by the openssl project
ofl-1.1: this font software is licensed under the sil open font license(?:#)?
postgresql: in no event shall the university of california be liable to any party for direct indirect special
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
ncsa: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
odbl: this (?:database|work|dataset) is made available under the open database license(?:#)?
busl-1.1: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic: you may not provide the software to third parties as a hosted or managed service
sspl: if you make the functionality of the program or a modified version available to third parties as a service
commons-clause: the license does not grant to you the right to sell the software
proprietary: unauthorised copying of this (?:file|document|software|material|work) via any medium is strictly prohibited
proprietary: unauthorized copying of this (?:file|document|software|material|work) via any medium is strictly prohibited
proprietary: this (?:software|document|file|material|work) is (?:the )?confidential and proprietary
proprietary: no part of this (?:publication|book|work|document|site) may be reproduced
proprietary: may not be reproduced (?:distributed |transmitted |stored |or ){0,8}without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary: trade secrets? (?:and|or) confidential information of
"""

#: Names of licences. Those without the word itself or a version count only where a form below precedes them; they start with !.
NAMES = """
apache: apache software license#
apache: apache license#
apache: apache#
apache: apache software license
apache: apache license
apache: asl#
mit-0: mit no attribution
mit: mit x11 license
mit: mit x license
mit: mit style license
mit: mit license
mit: expat license
mit: !mit
mit: !expat
bsd-0: zero clause bsd
bsd: bsd (?P<p>[0234]) clause(?: license)?
bsd-2-clause: 2 clause bsd(?: license)?
bsd-3-clause: 3 clause bsd(?: license)?
bsd-4-clause: 4 clause bsd(?: license)?
bsd-2-clause: simplified bsd license
bsd-2-clause: freebsd license
bsd-3-clause: new bsd license
bsd-3-clause: modified bsd license
bsd-3-clause: revised bsd license
bsd-4-clause: original bsd license
bsd-patent: bsd plus patent license
bsd: bsd style license
bsd: bsd license
bsd: !bsd
isc: isc license
isc: !isc
agpl: gnu affero general public license(?:#)?(?P<later>)
agpl: affero general public license(?:#)?(?P<later>)
agpl: gnu agpl(?:#)?(?P<later>)
agpl: agpl#(?P<later>)
agpl: agplv(?P<v>3)(?P<later>)
agpl: agpl license
agpl: !agpl
lgpl: gnu lesser general public license(?:#)?(?P<later>)
lgpl: gnu library general public license(?:#)?(?P<later>)
lgpl: lesser general public license(?:#)?(?P<later>)
lgpl: library general public license(?:#)?(?P<later>)
lgpl: gnu lgpl(?:#)?(?P<later>)
lgpl: lgpl#(?P<later>)
lgpl: lgplv(?P<v>[23](?: 1)?)(?P<later>)
lgpl: lgpl license
lgpl: !lgpl
gpl: gnu general public license(?:#)?(?P<later>)
gpl: general public license(?:#)?(?P<later>)
gpl: gnu gpl(?:#)?(?P<later>)
gpl: gpl#(?P<later>)
gpl: gplv(?P<v>[123])(?P<later>)
gpl: gpl license
gpl: !gpl
gfdl: gnu free documentation license(?:#)?(?P<later>)
gfdl: free documentation license(?:#)?(?P<later>)
gfdl: gfdl#
gfdl: !gfdl
mpl: mozilla public license(?:#)?
mpl: mpl#
mpl: !mpl
npl: netscape public license(?:#)?
epl: eclipse public license(?:#)?
epl: epl#
edl: eclipse distribution license(?:#)?
cpl: common public license(?:#)?
cpal: common public attribution license(?:#)?
cddl: common development and distribution license(?:#)?
cddl: cddl#
ipl: ibm public license(?:#)?
lpl: lucent public license(?:#)?
spl: sun public license(?:#)?
apsl: apple public source license(?:#)?
rpsl: realnetworks public source license(?:#)?
rpl: reciprocal public license(?:#)?
qpl: q public license(?:#)?
osl: open software license(?:#)?
osl: osl#
afl: academic free license(?:#)?
afl: afl#
ecl: educational community license(?:#)?
eupl: european union public license(?:#)?
eupl: eupl#
cecill-b: cecill b(?: license)?
cecill-c: cecill c(?: license)?
cecill: cecill(?: free software)? license(?:#)?
lal: license art libre(?:#)?
lal: free art license(?:#)?
artistic: artistic license(?:#)?
perl: same terms as perl
python: python software foundation license(?:#)?
python: psf license(?:#)?
ruby: ruby license
php: php license(?:#)?
zpl: zope public license(?:#)?
w3c: w3c software (?:and document )?(?:notice and )?license
postgresql: postgresql license
openssl: openssl license
sleepycat: sleepycat license
vim: vim license
tcl: tcl tk license
curl: curl license
icu: icu license
libpng: libpng license(?:#)?
zlib: zlib libpng license
zlib: zlib license
zlib: !zlib
ftl: freetype license
ijg: independent jpeg group license
imagemagick: imagemagick license
bsl: boost software license(?:#)?
bsl: boost license
unlicense: unlicense
wtfpl: wtfpl
beerware: beerware license
beerware: beer ware license
json: json license
upl: universal permissive license(?:#)?
blueoak: blue oak model license(?:#)?
mulanpsl: mulan permissive software license(?:#)?
mulanpsl: mulan psl(?:#)?
ncsa: university of illinois ncsa open source license
ncsa: ncsa open source license
naist: naist license
nosa: nasa open source agreement(?:#)?
hpnd: historical permission notice and disclaimer
ms-pl: microsoft public license
ms-rl: microsoft reciprocal license
watcom: sybase open watcom public license(?:#)?
ofl: sil open font license(?:#)?
ofl: open font license(?:#)?
ofl: ofl#
ubuntu-font: ubuntu font license(?:#)?
bitstream-vera: bitstream vera license
lppl: latex project public license(?:#)?
odbl: open database license(?:#)?
odbl: odbl(?:#)?
odc-by: open data commons attribution license(?:#)?
pddl: public domain dedication and license(?:#)?
cdla-permissive: community data license agreement permissive(?:#)?
cdla-sharing: community data license agreement sharing(?:#)?
ogl: open government license(?:#)?
dl-de-by: datenlizenz deutschland namensnennung(?:#)?
etalab: license ouverte(?:#)?
etalab: open license etalab(?:#)?
ogl-canada: open government license canada(?:#)?
cc0: cc0#
cc0: cc0
cc0: cc zero
cc0: creative commons zero(?:#)?
cc: cc by (?P<p>nc sa|nc nd|nc|sa|nd)(?:#)?
cc-by: cc by#
cc-by: cc by
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike(?:#)?
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?:#)?
cc-by-nc: creative commons attribution non ?commercial(?:#)?
cc-by-sa: creative commons attribution share ?alike(?:#)?
cc-by-nd: creative commons attribution no ?deriv(?:s|atives|ative works)(?:#)?
cc-by: creative commons attribution(?:#)?
cc: creative commons public license
cc: creative commons license
cc-sampling: creative commons sampling plus(?:#)?
public-domain-mark: public domain mark(?:#)?
public-domain: !public domain
sspl: server side public license(?:#)?
sspl: sspl(?:#)?
busl: business source license(?:#)?
busl: busl(?:#)?
elastic: elastic license(?:#)?
polyform-noncommercial: polyform noncommercial license(?:#)?
polyform-small-business: polyform small business license(?:#)?
polyform-shield: polyform shield license(?:#)?
commons-clause: commons clause(?: license)?(?: condition)?
confluent: confluent community license(?:#)?
timescale: timescale license
redis: redis source available license(?:#)?
parity: parity public license(?:#)?
prosperity: prosperity public license(?:#)?
hippocratic: hippocratic license(?:#)?
openrail: creativeml open ?rail(?: [ms])?(?: license)?
openrail: bigscience open ?rail(?: [ms])?(?: license)?
openrail: open ?rail(?: [ms])? license
llama: llama [0-9](?: [0-9])? community license(?: agreement)?
gemma: gemma terms of use
ai2-impact: ai2 impact license
rail: responsible ai license
proprietary: proprietary license
proprietary: commercial license
proprietary: !proprietary
eula: end user license agreement
"""

#: Addresses of licences.
URLS = """
apache: apache org licenses license (?P<v>[12] [01])
mit: opensource org licenses mit
mit: mit license org
bsd: opensource org licenses bsd (?P<p>[23] clause|license)
isc: opensource org licenses isc
gpl: opensource org licenses gpl (?P<v>[23] 0)
lgpl: opensource org licenses lgpl (?P<v>[23] [01])
gpl: gnu org licenses (?:old licenses )?gpl(?: (?P<v>[123] 0))?
lgpl: gnu org licenses (?:old licenses )?lgpl(?: (?P<v>[23] [01]))?
agpl: gnu org licenses agpl(?: (?P<v>3 0))?
gfdl: gnu org licenses (?:old licenses )?fdl(?: (?P<v>1 [123]))?
mpl: mozilla org (?:en us )?mpl(?: (?P<v>[12] [01]))?
epl: eclipse org legal epl (?:v(?P<v>[12])0|(?P<w>[12] 0))
boost: boost org license 1 0
unlicense: unlicense org
wtfpl: wtfpl net
cc0: creativecommons org publicdomain zero (?P<v>1 0)
public-domain-mark: creativecommons org publicdomain mark (?P<v>1 0)
cc: creativecommons org licenses (?P<p>by(?: nc)?(?: sa| nd)?) (?P<v>[1234] [05])
odbl: opendatacommons org licenses odbl(?: (?P<v>1 0))?
odc-by: opendatacommons org licenses by(?: (?P<v>1 0))?
pddl: opendatacommons org licenses pddl(?: (?P<v>1 0))?
ofl: scripts sil org ofl
artistic: perlfoundation org artistic license(?: (?P<v>[12] 0))?
python: python org psf license
ogl: nationalarchives gov uk doc open government license(?: version (?P<v>[123]))?
eupl: joinup ec europa eu collection eupl
spdx: spdx org licenses
"""

#: What says that a name follows: form, weight, pattern.
FORMS = """
tag 0.95: spdx license identifier
notice 0.9: licensed under
notice 0.9: licensed to you under
notice 0.9: released under
notice 0.9: distributed under
notice 0.9: published under
notice 0.9: available under
notice 0.9: provided under
notice 0.9: redistributed under
notice 0.9: redistribute it under
notice 0.9: copied under
notice 0.9: used under
notice 0.9: shared under
notice 0.9: dual licensed under
notice 0.9: subject to
notice 0.9: under the terms of
notice 0.9: governed by
notice 0.9: in accordance with
notice 0.9: under
notice 0.9: released into
notice 0.9: dedicated to
header 0.8: license osi approved
header 0.8: license is
header 0.8: license type
header 0.8: license
header 0.8: licenses
header 0.8: licensed as
header 0.8: licensing
"""
_FILLER = r"(?: (?:the|terms|of|and|conditions|a|an|either|version|this|following|to|under|by)){0,12}"
_LATER = r"(?P<later> (?:only|or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?|and later|plus))?"
_VERSION = r"(?: version| versions| v)? v?(?P<v>[0-9]{1,2}(?: [0-9](?![0-9]))?)"

#: Tiers: a detection inside one of an earlier tier is none.
TIERS = ("text", "tag", "notice", "url", "header", "name")
WEIGHTS = {"text": 0.95, "url": 0.85, "name": 0.6, "base": 0.5}


@dataclass(frozen=True)
class Rule:
    """``label`` is None for a form, which a name must follow."""

    order: int
    tier: str
    label: str | None
    keyword: str
    pattern: re.Pattern
    weight: float


def label_of(label: str, found: re.Match) -> str:
    """The rule's label with the elements, the version and ``or-later`` that it found."""
    groups = found.groupdict()
    parts, version, later = groups.get("p"), groups.get("v") or groups.get("w"), groups.get("later")
    if parts:
        by = "by-" if label == "cc" and not parts.startswith("by") else ""
        label += f"-{by}{parts.replace(' ', '-')}" + ("-clause" if parts.isdigit() else "")
    if version:
        label += "-" + (version.replace(" ", ".") if " " in version else f"{version}.0")
    return label + "-or-later" * bool(later and later != " only")


def _lines(table: str) -> list[tuple[str, str]]:
    return [tuple(line.split(": ", 1)) for line in table.strip().split("\n")]


def _keyword(pattern: str) -> str:
    """The literal letters that a pattern starts with, without one that is optional."""
    literal = re.match(r"[a-z0-9 ]*", pattern)[0]
    return literal[:-1] if pattern[len(literal) :].startswith(("?", "*", "{")) else literal


def _expression(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("#", _VERSION).replace("(?P<later>)", _LATER) + r"(?= |\Z)")


def rules() -> tuple[list[Rule], list[Rule]]:
    """(rules that stand alone or are forms, names behind forms), each in order."""
    alone, names = [], []
    for tier, table in (("text", TEXTS), ("url", URLS)):
        alone += [Rule(len(alone) + i, tier, label, _keyword(p), _expression(p), WEIGHTS[tier]) for i, (label, p) in enumerate(_lines(table))]
    for head, pattern in _lines(FORMS):
        tier, weight = head.split(" ")
        alone.append(Rule(len(alone), tier, None, _keyword(pattern), re.compile(pattern + _FILLER + " "), float(weight)))
    for label, pattern in _lines(NAMES):
        rule = Rule(len(alone), "name", label, _keyword(pattern.lstrip("!")), _expression(pattern.lstrip("!")), WEIGHTS["name"])
        names.append(rule)
        alone += [rule] * (not pattern.startswith("!"))
    return alone, names
