"""Signature rules of the license scan, strongest class first.

Signatures are written by hand from the texts of public licenses, over words (a-z,
0-9, one space between). Besides them, names of licenses are put in a few templates
("licensed under the ...", SPDX identifiers, name and version).
"""

from __future__ import annotations

from functools import cache

#: class -> (priority, confidence); a lower priority number wins.
GRANT, CLAUSE, NOTICE, TITLE, ADDRESS, PHRASE, HINT = (15, 0.97), (17, 0.9), (20, 0.95), (24, 0.9), (30, 0.85), (40, 0.7), (60, 0.4)

#: The phrases of the base and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

SIGNATURES = (
    # MIT and its relatives
    ("mit", GRANT, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", GRANT, "free of charge to any person obtaining a copy of (?:this|the) software"),
    ("mit", CLAUSE, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", CLAUSE, "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", CLAUSE, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit", CLAUSE, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", NOTICE, "(?:released|distributed|licensed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?: expat)? licen[cs]e"),
    ("mit", NOTICE, "use of this source code is governed by an mit style license"),
    ("mit", NOTICE, "subject to the (?:terms of the )?mit license"),
    ("mit", TITLE, "the mit license mit"),
    ("mit", TITLE, "(?:mit )?expat license"),
    ("mit", ADDRESS, "opensource org licenses mit(?: license)?(?: php| html)?"),
    ("mit", PHRASE, "mit licensed"),
    ("mit-0", CLAUSE, "mit no attribution"),
    ("x11", CLAUSE, "except as contained in this notice the names? of .{1,60}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("x11", TITLE, "(?:the )?x11 license"),
    ("mit-advertising", CLAUSE, "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("hpnd", GRANT, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", CLAUSE, "provided that the above copyright notice appears? in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ntp", TITLE, "(?:the )?ntp license"),
    # ISC, 0BSD, zero-clause texts
    ("isc", GRANT, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", GRANT, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", GRANT, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", CLAUSE, "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", NOTICE, "(?:released|distributed|licensed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e"),
    ("0bsd", TITLE, "bsd zero clause(?: license)?"),
    ("0bsd", TITLE, "zero clause bsd(?: license)?"),
    ("0bsd", TITLE, "bsd 0 clause(?: license)?"),
    ("0bsd", TITLE, "0bsd(?: license)?"),
    # BSD
    ("bsd", GRANT, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", CLAUSE, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", CLAUSE, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd", CLAUSE, "this software is provided by the (?:copyright holders and contributors|regents and contributors|author(?: and contributors)?|copyright holders?) as is and any express or implied warranties"),
    ("bsd", CLAUSE, "in no event shall the (?:copyright (?:owner|holders?) or contributors|regents or contributors|authors?(?: or contributors)?) be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause", CLAUSE, "neither the names? of .{1,80}? may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", CLAUSE, "may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission"),
    ("bsd-3-clause", CLAUSE, "the names? of (?:the )?(?:authors?|contributors?|copyright holders?) may not be used to endorse or promote products"),
    ("bsd-4-clause", CLAUSE, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", CLAUSE, "this product includes software developed by the university of california"),
    ("bsd-3-clause-clear", CLAUSE, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", CLAUSE, "bsd (?:2 clause )?plus patent"),
    ("bsd", NOTICE, "use of this source code is governed by a bsd style license"),
    ("bsd", NOTICE, "(?:released|distributed|licensed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? licen[cs]e"),
    ("bsd-2-clause", ADDRESS, "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", ADDRESS, "opensource org licenses bsd 3 clause"),
    ("bsd", ADDRESS, "opensource org licenses bsd license(?: php)?"),
    ("bsd", PHRASE, "bsd licensed"),
    # Apache
    ("apache-2.0", NOTICE, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", CLAUSE, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", CLAUSE, "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", CLAUSE, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", CLAUSE, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", CLAUSE, "contributor shall mean licensor and any individual or legal entity on behalf of whom a contribution has been received"),
    ("apache-2.0", TITLE, "apache license version 2 0 january 2004"),
    ("apache-2.0", CLAUSE, "to apply the apache license to your work attach the following boilerplate notice"),
    ("apache-1.1", CLAUSE, "this product includes software developed by the apache software foundation"),
    ("apache-1.1", TITLE, "the apache software license version 1 1"),
    ("apache-1.0", CLAUSE, "this product includes software developed by the apache group"),
    ("apache", NOTICE, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", ADDRESS, "www apache org licenses(?: license 2 0)?(?: txt| html)?"),
    ("apache-2.0", ADDRESS, "opensource org licenses apache 2 0"),
    ("apache", PHRASE, "apache (?:2 0 )?licensed"),
    # GNU
    ("gpl", NOTICE, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", NOTICE, "is free software you can redistribute it and or modify it under the terms of (?:version [0-9] of )?the gnu general public license"),
    ("lgpl", NOTICE, "you can redistribute it and or modify it under the terms of (?:version [0-9 ]{1,4}of )?the gnu (?:lesser|library) general public license"),
    ("agpl", NOTICE, "you can redistribute it and or modify it under the terms of (?:version [0-9] of )?the gnu affero general public license"),
    ("gpl", CLAUSE, "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", CLAUSE, "distributed in the hope that it will be useful but without any warranty"),
    ("gpl", CLAUSE, "you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|software|package|file)"),
    ("gpl", CLAUSE, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", CLAUSE, "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", CLAUSE, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", CLAUSE, "when we speak of free software we are referring to freedom not price"),
    ("gpl", CLAUSE, "the gnu general public license is intended to guarantee your freedom to share and change"),
    ("gpl", CLAUSE, "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl", CLAUSE, "activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl", CLAUSE, "you may not impose any further restrictions on the recipients exercise of the rights granted herein"),
    ("gpl", CLAUSE, "this general public license does not permit incorporating your program into proprietary programs"),
    ("gpl", CLAUSE, "the hypothetical commands show w and show c should show the appropriate parts of the general public license"),
    ("gpl-2.0-or-later", NOTICE, "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", NOTICE, "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", NOTICE, "either version 2 1 of the license or at your option any later version"),
    ("gpl-2.0", TITLE, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", TITLE, "gnu general public license version 3 29 june 2007"),
    ("lgpl-2.1", TITLE, "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", TITLE, "gnu library general public license version 2 june 1991"),
    ("lgpl-3.0", TITLE, "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", TITLE, "gnu affero general public license version 3 19 november 2007"),
    ("lgpl", CLAUSE, "a work that uses the library in isolation is not a derivative work of the library"),
    ("lgpl", CLAUSE, "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", CLAUSE, "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl", CLAUSE, "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", NOTICE, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", CLAUSE, "with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", CLAUSE, "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("gpl-exception", CLAUSE, "as a special exception (?:the copyright holders? |the authors? |you )?(?:give|gives|may|grants?|to the gnu)"),
    ("classpath-exception", CLAUSE, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", TITLE, "gcc runtime library exception"),
    ("gpl", ADDRESS, "www gnu org licenses(?: (?:gpl|old licenses))?(?: [23] 0)?"),
    ("lgpl", ADDRESS, "www gnu org (?:licenses|copyleft) lgpl"),
    ("agpl", ADDRESS, "www gnu org licenses agpl"),
    ("gpl", ADDRESS, "www fsf org licens(?:ing|es)"),
    ("gpl", PHRASE, "write to the free software foundation inc"),
    ("gpl", PHRASE, "gpl licensed"),
    ("gpl-2.0", PHRASE, "gplv2(?: or later)?"),
    ("gpl-3.0", PHRASE, "gplv3(?: or later)?"),
    ("lgpl-2.0", PHRASE, "lgplv2(?: or later)?"),
    ("lgpl-3.0", PHRASE, "lgplv3(?: or later)?"),
    ("agpl", PHRASE, "agplv3(?: or later)?"),
    # Mozilla, Eclipse, CDDL and other file-level copyleft
    ("mpl-2.0", NOTICE, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", CLAUSE, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", CLAUSE, "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", NOTICE, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", CLAUSE, "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language"),
    ("mpl", CLAUSE, "the initial developer of the original code is"),
    ("mpl", ADDRESS, "(?:www )?mozilla org mpl(?: 2 0)?"),
    ("epl-1.0", CLAUSE, "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl", NOTICE, "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2.0", CLAUSE, "this source code may also be made available under the following secondary licenses"),
    ("epl", ADDRESS, "www eclipse org (?:legal|org documents) epl"),
    ("cpl-1.0", CLAUSE, "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", CLAUSE, "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", NOTICE, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", CLAUSE, "you can obtain a copy of the license at usr src opensolaris license"),
    ("cddl", ADDRESS, "www opensolaris org os licensing"),
    ("eupl", NOTICE, "licensed under the eupl"),
    ("eupl", CLAUSE, "this european union public licence the eupl applies to the work"),
    ("apsl", NOTICE, "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("cecill", NOTICE, "this software is governed by the cecill(?: [bc])? license under french law"),
    ("ms-pl", CLAUSE, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", CLAUSE, "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license"),
    ("osl-3.0", NOTICE, "licensed under the open software license version 3 0"),
    ("afl-3.0", NOTICE, "licensed under the academic free license version 3 0"),
    ("qpl", TITLE, "(?:the )?q public license(?: version 1 0)?"),
    ("sissl", TITLE, "sun industry standards source license"),
    ("rpl", TITLE, "reciprocal public license"),
    ("npl", TITLE, "netscape public license"),
    ("nasa", TITLE, "nasa open source agreement"),
    ("ecl-2.0", TITLE, "educational community license"),
    ("ncsa", CLAUSE, "neither the names of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided as is without warranty of any kind"),
    # permissive singles
    ("zlib", CLAUSE, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", CLAUSE, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", CLAUSE, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", CLAUSE, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", CLAUSE, "this notice may not be removed or altered from any source distribution"),
    ("libpng", CLAUSE, "the contributing authors and group 42 inc disclaim all warranties"),
    ("libpng", TITLE, "png reference library license"),
    ("ijg", CLAUSE, "this software is based in part on the work of the independent jpeg group"),
    ("libtiff", CLAUSE, "the names of sam leffler and silicon graphics may not be used in any advertising or publicity"),
    ("bsl-1.0", GRANT, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", NOTICE, "distributed under the boost software license version 1 0"),
    ("bsl-1.0", ADDRESS, "www boost org license 1 0(?: txt)?"),
    ("curl", CLAUSE, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("openssl", CLAUSE, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", CLAUSE, "this product includes cryptographic software written by eric young"),
    ("php", CLAUSE, "this product includes php software freely available from"),
    ("php", ADDRESS, "www php net license(?: 3 01)?"),
    ("psf-2.0", CLAUSE, "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("psf-2.0", CLAUSE, "psf is making python available to licensee on an as is basis"),
    ("cnri", CLAUSE, "this license agreement is between the corporation for national research initiatives"),
    ("ruby", CLAUSE, "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("ruby", NOTICE, "(?:same|distributed under the) (?:terms|license) as ruby(?: itself)?"),
    ("artistic", NOTICE, "(?:redistribute it and or modify it|distributed) under the same terms as perl(?: itself)?"),
    ("artistic-1.0", CLAUSE, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", CLAUSE, "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("vim", CLAUSE, "there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", CLAUSE, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("postgresql", CLAUSE, "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("unicode", CLAUSE, "obtaining a copy of the unicode data files and any associated documentation"),
    ("unicode", ADDRESS, "www unicode org copyright"),
    ("icu", CLAUSE, "icu license icu 1 8 1 and later"),
    ("w3c", CLAUSE, "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions"),
    ("w3c", TITLE, "w3c software (?:notice and|and document(?: notice and)?) license"),
    ("ofl-1.1", NOTICE, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", CLAUSE, "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl", ADDRESS, "scripts sil org ofl"),
    ("upl-1.0", CLAUSE, "the universal permissive license upl version 1 0"),
    ("unlicense", GRANT, "this is free and unencumbered software released into the public domain"),
    ("unlicense", CLAUSE, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", ADDRESS, "unlicense org"),
    ("wtfpl", CLAUSE, "do what the fuck you want to public license"),
    ("wtfpl", CLAUSE, "you just do what the fuck you want to"),
    ("beerware", CLAUSE, "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", CLAUSE, "the software shall be used for good not evil"),
    ("blessing", CLAUSE, "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("mulan", TITLE, "mulan (?:permissive|public) (?:software )?license"),
    ("blueoak", TITLE, "blue oak model license"),
    ("fair", CLAUSE, "usage of the works is permitted provided that this instrument is retained with the works"),
    ("lppl", NOTICE, "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl", CLAUSE, "this work has the lppl maintenance status"),
    ("freetype", CLAUSE, "portions of this software are copyright .{1,30}? the freetype project"),
    ("bzip2", TITLE, "bzip2 (?:and libbzip2 )?license"),
    ("sleepycat", CLAUSE, "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("elastic-2.0", CLAUSE, "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", CLAUSE, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", CLAUSE, "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", CLAUSE, "the license does not grant to you the right to sell the software"),
    ("polyform", TITLE, "polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) license"),
    # Creative Commons and data licenses
    ("cc-by-4.0", TITLE, "creative commons attribution 4 0 international public license"),
    ("cc-by-sa-4.0", TITLE, "creative commons attribution sharealike 4 0 international public license"),
    ("cc-by-nc-4.0", TITLE, "creative commons attribution noncommercial 4 0 international public license"),
    ("cc-by-nc-sa-4.0", TITLE, "creative commons attribution noncommercial sharealike 4 0 international public license"),
    ("cc-by-nd-4.0", TITLE, "creative commons attribution noderivatives 4 0 international public license"),
    ("cc-by-nc-nd-4.0", TITLE, "creative commons attribution noncommercial noderivatives 4 0 international public license"),
    ("cc-by-sa", NOTICE, "creative commons attribution share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", NOTICE, "creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", NOTICE, "creative commons attribution non ?commercial no ?deriv(?:ative|ativ|s|atives)(?: works)?(?: [0-9] [0-9])?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-nc", NOTICE, "creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by-nd", NOTICE, "creative commons attribution no ?deriv(?:ative|s|atives)(?: works)?(?: [0-9] [0-9])?(?: international| unported)?(?: licen[cs]e)?"),
    ("cc-by", NOTICE, "creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc", PHRASE, "creative commons licen[cs]e"),
    ("cc", CLAUSE, "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", CLAUSE, "the work as defined below is provided under the terms of this creative commons public license"),
    ("cc0", TITLE, "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cc0", CLAUSE, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", CLAUSE, "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc0", ADDRESS, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", ADDRESS, "creativecommons org publicdomain mark 1 0"),
    ("cc-by-sa", ADDRESS, "creativecommons org licenses by sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-sa", ADDRESS, "creativecommons org licenses by nc sa(?: [0-9] [0-9])?"),
    ("cc-by-nc-nd", ADDRESS, "creativecommons org licenses by nc nd(?: [0-9] [0-9])?"),
    ("cc-by-nc", ADDRESS, "creativecommons org licenses by nc(?: [0-9] [0-9])?"),
    ("cc-by-nd", ADDRESS, "creativecommons org licenses by nd(?: [0-9] [0-9])?"),
    ("cc-by", ADDRESS, "creativecommons org licenses by(?: [0-9] [0-9])?"),
    ("odbl", NOTICE, "made available under the open database license"),
    ("odbl", ADDRESS, "opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", NOTICE, "open data commons attribution license"),
    ("odc-by", ADDRESS, "opendatacommons org licenses by(?: 1 0)?"),
    ("pddl", TITLE, "public domain dedication and license pddl"),
    ("pddl", ADDRESS, "opendatacommons org licenses pddl(?: 1 0)?"),
    ("cdla", TITLE, "community data license agreement (?:permissive|sharing)"),
    ("ogl-uk", NOTICE, "contains public sector information licensed under the open government licence"),
    ("ogl-uk", TITLE, "open government licence(?: v[123] 0)?"),
    ("openrail", TITLE, "(?:bigscience |creativeml )?openrail(?: m| s| d)? license"),
    ("llama", TITLE, "llama [234](?: [0-9])? community license agreement"),
    # public domain, proprietary and other notices
    ("public-domain", NOTICE, "(?:released|dedicated|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", PHRASE, "this (?:file|work|code|software|program|text) is (?:hereby )?(?:in|placed in) the public domain"),
    ("public-domain", PHRASE, "work of the united states government"),
    ("proprietary", PHRASE, "this software is proprietary and confidential"),
    ("proprietary", PHRASE, "unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", PHRASE, "no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", PHRASE, "end user license agreement"),
    ("proprietary", PHRASE, "for internal use only not for redistribution"),
    ("proprietary", HINT, "all rights reserved(?: [a-z0-9]+){0,6} licen[cs]e"),
    ("non-commercial", PHRASE, "for (?:personal and )?non ?commercial use only"),
    ("research-only", PHRASE, "for (?:academic|research|non ?profit)(?: [a-z]+){0,3} purposes only"),
    ("dual", HINT, "dual licen[cs]ed(?: under)?"),
    ("triple", HINT, "mpl 1 1 gpl 2 0 lgpl 2 1"),
)

#: Names: label, regex of the name, regex of the identifier, versions.
FAMILIES = (
    ("gpl", "(?:gnu )?gpl", "gpl", ("1", "2", "3")),
    ("gpl", "gnu general public license(?: gpl)?", "gpl", ("1", "2", "3")),
    ("lgpl", "(?:gnu )?lgpl", "lgpl", ("2", "2 1", "3")),
    ("lgpl", "(?:gnu )?lesser general public license(?: lgpl)?", "lgpl", ("2 1", "3")),
    ("agpl", "(?:gnu )?agpl", "agpl", ("1", "3")),
    ("agpl", "(?:gnu )?affero general public license(?: agpl)?", "agpl", ("1", "3")),
    ("gfdl", "gnu free documentation license(?: gfdl)?", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache(?: software)? license", "apache", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla public license(?: mpl)?", "mpl", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public license(?: epl)?", "epl", ("1 0", "2 0")),
    ("cddl", "common development and distribution license(?: cddl)?", "cddl", ("1 0", "1 1")),
    ("cpl", "common public license(?: cpl)?", "cpl", ("1 0",)),
    ("eupl", "european union public licen[cs]e(?: eupl)?", "eupl", ("1 0", "1 1", "1 2")),
    ("artistic", "(?:perl )?artistic license", "artistic", ("1 0", "2 0")),
    ("bsl", "boost software license(?: bsl)?", "bsl", ("1 0",)),
    ("osl", "open software license(?: osl)?", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free license(?: afl)?", "afl", ("1 1", "2 0", "2 1", "3 0")),
    ("ofl", "(?:sil )?open font license(?: ofl)?", "ofl", ("1 0", "1 1")),
    ("psf", "python software foundation license(?: psf)?", "psf", ("2",)),
    ("php", "php license", "php", ("3 0", "3 01")),
    ("zpl", "zope public license(?: zpl)?", "zpl", ("1 1", "2 0", "2 1")),
    ("lppl", "latex project public license(?: lppl)?", "lppl", ("1 0", "1 2", "1 3", "1 3c")),
    ("ms-pl", "microsoft public license(?: ms pl)?", "ms pl", ()),
    ("ms-rl", "microsoft reciprocal license(?: ms rl)?", "ms rl", ()),
    ("odbl", "open database license(?: odbl)?", "odbl", ("1 0",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by nc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by nd", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by sa", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc by", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("mit", "(?:the )?mit license", "mit", ()),
    ("isc", "(?:the )?isc license", "isc", ()),
    ("zlib", "(?:the )?zlib(?: libpng)? license", "zlib", ()),
    ("bsd-2-clause", "bsd 2 clause(?: license)?", "bsd 2 clause", ()),
    ("bsd-3-clause", "bsd 3 clause(?: license)?", "bsd 3 clause", ()),
    ("bsd-4-clause", "bsd 4 clause(?: license)?", "bsd 4 clause", ()),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd license", "bsd 2 clause", ()),
    ("bsd-3-clause", "(?:revised|modified|new|3 clause|three clause) bsd license", "bsd 3 clause", ()),
    ("bsd-4-clause", "(?:original|old|4 clause|four clause) bsd license", "bsd 4 clause", ()),
    ("bsd", "bsd(?: style)? license", "bsd", ()),
    ("unlicense", "(?:the )?unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("1", "2")),
    ("beerware", "beerware license", "beerware", ()),
    ("openssl", "openssl license", "openssl", ()),
    ("postgresql", "postgresql licen[cs]e", "postgresql", ()),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)? license", "ncsa", ()),
    ("upl", "universal permissive license(?: upl)?", "upl", ("1 0",)),
    ("vim", "vim license", "vim", ()),
    ("sspl", "server side public license(?: sspl)?", "sspl", ("1",)),
    ("busl", "business source license(?: busl)?", "busl", ("1 1",)),
)


#: Words that are no help in telling licenses from other texts: a keyword is chosen by the letters of other words.
_COMMON = frozenset("a above all and any as at by copy copyright documentation file files for free from general government group hereby if in including is it law license licensed licenses may no not notice of on open or org other permission product public rights same software source subject terms that the this to under use version web with without work www you your".split())


def _alternatives(group: str) -> list[str]:
    out, depth = [""], 0
    for c in group:
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def _runs(regex: str) -> list[str]:
    """Runs of literal whole words that stand outside of groups, classes and optional characters."""
    runs, now, i = [], "", 0  # "<" and ">" mark where a run may go on in the word beside it
    while i < len(regex):
        c = regex[i]
        if c in "([":
            end, depth = i + 1, 1
            while depth:
                depth += (regex[end] in "([") - (regex[end] in ")]")
                end += 1
            inside = _alternatives(regex[i + 3 : end - 1]) if regex.startswith("(?:", i) else ["x"]
            if c == "(" and len(inside) == 1 and regex[i + 2] == ":" and regex[end : end + 1] not in tuple("?*{"):
                regex = regex[:i] + inside[0] + regex[end:]  # a group that every match has
                continue
            runs.append(now + ("" if all(x.startswith(" ") for x in inside) else ">"))
            now = "" if all(x.endswith(" ") for x in inside) or regex.startswith("(?: ", i) and regex[end : end + 1] == "?" and regex[end + 1 : end + 2] == " " else "<"
            i = end
            if regex[i : i + 1] == "{":
                i = regex.index("}", i) + 1
            i += regex[i : i + 1] in ("?", "*")
        elif c == ".":
            runs.append(now + ">")
            now, i = "<", regex.index("}", i) + 1 + (regex[regex.index("}", i) + 1 :][:1] == "?")
        elif c == "?":
            runs.append(now[:-1] + ">")
            now, i = "<", i + 1
        else:
            now, i = now + c, i + 1
    runs.append(now)
    out = []
    for run in runs:
        if run.endswith(">"):
            run = run[:-1] if run.endswith(" >") else run.rpartition(" ")[0]
        if run.startswith("<"):
            run = run[1:] if run.startswith("< ") else run.partition(" ")[2]
        out.append(run.strip())
    return out


def keyword(regex: str) -> str:
    """Words that every match of ``regex`` holds, one after another; of several such runs the most telling."""
    return max(_runs(regex), key=lambda run: (sum(len(w) for w in run.split() if w not in _COMMON and not w.isdigit()), len(run)))


@cache
def rules() -> tuple[dict, ...]:
    """All rules in order."""
    out: list[dict] = []

    def add(label, kind, regex):
        out.append({"label": label, "keyword": keyword(regex), "regex": f"(?<= )(?:{regex})(?= )", "priority": kind[0], "confidence": kind[1], "rank": len(out)})

    for label, kind, regex in SIGNATURES:
        add(label, kind, regex)
    for ident, label in dict.fromkeys((ident, label) for label, _, ident, _ in FAMILIES):
        add(label, (12, 0.98), f"spdx license identifier {ident}(?: only| or later)?")
        for v in dict.fromkeys(v for _, _, i, versions in FAMILIES if i == ident for v in versions):
            add(label, (10, 0.99), f"spdx license identifier {ident} {v if ' ' in v else v + '(?: 0)?'}(?: only| or later)?")
    for label, name, _, versions in FAMILIES:
        under = f"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:{name})"
        for v in versions:
            dotted = v if " " in v else f"{v}(?: 0)?"
            add(label, (18, 0.96), f"{under}(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?{dotted}(?: or(?: at your option)? any later version)?")
            add(label, (28, 0.85), f"{name}(?: version| v)? v?{dotted}(?: or later)?")
        add(label, (22, 0.93), under)
        add(label, (35, 0.75 if "licen" in name else 0.4), name)
    for phrase, label in BASE:
        add(label, (90, 0.6), phrase)
    return tuple(out)
