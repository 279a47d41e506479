"""Signature rules of licenses, in order: (label, keyword, strength, expression).

An expression is matched against the normalised words of a text, between word boundaries. Its keyword is a part of every
match, chosen to be rare outside of that license, so that few rules run on a text that names none. Strength is the
priority: texts of a license above its notices, notices above names.
"""

from __future__ import annotations

RULES: list[tuple[str, str, int, str]] = [
    # MIT and its kin
    ("mit", "mit licen", 60, r"mit licen[cs]e"),
    ("mit", "under mit", 70, r"(?:released|licensed|distributed|available|provided|published) under mit(?: licen[cs]e)?"),
    ("mit", "under the mit", 75, r"(?:released|licensed|distributed|available|provided|published) under the mit(?: licen[cs]e)?"),
    ("mit", "expat licen", 65, r"expat licen[cs]e"),
    ("mit", "identifier mit", 100, r"spdx license identifier mit"),
    ("mit", "opensource org licenses mit", 90, r"opensource org licenses mit(?: license(?: php)?)?"),
    ("mit", "any person obtaining a copy", 95, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?"),
    ("mit", "to whom the software is furnished", 90, r"permit persons to whom the software is furnished to do so"),
    ("mit", "copies or substantial portions", 88, r"(?:this|the above copyright notice and this) permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "as is without warranty of any kind", 55, r"the software is provided as is without warranty of any kind express or implied"),
    ("mit-0", "mit no attribution", 85, r"mit no attribution(?: licen[cs]e)?"),
    ("mit-0", "identifier mit 0", 101, r"spdx license identifier mit 0"),
    ("x11", "x11 licen", 65, r"x11 licen[cs]e"),
    ("x11", "x consortium shall not", 92, r"the name of the x consortium shall not be used in advertising"),
    ("mit-modern", "modern variant", 70, r"mit licen[cs]e modern variant"),
    ("json", "good not evil", 98, r"the software shall be used for good not evil"),
    ("json", "json licen", 70, r"json licen[cs]e"),
    # Apache
    ("apache", "apache licen", 58, r"apache licen[cs]e"),
    ("apache", "apache software licen", 60, r"apache software licen[cs]e"),
    ("apache-2.0", "apache license version 2", 85, r"(?:licensed under )?(?:the )?apache license version 2(?: 0)?(?: the license)?"),
    ("apache-2.0", "apache license 2", 84, r"(?:licensed under )?(?:the )?apache license 2(?: 0)?"),
    ("apache-2.0", "apache 2", 72, r"apache 2(?: 0)? licen[cs]e"),
    ("apache-2.0", "asl 2", 68, r"asl 2(?: 0)?"),
    ("apache-2.0", "except in compliance with the license", 95, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache org licenses license 2", 98, r"apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "identifier apache 2", 100, r"spdx license identifier apache 2 0"),
    ("apache-2.0", "express or implied see the license", 80, r"without warranties or conditions of any kind either express or implied see the license"),
    ("apache-2.0", "grant of patent license", 82, r"grant of patent license subject to the terms and conditions of this license"),
    ("apache-1.1", "apache license version 1 1", 86, r"apache license version 1 1"),
    ("apache-1.1", "apache software license version 1 1", 87, r"apache software license version 1 1"),
    ("apache-1.1", "identifier apache 1 1", 100, r"spdx license identifier apache 1 1"),
    ("apache-1.1", "developed by the apache software foundation", 90, r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "developed by the apache group", 91, r"this product includes software developed by the apache group"),
    # GPL
    ("gpl", "general public licen", 55, r"(?:gnu )?general public licen[cs]e"),
    ("gpl", "gnu gpl", 60, r"gnu gpl"),
    ("gpl", "under the gpl", 70, r"(?:released|licensed|distributed|available|provided|published) under the gpl"),
    ("gpl", "this program is free software", 90, r"this program is free software you can redistribute it and or modify(?: it)?"),
    ("gpl", "fitness for a particular purpose see the gnu general", 85, r"merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "gnu org licenses gpl", 95, r"gnu org licenses gpl(?: html| txt)?"),
    ("gpl", "gnu org copyleft gpl", 95, r"gnu org copyleft gpl(?: html)?"),
    ("gpl-1.0", "general public license version 1", 84, r"(?:gnu )?general public license version 1(?: 0)?"),
    ("gpl-1.0", "identifier gpl 1", 100, r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl v2", 75, r"(?:gnu )?gpl v2(?: 0)?"),
    ("gpl-2.0", "gplv2", 75, r"(?:gnu )?gplv2"),
    ("gpl-2.0", "gpl 2", 74, r"(?:gnu )?gpl 2(?: 0)?"),
    ("gpl-2.0", "general public license v2", 80, r"(?:gnu )?general public license v2(?: 0)?"),
    ("gpl-2.0", "general public license version 2", 84, r"(?:gnu )?general public license version 2(?: 0)?(?: june 1991)?"),
    ("gpl-2.0", "either version 2 of the license", 92, r"either version 2 of the license or at your option any later version"),
    ("gpl-2.0", "identifier gpl 2", 100, r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-2.0", "gpl 2 0 html", 96, r"gnu org licenses (?:old licenses )?gpl 2 0 html"),
    ("gpl-2.0-classpath", "classpath exception", 93, r"(?:with )?(?:the )?(?:gnu )?classpath exception"),
    ("gpl-2.0-classpath", "linking this library statically or dynamically", 94, r"linking this library statically or dynamically with other modules"),
    ("gpl-3.0", "gpl v3", 75, r"(?:gnu )?gpl v3(?: 0)?"),
    ("gpl-3.0", "gplv3", 75, r"(?:gnu )?gplv3"),
    ("gpl-3.0", "gpl 3", 74, r"(?:gnu )?gpl 3(?: 0)?"),
    ("gpl-3.0", "general public license v3", 80, r"(?:gnu )?general public license v3(?: 0)?"),
    ("gpl-3.0", "general public license version 3", 84, r"(?:gnu )?general public license version 3(?: 0)?(?: 29 june 2007)?"),
    ("gpl-3.0", "either version 3 of the license", 92, r"either version 3 of the license or at your option any later version"),
    ("gpl-3.0", "identifier gpl 3", 100, r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("gpl-3.0", "gpl 3 0 html", 96, r"gnu org licenses gpl 3 0 html"),
    ("gpl-gcc-exception", "gcc runtime library exception", 93, r"gcc runtime library exception(?: version 3 1)?"),
    ("gpl-bison-exception", "bison parser", 70, r"part or all of the bison parser skeleton"),
    ("gpl-linking-exception", "linking exception", 72, r"(?:with (?:a )?)?(?:gpl )?linking exception"),
    # LGPL and AGPL
    ("lgpl", "lesser general public licen", 62, r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", "library general public licen", 62, r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl", "lgpl", 58, r"(?:gnu )?lgpl"),
    ("lgpl", "this library is free software", 91, r"this library is free software you can redistribute it and or modify(?: it)?"),
    ("lgpl", "gnu org licenses lgpl", 95, r"gnu org licenses lgpl(?: html| txt)?"),
    ("lgpl-2.0", "library general public license version 2", 86, r"(?:gnu )?library general public license version 2(?: 0)?"),
    ("lgpl-2.0", "identifier lgpl 2 0", 100, r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general public license version 2 1", 87, r"(?:gnu )?lesser general public license version 2 1"),
    ("lgpl-2.1", "lgpl 2 1", 76, r"(?:gnu )?lgpl 2 1"),
    ("lgpl-2.1", "lgpl v2 1", 76, r"(?:gnu )?lgpl v2 1"),
    ("lgpl-2.1", "lgplv2 1", 76, r"(?:gnu )?lgplv2 1"),
    ("lgpl-2.1", "either version 2 1 of the license", 93, r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-2.1", "identifier lgpl 2 1", 100, r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general public license version 3", 87, r"(?:gnu )?lesser general public license version 3(?: 0)?"),
    ("lgpl-3.0", "lgpl 3", 76, r"(?:gnu )?lgpl 3(?: 0)?"),
    ("lgpl-3.0", "lgpl v3", 76, r"(?:gnu )?lgpl v3(?: 0)?"),
    ("lgpl-3.0", "lgplv3", 76, r"(?:gnu )?lgplv3"),
    ("lgpl-3.0", "identifier lgpl 3", 100, r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl", "affero general public licen", 63, r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", 58, r"(?:gnu )?agpl"),
    ("agpl-1.0", "affero general public license version 1", 86, r"(?:gnu )?affero general public license version 1(?: 0)?"),
    ("agpl-3.0", "affero general public license version 3", 88, r"(?:gnu )?affero general public license version 3(?: 0)?"),
    ("agpl-3.0", "agpl 3", 77, r"(?:gnu )?agpl 3(?: 0)?"),
    ("agpl-3.0", "agplv3", 77, r"(?:gnu )?agplv3"),
    ("agpl-3.0", "agpl v3", 77, r"(?:gnu )?agpl v3"),
    ("agpl-3.0", "identifier agpl 3", 100, r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "interacting with it remotely", 90, r"all users interacting with it remotely through a computer network"),
    ("gfdl", "free documentation licen", 80, r"(?:gnu )?free documentation licen[cs]e"),
    ("gfdl", "no invariant sections", 92, r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "identifier gfdl", 100, r"spdx license identifier gfdl 1 \d(?: only| or later)?"),
    # BSD
    ("bsd", "bsd licen", 58, r"bsd licen[cs]e"),
    ("bsd", "bsd style licen", 62, r"(?:a )?bsd style licen[cs]e"),
    ("bsd", "berkeley software distribution", 56, r"berkeley software distribution(?: licen[cs]e)?"),
    ("bsd", "use in source and binary forms", 90, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "must retain the above copyright notice", 82, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "must reproduce the above copyright notice", 82, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-0-clause", "zero clause bsd", 86, r"zero clause bsd(?: licen[cs]e)?"),
    ("bsd-0-clause", "identifier 0bsd", 100, r"spdx license identifier 0bsd"),
    ("bsd-1-clause", "bsd 1 clause", 80, r"bsd 1 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd 2 clause", 82, r"bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "2 clause bsd", 82, r"2 clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "two clause bsd", 82, r"two clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "simplified bsd", 80, r"simplified bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "freebsd licen", 78, r"freebsd licen[cs]e"),
    ("bsd-2-clause", "identifier bsd 2", 100, r"spdx license identifier bsd 2 clause"),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent", 90, r"bsd 2 clause plus patent(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd 3 clause", 82, r"bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "3 clause bsd", 82, r"3 clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "three clause bsd", 82, r"three clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "new bsd", 78, r"new bsd licen[cs]e"),
    ("bsd-3-clause", "revised bsd", 78, r"revised bsd licen[cs]e"),
    ("bsd-3-clause", "modified bsd", 78, r"modified bsd licen[cs]e"),
    ("bsd-3-clause", "identifier bsd 3", 100, r"spdx license identifier bsd 3 clause"),
    ("bsd-3-clause", "nor the names of its contributors", 93, r"neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("bsd-3-clause-clear", "clear bsd", 84, r"clear bsd licen[cs]e"),
    ("bsd-3-clause-lbnl", "lawrence berkeley national laboratory", 72, r"lawrence berkeley national laboratory bsd(?: variant)? licen[cs]e"),
    ("bsd-4-clause", "bsd 4 clause", 82, r"bsd 4 clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "four clause bsd", 82, r"four clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "original bsd", 80, r"original bsd licen[cs]e"),
    ("bsd-4-clause", "identifier bsd 4", 100, r"spdx license identifier bsd 4 clause"),
    ("bsd-4-clause", "all advertising materials", 94, r"all advertising materials mentioning features or use of this software"),
    ("bsd-protection", "bsd protection", 84, r"bsd protection licen[cs]e"),
    # weak copyleft
    ("mpl", "mozilla public licen", 62, r"mozilla public licen[cs]e"),
    ("mpl-1.0", "mozilla public license version 1 0", 86, r"mozilla public license version 1 0"),
    ("mpl-1.1", "mozilla public license version 1 1", 86, r"mozilla public license version 1 1"),
    ("mpl-1.1", "mpl 1 1", 76, r"mpl 1 1"),
    ("mpl-1.1", "identifier mpl 1 1", 100, r"spdx license identifier mpl 1 1"),
    ("mpl-2.0", "mozilla public license version 2", 86, r"mozilla public license version 2 0"),
    ("mpl-2.0", "mozilla public license v 2", 87, r"mozilla public license v 2 0"),
    ("mpl-2.0", "mpl 2", 76, r"mpl 2 0"),
    ("mpl-2.0", "identifier mpl 2", 100, r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("mpl-2.0", "mozilla org mpl 2", 96, r"mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla org en us mpl", 96, r"mozilla org en us mpl 2 0"),
    ("epl", "eclipse public licen", 62, r"eclipse public licen[cs]e"),
    ("epl-1.0", "eclipse public license version 1", 86, r"eclipse public license version 1 0"),
    ("epl-1.0", "eclipse public license v1", 86, r"eclipse public license v1 0"),
    ("epl-1.0", "identifier epl 1", 100, r"spdx license identifier epl 1 0"),
    ("epl-1.0", "eclipse org legal epl v10", 96, r"eclipse org legal epl v10 html"),
    ("epl-2.0", "eclipse public license version 2", 86, r"eclipse public license version 2 0"),
    ("epl-2.0", "eclipse public license 2", 86, r"eclipse public license 2 0"),
    ("epl-2.0", "eclipse org legal epl 2", 96, r"eclipse org legal epl 2 0"),
    ("epl-2.0", "identifier epl 2", 100, r"spdx license identifier epl 2 0"),
    ("edl-1.0", "eclipse distribution licen", 84, r"eclipse distribution licen[cs]e(?: v(?:ersion )?1 0)?"),
    ("cpl-1.0", "common public licen", 82, r"common public licen[cs]e(?: version)?(?: 1 0)?"),
    ("ipl-1.0", "ibm public licen", 82, r"ibm public licen[cs]e(?: version)?(?: 1 0)?"),
    ("cddl", "common development and distribution licen", 64, r"common development and distribution licen[cs]e"),
    ("cddl-1.0", "distribution license version 1 0", 86, r"common development and distribution license version 1 0"),
    ("cddl-1.0", "identifier cddl 1 0", 100, r"spdx license identifier cddl 1 0"),
    ("cddl-1.1", "distribution license version 1 1", 86, r"common development and distribution license version 1 1"),
    ("cddl-1.1", "identifier cddl 1 1", 100, r"spdx license identifier cddl 1 1"),
    ("cpal-1.0", "common public attribution licen", 84, r"common public attribution licen[cs]e(?: version)?(?: 1 0)?"),
    ("eupl", "european union public licen", 64, r"european union public licen[cs]e"),
    ("eupl-1.1", "eupl 1 1", 78, r"eupl 1 1"),
    ("eupl-1.1", "eupl v 1 1", 78, r"eupl v 1 1"),
    ("eupl-1.2", "eupl 1 2", 78, r"eupl 1 2"),
    ("eupl-1.2", "identifier eupl 1 2", 100, r"spdx license identifier eupl 1 2"),
    ("osl-3.0", "open software licen", 80, r"open software licen[cs]e(?: v(?:ersion)?)?(?: 3 0)?"),
    ("afl-3.0", "academic free licen", 80, r"academic free licen[cs]e(?: v(?:ersion)?)?(?: 3 0)?"),
    ("artistic", "artistic licen", 62, r"(?:perl )?artistic licen[cs]e"),
    ("artistic-1.0", "artistic license 1", 84, r"artistic license 1 0(?: perl)?"),
    ("artistic-2.0", "artistic license 2", 84, r"artistic license 2 0"),
    ("artistic-2.0", "identifier artistic 2", 100, r"spdx license identifier artistic 2 0"),
    ("perl", "same terms as perl", 88, r"(?:under )?the same terms as perl(?: itself)?"),
    ("qpl-1.0", "q public licen", 84, r"q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("apsl-2.0", "apple public source licen", 84, r"apple public source licen[cs]e(?: version)?(?: 2 0)?"),
    ("nokia", "nokia open source licen", 84, r"nokia open source licen[cs]e"),
    ("sunpl", "sun public licen", 84, r"sun public licen[cs]e"),
    ("npl-1.1", "netscape public licen", 84, r"netscape public licen[cs]e(?: version)?(?: 1 [01])?"),
    ("rpl-1.5", "reciprocal public licen", 84, r"reciprocal public licen[cs]e(?: 1 \d)?"),
    ("sissl", "sun industry standards source licen", 86, r"sun industry standards source licen[cs]e"),
    ("ms-pl", "microsoft public licen", 84, r"microsoft public licen[cs]e"),
    ("ms-pl", "identifier ms pl", 100, r"spdx license identifier ms pl"),
    ("ms-rl", "microsoft reciprocal licen", 84, r"microsoft reciprocal licen[cs]e"),
    ("cecill", "cecill", 72, r"cecill(?: (?:b|c|2 0|2 1))?(?: free software)?(?: licen[cs]e)?"),
    ("mulan-psl-2.0", "mulan psl", 84, r"mulan psl(?: v2)?"),
    ("lppl", "latex project public licen", 86, r"latex project public licen[cs]e"),
    # permissive, by their own names
    ("isc", "isc licen", 64, r"isc licen[cs]e"),
    ("isc", "internet systems consortium", 50, r"internet systems consortium licen[cs]e"),
    ("isc", "identifier isc", 100, r"spdx license identifier isc"),
    ("isc", "to use copy modify and or distribute this software", 94, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims all warranties with regard", 70, r"the author disclaims all warranties with regard to this software"),
    ("zlib", "zlib licen", 70, r"zlib licen[cs]e"),
    ("zlib", "zlib libpng licen", 72, r"zlib libpng licen[cs]e"),
    ("zlib", "plainly marked as such", 94, r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not be misrepresented", 94, r"the origin of this software must not be misrepresented"),
    ("zlib", "identifier zlib", 100, r"spdx license identifier zlib"),
    ("libpng", "png reference library", 70, r"png reference library licen[cs]e"),
    ("boost", "boost software licen", 82, r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("boost", "boost org license 1 0", 96, r"boost org license 1 0(?: txt)?"),
    ("boost", "identifier bsl 1", 100, r"spdx license identifier bsl 1 0"),
    ("ncsa", "illinois ncsa", 84, r"university of illinois ncsa open source licen[cs]e"),
    ("ncsa", "identifier ncsa", 100, r"spdx license identifier ncsa"),
    ("python", "python software foundation licen", 84, r"python software foundation licen[cs]e(?: version 2)?"),
    ("python", "psf licen", 74, r"psf licen[cs]e(?: agreement)?"),
    ("python", "identifier psf", 100, r"spdx license identifier psf 2 0"),
    ("postgresql", "postgresql licen", 80, r"postgresql licen[cs]e"),
    ("postgresql", "identifier postgresql", 100, r"spdx license identifier postgresql"),
    ("openssl", "openssl licen", 80, r"openssl licen[cs]e"),
    ("openssl", "for use in the openssl toolkit", 94, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", 80, r"this product includes cryptographic software written by eric young"),
    ("php-3.01", "php licen", 78, r"php licen[cs]e(?: version)?(?: 3 01)?"),
    ("ruby", "ruby licen", 74, r"ruby licen[cs]e"),
    ("ruby", "same terms as ruby", 86, r"(?:under )?the same terms as ruby(?: itself)?"),
    ("w3c", "w3c software", 76, r"w3c software(?: and document)?(?: notice and)? licen[cs]e"),
    ("icu", "icu licen", 74, r"icu licen[cs]e(?: icu 1 8 1 and later)?"),
    ("unicode", "unicode licen", 74, r"unicode licen[cs]e(?: agreement| v3)?"),
    ("curl", "identifier curl", 100, r"spdx license identifier curl"),
    ("ntp", "ntp licen", 74, r"ntp licen[cs]e"),
    ("hpnd", "historical permission notice and disclaimer", 88, r"historical permission notice and disclaimer"),
    ("vim", "vim licen", 74, r"vim licen[cs]e"),
    ("tcl", "tcl tk licen", 78, r"tcl tk licen[cs]e"),
    ("freetype", "freetype project licen", 84, r"freetype project licen[cs]e"),
    ("ijg", "independent jpeg group", 76, r"based in part on the work of the independent jpeg group"),
    ("bzip2", "bzip2 licen", 76, r"bzip2 licen[cs]e"),
    ("upl-1.0", "universal permissive licen", 86, r"universal permissive licen[cs]e(?: v(?:ersion)?)?(?: 1 0)?"),
    ("naist", "naist", 60, r"naist(?: 2003)? licen[cs]e"),
    ("blueoak-1.0.0", "blue oak model licen", 88, r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("fair", "usage of the works is permitted", 88, r"usage of the works is permitted provided that this instrument is retained"),
    ("beerware", "beer ware licen", 84, r"beer ware licen[cs]e"),
    ("beerware", "buy me a beer", 80, r"you can buy me a beer in return"),
    ("wtfpl", "wtfpl", 82, r"wtfpl(?: version 2| licen[cs]e)?"),
    ("wtfpl", "what the fuck you want to", 94, r"do what the fuck you want to(?: public licen[cs]e)?"),
    # public domain
    ("unlicense", "the unlicense", 82, r"the unlicense"),
    ("unlicense", "free and unencumbered software", 95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "identifier unlicense", 100, r"spdx license identifier unlicense"),
    ("public-domain", "into the public domain", 72, r"(?:released|placed|dedicated|put) into the public domain"),
    ("public-domain", "in the public domain", 68, r"(?:is|are|placed|released) in the public domain"),
    ("public-domain", "to the public domain", 70, r"(?:dedicated|released) to the public domain"),
    ("cc0-1.0", "cc0", 74, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", 84, r"creative commons zero(?: v1 0)?(?: universal)?"),
    ("cc0-1.0", "publicdomain zero", 97, r"creativecommons org publicdomain zero 1 0"),
    ("pddl", "public domain dedication and licen", 86, r"(?:open data commons )?public domain dedication and licen[cs]e"),
    # content and data
    ("cc-by", "creative commons attribution", 66, r"creative commons attribution(?: licen[cs]e)?"),
    ("cc-by", "org licenses by ", 97, r"creativecommons org licenses by (?:\d \d)?"),
    ("cc-by", "identifier cc by", 99, r"spdx license identifier cc by(?: \d \d)?"),
    ("cc-by-3.0", "attribution 3 0", 82, r"creative commons attribution 3 0(?: unported| licen[cs]e)*"),
    ("cc-by-4.0", "attribution 4 0", 82, r"creative commons attribution 4 0(?: international| licen[cs]e)*"),
    ("cc-by-4.0", "licenses by 4 0", 98, r"creativecommons org licenses by 4 0"),
    ("cc-by-sa", "attribution sharealike", 84, r"creative commons attribution sharealike(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-sa", "attribution share alike", 84, r"creative commons attribution share alike(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-sa", "licenses by sa", 99, r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by-sa", "under cc by sa", 88, r"(?:licensed|released|available|published) under cc by sa(?: \d \d)?"),
    ("cc-by-nc", "attribution noncommercial", 84, r"creative commons attribution noncommercial(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-nc", "attribution non commercial", 84, r"creative commons attribution non commercial(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-nc", "licenses by nc", 99, r"creativecommons org licenses by nc(?: \d \d)?"),
    ("cc-by-nc", "under cc by nc", 87, r"(?:licensed|released|available|published) under cc by nc(?: \d \d)?"),
    ("cc-by-nd", "attribution noderiv", 84, r"creative commons attribution noderiv(?:s|atives)(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-nd", "licenses by nd", 99, r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-nc-sa", "noncommercial sharealike", 88, r"creative commons attribution noncommercial sharealike(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-nc-sa", "licenses by nc sa", 100, r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc-nd", "noncommercial noderiv", 88, r"creative commons attribution noncommercial noderiv(?:s|atives)(?: \d \d)?(?: international| unported| licen[cs]e)*"),
    ("cc-by-nc-nd", "licenses by nc nd", 100, r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc-by", "under cc by", 86, r"(?:licensed|released|available|published) under cc by(?: \d \d)?"),
    ("cc", "creative commons licen", 56, r"(?:a )?creative commons licen[cs]e"),
    ("odbl", "open database licen", 84, r"(?:open data commons )?open database licen[cs]e"),
    ("odbl", "under the odbl", 82, r"(?:licensed|released|available|published|made available) under the odbl"),
    ("odc-by", "open data commons attribution", 84, r"open data commons attribution licen[cs]e"),
    ("ofl", "sil open font licen", 86, r"sil open font licen[cs]e(?: version)?(?: 1 1)?"),
    ("ofl", "identifier ofl", 100, r"spdx license identifier ofl 1 [01]"),
    ("ofl", "reserved font name", 84, r"with reserved font name"),
    ("ogl-uk", "open government licen", 84, r"open government licen[cs]e(?: v[123] 0)?"),
    ("free-art", "free art licen", 84, r"free art licen[cs]e(?: 1 3)?"),
    ("bigscience-rail", "rail licen", 74, r"(?:bigscience |open ?)?rail licen[cs]e"),
    # source available and proprietary
    ("bsl-1.1", "business source licen", 84, r"business source licen[cs]e(?: 1 1)?"),
    ("sspl-1.0", "server side public licen", 86, r"server side public licen[cs]e(?: v(?:ersion)?)?(?: 1)?"),
    ("elastic-2.0", "elastic licen", 78, r"elastic licen[cs]e(?: 2 0)?"),
    ("commons-clause", "commons clause", 80, r"commons clause(?: licen[cs]e condition)?"),
    ("polyform", "polyform", 72, r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) licen[cs]e"),
    ("fsl", "functional source licen", 84, r"functional source licen[cs]e"),
    ("proprietary", "all rights reserved", 30, r"all rights reserved"),
    ("proprietary", "proprietary and confidential", 62, r"(?:is )?proprietary and confidential"),
    ("proprietary", "proprietary licen", 60, r"(?:a )?proprietary licen[cs]e"),
    ("proprietary", "commercial licen", 52, r"(?:a )?commercial licen[cs]e"),
    ("proprietary", "unauthorized", 58, r"unauthorized (?:copying|distribution|use|reproduction) .{0,60}?(?:prohibited|forbidden)"),
    ("proprietary", "unauthorised", 58, r"unauthorised (?:copying|distribution|use|reproduction) .{0,60}?(?:prohibited|forbidden)"),
    ("proprietary", "end user licen", 54, r"end user licen[cs]e agreement"),
    ("proprietary", "not for redistribution", 48, r"not for redistribution"),
    ("proprietary", "for internal use only", 46, r"for internal use only"),
]
