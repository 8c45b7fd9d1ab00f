"""Ordered license signatures: each name in several wordings, written over words."""

from __future__ import annotations

import re

#: Phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword, names as words; a name's parts in brackets may be left out. More specific names come first.
NAMES = (
    ("agpl-3", "affero", "gnu affero general public (license) (version) 3"), ("agpl-3", "agpl", "agpl (v) 3"), ("agpl-3", "agplv3", "agplv3"),
    ("agpl-1", "affero", "affero general public (license) (version) 1"), ("agpl", "affero", "(gnu) affero general public"),
    ("lgpl-3", "lesser", "(gnu) lesser general public (license) (version) 3"), ("lgpl-2.1", "lesser", "(gnu) lesser general public (license) (version) 2 1"), ("lgpl-2", "library", "(gnu) library general public (license) (version) 2"),
    ("lgpl-3", "lgplv3", "lgplv3"), ("lgpl-2.1", "lgpl", "lgpl (v) 2 1"), ("lgpl-3", "lgpl", "lgpl (v) 3"), ("lgpl", "lesser", "(gnu) lesser general public"),
    ("gpl-3", "gnu", "gnu general public (license) (version) 3"), ("gpl-2", "gnu", "gnu general public (license) (version) 2"), ("gpl-1", "gnu", "gnu general public (license) (version) 1"),
    ("gpl-3", "gplv3", "(gnu) gplv3"), ("gpl-2", "gplv2", "(gnu) gplv2"), ("gpl-3", "gpl", "(gnu) gpl (version) (v) 3"), ("gpl-2", "gpl", "(gnu) gpl (version) (v) 2"), ("gpl", "gnu", "gnu general public"), ("gpl", "gpl", "(gnu) gpl"),
    ("gfdl-1.3", "documentation", "(gnu) free documentation (license) (version) 1 3"), ("gfdl", "documentation", "(gnu) free documentation"),
    ("apache-2", "apache", "apache (software) (license) (version) 2 (0)"), ("apache-1.1", "apache", "apache (software) (license) (version) 1 1"), ("apache-1", "apache", "apache (software) (license) (version) 1 0"), ("apache", "apache", "apache (software)"),
    ("mit-0", "mit", "mit no attribution"), ("mit", "mit", "mit"), ("mit", "expat", "expat"), ("x11", "x11", "x11"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib (libpng)"), ("libpng", "libpng", "libpng"),
    ("bsd-4-clause", "bsd", "(original) bsd 4 clause"), ("bsd-3-clause", "bsd", "bsd 3 clause"), ("bsd-2-clause", "bsd", "bsd 2 clause"), ("bsd-0-clause", "bsd", "(zero clause) bsd 0 clause"), ("bsd-3-clause", "bsd", "new bsd"), ("bsd-3-clause", "bsd", "modified bsd"),
    ("bsd-2-clause", "bsd", "simplified bsd"), ("bsd-2-clause", "freebsd", "freebsd"), ("bsd", "bsd", "bsd (style)"), ("0bsd", "0bsd", "0bsd"),
    ("mpl-2", "mozilla", "mozilla public (license) (version) 2 (0)"), ("mpl-1.1", "mozilla", "mozilla public (license) (version) 1 1"), ("mpl", "mozilla", "mozilla public"), ("mpl-2", "mpl", "mpl (v) 2 (0)"),
    ("epl-2", "eclipse", "eclipse public (license) (version) (v) 2 (0)"), ("epl-1", "eclipse", "eclipse public (license) (version) (v) 1 (0)"), ("epl", "eclipse", "eclipse public"), ("edl-1", "eclipse", "eclipse distribution"),
    ("cddl-1.1", "cddl", "cddl (version) 1 1"), ("cddl-1", "cddl", "cddl (version) 1 0"), ("cddl", "distribution", "common development and distribution"), ("cpl-1", "common", "common public (license) (version) 1"), ("cpal-1", "attribution", "common public attribution"),
    ("eupl-1.2", "eupl", "eupl (version) (v) 1 2"), ("eupl-1.1", "eupl", "eupl (version) (v) 1 1"), ("eupl", "european", "european union public"), ("artistic-2", "artistic", "artistic (license) (version) 2"), ("artistic", "artistic", "artistic"), ("perl", "perl", "perl 5"),
    ("cc-by-nc-nd-4", "nc", "cc by nc nd 4 (0)"), ("cc-by-nc-nd", "nc", "cc by nc nd"), ("cc-by-nc-sa-4", "nc", "cc by nc sa 4 (0)"), ("cc-by-nc-sa-3", "nc", "cc by nc sa 3 (0)"), ("cc-by-nc-sa", "nc", "cc by nc sa"), ("cc-by-nc-4", "nc", "cc by nc 4 (0)"), ("cc-by-nc", "nc", "cc by nc"),
    ("cc-by-nd", "nd", "cc by nd"), ("cc-by-sa-4", "sa", "cc by sa 4 (0)"), ("cc-by-sa-3", "sa", "cc by sa 3 (0)"), ("cc-by-sa", "sa", "cc by sa"), ("cc-by-4", "cc", "cc by 4 (0)"), ("cc-by-3", "cc", "cc by 3 (0)"), ("cc-by", "cc", "cc by"), ("cc0", "cc0", "cc0 (1) (0)"), ("cc0", "zero", "creative commons zero"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non commercial share alike"), ("cc-by-nc-sa", "noncommercial", "creative commons attribution noncommercial sharealike"), ("cc-by-nc-nd", "noderivatives", "creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"), ("cc-by-nc", "creative", "creative commons attribution non commercial"), ("cc-by-sa", "sharealike", "creative commons attribution sharealike"), ("cc-by-sa", "creative", "creative commons attribution share alike"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives"), ("cc-by", "creative", "creative commons attribution"), ("cc", "creative", "creative commons"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl (version) 2"), ("boost-1", "boost", "boost software (license) (version) 1 (0)"), ("python-2", "python", "python software foundation"), ("psf-2", "psf", "psf (license) (version) 2"), ("ruby", "ruby", "ruby"),
    ("ofl-1.1", "ofl", "(sil) ofl (version) 1 1"), ("ofl-1.1", "font", "(sil) open font"), ("ms-pl", "microsoft", "microsoft public"), ("ms-rl", "microsoft", "microsoft reciprocal"), ("odbl-1", "database", "open (data commons) database"), ("odc-by", "commons", "open data commons attribution"),
    ("pddl", "dedication", "public domain dedication and"), ("ncsa", "ncsa", "(university of illinois) ncsa (open source)"), ("postgresql", "postgresql", "postgresql"), ("php-3", "php", "php (license) (version) 3"), ("openssl", "openssl", "openssl"), ("bsl-1.1", "business", "business source (license) (version) 1 1"),
    ("sspl-1", "side", "server side public (license) (version) 1"), ("elastic-2", "elastic", "elastic (license) (version) (v) 2"), ("osl-3", "osl", "osl (version) 3"), ("osl-3", "open", "open software (license) (version) 3"), ("afl-3", "academic", "academic free (license) (version) 3"), ("upl-1", "upl", "upl (version) 1"),
    ("ecl-2", "educational", "educational community (license) (version) 2"), ("mulan-2", "mulan", "mulan psl (v) 2"), ("vim", "vim", "vim"), ("sleepycat", "sleepycat", "sleepycat"), ("tcl", "tcl", "tcl tk"), ("ipa", "ipa", "ipa font"), ("lppl-1.3", "latex", "latex project public (license) (version) 1 3"),
    ("w3c", "w3c", "w3c software (notice) (and)"), ("zpl-2.1", "zope", "zope public (license) (version) 2 1"), ("blueoak-1", "oak", "blue oak model"), ("hippocratic", "hippocratic", "hippocratic"), ("rail", "rail", "(open) rail (m)"), ("llama-2", "llama", "llama 2 community"), ("llama-3", "llama", "llama 3 community"),
)

#: Words before "under" that make a wording a notice.
UNDER = ("licensed", "released", "distributed", "provided", "available", "published")

#: How much a wording says, and its words before and after the name.
WORDINGS = (
    (1.0, f"({'|'.join(UNDER)})! under (the|a|an) (terms) (of) (the)", "(license|licence)"),
    (0.9, "spdx license identifier", ""),
    (0.8, "(the)", "(license|licence)!"),
)


#: Sentences of license texts and notices. Label, keyword, words, weight.
SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 1.0),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.7),
    ("mit", "warranty", "the software is provided as is without warranty of any kind", 0.6),
    ("mit-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including", 0.9),
    ("x11", "advertising", "except as contained in this notice the name of the x consortium shall not be used in advertising", 1.0),
    ("isc", "permission", "permission to use copy modify and (and or)! distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software", 0.8),
    ("0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.8),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 1.0),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 1.0),
    ("bsd-3-clause", "endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 1.0),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 1.0),
    ("bsd", "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", 0.9),
    ("bsd", "consequential", "be liable for any direct indirect incidental special exemplary or consequential damages", 0.7),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2", "licenses", "you may obtain a copy of the license at http www apache org licenses license 2 0", 1.0),
    ("apache-2", "licenses", "www apache org licenses license 2 0", 0.9),
    ("apache-2", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 0.9),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 1.0),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 1.0),
    ("gpl-2", "foundation", "as published by the free software foundation either version 2 of the license or (at your option)! any later version", 1.0),
    ("gpl-3", "foundation", "as published by the free software foundation either version 3 of the license or (at your option)! any later version", 1.0),
    ("gpl-2", "foundation", "as published by the free software foundation version 2", 0.9),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this program", 1.0),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software", 1.0),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 1.0),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this library", 1.0),
    ("lgpl-2.1", "lesser", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this program", 1.0),
    ("agpl", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl", "remotely", "your modified version must prominently offer all users interacting with it remotely through a computer network", 1.0),
    ("gpl-classpath", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library", 1.0),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts", 1.0),
    ("gfdl", "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl", "incompatible", "this source code form is incompatible with secondary licenses", 0.9),
    ("epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 1.0),
    ("epl-1", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl", "accompanying", "the accompanying program is provided under the terms of this eclipse public license", 1.0),
    ("cddl", "development", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpl-1", "accompanying", "the accompanying program is provided under the terms of this common public license", 1.0),
    ("eupl", "eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission", 1.0),
    ("artistic", "conditions", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("perl", "perl", "you can redistribute it and or modify it under the same terms as perl itself", 1.0),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("libpng", "libpng", "this code is released under the libpng license", 1.0),
    ("boost-1", "boost", "distributed under the boost software license version 1 0", 1.0),
    ("boost-1", "executable", "in the form of machine executable object code generated by a source language processor", 0.9),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "relinquishment", "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights", 1.0),
    ("wtfpl", "want", "you just do what the fuck you want to", 1.0),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights to this work", 1.0),
    ("cc0", "dedicated", "has dedicated the work to the public domain by waiving all of (his or her)! rights to the work worldwide under copyright law", 1.0),
    ("cc-by-4", "creative", "this work is licensed under a creative commons attribution 4 0 international license", 1.0),
    ("cc-by-sa-4", "creative", "this work is licensed under a creative commons attribution sharealike 4 0 international license", 1.0),
    ("cc-by-nc-4", "creative", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", 1.0),
    ("cc-by-nc-sa-4", "creative", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", 1.0),
    ("cc-by-nd-4", "creative", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", 1.0),
    ("cc-by-nc-nd-4", "creative", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", 1.0),
    ("cc-by-sa-3", "creative", "creative commons attribution (share alike|sharealike)! 3 0 unported license", 1.0),
    ("cc-by-3", "creative", "creative commons attribution 3 0 unported license", 1.0),
    ("cc-by-4", "creativecommons", "creativecommons org licenses by 4 0", 1.0),
    ("cc-by-3", "creativecommons", "creativecommons org licenses by 3 0", 1.0),
    ("cc-by-sa-4", "creativecommons", "creativecommons org licenses by sa 4 0", 1.0),
    ("cc-by-sa-3", "creativecommons", "creativecommons org licenses by sa 3 0", 1.0),
    ("cc-by-nc-4", "creativecommons", "creativecommons org licenses by nc 4 0", 1.0),
    ("cc-by-nc-sa-4", "creativecommons", "creativecommons org licenses by nc sa 4 0", 1.0),
    ("cc-by-nc-nd-4", "creativecommons", "creativecommons org licenses by nc nd 4 0", 1.0),
    ("cc-by-nd-4", "creativecommons", "creativecommons org licenses by nd 4 0", 1.0),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0", 0.9),
    ("mit", "opensource", "opensource org licenses mit", 1.0),
    ("bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause", 1.0),
    ("apache-2", "opensource", "opensource org licenses apache 2 0", 1.0),
    ("gpl", "gnu", "www gnu org licenses gpl", 0.9),
    ("lgpl", "gnu", "www gnu org licenses lgpl", 0.9),
    ("agpl", "gnu", "www gnu org licenses agpl", 0.9),
    ("mpl-2", "mozilla", "mozilla org mpl 2 0", 0.9),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "fonts", "the fonts including any derivative works can be bundled embedded redistributed and or sold", 1.0),
    ("python-2", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce", 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("php-3", "php", "this product includes php software freely available from", 1.0),
    ("ncsa", "sublicense", "with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 0.8),
    ("postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("bsl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("sspl-1", "service", "if you make the functionality of the program or a modified version available to third parties as a service", 1.0),
    ("elastic-2", "managed", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license", 1.0),
    ("odbl-1", "database", "this database is made available under the open database license", 1.0),
    ("odc-by", "database", "this database is made available under the open data commons attribution license", 1.0),
    ("llama", "llama", "is licensed under the llama 2 community license", 1.0),
    ("rail", "responsible", "use based restrictions as set forth in the responsible ai license", 0.9),
    ("non-commercial", "commercial", "for non commercial (research|educational)! (purposes|use)! only", 0.7),
    ("non-commercial", "noncommercial", "for noncommercial (research|educational)! (purposes|use)! only", 0.7),
    ("non-commercial", "commercial", "may not be used for commercial purposes", 0.7),
    ("no-redistribution", "redistribution", "redistribution (is)! (strictly) prohibited", 0.6),
    ("no-redistribution", "reproduced", "no part of this (publication|document|book)! may be reproduced", 0.7),
    ("no-redistribution", "unauthorized", "unauthorized (copying|reproduction|distribution)! of this (file|document|work)!", 0.8),
    ("proprietary", "trade", "contains (confidential and) trade secrets of", 0.7),
    ("proprietary", "permission", "may not be reproduced without (the) (prior) (written) permission", 0.6),
    ("evaluation", "evaluation", "licensed for evaluation (purposes|use)! only", 0.8),
)


def _words(phrase: str) -> str:
    """A regex for words in a row, each with a blank on both sides. (a b): may be left out; (a|b)!: must stand."""
    out, at = [], 0
    while at < len(phrase):
        if phrase[at] == " ":
            at += 1
        elif phrase[at] == "(":
            end = phrase.index(")", at)
            inner = "|".join("".join(f" {w} " for w in choice.split()) for choice in phrase[at + 1 : end].split("|"))
            must = phrase[end + 1 : end + 2] == "!"
            out.append(f"(?:{inner})" + ("" if must else "?"))
            at = end + 1 + must
        else:
            end = min(x for x in (phrase.find(" ", at), phrase.find("(", at), len(phrase)) if x >= 0)
            out.append(f" {phrase[at:end]} ")
            at = end
    return "".join(out)


def _versions(name: str) -> str:
    """A version marked as such may be 3, v 3 or, in one word, v3, with or without "version" before."""
    return re.sub(r"(?:\((?:version|v)\) )+(\d+)", r"(version) (\1|v \1|v\1)!", name)


def rules() -> list[tuple[str, str, str, float]]:
    """(keyword, regex, label, weight) in order of priority."""
    out = []
    for weight, before, after in WORDINGS:
        out += [(f" {keyword} ", _words(before) + _words(_versions(name)) + _words(after), label, weight) for label, keyword, name in NAMES]
    other = (
        ("rights", "all rights reserved", "all-rights-reserved", 0.5), ("domain", "(released|dedicated|placed)! (in|to|into)! (the) public domain", "public-domain", 1.0), ("domain", "public domain", "public-domain", 0.5),
        ("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 1.0), ("redistribution", "redistribution and use in source and binary forms with or without modification", "bsd", 1.0),
        ("permission", "permission to use copy modify and or distribute this software for any purpose", "isc", 1.0), ("commercial", "commercial use (is) (strictly) prohibited", "non-commercial", 0.6), ("commercial", "non commercial use only", "non-commercial", 0.6),
        ("proprietary", "proprietary and confidential", "proprietary", 0.9), ("warranty", "comes with absolutely no warranty", "no-warranty", 0.4),
    )
    sentences = [(f" {keyword} ", _words(words), label, weight) for label, keyword, words, weight in SENTENCES]
    return out + [(f" {keyword} ", _words(phrase), label, weight) for keyword, phrase, label, weight in other] + sentences
