"""License scan: ordered signature rules behind a keyword prefilter, resolved by priority and interval containment.

``scan`` finds licence statements in whole texts. The rules are signatures of licence texts, notices, URLs and short names,
each with a priority of its own, and all ways to state a licence's name. Three steps per text:

1. one Aho-Corasick pass over the lower-cased text, its runs of white space taken as one blank, finds which rules'
   keywords occur; most texts end here;
2. only those rules' regular expressions run; what a negation stands before ("not released under") is no detection;
3. overlapping detections are resolved: by falling priority, then length, a detection is kept unless its interval lies
   inside one that is kept already (equal intervals: the higher priority stays, of equal ones the first label).

Base labels stay whatever the rules say. Time grows with a text's length and detections (times their logarithm).

Defined cases: a null or empty text has no words and no labels (null positions, score 0); repeated rows are scanned
each on its own; other columns are left out and may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, spread, tune

# Phrases that the base labels stand for.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Licence families: label, SPDX identifiers, names as regular expressions, and a keyword of each name.
FAMILIES = [
    ("mit", "MIT", [(r"mit(?: |-)licen[cs]e", "mit"), (r"expat licen[cs]e", "expat")]),
    ("mit-0", "MIT-0", [(r"mit no attribution(?: licen[cs]e)?", "no attribution")]),
    ("apache-1.1", "Apache-1.1", [(r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1", "apache")]),
    ("apache-2", "Apache-2.0", [(r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\.0)?", "apache"), (r"apache-2(?:\.0)?", "apache-2")]),
    ("bsd-2", "BSD-2-Clause", [(r"(?:simplified|freebsd|2-clause|two-clause) bsd licen[cs]e", "bsd"), (r"bsd[ -]2-clause", "2-clause")]),
    ("bsd-3", "BSD-3-Clause", [(r"(?:new|modified|revised|3-clause|three-clause) bsd licen[cs]e", "bsd"), (r"bsd[ -]3-clause", "3-clause")]),
    ("bsd-4", "BSD-4-Clause", [(r"(?:original|4-clause|four-clause) bsd licen[cs]e", "bsd")]),
    ("0bsd", "0BSD", [(r"zero[- ]clause bsd(?: licen[cs]e)?", "bsd")]),
    ("isc", "ISC", [(r"isc licen[cs]e", "isc")]),
    ("gpl-1", "GPL-1.0", [(r"gnu general public licen[cs]e,? (?:version |v)1(?:\.0)?", "general public")]),
    ("gpl-2", "GPL-2.0", [(r"gnu general public licen[cs]e,? (?:version |v)2(?:\.0)?", "general public"), (r"gpl ?v2", "gpl")]),
    ("gpl-3", "GPL-3.0", [(r"gnu general public licen[cs]e,? (?:version |v)3(?:\.0)?", "general public"), (r"gpl ?v3", "gpl")]),
    ("lgpl-2", "LGPL-2.0", [(r"gnu (?:library|lesser) general public licen[cs]e,? (?:version |v)2(?:\.0)?", "general public")]),
    ("lgpl-2.1", "LGPL-2.1", [(r"gnu lesser general public licen[cs]e,? (?:version |v)2\.1", "general public"), (r"lgpl ?v2\.1", "lgpl")]),
    ("lgpl-3", "LGPL-3.0", [(r"gnu lesser general public licen[cs]e,? (?:version |v)3(?:\.0)?", "general public"), (r"lgpl ?v3", "lgpl")]),
    ("agpl-3", "AGPL-3.0", [(r"gnu affero general public licen[cs]e,? (?:version |v)3(?:\.0)?", "affero"), (r"agpl ?v3", "agpl")]),
    ("mpl-1.1", "MPL-1.1", [(r"mozilla public licen[cs]e,? (?:version |v)?1\.1", "mozilla")]),
    ("mpl-2", "MPL-2.0", [(r"mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", "mozilla")]),
    ("epl-1", "EPL-1.0", [(r"eclipse public licen[cs]e(?:,? -)? (?:version |v ?)?1(?:\.0)?", "eclipse")]),
    ("epl-2", "EPL-2.0", [(r"eclipse public licen[cs]e(?:,? -)? (?:version |v ?)?2(?:\.0)?", "eclipse")]),
    ("cddl-1", "CDDL-1.0", [(r"common development and distribution licen[cs]e", "common development")]),
    ("cpl-1", "CPL-1.0", [(r"common public licen[cs]e", "common public")]),
    ("artistic-2", "Artistic-2.0", [(r"artistic licen[cs]e,? (?:version |v)?2(?:\.0)?", "artistic")]),
    ("artistic-1", "Artistic-1.0", [(r"artistic licen[cs]e,? (?:version |v)?1(?:\.0)?", "artistic")]),
    ("bsl-1", "BSL-1.0", [(r"boost software licen[cs]e", "boost")]),
    ("zlib", "Zlib", [(r"zlib(?:/libpng)? licen[cs]e", "zlib")]),
    ("libpng", "Libpng", [(r"(?<!zlib/)libpng licen[cs]e", "libpng")]),
    ("unlicense", "Unlicense", [(r"the unlicense", "unlicense")]),
    ("wtfpl", "WTFPL", [(r"do what the f\S+ you want to public licen[cs]e", "you want to public"), (r"wtfpl", "wtfpl")]),
    ("cc0", "CC0-1.0", [(r"creative commons zero", "creative commons"), (r"cc0(?: 1\.0)?", "cc0")]),
    ("cc-by", "CC-BY-4.0", [(r"creative commons attribution(?: \d\.\d)?(?: international)?(?: licen[cs]e)?(?![ -](?:non|share|no))", "creative commons"), (r"cc[- ]by(?: \d\.\d)?(?![- ](?:nc|sa|nd))", "cc")]),
    ("cc-by-sa", "CC-BY-SA-4.0", [(r"creative commons attribution[- ]share[- ]?alike", "creative commons"), (r"cc[- ]by[- ]sa", "cc")]),
    ("cc-by-nd", "CC-BY-ND-4.0", [(r"creative commons attribution[- ]no[- ]?deriv(?:ative)?s", "creative commons"), (r"cc[- ]by[- ]nd", "cc")]),
    ("cc-by-nc", "CC-BY-NC-4.0", [(r"creative commons attribution[- ]non[- ]?commercial(?![ -](?:share|no))", "creative commons"), (r"cc[- ]by[- ]nc(?![- ](?:sa|nd))", "cc")]),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", [(r"creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike", "creative commons"), (r"cc[- ]by[- ]nc[- ]sa", "cc")]),
    ("cc-by-nc-nd", "CC-BY-NC-ND-4.0", [(r"creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s", "creative commons"), (r"cc[- ]by[- ]nc[- ]nd", "cc")]),
    ("ofl-1.1", "OFL-1.1", [(r"sil open font licen[cs]e", "open font"), (r"open font licen[cs]e", "open font")]),
    ("eupl-1.2", "EUPL-1.2", [(r"european union public licen[cs]e", "european union")]),
    ("cecill", "CECILL-2.1", [(r"cecill(?:-[bc])? licen[cs]e", "cecill")]),
    ("python-2", "Python-2.0", [(r"python software foundation licen[cs]e", "python software")]),
    ("php-3", "PHP-3.01", [(r"php licen[cs]e", "php")]),
    ("ruby", "Ruby", [(r"ruby licen[cs]e", "ruby")]),
    ("postgresql", "PostgreSQL", [(r"postgresql licen[cs]e", "postgresql")]),
    ("openssl", "OpenSSL", [(r"openssl licen[cs]e", "openssl")]),
    ("ncsa", "NCSA", [(r"university of illinois/?(?:ncsa)? open source licen[cs]e", "illinois"), (r"ncsa licen[cs]e", "ncsa")]),
    ("afl-3", "AFL-3.0", [(r"academic free licen[cs]e", "academic free")]),
    ("osl-3", "OSL-3.0", [(r"open software licen[cs]e", "open software")]),
    ("odbl", "ODbL-1.0", [(r"open (?:data commons open )?database licen[cs]e", "database licen")]),
    ("gfdl-1.3", "GFDL-1.3", [(r"gnu free documentation licen[cs]e", "free documentation")]),
    ("sspl-1", "SSPL-1.0", [(r"server side public licen[cs]e", "server side")]),
    ("busl-1.1", "BUSL-1.1", [(r"business source licen[cs]e", "business source")]),
    ("ms-pl", "MS-PL", [(r"microsoft public licen[cs]e", "microsoft")]),
    ("ms-rl", "MS-RL", [(r"microsoft reciprocal licen[cs]e", "microsoft")]),
    ("upl-1", "UPL-1.0", [(r"universal permissive licen[cs]e", "universal permissive")]),
    ("vim", "Vim", [(r"vim licen[cs]e", "vim")]),
    ("w3c", "W3C", [(r"w3c(?: software)? (?:notice and )?licen[cs]e", "w3c")]),
    ("x11", "X11", [(r"x11 licen[cs]e", "x11")]),
    ("proprietary", "LicenseRef-Proprietary", [(r"all rights reserved", "rights reserved"), (r"proprietary and confidential", "proprietary")]),
    ("public-domain", "LicenseRef-Public-Domain", [(r"public domain dedication", "public domain"), (r"(?:released|dedicated|placed) (?:in|in)?to the public domain", "public domain")]),
]

# Signatures of licence texts, notices, addresses and names without a version: priority, confidence, label, a keyword of it, pattern.
SIGNATURES = [
    # texts and notices
    (90, 1.0, "mit", "obtaining a copy", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (91, 1.0, "mit-0", "obtaining a copy", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files[^.]{0,300}to permit persons to whom the software is furnished to do so\. the software is provided"),
    (90, 1.0, "bsl-1", "obtaining a copy", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    (90, 1.0, "isc", "to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that"),
    (90, 1.0, "0bsd", "to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. "),
    (80, 0.9, "bsd", "redistribution and use", r"redistribution and use in source and binary forms,? with or without modification"),
    (85, 0.95, "bsd-3", "neither the name", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software"),
    (86, 0.95, "bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (90, 1.0, "apache-2", "apache", r"licen[cs]ed under the apache licen[cs]e, version 2\.0 \(the [\"'“]?licen[cs]e"),
    (90, 1.0, "apache-2", "version 2.0, january", r"apache licen[cs]e,? version 2\.0, january 2004"),
    (90, 1.0, "gpl-2", "general public", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2"),
    (90, 1.0, "gpl-3", "general public", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3"),
    (90, 1.0, "gpl-2", "general public", r"gnu general public licen[cs]e version 2, june 1991"),
    (90, 1.0, "gpl-3", "general public", r"gnu general public licen[cs]e version 3, 29 june 2007"),
    (90, 1.0, "lgpl-2.1", "general public", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 2\.1"),
    (90, 1.0, "lgpl-3", "general public", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3"),
    (90, 1.0, "agpl-3", "affero", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation[;,] (?:either )?version 3"),
    (90, 1.0, "mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. 2\.0"),
    (90, 1.0, "mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    (90, 1.0, "epl-2", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2\.0"),
    (90, 1.0, "epl-1", "eclipse public", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?1\.0"),
    (90, 1.0, "cddl-1", "common development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    (90, 1.0, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    (90, 1.0, "wtfpl", "what the f", r"you just do what the f\S+ you want to"),
    (90, 1.0, "zlib", "provided 'as-is'", r"this software is provided 'as-is', without any express or implied warranty"),
    (90, 1.0, "cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    (88, 0.95, "artistic-2", "artistic", r"the artistic licen[cs]e 2\.0 copyright"),
    (88, 0.95, "ofl-1.1", "open font", r"this font software is licen[cs]ed under the sil open font licen[cs]e"),
    (88, 0.95, "php-3", "php", r"this (?:source file is subject to|product includes) (?:version 3\.01 of the )?php (?:licen[cs]e|software)"),
    (88, 0.95, "openssl", "openssl", r"this product includes software developed by the openssl project"),
    (88, 0.95, "busl-1.1", "change date", r"change date:? .{1,40} change licen[cs]e:?"),
    (88, 0.95, "ncsa", "illinois", r"neither the names of .{1,80}university of illinois"),
    (84, 0.9, "proprietary", "without the prior", r"(?:may not be|no part .{1,60}may be) (?:copied|reproduced|distributed|disclosed).{0,80}without the prior written (?:permission|consent)"),
    # addresses
    (70, 0.95, "mit", "opensource.org", r"opensource\.org/licen[cs]es?/mit(?:-license)?(?:\.php|\.html)?(?![\w-])"),
    (70, 0.95, "bsd-2", "opensource.org", r"opensource\.org/licen[cs]es?/bsd-2-clause"),
    (70, 0.95, "bsd-3", "opensource.org", r"opensource\.org/licen[cs]es?/bsd-3-clause"),
    (70, 0.95, "isc", "opensource.org", r"opensource\.org/licen[cs]es?/isc"),
    (70, 0.95, "apache-2", "opensource.org", r"opensource\.org/licen[cs]es?/apache-2\.0"),
    (70, 0.95, "apache-2", "apache.org", r"apache\.org/licen[cs]es/licen[cs]e-2\.0"),
    (70, 0.95, "gpl-2", "gnu.org", r"gnu\.org/licen[cs]es/(?:old-licenses/)?gpl-2\.0"),
    (70, 0.95, "gpl-3", "gnu.org", r"gnu\.org/licen[cs]es/gpl-3\.0"),
    (69, 0.9, "gpl", "gnu.org", r"gnu\.org/(?:licen[cs]es|copyleft)/gpl(?![\w-])"),
    (70, 0.95, "lgpl-2.1", "gnu.org", r"gnu\.org/licen[cs]es/(?:old-licenses/)?lgpl-2\.1"),
    (70, 0.95, "lgpl-3", "gnu.org", r"gnu\.org/licen[cs]es/lgpl-3\.0"),
    (69, 0.9, "lgpl", "gnu.org", r"gnu\.org/(?:licen[cs]es|copyleft)/(?:lgpl|lesser)(?![\w-])"),
    (70, 0.95, "agpl-3", "gnu.org", r"gnu\.org/licen[cs]es/agpl-3\.0"),
    (70, 0.95, "mpl-2", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    (70, 0.95, "epl-2", "eclipse.org", r"eclipse\.org/(?:legal|org/documents)/epl-2\.0"),
    (70, 0.95, "epl-1", "eclipse.org", r"eclipse\.org/(?:legal|org/documents)/epl-v10"),
    (70, 0.95, "cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    (70, 0.95, "public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0"),
    (70, 0.95, "cc-by", "creativecommons.org", r"creativecommons\.org/licen[cs]es/by(?![\w-])(?:/\d\.\d)?"),
    (70, 0.95, "cc-by-sa", "creativecommons.org", r"creativecommons\.org/licen[cs]es/by-sa(?![\w-])(?:/\d\.\d)?"),
    (70, 0.95, "cc-by-nd", "creativecommons.org", r"creativecommons\.org/licen[cs]es/by-nd(?![\w-])(?:/\d\.\d)?"),
    (70, 0.95, "cc-by-nc", "creativecommons.org", r"creativecommons\.org/licen[cs]es/by-nc(?![\w-])(?:/\d\.\d)?"),
    (70, 0.95, "cc-by-nc-sa", "creativecommons.org", r"creativecommons\.org/licen[cs]es/by-nc-sa(?![\w-])(?:/\d\.\d)?"),
    (70, 0.95, "cc-by-nc-nd", "creativecommons.org", r"creativecommons\.org/licen[cs]es/by-nc-nd(?![\w-])(?:/\d\.\d)?"),
    (70, 0.95, "unlicense", "unlicense.org", r"(?<![\w.])unlicense\.org"),
    (70, 0.95, "ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    (70, 0.95, "bsl-1", "boost.org", r"boost\.org/license_1_0\.txt"),
    (70, 0.95, "odbl", "opendatacommons.org", r"opendatacommons\.org/licen[cs]es/odbl"),
    (70, 0.95, "wtfpl", "wtfpl.net", r"(?<![\w.])(?:www\.)?wtfpl\.net"),
    # fields of package metadata
    (46, 0.9, "mit", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:mit|expat)(?![\w-])"),
    (46, 0.9, "isc", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?isc(?![\w-])"),
    (46, 0.9, "apache-2", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?apache(?:[- ]licen[cs]e)?,?[- ]?(?:version |v ?)?2(?:\.0)?(?![\w-])"),
    (46, 0.9, "bsd-2", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:bsd[- ]2(?:[- ]clause)?|2[- ]clause bsd)(?![\w-])"),
    (46, 0.9, "bsd-3", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:bsd[- ]3(?:[- ]clause)?|3[- ]clause bsd|new bsd)(?![\w-])"),
    (44, 0.7, "bsd", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?bsd(?![\w-])(?! (?:2|3|new))"),
    (46, 0.9, "gpl-2", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:gnu )?gpl[- ]?(?:version |v ?)?2(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-])"),
    (46, 0.9, "gpl-3", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:gnu )?gpl[- ]?(?:version |v ?)?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-])"),
    (46, 0.9, "lgpl-2.1", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:gnu )?lgpl[- ]?(?:version |v ?)?2\.1(?:\+|-only|-or-later)?(?![\w.-])"),
    (46, 0.9, "lgpl-3", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:gnu )?lgpl[- ]?(?:version |v ?)?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-])"),
    (46, 0.9, "agpl-3", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:gnu )?agpl[- ]?(?:version |v ?)?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.-])"),
    (44, 0.7, "gpl", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?(?:gnu )?gpl(?![\w-])(?! ?(?:version |v ?)?\d)"),
    (46, 0.9, "mpl-2", "licen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?mpl[- ]?(?:version |v ?)?2(?:\.0)?(?![\w-])"),
    (46, 0.9, "unlicense", "unlicen", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?unlicen[cs]e(?![\w-])"),
    (46, 0.9, "cc0", "cc0", r"licen[cs]es?[\"']?\s*[:=]\s*[\"'(\[]*\s*(?:the )?cc0(?:[- ]?1\.0)?(?![\w-])"),
    (43, 0.8, "mit", "mit license", r"license ::(?: osi approved ::)? mit license"),
    (43, 0.8, "apache", "apache software", r"license ::(?: osi approved ::)? apache software license"),
    (43, 0.8, "bsd", "bsd license", r"license ::(?: osi approved ::)? bsd license"),
    (43, 0.8, "gpl-3", "gplv3", r"license ::(?: osi approved ::)? gnu general public license v3(?: or later)? \(gplv3\+?\)"),
    (43, 0.8, "gpl-2", "gplv2", r"license ::(?: osi approved ::)? gnu general public license v2(?: or later)? \(gplv2\+?\)"),
    # short names in sentences
    (42, 0.85, "mit", "mit", r"(?:dual[- ])?licen[cs]ed (?:under|by|with) (?:the )?(?:terms of )?(?:the )?mit(?![\w-])"),
    (42, 0.85, "mit", "mit", r"(?<![\w-])mit[- ]licen[cs]ed(?![\w-])"),
    (41, 0.8, "mit", "mit", r"(?:released|available|distributed|published) (?:under|with) (?:the )?mit(?![\w-])(?! (?:press|media))"),
    (42, 0.85, "isc", "isc", r"(?:licen[cs]ed|released|available) under (?:the )?isc(?![\w-])"),
    (42, 0.85, "apache-2", "apache", r"licen[cs]ed (?:under|by|with) (?:the )?apache(?:[- ]licen[cs]e)?,?[- ](?:version |v ?)?2(?:\.0)?(?![\w-])"),
    (42, 0.85, "apache-2", "apache", r"(?<![\w-])apache[- ](?:version |v ?)?2(?:\.0)?[- ]licen[cs]ed?(?![\w-])"),
    (41, 0.8, "apache-2", "apache", r"(?:released|available|distributed|published) (?:under|with) (?:the )?apache[- ](?:version |v ?)?2(?:\.0)?(?![\w-])"),
    (42, 0.8, "bsd", "bsd", r"(?:licen[cs]ed|released|available|distributed) (?:under|with) (?:the )?bsd(?![\w-])(?! (?:[23]|new|simplified))"),
    (42, 0.8, "bsd", "bsd", r"(?<![\w-])bsd[- ]licen[cs]ed(?![\w-])"),
    (42, 0.85, "gpl-2", "gpl", r"(?<![\w-])(?:gnu )?gpl(?: licen[cs]e)?,? (?:version|v\.?) ?2(?:\.0)?(?![\w-])(?!\.\d)"),
    (42, 0.85, "gpl-3", "gpl", r"(?<![\w-])(?:gnu )?gpl(?: licen[cs]e)?,? (?:version|v\.?) ?3(?:\.0)?(?![\w-])(?!\.\d)"),
    (42, 0.85, "lgpl-2.1", "lgpl", r"(?<![\w-])(?:gnu )?lgpl(?: licen[cs]e)?,? (?:version|v\.?) ?2\.1(?![\w-])"),
    (42, 0.85, "lgpl-3", "lgpl", r"(?<![\w-])(?:gnu )?lgpl(?: licen[cs]e)?,? (?:version|v\.?) ?3(?:\.0)?(?![\w-])(?!\.\d)"),
    (42, 0.85, "agpl-3", "agpl", r"(?<![\w-])(?:gnu )?agpl(?: licen[cs]e)?,? (?:version|v\.?) ?3(?:\.0)?(?![\w-])(?!\.\d)"),
    (42, 0.8, "gpl", "gpl", r"(?<![\w-])gpl[- ]licen[cs]ed(?![\w-])"),
    (42, 0.85, "cc0", "cc0", r"(?:licen[cs]ed|released|available|dedicated) (?:under|with|to) (?:the )?(?:creative commons )?cc0(?![\w-])"),
    # names without a version; a versioned rule that covers one suppresses it
    (9, 0.6, "gpl", "general public", r"(?<!lesser\s)(?<!library\s)(?<!affero\s)(?:gnu )?general public licen[cs]e(?!,? (?:version|v) ?\d)"),
    (8, 0.5, "gpl", "gpl", r"(?:under|licen[cs]e[sd]?|the|gnu) (?:the )?gpl(?![\w-])(?!,? ?(?:version |v\.? ?)?\d)"),
    (9, 0.6, "lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?!,? (?:version|v) ?\d)"),
    (8, 0.5, "lgpl", "lgpl", r"(?<![\w-])lgpl(?![\w-])(?!,? ?(?:version |v\.? ?)?\d)"),
    (9, 0.6, "agpl", "affero", r"(?:gnu )?affero general public licen[cs]e(?!,? (?:version|v) ?\d)"),
    (8, 0.5, "agpl", "agpl", r"(?<![\w-])agpl(?![\w-])(?!,? ?(?:version |v\.? ?)?\d)"),
    (9, 0.6, "bsd", "bsd", r"(?<!clause\s)(?<!simplified\s)(?<!freebsd\s)(?<!new\s)(?<!modified\s)(?<!revised\s)(?<!original\s)(?<![\w-])bsd(?:-style)? licen[cs]e"),
    (9, 0.6, "apache", "apache", r"(?<![\w-])apache(?: software)? licen[cs]e(?!,? (?:version |v)?\d)"),
    (9, 0.6, "mpl", "mozilla", r"mozilla public licen[cs]e(?!,? (?:version |v\.? ?)?\d)"),
    (9, 0.6, "epl", "eclipse", r"eclipse public licen[cs]e(?!(?:,? -)?,? (?:version |v ?)?\d)"),
    (9, 0.6, "artistic", "artistic", r"(?<![\w-])artistic licen[cs]e(?!,? (?:version |v)?\d)"),
    (9, 0.6, "cc", "creative commons", r"creative commons licen[cs]e"),
    (9, 0.6, "public-domain", "public domain", r"(?:is|are|lies|falls) in the public domain"),
    (9, 0.6, "copyleft", "copyleft", r"(?<![\w-])copyleft licen[cs]es?"),
]

#: Ways to state a licence, from the strongest: priority, confidence, pattern around the name, and whether it takes the SPDX identifier.
FORMS = [
    (50, 1.0, r"spdx-licen[cs]e-identifier:?[\s(]*{spdx}(?:-only|-or-later|\+)?", True, "spdx"),
    (48, 1.0, r"spdx-licen[cs]e-identifier:?[^\n]{{0,200}}?(?:\b(?:or|and)\b|\()[ \t(]*{spdx}(?:-only|-or-later|\+)?", True, "spdx"),  # a later part of an expression
    (45, 0.95, r"(?:under|subject to|governed by|pursuant to) (?:the (?:terms|conditions)(?: and conditions)? of )?(?:the )?{name}", False, None),
    (40, 0.95, r"licen[cs]ed (?:to you )?(?:under|by|with) (?:the )?{name}", False, None),
    (35, 0.9, r"(?:released|distributed|published|available|provided) (?:under|with|by) (?:the )?{name}", False, None),
    (30, 0.8, r"licen[cs]e\s*[:=]\s*[\"']?{name}", False, None),
    (10, 0.5, r"(?<![\w-]){name}(?![\w-])", False, None),
]


class Rule:
    __slots__ = ("confidence", "keyword", "label", "pattern", "priority")

    def __init__(self, priority: int, confidence: float, label: str, keyword: str, pattern: str):
        self.priority, self.confidence, self.label, self.keyword = priority, confidence, label, keyword
        self.pattern = re.compile(pattern)


def _spaced(pattern: str) -> str:
    """A space of a pattern stands for any white space."""
    for a, b in (("[- ]", r"(?:-|\s+)"), ("[ -]", r"(?:-|\s+)"), ("(?: |-)", r"(?:\s+|-)"), (" ?", r"\s*"), (" ", r"\s+")):
        pattern = pattern.replace(a, b)
    return pattern


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules, by falling priority."""
    out = []
    for label, spdx, names in FAMILIES:
        for priority, confidence, form, takes_id, keyword in FORMS:
            if takes_id:
                out.append(Rule(priority, confidence, label, keyword, form.format(spdx=re.escape(spdx.lower()))+ r"(?![\w.-])"))
                continue
            for name, key in names:
                out.append(Rule(priority, confidence, label, key, _spaced(form.replace("{name}", f"(?:{name})"))))
    out += [Rule(priority, confidence, label, keyword, _spaced(pattern)) for priority, confidence, label, keyword, pattern in SIGNATURES]
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _keywords() -> ahocorasick.Automaton:
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    a = ahocorasick.Automaton()
    for k, v in by.items():
        a.add_word(k, tuple(v))
    a.make_automaton()
    return a


def resolve(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Detections (start, end, priority, confidence, label) less those that lie inside a stronger one."""
    starts = sorted({d[0] for d in found})
    place = {s: i + 1 for i, s in enumerate(starts)}
    reach = [0] * (len(starts) + 1)  # a tree of the largest ends that are kept, by prefixes of the starts
    kept = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[4])):
        i, far = place[d[0]], 0
        while i:
            far = max(far, reach[i])
            i &= i - 1
        if far >= d[1]:
            continue
        kept.append(d)
        i = place[d[0]]
        while i < len(reach):
            reach[i] = max(reach[i], d[1])
            i += i & -i
    return sorted(kept)


#: What says that the words behind it do not hold: a negation and a few more words of the same clause.
_NEGATION = re.compile(r"(?:\bnot|\bnever|\bneither|\bnor|\bno longer|\bnicht|\bkeine[rsnm]?|n['’]t|\bwithout being)(?!\s+(?:only|just|merely|solely))(?:\s+[^\W\d_]+){0,5}\s+$")
#: Characters before a detection that a negation is looked for in.
_BEFORE = 60


def detect(text: str | None, gated: bool = True) -> list[tuple[int, int, int, float, str]]:
    """The detections of one text that survive suppression, by start. gated: only rules whose keyword occurs are tried."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower-case to more code points; intervals are told on the text
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    # a blank of a keyword is any white space, as in the rules
    which = {i for _, ids in _keywords().iter(" ".join(low.split())) for i in ids} if gated else range(len(rules()))
    found = []
    for i in sorted(which):
        r = rules()[i]
        found += [(m.start(), m.end(), r.priority, r.confidence, r.label) for m in r.pattern.finditer(low) if not _NEGATION.search(low, max(0, m.start() - _BEFORE), m.start())]
    return resolve(found)


_PHRASES = [(f" {p} ".encode(), v) for p, v in BASE_PHRASES.items()]


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Word positions at which a base phrase starts, and the labels."""
    line, places, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in _PHRASES:
        at, last, n = line.find(phrase), 0, -1
        while at >= 0:
            n, last = n + line.count(b" ", last, at + 1), at + 1
            places.append(n)
            labels.add(label)
            at = line.find(phrase, at + 1)
    return places, labels


ADDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,priority:int,confidence:double,label:string>>"


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and licence findings of each row; see the module's text for nulls and ties."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                words = alnum_words(t)
                places, base = base_places(words)
                found = detect(t)
                labels = base | {d[4] for d in found}
                best = max([0.9 * bool(base), *(d[3] for d in found)])
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, [dict(zip(("start", "end", "priority", "confidence", "label"), d, strict=True)) for d in found]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["k", *_NAMES])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, {ADDS}").withColumnRenamed("k", key)


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32()), ("confidence", pa.float64()), ("label", pa.string())]))]
