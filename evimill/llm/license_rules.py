"""Signature rules of licenses, over texts reduced to lower-case words with one space between.

Rules stand in order of rank: a phrase that must always count, an identifier, a grant, an address, a
name with the word license, a bare name. A keyword says when a rule is worth trying.
"""

from __future__ import annotations

from typing import NamedTuple


class SignatureRule(NamedTuple):
    """``pattern`` matches whole words; a smaller ``priority`` outranks; ``base`` is never suppressed."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    base: bool

    def starts(self) -> list[str]:
        """What a word begins with wherever the keyword stands in a match."""
        return [self.keyword, *INSIDE.get(self.keyword, [])]



#: Words that hold a keyword further in.
INSIDE = {"bsd": ["0bsd"]}
#: Phrases that always count.
PHRASES = [
    ("mit", "mit", "under the mit license"),
    ("apache-2", "apache", "apache license version 2"),
    ("cc-by-nc", "cc", "cc by nc"),
]

V = "(?: v| version)?"
OR_LATER = "(?: or(?: any)? later(?: version)?)?"
#: label; keyword that every rule of the license needs; its name; words of its identifier or none;
#: words of its address or none. Patterns are tried on normalized words, so 2.0 reads "2 0".
LICENSES = [
    ("0bsd", "bsd", "(?:zero clause bsd|0bsd|bsd zero clause)", "0bsd", "opensource org licenses 0bsd"),
    ("afl-3.0", "academic", f"academic free license{V} ?3(?: 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("agpl-3", "affero", f"(?:gnu )?affero (?:general )?public licen[cs]e{V}(?: ?v?3(?: 0)?)?{OR_LATER}", None, "gnu org licenses agpl(?: 3 0)?"),
    ("agpl-3", "agpl", f"(?:gnu )?agpl{V}(?: ?v?3(?: 0)?)?{OR_LATER}", "agpl 3 0", None),
    ("apache-1.1", "apache", f"apache(?: software)?(?: license)?{V} ?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", "apache", f"apache(?: software)?(?: license)?{V} ?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("artistic-2", "artistic", f"artistic licen[cs]e{V}(?: ?2(?: 0)?)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("blueoak-1.0.0", "oak", "blue oak model license(?: 1 0 0)?", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0"),
    ("bsd-1-clause", "bsd", "(?:1|one) clause bsd|bsd (?:1|one) clause", "bsd 1 clause", None),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause|simplified|freebsd) bsd|bsd (?:2|two) clause", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause|new|revised|modified) bsd|bsd (?:3|three) clause", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:(?:4|four) clause|original|old) bsd|bsd (?:4|four) clause", "bsd 4 clause", None),
    ("bsl-1.0", "boost", f"boost software licen[cs]e{V}(?: 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business", f"business source licen[cs]e{V}(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("cc-by", "commons", f"creative commons attribution{V}(?: [1-4] 0)?", None, "creativecommons org licenses by(?: [1-4] 0)?"),
    ("cc-by", "cc", "cc by(?: [1-4] 0)?", "cc by [1-4] 0", None),
    ("cc-by-sa", "commons", f"creative commons attribution share ?alike{V}(?: [1-4] 0)?", None, "creativecommons org licenses by sa(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?", "cc by sa [1-4] 0", None),
    ("cc-by-nd", "commons", f"creative commons attribution no ?deriv(?:atives|s){V}(?: [1-4] 0)?", None, "creativecommons org licenses by nd(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?", "cc by nd [1-4] 0", None),
    ("cc-by-nc", "commons", f"creative commons attribution non ?commercial{V}(?: [1-4] 0)?", None, "creativecommons org licenses by nc(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?", "cc by nc [1-4] 0", None),
    ("cc-by-nc-sa", "commons", f"creative commons attribution non ?commercial share ?alike{V}(?: [1-4] 0)?", None, "creativecommons org licenses by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?", "cc by nc sa [1-4] 0", None),
    ("cc-by-nc-nd", "commons", f"creative commons attribution non ?commercial no ?deriv(?:atives|s){V}(?: [1-4] 0)?", None, "creativecommons org licenses by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?", "cc by nc nd [1-4] 0", None),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0", None),
    ("cc0-1.0", "commons", "creative commons zero(?: v1 0| 1 0)?(?: universal)?", None, "creativecommons org publicdomain zero 1 0"),
    ("cddl-1.0", "distribution", f"common development and distribution licen[cs]e{V}(?: 1 [01])?", "cddl 1 [01]", "opensource org licenses cddl 1 0"),
    ("cecill-2.1", "cecill", f"cecill(?: free software)?(?: license)?{V}(?: 2 [01])?", "cecill 2 1", "cecill info licences licence cecill v2(?: 1)? en"),
    ("epl-1.0", "eclipse", f"eclipse public licen[cs]e{V} ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", f"eclipse public licen[cs]e{V}(?: ?2(?: 0)?)?", "epl 2 0", "eclipse org legal epl(?: v20| 2 0)"),
    ("eupl-1.2", "european", f"european union public licen[cs]e{V}(?: 1 2)?", "eupl 1 2", "joinup ec europa eu software page eupl"),
    ("fdl-1.3", "documentation", f"(?:gnu )?free documentation licen[cs]e{V}(?: 1 [123])?{OR_LATER}", "gfdl 1 3", "gnu org licenses fdl(?: 1 3)?"),
    ("gpl-1", "general", f"(?:gnu )?general public licen[cs]e{V} ?v?1(?: 0)?{OR_LATER}", "gpl 1 0", None),
    ("gpl-2", "general", f"(?:gnu )?general public licen[cs]e{V} ?v?2(?: 0)?{OR_LATER}", None, "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-2", "gpl", f"(?:gnu )?gpl(?:v2|{V} ?v?2(?: 0)?){OR_LATER}", "gpl 2 0", None),
    ("gpl-3", "general", f"(?:gnu )?general public licen[cs]e{V} ?v?3(?: 0)?{OR_LATER}", None, "gnu org licenses gpl(?: 3 0)?"),
    ("gpl-3", "gpl", f"(?:gnu )?gpl(?:v3|{V} ?v?3(?: 0)?){OR_LATER}", "gpl 3 0", None),
    ("isc", "isc", "isc(?: style)?", "isc", "opensource org licenses isc"),
    ("lgpl-2.1", "lesser", f"(?:gnu )?lesser general public licen[cs]e{V} ?v?2(?: 1)?{OR_LATER}", None, "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.1", "lgpl", f"(?:gnu )?lgpl(?:v2(?: 1)?|{V} ?v?2(?: 1)?){OR_LATER}", "lgpl 2 1", None),
    ("lgpl-2", "library", f"(?:gnu )?library general public licen[cs]e{V}(?: ?v?2(?: 0)?)?{OR_LATER}", None, None),
    ("lgpl-3", "lesser", f"(?:gnu )?lesser general public licen[cs]e{V} ?v?3(?: 0)?{OR_LATER}", None, "gnu org licenses lgpl(?: 3 0)?"),
    ("lgpl-3", "lgpl", f"(?:gnu )?lgpl(?:v3|{V} ?v?3(?: 0)?){OR_LATER}", "lgpl 3 0", None),
    ("mit", "mit", "mit(?: x11)?", "mit", "opensource org licenses mit(?: license)?"),
    ("mit", "expat", "expat(?: mit)?", None, "jclark com xml copying txt"),
    ("mit-0", "mit", "mit (?:0|no attribution)", "mit 0", "aws mit 0"),
    ("mpl-1.1", "mozilla", f"mozilla public licen[cs]e{V} ?1 1", "mpl 1 1", "mozilla org mpl mpl 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public licen[cs]e{V}(?: ?2(?: 0)?)?", "mpl 2 0", "mozilla org (?:en us )?mpl 2 0"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl", "opensource org licenses ms pl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", "opensource org licenses ncsa"),
    ("odbl-1.0", "database", f"open (?:data commons open )?database licen[cs]e{V}(?: 1 0)?", "odbl 1 0", "opendatacommons org licenses odbl(?: 1 0)?"),
    ("ofl-1.1", "font", f"(?:sil )?open font licen[cs]e{V}(?: 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("openssl", "openssl", "openssl(?: ssleay)?", "openssl", "openssl org source license"),
    ("osl-3.0", "open", f"open software licen[cs]e{V} ?3(?: 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql", "opensource org licenses postgresql"),
    ("psf-2.0", "python", f"python software foundation(?: license)?{V}(?: 2(?: 0)?)?", "psf 2 0", "docs python org 3 license"),
    ("sspl-1.0", "server", f"server side public licen[cs]e{V}(?: 1)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("unlicense", "unlicense", "unlicense", "unlicense", "unlicense org"),
    ("upl-1.0", "permissive", f"universal permissive licen[cs]e{V}(?: 1 0)?", "upl 1 0", "oss oracle com licenses upl"),
    ("w3c", "w3c", "w3c(?: software(?: notice and)?)?", "w3c", "w3 org consortium legal (?:2002 )?copyright software"),
    ("wtfpl", "wtfpl", "wtfpl(?: 2)?", "wtfpl", "wtfpl net"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
]

#: Sentences that only the text of one license holds.
NOTICES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", "neither", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-2-clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl-2", "option", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "option", "either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "option", "either version 2 1 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("wtfpl", "want", "you just do what the [^ ]+ you want to"),
    ("public-domain", "domain", "(?:released|dedicated|placed|put) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "rights", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
]

GRANT = (
    "(?:(?:re)?licensed|released|distributed|available|published|provided|covered|governed|made available|use|shared)"
    "(?: [^ ]+){0,2} (?:under|by)(?: an?| the)?(?: terms(?: and conditions)? of(?: the)?)? "
)


def signature_rules() -> list[SignatureRule]:
    """All rules in order: every license with an identifier, a grant, an address, a full and a bare name."""
    rules = [SignatureRule(label, key, phrase, 0, 1.0, True) for label, key, phrase in PHRASES]
    rules += [SignatureRule(label, key, text, 1, 0.99, False) for label, key, text in NOTICES]
    for label, key, name, identifier, address in LICENSES:
        name = f"(?:{name})"
        if identifier:
            spdx = f"spdx license identifier (?:[^ ]+ (?:or|and) )?{identifier}(?: only| or later)?"
            rules.append(SignatureRule(label, "spdx", spdx, 1, 1.0, False))
        rules.append(SignatureRule(label, key, f"{GRANT}{name}(?: licen[cs]e)?", 2, 0.95, False))
        if address:
            rules.append(SignatureRule(label, address.split()[0], f"(?:https? )?(?:www )?{address}", 3, 0.9, False))
        rules.append(SignatureRule(label, key, f"(?:the )?{name} licen[cs]e", 3, 0.85, False))
        if "licen" in name or len(name) > 24:
            rules.append(SignatureRule(label, key, name, 4, 0.7, False))
    return rules
