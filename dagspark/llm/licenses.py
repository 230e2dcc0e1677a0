"""Operator 10: license detection by ordered signature rules, with DataFrame functions only.

Texts are reduced to lower-cased words with single spaces between them. Each
rule is a regex over such words with keywords: its regex runs only on texts that
hold one. TEXTS are sentences of licenses and of the notices that go with them;
NAMES are the ways to write a license's name, from which KINDS makes the
statements that name it (an SPDX tag, a grant such as "released under the ...",
a link to the license's page, a further name in a list, a name with "license"
after it, a name that is clear alone). Kinds are in order of priority.

All matches of all rules are intervals of words. They are gone through in order
of priority (within one the longer first, then the earlier, then the earlier
rule), and one that lies inside a match that was kept, or overlaps it, is
suppressed; but before that, one that lies inside a longer match of any
priority waits until that one is decided. What is suppressed suppresses nothing.
Only matches that overlap, directly or through others, are looked at together.

Null and empty texts, and texts without a match, have no label, score 0 and
null words. Repeated rows each give a row. An empty table gives an empty
result, and columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, padded_words, spaces, stored

# The phrases that always count, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_V = "(?: version| ver| ?v)?"
_GNU = "(?: licen[sc]e)?(?: as published by the free software foundation)?(?: inc)?(?: either)?(?: version| ver| ?v)? ?"
_LATER = "(?: of the licen[sc]e)?(?: only| or later| or any later version| or newer| or at your option any later version)?"
_CC = "(?: [1234] 0)?(?: international| unported| generic| deed)?"

#: label, ways to write the name, whether it is clear without the word license, keywords (one begins a word in every match)
NAMES = (
    ("mit", "mit(?: x11)?|x11 mit|expat", False, "mit|x11|expat"),
    ("mit-0", "mit 0|mit no attribution", True, "mit 0|mit no"),
    ("x11", "x11|x consortium", False, "x11|x consortium"),
    ("apache-2", f"apache(?: software)?(?: licen[sc]e)?{_V} ?2(?: 0)?|asl ?2(?: 0)?", True, "apache|asl"),
    ("apache-1.1", f"apache(?: software)?(?: licen[sc]e)?{_V} 1 1|asl 1 1", True, "apache|asl"),
    ("apache-1", f"apache(?: software)?(?: licen[sc]e)?{_V} 1 0|asl 1 0", True, "apache|asl"),
    ("bsd-1-clause", "bsd 1 clause|1 clause bsd|one clause bsd", True, "bsd|1 clause|one clause"),
    ("bsd-2-clause", "simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd", True, "simplified bsd|freebsd|bsd|2 clause|two clause"),
    ("bsd-3-clause", "modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd", True, "modified bsd|new bsd|revised bsd|bsd|3 clause|three clause"),
    ("bsd-4-clause", "original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd", True, "original bsd|old bsd|bsd|4 clause|four clause"),
    ("0bsd", "zero clause bsd|bsd zero clause|0bsd|0 clause bsd", True, "zero clause|bsd|0bsd|0 clause"),
    ("bsd", "bsd(?: style)?|berkeley software distribution", False, "bsd|berkeley"),
    ("isc", "isc|internet software consortium|internet systems consortium", False, "isc|internet s"),
    ("zlib", "zlib(?: libpng)?|libpng", False, "zlib|libpng"),
    ("boost-1", f"boost(?: software)?(?: licen[sc]e)?{_V}(?: 1 0)?|bsl 1 0", False, "boost|bsl"),
    ("unlicense", "(?:the )?unlicense", True, "unlicense|the unlicense"),
    ("wtfpl", "wtfpl|do what the f[a-z]* you want to public", True, "wtfpl|do what"),
    ("mpl-1.1", f"(?:mozilla public(?: licen[sc]e)?|mpl){_V} ?1 1", True, "mozilla|mpl"),
    ("mpl-2", f"(?:mozilla public(?: licen[sc]e)?|mpl){_V} ?2(?: 0)?", True, "mozilla|mpl"),
    ("epl-1", f"(?:eclipse public(?: licen[sc]e)?|epl){_V} ?1(?: 0)?", True, "eclipse|epl"),
    ("epl-2", f"(?:eclipse public(?: licen[sc]e)?|epl){_V} ?2(?: 0)?", True, "eclipse|epl"),
    ("gpl-1", f"(?:(?:gnu )?general public|(?:gnu )?gpl){_GNU}1(?: 0)?{_LATER}", True, "gnu|gpl|general public"),
    ("gpl-2", f"(?:(?:gnu )?general public|(?:gnu )?gpl){_GNU}2(?: 0)?{_LATER}", True, "gnu|gpl|general public"),
    ("gpl-3", f"(?:(?:gnu )?general public|(?:gnu )?gpl){_GNU}3(?: 0)?{_LATER}", True, "gnu|gpl|general public"),
    ("gpl", "gnu general public|gnu gpl|gpl", False, "gnu|gpl"),
    ("lgpl-2", f"(?:(?:gnu )?(?:library|lesser) general public|(?:gnu )?lgpl){_GNU}2(?: 0)?{_LATER}", True, "gnu|lgpl|library general|lesser general"),
    ("lgpl-2.1", f"(?:(?:gnu )?lesser general public|(?:gnu )?lgpl){_GNU}2 1{_LATER}", True, "gnu|lgpl|lesser general"),
    ("lgpl-3", f"(?:(?:gnu )?lesser general public|(?:gnu )?lgpl){_GNU}3(?: 0)?{_LATER}", True, "gnu|lgpl|lesser general"),
    ("lgpl", "gnu lesser general public|gnu lgpl|lgpl", False, "gnu|lgpl"),
    ("agpl-3", f"(?:(?:gnu )?affero general public|(?:gnu )?agpl){_GNU}3(?: 0)?{_LATER}", True, "gnu|agpl|affero"),
    ("agpl", "gnu affero general public|gnu agpl|agpl", False, "gnu|agpl"),
    ("gfdl", f"(?:gnu free documentation|gfdl)(?: licen[sc]e)?{_V}(?: ?1 [123])?", True, "gnu|gfdl"),
    ("cddl-1", f"(?:common development and distribution|cddl)(?: licen[sc]e)?{_V}(?: ?1 [01])?", True, "cddl|common development"),
    ("artistic-1", f"artistic(?: licen[sc]e)?{_V} 1(?: 0)?", True, "artistic"),
    ("artistic-2", f"artistic(?: licen[sc]e)?{_V} 2(?: 0)?", True, "artistic"),
    ("eupl-1.1", f"(?:european union public|eupl)(?: licen[sc]e)?{_V} ?1 1", True, "eupl|european union"),
    ("eupl-1.2", f"(?:european union public|eupl)(?: licen[sc]e)?{_V} ?1 2", True, "eupl|european union"),
    ("ofl-1.1", f"(?:sil open font|ofl)(?: licen[sc]e)?{_V} ?1 1", True, "ofl|sil open"),
    ("postgresql", "postgresql", False, "postgresql"),
    ("python-2", f"(?:python software foundation|psf)(?: licen[sc]e)?{_V}(?: 2(?: 0)?)?", False, "psf|python"),
    ("ruby", "ruby", False, "ruby"),
    ("php-3", f"php(?: licen[sc]e)?{_V} ?3(?: 0| 01)?", True, "php"),
    ("openssl", "openssl(?: and ssleay)?", False, "openssl"),
    ("ms-pl", "microsoft public|ms pl", False, "microsoft|ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", False, "microsoft|ms rl"),
    ("odbl", f"(?:open database|odbl)(?: licen[sc]e)?{_V}(?: ?1 0)?", False, "odbl|open database"),
    ("odc-by", "open data commons attribution|odc by", False, "odc by|open data"),
    ("pddl", "public domain dedication and|pddl", False, "pddl|public domain"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", True, "cc0|cc zero|creative commons"),
    ("cc-by", f"(?:cc by|creative commons attribution){_CC}", True, "cc by|creative commons"),
    ("cc-by-sa", f"(?:cc by sa|creative commons attribution share ?alike){_CC}", True, "cc by|creative commons"),
    ("cc-by-nc", f"(?:cc by nc|creative commons attribution non ?commercial){_CC}", True, "cc by|creative commons"),
    ("cc-by-nd", f"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s){_CC}", True, "cc by|creative commons"),
    ("cc-by-nc-sa", f"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike){_CC}", True, "cc by|creative commons"),
    ("cc-by-nc-nd", f"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s){_CC}", True, "cc by|creative commons"),
    ("bsl-1.1", f"(?:business source|busl|bsl)(?: licen[sc]e)?{_V} ?1 1", True, "bsl|busl|business source"),
    ("sspl-1", f"(?:server side public|sspl)(?: licen[sc]e)?{_V}(?: ?1(?: 0)?)?", True, "sspl|server side"),
    ("elastic-2", f"elastic(?: licen[sc]e)?{_V} ?2(?: 0)?", True, "elastic"),
    ("upl-1", f"(?:universal permissive|upl)(?: licen[sc]e)?{_V}(?: ?1 0)?", False, "upl|universal permissive"),
    ("ncsa", "university of illinois ncsa(?: open source)?|ncsa", False, "ncsa|university of illinois"),
    ("afl-3", f"(?:academic free|afl)(?: licen[sc]e)?{_V} ?3(?: 0)?", True, "afl|academic free"),
    ("osl-3", f"(?:open software|osl)(?: licen[sc]e)?{_V} ?3(?: 0)?", True, "osl|open software"),
    ("cpl-1", f"(?:common public|cpl)(?: licen[sc]e)?{_V} ?1 0", True, "cpl|common public"),
    ("ecl-2", f"(?:educational community|ecl)(?: licen[sc]e)?{_V} ?2(?: 0)?", True, "ecl|educational community"),
    ("cecill-2.1", f"cecill(?: licen[sc]e)?{_V}(?: ?2 [01])?", True, "cecill"),
    ("mulan-2", f"(?:mulan permissive(?: software)?|mulanpsl)(?: licen[sc]e)?{_V}(?: ?2(?: 0)?)?", True, "mulan"),
    ("blueoak-1", "blue oak model(?: licen[sc]e)?(?: 1 0 0)?|blueoak 1 0 0", True, "blue oak|blueoak"),
    ("hpnd", "historical permission notice and disclaimer|hpnd", True, "historical permission|hpnd"),
    ("vim", "vim", False, "vim"),
    ("w3c", "w3c(?: software(?: notice and)?)?", False, "w3c"),
    ("unicode", "unicode(?: inc|data files and software)?", False, "unicode"),
    ("json", "json", False, "json"),
    ("curl", "curl", False, "curl"),
    ("beerware", "beer ?ware", False, "beer"),
    ("llama-2", "llama ?2(?: community)?", False, "llama"),
    ("llama-3", "llama ?3(?: [123])?(?: community)?", False, "llama"),
    ("openrail", "(?:creativeml |bigcode |bigscience )?open ?rail(?: ?[ms])?(?: v1)?|bigscience rail", False, "openrail|open rail|bigscience|bigcode|creativeml"),
    ("gemma", "gemma(?: terms of use)?", False, "gemma"),
    ("proprietary", "proprietary|commercial|all rights reserved", False, "proprietary|commercial|all rights"),
)

#: label, a sentence of the license's text or notice, keywords
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "warranty of any kind"),
    ("mit", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", "above copyright"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "permission is hereby"),
    ("x11", "except as contained in this notice the name(?: [^ ]+){1,8} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "except as contained"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", "permission to use"),
    ("hpnd", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted", "permission to use"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", "redistribution and use in"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in"),
    ("bsd-3-clause", "neither the names? of(?: [^ ]+){1,12} nor the names of(?: its| their)? contributors may be used to endorse or promote products derived from this software", "neither the name"),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software", "name of the author"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", "party s patent"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "held liable"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)?(?: www)? apache org licenses license 2 0", "in compliance with"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "unless required by"),
    ("apache-2", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", "for use reproduction"),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation", "apache software foundation"),
    ("gpl", "this program is free software(?: you can redistribute it and or modify it under the terms of the gnu general public license)?", "this program is free"),
    ("gpl-1", "the gnu general public license as published by the free software foundation(?: inc)? either version 1", "gnu general"),
    ("gpl-2", "(?:under the terms of )?the gnu general public license as published by the free software foundation(?: inc)? either version 2 of the license or at your option any later version", "general public license as|affero general|lesser general|library general"),
    ("gpl-2", "gnu general public license version 2 june 1991", "gnu general"),
    ("gpl-3", "(?:under the terms of )?the gnu general public license as published by the free software foundation(?: inc)? either version 3 of the license or at your option any later version", "general public license as|affero general|lesser general|library general"),
    ("gpl-3", "gnu general public license version 3 29 june 2007", "gnu general"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "hope that it"),
    ("gpl", "you should have received a copy of the gnu general public license", "should have received"),
    ("lgpl-2.1", "(?:under the terms of )?the gnu lesser general public license as published by the free software foundation(?: inc)? either version 2 1 of the license or at your option any later version", "general public license as|affero general|lesser general|library general"),
    ("lgpl-3", "(?:under the terms of )?the gnu lesser general public license as published by the free software foundation(?: inc)? either version 3 of the license or at your option any later version", "general public license as|affero general|lesser general|library general"),
    ("lgpl-2", "(?:under the terms of )?the gnu library general public license as published by the free software foundation(?: inc)? either version 2 of the license or at your option any later version", "general public license as|affero general|lesser general|library general"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "should have received"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license", "version of the gnu"),
    ("agpl-3", "(?:under the terms of )?the gnu affero general public license as published by the free software foundation(?: inc)? either version 3 of the license or at your option any later version", "general public license as|affero general|lesser general|library general"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", "gnu affero"),
    ("agpl", "you should have received a copy of the gnu affero general public license", "should have received"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted to copy"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla public"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", "eclipse public"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0", "eclipse public"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "common development"),
    ("cpl-1", "the accompanying program is provided under the terms of this common public license", "common public"),
    ("epl-1", "the accompanying program is provided under the terms of this eclipse public license", "eclipse public"),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", "artistic control"),
    ("artistic-2", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "given free software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free"),
    ("wtfpl", "0 you just do what the f[a-z]* you want to", "0 you just"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "meet some day"),
    ("cc0", "to the extent possible under law(?: [^ ]+){1,12} has waived all copyright and related or neighboring rights", "waived all"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work"),
    ("public-domain", "(?:released|placed|dedicated|put)(?: this| the)?(?: [^ ]+){0,4} (?:into|in|to) the public domain", "public domain"),
    ("public-domain", "(?:this|the)(?: [^ ]+){1,3} is in the public domain", "public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution [1234] 0", "creative commons"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share ?alike [1234] 0", "creative commons"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial [1234] 0", "creative commons"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution non ?commercial share ?alike [1234] 0", "creative commons"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open"),
    ("ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software", "permission is hereby"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use"),
    ("python-2", "python software foundation license version 2 1 this license agreement is between the python software foundation", "python software"),
    ("php-3", "this product includes php software freely available from", "php software"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl project"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "accompanying software"),
    ("odbl", "this(?: [^ ]+){1,6} is made available under the open database license", "open database"),
    ("pddl", "the open data commons public domain dedication and license is a document intended to allow you to freely share modify and use this work", "open data"),
    ("upl-1", "the universal permissive license upl version 1 0", "universal permissive"),
    ("ncsa", "neither the names of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided as is", "neither the names"),
    ("afl-3", "licensed under the academic free license version 3 0", "academic free"),
    ("osl-3", "licensed under the open software license version 3 0", "open software"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "eupl"),
    ("sspl-1", "offering the service source code", "service source code"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed"),
    ("bsl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "non production"),
    ("json", "the software shall be used for good not evil", "good not evil"),
    ("llama-2", "llama 2 is licensed under the llama 2 community license copyright c meta platforms", "llama 2"),
    ("openrail", "you agree not to use the model or derivatives of the model", "derivatives of the model"),
    ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", "unauthorized copying|unauthorised copying"),
    ("proprietary", "this software is the confidential and proprietary information of", "confidential and proprietary"),
    ("proprietary", "no part of this(?: [^ ]+){1,3} may be reproduced", "be reproduced"),
)

_GRANT = "(?:licen[sc]ed|dual licen[sc]ed|released|distributed|redistributed|available|provided|published|shared|offered|covered|permitted|usable)(?: (?:only|solely|freely|to you|both))? (?:under|by|according to|subject to|in accordance with)(?: either)?(?: the| a)?(?: terms(?: and conditions)? of(?: the)?)?"
#: what makes a further name one of a list of licenses
_LISTED = "(?<= (?:licen[sc]ed|licen[sc]e|licen[sc]es|identifier|under) .{0,160})"
_NUMBER = "(?: (?:version |v)?[0-9]+(?: [0-9]+)?(?! clause))?"
#: kind of statement, its form around the name, gates (every match holds one), weight; in order of priority
KINDS = (
    ("text", "", "", 0.97),
    ("spdx", "spdx license identifier (?:{name})", "spdx license identifier ", 1.0),
    ("grant", _GRANT + " (?:{name})(?: licen[sc]e)?" + _NUMBER, " under | by | according to | subject to | accordance ", 0.95),
    ("link", "(?:opensource org licen[sc]es?|spdx org licen[sc]es|choosealicense com licen[sc]es|gnu org licen[sc]es|www gnu org copyleft|creativecommons org licen[sc]es|apache org licen[sc]es licen[sc]e) (?:{name})", " org | com ", 0.9),
    ("clear", "(?:{name})(?: licen[sc]e)?", "", 0.8),
    ("name", "(?:{name}) (?:public )?licen[sc]es?" + _NUMBER, " licen", 0.8),
    ("listed", "(?:and or|and|or|plus|with)(?: the)? (?:{name})(?: licen[sc]es?)?" + _LISTED, " and | or | plus | with ", 0.75),
)

def rules() -> list[dict]:
    """All rules in order: kind by kind, within a kind the longer pattern first."""
    out = []
    for level, (kind, form, gate, weight) in enumerate(KINDS):
        of = TEXTS if kind == "text" else [(label, form.replace("{name}", name), keys) for label, name, clear, keys in NAMES if clear or kind != "clear"]
        for label, pattern, keys in sorted(of, key=lambda x: (-len(x[1]), x[0])):
            out.append({"id": len(out), "level": level, "kind": kind, "label": label, "keywords": keys.split("|"), "gates": [g for g in gate.split("|") if g] or [" "], "weight": weight, "pattern": f" {pattern}(?= )"})
    return out


def gate() -> str:
    """A regex that every text with a match of any rule matches."""
    words = {k for r in rules() if r["kind"] in ("text", "clear") for k in r["keywords"]}
    grant = "(?:released|redistributed|distributed|available|provided|published|shared|offered|covered|permitted|usable)(?: [^ ]+){1,3} "
    return f" (?:licen|dual licen|spdx |{grant}|(?:opensource|spdx|gnu|apache) org |choosealicense com |{'|'.join(sorted(words))})"


def _starts(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often the phrase stands in the padded words, and its first and last start (in words)."""
    held = F.contains(padded, F.lit(f" {phrase} "))
    n = F.when(held, F.regexp_count(padded, F.lit(f" {re.escape(phrase)}(?= )"))).otherwise(F.lit(0)).cast("bigint")
    first = F.when(held, spaces(F.substring_index(padded, f" {phrase} ", 1)))
    after = spaces(F.substring_index(padded, f" {phrase} ", -1))
    last = F.when(held, spaces(padded) - 1 - after - len(phrase.split()))
    return n, first, last


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, detections): a row for each row of docs(doc_id, text), and the kept matches.

    texts: rid, doc_id, n_words, n_base, first_word, last_word, base (labels).
    detections: rid, start, stop (in words, stop is past the end), label, kind, weight.
    """
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", padded_words(F.col("text")).alias("padded"))
    stats = [_starts(F.col("padded"), p) for p in BASE_PHRASES]
    gated = F.col("padded").rlike(gate())
    texts = stored(
        base.select(
            "rid", "doc_id", (spaces(F.col("padded")) - 1).alias("n_words"), sum((s[0] for s in stats), F.lit(0)).alias("n_base"),
            F.least(*(s[1] for s in stats)).alias("first_word"), F.greatest(*(s[2] for s in stats)).alias("last_word"),
            F.array_compact(F.array(*(F.when(s[0] > 0, F.lit(label)) for s, label in zip(stats, BASE_PHRASES.values(), strict=True)))).alias("base"),
            F.when(gated, F.col("padded")).alias("padded"),
        ),
        "license_texts",
    )
    of_keyword: dict[str, list[int]] = {}
    for r in rules():
        for k in r["keywords"]:
            of_keyword.setdefault(k, []).append(r["id"])
    # where a keyword stands, all that begin it do too
    reached = {k: sorted({i for shorter, ids in of_keyword.items() if k.startswith(shorter) for i in ids}) for k in of_keyword}
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<id:int,level:int,kind:string,label:string,keywords:array<string>,gates:array<string>,weight:double,pattern:string>>")
    of_held = F.from_json(F.lit(json.dumps(reached)), "map<string,array<int>>")
    standing = F.array_distinct(F.regexp_extract_all("padded", F.lit(f" (?=({'|'.join(sorted(of_keyword, key=lambda k: (-len(k), k)))}))"), F.lit(1)))
    ids = F.array_distinct(F.flatten(F.transform(standing, lambda k: F.element_at(of_held, k))))
    tried = texts.where("padded is not null").select("rid", "padded", F.explode(ids).alias("id")).select("rid", "padded", F.get(table, F.col("id")).alias("rule"))
    tried = tried.where(F.exists("rule.gates", lambda g: F.contains(F.col("padded"), g)))
    found = tried.where(F.rlike("padded", F.col("rule.pattern"))).select(
        "rid", "rule",
        F.transform(F.split("padded", F.col("rule.pattern"), -1), lambda x: spaces(x)).alias("between"),
        F.transform(F.regexp_extract_all("padded", F.col("rule.pattern"), F.lit(0)), lambda x: spaces(x)).alias("long"),
    )
    parts = found.select("rid", "rule", F.posexplode(F.arrays_zip("between", "long")).alias("nth", "x")).select("rid", "rule", "nth", F.col("x.between").alias("gap"), F.col("x.long").alias("long"))
    earlier = Window.partitionBy("rid", "rule.id").orderBy("nth")
    past = earlier.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(earlier) + F.coalesce(F.sum("long").over(past), F.lit(0))
    matches = parts.withColumn("start", start).where("long is not null").select("rid", "rule", "start", (F.col("start") + F.col("long")).alias("stop"))
    return texts.drop("padded"), resolved(stored(matches.select("rid", "start", "stop", "rule.id", "rule.level", "rule.label", "rule.kind", "rule.weight"), "license_matches"))


def resolved(matches: DataFrame) -> DataFrame:
    """Those of matches(rid, start, stop, id, level, ...) that are kept."""
    rest = [c for c in matches.columns if c not in ("rid", "start", "stop")]
    in_order = Window.partitionBy("rid").orderBy("start", F.desc("stop"), "id")
    before = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # matches that overlap, directly or through others, have one number
    cluster = F.sum(F.when(F.coalesce(before > F.col("start"), F.lit(False)), 0).otherwise(1)).over(in_order)
    # what lies inside a longer one comes after it, whatever its priority; so a match's turn is that of the first priority that reaches over it
    one = F.struct("level", (F.col("start") - F.col("stop")).alias("minus"), "start", "stop", *(c for c in rest if c != "level"))
    clusters = matches.withColumn("cluster", cluster).groupBy("rid", "cluster").agg(F.array_sort(F.collect_list(one)).alias("found"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["stop"] <= y["stop"]) & (x["stop"] - x["start"] < y["stop"] - y["start"])
    turn = F.transform("found", lambda x: F.struct(F.array_max(F.concat(F.array(x["level"]), F.transform(F.filter("found", lambda y: inside(x, y)), lambda y: y["level"]))).alias("turn"), x.alias("x")))
    none = F.filter("found", lambda x: F.lit(False))
    kept = F.aggregate(F.array_sort(turn), none, lambda a, t: F.when(F.exists(a, lambda y: (y["start"] < t["x"]["stop"]) & (t["x"]["start"] < y["stop"])), a).otherwise(F.concat(a, F.array(t["x"]))))
    return clusters.select("rid", F.explode(kept).alias("x")).select("rid", "x.start", "x.stop", *(f"x.{c}" for c in rest))


def license_labels(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text) with its base places, labels and score."""
    texts, kept = scan(docs)
    by_doc = stored(kept.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("weight").alias("weight"), F.count("*").alias("n_detections")), "license_labels")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return texts.join(by_doc, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, F.lit(0.9)).otherwise(F.lit(0.0)), F.coalesce("weight", F.lit(0.0))).alias("score"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(documents(spark, sf_dir))


QUERIES = {"op10_licenses": op10_licenses}
ORACLE_SQL: dict[str, str] = {}
