"""Signature rules of licenses: wordings of each license, put into the sentences that announce one.

A rule is (id, label, priority, keyword, pattern). Words are joined by single blanks here; `*`
marks an optional word before it. Higher priority wins where one match contains another.
"""

from __future__ import annotations

from itertools import product

#: Label, and the names under which the license goes.
LICENSES = [
    ("mit", ["mit", "mit expat", "expat"]),
    ("apache-2", ["apache license version 2 0", "apache license version 2", "apache license 2 0", "apache 2 0", "apache 2"]),
    ("apache-1.1", ["apache software license version 1 1", "apache license 1 1"]),
    ("cc-by-nc", ["cc by nc 4 0", "cc by nc", "creative commons attribution noncommercial"]),
    ("cc-by-nc-sa", ["cc by nc sa 4 0", "cc by nc sa", "creative commons attribution noncommercial sharealike"]),
    ("cc-by-nc-nd", ["cc by nc nd 4 0", "cc by nc nd"]),
    ("cc-by", ["cc by 4 0", "cc by 3 0", "creative commons attribution"]),
    ("cc-by-sa", ["cc by sa 4 0", "cc by sa", "creative commons attribution sharealike"]),
    ("cc-by-nd", ["cc by nd 4 0", "cc by nd"]),
    ("cc0", ["cc0 1 0", "cc0", "creative commons zero"]),
    ("gpl-3", ["gnu general public license version 3", "gnu gpl version 3", "gplv3", "gpl 3 0", "gpl 3"]),
    ("gpl-2", ["gnu general public license version 2", "gnu gpl version 2", "gplv2", "gpl 2 0", "gpl 2"]),
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"]),
    ("lgpl-3", ["gnu lesser general public license version 3", "lgplv3", "lgpl 3"]),
    ("lgpl-2.1", ["gnu lesser general public license version 2 1", "lgplv2 1", "lgpl 2 1"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lgpl"]),
    ("agpl-3", ["gnu affero general public license version 3", "agplv3", "agpl 3"]),
    ("agpl", ["gnu affero general public license", "agpl"]),
    ("bsd-2-clause", ["bsd 2 clause", "simplified bsd"]),
    ("bsd-3-clause", ["bsd 3 clause", "new bsd", "modified bsd"]),
    ("bsd-4-clause", ["bsd 4 clause", "original bsd"]),
    ("bsd", ["bsd", "bsd style"]),
    ("isc", ["isc"]),
    ("mpl-2", ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"]),
    ("mpl-1.1", ["mozilla public license version 1 1", "mpl 1 1"]),
    ("epl-2", ["eclipse public license version 2 0", "epl 2 0"]),
    ("epl-1", ["eclipse public license version 1 0", "epl 1 0"]),
    ("cddl-1", ["common development and distribution license", "cddl 1 0"]),
    ("zlib", ["zlib", "zlib libpng"]),
    ("boost-1", ["boost software license", "bsl 1 0"]),
    ("unlicense", ["unlicense"]),
    ("wtfpl", ["wtfpl"]),
    ("artistic-2", ["artistic license 2 0"]),
    ("python-2", ["python software foundation license", "psf license"]),
    ("postgresql", ["postgresql license"]),
    ("ofl-1.1", ["sil open font license", "ofl 1 1"]),
    ("eupl-1.2", ["european union public licence", "eupl 1 2"]),
    ("odbl-1", ["open database license", "odbl 1 0"]),
    ("ms-pl", ["microsoft public license", "ms pl"]),
    ("upl-1", ["universal permissive license"]),
    ("0bsd", ["0bsd", "zero clause bsd"]),
    ("openssl", ["openssl license"]),
    ("php-3", ["php license version 3"]),
    ("w3c", ["w3c software notice"]),
    ("public-domain", ["public domain"]),
]
#: Sentences around a name ({}), and their priorities.
SENTENCES = [
    ("spdx license identifier {}", 100),
    ("licensed under the* terms* of* the* {} license*", 90),
    ("released under the* {} license*", 85),
    ("distributed under the* terms* of* the* {} license*", 85),
    ("available under the* {} license*", 80),
    ("under the terms of the {} license*", 75),
    ("under the {} license", 70),
    ("under {}", 60),
]
#: License texts known by their own words (label, priority, words).
TEXTS = [
    ("mit", 95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 95, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 65, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 80, "neither the name of the copyright holder nor the names of its contributors"),
    ("apache-2", 95, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("unlicense", 95, "this is free and unencumbered software released into the public domain"),
    ("zlib", 90, "the origin of this software must not be misrepresented"),
    ("gpl", 65, "this program is free software you can redistribute it and or modify it"),
    ("proprietary", 60, "all rights reserved"),
    ("public-domain", 60, "placed in the public domain"),
]


def wide(words: str) -> str:
    """Words between the double blanks of normalised text; a starred word may be missing."""
    out = " "
    for w in words.split():
        out += f"(?: {w[:-1]} )?" if w.endswith("*") else f" {w} "
    return out[1:]


def rules() -> list[tuple[str, str, int, str, str]]:
    """Hundreds of rules in a fixed order. The keyword gates a rule: text without it can't match."""
    out = [(f"{label}/text{i}", label, priority, wide(words), wide(words)) for i, (label, priority, words) in enumerate(TEXTS)]
    for (label, names), (s, (sentence, priority)) in product(LICENSES, enumerate(SENTENCES)):
        for n, name in enumerate(names):
            if "{} license" in sentence and not sentence.endswith("*") and name.endswith(("license", "licence")):
                continue
            out.append((f"{label}/{n}.{s}", label, priority, wide(name), wide(sentence.replace("{}", name))))
    return out
