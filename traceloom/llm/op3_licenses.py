"""License scan by ordered signature rules.

A text becomes its words (A-Z lower-cased, ASCII marks dropped) joined by single spaces, so a rule sees no layout.  Every rule is a
regex with keywords and a phrase; a rule runs only on texts that hold its phrase and one of its keywords, which every match of it does.
Rules have priorities: full license sentences before named versions before bare names.  Detections are taken
in order of priority, then length, then place, and one that lies inside an interval already taken is suppressed, so "lgpl 2.1" does not
also count as a plain "gpl".
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.ship import ship

#: The phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Names as they stand in normalised words: label, pattern of the name, keyword that every match holds.
NAMES = (
    ("mit", r"(?:mit|expat)(?: x11)?", "mit expat"),
    ("mit-0", r"mit (?:0|no attribution|zero)", "mit"),
    ("x11", r"x11", "x11"),
    ("isc", r"isc", "isc"),
    ("0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)", "bsd 0bsd"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd freebsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd"),
    ("bsd", r"bsd(?: style)?", "bsd"),
    ("apache-1.1", r"apache (?:software )?(?:license )?(?:version )?(?:v )?1 1", "apache"),
    ("apache-2", r"(?:apache (?:software )?(?:license )?(?:version )?(?:v ?)?2(?: 0)?|asl 2(?: 0)?)", "apache asl"),
    ("apache", r"apache(?: software)?", "apache"),
    ("gpl-1", r"(?:gnu )?(?:gpl|general public license)(?: version)? v?1(?: 0)?", "gpl gnu general"),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license)(?: version)? ?v?2(?: 0)?(?: only)?", "gpl gplv2 gpl2 general"),
    ("gpl-2+", r"(?:gnu )?(?:gpl|general public license)(?: version)? ?v?2(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?", "gpl gplv2 gpl2 general"),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license)(?: version)? ?v?3(?: 0)?(?: only)?", "gpl gplv3 gpl3 general"),
    ("gpl-3+", r"(?:gnu )?(?:gpl|general public license)(?: version)? ?v?3(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later(?: version)?", "gpl gplv3 gpl3 general"),
    ("gpl", r"(?:gnu )?(?:gpl|general public license)", "gpl general"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: version)? ?v?2(?: 1)?", "lgpl lgplv2 lesser library"),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? ?v?3(?: 0)?", "lgpl lgplv3 lesser"),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)", "lgpl lesser library"),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license)(?: version)? ?v?3(?: 0)?", "agpl agplv3 affero"),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public license)", "agpl affero"),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation license)(?: version)?(?: 1 [123])?", "gfdl documentation"),
    ("mpl-1.1", r"(?:mpl|mozilla public license)(?: version)? ?v?1 1", "mpl mozilla"),
    ("mpl-2", r"(?:mpl|mozilla public license)(?: version)? ?v?2(?: 0)?", "mpl mozilla"),
    ("mpl", r"(?:mpl|mozilla public)", "mpl mozilla"),
    ("epl-1", r"(?:epl|eclipse public license)(?: version)? ?v?1(?: 0)?", "epl eclipse"),
    ("epl-2", r"(?:epl|eclipse public license)(?: version)? ?v?2(?: 0)?", "epl eclipse"),
    ("edl", r"eclipse distribution", "eclipse"),
    ("cddl", r"(?:cddl|common development and distribution)", "cddl common"),
    ("cpl", r"common public", "common"),
    ("cecill", r"cecill(?: [bc])?", "cecill"),
    ("eupl", r"(?:eupl|european union public)", "eupl european"),
    ("osl-3", r"(?:osl|open software license)(?: version)? ?v?3(?: 0)?", "osl open"),
    ("afl-3", r"(?:afl|academic free license)(?: version)? ?v?3(?: 0)?", "afl academic"),
    ("artistic-1", r"artistic license 1(?: 0)?", "artistic"),
    ("artistic-2", r"artistic license(?: version)? 2(?: 0)?", "artistic"),
    ("artistic", r"artistic", "artistic"),
    ("bsl-1", r"(?:boost software|bsl 1 0)", "boost bsl"),
    ("busl-1.1", r"business source license(?: 1 1)?", "business"),
    ("sspl", r"(?:sspl|server side public)", "sspl server"),
    ("elastic-2", r"elastic license(?: version)?(?: 2(?: 0)?)?", "elastic"),
    ("zlib", r"(?:zlib(?: libpng)?|libpng)", "zlib libpng"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl fuck"),
    ("psf-2", r"(?:python software foundation|psf)(?: license)?(?: version)?(?: 2(?: 0)?)?", "python psf"),
    ("php-3", r"php license(?: version)? 3(?: 0[01]?)?", "php"),
    ("ruby", r"ruby", "ruby"),
    ("vim", r"vim", "vim"),
    ("perl", r"same terms as perl(?: itself)?", "perl"),
    ("ms-pl", r"(?:ms pl|microsoft public)", "microsoft pl"),
    ("ms-rl", r"(?:ms rl|microsoft reciprocal)", "microsoft rl"),
    ("ncsa", r"(?:ncsa|university of illinois ncsa)", "ncsa"),
    ("ofl-1.1", r"(?:sil open font|ofl)(?: license)?(?: version)?(?: 1 1)?", "sil ofl"),
    ("postgresql", r"postgresql", "postgresql"),
    ("openssl", r"openssl", "openssl"),
    ("odbl", r"(?:odbl|open (?:data commons open )?database)", "odbl database"),
    ("odc-by", r"open data commons attribution", "commons"),
    ("ogl-uk-3", r"open government license(?: version)?(?: v?3(?: 0)?)?", "government"),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 zero"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)", "nd commons"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "sa commons"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "nc commons"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)", "nd commons"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "sa commons"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc commons"),
)

#: Ways in which a license is granted by name; ``{}`` is the name.  From sure to bare: priority, share of certainty, form, phrase that every match holds.
FORMS = (
    (90, 0.98, r"spdx license identifier {}", " spdx license identifier "),
    (80, 0.95, r"(?:licen[sc]ed|released|distributed|published|available|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?", " under "),
    (70, 0.9, r"(?:under|subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?{} licen[sc]e", " licen"),
    (60, 0.8, r"(?:licen[sc]e|licen[sc]ed|licen[sc]ing) (?:is |as )?{}", " licen"),
    (50, 0.7, r"{} licen[sc]es?(?: version [0-9]+(?: [0-9]+)?)?", " licen"),
)

#: Sentences of license texts: label, pattern, keyword.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "copyright"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products", "neither"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "provided"),
    ("apache-2", r"you may not use this file except in compliance with the license", "compliance"),
    ("apache-2", r"www apache org licenses license 2 0", "apache"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "distributed"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0", r"has waived all copyright and related or neighboring rights", "waived"),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim"),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "domain"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential|unauthorized copying .{1,40} is strictly prohibited)", "proprietary unauthorized"),
    ("all-rights-reserved", r"all rights reserved", "rights"),
    ("cc-by-nc", r"creativecommons org licenses by nc(?= [0-9])", "creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa", "creativecommons"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd", "creativecommons"),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons"),
    ("cc-by-nd", r"creativecommons org licenses by nd", "creativecommons"),
    ("cc-by", r"creativecommons org licenses by(?= [0-9])", "creativecommons"),
    ("cc0", r"creativecommons org publicdomain zero", "creativecommons"),
)


class Rule(NamedTuple):
    priority: int
    sure: float
    label: str
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]
    phrase: bytes


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, first those that go before others."""

    def rule(priority: int, sure: float, label: str, pattern: str, keywords: str, phrase: str = " ") -> Rule:
        return Rule(priority, sure, label, re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])"), tuple(b" " + k.encode() for k in keywords.split()), phrase.encode())

    found = [rule(100, 0.99, label, pattern, keyword) for label, pattern, keyword in SENTENCES]
    found += [rule(95, 1.0, label, phrase, phrase.split()[-2]) for phrase, label in BASE]
    for label, name, keywords in NAMES:
        found += [rule(priority, sure, label, form.format(name), keywords, phrase) for priority, sure, form, phrase in FORMS]
    return tuple(sorted(found, key=lambda r: -r.priority))


def normalise(text: str | None) -> tuple[bytes, int]:
    """The words joined and surrounded by single spaces, and their number."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    return b" " + b" ".join(words) + b" ", len(words)


def detect(norm: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in characters of ``norm``, after suppression, by start."""
    present: dict[bytes, bool] = {}

    def holds(part: bytes) -> bool:
        if part not in present:
            present[part] = part in norm
        return present[part]

    levels: dict[int, list] = {}
    for order, rule in enumerate(rules()):
        if holds(rule.phrase) and any(holds(k) for k in rule.keywords):
            levels.setdefault(-rule.priority, []).extend((m.start(), -m.end(), order, rule) for m in rule.pattern.finditer(norm))
    taken: list[tuple[int, int, Rule]] = []
    for level in sorted(levels):
        # An interval is contained in one of those that begin no later if the farthest of their ends is no nearer than its own.
        starts = [s for s, _, _ in taken]
        ends = list(accumulate((e for _, e, _ in taken), max))
        farthest = -1
        for start, minus_end, _, rule in sorted(levels[level], key=lambda h: h[:3]):
            before = bisect_right(starts, start)
            if -minus_end > max(farthest, ends[before - 1] if before else -1):
                taken.append((start, -minus_end, rule))
            farthest = max(farthest, -minus_end)
        taken.sort(key=lambda t: t[:2])
    return taken


def _scan_text(text: str | None) -> tuple:
    norm, n = normalise(text)
    places: list[int] = []
    base = set()
    for phrase, label in BASE:
        sought = b" " + phrase.encode() + b" "
        at = norm.find(sought)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = norm.find(sought, at + 1)
    found = detect(norm)
    doubt = 1.0
    for rule in {r.label: r for _, _, r in sorted(found, key=lambda f: f[2].sure)}.values():
        doubt *= 1 - rule.sure
    first, last = (norm.count(b" ", 0, min(places)), norm.count(b" ", 0, max(places))) if places else (None, None)
    labels = base | {r.label for _, _, r in found}
    # Words begin behind spaces, so a place's word is told by the spaces before it, found once for all places.
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == ord(" ")) if found else None
    words = np.searchsorted(gaps, [(s, e) for s, e, _ in found]).tolist() if found else []
    spans = [(s - 1, e, r.label, r.sure) for (s, e), (_, _, r) in zip(words, found, strict=True)]
    return n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max(1 - doubt, 1.0 if base else 0.0), spans


_FORM = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<first:bigint,end:bigint,label:string,sure:double>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections for every row of ``docs``.

    Null and empty texts have no words and empty labels, score 0.  Detections are word intervals (end exclusive) after suppression.  Base places
    are all counted, suppressed or not, and may overlap others.  Of a label detected several times the surest counts in the score.
    Repeated rows are answered alike.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(_FORM)
    def scan(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in _FORM.split(", ")]
        for texts in column:
            frame = pd.DataFrame([_scan_text(t) for t in texts], columns=names)
            frame[["first_word", "last_word"]] = frame[["first_word", "last_word"]].astype("Int64")
            frame["detections"] = [[{"first": a, "end": b, "label": c, "sure": d} for a, b, c, d in spans] for spans in frame["detections"]]
            yield frame

    return docs.select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
