"""License scans: exact base phrases and fuzzy search for short notices.

A notice may be written with a few edits.  It is split into edits + 1 pieces, so that by the
pigeonhole principle at least one piece stands unchanged in every such writing; an Aho-Corasick
automaton over all pieces locates them, and the regex library's bounded-error matching verifies
the surroundings of each hit and reports span and edits.  Texts are normalised to lower-case words
joined by one space first, so that line breaks and punctuation in a notice don't count.

Every place where a piece stands is a window of its own, in which the best match is looked for, so that
a better match elsewhere hides none.  Of found matches that overlap, the one of fewest edits for its
length stays; ties go to the longer one, then to the earlier one, then to the label first in the
alphabet.

Nulls and empty texts have no words, no places and score 0.  Repeated rows give repeated results; an
empty table gives none.  Texts of any length are read whole.  Columns other than the two named ones,
whatever their names, are not read.
"""

from __future__ import annotations

import bisect

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import LOWER, arrow_map, raw_bytes

#: Bytes that aren't part of a word become spaces, A-Z become a-z.
FOLD = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else LOWER[b] for b in range(256))

#: Phrases whose places are counted, and their labels (fixed by the query's contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
_SPDX = "mit apache-2.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 agpl-3.0 mpl-2.0 bsd-2-clause bsd-3-clause isc epl-2.0 cc0-1.0 unlicense bsl-1.0 zlib"


def _families() -> list[tuple[str, str]]:
    """Notices that follow a rule: versions of the GNU and Creative Commons licenses, SPDX lines."""
    out = []
    for label, name, versions in (("gpl", "gnu general public license", "2 3"), ("lgpl", "gnu lesser general public license", "2.1 3"), ("agpl", "gnu affero general public license", "3")):
        for v in versions.split():
            v = v.replace(".", " ")
            out += [(label, f"licensed under the {name} version {v}"), (label, f"terms of the {name} version {v}")]
        out += [(label, f"under the terms of the {name} as published by the free software foundation"), (label, f"you should have received a copy of the {name}"), (label, name) if label != "gpl" else (label, f"this program is free software under the {name}")]
    for code, name in _CC.items():
        short = code.replace("-", " ")
        out += [(f"cc-{code}", f"creative commons {name} {v} 0 {where} license") for v in "34" for where in ("international", "unported")]
        out += [(f"cc-{code}", f"licensed under cc {short} {v} 0") for v in "234"] + [(f"cc-{code}", f"creativecommons org licenses {short} 4 0")]
    out += [("spdx-" + x, "spdx license identifier " + x.replace("-", " ").replace(".", " ")) for x in _SPDX.split()]
    return out


#: Notices that are searched with errors: label, words.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("cddl", "common development and distribution license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("bsl", "distributed under the boost software license version 1 0"),
    ("artistic", "this is free software under the artistic license"),
    ("psf", "python software foundation license agreement"),
    ("ofl", "licensed under the sil open font license"),
    ("odbl", "made available under the open database license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc0", "licensed under cc0 1 0 universal"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("cc", "licensed under a creative commons attribution"),
    ("public-domain", "this work is in the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("all-rights-reserved", "no part of this publication may be reproduced"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    *_families(),
]
#: One edit for so many characters of a notice.
PER_EDIT = 12


def pigeonhole(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in edits + 1 pieces, with their places."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Automaton and patterns of a list of notices; made once per worker."""

    def __init__(self, notices: list[tuple[str, str]], per_edit: int):
        self.notices = [(label, text, len(text) // per_edit) for label, text in notices]
        self.patterns = [regex.compile(rf"(?be)(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?![^ ])") for _, text, edits in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.notices):
            for at, piece in pigeonhole(text, edits):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in the normalised text, the best of overlapping ones."""
        windows = {(k, last - size + 1 - at) for last, (size, of) in self.automaton.iter(text) for k, at in of}
        found = set()
        for k, start in windows:
            label, notice, edits = self.notices[k]
            # wide enough that a match can't end with the window, but in the middle of a word
            a, b = max(0, start - edits - 1), min(len(text), start + len(notice) + 2 * edits + 2)
            if (m := self.patterns[k].search(text, a, b)) and (m.end() < b or b == len(text) or text[b] == " "):
                n = sum(m.fuzzy_counts)
                found.add((n / len(notice), m.start() - m.end(), m.start(), label, n))
        out: list[tuple[int, int, str, int]] = []
        for _, size, start, label, n in sorted(found):
            end = start - size
            at = bisect.bisect_left(out, (start,))
            if (not at or out[at - 1][1] <= start) and (at == len(out) or out[at][0] >= end):
                out.insert(at, (start, end, label, n))
        return [(label, start, end, n) for start, end, label, n in out]


def base_places(words: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(index of the first word, label) of each place; `words` are joined by one space, with one at both ends."""
    out = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = words.find(needle)
        while at >= 0:
            out.append((words.count(b" ", 0, at + 1) - 1, label))
            at = words.find(needle, at + 1)
    return sorted(out)


_scanners: dict = {}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,start:long,end:long,edits:long>>, labels array<string>, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per document: places of base phrases, fuzzy spans (in the normalised text), labels and score.

    The score is 1 where a base phrase or an unedited notice stands, else 1 less the share of edited
    characters of the best span, 0 without any.  One pass, no shuffle.
    """
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base
    key = (tuple(notices), per_edit)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _scanners:
            _scanners[key] = Scanner(notices, per_edit)
        scanner, rows = _scanners[key], []
        for raw in raw_bytes(batch.column("text")):
            words = (raw or b"").translate(FOLD).split()
            joined = b" " + b" ".join(words) + b" "
            places = base_places(joined, base)
            spans = scanner.spans(joined[1:-1].decode("utf-8")) if words else []
            found, own = {label for _, label in places}, {s[0] for s in spans}
            sizes = {(label, s, e, k): 1 - k / max(1, e - s) for label, s, e, k in spans}
            rows.append((len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), sorted(found), [{"label": a, "start": b, "end": c, "edits": d} for a, b, c, d in spans], sorted(found | own), 1.0 if places else max(0.0, max(sizes.values(), default=0.0))))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])), pa.list_(pa.string()), pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "labels", "score"])

    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), scan, SCHEMA)
