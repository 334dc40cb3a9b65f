import random
import re

import numpy as np
import pytest

from tarnlake.llm import licenses as C

SPACE = "\t\n\x0b\x0c\r "


@pytest.fixture(scope="module")
def model():
    return C.train()


def judged(ws_grams, model):
    """(family, status, probability) of a unit with these n-grams, or nothing without features."""
    at = [i for i, g in enumerate(model.vocabulary) if g in ws_grams]
    if not at:
        return None
    z = (model.weights[at].sum(0) + model.bias) / model.temperature
    said = {re.sub(C.ZEROS, "", m[1]) for m in (re.match(C.VERSION, g) for g in ws_grams) if m}
    for i, c in enumerate(model.classes):
        if said and c in C.VERSIONS and not said & set(C.VERSIONS[c]):
            z[i] = C.REFUTED
    p = np.exp(z - z.max())
    p /= p.sum()
    share = {c: max([0.0, *(len(set(t) & ws_grams) / len(t) for f, t in model.templates if f == c)]) for c in model.classes}
    top = model.classes[int(p.argmax())]
    if p[-1] >= C.UNLIKELY:
        return "none", "none", p.max()
    if p.max() >= C.SURE and top not in ("unknown", "none") and share[top] >= C.CONFIRMED and share[top] >= max(share.values()):
        return top, "confirmed", p.max()
    return "unknown", "unknown", p.max()


def brute(text, model):
    """families and spans of a text, line by line and paragraph by paragraph."""
    lines, at = [], 0
    for x in (text or "").split("\n"):
        lines.append((at, x))
        at += len(x) + 1
    parts, part = [], []
    for start, x in [*lines, (0, "")]:
        if x.strip(SPACE):
            part.append((start, x))
        elif part:
            parts.append(part)
            part = []
    out = []
    for part in parts:
        units = []
        for start, x in part:
            units.append((0, start, start + len(x), judged(C.grams(C.words(x)), model)))
        if len(part) > 1:
            gs, last = set(), None
            for _, x in part:
                ws = C.words(x)
                gs |= C.grams(ws)
                if ws and last:
                    gs.add(f"{last} {ws[0]}")
                last = ws[-1] if ws else None
            units.append((1, part[0][0], max(s + len(x) for s, x in part), judged(gs, model)))
        units = [u for u in units if u[3] and u[3][1] != "none"]
        line_ok = any(u[0] == 0 and u[3][1] == "confirmed" for u in units)
        whole_ok = any(u[0] == 1 and u[3][1] == "confirmed" for u in units)
        some = any(u[0] == 0 for u in units)
        for kind, a, b, (family, status, _) in units:
            if kind == 0 and (status == "confirmed" or line_ok or not whole_ok) or kind == 1 and (not line_ok if status == "confirmed" else not some):
                out.append((a, b, family))
    return ",".join(f"{f}:{a}:{b}" for a, b, f in sorted(out))


def wrap(text, n):
    ws = text.split(" ")
    return "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))


def test_against_brute_force(docs_of, odd, model):
    rng = random.Random(1)
    notices = [t for ts in C.NOTICES.values() for t in ts] + C.OTHER_LICENCES + C.OTHERS
    texts = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            t = rng.choice(notices)
            parts.append(rng.choice([t, t.upper(), wrap(t, rng.randint(2, 9)), "-----", "", " ", "plain words é of text"]))
        texts.append(rng.choice(["\n", "\n\n"]).join(parts))
    docs = docs_of([(k, t) for k, t in enumerate(texts)]).unionByName(odd)
    got = C.scan(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        want = {brute(t, model) for i, t in [(k, t) for k, t in enumerate(texts)] + [(x.doc_id, x.text) for x in odd.select("doc_id", "text").collect()] if i == r.doc_id}
        assert r.spans in want
        assert sorted({s.split(":")[0] for s in r.spans.split(",") if s}) == r.families and r.n_confirmed + r.n_unknown == len([s for s in r.spans.split(",") if s])


def test_families(docs_of, none, model):
    rows = [
        (1, "first line\nReleased under the MIT License.\nlast"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "the doctor lost his license in the war"), (5, "Licensed under the Wombat Accord License 9"), (6, None), (7, ""), (8, "no notice at all\n\n"), (None, "All rights reserved."),
        (9, "é\nLicensed under the Apache License, Version 2.0.\nAll rights reserved."), (9, "Released under the MIT License."),
        (10, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
        (11, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'),
        (12, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), (13, "Released under the Eclipse Public License 2.0"), (14, "The MIT license was discussed by the committee"),
        (15, "Der Text steht unter einer freien Lizenz, siehe unten"), (16, "Veröffentlicht unter einer Lizenz"),
    ]
    by = {}
    for r in C.scan(docs_of(rows), model).collect():
        by.setdefault(r.doc_id, []).append(r.families)
    assert by[1] == [["mit"]] and by[2] == [["cc-by-nc"]] and by[3] == [["gpl-3.0"]]
    assert by[4] == by[6] == by[7] == by[8] == by[14] == [[]]
    assert by[5] == [["unknown"]] and by[None] == [["proprietary"]] and sorted(by[9]) == [["apache-2.0", "proprietary"], ["mit"]]
    assert by[10] == [["isc"]] and by[11] == [["mit"]] and by[12] == [["bsd"]] and by[13] == [["epl"]]
    assert by[15] == [["unknown"]] and by[16] == [[]]  # one word of evidence in another language is not enough
    assert C.scan(none, model).count() == 0


def test_versions_decide(docs_of, model):
    rows = [
        (1, "Licensed under the Apache License, Version 1.1"), (2, "Licensed under the Apache License, Version 2.0"), (3, "GNU General Public License version 2"), (4, "SPDX-License-Identifier: GPL-2.0-only"), (5, "Released under version 2 of the GNU GPL"), (6, "Released under the GNU General Public License, version 3"),
        (7, "Licensed under the Apache License,\nVersion 1.1"), (8, "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."), (9, "Licensed under the Mozilla Public License 1.1"), (10, "SPDX-License-Identifier: Apache-1.1"), (11, "Todos los derechos reservados"), (12, "Available under the same conditions as Perl itself"), (13, "SPDX-License-Identifier: 0BSD"), (14, "Licensed under the Apache License, Version 3.0"), (15, "Licensed under GPLv4"),
    ]
    by = {r.doc_id: r.families for r in C.scan(docs_of(rows), model).collect()}
    assert by[2] == ["apache-2.0"] and by[3] == by[4] == by[5] == by[8] == ["gpl-2.0"] and by[6] == ["gpl-3.0"] and by[11] == ["proprietary"]
    assert all(by[i] == ["unknown"] for i in (1, 7, 9, 10, 12, 13, 14, 15)), by


@pytest.mark.parametrize("family", ["mpl-2.0", "gpl-2.0", "isc"])
def test_families_never_seen_are_not_confirmed_as_others(family, monkeypatch):
    """Recall and false confirmations of a family whose notices are left out of training."""
    own = C.NOTICES[family]
    monkeypatch.setattr(C, "NOTICES", {f: ts for f, ts in C.NOTICES.items() if f != family})
    other = C.train()
    got = [judged(C.grams(C.words(t)), other) or ("none", "none", 1) for t in own]
    assert sum(g[1] != "none" for g in got) >= 0.6 * len(got)
    assert sum(g[1] == "confirmed" for g in got) <= 0.2 * len(got), got


def test_held_out_notices_and_ordinary_text(model):
    """Notices that are nowhere in the training texts, and talk that isn't either."""
    notices = {
        "mit": ["This package is distributed under the MIT license, see the file", "The code is MIT licensed"], "apache-2.0": ["The project is available under the Apache License 2.0", "Source is Apache-2.0 licensed, Licensed under the Apache License, Version 2.0 (the License)"],
        "gpl-3.0": ["This script is released under the GNU General Public License version 3", "Licensed under the terms of the GNU General Public License"], "bsd": ["The library is released under the BSD 3-clause license"], "cc-by": ["All images are licensed under CC BY 4.0"],
        "cc-by-sa": ["The article is licensed under CC BY-SA 4.0"], "proprietary": ["Copyright 1999 by the publisher. All rights reserved."], "public-domain": ["The text was released into the public domain"],
    }
    hit = [judged(C.grams(C.words(t)), model)[1] != "none" for ts in notices.values() for t in ts]
    right = [judged(C.grams(C.words(t)), model)[0] in (f, "unknown") for f, ts in notices.items() for t in ts]
    assert sum(hit) >= 0.9 * len(hit) and sum(right) >= 0.9 * len(right)
    plain = ["the ship left the harbour under a grey sky", "he used the software to write a copy of the report", "the general of the army spoke in public about his work", "a commons for all people of the village", "the source code of the program was printed in the book", "she reserved the right to change her mind", "permission was granted by the king", "the notice was lost", "use of the road is free of charge", "the licence of the driver was taken by the police"]
    assert sum((judged(C.grams(C.words(t)), model) or ("none",))[0] == "none" for t in plain) >= 9
    assert re.match(r"\w+", C.UNKNOWN)
