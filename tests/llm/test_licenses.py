import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioseek.llm import licenses
from folioseek.llm.common import tokens

SCANNER = licenses.Scanner()


def ids(text):
    found = tokens(pa.array([text], pa.string()), licenses.WORD)
    words = found.distinct.to_pylist()
    return np.array([SCANNER.words.get(words[c], -1) for c in found.codes], dtype=np.int64)


def test_matching_statistics_equal_brute_force():
    draw = random.Random(2)
    templates = [[draw.randrange(4) for _ in range(draw.randrange(1, 14))] for _ in range(6)]
    automaton = licenses.SuffixAutomaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(60):
        text = [draw.randrange(5) for _ in range(30)]
        for at, (state, length) in enumerate(automaton.statistics(text)):
            longest = max((n for n in range(at + 2) if tuple(text[at + 1 - n : at + 1]) in runs), default=0)
            assert length == longest
            run = text[at + 1 - length : at + 1]
            ends = {(k, e) for k, t in enumerate(templates) for e in range(len(t)) if length and e + 1 >= length and t[e + 1 - length : e + 1] == run}
            assert not length or automaton.ends[state] == ends


def base(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


NOTICE = dict(licenses.TEMPLATES)["mit-notice"]
TEXTS = [
    None, "", "...", "the gnu general public", "GNU General Public License, the Apache License; cc-by, CC BY MIT license mit license",
    "under the GNU General Public License as published by the apache_license", NOTICE, "x " * 50 + NOTICE.replace("free of charge, ", "") + " y" * 50,
    NOTICE[: len(NOTICE) // 3], "Released under the MIT License.\nReleased under the MIT License.", "é mit licenseé mit license é" * 3, "cc by " * 4000,
    "permission to deal in the sun and the software without a license of the gnu general public",
]


def test_scan_equals_brute_force(spark):
    frame = spark.createDataFrame([(i, t, "l") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scanned(frame).collect()}
    for i, text in enumerate(TEXTS):
        row = rows[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text)
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def test_changed_notice_is_one_span():
    words, changed = NOTICE.split(), NOTICE.split()
    del changed[20:23]
    changed[60] = "something"
    text = ids(" ".join(["intro"] * 7 + changed + ["outro"] * 9))
    spans = [s for s in SCANNER.spans(SCANNER.scan(text)[1]) if s[3] >= licenses.MIN_COVERAGE]
    size = SCANNER.sizes[0]
    assert len(spans) == 1 and spans[0][0] == 0 and spans[0][1] == 7 and spans[0][3] > 0.9
    assert abs(spans[0][2] - 7 - size) <= 4 and len(words) > 60


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_part_of_a_notice_gets_no_label(share):
    text = ids(NOTICE[: int(len(NOTICE) * share)])
    row = licenses.judged(text, SCANNER)
    assert row[5] == "" and abs(row[6] - share) < 0.1
