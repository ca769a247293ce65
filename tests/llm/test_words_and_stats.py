"""Words of batches and text counts against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import ODD, WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.common import byte_view
from codeloom.llm.quality_rules import RULES, judge
from codeloom.llm.text_stats import Stats
from codeloom.llm.words import words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1cé日.|#", max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([3, 7, 1 << 20]))
def test_words(texts, limit):
    data, offsets = byte_view(pa.array(texts, pa.string()))
    w = words_of(data, offsets, limit=limit)
    got = [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(w.row, w.start, w.end, strict=True)]
    want = [(r, x) for r, t in enumerate(texts) for x in WORD.findall(t or "")]
    assert got == want
    by_word = {}
    for (_, word), h in zip(got, w.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sliced_array_and_lower_case():
    data, offsets = byte_view(pa.array(["skip", "The CAT", None, "the cat É é"]).slice(1))
    w = words_of(data, offsets, lower=True)
    assert w.row.tolist() == [0, 0, 2, 2, 2, 2]
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.hash[4] != w.hash[5]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_counts(texts):
    s = Stats(pa.array(texts, pa.string()))
    got = list(zip(*(np.asarray(c).tolist() for c in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)), strict=True))
    assert got == [counts(t) for t in texts]


def test_counts_of_odd_texts():
    columns, _, _ = judge(pa.array(ODD, pa.string()), RULES)
    got = zip(*(columns[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)
    assert list(got) == [counts(t) for t in ODD]
