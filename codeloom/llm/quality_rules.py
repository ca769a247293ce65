"""Quality rules, lines first: a line goes if a punctuation, navigation or boilerplate rule finds against it, and a text
goes if it loses too many of its words that way.

An open end or a phrase of page furniture is weak evidence: such a line goes only if ``weighed`` finds more against it.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from codeloom.llm.common import prepare
from codeloom.llm.text_stats import Stats, ends_sentence, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# a line of punctuation and symbols, a bar or arrow between every few words, and phrases of page furniture
NOISE = table(b"#*$%&|<>!~^=_{}[]\\@")
SEPARATOR = table(b"|<>")
BOILERPLATE = ("cookie policy", "cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved",
               "javascript", "subscribe to our newsletter", "click here", "read more", "share this", "sign up", "log in", "lorem ipsum")
RULES = {"noise_share": 0.08, "separator_share": 0.15, "open_end_words": 0, "max_loss": 0.5,
         "few_words": 3, "short_words": 10, "phrase_share": 0.25}
LIST_ITEM = re.compile(r"\s|[-*+•‣–—]\s|(?:\d+|\w)[.)]\s")

VERDICTS = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                      ("n_repeat_words", pa.int64()), ("n_lost_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def line_failures(s: Stats, rules: dict) -> dict[str, np.ndarray]:
    """Flags of each line of the batch, by rule."""
    lines, words = s.lines, np.maximum(s.line_words, 1)
    starts, ends = s.line_last

    def inside(flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags[s.data])
        return np.bincount(np.searchsorted(lines.start, at, "right") - 1, minlength=len(lines.row)) if len(at) else np.zeros(len(lines.row))

    failures = {
        "noise": inside(NOISE) > rules["noise_share"] * (lines.end - lines.start),
        "navigation": inside(SEPARATOR) > rules["separator_share"] * words,
        "open_end": (s.line_words > rules["open_end_words"]) & ~ends_sentence(s.data, ends, starts),
        "repeated": s.line_repeats,
    }
    whole = pa.LargeStringArray.from_buffers(len(lines.row), pa.py_buffer(np.append(lines.start, len(s.data)).astype(np.int64)), pa.py_buffer(s.data))
    found = np.zeros(len(lines.row), bool)
    if len(lines.row):
        # lines follow each other with newlines between, so the next start bounds a line
        pattern = "|".join(re.escape(p) for p in rules.get("boilerplate", BOILERPLATE))
        found = pc.match_substring_regex(whole, pattern, ignore_case=True).to_numpy(zero_copy_only=False)
    failures["boilerplate"] = found
    return failures


@cache
def ends_of_all_scripts() -> frozenset[str]:
    """Full stops, closing brackets and quotes, colons and ellipses of Unicode."""
    every = "".join(chr(c) for c in range(0x11_0000) if not 0xD800 <= c < 0xE000)
    return frozenset(regex.findall(r"[\p{Sentence_Terminal}\p{Pe}\p{Pf}]", every)) | set(":;…\"'：；")


@cache
def _phrases(phrases: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)", re.IGNORECASE)


def weighed(s: Stats, failures: dict[str, np.ndarray], rules: dict) -> np.ndarray:
    """Which lines go, with open ends and boilerplate looked at in their surroundings.

    A line with an open end goes if it has few words, is neither a list item nor indented nor part of a wrapped paragraph, and
    no line next to it has more words and stays. A line with a boilerplate phrase at word borders goes if such phrases are a
    good share of its words, or if it is short and not part of a wrapped paragraph.
    """
    lines, n = s.lines, len(s.lines.row)
    bad = failures["noise"] | failures["navigation"] | failures["repeated"]
    ends, raw = ends_of_all_scripts(), s.data

    def shown(k: int) -> str:
        return raw[lines.start[k]:lines.end[k]].tobytes().decode()

    def starts_anew(k: int) -> bool:
        """A letter without case may go on with a sentence."""
        first = shown(k).lstrip()[:1]
        return not first.isalpha() or first.isupper()

    def in_paragraph(k: int) -> bool:
        """Whether line k goes on with the one before it or goes on in the one after it."""
        before = k > 0 and lines.row[k - 1] == lines.row[k] and lines.end[k - 1] + 1 == lines.start[k]
        after = k + 1 < n and lines.row[k + 1] == lines.row[k] and lines.end[k] + 1 == lines.start[k + 1]
        return before and not starts_anew(k) or after and not starts_anew(k + 1)

    for k in np.flatnonzero(failures["boilerplate"] & ~bad).tolist():
        line = shown(k)
        words = sum(len(m.group().split()) for m in _phrases(tuple(rules.get("boilerplate", BOILERPLATE))).finditer(line))
        bad[k] = words and (words >= rules["phrase_share"] * s.line_words[k] or s.line_words[k] <= rules["short_words"] and not in_paragraph(k))
    many = (s.line_words > rules["few_words"]) & ~bad
    beside = np.zeros(n, bool)
    same = lines.row[1:] == lines.row[:-1]
    beside[1:] |= many[:-1] & same
    beside[:-1] |= many[1:] & same
    for k in np.flatnonzero(failures["open_end"] & (s.line_words <= rules["few_words"]) & ~beside & ~bad).tolist():
        line = shown(k)
        bad[k] = line.rstrip()[-1:] not in ends and not LIST_ITEM.match(line) and starts_anew(k) and not in_paragraph(k)
    return bad


def judge(texts, rules: dict) -> tuple[dict[str, np.ndarray], Stats, np.ndarray]:
    """(columns of VERDICTS, statistics, which lines fail) of a batch of texts."""
    s = Stats(texts)
    failures = line_failures(s, rules)
    bad = weighed(s, failures, rules)
    lost = s.by_row(s.lines.row[bad], s.line_words[bad]).astype(np.int64) if bad.any() else np.zeros(s.n, np.int64)
    base = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words)
    kept = ~base & (lost <= rules["max_loss"] * s.n_words)
    return ({"n_words": s.n_words, "word_chars": s.word_chars, "n_symbols": s.n_symbols, "n_dup_lines": s.n_dup_lines,
             "n_repeat_words": s.n_repeat_words, "n_lost_words": lost, "base_failed": base, "kept": kept}, s, bad)


def quality_verdicts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rules: dict | None = None) -> DataFrame:
    """The key and the columns of VERDICTS for every row.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated runs of 8 words. ``kept`` is false for those
    and for texts that lose more than ``max_loss`` of their words with their bad lines. Null and empty texts have no words
    and fail. Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    rules = RULES | (rules or {})
    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))

    def run(batches):
        for batch in batches:
            columns, _, _ = judge(batch.column("text"), rules)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(columns[f.name], f.type) for f in VERDICTS]], names=["key", *VERDICTS.names])

    kind = rows.schema["key"].dataType.simpleString()
    shown = ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in VERDICTS)
    return rows.mapInArrow(run, f"key {kind}, {shown}").withColumnRenamed("key", key)


def clean_lines(docs: DataFrame, *, text: str = "text", rules: dict | None = None, cut: bool = True) -> DataFrame:
    """The rows that stay, all columns as they are but for the text, which loses its bad lines if ``cut``."""
    prepare(docs.sparkSession)
    rules = RULES | (rules or {})

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            columns, s, bad = judge(batch.column(place), rules)
            if cut and bad.any():
                batch = batch.set_column(place, batch.schema.field(place), _without(batch.column(place), s, bad))
            yield batch.filter(pa.array(columns["kept"]))

    return docs.mapInArrow(run, docs.schema)


def _without(texts: pa.Array, s: Stats, bad: np.ndarray) -> pa.Array:
    """The texts without their bad lines; a text without any stays the same to the byte."""
    hit = np.zeros(s.n, bool)
    hit[s.lines.row[bad]] = True
    gone = {(int(r), int(a)) for r, a in zip(s.lines.row[bad], s.lines.start[bad] - s.offsets[s.lines.row[bad]], strict=True)}
    out = texts.to_pylist()
    for row in np.flatnonzero(hit):
        kept, at = [], 0
        for line in out[row].encode().split(b"\n"):
            if (int(row), at) not in gone:
                kept.append(line)
            at += len(line) + 1
        out[row] = b"\n".join(kept).decode()
    return pa.array(out, texts.type)
