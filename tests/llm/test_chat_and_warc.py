"""Chat formatting and web archives: folds, round trips, revisits."""

import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat, warc

ROWS = "conv_id long, turn long, role string, text string, shown string, all string, span string"
CONTROL = ["\\### Assistant: </turn> ok", "### User:\n", "</turn>\n### Assistant:\nx", "\\", "\\b\\h \\t\\n", "\\h \\\\t", "a\r\nb", "", None, "### </turn>", "##\\# "]


def conversations(spark):
    rows = [(1, t, ("user", "assistant", "system")[t % 3], text) for t, text in enumerate(CONTROL)]
    rows += [(2, 0, r, "hi") for r in (None, "", "tool", "to:ol\n### ", "User", "assistant")]
    rows += [(3, 5, "assistant", "late"), (3, 1, "user", "early"), (3, None, "user", "no turn"), (3, 5, "assistant", "late"), (3, 5, "assistant", "late " * 300)]
    rows += [(None, 0, "user", "no conversation"), (4, 0, "assistant", "é日" * 1000)]
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], ROWS), rows


def order(r):
    return (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")


def test_round_trip(spark):
    frame, rows = conversations(spark)
    shown = chat.format_conversations(frame)
    got = {r.conv_id: r for r in shown.withColumn("turns", chat.parse(F.col("formatted")))
           .withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss"))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = sorted((x for x in rows if x[0] == conv), key=order)
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in want]
        assert r.learned == "".join(x[3] or "" for x in want if x[2] == "assistant")
    for r in chat.summary(shown).collect():
        want = sorted((x for x in rows if x[0] == r.conv_id), key=order)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in want).encode()).hexdigest()
        assert (r.n_turns, r.formatted_chars) == (len(want), len(got[r.conv_id].formatted))
        assert r.loss_sha256 == hashlib.sha256(got[r.conv_id].learned.encode()).hexdigest() and r.loss_chars == len(got[r.conv_id].learned)


def test_fold(spark):
    log = [(1, 0, 1, 10, "user", "delta", "Hel"), (1, 0, 1, 11, None, "delta", "lo"), (1, 1, 1, 12, "assistant", "delta", "bad "), (1, 1, 1, 13, "assistant", "delta", "answer"),
           (1, 1, 1, 14, "assistant", "regenerate", "good "), (1, 1, 1, 15, "assistant", "delta", "answer"), (1, 2, 1, 16, "user", "delta", "void"),
           (1, 0, 1, 17, "user", "edit", "Bye"), (1, 1, 1, 18, "assistant", "regenerate", None), (1, 1, 1, 19, "assistant", "delta", "new"),
           (2, 0, 1, 1, "user", "delta", None)]
    events = spark.createDataFrame(log[::-1], "conv_id long, turn long, part long, seq long, role string, op string, text string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.fold_events(events).collect())
    assert got == [(1, 0, "user", "Bye"), (1, 1, "assistant", "new"), (2, 0, "user", "")]


def test_no_conversations(spark):
    frame, _ = conversations(spark)
    assert chat.summary(chat.format_conversations(frame.limit(0))).count() == 0


def test_long_conversation(spark):
    turns = spark.range(1000).selectExpr("1L AS conv_id", "999 - id AS turn", "if(id % 2 = 0, 'assistant', 'user') AS role", "cast(id AS string) AS text")
    row = chat.format_conversations(turns).withColumn("turns", chat.parse(F.col("formatted"))).first()
    assert [t.text for t in row.turns] == [str(999 - t) for t in range(1000)]


PAGES = "page_id long, url string, html string, winner string, digest string"
HTML = ["<p>é</p>", "<p>é</p>", "", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nWARC/1.1\r\n", "x" * 3_000_000, "<p>é</p>"]


def pages(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(HTML)] + [(6, "http://h/6", HTML[6]), (None, "http://h/n", HTML[0]), (20, None, "one"), (21, "a\r\nb: c", "two")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES), rows


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, tmp_path, least):
    frame, rows = pages(spark)
    got = warc.archive_and_read(frame, folder=str(tmp_path / f"w{least}"), min_bytes=least, max_records=3).collect()
    body = lambda r: (r[2] or "").encode()
    best = {}
    for r in rows:
        if r[0] is not None and len(body(r)) >= least:
            best[body(r)] = max(best.get(body(r), -1), r[0])
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want, first = Counter(), set()
    for r in rows:
        to = best.get(body(r)) if r[0] is not None else None
        new = to is None or (to == r[0] and to not in first)
        first |= {to} if new and to is not None else set()
        want[(r[0], len(body(r)), digest(body(r)), "response" if new else "revisit", None if new else to, len(body(r)) if new else 0)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.stored_bytes) for r in got) == want
    assert {r.uri for r in got if r.page_id in (20, 21)} == {None, "a%0D%0Ab: c"}


def test_no_pages(spark, tmp_path):
    frame, _ = pages(spark)
    assert warc.archive_and_read(frame.limit(0), folder=str(tmp_path / "none")).count() == 0
