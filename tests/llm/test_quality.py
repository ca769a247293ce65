"""Quality rules and the quality classifier."""

import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from cases import DOCUMENTS, ODD

from codeloom.llm import quality_model as model
from codeloom.llm import quality_rules as rules
from codeloom.llm import queries

SF = "/root/testdata/sf0.01"
GOOD = "This line has quite a few words in it and it ends well."


def test_line_rules(spark):
    lines = {"noise": "So### many*** signs&&& here%%% and$$$ there### too***.", "navigation": "Home | About | News | Contact.", "open_end": "A headline without an end",
             "boilerplate": "Please read our Privacy Policy before you go on."}
    texts = [f"{GOOD}\n{bad}\n\nAnother line of the same kind with enough words." for bad in lines.values()]
    s = rules.Stats(pa.array(texts))
    found = rules.line_failures(s, rules.RULES)
    for row, name in enumerate(lines):
        assert found[name][s.lines.row == row].tolist() == [False, True, False], name
    assert found["repeated"].sum() == 0


def test_cleaning(spark, odd, none):
    bad = "Home | About | News"
    more = "Nobody who reads it would think that such a sentence could be the work of a program."
    docs = spark.createDataFrame([(1, f"{GOOD}\n{bad}\n{more}", "en", None, 1), (2, "".join(f"{bad} {k}\n" for k in range(9)) + GOOD, None, None, None),
                                  (3, f"{GOOD} {more}", None, None, None)], DOCUMENTS)
    got = {r.doc_id: r for r in rules.clean_lines(docs).collect()}
    assert set(got) == {1, 3} and got[1].text == f"{GOOD}\n{more}" and got[3].text == f"{GOOD} {more}"
    assert {r.doc_id: r.kept for r in rules.quality_verdicts(docs).collect()} == {1: True, 2: False, 3: True}
    assert rules.clean_lines(odd).columns == odd.columns and rules.quality_verdicts(odd).count() == odd.count()
    stay = rules.quality_verdicts(odd).filter("kept").select("doc_id").collect()
    assert sorted(map(str, rules.clean_lines(odd, cut=False).select("doc_id").collect())) == sorted(map(str, stay))
    assert rules.quality_verdicts(none).count() == 0 and rules.clean_lines(none).count() == 0


PROSE = ("The river had been rising for three days before anyone in the village thought of moving the cattle to the higher fields. "
         "When they did, the bridge was gone, and the men stood on the bank and looked at the brown water, as if it might change its mind. ")
VERSE = """The wind came down the valley late
And shook the apples from the bough
It rattled at the garden gate
And no one hears the gate but now
The house is sold the orchard gone
A stranger ploughs the lower field
And still the wind goes on and on"""


def stays(texts):
    columns, s, bad = rules.judge(pa.array(texts), rules.RULES)
    return columns["kept"].tolist(), columns["n_lost_words"].tolist()


def test_open_ends_of_clean_texts():
    hindi = "यह गाँव नदी के किनारे बसा है और लोग खेती करते हैं। बच्चे रोज़ सुबह नदी पार करके स्कूल जाते हैं।"
    clean = [textwrap.fill(PROSE, 72), textwrap.fill(PROSE, 18), VERSE, PROSE.replace(".", "").strip(), hindi, "Rain\n\n" + PROSE.strip() + "\n- bread\n- salt\n- oil"]
    assert stays(clean) == ([True] * len(clean), [0] * len(clean))


def test_stacked_menus_still_go():
    menu = "Home\nAbout us\nOur Team\nContact\nCareers\nPress Room\nInvestors\nSupport\nDownloads\nShop Now\nMy Account\nHelp Centre\nSite Map\nNews Feed"
    assert stays([menu, "Home\nAbout us\nContact\n" + PROSE.strip()]) == ([False, True], [22, 3])


def test_boilerplate_in_clean_texts():
    long = " ".join([PROSE.strip()] * 6).replace("The river", "The JavaScript river", 1)
    long = " ".join(f"{w}{k}" if k % 5 == 0 and "JavaScript" not in w else w for k, w in enumerate(long.split()))
    blog = "They put the whole story in a blog in June and the design upset nobody at all, which is rare for a catalog in this part of the world."
    wrapped = textwrap.fill("She wrote the first version in an afternoon with nothing but javascript and patience, and the rest of the week went into tests.", 60)
    assert len(long.split()) > 270
    assert stays([long, blog, wrapped]) == ([True] * 3, [0] * 3)
    furniture = ["We use cookies.", "Click here to log in and read more.", "Please read our Privacy Policy before you go on."]
    assert stays([f"{line}\n{PROSE.strip()}" for line in furniture])[1] == [3, 8, 9]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    # labels of held-out rows do not matter
    upside_down = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    forest, other = model.train(docs, labels), model.train(docs, upside_down)
    assert np.array_equal(forest.value, other.value) and np.array_equal(forest.feature, other.feature)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = model.score(docs, forest).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id) for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and np.mean([p == t for p, t in judged]) > 0.95


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(3)
    x, noise = rng.normal(size=(600, 5)), rng.normal(size=600)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = model.fit(x, y, rounds=20)
    bins = forest.binned(x)

    def walk(row, node):
        while forest.left[node] != node or forest.right[node] != node:
            node = forest.left[node] if bins[row, forest.feature[node]] <= forest.bin[node] else forest.right[node]
        return forest.value[node]

    # a node's own value counts only at leaves
    slow = [forest.start + sum(walk(r, t) for t in forest.roots) for r in range(len(x))]
    assert np.allclose(slow, forest.margin(x))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95 and len(noise)


def test_odd_rows(spark, odd, none):
    known = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))] + [(None, 1), (3, None)], "doc_id long, quality int")
    forest = model.train(odd, known)
    rows = model.score(odd, forest).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert model.keep_good(odd, forest).columns == odd.columns
    assert model.score(none, forest).count() == 0
    unlearned = model.train(none, known.limit(0))
    assert {r.score for r in model.score(odd, unlearned).collect()} == {0.5}


def test_the_sample_is_bounded(spark, small, monkeypatch):
    labels, seen = spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), []
    monkeypatch.setattr(model, "fit", lambda x, y, **_: seen.append(x.shape))
    model.train(small, labels, max_rows=3)
    assert seen == [(3, len(model.FEATURES))]


def furniture_texts(documents: list[str]) -> list[str]:
    """Texts whose lines meet every rule: wrapped, verse, lists, menus, phrases side by side and inside words, ends of other scripts."""
    prose = " ".join(f"Word{i} goes on with others and ends here." for i in range(12))
    verse = "\n".join(f"The night is {a}\nand so is the sea\nCold" for a in ("dark", "deep", "long"))
    listed = "\n".join(f"{mark} item {i}" for i, mark in enumerate(("-", "*", "•", "1.", "b)", "٣.", "–")))
    menu = "Home | About | Contact\n" * 2 + "Log in sign up\nRead more\nlog in log in click here\nBlog in catalog in design up\nAccept cookies"
    ends = "\n".join(("नमस्ते दुनिया।", "مرحبا؟", "\n \nAlone", "Title", "  ", "alone", "日本", "ǅ abc", "Ⅳ", "end ]", "x \x85"))
    page = "We use cookies and JavaScript on this very long page of many words so that it all works as it has to\nall rights reserved by us\nfor ever and ever."
    texts = [prose, verse, listed, menu, ends, page, page.replace("\n", " "), "LOREM IPSUM dolor\n" * 3 + prose, "\n".join((menu, prose, ends)),
             f"{prose}\nCookies\n{prose}\nsign up, log in. (privacy policy)\n\nCOOKIES"]
    return texts + [textwrap.fill(t, 72) for t in texts] + [textwrap.fill(t, 40) for t in documents]


def test_rules_agree_with_sql(spark, small, odd):
    """Operator and check SQL on the same rows: documents as they are and wrapped, odd texts and texts for each rule.

    The windows of the SQL carry all words of a text, so the text of 1.8 MB is left to the tests of the statistics.
    """
    plain = [r.text for r in small.collect()]
    texts = [*plain, *[r.text for r in odd.collect() if len(r.text or "") < 100_000], *furniture_texts(plain)]
    given = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    got = {tuple(r[n] for n in ("doc_id", *rules.VERDICTS.names))
           for r in rules.quality_verdicts(spark.createDataFrame(given.to_pandas(), "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.register("documents", given)
    found = con.execute(f"SELECT doc_id, {', '.join(rules.VERDICTS.names)} FROM ({queries.oracle_sql()['op6_quality_rules']})").fetchall()
    assert got == set(found) and len(found) == len(texts)
    lost = {r[6] for r in found if r[0] >= len(texts) - len(plain) - 20}
    assert len(lost) > 5, "the texts must meet the rules"


def test_wrapped_clean_documents_stay(spark, small):
    """Of documents of good quality at least 95 % stay after wrapping at 72 columns."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = small.join(labels, "doc_id").filter("quality = 1").select("doc_id", "text").collect()
    wrapped = spark.createDataFrame([(r.doc_id, "\n".join(textwrap.fill(p, 72) for p in r.text.split("\n"))) for r in good], "doc_id long, text string")
    assert rules.quality_verdicts(wrapped).filter("kept").count() >= 0.95 * len(good)
