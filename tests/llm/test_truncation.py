import random

import numpy as np
import pytest

from orrery.llm import truncation
from orrery.llm.terms import terms
from orrery.llm.truncation import CONTEXTS, HELD_WORDS, Lexicon, Read, align, bands, cut_copies, ending, ends_early, levels, pieces, survey, truncation_by_source, truncations, word_counts

SCHEMA = "doc_id long, text string, source string"


def test_endings():
    for text, kind in [
        ("A b.", "ended"), ("A b!\" ", "ended"), ("A b", "plain"), ("A b...", "dots"), ("A b …", "dots"), ("A b [...]", "bracket"), ("A b ... more", "more"),
        ("A <span cla", "markup"), ("A [x](http://y", "markup"), ("A &quo", "markup"), ("A b�", "markup"), ("```\nx\n```", "ended"), ("```\nx", "markup"),
        ("A.\n- b c", "plain"), ("A.\n| b | c |", "ended"), ("A.\n| b | c", "markup"), ("A b,", "comma"), ("A b, c", "plain"), ("A. \U0001F44D", "ended"),
        ("", "empty"), (" \n", "empty"), ("あ。", "ended"), ("It weighs 44.", "plain"), ("(a b)", "ended"), ("x" * 5000 + ".", "ended"),
    ]:
        assert ending(text)[0] == kind, text


def test_copies_that_go_on():
    text = " ".join(f"w{i}" for i in range(60)) + " collection ends here. Then more"
    assert ends_early(text[: text.index("lection")], text) == 1
    assert ends_early(text[: text.index(" ends")], text) == 1
    assert ends_early(text[: text.index(" Then")], text) == 0
    assert ends_early(text, text) == -1
    assert ends_early("short", text) == 0 and ends_early("", "") == 0
    changed = text[: text.index(" ends")].replace("w59", "v59")
    assert ends_early(changed, text) == 1 and ends_early(" ".join(f"u{i}" for i in range(70)), text) == 0


def test_alignment_is_a_longest_chain():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(1, 12, 40).astype(np.uint64)
        i, j, share = align(a, np.concatenate([a[:20], rng.integers(50, 60, 3).astype(np.uint64), a[20:]]))
        assert (i, j, share) == (40, 43, 1.0)
    assert align(np.arange(9, dtype=np.uint64), np.arange(20, 29, dtype=np.uint64)) == (0, 0, 0.0)


def test_bands_of_beginnings_are_those_of_the_shorter_text():
    runs = np.random.default_rng(2).integers(1, 2**63, 300).astype(np.uint64)
    edges = np.array([0, 0, 3, 3, 100, 104, 111, 300, 300])
    row, every = bands(runs, edges)
    want = []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        for size in levels(b - a):
            at, key = bands(runs[a : a + size], np.array([0, size]), longest=True)
            values = (runs[a : a + size][None, :] * truncation._SEEDS[:, None]).min(axis=1)
            want.append((i, size, key[0].tolist()))
            assert at.tolist() == [0] and len(set(values.tolist())) > 1
    assert row.tolist() == [w[0] for w in want] and every.tolist() == [w[2] for w in want]
    # the keys are those of the least values
    one, two = (bands(x, np.array([0, 8]), longest=True)[1] for x in (runs[:8], runs[:8][::-1].copy()))
    assert (one == two).all() and (one != bands(runs[1:9], np.array([0, 8]), longest=True)[1]).any()
    assert levels(3) == [] and bands(runs[:2], np.array([0, 2]))[1].shape == (0, truncation.BANDS)


NOUNS = ["cluster", "planner", "mattress", "gardener", "village", "orchard", "painter", "engine", "harbor", "cellar", "bridge", "lantern"]


def sentence(rnd):
    a, b, c = (rnd.choice(NOUNS) for _ in range(3))
    return rnd.choice([f"The {a} watches a {b} behind the {c}.", f"Without this {a}, every {b} must wait for the {c}.", f"It is the {a}, not the {b}, that needs another {c}."])


def corpus():
    rnd = random.Random(3)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rnd) for _ in range(rnd.randrange(4, 12)))
        source = rnd.choice([" Forum", "forum", "wiki", None])
        if source and "orum" in source and len(text) > 300:
            if text[299] not in ".":
                cut.add(i)
            text = text[:300]
        elif rnd.random() < 0.05:
            at = rnd.randrange(60, len(text) - 2)
            if text[at - 1] not in ". ":
                text = text[:at]
                cut.add(i)
        elif rnd.random() < 0.05:
            text = text[:-1]
        elif rnd.random() < 0.1:
            text += rnd.choice(["\n\nThanks\n-- ", "\n\nBest, "]) + rnd.choice(["Ada", "Kurt", "Emmy", "Alonzo"]) + str(i)
        elif rnd.random() < 0.1:
            text += "\n\n- " + "\n- ".join(f"{rnd.choice(NOUNS)} {rnd.choice(NOUNS)}" for _ in range(3))
        rows.append((i, text, source, "x"))
    return rows + [(5000, None, "wiki", "x"), (5001, "", "wiki", "x"), (5002, "", None, "x"), (5002, "", None, "x")], cut


def test_cut_documents_are_found(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bands string")
    got = truncations(df).collect()
    assert len(got) == len(rows) - 1
    found = {r.doc_id for r in got if r.truncated}
    assert len(found & cut) >= 0.95 * len(cut) and len(found & cut) >= 0.93 * len(found), (len(cut), len(found), len(found & cut))
    shares = {r.source: r for r in truncation_by_source(df).collect()}
    assert set(shares) == {"forum", "wiki", None} and shares["forum"].share > 0.5 > 0.2 > shares["wiki"].share
    assert truncations(df.limit(0)).count() == 0
    # the same rows in other partitions give the same result
    assert {r.doc_id for r in truncations(df.repartition(7)).filter("truncated").collect()} == found


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_near_copies_cut_anywhere_are_found_by_alignment(spark, edits):
    rnd = random.Random(11 + edits)
    rows, planted = [], set()
    for i in range(160):
        words = []
        while len(words) < 90:
            words += sentence(rnd).split()
        words = [w if rnd.random() < 0.5 else f"{w.strip('.,')}{rnd.randrange(400)}{w[len(w.strip('.,')):]}" for w in words]
        copy = list(words)
        for _ in range(edits):
            copy[rnd.randrange(len(copy))] = f"other{rnd.randrange(99)}"
        text = " ".join(words)
        at = int(len(text) * rnd.uniform(0.3, 0.95))
        while text[at - 1] in ". ,":
            at -= 1
        rows += [(2 * i, " ".join(copy), "a"), (2 * i + 1, text[:at], "b")]
        a, b = (set(zip(*(terms(t)[k:] for k in range(5)), strict=False)) for t in (text[:at], " ".join(copy)))
        if len(a & b) >= 0.8 * len(a):  # a near-copy
            planted.add(2 * i + 1)
    assert len(planted) > 100
    got = {r.doc_id for r in truncations(spark.createDataFrame(rows, SCHEMA)).filter("copy = 1").collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 0.02 * len(planted), (len(got & planted), len(got - planted))


def test_no_word_is_dropped_from_the_counts(spark):
    rare = [f"x{chr(97 + i % 26)}{i}" for i in range(25_000)]
    texts = [" ".join(rare[at : at + 100]) + "." for at in range(0, len(rare), 100) for _ in range(6)]
    texts += ["They inform us with zyxwvutable ink." for _ in range(4)] + ["No information here." for _ in range(100)] + ["All is said. Please zyxwvut"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    for held in (HELD_WORDS, 50):
        counts = word_counts(df, held)
        n = {r.word: r.n for r in counts.collect()}
        assert all(n[w] == 6 for w in rare) and n["inform"] == 4 and "zyxwvut" not in n
        asked = spark.createDataFrame([("inform",), ("zyxwvut",), ("none",), (None,)], "word string")
        assert {tuple(r) for r in pieces(asked, counts).collect()} == {("inform", 4, 100), ("zyxwvut", 0, 4), ("none", 0, 0)}


def test_surveys_equal_plain_counting(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "a", "Cat", "sits.", "7", "down,"]) for _ in range(30)) for _ in range(200)]
    read = Read(texts, Lexicon({"the", "a"}))
    keys = read.contexts()
    want = {}
    for at in range(len(read.row)):
        if read.closes[at] or not read.last[at]:
            for key in keys[:, at].view("int64").tolist():
                seen, closed = want.get(key, (0, 0))
                want[key] = seen + 1, closed + int(read.closes[at])
    asked = {k: v for i, (k, v) in enumerate(sorted(want.items())) if i % 3 == 0}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keys = lambda values: spark.createDataFrame([(k,) for k in values], "key long")
    for most in (1 << 15, 1 << 27):
        got = survey(df, {"the", "a"}, keys([*asked, 77]), keys([1]), most).filter("kind = 0").collect()
        found = {r.key: (r.seen, r.closed) for r in got}
        assert {k: found[k] for k in asked} == asked and all(found[k] == want[k] for k in found)
    assert len(Read(["", "a", "  "], Lexicon(set())).contexts()[0]) == 1 and Read([""], Lexicon(set())).contexts().shape == (CONTEXTS, 0)


def test_a_hot_band_loses_no_partner(spark):
    words = [f"w{i}" for i in range(80)]
    text = " ".join(words)
    # very many texts share band and last words with the asked one, few go on there
    rows = [(i, text + f". Another{i} text.") for i in range(120)] + [(500, text), (501, text), (502, text + " goes on here."), (503, "Quite another text that nobody ever copied in this table")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.copy for r in truncations(df).collect()}
    assert got[500] == got[501] == 1 and got[503] is None
    asked = spark.createDataFrame([(1, 10, 500)], "key long, sig long, doc_id long")
    answers = spark.createDataFrame([(1, 1000 + i, i) for i in range(120)] + [(1, 10, 500), (1, 9999, 502)], "key long, sig long, doc_id long")
    for step in (2, 4, 500):
        assert [r.sig for r in cut_copies(df, asked, answers, step).collect()] == [10]
