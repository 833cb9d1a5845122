import random
import sys
import unicodedata
from collections import Counter

from orrery.llm.terms import _WORD, RECORD, BurstTrie, term_counts, terms


def test_word_class_is_letters_and_numbers():
    assert [c for c in map(chr, range(sys.maxunicode + 1)) if bool(_WORD.match(c)) != (unicodedata.category(c)[0] in "LN")] == []
    assert terms("Ab_c-12é ½ 語。") == ["ab", "c", "12é", "½", "語"]


def test_trie_counts_like_a_dictionary():
    rnd = random.Random(1)
    for burst in (1, 3, 50, 5000):
        trie, want = BurstTrie(burst), {}
        for _ in range(600):
            words = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(0, 7))) for _ in range(7)]
            trie.add_text(words)
            for w in words:
                want[w] = want.get(w, 0) + 1
            for w in set(words):
                want[w] += RECORD
        got = {p + s: v for p, t in trie.containers() for s, v in t.items()}
        assert got == want and trie.entries() == len(want)


def test_counts_against_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        text = rnd.choice([None, "", "a b a", "A-b c_d", "common " + str(i), "common x y", "é é"])
        rows.append((rnd.choice(["f", "g"]), rnd.choice(["s", "s", "t", None, ""]), text, "extra"))
    rows += [("f", "big", " ".join(f"w{i}" for i in range(3000)), "extra")]
    df = spark.createDataFrame(rows, "field string, scope string, text string, term string")
    occurrences, records, texts = Counter(), Counter(), Counter()
    for field, scope, text, _ in rows:
        if text is None or scope is None:
            continue
        texts[field, scope] += 1
        for t in terms(text):
            occurrences[field, scope, t] += 1
        for t in set(terms(text)):
            records[field, scope, t] += 1
    want = set()
    for key, n in records.items():
        mark = "rare" if n <= 1 else "common" if n > 0.5 * texts[key[:2]] else None
        want.add((*key, occurrences[key], n, texts[key[:2]], mark))
    # tries that burst or not, tasks that burst apart, routes that are cut further
    for burst, entries, route in ((2048, 400_000, 400_000), (4, 400_000, 400_000), (4, 20, 400_000), (300, 2000, 50), (2048, 400_000, 5)):
        got = term_counts(df.repartition(5), burst=burst, most_entries=entries, most_route=route).select("field", "scope", "term", "occurrences", "records", "texts", "mark").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert term_counts(df.limit(0)).count() == 0
