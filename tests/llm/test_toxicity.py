import math
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from palimpsest.llm import toxicity
from palimpsest.llm.toxicity import AS_IS, DROP, REPEAT, SEPARATORS, SIGN, STANDS_FOR, Letters, Model, classify, features, fit, letters_of, odds_of, op4_toxicity, tokens_of, trigrams, words_in, words_of

DOCS = "doc_id long, text string, toxic int"


def of_words(words):
    return Letters(trigrams(words), words)


def test_letters_of_a_table_are_those_of_its_texts(spark):
    texts = ["The cat, the CAT! (sat)", None, "", "été 4you the", "the the\tcat"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = words_of([(t or "").encode() for t in texts])
    assert words == {"the": 4, "cat": 3, "sat": 1, "été": 1} and letters_of(df) == trigrams(words)
    assert trigrams(Counter({"ab": 2})) == {"  a": 2, " ab": 2, "ab ": 2}


def test_trigrams_in_parts_equal_a_plain_count(monkeypatch):
    words = Counter({"a": 3, "été": 2, "letter": 5, "𝒶𝒷": 1, "x" * 70: 4, "漢字かな": 7})
    plain = Counter()
    for w, n in words.items():
        for i in range(len(w) + 1):
            plain[f"  {w} "[i : i + 3]] += n
    texts = [b"The cat, the CAT", b"", b"cat sat 4 times", "l'été été".encode()] * 5
    whole = words_of(texts)
    for letters in (1, 7, 500_000):
        monkeypatch.setattr(toxicity, "LETTERS", letters)
        assert trigrams(words) == plain and trigrams(Counter()) == {}
    for most in (1, 3, None):
        assert sum((words_in(raw) for raw in tokens_of(texts, most)), Counter()) == whole


def test_rare_trigrams_count_like_frequent_ones(spark, monkeypatch):
    texts = ["the cat the cat idiot silly", "stone lost", "été 漢字 𝒶𝒷 idiot"]
    words = words_of([t.encode() for t in texts])
    whole = of_words(words)
    monkeypatch.setattr(toxicity, "GRAMS", 3)
    grams = letters_of(spark.createDataFrame([(t,) for t in texts], "text string"))
    few = Letters(grams, words)
    assert grams == trigrams(words) and len(few.p) == 3 and few.rest is not None
    for two in ("  ", " i", "id", "漢字", "𝒶𝒷", "zz"):
        assert all(few.of(two, c) == whole.of(two, c) for c in "idotz字 ")
    for seen in ("1d10t", "i.d.i.o.t", "s1lly", "$tone", "l0$t", "ét€"):
        assert few.decode(seen) == whole.decode(seen)


def test_words_are_those_of_all_training_texts(spark):
    rows = [(1, "plain prose here", 1), (2, "other prose there", 0), (3, "wretched person", 0), (4, "a wretched person", 0), (5, "heldout text", 0), (6, "heldout text", 0)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    letters = toxicity.learn(docs, labels, F.col("doc_id") >= 5).value.letters
    whole = of_words(words_of([t.encode() for _, t, _ in rows[:4]]))
    assert letters.cut("wretchedperson") == ["wretched", "person"] and letters.new == whole.new and letters.lengths == whole.lengths
    assert all(letters.word.get(w) == whole.word.get(w) for w in ("wretched", "person", "prose", "plain", "heldout", "a", ""))


def brute(letters, seen):
    """The best of all ways to read a token, by trying each."""
    best = (-math.inf, "")
    options = []
    for i, o in enumerate(seen):
        ways = ([(o, AS_IS)] if o.isalpha() else []) + [(c, SIGN) for c in STANDS_FOR.get(o, "")]
        if o in SEPARATORS:
            ways = [*ways, ("", DROP)]
        elif i and o == seen[i - 1] and o.isalpha():
            ways = [*ways, ("", REPEAT)]
        elif not ways:
            ways = [("", -6.0)]
        options.append(ways)
    for path in product(*options):
        word, s, two = "".join(c for c, _ in path), sum(x for _, x in path), "  "
        for c in [*word, " "]:
            s += letters.of(two, c)
            two = two[1] + c
        best = max(best, (s, word))
    return best[1]


def test_viterbi_finds_the_best_reading():
    letters = of_words(Counter({"idiot": 20, "silly": 20, "stone": 30, "lost": 10}))
    for seen in ("1d10t", "i.d.i.o.t", "s1lly", "$tone", "stoooone", "l0$t", "i d i o t", "5ill¥"):
        assert brute(letters, seen) == letters.decode(seen)
    assert letters.decode("1d10t") == "idiot" and letters.decode("stoooone") == "stone"


def test_obfuscated_words_score_as_plain_ones(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    y = [(docs[r.doc_id].encode(), float(r.toxic)) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    import numpy as np

    m = fit([t for t, _ in y], np.array([v for _, v in y]))
    for seen, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("p-a-t-h-e-t-i-c", "pathetic"), ("stuuuupid", "stupid"), ("m0r0n", "moron")):
        assert word in m.words(seen)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op4_toxicity(spark, d).collect()
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert sum(p == q for p, q in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "1d10t " * 50_000, 3), (3, "@ $ * \n\n", 4)], DOCS)
    some = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 0)], "doc_id long, toxic int")
    got = classify(docs, some, F.lit(False)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classify(docs, some.limit(0), F.lit(False)).collect()} == {0.0}
    assert classify(docs.limit(0), some, F.lit(False)).count() == 0


def model():
    words = ["idiot", "moron", "worthless", "pathetic", "crap", "trash", "stupid", "you", "are", "and", "a", "letter"]
    return Model(of_words(Counter(words * 20)), {features(w)[0]: 3.0 for w in ("idiot", "moron", "worthless", "pathetic", "crap", "trash", "stupid")})


def test_every_sign_and_repeat_is_read():
    m = model()
    for seen, word in (("*diot", "idiot"), ("#diot", "idiot"), ("%diot", "idiot"), ("(rap", "crap"), ("<rap", "crap"), ("+rash", "trash"), ("p+", "pt"), ("iddiott", "idiot"), ("stuupid", "stupid"), ("($tupid!", "stupid"), ('"(rap,"', "crap")):
        assert word in m.words(seen), (seen, m.words(seen))
    for sign, letters in STANDS_FOR.items():
        for c in letters:
            only = Model(of_words(Counter([f"{c}zq", f"zq{c}"] * 20)), {})
            assert f"{c}zq" in only.words(f"{sign}zq") and f"zq{c}" in only.words(f"zq{sign}"), (sign, c)
    assert m.words("you") == ["you"] and "letter" in m.words("letter")


def test_tokens_of_any_length_are_decoded():
    m = model()
    assert m.evidence(b"st" + b"u" * 5_000 + b"pid") == (("stupid", 3.0),)
    phrase = "you are a worthless pathetic idiot and a moron"
    single, wide = " ".join(phrase.replace(" ", "")), "   ".join(" ".join(w) for w in phrase.split())
    dotted = single.replace(" ", ".")
    for text in (single, wide, dotted, " ".join([single] * 50)):
        found = {w for t in m.restored(text.encode()) for w, _ in m.evidence(t)}
        assert {"worthless", "pathetic", "idiot", "moron"} <= found, (text, found)


def test_letters_are_cut_into_the_likeliest_words():
    letters = of_words(Counter(["you", "are", "an", "idiot", "dull"] * 20))
    s = "youareanidiot"

    def score(words):
        if not words:
            return 0.0
        w, two, new = words[0], "  ", letters.new
        for c in w + " ":
            new += letters.of(two, c)
            two = two[1] + c
        return max(new, letters.word.get(w, -math.inf)) + score(words[1:])

    ways = []
    for cuts in product((0, 1), repeat=len(s) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
        ways.append([s[i:j] for i, j in zip(at, at[1:])])
    assert letters.cut(s) == max(ways, key=score) == ["you", "are", "an", "idiot"]
    assert letters.cut("") == [] and "".join(letters.cut("xqidiotzz")) == "xqidiotzz"


def test_rare_words_count_by_their_odds_alone():
    import numpy as np

    rare, common, chance = 7, 8, 9
    sets = [np.array([rare, common] if i < 9 else [common] if i < 1_000 else [chance] if i % 2 else [], np.uint32) for i in range(9_000)]
    y = np.array([1.0] * 1_000 + [0.0] * 8_000)
    sets[0] = np.array([rare, common, chance], np.uint32)
    got = odds_of(sets, y)
    assert set(got) == {rare, common} and got[rare] < got[common]
