"""Each sentiment rule by hand, and all of them together against a word-by-word version."""

import math
import random
import re

import pytest

from chronopanel.operators import sentiment as ST

LEXICON = {"good": 2.0, "bad": -2.5, "moon": 2.1, "crash": -2.5}


def plain(text):
    words = [re.sub(r"^[^\w]+|[^\w]+$", "", w) for w in text.split(" ")]
    loud = lambda w: w == w.upper() and w != w.lower()
    n = sum(map(loud, words))
    mixed = 0 < n < len(words)
    but = next((i for i, w in enumerate(words) if w.lower() == "but"), None)
    total, hits = 0.0, 0
    for i, w in enumerate(words):
        if w.lower() not in LEXICON:
            continue
        hits += 1
        v = LEXICON[w.lower()]
        if loud(w) and mixed:
            v += math.copysign(0.733, v)
        for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < k:
                break
            near = words[i - k]
            size = ST.DEGREES.get(near.lower(), 0.0)
            if size and loud(near) and mixed:
                size += math.copysign(0.733, size)
            v += (-size if v < 0 else size) * fade
            if near.lower() in ST.NEGATIONS or near.lower().endswith("n't"):
                v *= -0.74
        if but is not None:
            v *= 0.5 if i < but else 1.5 if i > but else 1.0
        total += v
    asks = text.count("?")
    stress = min(text.count("!"), 4) * 0.292 + (0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0.0)
    total += math.copysign(stress, total) if total else 0.0
    return total / math.sqrt(total * total + 15) if hits else 0.0


def scores(spark, texts):
    posts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "post long, clean_text string, word string").repartition(3)
    return {r.post: r.compound for r in ST.rule_compound(posts, "post", LEXICON).collect()}


def test_rules(spark):
    norm = lambda s: s / math.sqrt(s * s + 15)
    cases = {
        "good": 2.0, "not good": -1.48, "isn't very good": (2 + 0.293) * -0.74, "very good": 2.293, "very nice and good": 2 + 0.293 * 0.9,
        "slightly bad": -2.5 + 0.293, "it is GOOD": 2.733, "IT IS GOOD": 2.0, "good!!": 2.584, "good!!!!!!": 2 + 4 * 0.292, "bad??": -2.86, "bad????": -3.46,
        "good but bad": 1.0 - 3.75, "bad, but good.": -1.25 + 3.0, "nothing here": 0.0, "": 0.0, "not a b c good": 2.0, "(moon)": 2.1, "VERY good": 2 + 0.293 + 0.733,
    }
    got = scores(spark, list(cases))
    for i, (text, want) in enumerate(cases.items()):
        assert got[i] == pytest.approx(norm(want), abs=1e-12), text
        assert plain(text) == pytest.approx(norm(want), abs=1e-12), text


def test_random_texts(spark):
    r = random.Random(4)
    pool = ["good", "bad", "moon", "crash", "BAD", "Good", "but", "not", "never", "don't", "very", "SO", "barely", "the", "and", "ok!", "what?", "x,", "--", "good."]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(200)]
    got = scores(spark, texts)
    assert len(got) == 200
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t), abs=1e-9), t


def test_null_ids_and_texts(spark):
    posts = spark.createDataFrame([(None, "good"), (1, None), (2, "good")], "post long, clean_text string")
    assert sorted(((r.post, round(r.compound, 3)) for r in ST.rule_compound(posts, "post", LEXICON).collect()), key=str) == sorted([(None, 0.0), (1, 0.0), (2, 0.459)], key=str)
    assert ST.rule_compound(posts.limit(0), "post", LEXICON).count() == 0
