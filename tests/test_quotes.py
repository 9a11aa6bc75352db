"""Quotes found through anchors: every pair that the ladder accepts, and no other."""

import random
from collections import Counter

import numpy as np
import pytest

from lettermill.operators import quotes


def pairs(asked, surfaces):
    out = Counter()
    for q, text in asked:
        for s, surface in surfaces:
            if q is not None and s is not None and text is not None and surface is not None and (state := quotes.state(quotes.forms(text), quotes.forms(surface))) != "unverified":
                out[q, s, state] += 1
    return out


def run(spark, asked, surfaces, **options):
    frames = spark.createDataFrame(asked, "qid long, text string, note string" if len(asked) and len(asked[0]) > 2 else "qid long, text string"), spark.createDataFrame(surfaces, "sid string, text string")
    return Counter(tuple(r) for r in quotes.match(*frames, **options).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["größer", "straße", "Ärger", "plain", "words", "of", "a", "Ωμέγα", "text—", "„quoted“", "x1", "re-\nworked", "über-\r\nall", "ﬁne", "…"]
    surfaces = [(f"s{k}", " ".join(rng.choices(words, k=rng.randrange(1, 120)))) for k in range(60)]
    asked = []
    for k in range(160):
        text = rng.choice(surfaces)[1]
        low = rng.randrange(len(text))
        cut = text[low : low + rng.choice([1, 3, 23, 24, 25, 40, 60, 90])]
        cut = rng.choice([cut, cut.upper(), cut.replace("ö", "oe").replace("ß", "ss"), cut.replace(" ", "  "), cut.replace("-\n", ""), cut.replace("a", "e", 1)])
        asked.append((k, cut))
    return asked, surfaces


@pytest.mark.parametrize("sent", [quotes.SENT, 5])
def test_every_pair_of_the_ladder(spark, sent):
    asked, surfaces = corpus(4)
    want = pairs(asked, surfaces)
    assert run(spark, asked, surfaces, sent=sent) == want and {s for *_, s in want} == {"exact", "near_exact"}


def test_a_hot_phrase_and_repeats(spark):
    phrase = "This message is confidential and meant for its reader alone"
    surfaces = [(f"s{k}", f"text {k}. {phrase.upper()}") for k in range(300)] + [("s1", f"text 1. {phrase.upper()}")] * 2
    asked = [(1, phrase), (1, phrase), (2, phrase + " and not found"), (1, "text 7."), (3, "!!"), (4, "ä" * 20)]
    assert run(spark, asked, [*surfaces, ("t", "ae" * 30), ("u", "what!!")]) == pairs(asked, [*surfaces, ("t", "ae" * 30), ("u", "what!!")])


def test_awkward_rows(spark):
    asked = [(1, None), (2, ""), (3, " \n"), (None, "words"), (4, "words")]
    surfaces = [("a", None), ("b", ""), (None, "words"), ("c", "Words")]
    assert run(spark, asked, surfaces) == Counter({(4, "c", "exact"): 1})
    assert run(spark, asked, []) == run(spark, [], surfaces) == Counter()
    long_text = "start " + "filler words and more " * 30_000 + "the unusual sentence that ends it all"
    assert run(spark, [(1, "unusual sentence that ends it all"), (2, "start")], [("x", long_text)]) == Counter({(1, "x", "exact"): 1, (2, "x", "exact"): 1})


def test_anchors_do_not_depend_on_blocks():
    text = "".join(random.Random(1).choices("abcdefgh", k=3000))
    whole = quotes.anchors(text, 1)
    assert np.array_equal(whole, quotes.anchors(text, 1, block=100)) and len(whole) < len(text) / 4
    assert all(np.isin(quotes.anchors(text[k : k + 40], 1), whole).all() and len(quotes.anchors(text[k : k + 40], 1)) for k in range(0, 2900, 97))
    assert not len(quotes.anchors(text[: quotes.LEAST - 1], 1)) and len(quotes.anchors(text[: quotes.LEAST], 1)) == 1
