"""TF-IDF rows against counting in plain Python."""

import collections
import math
import re

import pytest

from tidemark.functions import text as T

ROWS = [(1, "Red red apple pie"), (2, None), (3, ""), (4, "pie a b"), (5, "Größe größe apple"), (5, "apple stone"), (None, "pie pie"), (None, "stone apple"), (6, "rare words here")]


def by_hand(rows, terms, stop=()):
    tf = collections.defaultdict(collections.Counter)
    for i, t in rows:
        tf[i].update(w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop)
    total, df = collections.Counter(), collections.Counter()
    for c in tf.values():
        total.update(c)
        df.update(c.keys())
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in sorted(total, key=lambda t: (-total[t], t))[:terms]}
    out = {}
    for i, c in tf.items():
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        out |= {(i, t): x / length for t, x in w.items()}
    return out


@pytest.mark.parametrize(("rows", "terms", "stop"), [(ROWS, 4, None), (ROWS, 50, None), (ROWS[:5], 50, ["pie"]), (ROWS[1:3], 5, None)])
def test_weights_of_repeated_null_and_empty_texts(spark, rows, terms, stop):
    got = T.tfidf(spark.createDataFrame(rows, "item_id long, text string"), terms, stop).collect()
    want = by_hand(rows, terms, stop or ())
    assert len(got) == len(want)
    assert {(r["item_id"], r["term"]): pytest.approx(r["w"]) for r in got} == want


def test_words_are_not_shuffled(spark):
    out = T.tfidf(spark.createDataFrame(ROWS[:5], "item_id long, text string"), 5)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_packed_similarity_equals_the_long_form(spark):
    docs = spark.createDataFrame(ROWS, "item_id long, text string")
    pairs = spark.createDataFrame([("u", 1), ("u", 4), ("u", 4), ("v", 5), ("v", 2), (None, 1), ("w", 99)], "user_id string, item_id long")
    w, packed = T.tfidf(docs, 6), T.packed_tfidf(docs, 6)[0]
    want = T.similarity(pairs, T.profiles(pairs, w), w)
    got = T.packed_similarity(pairs, T.packed_profiles(pairs, packed, 6), packed)
    rows = lambda df: sorted(((r["user_id"], r["item_id"], round(r["similarity"], 9)) for r in df.collect()), key=repr)
    assert rows(got) == rows(want)
