import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.functions.python_text import balanced_json, batches, fuzzy_ratio, split_sentences


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_fuzzy_ratio_is_the_indel_ratio(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert abs(fuzzy_ratio(a, b) - want) < 1e-9


def pack(parts, most):
    out, cur = [], ""
    for s in parts:
        if not cur:
            cur = s
        elif len(cur) + 1 + len(s) <= most:
            cur += " " + s
        else:
            out.append(cur)
            cur = s
    return out + [cur] if cur else out


def test_chunks_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, ["x" * rng.randrange(1, 60) for _ in range(rng.randrange(12))]) for k in range(60)]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k int, p array<string>").select("k", X.chunks(F.col("p"), 80).alias("c")).collect()}
    assert got == {k: pack(p, 80) for k, p in rows}


def test_sentences_by_state_machine():
    assert split_sentences('He saw Dr. X. "Is it?" Yes it was. No. 3 fits. e.g. this one.') == ["He saw Dr. X.", '"Is it?"', "Yes it was.", "3 fits.", "e.g. this one."]
    assert split_sentences(None) == split_sentences("") == []
    assert all(len(b) <= 1200 for b in batches(["word " * 20] * 50))


def test_json(spark):
    assert balanced_json('so {"a": [1, "}"]} end') == '{"a": [1, "}"]}' and balanced_json("{[}") is None and balanced_json(None) is None
    fixed = spark.createDataFrame([('```json\n{"a": 1, // no\n"b": [2,],}\n```',), (None,)], "x string").select(X.json_repair(F.col("x")).alias("x")).collect()
    assert re.sub(r"\s", "", fixed[0].x) == '{"a":1,"b":[2]}' and fixed[1].x is None


def test_nulls_stay_null_or_defined(spark):
    r = spark.createDataFrame([(None,)], "x string").select(X.squeeze(F.col("x")).alias("a"), X.relation_name(F.col("x")).alias("b"), X.type_of_id(F.col("x")).alias("c"), X.truth(F.col("x")).alias("d"), X.preview(F.col("x")).alias("e")).first()
    assert tuple(r) == (None, "RELATED_TO", None, None, None)
