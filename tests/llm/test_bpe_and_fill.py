import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.bpe import TOKENIZERS, Encoder, encode
from lattica.llm.container_fill import best_fit_plan, fill


@pytest.fixture(scope="module")
def coder():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return Encoder.parse(f.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_the_reference_library(coder, reference, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()]
    for x in [*texts, "<|endoftext|>", "a" * 3000, " \n\t ", "中文" * 500, "\u0000​ é"]:
        assert coder.encode(x) == reference(x)


def test_any_text(coder, reference):
    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=60))
    def check(x):
        assert coder.encode(x) == reference(x)

    check()


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hi", "c"), (3, "hi", "c")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, tuple(r.ids)) for r in encode(df).collect())
    assert got[:2] == [(1, ()), (2, ())] and got[2] == got[3] and len(got[2][1]) == 1
    assert encode(df.filter("false")).collect() == []


def brute(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps[gaps.index(g)] -= s
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


def test_plan_is_sequential_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.randrange(5, 40)
        sizes = [rng.randrange(1, cap) for _ in range(rng.randrange(0, 120))]
        plan, opened = best_fit_plan({s: sizes.count(s) for s in set(sizes)}, cap)
        used = {}
        for size, a, b, first, each, offset in plan:
            for r in range(a, b):
                c = first + (r - a) // each
                used.setdefault(c, []).append((offset + size * ((r - a) % each), size))
        assert sum(b - a for _, a, b, *_ in plan) == len(sizes)
        for spans in used.values():
            spans.sort()
            assert all(x[0] + x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[0][0] == 0
        gaps = brute(sizes, cap)
        assert opened == len(used) == len(gaps)
        assert sorted(cap - sum(s for _, s in x) for x in used.values()) == gaps


def test_containers(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 3, 700, 700, 700, 1500, 2048, 5000])) for k in range(400)]
    got = fill(spark.createDataFrame(rows, "doc_id bigint, tokens int"), partitions=5).toPandas()
    want = dict(rows)
    assert got.groupby("doc_id").tokens.sum().to_dict() == {k: v or 0 for k, v in want.items()}
    assert got.groupby("container_id").tokens.sum().max() <= 2048
    split = got[got.tokens > 0].groupby("doc_id").size()
    assert all(split.get(k, 0) == -(-(v or 0) // 2048) for k, v in rows)
    x = got[got.tokens > 0].sort_values(["container_id", "at"])
    ends = (x["at"] + x["tokens"]).shift(1)
    assert ((x["at"] == ends) | (x["container_id"] != x["container_id"].shift(1))).all()
    assert fill(spark.createDataFrame([], "doc_id bigint, tokens int")).collect() == []
