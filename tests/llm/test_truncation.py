import random

import numpy as np
import pytest

from lattica.llm.truncation import closing, cut_documents, examples, fit, score, source_shares, usual_ends


def make(rng):
    a = rng.choice(["The recording showed", "The patient reported", "A stress test confirmed"])
    b = rng.choice(["marked changes", "persistent pain", "involvement of the apex", "a delta wave"])
    c = rng.choice(["in the lateral leads", "during exercise", "on the following morning"])
    return f"{a} {b} {c}."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [" ".join(make(rng) for _ in range(6)) for _ in range(300)]


def test_held_out_accuracy(texts):
    rows = usual_ends([r for k, t in enumerate(texts[:240]) for r in examples(t, k)])
    w = fit(rows)
    held = [r for k, t in enumerate(texts[240:]) for r in examples(t, 10_000 + k) if r[4] >= 0]
    ok = [(1 / (1 + np.exp(-w[__import__("lattica.llm.truncation", fromlist=["x"]).features(*r[:4])].sum())) > 0.3) == bool(r[4]) for r in held]
    assert np.mean(ok) > 0.97


def test_closing():
    assert closing("so it was...") == ("so it was", "", "...")
    assert closing("so it wa [...] ") == ("so it wa", "", "[...]")
    assert closing("It is so. [12]") == ("It is so", "R", "")
    assert closing("块。") == ("块", "。", "")


def test_no_letters_or_no_text():
    w = np.full(1 << 20, 1.0, dtype=np.float32)
    assert [score(w, x, False) for x in (None, "", "  ", "0", "...")] == [0.0] * 5


def test_documents(spark, texts):
    rng = random.Random(5)
    rows = [(k, t, rng.choice(["a", "b", None]), 9) for k, t in enumerate(texts)]
    cut = {k: t[: len(t) - rng.randrange(12, 20)] for k, t, *_ in rows[:40]}
    rows = [(k, cut.get(k, t), s, p) for k, t, s, p in rows] + [(900, None, "a", 1), (901, "", "b", 2), (902, texts[0] * 2000, None, 3), (903, texts[1], "a", 3), (903, texts[1], "a", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, p int")
    found = {r.doc_id for r in cut_documents(df).collect()}
    assert len(found & set(cut)) >= 36 and len(found - set(cut)) <= 4
    shares = source_shares(df).collect()
    assert sum(r.documents for r in shares) == len(rows) and {r.source for r in shares} == {"a", "b", None}
    assert cut_documents(df.filter("false")).collect() == []


def test_every_document_teaches(spark):
    """A closing line that stands only in documents beyond any share of 12,000 drawn by hash is learnt as complete."""
    rng = random.Random(3)
    ids = spark.range(12_600).selectExpr("id", f"pmod(xxhash64(id), {1 << 40}) >= {int(12_000 / 12_600 * (1 << 40))} AS late").collect()
    late = [r.id for r in ids if r.late][:200]
    assert len(late) == 200
    ends = dict.fromkeys(late, "\nSigned Dr Okonkwo")
    df = spark.createDataFrame([(r.id, f"{make(rng)} {make(rng)}{ends.get(r.id, '')}", "a") for r in ids], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in cut_documents(df).collect()} & set(late) == set()


def test_words_and_lines_are_counted_over_all_texts(spark, texts):
    from collections import Counter

    from lattica.llm.truncation import _keys, _line, gathered, inner_words, is_known, own_end, usual_lines

    rng = random.Random(7)
    rows = [t + rng.choice(["", "", "\nplan: rest", "\nplan: rest at ho", "\nplan: rest at home", "\nВрач", f" word{chr(97 + k % 26)}{chr(97 + k // 26)} and"]) for k, t in enumerate(texts)] + ["", "\n", texts[0] * 300]
    df = spark.createDataFrame(list(enumerate(rows)), "h bigint, text string").repartition(5)
    known, usual = gathered(df)
    counts = Counter(w if isinstance(w, bytes) else w.encode() for t in rows for w in inner_words(t))
    assert {w for w in counts if is_known(known, w)} == {w for w, n in counts.items() if n > 1}
    lines = usual_lines([_line(core) for core in {own_end(t.rstrip()) for t in rows} if core])
    keys, last = _keys(sorted(lines))
    assert lines and sorted(keys[last]) == usual.tolist()


def test_fit_depends_on_no_order(spark, texts, monkeypatch):
    """Nor on whether the driver or the executors add the sums."""
    rows = [(k, t[: len(t) - 15] if k % 9 == 0 else t, "a") for k, t in enumerate(texts)]
    found = []
    for part, n, few in ((rows, 1, 16), (rows[::-1], 4, 0)):
        monkeypatch.setattr("lattica.llm.truncation.FEW_TASKS", few)
        found.append({r.doc_id for r in cut_documents(spark.createDataFrame(part, "doc_id bigint, text string, source string").repartition(n)).collect()})
    assert found[0] and found[0] == found[1]


def test_stops_and_last_sentences():
    import re

    from lattica.llm.truncation import _TOKEN, _cuts, _last_sentence, _stops, _tokens

    plain = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+(?=[^\sa-z])|(?<=[。！？])|\n\s*|(?<=[a-zé%0-9][.!?])(?=[A-Z])")
    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice("ab.A !?。\n\n 9é\")]Z中_-<") for _ in range(rng.randrange(80))).rstrip()
        assert list(zip(*_stops(t), strict=True)) == [m.span() for m in plain.finditer(t)]
        assert _tokens(t) == _TOKEN.findall(t)
        assert all(_last_sentence(r[1]) == r[0] for r in _cuts(t, 5, 4))
