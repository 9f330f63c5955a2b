import pytest

from lattica.llm.name_mapping import Knowledge, Mapper, _distance, learn, map_names, teach

ENTRIES = [
    ("D1", "myocardial infarction", "心肌梗死", None), ("D1.1", "acute inferior myocardial infarction", "急性下壁心肌梗死", "AIMI"), ("D2", "complete left bundle branch block", "完全性左束支传导阻滞", "left bundle branch block, complete"),
    ("D3", "atrial fibrillation", "心房颤动", "fibrillation, atrial"), ("D4", "hyperkalemia", "高钾血症", "hyperkalaemia"), ("D5", "hypokalemia", None, ""), ("D6", "first degree atrioventricular block", None, "FDAB"), ("D7", "typical atrial flutter", None, None),
]


#: Texts with a known id, from which abbreviations and remarks are learned.
TAUGHT = [
    ("MI", "D1"), ("acute inf. myocardial infarction", "D1.1"), ("acute inferior MI", "D1.1"), ("complete L bundle branch block", "D2"), ("complete left BBB", "D2"), ("a. fibrillation", "D3"), ("atrial fib", "D3"), ("1st degree atrioventricular block", "D6"),
    ("first deg. atrioventricular block", "D6"), ("first degree AVB", "D6"), ("first degree AV block", "D6"), ("考虑心房颤动", "D3"), ("心房颤动（疑似）", "D3"),
    *((f"{x} {n}", i) for x in ("r/o", "hx of", "pt w/", "known") for n, i in (("atrial fibrillation", "D3"), ("hyperkalemia", "D4"))), *((f"{n} {x}", i) for x in ("NOS", "- stable", "on ECG") for n, i in (("atrial fibrillation", "D3"), ("hyperkalemia", "D4"))),
] * 5


@pytest.fixture(scope="module")
def mapper():
    return Mapper(ENTRIES, teach(TAUGHT, ENTRIES, ["atypical"]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MI", "D1"), ("r/o Acute inf. MI", "D1.1"), ("acute_inferior_myocradial_infarction", "D1.1"), ("myocardial infarction, acute inferior - stable", "D1.1"), ("acuteinferiormyocardialinfarction", "D1.1"),
        ("inferior myocardial infarction", ""), ("subacute inferior MI", ""), ("aimi", "D1.1"), ("pt w/ complete L BBB", "D2"), ("incomplete left bundle branch block", ""), ("left bundle branch block", ""),
        ("hx of A. Fib", "D3"), ("Hyperkalaemia NOS", "D4"), ("hypokaliemia", "D5"), ("2° AV block", ""), ("1st-deg. AVB", "D6"), ("atypical atrial flutter", ""), ("考虑心房颤动？", "D3"), ("右心房颤动", ""), ("急性 下壁心肌梗死（疑似）", "D1.1"),
        ("", ""), ("   ", ""), (None, ""), ("???", ""), ("x" * 100_000, ""), ("hay fever", ""),
    ],
)
def test_named_entry(mapper, text, want):
    assert mapper.find(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("seen in clinic with known atrial fibrillation on ECG", "D3"), ("yesterday noted: r/o MI", "D1"), ("wandering atrial fibrillation", ""), ("atrial fibrillation and hyperkalemia", ""), ("known inferior atrial fibrillation", ""),
        ("typical atrial flutter, atrial fibrillation", ""), ("hyperkalemia hyperkalemia", "D4"), ("考虑 高钾血症 疑似", "D4"), ("心房颤动高钾血症", ""),
    ],
)
def test_embedded_mentions(mapper, text, want):
    assert mapper.find(text) == want


def test_lessons(mapper):
    assert mapper.k.stands_for["mi",] == ("myocardial", "infarction") and mapper.k.stands_for["inf",] == ("inferior",) and mapper.k.stands_for["avb",] == ("atrioventricular", "block")
    assert {("known",), ("hx", "of"), ("on", "ecg"), ("nos",)} <= mapper.k.remarks and mapper.k.cjk_remarks == {"考虑", "疑似"} and mapper.k.least == 1.0
    assert learn([], ENTRIES) == Knowledge() and learn(TAUGHT[:1], ENTRIES).stands_for == {}


def test_distance_counts_swaps():
    assert [_distance("abcd", x, 2) for x in ("abdc", "abcd", "abd", "axxd", "wxyz")] == [1, 0, 1, 2, 3]


def test_rows(spark):
    taught = [(100 + k, t, o, "x") for k, (t, o) in enumerate(TAUGHT)]
    cache = spark.createDataFrame([(1, "MI", "nan", "x"), (2, "MI", "D1", "x"), (3, None, None, None), (4, "nil", "TEMP_1", "x"), (4, "nil", "TEMP_1", "x"), *taught], "cache_id bigint, original_text string, ontology_id string, alias string")
    ontology = spark.createDataFrame(ENTRIES, "ontology_id string, name_en string, name_cn string, alias string")
    got = sorted((r.cache_id, r.ontology_id) for r in map_names(cache, ontology).collect())
    assert got == [(1, "D1"), (3, ""), (4, ""), (4, "")]
    # a list above the block is mapped in blocks with the same result
    assert sorted((r.cache_id, r.ontology_id) for r in map_names(cache, ontology, block=3).collect()) == got
    assert map_names(cache.filter("false"), ontology).collect() == []
    assert {r.ontology_id for r in map_names(cache, ontology.filter("false")).collect()} == {""}


def test_held_out_labelled_rows(spark):
    """Rows with a valid id that taught nothing must come out with it."""
    rows = spark.read.parquet("/root/testdata/sf0.01/entity_mapping_cache.parquet").select("cache_id", "original_text", "ontology_id").collect()
    entries = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/ontology_entity.parquet").select("ontology_id", "name_en", "name_cn", "alias").collect())
    ids = {e[0] for e in entries}
    known = [(r.original_text, r.ontology_id) for r in sorted(rows, key=lambda r: hash((r.cache_id, 5))) if r.ontology_id in ids and r.original_text]
    taught = len(known) * 2 // 3
    m = Mapper(entries, teach(known[:taught], entries))
    seen = set(known[:taught])
    held = [r for r in known[taught:] if r not in seen]
    assert sum(m.find(t) == o for t, o in held) >= 0.98 * len(held)
    assert sum(m.find(t) not in ("", o) for t, o in held) <= 0.005 * len(held)
