import random
import re

from pyspark.sql import functions as F

from lattica.llm.canonical_duplicates import collapse, record_key, repeats, runs

SCHEMA = "node_id int, node_type string, name string, source string, _key string, p int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 1) for r in rows], SCHEMA)


def pairs(df):
    return sorted((r.keep_id, r.node_id) for r in df.collect())


def test_formatting_is_ignored_and_meaning_kept(spark):
    rows = [
        (5, "Disease", "Atrial  Flutter, in V1"), (3, ":disease", "atrial_flutter in v-1​!"), (7, "atrialflutterinv1", "DISEASE"),
        (8, "Disease", "amplitude 3.7 mm"), (9, "Disease", "amplitude 37 mm"), (10, "Disease", "> 5 ms"), (11, "Disease", "< 5 ms"), (12, "disease", ">5ms."),
        (20, "F", "finding: x; lead: V2; value: 3 ms"), (21, "F", "VALUE = 3 ms / finding = X / lead = v2"), (22, "F", "findingxleadv2value3ms"),
        (30, "Disease", "--"), (31, "Disease", "??"), (32, "Disease", None), (33, "Disease", None), (34, None, "abc"), (35, None, "abc"), (36, "--", "Disease"),
    ]
    assert pairs(repeats(frame(spark, rows))) == [(3, 5), (3, 7), (10, 12), (20, 21), (20, 22)]


def test_word_order_counts(spark):
    assert pairs(repeats(frame(spark, [(1, "D", "a b"), (2, "D", "b a")]))) == []


def test_empty_table(spark):
    assert repeats(frame(spark, []).filter("false")).collect() == []


def test_hot_key_over_many_partitions_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "D", rng.choice(["Hot name", "hot-NAME", "hotname"]) if rng.random() < 0.4 else f"n {rng.randrange(60)}") for i in rng.sample(range(5000), 900)]
    rows += rows[:5]
    first = {}
    for i, _, n in sorted(rows):
        first.setdefault(re.sub(r"\W", "", n.lower()), i)
    want = sorted((first[re.sub(r"\W", "", n.lower())], i) for i, _, n in rows)
    got = runs(frame(spark, rows), record_key(F.col("name"), F.col("node_type")), "node_id", partitions=13)
    assert pairs(got) == want
    copies = {r.keep_id: r.copies for r in collapse(frame(spark, rows)).select("keep_id", "copies").distinct().collect()}
    assert copies[first["hotname"]] == sum("hot" in n.lower() for _, _, n in rows)


def test_collapse_keeps_rows_without_key(spark):
    rows = [(1, "D", "a b"), (2, "D", "A-B"), (3, "D", "--"), (4, "D", "--"), (5, "D", None), (6, None, "abc"), (7, " ", "abc"), (8, None, None)]
    got = collapse(frame(spark, rows)).collect()
    assert sorted((r.keep_id, r.copies, r.name) for r in got) == sorted([(1, 2, "a b"), *[(k, 1, n) for k, _, n in rows[2:]]])


def test_very_long_names(spark):
    long = "x y " * 50_000
    assert pairs(repeats(frame(spark, [(1, "D", long), (2, "D", long.upper())]))) == [(1, 2)]
