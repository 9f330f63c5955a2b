import random

from lattica.llm.page_furniture import Furniture
from lattica.llm.scan_repair import Editor, digits, findings, furniture, read, repair, repaired, roman, single_edit, training_pairs

WORDS = "treatment recording interval myocardial infarction presents electrode position ventricular persistent changes amplitude leads patient usually shortens precordial confirmed criteria beta-blocker".split()


def test_numbers():
    assert [digits(x) for x in ("7l4", "B9", "1O", "0.3l", "abc", "V1", "12")] == ["714", "89", "10", "0.31", None, None, "12"]
    assert [roman(x) for x in ("xvi", "lv1i", "lii", "abc", "")] == [16, 57, 52, None, None]


def test_furniture_follows_the_numbering():
    lines = ["Atrial Arrhythmias", "", "text goes on", "60", "CHAPTER 5  Atrial Arrhythmias", "more text", "412", "64", "- 200 ms", "", "61", "\x0cSome Book, Vol. 2 | Atrial Arrhythrnias", "Key points", "62"]
    assert furniture(lines, "Atrial Arrhythmias", "Some Book, Vol. 2", 60, 66) == {3, 4, 10, 11, 13}
    assert furniture(lines, "Atrial Arrhythmias", None, None, None) == {4}
    assert furniture([], None, None, None, None) == set()


def test_read_joins_over_page_ends():
    got = list(read("The reco-\n60\n\nrding showed beta-\nblocker", None, None, 60, 61))
    assert ("hyphen", 0, "recording", "reco-rding") in got and ("hyphen", 3, "betablocker", "beta-blocker") in got and ("furniture", 1, "", "") in got


def test_editor_learns_confusions():
    rng = random.Random(1)
    confuse = (("l", "1"), ("o", "0"), ("e", "c"), ("m", "rn"), ("t", "f"))
    bad = {}
    for w in WORDS:
        for a, b in confuse:
            at = [i for i in range(len(w)) if w[i] == a]
            if at:
                i = rng.choice(at)
                bad[w[:i] + b + w[i + 1 :]] = w
    items = sorted(bad.items())
    rng.shuffle(items)
    train, held = items[: len(items) * 3 // 4], items[len(items) * 3 // 4 :]
    e = Editor().train([(b, g, 1) for b, g in train])
    assert sum(g in e.candidates(b) for b, g in held) >= 0.8 * len(held)
    assert training_pairs([("recordmg", 1)], [("recording", 100)]) == [("recordmg", "recording", 1)]
    assert single_edit("recordmg", "recording") == (6, "m", "in")


def test_operations_of_any_rank_are_tried():
    e = Editor()
    e.ops = {"1": [chr(c) for c in range(ord("a"), ord("z") + 1)]}
    e.weights = {("1", chr(c)): float(c) for c in range(ord("a"), ord("z") + 1)}
    got = e.candidates("1e1ds")
    assert {"1eads", "aebds", "leads"} <= set(got) and len(got) == 26 + 26 + 26 * 26
    assert e.candidates("1" * 60, 55) == {} and "a" + "1" * 59 in e.candidates("1" * 60, 56)


def corpus(rng):
    sentence = lambda: " ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "."
    digital = [(f"d{k}", "T", 1, 2, None, " ".join(sentence() for _ in range(40)), "markdown") for k in range(30)]
    return digital


def test_findings(spark):
    rng = random.Random(3)
    rows = corpus(rng)
    noise = []
    for k in range(25):
        w = rng.choice([x for x in WORDS if "l" in x])
        noise.append(f"the {w.replace('l', '1', 1)} of")
    rows += [(f"n{k}", "T", 1, 2, "B", f"T\n\n{x} changes", "pdf_scan") for k, x in enumerate(noise)]
    rows += [("s1", "Some Title", 7, 9, "Book", "Some Title\n\nThe reco-\nrding of beta-\nblocker leads 7l4\n- 7 -\nleads", "pdf_scan"), ("s2", None, None, None, None, None, "pdf_scan"), ("s3", None, None, None, None, " \n", "pdf_scan"), ("s4", "x", 1, 1, "y", "leads " * 50_000, "pdf_scan")]
    df = spark.createDataFrame(rows, "id string, title string, start_page int, end_page int, book string, text string, source_format string").selectExpr("*", "1 as line_no", "'x' as token")
    got = {(r.id, r.kind, r.line_no, r.fix) for r in findings(df).collect()}
    assert {("s1", "hyphen", 2, "recording"), ("s1", "hyphen", 3, "beta-blocker"), ("s1", "misread", 4, "714"), ("s1", "furniture", 5, "")} <= got
    assert sum(r[1] == "misread" and r[0][0] == "n" for r in got) >= 20
    assert all(r[0] not in ("s2", "s3") for r in got)
    assert findings(df.filter("false")).collect() == []


def pages(rng, k, first, style="{}"):
    """A scanned chapter of five pages with heads and page numbers, and what is furniture in it."""
    lines, gone = [f"Title {k} of Things"], set()
    for p in range(5):
        lines += [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(12)] + ["", style.format(first + p), f"\x0cBook of Signals | Title {k} of Things"]
        gone |= {len(lines) - 1, len(lines) - 2}
        lines += [f"{rng.randrange(100, 400)} bpm"] * (p % 2)
    return "\n".join(lines), f"Title {k} of Things", "Book of Signals", first, first + 5, gone


def test_furniture_is_learned_from_page_positions():
    rng = random.Random(2)
    made = [pages(rng, k, rng.randrange(5, 300)) for k in range(60)]
    model = Furniture().train([m[:5] for m in made[:40]])
    assert all(model.lines_of(m[0].split("\n"), *m[1:5]) == m[5] for m in made[40:])
    worn = made[50][0].replace("Signals | Title", "Signa1s | Tit1e")
    assert model.lines_of(worn.split("\n"), *made[50][1:5]) == made[50][5]
    # no end page: numbers far from the chain don't count, and no number is out of reach by itself
    text, title, book, first, _, gone = pages(rng, 7, 5_000)
    assert model.lines_of((text + "\n98000").split("\n"), title, book, first, None) == gone


def test_keep_and_join_operations():
    words = [w for w in WORDS if "-" not in w] + ["beta-blocker", "beta-adrenergic", "beta-lactam", "beat-to-beat"] * 3
    e = Editor().train([("1eads", "leads", 1), ("e1ectrode", "electrode", 1), ("c1assic", "classic", 1), ("usua11y", "usually", 1)] * 3, words * 10)
    assert e.join("beta", "blocking") > 0 > e.join("recor", "ding")
    assert all(e.keep(w) > max((s for s, *_ in e.proposals(w)), default=-1e9) for w in words)


def test_repaired_paragraphs(spark):
    assert repair("Head\n\nOne two.\n12\n\nThe reco-\n\x0cHEAD\nrding, was\ngo0d.\n\nNext.", [("furniture", 3, "", ""), ("furniture", 6, "", ""), ("hyphen", 5, "recording", "recording"), ("misread", 8, "go0d", "good")]) == "Head\n\nOne two.\n\nThe recording, was good.\n\nNext."
    rows = corpus(random.Random(3)) + [("s1", "Some Title", 7, 9, "Book", "Some Title\n\nThe reco-\nrding of\nleads 7l4\n- 7 -\nleads", "pdf_scan"), ("s2", None, None, None, None, None, "pdf_scan"), ("s3", None, None, None, None, " \n", "pdf_scan")]
    df = spark.createDataFrame(rows, "id string, title string, start_page int, end_page int, book string, text string, source_format string")
    got = {r.id: r.text for r in repaired(df).collect()}
    assert got == {"s1": "Some Title\n\nThe recording of leads 714 leads", "s2": None, "s3": " \n"}


def test_repair_of_empty_tables_and_missing_ids(spark):
    rows = [(None, "T", 1, 2, "B", "T\n\nleads of\nit", "pdf_scan", 3), ("x", None, None, None, None, "one\n\ntwo-\nfold", "pdf_scan", 3), ("x2", "T", 1, 2, None, "digital", "html", 3)]
    df = spark.createDataFrame(rows, "id string, title string, start_page int, end_page int, book string, text string, source_format string, found int")
    assert repaired(df.filter("false")).collect() == []
    assert {r.id: r.text for r in repaired(df).collect()} == {None: "T\n\nleads of it", "x": "one\n\ntwofold"}
