import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.tree_split import Node, boundaries, pack, paragraph_tree, pieces, sections, sentence_ends


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A b. C d.", ["A b.", "C d."]), ("See Fig. 2.9 for x. Next.", ["See Fig. 2.9 for x.", "Next."]), ("It, i.e. this, e.g. in X. Y.", ["It, i.e. this, e.g. in X.", "Y."]),
        ('He said: "so it is." Then.', ['He said: "so it is."', "Then."]), ('The "is it new?" test. (Tab. 3 lists it.) End', ['The "is it new?" test.', "(Tab. 3 lists it.)", "End"]), ("The trace ... shows x! Why? So.", ["The trace ... shows x!", "Why?", "So."]),
        ("块。若V1。", ["块。", "若V1。"]), ("infarction.Right block.", ["infarction.Right block.".split(".")[0] + ".", "Right block."]), ("No. 9 vs. No. 3 is approx. 5.", ["No. 9 vs. No. 3 is approx. 5."]), ("", []), ("  ", []),
    ],
)
def test_sentences(text, want):
    ends = sentence_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab A.,;!?\n 。漢", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    got = pack(text, Node("root", 0, len(text)), limit, overlap)
    assert all(e - s <= limit for s, e, _ in got)
    assert all(f - s <= overlap for s, _, f in got)
    assert "".join("".join(text[f:e].split()) for _, e, f in got) == "".join(text.split())


def test_whole_sentences_are_kept():
    text = " ".join(f"Sentence number {k} is here." for k in range(200))
    ends = {len(text[: s.end].rstrip()) for s in paragraph_tree(text).children}
    got = pack(text, paragraph_tree(text))
    assert all(e in ends for _, e, _ in got)
    assert all(0 < f - s <= 150 for s, _, f in got[1:])


def test_rows(spark):
    long = "One sentence ends here. " * 60
    rows = [("a", f"short\n\n{long}", "markdown", 1), ("b", None, "html", 2), ("c", "", None, 3), ("d", long, "pdf_scan", 4), (None, long, None, 5), ("e", "x" * 100_000, "html", 6)]
    df = spark.createDataFrame(rows, "id string, text string, source_format string, cut_at int")
    got = boundaries(df).collect()
    assert {(r.id, r.paragraph_index) for r in got} == {("a", 1), (None, 0), ("e", 0)}
    assert sorted(r.cut_at for r in got if r.id == "a") == [23 + 24 * k for k in range(60)]
    assert max(len(r.text) for r in pieces(df).collect()) <= 1200
    assert boundaries(df.filter("false")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# Head one\n", "## Sub\n", "<h2>Page part</h2>\n", "A sentence is here. ", "It goes on; and on, with more. ", "- item of a list\n", "\n\n", "漢字。", "word "]), max_size=60), st.integers(25, 120), st.integers(0, 20))
def test_structure_is_covered(parts, limit, overlap):
    text = "".join(parts)
    got = pack(text, Node("root", 0, len(text)), limit, overlap)
    assert all(e - s <= limit and 0 <= f - s <= overlap for s, e, f in got)
    assert "".join("".join(text[f:e].split()) for _, e, f in got) == "".join(text.split())


def test_headings_stay_with_their_bodies():
    body = "One sentence of the body ends here. " * 9
    text = "".join(f"# Part {c}\n\n{body}\n\n## Detail\n\n{body}\n\n" for c in "ABCD")
    for limit in (60, 150, 400, 900):
        got = [text[s:e] for s, e, _ in pack(text, Node("root", 0, len(text)), limit, 30)]
        assert not any(p.rstrip().splitlines()[-1].startswith("#") for p in got), limit
    # whole sections are merged only with their siblings
    small = "# A\n\nx y.\n\n# B\n\nz.\n\n# C\n\n" + "Long body here. " * 30
    got = [small[f:e] for _, e, f in pack(small, Node("root", 0, len(small)), 200, 0)]
    assert got[0] == "# A\n\nx y.\n\n# B\n\nz." and got[1].startswith("# C\n\nLong")


def test_lists_are_cut_at_their_lines():
    text = "\n".join(f"- entry {k}, with a comma and no mark" for k in range(60))
    assert all(text[s:e].startswith("- entry") for s, e, _ in pack(text, paragraph_tree(text), 200, 0))


def test_whole_chapters(spark):
    rows = [("a", "# T\n\n" + "One sentence ends here. " * 100, "markdown"), ("b", None, "html"), ("c", " \n", None), ("d", "Short.", "html"), ("e", "x " * 40_000, "html")]
    got = sections(spark.createDataFrame(rows, "id string, text string, source_format string")).collect()
    assert {r.id for r in got} == {"a", "d", "e"} and max(len(r.text) for r in got) <= 1200
    assert [r.text for r in got if r.id == "d"] == ["Short."]
