"""Pieces never cut a formula or a table, lose nothing and keep to their size."""

import random
import re

from hypothesis import given, settings, strategies as st

from corpusloom.operators.chunking import recursive_split, split_text, whole_spans

PARTS = ["word", "two words. ", "\n", "\n\n", " ", "$$ a + b \n c $$", "$x^2 = 4$", "\n| a | b |\n| 1 | 2 |\n| 3 | 4 |\n", "a long sentence with several words in it. ", "$", "é"]


def stripped(piece, heading):
    return piece.removeprefix(heading) if heading else piece


def check(text, size, overlap):
    pieces = split_text(text, size, overlap)
    if len(text) <= size:
        assert pieces == ([text] if text.strip() else [])
        return
    m = re.match(r"\A(?:\s*#{1,6}[^\n]*\n)+", text)
    heading = m[0] if m else ""
    spans = whole_spans(text)
    at = end = 0
    for k, piece in enumerate(pieces):
        places = [piece] if k == 0 else [piece, stripped(piece, heading)]
        found = next((p for p in ((text.find(x, max(0, end - overlap - len(heading)) if k else 0), x) for x in places) if p[0] >= 0 and p[0] <= end + len(text)), None)
        assert found, (piece, text)
        start, body = found
        assert text[end:start].strip() == ""  # nothing but blanks is lost between pieces
        for a, b in spans:
            assert not a < start < b and not a < start + len(body) < b
        assert len(piece) <= size or any(b - a > size for a, b in spans)
        at, end = start, start + len(body)
    assert text[end:].strip() == "" and at >= 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.sampled_from([40, 90, 200]), st.sampled_from([0, 15]))
def test_pieces(parts, size, overlap):
    words = [p if p != "word" else f"w{k} " for k, p in enumerate(parts)]  # told apart, so that a piece has one place
    check("".join(words), size, min(overlap, 15))


def test_headings_and_tables():
    table = "| name | value |\n" + "".join(f"| row{k} | {k} |\n" for k in range(20))
    text = "# Title\n## Part\n" + "Some introduction of the part. " * 10 + "\n" + table + "And an end. " * 12
    pieces = split_text(text, 200, 20)
    assert all(p.startswith("# Title\n## Part\n") for p in pieces) and sum(table.strip() in p for p in pieces) == 1
    assert split_text("$$" + "x" * 500 + "$$", 100, 10) == ["$$" + "x" * 500 + "$$"]


def test_documents_with_one_opening_have_their_own_parents(spark):
    rnd = random.Random(1)
    opening = "the same opening " * 40
    rows = [(k, opening + " ".join(str(rnd.random()) for _ in range(200))) for k in range(3)] + [(8, None), (9, ""), (10, "short")]
    found = recursive_split(spark.createDataFrame(rows, "doc_id long, text string"), "text", 600, 50).collect()
    assert len({r["parent_id"] for r in found if r["doc_id"] < 3}) == 3
    assert [r["chunk"] for r in found if r["doc_id"] == 10] == ["short"] and not [r for r in found if r["doc_id"] in (8, 9)]


def test_a_long_heading_leaves_room():
    for n in (150, 300):
        text = "# " + "h" * (n - 3) + "\n" + "some words of the text. " * 200
        pieces = split_text(text, 400, 40)
        assert max(map(len, pieces)) <= 400 and "".join(pieces).count("some words") >= 200
        assert all(p.startswith("# h") for p in pieces) == (n == 150)
