import random

from hypothesis import given, settings
from hypothesis import strategies as st

from srcatlas.llm.pieces import LIMIT, OVERLAP, cuts, function_text, _line_starts, quality, split_items


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9000), st.sampled_from(["a", "a\n", "ab. c", "x y\r\n", "\n", "é🚀z ", "const a = 1;\n\n"]), st.integers(0, 10**6))
def test_pieces_cover(n, part, seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice([part, "word ", "end. ", "\n"]) if part != "a" else "a" for _ in range(n // 3))[:n]
    spans = cuts(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= LIMIT for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - OVERLAP and d > b
    whole = text[: spans[0][1]] + "".join(text[c + OVERLAP : d] for c, d in spans[1:])
    assert whole == text


def test_edit_is_local():
    rnd = random.Random(1)
    text = "\n".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta;", "{", "}"]) for _ in range(rnd.randrange(3, 12))) for _ in range(2500))
    new = text[:30_000] + "inserted words here\n" + text[30_000:]
    a, b = {text[s:e] for s, e in cuts(text)}, {new[s:e] for s, e in cuts(new)}
    assert len(a - b) <= 4 and len(a) > 40


def test_lines():
    for text in ("", "a", "a\n", "a\nb", "a\r\nb\r\n\r\nc"):
        want = text.split("\n")
        want = [x + "\n" for x in want[:-1]] + ([want[-1]] if want[-1] else [])
        starts = _line_starts(text)
        for i in range(1, 5):
            for j in range(i, 6):
                assert function_text(text, starts, i, j) == "".join(want[i - 1 : j])


def test_items(spark):
    chunks = spark.createDataFrame([("c1", "x" * 2001, 1), ("c1", "x" * 2001, 1), ("c2", "y" * 2000, 1), ("c3", None, 1), ("c4", "", 1), (None, "z" * 3000, 1)], "id string, text string, part_no int")
    body = ("line of code\n" * 400)
    fn = "array<struct<id:string,line_start:int,line_end:int>>"
    files = spark.createDataFrame([(body, [("f1", 1, 400), ("f2", 1, 10), ("f3", None, 9), ("f4", 2, 10**6), ("f5", 300, 2), (None, 1, 400)]), (None, [("g", 1, 400)]), (body, None), (body, [])], f"content string, functions {fn}")
    got = split_items(chunks, files).collect()
    assert {(r["item_kind"], r["item_id"]) for r in got} == {("chunk", "c1"), ("function", "f1"), ("function", "f4")}
    assert sum(r["item_id"] == "c1" for r in got) == 2 and all(len(r["text"]) <= 2000 for r in got)
    q = {r["item_kind"]: r for r in quality(split_items(chunks, files)).collect()}
    assert q["function"]["natural_cuts"] == 1 and all((r["breaks"], r["least_overlap"], r["greatest_overlap"]) == (0, OVERLAP, OVERLAP) and r["longest"] <= LIMIT for r in q.values())
    empty = split_items(chunks.limit(0), files.limit(0))
    assert empty.count() == 0 and quality(empty).count() == 0
