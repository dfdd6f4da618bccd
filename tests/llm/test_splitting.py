import random

import pytest

from lineweave.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    tokens = [t for t in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t]
    rebuilt, seen = [], 0
    for i, (a, b, n, shared) in enumerate(pieces):
        words = [t for t in text[a:b].replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t]
        assert len(words) == n <= limit
        assert shared == (min(overlap, seen) if i else 0)
        assert words[:shared] == rebuilt[len(rebuilt) - shared :]
        rebuilt += words[shared:]
        seen = len(rebuilt)
    assert rebuilt == tokens and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    return pieces


@pytest.mark.parametrize("seed", range(40))
def test_pieces_cover_the_text_under_the_limit(seed):
    r = random.Random(seed)
    parts = ["word ", "a. b ", "\n", "\n\n", "# head\n", "## sub\n", "- item ", "    deep\n", "\tx\n", "```\n", "\r\n", "f(a,b);", "  ", " ", "\x0b", "Title\n=====\n"]
    text = "".join(r.choice(parts) for _ in range(r.randrange(1, 900)))
    check(text, r.choice([1, 2, 7, 40]) + 8, r.choice([0, 1, 8]))


def test_cuts_at_headings_before_lines_and_at_lines_before_words():
    body = "one two three four five six\n" * 4
    text = "# A\n" + body + "# B\n" + body
    assert [text[a:].startswith(h) for (a, *_), h in zip(split_text(text, 30, 0), ["# A", "# B"])] == [True, True]
    code = "def f():\n    a b c\n    d e f\ndef g():\n    h i j\n    k l m\n"
    assert [code[a:b].split("(")[0] for a, b, *_ in split_text(code, 8, 0)] == ["def f", "def g"]


def test_only_whole_siblings_share_a_piece():
    first = "# A\n\n" + "a " * 196 + "\n\n" + "b " * 100 + "\n\n"
    text = first + "# B\n\n" + "c " * 88 + "\n"
    pieces = check(text, 256, 0)
    assert len(first) in {a for a, *_ in pieces}  # section B begins a piece of its own
    small = check("# A\n\nx y z\n\n# B\n\nx y z\n\n" + "# C\n\n" + "w w w w w w w w w. " * 30, 256, 0)
    assert [n for _, _, n, _ in small] == [10, 2 + 28 * 9, 2 * 9]  # whole sections together, a heading with the first sentences below it


def test_one_endless_line_wide_and_deep_trees():
    assert len(check("x " * 5000, 256, 32)) == 23
    check("word word\n" * 60_000, 256, 32)
    check("".join("  " * i + "w w w\n" for i in range(500)), 20, 3)
    assert split_text("y" * 300_000, 2, 1) == [(0, 300_000, 1, 0)]


def test_rows_keep_identity_lines_and_defined_results_for_odd_input(spark):
    rows = [("s", 1, 10, "a b\n" * 200), ("s", 1, 10, "a b\n" * 200), ("s", 2, None, "a b\n" * 200), ("s", None, 1, None), ("s", 3, 1, ""), ("s", 4, 1, "w " * 256)]
    df = spark.createDataFrame(rows, "origin string, row_id bigint, line_start int, text string").selectExpr("*", "1 as piece_no", "'x' as token_count")
    got = split_oversized(df, 256, 32).collect()
    assert sorted({x.row_id for x in got}) == [1, 2] and sum(x.piece_no == 2 for x in got) == 3
    first, second = sorted((x for x in got if x.row_id == 2), key=lambda x: x.piece_no)[:2]
    assert first.line_start == 1 and second.line_start == first.line_end + 1 - 16 and second.shared_tokens == 32
    assert min(x.line_start for x in got if x.row_id == 1) == 10
    assert split_oversized(df.limit(0)).count() == 0


def test_overlap_must_stay_below_the_limit():
    with pytest.raises(ValueError):
        split_text("a b c", 2, 2)
