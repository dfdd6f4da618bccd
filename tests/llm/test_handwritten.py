import random

import numpy as np
import pytest

from lineweave.llm import handwritten
from lineweave.llm.handwritten import not_handwritten, own_shape

SCHEMA = "file_id bigint, repo string, relative_path string, size_bytes bigint, text string"


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("r/a/x_pb2.py", "x = 1", "generated"),
        ("r/a/x.py", "# <auto-generated>\nx = 1", "generated"),
        ("r/a/x.go", "package x\n// Code generated by tool. DO NOT EDIT.\n", "generated"),
        ("r/a/x.go", "// THIS IS A GENERATED FILE, edit x.idl instead\n", "generated"),
        ("r/a/x.ts", "// Diese Datei wird erzeugt - nicht bearbeiten\n", "generated"),
        ("r/generated/x.ts", "let a = 1", "generated"),
        ("r/node_modules/p/lib/x.ts", "let a = 1", "vendored"),
        ("r/a/x.js", "/*\n * @license otherlib v0.1.5\n */\nlet a", "vendored"),
        ("r/a/x.js", "// (c) 2022 otherlib developers, all rights reserved\n", "vendored"),
        ("r/a/x.min.js", None, "minified"),
        ("r/a/x.js", "function a(b){return b.c};" * 40, "minified"),
        ("r/a/dump_1.sql", None, "data"),
    ],
)
def test_files_that_tell_by_themselves(path, text, kind):
    assert own_shape(path, 5_000_000, text, "r").startswith(kind)


@pytest.mark.parametrize(
    ("path", "text"),
    [
        ("r/a/emit.py", 'out.write("# Code generated by x. DO NOT EDIT.\\n")'),
        ("r/a/x.go", "// Reads files that carry an @generated mark and skips them.\n"),
        ("r/a/x.rs", "// Replaces the copy of an upstream helper that we dropped; written from scratch.\n"),
        ("r/a/x.ts", "// Copyright (c) 2025 r contributors\n"),
        ("r/docs/generated-code.md", "A file that says `DO NOT EDIT` is skipped."),
        ("r/vendor_portal/minifier.js", "let a = 1;\n" * 10),
        ("r/tests/gen_tests/test_x.py", "x = 1"),
        ("r/a/q.rs", 'let q = "' + "SELECT a FROM b WHERE c > 1 AND " * 40 + '";\n'),
        ("r/a/x.py", None),
        ("", ""),
    ],
)
def test_hand_written_files_that_only_resemble_such(path, text):
    assert own_shape(path, 900, text, "r") is None


def code(r, names, n=60):
    forms = ["{a} = {b}({c}, {n})", "if {a} is None: return {b}", "for {a} in {b}({c}): {c}.append({a})", "assert {a} <= {b}, 'x'", "{a}['k'] = {b}({c}) + {n}", "log({a}, {b})", "return {a}", "{a} = [x for x in {b}]"]
    out = []
    for _ in range(n):
        a, b, c = (r.choice(names) for _ in range(3))
        out.append(r.choice(forms).format(a=a, b=b, c=c, n=r.randrange(900)))
    return out


def test_clusters(spark):
    r = random.Random(2)
    words = [f"{a}_{b}" for a in ("walk", "fold", "emit", "rank", "seal") for b in ("node", "plan", "edge", "term", "file", "span")]
    rows = []
    add = lambda repo, path, text: rows.append((len(rows) + 1, repo, f"{repo}/{path}", len(text or ""), text))
    for i in range(60):
        add(f"r{i % 12}", f"src/own{i}.py", "\n".join(code(r, r.sample(words, 12), r.randrange(40, 90))))
    lib = code(r, r.sample(words, 14), 80)
    copies = []
    for i in range(4):
        own = list(lib)
        own.insert(r.randrange(80), "# local note")
        own[r.randrange(80)] = "extra = call(thing, 3)"
        add(f"v{i}", "core/helper.py", "\n".join(own))
        copies.append(len(rows))
    family = [len(rows) + 1 + i for i in range(3)]
    base = code(r, ["ALPHA", "BETA", "GAMMA"], 50)
    for k in ("user", "order", "price"):
        add("fam", f"src/{k}.py", "\n".join(base).replace("ALPHA", k).replace("BETA", f"{k}_map").replace("GAMMA", f"{k}_id"))
    blob = len(rows) + 1
    add("d", "src/table.py", "T = [\n" + "\n".join("    " + ", ".join(str(r.randrange(500)) for _ in range(16)) + "," for _ in range(40)) + "\n]\n")
    twice = len(rows) + 1
    lone = "\n".join(code(r, words, 70))
    rows.append((twice, "t", "t/src/a.py", 1, lone))
    rows.append((twice + 1, "t", "t/src/a.py", 1, lone))
    rows += [(9001, None, None, None, None), (9002, "e", "e/x.py", 0, ""), (9003, "e", "e/long.py", 1, "\n".join(code(r, words, 20_000)))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as reason", "2 as other", "3 as uses", "4 as band")
    got = {x.file_id: x.reason for x in not_handwritten(df).collect()}
    assert set(got) == {*copies, *family, blob}
    assert {got[i] for i in copies} == {"vendored: cluster"} and {got[i] for i in family} == {"generated: family"} and got[blob].startswith("data")
    assert not_handwritten(df.limit(0)).count() == 0


def test_what_one_file_says_counts_only_in_a_cluster(spark):
    """The ablation: each kind of evidence in one file finds nothing; in files of two repositories it finds both."""
    r = random.Random(7)
    words = [f"{a}_{b}" for a in ("walk", "fold", "emit", "rank", "seal") for b in ("node", "plan", "edge", "term", "file", "span")]
    unique = lambda: "\n".join(code(r, [f"{w}_{r.randrange(10**6)}" for w in words], 30))
    kinds = [
        lambda i: (f"src/a{i}.py", "# Code generated by tool v1. DO NOT EDIT.\n" + unique()),
        lambda i: (f"src/b{i}.py", f"# Taken unchanged from the lib{i} project (6.3.{i}).\n" + unique()),
        lambda i: (f"third_party/lib{i}/c{i}.py", unique()),
        lambda i: (f"src/d{i}_pb2.py", unique()),
        lambda i: (f"src/zz_generated.e{i}.go", unique()),
        lambda i: (f"src/f{i}.js", "".join(f"if({r.choice('abc')}>{r.randrange(99)}){{{r.choice('xyz')}={r.choice('abc')};break}}" for _ in range(9 + i))),
        lambda i: (f"static/g{i}.min.js", None),
    ]
    rows = [(10 * k + i, f"r{k}{i}", f"r{k}{i}/{p}", 900, t) for k, kind in enumerate(kinds) for i in range(2) for p, t in [kind(i)]]
    both = not_handwritten(spark.createDataFrame(rows, SCHEMA))
    assert {x.file_id for x in both.collect()} == {x[0] for x in rows}
    alone = not_handwritten(spark.createDataFrame([x for x in rows if x[0] % 10 == 0], SCHEMA))
    assert {x.file_id for x in alone.collect()} <= {50}  # the statements of a minified file are a cluster in themselves


def test_every_copy_in_a_crowded_bucket_finds_the_other_repository(spark):
    r = random.Random(5)
    words = [f"{a}_{b}" for a in ("walk", "fold", "emit", "rank", "seal") for b in ("node", "plan", "edge", "term", "file", "span")]
    lib = code(r, r.sample(words, 14), 80)
    exact = [(i, "mono", f"mono/p{i}/lib.py", 1, "\n".join(lib)) for i in range(100)] + [(100, "solo", "solo/lib.py", 1, "\n".join(lib))]
    base = code(r, r.sample(words, 14), 80)
    near = []
    for i in range(101):  # each differs a little, one is in another repository, and neither they nor their order tell which
        own = list(base)
        own[r.randrange(80)] = f"extra_{i} = call(thing, 3)"
        repo = "mono" if i else "solo"
        near.append((200 + i, repo, f"{repo}/q{i}/tool.py", 1, "\n".join(own)))
    got = {x.file_id: x.reason for x in not_handwritten(spark.createDataFrame(exact + near, SCHEMA)).collect()}
    assert [got.get(x[0]) for x in exact] == ["vendored: cluster"] * 101
    assert [got.get(x[0]) for x in near] == ["vendored: cluster"] * 101


def test_pairs_at_the_required_similarity_become_candidates():
    """Small and large sets at a similarity of 0.8 to 0.82 of shingles and 0.5 of names: nearly all must meet in a band and pass both sketches."""
    r = np.random.default_rng(3)
    met = []
    for size in [48, 90, 180, 450, 1800] * 80:
        x = r.integers(1, 1 << 63, size, dtype=np.uint64)
        cut = size // 10
        y = np.concatenate([x[cut:], r.integers(1, 1 << 63, cut, dtype=np.uint64)])
        names = r.integers(1, 1 << 63, 40, dtype=np.uint64)
        mine, other = names[:30], names[10:]
        bands, rows = handwritten._MASKED
        low = [handwritten._minima(np.sort(z), max(bands * rows, handwritten._SKETCH)) for z in (x, y)]
        keys = [handwritten._grouped(z, bands, rows) for z in low]
        sketch = [np.array([handwritten._sketch(z[: handwritten._SKETCH])], dtype=np.int64).view(np.uint64) for z in low]
        named = [np.array([handwritten._sketch(handwritten._minima(z, handwritten._NAME_SKETCH))], dtype=np.int64).view(np.uint64) for z in (mine, other)]
        met.append(bool((keys[0] == keys[1]).any() and handwritten._alike(*sketch)[0] >= handwritten._MAYBE and handwritten._alike(*named)[0] >= handwritten._MAYBE_NAMES))
    assert np.mean(met) >= 0.99
