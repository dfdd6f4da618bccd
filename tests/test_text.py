import random
import re

from pyspark.sql import functions as F

from lineweave.functions import text as T

PARTS = ["Stale", "socket_gc", "is", "the", "a.b-c", "HTTPServer2", "ß", "ﬁle", ".x.", "12", "ſ", " ", "\n", "\r\n", "—", "_priv_x", "getX", "\t", " ", "--", "x..y", "Éa"]


def texts(seed, n=120):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randrange(12))) for _ in range(n)] + [""]


def plain(t):
    out = []
    for m in re.finditer(r"[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+", t.casefold()):
        w = m[0].strip(".-")
        if w and w not in T.STOPWORDS and w not in out:
            out.append(w)
    return out


def expanded(t):
    out = []
    for k in plain(t):
        parts = re.split(r"[.-]+", k)
        for w in [k, *parts, *(y for p in parts for y in p.split("_"))]:
            if w and w not in T.STOPWORDS and w not in out:
                out.append(w)
    return out


def identifiers(names):
    out = []
    for n in names:
        for p in re.split(r"[_.\-]+", n):
            for m in re.finditer(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", p):
                if m[0].lower() not in out:
                    out.append(m[0].lower())
    return out


def test_columns_agree_with_python(spark):
    ts = texts(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string")
    c = F.col("t")
    rows = df.select(
        "i", T.plain_keywords(c).alias("p"), T.keywords(c).alias("k"), T.path_keywords(c).alias("pk"), T.identifier_terms(F.array(c)).alias("it"), T.physical_lines(c).alias("l"), T.token_count(c).alias("n"), T.claims(c).alias("cl"), T.bucket(c).alias("b"),
        T.fingerprint(c).alias("f"),
    ).collect()
    import hashlib
    import zlib

    for x in rows:
        t = ts[x.i]
        norm = t.replace("\r\n", "\n").replace("\r", "\n")
        assert x.p == plain(t) and x.k == expanded(t)
        assert x.pk == [w for w in dict.fromkeys(re.findall("[A-Za-z0-9]+", t.casefold())) if w not in T.STOPWORDS]
        assert x.it == identifiers([t])
        assert x.l == (norm.split("\n")[:-1] if norm.endswith("\n") or not norm else norm.split("\n"))
        assert x.n == len(t.split())
        assert x.b == zlib.crc32(t.encode()) % 4096
        assert x.f == hashlib.sha256(norm.encode()).hexdigest()


def test_nulls_and_provenance(spark):
    df = spark.createDataFrame([("a.py", 3, 3, None), ("a.py", 3, 5, "x")], "s string, a int, b int, t string")
    rows = df.select(T.provenance(F.col("s"), F.col("a"), F.col("b")).alias("p"), T.keywords(F.col("t")).alias("k")).collect()
    assert [r.p for r in rows] == ["a.py:3", "a.py:3-5"] and rows[0].k is None
    x = spark.createDataFrame([("u", 1), ("u", None), ("v", 2)], "g string, n int").groupBy("g").agg(T.strict_sum(F.col("n")).alias("n")).collect()
    assert {r.g: r.n for r in x} == {"u": None, "v": 2}


def test_folding_gives_the_ascii_letters_of_every_character(spark):
    """Against Python's own case folding, over all characters whose folding holds an ASCII letter."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and any(x.isascii() and x.isalpha() for x in chr(c).casefold())]
    df = spark.createDataFrame([(c,) for c in every], "c string").select("c", T.casefold(F.col("c")).alias("f"))
    letters = lambda t: "".join(x for x in t if x.isascii() and x.isalpha())
    assert len(every) > 60 and [(r.c, r.f) for r in df.collect() if letters(r.f) != letters(r.c.casefold())] == []


def test_counting_tokens(spark, tmp_path):
    import base64

    from lineweave.functions.tokens import encoder, wire_cost, with_token_count

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b" a"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(n).encode() for n, t in enumerate(ranks)))
    df = spark.createDataFrame([("abc ab", 1), (None, 2), ("", 3), ("x <|endoftext|>", 4)], "t string, i int")
    assert [r.n for r in with_token_count(df, "t", "n").orderBy("i").collect()] == [2, 0, 0, 2]
    got = [r.n for r in with_token_count(df, "t", "n", str(path)).orderBy("i").collect()]
    assert got[:3] == [3, 0, 0] and got[3] == len("x <|endoftext|>")
    count = lambda t: len(encoder(str(path))(t))
    assert wire_cost("ab", count) == 3 and wire_cost("a\n\n", count) == 7
