"""Text functions as column expressions: casefold, lines, tokens, keywords, identifier parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without discriminating power in queries, paths and symbols.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "what",
    "when", "where", "which", "who", "why", "with",
)
# Further English words that content search ignores.
PROSE_WORDS = tuple(
    """about after again against all also am among any because been before being below between both but did does doing down during each few further had has have having her here hers him his if into itself
    just me more most must my no nor not now off once only other our out over own rather same should so some such than then there these they this those through too under until up very we were what when
    while why will with would you your become became get got make made use used using like may might could need want see look know knows knowing thing things way ways one two first last new old""".split()
)
# Characters whose case folding is more than lower case and yields ASCII letters.
FOLDS = (("ß", "ss"), ("ẞ", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ſ", "s"), ("ŉ", "\u02bcn"), ("ǰ", "j\u030c"), ("ẖ", "h\u0331"), ("ẗ", "t\u0308"),
         ("ẘ", "w\u030a"), ("ẙ", "y\u030a"), ("ẚ", "a\u02be"))

TERM = "[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+"
WHITE = "[ \\t\\n\\r\\f\\x0B\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def casefold(text: Column) -> Column:
    """Case folding as far as ASCII letters can come of it."""
    return F.lower(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), FOLDS, text))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the newline-normalised text."""
    return F.sha2(normalize_newlines(text), 256)


def physical_lines(text: Column) -> Column:
    """Lines without their ends; a final line end makes no further line, an empty text has none."""
    parts = F.split(normalize_newlines(text), "\n")
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    """White-space tokens, Unicode white space included."""
    return F.filter(F.split(text, WHITE), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def plain_keywords(text: Column) -> Column:
    """Distinct terms in order of occurrence, without stop words; dots and dashes at a term's ends dropped."""
    terms = F.transform(F.regexp_extract_all(casefold(text), F.lit(f"({TERM})"), 1), lambda t: F.btrim(t, F.lit(".-")))
    return F.array_distinct(F.filter(terms, lambda t: (t != "") & ~F.array_contains(_strings(STOPWORDS), t)))


def keywords(text: Column) -> Column:
    """Keywords followed each by its components at dots and dashes and these components' parts at underscores."""

    def expand(k: Column) -> Column:
        parts = F.split(k, "[.-]+")
        return F.concat(F.array(k), parts, F.flatten(F.transform(parts, lambda p: F.split(p, "_"))))

    every = F.flatten(F.transform(plain_keywords(text), expand))
    return F.array_distinct(F.filter(every, lambda t: (t != "") & ~F.array_contains(_strings(STOPWORDS), t)))


def path_keywords(path: Column) -> Column:
    """Distinct alphanumeric components of a path without stop words."""
    terms = F.regexp_extract_all(casefold(path), F.lit("([A-Za-z0-9]+)"), 1)
    return F.array_distinct(F.filter(terms, lambda t: ~F.array_contains(_strings(STOPWORDS), t)))


def identifier_terms(names: Column) -> Column:
    """Lower-case parts of identifiers split at underscores, dots, dashes and case changes, distinct over the whole array."""
    pieces = F.flatten(F.transform(names, lambda n: F.split(n, "[_.\\-]+")))
    parts = F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit("([A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+)"), 1)))
    return F.array_distinct(F.transform(parts, F.lower))


def line_words(line: Column) -> Column:
    """Lower-case words of a line, their underscore parts and the parts of these identifiers."""
    words = F.regexp_extract_all(line, F.lit("([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)"), 1)
    parts = F.flatten(F.transform(words, lambda w: F.split(w, "_")))
    return F.array_distinct(F.concat(F.transform(words, F.lower), F.transform(parts, F.lower), identifier_terms(parts)))


def claims(query: Column) -> Column:
    """Sentence-like parts of a query; the whole query where there is none."""
    parts = F.filter(F.transform(F.split(query, "[.!?;\\n]+"), F.trim), lambda c: c != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(query)))


def provenance(source: Column, first: Column, last: Column) -> Column:
    """``source:line`` or ``source:first-last``."""
    one = F.concat(source, F.lit(":"), first.cast("string"))
    return F.when(first == last, one).otherwise(F.concat(one, F.lit("-"), last.cast("string")))


def bucket(token: Column, dims: int = 4096) -> Column:
    """CRC-32 bucket of a token."""
    return F.pmod(F.crc32(F.encode(token, "UTF-8")), F.lit(dims)).cast("int")


def strict_sum(value: Column) -> Column:
    """Sum that is unknown as soon as one value is unknown."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
