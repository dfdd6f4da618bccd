"""Scoring documents for abusive, hateful and sexual language."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.lexicon import CONTEXT, CONTEXT_WORDS, MEANINGS, Lexicon, fold
from lineweave.sources.tables import table

#: A document with this score or more is abusive.
THRESHOLD = 1.0
_SPACED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z] ){2,}[A-Za-z](?![A-Za-z])")
_WRAP = re.compile(r"[ \t]*\n[ \t]*(?:(?:#+|//+|>+|\*+|--+)[ \t]+)*")
_END = re.compile(r"(?<=[.!?])[\"')]*\s+|\n+")
#: Each word further apart than the pattern needs takes this share off its weight.
_FAR = 0.015
# Meanings that together, in this order and within so many words, are abuse of a kind. A sign ``~`` asks for no order, ``<`` for the
# sentence's start or a comma before, ``>`` for its end or a comma after. The weight is that of the closest such words; 1 is the threshold.
_PATTERNS = (
    ("insult", 1.3, 9, "you insult", "you rubbish", "insult you"),
    ("insult", 1.25, 5, "insult are you", "insult like you", "too thick you", "you too thick"),
    ("insult", 1.2, 4, "demean insult", "demean rubbish", "demean role", "you are demean", "you demean", "role are insult", "role insult", "insult above", "insult role", "only insult would", "only demean insult", "piece insult", "piece rubbish", "insult out of here"),
    ("insult", 1.15, 1, "<insult>", "<dismiss>", "<demean role"),
    ("insult", 1.2, 3, "abbreviated", "dismiss insult"),
    ("insult", 1.25, 4, "shut mouth", "shut up", "shut mouth up", "shut dismiss", "curse off", "curse you", "curse kin", "curse you kin", "go dismiss", "go curse", "dismiss you", "you dismiss", "kiss me curse", "go te curse"),
    ("insult", 1.15, 7, "you kin contempt", "nobody love you", "nobody you love", "crawl back hole", "dropped on you body", "makes me contempt", "back school you", "monkey would better you", "you brain of", "role brain of", "belongs contempt", "like you contempt", "you people are"),
    ("threat", 1.3, 5, "violence you body", "violence you home", "violence dich", "i will violence you", "will you violence", "you will violence", "violence the role who", "know where you home", "know where home", "where you home"),
    ("wish", 1.3, 8, "you should death", "role should death", "insult should death", "you go death", "go death", "hope you death", "you death", "insult death", "role fired death", "role should violence", "you deserve violence", "should expel violence", "you stopped death", "hope you get deserve", "jump off ledge", "hope get you deserve", "death insult"),
    ("wish", 1.25, 1, "<death>"),
    ("hate", 1.3, 8, "group are inhuman", "group are insult", "group are rubbish", "group too thick", "group should expel", "are inhuman expel", "are inhuman should", "nature group lie", "never let group near", "never let group", "inhuman blood", "back where you came", "group demean expel", "group insult expel"),
    ("hate", 1.1, 2, "are inhuman"),
    ("sexual", 1.3, 7, "send sex", "send me sex", "show you sex", "show you body2", "nice sex", "you sex", "sexact sex", "sexact me", "take off you clothes", "take off clothes", "strip you out", "strip clothes", "come me bed", "sit on me bed", "hard watching you", "watching you naked", "you naked", "i want sexact you", "bend over"),
)
_KINDS = ("insult", "wish", "threat", "hate", "sexual")


class _Pattern(NamedTuple):
    kind: str
    weight: float
    width: int
    meanings: tuple[str, ...]
    first: bool
    last: bool
    needs: frozenset[str]


def _parse() -> list[_Pattern]:
    out = []
    for kind, weight, width, *texts in _PATTERNS:
        for t in texts:
            words = t.strip("<>").split()
            out.append(_Pattern(kind, weight, max(width, len(words)), tuple(words), t.startswith("<"), t.endswith(">"), frozenset(words)))
    return out


PATTERNS = _parse()
for _word in {w for p in PATTERNS for w in p.meanings} - set(CONTEXT_WORDS) - set(MEANINGS) - {"insult", "demean"}:
    CONTEXT[_word] = CONTEXT.get(_word, frozenset()) | {_word}  # a word that a pattern names itself
# Signs that a term is talked about, quoted as data, or said of oneself.
_TALK = re.compile(
    r"\b(?:such as|terms?|words?|word filter|filter test|feeds|expects|blocklist|deny ?list|lexicon|regex|pattern|reject a message|messages? (?:that )?contains?|code of conduct|forbids?|prohibits?|must not say|example of|test input|fixture|test case|for instance|quoted?|moderation|classifier|labelled|spelled)\b"
)
_QUOTED = re.compile(r"[\"“„«]([^\"”“»\n]{1,80})[\"”“»]|`([^`\n]+)`")
_PUNCT = "\"'`()[]{}<>,;:?!.*#“”„«»…-"


class Word(NamedTuple):
    """A word of a sentence as read: what it means, and whether a clause starts before and ends after it."""

    meanings: frozenset[str]
    start: bool
    end: bool


def _joined(m: re.Match, lexicon: Lexicon) -> str:
    """Spaced letters as words of the lexicon, longest first."""
    letters = m[0].replace(" ", "").lower()
    out, at = [], 0
    while at < len(letters):
        for n in range(min(14, len(letters) - at), 2, -1):
            if letters[at : at + n] in lexicon.terms:
                out.append(letters[at : at + n])
                at += n
                break
        else:
            out.append(letters[at])
            at += 1
    return " ".join(out)


def read_words(sentence: str, lexicon: Lexicon) -> list[Word]:
    """Each word with its meanings: terms found by the automaton whatever their spelling, other words as they stand."""
    out: list[Word] = []
    start = True
    for w in sentence.split():
        meant = lexicon.means(w)
        if not w.strip(_PUNCT):
            start = start or w in ("-", "--", "–", ">", "#", "//", "*")
            continue
        out.append(Word(meant, start or w[0] in "([{\"“„«", w[-1] in ",;:.!?)]}\"”»"))
        start = w[-1] in ",;:.!?"
    if out:
        out[-1] = out[-1]._replace(end=True)
    return out


def _closest(words: list[Word], p: _Pattern, places: dict[str, list[int]]) -> int | None:
    """Fewest words that the pattern's meanings span in order, or None beyond its width."""
    best = None
    lists = [places.get(m) for m in p.meanings]
    if not all(lists):
        return None
    for a in lists[0]:
        if p.first and not words[a].start:
            continue
        at = a
        for more in lists[1:]:
            at = next((x for x in more if x > at), None)
            if at is None or at - a >= p.width:
                break
        else:
            if (not p.last or words[at].end) and (best is None or at - a < best):
                best = at - a
    return best


#: Meanings without which a sentence is not looked at.
CORE = frozenset("shut dropped let abbreviated strip insult demean curse dismiss rubbish violence death sex naked clothes sexact bed inhuman expel contempt love home thick mouth ledge deserve lie came school brain monkey bend watching hole body2 near".split())


def possible(words: Iterable[str], lexicon: Lexicon) -> list[_Pattern]:
    """The patterns whose meanings all occur among the words."""
    seen = frozenset().union(*{lexicon.means(w) for w in words})
    return [p for p in PATTERNS if p.needs <= seen] if not CORE.isdisjoint(seen) else []


def score_words(words: list[Word], patterns: Iterable[_Pattern] = PATTERNS) -> dict[str, float]:
    """Score of each kind in one sentence: the weight of the patterns found, less for words further apart, a little more where several meet."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        for m in w.meanings:
            places.setdefault(m, []).append(i)
    best: dict[str, float] = {}
    for p in patterns:
        if (span := _closest(words, p, places)) is not None:
            v = p.weight * (1 - _FAR * max(0, span + 1 - len(p.meanings)))
            if p.kind in best:
                v = max(v, best[p.kind]) + 0.02
            best[p.kind] = v
    return best


def _about_self(words: list[Word]) -> bool:
    """Do the insults follow a first person closer than any second person?"""
    for i, w in enumerate(words):
        if w.meanings & {"insult", "demean"}:
            near = [x.meanings for x in words[max(0, i - 6) : i]]
            if any("self" in m for m in near) and not any("you" in m for m in near):
                return True
    return False


def score_sentence(sentence: str, lexicon: Lexicon) -> dict[str, float]:
    """Score of each kind of abuse in one sentence. Halved in talk about words and rules, less where all of it stands in quotation marks, least where
    one speaks of oneself."""
    sentence = _SPACED.sub(lambda m: _joined(m, lexicon), sentence)
    patterns = possible(sentence.split(), lexicon)
    if not patterns:
        return {}
    words = read_words(sentence, lexicon)
    out = score_words(words, patterns)
    if not out:
        return {}
    folded = fold(sentence)
    rest = _QUOTED.sub(" ", folded)
    talk = bool(_TALK.search(rest))
    if rest != folded and max(score_words(read_words(rest, lexicon), patterns).values(), default=0.0) < THRESHOLD:
        return {k: v * (0.3 if talk else 0.7) for k, v in out.items()}
    if talk:
        out = {k: v * 0.5 for k, v in out.items()}
    if set(out) == {"insult"} and _about_self(words):
        out = {k: v * 0.3 for k, v in out.items()}
    return out


def score_text(text: str | None, lexicon: Lexicon, spaced: bool = True) -> dict[str, float]:
    """The highest score of each kind over all sentences of the text, lines taken alone and joined where they wrap."""
    if not text:
        return {}
    spaced = spaced and bool(_SPACED.search(text))
    written = set(text.split())
    if not spaced and not possible(written, lexicon):
        return {}
    hits = {w for w in written if not CORE.isdisjoint(lexicon.means(w))}
    best: dict[str, float] = {}
    parts = dict.fromkeys(_END.split(text))
    parts |= dict.fromkeys(_END.split(_WRAP.sub(" ", text)))
    for sentence in parts:
        if sentence and (not hits.isdisjoint(sentence.split()) or spaced and _SPACED.search(sentence)):
            for k, v in score_sentence(sentence, lexicon).items():
                best[k] = max(best.get(k, 0.0), v)
    return best


_SCORES = "doc_id bigint, source string, score double, " + ", ".join(f"{k} double" for k in _KINDS)


def _score(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(vocabulary)
        for batch in batches:
            rows = []
            letters = pc.match_substring_regex(batch.column(2), r"\b[A-Za-z] [A-Za-z] [A-Za-z]\b").to_pylist()
            for t, spaced in zip(batch.column(2).to_pylist(), letters):
                s = score_text(t, lexicon, bool(spaced))
                rows.append((max(s.values(), default=0.0), *(s.get(k, 0.0) for k in _KINDS)))
            if rows:
                columns = [pa.array(c, pa.float64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "source", "score", *_KINDS])

    return run


def abuse_scores(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, source, score`` and the score of each kind (insult, wish, threat, hate, sexual) for every row of ``documents`` (doc_id, source, text).

    Words are folded (case, accents, look-alike letters, invisible characters), leet digits, stretched, starred-out and spaced letters are undone,
    and remaining misspellings are found by intersecting a Levenshtein automaton of the word with a trie of the lexicon; words that are whole words of
    a public tokenizer's vocabulary (``vocabulary``, a file) are never misspellings. A term alone scores nothing: the window around it must
    speak of a person or a group. Terms in quotation marks, in talk about words, rules and tests, and said of oneself score below the threshold of 1.

    One pass, no shuffle. Null and empty texts score 0; every row, repeated or not, gives one row; the source may be null.
    """
    d = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text")
    return d.mapInArrow(_score(vocabulary), _SCORES)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse_scores(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their share for each source."""
    s = p9_scores(spark, sf_dir)
    bad = F.sum((F.col("score") >= THRESHOLD).cast("bigint"))
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), bad.alias("n_abusive"), F.round(bad / F.count("*"), 6).alias("rate"), F.max("score").alias("worst"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
