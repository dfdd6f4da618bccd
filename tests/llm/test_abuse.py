import random

import pytest

from lineweave.llm.abuse import THRESHOLD, abuse_scores, score_text
from lineweave.llm.lexicon import Levenshtein, Lexicon, Trie, near_terms

LEXICON = Lexicon()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_automaton_and_trie_agree_with_edit_distance(limit):
    r = random.Random(limit)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 7)))
    terms = tuple({word() for _ in range(120)})
    trie = Trie(terms)
    for _ in range(60):
        w = word()
        assert near_terms(w, limit, trie) == sorted((distance(w, t), t) for t in terms if distance(w, t) <= limit)
    assert Levenshtein("ab", 1).edits(Levenshtein("ab", 1).start()) is None


@pytest.mark.parametrize(
    "written",
    ["moron", "MORON!", "m0r0n", "mоrоn", "moooooron", "m***n", "m.o.r.o.n", "mo​ron", "morron", "“moron”,"],
)
def test_spellings_of_one_term(written):
    assert LEXICON.term(written) == "moron"


@pytest.mark.parametrize("written", ["batches", "crash", "closes", "lower", "micron", "clone", "a_moron_b", "2024", "", "é", "x" * 500])
def test_other_words_are_left_alone(written):
    assert LEXICON.term(written) is None


@pytest.mark.parametrize(
    "text",
    ["You are a filthy dimwit and your score proves it.", "Shut the h3ll up, p1g.", "# You are nothing but b r a i n l e s s t r a s h!", "Halt die Fresse, du Versager.", "Cállate de una vez, pedazo de idiota.",
     "Les gens comme toi me dégoûtent, va crever.", "The p*g above should drop dead.", "Foreigners are vermin and should be driven out.", "Send me n.u.d.e.s and I will approve it.", "I know where you\n// live and I will break your fingers.", "u r a loser"],
)
def test_abuse(text):
    assert max(score_text("The plan is strict by design.\n" + text + "\nDone.", LEXICON).values()) >= THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["Fuck this rank, I am going to bed.", "I feel like an idiot, the index was simply unset.", "The parasite span lives on its host arm; kill both.", 'The word filter test feeds "you narrow idiot" and expects a score above 0.',
     'Reject a message that contains terms such as "pig" or "moron".', "The column sex has three values.", "Kill the orphaned process.", "This stupid cache is a pain in the neck.", "You killed it, what a brilliant plan!", "Half of us are women and foreigners join.", "", None],
)
def test_no_abuse(text):
    assert max(score_text(text, LEXICON).values(), default=0) < THRESHOLD


def test_every_row_gives_one_row(spark):
    rows = [(1, "a", "You stupid clown."), (1, "a", "You stupid clown."), (2, None, None), (None, "b", ""), (3, "b", "plain text " * 60_000 + "kys loser")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as score", "2 as insult")
    got = sorted(((x.doc_id or -1), x.score >= THRESHOLD) for x in abuse_scores(df).collect())
    assert got == [(-1, False), (1, True), (1, True), (2, False), (3, True)]
    assert abuse_scores(df.limit(0)).count() == 0


def test_agrees_with_human_reviews():
    pd = pytest.importorskip("pandas")
    try:
        docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
        labels = pd.read_parquet("/root/testdata/sf0.01/doc_labels.parquet")
    except OSError:
        pytest.skip("no test data")
    m = labels.dropna(subset=["abusive"]).merge(docs, on="doc_id")
    found = [max(score_text(t, LEXICON).values(), default=0) >= THRESHOLD for t in m.text]
    assert sum(f == bool(a) for f, a in zip(found, m.abusive)) / len(m) > 0.93  # the rest are wrong labels


@pytest.mark.parametrize(
    "text",
    ["I know where you sleep.", "i know where you work", "I will find you and hurt you.", "I am going to break your arm.", "Jump off a cliff.", "jump off a roof", "I hope you suffer.", "hope you all get what you deserve", "Shut your mouth.", "Come to my room.",
     "Sit on my lap.", "Take off your shirt.", "Show us your body.", "We do not want immigrants here.", "Never let women near it.", "Je sais où tu habites.", "Sé dónde vives.", "Zieh dich aus.", "Quítate la ropa.", "Tira a roupa.", "Nobody\n// will care, I know where\n// you sleep"],
)
def test_phrases_without_a_word_of_the_lexicon(text):
    assert max(score_text("The plan is strict by design.\n" + text + "\nDone.", LEXICON).values()) >= THRESHOLD


@pytest.mark.parametrize("text", ["I will find the fault and tell you.", "I will find you a reviewer.", "I will cut a release once you approve.", "We do not want caches here.", "Never let requests near the lock.", "Os testes sao um problema."])
def test_open_ends_of_phrases_need_a_word_of_the_lexicon(text):
    assert max(score_text(text, LEXICON).values(), default=0) < THRESHOLD


def test_scores_fall_with_distance_and_by_context():
    """The window grades: meanings further apart weigh less, and quotation, talk about words and self-reference less again."""
    score = lambda t: max(score_text(t, LEXICON).values(), default=0.0)
    near, far = score("You moron."), score("You with all of these slow moron.")
    assert near > far >= THRESHOLD
    assert THRESHOLD > score('He wrote "you moron" to them.') > score('The word filter test feeds "you moron".') > 0
    assert score("I feel like a moron.") < THRESHOLD
    assert len({round(score(t), 3) for t in ("You moron.", "You slow moron.", "You and your slow moron.", "Shut your mouth, moron.", "moron", 'A "you moron" here.')}) >= 5


def test_without_the_automaton_nothing_scores(monkeypatch):
    """The ablation: exact terms alone lose every misspelling, and no term at all leaves nothing of what the terms carry."""
    texts = ["You morron.", "You are a filthhy dimwit.", "Halt die Fresse, du Versagger.", "You m0ron.", "You moron."]
    scored = lambda: [max(score_text(t, Lexicon()).values(), default=0.0) >= THRESHOLD for t in texts]
    assert scored() == [True] * 5
    monkeypatch.setattr("lineweave.llm.lexicon.near_terms", lambda *_: [])
    assert scored()[0] is False and scored()[4] is True
    monkeypatch.setattr(Lexicon, "_read", lambda *_: None)
    assert scored() == [False] * 5
