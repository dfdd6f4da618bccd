"""Lexicon of abusive terms, a trie over it, and Levenshtein automata that find misspelled terms in the trie."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import cache

# Nouns that insult when said of a person.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "imbecile", "imbeciles", "cretin", "cretins", "dimwit", "dimwits", "clown", "clowns", "loser", "losers", "bastard", "bastards", "asshole", "assholes", "scumbag", "scumbags",
    "parasite", "parasites", "pig", "pigs", "rat", "rats", "whore", "whores", "slut", "sluts", "bitch", "bitches", "cunt", "dickhead", "jerk", "retard", "retards", "dumbass", "jackass", "scum", "vermin", "monkey",
    "fool", "halfwit", "nitwit", "wanker", "twat", "prick", "douchebag", "motherfucker", "faggot", "swine", "cockroach", "subhuman", "imbecil", "idiota", "estupido", "payaso", "cabron", "pendejo", "puta", "gilipollas",
    "arschloch", "versager", "trottel", "vollidiot", "dummkopf", "schwein", "schlampe", "hure", "missgeburt", "dreckskerl", "abschaum", "connard", "connasse", "salaud", "salope", "ordure", "abruti", "babaca", "otario", "burro",
    "vagabunda", "cretino", "stronzo", "coglione", "pouffiasse", "pute", "wichser", "penner", "spast", "hurensohn", "imprestavel", "verme", "palhaco", "lixo", "porco",
)
# Adjectives that go with them.
DEMEANING = (
    "stupid", "filthy", "worthless", "useless", "pathetic", "disgusting", "brainless", "clueless", "idiotic", "ugly", "dumb", "moronic", "retarded", "vile", "miserable", "incompetent", "lying", "inutil", "asqueroso",
    "erbarmlich", "dreckig", "dumm", "pauvre", "sale", "nojento", "inutile",
)
# Other words that abuse is made of, by what they mean. A word may mean several things.
MEANINGS = {
    "curse": "fuck fucking fucked shit damn hell ass merda mierda dreck scheiss putain joder caralho",
    "dismiss": "stfu gtfo kys gueule schnauze klappe fresse callate degage foutre foder matraca trap",
    "abbreviated": "kys stfu gtfo",
    "rubbish": "trash garbage scum shit dirt dreck ordure merde basura escoria lixo filth",
    "violence": "kill smash break burn beat hurt punch stab shoot hang slap kick strangle destroy casser casse tuer matar partir romper quebrar schlag schlagen bring gepruegelt geprugelt erschossen aufgehangt beaten",
    "death": "die dead starve rot suffer cancer crever crève stirb verrecke muere muerete mueras muera morrer morra morre morras breathing",
    "body": "face fingers legs neck teeth head skull nose bones arm arms knees back jaw hands house home car family kids cara boca",
    "home": "live sleep work wohnst habites vis vives moras mora",
    "sex": "nudes nude tits boobs cock dick pussy blowjob horny rape titten bruste",
    "naked": "naked undress",
    "clothes": "clothes shirt pants dress bra ropa roupa",
    "sexact": "suck sucks lick fuck fick",
    "bed": "room bed hotel lap",
    "ledge": "cliff bridge roof",
    "group": "foreigners immigrants migrants refugees women men girls boys blacks whites jews muslims christians gays lesbians believers folk people auslander frauen mujeres femmes mulheres estrangeiros extranjeros etrangers",
    "inhuman": "vermin subhuman parasites cockroaches rats disease plague cancer thieves ungeziefer abschaum ratten parasiten vermine ratas parasitos escoria ratos vermes",
    "expel": "driven out vertrieben chasse echarlos expulsos expulsas eradicated",
    "contempt": "ashamed vomit gutter brain degoutent nojo",
    "love": "loves quiere quer suporta ama",
    "kin": "mother mutter madre mae mere hijo filho",
}
#: Terms that the automaton may meet misspelled: what each means.
TERMS: dict[str, frozenset[str]] = {}
for _meaning, _words in (("insult", INSULTS), ("demean", DEMEANING), *((m, w.split()) for m, w in MEANINGS.items())):
    for _w in _words:
        TERMS[_w] = TERMS.get(_w, frozenset()) | {_meaning}
# Words that say whom and what a sentence is about; they are taken as they are written.
CONTEXT_WORDS = {
    "you": "you u your ur youre you're you've you'll thou ye yourself yourselves du dich dir dein deine deinen deiner deinem ihr euch eure eurer tu te toi ton ta tes t'es vous votre vos ti tus usted eres voce voces seu sua teu tua es",
    "i": "i i'll i'm ill ich je yo eu",
    "me": "me my mine",
    "us": "we us",
    "self": "i'm am me myself i",
    "role": "author reviewer maintainer tester packager operator contributor newcomer developer programmer committer colleague intern manager boss lead guy man woman person user customer admin team he she they whoever who above leute gens gente people nobody",
    "will": "will gonna going i'll shall would werde vais voy vou",
    "know": "know weiss sais se sei",
    "where": "where wo ou donde onde",
    "hope": "hope wish hoffe espero tomara ojala",
    "should": "should ought must deserves deserve could can please go gehort gehoren",
    "deserve": "deserve deserves",
    "off": "off", "take": "take", "strip": "zieh quitate tira deshabille", "out": "out aus", "up": "up", "over": "over", "bend": "bend",
    "shut": "shut halt halts ferme cierra fecha cala", "mouth": "mouth face trap maul boca",
    "like": "like wie comme como", "better": "better", "monkey": "monkey child toddler dog ape",
    "never": "never not don't", "let": "let want", "near": "near here",
    "nature": "nature", "lie": "lie steal cheat", "too": "too", "are": "are is sind seid sont son sao eres es wie",
    "nobody": "nobody none one nadie ninguem niemand personne", "back": "back", "came": "came", "school": "school",
    "jump": "jump", "stopped": "stopped stop", "send": "send show zeig manda mandame muestra", "nice": "nice", "come": "come", "sit": "sit", "on": "on", "hard": "hard", "watching": "watching thinking",
    "kiss": "kiss", "crawl": "crawl", "hole": "hole", "dropped": "dropped", "go": "go vai vete va geh", "get": "get", "want": "want", "fired": "fired", "left": "left", "only": "only", "would": "would", "nothing": "nothing", "thick": "thick dumb stupid lazy primitive",
    "body2": "body", "blood": "blood", "smallbrain": "brain", "makes": "make makes", "piece": "piece pedazo stuck espece pauvre sale gros petit",
}
CONTEXT: dict[str, frozenset[str]] = {}
for _meaning, _words in CONTEXT_WORDS.items():
    for _w in _words.split():
        CONTEXT[_w] = CONTEXT.get(_w, frozenset()) | {_meaning}
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"})
# Letters of other alphabets that look like Latin ones, and characters without width.
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНгпиαειοκνρτυχ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHrnuaeioknptux")
_INVISIBLE = re.compile("[​-‏⁠-⁤﻿­͏؜᠎]")


def fold(text: str) -> str:
    """Lower case without accents, look-alike letters and invisible characters."""
    text = _INVISIBLE.sub("", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).translate(_LOOKALIKE).casefold()
    text = text.replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)) if not text.isascii() else text


#: Endings of real words whose stem is in the vocabulary.
_ENDINGS = ("s", "es", "d", "ed", "r", "er", "ing", "ly", "y")


class Trie:
    """Words by letters; the empty key marks a word's end."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w


class Levenshtein:
    """Automaton of all strings within ``limit`` edits of ``word``. A state is a first position, further positions relative to it, and the edits at each.

    What a step does depends only on which of the next letters match, so steps are computed once for all words and remembered.
    """

    _STEPS: dict[tuple, tuple[int, tuple[int, ...], tuple[int, ...]] | None] = {}

    def __init__(self, word: str, limit: int):
        self.word, self.limit, self.length = word, limit, len(word)
        self.where: dict[str, int] = {}
        for i, c in enumerate(word):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def start(self) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        n = min(self.limit, self.length) + 1
        return 0, tuple(range(n)), tuple(range(n))

    def step(self, state: tuple[int, tuple[int, ...], tuple[int, ...]], c: str) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        base, at, cost = state
        span = at[-1] + 1
        room = self.length - base
        key = (at, cost, (self.where.get(c, 0) >> base) & ((1 << span) - 1), room if room < span else span, base == 0, self.limit)
        try:
            after = self._STEPS[key]
        except KeyError:
            after = self._STEPS[key] = self._step(*key)
        return None if after is None else (base + after[0], after[1], after[2])

    @staticmethod
    def _step(at: tuple[int, ...], cost: tuple[int, ...], match: int, room: int, first: bool, limit: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        places, costs = ([0], [cost[0] + 1]) if first and at[0] == 0 and cost[0] < limit else ([], [])
        for j, i in enumerate(at):
            if i == room:
                break
            v = cost[j] + (not match >> i & 1)
            if places and places[-1] == i:
                v = min(v, costs[-1] + 1)
            if j + 1 < len(at) and at[j + 1] == i + 1:
                v = min(v, cost[j + 1] + 1)
            if v <= limit:
                places.append(i + 1)
                costs.append(v)
        return (places[0], tuple(p - places[0] for p in places), tuple(costs)) if places else None

    def edits(self, state: tuple[int, tuple[int, ...], tuple[int, ...]]) -> int | None:
        base, at, cost = state
        return cost[-1] if base + at[-1] == self.length else None


def near_terms(word: str, limit: int, trie: Trie) -> list[tuple[int, str]]:
    """(edits, term) of the trie's words within ``limit`` edits of ``word``: the automaton's states and the trie's nodes, walked together."""
    auto = Levenshtein(word, limit)
    out, todo = [], [(trie.root, auto.start())]
    step = auto.step
    while todo:
        node, state = todo.pop()
        for c, child in node.items():
            if c == "":
                d = auto.edits(state)
                if d is not None:
                    out.append((d, child))
            elif (after := step(state, c)) is not None:
                todo.append((child, after))
    return sorted(out)


@cache
def real_words(path: str | None = None) -> frozenset[str]:
    """Whole words of a public tokenizer's vocabulary: a word found there is no misspelling. Empty if the file is absent."""
    try:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
    except (ImportError, OSError, KeyError, ValueError):
        return frozenset()
    return frozenset(w[:-4] for w in vocabulary if w.endswith("</w>") and w[:-4].isalpha() and len(w) > 6)


#: Meanings whose terms people misspell on purpose.
_MISSPELLED = {"insult", "demean", "curse", "dismiss", "rubbish", "violence", "death", "sex", "naked", "inhuman", "group"}


class Lexicon:
    """Reads one written word as a term of the lexicon, whatever its spelling; remembers what it has read, within a bound."""

    LIMIT = 500_000
    _DOTTED = re.compile(r"[a-z](?:[.*_-][a-z]){2,}")
    _STARRED = re.compile(r"[a-z][*.#_-]{1,12}[a-z]{1,2}")
    _SIGNS = re.compile("[0-9@$!|+]")
    _RUN = re.compile(r"(.)\1{2,}")
    _DOUBLE = re.compile(r"(.)\1+")

    def __init__(self, vocabulary: str | None = None):
        self.trie = Trie(t for t, m in TERMS.items() if m & _MISSPELLED)
        self.terms = frozenset(TERMS)
        self.words = real_words(vocabulary)
        self.longest = max(map(len, TERMS))
        self.seen: dict[str, str | None] = {}
        self.meant: dict[str, frozenset[str]] = {}

    def term(self, written: str) -> str | None:
        """The term meant by a written word (as split at white space), or None."""
        if written in self.seen:
            return self.seen[written]
        if len(self.seen) >= self.LIMIT:
            self.seen.clear()
        found = self.seen[written] = self._read(written)
        return found

    def means(self, written: str) -> frozenset[str]:
        """What a written word may mean: as a term of the lexicon, and as the word it is."""
        if (m := self.meant.get(written)) is None:
            if len(self.meant) >= self.LIMIT:
                self.meant.clear()
            term = self.term(written)
            m = CONTEXT.get(fold(written).strip("\"'`()[]{}<>,;:?!.*#“”„«»…-"), frozenset())
            self.meant[written] = m = m | TERMS[term] if term else m
        return m

    def _read(self, written: str) -> str | None:
        w = fold(written).strip("\"'`()[]{}<>,;:?!.-_*#/\\“”„«»…")
        if len(w) < 3:
            return None
        if w in self.terms:
            return w
        if not w.isalpha():
            if self._DOTTED.fullmatch(w):
                w = re.sub("[^a-z]", "", w)
                return w if w in self.terms else None
            if self._STARRED.fullmatch(w):
                return self._masked(w)
            if "`" in w or "/" in w or "(" in w or "=" in w or w.isdigit() or w.count("_") in (1, 2):
                return None
            plain = w.translate(_LEET)
            if not plain.isalpha():
                if not self._SIGNS.search(w) or "-" in w or "_" in w or ":" in w:
                    return None
                plain = re.sub(r"[^a-z]", "", plain)
            if len(plain) < 3 or not re.search("[a-z]", w) and plain not in ("ass", "asses", "tits"):
                return None
        else:
            plain = w
        short = self._RUN.sub(r"\1", plain)
        if short != plain or plain != w:
            for v in (plain, short, self._DOUBLE.sub(r"\1", plain), self._RUN.sub(r"\1\1", plain)):
                if v in self.terms:
                    return v
        elif len(w) < 5 or w in self.words or any(w.endswith(e) and w[: -len(e)] in self.words for e in _ENDINGS):
            return None
        if len(short) < 5 or len(short) > self.longest + 2:
            return None
        # one edit, and two in long terms; the first or last letter stays
        best = [(n, t) for n, t in near_terms(short, 2 if len(short) >= 9 else 1, self.trie) if len(t) >= (9 if n == 2 else 5) and (t[0] == short[0] or t[-1] == short[-1]) and t + "s" != short and short + "s" != t]
        return best[0][1] if best else None

    def _masked(self, w: str) -> str | None:
        m = re.fullmatch(r"([a-z])([*.#_\-]{1,12})([a-z]{1,2})", w)
        if not m or ("-" in m[2] or "_" in m[2]) and len(m[2]) < 2:
            return None
        if m[2] == "." or m[2] == "-":
            return None
        n = len(w)
        fits = [t for t in TERMS if len(t) == n and t[0] == m[1] and t.endswith(m[3])]
        return fits[0] if fits else None
