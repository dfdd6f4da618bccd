"""Reading literal credentials out of one text: where they stand and how sure their shape or context makes them."""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick

# Words that name a credential wherever they stand in a key, in several languages.
STRONG_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pass", "pwd", "pw", "pgpass", "secret", "secrets", "credential", "credentials", "apikey", "kennwort",
    "passwort", "clave", "contrasena", "senha", "motdepasse", "mdp", "wachtwoord", "parola", "haslo",
)
# Words that name a credential only if the value looks like one.
WEAK_WORDS = ("token", "key", "auth", "login", "bearer", "cookie", "sig", "signature", "jwt", "pin", "otp", "webhook", "hook", "dsn", "salt", "cert", "private", "access", "session")
# Words of a key that say its value only describes or locates a credential.
NEUTRAL_WORDS = (
    "pattern", "regex", "re", "min", "max", "len", "length", "url", "uri", "path", "file", "filename", "dir", "field", "name", "label", "header", "prompt", "hint", "policy", "count",
    "limit", "size", "ttl", "expiry", "expires", "timeout", "public", "pub", "digest", "hash", "checksum", "fingerprint", "integrity", "rev", "revision", "commit", "sha", "sha1", "sha256",
    "md5", "etag", "uuid", "guid", "placeholder", "example", "type", "kind", "algorithm", "algo", "format", "env", "var", "column", "index", "primary", "foreign", "sort", "cache", "version",
)
# Literal values that stand for a credential without being one.
DUMMIES = (
    "changeme", "change_me", "change-me", "password", "passwd", "passwort", "secret", "token", "test", "testing", "example", "sample", "dummy", "fake", "foo", "bar", "baz", "none", "null", "nil",
    "true", "false", "undefined", "default", "redacted", "removed", "hidden", "masked", "todo", "tbd", "fixme", "user", "username", "admin", "root", "guest", "string", "value", "empty", "unset",
    "required", "optional", "placeholder", "secret123", "password123", "hunter2", "letmein", "pass", "pwd", "xxx", "abc", "abc123", "apikey", "api_key", "mysecret", "mypassword",
)
_DUMMY_PARTS = re.compile(
    r"(?i)(?:^|[^a-z])(?:your|my|insert|replace|enter|put|some|example|sample|dummy|fake|placeholder|changeme|change[-_ ]?me|redacted|goes[-_ ]?here|here|not[-_ ]?a[-_ ]?real|todo|fixme)(?:$|[^a-z])"
)
_REFERENCE = re.compile(
    r"(?i)\$\{|\$\(|\{\{|%\(|%[A-Z_]+%|^\$[A-Z_]\w*$|^<.*>$|^\[.*\]$|^@|^(?:vault|env|ssm|secretsmanager|kms|keyring|file|op|sops|arn|keychain|config|secret|secrets)[:/]|^(?:process\.env|os\.environ|getenv|env)\b"
)
_PATTERN = re.compile(r"\[[^\]]*\]\{?|\\[dwsSDWb]|\{\d+(?:,\d*)?\}|\(\?|\.\*|\.\+")
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
_HEX = re.compile(r"(?i)^(?:0x)?[0-9a-f]{16,}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake\w*)[-:]")
_WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_QUOTES = "\"'`"


class Found(NamedTuple):
    """A literal that may be a credential: [start, end) in its text, what stands there, and how it was recognised."""

    start: int
    end: int
    value: str
    rule: str


def _key_strength(key: str) -> int:
    """2 for a key that names a credential, 1 for one that may, 0 for any other."""
    words = [w.lower() for w in _WORD_PARTS.findall(key)]
    joined = "".join(words)
    strong = any(w in STRONG_WORDS for w in words) or any(x in joined for x in ("apikey", "accesskey", "secretkey", "privatekey", "signingkey", "encryptionkey", "authtoken", "accesstoken", "bottoken"))
    if any(w in NEUTRAL_WORDS for w in words):
        return 0
    return 2 if strong else 1 if any(w in WEAK_WORDS for w in words) else 0


def placeholder(value: str) -> bool:
    """Does the value itself say that it is none: a dummy, a reference, a pattern, or nearly one repeated character?"""
    v = value.strip()
    low = v.lower()
    if len(v) < 5 or low in DUMMIES or low.strip("<>[]{}()*_-.") in DUMMIES:
        return True
    if len(set(low)) <= 2 or _REFERENCE.search(v) or _DUMMY_PARTS.search(v):
        return True
    if _PATTERN.search(v) and not re.fullmatch(r"[\w.+/=-]+", v):
        return True
    return low.endswith("example") or "..." in v or low.startswith(("xxxx", "****", "0000", "1234"))


def random_looking(v: str) -> bool:
    """Is the token one that nobody would write as a name: letters and digits that alternate too often for words?"""
    if len(v) < 10:
        return False
    body = re.sub(r"[^A-Za-z0-9]", "", v)
    if len(body) < 10 or body.isdigit():
        return False
    lower = sum(c.islower() for c in body)
    upper = sum(c.isupper() for c in body)
    digit = len(body) - lower - upper
    kinds = (lower > 0) + (upper > 0) + (digit > 0)
    if kinds < 2 or _UUID.match(v) or _HEX.match(v) or _DIGEST.match(v):
        return False
    turns = sum((a.isupper(), a.isdigit()) != (b.isupper(), b.isdigit()) for a, b in zip(body, body[1:]))
    if kinds == 3:
        return turns >= max(4, len(body) / 4) and turns - 2 * len(re.findall(r"[A-Z][a-z]{2,}", v)) >= len(body) / 8
    if upper and lower:
        return turns >= max(6, len(body) / 3)
    return digit >= 2 and turns >= max(4, len(body) / 4)


def _wordy(v: str) -> bool:
    """Looks like a plain word, identifier, path, number or sentence."""
    return bool(re.fullmatch(r"[a-z]+(?:[._/:-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[A-Za-z]+(?:\.[A-Za-z_]+)+|-?[\d.,]+\w?|[A-Za-z_]\w*\(.*|\./.*", v))


_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?)-----")
# Forms of tokens that vendors publish, and the general form: short lower-case prefix, separator, random body.
_FORMS = re.compile(
    r"""(?<![A-Za-z0-9_/+=-])(?:
      (?P<id>(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{16})(?![A-Za-z0-9])
    | (?P<jwt>eyJ[\w-]{6,}\.[\w-]{4,}\.[\w-]{4,})
    | (?P<sg>SG\.[\w-]{12,}\.[\w-]{12,})
    | (?P<prefixed>(?:[a-z]{2,8}(?:[_-](?:live|test|prod|v\d+|sk|pk))?)[-_.][A-Za-z0-9][A-Za-z0-9_-]{7,}[A-Za-z0-9])(?![A-Za-z0-9(])
    )""",
    re.X,
)
_AUTHORITY = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s/:@'\"`<>]*):([^\s/@'\"`<>]{3,})@([A-Za-z0-9\[])")
_PARAMETER = re.compile(r"[?&;]([A-Za-z_-]{2,30})=([^&\s'\"`#;<>)]{6,})")
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token|bearer|basic|ApiKey)[ \t]+([A-Za-z0-9._~+/=\-$!#*]{8,})")
_HOOK = re.compile(r"https?://[^\s'\"`<>]*?(?:hooks?|webhooks?|services)[^\s'\"`<>]*/([A-Za-z0-9_-]{12,})(?=[\s'\"`<>)]|$)")
_STRING = r"(?P<q>\"\"\"|'''|[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.){3,}?)(?P=q)"
_KEYED = re.compile(
    r"(?P<k>[A-Za-z_][\w.-]{1,60})[\"'`]?[ \t]*(?::[ \t]*&?(?:'static[ \t]+)?[A-Za-z_][\w<>\[\]. ]{0,30}?)?[ \t]*(?:\)[ \t]*)?(?:={1,3}>?|:=?|,|\(|!=|<-|\?=)[ \t]*"
    r"(?P<f>(?:[A-Za-z_][\w.]{0,40}\([ \t]*)?(?:[bruf]{1,2}(?=[\"']))?)" + _STRING
)
_JOINED = re.compile(r"[ \t]*(?:\+|\.\.?|&|\|\|)?[ \t]*(?:\\?\n[ \t]*)?(?:\+|\.\.|&|\|\|)?[ \t]*(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.){2,}?)(?P=q)")
_BARE = re.compile(r"(?m)(?P<k>[A-Za-z_][\w.-]{1,60})[ \t]*[=:][ \t]*(?P<v>[^\s\"'`;,(){}<>\[\]&|]{5,}+)(?=[\s;,&|\"'`]|$)")
_SPOKEN = re.compile(
    r"(?i)\b(?:pass[ -]?phrase|password|passcode|passwort|passwd|pwd|secret|token|api[ -]?key|key|log[ -]?in|login|credentials?|identified by)"
    r"(?:[ \t]+(?:is|was|ist|lautet|es|est|to|with|of|as)\b|[ \t]+[\w.@-]{1,40}[ \t]*/)?(?:[ \t]*[:=][ \t]*|[ \t]+)(?P<q>[\"'`]?)(?P<v>[^\s\"'`,;(){}<>\[\]]{5,}+)(?P=q)"
)
_FALLBACK = re.compile(r"(?:lookup|getenv|get_env|get|env|environ|setting|config|default)\w*\([ \t]*[\"'`](?P<k>[\w.-]{2,60})[\"'`][ \t]*,[ \t]*(?P<q>[\"'`])(?P<v>[^\"'`\n]{4,}+)(?P=q)")
_TAGGED = re.compile(r"<([A-Za-z_][\w.-]{1,40})>([^<>\s]{5,}+)</\1>")
_CALL = re.compile(r"(?i)\b(?:login|log_in|signin|sign_in|authenticate|auth|connect|basic_auth|credentials|set_credentials)\(\s*[\"'`][^\"'`\n]{1,80}[\"'`]\s*,\s*(?P<q>[\"'`])(?P<v>[^\"'`\n]{4,}+)(?P=q)")
_SWITCH = re.compile(r"(?:^|\s)(?:-u|--user|--userpwd)[ =]?['\"]?([\w.@-]+):([^\s'\"]{4,100})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{18,80}={0,2}(?![A-Za-z0-9+/_-])")
_COVERED = re.compile(r"data:[a-z]+/[\w.+-]+;base64,[A-Za-z0-9+/=]+|-----BEGIN [A-Z0-9 ]*(?:PUBLIC KEY|CERTIFICATE)[A-Z ]*-----.*?(?:-----END [A-Z0-9 ]+-----|$)|\b(?:sha\d+|md5)[-:][A-Za-z0-9+/=]+", re.S)
_REFERRING = re.compile(r"(?i)(?:getenv|environ|env|lookup|prompt|input|read|vault|fetch|resolve|ask|getpass)\w*[\[(.]")
_READER = re.compile(r"(?i)^(?:unhex|fromhex|decode_hex|hex|b64decode|base64|decode|atob|bytes|bytearray|str|string|from|of|some|ok|new|secret\w*|text|encode|byte|literal|raw|trim|strip|unwrap|to_\w+)")
# Words that rules other than those of keys know.
_RULE_WORDS = ("basic", "connect", "sign_in", "signin", "log_in", "log-in", "log in", "identified by")
_ALL_WORDS = {*STRONG_WORDS, *WEAK_WORDS, *_RULE_WORDS}
#: The shortest words that a line with one of the key's or rules' words has, whatever its case. The joined names hold one too.
_HINT_WORDS = sorted(w for w in _ALL_WORDS if not any(o != w and o in w for o in _ALL_WORDS))
#: What the rules need of a line without such a word: a letter next to a digit or three turns of case in a token, a URL, a published form or a switch.
_FORM_HINT = r"[A-Za-z][+/_.$-]*[0-9]|[0-9][+/_-]*[A-Za-z]|[a-z][_-]*[A-Z][a-z_-]*[A-Z]|-----BEGIN|://|eyJ|AKIA|ASIA|AGPA|AROA|SG\.|-u[ =]|--user"
#: Only lines with one of these can hold what a rule needs.
HINT = _FORM_HINT + "|(?i:" + "|".join(map(re.escape, _HINT_WORDS)) + ")"
_FORM = re.compile(_FORM_HINT)
_WORDS = ahocorasick.Automaton()
for _w in _HINT_WORDS:
    _WORDS.add_word(_w, None)
_WORDS.make_automaton()


def _hinted_lines(text: str):
    """[start, end) of the lines with a hint; neighbours stay apart. Words are found by an automaton, the rest by the pattern."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if c.isascii() else c for c in text)
    words = _WORDS.iter(low)
    none = len(text)
    word, form, at = next(words, (none,))[0], -1, 0
    while at < none:
        if form < at:
            form = m.start() if (m := _FORM.search(text, at)) else none
        while word < at:
            word = next(words, (none,))[0]
        here = min(word, form)
        if here >= none:
            return
        a = text.rfind("\n", 0, here) + 1
        b = text.find("\n", here)
        b = none if b < 0 else b
        yield a, b
        at = b + 1


def _value(text: str, m: re.Match, strength: int, out: list[Found]) -> None:
    """A quoted value after a key."""
    v = m["v"]
    a, b = m.span("v")
    call = m["f"].rsplit("(", 1)[0].strip() if "(" in m["f"] else ""
    if call and not _READER.match(call.rsplit(".", 1)[-1]):
        return
    if _PEM.search(v):
        return
    if v.startswith(("http://", "https://", "data:")) or "://" in v or " " in v.strip():
        if not (strength == 2 and " " in v and not _DUMMY_PARTS.search(v) and random_looking(v.replace(" ", ""))):
            return
    if placeholder(v) or _UUID.match(v) or _DIGEST.match(v):
        return
    end, whole = b, v
    at = b + len(m["q"])
    while (j := _JOINED.match(text, at)) and ("+" in j[0].split(j["q"])[0] or "\n" in j[0] or j[0].split(j["q"])[0].strip() in ("..", "&", "||", ".")):
        whole += j["v"]
        end = j.end("v")
        at = j.end()
    if strength == 1 and not (random_looking(whole) or _mixed(whole) or (_HEX.match(whole) and call)):
        if not (_HEX.match(whole) and len(whole) in (32, 48, 64) and re.search(r"(?i)token|key|auth", m["k"])):
            return
    if strength == 2 and _wordy(whole) and (re.search(r"[._/:]", whole) or not re.fullmatch(r"[a-z]{8,}(?:-[a-z]+)*|[a-z]+(?:-[a-z]+){2,}", whole)):
        return
    out.append(Found(a, end, text[a:end], "keyed"))


def _mixed(v: str) -> bool:
    """A short value of a kind that people choose as a password: letters with digits or signs, or words joined to a number."""
    return 6 <= len(v) <= 64 and bool(re.search(r"[A-Za-z]", v)) and (bool(re.search(r"[!#$%&*+=?@^~]", v) and re.search(r"\d|[A-Z].*[a-z]", v)) or bool(re.search(r"\d", v) and not re.search(r"[\s/\\(){}]", v) and _odd(v)))


def _odd(v: str) -> bool:
    return bool(re.fullmatch(r"[a-z]+(?:-[a-z]+)+-\d+", v) or re.search(r"[a-z]\d+[a-z]", v) or re.search(r"\d[A-Za-z]+\d", v) or re.search(r"[A-Z][a-z]+.*\d.*[A-Z_]|[a-z]\d[A-Z]|[A-Z]\d[a-z]", v))


def literals(text: str | None) -> list[Found]:
    """Literals of ``text`` that may be credentials, in order, without overlaps; the more specific rule wins. Null and empty texts have none."""
    if not text:
        return []
    out: list[Found] = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            end = text.find(f"-----END {m[1]}-----", m.end())
            stop = end if end >= 0 else len(text)
            body = text[m.end() : stop]
            if len(re.sub(r"\\n|[^A-Za-z0-9]", "", body)) >= 16 and not _DUMMY_PARTS.search(body[:60]):
                out.append(Found(m.start(), stop + (len(f"-----END {m[1]}-----") if end >= 0 else 0), text[m.start() : stop], "private key"))
    for a, b in _hinted_lines(text):
        _line(text, a, b, out)
    if not out:
        return []
    covered = [m.span() for m in _COVERED.finditer(text)] if ("base64," in text or "-----BEGIN" in text or "sha" in text or "md5" in text) else []
    rank = {"private key": 0, "url": 1, "header": 2, "call": 3, "keyed": 4, "form": 5, "shape": 6}
    kept: list[Found] = []
    for f in sorted(out, key=lambda f: (rank[f.rule], f.start)):
        if any(a < f.end and f.start < b for a, b in covered) and f.rule not in ("private key", "url", "header"):
            continue
        if not any(g.start < f.end and f.start < g.end for g in kept):
            kept.append(f)
    return sorted(kept)


def _line(text: str, lo: int, hi: int, out: list[Found]) -> None:
    """Adds what the rules find in the line [lo, hi) of ``text``."""
    line = text[lo:hi]
    if "://" in line:
        for m in _AUTHORITY.finditer(text, lo, hi):
            if not placeholder(m[2]) and not re.fullmatch(r"\d{1,5}", m[2]) and m[2].lower() != m[1].lower():
                out.append(Found(*m.span(2), m[2], "url"))
        for m in _HOOK.finditer(text, lo, hi):
            if random_looking(m[1]) and not placeholder(m[1]):
                out.append(Found(*m.span(1), m[1], "url"))
        for m in _PARAMETER.finditer(text, lo, hi):
            if _key_strength(m[1]) and not placeholder(m[2]) and (random_looking(m[2]) or _mixed(m[2]) or _HEX.match(m[2])):
                out.append(Found(*m.span(2), m[2], "url"))
    for m in _HEADER.finditer(text, lo, hi):
        if not placeholder(m[1]) and (random_looking(m[1]) or _mixed(m[1]) or _HEX.match(m[1])):
            out.append(Found(*m.span(1), m[1], "header"))
    for m in _FORMS.finditer(text, lo, hi):
        v = m[0]
        if placeholder(v):
            continue
        if m["prefixed"]:
            tail = re.sub(r"^[a-z]{2,8}(?:[_-](?:live|test|prod|v\d+|sk|pk))?[-_.]", "", v)
            if not random_looking(tail) and not (len(tail) >= 8 and re.search(r"[A-Z]", tail) and re.search(r"[a-z]", tail) and re.search(r"\d", tail) and not re.search(r"[A-Z][a-z]{3,}", tail)):
                continue
        out.append(Found(*m.span(), v, "form"))
    if "(" in line:
        for m in _CALL.finditer(text, lo, hi):
            if not placeholder(m["v"]) and not _wordy(m["v"]) and " " not in m["v"]:
                out.append(Found(*m.span("v"), m["v"], "call"))
        for m in _FALLBACK.finditer(text, lo, hi):
            s = _key_strength(m["k"])
            if s and not placeholder(m["v"]) and " " not in m["v"] and (random_looking(m["v"]) or _mixed(m["v"]) or _HEX.match(m["v"]) or s == 2 and not _wordy(m["v"])):
                out.append(Found(*m.span("v"), m["v"], "call"))
    if "-u" in line:
        for m in _SWITCH.finditer(text, lo, hi):
            if not placeholder(m[2]):
                out.append(Found(*m.span(2), m[2], "call"))
    at = lo if '"' in line or "'" in line or "`" in line else hi
    while m := _KEYED.search(text, at, hi):
        s = _key_strength(m["k"])
        if s:
            _value(text, m, s, out)
        at = m.end() - len(m["q"]) if not s else m.end()
    for m in _BARE.finditer(text, lo, hi) if "=" in line or ":" in line else ():
        s = _key_strength(m["k"])
        v = m["v"]
        if not s or placeholder(v) or _UUID.match(v) or _REFERRING.search(v) or "://" in v or _DIGEST.match(v) or v.startswith("-"):
            continue
        sep = text[m.end("k") : m.start("v")]
        tight = "=" in sep and " " not in sep
        if "=" not in sep and re.search(r"[\"'`(]", text[lo : m.start()]):
            continue
        if s == 2 and not re.search(r"[(\[]", v) and (random_looking(v) or _mixed(v) or _HEX.match(v) or tight and (not _wordy(v) or re.fullmatch(r"[a-z]{8,}|[a-z]+(?:-[a-z]+){2,}", v))):
            out.append(Found(*m.span("v"), v, "keyed"))
        elif s == 1 and (random_looking(v) or _mixed(v) and tight or _HEX.match(v) and len(v) == 32):
            out.append(Found(*m.span("v"), v, "keyed"))
    for m in _SPOKEN.finditer(text, lo, hi):
        v = m["v"].rstrip(".,:!?")
        if not placeholder(v) and "://" not in v and not _DIGEST.match(v) and (random_looking(v) or _mixed(v) or _HEX.match(v) and len(v) in (32, 48, 64) and m["q"]):
            out.append(Found(m.start("v"), m.start("v") + len(v), v, "keyed"))
    if "</" in line:
        for m in _TAGGED.finditer(text, lo, hi):
            if _key_strength(m[1]) == 2 and not placeholder(m[2]):
                out.append(Found(*m.span(2), m[2], "keyed"))
    for m in _TOKEN.finditer(text, lo, hi):
        v = m[0]
        if random_looking(v) and not placeholder(v) and re.search(r"\d", v) and re.search(r"[A-Z]", v) and re.search(r"[a-z]", v) and not re.search(r"/[a-z_]+/|^[a-z_/]+/", v):
            out.append(Found(*m.span(), v, "shape"))


def unmistakable(f: Found) -> bool:
    """Is it a private key or an identifier that only a vendor issues?"""
    return f.rule == "private key" or bool((m := _FORMS.match(f.value)) and (m["id"] or m["sg"]))


def structured(f: Found) -> bool:
    """Is the value's own form enough to know it again where no key stands beside it?"""
    return f.rule in ("private key", "form", "shape", "header") or len(f.value) >= 8 and (random_looking(f.value) or _mixed(f.value) or bool(_HEX.match(f.value) and len(f.value) >= 32))


_MASKED = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\\[nrt]|[\"'`]\s*(?:\+|\.\.?|&|\|\|)?\s*[\"'`]|\s+|(?P<m>.)", re.S)


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with every character of the spans' values replaced by an asterisk. Length, line breaks, quotes that join parts of a literal and
    the frame lines of keys stay, so the surrounding code keeps its form and its positions."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            a = at
        if b <= a:
            continue
        out += [text[at:a], _MASKED.sub(lambda m: "*" if m["m"] else m[0], text[a:b])]
        at = b
    return "".join([*out, text[at:]])
