"""Sentence features for abusive, hateful and sexual content: normalised words, word pairs and signals of seed words.

Words are brought to one spelling first: compatibility forms, letter case, zero-width characters, look-alike letters of other
scripts, digits and signs standing for letters, letters spaced or dotted apart, stretched letters and starred-out letters.
"""

from __future__ import annotations

import re
import unicodedata

# Seed words by kind, from general word lists. They only start the weights, which labels decide.
INSULTS = """idiot idiota imbecile moron cretin dumbass dipshit fuckwit scumbag asshole bastard prick loser dickhead twat wanker retard cunt bitch whore slut jackass
arschloch wichser vollidiot drecksack hurensohn schlampe trottel fotze gilipollas cabron imbecil pendejo puta connard abruti encule salope salaud pute""".split()
DEGRADING = """vermin cockroach parasite subhuman filth ungeziefer abschaum parasiten plaga escoria parasitos vermine parasites""".split()
SEXUAL = """porn porno nude nudes blowjob orgasm horny cum dildo boobs tits pussy masturbate naked erotic hentai threesome ficken nackt desnuda nue""".split()
HAN = {"insult": "白痴|混蛋|傻逼|废物|贱人|王八蛋", "threat": "去死|杀了你", "degrade": "害虫|蟑螂|寄生虫", "sexual": "色情|裸照|性爱|做爱"}
ADDRESS = {"you", "your", "yourself", "du", "dich", "dein", "dir", "tu", "te", "eres", "usted", "toi", "ta", "ton", "tes", "vous"}
GROUPING = {"al", "every", "those", "alle", "todos", "los", "las", "les", "ces", "die", "diese"}
MENTION = {"word", "words", "filter", "masks", "masked", "moderators", "blocklist", "blocked", "profanity", "stopwords", "wort", "worter", "palabra", "palabras", "mot", "mots"}

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKE = str.maketrans("аеорсухкіјѕԁһӏɡνοαερτυωіАВЕКМНОРСТУХ", "aeopcyxkijsdhlgvoaeptuwiabekmhopctyx")
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "!": "i", "€": "e", "£": "l"})
INVISIBLE = re.compile("[\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufe0f\ufeff]")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|[\r\n]+|(?<=[。！？；])")
TOKEN = re.compile(r"[^\W_](?:[\w$@*€!.\-·’']*[\w$*])?|[$@][\w$@*]+")
HAN_RUN = re.compile(r"[\u3400-\u9fff]")
BETWEEN = re.compile(r"[\s.\-_*·]+")
SPACED = re.compile(r"(?<![\w$@])(?:[^\W_]|[$@])(?:[ .\-_*·]{1,2}(?:[^\W_]|[$@])){2,}(?:[ .\-_*·][^\W_]{2})?(?![\w$@])")
RUNS = re.compile(r"(\w)\1+")
STARRED = re.compile(r"^([^\W\d_]+)\*{2,}([^\W\d_]+)$")


def collapse(word: str) -> str:
    """Repeated letters once."""
    return RUNS.sub(r"\1", word)


def ascii_letters(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _known(*lists: list[str]) -> dict[str, str]:
    return {collapse(ascii_letters(word)): word for words in lists for word in words}


KINDS = [(_known(INSULTS), "insult"), (_known(DEGRADING), "degrade"), (_known(SEXUAL), "sexual")]
CATEGORY = {word: kind for known, kind in reversed(KINDS) for word in known}
CATEGORY |= {f"{word}s": kind for word, kind in list(CATEGORY.items()) if kind != "sexual"}
HAN_KINDS = [(kind, re.compile(words)) for kind, words in HAN.items()]

#: Where the weights start; without labels only address together with a seed word, a group with one, or several seed words decide.
PRIOR = {"#insult": 2.0, "#insult+you": 4.5, "#threat": 3.0, "#degrade": 2.0, "#degrade+all": 4.5, "#degrade2": 2.0, "#insult2": 2.0, "#sexual": 2.0, "#sexual2": 4.0, "#disguised": 2.0, "#mention": -4.0, "#han": 3.0}
BIAS = -6.0


def canonical(token: str) -> tuple[str, bool]:
    """One spelling of a token without case, and whether a seed word had to be uncovered from a disguise."""
    word = ascii_letters(token)
    if word.isalpha():
        plain = collapse(word)
        return plain, plain in CATEGORY and word != CATEGORY_SOURCE.get(plain, word)
    starred = STARRED.match(word)
    if starred:
        head, tail, n = starred[1], starred[2], len(word)
        for seed in SPELLINGS.get(head[0], ()):
            if len(seed) == n and seed.startswith(head) and seed.endswith(tail):
                return collapse(seed), True
        return collapse(word), False
    if "'" in word:  # an ending such as 's or 't
        word = word.split("'")[0]
    joined = re.sub(r"[.\-_*·’]", "", word)
    if not re.search("[^\\W\\d]", joined):
        return joined, False
    candidate = collapse(joined.rstrip("!").translate(LEET))
    return candidate, candidate in CATEGORY


CATEGORY_SOURCE = {collapse(ascii_letters(w)): ascii_letters(w) for w in INSULTS + DEGRADING + SEXUAL}
CATEGORY_SOURCE |= {f"{k}s": f"{v}s" for k, v in list(CATEGORY_SOURCE.items())}
SPELLINGS: dict[str, list[str]] = {}
for _w in CATEGORY_SOURCE.values():
    SPELLINGS.setdefault(_w[0], []).append(_w)


class Words:
    """Sentences of a text as lists of canonical words; the memo of spellings is emptied when full, which changes speed only."""

    def __init__(self, memo: int = 300_000):
        self.memo: dict[str, tuple[str, bool]] = {}
        self.size = memo

    def clean(self, text: str) -> str:
        if not text.isascii():
            text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        return text.lower() if text.isascii() else text.casefold()

    def token(self, raw: str) -> tuple[str, bool]:
        out = self.memo.get(raw)
        if out is None:
            if len(self.memo) >= self.size:
                self.memo.clear()
            word = raw
            if not raw.isascii() and re.search("[a-z]", raw):
                word = raw.translate(LOOKALIKE)
            out = canonical(word)
            if word != raw and out[0] in CATEGORY and ascii_letters(raw) != ascii_letters(word):
                out = (out[0], True)
            if len(raw) <= 64:
                self.memo[raw] = out
        return out

    def sentences(self, text: str) -> list[str]:
        return [s for s in SENTENCE.split(self.clean(text)) if s and not s.isspace()]

    def words(self, sentence: str) -> tuple[list[str], bool]:
        """Canonical words of a cleaned sentence, and whether a lexicon word was disguised."""
        disguised = False
        if SPACED.search(sentence):
            sentence = SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), sentence)
        memo, token, out = self.memo, self.token, []
        for raw in TOKEN.findall(sentence):
            word, hidden = memo.get(raw) or token(raw)
            out.append(word)
            disguised = disguised or hidden
        return out, disguised


def signals(sentence: str, words: list[str], disguised: bool) -> list[str]:
    """Seed features of a sentence: kinds of seed words, whether somebody or a group is addressed, and whether words are only named."""
    counts: dict[str, int] = {}
    address = grouping = mention = False
    for word in words:
        kind = CATEGORY.get(word)
        if kind:
            counts[kind] = counts.get(kind, 0) + 1
        address = address or word in ADDRESS
        grouping = grouping or word in GROUPING
        mention = mention or word in MENTION
    out = []
    if not sentence.isascii() and HAN_RUN.search(sentence):
        squeezed = BETWEEN.sub("", sentence)
        for kind, pattern in HAN_KINDS:
            if hits := len(pattern.findall(squeezed)):
                counts[kind] = counts.get(kind, 0) + hits
                out.append("#han")
    if not counts:
        return []
    out += [f"#{kind}" for kind in counts] + [f"#{kind}2" for kind, n in counts.items() if n >= 2]
    if address and "insult" in counts:
        out.append("#insult+you")
    if grouping and "degrade" in counts:
        out.append("#degrade+all")
    if disguised:
        out.append("#disguised")
    if mention:
        out.append("#mention")
    return out


def lexical(words: list[str]) -> list[str]:
    """The words that weights are learned for: those with letters, longer than one letter (squeezed code is mostly single letters)."""
    return [w for w in words if len(w) > 1 and not w[0].isdigit()]


def features(sentence: str, words: list[str], disguised: bool) -> list[str]:
    """All features of a sentence: words, pairs of neighbours and signals, each once."""
    learned = lexical(words)
    out = set(learned)
    out.update(f"{a} {b}" for a, b in zip(learned, learned[1:]))
    if HAN_RUN.search(sentence):
        han = re.sub(r"[^\u3400-\u9fff]", "", sentence)
        out.update(han[i : i + 2] for i in range(len(han) - 1))
    out.update(signals(sentence, words, disguised))
    return list(out)
