"""Full-text analysis in the JVM: words, stop words and a light English stemmer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = "a an and are as at be but by for from has have he her his i if in into is it its me my no not of on or our she so that the their them then there these they this to us was we were will with you your".split()


# Plural endings, each rule on a text of whole words: ``ies`` to ``y``, ``es`` to ``e``, ``s`` dropped, with the usual exceptions.
ENDINGS = [("(?<=[b-df-z0-9])ies", "y"), ("(?<=[a-z0-9][b-df-np-z0-9])es", "e"), ("(?<=[a-z0-9]{2}[a-rtv-z0-9])s", "")]
_STOPPED = f"(?<![a-z0-9])(?:{'|'.join(STOP_WORDS)})(?![a-z0-9])"


def terms(text: Column) -> Column:
    """Stemmed ASCII words of a text in order, without stop words; null gives an empty array.

    Stop words and endings are rewritten on the whole text, so the words are split once and no lambda runs a pattern per word.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(_STOPPED), F.lit(" "))
    for pattern, replacement in ENDINGS:
        plain = F.regexp_replace(plain, F.lit(f"{pattern}(?![a-z0-9])"), F.lit(replacement))
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda word: word != "")


def stem_text(word: str) -> str:
    """The same stemmer for the few words of a query."""
    if len(word) <= 3:
        return word
    if word.endswith("ies") and word[-4:-3] not in ("a", "e"):
        return word[:-3] + "y"
    if word.endswith("es") and word[-3:-2] not in ("a", "e", "o"):
        return word[:-1]
    return word[:-1] if word.endswith("s") and word[-2:-1] not in ("u", "s") else word


def occurrences(words: Column, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the terms stand next to each other in order."""
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")
