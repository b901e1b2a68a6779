"""Column functions on text: cleaning, counting, tokens, sentences, normal forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# High-frequency Gujarati function words that the index leaves out.
STOPWORDS = (
    "અને છે હતો હતી હતું હતા તે તેઓ આ એ માં થી ને નો ની નું ના પણ કે જે જેમ માટે સાથે પર કર્યું કરી કરે હોય શકે એક તો જ શું કેમ અહીં ત્યાં હવે પછી ખૂબ બહુ"
).split()
# Inflections removed by the stemmer.
SUFFIXES = "ઓનો ઓની ઓના ઓનું ઓનાં ઓમાં ઓથી ઓને ઓએ નો ની ના નું નાં માં થી ને એ ે ો ી ું ા ં".split()
# Words that make a question of a sentence.
QUESTION_WORDS = "શું કેમ કોણ ક્યાં ક્યારે કેવી કેટલા કેટલી શા what why who where when how which is are the of in a an does did do tell me about".split()

GUJARATI = "[\u0a80-\u0aff]"
GUJARATI_DIGITS = "".join(chr(0x0AE6 + i) for i in range(10))
LETTERS_MIN = 60
LEGACY_SHARE = 0.3


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t and unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _without_joiners(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t and unicodedata.normalize("NFC", t.replace("\u200c", "").replace("\u200d", "")))


#: Characters that compose with nothing and stand as they are: Latin without combining marks, punctuation, joiners, and the Gujarati block without its nukta.
_SETTLED = "\\x00-\u02ff\u0964\u0965\u0a81-\u0abb\u0abd-\u0aff\u200b-\u200f\u2010-\u203a"


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no built-in. Only texts with other characters than _SETTLED go to Python."""
    return F.coalesce(_composed(F.when(c.rlike(f"[^{_SETTLED}]"), c)), c)


def bare(c: Column) -> Column:
    """Without joiners and composed; empty for null. One look at a text decides whether it goes to Python, and most do not."""
    c = F.coalesce(c, F.lit(""))
    return F.coalesce(_without_joiners(F.when(c.rlike(f"[^{_SETTLED}]|[\u200c\u200d]"), c)), c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value written into the plan once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def latin_digits(c: Column) -> Column:
    return F.translate(c, GUJARATI_DIGITS, "0123456789")


def to_int(c: Column) -> Column:
    """Digits of either script as a number, else null."""
    return latin_digits(c).try_cast("int")


def clean_text(c: Column) -> Column:
    """Composed, without zero-width and control characters, hyphenated line ends rejoined, white space collapsed."""
    steps = [
        ("[\u200b\u200c\u200d\ufeff]", ""), ("\r\n?", "\n"), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\ufffd]", ""),
        ("(?U)(\\w)-\n(\\w)", "$1$2"), ("[ \t\u00a0]+", " "), ("(?m)^(?U:\\s)+?(?=[^\\s]|$)|(?U:[\\s&&[^\n]])+$", ""), ("\n{3,}", "\n\n"),
    ]
    c = nfc(F.coalesce(c, F.lit("")))
    for pattern, new in steps[:5]:
        c = F.regexp_replace(c, pattern, new)
    c = F.array_join(F.transform(F.split(c, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{L}+", ""))


def readable_letter_count(c: Column) -> Column:
    """Letters outside the accented Latin blocks, where legacy fonts put their glyphs."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\P{L}\u0080-\u024f]+", ""))


def legacy_encoded(c: Column) -> Column:
    letters = letter_count(c)
    return (letters >= LETTERS_MIN) & ((letters - readable_letter_count(c)) / letters > F.lit(LEGACY_SHARE))


def language(c: Column, script: str = GUJARATI) -> Column:
    """gujarati if the script occurs at all."""
    return F.when(c.rlike(script), "gujarati").otherwise("english")


def script_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^\u0a80-\u0aff]+", ""))


def latin_letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))


def mostly_gujarati(c: Column) -> Column:
    return script_letters(c) > latin_letters(c)


def script_share(c: Column) -> Column:
    return F.coalesce(script_letters(c) / F.nullif(script_letters(c) + latin_letters(c), F.lit(0)), F.lit(0.0))


def words_of(c: Column, stopwords: list[str] | None = None) -> Column:
    """tokens() of a text that is composed and without joiners, as match_form leaves it; no Python, so it may stand in a lambda."""
    words = F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}]+", " ")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOPWORDS if stopwords is None else stopwords or [""]))


def tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of letters, digits and marks; joiners never split a word."""
    return words_of(bare(c), stopwords)


def token_estimate(own: Column, other: Column) -> Column:
    """2.4 a Gujarati word, 1.3 another, rounded down, plus 1."""
    return (own * F.lit(2.4) + other * F.lit(1.3)).cast("int") + 1


def estimate_tokens(c: Column) -> Column:
    """The estimate of a text's words; nothing for nothing."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    own = F.size(F.filter(words, lambda w: w.rlike(GUJARATI)))
    return F.when(F.size(words) == 0, 0).otherwise(token_estimate(own, F.size(words) - own))


def sentences(c: Column) -> Column:
    """Paragraphs at blank lines, then after a full stop, danda or question mark and white space."""
    parts = F.flatten(F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda p: F.split(p, r"(?<=[।॥?!.])\s+")))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(bare(c), r"(?U)\s+", " "))


@F.pandas_udf(ArrayType(StringType()))
def nfc_each(texts: pd.Series) -> pd.Series:
    """Canonical composition of each text of an array; a Python function cannot stand in a lambda."""
    return texts.map(lambda own: [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in own])


def match_form(c: Column) -> Column:
    """The form in which a quote and its source are compared."""
    return _match_form(normalize(c))


def match_forms(c: Column) -> Column:
    """match_form of each text of an array."""
    plain = nfc_each(F.transform(c, lambda t: F.regexp_replace(t, "[\u200c\u200d]", "")))
    return F.transform(plain, lambda t: _match_form(F.trim(F.regexp_replace(t, r"(?U)\s+", " "))))


def _match_form(c: Column) -> Column:
    c = F.translate(c, "“”‘’\"«»", "'" * 7)
    c = F.regexp_replace(c, "([A-Za-z])-\\s+([a-z])", "$1$2")
    return F.regexp_replace(c, "^[ .,;:!?।|\\-–—']+|[ .,;:!?।|\\-–—']+$", "")


def stem(c: Column) -> Column:
    """Without its longest known suffix, if two characters stay."""
    out = c
    for suffix in sorted(SUFFIXES, key=len):  # the longest is tested first, being outermost
        out = F.when(c.endswith(suffix) & (F.length(c) >= len(suffix) + 2), F.substring(c, 1, F.length(c) - len(suffix))).otherwise(out)
    return out


def keywords(c: Column) -> Column:
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.lower(F.regexp_replace(w, "^[?।,.]+|[?।,.]+$", "")).isin(QUESTION_WORDS))
    return F.coalesce(F.nullif(F.regexp_replace(F.array_join(words, " "), "^[?। ]+|[?। ]+$", ""), F.lit("")), c)


def join_overlapping(a: Column, b: Column) -> Column:
    """a and b without the text that ends a and begins b (8 characters at least), else joined by a space."""
    head = F.substring(b, 1, 8)
    whole = F.concat_ws(" ", a, b)
    cut = lambda p: F.concat(F.substr(a, F.lit(1), p - 1), b)

    def joined(first: Column) -> Column:
        """first: where b's opening occurs first in a; most texts hold it nowhere or there."""
        at = F.filter(F.sequence(first, F.greatest(F.length(a), first)), lambda p: (F.length(a) - p + 1 >= 8) & F.startswith(b, F.substr(a, p)))
        return F.when(first == 0, whole).when(F.startswith(b, F.substr(a, first)), cut(first)).when(F.size(at) > 0, cut(F.element_at(at, 1))).otherwise(whole)

    return let(F.when(F.length(head) == 8, F.instr(a, head)).otherwise(0), joined)


def search_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(bare(c), r"\s+", " ")))


def holds_all_words(haystack: Column, words: str) -> Column:
    """Every word of the query, in the form of search_key, occurs; a blank query matches all."""
    out = F.lit(True)
    for word in unicodedata.normalize("NFC", re.sub("[\u200c\u200d]", "", words)).lower().split():
        out = out & F.contains(haystack, F.lit(word))
    return out


def display_title(title: Column, filename: Column) -> Column:
    stem_ = F.regexp_replace(filename, r"(?i)\.pdf$", "")
    given = F.trim(F.coalesce(title, F.lit("")))
    nice = F.trim(F.regexp_replace(stem_, "[_\\-]+", " "))
    return F.when((given != "") & (given != stem_), given).otherwise(F.coalesce(F.nullif(nice, F.lit("")), filename))
