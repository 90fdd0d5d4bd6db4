"""Text analysis for search: tokens, prefixes, transliteration and query policies."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 40
#: Letters above ASCII whose decomposition starts with an ASCII letter, by rule; and those folded to two.
_FOLD = {c: d for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFKD", c)[0].lower()).isascii() and d.isalpha()}
_FOLD |= {"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d", "ħ": "h", "ı": "i"}
_TWO = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
#: Letters of two scripts and how they are written in Latin.
_LATIN = dict(zip("абвгдезиклмнопрстуфыэйъьєіїґ", ["a", "b", "v", "g", "d", "e", "z", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "y", "e", "i", "", "", "ie", "i", "yi", "g"], strict=True))
_LATIN |= {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io"}
_LATIN |= dict(zip("αβγδεζηικλμνξοπρσςτυφω", "abgdezeiklmnxoprsstyfo", strict=True)) | {"θ": "th", "χ": "kh", "ψ": "ps", "ά": "a", "έ": "e", "ή": "e", "ί": "i", "ό": "o", "ύ": "y", "ώ": "o"}


def fold(text: Column) -> Column:
    """Lower case without accents."""
    out = F.translate(F.lower(text), "".join(_FOLD), "".join(_FOLD.values()))
    for letter, two in _TWO.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; those of more than 40 letters are dropped."""
    return F.transform(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0), lambda t: F.octet_length(t) <= LONGEST), fold)


def plain_tokens(text: str) -> list[str]:
    """The same for a string on the driver, such as a rule's."""
    table = {ord(k): v for k, v in (_FOLD | _TWO).items()}
    return [t.lower().translate(table) for t in re.findall(r"[^\W_]+", text) if len(t.encode()) <= LONGEST]


def transliterate(text: Column) -> Column:
    """Cyrillic and Greek letters in Latin ones, quotes dropped; null where nothing changes."""
    out = F.lower(text)
    one = {k: v for k, v in _LATIN.items() if len(v) == 1}
    for letter, many in _LATIN.items():
        if len(many) != 1:
            out = F.replace(out, F.lit(letter), F.lit(many)) if many else F.replace(out, F.lit(letter))
    out = F.regexp_replace(F.translate(out, "".join(one), "".join(one.values())), "['\"`]", "")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), out)


def edge_ngrams(words: Column, longest: int = 12) -> Column:
    """The distinct beginnings of all words, sorted."""
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length(w))), lambda n: F.substring(w, F.lit(1), n)))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def fuzzy_distance(token: Column) -> Column:
    """How many edits a token may have: none with a digit or up to three letters, one up to seven, else two."""
    return F.when(token.rlike("[0-9]") | (F.char_length(token) <= 3), 0).when(F.char_length(token) <= 7, 1).otherwise(2)


def last_is_prefix(query: Column, autocomplete: Column) -> Column:
    return autocomplete & ~query.rlike(r"\s$")


def osm_key(kind: Column, number: Column) -> Column:
    return F.concat(kind, number.cast("string"))


def place_ref(text: Column) -> Column:
    """struct<kind,number> of `N1`, `w2`, `R3`, `P4`; null for all else."""
    t = F.upper(F.trim(text))
    return F.when(t.rlike("^[NWRP][0-9]{1,18}$"), F.struct(F.substring(t, 1, 1).alias("kind"), F.substring(t, 2, 18).cast("long").alias("number")))


def numeric_housenumber(text: Column) -> Column:
    return F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).cast("int"))


def localized(names: Column, name: Column, lang: Column) -> Column:
    return F.coalesce(F.element_at(names, lang), name)


def split_names(names: Column, base: str) -> Column:
    """struct<name,names> from a map with `base` and `base:<lang>` keys."""
    own = F.map_filter(names, lambda k, v: k.startswith(base + ":"))
    return F.struct(F.element_at(names, base).alias("name"), F.transform_keys(own, lambda k, v: F.substring(k, len(base) + 2, 40)).alias("names"))


def _swaps(word: Column) -> Column:
    """All words that a swap of two neighbouring letters makes of a word."""
    at = F.sequence(F.lit(1), F.greatest(F.char_length(word) - 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, F.char_length(word))))


def osa_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Edits between two words where swapping neighbours is one, up to `most` (1 or 2); null beyond.

    Levenshtein gives all but swaps; what a single swap and an edit explain is found by trying each swap of `a`, and two
    swaps by meeting in the middle: one of `a` gives what one of `b` does.
    """
    direct = F.levenshtein(a, b, most)
    after = F.array_min(F.filter(F.transform(_swaps(a), lambda s: F.levenshtein(s, b)), lambda d: d <= most - 1))
    best = F.least(F.when(direct >= 0, direct), after + 1)
    if most >= 2:
        best = F.least(best, F.when((F.char_length(a) == F.char_length(b)) & F.arrays_overlap(_swaps(a), _swaps(b)), 2))
    return F.when(best <= most, best)
