"""Text functions of bibliographic cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that are restored, and what ends of terms lose.
ENTITIES = {"&amp;": "&", "&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&times;": "*", "&reg;": "", "&micro;": "mu", "&mdash;": "-", "&lgr;": "lambda", "&sgr;": "sigma"}
PUNCTUATION = " .,;:!?'\"()[]{}-"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trim_leading(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+", "")


def trim_trailing(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def trim_punctuation(c: Column) -> Column:
    return F.btrim(c, F.lit(PUNCTUATION))


def restore_entities(c: Column, names=tuple(ENTITIES)) -> Column:
    """The named entities, ampersands last: what they bring forth is not read again."""
    for name in sorted(names, key=lambda n: n == "&amp;"):
        c = F.replace(c, F.lit(name), F.lit(ENTITIES[name]))
    return c


def any_of(left: str, words: list[str], right: str) -> str:
    """A regular expression of alternatives between two bounds."""
    return left + "(" + "|".join(words) + ")" + right


def capitals(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Z]"))


def decapitalised(c: Column) -> Column:
    """Words' first capitals in lower case, but for capitals that another one follows; words in capitals only stay whole."""
    words = F.regexp_extract_all(c, F.lit(r"\w+|\W+"), F.lit(0))
    low = lambda w: F.when(w.rlike(r"^[A-Z](?:[^A-Z]|$)"), F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000_000))).otherwise(w)
    return F.when(~c.rlike("[A-Z]") | (~c.rlike("[a-z]") & c.rlike("[A-Z]{2}")), c).otherwise(F.array_join(F.transform(words, low), ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\w+"))


def word_count_without(c: Column, stop: list[str]) -> Column:
    return F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0)), lambda w: ~w.isin(stop)))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.array_join(c, "','"), F.lit("'"))


def case_variants(c: Column) -> Column:
    low = F.lower(c)
    return F.array_distinct(F.array(low, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1_000_000)), F.initcap(low), F.upper(c)))


def clean_term(c: Column) -> Column:
    """A taxonomy term: underscores to blanks, namespace and escapes resolved."""
    return F.trim(F.url_decode(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"^[A-Za-z]+:", ""), r"%(?![0-9A-Fa-f]{2})", "%25")))


def illegal(c: Column) -> Column:
    return c.rlike(r"  |[<>{}]")


def title_words(c: Column, stop: list[str]) -> Column:
    """Lower-case words of a title without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(stop))


def grams(words: Column) -> Column:
    """Distinct adjacent pairs."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def without_publisher(c: Column, publishers: list[str]) -> Column:
    """A title without trailing publisher, year, page range and binding notes."""
    names = "|".join(sorted((re.escape(p) for p in publishers), reverse=True)) or "(?!)"
    c = F.regexp_replace(c, rf"[\s,.;:(]+(?:{names})\b.*$", "")
    c = F.regexp_replace(c, r"(?i)[\s,(]+(?:hardcover|paperback|book review)\)?\.?$", "")
    c = F.regexp_replace(c, r"[\s,;:]+(?:pp?\.?\s*)?\d+\s*-\s*\d+\.?$", "")
    return F.regexp_replace(c, r"[\s,(]+(?:19|20)\d{2}\)?\.?$", "")
