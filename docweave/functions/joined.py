"""Words that recognition has run together, parted again: repeated words, known names, providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.textnorm import bound

# Given names that part a joined word, in order of precedence; words that stand apart in provider names.
NAME_TOKENS = ("SURAJUDEEN", "TEMIDAYO", "EMMANUEL", "MICHAEL", "EDWARD", "OGUNNAIKE", "OLABODE", "EBUBE")
PROVIDER_WORDS = (("Abuja", "Electricity"), ("Electricity", "Distribution"), ("Distribution", "Prepaid"))
#: Shorter words are left as they are, and so is a rest of so few letters.
LEAST_WORD, LEAST_REST = 8, 2


def _blanks(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[ \t\r\f\x0B]+", " "))


def _capital(word: Column) -> Column:
    return (F.length(word) >= LEAST_WORD) & F.regexp_like(word, F.lit(r"\p{Lu}")) & (word == F.upper(word))


def halves(word: Column) -> Column:
    """A word of capitals that is another one twice, as those two; any other word alone. An array."""
    size = F.length(word)
    half = F.substr(word, F.lit(1), (size / 2).cast("int"))
    twice = _capital(word) & (size % 2 == 0) & (word == F.concat(half, half))
    return F.when(twice, F.array(half, half)).otherwise(F.array(word))


def _parted(word: Column) -> Column:
    """A word cut once before or behind the first known name it begins or ends with; that name alone is whole."""
    cuts = []
    for name in NAME_TOKENS:
        long_ = F.length(word) > len(name) + LEAST_REST
        cuts.append(F.when(word == name, F.array(word)))
        cuts.append(F.when(F.startswith(word, F.lit(name)) & long_, F.array(F.lit(name), F.substr(word, F.lit(len(name) + 1)))))
        cuts.append(F.when(F.endswith(word, F.lit(name)) & long_, F.array(F.substr(word, F.lit(1), F.length(word) - len(name)), F.lit(name))))
    return F.when(_capital(word), F.coalesce(*cuts, F.array(word))).otherwise(F.array(word))


def readable_name(value: Column) -> Column:
    """A printed name in capitals with its words apart; null for null.

    Parts at changes from small to capital letters, words that are repeated, and known names in joined ones, as often as they
    are found. A first word that ends with the second one loses it to a word of its own. A pass cuts each word once,
    and there are as many passes as a word can have names.
    """
    parted = _blanks(F.regexp_replace(_blanks(value), r"([a-z])([A-Z])", "$1 $2"))
    words = F.flatten(F.transform(F.filter(F.split(parted, r"\s+"), lambda w: w != ""), lambda w: halves(w)))
    least = min(map(len, NAME_TOKENS))
    passes = F.sequence(F.lit(1), (F.length(parted) / least).cast("int") + 1)
    apart = F.aggregate(passes, words, lambda all_, _: F.flatten(F.transform(all_, lambda w: _parted(w))))

    def without_tail(found: Column) -> Column:
        first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        tail = (F.length(first) > F.length(second) + 2) & F.endswith(first, second)
        head = F.concat(F.substr(first, F.lit(1), F.length(first) - F.length(second)), F.lit(" "), second)
        start = F.when(F.coalesce(tail, F.lit(False)), head).otherwise(first)
        return F.concat_ws(" ", start, F.slice(found, F.lit(2), F.size(found)))

    return F.when(value.isNotNull(), F.upper(_blanks(bound(apart, without_tail))))


def readable_provider(value: Column) -> Column:
    """A provider as printed, with a space where a capital follows a small letter or two known words meet."""
    out = F.regexp_replace(_blanks(value), r"([a-z])([A-Z])", "$1 $2")
    for left, right in PROVIDER_WORDS:
        out = F.regexp_replace(out, f"(?i)({left})({right})", "$1 $2")
    return _blanks(out)
