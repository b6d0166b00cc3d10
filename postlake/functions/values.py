"""Column expressions that put messy field values on fixed scales."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.text import (
    CYRILLIC, SPACE, _H, _col, blank_as_null, collapse, lookup, strip,
)

# Decimal numbers only: no 'inf', 'nan' or typed literals such as '1d'.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (rf"\A([+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)"
           rf"{SPACE}*([{''.join(vocab.MAGNITUDES)}]?)\z")


def number(c) -> Column:
    """Number written in text ('$180k', '250 000', '1.5M'); null when there is none.

    A number too large for a double comes out as infinity.
    """
    text = F.regexp_replace(_col(c).cast("string"), rf"[{vocab.CURRENCY_SIGNS},{_H}]+", "")
    text = F.btrim(text, F.lit("\n"))  # the only space that is left
    digits = F.replace(F.regexp_extract(text, _NUMBER, 1), F.lit("_"), F.lit(""))
    # Of a text that is a number, the last character is the magnitude or none.
    factor = F.coalesce(lookup(vocab.MAGNITUDES, F.substring(text, -1, 1)), F.lit(1.0))
    return digits.try_cast("double") * factor


def period_unit(c, periods=None) -> Column:
    """'year', 'month' or 'hour', null when the period is not known."""
    return lookup(periods or vocab.PERIODS, F.lower(strip(c)))


def monthly(amount, period, periods=None) -> Column:
    """Whole amount per month, ties to even; null when either part is unusable."""
    periods = periods or vocab.PERIODS
    key = F.lower(strip(period))
    # Times one or over one changes nothing, so one formula serves all units.
    times = lookup({p: vocab.HOURS_PER_MONTH if u == "hour" else 1.0 for p, u in periods.items()}, key)
    over = lookup({p: float(vocab.MONTHS_PER_YEAR) if u == "year" else 1.0 for p, u in periods.items()}, key)
    return F.bround(number(amount) * times / over, 0).try_cast("bigint")


def enum_key(c) -> Column:
    """Lower-case lookup key of an enum-like string."""
    return F.replace(F.lower(collapse(strip(c))), F.lit("_"), F.lit("-"))


def _enum(c, mapping: dict) -> Column:
    # A blank word is never looked up, whatever the vocabulary says.
    stated = {k: v for k, v in mapping.items() if k not in vocab.BLANKS}
    return F.coalesce(lookup(stated, enum_key(c)), F.lit("unknown"))


def seniority(c, mapping=None) -> Column:
    return _enum(c, mapping or vocab.SENIORITY)


def employment(c, mapping=None) -> Column:
    return _enum(c, mapping or vocab.EMPLOYMENT)


def remote_policy(c, flag=None, mapping=None) -> Column:
    """Work mode from text, or from a yes/no flag where there is one.

    A flag of false says nothing about an office, so it means unknown.
    """
    text = _enum(c, mapping or vocab.REMOTE)
    if flag is None:
        return text
    flag = _col(flag)
    return F.when(flag, F.lit("remote")).when(~flag, F.lit("unknown")).otherwise(text)


def currency(c, mapping=None) -> Column:
    """ISO code of a sign or word; any other three Latin letters pass upper-cased."""
    key = F.lower(blank_as_null(c))
    return F.coalesce(lookup(mapping or vocab.CURRENCIES, key),
                      F.when(key.rlike(r"\A[a-z]{3}\z"), F.upper(key)))


def first_currency(c, mapping=None) -> Column:
    """ISO code of the first currency sign in free text."""
    sign = F.regexp_extract(_col(c), f"([{vocab.FREE_TEXT_SIGNS}])", 1)
    return F.when(sign != "", currency(sign, mapping))


def fold_lookalikes(c) -> Column:
    """Latin spelling of a word typed with look-alike letters, if that makes it Latin."""
    c = _col(c)
    folded = F.translate(c, vocab.LOOKALIKES_CYRILLIC, vocab.LOOKALIKES_LATIN)
    return F.when(folded.rlike(CYRILLIC), c).otherwise(folded)


def skills(c, aliases=None, stoplist=None) -> Column:
    """Canonical skill names of an array, each once, in order of first mention."""
    aliases, stoplist = aliases or vocab.SKILL_ALIASES, stoplist or vocab.SKILL_STOPLIST
    # One pass per step: a lambda has no shared subexpressions, so nesting the
    # steps in one would evaluate the early ones many times per item.
    stated = F.transform(_col(c), strip)
    keys = F.transform(stated, lambda x: F.when(F.lower(x).isin(list(vocab.BLANKS)), None)
                       .when(_plain(x), F.lower(collapse(x)))
                       .otherwise(F.lower(collapse(fold_lookalikes(x)))))
    known = F.transform(keys, lambda k: F.when(~k.isin(list(stoplist)), F.coalesce(
        lookup(aliases, k), F.when(_plain(k), k), F.when(~k.rlike(CYRILLIC), k))))
    # Without nulls, each once.
    return F.array_except(known, F.array(F.lit(None).cast("string")))


def _plain(c: Column) -> Column:
    """True for text of one-byte characters, which has no look-alikes."""
    return F.octet_length(c) == F.char_length(c)


def skill(c, aliases=None, stoplist=None) -> Column:
    """Canonical name of one skill, null when it is dropped."""
    return F.try_element_at(skills(F.array(_col(c)), aliases, stoplist), F.lit(1))


def salary_bounds(low, high) -> Column:
    """'low-high', 'up to high', 'from low' or null, of two texts or nulls."""
    low, high = _col(low), _col(high)
    return (F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low, high))
            .when(high.isNotNull(), F.concat(F.lit("up to "), high))
            .when(low.isNotNull(), F.concat(F.lit("from "), low)))
