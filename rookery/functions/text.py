"""Words, stems and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in a question or a class body.
NOISE = (
    "a an the is are was were be been do does did done how what which who whom whose where when why "
    "of to in on at by for from with without and or not no it its this that these those there here "
    "can could should would will shall may might must i we you they me my our your about any all "
    "class classes code file files find show tell explain used use using talk talks work works "
    "get set has have had if else then than so as into out up over "
    "public private protected static final void return returns new null true false this super extends "
    "implements import package throws throw try catch finally int long boolean string var "
    "override java"
).split()


#: Where a word ends: at anything but letters and digits, before a capital that follows a small letter or digit or that begins a word
#: after an acronym, and between letters and digits.
WORD_EDGE = "[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def stem(word: Column) -> Column:
    """A rough stem of a lower-case word, so that singular and plural, "handled" and "handle" meet."""
    n = F.length
    plural = F.when((n(word) > 4) & word.endswith("sses"), word.substr(F.lit(1), n(word) - 2)).when((n(word) > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), word.substr(F.lit(1), n(word) - 1)).otherwise(word)
    tense = lambda w: F.when((n(w) > 5) & w.endswith("ing"), w.substr(F.lit(1), n(w) - 3)).when((n(w) > 4) & w.endswith("ed"), w.substr(F.lit(1), n(w) - 2)).otherwise(w)
    mute = lambda w: F.when((n(w) > 3) & w.endswith("e"), w.substr(F.lit(1), n(w) - 1)).otherwise(w)
    return F.when((n(word) > 4) & word.endswith("ies"), F.concat(word.substr(F.lit(1), n(word) - 3), F.lit("y"))).otherwise(mute(tense(plural)))


def split_words(text: Column) -> Column:
    """Lower-case words of camelCase, acronyms, snake_case, paths and digits; of two characters or more and not only digits."""
    return F.filter(F.transform(F.split(text, WORD_EDGE), F.lower), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))


def is_noise(word: Column) -> Column:
    return word.isin(NOISE)


def tokenize(text: Column) -> Column:
    """Stems of the words that are no noise."""
    return F.transform(F.filter(split_words(text), lambda w: ~is_noise(w)), stem)


def norm_key(key: Column) -> Column:
    """Spring's relaxed form of a property key: case, hyphens and underscores don't count."""
    return F.regexp_replace(F.lower(key), "[-_]", "")


CONTROLS = r"[\x00-\x1f\x7f-\x9f]+"


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, " ")


def truncate(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)
