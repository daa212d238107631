"""Scalar text functions as column expressions."""

from __future__ import annotations

import re._constants as C
import re._parser as parser
import unicodedata
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import rules

#: Letters of word counting are ASCII; a word may go on with digits, apostrophes and hyphens.
WORD, ALPHA_WORD = "[A-Za-z0-9][A-Za-z0-9'-]*", "[A-Za-z][A-Za-z'-]*"
QUOTES = " \t\"'«»“”‘’#"


#: Any character but ASCII, and those above it that are common and that NFKC leaves alone.
UNSETTLED = "[^\\x00-\\x7f¡-§©«¬®°±¶·»¿À-ÿ–—‘’“”•€]"
#: Letters other than ASCII ones that patterns take for them when they ignore case, and those.
ALIKE, ASCII = "İıſ\u212a", "iisk"
#: A pattern's needles: alternatives at most, characters of one at least, one if it is a sign.
MOST_NEEDLES, NEEDLE = 8, 2


class Line(NamedTuple):
    """A text with what many tests need of it as columns, so that it is worked out once."""

    text: Column
    low: Column | None = None
    words: Column | None = None
    alpha: Column | None = None
    letters: Column | None = None
    capitals: Column | None = None
    name: str | None = None  # of the column that has the text, for SQL
    key: str | None = None  # of the column that has its exact_key


#: Names of the columns that with_parts() adds.
PARTS = ("p_low", "p_words", "p_alpha", "p_letters", "p_capitals")


def with_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns PARTS of the text for line(); drop them when no test is left."""
    t = F.col(text)
    low = df.withColumn("p_low", F.lower(F.translate(t, ALIKE, ASCII)))
    return low.withColumns({"p_words": F.split("p_low", r"(?U)\W+"), "p_alpha": alpha_words(t), "p_letters": letters(t), "p_capitals": capitals(t)})


def line(text: str = "text", key: str | None = "norm") -> Line:
    return Line(*map(F.col, (text, *PARTS)), text, key)


def bare(text: str) -> Line:
    """A text column without parts."""
    return Line(F.col(text), name=text)


def literal(text: str) -> str:
    """A SQL literal of the text."""
    quote = next((q for q in "'\"" if q not in text), None)
    return f"r{quote}{text}{quote}" if quote else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_in(name: str, values: tuple[str, ...]) -> Column:
    """Whether the column of that name has one of the values; one expression, however many there are."""
    return F.expr(f"{name} IN ({', '.join(map(literal, values))})")


def matches_sql(x: Line, pattern: str, case: bool = False) -> str:
    """matches() of a text with a name, as SQL."""
    found = f"{x.name} RLIKE {literal(rx(pattern, case))}"
    if x.low is None or not needles(pattern):
        return found
    return f"(({' OR '.join(f'contains(p_low, {literal(n)})' for n in needles(pattern))}) AND {found})"


def parts(text: Column | Line) -> Line:
    return text if isinstance(text, Line) else Line(text)


@cache
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which a text holds one at least if the pattern matches in it; none if unknown."""

    def least(options: tuple[str, ...]) -> tuple[int, int]:
        """How telling the least telling one is; a sign is worth two letters."""
        return min((sum(1 if c.isalnum() or c == " " else NEEDLE for c in x) for x in options), default=0), -len(options)

    def of(tree: list) -> tuple[str, ...]:
        found, run = [], ""
        for op, arg in [*tree, (None, None)]:
            if op is C.LITERAL:
                run += chr(arg).lower()
                continue
            found.append((run,))
            run = ""
            if op is C.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is C.BRANCH:
                sides = [of(x) for x in arg[1]]
                found.append(tuple(dict.fromkeys(n for s in sides for n in s)) if all(s and all(s) for s in sides) else ())
            elif op is C.MAX_REPEAT and arg[0] > 0:
                found.append(of(arg[2]))
        return max(found, key=least)

    best = of(parser.parse(pattern))
    return best if least(best)[0] >= NEEDLE and len(best) <= MOST_NEEDLES else ()


def rx(pattern: str, case: bool = False) -> str:
    """A rule's pattern for Java: Unicode classes, and case ignored unless `case`."""
    return ("(?U)" if case else "(?iuU)") + pattern


def matches(text: Column | Line, pattern: str, case: bool = False) -> Column:
    """Whether the pattern matches anywhere; of a Line only where one of the pattern's needles is."""
    x = parts(text)
    if x.name:
        return F.expr(matches_sql(x, pattern, case))
    found = x.text.rlike(rx(pattern, case))
    if x.low is None or not needles(pattern):
        return found
    first, *more = (x.low.contains(n) for n in needles(pattern))
    for other in more:
        first = first | other
    return first & found


def has_word(text: Column | Line, words: tuple[str, ...]) -> Column:
    """Whether one of the words, in lower-case ASCII, stands in the text as a word."""
    x = parts(text)
    return matches(x, rf"\b({'|'.join(words)})\b") if x.words is None else F.expr(f"arrays_overlap(p_words, array({', '.join(map(literal, words))}))")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in function has it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


nfkc = nfkc.asNondeterministic()  # else a filter on its result would run it once more


def collapse_space(text: Column) -> Column:
    """Without soft hyphens, white-space runs as one space, trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00ad"), F.lit("")), r"(?U)\s+", " "))


def composed(text: Column) -> Column:
    """The text after NFKC; only texts with a character that it may change go through Python."""
    return F.coalesce(nfkc(F.when(text.rlike(UNSETTLED), text)), text)


def normalize_space(text: Column, compose: bool = True) -> Column:
    """collapse_space after NFKC; without `compose`, for text known to be composed, collapse_space alone."""
    return collapse_space(composed(F.coalesce(text, F.lit(""))) if compose else text)


def exact_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces between runs of them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def alpha_words(text: Column | Line) -> Column:
    x = parts(text)
    return F.regexp_extract_all(x.text, F.lit(f"({ALPHA_WORD})"), F.lit(1)) if x.alpha is None else x.alpha


def letters(text: Column | Line) -> Column:
    x = parts(text)
    return F.length(F.regexp_replace(x.text, r"\P{L}+", "")) if x.letters is None else x.letters


def capitals(text: Column | Line) -> Column:
    x = parts(text)
    return F.length(F.regexp_replace(x.text, r"\P{Lu}+", "")) if x.capitals is None else x.capitals


def letter_ratio(text: Column | Line) -> Column:
    """Letters among characters that are no white space; 0 if there are none."""
    return F.coalesce(F.try_divide(letters(text), F.length(F.regexp_replace(parts(text).text, r"(?U)\s+", ""))), F.lit(0.0))


def mostly_all_caps(text: Column | Line) -> Column:
    return (letters(text) >= 6) & (capitals(text) >= 0.82 * letters(text))


def capitalised_share(word_list: Column) -> Column:
    """Share of words that begin with a capital; 0 without words."""
    return F.coalesce(F.try_divide(F.size(F.filter(word_list, lambda w: w.rlike("^[A-Z]"))), F.size(word_list)), F.lit(0.0))


def mostly_title_or_caps(text: Column | Line) -> Column:
    return mostly_all_caps(text) | (capitalised_share(alpha_words(text)) >= 0.6)


def starts_capitalised(text: Column) -> Column:
    return F.regexp_extract(text, r"(\p{L})", 1).rlike(r"^\p{Lu}")


def starts_lower(text: Column) -> Column:
    return F.regexp_extract(text, r"(\p{L})", 1).rlike(r"^\p{Ll}")


def ends_with_period(text: Column) -> Column:
    """Ends like a sentence: a period that does not close a short capitalised abbreviation."""
    return text.rlike(r"(?U)\.\s*$") & ~text.rlike(r"(?U)\b[A-Z][a-z]{0,3}\.\s*$")


def _last_word_dangles(word_list: Column) -> Column:
    return F.lower(F.element_at(word_list, -1)).isin(*rules.DANGLING)


def ends_incomplete(text: Column) -> Column:
    """Two words or more, of which the last is a function word."""
    return F.coalesce(F.when(word_count(text) >= 2, _last_word_dangles(words(text))), F.lit(False))


def is_cover_particle(text: Column) -> Column:
    """A single word, and a function word."""
    return F.coalesce(F.when(word_count(text) == 1, _last_word_dangles(words(text))), F.lit(False))


def is_title_fragment(a_key: Column, b_key: Column) -> Column:
    """Whether one of two keys is within the other, both not empty."""
    return (a_key != "") & (b_key != "") & (a_key.contains(b_key) | b_key.contains(a_key))


def matches_filename(title: Column, filename: Column) -> Column:
    """Whether the title is the file's name without folder and extension, six characters or more."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    return F.coalesce((alnum(title) == alnum(stem)) & (F.length(alnum(title)) >= 6) & (filename != ""), F.lit(False))


def clean_metadata_title(title: Column, compose: bool = True) -> Column:
    text = normalize_space(title, compose)
    text = F.regexp_replace(text, rx(r"\s*[|_].*?\bMedium\s*$"), "")
    return collapse_space(F.translate(F.regexp_replace(text, "^#+", ""), "_", " "))


def is_garbled(text: Column) -> Column:
    """Whether the first 5000 characters are decoding junk rather than text."""
    sample = F.substring(text, 1, 5000)
    size = F.length(sample)
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
    controls = F.regexp_count(sample, F.lit(control))
    compact = F.regexp_replace(sample, r"(?U)[\s\x1c-\x1f]+", "")
    # The counts are only taken where there is something to count.
    return (
        (
            sample.rlike(control)
            & (
                (controls >= 8)
                | ((controls >= 2) & (controls > 0.015 * size))
                | (F.regexp_count(sample, F.lit(r"\x03")) >= 2)
                | (F.regexp_count(sample, F.lit(r"\x00")) >= 2)
            )
        )
        | sample.rlike("^,[A-Z]{6,}")
        | (compact == "")
        | (sample.contains("�") & (F.regexp_count(sample, F.lit("�")) > 0.05 * size))
        | (sample.contains("(") & (F.regexp_count(sample, F.lit(r"(?i)\(cid:\d+\)")) >= 8))
        | (letters(compact) < 0.25 * F.length(compact))
    )


def unquoted(text: Column, compose: bool = True) -> Column:
    """A line with single spaces, without quotes around it."""
    return F.btrim(normalize_space(text, compose), F.lit(QUOTES))


def cut_glued(text: Column) -> Column:
    """An unquoted line without copyright notices and what publishers' pages glue to its end."""
    t = F.regexp_replace(text, r"(?U)\s*\(\s*©[^)]*\)", " ")
    for cut in (r"(?U)\s+©\s+.*$", rx(r"\s+you\s+may\s+also\s+like\b.*$"), rx(r"^paper\s*[•·\-]?\s*open\s+access\s*"),
                rx(r"\s+(?:e-?issn|M\.?\s*Tech|Department\s+Of)\b.*$")):
        t = F.regexp_replace(t, cut, "")
    t = F.regexp_replace(t, r"(?U)([A-Za-z])\s+[A-Z]\.[A-Z][a-z]+\s+[A-Z][a-z]+.*$", "$1")
    return collapse_space(t)


#: Strings of which cut_glued() finds one, in the folded text, where it cuts anything; else two initials.
GLUED = ("©", "also", "paper", "issn", "tech", "department")


def clean_line(text: Column, compose: bool = True) -> Column:
    return cut_glued(unquoted(text, compose))


def with_clean_lines(df: DataFrame, compose: bool = True) -> DataFrame:
    """clean_line() of the column text; the patterns are only tried where they can match."""
    low = F.lower(F.translate("text", ALIKE, ASCII))
    glued = F.col("text").rlike(r"[A-Z]\.[A-Z][a-z]")
    for needle in GLUED:
        glued = glued | F.col("p_low").contains(needle)
    out = df.withColumn("text", unquoted(F.col("text"), compose)).withColumn("p_low", low)
    return out.withColumn("text", F.when(glued, cut_glued(F.col("text"))).otherwise(F.col("text"))).drop("p_low")
