"""Line classifiers as column expressions over the cleaned text and its word count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import rules
from foliant.functions.text import (
    Line,
    alpha_words,
    capitals,
    ends_with_period,
    exact_key,
    has_word,
    is_in,
    letters,
    literal,
    matches,
    matches_sql,
    mostly_all_caps,
    mostly_title_or_caps,
    parts,
    starts_lower,
)

Text = Column | Line


def first_match(text: Text, table: tuple[tuple[str, str], ...]) -> Column:
    """Reason of the first rule that matches, or null."""
    x, out = parts(text), None
    if x.name:
        return F.expr(f"CASE {' '.join(f'WHEN {matches_sql(x, p)} THEN {literal(r)}' for p, r in table)} END")
    for pattern, reason in table:
        hit = matches(text, pattern)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return out


def boilerplate_reason(text: Text) -> Column:
    x, never = parts(text), (*rules.NEVER_TITLES, *rules.GENERIC_TITLES)
    known = is_in(x.key, never) if x.key else exact_key(x.text).isin(*never)
    return F.when(known, "boilerplate").otherwise(first_match(text, rules.LINE_RULES))


def venue_reason(text: Text) -> Column:
    return first_match(text, rules.VENUE_RULES)


def looks_topical(text: Text) -> Column:
    return has_word(text, rules.TOPICAL)


def is_venue_line(text: Text, venue: Column, n_words: Column) -> Column:
    """The whole line names a journal or the like, rather than being a title about one."""
    named = F.coalesce(venue.isin("journal", "proceedings", "transactions"), F.lit(False))
    return named & (n_words <= 14) & ~parts(text).text.contains(":") & ~matches(text, rules.VENUE_EXEMPT)


def _is_name_token(w: Column) -> Column:
    shouted = (F.length(w) > 2) & (F.upper(w) == w) & (F.lower(w) != w)
    return w.rlike(rules.NAME_TOKEN) & ~F.lower(w).isin(*rules.NAME_STOPS) & ~shouted


def looks_like_person_names(text: Text, n_words: Column, topical: Column) -> Column:
    tokens = F.regexp_extract_all(parts(text).text, F.lit(r"([A-Za-z][A-Za-z.'’-]*)"), F.lit(1))
    count = F.size(tokens)
    named = F.size(F.filter(tokens, _is_name_token))
    initial = F.exists(tokens, lambda w: w.rlike(rules.INITIALS))
    two = (
        (n_words == 2)
        & (named == 2)
        & F.forall(tokens, lambda w: w.rlike("^[A-Z][a-z]{2,20}$"))
        & ~F.exists(tokens, lambda w: F.lower(w).isin(*rules.NAME_NOUNS))
    )
    return (
        ~topical
        & n_words.between(2, 12)
        & ~has_word(text, rules.NOT_A_NAME)
        & ~matches(text, rules.NOT_A_NAME_EITHER)
        & ~matches(text, r"\d{3,}")
        & (count >= 2)
        & (named >= 0.75 * count)
        & (initial | (named >= 4) | two)
    )


def looks_like_author(text: Text, n_words: Column, topical: Column) -> Column:
    """Names, affiliations, addresses."""
    t = parts(text).text
    commas = F.length(t) - F.length(F.replace(t, F.lit(",")))
    plain = ~topical & (
        matches(text, rules.INSTITUTION)
        | matches(text, rules.AFFILIATION)
        | ((n_words <= 22) & (commas >= 2))
        | ((n_words <= 18) & (commas >= 1) & matches(text, rules.CONJUNCTION))
        | ((n_words <= 10) & matches(text, rules.TWO_NAMES, case=True))
    )
    # rules.NAME_LIST name by name: as one pattern it would recurse once for each name.
    listed = (n_words <= 16) & (commas >= 1) & F.forall(F.split(t, ","), lambda name: matches(name, rules.NAME_LIST_PART))
    return (
        (t.contains("/") & matches(text, rules.ID_CODE, case=True))
        | (t.contains("@") & matches(text, rules.EMAIL, case=True))
        | matches(text, rules.CORRESPONDING)
        | plain
        | listed
        # The second pattern tries four words from every letter; its end alone is cheap to look for.
        | ((commas >= 1) & matches(text, r"[\d*†‡]\s*,\s*[^\W\d_]", case=True) & matches(text, rules.MARKED_NAME, case=True))
        | ((commas >= 1) & matches(text, rules.TWO_INITIALS, case=True))
        | looks_like_person_names(text, n_words, topical)
    )


def looks_like_fragment(text: Text, n_words: Column) -> Column:
    """The middle of a paragraph."""
    t = parts(text).text
    return (starts_lower(t) & (n_words >= 6)) | ((n_words >= 8) & matches(F.ltrim(t), rules.FRAGMENT_OPENER))


def looks_like_sentence(text: Text, n_words: Column, topical: Column) -> Column:
    t = parts(text).text
    finite = has_word(text, rules.FINITE_VERBS)
    titled = mostly_title_or_caps(text)
    opener = matches(t, rules.SENTENCE_OPENER)
    return (
        ((n_words >= 10) & matches(t, rules.SENTENCE_SUBJECT) & finite)
        | ((n_words >= 11) & finite & ~titled)
        | matches(text, rules.FIRST_PERSON)
        | (matches(text, rules.FIRST_PERSON_PAST, case=True) & ~t.contains(":") & ~titled)
        | ((n_words >= 12) & ends_with_period(t) & (opener | finite | ~topical))
        | ((n_words >= 8) & opener & matches(text, rules.THANKS))
        | ((n_words >= 12) & matches(text, rules.SENTENCE_PHRASE))
        | ((n_words >= 8) & matches(t, rules.LABELLED_SENTENCE))
    )


def looks_like_formula(text: Text) -> Column:
    """Of six words or more, two in five are numbers or single letters, whatever signs are in them."""
    t = parts(text).text
    words = F.regexp_count(t, F.lit(r"(?U)\S+"))
    letter, number = r"[^A-Za-z0-9\s]*+[A-Za-z][^A-Za-z0-9\s]*+", r"(?=[^A-Za-z\s]*[0-9])[^A-Za-z\s]++"
    short = F.regexp_count(t, F.lit(rf"(?U)(?<!\S)(?:{letter}|{number})(?!\S)"))
    return (words >= 6) & (short >= 0.4 * words)


def looks_like_ocr_junk(text: Text, topical: Column) -> Column:
    w = alpha_words(text)
    longest = F.array_max(F.transform(w, F.length))
    return (F.size(w) == 0) | F.coalesce(
        ~topical
        & (
            ((F.size(w) <= 6) & (longest <= 3))
            | ((capitals(text) > 0.4 * letters(text)) & (F.size(w) <= 4) & (longest <= 4))
        ),
        F.lit(False),
    )


def looks_like_short_name(text: Text, topical: Column) -> Column:
    w = alpha_words(text)
    names = ~F.exists(w, lambda x: F.lower(x).isin(*rules.SHORT_NAME_NOUNS)) & F.forall(w, lambda x: x.rlike("^[A-Z]"))
    return F.size(w).between(1, 3) & ~topical & (matches(text, rules.HONORIFIC) | names)


def without_section_number(text: Column) -> Column:
    return F.regexp_replace(text, "(?iuU)" + rules.SECTION_NUMBER, "")


def is_abstract_marker(text: Column) -> Column:
    key = exact_key(without_section_number(text))
    return key.isin(*rules.ABSTRACT_KEYS) | key.startswith("abstract ")


def is_cover_role(text: Column) -> Column:
    return matches(text, rules.COVER_ROLE)


def is_merge_interrupter(text: Column, key: Column, n_words: Column) -> Column:
    """Lines between which a title may go on."""
    chrome = key.isin(*rules.INTERRUPTERS) | key.startswith("you may also like") | key.startswith("to cite this article")
    return chrome | ((n_words < rules.MIN_WORDS) & ~(text.rlike("[A-Za-z]") & ~text.rlike(r"(?U)^[\d.]+")))
