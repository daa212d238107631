"""Text functions and line classifiers at their limits."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import predicates as P
from foliant.functions import rules
from foliant.functions import text as X


@pytest.fixture(scope="module")
def on(spark):
    """Values of a column expression over texts."""

    def run(make, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
        return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]

    return run


def test_keys_and_counts(on):
    texts = ["  A–Title: of 2 Parts ", "", None, "éé", "don't stop-now 3d", "x  y"]
    assert on(X.exact_key, texts) == ["a title of 2 parts", "", "", "", "don t stop now 3d", "x y"]
    assert on(X.word_count, texts)[4] == 3 and on(X.word_count, texts)[1] == 0
    assert on(X.collapse_space, [" a   b\t\nc­d ", None]) == ["a b cd", ""]
    assert on(lambda t: X.normalize_space(t, True), ["ﬁne  ½", None]) == [unicodedata.normalize("NFKC", "ﬁne ½"), ""]


@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_word_count_matches_the_pattern(on, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert on(X.word_count, texts) == [len(re.findall(r"[A-Za-z0-9][A-Za-z0-9'-]*", t)) for t in texts]


def test_capitals(on):
    assert on(X.mostly_all_caps, ["ABCDE", "ABCDEF", "ABCDEFGHIj", "ABCDEFGhij", "ÄÖÜÄÖÜ"]) == [False, True, True, False, True]
    assert on(X.mostly_title_or_caps, ["One Two three", "one two Three", "", "A b"]) == [True, False, False, False]
    assert on(X.starts_capitalised, ["1. Ab", "ab", "«É", "123"]) == [True, False, True, False]


def test_periods_and_open_ends(on):
    assert on(X.ends_with_period, ["It ends.", "See Fig.", "No", "made by X.", "long Words."]) == [True, False, False, False, True]
    assert on(X.ends_incomplete, ["of", "Study of", "Study of it", "Using THE", "Results with-"]) == [False, True, False, True, False]
    assert on(X.is_cover_particle, ["of", "On", "study", "of the"]) == [True, True, False, False]


def test_garbled_limits(on):
    long = "plain words here " * 40
    cases = {
        long + "\x01" * 7: False, long + "\x01" * 8: True, "ab\x01\x01": True, long + "\x03": False, long + "\x03\x03": True, "": True, "  ": True,
        "abc" + "1" * 9: False, "ab" + "1" * 7: True, "a" + "1" * 3: False, "a" + "1" * 4: True, long + "(cid:1)" * 7: False, long + "(cid:1)" * 8: True,
        "a" * 95 + "�" * 5: False, "a" * 94 + "�" * 6: True, ",ABCDEF rest of it": True,
    }
    cases["ab" + "1" * 7] = True
    assert on(X.is_garbled, list(cases)) == list(cases.values())


def test_metadata_cleaning_and_files(on):
    assert on(X.clean_metadata_title, ["## My Title | by Someone | Medium", "a_b", None]) == ["My Title", "a b", ""]
    got = on(lambda t: X.matches_filename(F.lit("Solar Dryer"), t), ["/x/solar-dryer.pdf", "solar.dryer.pdf", "solar_dryer", "", None, ".pdf"])
    assert got == [True, True, True, False, False, False]


def test_line_cleaning(on):
    cases = {
        '"A Title"': "A Title", "Talk (© Someone 2020) now": "Talk now", "Title © 2020 X": "Title", "Paper • Open Access Real Title": "Real Title",
        "A Title You may also like this": "A Title", "Title e-ISSN 123": "Title", "A Design M.Tech thesis": "A Design", "A Design Department of X": "A Design",
        "Flow in Pipes A.Kumar Singh and others": "Flow in Pipes",
    }
    assert on(X.clean_line, list(cases)) == list(cases.values())


def test_every_line_rule_has_its_reason(on):
    samples = {
        "ISSN 1234-5678": "issn", "ISBN 978": "isbn", "doi: 10.1000/x": "doi", "arXiv:2101.1": "arxiv", "see https://x.y": "url", "www.example.org": "url",
        "write to a.b@c.org": "email", "ORCID 0000": "orcid", "Available  online today": "available_online", "Vol. 12": "volume", "Issue 3": "issue",
        "pp. 12-19": "pages", "© Someone": "copyright", "Received 1 May, accepted 2 June": "dates", "Corresponding author": "corresponding_author",
        "Keywords: a": "keywords", "Abstract: we": "abstract_label", "sharing with colleagues": "elsevier_cover", "lomoarcpsd": "studocu",
        "A project report on X": "front_matter", "The bonafide certificate": "front_matter", "This is to certify that": "front_matter",
        "We express our joy": "acknowledgement", "Serial No. Name Roll No.": "table_header", "Co-supervisor of this": "role_label", "Course: CS": "course_label",
        "UDC 12": "classification", "Figure 3 shows": "caption", "Contents lists available": "sciencedirect", "cc-by": "license",
        "IOP Publishing": "publisher", "peer-review": "peer_review", "Article history": "boilerplate", "Article in press": "article_info",
        "Supplementary data": "supplement", "Design of a Dryer": None, "Denissn": None,
    }
    assert on(P.boilerplate_reason, list(samples)) == list(samples.values())
    assert on(P.venue_reason, ["Journal of X", "IEEE", "Conference on Y", "Symposium on Z", "Transactions of A", "Dryer"]) == ["journal", "society", "conference", "symposium", "transactions", None]


def classes(on, make, texts):
    return on(lambda t: make(t, X.word_count(t), P.looks_topical(t)), texts)


def test_composition_is_skipped_only_where_it_changes_nothing(on):
    settled = [chr(c) for c in range(0x250) if not re.match(X.UNSETTLED, chr(c))] + list("–—‘’“”•€")
    for c in settled:
        for text in (c, "a" + c, c + "b"):
            assert unicodedata.normalize("NFKC", text) == text
    texts = ["ﬁne  ½", "e\u0301", "Ｆｕｌｌ", "plain", "Größe „x“ …", "a\u00a0b", None, "ſ²", "한"]
    assert on(X.normalize_space, texts) == [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in texts]


def test_needles_are_in_every_match():
    cases = {r"\bissn\b": ("issn",), r"available\s+online": ("available",), r"©|copyright\s+\d{4}": ("©", "copyright"), r"^of\s+approval$": ("approval",),
             r"\b(bachelor of|master of)\b": ("bachelor of", "master of"), r"\d+": (), r"(?:abcd)?xy": ("xy",), r"(?:abcd)?x": (), r"[\w.]+@[\w-]+": ("@",)}
    assert {p: tuple(sorted(X.needles(p))) for p in cases} == {p: tuple(sorted(n)) for p, n in cases.items()}


def test_lines_are_cleaned_alike_with_and_without_needles(spark):
    texts = ["'A title'", "Title (© 2020 X) more", "Title © IEEE", "Title You may also like this", "PAPER • OPEN ACCESS Title", "Title e-ISSN 12", "Title İSSN 1", "Title M. Tech 3",
             "Title Department of X", "A title J.Smith Adams and more", "no J.Smith", "  plain   text  ", "", "«»", "x \"#", "It is also plain paper", "a\u00a0© b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [r.t for r in df.select(X.clean_line(F.col("text")).alias("t")).collect()]
    assert [r.text for r in X.with_clean_lines(df).collect()] == want


def test_parts_change_no_class(spark):
    odd = ["İSSN 1234", "ıssn", "I\u017f\u017fN", "COPYRİGHT 2020 x", "boo\u212as downloaded from", "DESIGN study", "das Design", "de\u017fign", "A.B. Smith, x", "a@b.c", "", "é",
           "The work is done in this place by us all.", "Dr Smith", "Permission is prohibited", "Internal Editor"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    t, n = F.col("text"), X.word_count(F.col("text"))

    def made(x):
        about = P.looks_topical(x)
        return [c.alias(k) for k, c in {
            "boilerplate": P.boilerplate_reason(x), "venue": P.venue_reason(x), "topical": about, "author": P.looks_like_author(x, n, about),
            "sentence": P.looks_like_sentence(x, n, about), "short": P.looks_like_short_name(x, about), "caps": X.mostly_all_caps(x), "ratio": X.letter_ratio(x),
            "junk": P.looks_like_ocr_junk(x, about), "rest": X.matches(x, rules.NO_PERMISSION) | X.matches(x, rules.EDITOR),
        }.items()]

    assert X.with_parts(df).select("text", *made(X.line(key=None))).collect() == df.select("text", *made(t)).collect()
    assert df.select(P.boilerplate_reason(t).alias("b")).first().b == "issn"


def test_authors(on):
    yes = ["Anna Lopez and Ravi Kumar", "University of X", "a.b@c.org", "Kumar, Singh, Lopez", "J. R. Smith, PhD", "Lopez1, Kumar2", "AB123/4", "Anand Kumar S. Malipatil", "Ravi Kumar"]
    no = ["Design and Analysis of a Solar Dryer", "The story of water", "Computer Networks"]
    assert classes(on, P.looks_like_author, yes + no) == [True] * len(yes) + [False] * len(no)


def test_a_very_long_name_list_does_not_bring_the_machine_down(on):
    assert classes(on, P.looks_like_author, ["Anna Lopez, " * 4500 + "Ravi"]) == [False]
    # Word counts are of ASCII words, so a long list in another script is one.
    assert classes(on, P.looks_like_author, ["Анна Лопез, " * 4500 + "Рави", "Анна Лопез, " * 4500 + "Design Study", "Анна Лопез, " * 200 + "Design 5"]) == [True, True, False]


def test_prose(on):
    words = " ".join(["word"] * 9)
    assert on(lambda t: P.looks_like_fragment(t, X.word_count(t)), ["and so it goes on here", "and so it goes on", "More than eight words are in this line", "As Well As it"]) == [True, False, True, False]
    assert classes(on, P.looks_like_sentence, [f"The {words} is", "We successfully did", "I tested it", f"Title {words}", "Design of X"]) == [True, True, True, False, False]
    assert on(P.looks_like_formula, ["x = 1 + 2 y", "a b c d e f", "Design of a New Solar Dryer"]) == [True, True, False]
    assert on(lambda t: P.looks_like_ocr_junk(t, P.looks_topical(t)), ["12 34", "ab cd", "ABCD efg", "Solar dryer"]) == [True, True, True, False]
    assert on(lambda t: P.looks_like_short_name(t, P.looks_topical(t)), ["Dr Smith", "Ravi Kumar", "Stone Pump", "ravi kumar", "One Two Three Four"]) == [True, True, False, False, False]


def test_markers_and_interrupters(on):
    assert on(P.is_abstract_marker, ["Abstract", "1. Abstract", "Abstract This", "Abstraction"]) == [True, True, True, False]
    assert on(P.is_cover_role, ["Submitted by", "submitted", "In partial fulfilment of"]) == [True, False, True]
    assert on(lambda t: P.is_merge_interrupter(t, X.exact_key(t), X.word_count(t)), ["Open Access", "12", "corn-thresher", "Two words", "To cite this article: x"]) == [True, True, False, False, True]


def test_fixed_values():
    assert len(set(rules.NEVER_TITLES)) == 153 and len(rules.LINE_RULES) == 83 and sum(rules.WEIGHTS.values()) == 142
