"""Signals, spans, folds, selection, front text and routing on small tables with known results."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from foliant import schemas
from foliant.functions import predicates as P
from foliant.functions import rules
from foliant.functions import text as X
from foliant.operators import features, front, merge, spans, titles
from foliant.plans.extract import Options, extract_titles, lines_from_pages
from foliant.sources import adapters, pdf


def line(ord, text, size=10.0, page=1, box=(72.0, 210.0, 540.0, 220.0), bold=False, doc=1, source="native", italic=False):
    return (doc, ord, text, page, "", float(size), bold, italic, *map(float, box), 0, 0, source, 1, 612.0, 792.0)


def lines_df(spark, rows):
    return spark.createDataFrame(rows, schemas.LINES)


def docs_df(spark, *rows):
    rows = [(r + (None,) * 5)[:5] for r in rows]
    return spark.createDataFrame(rows, schemas.DOCS)


def article(doc=1):
    """A plain article: title, authors, abstract heading, ten lines of text."""
    head = [
        line(0, "Design and Analysis of a Solar Dryer", 18, box=(156, 100, 456, 118), bold=True, doc=doc),
        line(1, "Anna Lopez and Ravi Kumar", 11, box=(206, 140, 406, 151), doc=doc),
        line(2, "Abstract", 11, box=(286, 180, 326, 191), bold=True, doc=doc),
    ]
    body = [line(3 + k, "Drying of farm goods loses heat through walls and air", 10, box=(72, 200 + 14 * (k + 1), 540, 210 + 14 * (k + 1)), doc=doc) for k in range(10)]
    return head + body


def test_plain_article(spark):
    out = titles.detect_titles(docs_df(spark, (1, "a.pdf", "", "")), lines_df(spark, article())).first()
    assert (out.title, out.source, out.confidence, out.page) == ("Design and Analysis of a Solar Dryer", "heuristic", "high", 1)
    assert out.score == pytest.approx(125.95)
    s = out.signals
    assert s["font_percentile"] == 22 and s["size_vs_body"] == 16 and s["bold"] == 5 and s["above_authors"] == 14 and s["prominence"] == pytest.approx(7.2)
    assert s["capitalization"] == pytest.approx(1.75) and s["isolation"] == 12 and s["word_count"] == 8
    raw = features.classify(features.annotate(lines_df(spark, article()))).orderBy("ord").limit(3).collect()
    assert [r.reject_bare for r in raw] == [None, "author_or_affiliation", "section_heading"]


def test_order_of_rows_and_other_documents_change_nothing(spark):
    rows = [r for d in range(1, 30) for r in article(d)]
    docs = docs_df(spark, *((d, "a.pdf", "", "") for d in range(1, 30)))
    a = titles.detect_titles(docs, lines_df(spark, rows)).drop("doc_id", "signals").distinct()
    b = titles.detect_titles(docs, lines_df(spark, rows[::-1]).repartition(9)).drop("doc_id", "signals").distinct()
    assert a.collect() == b.collect() and a.count() == 1


def test_no_lines_blank_lines_and_metadata(spark):
    docs = docs_df(spark, (1, "f.pdf", "A Fine Metadata Title", ""), (2, "f.pdf", None, None), (3, None, "untitled", None))
    rows = [line(0, None), line(1, "  "), line(0, None, doc=3)]
    out = {r.doc_id: r for r in titles.detect_titles(docs, lines_df(spark, rows)).collect()}
    assert (out[1].title, out[1].source, out[1].score) == ("A Fine Metadata Title", "metadata", 100.0)
    assert out[2].title is None and out[2].reason == titles.NO_LINES and out[2].rejected_metadata.reason == "empty"
    assert tuple(out[3].rejected_metadata) == ("untitled", "generic") and out[3].confidence == "low"
    empty = titles.detect_titles(docs.where("false"), lines_df(spark, []))
    assert empty.count() == 0 and empty.columns == schemas.TITLES.names


def test_labelled_title_wins(spark):
    rows = [*article(), line(20, "Project Title: Smart Irrigation Network", page=2, box=(72, 60, 300, 72)), line(21, "Title: Another One Here", page=2, box=(72, 300, 300, 312))]
    out = titles.detect_titles(docs_df(spark, (1, "a.pdf", "", "")), lines_df(spark, rows)).first()
    assert (out.title, out.source, out.score, out.confidence, out.page) == ("Smart Irrigation Network", "labeled", 95.0, "high", 2)
    assert dict(out.signals) == {"labeled": 95.0}


def test_lines_too_long_for_a_title_are_classified_too(spark):
    many = " ".join(["word"] * 30)
    texts = [f"The {many} is", f"and so it goes on {many}", f"ISSN 1234-5678 {many}", many.upper(), f"{many}."]
    lines = features.annotate(lines_df(spark, [line(k, t) for k, t in enumerate(texts)]))
    t, n = F.col("text"), F.col("word_count")
    topical = P.looks_topical(t)
    alone = {
        "boilerplate": P.boilerplate_reason(t), "venue": P.venue_reason(t), "fragment": P.looks_like_fragment(t, n), "sentence": P.looks_like_sentence(t, n, topical),
        "short_name": P.looks_like_short_name(t, topical), "garbled": X.is_garbled(t), "all_caps": X.mostly_all_caps(t), "period_end": X.ends_with_period(t),
    }
    want = lines.select("ord", *(c.alias(k) for k, c in alone.items())).orderBy("ord").collect()
    got = features.classify(lines).select("ord", *alone).orderBy("ord").collect()
    assert got == want
    assert got[0].sentence and got[1].fragment and got[2].boilerplate and got[3].all_caps and got[4].period_end


def test_course_lines_and_print_chrome(spark):
    cases = {
        1: ["Course: Electronics Smart Dryer Design", "x"], 2: ["Subject: Physics", "Solar Dryer Design Study"], 3: ["8/30/26, 1:25 PM | I Made a Dryer | by Bob | Medium", "x"],
        4: ["Subject: Physics", "no good one"],
    }
    rows = [line(k, t, doc=d, box=(72, 100 + 20 * k, 300, 110 + 20 * k)) for d, ts in cases.items() for k, t in enumerate(ts)]
    got = {r.doc_id: r.title for r in titles.labelled_titles(features.classify(features.annotate(lines_df(spark, rows)))).collect()}
    assert got == {1: "Smart Dryer Design", 2: "Solar Dryer Design Study", 3: "Made a Dryer"}


METADATA = [
    ("", "f.pdf", "", "empty"), ("A long title ...", "f.pdf", "", "truncated"), ("Seven 7", "f.pdf", "", "too_short"), ("My paper.docx", "f.pdf", "", "file_extension"),
    ("Microsoft Word - thesis", "f.pdf", "", "word_processor"), ("see /home/user/x", "f.pdf", "", "filepath"), ("lomoarcpsd here", "f.pdf", "", "studocu"),
    ("12, 34 things", "f.pdf", "", "studocu"), ("Untitled Document", "f.pdf", "", "generic"), ("Solar Dryer", "solar_dryer.pdf", "", "matches_filename"),
    ("Anna Lopez Diaz", "f.pdf", "anna lopez diaz", "matches_author"), ("ISSN 1234-5678 x", "f.pdf", "", "boilerplate"),
    ("Journal of Heat", "f.pdf", "", "journal_masthead"), (" ".join(["word"] * 29), "f.pdf", "", "too_long"), (" ".join(["word"] * 28), "f.pdf", "", "ok"),
]


def test_metadata_validation(spark):
    docs = docs_df(spark, *((i, f, t, a) for i, (t, f, a, _) in enumerate(METADATA)))
    assert [r.meta_status for r in titles.validate_metadata(docs).orderBy("doc_id").collect()] == [m[3] for m in METADATA]


def test_reconciliation(spark):
    rows = [
        ("A Solar Dryer Study", None, None, 0.0, False, "heuristic", "metadata"), ("A Solar Dryer", "A Solar Dryer", "medium", 50.0, True, "heuristic", "agreed"),
        ("A Solar Dryer And Its Long Design", "A Solar Dryer", "low", 20.0, True, "heuristic", "metadata_fuller"),
        ("A Solar Dryer And Its Long Design", "A Solar Dryer", "low", 20.0, False, "heuristic", "agreed"),
        ("Other Thing", "A Solar Dryer", "high", 95.0, True, "labeled", "layout:page_title_differs"), ("Other Thing", "A Solar Dryer", "high", 60.0, False, "heuristic", "layout:not_on_page"),
        ("Other Thing", "A Solar Dryer", "low", 58.0, True, "heuristic", "layout:page_title_differs"), ("Other Thing", "A Solar Dryer", "medium", 42.0, False, "heuristic", "layout:not_on_page"),
        ("Other Thing", "A Solar Dryer", "medium", 42.0, True, "heuristic", "metadata"), ("Other Thing", "A Solar Dryer", "low", 41.9, False, "heuristic", "metadata"),
    ]
    df = spark.createDataFrame([(i, *r[:-1], "ok") for i, r in enumerate(rows)], "doc_id int, meta_clean string, title string, confidence string, score double, on_page boolean, source string, meta_status string")
    assert [r.choice for r in titles.reconcile(df).orderBy("doc_id").collect()] == [r[-1] for r in rows]


def test_running_header(spark):
    top = [line(p, "Annual Solar Notes", 9, page=p, box=(72, 40, 300, 49)) for p in (1, 2, 3)]
    large = [line(10 + p, "A Large Banner Here", 13, page=p, box=(72, 30, 300, 43)) for p in (1, 2)]
    once = [line(20, "Only One Page Note", 9, page=1, box=(72, 60, 300, 69))]
    out = features.with_scores(features.classify(features.annotate(lines_df(spark, top + large + once))))
    got = {r.ord: (r.header, r.reject_reason) for r in out.collect()}
    assert all(got[p] == (True, "running_header") for p in (1, 2, 3))
    assert got[11][0] and got[11][1] != "running_header" and not got[20][0]


BANDS = [
    ("vertical", [(0.039, 1), (0.04, 8), (0.079, 8), (0.08, 10), (0.48, 10), (0.481, 5.5), (0.62, 5.5), (0.621, 2), (0.75, 2), (0.751, 0)]),
    ("center", [(0.04, 10), (0.041, 7), (0.08, 7), (0.081, 3), (0.14, 3), (0.141, 0)]),
    ("size", [(1.05, 0), (1.6, 16), (2.0, 16), (1.325, 8)]),
    ("words", [(1, 0), (2, 2), (3, 5.6), (4, 5.6), (5, 8), (16, 8), (17, 5.6), (22, 5.6), (23, 2), (28, 2), (29, 0)]),
    ("share", [(0.55, 0), (1.0, 22), (0.775, 11)]),
    ("page", [(1, 8), (2, 3.6), (3, 1.6), (4, 0)]),
]


@pytest.mark.parametrize("k", range(6))
def test_signal_bands(spark, k):
    v = F.col("v")
    make = [
        lambda: features.vertical_signal(v, F.lit(False), F.lit(False)), lambda: features.center_signal(v), lambda: features.size_ratio_signal(v * 10, F.lit(10.0)),
        lambda: features.word_count_signal(v), lambda: features.percentile_signal(v), lambda: features.page_signal(v, F.lit(1)),
    ][k]
    want = BANDS[k][1]
    got = [r.s for r in spark.createDataFrame([(float(a),) for a, _ in want], "v double").coalesce(1).select(make().alias("s")).collect()]
    assert got == pytest.approx([float(b) for _, b in want], abs=1e-6)


def test_ocr_cover_vertical(spark):
    r = spark.range(1).select(features.vertical_signal(F.lit(0.78), F.lit(True), F.lit(True)).alias("a"), features.vertical_signal(F.lit(0.79), F.lit(True), F.lit(True)).alias("b")).first()
    assert (r.a, r.b) == (8.5, 0.0)


def test_isolation_of_overlapping_boxes(spark):
    boxes = [(0, 10, 50, 20), (60, 12, 90, 22), (0, 30, 50, 40), (0, 39.7, 50, 50), (0, 100, 50, 110)]
    rows = [line(k, f"line number {k}", box=b) for k, b in enumerate(boxes)]
    out = {r.ord: (round(r.gap_above, 3), round(r.gap_below, 3)) for r in features.with_context(features.classify(features.annotate(lines_df(spark, rows)))).collect()}

    def slow(k):
        x0, y0, x1, y1 = boxes[k]
        up, down = y0, 792 - y1
        for j, (_, a, _, b) in enumerate(boxes):
            if j != k:
                if b <= y0 + 0.4:
                    up = min(up, y0 - b)
                elif a >= y1 - 0.4:
                    down = min(down, a - y1)
        return round(max(up, 0), 3), round(max(down, 0), 3)

    assert out == {k: slow(k) for k in range(len(boxes))}


def test_body_size_ties_go_to_the_first_seen(spark):
    rows = [line(0, "abcd efgh", 12), line(1, "abcd efgh", 10), line(2, "x", 0)]
    assert features.with_context(features.classify(features.annotate(lines_df(spark, rows)))).first().body_size == 12
    assert features.with_context(features.classify(features.annotate(lines_df(spark, [line(0, "only this", 0)])))).first().body_size == 11


def test_gaps_of_regular_and_irregular_pages(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for page in range(1, 25):
        boxes = []
        top = 20.0
        for _ in range(rng.randint(1, 9)):
            tall = rng.choice([0.0, 0.3, 8.0, 12.0, 30.0])
            boxes.append((top, top + tall))
            # On every third page boxes may overlap, or stand side by side.
            top += rng.choice([0.0, 0.2, 5.0, tall, tall + 9]) if page % 3 == 0 else max(tall, 0.5) + rng.choice([0.0, 0.3, 6.0, 40.0])
        if page % 3:
            boxes = [(a, max(b, a + 1.0)) for a, b in boxes]
        for y0, y1 in boxes:
            rows.append(line(len(rows), f"Line number {len(rows)}", 10, page=page, box=(72, y0, 300, y1)))
        first = len(rows) - len(boxes)
        for k, (y0, y1) in enumerate(boxes):
            others = [b for j, b in enumerate(boxes) if j != k]
            above = min([y0 - b for a, b in others if b <= y0 + 0.4], default=y0)
            below = min([a - y1 for a, b in others if b > y0 + 0.4 and a >= y1 - 0.4], default=1e9)
            want[first + k] = (round(max(min(y0, above), 0.0), 3), round(max(min(792.0 - y1, below), 0.0), 3))
    out = features.with_context(features.classify(features.annotate(lines_df(spark, rows)))).select("ord", "gap_above", "gap_below").collect()
    assert {r.ord: (round(r.gap_above, 3), round(r.gap_below, 3)) for r in out} == want


def wrapped(second_size=16, gap=6, first="Study of the Performance of", second="a Wind Turbine"):
    return [line(0, first, 16, box=(150, 100, 460, 116), bold=True), line(1, second, second_size, box=(220, 116 + gap, 390, 132 + gap), bold=True)]


def merged(spark, rows):
    return [r.text for r in merge.merge_adjacent(merge.with_merge_flags(features.classify(features.annotate(lines_df(spark, rows))))).orderBy("ord").collect()]


def test_wrapped_titles_merge(spark):
    assert merged(spark, wrapped()) == ["Study of the Performance of a Wind Turbine"]
    assert merged(spark, wrapped(13)) == ["Study of the Performance of", "a Wind Turbine"]
    assert merged(spark, wrapped(gap=60)) == ["Study of the Performance of", "a Wind Turbine"]
    assert merged(spark, wrapped(first="Study of a corn-", second="thresher machine")) == ["Study of a cornthresher machine"]
    assert len(merged(spark, wrapped(second="Anna Lopez, Ravi Kumar, Mira Singh and Tom Lee", first="A Wind Turbine Design"))) == 2


def test_columns_do_not_merge(spark):
    rows = [line(0, "Study of the Flow in", 12, box=(50, 100, 250, 112)), line(1, "Other Column Text Here", 12, box=(360, 101, 560, 113)), line(2, "a Wind Turbine", 12, box=(50, 116, 250, 128))]
    assert merged(spark, rows) == ["Study of the Flow in a Wind Turbine", "Other Column Text Here"]


def test_grow_joins_lines_around_the_winner(spark):
    rows = [
        line(0, "Thermal Performance Study", 16, box=(150, 100, 460, 116), bold=True), line(1, "Using Nanofluid Radiators", 16, box=(150, 122, 460, 138), bold=True),
        *[line(3 + k, "Drying of farm goods loses heat through walls and air", 10, box=(72, 300 + 14 * k, 540, 310 + 14 * k)) for k in range(8)],
    ]
    raw = features.classify(features.annotate(lines_df(spark, rows)))
    scored = merge.with_merge_flags(features.with_scores(raw))
    out = {r.text: (r.merged_text, r.merged_score - r.score) for r in merge.grow_candidates(scored, ["text", "score"]).collect() if r.score is not None}
    text, gain = out["Thermal Performance Study"]
    assert text == "Thermal Performance Study Using Nanofluid Radiators" and gain >= 2


def span(ord, text, box, size=10.0, page=1, source="native", bold=False, doc=1):
    return (doc, ord, text, page, "F", float(size), bold, False, *map(float, box), 0, 0, source, None)


def visual(spark, rows):
    out = spans.spans_to_lines(spark.createDataFrame(rows, schemas.SPANS)).orderBy("ord").collect()
    return [r.text for r in out], out


def test_gutters(spark):
    pair = lambda gap, source, size=10.0, other=10.0: visual(spark, [span(0, "left", (10, 10, 100, 20), size, source=source), span(1, "right", (100 + gap, 10, 200 + gap, 20), other, source=source)])[0]
    assert pair(19, "native") == ["left right"] and pair(21, "native") == ["left", "right"]
    assert pair(89, "ocr") == ["left right"] and pair(91, "ocr") == ["left", "right"]
    assert pair(9, "native", 16, 7) == ["left", "right"] and pair(7, "native", 16, 7) == ["left right"]
    assert pair(1, "native") == ["leftright"]


def test_lines_of_spans(spark):
    rows = [span(0, "world", (60, 10, 90, 20), 12), span(1, "hello ", (10, 11, 58, 21), 10, bold=True), span(2, " ", (200, 10, 210, 20)), span(3, None, (10, 50, 20, 60)), span(4, "next", (10, 40, 30, 50))]
    texts, out = visual(spark, rows)
    assert texts == ["hello world", "next"]
    r = out[0]
    assert (r.font_size, r.bold, r.span_count, r.x0, r.y0, r.x1, r.y1, r.page_width) == (12.0, True, 2, 10.0, 10.0, 90.0, 21.0, 612.0)
    assert visual(spark, [])[0] == []


def plain_on_line(span, line):
    """Whether a span shares the baseline of those of `line`, from all of them anew."""
    size = lambda x, least=0.0: x["font_size"] or least
    top, bottom = min(s["y0"] for s in line), max(s["y1"] for s in line)
    left, right = min(s["x0"] for s in line), max(s["x1"] for s in line)
    tall = max(span["y1"] - span["y0"], size(span, 1.0), 1.0)
    line_tall = max(bottom - top, max(size(s, 1.0) for s in line), 1.0)
    apart = abs((span["y0"] + span["y1"]) / 2 - (top + bottom) / 2)
    if min(span["y1"], bottom) - max(span["y0"], top) <= 0.25 * min(tall, line_tall) and apart >= 0.4 * max(tall, line_tall):
        return False
    gutter = max(0.0, span["x0"] - right, left - span["x1"])
    a, b = size(span), max(size(s) for s in line)
    if a and b and abs(a - b) > 0.30 * max(a, b) and gutter > 8:
        return False
    ocr = span["source"] == "ocr" or any(s["source"] == "ocr" for s in line)
    return gutter <= (max(90.0, 0.16 * max(right, span["x1"], 1.0)) if ocr else 20.0)


def test_clusters_against_all_comparisons():
    r = random.Random(5)
    for _ in range(400):
        high, rows = r.choice([30, 100, 400]), []
        for k in range(r.randint(1, 60)):
            x, y = r.choice([r.uniform(0, 600), r.randrange(0, 600, 20)]), r.choice([r.uniform(0, high), r.randrange(0, high, 5)])
            rows.append({"n": k, "font_size": r.choice([None, 0.0, 8.0, 10.0, 30.0, r.uniform(1, 60)]), "source": r.choice(["ocr", "native", "native", None]), "x0": x, "y0": y, "x1": x + r.uniform(-10, 80), "y1": y + r.choice([0, 10, 12, r.uniform(-20, 40)])})
        want = []
        for s in sorted(rows, key=lambda s: (s["y0"], s["x0"])):
            home = next((c for c in want if plain_on_line(s, c)), None)
            home.append(s) if home else want.append([s])
        assert [[s["n"] for s in c.spans] for c in spans._clusters(rows)] == [[s["n"] for s in c] for c in want]


def test_a_page_of_many_lines_takes_time_in_proportion():
    names = schemas.SPANS.names
    rows = [dict(zip(names, span(2 * k + j, f"w{k}", (10 + 300 * j, 20 * k, 50 + 300 * j, 20 * k + 10)), strict=True)) for k in range(3000) for j in range(2)]
    began = time.process_time()
    out = spans.lines_of(rows)
    assert time.process_time() - began < 5
    assert [(x["ord"], x["text"], x["x0"]) for x in out] == [(2 * k + j, f"w{k}", 10.0 + 300 * j) for k in range(3000) for j in range(2)]


def test_ocr_prominence(spark):
    _, out = visual(spark, [span(0, "Big", (10, 10, 60, 30), 20, source="ocr"), span(1, "near", (10, 100, 60, 119), 19.4, source="ocr"), span(2, "small", (10, 200, 60, 210), 10, source="ocr")])
    assert [r.bold for r in out] == [True, True, False]


def test_page_sizes_join(spark):
    pages = spark.createDataFrame([(1, 1, 500.004, 700.0, "", False)], schemas.PAGES)
    rows = spark.createDataFrame([span(0, "one", (1, 1, 9, 9)), span(1, "two", (1, 1, 9, 9), page=2)], schemas.SPANS)
    assert [(r.page_width, r.page_height) for r in spans.spans_to_lines(rows, pages).orderBy("page").collect()] == [(500.0, 700.0), (612.0, 792.0)]


def test_page_kinds(spark):
    good = "A readable page of text that is long enough for it."
    rows = [(None, False, "empty"), ("", True, "scanned"), ("  \n", False, "empty"), (good, True, "native"), ("short text", True, "scanned"), ("short text", False, "native"), ("\x03\x03" + good, False, "garbled")]
    df = spark.createDataFrame([(1, i, None, None, t, im) for i, (t, im, _) in enumerate(rows)], schemas.PAGES)
    assert [r.kind for r in spans.classify_pages(df).orderBy("page").collect()] == [r[2] for r in rows]
    assert spans.has_text_layer(df).first().has_text_layer and not spans.has_text_layer(df, 2).first().has_text_layer


def test_document_types(spark):
    cases = {1: ["empty"], 2: ["native", "empty"], 3: ["scanned", "garbled"], 4: ["native", "garbled"]}
    df = spark.createDataFrame([(d, i, k) for d, ks in cases.items() for i, k in enumerate(ks)], "doc_id long, page int, kind string")
    assert {r.doc_id: r.pdf_type for r in spans.document_type(df).collect()} == {1: "empty", 2: "native", 3: "scanned", 4: "mixed"}


def read_page(page, text, images=False, parts=None):
    parts = [text] if parts is None else parts
    block = (0, [[(p, "Times-Bold", 12.001, 0, [10.0, 20.0 + 20 * k, 200.0, 32.0 + 20 * k])] for k, p in enumerate(parts)])
    return (1, page, 612.0, 792.0, text, images, [block, (1, [[("image", "", 1.0, 0, None)]])])


def test_reading_pages_routes_and_caps_ocr(spark):
    schema = schemas.T.StructType([schemas.PAGES["doc_id"], *pdf.READ_PAGE.fields])
    good = "Solar Dryer Design for readers of all kinds and ages"
    pages = spark.createDataFrame([read_page(1, good), *(read_page(p, "", True, [" "]) for p in (2, 3, 4, 5))], schema)
    words = spark.createDataFrame([(1, p, 0, 0, 0, w, c, 10.0 * k, 5.0, 10.0 * k + 8, 15.0 + k) for p in (2, 3, 4) for k, (w, c) in enumerate([("Scanned", 90.0), ("Title", 80.0), ("bad", -1.0), (" ", 50.0)])], schemas.OCR_WORDS)
    lines, reports = lines_from_pages(pages, words)
    got = {r.page: (r.kind, r.method, r.span_count, r.error) for r in reports.collect()}
    assert got == {1: ("native", "native", 1, None), **{p: ("scanned", "ocr", 1, None) for p in (2, 3, 4)}, 5: ("scanned", "ocr_skipped", 0, "OCR page limit reached")}
    texts = {r.page: (r.text, r.font_size, r.bold) for r in lines.collect()}
    assert texts[1] == (good, 12.0, True) and texts[2] == ("Scanned Title", 10.5, True)
    _, none = lines_from_pages(pages)
    assert {r.method for r in none.collect()} == {"native", "ocr_unavailable", "ocr_skipped"}
    _, off = lines_from_pages(pages, words, use_ocr=False)
    assert {r.error for r in off.collect()} == {None, "OCR skipped"}


def test_garbled_spans_are_swapped_or_dropped(spark):
    bad, good = "\x01" * 9 + "x", "A good line of text that people can read with ease"
    page = spark.createDataFrame([(1, 1, 612.0, 792.0, good, False)], schemas.PAGES)
    blocks = spans.block_spans(spark.createDataFrame([(1, 1, 0, 0, "First line\nSecond line\n\n", 10.0, 100.0, 200.0, 124.0)], "doc_id long, page int, block int, type int, text string, x0 double, y0 double, x1 double, y1 double"))
    assert [(r.text, r.font_size, r.y0) for r in blocks.orderBy("ord").collect()] == [("First line", 9.0, 100.0), ("Second line", 9.0, 112.0)]
    all_bad = spark.createDataFrame([span(0, bad, (1, 1, 2, 2))], schemas.SPANS)
    assert [r.text for r in spans.page_spans(all_bad, page, blocks).orderBy("ord").collect()] == ["First line", "Second line"]
    mixed = spark.createDataFrame([span(0, bad, (1, 1, 2, 2)), span(1, good, (1, 5, 2, 6))], schemas.SPANS)
    assert [r.text for r in spans.page_spans(mixed, page).collect()] == [good]
    assert [r.text for r in spans.usable_spans(mixed).collect()] == [good]
    assert spans.usable_spans(spark.createDataFrame([span(0, "see www.example.org/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", (1, 1, 2, 2))], schemas.SPANS)).count() == 0


def test_front_text_caps(spark):
    rows = [line(p, "x" * 600, page=p, box=(10, 50, 20, 60)) for p in range(1, 5)]
    out = front.front_text(lines_df(spark, rows)).first()
    assert dict(out.sent_by_page) == {1: 500, 2: 500, 3: 500, 4: 200} and out.sent_chars == 1806
    low = [line(k, f"line {k}", box=(10, 400 + 20 * k, 20, 410 + 20 * k)) for k in range(5)]
    assert front.front_text(lines_df(spark, low)).first().text == "--- page 1 (top 40%) ---\nline 0\nline 1\nline 2"
    assert front.front_text(lines_df(spark, [line(0, " "), line(1, None)])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_front_text_is_the_loop(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [line(k, "w" * rng.randrange(1, 400), page=rng.randrange(1, 8), box=(rng.randrange(9), rng.randrange(700), 20, 30)) for k in range(25)]
    used, chunks = 0, []
    for p in sorted({r[3] for r in rows}):
        own = sorted((r for r in rows if r[3] == p), key=lambda r: (r[9] / 792, r[8], r[1]))
        top = [r for r in own if r[9] / 792 <= 0.4] or own[: max(1, (len(own) + 1) // 2)]
        head = f"--- page {p} (top 40%) ---\n"
        if 1800 - used <= len(head):
            break
        part = head + "\n".join(r[2] for r in top)[: min(500, 1800 - used - len(head))]
        chunks.append(part)
        used += len(part)
    assert front.front_text(lines_df(spark, rows)).first().text == "\n\n".join(chunks)


def test_sparse_documents_read_further_pages(spark):
    body = lambda n, doc: [line(0, "y" * n, page=1, box=(1, 5, 2, 6), doc=doc), line(1, "far", page=6, box=(1, 5, 2, 6), doc=doc), line(2, "too far", page=8, box=(1, 5, 2, 6), doc=doc)]
    lines = lines_df(spark, body(94, 1) + body(95, 2))
    docs = docs_df(spark, (1,), (2,), (3,))
    assert {r.doc_id for r in front.sparse_documents(docs, lines).collect()} == {1, 3}
    assert sorted((r.doc_id, r.page) for r in front.pages_to_read(docs, lines).collect()) == [(1, 1), (1, 6), (2, 1)]


def test_reconstructed_text(spark):
    rows = [line(1, "b", page=1), line(0, "a", page=1), line(2, "c", page=3)]
    assert front.reconstruct_text(lines_df(spark, rows)).first().text == "--- page 1 ---\na\nb\n\n--- page 3 ---\nc"


def test_cover_pages_go_unless_all_do(spark):
    cover = line(0, "Sharing with colleagues is fine", page=1)
    rows = [cover, line(1, "A Title of Note", page=2)]
    assert [r.page for r in titles.drop_cover_pages(features.annotate(lines_df(spark, rows))).collect()] == [2]
    assert titles.drop_cover_pages(features.annotate(lines_df(spark, [cover]))).count() == 1


def test_selection_rules():
    def c(ord, text, score, page=1, **more):
        base = {"doc_id": 1, "ord": ord, "text": text, "norm": text.lower(), "page": page, "font_size": 10.0, "score": score, "topical": True, "all_caps": False, "word_count": 4,
                "author": False, "prose": False, "merged_text": text, "merged_score": score, "m_norm": text.lower(), "m_author": False, "m_short": False, "m_prose": False,
                "signals": [], "carried": {"label": None, "raw_label": None, "fallback": None, "blob": ""}}
        return base | more

    pick = lambda *rows: titles._select(list(rows))
    assert pick(c(1, "b", 60.0), c(0, "a", 60.0))["title"] == "a"
    assert pick(c(0, "late", 70.0, page=3), c(1, "early", 59.0))["title"] == "early"
    assert pick(c(0, "late", 80.0, page=3), c(1, "early", 59.0))["title"] == "late"
    assert pick(c(0, "late", 80.0, page=3, topical=False), c(1, "early", 59.0))["title"] == "early"
    assert pick(c(0, "late", 79.0, page=3, topical=False), c(1, "early", 59.0, topical=False))["title"] == "early"
    assert pick(c(0, "names", 80.0, m_author=True), c(1, "title", 50.0))["title"] == "title"
    assert pick(c(0, "names", 80.0, m_author=True))["give_up"]
    assert pick(c(0, "prose", 80.0, m_prose=True, prose=True), c(1, "title", 50.0))["title"] == "title"
    assert pick(c(0, "study of", 80.0))["confidence"] == "medium"
    assert [pick(c(0, "x", s), c(1, "y", s - m))["confidence"] for s, m in ((58, 7), (58, 6.9), (57.9, 20), (42, 0), (41.9, 20))] == ["high", "medium", "medium", "medium", "low"]
    many = pick(*(c(k, f"t{k}t", 90.0 - k) for k in range(12)))
    assert len(many["alternatives"]) == 8


def test_extract_modes(spark):
    docs = docs_df(spark, (1, "a.pdf", "", ""), (2, "b.pdf", "", ""))
    lines = lines_df(spark, article())
    import json

    def said(title):
        return json.dumps({"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": json.dumps({"title": title, "page": 1, "reason": "r"})}]}}]})

    def run(call=None, keys=(("K", "k"),), **more):
        return {r.doc_id: r for r in extract_titles(docs, lines, Options(call=call, keys=list(keys), models=["m"], **more)).collect()}

    def quota(*a, **k):
        raise RuntimeError("429 quota")

    def denied(*a, **k):
        raise RuntimeError("403 Permission denied")

    off = run(use_model=False)
    assert off[1].title is None and off[1].reason == "Gemini was not requested." and off[1].mode == "skip"
    none = run(keys=())
    assert (none[1].title, none[1].mode) == (None, "unavailable") and "not configured" in none[1].reason and none[2].reason != none[1].reason
    good = run(lambda *a, **k: said(" 'A Good  Title' "))
    assert (good[1].title, good[1].source, good[1].page, good[1].mode) == ("A Good Title", "gemini", 1, "extract") and good[2].mode == "unavailable"
    assert run(lambda *a, **k: said("null"))[1].title is None
    auth = run(denied)
    assert auth[1].mode == "unavailable" and auth[1].title is None
    spent = run(quota)
    assert spent[1].title == "Design and Analysis of a Solar Dryer" and spent[1].quota_exhausted and spent[1].source == "heuristic"
    assert spent[2].mode == "unavailable" and not spent[2].quota_exhausted


def test_title_payload(spark):
    rows = [(1, " T ", "heuristic", "f", "native"), (2, " ", None, "f", "scanned"), (3, None, None, "f", "")]
    out = [tuple(r)[1:] for r in pdf.title_payload(spark.createDataFrame(rows, "doc_id long, title string, source string, filename string, pdf_type string")).orderBy("doc_id").collect()]
    assert out == [(True, "T", "heuristic", "f", "heuristic", None), (False, None, None, "f", "scanned", "No OCR"), (False, None, None, "f", None, None)]


def test_adapters_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/a/b.html?x=1", "<title>T</title><h1>Head</h1><p class='x'>Text  here</p>")], "page_id long, url string, html string")
    assert [(r.doc_id, r.text, r.font_size, r.bold) for r in adapters.html_lines(pages).collect()] == [(2, "Head", 18.0, True), (2, "Text here", 10.0, False)]
    assert {r.doc_id: (r.filename, r.meta_title) for r in adapters.html_docs(pages).collect()} == {1: ("", ""), 2: ("b.html", "T")}


def test_pdf_plug_in(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")

    def reader(content, max_pages):
        if content == b"bad":
            raise ValueError("broken")
        yield {"page": 1, "page_width": 1.0, "page_height": 2.0, "plain_text": "t", "has_images": False, "blocks": []}

    files = pdf.read_files(spark, str(tmp_path))
    out = pdf.read_pages(files, reader).join(files, "doc_id").select("filename", "page", "error").orderBy("filename").collect()
    assert [tuple(r) for r in out] == [("a.pdf", 1, None), ("b.pdf", None, "Could not read PDF: broken")]


def test_stream(spark, tmp_path):
    from foliant.streaming.titles import stream_titles

    schema = "page_id long, url string, html string"
    spark.createDataFrame([(1, "u", "<h1>Design of a Solar Dryer</h1><p>and so on it goes here</p>")], schema).write.parquet(str(tmp_path / "in"))
    query = stream_titles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert [r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Design of a Solar Dryer"]


def test_all_pairs_of_columns():
    left = {"x0": 50, "x1": 250, "y0": 100, "y1": 112, "line_height": 12, "page_width": 612}
    right = left | {"x0": 360, "x1": 560}
    assert merge.other_column(left, right) and merge.other_column(right, left) and not merge.other_column(left, left)
    assert all(merge.same_size(a, b) == merge.same_size(b, a) for a, b in itertools.product([0.0, 10.0, 10.7, 14.0, 16.0], repeat=2))
    assert rules.MAX_MERGED_WORDS == 28
