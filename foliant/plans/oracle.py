"""The operators in DuckDB SQL, to hold the DataFrame versions against.

Built from the same fixed values. RE2 has ASCII word classes only, so they are spelled out.
"""

from __future__ import annotations

import re

from foliant.functions import rules
from foliant.functions.text import ALPHA_WORD, QUOTES, WORD
from foliant.sources import adapters as A

_W = r"\p{L}\p{M}\p{N}_"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A rule's pattern for RE2, for tests whether it matches."""
    p = pattern.replace(r"[^\W\d_]", r"\p{L}")
    p = re.sub(r"\[([^\]]*)\\w([^\]]*)\]", lambda m: f"[{m[1]}{_W}{m[2]}]", p)
    p = re.sub(r"(?<!\\)\\w", lambda m: f"[{_W}]", p)
    out, at = "", 0
    for m in re.finditer(r"\\b", p):
        rest = p[m.end() : m.end() + 1]
        left = rest.isalnum() or rest in ("(", "[", "\\")
        out += p[at : m.start()] + (f"(?:^|[^{_W}])" if left else f"(?:$|[^{_W}])")
        at = m.end()
    return out + p[at:]


def hit(text: str, pattern: str, case: bool = False) -> str:
    return f"regexp_matches({text}, {quoted(re2(pattern))}{'' if case else ', ' + quoted('i')})"


def members(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def collapse(text: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({text}, ''), chr(173), ''), '\\s+', ' ', 'g'))"


def key(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'))"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def n_words(text: str) -> str:
    return count(text, WORD)


def letters(text: str) -> str:
    return count(text, r"\p{L}")


def capitals(text: str) -> str:
    return count(text, r"\p{Lu}")


def all_caps(text: str) -> str:
    return f"({letters(text)} >= 6 AND {capitals(text)} >= 0.82 * {letters(text)})"


def alpha(text: str) -> str:
    return f"regexp_extract_all({text}, {quoted(ALPHA_WORD)})"


def title_or_caps(text: str) -> str:
    w = alpha(text)
    share = f"coalesce(len(list_filter({w}, lambda w: regexp_matches(w, '^[A-Z]'))) / nullif(len({w}), 0), 0)"
    return f"({all_caps(text)} OR {share} >= 0.6)"


def period_end(text: str) -> str:
    return f"(regexp_matches({text}, '\\.\\s*$') AND NOT regexp_matches({text}, {quoted(f'(?:^|[^{_W}])[A-Z][a-z]{{0,3}}' + chr(92) + '.' + chr(92) + 's*$')}))"


def incomplete(text: str) -> str:
    return f"({n_words(text)} >= 2 AND lower(regexp_extract_all({text}, {quoted(WORD)})[-1]) IN {members(rules.DANGLING)})"


def garbled(text: str) -> str:
    s = f"substring({text}, 1, 5000)"
    controls = count(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    compact = f"regexp_replace({s}, '[\\s\\x0b\\x1c-\\x1f]+', '', 'g')"
    return f"""({controls} >= 8 OR ({controls} >= 2 AND {controls} > 0.015 * length({s})) OR {count(s, chr(92) + 'x03')} >= 2
      OR regexp_matches({s}, '^,[A-Z]{{6,}}') OR {compact} = '' OR {count(s, chr(0xFFFD))} > 0.05 * length({s})
      OR {count(s, '(?i)' + chr(92) + '(cid:' + chr(92) + 'd+' + chr(92) + ')')} >= 8 OR {letters(compact)} < 0.25 * length({compact}))"""


def clean(text: str) -> str:
    t = f"trim({collapse(text)}, {quoted(QUOTES)})"
    t = f"regexp_replace({t}, {quoted('[' + chr(34) + chr(39) + '«»“”]+$')}, '')"
    t = f"regexp_replace({t}, '\\s*\\(\\s*©[^)]*\\)', ' ', 'g')"
    for cut in (r"\s+©\s+.*$", r"\s+you\s+may\s+also\s+like\b.*$", r"^paper\s*[•·\-]?\s*open\s+access\s*",
                r"\s+e-?issn\b.*$", r"\s+M\.?\s*Tech\b.*$", r"\s+Department\s+Of\b.*$"):
        t = f"regexp_replace({t}, {quoted(cut)}, '', 'i')"
    t = f"regexp_replace({t}, '([A-Za-z])\\s+[A-Z]\\.[A-Z][a-z]+\\s+[A-Z][a-z]+.*$', '\\1')"
    return collapse(t)


def first_rule(text: str, table: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN {hit(text, p)} THEN {quoted(r)}" for p, r in table) + " END"


def boilerplate(text: str) -> str:
    known = f"{key(text)} IN {members(rules.NEVER_TITLES + rules.GENERIC_TITLES)}"
    return f"CASE WHEN {known} THEN 'boilerplate' ELSE {first_rule(text, rules.LINE_RULES)} END"


def venue(text: str) -> str:
    return first_rule(text, rules.VENUE_RULES)


def topical(text: str) -> str:
    return hit(text, rf"\b({'|'.join(rules.TOPICAL)})\b")


def person_names(text: str, n: str, about: str) -> str:
    tok = f"regexp_extract_all({text}, {quoted(chr(91) + 'A-Za-z][A-Za-z.' + chr(39) + '’-]*')})"
    named = (
        f"len(list_filter({tok}, lambda w: regexp_matches(w, {quoted(rules.NAME_TOKEN)}) AND lower(w) NOT IN {members(rules.NAME_STOPS)} "
        f"AND NOT (length(w) > 2 AND upper(w) = w AND lower(w) <> w)))"
    )
    none_of = lambda test: f"len(list_filter({tok}, lambda w: {test})) = 0"
    initial = f"NOT {none_of('regexp_matches(w, ' + quoted(rules.INITIALS) + ')')}"
    two = (
        f"({n} = 2 AND {named} = 2 AND {none_of('NOT regexp_matches(w, ' + quoted('^[A-Z][a-z]{2,20}$') + ')')} "
        f"AND {none_of('lower(w) IN ' + members(rules.NAME_NOUNS))})"
    )
    return (
        f"(NOT {about} AND {n} BETWEEN 2 AND 12 AND NOT {hit(text, rf"\b({'|'.join(rules.NOT_A_NAME)}|and the)\b")} AND NOT {hit(text, chr(92) + 'd{3,}')} "
        f"AND len({tok}) >= 2 AND {named} >= 0.75 * len({tok}) AND ({initial} OR {named} >= 4 OR {two}))"
    )


def author(text: str, n: str, about: str) -> str:
    commas = count(text, ",")
    plain = " OR ".join(
        [
            hit(text, rules.INSTITUTION),
            hit(text, rules.AFFILIATION),
            f"({commas} >= 2 AND {n} <= 22)",
            f"({commas} >= 1 AND {n} <= 18 AND ({hit(text, r'\band\b')} OR regexp_matches({text}, {quoted(f'[{_W}]&[{_W}]')})))",
            f"({n} <= 10 AND {hit(text, rules.TWO_NAMES, True)})",
        ]
    )
    return "(" + " OR ".join(
        [
            hit(text, rules.ID_CODE, True),
            hit(text, rules.EMAIL),
            hit(text, rules.CORRESPONDING),
            f"(NOT {about} AND ({plain}))",
            f"({n} <= 16 AND {hit(text, rules.NAME_LIST)})",
            hit(text, rules.MARKED_NAME, True),
            f"({hit(text, rules.TWO_INITIALS, True)} AND contains({text}, ','))",
            person_names(text, n, about),
        ]
    ) + ")"


def fragment(text: str, n: str) -> str:
    opener = hit(f"ltrim({text})", rules.FRAGMENT_OPENER)
    return f"((regexp_matches(regexp_extract({text}, '\\p{{L}}'), '^\\p{{Ll}}') AND {n} >= 6) OR ({n} >= 8 AND {opener}))"


def sentence(text: str, n: str, about: str) -> str:
    finite, titled = hit(text, rf"\b({'|'.join(rules.FINITE_VERBS)})\b"), title_or_caps(text)
    opener = hit(text, rules.SENTENCE_OPENER)
    return "(" + " OR ".join(
        [
            f"({n} >= 10 AND {hit(text, rules.SENTENCE_SUBJECT)} AND {finite})",
            f"({n} >= 11 AND {finite} AND NOT {titled})",
            hit(text, rules.FIRST_PERSON),
            f"({hit(text, rules.FIRST_PERSON_PAST, True)} AND NOT contains({text}, ':') AND NOT {titled})",
            f"({n} >= 12 AND {period_end(text)} AND ({opener} OR {finite} OR NOT {about}))",
            f"({n} >= 8 AND {opener} AND {hit(text, rules.THANKS)})",
            f"({n} >= 12 AND {hit(text, rules.SENTENCE_PHRASE)})",
            f"({n} >= 8 AND {hit(text, rules.LABELLED_SENTENCE)})",
        ]
    ) + ")"


def formula(text: str) -> str:
    tok = f"regexp_extract_all({text}, '\\S+')"
    cores = f"list_transform({tok}, lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))"
    short = (
        f"len(list_filter({cores}, lambda w: w <> '' AND lower(w) NOT IN {members(rules.FORMULA_SKIP)} "
        f"AND (regexp_matches(w, '^[0-9]+$') OR length(w) = 1)))"
    )
    return f"(len({tok}) >= 6 AND {short} >= 0.4 * len({tok}))"


def ocr_junk(text: str, about: str) -> str:
    w = alpha(text)
    longest = f"list_max(list_transform({w}, lambda w: length(w)))"
    return (
        f"(len({w}) = 0 OR coalesce(NOT {about} AND ((len({w}) <= 6 AND {longest} <= 3) "
        f"OR ({capitals(text)} > 0.4 * {letters(text)} AND len({w}) <= 4 AND {longest} <= 4)), false))"
    )


def without_number(text: str) -> str:
    return f"regexp_replace({text}, {quoted(rules.SECTION_NUMBER)}, '', 'i')"


def reject(context: bool) -> str:
    """Reject reason of rows with the columns of CLASSIFIED."""
    m = lambda p, case=False: hit("text", p, case)
    intro = m(rules.INTRODUCTION_TO)
    never = members(rules.NEVER_TITLES)
    stripped = without_number("text")
    arms = [
        ("chrome_page AND x0 / page_width >= 0.48", "'iop_sidebar'"),
        ("chrome_page AND y_ratio < 0.12 AND word_count <= 4 AND NOT topical", "'journal_subtitle'"),
    ] * context + [
        ("norm = ''", "'empty'"),
        (f"norm IN {never} OR {key(stripped)} IN {never}", "'section_heading'"),
        (f"word_count NOT BETWEEN {rules.MIN_WORDS} AND {rules.MAX_WORDS}", "'word_count'"),
    ]
    if context:
        arms.append(("header AND (y_ratio < 0.12 OR y_ratio > 0.88) AND (word_count > 10 OR font_size <= 12)", "'running_header'"))
    arms += [
        ("boilerplate IS NOT NULL", "boilerplate"),
        ("garbled", "'garbled'"),
        (m(rules.COURSE_CODE, True), "'course_code'"),
        (f"norm IN {members(rules.GENERIC_COURSES)} AND NOT (font_size >= 18 AND page = 1 AND y_ratio < 0.25)", "'generic_course'"),
        (
            f"{m(rules.DEPARTMENT)} OR (NOT topical AND ({m(rules.INSTITUTION)} OR "
            f"({m(rules.TEACHING_PLACE)} AND word_count <= 12)))",
            "'institution'",
        ),
        ("y_ratio < 0.12 AND venue IS NOT NULL", "venue"),
        ("y_ratio < 0.12 AND all_caps AND word_count <= 4 AND NOT topical AND font_size < 14", "'masthead_caps'"),
        (
            f"NOT contains(text, ':') AND NOT {m(rules.VENUE_EXEMPT)} AND coalesce(venue IN ('journal', 'proceedings', 'transactions'), false) "
            "AND word_count <= 14",
            "'journal_name'",
        ),
        ("author", "'author_or_affiliation'"),
        (f"coalesce({letters('text')} / nullif(length(regexp_replace(text, '\\s+', '', 'g')), 0), 0) < 0.55", "'low_letter_ratio'"),
        (m(rules.MONTH_YEAR, True), "'date'"),
        (f"{m(rules.DEEP_HEADING)} OR ({m(rules.SUB_HEADING)} AND NOT {intro})", "'body_section_heading'"),
        (f"{m(rules.DEFINITION)} AND word_count >= 8", "'definition'"),
        (f"{m(rules.LIST_ITEM, True)} AND word_count >= 8", "'list_item'"),
        (f"{m(rules.ROMAN_HEADING, True)} AND word_count <= 8", "'body_section_heading'"),
        (
            f"NOT {intro} AND (regexp_matches(norm, {quoted(rules.CHAPTER_KEY)}) OR {m(rules.INTRODUCTION)})",
            "'section_heading'",
        ),
        (m(rules.EDITOR), "'editor'"),
        (m(rules.DEGREE), "'degree'"),
        (f"{m(rules.TITLED_NAME)} AND NOT topical AND word_count <= 8", "'author_or_affiliation'"),
        ("fragment", "'body_fragment'"),
        ("(all_caps AND period_end AND word_count >= 6) OR sentence", "'sentence'"),
        (formula("text"), "'formula'"),
        (
            f"{ocr_junk('text', 'topical')} OR {m(rules.NO_PERMISSION)} OR (contains(text, '=') AND word_count <= 6 AND NOT topical)",
            "'ocr_junk'",
        ),
        (f"regexp_matches(text, {quoted(rules.NUMERIC)})", "'numeric'"),
    ]
    return "CASE " + " ".join(f"WHEN {w} THEN {r}" for w, r in arms) + " END"


def _placed(source: str, size: str, bold: str, centred: str, page: str) -> str:
    width = f"least({A.MOST_WIDTH}, length(text) * {A.CHAR_WIDTH})"
    return f"""SELECT doc_id, ord, text, {page} AS page, {size}::DOUBLE AS font_size, {bold} AS bold, false AS italic, 'native' AS source,
      (CASE WHEN {centred} THEN ({rules.PAGE_WIDTH} - {width}) / 2 ELSE {A.LEFT} END)::DOUBLE AS x0,
      ({A.TOP} + ord % {A.PAGE_LINES} * {A.LINE_STEP})::DOUBLE AS y0, {width}::DOUBLE AS width,
      {rules.PAGE_WIDTH}::DOUBLE AS page_width, {rules.PAGE_HEIGHT}::DOUBLE AS page_height FROM {source}"""


def _boxed(placed: str) -> str:
    return f"SELECT *, x0 + width AS x1, y0 + font_size AS y1 FROM ({placed})"


def html_lines() -> str:
    parts = f"""SELECT page_id AS doc_id, regexp_extract_all(coalesce(html, ''), {quoted(A.ELEMENT)}, 1) AS tags,
      regexp_extract_all(coalesce(html, ''), {quoted(A.ELEMENT)}, 2) AS texts FROM pages"""
    rows = f"SELECT doc_id, ord, tags[ord + 1] AS tag, {collapse('texts[ord + 1]')} AS text FROM (SELECT *, unnest(range(len(tags))) AS ord FROM ({parts}))"
    size = "CASE tag WHEN 'h1' THEN 18 WHEN 'b' THEN 12 WHEN 'p' THEN 10 ELSE 8 END"
    return _boxed(_placed(f"({rows})", size, "tag IN ('h1', 'b')", "tag = 'h1'", f"ord // {A.PAGE_LINES} + 1"))


def text_lines() -> str:
    rows = f"SELECT doc_id, ord, {collapse('parts[ord + 1]')} AS text FROM (SELECT *, unnest(range(len(parts))) AS ord FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))"
    return _boxed(_placed(f"({rows})", "CASE WHEN ord = 0 THEN 18 ELSE 10 END", "ord = 0", "ord = 0", f"ord // {A.PAGE_LINES} + 1"))


def conversation_lines() -> str:
    rows = f"SELECT doc_id, turn_page, ord, {collapse('parts[ord + 1]')} AS text FROM (SELECT *, unnest(range(len(parts))) AS ord FROM (SELECT conv_id AS doc_id, turn + 1 AS turn_page, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations))"
    return _boxed(_placed(f"({rows})", "10", "false", "false", "turn_page"))


def annotated(lines: str) -> str:
    return geometry(f"SELECT * REPLACE ({clean('text')} AS text) FROM ({lines}) WHERE trim(coalesce(text, '')) <> ''")


def geometry(lines: str) -> str:
    """Columns that follow from the text and the box of cleaned lines."""
    return f"""SELECT *, {key('text')} AS norm, {n_words('text')} AS word_count, y0 / page_height AS y_ratio,
      abs((x0 + x1) / 2 - page_width / 2) / page_width AS center_offset, greatest(y1 - y0, font_size, 1.0) AS line_height FROM ({lines})"""


def classified(lines: str) -> str:
    return classes(annotated(lines))


def classes(cleaned: str) -> str:
    t = f"""SELECT *, {topical('text')} AS topical, {boilerplate('text')} AS boilerplate, {venue('text')} AS venue FROM ({cleaned})"""
    mark = without_number("text")
    return f"""SELECT *, {author('text', 'word_count', 'topical')} AS author, {fragment('text', 'word_count')} AS fragment,
      {sentence('text', 'word_count', 'topical')} AS sentence, {garbled('text')} AS garbled, {all_caps('text')} AS all_caps,
      {period_end('text')} AS period_end, {hit('text', rules.COVER_ROLE)} AS cover_role,
      ({key(mark)} IN {members(rules.ABSTRACT_KEYS)} OR starts_with({key(mark)}, 'abstract ')) AS abstract_mark FROM ({t})"""


def with_bare_reject(lines: str) -> str:
    return rejected(annotated(lines))


def rejected(cleaned: str) -> str:
    return f"SELECT *, {reject(False)} AS reject_bare FROM ({classes(cleaned)})"


def body_sizes(lines: str) -> str:
    """(doc_id, body_size): the size with most characters, the one seen first among equals."""
    return f"""SELECT doc_id, coalesce(max_by(k, struct_pack(a := chars, b := -first)), 11.0) AS body_size FROM (
      SELECT doc_id, round(font_size, 1) AS k, sum(greatest(length(text), 1)) AS chars, min(ord) AS first FROM ({lines})
      WHERE round(font_size, 1) > 0 GROUP BY ALL) GROUP BY doc_id"""


def scored(lines: str) -> str:
    return scores(annotated(lines))


def scores(cleaned: str) -> str:
    """Rows with reject_reason, total, score and a column s_<name> for each signal."""
    w = rules.WEIGHTS
    ctx = f"""SELECT c.*, body_size, min(page) OVER d AS first_page,
      sum(greatest(length(text), 1)) OVER (PARTITION BY c.doc_id ORDER BY font_size RANGE UNBOUNDED PRECEDING) / sum(greatest(length(text), 1)) OVER d AS percentile,
      min(CASE WHEN abstract_mark THEN struct_pack(p := page, y := y0) END) OVER d AS abstract_at,
      min(CASE WHEN author THEN struct_pack(p := page, y := y0) END) OVER d AS author_at,
      min(CASE WHEN cover_role THEN struct_pack(p := page, y := y0) END) OVER d AS cover_at,
      norm <> '' AND word_count <= 18 AND coalesce(min(CASE WHEN word_count <= 18 THEN page END) OVER n < max(CASE WHEN word_count <= 18 THEN page END) OVER n, false)
        AND sum(CASE WHEN word_count <= 18 AND (y_ratio < 0.12 OR y_ratio > 0.88) THEN 1 ELSE 0 END) OVER n >= 2 AS header,
      bool_or({hit('text', rules.CHROME_MARKER)}) OVER (PARTITION BY c.doc_id, page) AS chrome_page,
      lag(font_size) OVER o AS above_size, lead(font_size) OVER o AS below_size, lead(author) OVER o AS below_author
      FROM ({rejected(cleaned)}) c JOIN ({body_sizes(cleaned)}) b ON c.doc_id = b.doc_id
      WINDOW d AS (PARTITION BY c.doc_id), n AS (PARTITION BY c.doc_id, norm), o AS (PARTITION BY c.doc_id, page ORDER BY y0, ord)"""
    gaps = isolation(cleaned)
    after = "(abstract_at IS NOT NULL AND (page > abstract_at.p OR (page = abstract_at.p AND y0 > abstract_at.y + 8)))"
    side = lambda g: f"CASE WHEN {g} / greatest(line_height * 0.35, 2.0) >= 1.6 THEN {w['isolation'] * 0.5} WHEN {g} / greatest(line_height * 0.35, 2.0) >= 1.1 THEN {w['isolation'] * 0.25} ELSE 0 END"
    sandwich = lambda at, near, far, full, part: (
        f"CASE WHEN page = {at}.p AND {at}.y - y1 BETWEEN {near[0]} AND {near[1]} THEN {full} WHEN page = {at}.p AND {at}.y - y1 BETWEEN {far[0]} AND {far[1]} THEN {full * part} ELSE 0 END"
    )
    bonus = (
        f"(CASE WHEN font_size >= above_size * 0.92 THEN {w['prominence'] * 0.35} ELSE 0 END + CASE WHEN coalesce(below_author, false) "
        f"OR coalesce(below_size > 0 AND font_size >= below_size * 1.12, false) THEN {w['prominence'] * 0.65} ELSE 0 END)"
    )
    signals = {
        "font_percentile": percentile_signal("percentile"),
        "size_vs_body": size_signal("font_size", "body_size"),
        "bold": f"CASE WHEN bold THEN {w['bold']} ELSE 0 END",
        "vertical": vertical_signal("y_ratio"),
        "centering": center_signal("center_offset"),
        "isolation": f"{side('gap_above')} + {side('gap_below')}",
        "word_count": word_signal("word_count"),
        "capitalization": caps_signal("text"),
        "page_bias": page_signal("page", "first_page"),
        "before_abstract": f"CASE WHEN abstract_at IS NULL OR {after} THEN 0 WHEN page = abstract_at.p AND abstract_at.y - y0 < 280 THEN {w['before_abstract']} "
        f"WHEN page = abstract_at.p THEN {w['before_abstract'] * 0.6} WHEN page = abstract_at.p - 1 THEN {w['before_abstract'] * 0.3} ELSE 0 END",
        "above_authors": sandwich("author_at", (4, 90), (0, 160), w["above_authors"], 0.55),
        "above_cover_role": sandwich("cover_at", (2, 140), (0, 220), w["above_cover_role"], 0.5),
        "prominence": f"least({w['prominence']}, CASE WHEN body_size > 0 AND font_size >= body_size * 1.25 THEN least({w['prominence']}, {bonus} + 2.0) ELSE {bonus} END)",
        "starts_capital": f"CASE WHEN regexp_matches(regexp_extract(text, '\\p{{L}}'), '^\\p{{Lu}}') THEN {w['starts_capital']} ELSE 0 END",
    }
    penalties = [
        f"CASE WHEN {after} THEN -28 ELSE 0 END",
        "CASE WHEN y_ratio > 0.72 THEN -12 ELSE 0 END",
        "CASE WHEN font_size <= body_size * 1.04 THEN -14 ELSE 0 END",
        "CASE WHEN center_offset > 0.22 AND font_size < body_size * 1.4 THEN -4 ELSE 0 END",
        "CASE WHEN period_end AND word_count > 12 THEN -3 ELSE 0 END",
        f"CASE WHEN y_ratio < 0.18 AND coalesce(venue IN {members(rules.VENUE_PENALTY)}, false) THEN -18 ELSE 0 END",
    ]
    named = ", ".join(f"({x})::DOUBLE AS s_{k}" for k, x in signals.items())
    total = " + ".join([f"s_{k}" for k in signals] + [f"({x})" for x in penalties])
    good = f"reject_reason IS NULL AND NOT (word_count < {rules.SWEET_MIN} AND font_size < body_size * 1.35)"
    return f"""SELECT *, CASE WHEN {good} AND total >= {rules.LEAST_SCORE} THEN total END AS score FROM (SELECT *, {total} AS total FROM (
      SELECT *, {reject(True)} AS reject_reason, {named} FROM ({ctx}) x JOIN ({gaps}) g USING (doc_id, ord)))"""


def isolation(lines: str) -> str:
    """(doc_id, ord, gap_above, gap_below) by a range self-join on the page."""
    return f"""SELECT a.doc_id, a.ord, greatest(least(any_value(a.y0), coalesce(min(CASE WHEN b.y1 <= a.y0 + 0.4 THEN a.y0 - b.y1 END), any_value(a.y0))), 0) AS gap_above,
      greatest(least(any_value(a.page_height - a.y1), coalesce(min(CASE WHEN b.y1 > a.y0 + 0.4 AND b.y0 >= a.y1 - 0.4 THEN b.y0 - a.y1 END), 1e9)), 0) AS gap_below
      FROM ({lines}) a LEFT JOIN ({lines}) b ON a.doc_id = b.doc_id AND a.page = b.page AND a.ord <> b.ord GROUP BY a.doc_id, a.ord"""


def percentile_signal(p: str) -> str:
    return f"{rules.WEIGHTS['font_percentile']} * least(1.0, greatest(0.0, ({p} - 0.55) / 0.45))"


def size_signal(size: str, body: str) -> str:
    return f"CASE WHEN {body} <= 0 OR {size} / {body} <= 1.05 THEN 0 ELSE {rules.WEIGHTS['size_vs_body']} * least(1.0, ({size} / {body} - 1.05) / 0.55) END"


def _steps(column: str, steps: list[tuple[str, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} {test} THEN {value}" for test, value in steps) + " ELSE 0 END"


def vertical_signal(y: str) -> str:
    w = rules.WEIGHTS["vertical"]
    return _steps(y, [("< 0.04", 1.0), ("< 0.08", w * 0.8), ("<= 0.48", w), ("<= 0.62", w * 0.55), ("<= 0.75", w * 0.2)])


def center_signal(offset: str) -> str:
    w = rules.WEIGHTS["centering"]
    return _steps(offset, [("<= 0.04", w), ("<= 0.08", w * 0.7), ("<= 0.14", w * 0.3)])


def word_signal(n: str) -> str:
    w = rules.WEIGHTS["word_count"]
    return f"CASE WHEN {n} BETWEEN 5 AND 16 THEN {w} WHEN {n} BETWEEN {rules.SWEET_MIN} AND {rules.SWEET_MAX} THEN {w * 0.7} WHEN {n} BETWEEN {rules.MIN_WORDS} AND {rules.MAX_WORDS} THEN {w * 0.25} ELSE 0 END"


def page_signal(page: str, first: str) -> str:
    w = rules.WEIGHTS["page_bias"]
    return _steps(f"{page} - {first}", [("<= 0", w), ("= 1", w * 0.45), ("= 2", w * 0.2)])


def caps_signal(text: str) -> str:
    w, found = rules.WEIGHTS["capitalization"], alpha(text)
    small = "regexp_matches(w[2:], '[a-z]') AND NOT regexp_matches(w[2:], '[A-Z]')"
    parts = "regexp_matches(w[2:], '[A-Z]') AND NOT regexp_matches(w[2:], '[A-Za-z][A-Z]') AND NOT regexp_matches(w[2:], '(?:^|[^A-Za-z])[a-z]')"
    titled = f"len(list_filter({found}, lambda w: regexp_matches(w, '^[A-Z]') AND (length(w) = 1 OR ({small}) OR ({parts}))))"
    shouted = f"len(list_filter({found}, lambda w: NOT (length(w) <= 1 OR upper(w) = w))) = 0"
    content = f"len(list_filter({found}, lambda w: lower(w) NOT IN {members(rules.SMALL_WORDS)})) > 0"
    return (
        f"CASE WHEN len({found}) = 0 THEN 0 WHEN {shouted} THEN {w * 0.7} WHEN {content} AND {titled} >= 0.6 * len({found}) THEN {w} "
        f"WHEN regexp_matches({found}[1], '^[A-Z]') THEN {w * 0.35} ELSE 0 END"
    )


def short_name(text: str, about: str) -> str:
    w = alpha(text)
    nouns = f"len(list_filter({w}, lambda w: lower(w) IN {members(rules.SHORT_NAME_NOUNS)} OR NOT regexp_matches(w, '^[A-Z]'))) = 0"
    return f"(len({w}) BETWEEN 1 AND 3 AND NOT {about} AND ({hit(text, rules.HONORIFIC)} OR {nouns}))"
