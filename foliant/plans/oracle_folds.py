"""The order-dependent folds in DuckDB SQL: lists of structs that list_reduce walks through.

What a fold has so far is in fields of the struct that it walks over, as an accumulator must be of the
elements' type.
"""

from __future__ import annotations

from foliant.functions import rules
from foliant.functions.text import WORD
from foliant.operators import merge
from foliant.operators import titles as T
from foliant.plans import oracle as O


def joined(texts: str) -> str:
    """Texts with spaces between; a single hyphen at an end goes and glues."""
    glued = "CASE WHEN o LIKE '%-' AND o NOT LIKE '%--' THEN o[:-2] || t WHEN o <> '' THEN o || ' ' || t ELSE t END"
    return f"trim(regexp_replace(list_reduce(list_transform({texts}, lambda t: trim(t)), lambda o, t: {glued}, ''), '\\s+', ' ', 'g'))"


def ends_open(text: str) -> str:
    found = f"regexp_extract_all({text}, {O.quoted(WORD)})"
    return f"(len({found}) > 1 AND lower({found}[-1]) IN {O.members(rules.DANGLING)})"


def same_size(a: str, b: str) -> str:
    return f"({a} > 0 AND {b} > 0 AND (abs({a} - {b}) <= {rules.SAME_SIZE_POINTS} OR abs({a} - {b}) <= {rules.SAME_SIZE_RATIO} * greatest({a}, {b})))"


def other_column(a: str, b: str) -> str:
    """Whether two lines of a page, which is as wide as the first says, stand in different columns."""
    width = f"{a}.page_width"
    overlap = f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    band = f"greatest(least({a}.line_height, {b}.line_height), 1.0)"
    gutter = f"greatest(0.0, {b}.x0 - {a}.x1, {a}.x0 - {b}.x1)"
    mid = lambda x: f"(({x}.x0 + {x}.x1) / 2)"
    return (
        f"(NOT ({overlap} > 0.45 * {band} AND {gutter} <= greatest(90.0, 0.16 * {width})) AND ("
        f"(least({mid(a)}, {mid(b)}) < 0.46 * {width} AND greatest({mid(a)}, {mid(b)}) > 0.54 * {width})"
        f" OR (({a}.x0 < 0.48 * {width}) <> ({b}.x0 < 0.48 * {width}) AND {overlap} > 0.2 * {band})))"
    )


def within(upper: str, lower: str, limit: str, size: str) -> str:
    return f"({lower}.y0 - {upper}.y1 <= ({limit}) * greatest({upper}.line_height, {lower}.line_height, {size}))"


def wraps(upper: str, lower: str) -> str:
    size = f"(CASE WHEN {upper}.font_size <> 0 THEN {upper}.font_size ELSE 1.0 END)"
    return (
        f"({upper}.page = {lower}.page AND {lower}.word_count <= 6 AND {upper}.word_count >= 2 AND NOT {upper}.closed AND NOT {upper}.stop_end"
        f" AND NOT {lower}.abstract_mark AND NOT {lower}.contact AND {same_size(size, lower + '.font_size')} AND {within(upper, lower, '2.2', size)})"
    )


def flagged(classified: str) -> str:
    """Lines with reject_bare, and the single-line tests of the folds."""
    t, never = "text", f"norm IN {O.members(rules.NEVER_TITLES)}"
    particle = f"(word_count = 1 AND lower(regexp_extract_all(text, {O.quoted(WORD)})[-1]) IN {O.members(rules.DANGLING)})"
    chrome = f"norm IN {O.members(rules.INTERRUPTERS)} OR starts_with(norm, 'you may also like') OR starts_with(norm, 'to cite this article')"
    return f"""SELECT *, {O.short_name(t, 'topical')} AS short_name, {O.incomplete(t)} AS incomplete, {particle} OR {never} AS heading,
      {particle} OR {never} OR boilerplate IS NOT NULL AS closed,
      ({chrome} OR (word_count < {rules.MIN_WORDS} AND NOT (regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '^[\\d.]+')))) AS interrupter,
      {O.hit(t, rules.CONTACT)} AS contact, {O.count(t, ',')} >= 2 AND NOT topical AS listed, {O.hit(t, rules.SUBMITTED)} AS submitted,
      regexp_matches(text, '[.?!]$') AS stop_end, regexp_matches(text, '^[a-z]') AS lower_start, {O.hit(t, rules.PROSE_OPENER)} AS opener,
      regexp_matches(text, '\\.\\s+[A-Za-z]') AS inner_period, {O.hit(t, rules.ID_CODE, True)} AS id_code,
      norm IN {O.members(rules.GENERIC_COURSES)} AS course, regexp_matches(norm, {O.quoted(rules.REPORT_KEY)}) AS report FROM ({classified})"""


_LINE = ("doc_id", "ord", "text", "page", "font_size", "bold", "x0", "y0", "x1", "y1", "page_width", "page_height")


def _struct(names: tuple[str, ...], of: str = "") -> str:
    return "struct_pack(" + ", ".join(f"{n} := {of}{n}" for n in names) + ")"


def _goes_on(held: str, line: str) -> str:
    """Whether `line` continues the title of which `held` are the lines so far."""
    a, b = f"{held}[-1]", line
    p, q = f"{a}.font_size", f"{b}.font_size"
    texts = f"list_transform({held}, lambda h: h.text)"
    open_end = f"({a}.incomplete OR {ends_open(joined(texts))})"
    loose = f"({open_end} OR {wraps(a, b)})"
    words = O.n_words(joined(f"list_append({texts}, {b}.text)"))
    barred = " OR ".join(
        [
            f"{a}.boilerplate IS NOT NULL", f"{b}.contact", f"{b}.listed", f"({b}.author AND NOT {loose})", f"({b}.short_name AND NOT {loose})",
            f"{a}.author", f"({a}.short_name AND NOT {loose})", f"{b}.abstract_mark", f"{b}.boilerplate IS NOT NULL", f"{b}.submitted",
            f"coalesce({b}.reject_bare IN ('journal_name', 'institution', 'garbled', 'section_heading'), false)", f"{p} = 0",
            f"{words} > {rules.MAX_MERGED_WORDS}", f"NOT {same_size(p, q)}", f"NOT {within(a, b, f'CASE WHEN {open_end} THEN 2.6 ELSE 2.4 END', p)}",
        ]
    )
    indented = f"abs({a}.x0 - {b}.x0) <= 24 AND {within(a, b, '1.8', p)}"
    strong = f"({a}.topical OR {open_end} OR {a}.all_caps)"
    return f"""CASE WHEN {a}.page <> {b}.page OR {a}.heading THEN false
      WHEN {a}.course AND {b}.report AND {p} <> 0 AND abs({p} - {q}) <= 0.35 * greatest({p}, 1.0) AND {within(a, b, '3.5', p)} THEN true
      WHEN {barred} THEN false
      WHEN {loose} AND NOT {b}.sentence THEN true
      WHEN {b}.lower_start AND {indented} AND NOT {a}.stop_end AND NOT {b}.sentence THEN true
      WHEN {b}.word_count <= 4 AND {a}.word_count >= 2 AND NOT {a}.stop_end AND {strong} AND NOT {a}.id_code THEN true
      WHEN abs({a}.center_offset - {b}.center_offset) > CASE WHEN {b}.word_count <= 4 THEN 0.32 ELSE 0.20 END THEN false
      ELSE NOT ({b}.sentence OR {b}.fragment OR ({b}.opener AND NOT {open_end}) OR {b}.inner_period) END"""


_FOLD = tuple(dict.fromkeys((*_LINE, *merge.FOLD_FLAGS)))


def merged(flagged_lines: str) -> str:
    """Lines (_LINE) with wrapped titles joined, ord anew: each round of the recursion takes what stood in another column."""
    held = "acc.held"
    many = lambda f, c: f"{f}(list_transform({held}, lambda h: h.{c}))"
    parts = {
        "text": joined(f"list_transform({held}, lambda h: h.text)"), "font_size": many("list_max", "font_size"),
        "bold": f"(len(list_filter({held}, lambda h: h.bold)) > 0)",
        "x0": many("list_min", "x0"), "y0": many("list_min", "y0"), "x1": many("list_max", "x1"), "y1": many("list_max", "y1"),
    }
    one = "struct_pack(" + ", ".join(f"{n} := {parts.get(n, f'{held}[1].{n}')}" for n in _FOLD) + ")"
    whole = f"(CASE WHEN len({held}) = 1 THEN {held}[1] ELSE {one} END)"
    state = lambda l, h, o, w: f"struct_pack(l := {l}, held := {h}, done := {o}, later := {w})"
    step = f"""CASE WHEN {held}[-1].page = x.l.page AND {other_column(held + '[-1]', 'x.l')} THEN {state('x.l', held, 'acc.done', 'list_append(acc.later, x.l)')}
      WHEN {_goes_on(held, 'x.l')} THEN {state('x.l', f'list_append({held}, x.l)', 'acc.done', 'acc.later')}
      ELSE {state('x.l', '[x.l]', f'list_append(acc.done, {whole})', 'acc.later')} END"""
    none = "list_slice(stream, 1, 0)"
    elements = f"list_transform(stream[2:], lambda l: {state('l', none, none, none)})"
    reduced = f"list_reduce({elements}, lambda acc, x: {step}, {state('stream[1]', '[stream[1]]', none, none)})"
    order = "ORDER BY page, y0, x0, ord"
    return f"""(WITH RECURSIVE f AS ({flagged_lines}),
      rounds AS (
        SELECT doc_id, list({_struct(_FOLD)} {order}) FILTER (NOT interrupter) AS stream, list({_struct(_FOLD)}) FILTER (interrupter) AS done FROM f GROUP BY doc_id
        UNION ALL
        SELECT doc_id, acc.later, list_append(acc.done, {whole}) FROM (SELECT doc_id, {reduced} AS acc FROM rounds WHERE len(stream) > 0)
      )
      SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id {order}) - 1 AS ord) FROM (
        SELECT {', '.join(f'l.{n} AS {n}' for n in _LINE)} FROM (SELECT unnest(done) AS l FROM rounds WHERE done IS NOT NULL)))"""


def without_covers(lines: str) -> str:
    """Annotated or classified lines without a publisher's cover pages."""
    return f"""(WITH l AS ({lines}), c AS (SELECT doc_id AS c_doc, page AS c_page, {O.hit("string_agg(text, ' ' ORDER BY ord)", rules.COVER_PAGE)} AS cover FROM l GROUP BY doc_id, page)
      SELECT l.* FROM l JOIN c ON doc_id = c_doc AND page = c_page
      WHERE NOT cover OR doc_id IN (SELECT c_doc FROM c GROUP BY c_doc HAVING bool_and(cover)))"""


def candidates(lines: str) -> str:
    """Lines after merging, scored, with the tests of the folds."""
    rejected = O.rejected(without_covers(O.annotated(lines)))
    return flagged(O.scores(O.geometry(merged(flagged(rejected)))))


_GROW = tuple(dict.fromkeys((*_FOLD, "y_ratio", "venue", "score")))


def grown(scored: str) -> str:
    """Rows of `scored` that have a score, with merged_text and merged_score."""
    size = "(CASE WHEN w.font_size <> 0 THEN w.font_size ELSE 1.0 END)"

    def may_join(line: str, loose: str) -> str:
        own, none = f"{line}.font_size", f"{line}.reject_bare IS NULL"
        forgiven = f"({none} OR ({loose} AND {line}.reject_bare IN ('word_count', 'body_fragment', 'author_or_affiliation')))"
        far = f"abs({line}.center_offset - w.center_offset) > CASE WHEN {loose} OR {line}.word_count <= 4 THEN 0.36 ELSE 0.20 END"
        return (
            f"({forgiven} AND NOT ({line}.author AND NOT {loose}) AND NOT {line}.abstract_mark AND {same_size(size, own)} AND NOT ({far})"
            f" AND NOT ({line}.bold <> w.bold AND abs({own} - {size}) > 0.08 * {size} AND NOT {loose}))"
        )

    near = lambda a, b, loose: f"({b}.y0 - {a}.y1 < (CASE WHEN {loose} THEN 2.2 ELSE 1.7 END) * greatest({a}.line_height, {b}.line_height, {size}))"
    texts = lambda xs: f"list_transform({xs}, lambda h: h.text)"
    fits = lambda xs: f"{O.n_words(joined(xs))} <= {rules.MAX_MERGED_WORDS}"
    state = lambda parts, ended: f"struct_pack(l := x.l, parts := {parts}, ended := {ended})"
    loose = f"({ends_open(joined(texts('acc.parts')))} OR {wraps('acc.parts[-1]', 'x.l')})"
    below = f"""CASE WHEN acc.ended OR {other_column('w', 'x.l')} OR {other_column('acc.parts[-1]', 'x.l')} THEN acc
      WHEN NOT ({may_join('x.l', loose)} AND {near('acc.parts[-1]', 'x.l', loose)} AND {fits(f"list_append({texts('acc.parts')}, x.l.text)")}) THEN {state('acc.parts', 'true')}
      ELSE {state('list_append(acc.parts, x.l)', 'false')} END"""
    loose = f"(x.l.incomplete OR {wraps('x.l', 'acc.parts[1]')})"
    above = f"""CASE WHEN acc.ended THEN acc
      WHEN x.l.closed OR (x.l.y_ratio < 0.10 AND x.l.venue IS NOT NULL) OR NOT ({may_join('x.l', loose)} AND {near('x.l', 'acc.parts[1]', loose)}
        AND {fits(f"list_prepend(x.l.text, {texts('acc.parts')})")}) THEN {state('acc.parts', 'true')}
      ELSE {state('list_prepend(x.l, acc.parts)', 'false')} END"""
    element = lambda lines: f"list_transform({lines}, lambda l: struct_pack(l := l, parts := list_slice(lines, 1, 0), ended := false))"
    first = lambda parts: f"struct_pack(l := w, parts := {parts}, ended := false)"
    value = "list_max(list_append(list_transform(parts, lambda p: list_filter(lines, lambda q: q.norm = p.norm AND q.score IS NOT NULL)[-1].score), w.score))"
    return f"""(WITH s AS ({scored}), page_lines AS (SELECT doc_id, page, list({_struct(_GROW)} ORDER BY y0, x0, ord) AS lines FROM s GROUP BY doc_id, page),
      winners AS (SELECT p.*, w, list_position(list_transform(lines, lambda l: l.ord), w.ord) AS seat FROM page_lines p, unnest(list_filter(lines, lambda l: l.score IS NOT NULL)) AS u(w)),
      lower_part AS (SELECT *, list_reduce({element('lines[seat + 1:]')}, lambda acc, x: {below}, {first('[w]')}).parts AS low FROM winners),
      both_parts AS (SELECT *, list_reduce({element('list_reverse(lines[:seat - 1])')}, lambda acc, x: {above}, {first('low')}).parts AS parts FROM lower_part)
      SELECT doc_id, w.ord AS g_ord, {joined(texts('parts'))} AS merged_text,
        {value} + CASE WHEN len(parts) > 1 THEN least(6.0, 2.0 * (len(parts) - 1)) ELSE 0.0 END AS merged_score FROM both_parts)"""


def multiline_titles(lines: str) -> str:
    s = candidates(lines)
    return f"""WITH c AS MATERIALIZED ({s}), g AS ({grown('SELECT * FROM c')})
      SELECT c.doc_id, c.ord, c.text, merged_text, round(merged_score, 4) AS merged_score FROM c JOIN g ON c.doc_id = g.doc_id AND c.ord = g.g_ord
      UNION ALL SELECT doc_id, min(ord), min_by(text, ord), NULL, NULL FROM c GROUP BY doc_id HAVING count(score) = 0"""


def wrapped(lines: str) -> str:
    """Lines cut into pieces of five words and set solid, some in a second column, some with a topical or an open end."""
    w = "string_split(text, ' ')"
    pieces = f"SELECT * REPLACE (array_to_string({w}[5 * k + 1 : 5 * k + 5], ' ') AS text) FROM (SELECT *, unnest(range((len({w}) + 4) // 5)) AS k FROM ({lines}))"
    numbered = f"SELECT * EXCLUDE (ord, k), row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS ord FROM ({pieces})"
    ended = "text || CASE WHEN ord % 9 = 4 THEN ' Design Study' WHEN ord % 13 = 5 THEN ' of the' ELSE '' END"
    placed = f"""SELECT * REPLACE (ord // 40 + 1 AS page, {ended} AS text, CASE WHEN ord % 11 = 7 THEN 330.0 ELSE 72.0 + ord % 3 * 10 END AS x0, 40.0 + ord % 40 * 18 AS y0) FROM ({numbered})"""
    return f"SELECT * REPLACE (x0 + least(220.0, 5.0 * length(text)) AS x1, y0 + font_size AS y1) FROM ({placed})"


def word_spans(lines: str) -> str:
    """Every word as a span: two lines side by side, some words apart, some larger, every fifth line of OCR."""
    words = f"SELECT *, unnest(range(len(w))) AS k FROM (SELECT *, string_split(text, ' ') AS w FROM ({lines}))"
    left = "72.0 + ord % 2 * 270 + k * 45 + CASE WHEN k % 6 = 5 THEN 22 ELSE 0 END"
    top = "40.0 + ord // 2 % 12 * 50 + k % 3"
    big = "font_size + CASE WHEN k % 8 = 7 THEN 6 ELSE 0 END"
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS ord, w[k + 1] AS text, (ord // 24 + 1)::INT AS page, {big} AS font_size, bold,
      {left} AS x0, {top} AS y0, {left} + 40 AS x1, {top} + font_size AS y1, CASE WHEN ord % 5 = 2 THEN 'ocr' ELSE 'native' END AS source FROM ({words}) WHERE w[k + 1] <> ''"""


_SPAN = ("text", "font_size", "bold", "x0", "y0", "x1", "y1", "source")


def _size1(s: str) -> str:
    return f"(CASE WHEN {s}.font_size <> 0 THEN {s}.font_size ELSE 1.0 END)"


def _cluster(s: str, c: str | None = None) -> str:
    """What counts of a cluster: of the span alone, or with that of the cluster before."""
    with_ = lambda f, n, own: f"{n} := {f}({c}.{n}, {own})" if c else f"{n} := {own}"
    ocr = f"ocr := {c}.ocr OR {s}.source = 'ocr'" if c else f"ocr := {s}.source = 'ocr'"
    fields = [with_("least", "top", f"{s}.y0"), with_("greatest", "bottom", f"{s}.y1"), with_("least", "lft", f"{s}.x0"), with_("greatest", "rgt", f"{s}.x1")]
    return f"struct_pack({', '.join([*fields, with_('greatest', 'size', f'{s}.font_size'), with_('greatest', 'size1', _size1(s)), ocr])})"


def _on_line(s: str, c: str) -> str:
    """Whether a span shares the baseline of the cluster `c`."""
    tall, line_tall = f"greatest({s}.y1 - {s}.y0, {_size1(s)}, 1.0)", f"greatest({c}.bottom - {c}.top, {c}.size1, 1.0)"
    overlap = f"(least({s}.y1, {c}.bottom) - greatest({s}.y0, {c}.top))"
    apart = f"abs(({s}.y0 + {s}.y1) / 2 - ({c}.top + {c}.bottom) / 2)"
    gutter = f"greatest(0.0, {s}.x0 - {c}.rgt, {c}.lft - {s}.x1)"
    a, b = f"{s}.font_size", f"{c}.size"
    return (
        f"(NOT ({overlap} <= 0.25 * least({tall}, {line_tall}) AND {apart} >= 0.4 * greatest({tall}, {line_tall}))"
        f" AND NOT ({a} <> 0 AND {b} <> 0 AND abs({a} - {b}) > 0.30 * greatest({a}, {b}) AND {gutter} > 8)"
        f" AND {gutter} <= CASE WHEN {c}.ocr OR {s}.source = 'ocr' THEN greatest(90.0, 0.16 * greatest({c}.rgt, {s}.x1, 1.0)) ELSE 20.0 END)"
    )


def _halves(a: str, b: str) -> str:
    """Whether two lines, one of OCR at least, are halves of one line."""
    tall = lambda x: f"greatest({x}.y1 - {x}.y0, CASE WHEN {x}.font_size <> 0 THEN {x}.font_size ELSE 1.0 END, 1.0)"
    p, q = f"{a}.font_size", f"{b}.font_size"
    return (
        f"({a}.page = {b}.page AND 'ocr' IN ({a}.source, {b}.source) AND least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0) > 0.45 * least({tall(a)}, {tall(b)})"
        f" AND NOT ({p} <> 0 AND {q} <> 0 AND abs({p} - {q}) > 0.18 * greatest({p}, {q}))"
        f" AND greatest(0.0, {b}.x0 - {a}.x1, {a}.x0 - {b}.x1) <= greatest(90.0, 0.18 * greatest({a}.x1, {b}.x1, 1.0)))"
    )


def spans_to_lines(span_rows: str) -> str:
    """(doc_id, ord, text, page, font_size, bold, span_count, x0, y0, x1, y1): visual lines of spans."""
    home = f"coalesce(list_position(list_transform(acc.clusters, lambda c: {_on_line('x.s', 'c')}), true), 0)"
    joined_in = f"list_transform(acc.clusters, lambda c, i: CASE WHEN i = h THEN {_cluster('x.s', 'c')} ELSE c END)"
    step = f"""list_transform([{home}], lambda h: struct_pack(s := x.s, clusters := CASE WHEN h = 0 THEN list_append(acc.clusters, {_cluster('x.s')}) ELSE {joined_in} END,
      homes := list_append(acc.homes, CASE WHEN h = 0 THEN len(acc.clusters) + 1 ELSE h END)))[1]"""
    text = """list_reduce(list_transform(members[2:], lambda s: struct_pack(s := s, done := '')), lambda acc, x: struct_pack(s := x.s,
      done := acc.done || CASE WHEN x.s.x0 - acc.s.x1 > 1.2 AND acc.done NOT LIKE '% ' AND x.s.text NOT LIKE ' %' THEN ' ' ELSE '' END || x.s.text),
      struct_pack(s := members[1], done := members[1].text)).done"""
    of = lambda f, n: f"{f}(list_transform(members, lambda m: m.{n}))"
    main = "list_sort(list_transform(members, lambda m, i: struct_pack(a := -length(m.text), b := -m.font_size, i := i)))[1].i"
    fields = ("page", "text", "font_size", "bold", "source", "span_count", "x0", "y0", "x1", "y1")
    last = "acc.done[-1]"
    both = f"""struct_pack(page := {last}.page, text := trim(trim({last}.text) || ' ' || trim(x.l.text)), font_size := greatest({last}.font_size, x.l.font_size),
      bold := {last}.bold OR x.l.bold, source := 'ocr', span_count := {last}.span_count + x.l.span_count, x0 := round(least({last}.x0, x.l.x0), 2),
      y0 := round(least({last}.y0, x.l.y0), 2), x1 := round(greatest({last}.x1, x.l.x1), 2), y1 := round(greatest({last}.y1, x.l.y1), 2))"""
    return f"""WITH pages_ AS (SELECT doc_id, page, list({_struct(_SPAN)} ORDER BY y0, x0, ord) AS found FROM ({span_rows}) GROUP BY doc_id, page),
      folded AS (SELECT doc_id, page, found, list_reduce(list_transform(found[2:], lambda s: struct_pack(s := s, clusters := list_slice([{_cluster('s')}], 1, 0), homes := list_slice([1::BIGINT], 1, 0))),
        lambda acc, x: {step}, struct_pack(s := found[1], clusters := [{_cluster('found[1]')}], homes := [1::BIGINT])).homes AS homes FROM pages_),
      members_ AS (SELECT doc_id, page, unnest(found) AS s, unnest(homes) AS number, unnest(range(len(found))) AS i FROM folded),
      rows_ AS (SELECT doc_id, page, number, list(s ORDER BY s.x0, s.y0, i) AS members FROM members_ GROUP BY doc_id, page, number),
      lines_ AS (SELECT doc_id, page, number, trim(regexp_replace({text}, '[ \t]+', ' ', 'g')) AS text, round({of('list_max', 'font_size')}, 2) AS font_size,
        len(list_filter(members, lambda m: m.bold)) > 0 AS bold, members[{main}].source AS source, len(members) AS span_count, round({of('list_min', 'x0')}, 2) AS x0,
        round({of('list_min', 'y0')}, 2) AS y0, round({of('list_max', 'x1')}, 2) AS x1, round({of('list_max', 'y1')}, 2) AS y1 FROM rows_),
      docs_ AS (SELECT doc_id, list({_struct(fields)} ORDER BY page, y0, x0, number) AS found FROM lines_ WHERE text <> '' GROUP BY doc_id),
      whole AS (SELECT doc_id, list_reduce(list_transform(found[2:], lambda l: struct_pack(l := l, done := list_slice(found, 1, 0))),
        lambda acc, x: struct_pack(l := x.l, done := CASE WHEN {_halves(last, 'x.l')} THEN list_append(acc.done[:-2], {both}) ELSE list_append(acc.done, x.l) END),
        struct_pack(l := found[1], done := [found[1]])).done AS done FROM docs_),
      out_ AS (SELECT doc_id, unnest(done) AS l, unnest(range(len(done))) AS i, coalesce(list_max(list_transform(list_filter(done, lambda d: d.source = 'ocr'), lambda d: d.font_size)), 0) AS peak FROM whole)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l.page, l.y0, l.x0, i) - 1 AS ord, l.text AS text, l.page AS page, l.font_size AS font_size,
        l.bold OR (l.source = 'ocr' AND peak > 0 AND l.font_size >= 0.97 * peak) AS bold, l.span_count AS span_count, l.x0 AS x0, l.y0 AS y0, l.x1 AS x1, l.y1 AS y1 FROM out_"""


def labels(classified: str) -> str:
    """(doc_id, title, page, reason): the first line that says what the title is."""
    part = lambda pattern: O.collapse(f"regexp_extract(text, {O.quoted(pattern)}, 1, 'i')")
    course = f"trim(regexp_replace({part(rules.COURSE_LINE)}, {O.quoted(rules.COURSE_PREFIX)}, '', 'i'))"
    fine = "word_count >= 3 AND topical AND boilerplate IS NULL AND NOT sentence"
    named = f"""SELECT *, {part(rules.LABELLED_TITLE)} AS label, regexp_replace({part(rules.PRINT_CHROME_TITLE)}, '^I\\s+', '') AS chrome, {course} AS course_title,
      {O.hit('text', rules.COURSE_LINE)} AS is_course, CASE WHEN lead(page) OVER o = page THEN lead(CASE WHEN {fine} THEN text END) OVER o END AS following
      FROM ({classified}) WINDOW o AS (PARTITION BY doc_id ORDER BY page, y0, ord)"""
    ok = f"({O.n_words('course_title')} >= 3 AND {O.topical('course_title')})"
    chosen = f"""SELECT *, CASE WHEN label <> '' THEN label WHEN chrome <> '' THEN chrome WHEN is_course AND {ok} THEN course_title WHEN is_course THEN following END AS title,
      CASE WHEN label <> '' THEN {O.quoted(T.LABEL)} WHEN chrome <> '' THEN {O.quoted(T.CHROME)} WHEN {ok} THEN {O.quoted(T.COURSE)} ELSE {O.quoted(T.COURSE_NEXT)} END AS why FROM ({named})"""
    counted = f"SELECT *, {O.n_words('title')} AS n, {O.topical('title')} AS about FROM ({chosen}) WHERE title <> ''"
    return f"""SELECT doc_id, s.t AS title, s.p AS page, s.w AS reason FROM (
      SELECT doc_id, min_by(struct_pack(t := title, p := page, w := why), struct_pack(p := page, y := y0, o := ord)) AS s FROM ({counted})
      WHERE n >= {rules.MIN_WORDS} AND {O.boilerplate('title')} IS NULL AND NOT {O.sentence('title', 'n', 'about')} GROUP BY doc_id)"""


def fallbacks(rejected: str) -> str:
    return f"""SELECT doc_id, s.t AS title, s.p AS page FROM (SELECT doc_id, max_by(struct_pack(t := text, p := page), struct_pack(a := font_size, b := word_count, c := -y0, d := -ord)) AS s
      FROM ({rejected}) WHERE reject_bare IS NULL AND word_count >= {rules.MIN_WORDS} AND topical AND NOT fragment AND NOT sentence GROUP BY doc_id)"""


_RANKED = (
    "ord", "text", "norm", "page", "score", "topical", "all_caps", "word_count", "author", "prose", "signal_sum", "merged_text", "merged_score", "m_norm",
    "m_author", "m_short", "m_prose",
)


def detected(meta: str, lines: str) -> str:
    """One row per row of `meta` (doc_id, meta_clean, meta_status): the title, why, and what it was chosen over."""
    m = "merged_text"
    signal_sum = " + ".join(f"round(s_{k}, 2)" for k in rules.WEIGHTS)
    apart = lambda c, t: f"NOT ({c}.norm <> '' AND {t}.m_norm <> '' AND (contains({c}.norm, {t}.m_norm) OR contains({t}.m_norm, {c}.norm)))"
    form = "(NOT r[1].topical OR (r[1].all_caps AND r[1].word_count <= 8))"
    margin = "(r[1].score - early[1].score)"
    sure = f"score >= {rules.HIGH_SCORE} AND margin >= {rules.HIGH_MARGIN}"
    k, tk = O.key("meta_clean"), O.key("coalesce(title, '')")
    packed = f"replace({k}, ' ', '')"
    same = f"({k} <> '' AND {tk} <> '' AND (contains({k}, {tk}) OR contains({tk}, {k})))"
    strong, usable = f"(confidence = 'high' OR score >= {rules.HIGH_SCORE})", f"(confidence IN ('high', 'medium') OR score >= {rules.MEDIUM_SCORE})"
    on_page = f"(length({k}) >= 8 AND (contains(coalesce(blob, ''), {k}) OR (length({packed}) >= 10 AND contains(replace(coalesce(blob, ''), ' ', ''), {packed}))))"
    return f"""WITH raw AS MATERIALIZED ({O.with_bare_reject(lines)}), c AS MATERIALIZED ({candidates(lines)}),
      raw_label AS ({labels('SELECT * FROM raw')}), own_label AS ({labels('SELECT * FROM c')}), spare AS ({fallbacks('SELECT * FROM c')}),
      early_keys AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY ord) AS blob FROM raw WHERE page <= 3 GROUP BY doc_id),
      g AS ({grown('SELECT * FROM c')}),
      merged_ AS (SELECT c.*, boilerplate IS NOT NULL OR fragment OR sentence AS prose, {signal_sum} AS signal_sum, merged_text, merged_score,
        {O.n_words(m)} AS m_words, {O.topical(m)} AS m_topical, {O.key(m)} AS m_norm FROM c JOIN g ON c.doc_id = g.doc_id AND c.ord = g.g_ord),
      judged AS (SELECT *, {O.author(m, 'word_count', 'm_topical')} AS m_author, {O.hit(m, rules.NAME_PREFIX)} OR {O.short_name(m, 'm_topical')} AS m_short,
        {O.boilerplate(m)} IS NOT NULL OR {O.fragment(m, 'm_words')} OR {O.sentence(m, 'm_words', 'm_topical')} AS m_prose FROM merged_),
      ranked AS (SELECT doc_id, list({_struct(_RANKED)} ORDER BY score DESC, ord) AS r FROM judged GROUP BY doc_id),
      a AS (SELECT *, list_filter(r, lambda x: x.page <= 2) AS early, list_filter(r, lambda x: x.page <= 2 AND x.topical) AS about FROM ranked),
      b AS (SELECT *, CASE WHEN len(early) > 0 AND r[1].page > 2 THEN CASE WHEN {form} AND len(about) > 0 THEN about[1] WHEN {margin} < 12 OR ({form} AND {margin} < 22) THEN early[1] ELSE r[1] END
        ELSE r[1] END AS t1 FROM a),
      d AS (SELECT *, list_filter(r, lambda x: {apart('x', 't1')} AND NOT x.author) AS others FROM b),
      e AS (SELECT *, CASE WHEN t1.m_author AND len(others) > 0 THEN others[1] ELSE t1 END AS t2, (t1.m_author AND len(others) = 0) AS no_other FROM d),
      f AS (SELECT *, no_other OR t2.m_short AS give_up, list_filter(r, lambda x: {apart('x', 't2')} AND NOT (x.prose OR x.author)) AS plain FROM e),
      h AS (SELECT *, CASE WHEN t2.m_prose AND len(plain) > 0 THEN plain[1] ELSE t2 END AS t FROM f),
      i AS (SELECT *, list_filter(r, lambda x: {apart('x', 't')}) AS rivals FROM h),
      j AS (SELECT doc_id, give_up, t, rivals, t.merged_score AS score, t.merged_score - coalesce(rivals[1].score, 0.0) AS margin FROM i),
      best AS (SELECT *, CASE WHEN {sure} AND NOT {ends_open('t.merged_text')} THEN 'high' WHEN score >= {rules.MEDIUM_SCORE} THEN 'medium' ELSE 'low' END AS confidence FROM j),
      found AS (SELECT DISTINCT doc_id FROM c),
      layout AS (SELECT found.doc_id, coalesce(o.title, w.title) AS label, coalesce(o.page, w.page) AS label_page, CASE WHEN o.title IS NOT NULL THEN o.reason ELSE w.reason END AS label_reason,
        s.title AS spare, s.page AS spare_page, best.* EXCLUDE (doc_id, confidence, score), best.confidence AS sure, best.score AS value, best.doc_id IS NOT NULL AS any_candidate,
        CASE WHEN label IS NOT NULL THEN 'label' WHEN s.title IS NOT NULL AND coalesce(give_up, true) THEN 'spare' WHEN best.doc_id IS NOT NULL THEN 'best' ELSE 'none' END AS kind
        FROM found LEFT JOIN own_label o ON found.doc_id = o.doc_id LEFT JOIN raw_label w ON found.doc_id = w.doc_id LEFT JOIN spare s ON found.doc_id = s.doc_id LEFT JOIN best ON found.doc_id = best.doc_id),
      told AS (SELECT doc_id, kind, CASE kind WHEN 'label' THEN label WHEN 'spare' THEN spare WHEN 'best' THEN t.merged_text END AS title,
        CASE kind WHEN 'label' THEN 'labeled' WHEN 'none' THEN NULL ELSE 'heuristic' END AS source, CASE kind WHEN 'label' THEN 'high' WHEN 'spare' THEN 'medium' WHEN 'best' THEN sure ELSE 'low' END AS confidence,
        CASE kind WHEN 'label' THEN 95.0 WHEN 'spare' THEN 40.0 WHEN 'best' THEN round(value, 2) ELSE 0.0 END AS score,
        CASE kind WHEN 'label' THEN label_page WHEN 'spare' THEN spare_page WHEN 'best' THEN t.page END AS page,
        CASE kind WHEN 'label' THEN label_reason WHEN 'spare' THEN {O.quoted(T.FALLBACK)} WHEN 'best' THEN {O.quoted(T.HEURISTIC)} ELSE {O.quoted(T.ALL_REJECTED)} END AS reason,
        CASE kind WHEN 'label' THEN 95.0 WHEN 'best' THEN t.signal_sum ELSE 0.0 END AS signal_sum, CASE kind WHEN 'best' THEN 1 + least(7, len(rivals)) ELSE 0 END AS n_alternatives,
        CASE kind WHEN 'best' THEN rivals[1].text END AS runner_up, CASE kind WHEN 'best' THEN round(rivals[1].score, 2) END AS runner_up_score FROM layout),
      both_ AS (SELECT x.doc_id, meta_clean, meta_status, y.* EXCLUDE (doc_id), {on_page} AS on_page FROM ({meta}) x LEFT JOIN told y ON x.doc_id = y.doc_id LEFT JOIN early_keys z ON x.doc_id = z.doc_id),
      decided AS (SELECT *, CASE WHEN meta_status <> 'ok' THEN 'layout' WHEN trim(coalesce(title, '')) = '' THEN 'metadata'
        WHEN {same} AND contains({k}, {tk}) AND length({k}) > length({tk}) + 10 AND on_page THEN 'metadata_fuller' WHEN {same} THEN 'agreed'
        WHEN source = 'labeled' AND {usable} THEN 'layout:page_title_differs' WHEN {strong} THEN CASE WHEN on_page THEN 'layout:page_title_differs' ELSE 'layout:not_on_page' END
        WHEN {usable} AND NOT on_page THEN 'layout:not_on_page' ELSE 'metadata' END AS choice FROM both_),
      named AS (SELECT *, starts_with(choice, 'metadata') AS by_meta, starts_with(choice, 'layout:') AS lost FROM decided)
      SELECT doc_id, CASE WHEN by_meta THEN meta_clean ELSE title END AS title, CASE WHEN by_meta THEN 'metadata' ELSE source END AS source,
        CASE WHEN by_meta OR choice = 'agreed' THEN 'high' ELSE coalesce(confidence, 'low') END AS confidence, CASE WHEN by_meta THEN 100.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score,
        CASE WHEN choice <> 'metadata' THEN page END::INT AS page,
        CASE WHEN choice = 'metadata' THEN {O.quoted(T.METADATA)} WHEN choice = 'metadata_fuller' THEN {O.quoted(T.FULLER)} WHEN choice = 'agreed' THEN {O.quoted(T.AGREED)}
          WHEN lost THEN coalesce(reason, {O.quoted(T.NO_LINES)}) || CASE WHEN source = 'labeled' THEN {O.quoted(T.OVER_LABEL)} WHEN choice = 'layout:not_on_page' THEN {O.quoted(T.OVER_ABSENT)} ELSE {O.quoted(T.OVER_WEAKER)} END
          ELSE coalesce(reason, {O.quoted(T.NO_LINES)}) END AS reason,
        CASE WHEN by_meta THEN 100.0 ELSE round(coalesce(signal_sum, 0.0), 2) END::DOUBLE AS signal_sum, CASE WHEN by_meta THEN 0 ELSE coalesce(n_alternatives, 0) END::INT AS n_alternatives,
        CASE WHEN NOT by_meta THEN runner_up END AS runner_up, CASE WHEN NOT by_meta THEN runner_up_score END AS runner_up_score,
        CASE WHEN lost OR choice = 'layout' THEN nullif(meta_clean, '') END AS rejected_title, CASE WHEN lost THEN substr(choice, 8) WHEN choice = 'layout' THEN meta_status END AS rejected_reason FROM named"""
