"""DuckDB SQL for the queries of this package that SQL can express.

Queries without an entry (approximate neighbours, packing, leakage, varied subset) are tested
against brute force, round trips and bounds in ``tests/llm``.
"""

from __future__ import annotations

from vecloom.llm import lookalike, truncation

_P3 = """
WITH recs AS (SELECT id, max(term_ids) AS term_ids FROM terms WHERE id IS NOT NULL GROUP BY id),
occ AS (SELECT id, unnest(term_ids) AS term FROM recs),
freq AS (SELECT term, count(DISTINCT id) AS docs, count(*) AS occurrences FROM occ WHERE term IS NOT NULL GROUP BY term),
entries AS (SELECT word_id, min(word) AS word FROM word_list WHERE word_id IS NOT NULL GROUP BY word_id),
marked AS (
  SELECT term AS word_id, e.word, docs, occurrences,
         CASE WHEN docs <= 2 THEN 'rare' WHEN docs > 0.1 * (SELECT count(*) FROM recs) THEN 'common' END AS mark,
         e.word_id IS NOT NULL AS known
  FROM freq LEFT JOIN entries e ON e.word_id = term)
"""

_KEY = r"""array_to_string(list_sort(list_filter(list_transform(string_split_regex(lower({0}), '[ \t\n\x0B\f\r]+'),
  lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '')), ' ')"""

_P5 = rf"""
WITH keyed AS (
  SELECT 'terms' AS tab, id, array_to_string(list_sort(list_filter(term_ids, lambda x: x IS NOT NULL)), ',') AS k FROM terms
  UNION ALL
  SELECT 'element_lines', line_id, {_KEY.format("string_split(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$'), ':')[-1]")} FROM element_lines
  UNION ALL
  SELECT 'word_list', word_id, {_KEY.format("word")} FROM word_list),
ids AS (SELECT DISTINCT tab, CAST(id AS BIGINT) AS id, k FROM keyed WHERE id IS NOT NULL AND k <> ''),
kept AS (SELECT tab, id, min(id) OVER (PARTITION BY tab, k) AS kept_id, count(*) OVER (PARTITION BY tab, k) AS n FROM ids)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _look(column: str) -> str:
    singles, many = lookalike.mapping()
    out = column
    for sign, form in many.items():
        out = f"replace({out}, {_quoted(sign)}, {_quoted(form)})"
    source, target = "".join(singles) + lookalike.INVISIBLE, "".join(singles.values())
    return f"nfc_normalize(trim(translate({out}, {_quoted(source)}, {_quoted(target)}), ' '))"


def _p4() -> str:
    return f"""
WITH looks AS (SELECT DISTINCT word_id, word, {_look("word")} AS look FROM word_list WHERE word IS NOT NULL AND word_id IS NOT NULL)
"""


_UNIT = """
WITH raw AS (
  SELECT 'vectors_f32' AS tab, id, max(vec)::DOUBLE[] AS v FROM vectors_f32 WHERE vec IS NOT NULL AND id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'dict', CAST(word_id AS BIGINT), max(vec)::DOUBLE[] FROM dict WHERE vec IS NOT NULL AND word_id IS NOT NULL GROUP BY word_id),
normed AS (SELECT tab, id, v, sqrt(list_dot_product(v, v)) AS n FROM raw),
u AS (SELECT tab, id, list_transform(v, lambda x: x / n) AS v FROM normed WHERE n > 0)
"""

_P2 = _UNIT + """,
near AS (SELECT a.tab, a.id, b.id AS other, 1 - list_dot_product(a.v, b.v) AS d FROM u a JOIN u b ON a.tab = b.tab AND a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.997),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tab, id ORDER BY d, other) AS r FROM near)
SELECT DISTINCT tab, least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE r <= 10
"""

_P1 = """
WITH counts AS (
  SELECT 'vectors_f32' AS tab, count(*) AS n, count(DISTINCT id) AS most FROM vectors_f32 WHERE len(vec) > 0 AND id IS NOT NULL
  UNION ALL SELECT 'dict', count(*), count(DISTINCT word_id) FROM dict WHERE len(vec) > 0 AND word_id IS NOT NULL)
SELECT tab, least(greatest(64, CAST(floor(n * 0.01) AS BIGINT)), most) AS ids, least(greatest(64, CAST(floor(n * 0.01) AS BIGINT)), most) AS different FROM counts
"""

_P2_COUNTS = _UNIT + "SELECT tab, count(*) AS ids, 10 * count(*) AS neighbours, 0::BIGINT AS wrong FROM u GROUP BY tab"

_PLAIN = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+'), lambda w: w <> '')"
_P8 = rf"""
WITH docs AS (SELECT DISTINCT doc_id, ' ' || array_to_string({_PLAIN.format("text")}, ' ') || ' ' AS doc FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
words AS (SELECT item_id, {_PLAIN.format("passage")} AS ws FROM eval_items WHERE passage IS NOT NULL),
runs AS (SELECT DISTINCT item_id, ' ' || array_to_string(ws[i : i + 19], ' ') || ' ' AS run FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 19, 1) + 1)) AS i FROM words))
SELECT DISTINCT doc_id, item_id FROM docs JOIN runs ON contains(doc, run)
"""

# a group: ids whose neighbours within the limit (themselves included) are the same ids
_P6_GROUPS = _UNIT + """,
near AS (SELECT a.tab, a.id, b.id AS other FROM u a JOIN u b ON a.tab = b.tab WHERE list_dot_product(a.v, b.v) >= 0.85),
ball AS (SELECT tab, id, min(other) AS lead_id, count(*) AS n, list(other ORDER BY other) AS members FROM near GROUP BY tab, id),
grp AS (SELECT tab, lead_id, members, count(*) AS k FROM ball WHERE n >= 8 GROUP BY tab, lead_id, members HAVING count(*) = len(members))
"""
_P6 = _P6_GROUPS + """
SELECT b.tab, b.lead_id, b.id FROM ball b JOIN grp g ON g.tab = b.tab AND g.members = b.members WHERE b.id <> b.lead_id
"""


def _p9() -> str:
    cut, closing = _quoted(truncation.CUT_MARK), _quoted(truncation.CLOSING)
    end = f"regexp_replace(regexp_replace(regexp_replace(text, {cut}, ''), {closing}, ''), {cut}, '')"
    return f"""
WITH docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, max(source) AS source, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
ends AS (SELECT *, length(text) AS chars, strlen(text) AS bytes, {end} AS fin, coalesce(regexp_matches(text, {_quoted("^" + truncation._S + "*$")}), true) AS blank FROM docs),
read AS (SELECT *, regexp_matches(fin, {_quoted(truncation.TERMINAL)}) AND NOT regexp_matches(fin, {_quoted(truncation.ABBREVIATION)}) AS closed,
  fin = '' OR regexp_matches(fin, {_quoted(truncation.HEADING)}) AS heading FROM ends),
lens AS (SELECT source, 'c' AS unit, chars AS len FROM read WHERE NOT blank UNION ALL SELECT source, 'b', bytes FROM read WHERE NOT blank),
hist AS (SELECT source, unit, len, count(*) AS n FROM lens GROUP BY ALL),
tops AS (SELECT source, unit, max(len) AS len, arg_max(n, len) AS n, sum(n) AS total FROM hist GROUP BY source, unit),
spikes AS (SELECT * FROM tops WHERE n >= {truncation.SPIKE_VALUES} AND n >= {truncation.SPIKE_SHARE} * total),
flags AS (SELECT doc_id, source, coalesce(chars = c, false) OR coalesce(bytes = b, false) AS at_limit, NOT blank AND NOT closed AND (coalesce(chars = c, false) OR coalesce(bytes = b, false) OR NOT heading) AS truncated
  FROM (SELECT r.*, (SELECT max(len) FROM spikes s WHERE s.source IS NOT DISTINCT FROM r.source AND unit = 'c') AS c, (SELECT max(len) FROM spikes s WHERE s.source IS NOT DISTINCT FROM r.source AND unit = 'b') AS b FROM read r))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_sizes": _P1,
        "p2_counts": _P2_COUNTS,
        "p6_sizes": _P6_GROUPS + "SELECT tab, lead_id, k AS size FROM grp",
        "p7_coverage": "SELECT count(DISTINCT doc_id) AS docs, 0::BIGINT AS torn, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM documents WHERE doc_id IS NOT NULL",
        "p8_verbatim": _P8,
        "p2_found": _P2,
        "p3_found": _P3 + "SELECT word_id, mark FROM marked WHERE known AND mark IS NOT NULL",
        "p3_frequencies": _P3 + "SELECT word_id, word, docs, occurrences, mark FROM marked",
        "p4_found": _p4() + "SELECT DISTINCT a.word_id AS word_id_a, b.word_id AS word_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.word <> b.word AND a.word_id < b.word_id",
        "p4_forms": _p4() + "SELECT word_id, word, min(word) OVER (PARTITION BY look) AS canonical FROM looks",
        "p5_found": _P5 + "SELECT tab, kept_id, id AS copy_id FROM kept WHERE id <> kept_id",
        "p5_kept": _P5 + "SELECT tab, kept_id, n - 1 AS copies FROM kept WHERE id = kept_id",
        "p6_found": _P6,
        "p9_found": _p9() + "SELECT doc_id FROM flags WHERE truncated",
        "p9_signals": _p9() + "SELECT CASE WHEN at_limit THEN 'limit' ELSE 'ending' END AS signal, count(*) AS docs FROM flags WHERE truncated GROUP BY 1",
        "p9_sources": _p9()
        + """SELECT source, count(*) AS docs, CAST(sum(truncated::INT) AS BIGINT) AS truncated, CAST(sum((truncated AND at_limit)::INT) AS BIGINT) AS at_limit,
        round(avg(truncated::INT::DOUBLE), 6) AS share FROM flags GROUP BY source""",
    }
