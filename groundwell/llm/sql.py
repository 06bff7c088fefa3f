"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from groundwell.llm import quality_rules as q
from groundwell.llm.license_scan import BLOCK_END, LOWER, UPPER, Scan, needed

WORD = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


OP1 = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines),
common AS (
  SELECT t FROM trimmed WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce(source, chr(0))) >= 5)
SELECT doc_id, count(*) AS n_lines, count(common.t) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN common.t IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM trimmed LEFT JOIN common USING (t) GROUP BY doc_id
"""

OP2 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h, doc_id::HUGEINT * 4294967296 + i AS place
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts)),
firsts AS (SELECT h, min(place) AS place FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, j
  FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM windows JOIN firsts USING (h) WHERE windows.place > firsts.place)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM texts),
left_over AS (
  SELECT doc_id, count(gone.j) AS n, string_agg(CASE WHEN gone.j IS NULL THEN word END, ' ' ORDER BY j) AS kept
  FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc_id)
"""

OP3 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size) AS ss FROM sized GROUP BY source),
weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w FROM totals),
levels AS (
  SELECT *, row_number() OVER by_need AS k,
         (1.5 * (SELECT sum(ss) FROM totals)::DOUBLE
          - 2.0 * coalesce(sum(ss) OVER (by_need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (by_need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS each
  FROM weighed WINDOW by_need AS (ORDER BY 2.0 * ss / w, source)),
level AS (SELECT arg_min(each, k) AS each FROM levels WHERE 2.0::DOUBLE * ss::DOUBLE > each * w),
goals AS (
  SELECT source, ss, least(2.0::DOUBLE * ss::DOUBLE, coalesce(each * w, 2.0::DOUBLE * ss::DOUBLE)) AS target FROM weighed, level),
parts AS (
  SELECT *, CASE WHEN ss > 0 THEN floor(target / ss::DOUBLE)::BIGINT ELSE 0 END AS whole FROM goals)
SELECT doc_id, size::BIGINT AS size, ss::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN sum(size) OVER (
          PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= target - whole * ss::DOUBLE
        THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
"""


def _op6(scan: Scan) -> str:
    templates = []
    for label, text in scan.templates:
        words = sorted(set(text.split(" ")))
        templates.append(f"({_text(label)}, {_list(words)}, {needed(len(words), scan.threshold)})")
    phrases = ", ".join(f"({_list(p.split(' '))}, {_text(label)})" for p, label in scan.phrases.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM lowered),
phrases(p, label) AS (VALUES {phrases}),
templates(label, words, need) AS (VALUES {", ".join(templates)}),
starts AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM words),
base AS (
  SELECT doc_id, i, label FROM starts, phrases WHERE list_slice(w, (i + 1)::INT, (i + len(p))::INT) = p),
based AS (
  SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
blocks AS (
  SELECT DISTINCT doc_id, list_distinct(regexp_extract_all(b, '{word}')) AS bw
  FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '{BLOCK_END}')) AS b FROM lowered)),
met AS (
  SELECT doc_id, label, len(list_intersect(words, bw)) / len(words) AS score FROM blocks, templates
  WHERE len(list_intersect(words, bw)) >= need),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN based USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _distance(ours: str, theirs: str) -> str:
    p, r = f"{ours}[i] / list_sum({ours})::DOUBLE", f"{theirs}[i] / list_sum({theirs})::DOUBLE"
    part = lambda x: f"CASE WHEN {x} > 0 THEN ({x}) * log2(({x}) / (({p} + {r}) / 2)) ELSE 0 END"
    terms = f"list_sum(list_transform(range(1, len({ours}) + 1), lambda i: {part(p)} + {part(r)}))"
    return f"CASE WHEN list_sum({ours}) > 0 AND list_sum({theirs}) > 0 THEN sqrt(greatest({terms} / 2, 0)) END"


def _sums(column: str, n: int) -> str:
    return "[" + ", ".join(f"coalesce(sum({column}[{i + 1}]), 0)" for i in range(n)) + "]"


def _op10() -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    less = lambda pattern: f"len(t) - len(regexp_replace(t, {_text(pattern + '+')}, '', 'g'))"
    listed = "CASE lang " + " ".join(f"WHEN {_text(k)} THEN {_list(v)}" for k, v in q.COMMON.items()) + " END"
    most = 1 + max(map(len, q.COMMON.values()))
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, '{WORD}') AS w, {listed} AS listed,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM texts),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words))),
repeated AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n >= 2) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
         ({less(q.SYMBOLS)})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, {less(q.UPPER)} AS up, {less(q.DIGIT)} AS num,
         {less(q.PUNCTUATION)} AS pun, len(t) AS chars, listed,
         list_filter(string_split_regex(lower(t), '{gap}'), lambda x: list_contains(listed, x)) AS found
  FROM words LEFT JOIN repeated USING (doc_id)),
bins AS (
  SELECT *, [chars - word_chars, up, num, n_symbols, pun, word_chars - n_symbols - up - num - pun] AS classes,
         CASE WHEN listed IS NOT NULL THEN list_append(
           list_transform(listed, lambda x: len(list_filter(found, lambda y: y = x))), greatest(n_words - len(found), 0)) END AS common
  FROM counted),
own AS (
  SELECT lang, {_sums("classes", 6)} AS classes, {_sums("common", most)} AS common
  FROM bins WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {q.LANGUAGE_WORDS}),
pooled AS (SELECT {_sums("classes", 6)} AS classes FROM bins),
met AS (
  SELECT b.*, coalesce(own.classes, pooled.classes) AS ref_classes, own.common AS ref_common
  FROM bins b CROSS JOIN pooled LEFT JOIN own ON b.lang = own.lang),
far AS (
  SELECT *, {_distance("classes", "ref_classes")} AS dc, {_distance("common", "ref_common")} AS dw,
         n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed
  FROM met)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {q.JUDGED_WORDS}
         AND (coalesce(dc > {q.MAX_CHARS}, false) OR coalesce(dw > {q.MAX_COMMON}, false))) AS kept
FROM far
"""


OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
hashed AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM texts),
formed AS (
  SELECT doc_id, text, n, u, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
cut AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m,
         array_to_string(u[high + 1:], '') AS s
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

ORACLE = {
    "op1_line_dedup": OP1,
    "op2_substring_dedup": OP2,
    "op3_source_mixing": OP3,
    "op6_license_scan": _op6(Scan()),
    "op10_quality_rules": _op10(),
    "op13_fill_in_middle": OP13,
}
