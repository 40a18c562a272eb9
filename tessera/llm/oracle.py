"""DuckDB SQL for the queries that SQL can express, each from its definition and not from its method."""

from __future__ import annotations

from tessera.llm import licenses, quality

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _licenses() -> str:
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({_list(sorted(set(t.split())))}, '{label}', {licenses.needed(len(set(t.split())))}, {licenses.span(t)})" for label, t in licenses.TEMPLATES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    size = licenses.BLOCK_WORDS
    return f"""
WITH d AS (SELECT doc_id, text, regexp_extract_all({LOW}, '{word}') AS w FROM documents),
phrases(p, label) AS (VALUES {phrases}),
templates(t, label, needed, span) AS (VALUES {templates}),
hits AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS place FROM d, phrases),
base AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
blocks AS (SELECT doc_id, place, v[place + 1:place + {size}] AS b FROM (SELECT *, unnest(range(0, greatest(len(v) - {size // 2} - 1, 0) + 1, {size // 2})) AS place FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS v FROM documents))),
near AS (SELECT * FROM blocks, templates WHERE len(list_intersect(b, t)) >= needed),
found AS (SELECT * FROM (SELECT doc_id, place, label, needed, list_max(list_transform(range(1, len(b) + 1), lambda i: len(list_intersect(t, b[i:i + span - 1])))) AS held, len(t) AS n FROM near) WHERE held >= needed),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(held / n) AS best, count(DISTINCT place) AS n FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::VARCHAR[]), coalesce(more.labels, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score, coalesce(more.n, 0) AS n_blocks
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    n, m = f"list_sum({p})", f"list_sum({q})"
    a, b = f"({p}[i] / {n})", f"({q}[i] / {m})"
    term = f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN {b} * log2(2 * {b} / ({a} + {b})) ELSE 0 END)"
    return f"CASE WHEN {n} > 0 AND {m} > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term})) / 2)) END"


def _quality() -> str:
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in quality.COMMON_WORDS.items()) + " ELSE []::VARCHAR[] END"
    classes = [r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[.,;:!?''\"()\-]", "[#*$%&|<>]"]
    counts = ", ".join(f"len(regexp_extract_all(t, '{c}'))" for c in classes)
    size = quality.WINDOW
    width = 1 + max(map(len, quality.COMMON_WORDS.values()))
    class_sums = ", ".join(f"sum(cc[{i}])" for i in range(1, len(classes) + 2))
    word_sums = ", ".join(f"sum(wc[{i}])" for i in range(1, width + 1))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, {common} AS common FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - {size - 2})) AS i, unnest(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) AS g FROM d WHERE len(w) > {size})),
covered AS (SELECT doc_id, sum(least({size}, coalesce(next - i, {size}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM g WHERE n > 1) GROUP BY doc_id),
h AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, list_transform(list_concat([{counts}], [length(t) - list_sum([{counts}])]), lambda x: x::DOUBLE) AS cc, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS found FROM d LEFT JOIN covered USING (doc_id)),
k AS (SELECT *, list_transform(list_concat(found, [n_words - coalesce(list_sum(found), 0)]), lambda x: x::DOUBLE) AS wc FROM h),
r AS (SELECT lang, [{class_sums}] AS cr, list_filter([{word_sums}], lambda x: x IS NOT NULL) AS wr FROM k GROUP BY lang),
j AS (SELECT k.*, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {_distance('cc', 'cr')} AS cd, {_distance('wc', 'wr')} AS wd FROM k JOIN r ON k.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, CAST(cc[5] AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((n_words >= {quality.MIN_WORDS_CLASSES} AND cd > {quality.MAX_CLASSES}) OR (n_words >= {quality.MIN_WORDS_COMMON} AND wd > {quality.MAX_COMMON}), FALSE) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS common_distance FROM j"""


_ESCAPED = "(length({0}) + (length({0}) - length(replace({0}, '\\', ''))) + 3 * (length({0}) - length(translate({0}, '<[|', ''))))"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(11 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

ITQ = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.c),
roots AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN roots USING (vec_id) LEFT JOIN degree USING (vec_id)"""

ORACLE_SQL = {"op2_licenses": _licenses(), "op4_ngram_join": NGRAM_JOIN, "op7_quality": _quality(), "op8_chat": CHAT, "op9_itq": ITQ}
