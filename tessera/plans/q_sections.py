"""Sections and lines over messages, each given headings, links or bullets around its whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sections as S
from tessera.functions import text as X
from tessera.operators.probes import synthesized
from tessera.plans.registry import query
from tessera.plans.views import view, with_views

_M = with_views("messages")
_HEADED = "'Intro' || chr(10) || '* Requirements:' || chr(10) || content || chr(10) || 'About us' || chr(10) || content || chr(10) || '## Responsibilities: ' || role || chr(10) || content || chr(10) || 'tasks' || chr(10) || content"
_ANSWER = "CASE WHEN ts % 3 = 0 THEN 'Reasoning:' || chr(10) || content || chr(10) || 'CONCLUSION' || chr(10) || role || chr(10) || 'Final response::' || chr(10) || content || chr(10) || 'reasoning' || chr(10) || role WHEN ts % 3 = 1 THEN content || ' [' || role || '](https://Docs.example.org/' || role || ') and [x](http://b.example)' || chr(10) || 'sources :' || chr(10) || 'none' ELSE content END"
TERMS = ("schein", "ouelle", "there", "ación")


def _kind(test: str, name: str) -> str:
    pattern = "(?i)^(?:" + "|".join(S.KINDS[name]).replace("'", "''") + r")\s*:?\s*(.*)$"
    return f"regexp_extract(head, '{pattern}', 1)" if test == "inline" else f"regexp_matches(head, '{pattern}')"


def messages(spark, sf_dir):
    return view(spark, sf_dir, "messages")


@query("X10_headed_sections", f"""{_M}, parts AS (SELECT id, unnest(string_split({_HEADED}, chr(10))) AS line, generate_subscripts(string_split({_HEADED}, chr(10)), 1) AS n FROM messages),
heads AS (SELECT *, trim(regexp_replace(trim(trim(regexp_replace(line, '{S.SIGNS}', '')), '{S.BRACKETS}'), '\\s+', ' ', 'g')) AS head FROM parts),
kinds AS (SELECT *, CASE WHEN {_kind('', 'candidate_expectations')} THEN 'candidate_expectations' WHEN {_kind('', 'responsibilities')} THEN 'responsibilities' WHEN regexp_matches(trim(line), '(?i)^(?:{'|'.join(S.OTHER)})\\s*:?\\s*$') THEN '' END AS mark,
  CASE WHEN {_kind('', 'candidate_expectations')} THEN {_kind('inline', 'candidate_expectations')} WHEN {_kind('', 'responsibilities')} THEN {_kind('inline', 'responsibilities')} END AS inside FROM heads),
filled AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS kind FROM kinds),
raws AS (SELECT id, n, kind, CASE WHEN inside IS NOT NULL THEN inside WHEN mark = '' THEN '' ELSE line END AS raw FROM filled WHERE kind <> ''),
clean AS (SELECT id, n, kind, trim(substring(trim(regexp_replace(regexp_replace(regexp_replace(raw, '{S.SIGNS}', ''), '^\\s*\\d+[.)]\\s+', ''), '\\s+', ' ', 'g')), 1, 540)) AS w FROM raws),
cut AS (SELECT id, n, kind, CASE WHEN length(w) <= 180 THEN w WHEN contains(substring(w, 1, 180), ' ') THEN trim(regexp_replace(substring(w, 1, 180), ' [^ ]*$', '')) ELSE substring(w, 1, 180) END AS item FROM clean),
firsts AS (SELECT id, kind, min(n) AS n, arg_min(item, n) AS item FROM cut WHERE item <> '' GROUP BY id, kind, lower(item)),
kept AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY n) <= 6)
SELECT m.id, md5(coalesce((SELECT string_agg(item, chr(10) ORDER BY n) FROM kept WHERE kept.id = m.id AND kind = 'candidate_expectations'), '')) AS expectations,
md5(coalesce((SELECT string_agg(item, chr(10) ORDER BY n) FROM kept WHERE kept.id = m.id AND kind = 'responsibilities'), '')) AS responsibilities FROM messages m""")
def x10(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("s", S.headed_sections(F.expr(_HEADED)))
    return m.select("id", F.md5(F.array_join("s.candidate_expectations", "\n")).alias("expectations"), F.md5(F.array_join("s.responsibilities", "\n")).alias("responsibilities"))


@query("X38_response_sections", f"""{_M}, t AS (SELECT id, ts, role, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l: rtrim(l)), lambda l: trim(l) <> ''), chr(10)) AS own, content FROM messages)
SELECT id, md5(CASE ts % 3 WHEN 0 THEN trim(own) || CASE WHEN trim(own) = '' THEN '' ELSE chr(10) END || role WHEN 1 THEN 'Leyendo estas fuentes y extrayendo lo relevante:' || chr(10) || '- ' || role || ' (docs.example.org)' || chr(10) || '- x (b.example)' ELSE '' END) AS reasoning,
CASE ts % 3 WHEN 0 THEN role ELSE '' END AS conclusion, md5(CASE ts % 3 WHEN 0 THEN trim(own) WHEN 1 THEN trim(content || ' [' || role || '](https://Docs.example.org/' || role || ') and [x](http://b.example)', chr(10) || ' ') ELSE trim(content, chr(10) || ' ') END) AS final FROM t""")
def x38(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("s", S.response_sections(F.expr(_ANSWER)))
    return m.select("id", F.md5("s.reasoning").alias("reasoning"), "s.conclusion", F.md5("s.final").alias("final"))


_LINES = f"""{_M}, parts AS (SELECT id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM messages),
own AS (SELECT id, n, trim(raw) AS l, lower(trim(raw)) AS low, translate(lower(trim(raw)), '{X.MARKED}', '{X.PLAIN}') AS plain FROM parts WHERE trim(raw) <> '')
"""


@query("F17_content_lines", f"""{_LINES}, tested AS (SELECT *, NOT (contains(low, 'http') OR contains(low, 'sources') OR low LIKE 'url:%') AND regexp_matches(l, '{S.LETTER}') AS follows FROM own),
judged AS (SELECT *, follows AND low NOT LIKE 'web search results for query%' AND length(l) >= 3 AND NOT regexp_matches(l, '^\\*\\*.+\\*\\*$') AND NOT regexp_matches(l, '{S.HEADING}') AND NOT regexp_matches(low, '{S.META}')
  AND NOT (regexp_matches(low, '^(?:esta|este|esto|esa|ese|eso|dicha|dicho|tal)\\s+[\\p{{L}}\\p{{N}}_]+') AND regexp_extract(low, '^(?:esta|este|esto|esa|ese|eso|dicha|dicho|tal)\\s+([\\p{{L}}\\p{{N}}_]+)', 1) NOT IN {S.TIMES}) AS ok,
  contains(plain, 'schein') OR contains(plain, 'ouelle') OR contains(plain, 'there') OR contains(plain, 'acion') AS hit, regexp_matches(l, '{S.SCORE}') AS score,
  lead(l, 1) OVER w AS l1, lead(l, 2) OVER w AS l2, lead(follows, 1) OVER w AS f1, lead(follows, 2) OVER w AS f2 FROM tested WINDOW w AS (PARTITION BY id ORDER BY n)),
numbered AS (SELECT *, count(*) FILTER (ok AND NOT hit AND score) OVER (PARTITION BY id ORDER BY n) AS s FROM judged),
said AS (SELECT id, n, CASE WHEN NOT hit THEN [l] WHEN coalesce(f1, false) AND coalesce(f2, false) THEN [l, l1, l2] WHEN coalesce(f1, false) THEN [l, l1] ELSE [l] END AS run FROM numbered WHERE ok AND (hit OR (score AND s = 1)))
SELECT m.id, md5(coalesce(string_agg(array_to_string(run, chr(10)), chr(10) ORDER BY n), '')) AS content FROM messages m LEFT JOIN said ON said.id = m.id GROUP BY m.id""")
def f17(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.md5(F.array_join(S.content_lines(F.col("content"), TERMS), "\n")).alias("content"))


@query("F33_section_lines", f"""{_LINES}, shown AS (SELECT id, n, plain, trim(regexp_replace(regexp_replace(l, '^\\s*(?:[-*•]\\s+|\\d+\\.\\s+)', ''), '\\s+', ' ', 'g')) AS c FROM own),
news AS (SELECT * FROM shown WHERE NOT (plain LIKE 'url:%' OR plain LIKE 'sources:%' OR plain LIKE 'http%' OR contains(plain, '<<<cite_this:') OR plain LIKE 'error al procesar la pagina web%') AND length(c) >= 12 AND regexp_matches(c, '[A-Za-zÁÉÍÓÚÑáéíóúñ]')
  AND (regexp_matches(c, '^["“].+["”]') OR regexp_matches(plain, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(S.STEMS)})') OR contains(c, '"') OR contains(c, ':'))),
firsts AS (SELECT id, min(n) AS n, arg_min(c, n) AS c FROM news GROUP BY id, translate(lower(c), '{X.MARKED}', '{X.PLAIN}'))
SELECT id, string_agg(c, chr(10) ORDER BY n) AS lines FROM firsts GROUP BY id""")
def f33(spark, sf_dir):
    found = S.section_lines(F.col("content"))
    return messages(spark, sf_dir).select("id", F.array_join(found, "\n").alias("lines")).where("lines <> ''")


_PROBES = f"""{_M}, p AS (SELECT session_id AS q, id, CASE WHEN ts % 4 = 1 THEN role || ' ' || CAST(ts AS VARCHAR) || ' - ' || CAST(session_id % 3 AS VARCHAR) || ' end' || chr(10) || content WHEN ts % 4 = 2 THEN role ELSE content END AS r,
  CASE ts % 3 WHEN 0 THEN 'search_direct_' WHEN 1 THEN 'search_refined_' ELSE '' END || role AS s, CASE WHEN ts % 3 <> 2 THEN 'https://' || role || '.example/' || CAST(ts % 2 AS VARCHAR) END AS u FROM messages),
w AS (SELECT *, len(list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '')) AS n, trim(r, chr(10) || ' ') AS t FROM p),
scored AS (SELECT *, CASE WHEN t = '' THEN -100 ELSE {' + '.join(f"CASE WHEN contains(lower(r), '{x}') THEN 1 ELSE 0 END" for x in ('respuesta', 'verificable', 'evidencia', 'fuente', 'dato', 'hecho', 'confirmado'))}
  - CASE WHEN contains(lower(r), 'no pude') OR contains(lower(r), 'sin dato') OR contains(lower(r), 'no encontré') OR contains(lower(r), 'no logré') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(r, '\\b\\d+\\s*-\\s*\\d+\\b') THEN 8 ELSE 0 END
  + CASE WHEN contains(lower(r), replace(s, '_', ' ')) THEN 2 ELSE 0 END + CASE WHEN s LIKE 'search_direct%' THEN 2 WHEN s LIKE 'search_refined%' THEN 1 ELSE 0 END - CASE WHEN n < 8 THEN 2 WHEN n > 80 THEN 1 ELSE 0 END END AS score FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, length(r) DESC, id) AS k FROM scored),
lines AS (SELECT q, k, unnest(string_split(r, chr(10))) AS line, generate_subscripts(string_split(r, chr(10)), 1) AS i FROM ranked),
firsts AS (SELECT q, l, min((k, i)) AS o FROM (SELECT q, k, i, regexp_replace(trim(line), '\\s+', ' ', 'g') AS l FROM lines) WHERE regexp_matches(l, '\\b.+?\\b\\d+\\s*-\\s*\\d+\\b.+') GROUP BY q, l),
said AS (SELECT q, string_agg(chr(10) || '- ' || l, '' ORDER BY o) AS ls FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o) AS j FROM firsts) WHERE j <= 4 GROUP BY q),
links AS (SELECT q, string_agg('- [' || s || '](' || u || ')', chr(10) ORDER BY k) AS us FROM (SELECT q, u, min(k) AS k, arg_min(s, k) AS s FROM ranked WHERE u IS NOT NULL GROUP BY q, u) GROUP BY q)
"""


@query("J10_synthesized", f"""{_PROBES}, a AS (SELECT b.q, b.s, b.score, coalesce('Fuente más confiable: ' || b.s || ls, nullif(b.t, ''), 'No pude obtener resultados claros para esta consulta.') || coalesce(chr(10) || chr(10) || 'Sources:' || chr(10) || us, '') AS answer, c.t AS t2, c.s AS s2
  FROM ranked b LEFT JOIN ranked c ON c.q = b.q AND c.k = 2 LEFT JOIN said ON said.q = b.q LEFT JOIN links ON links.q = b.q WHERE b.k = 1)
SELECT q AS session_id, s AS best_source, score, md5(answer || CASE WHEN len(list_filter(string_split_regex(answer, '\\s+'), lambda x: x <> '')) <= 12 AND t2 <> '' AND t2 <> answer THEN chr(10) || chr(10) || 'Respaldo de ' || s2 || ': ' || t2 ELSE '' END) AS answer FROM a""")
def j10(spark, sf_dir):
    ts = F.col("ts")
    shown = F.concat("role", F.lit(" "), ts.cast("string"), F.lit(" - "), (F.col("session_id") % 3).cast("string"), F.lit(" end\n"), "content")
    m = messages(spark, sf_dir).withColumn("response", F.when(ts % 4 == 1, shown).when(ts % 4 == 2, F.col("role")).otherwise(F.col("content")))
    m = m.withColumn("source", F.concat(F.when(ts % 3 == 0, "search_direct_").when(ts % 3 == 1, "search_refined_").otherwise(""), "role"))
    m = m.withColumn("urls", F.when(ts % 3 != 2, F.array(F.concat(F.lit("https://"), "role", F.lit(".example/"), (ts % 2).cast("string")))))
    return synthesized(m, "session_id", "id", "response", "source", "urls").select("session_id", "best_source", "score", F.md5("answer").alias("answer"))
