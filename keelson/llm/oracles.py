"""DuckDB SQL that gives the rows of the queries SQL can express, over whole tables."""

from __future__ import annotations


def _spans(kind: str, rank: int, pattern: str, needs: str = "true", passes: str = "true", lead: bool = False) -> str:
    """Rows (rid, rank, kind, s, e, v) of a pattern's matches in d(rid, t); with ``lead`` group 1 isn't part of the span."""
    body = f"length(regexp_extract(v, '{pattern}', 1))" if lead else "0"
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, st + {body} AS s, st + length(v) AS e, v FROM (
      SELECT rid, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st
      FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE {needs}), UNNEST(range(1, len(m) + 1)) AS u(i)) WHERE {passes}"""


_WHITE = r"\x20\x09-\x0D"
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PEM = rf"-----BEGIN (?:[A-Z]+ )??PRIVATE KEY-----[A-Za-z0-9+/={_WHITE}]{{32,}}-----END (?:[A-Z]+ )??PRIVATE KEY-----"

SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS (
  {_spans("assign", 0, _ASSIGN, passes=f"length(regexp_extract(v, '{_ASSIGN}', 2)) >= 8")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "contains(t, 'AKIA')", "length(v) >= 16")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", passes="length(v) >= 32")}
  UNION ALL {_spans("pem", 3, _PEM, "contains(t, 'PRIVATE KEY')")}
  UNION ALL {_spans("jwt", 4, r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}", "contains(t, 'eyJ')", lead=True)}
  UNION ALL {_spans("github", 5, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "contains(t, 'gh')")}
  UNION ALL {_spans("slack", 6, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "contains(t, 'xox')")}
  UNION ALL {_spans("url_login", 7, rf"(^|[^A-Za-z0-9+.-])[a-z][a-z0-9+.-]{{1,20}}://[^{_WHITE}/:@]{{1,64}}:[^{_WHITE}/:@]{{4,64}}@[A-Za-z0-9.-]+", "contains(t, '://')", lead=True)}),
by_doc AS (SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (rid)"""

_METRICS = (("mean_word_chars", "word_chars / greatest(n_words, 1)", 2.0, True), ("symbols_per_word", "n_symbols / greatest(n_words, 1)", 0.15, False), ("dup_line_share", "n_dup_lines / greatest(n_lines, 1)", 0.3, False), ("repeat_share", "n_repeat_words / greatest(n_words, 1)", 0.25, False))


def _measures() -> str:
    word = "[^\\x20\\x09-\\x0D]"
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM d),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, UNNEST(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""


def _quality() -> str:
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {x} AS x FROM f WHERE NOT base_failed" for k, x, _, _ in _METRICS)
    level = lambda keys: f"""(SELECT {keys}metric, max(n)::DOUBLE AS n, {", ".join(f"min(v) FILTER (c >= {q} * n) AS {name}" for name, q in (("q1", 0.25), ("q3", 0.75)))}
      FROM (SELECT *, sum(k) OVER (PARTITION BY {keys}metric ORDER BY bucket) AS c, sum(k) OVER (PARTITION BY {keys}metric) AS n,
        CASE WHEN bucket = -100000 THEN 0.0 ELSE 2 * pow(1.02::DOUBLE, bucket) / (1.02::DOUBLE + 1) END AS v
        FROM (SELECT {keys}metric, bucket, count(*) AS k FROM b GROUP BY ALL)) GROUP BY {keys}metric)"""  # noqa: E731
    drawn = lambda q: f"(own.n * own.{q} + 50.0::DOUBLE * ((wide.n * wide.{q} + 50.0::DOUBLE * every.{q}) / (wide.n + 50.0::DOUBLE))) / (own.n + 50.0::DOUBLE)"
    least = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, _, v, _ in _METRICS) + " END"
    high = " OR ".join(f"coalesce({x} > h['{k}'], false)" + (f" OR coalesce({x} < l['{k}'], false)" if below else "") for k, x, _, below in _METRICS)
    return f"""WITH {_measures()},
b AS (SELECT lang, source, metric, CASE WHEN x <= 0 THEN -100000 ELSE ceil(ln(x) / ln(1.02::DOUBLE))::INT END AS bucket FROM ({values})),
q AS (SELECT own.lang, own.source, metric, {drawn("q1")} AS q1, {drawn("q3")} AS q3 FROM {level("lang, source, ")} own JOIN {level("lang, ")} wide USING (metric) JOIN {level("")} every USING (metric) WHERE own.lang IS NOT DISTINCT FROM wide.lang),
fence AS (SELECT lang, source, map(list(metric), list(q1 - reach)) AS l, map(list(metric), list(q3 + reach)) AS h FROM (SELECT *, greatest(3.0::DOUBLE * (q3 - q1), {least}) AS reach FROM q) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({high}) AS kept
FROM f LEFT JOIN fence ON f.lang IS NOT DISTINCT FROM fence.lang AND f.source IS NOT DISTINCT FROM fence.source"""


_NUMBER = "('0x' || substr({}, 1, 15))::BIGINT"
_COPY = "CASE WHEN size > 0 AND start + {k} * source_size + size / 2 < target THEN 1 ELSE 0 END"
MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS m FROM documents),
h AS (SELECT *, {_NUMBER.format("md5(coalesce(doc_id::VARCHAR, '') || ':' || m)")} AS h1, {_NUMBER.format("m")} AS h2 FROM d),
s AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][turn % 3 + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source)),
r AS (SELECT *, 3 * source_size / weight AS room FROM s),
v AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER up_to, 0)::BIGINT) / (sum(weight) OVER () - coalesce(sum(weight) OVER up_to, 0)) AS level FROM r WINDOW up_to AS (ORDER BY room, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, turn, least(weight * coalesce((SELECT arg_min(level, [room, turn]) FROM v WHERE room >= level), 'inf'::DOUBLE), (3 * source_size)::DOUBLE) AS target FROM v),
p AS (SELECT h.*, source_size, turn, target, coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY h1 % 4096, h1, doc_id NULLS FIRST, h2, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, ({" + ".join(_COPY.format(k=k) for k in range(3))})::BIGINT AS copies, CASE WHEN turn % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, CASE WHEN copies > 0 THEN
  ((1 + tilt) - sqrt(greatest(0.0::DOUBLE, (1 + tilt) * (1 + tilt) - 4 * tilt * least(1.0::DOUBLE, start / target)))) / (2 * tilt) END AS first_position FROM c"""

_LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(g, length(g) - i + 1, 1)::INT ELSE 2 * substr(g, length(g) - i + 1, 1)::INT - CASE WHEN substr(g, length(g) - i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PERSONAL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  {_spans("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")}
  UNION ALL {_spans("ip", 1, "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", passes="len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0")}
  UNION ALL {_spans("card", 2, "[0-9](?:[ -]?[0-9])+")}
  UNION ALL {_spans("phone", 3, "[+][0-9][ ().0-9-]+[0-9]", passes="length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15")}),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM raw) WHERE kind <> 'card' OR CASE WHEN length(g) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END),
blanked AS (SELECT rid, array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN len(list_filter(held, lambda h: h.s < i AND i <= h.e)) > 0 THEN ' ' ELSE c END), '') AS o FROM (SELECT rid, list({{'s': s, 'e': e}}) AS held FROM hits GROUP BY rid) JOIN d USING (rid)),
o AS MATERIALIZED (SELECT d.rid, d.t AS text, coalesce(o, d.t) AS t FROM d LEFT JOIN blanked USING (rid)),
terms AS MATERIALIZED (SELECT DISTINCT rid, lower(w) AS term FROM (SELECT rid, unnest(regexp_extract_all(t, '\\p{{L}}{{3,}}')) AS w FROM o)),
members AS (SELECT kind || ':' || lower(v) AS entity, text, count(DISTINCT rid) AS n FROM hits JOIN o USING (rid) GROUP BY ALL),
sets AS (SELECT entity, sum(n) AS n_entity, list(md5(text) ORDER BY md5(text)) AS texts FROM members GROUP BY entity),
n_docs AS (SELECT count(*) AS n_docs FROM d),
within_ AS (SELECT DISTINCT text, n_entity, texts, p, n_entity * pow(p, 0.9::DOUBLE - 1) * (1 + 1e-9::DOUBLE) AS most FROM (SELECT *, n_entity / greatest(n_docs::DOUBLE, n_entity + 1.0::DOUBLE) AS p FROM members JOIN sets USING (entity), n_docs)),
n_term AS (SELECT term, count(*) AS n_term FROM terms GROUP BY term),
words AS (SELECT text, term, count(*) AS n FROM terms JOIN o USING (rid) WHERE rid IN (SELECT rid FROM hits) GROUP BY ALL),
pairs AS (SELECT term, n_term, p, texts, n_entity, sum(n) AS together, count(*) AS held FROM words JOIN n_term USING (term) JOIN within_ USING (text) WHERE n_term <= most GROUP BY ALL),
disclosing AS MATERIALIZED (SELECT DISTINCT term FROM (SELECT *, 0.5::DOUBLE * together / held AS prior FROM pairs) WHERE 1 - ln(least(1.0::DOUBLE, (together + prior * p) / (n_term + prior))) / ln(p) >= 0.9::DOUBLE),
marked AS (SELECT rid, 4 AS rank, 'term' AS kind, st AS s, st + length(v) AS e FROM (
  SELECT rid, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st
  FROM (SELECT rid, regexp_extract_all(t, '\\p{{L}}{{3,}}') AS m, string_split_regex(t, '\\p{{L}}{{3,}}') AS p FROM o WHERE rid IN (SELECT rid FROM terms SEMI JOIN disclosing USING (term))), UNNEST(range(1, len(m) + 1)) AS u(i))
  WHERE lower(v) IN (SELECT term FROM disclosing)),
spans AS (SELECT rid, rank, kind, s, e FROM hits UNION ALL FROM marked),
by_doc AS (SELECT rid, {", ".join(f"count(*) FILTER (rank = {n}) AS n_{k}" for n, k in enumerate(("email", "ip", "card", "phone")))},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_doc USING (rid)"""

ORACLES = {"op3_secret_scan": SECRETS, "op5_source_mix": MIX, "op6_pii": PERSONAL, "op9_quality_rules": _quality()}
