"""SQL twins of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from qaflow.llm.phrases import PhraseConfig
from qaflow.llm.quality import QualityRules

_GAP = r"[\x20\x09-\x0D]+"


def _quality(rules: QualityRules = QualityRules()) -> str:
    values = {
        "word_len": "100 * word_chars // greatest(n_words, 1)",
        "symbols": "1000 * n_symbols // greatest(n_words, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
    }
    names = ", ".join(f"'{k}'" for k in values)
    cells = ", ".join(values.values())
    least = " ".join(f"WHEN '{k}' THEN {n}" for k, n, _ in rules.metrics)
    low = ", ".join(f"'{k}'" for k, _, lower in rules.metrics if lower)
    tails = ", ".join(f"'{k}'" for k in rules.tails)
    quartiles = lambda name, keys: f"""{name} AS (SELECT {keys}, sum(n) AS total,
  min(bin) FILTER (cum * 4 >= total_n) AS q1, min(bin) FILTER (cum * 4 >= total_n * 3) AS q3,
  min(bin + (1 << greatest(length(bin(bin)) - 5, 0)) - 1) FILTER (cum * 1000 >= total_n * {rules.tail}) AS top
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {keys}) AS total_n
    FROM (SELECT {keys}, bin, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys})"""  # noqa: E731
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS lang_key, coalesce('=' || source, 'null') AS source_key, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, t, list_filter(regexp_split_to_array(t, '{_GAP}'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS win FROM w, unnest(range(1, len(words) - 3)) u(i)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1),
m AS (SELECT d.rid, doc_id, lang_key, source_key, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM d JOIN w USING (rid) LEFT JOIN repeats r USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
long AS (SELECT rid, lang_key, source_key, base_failed, n_words, unnest([{names}]) AS metric, unnest([{cells}]) AS v FROM judged),
sketch AS (SELECT lang_key, source_key, metric, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS bin, count(*) AS n FROM long WHERE NOT base_failed GROUP BY ALL),
{quartiles("own", "lang_key, source_key, metric")},
{quartiles("by_lang", "lang_key, metric")},
{quartiles("every", "metric")},
picked AS (SELECT o.lang_key, o.source_key, o.metric, CASE WHEN o.total >= {rules.min_docs} THEN o.q1 WHEN l.total >= {rules.min_docs} THEN l.q1 ELSE e.q1 END AS q1,
  CASE WHEN o.total >= {rules.min_docs} THEN o.q3 WHEN l.total >= {rules.min_docs} THEN l.q3 ELSE e.q3 END AS q3,
  CASE WHEN l.total >= {rules.min_docs} THEN l.top ELSE e.top END AS top
  FROM own o JOIN by_lang l ON l.lang_key = o.lang_key AND l.metric = o.metric JOIN every e ON e.metric = o.metric),
spread AS (SELECT *, greatest(greatest(q3 - q1, CASE metric {least} END) * {rules.reach}, CASE WHEN metric IN ({tails}) THEN top - q3 ELSE 0 END) AS spread FROM picked),
bad AS (SELECT DISTINCT rid FROM long JOIN spread USING (lang_key, source_key, metric)
  WHERE (v - q3) * n_words > spread * (n_words + {rules.short_words}) OR metric IN ({low}) AND (q1 - v) * n_words > spread * (n_words + {rules.short_words}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM judged"""


_UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296::DOUBLE"

_MIXING = f"""WITH sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5::DOUBLE) AS w FROM documents GROUP BY 1),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) * w / (SELECT sum(w) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT source, greatest(ceil(rate / 8), 1)::INT AS parts, rate / greatest(ceil(rate / 8), 1) AS mean FROM rates),
steps AS (SELECT source, k, sum(exp(-mean) * pow(mean, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS step FROM parts, range(48) r(k)),
draws AS (SELECT doc_id, d.source, {_UNIT.format("concat_ws(':', doc_id, '29', part)")} AS u FROM documents d JOIN parts p ON p.source = d.source, unnest(range(1, parts + 1)) r(part)),
counts AS (SELECT doc_id, count(*) AS copies FROM draws x JOIN steps s ON s.source = x.source AND s.step <= x.u GROUP BY doc_id)
SELECT d.*, copy_no, {_UNIT.format("concat_ws(':', d.doc_id, 'order', '29', copy_no)")} AS mix_order
FROM documents d JOIN counts c ON c.doc_id = d.doc_id, unnest(range(1, c.copies + 1)) r(copy_no)"""

_WARC = r"""WITH c AS (SELECT page_id AS p, url, coalesce(html, '') AS html, 'front ' || (page_id // 70) AS front FROM pages),
r AS (SELECT p * 8 AS record_id, url, p AS ts, html AS body FROM c
  UNION ALL SELECT p * 8 + 1, url, p + 400, html || 'changed' FROM c WHERE p % 4 = 2
  UNION ALL SELECT p * 8 + 2, 'https://WWW.front.example.org:443/?utm_source=x#top', p, front FROM c WHERE p % 7 = 0),
v AS (SELECT p * 8 + 3 AS record_id, url, p + 1 + (p * 7919) % 1000 AS ts, CASE WHEN p % 3 <> 0 THEN CASE WHEN p % 5 = 0 THEN 'W/' ELSE '' END || '"' || md5(html) || '"' END AS etag, 'day ' || length(html) AS day FROM c
  UNION ALL SELECT p * 8 + 4, url, p + 500, NULL, NULL FROM c WHERE p % 5 = 1
  UNION ALL SELECT p * 8 + 5, url, p - 3, '"' || md5(html) || '"', NULL FROM c WHERE p % 6 = 0
  UNION ALL SELECT p * 8, url, p, '"' || md5(html) || '"', NULL FROM c WHERE p % 9 = 0
  UNION ALL SELECT p * 8 + 6, 'http://front.example.org', p, '"' || md5(front) || '"', NULL FROM c WHERE p % 7 = 3
  UNION ALL SELECT p * 8 + 7, NULL, p, '"' || md5(html) || '"', NULL FROM c WHERE p % 50 = 0),
bare AS (SELECT DISTINCT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM (SELECT url FROM r UNION ALL SELECT url FROM v) WHERE url IS NOT NULL),
keyed AS (SELECT url, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[.]', '')
    || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]*|gclid|fbclid|ref)(=|$)'))) AS args FROM bare),
urls AS (SELECT url, path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key FROM keyed),
rk AS (SELECT r.*, url_key, '"' || md5(body) || '"' AS tag, 'day ' || length(body) AS day, sha256(body) AS digest, ts::HUGEINT * 1000000000000 + record_id AS at FROM r JOIN urls USING (url)),
vk AS (SELECT v.*, url_key, row_number() OVER () AS n, ts::HUGEINT * 1000000000000 + record_id AS at FROM v LEFT JOIN urls USING (url)),
matched AS (SELECT v.record_id, v.url_key, v.ts, r.record_id AS response_id, r.tag, r.digest, r.ts AS response_ts,
  CASE WHEN r.record_id IS NULL THEN 'no_response' WHEN v.etag IS NULL AND v.day IS NULL THEN 'unverified' WHEN v.etag IS NOT NULL AND regexp_replace(v.etag, '^W/', '') = r.tag THEN 'resolved'
    WHEN v.etag IS NULL AND v.day = r.day THEN 'resolved' ELSE 'mismatch' END AS status
  FROM vk v ASOF LEFT JOIN rk r ON r.url_key = v.url_key AND r.at < v.at)
SELECT record_id, url_key, ts, response_id, status, CASE WHEN status IN ('resolved', 'unverified') THEN digest END AS payload_digest,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'Cache-Control: max-age=60' || chr(10) || 'Content-Type: text/html' || chr(10) || 'ETag: ' || tag || chr(10) || 'date: ' || ts END AS headers
FROM matched"""

_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
marked AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM d JOIN firsts USING (t) LEFT JOIN marked USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY ALL),
letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
  JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (SELECT o, s, 1 << (ascii(o[s]) - 65) AS bit, list_sum(list_transform(range(1, s), lambda k: 1 << (ascii(o[k]) - 65))) AS earlier FROM orders, unnest(range(1, 6)) u(s)),
found AS (SELECT part, o AS filter_order, s::INT AS step, bit, sum(n) FILTER (mask & (bit | coalesce(earlier, 0)::INT) = 0) AS kept,
  sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT > 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(g) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0) AS good_lost,
  sum(x) FILTER (mask & bit > 0 AND mask & coalesce(earlier, 0)::INT = 0) AS toxic_lost FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM found"""


def _phrases(c: PhraseConfig = PhraseConfig()) -> str:
    return rf"""WITH stretches AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM stretches GROUP BY 1),
f AS (SELECT lang, n, array_to_string(w[i:i + n - 1], ' ') AS phrase, count(*) AS a FROM stretches, unnest(range(1, {c.max_n + 1})) k(n), unnest(range(1, len(w) - n + 2)) u(i)
  GROUP BY ALL HAVING count(*) >= {c.least}),
cuts AS (SELECT lang, n, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM f, unnest(range(1, n)) u(k) WHERE n > 1),
scored AS (SELECT c.*, x.a AS l, y.a AS r, ({2 * c.unit}::HUGEINT * c.a) // (x.a + y.a) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT DISTINCT p.lang, p.phrase FROM best p JOIN best q ON q.lang = p.lang AND q.n > p.n AND 100 * q.a >= {c.absorbed} * p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN held USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, sizes.n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {c.top}"""


ORACLE_SQL: dict[str, str] = {"op6_quality": _quality(), "op7_mixing": _MIXING, "op9_warc": _WARC, "op12_audit": _AUDIT, "op13_phrases": _phrases()}
