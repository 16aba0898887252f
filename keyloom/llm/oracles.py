"""SQL of the operators that SQL can express."""

#: Temperature mixing with a repetition limit of 2, covering the corpus. The exponent is bisected in a recursive query.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents
), t AS (SELECT s, sum(tokens)::BIGINT AS tokens FROM d GROUP BY s),
p AS (SELECT s, tokens, tokens::DOUBLE / greatest(1, (SELECT sum(tokens) FROM t))::DOUBLE AS share FROM t),
f AS (SELECT max(share) AS most, min(share) AS least FROM p WHERE tokens > 0),
b(n, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT n + 1, CASE WHEN pow(most / least, 1 - (low + high) / 2) > 2.0 THEN (low + high) / 2 ELSE low END,
    CASE WHEN pow(most / least, 1 - (low + high) / 2) > 2.0 THEN high ELSE (low + high) / 2 END FROM b, f WHERE n < 30
), e AS (SELECT CASE WHEN (SELECT most = least FROM f) THEN 1.0::DOUBLE ELSE high END AS a FROM b WHERE n = 30),
w AS (SELECT s, tokens, CASE WHEN tokens > 0 THEN pow(share, a) / (SELECT sum(pow(share, a)) FROM p, e WHERE tokens > 0) ELSE 0 END AS weight FROM p, e),
q AS (
  SELECT s, tokens, weight, greatest(tokens, floor(weight * (SELECT max(tokens / weight) FROM w WHERE tokens > 0) + 0.5))::BIGINT AS budget,
    least(CAST(ceil((tokens + 1) / 262144.0) AS BIGINT), 1048576) AS blocks FROM w
), x AS (
  SELECT d.*, ('0x' || substr(md5('11|' || k || '|block'), 1, 8))::BIGINT % q.blocks AS block, md5('11|' || k) AS ord FROM d JOIN q USING (s)
), y AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY s, block ORDER BY ord, k, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM x
), h AS (SELECT s, block, sum(tokens)::BIGINT AS held FROM x GROUP BY ALL),
r AS (
  SELECT q.*, unnest(range(CASE WHEN tokens > 0 THEN CAST(ceil(budget / tokens) AS BIGINT) ELSE 1 END)) AS epoch FROM q
), z AS (
  SELECT r.*, h.block, r.epoch * r.tokens + coalesce(sum(held) OVER (
    PARTITION BY s, epoch ORDER BY ('0x' || substr(md5('11|' || epoch || '|' || s || '|' || h.block), 1, 8))::BIGINT, h.block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM r JOIN h USING (s)
)
SELECT y.doc_id, y.source, y.tokens::BIGINT AS tokens, z.epoch::BIGINT AS epoch, y.block, (z.base + y.before)::BIGINT AS start, round(z.weight, 9) AS weight
FROM y JOIN z ON y.s = z.s AND y.block = z.block
WHERE (z.base <= z.budget OR z.tokens = 0) AND (z.base + y.before < z.budget OR z.tokens = 0 OR (y.tokens = 0 AND z.base + y.before <= z.budget))
"""

_ALPHABET_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: WARC round trip: base32 is made from each five hexadecimal digits of the SHA-1.
WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS low FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_ALPHABET_32}', CAST(1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to FROM g
"""


def quality_sql(measures: dict[str, tuple[bool, bool]], reach: int, prior: int) -> str:
    """The quality rules with their sketches: integer histograms, merged by adding, read at the quartiles and drawn towards the parent's."""
    from_rows = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS measure, {m} AS v FROM m" for m in measures)
    some = ", ".join(f"'{m}'" for m, (positive, _) in measures.items() if positive)
    lower = ", ".join(f"'{m}'" for m, (_, low) in measures.items() if low)
    order = " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(measures))
    names = ", ".join(f"'{m}'" for m in measures)

    def quartiles(by: str) -> str:
        keys = f"{by}, " if by else ""
        part = f"PARTITION BY {keys}measure"
        return f"""(SELECT {keys}measure, max(docs)::DOUBLE AS n, min(CASE WHEN upto * 4 >= docs THEN floor_of END)::DOUBLE AS q1, min(CASE WHEN upto * 4 >= docs * 3 THEN floor_of + (1 << CASE WHEN bucket < 128 THEN 0 ELSE bucket // 64 - 1 END::INTEGER) - 1 END)::DOUBLE AS q3 FROM (
          SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS docs, CASE WHEN bucket < 128 THEN bucket ELSE (bucket - 64 * (bucket // 64 - 1)) << (bucket // 64 - 1)::INTEGER END AS floor_of
          FROM (SELECT {keys}measure, bucket, sum(n)::BIGINT AS n FROM s WHERE bucket > 0 OR measure NOT IN ({some}) GROUP BY ALL)) GROUP BY {keys}measure)"""

    def drawn(q: str) -> str:
        of_lang = f"((coalesce(l.n, 0.0::DOUBLE) * coalesce(l.{q}, 0.0::DOUBLE) + {float(prior)}::DOUBLE * e.{q}) / (coalesce(l.n, 0.0::DOUBLE) + {float(prior)}::DOUBLE))"
        return f"((coalesce(p.n, 0.0::DOUBLE) * coalesce(p.{q}, 0.0::DOUBLE) + {float(prior)}::DOUBLE * {of_lang}) / (coalesce(p.n, 0.0::DOUBLE) + {float(prior)}::DOUBLE)) AS {q}"

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
b AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS n_marks FROM d LEFT JOIN r USING (rid)
), m AS (
  SELECT rid, doc_id, lang, source, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
    100 * word_chars // greatest(n_words, 1) AS mean_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * (len(lines) - len(list_distinct(lines))) // greatest(len(lines), 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_capitals // greatest(word_chars, 1) AS capitals, 1000 * n_marks // greatest(word_chars, 1) AS marks,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
), v AS ({from_rows}),
s AS (
  SELECT v.lang, v.source, measure, CASE WHEN v < 128 THEN v ELSE 64 * (length(bin(v)) - 7) + (v >> (length(bin(v)) - 7)::INTEGER) END AS bucket, count(*) AS n
  FROM v JOIN m USING (rid) WHERE NOT base_failed GROUP BY ALL
), grid AS (SELECT lang, source, unnest([{names}]) AS measure FROM (SELECT DISTINCT lang, source FROM s)),
f AS (
  SELECT grid.lang, grid.source, grid.measure, {drawn("q1")}, {drawn("q3")}
  FROM grid LEFT JOIN {quartiles("")} e ON grid.measure = e.measure LEFT JOIN {quartiles("lang")} l ON grid.lang = l.lang AND grid.measure = l.measure
    LEFT JOIN {quartiles("lang, source")} p ON grid.lang = p.lang AND grid.source = p.source AND grid.measure = p.measure
), t AS (SELECT *, {float(reach)}::DOUBLE * (q3 - q1) AS wide FROM f),
x AS (
  SELECT v.rid, string_agg(v.measure, ',' ORDER BY CASE v.measure {order} END) AS failed FROM v JOIN t ON v.lang = t.lang AND v.source = t.source AND v.measure = t.measure
  WHERE v.v > q3 + wide OR (v.measure IN ({lower}) AND v.v < q1 - wide) GROUP BY v.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM m LEFT JOIN x USING (rid)
"""


def license_sql(rows: list[tuple], coverage: float) -> str:
    """The licence index in SQL; ``rows`` are its postings (template, kind, label, word, position, key)."""
    values = ", ".join(f"('{t}', '{k}', '{x}', '{w}', {p}, {int(key)})" for t, k, x, w, p, key in rows)
    return rf"""
WITH ix(template, kind, label, word, tpos, key) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
u AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w),
h AS (SELECT rid, word, pos FROM u WHERE word IN (SELECT word FROM ix)),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
f AS (SELECT word, count(DISTINCT rid) AS df FROM h GROUP BY word),
q AS (SELECT ix.*, round(ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)), 6) AS weight FROM ix LEFT JOIN f USING (word), n),
t AS (SELECT template, sum(weight) AS all_weight, sum(key) AS key_words FROM q GROUP BY template),
a AS (SELECT rid, template, kind, label, pos - tpos AS start, sum(weight) AS weight, sum(key) AS keys FROM h JOIN q USING (word) GROUP BY ALL),
m AS (SELECT a.*, CASE WHEN kind = 'base' OR all_weight = 0 THEN 1.0::DOUBLE ELSE round(a.weight / all_weight, 6) END AS share FROM a JOIN t USING (template) WHERE keys = key_words),
o AS (
  SELECT rid, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
    coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (kind = 'base')), ','), '') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
    max(share) AS score FROM m WHERE kind = 'base' OR share >= {coverage} GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN o USING (rid)
"""
