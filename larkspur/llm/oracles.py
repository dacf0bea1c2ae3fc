"""DuckDB forms of the newer operators' results, over the same tables."""

#: CRC-32 of a hexadecimal string's bytes: the table by its rule, then a fold over the bytes.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n)))"""


def crc32_of(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, where crc_table is in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substring(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])))"


_FEATURES = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

RESAMPLING = f"""WITH {CRC_TABLE},
  d AS (SELECT doc_id, row_number() OVER () AS r, {_FEATURES} AS words FROM documents),
  c AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
  target AS (SELECT word, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS word FROM benchmark) GROUP BY 1),
  seen AS (SELECT word FROM c UNION SELECT word FROM target),
  bucket AS (SELECT word, {crc32_of('word')} % 10000 AS bucket FROM seen, crc_table),
  s AS (SELECT bucket, sum(n) AS n FROM c JOIN bucket USING (word) GROUP BY 1),
  t AS (SELECT bucket, sum(n) AS n FROM target JOIN bucket USING (word) GROUP BY 1),
  all_s AS (SELECT coalesce(sum(n), 0) AS n FROM s), all_t AS (SELECT coalesce(sum(n), 0) AS n FROM t),
  gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(all_s.n + 10000 AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(all_t.n + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM s FULL JOIN t USING (bucket), all_s, all_t),
  w AS (SELECT r, sum(n * gain) AS weight FROM c JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY 1),
  h AS (SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substring(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
  scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
  able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS all_able FROM scored WHERE n_features >= 20)
  SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN rank <= all_able * 10 // 100 THEN rank END AS BIGINT) AS rank
  FROM scored LEFT JOIN able USING (r)"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every pair of equal words a period apart, the stretches of such pairs, and of equal stretches the smallest period.
PERIODIC = f"""WITH {CRC_TABLE},
  d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS words, {crc32_of("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h, doc_id IS NULL AS unnamed FROM documents, crc_table),
  planted AS (SELECT *, CASE WHEN h % 10 = 0 AND NOT unnamed AND len(words) > 0 THEN h // 10 END AS g, len(words) AS n FROM d),
  spots AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM planted),
  w AS (SELECT r, i, n, words[CASE WHEN i < a THEN i ELSE coalesce(a + (i - a) % p, i) END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM spots)),
  pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
  stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
  runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
  told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DECIMAL(38, 18)) / period DESC, start, period) AS k FROM runs) WHERE k = 1),
  gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
  kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN gone USING (r, i) GROUP BY 1)
  SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
  FROM d LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""
