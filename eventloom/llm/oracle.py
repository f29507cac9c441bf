"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from eventloom.llm import lines
from eventloom.llm.mixing import SLOTS
from eventloom.llm.queries import LINE_RATIO, SHARDS


def _sharding() -> str:
    return f"""
    WITH RECURSIVE table_of AS (
      SELECT list(c ORDER BY i) AS crc_table FROM (
        SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
    base AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS body FROM documents),
    sized AS (SELECT doc_id, k, strlen(body) + 16 AS size, body FROM base),
    scored AS (
      SELECT k, s, 1.0 / -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS score
      FROM (SELECT DISTINCT k FROM base), (SELECT unnest(range({SHARDS + 1})) AS s)),
    placed AS (
      SELECT k, first(s ORDER BY score DESC, s) FILTER (WHERE s < {SHARDS}) AS shard, first(s ORDER BY score DESC, s) AS grown FROM scored GROUP BY k),
    summed AS (
      SELECT sized.*, shard, grown,
        xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
          lambda c, b: xor(c >> 8, list_extract(crc_table, xor(c & 255, b) + 1)))) AS text_crc32
      FROM sized JOIN placed USING (k) CROSS JOIN table_of)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
      row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, 2), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INT AS grown_shard
    FROM summed
    """


EXACT = r"""
    WITH bare AS (
      SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
    SELECT doc_id,
      first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
      count(*) OVER (PARTITION BY t) AS group_size,
      row_number() OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST) = 1 AS kept,
      sha256(t) AS text_sha256
    FROM bare
    """


SUBSTRING = r"""
    WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    starts AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, words FROM split WHERE len(words) >= 13),
    windows AS (SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS w FROM starts),
    hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
    covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM hits),
    gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
      sha256(coalesce(array_to_string(list_filter(words, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
    FROM split LEFT JOIN gone USING (doc_id)
    """


NEAR = r"""
    WITH RECURSIVE split AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS s
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM split WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
    """


def _mixing() -> str:
    """The schedule slot by slot: done counts a source's blocks, since those of the phase. Integers only."""
    return f"""
    WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    sized AS (SELECT greatest(64, (sum(n) + {SLOTS - 1}) // {SLOTS})::BIGINT AS size FROM counts),
    sources AS (
      SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, source, floor(sqrt(n))::BIGINT AS weight, ((n + size - 1) // size)::BIGINT AS blocks
      FROM counts CROSS JOIN sized),
    fixed AS (SELECT list(weight ORDER BY i) AS ws, list(blocks ORDER BY i) AS bs, range(1, count(*) + 1) AS every, sum(blocks) AS slots FROM sources),
    dealt AS (
      SELECT -1::BIGINT AS slot, 0::BIGINT AS start, list_transform(every, lambda i: 0::BIGINT) AS since, list_transform(every, lambda i: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM fixed
      UNION ALL
      SELECT slot + 1, CASE WHEN done[pick] + 1 = bs[pick] THEN slot + 2 ELSE start END,
        list_transform(every, lambda i: CASE WHEN done[pick] + 1 = bs[pick] THEN 0 WHEN i = pick THEN since[i] + 1 ELSE since[i] END),
        list_transform(every, lambda i: CASE WHEN i = pick THEN done[i] + 1 ELSE done[i] END), pick
      FROM (
        SELECT * EXCLUDE (pick), list_min(list_transform(
            list_filter(every, lambda i: done[i] < bs[i] AND since[i] * total // ws[i] <= slot + 1 - start),
            lambda i: {{'due': ((since[i] + 1) * total + ws[i] - 1) // ws[i], 'i': i}})).i AS pick
        FROM (
          SELECT *, list_sum(list_transform(list_filter(every, lambda i: done[i] < bs[i]), lambda i: ws[i]))::BIGINT AS total
          FROM dealt CROSS JOIN fixed WHERE slot + 1 < slots))),
    slots AS (SELECT slot, pick, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM dealt WHERE slot >= 0),
    ranked AS (
      SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 2), doc_id NULLS FIRST) - 1 AS source_rank FROM documents)
    SELECT doc_id, ranked.source, source_rank, source_rank // size AS block, slot, slot * size + source_rank % size AS position
    FROM ranked CROSS JOIN sized JOIN sources ON ranked.source IS NOT DISTINCT FROM sources.source JOIN slots ON pick = i AND slots.block = source_rank // size
    """


#: HTML as the SQL reads it.
SILENT = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCKS = r"(?i)</?(?:html|head|body|title|meta|p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|aside|main|br|hr|tr|td|th|table|pre|blockquote|form)(?:[\s/][^>]*)?>|<!doctype[^>]*>"


def _lines() -> str:
    quoted = {k: v.replace("'", "''") for k, v in (("host", lines.HOST), ("silent", SILENT), ("blocks", BLOCKS), ("tags", lines.TAGS))}
    return r"""
    WITH bare AS (
      SELECT page_id, coalesce(regexp_extract(lower(url), '{host}', 1), '') AS host,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{silent}', ' ', 'g'), '{blocks}', chr(10), 'g'), '{tags}', '', 'g') AS t FROM pages),
    cut AS (
      SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '') AS l FROM bare),
    totals AS (SELECT host, count(*) AS pages FROM cut WHERE host <> '' GROUP BY host),
    often AS (
      SELECT host, line FROM (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(l)) AS line FROM cut WHERE host <> '') GROUP BY host, line)
      JOIN totals USING (host) WHERE n > 1 AND n::DOUBLE / pages > {ratio}::DOUBLE),
    boiler AS (SELECT host, list(line) AS b FROM often GROUP BY host),
    kept AS (SELECT page_id, host, l, CASE WHEN b IS NULL THEN l ELSE list_filter(l, lambda x: NOT list_contains(b, x)) END AS k FROM cut LEFT JOIN boiler USING (host))
    SELECT page_id, host, len(l)::BIGINT AS n_lines, (len(l) - len(k))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(k, chr(10)), '')) AS kept_sha256 FROM kept
    """.replace("{ratio}", str(LINE_RATIO)).replace("{host}", quoted["host"]).replace("{silent}", quoted["silent"]).replace("{blocks}", quoted["blocks"]).replace("{tags}", quoted["tags"])


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _sharding(), "op4_exact_dedup": EXACT, "op6_line_dedup": _lines(), "op8_substring_dedup": SUBSTRING, "op9_minhash_dedup": NEAR, "op10_mixing": _mixing()}
