"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLES = {
    "op6_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
        keyed AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        repeated AS (
            SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (
            SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped
            FROM keyed k LEFT JOIN repeated r USING (key))
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op8_warc_revisits": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        hashed AS (SELECT page_id, payload_bytes, sha256(payload) AS payload_digest FROM payloads),
        firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM hashed WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, h.payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM hashed h LEFT JOIN firsts f ON h.payload_digest = f.payload_digest
    """,
    "op11_spelling_variants": r"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS keyed, w, count(*) AS n
            FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
            WHERE length(w) >= 7 GROUP BY ALL),
        crcs AS (
            SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
            FROM (SELECT unnest(range(256)) AS i)),
        bytes AS (
            SELECT w, n, flatten(list_transform(string_split(keyed, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
        hashed AS (
            SELECT w, n, xor(4294967295, list_reduce([4294967295] || b, lambda h, x: xor(h >> 8, crc[1 + (xor(h, x) & 255)]))) AS h FROM bytes, crcs),
        written AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS word, n FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        gaps AS (
            SELECT word, n, k, left(word, (k - 1)::INT) || substr(word, (k + 1)::INT) AS gap FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
        links AS (
            SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.k = b.k AND a.word <> b.word
            UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.gap = w.word
            UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.gap = w.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM links GROUP BY word),
        found AS (
            SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        steps AS (
            SELECT word, word AS here, 0 AS step FROM found
            UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN found f ON s.here = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, form, arg_max(here, step) AS root, n, n_near, form_n
        FROM found f JOIN steps USING (word) GROUP BY ALL
    """,
    "op13_source_divergence": r"""
        WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents),
        cells AS (
            SELECT lang, source, doc, term, count(*) AS n
            FROM (SELECT lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs)
            GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL HAVING count(*) >= 3),
        sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT c.lang, source, term, sum(c.n)::HUGEINT AS n FROM cells c SEMI JOIN kept k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL),
        totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
        shares AS (
            SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
                   (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.n + s.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 1) // (s.n + s.v))::BIGINT AS q
            FROM totals t JOIN sizes s ON t.lang = s.lang JOIN kept k ON k.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM found QUALIFY part = 'pair' OR rank <= 200
    """,
}
