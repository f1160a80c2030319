"""SQL twins of the operators that SQL can express, for another engine (DuckDB) on the same tables.

They state the result by its definition: no hashing, banding, or index.
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n_bytes FROM d),
g AS (SELECT doc_id, pos, array_slice(b, pos, pos + 49) AS s
      FROM (SELECT doc_id, b, unnest(range(1, n_bytes - 48)) AS pos FROM n)),
least_doc AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, pos FROM g JOIN least_doc USING (s) WHERE doc_id > least),
marked AS (SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, 0) AS opens FROM hit),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS e FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER w, 1) AS a, a AS e FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT n.doc_id, coalesce(max(r.e), 1), any_value(n.n_bytes) + 1
         FROM n LEFT JOIN runs r USING (doc_id) GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN e > a THEN hex(array_slice(b, a, e - 1)) ELSE '' END, '' ORDER BY a) AS x
         FROM gaps JOIN n USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents
          UNION SELECT v, root FROM reach JOIN edges ON u = node WHERE root < v),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM m"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL_SEARCH = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_TERM}) AS t FROM documents),
a AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
m AS (SELECT doc_id, 100 - 90 + (90 * len(t) * n_docs) // n_terms AS m FROM d, a WHERE len(t) > 0),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM c GROUP BY term), a),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), {_TERM}))) AS term
      FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
