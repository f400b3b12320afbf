"""SQL that gives the rows of those queries SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
bw AS (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
    SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p FROM (
    SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw JOIN (SELECT DISTINCT m FROM pat) s ON len(w) >= m)),
hit AS (SELECT win.doc_id, win.m, win.i, pat.item FROM win JOIN pat ON win.p = pat.p AND win.m = pat.m),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) t GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hit) t GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(items.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON words.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id"""

SUBSTRING_DEDUP = f"""
WITH dw AS (SELECT doc_id, {_BLANK.format("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS p FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM dw WHERE len(w) >= 50)),
least_id AS (SELECT p, min(doc_id) AS first_doc FROM win GROUP BY p),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN least_id ON win.p = least_id.p WHERE first_doc < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM dw WHERE len(w) > 0),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.k) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k WHERE gone.k IS NULL GROUP BY word.doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept ON kept.doc_id = dw.doc_id"""

JACCARD_JOIN = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_BLANK.format(_LOWER)} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM dw UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.other)
SELECT dw.doc_id, coalesce(size.n, 0) AS n_shingles, least_id.c AS component_id
FROM dw LEFT JOIN size ON size.doc_id = dw.doc_id
JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) least_id ON least_id.doc_id = dw.doc_id"""


_PARTS, _ENTRIES = 16, 64


def _nearest(book: str) -> str:
    """Nearest entry of every part, as squared distance times the entries plus the entry."""
    return f"""
  SELECT vec_id, part, min(list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) * {_ENTRIES} + entry) AS m
  FROM parts JOIN {book} USING (part) GROUP BY vec_id, part"""


def _refined(book: str, near: str) -> str:
    return f"""
  SELECT {book}.part, {book}.entry, coalesce(moved.c, {book}.c) AS c FROM {book} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM (
      SELECT part, m % {_ENTRIES} AS entry, k, sum(v[k])::BIGINT AS s, count(*) AS n
      FROM {near} JOIN (SELECT vec_id, part, v, unnest(range(1, len(v) + 1)) AS k FROM parts) t USING (vec_id, part) GROUP BY ALL) u
    GROUP BY part, entry) moved ON moved.part = {book}.part AND moved.entry = {book}.entry"""


VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, x[part * (len(x) // {_PARTS}) + 1:(part + 1) * (len(x) // {_PARTS})] AS v
  FROM (SELECT vec_id, x, unnest(range({_PARTS})) AS part FROM kept) t),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {_ENTRIES}) t),
book0 AS MATERIALIZED (SELECT part, entry, v AS c FROM parts JOIN seeds USING (vec_id)),
near0 AS MATERIALIZED ({_nearest("book0")}),
book1 AS MATERIALIZED ({_refined("book0", "near0")}),
near1 AS MATERIALIZED ({_nearest("book1")}),
book2 AS MATERIALIZED ({_refined("book1", "near1")}),
near2 AS MATERIALIZED ({_nearest("book2")}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(m % {_ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, sum(m // {_ENTRIES})::BIGINT AS error
  FROM near2 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest"""
