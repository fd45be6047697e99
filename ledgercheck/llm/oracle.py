"""DuckDB SQL with the same rows, for the queries SQL can express."""

ORACLE = {}

# Words of a text: lower-cased A-Z, runs of digits, a-z and everything beyond ASCII.
_WORDS = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLE["op1_decontaminate"] = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w
               FROM benchmark),
wins AS (
  SELECT item, array_to_string(w[i:i + 9], ' ') AS win, 10 AS n
  FROM items, unnest(range(1, len(w) - 8)) AS t(i) WHERE len(w) >= 10
  UNION
  SELECT item, array_to_string(w, ' '), len(w) FROM items WHERE len(w) BETWEEN 1 AND 9),
docs AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, runs.n, item FROM runs JOIN wins USING (win)),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

ORACLE["op7_mixing"] = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
counts AS (SELECT key, count(*) AS n FROM docs GROUP BY key),
roots AS (SELECT key, n, CAST(floor(sqrt(n)) AS BIGINT) AS root FROM counts),
shares AS (SELECT key, n, greatest(1, 1000 * root // (SELECT sum(root) FROM roots)) AS share
           FROM roots),
numbered AS (SELECT key, share, n, row_number() OVER (ORDER BY key) AS i FROM shares),
total AS (SELECT CAST(sum(share) AS BIGINT) AS q, list(share ORDER BY i) AS a FROM numbered),
-- one slot at a time: of the released blocks the one due first
sched(t, given, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT)
  FROM total
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: CASE WHEN i = p THEN g + 1 ELSE g END), p
  FROM (
    SELECT t, given, (
      SELECT arg_min(i, due * 100000 + i) FROM (
        SELECT i, ((given[i] + 1) * q + a[i] - 1) // a[i] AS due
        FROM unnest(range(1, len(a) + 1)) AS u(i)
        WHERE given[i] * q < (t + 2) * a[i])) AS p
    FROM sched, total WHERE t + 1 < q)),
plan AS (
  SELECT key, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k
  FROM sched JOIN numbered ON pick = i WHERE t >= 0),
placed AS (
  SELECT doc_id, source, key, share, n, h % ((n + 8191) // 8192) AS bucket, h
  FROM docs JOIN shares USING (key)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY bucket, h, doc_id) - 1 AS r FROM placed),
horizon AS (
  SELECT min(blocks // share * q + slot) AS horizon
  FROM (SELECT key, share, (n + 63) // 64 AS blocks FROM shares) s, total, plan
  WHERE plan.key = s.key AND plan.k = blocks % share)
SELECT doc_id, source, CAST(share AS BIGINT) AS share, q AS period, r // 64 AS block,
       r // 64 // share * q + slot AS slot,
       (r // 64 // share * q + slot) * 64 + r % 64 AS position,
       r // 64 // share * q + slot < horizon AS in_mix
FROM ranked JOIN plan ON plan.key = ranked.key AND plan.k = r // 64 % share, total, horizon
"""

# Words between ASCII white space, lower-cased A-Z.
_SPACED = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')")

ORACLE["op10_jaccard"] = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM docs, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT docs.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM docs LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

ORACLE["op9_repeats"] = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win
  FROM docs, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM wins)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
spread AS (SELECT doc_id, k, w[k] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text
  FROM spread LEFT JOIN gone USING (doc_id, k) WHERE gone.doc_id IS NULL GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN kept USING (doc_id)
"""

# crc32 of ASCII text, byte by byte and bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(
    list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_CONV_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"

# One row of every conversation at a time; per state (nothing, s, ..u, ..a) the cheapest way there,
# the least audit of those, and its lines.
ORACLE["op11_conversations"] = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC32.format(_CONV_KEY)} % 20 AS code FROM conversations),
changed AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, n
  FROM coded, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(n)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                               left(text, 64), md5(role || chr(0) || text)) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM changed),
told AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS r,
         CASE WHEN bare = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1
                THEN 'duplicate'
              WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
pairs AS (
  SELECT conv_id, r || lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS two FROM told),
faults AS (
  SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM told GROUP BY conv_id),
wrong AS (
  SELECT conv_id, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM pairs GROUP BY conv_id),
ways(conv_id, i, state, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[])
  FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    WITH inserted AS (
      SELECT conv_id, i, state, cost, audit, lines FROM ways
      UNION ALL
      SELECT conv_id, i, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 5, audit || 'I',
             list_append(lines, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END) FROM ways
      UNION ALL
      SELECT conv_id, i, CASE state WHEN 2 THEN 2 ELSE 3 END, cost + 10, audit || 'II',
             lines || (CASE state WHEN 2 THEN ['assistant:', 'user:']
                       ELSE ['user:', 'assistant:'] END) FROM ways
      UNION ALL
      SELECT conv_id, i, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 15, audit || 'III',
             lines || (CASE state WHEN 2 THEN ['assistant:', 'user:', 'assistant:']
                       ELSE ['user:', 'assistant:', 'user:'] END) FROM ways),
    steps AS (
      SELECT w.conv_id, t.i, state, cost + 2 AS cost, audit || 'D' AS audit, lines
      FROM inserted w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
      UNION ALL
      SELECT w.conv_id, t.i, CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
             cost + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, audit || 'K',
             list_append(lines, role || ':' || text)
      FROM inserted w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
      WHERE fault IN ('', 'truncated')
        AND (r = 's' AND state = 0 OR r = 'u' AND state <> 2 OR r = 'a' AND state = 2)
      UNION ALL
      SELECT w.conv_id, t.i, CASE state WHEN 2 THEN 3 ELSE 2 END,
             cost + 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, audit || 'R',
             list_append(lines, CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text)
      FROM inserted w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
      WHERE fault IN ('', 'truncated'))
    SELECT *, row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) AS k
    FROM steps) WHERE k = 1),
ends AS (
  SELECT conv_id, i, CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END + cost AS cost,
         audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         lines || (CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:']
                   ELSE CAST([] AS VARCHAR[]) END) AS lines FROM ways),
best AS (
  SELECT * FROM ends QUALIFY row_number() OVER (
    PARTITION BY conv_id ORDER BY i DESC, cost, audit) = 1)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
       sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN wrong ON wrong.conv_id IS NOT DISTINCT FROM best.conv_id
"""

ORACLE["op12_archive"] = """
WITH held AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
ranked AS (
  SELECT page_id, html, strlen(html) AS n,
         first_value(page_id) OVER w AS best, row_number() OVER w AS k
  FROM held WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 THEN best END AS refers_to
FROM ranked
"""

ORACLE["op13_divergence"] = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
found AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM found GROUP BY lang, source),
sides AS (
  SELECT DISTINCT docs.lang, docs.source, coalesce(v, 0) AS v, coalesce(t.total, 0) AS total,
         coalesce(langs.total, 0) AS lang_total
  FROM docs LEFT JOIN langs USING (lang)
  LEFT JOIN totals t ON t.lang = docs.lang AND t.source = docs.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(f.n, 0) AS n,
         1 + CAST(1000000000 * (coalesce(f.n, 0) + 5) // (s.total + 5 * s.v) AS BIGINT) AS p,
         1 + CAST(1000000000 * (k.n + 5) // (s.lang_total + 5 * s.v) AS BIGINT) AS q
  FROM sides s JOIN kept k ON k.lang = s.lang
  LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                                    ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
