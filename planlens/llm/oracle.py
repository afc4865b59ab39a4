"""SQL that must give the rows of the text operators' queries, where SQL can say what they compute."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOW_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
lowest AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN lowest USING (s) WHERE lo < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

LINES = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM line),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY doc_id"""

BENCHMARK = rf"""
WITH item AS (SELECT item_id, {TERMS} AS w FROM benchmark),
size AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM size)),
d AS (SELECT doc_id, {TERMS} AS w FROM documents),
part AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM size))),
met AS (SELECT doc_id, n, i, item_id FROM part JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {LOW_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS seen FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.seen),
low AS (SELECT doc_id, min(seen) AS lo FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(lo, d.doc_id)::BIGINT AS component_id, coalesce(lo, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {shift}) & 31)::INT, 1)"
                      for g in range(8) for shift in (15, 10, 5, 0))
ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lo FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lo THEN lo END AS refers_to
FROM p"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(regexp_replace(text, '(\\|</?s>|\[/?INST\])', '\\\1', 'g')) + length(role) + 1
             + CASE WHEN role = 'assistant' THEN 4 + 5 ELSE 10 + 12 END AS chars FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

# The main text of the given pages is what stands in their article element; its blocks are h1 and p.
ARTICLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM t),
w AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM w"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
gram AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, g, count(*) AS f FROM gram GROUP BY lang, g HAVING count(*) >= 100),
cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
inner_part AS (SELECT DISTINCT lang, g[i:i + k - 1] AS g, a FROM
               (SELECT lang, g, a, k, unnest(range(1, len(g) - k + 2)) AS i FROM cand CROSS JOIN range(2, 5) AS r(k) WHERE k < len(g))),
gone AS (SELECT DISTINCT c.lang, c.g FROM cand c JOIN inner_part i ON i.lang = c.lang AND i.g = c.g WHERE 100 * i.a >= 100 * c.a),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand ANTI JOIN gone USING (lang, g)),
score AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
          FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN size s ON s.lang = c.lang),
low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM low)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named QUALIFY rank <= 2000"""

MIDDLE = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
x AS (SELECT doc_id, n, t, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s,
      CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x"""

ORACLE: dict[str, str] = {"op1_substring_dedup": SUBSTRING, "op3_line_dedup": LINES, "op5_decontamination": BENCHMARK, "op6_near_dedup": NEAR,
                          "op7_warc": ARCHIVE, "op8_chat": CHAT,
                          "op11_html_text": ARTICLE, "op12_collocations": PHRASES, "op13_fill_in_middle": MIDDLE}
