"""DuckDB SQL for the queries that SQL can express; written from the contracts, apart from the operators."""

from __future__ import annotations

SPACE = "[\\x20\\x09-\\x0D]"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source, {WORDS} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM d, unnest(range(1, len(words) - 1)) t(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
ln AS (SELECT rid, source, text, unnest(lines) AS line FROM d),
nm AS (SELECT rid, source, text, length(line) AS chars, trim(regexp_replace(lower(line), '{SPACE}+', ' ', 'g')) AS mark FROM ln),
texts AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY source),
often AS (SELECT nm.source, mark FROM nm JOIN texts ON texts.source IS NOT DISTINCT FROM nm.source GROUP BY nm.source, mark, texts HAVING count(DISTINCT text) > greatest(20, texts * 0.05)),
gone AS (SELECT rid, sum(chars)::BIGINT AS chars FROM nm WHERE EXISTS (SELECT 1 FROM often o WHERE o.mark = nm.mark AND o.source IS NOT DISTINCT FROM nm.source) GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0)::BIGINT AS line_chars, coalesce(gone.chars, 0) AS removed_chars
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_chars <= 0.5 * line_chars AS kept, line_chars, removed_chars FROM f
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS gram FROM d, unnest(range(1, greatest(len(words) - 2, 2))) t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT c.doc_id, e.y FROM c JOIN e ON e.x = c.root)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(root) AS component_id, min(root) = c.doc_id AS is_representative FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id, n.n
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
k AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win FROM d, unnest(range(1, len(words) - 18)) t(i)),
f AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) r(j)),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
o AS (SELECT w.doc_id, count(c.p) AS gone, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL) AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN strlen(html) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(html) >= 100 AND first <> page_id THEN first END AS refers_to FROM q
"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '\\', '\\\\'), '<', '\\l'), '>', '\\g'), '#', '\\h')"


OP9 = f"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
count(CASE WHEN role = 'assistant' THEN 1 END)::BIGINT AS n_examples, sum(17 + length(replace({_escaped('role')}, chr(10), '\\n')) + length({_escaped('text')}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id
"""
