"""The same rows as SQL that DuckDB runs, for queries whose SQL is long."""

from __future__ import annotations


def _crc32(s: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    bits = f"[CAST((ascii({s}[k // 8 + 1]) >> (k % 8)) & 1 AS BIGINT) FOR k IN range(8 * len({s}))]"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {bits}, lambda x, b: xor(x >> 1, (xor(x, b) & 1) * 3988292384)), 4294967295)"


def _encoded(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST = f"""WITH RECURSIVE leaf AS (SELECT doc_id, lang, {' || '.join(map(_encoded, ('doc_id','source','lang','n_chars')))} AS head, text, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {LOWERED} ELSE text END AS altered FROM documents),
leaves AS (SELECT doc_id, lang, sha256(head || {_encoded('text')}) AS h, sha256(head || {_encoded('altered')}) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
low AS (SELECT lang, 0 AS lvl, i, n, h FROM leaves
  UNION ALL SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, lvl, n, i // 8),
tops AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, i, n, h FROM tops
  UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, n, i // 8),
beside AS (SELECT lang, lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM low WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, i // 8 ORDER BY i)),
above AS (SELECT lvl, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 8 ORDER BY i)),
steps AS (SELECT doc_id, beside.lvl AS s, b, a FROM leaves JOIN beside ON leaves.lang IS NOT DISTINCT FROM beside.lang AND leaves.i // CAST(8 ** beside.lvl AS BIGINT) = beside.i
  UNION ALL SELECT doc_id, 100 + above.lvl, b, a FROM leaves JOIN tops ON leaves.lang IS NOT DISTINCT FROM tops.lang JOIN above ON tops.i // CAST(8 ** above.lvl AS BIGINT) = above.i),
path AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k, b, a FROM steps),
fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, t AS x FROM leaves
  UNION ALL SELECT doc_id, fold.k + 1, sha256(b || x || a) FROM fold JOIN path USING (doc_id) WHERE path.k = fold.k + 1),
folded AS (SELECT doc_id, arg_max(x, k) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(b || a, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY doc_id)
SELECT leaves.doc_id, leaves.h AS leaf, tops.h AS subroot, high.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = high.h AS verified
FROM leaves JOIN tops ON leaves.lang IS NOT DISTINCT FROM tops.lang JOIN high ON high.n = 1 JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id)"""


def _more(state: str, cost: str, letter: str) -> str:
    """Cost (nine digits) and edits of a state with one more edit; null stays null."""
    return f"lpad(CAST(CAST(left({state}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}'"


_PUT = ", ".join(_more(x, "5", "I") for x in ("e", "s", "a"))
_TO_USER = lambda cost, letter: f"least({', '.join(_more(x, cost, letter) for x in ('e', 's', 'a1'))})"

REPAIR = f"""WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS how FROM conversations),
made AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hit, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(x)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM made),
r AS (SELECT conv_id, turn, role, text, k, left(role, 1) AS i, coalesce(lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal,
  CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
seen AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM seen
  UNION ALL SELECT conv_id, k, {_more("e", "2", "D")}, least({_more("s", "2", "D")}, CASE WHEN fault NOT IN (1, 2) AND i = 's' THEN {_more("e", "x", "K")} END),
    least({_more("u1", "2", "D")}, CASE WHEN fault NOT IN (1, 2) THEN {_TO_USER("1 + x", "R")} END, CASE WHEN fault NOT IN (1, 2) AND i = 'u' THEN {_TO_USER("x", "K")} END),
    least({_more("a1", "2", "D")}, CASE WHEN fault NOT IN (1, 2) THEN {_more("u1", "1 + x", "R")} END, CASE WHEN fault NOT IN (1, 2) AND i = 'a' THEN {_more("u1", "x", "K")} END)
    FROM (SELECT *, least(a, {_more("u1", "5", "I")}) AS a1 FROM (SELECT dp.*, least(dp.u, {_PUT}) AS u1, r.k AS next, r.i, r.fault, CASE WHEN r.fault = 3 THEN 5 ELSE 0 END AS x FROM dp JOIN r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = dp.k + 1)) AS q(conv_id, j, e, s, u, a, u1, k, i, fault, x, a1)),
best AS (SELECT dp.conv_id, least(e, a, {_more(f"least(u, {_PUT})", "5", "I")}) AS b FROM dp JOIN seen ON dp.conv_id IS NOT DISTINCT FROM seen.conv_id AND dp.k = seen.n),
steps AS (SELECT conv_id, j, substr(b, 9 + j, 1) AS edit FROM best, unnest(range(1, len(b) - 8)) AS t(j)),
told AS (SELECT conv_id, j, edit, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS m FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
kept AS (SELECT told.conv_id, j, edit, m, role, text, bool_or(m = 1 AND edit = 'K' AND i = 's') OVER (PARTITION BY told.conv_id) AS led FROM told LEFT JOIN r ON told.conv_id IS NOT DISTINCT FROM r.conv_id AND told.k = r.k WHERE edit <> 'D'),
final AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(b, 9) AS BIGINT), 0) AS cost, coalesce(substr(b, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN seen ON c.conv_id IS NOT DISTINCT FROM seen.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN final ON c.conv_id IS NOT DISTINCT FROM final.conv_id"""
