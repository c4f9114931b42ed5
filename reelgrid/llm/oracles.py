"""SQL, in DuckDB's dialect, of the operators that SQL can express; written from the results they are to give, not from their method."""

from __future__ import annotations


def crc32_of(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"
    byte = "list_reduce([xor(a, x)] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || {codes}, lambda a, x: {byte}))"


def _plus(path: str, cost: str, letter: str) -> str:
    """A path (cost of nine digits, then the audit) with one more edit."""
    return f"lpad((substr({path}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({path}, 10) || '{letter}'"


_BEFORE_USER = ("s0", "s1", "s3")

REPAIR = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spot
  FROM conversations
), hit AS (SELECT conv_id, turn, role, text, {crc32_of("spot")} % 20 AS h FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit WHERE h <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM hit WHERE h = 3
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words
  FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, words = '' AS blank,
    words <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    words <> '' AND right(words, 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM sorted
), ready AS (
  SELECT *, cut AND NOT duplicate AS truncated, blank OR duplicate AS must_go, CASE WHEN cut AND NOT duplicate THEN 5 ELSE 0 END AS extra,
    before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged
), path AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, r.i, {_plus("s0", "2", "D")},
    least({_plus("s1", "2", "D")}, CASE WHEN NOT must_go AND initial = 's' THEN {_plus("s0", "extra", "K")} END),
    least({_plus("s2", "2", "D")},
      CASE WHEN NOT must_go AND initial = 'u' THEN least({", ".join(_plus(s, "extra", "K") for s in _BEFORE_USER)}) END,
      CASE WHEN NOT must_go THEN least({", ".join(_plus(s, "extra + 1", "R") for s in _BEFORE_USER)}) END),
    least({_plus("s3", "2", "D")},
      CASE WHEN NOT must_go AND initial = 'a' THEN {_plus("s2", "extra", "K")} END,
      CASE WHEN NOT must_go THEN {_plus("s2", "extra + 1", "R")} END)
  FROM path p JOIN ready r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
), best AS (
  -- An insertion (5) is never among the cheapest edits: its neighbour can be deleted (2) instead.
  SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM path GROUP BY conv_id
), kept AS (
  SELECT r.conv_id, r.i, r.role, r.text, r.initial, substr(b.best, 9 + r.i::INT, 1) AS edit
  FROM ready r JOIN best b ON r.conv_id IS NOT DISTINCT FROM b.conv_id
  WHERE substr(b.best, 9 + r.i::INT, 1) <> 'D'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k,
    first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY conv_id ORDER BY i) AS led
  FROM kept
), written AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole
  FROM numbered GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM ready GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def _framed(field: str) -> str:
    return f"coalesce(strlen({field})::VARCHAR || ':' || {field}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_framed, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


def _tree(name: str, start: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT g, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM {name}) WHERE k > 1 GROUP BY g, level + 1, i // 8
)"""


def _fold(name: str, start: str, tree: str) -> str:
    """The digest of every leaf's path, level by level, from its own first digest and the others of each run."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT f.r, f.g, f.level + 1, f.i // 8, sha256(string_agg(CASE WHEN n.i = f.i THEN f.digest ELSE n.digest END, '' ORDER BY n.i))
  FROM {name} f JOIN {tree} n ON n.g = f.g AND n.level = f.level AND n.i // 8 = f.i // 8
  JOIN depth d ON d.tree = '{tree}' AND d.g = f.g AND f.level < d.top
  GROUP BY f.r, f.g, f.level, f.i
)"""


MERKLE = f"""
WITH RECURSIVE given AS (
  SELECT *, coalesce('=' || lang, '-') AS g, {_leaf("text")} AS leaf,
    {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf, doc_id::VARCHAR AS name
  FROM documents
), leaves AS (
  SELECT doc_id, g, leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_of("name")} % 3 = 0 THEN lower_leaf ELSE leaf END AS after,
    row_number() OVER () AS r, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM given
), {_tree("tree", "SELECT g, 0 AS level, i, leaf AS digest FROM leaves")},
tops AS (SELECT g, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM tree GROUP BY g),
{_tree("crown", "SELECT '' AS g, 0 AS level, i, subroot AS digest FROM tops")},
depth AS (SELECT 'tree' AS tree, g, max(level) AS top FROM tree GROUP BY g UNION ALL SELECT 'crown', g, max(level) FROM crown GROUP BY g),
{_fold("low", "SELECT r, g, 0 AS level, i, after AS digest FROM leaves", "tree")},
reached AS (SELECT r, any_value(g) AS g, arg_max(digest, level) AS digest FROM low GROUP BY r),
{_fold("high", "SELECT r, '' AS g, 0 AS level, t.i, digest FROM reached JOIN tops t USING (g)", "crown")},
folded AS (SELECT r, arg_max(digest, level) AS folded_root FROM high GROUP BY r),
beside AS (
  SELECT f.r, 0 AS part, n.level, n.i, n.digest FROM low f JOIN tree n ON n.g = f.g AND n.level = f.level AND n.i // 8 = f.i // 8 AND n.i <> f.i
  UNION ALL
  SELECT f.r, 1, n.level, n.i, n.digest FROM high f JOIN crown n ON n.level = f.level AND n.i // 8 = f.i // 8 AND n.i <> f.i
), proof AS (SELECT r, string_agg(digest, '' ORDER BY part, level, i) AS digests FROM beside GROUP BY r),
root AS (SELECT arg_max(digest, level) AS root FROM crown)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(digests, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN tops USING (g) JOIN folded USING (r) LEFT JOIN proof USING (r) CROSS JOIN root
"""

NEAR_VECTORS = """
WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
valid AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS size FROM given
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r, b.r AS other FROM valid a JOIN valid b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT r, r AS other FROM valid
  UNION
  SELECT reach.r, links.other FROM reach JOIN links ON links.r = reach.other
), least AS (SELECT reach.r, min(g.vec_id) AS component_id FROM reach JOIN given g ON g.r = reach.other GROUP BY reach.r),
counts AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM given LEFT JOIN counts USING (r) LEFT JOIN least USING (r)
"""
