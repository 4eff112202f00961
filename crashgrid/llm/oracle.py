"""DuckDB SQL of the filter audit, the Merkle manifest and the chat format."""

from __future__ import annotations

#: What both turns of the added conversation say.
ADDED_TURN = "</s>[INST] ok [/INST]"

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT r, part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
             doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS tox,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
              100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (tox) AS tox FROM f GROUP BY ALL),
p AS (SELECT DISTINCT part FROM c),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, g.i, e.i, h.i] AS ord FROM x a, x b, x g, x e, x h
      WHERE len(list_distinct([a.i, b.i, g.i, e.i, h.i])) = 5),
s AS (SELECT ord, x.i AS step, ord[x.i] AS f, ord[1:x.i - 1] AS before FROM o, x),
k AS (SELECT part, ord, step, s.f,
        sum(n) FILTER (len(list_filter(list_append(before, s.f), lambda j: fails[j])) = 0) AS kept,
        sum(n) FILTER (fails[s.f] AND len(list_filter(before, lambda j: fails[j])) = 0) AS removed,
        sum(n) FILTER (fails[s.f] AND len(list_filter(before, lambda j: fails[j])) > 0) AS redundant,
        sum(n) FILTER (fails[s.f] AND len(list_filter(fails, lambda j: j)) = 1) AS uniq,
        sum(good) FILTER (fails[s.f] AND len(list_filter(before, lambda j: fails[j])) = 0) AS gl,
        sum(tox) FILTER (fails[s.f] AND len(list_filter(before, lambda j: fails[j])) = 0) AS tl
      FROM c, s GROUP BY ALL)
SELECT part, array_to_string(list_transform(ord, lambda j: 'ABCDE'[j]), '') AS filter_order, step::INT AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(uniq, 0)::BIGINT AS unique_fails,
       coalesce(gl, 0)::BIGINT AS good_lost, coalesce(tl, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM k"""

#: Trees are recursive tables, one level after the other; crc32 is a fold over the digits' bytes.
_OP12 = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({framed}) AS leaf, sha256({tampered}) AS other,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
             lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (SELECT 0 AS lvl, lang, pos, leaf AS h, n FROM leaves
          UNION ALL
          SELECT lvl + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
          FROM nodes WHERE n > 1 GROUP BY lvl, lang, pos // 8, n),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
         FROM nodes WHERE n = 1),
upper_nodes AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM tops
                UNION ALL
                SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
                FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 8, n),
run AS (SELECT lvl, lang, pos, h, n, list(h) OVER r AS hs, pos % 8 AS i FROM nodes
        WINDOW r AS (PARTITION BY lvl, lang, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
upper_run AS (SELECT lvl, pos, n, list(h) OVER r AS hs, pos % 8 AS i FROM upper_nodes
        WINDOW r AS (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
step AS (SELECT lvl, lang, pos, {{'l': array_to_string(hs[1:i], ''), 'r': array_to_string(hs[i + 2:], '')}} AS s FROM run WHERE n > 1),
upper_step AS (SELECT lvl, pos, {{'l': array_to_string(hs[1:i], ''), 'r': array_to_string(hs[i + 2:], '')}} AS s
               FROM upper_run WHERE n > 1),
paths AS (SELECT x.doc_id, x.leaf, x.lang, x.pos, list(s.s ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS p FROM leaves x
          LEFT JOIN step s ON s.lang IS NOT DISTINCT FROM x.lang AND s.pos = x.pos // (8 ** s.lvl)::BIGINT
          GROUP BY ALL),
upper_paths AS (SELECT t.lang, t.subroot, list(s.s ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS p FROM tops t
                LEFT JOIN upper_step s ON s.pos = t.pos // (8 ** s.lvl)::BIGINT GROUP BY ALL),
whole AS (SELECT x.doc_id, x.leaf, u.subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root,
                 list_concat(coalesce(p.p, []), coalesce(u.p, [])) AS p,
                 CASE WHEN x.crc % 3 = 0 THEN x.other ELSE x.leaf END AS given
          FROM leaves x JOIN paths p ON p.lang IS NOT DISTINCT FROM x.lang AND p.pos = x.pos
          JOIN upper_paths u ON u.lang IS NOT DISTINCT FROM x.lang)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(p, lambda s: s.l || s.r), '')) AS proof_sha256,
       list_reduce(list_prepend({{'l': given, 'r': ''}}, p), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root,
       folded_root = root AS verified FROM whole"""

#: The lumped escape rule without lookahead: no control string's rest holds a first character.
OP13 = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|\|image\|>|\|audio\|>|\|document\|>))', '\1\\\2', 'g') AS escaped FROM m),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length(role) + length(escaped) + 9) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS n_tokens_attached FROM g""".replace("{said}", ADDED_TURN)


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def op12() -> str:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return _OP12.format(framed=" || ".join(map(_framed, columns)),
                        tampered=" || ".join(_framed(lower if c == "text" else c) for c in columns))
