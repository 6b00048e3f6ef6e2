"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from probelake.llm import mixing as M
from probelake.llm import quality as Q

SQL: dict[str, str] = {}

SQL["op10_chunk_recipes"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL["op3_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{Q.SPACE}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 4)) AS s(i)),
again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS r FROM again GROUP BY doc_id),
line AS (SELECT doc_id, l, regexp_replace(l, '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g') AS x FROM d, unnest(lines) AS u(l)),
marked AS (SELECT doc_id, l, x, len(string_split_regex(x, '{Q.SPACE}+')) AS n,
             len(regexp_extract_all(l, {quoted(Q.MENU_MARK)})) AS marks,
             len(regexp_extract_all(l, {quoted(Q.SYMBOL + '|' + Q.SHOUT)})) AS noise FROM line),
judged AS (SELECT doc_id, l, regexp_matches(x, {quoted(Q.SENTENCE_END)})
             AND NOT (marks >= 2 AND n <= marks * {Q.MENU_WORDS_PER_MARK}) AND NOT (noise * {Q.NOISE_WORDS_PER_MARK} >= n)
             AND NOT regexp_matches(l, {quoted(Q.BOILERPLATE)}) AS good FROM marked),
lost AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT good) AS n_lines_removed, sum(length(l)) AS chars,
           coalesce(sum(length(l)) FILTER (NOT good), 0) AS chars_removed FROM judged GROUP BY doc_id),
out AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, {quoted(Q.SYMBOL)}, '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed,
    coalesce(chars, 0)::BIGINT AS chars, coalesce(chars_removed, 0)::BIGINT AS chars_removed
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words) AND 100 * chars_removed <= {Q.MAX_LOST_PERCENT} * chars AS kept,
  n_lines, n_lines_removed, chars_removed
FROM out
"""


SQL["op11_stream_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded),
grams AS (SELECT lang, w[i:i + m - 1] AS g, count(*) AS f FROM starts, range(1, 6) AS r(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING m = 1 OR count(*) >= 100),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
cand AS (SELECT lang, g, f AS a FROM grams WHERE len(g) > 1),
inside AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer FROM cand, range(1, 5) AS s(i), range(2, 5) AS r(m)
           WHERE i + m - 1 <= len(g) AND m < len(g) GROUP BY ALL),
open AS (SELECT c.* FROM cand AS c LEFT JOIN inside AS x ON c.lang = x.lang AND c.g = x.g WHERE longer IS NULL OR longer < a),
cuts AS (SELECT lang, g, a, k, g[1:k] AS p, g[k + 1:] AS q FROM open, range(1, 5) AS s(k) WHERE k < len(g)),
valued AS (SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts AS c JOIN grams AS x ON c.lang = x.lang AND c.p = x.g JOIN grams AS y ON c.lang = y.lang AND c.q = y.g JOIN totals AS t ON c.lang = t.lang),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
placed AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score, k,
             row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score, k::BIGINT AS cut FROM placed WHERE rank <= 2000
"""

def poured(level: str, parents: list[str], weights: dict[str, int], before: str) -> str:
    """CTEs that share the budgets of table ``before`` among the nodes of a level, into ``share_<level>``."""
    path = ", ".join([*parents, level])
    part = f"PARTITION BY {', '.join(parents) or '0'}"
    weight = f"(CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END)::HUGEINT"
    order = f"ORDER BY capacity::DOUBLE / weight::DOUBLE, {level}"
    return f"""
node_{level} AS (SELECT {path}, capacity, {weight} AS weight, budget FROM
  (SELECT {path}, sum(tokens * {{epochs}})::HUGEINT AS capacity FROM leaf GROUP BY ALL) {'JOIN ' + before + f' USING ({", ".join(parents)})' if parents else 'CROSS JOIN ' + before}),
run_{level} AS (SELECT *, coalesce(sum(capacity) OVER ({part} {order} ROWS UNBOUNDED PRECEDING), 0)::HUGEINT - capacity AS below,
  (sum(weight) OVER ({part}) - sum(weight) OVER ({part} {order} ROWS UNBOUNDED PRECEDING) + weight)::HUGEINT AS rest FROM node_{level}),
full_{level} AS (SELECT *, capacity * rest <= (budget - below) * weight AS filled FROM run_{level}),
open_{level} AS (SELECT *, budget - coalesce(sum(capacity) FILTER (filled) OVER ({part}), 0)::HUGEINT AS remain,
  (sum(weight) FILTER (NOT filled) OVER ({part}))::HUGEINT AS open FROM full_{level}),
part_{level} AS (SELECT *, CASE WHEN filled THEN capacity ELSE remain * weight // open END AS part,
  sum((NOT filled)::INT) OVER ({part} ORDER BY {level}) AS turn FROM open_{level}),
share_{level} AS (SELECT {path}, part + (CASE WHEN NOT filled AND
    turn <= remain - coalesce(sum(part) FILTER (NOT filled) OVER ({part}), 0) THEN 1 ELSE 0 END) AS budget FROM part_{level})"""


def mix_sql(weights: dict[str, dict[str, int]], domains: tuple[str, ...], percent: int, epochs: int, seed: int) -> str:
    names = "[" + ", ".join(f"'{d}'" for d in domains) + "]"
    levels = poured("domain", [], weights["domain"], "root") + "," + poured("lang", ["domain"], weights["lang"], "share_domain") + "," + \
        poured("source", ["domain", "lang"], weights["source"], "share_lang")
    return f"""
WITH keyed AS (SELECT doc_id, coalesce({names}[TRY_CAST(regexp_extract(source, '[0-9]+') AS INT) % {len(domains)} + 1], '{M.NONE}') AS domain,
    coalesce(lang, '{M.NONE}') AS lang, coalesce(source, '{M.NONE}') AS source,
    len(list_filter(string_split_regex(coalesce(text, ''), '{Q.SPACE}+'), lambda x: x <> '')) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM keyed GROUP BY ALL),
root AS (SELECT least(sum(tokens) * {percent} // 100, sum(tokens) * {epochs})::HUGEINT AS budget FROM leaf),
{levels.replace('{epochs}', str(epochs))},
cut AS (SELECT domain, lang, source, tokens AS leaf_tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs
  FROM leaf JOIN share_source USING (domain, lang, source)),
placed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS start,
    budget - epochs * leaf_tokens AS rest
  FROM (SELECT *, md5('{seed}:' || epochs || ':' || doc_id) AS o FROM keyed JOIN cut USING (domain, lang, source)))
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, leaf_tokens::BIGINT AS leaf_tokens, budget::BIGINT AS leaf_budget,
  (epochs + (start < rest)::INT)::BIGINT AS copies,
  (epochs * tokens + greatest(0, least(tokens, rest - start)))::BIGINT AS tokens_used
FROM placed
"""


SQL["op1_b_bit_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
  FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, root) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id WHERE r.root < e.b),
least AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.id = d.doc_id
"""
