"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from lograft.llm import chat, quality
from lograft.llm import conversation_repair as repair

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_ODDS = "list_sum(list_transform(list_zip(p.v, e.a), lambda z: z[1] * ln(z[2] / (1 - z[2]))))"


def _accuracy(j: int) -> str:
    good = f"1 / (1 + exp(-(ln({quality.SHARE} / (1 - {quality.SHARE})) + {_ODDS})))"
    right = f"CASE WHEN p.v[{j}] > 0 THEN p.n * {good} WHEN p.v[{j}] < 0 THEN p.n * (1 - {good}) ELSE 0 END"
    return (f"greatest({quality.LEAST}, ({quality.PSEUDO} * {quality.START} + sum({right})) / "
            f"({quality.PSEUDO} + sum(CASE WHEN p.v[{j}] <> 0 THEN p.n ELSE 0 END)))")


_N = len(quality.RULES)

#: Counts of every document, with the columns of documents beside them.
_COUNTED = rf"""
base AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, {_WORDS} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win FROM worded, unnest(generate_series(1, len(ws) - 7)) AS u(i)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (
  SELECT rid, sum(adds) AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS adds FROM twice) GROUP BY rid),
counted AS (
  SELECT doc_id, text, lang, source, n_chars, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
    len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda z: z[1] = z[2])) AS n_same_next
  FROM worded LEFT JOIN covered c USING (rid)),
voted AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [
    CASE WHEN n_words < 20 THEN -1 ELSE 0 END,
    CASE WHEN 10 * n_symbols > 3 * n_words THEN -1 ELSE 0 END,
    CASE WHEN 10 * n_upper > 3 * word_chars THEN -1 ELSE 0 END,
    CASE WHEN 2 * n_dup_lines > n_lines THEN -1 ELSE 0 END,
    CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 ELSE 0 END,
    CASE WHEN 5 * n_same_next > n_words THEN -1 ELSE 0 END,
    CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN -1 ELSE 0 END,
    CASE WHEN n_words >= 50 AND 20 * n_symbols < n_words AND 10 * n_upper < word_chars AND 10 * n_repeat_words <= n_words
      AND 20 * n_same_next < n_words THEN 1 ELSE 0 END] AS v
  FROM counted),
patterns AS (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
em(it, a) AS (
  SELECT 0, [{', '.join([f'{quality.START}::DOUBLE'] * _N)}]
  UNION ALL
  SELECT e.it + 1, [{', '.join(_accuracy(j) for j in range(1, _N + 1))}]
  FROM em e, patterns p WHERE e.it < {quality.ROUNDS} GROUP BY e.it),
judged AS (
  SELECT p.*, NOT base_failed AND 1 / (1 + exp(-(ln({quality.SHARE} / (1 - {quality.SHARE})) + {_ODDS}))) >= {quality.THRESHOLD} AS kept
  FROM voted p, em e WHERE e.it = {quality.ROUNDS})"""

OP1 = f"""WITH RECURSIVE {_COUNTED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def _text(value: str) -> str:
    return " || ".join("chr(10)" if part == "\n" else f"'{part}'" for part in value.replace("\n", "\0\n\0").split("\0") if part) or "''"


def _escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\-')"
    for c in chat.DEFAULT.controls:
        out = rf"replace({out}, '{c}', '{c[0]}\+{c[1:]}')"
    return out


_FORMS = " ".join(
    f"WHEN role = '{role}' THEN {_text(f.before)} || {_escaped('text')} || {_text(f.after)}" for role, f in chat.DEFAULT.forms.items())
_OTHER = (rf"{_text(chat.DEFAULT.other.before)} || replace({_escaped('role')}, chr(10), '\|') || chr(10) || {_escaped('text')} || "
          f"{_text(chat.DEFAULT.other.after)}")

OP10 = rf"""
WITH raw AS (
  SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM raw),
formed AS (SELECT *, CASE {_FORMS} ELSE {_OTHER} END AS form FROM turns),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    string_agg(form, '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
    string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM formed GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  length(formatted)::BIGINT AS formatted_chars, regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM whole"""



def _crc32(text: str) -> str:
    """crc32 of an ASCII string: each byte is taken in, then shifted out bit by bit (the -1 in the list)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), {fold}), 4294967295)"


def _moves() -> str:
    """Rows (symbol, state, next state, cost, letters) of one turn with the turns inserted behind it; symbol -1 stands for the begin."""
    rows = []
    for symbol in (-1, *range(repair.GONE + 1)):
        for q in range(repair.STATES):
            if symbol < 0:
                edits = [("", 0, repair.START)] if q == repair.START else []
            else:
                gone, kind = symbol == repair.GONE, symbol % repair.TRUNCATED
                more = 3 if symbol >= repair.TRUNCATED else 0
                edits = [("D", 4, q)] + ([] if gone else [("R", 3 + more, repair.ADDED[q])])
                edits += [("K", more, repair.KEPT[kind][q])] if not gone and q in repair.KEPT[kind] else []
            for letter, cost, to in edits:
                for n in range(3):
                    rows.append(f"({symbol}, {q}, {to}, {cost + 3 * n}, '{letter + 'I' * n}')")
                    to = repair.ADDED[to]
    return ", ".join(rows)


#: Cheapest edits as a recursion over turns: the least (cost, letters) for every state of the role order.
OP11 = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
    coalesce(nullif(strpos('sua', left(role, 1)), 0), 4) - 1 AS kind FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
told AS (
  SELECT *, CASE WHEN role = '' THEN 3 ELSE kind END AS initial,
    CASE WHEN blank OR again THEN {repair.GONE} ELSE (CASE WHEN role = '' THEN 3 ELSE kind END) + CASE WHEN cut THEN 4 ELSE 0 END END AS symbol
  FROM seen),
moves(symbol, q, q2, cost, letters) AS (VALUES {_moves()}),
best(conv_id, i, q, found) AS (
  SELECT t.conv_id, 0::BIGINT, m.q2, min(lpad(m.cost::VARCHAR, 12, '0') || m.letters)
  FROM (SELECT DISTINCT conv_id FROM told) t, moves m WHERE m.symbol = -1 GROUP BY ALL
  UNION ALL
  SELECT b.conv_id, b.i + 1, m.q2,
    min(lpad((left(b.found, 12)::BIGINT + m.cost)::VARCHAR, 12, '0') || substr(b.found, 13) || m.letters)
  FROM best b JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1 JOIN moves m ON m.symbol = t.symbol AND m.q = b.q
  GROUP BY b.conv_id, b.i, m.q2),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
    sum((NOT blank AND again)::INT) AS duplicate, sum((NOT blank AND NOT again AND cut)::INT) AS truncated FROM told GROUP BY conv_id),
pairs AS (
  SELECT conv_id, sum((NOT ((a = 0 AND b = 1) OR (a = 1 AND b = 2) OR (a = 2 AND b = 1)))::INT) AS illegal
  FROM (SELECT conv_id, initial AS a, lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM told) WHERE b IS NOT NULL GROUP BY conv_id),
ended AS (
  SELECT c.conv_id, left(min(b.found), 12)::BIGINT AS cost, substr(min(b.found), 13) AS audit
  FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n AND b.q IN ({repair.START}, {repair.ANSWERED})
  GROUP BY c.conv_id),
letters AS (
  SELECT conv_id, p, audit[p] AS e, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS out
  FROM ended, unnest(range(1, length(audit) + 1)) AS u(p)),
edited AS (
  SELECT l.*, t.role, t.text, bool_or(l.out = 1 AND e = 'K' AND t.initial = 0) OVER (PARTITION BY l.conv_id) AS briefed
  FROM letters l LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i WHERE e <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (out - briefed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS told FROM edited GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(l.told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id"""

#: Nodes as groups of equal prefixes; sums over a subtree by handing every node's share to all its prefixes.
OP12 = rf"""
WITH told AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
dealt AS (SELECT *, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM told),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM dealt c LEFT JOIN told b ON b.conv_id = c.base),
prefixes AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS ends FROM rebuilt, unnest(range(len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids,
    CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].t) END AS bytes FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(children.n, 0) AS kids FROM nodes LEFT JOIN children USING (d, p)),
shares AS (SELECT a AS d, p[1:a] AS p, sum((kids = 0)::INT) AS leaves, sum((n - 1) * bytes) AS saved FROM known, unnest(range(d + 1)) AS u(a) GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, o.conv_id AS parent_conv_id, k.n AS n_convs, k.kids AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
FROM known k JOIN shares s ON s.d = k.d AND s.p = k.p LEFT JOIN nodes o ON o.d = k.d - 1 AND o.p = k.p[1:k.d - 1]"""

SQL = {"op12_conversation_prefix_trie": OP12, "op11_conversation_structure_repair": OP11, "op1_quality_rules": OP1, "op10_chat_formatting": OP10}
