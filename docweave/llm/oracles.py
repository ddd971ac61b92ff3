"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight,
             sum(source_size) OVER ()::HUGEINT AS total FROM r),
o AS (SELECT *, total - coalesce(sum(3 * source_size) OVER before, 0)::HUGEINT AS remaining,
             (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::HUGEINT AS weight_left
      FROM w WINDOW before AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * weight_left <= weight * remaining AS clamped FROM o),
f AS (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (clamped), 0) AS free_total,
             sum(weight) FILTER (NOT clamped) AS free_weight FROM c),
t AS (SELECT source, source_size::BIGINT AS source_size,
             CASE WHEN clamped THEN (3 * source_size)::DOUBLE
                  ELSE free_total::DOUBLE / free_weight::DOUBLE * weight::DOUBLE END AS target
      FROM c, f),
p AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target + 0.5)::BIGINT // t.source_size ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(0, least(size, floor(target + 0.5)::BIGINT - whole * source_size - ahead)) AS extra FROM p)
SELECT doc_id, size, source_size, target, (whole * size + extra)::BIGINT AS taken,
       (whole + CASE WHEN extra = size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS repeats,
       (CASE WHEN extra = size AND size > 0 THEN 0 ELSE extra END)::BIGINT AS part
FROM x
"""

_WORDS3 = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS3} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
               unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS g
        FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS3} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT row_no, k, unnest(range(1, len(w) - k + 2)) AS p,
                 unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
          FROM d, sizes WHERE len(w) >= k),
m AS (SELECT row_no, p, grams.k, item_id FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
hit AS (SELECT row_no, count(DISTINCT q) AS n_hit FROM (SELECT row_no, unnest(range(p, p + k)) AS q FROM m) GROUP BY row_no),
its AS (SELECT row_no, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
        FROM m GROUP BY row_no)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.row_no = hit.row_no LEFT JOIN its ON d.row_no = its.row_no
"""

OP5 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
         role, text, coalesce('=' || role, '-') || chr(31) || coalesce('=' || text, '-') AS mark
  FROM conversations),
p AS (SELECT conv_id, n, md5(string_agg(mark, chr(30)) OVER (PARTITION BY conv_id ORDER BY n)) AS h,
             count(*) OVER (PARTITION BY conv_id) AS full_n FROM t),
w AS (SELECT n, h, min(conv_id) AS conv_id FROM p WHERE n = full_n GROUP BY n, h),
k AS (SELECT conv_id FROM w ANTI JOIN (SELECT DISTINCT n, h FROM p WHERE n < full_n) q ON w.n = q.n AND w.h = q.h)
SELECT t.conv_id, count(*)::BIGINT AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10)
                  ORDER BY n) AS rendered
FROM t JOIN k ON t.conv_id = k.conv_id GROUP BY t.conv_id
"""

OP7 = f"""
WITH t AS (SELECT doc_id, {LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, false) AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

#: kind, pattern, least length of the tested group, that group. RE2 folds more than ASCII, so cases are spelled out.
_SECRETS = (
    (
        "assign",
        """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    ("access", "AKIA[A-Z0-9]+", 18, 0),
    ("hex", "[0-9a-f]+", 16, 0),
    ("pem", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", 0, 0),
    ("github", "gh[oprsu]_[A-Za-z0-9]+", 40, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 16, 0),
)


def _op9() -> str:
    parts = " UNION ALL ".join(
        f"SELECT row_no, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, '{p}', 0) AS m,"
        f" regexp_extract_all(text, '{p}', {group}) AS g, string_split_regex(text, '{p}') AS b, {least} AS least FROM d"
        for k, (kind, p, least, group) in enumerate(_SECRETS)
    )
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{x[0]}'), 0)::BIGINT AS n_{x[0]}" for x in _SECRETS)
    span = "kind || ':' || s || ':' || (s + w)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({parts}),
u AS (SELECT row_no, kind, k, least, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g) AS g,
             unnest(b[1:len(m)]) AS b FROM f WHERE len(m) > 0),
v AS (SELECT *, length(m) AS w, (sum(length(b)) OVER o + sum(length(m)) OVER o - length(m))::BIGINT AS s FROM u
      WINDOW o AS (PARTITION BY row_no, kind ORDER BY i)),
x AS (SELECT row_no, {counts},
             sha256(coalesce(string_agg({span}, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
             string_agg({span}, ',' ORDER BY s, k) AS spans
      FROM v WHERE length(g) >= least GROUP BY row_no)
SELECT d.doc_id, {', '.join(f'coalesce(n_{x[0]}, 0) AS n_{x[0]}' for x in _SECRETS)},
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN x ON d.row_no = x.row_no
"""


#: The 256 entries of the CRC-32 table, by the rule of the polynomial.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"""


def _crc32(codes: str) -> str:
    """CRC-32 of a list of bytes, with the table t of _CRC_TABLE in scope."""
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _op11() -> str:
    leaf = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    altered = " || ".join([*(_field(c) for c in ("doc_id", "source", "lang", "n_chars")), "coalesce(strlen(low) || ':' || low, '-')"])
    crc = _crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")
    run = "string_agg(h, '') OVER (PARTITION BY stage, lvl, tree, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
             coalesce('=' || lang, '-') AS tree FROM documents),
l AS (SELECT doc_id, tree, sha256({leaf}) AS leaf,
             sha256(CASE WHEN {crc} % 3 = 0 THEN {altered} ELSE {leaf} END) AS altered FROM d, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n FROM l),
a AS (SELECT 0 AS lvl, tree, pos, leaf AS h, n FROM p
      UNION ALL
      SELECT lvl + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8
      FROM a WHERE n > 1 GROUP BY lvl, tree, pos // 8),
subs AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
      UNION ALL
      SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM b WHERE n > 1 GROUP BY lvl, pos // 8),
nodes AS (SELECT 0 AS stage, lvl, tree, pos, h FROM a WHERE n > 1 UNION ALL SELECT 1, lvl, '', pos, h FROM b WHERE n > 1),
steps AS (SELECT stage, lvl, tree, pos,
                 {{'b': coalesce({run} UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
                   'a': coalesce({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')}} AS step FROM nodes),
inner_path AS (SELECT p.tree, p.pos, list(step ORDER BY s.lvl) AS path
               FROM p JOIN steps s ON s.stage = 0 AND s.tree = p.tree AND s.pos = p.pos // (8 ** s.lvl)::BIGINT GROUP BY ALL),
outer_path AS (SELECT u.tree, list(step ORDER BY s.lvl) AS path
               FROM subs u JOIN steps s ON s.stage = 1 AND s.pos = u.pos // (8 ** s.lvl)::BIGINT GROUP BY ALL),
f AS (SELECT p.*, subs.subroot, (SELECT h FROM b WHERE n = 1) AS root,
             list_concat(coalesce(i.path, []), coalesce(o.path, [])) AS path
      FROM p JOIN subs ON subs.tree = p.tree
      LEFT JOIN inner_path i ON i.tree = p.tree AND i.pos = p.pos LEFT JOIN outer_path o ON o.tree = p.tree),
g AS (SELECT *, list_reduce(path, lambda s, x: {{'b': '', 'a': sha256(x.b || s.a || x.a)}}, {{'b': '', 'a': altered}}).a AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.b || x.a), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM g
"""


OP12 = """
WITH v AS (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
           FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.row_no, q.vec_id AS query_id, v.vec_id,
             list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v ON q.row_no <> v.row_no AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def _op13() -> str:
    crc = _crc32("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)")
    far = 1000000000
    extra = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"

    def least(s: int, keeps: dict[str, int], changed: int) -> str:
        """The best value of state s before a row, without inserts."""
        parts = [f"{{'c': v[{s + 1}].c + 2, 'a': 'D' || v[{s + 1}].a}}"]
        for initial, t in keeps.items():
            cost = f"CASE WHEN fault NOT IN (1, 2) AND initial = '{initial}' THEN v[{t + 1}].c + {extra} ELSE {far} END"
            parts.append(f"{{'c': {cost}, 'a': 'K' || v[{t + 1}].a}}")
        cost = f"CASE WHEN fault NOT IN (1, 2) THEN v[{changed + 1}].c + 1 + {extra} ELSE {far} END"
        parts.append(f"{{'c': {cost}, 'a': 'R' || v[{changed + 1}].a}}")
        return f"list_min([{', '.join(parts)}])"

    step = ", ".join(least(*x) for x in ((0, {"s": 1, "u": 2}, 2), (1, {"u": 2}, 2), (2, {"a": 3}, 3), (3, {"u": 2}, 2)))
    insert = lambda b: "[" + ", ".join(f"list_min([{b}[{s}], {{'c': {b}[{t}].c + 5, 'a': 'I' || {b}[{t}].a}}])" for s, t in ((1, 3), (2, 3), (3, 4), (4, 3))) + "]"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT conv_id, coalesce('=' || conv_id, '-') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS draw
      FROM conversations, crc),
e AS (SELECT conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
             CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE draw <> 0),
o AS (SELECT conv, turn, role, text, left(role, 1) AS initial,
             row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
r AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
                     WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM o),
f AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank,
             count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
             count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
w AS (SELECT conv, n AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM f
      UNION ALL
      SELECT conv, i - 1, {insert("b")} AS v FROM (
        SELECT conv, i, {insert("b")} AS b FROM (SELECT w.conv, w.i, [{step}] AS b FROM w JOIN r ON r.conv = w.conv AND r.i = w.i))),
p AS (SELECT conv, v[1].c AS cost, v[1].a AS audit FROM w WHERE i = 0),
l AS (SELECT conv, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS k FROM p WHERE audit <> ''),
m AS (SELECT *, count_if(letter <> 'I') OVER (PARTITION BY conv ORDER BY k) AS i, count_if(letter <> 'D') OVER (PARTITION BY conv ORDER BY k) AS pos FROM l),
t AS (SELECT m.conv, k, letter, pos, r.role, r.text, initial,
             max(CASE WHEN letter = 'K' AND pos = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv) AS lead
      FROM m LEFT JOIN r ON r.conv = m.conv AND r.i = m.i AND letter <> 'I'),
h AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (pos + lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
                                     || coalesce(text, ''), chr(10) ORDER BY k)) AS digest
      FROM t WHERE letter <> 'D' GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM d) c LEFT JOIN f ON f.conv = c.conv LEFT JOIN p ON p.conv = c.conv LEFT JOIN h ON h.conv = c.conv
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": OP2,
        "op3_decontamination": OP3,
        "op5_chat": OP5,
        "op7_exact_dedup": OP7,
        "op9_secrets": _op9(),
        "op11_merkle": _op11(),
        "op12_topk": OP12,
        "op13_repair": _op13(),
    }
