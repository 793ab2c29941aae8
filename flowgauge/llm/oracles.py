"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from itertools import permutations

from . import filter_audit, license, merkle

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex({0}, '{1}'), lambda x: x <> '')"

def _components(size: int, percent: int) -> str:
    """Sizes of shingle sets and the smallest document that each reaches by links."""
    return f"""WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_LOWER, "[ \\t\\n\\x0B\\f\\r]+")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {size - 1}], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - {size - 2}, 2)::BIGINT)) t(i) WHERE len(w) > 0),
sizes AS (SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingles USING (doc_id) GROUP BY w.doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared h JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * h.n >= {percent} * (x.n + y.n - h.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (
  SELECT a, b FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sizes s LEFT JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, s.n"""


NEAR_DUPLICATES = f"SELECT *, doc_id = component_id AS kept FROM ({_components(5, 75)})"
NGRAM_JOIN = _components(3, 90)

_TEMPLATES = ", ".join(
    f"({k}, '{label}', {str(k < len(license.PHRASES)).lower()}, '{text}')"
    for k, (text, label) in enumerate([*license.PHRASES, *license.NOTICES]))

LICENSES = f"""WITH templates(template, label, base, w) AS (
  SELECT t, l, b, string_split(x, ' ') FROM (VALUES {_TEMPLATES}) v(t, l, b, x)),
runs AS (
  SELECT template, label, base, len(w) - 2 AS runs, i AS at_, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c
  FROM templates, unnest(range(len(w) - 2)) t(i)),
words AS (
  SELECT doc_id, {_WORDS.format(_LOWER, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents),
rolled AS (
  SELECT doc_id, i AS place, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c
  FROM words, unnest(range(greatest(len(w) - 2, 0)::BIGINT)) t(i)),
voted AS (
  SELECT doc_id, template, label, base, runs, place - at_ AS diagonal, count(*) AS votes, min(place) AS low, max(place) AS high
  FROM rolled JOIN runs USING (a, b, c) GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {license.MERGE} OR low - lag(high) OVER w > {license.RUN + license.MERGE}
    OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS apart
  FROM voted WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal, low)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal, low) AS span FROM marked),
spans AS (
  SELECT doc_id, template, label, base, runs, sum(votes) AS votes, max(high) - min(low) + {license.RUN} AS length,
    count(*) FILTER (base AND votes = runs) AS n_base, min(diagonal) FILTER (base AND votes = runs) AS first_word,
    max(diagonal) FILTER (base AND votes = runs) AS last_word
  FROM numbered GROUP BY doc_id, template, label, base, runs, span),
scored AS (
  SELECT *, CASE WHEN n_base > 0 THEN 1.0 WHEN length <= {license.STRETCH} * (runs + {license.RUN - 1})
    THEN least(1.0, votes / runs) ELSE 0.0 END::DOUBLE AS score FROM spans)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(sum(n_base), 0)::BIGINT AS n_base, min(first_word)::BIGINT AS first_word,
  max(last_word)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (n_base > 0))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (n_base > 0 OR (NOT base AND score >= {license.COVERAGE})))), ','), '')
    AS labels,
  coalesce(max(score), 0.0)::DOUBLE AS score
FROM words d LEFT JOIN scored s USING (doc_id) GROUP BY d.doc_id, d.w"""

_LETTERS = ", ".join(f"('{x}')" for x in filter_audit.FILTERS)
_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations(filter_audit.FILTERS))

FILTER_AUDIT = f"""WITH rows_ AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    {_WORDS.format("coalesce(text, '')", "[ \\t\\n\\x0B\\f\\r]+")} AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS low FROM rows_ GROUP BY t),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
    CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > low THEN 'E' END) AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM rows_ JOIN firsts USING (t) LEFT JOIN known USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
steps AS (
  SELECT o AS filter_order, k AS step, o[k] AS filter, o[1:k] AS upto, left(o, k::INT - 1) AS ahead
  FROM (VALUES {_ORDERS}) v(o), range(1, 6) r(k)),
met AS (
  SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS fails_it, fails = filter AS only_it,
    len(list_intersect(string_split(ahead, ''), string_split(fails, ''))) > 0 AND ahead <> '' AND fails <> '' AS gone
  FROM counted, steps),
told AS (
  SELECT part, filter_order, step, filter, sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (NOT gone AND fails_it) AS removed,
    sum(n) FILTER (gone AND fails_it) AS redundant, sum(n) FILTER (only_it) AS unique_fails,
    sum(good) FILTER (NOT gone AND fails_it) AS good_lost, sum(toxic) FILTER (NOT gone AND fails_it) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told"""


def _tree_levels(name: str, start: str, levels: int) -> str:
    """CTEs for a tree over (tree, rank, node): ``levels`` times eight nodes become one while a tree has several."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}_s{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})")
        out.append(f"""{name}{k + 1} AS (
  SELECT tree, rank // {merkle.ARITY} AS rank, sha256(string_agg(node, '' ORDER BY rank)) AS node FROM {name}_s{k} WHERE n > 1
  GROUP BY tree, rank // {merkle.ARITY} UNION ALL SELECT tree, rank, node FROM {name}_s{k} WHERE n = 1)""")
    return ",\n".join(out)


def _climb(name: str, rows: str, levels: int) -> str:
    """CTEs that carry ``rows`` (tree, at, folded, proof) up the levels of a tree."""
    out = [f"{name}_w0 AS ({rows})"]
    for k in range(levels):
        out.append(f"""{name}_w{k + 1} AS (
  SELECT w.doc_id, w.original, w.tree, CASE WHEN w.n > 1 THEN w.at // {merkle.ARITY} ELSE w.at END AS at,
    CASE WHEN w.n > 1 THEN sha256(concat(w.left_, w.folded, w.right_)) ELSE w.folded END AS folded,
    concat(w.proof, w.left_, w.right_) AS proof
  FROM (SELECT r.doc_id, r.original, r.tree, r.at, r.folded, r.proof, max(s.n) AS n,
          coalesce(string_agg(s.node, '' ORDER BY s.rank) FILTER (s.rank < r.at), '') AS left_,
          coalesce(string_agg(s.node, '' ORDER BY s.rank) FILTER (s.rank > r.at), '') AS right_
        FROM {name}_w{k} r JOIN {name}_s{k} s ON s.tree = r.tree AND s.rank // {merkle.ARITY} = r.at // {merkle.ARITY}
        GROUP BY ALL) w)""")
    return ",\n".join(out)


def _field(column: str) -> str:
    return f"coalesce(concat(strlen({column}::VARCHAR), ':', {column}::VARCHAR), '-')"


def _leaf(text: str) -> str:
    fields = [_field(c) for c in merkle.FIELDS if c != "text"]
    return f"sha256(concat({', '.join([*fields, _field(text)])}))"


_CAPITALS_AWAY = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Eight levels hold sixteen million documents of a language, three of them 512 languages.
_BELOW, _ABOVE = 8, 3

MERKLE = f"""WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
marked AS (
  SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS touched FROM documents d, crc_table),
leaf_rows AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf('text')} AS node,
    CASE WHEN touched THEN {_leaf(_CAPITALS_AWAY)} ELSE {_leaf('text')} END AS changed FROM marked),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS rank FROM leaf_rows),
{_tree_levels('a', 'SELECT tree, rank, node FROM ranked', _BELOW)},
{_climb('a', "SELECT doc_id, node AS original, tree, rank AS at, changed AS folded, '' AS proof FROM ranked", _BELOW)},
{_tree_levels('b', f"SELECT 1 AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, node, tree AS name FROM a{_BELOW}", 1)
  .replace("b1 AS", "b1_unused AS")},
{_tree_levels('t', "SELECT tree, rank, node FROM b0", _ABOVE)},
{_climb('t', f"SELECT w.doc_id, w.original, 1 AS tree, b.rank AS at, w.folded, w.proof FROM a_w{_BELOW} w JOIN b0 b ON b.name = w.tree", _ABOVE)}
SELECT w.doc_id, w.original AS leaf, b.node AS subroot, r.node AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root,
  w.folded = r.node AS verified
FROM t_w{_ABOVE} w JOIN ranked k ON k.doc_id = w.doc_id AND k.node = w.original JOIN b0 b ON b.name = k.tree, t{_ABOVE} r"""
