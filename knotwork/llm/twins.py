"""SQL twins of the manifest, the licence scan and the conversation trie."""

from __future__ import annotations

#: crc32 of an id's decimal text, byte by byte and bit by bit.
_CRC = "list_reduce(flatten(list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295)"


def crc32(column: str) -> str:
    return f"xor({_CRC.format(id=column)}, 4294967295)"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of the levels of trees over (tree, idx, d, ...): digests, and what stands before and after each in its run."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        here = f"{name}{k}"
        out.append(f"{here}s AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n, coalesce(string_agg(d, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(d, '') OVER (PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {here})")
        out.append(f"{name}{k + 1} AS (SELECT tree, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY idx)) END AS d FROM {here}s GROUP BY tree, idx // 16)")
    return ",\n".join(out)


def _fold(name: str, start: str, levels: int) -> str:
    """CTEs that fold the leaves (tree, idx, f, proof, ...) of `start` up the levels."""
    out, last = [], start
    for k in range(levels):
        here = f"{name}{k}"
        out.append(f"{here} AS (SELECT a.* REPLACE (a.idx // 16 AS idx, CASE WHEN s.n = 1 THEN f ELSE sha256(s.before || f || s.after) END AS f, CASE WHEN s.n = 1 THEN proof ELSE proof || s.before || s.after END AS proof) FROM {last} a JOIN {name[0]}{k}s s ON s.tree = a.tree AND s.idx = a.idx)")
        last = here
    return ",\n".join(out)


def merkle_sql(levels: int = 6, over: int = 3) -> str:
    """Trees of at most 16**levels leaves, and 16**over sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH doc AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS tree, {digest("text")} AS d, CASE WHEN {crc32("doc_id")} % 5 = 0 THEN {digest(low)} END AS other FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS idx FROM doc),
{_tree("t", "SELECT tree, idx, d FROM leaf", levels)},
{_tree("o", f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, d, tree AS source FROM t{levels}", over)},
start AS (SELECT tree, idx, coalesce(other, d) AS f, '' AS proof, doc_id, d FROM leaf),
{_fold("tf", "start", levels)},
mid AS (SELECT '' AS tree, o.idx, f, proof, doc_id, a.d, o.d AS subroot FROM tf{levels - 1} a JOIN o0 o ON o.source = a.tree),
{_fold("of", "mid", over)}
SELECT doc_id, a.d AS leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM of{over - 1} a, o{over} r
"""


def trie_sql() -> str:
    return f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT *, sha256(CAST(octet_length(encode(r)) AS VARCHAR) || ':' || r || x) AS hash, octet_length(encode(x)) AS bytes FROM turns),
own AS (SELECT conv_id, list(struct_pack(hash, bytes) ORDER BY turn NULLS FIRST, substr(hash, 1, 32)) AS t FROM named GROUP BY conv_id),
h AS (SELECT conv_id, t, conv_id - conv_id % 5 AS base, {crc32("conv_id")} % 9 AS h FROM own),
built AS (SELECT h.conv_id, coalesce(b.t[:h], []) || h.t[h + 1:] AS t FROM h LEFT JOIN own b ON b.conv_id = h.base),
pre AS (SELECT conv_id, len(t) AS n, d, list_aggregate(list_transform(t[:d], lambda s: s.hash), 'string_agg', '') AS path, t[d].bytes AS bytes, list_aggregate(list_transform(t[:d - 1], lambda s: s.hash), 'string_agg', '') AS up FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
named_pre AS (SELECT * REPLACE (sha256(coalesce(path, '')) AS path, CASE WHEN d > 0 THEN sha256(coalesce(up, '')) END AS up) FROM pre),
node AS (SELECT d, path, any_value(up) AS up, count(*) AS n_convs, min(conv_id) AS conv_id, (count(*) - 1) * coalesce(any_value(bytes), 0) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256 FROM named_pre GROUP BY d, path),
kid AS (SELECT d - 1 AS d, up AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children, p.conv_id AS parent_conv_id FROM node LEFT JOIN kid ON kid.d = node.d AND kid.path = node.path LEFT JOIN node p ON p.d = node.d - 1 AND p.path = node.up),
under AS (SELECT a.d, a.path, sum(b.saved) AS saved, count(*) FILTER (WHERE b.n_children = 0) AS leaves FROM named_pre a JOIN full_node b ON b.conv_id = a.conv_id AND b.d >= a.d GROUP BY 1, 2)
SELECT conv_id, f.d AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, ends_sha256 FROM full_node f JOIN under ON under.d = f.d AND under.path = f.path
"""


def license_sql() -> str:
    from .licenses import COVER, GAP, LONG, PHRASE_K, TEMPLATES, TEXT_K, template_words

    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {template_words(t)!r})" for n, t in enumerate(TEMPLATES))
    return rf"""
WITH tmpl(template, label, base, w) AS (VALUES {rows}),
t AS (SELECT *, len(w) AS length, CASE WHEN len(w) >= {LONG} THEN {TEXT_K} ELSE {PHRASE_K} END AS k FROM tmpl),
tg AS (SELECT template, k, j, array_to_string(w[j + 1:j + k], ' ') AS g FROM (SELECT *, unnest(range(0, length - k + 1)) AS j FROM t)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT row, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM d, (VALUES ({PHRASE_K}), ({TEXT_K})) ks(k))),
vote AS (SELECT row, template, i - j AS diagonal, list(DISTINCT j) AS places FROM dg JOIN tg USING (k, g) GROUP BY ALL),
phrase AS (SELECT row, template, diagonal AS start, diagonal + length AS stop, places FROM vote JOIN t USING (template) WHERE length < {LONG}),
step AS (SELECT vote.*, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM vote JOIN t USING (template) WHERE length >= {LONG}),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS g FROM step),
islands AS (SELECT row, template, min(diagonal + list_min(places)) AS start, max(diagonal + list_max(places) + {TEXT_K}) AS stop, flatten(list(places)) AS places FROM grouped GROUP BY row, template, g),
span AS (SELECT row, template, label, base, length, k, start, stop, list_distinct(places) AS places, len(list_distinct(flatten(list_transform(places, lambda p: range(p, p + k))))) AS covered FROM (SELECT * FROM phrase UNION ALL SELECT * FROM islands) JOIN t USING (template)),
good AS (SELECT row, label, base, start, covered / length AS cover, CASE WHEN length < {LONG} THEN len(places) = length - k + 1 ELSE covered / length >= {COVER} AND covered >= {COVER} * (stop - start) END AS verified FROM span),
per AS (SELECT row, count(*) FILTER (WHERE verified AND base) AS n_base, min(start) FILTER (WHERE verified AND base) AS first_word, max(start) FILTER (WHERE verified AND base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified) AS labels, max(cover) AS cover FROM good GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(cover, 6), 0.0) AS score FROM d LEFT JOIN per USING (row)
"""
