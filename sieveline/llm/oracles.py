"""DuckDB SQL for the queries that SQL can express on small tables."""

from __future__ import annotations

#: All pairs that share a shingle, then the smallest id that can be reached; for small tables only.
NEARDUP = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
    r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)"""

FILL_IN_MIDDLE = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    k AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
    FROM p"""

#: The register of CRC-32 over the decimal digits of an id, by a table that is a list.
CRC = """
    crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""
CRC_OF_ID = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs `name0` to `name{levels}` of nodes `tree, i, n, h`, and `name_s0` on of what stands beside each node."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY tree, i // 16, n)")
        out.append(f"{name}_s{k} AS (SELECT a.tree, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 16 = b.i // 16 GROUP BY a.tree, a.i, a.n)")
    return ",\n    ".join(out)


def merkle(levels: int = 5) -> str:
    """Trees of up to 16^levels leaves."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaves = "SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, h, doc_id, tampered FROM d"
    tops = f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree AS name FROM v{levels}"
    joins = "".join(f" JOIN v_s{k} s{k} ON s{k}.tree = v0.tree AND s{k}.i = v0.i // {16**k}" for k in range(levels))
    upper = "".join(f" JOIN u_s{k} t{k} ON t{k}.i = u0.i // {16**k}" for k in range(levels))
    steps = [f"s{k}" for k in range(levels)] + [f"t{k}" for k in range(levels)]
    columns = ", ".join(f"{s}.n AS {s}n, {s}.l AS {s}l, {s}.r AS {s}r" for s in steps)
    folds = ",\n    ".join(f"f{j + 1} AS (SELECT *, CASE WHEN {s}n > 1 THEN sha256({s}l || x{j} || {s}r) ELSE x{j} END AS x{j + 1} FROM f{j})" for j, s in enumerate(steps))
    beside = " || ".join(f"{s}l || {s}r" for s in steps)
    return f"""
    WITH {CRC.strip()},
    d AS (SELECT coalesce('=' || source, '-') AS tree, doc_id, {leaf("text")} AS h, CASE WHEN {CRC_OF_ID} % 5 = 0 THEN {leaf(low)} END AS tampered FROM documents, crc),
    {_tree("v", leaves, levels)},
    {_tree("u", tops, levels)},
    f0 AS (SELECT v0.doc_id, v0.h AS leaf, u0.h AS subroot, (SELECT h FROM u{levels}) AS root, coalesce(v0.tampered, v0.h) AS x0, {columns} FROM v0{joins} JOIN u0 ON u0.name = v0.tree{upper}),
    {folds}
    SELECT doc_id, leaf, subroot, root, sha256({beside}) AS proof_sha256, x{len(steps)} AS folded_root, x{len(steps)} = root AS verified FROM f{len(steps)}"""


def repeated_windows(length: int = 200) -> str:
    """Every window of every text, in hexadecimal digits, cut from pieces because a substring is sought from its string's start."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    c AS (SELECT doc_id, n, p, substr(x, 2 * p + 1, {2 * (255 + length)}) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n - {length - 1}, 256)) AS p FROM d WHERE n >= {length})),
    w AS (SELECT doc_id, p + j AS i, md5_number(substr(y, 2 * j + 1, {2 * length})) AS h FROM (SELECT doc_id, p, y, unnest(range(0, least(256, n - {length - 1} - p))) AS j FROM c)),
    r AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) m USING (h)),
    g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER p + {length} OR lag(i) OVER p IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
    e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s),
    k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(max(x), 2 * max(b) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
