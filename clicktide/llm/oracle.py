"""SQL for DuckDB of the corpus queries that SQL can express in reasonable time."""

from __future__ import annotations


def _tree(name: str, levels: int) -> str:
    """Levels 1 to ``levels`` above the table ``name0``, and for each what stands beside a node below it."""
    out = []
    for k in range(1, levels + 1):
        below = f"{name}{k - 1}"
        out.append(f"""
        {name}{k} AS MATERIALIZED (
            SELECT tree, pos // 16 AS pos, (max(n) + 15) // 16 AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node
            FROM {below} WHERE n > 1 GROUP BY tree, pos // 16),
        {name}_beside{k} AS MATERIALIZED (
            SELECT a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
                   coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
            FROM {below} a JOIN {below} b ON a.tree = b.tree AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),""")
    return "".join(out)


def _tops(name: str, levels: int) -> str:
    return " UNION ALL ".join(f"SELECT tree, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1))


def _climb(docs: str, name: str, levels: int, tree: str, pos: str) -> str:
    """``docs`` with ``fold`` and ``proof`` carried up all levels of a tree; the last table is ``docs_name<levels>``."""
    out, last = [], docs
    for k in range(1, levels + 1):
        out.append(f"""
        {docs}_{name}{k} AS (
            SELECT d.* EXCLUDE (fold, proof), CASE WHEN b.l IS NULL THEN fold ELSE sha256(b.l || fold || b.r) END AS fold,
                   proof || coalesce(b.l || b.r, '') AS proof
            FROM {last} d LEFT JOIN {name}_beside{k} b ON b.tree = {tree} AND b.pos = {pos} // {16 ** (k - 1)}),""")
        last = f"{docs}_{name}{k}"
    return "".join(out)


def _merkle(leaf_levels: int, source_levels: int) -> str:
    """Trees of up to 16 ** levels leaves and sources, level by level."""
    # a bit of the checksum per list entry; a byte enters with its first one
    crc = """list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])),
                lambda crc, x: xor(xor(crc, x) >> 1, CASE WHEN xor(crc, x) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295)"""

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        parts = (f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields)
        return f"sha256({' || '.join(parts)})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH hashed AS (
            SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(low)} AS twin,
                   xor({crc}, 4294967295) % 5 = 0 AS hit
            FROM documents),
        src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS sources
                FROM (SELECT DISTINCT source FROM documents)),
        leaf0 AS MATERIALIZED (
            SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY tree) AS n, leaf AS node, doc_id, CASE WHEN hit THEN twin ELSE leaf END AS fold
            FROM hashed JOIN src ON hashed.source IS NOT DISTINCT FROM src.source),
        {_tree('leaf', leaf_levels)}
        sub AS MATERIALIZED ({_tops('leaf', leaf_levels)}),
        src0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, sources AS n, node FROM sub JOIN src USING (tree)),
        {_tree('src', source_levels)}
        root AS ({_tops('src', source_levels)}),
        d AS (SELECT *, '' AS proof FROM leaf0),
        {_climb('d', 'leaf', leaf_levels, 'd.tree', 'd.pos')}
        e AS (SELECT * FROM d_leaf{leaf_levels}),
        {_climb('e', 'src', source_levels, '0', 'd.tree')}
        z AS (SELECT * FROM e_src{source_levels})
        SELECT doc_id, z.node AS leaf, sub.node AS subroot, root.node AS root, sha256(proof) AS proof_sha256,
               fold AS folded_root, fold = root.node AS verified
        FROM z JOIN sub ON sub.tree = z.tree, root
    """


ORACLE = {
    "op2_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) + len(regexp_extract_all(text,
                   '<\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')))
                   AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op7_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS a
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, list_slice(a, k, k + 2) AS x
            FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 1, 2))) AS k FROM w WHERE len(a) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS c FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM comp LEFT JOIN n USING (doc_id)
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT h, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN original < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original < page_id THEN original END AS refers_to
        FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 100
    """,
    "op11_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
        k AS (
            -- in the order in which targets stop: what is left, and the weight of those that share it
            SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                   sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER o AS turn
            FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
        f AS (SELECT rest, open FROM k WHERE CAST(weight * rest AS DOUBLE) / open <= 3 * source_size ORDER BY turn LIMIT 1),
        t AS (
            SELECT source, source_size, least(CAST(weight * rest AS DOUBLE) / open, 3 * source_size) AS target FROM w, f),
        e AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size * 16777216 + 0.5) AS BIGINT) END AS expected,
                   CAST('0x' || substr(md5('mix/' || coalesce('s' || source, 'n')), 1, 6) AS BIGINT) AS start
            FROM t),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS pos FROM d)
        SELECT doc_id, size, source_size, target,
               (((start + (pos + 1) * expected) >> 24) - ((start + pos * expected) >> 24)) * size AS taken
        FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
            FROM documents),
        m AS (
            SELECT doc_id, part, (len(w) < 200)::INT
                   + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                   + 4 * (100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x))::INT
                   + 8 * (regexp_matches(x, '[#$%&*|]'))::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
            FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (
            SELECT [a, b, c, d, e] AS f FROM
                (SELECT name AS a FROM f), (SELECT name AS b FROM f), (SELECT name AS c FROM f), (SELECT name AS d FROM f), (SELECT name AS e FROM f)
            WHERE len(list_distinct([a, b, c, d, e])) = 5),
        s AS (
            SELECT array_to_string(o.f, '') AS filter_order, step, f.bit,
                   CAST(list_sum(list_transform(o.f[1:step - 1], lambda x: 1 << (ascii(x) - 65))) AS INT) AS earlier
            FROM (SELECT f, unnest(range(1, 6)) AS step FROM o) o JOIN f ON f.name = o.f[step]),
        r AS (
            SELECT part, filter_order, step, bit,
                   sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0) AS kept,
                   sum(n) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0) AS removed,
                   sum(n) FILTER (mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0) AS redundant,
                   sum(n) FILTER (mask = bit) AS unique_fails,
                   sum(good) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0) AS good_lost,
                   sum(toxic) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0) AS toxic_lost
            FROM c, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step,
               CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r
    """,
    "op13_merkle_manifest": _merkle(6, 3),
}
