"""DuckDB SQL of the queries whose SQL is longer than a few lines."""

#: The words of a text: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.
_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

#: CRC-32 in SQL: the table of the reflected polynomial, then one step a byte.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)"""


def _crc(text: str) -> str:
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)))"


DECONTAMINATE = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS name, {_WORDS} AS w FROM benchmark),
    cut AS (SELECT name, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM cut),
    runs AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
             FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
    m AS (SELECT rid, i, n, win FROM runs WHERE win IN (SELECT win FROM cut)),
    hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + n)) AS u(j) GROUP BY rid),
    item AS (SELECT rid, count(DISTINCT name) AS n_items, string_agg(DISTINCT name, ',' ORDER BY name) AS names
             FROM m JOIN cut USING (win) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid)"""

RESAMPLING = f"""
    WITH {_CRC_TABLE},
    d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
    dw AS (SELECT rid, word FROM d, unnest(w) AS u(word)),
    bw AS (SELECT word FROM (SELECT {_WORDS} AS w FROM benchmark), unnest(w) AS u(word)),
    v AS (SELECT word, {_crc('word')} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * CAST((SELECT count(*) FROM dw) + 10000 AS DOUBLE)
              / ((coalesce(s, 0) + 1) * CAST((SELECT count(*) FROM bw) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
          FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    f AS (SELECT rid, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
          FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY rid),
    r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
              (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
          FROM d LEFT JOIN f USING (rid)),
    p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
                 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn FROM r)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= drawn THEN k END AS rank FROM p"""


def _field(column: str, value: str | None = None) -> str:
    said = f"CAST({value or column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({said})) || ':' || {said} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*[_field(c) for c in ("doc_id", "source", "lang", "n_chars")], _field("text", text)]) + ")"


#: The siblings of a node within its run of eight.
_RUN = "PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN"
_LEFT = f"coalesce(string_agg(node, '') OVER ({_RUN} UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
_RIGHT = f"coalesce(string_agg(node, '') OVER ({_RUN} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"


def _climb(name: str, base: str) -> str:
    """Levels over ``base`` (tree, idx, node), each tree until one node is left, with the siblings."""
    return f"""{name}_up(tree, level, idx, node) AS (
        SELECT tree, 0, idx, node FROM {base}
        UNION ALL
        SELECT tree, level + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}_up) WHERE c > 1 GROUP BY tree, level, idx // 8),
    {name}_root AS (SELECT tree, arg_max(node, level) AS node FROM {name}_up GROUP BY tree),
    {name}_side AS (SELECT tree, level, idx, {_LEFT} AS l, {_RIGHT} AS r
        FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS top FROM {name}_up) WHERE level < top)"""


def _fold(name: str, base: str, sides: str) -> str:
    """Rows of ``base`` (rid, tree, idx, proof, folded) after their way through the levels of ``sides``."""
    return f"""{name}_way(rid, tree, level, idx, proof, folded) AS (
        SELECT rid, tree, 0, idx, proof, folded FROM {base}
        UNION ALL
        SELECT rid, tree, level + 1, idx // 8, proof || l || r, sha256(l || folded || r) FROM {name}_way JOIN {sides} USING (tree, level, idx)),
    {name} AS (SELECT rid, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM {name}_way GROUP BY rid)"""


MERKLE = f"""
    WITH RECURSIVE {_CRC_TABLE},
    rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS node,
              CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0
                   THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS found
              FROM documents, crc_table),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS idx FROM rows_),
    {_climb('low', 'leaves')},
    subs AS (SELECT '' AS tree, tree AS under, row_number() OVER (ORDER BY tree) - 1 AS idx, node FROM low_root),
    {_climb('high', 'subs')},
    start_ AS (SELECT rid, tree, idx, '' AS proof, coalesce(found, node) AS folded FROM leaves),
    {_fold('in_tree', 'start_', 'low_side')},
    next_ AS (SELECT rid, '' AS tree, subs.idx, proof, folded FROM in_tree JOIN leaves USING (rid) JOIN subs ON subs.under = leaves.tree),
    {_fold('whole', 'next_', 'high_side')}
    SELECT doc_id, leaves.node AS leaf, subs.node AS subroot, high_root.node AS root, sha256(proof) AS proof_sha256,
           folded AS folded_root, folded = high_root.node AS verified
    FROM leaves JOIN whole USING (rid) JOIN subs ON subs.under = leaves.tree, high_root"""
