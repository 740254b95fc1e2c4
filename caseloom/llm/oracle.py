"""DuckDB SQL for the numbered queries whose rows SQL can express."""

from __future__ import annotations

from . import mixing, secrets, sharding

TEXT = "coalesce(text, '')"


def mark(seed: int, *values: str) -> str:
    """`common.mark` in SQL."""
    parts = ", '|', ".join(f"coalesce(CAST({v} AS VARCHAR), '-')" for v in values)
    return f"CAST(concat('0x', substr(md5(concat('{seed}|', {parts})), 1, 15)) AS BIGINT)"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def secret_scan() -> str:
    """Matches are placed by the lengths of what a split at them leaves."""
    kinds = {
        "assign": ("(?i)" + secrets.ASSIGN.pattern, 2, secrets.LEAST_ASSIGN),
        "access": (secrets.ACCESS.pattern, 0, secrets.LEAST_ACCESS),
        "hex": (r"[0-9a-f]+", 0, 16),
    } | {k: (p.pattern, 0, 0) for k, p in secrets.EXTRA.items()}
    met = " UNION ALL ".join(
        f"SELECT doc_id, row, '{kind}' AS kind, {n} AS place, {least} AS least, string_split_regex(t, '{_quoted(p)}') AS p, regexp_extract_all(t, '{_quoted(p)}') AS m, regexp_extract_all(t, '{_quoted(p)}', {group}) AS v FROM d WHERE regexp_matches(t, '{_quoted(p)}')"
        for n, (kind, (p, group, least)) in enumerate(kinds.items())
    )
    shown = "string_agg(concat(kind, ':', CAST(start AS VARCHAR), ':', CAST(start + n AS VARCHAR)), ',' ORDER BY start, place, n)"
    return f"""WITH d AS (SELECT doc_id, {TEXT} AS t, row_number() OVER () AS row FROM documents), m AS ({met}),
    e AS (SELECT doc_id, row, kind, place, least, p, m, generate_subscripts(m, 1) AS i, unnest(m) AS x, unnest(v) AS val FROM m),
    s AS (SELECT row, kind, place, length(x) AS n, CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start FROM e WHERE length(val) >= least),
    g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {shown} FILTER (place < 3) AS base, {shown} AS spans FROM s GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""


def _network() -> str:
    """The Feistel network over column x of `walk` (row, x, n, a, b), as nested selects."""
    inner = "SELECT row, n, a, b, x // b AS l, x % b AS r FROM walk"
    for i in range(sharding.ROUNDS):
        inner = f"SELECT row, n, a, b, (l + {mark(sharding.SEED, 'r', str(2 * i))} % a) % a AS l, r FROM ({inner})"
        inner = f"SELECT row, n, a, b, l, (r + {mark(sharding.SEED, 'l', str(2 * i + 1))} % b) % b AS r FROM ({inner})"
    return f"SELECT row, l * b + r AS x, n, a, b FROM ({inner})"


def shard() -> str:
    """CRC-32 by its table over the bytes; cycle walking by recursion."""
    return f"""WITH RECURSIVE tb AS (SELECT list(list_reduce([i::UBIGINT] || [0::UBIGINT FOR k IN range(8)], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    h AS (SELECT doc_id, hex(encode({TEXT})) AS h, row_number() OVER () AS row FROM documents), l AS (SELECT doc_id, row, h, [CAST('0x' || h[2 * k + 1:2 * k + 2] AS UBIGINT) FOR k IN range(length(h) // 2)] AS l FROM h),
    c AS (SELECT doc_id, row, CAST(length(h) // 2 + 8 AS BIGINT) AS size, CAST(xor(list_reduce([4294967295::UBIGINT] || l, lambda a, x: xor(a >> 8, t[1 + CAST(xor(a, x) & 255 AS BIGINT)])), 4294967295::UBIGINT) AS BIGINT) AS crc FROM l, tb),
    s AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM c), k AS (SELECT *, row_number() OVER (ORDER BY {mark(sharding.SEED, 'doc_id', 'crc', 'size')} % {sharding.BUCKETS}, doc_id NULLS FIRST, crc, size) - 1 AS x FROM c),
    walk AS (SELECT row, x, n, a, (n + a - 1) // a AS b, 0 AS walked FROM k, s UNION ALL SELECT row, x, n, a, b, 1 FROM ({_network().replace('FROM walk', 'FROM (SELECT * FROM walk WHERE walked = 0 OR x >= n)')}))
    SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p.x % {sharding.SHARDS} AS INT) AS shard, p.x // {sharding.SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard FROM k JOIN (SELECT row, x FROM walk WHERE walked = 1 AND x < n) p USING (row)"""


def mix() -> str:
    """Targets by the same closed form, places in strata by windows."""
    seed, stratum, most, chunk = mixing.SEED, mixing.STRATUM, mixing.MOST, mixing.CHUNK
    weight = f"[{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]"
    return f"""WITH d AS (SELECT doc_id, md5(text) AS t, source, CAST(len(regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY 1), w AS (SELECT *, CAST({weight} AS DOUBLE) AS w, {most} * source_size AS cap FROM p),
    v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    g AS (SELECT level AS final FROM v WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1), t AS (SELECT source, source_size, n, CAST(coalesce(least(cap, (SELECT final FROM g) * w), cap) AS DOUBLE) AS target FROM v),
    c AS (SELECT doc_id, t, source, size, count(*) AS n FROM d GROUP BY 1, 2, 3, 4), e AS (SELECT *, unnest(range(0, (n - 1) // {chunk} + 1)) AS j FROM c),
    r AS (SELECT e.doc_id, e.source, e.size, least({chunk}, e.n - {chunk} * j) AS m, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, {mark(seed, 'doc_id', 'e.t', 'j')} AS h, CAST(ceil(t.n / {stratum}.0) AS BIGINT) AS strata FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
    o AS (SELECT *, h % strata AS stratum FROM r), k AS (SELECT *, sum(m) OVER (PARTITION BY source, stratum ORDER BY size DESC, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - m AS start, rate - floor(rate) AS f, CAST({mark(seed, 'source', 'stratum')} >> 8 AS DOUBLE) * (1.0 / 4503599627370496) AS u FROM o),
    i AS (SELECT *, unnest(range(1, m + 1)) AS i FROM k)
    SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + floor(f * (start + i) + u) - floor(f * (start + i - 1) + u) AS BIGINT) AS taken FROM i"""


def hard_negatives() -> str:
    """Every anchor against every row, by definition."""
    order = "score DESC, vec_id NULLS LAST, row"
    return f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER () AS row FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.row AS anchor, b.vec_id, b.row, a.label = b.label AS alike, CAST(list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score FROM e a JOIN e b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, anchor, vec_id AS positive_id, row AS positive, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY {order}) <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, positive ORDER BY {order}) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor = s.anchor AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan(), "op3_shard": shard(), "op10_mix": mix(), "op12_hard_negatives": hard_negatives()}
