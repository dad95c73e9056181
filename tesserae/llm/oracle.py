"""SQL (DuckDB) for the operators that it can express."""

from __future__ import annotations

from tesserae.llm import fim, manifest, mixing, neardup, secrets, sharding


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def secrets_sql() -> str:
    fits = {
        kind: f"length(regexp_extract(m, {_quoted(pattern)}, {group})) >= {least}" if group else f"length(m) >= {least}"
        for kind, (pattern, group, least) in secrets.PATTERNS.items()
    }
    fits["mixed"] += " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"
    hits = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, unnest(h) AS m, unnest(g[1:len(h)]) AS gap, generate_subscripts(h, 1) AS i FROM (SELECT rid, regexp_extract_all(t, {_quoted(p)}) AS h, string_split_regex(t, {_quoted(p)}) AS g FROM d) WHERE len(h) > 0"
        for kind, (p, _, _) in secrets.PATTERNS.items()
    )
    test = " ".join(f"WHEN '{kind}' THEN {x}" for kind, x in fits.items())
    near = lambda a, b: f"EXISTS (SELECT 1 FROM {b} o WHERE o.rid = {a}.rid AND abs(o.start - {a}.start) <= {secrets.SCOPE})"
    base = "('" + "','".join(secrets.BASE) + "')"
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(secrets.KINDS)) + " END"
    written = f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {order}, stop)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), x AS ({hits}),
y AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM x),
p AS (SELECT rid, kind, stop - length(m) AS start, stop FROM y WHERE CASE kind {test} END),
weak AS (SELECT * FROM p WHERE kind = 'named' UNION ALL SELECT * FROM p WHERE kind = 'mixed' AND NOT EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND o.stop = p.stop AND o.kind IN ('assign', 'access', 'hex', 'named'))),
ids AS (SELECT * FROM p WHERE kind IN ('id', 'access')), secret AS (SELECT * FROM weak UNION ALL SELECT * FROM p WHERE kind IN ('assign', 'hex')), named AS (SELECT * FROM p WHERE kind = 'id'), ends AS (SELECT * FROM p WHERE kind = 'endpoint'),
s AS (SELECT rid, kind, start, stop FROM p WHERE kind IN {base} UNION ALL SELECT rid, 'link_id', start, stop FROM named WHERE {near('named', 'secret')}
UNION ALL SELECT rid, 'link_secret', start, stop FROM weak WHERE {near('weak', 'ids')} UNION ALL SELECT rid, 'link_endpoint', start, stop FROM ends WHERE {near('ends', 'ids')} AND {near('ends', 'secret')}),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {written} AS spans, {written} FILTER (kind IN {base}) AS base FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


def neardup_sql() -> str:
    n = neardup.SIZE
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN c ca ON ca.doc_id = a.doc_id JOIN c cb ON cb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, ca.n, cb.n HAVING {neardup.SHARE} * count(*) >= {neardup.PART} * (ca.n + cb.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)"""


def sharding_sql(shards: int) -> str:
    """For equal weights: the largest draw wins, and the first of equal ones."""
    of = lambda n: f"list_transform(range({n}), lambda k: ('0x' || substring(md5(key || '#' || k), 1, 13))::BIGINT)"
    best = lambda x: f"(list_position({x}, list_max({x})) - 1)::INT"
    part = f"('0x' || substring(md5(coalesce(doc_id::VARCHAR, '-') || '|' || size || '|' || text_crc32 || '|key|' || grown_shard), 1, 8))::BIGINT % {sharding.PARTS}"
    return f"""WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, chr(0)) AS key, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
x AS (SELECT doc_id, len(bytes) + 8 AS size, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32, {of(shards)} AS a, {of(shards + 1)} AS b FROM d, tab),
s AS (SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, {best("a")} AS shard, {best("b")} AS grown_shard FROM x)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY {part}, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard FROM s"""


def fim_sql() -> str:
    p, s, m = (_quoted(x) for x in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    any_mark = " OR ".join(f"contains(t, {x})" for x in (p, s, m))
    at = lambda x: f"strpos(o, {x})"
    behind = lambda x: f"substr(o, strpos(o, {x}) + length({x}))"
    between = lambda x, y: f"substr(o, {at(x)} + length({x}), {at(y)} - {at(x)} - length({x}))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, least({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS a, greatest({draw(0)} % (n + 1), {draw(1)} % (n + 1)) AS b, CASE WHEN t = '' OR {any_mark} OR {draw(2)} % 100 >= {fim.RATE} THEN 'plain' WHEN {draw(3)} % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || pre || {s} || suf || {m} || mid ELSE {s} || suf || {p} || pre || {m} || mid END AS o FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(o) AS output_sha256,
sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN {between(p, s)} || {behind(m)} || {between(s, m)} ELSE {between(p, m)} || {behind(m)} || {between(s, p)} END) AS restored_sha256 FROM o"""


def manifest_sql(levels: int = 8) -> str:
    """Trees of at most FANOUT ** levels leaves."""
    f = manifest.FANOUT
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(text if x == "text" else field(x) for x in manifest.FIELDS) + ")"
    lower = field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = """(xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295))"""
    join = lambda xs: f"coalesce(array_to_string({xs}, ''), '')"

    def tower(name: str) -> str:
        """name0 (gid, at, size, digest) to name0..levels, and the runs of each."""
        out = []
        for k in range(levels):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT gid, pos // {f} AS up, list(digest ORDER BY pos) AS run, any_value(size) AS size FROM {name}{k} WHERE size > 1 GROUP BY gid, pos // {f})")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT gid, up AS pos, (size + {f - 1}) // {f} AS size, sha256({join('run')}) AS digest FROM {name}r{k})")
        return ",\n".join(out)

    def climb(name: str, start: str, size: str, at: str, gid: str) -> str:
        """Lists of what stands left and right of a row's ancestors, level by level."""
        out, last = [], start
        for k in range(levels):
            place = f"{last}.{at} // {f**k} % {f}"
            out.append(f"{name}c{k} AS (SELECT {last}.*, coalesce({join(f'run[1:{place}]')}, '') AS {name}left{k}, coalesce({join(f'run[{place} + 2:]')}, '') AS {name}right{k} FROM {last} LEFT JOIN {name}r{k} r ON r.gid = {last}.{gid} AND r.up = {last}.{at} // {f ** (k + 1)} AND r.size > 1)")
            last = f"{name}c{k}"
        return ",\n".join(out)

    steps, cols, last = [], [], "v0"
    for name, size in (("n", "size"), ("t", "tsize")):
        for k in range(levels):
            new = f"{name}v{k}"
            steps.append(f"{new} AS (SELECT * REPLACE (CASE WHEN {size} > {f**k} THEN sha256({name}left{k} || v || {name}right{k}) ELSE v END AS v) FROM {last})")
            cols.append(f"{name}left{k} || {name}right{k}")
            last = new
    folds = ",\n".join(steps)
    return f"""WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce('+' || source, '') AS gid, {leaf(field('text'))} AS digest, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents, tab),
n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY gid) AS size FROM d),
{tower('n')},
g AS ({' UNION ALL '.join(f'SELECT gid, digest FROM n{k} WHERE size = 1' for k in range(levels + 1))}),
t0 AS MATERIALIZED (SELECT '' AS gid, gid AS source_gid, row_number() OVER (ORDER BY gid) - 1 AS pos, count(*) OVER () AS size, digest FROM g),
{tower('t')},
root AS ({' UNION ALL '.join(f'SELECT digest AS root FROM t{k} WHERE size = 1' for k in range(levels + 1))}),
{climb('n', 'n0', 'size', 'pos', 'gid')},
top AS (SELECT nc{levels - 1}.*, t0.pos AS tpos, t0.size AS tsize, t0.digest AS subroot, '' AS tgid FROM nc{levels - 1} JOIN t0 ON t0.source_gid = nc{levels - 1}.gid),
{climb('t', 'top', 'tsize', 'tpos', 'tgid')},
v0 AS (SELECT *, coalesce(tampered, digest) AS v FROM tc{levels - 1}),
{folds}
SELECT doc_id, digest AS leaf, subroot, root, sha256({' || '.join(cols)}) AS proof_sha256, v AS folded_root, v = root AS verified FROM {last}, root"""


def mixing_sql() -> str:
    """Which blocks are taken how often; the order of the slots does not matter to the result."""
    w = ", ".join(f"{x}::DOUBLE" for x in mixing.WEIGHTS)
    blocks = lambda s: f"greatest(ceil({s} / {mixing.BLOCK}.0::DOUBLE)::BIGINT, least({s}, {mixing.FINE}))"
    block_of = lambda p: f"CASE WHEN {p} < longer * (q + 1) THEN ({p}) // (q + 1) ELSE longer + ({p} - longer * (q + 1)) // q END"
    edge = lambda b: f"(({b}) * q + least({b}, longer))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || source, '-') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{mixing.SEED}-' || coalesce(doc_id::VARCHAR, '-')) AS h FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY src = '-', src) - 1 AS ordinal FROM s),
w AS (SELECT *, [{w}][ordinal % {len(mixing.WEIGHTS)} + 1] AS weight, {mixing.EPOCHS}.0::DOUBLE * source_size AS most FROM o),
r AS (SELECT *, coalesce(sum(most) OVER f, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS free FROM w WINDOW f AS (ORDER BY most / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, ({mixing.BUDGET}::DOUBLE * (SELECT sum(source_size) FROM s) - full_before) / free AS level FROM r),
l AS (SELECT arg_min(level, most / weight) AS level FROM c WHERE level < most / weight),
p AS (SELECT *, least(most, weight * level) AS target, {blocks('source_size')} AS blocks FROM w, l),
n AS (SELECT *, floor(target * blocks / greatest(source_size, 1) + 0.5)::BIGINT AS slots FROM p),
b AS (SELECT src, blocks, slots, unnest(range(blocks)) AS block FROM n),
e AS (SELECT src, block, blocks, slots, epoch, row_number() OVER (PARTITION BY src, epoch ORDER BY md5('{mixing.SEED}-' || src || '-' || epoch || '-' || block), block) - 1 AS rank FROM b, range({mixing.EPOCHS}) x(epoch)),
k AS (SELECT src, block, count(*) AS times FROM e WHERE epoch * blocks + rank < slots GROUP BY 1, 2),
x AS (SELECT rid, d.src, size, source_size // blocks AS q, source_size % blocks AS longer, sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id, size, rid) - size AS start FROM d JOIN n ON n.src = d.src WHERE size > 0),
y AS (SELECT *, unnest(range(({block_of('start')})::BIGINT, ({block_of('start + size - 1')})::BIGINT + 1)) AS block FROM x),
t AS (SELECT rid, sum(times * (least(start + size, {edge('y.block + 1')}) - greatest(start, {edge('y.block')})))::BIGINT AS taken FROM y JOIN k ON k.src = y.src AND k.block = y.block GROUP BY 1)
SELECT d.doc_id, d.size, n.source_size, round(n.target, 6) AS target, coalesce(taken, 0) AS taken FROM d JOIN n ON n.src = d.src LEFT JOIN t ON t.rid = d.rid"""
