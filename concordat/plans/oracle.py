"""SQL twins of the queries, for DuckDB over the same tables. Written from the rules, not from the DataFrame code."""

from __future__ import annotations

import re

from .fixtures import BASE_TIME, states_sql
from .queries import BLOOM_RATE, NOW

COLS = "drive_id, path, hash, size, mtime, version_vector, tombstone, corrupted, inode"


def _json(a: str, b: str, c: str) -> str:
    return f"""('{{' || concat_ws(',', CASE WHEN {a} > 0 THEN '"drive_a":' || {a} END, CASE WHEN {b} > 0 THEN '"drive_b":' || {b} END, CASE WHEN {c} > 0 THEN '"drive_c":' || {c} END) || '}}')"""


def _ahead(x: str, y: str) -> str:
    return f"({x}.a > {y}.a OR {x}.b > {y}.b OR {x}.c > {y}.c)"


def _dom(x: str, y: str) -> str:
    return f"({_ahead(x, y)} AND NOT {_ahead(y, x)})"


def _conc(x: str, y: str) -> str:
    return f"({_ahead(x, y)} AND {_ahead(y, x)})"


def _conflicts(fs: str = "fs") -> str:
    return f"""
pairs AS (SELECT x.path FROM {fs} x JOIN {fs} y ON x.path = y.path AND x.drive_id < y.drive_id
  WHERE {_conc('x', 'y')} OR ({_dom('x', 'y')} AND NOT x.tombstone AND y.tombstone) OR ({_dom('y', 'x')} AND NOT y.tombstone AND x.tombstone)),
cv AS (SELECT * FROM {fs} WHERE path IN (SELECT path FROM pairs))"""


def _resolve(fs: str = "fs") -> str:
    return (
        _conflicts(fs)
        + f""",
dom AS (SELECT path, min(drive_id) AS w FROM cv x WHERE NOT EXISTS (SELECT 1 FROM cv y WHERE y.path = x.path AND {_ahead('y', 'x')}) GROUP BY path),
quo AS (SELECT path, min(w) AS w, min(hash) AS hash, min(n) AS n FROM (SELECT path, hash, min(drive_id) AS w, count(*) AS n FROM cv WHERE NOT tombstone GROUP BY path, hash HAVING count(*) * 2 > (SELECT count(*) FROM drives)) GROUP BY path),
tom AS (SELECT path, min(drive_id) AS w FROM cv WHERE tombstone GROUP BY path),
lww AS (SELECT path, arg_min(drive_id, drive_id) AS w, max(mtime) AS t FROM cv x WHERE mtime > 0 AND mtime = (SELECT max(mtime) FROM cv y WHERE y.path = x.path) GROUP BY path),
res AS (SELECT p.path, coalesce(dom.w, quo.w, tom.w, lww.w, '') AS winner,
  CASE WHEN dom.w IS NOT NULL THEN 'DOMINANT_VERSION' WHEN quo.w IS NOT NULL THEN 'MAJORITY_QUORUM' WHEN tom.w IS NOT NULL THEN 'TOMBSTONE_WINS' WHEN lww.w IS NOT NULL THEN 'LAST_WRITE_WINS' ELSE 'COPY_ALL_VERSIONS' END AS strategy,
  CASE WHEN dom.w IS NOT NULL THEN 'Selected dominant version from drive ' || dom.w
    WHEN quo.w IS NOT NULL THEN 'Quorum: ' || quo.n || '/' || (SELECT count(*) FROM drives) || ' drives agree on ' || quo.hash || '; Version vectors merged to reflect resolution'
    WHEN tom.w IS NOT NULL THEN 'Tombstone from drive ' || tom.w || ' wins for ' || p.path
    WHEN lww.w IS NOT NULL THEN 'Last-write-wins: drive ' || lww.w || ' mtime=' || lww.t ELSE 'Preserving all versions of ' || p.path END AS actions
  FROM (SELECT DISTINCT path FROM pairs) p LEFT JOIN dom USING (path) LEFT JOIN quo USING (path) LEFT JOIN tom USING (path) LEFT JOIN lww USING (path))"""
    )


def _renames(fs: str = "fs") -> str:
    return f"""
ren0 AS (SELECT t.drive_id AS target_drive, t.path AS old_path, s.path AS new_path, s.drive_id AS src FROM {fs} s JOIN {fs} t ON s.hash = t.hash AND s.drive_id <> t.drive_id AND s.path <> t.path
  WHERE NOT s.tombstone AND NOT t.tombstone AND NOT EXISTS (SELECT 1 FROM {fs} n WHERE n.drive_id = t.drive_id AND n.path = s.path AND NOT n.tombstone)
  AND EXISTS (SELECT 1 FROM {fs} o WHERE o.drive_id = s.drive_id AND o.path = t.path AND o.tombstone)),
ren AS (SELECT target_drive, old_path, new_path FROM ren0 QUALIFY row_number() OVER (PARTITION BY target_drive, old_path ORDER BY src DESC, new_path DESC) = 1)"""


def _ops(scope: str = "reference", fs: str = "fs") -> str:
    if scope == "reference":
        win = f"""wins AS (SELECT winner, min(path) AS p FROM res WHERE winner <> '' GROUP BY winner),
app AS (SELECT x.path, x.drive_id, w.p FROM {fs} x JOIN wins w ON w.winner = x.drive_id WHERE EXISTS (SELECT 1 FROM {fs} y WHERE y.path = x.path AND y.drive_id <> x.drive_id AND {_conc('x', 'y')}))"""
    else:
        win = f"""app AS (SELECT x.path, x.drive_id, x.path AS p FROM {fs} x JOIN res w ON w.winner = x.drive_id AND w.path = x.path WHERE EXISTS (SELECT 1 FROM {fs} y WHERE y.path = x.path AND y.drive_id <> x.drive_id AND {_conc('x', 'y')}))"""
    return f"""{_resolve(fs)},
{_renames(fs)},
{win},
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY drive_id) AS rn FROM {fs}),
f1 AS (SELECT * FROM ranked WHERE rn = 1),
f2 AS (SELECT f1.path, CASE WHEN y.path IS NOT NULL AND {_dom('y', 'f1')} THEN y.drive_id ELSE f1.drive_id END AS drive_id FROM f1 LEFT JOIN ranked y ON y.path = f1.path AND y.rn = 2),
h2 AS (SELECT r.* FROM f2 JOIN {fs} r ON r.path = f2.path AND r.drive_id = f2.drive_id),
fold AS (SELECT h2.path, CASE WHEN z.path IS NOT NULL AND {_dom('z', 'h2')} THEN z.drive_id ELSE h2.drive_id END AS drive_id FROM h2 LEFT JOIN ranked z ON z.path = h2.path AND z.rn = 3),
picked AS (SELECT path, arg_min(drive_id, p) AS drive_id FROM app GROUP BY path),
src AS (SELECT r.*, m.ma, m.mb, m.mc FROM fold LEFT JOIN picked USING (path) JOIN {fs} r ON r.path = fold.path AND r.drive_id = coalesce(picked.drive_id, fold.drive_id)
  JOIN (SELECT path, max(a) AS ma, max(b) AS mb, max(c) AS mc FROM {fs} GROUP BY path) m ON m.path = r.path),
quorum AS (SELECT path, min(drive_id) AS drive_id, max(a) AS ma, max(b) AS mb, max(c) AS mc FROM {fs} WHERE tombstone GROUP BY path HAVING count(*) * 2 > (SELECT count(*) FROM drives)),
handled AS (SELECT target_drive, old_path AS path FROM ren UNION SELECT target_drive, new_path FROM ren),
fileops AS (
  SELECT 'REMOVE' AS type, q.drive_id AS source_drive, t.drive_id AS target_drive, q.path, {_json('q.ma', 'q.mb', 'q.mc')} AS version_vector FROM quorum q JOIN {fs} t ON t.path = q.path AND NOT t.tombstone
  UNION ALL
  SELECT CASE WHEN s.tombstone THEN CASE WHEN t.path IS NOT NULL AND NOT t.tombstone THEN 'REMOVE' END
      WHEN t.path IS NULL OR t.tombstone THEN 'COPY'
      WHEN {_dom('s', 't')} OR s.hash <> t.hash THEN 'REPLACE' END, s.drive_id, d.drive_id, s.path, {_json('s.ma', 's.mb', 's.mc')}
  FROM src s CROSS JOIN drives d LEFT JOIN {fs} t ON t.path = s.path AND t.drive_id = d.drive_id
  WHERE d.drive_id <> s.drive_id AND s.path NOT IN (SELECT path FROM quorum)),
renv AS (SELECT r.*, (SELECT min(s.drive_id) FROM {fs} s WHERE s.path = r.new_path AND NOT s.tombstone AND s.drive_id <> r.target_drive) AS source_drive,
  (SELECT struct_pack(a := max(a), b := max(b), c := max(c)) FROM {fs} v WHERE v.path IN (r.old_path, r.new_path)) AS v FROM ren r),
ops AS (
  SELECT 'RENAME' AS type, source_drive, target_drive, old_path AS path, new_path, {_json('v.a', 'v.b', 'v.c')} AS version_vector FROM renv
  UNION ALL
  SELECT type, source_drive, target_drive, path, CAST(NULL AS VARCHAR), version_vector FROM fileops o
  WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM handled h WHERE h.target_drive = o.target_drive AND h.path = o.path))"""


_DIRS = """
keyed AS (SELECT *, CASE type WHEN 'RENAME' THEN 0 ELSE 1 END AS phase, CASE type WHEN 'RENAME' THEN target_drive ELSE path END AS k1, CASE type WHEN 'RENAME' THEN path ELSE target_drive END AS k2 FROM ops),
need AS (SELECT target_drive, phase, k1, k2, string_split(coalesce(new_path, path), '/') AS parts FROM keyed WHERE type IN ('COPY', 'RENAME')),
need2 AS (SELECT target_drive, phase, k1, k2, array_to_string(parts[1:n], '/') AS dir, len(parts) - 1 - n AS sub FROM need, unnest(range(1, len(parts))) AS u(n)),
dirs AS (SELECT target_drive, dir, min(struct_pack(phase := phase, k1 := k1, k2 := k2, sub := CAST(sub AS BIGINT))) AS key FROM need2 GROUP BY target_drive, dir)"""

_PLAN = (
    _DIRS
    + """,
allops AS (SELECT type, source_drive, target_drive, path, new_path, version_vector, struct_pack(phase := phase, k1 := k1, k2 := k2, sub := CAST(1073741824 AS BIGINT)) AS key FROM keyed
  UNION ALL SELECT 'MKDIR', '', target_drive, dir, NULL, '{}', key FROM dirs),
numbered AS (SELECT *, row_number() OVER (ORDER BY key) AS idx FROM allops),
mk AS (SELECT target_drive, path, idx FROM numbered WHERE type = 'MKDIR'),
chained AS (SELECT n.type, n.source_drive, n.target_drive, n.path, n.new_path, n.version_vector, n.idx,
  coalesce((SELECT list(m.idx ORDER BY length(m.path)) FROM mk m WHERE m.target_drive = n.target_drive AND starts_with(n.path, m.path || '/')), []) AS chain FROM numbered n),
seqd AS (SELECT *, row_number() OVER (ORDER BY len(chain), chain, idx) AS s FROM chained),
kept AS (SELECT * FROM seqd QUALIFY row_number() OVER (PARTITION BY target_drive, path ORDER BY s DESC) = 1),
plan AS (SELECT row_number() OVER (ORDER BY s) AS seq, type, source_drive, target_drive, path, new_path, version_vector FROM kept)"""
)

_APPLIED = """
applied AS (
  SELECT o.target_drive AS drive_id, o.path, s.hash, s.size, s.mtime, o.version_vector, s.tombstone, s.corrupted, s.inode FROM ops o JOIN fs s ON s.drive_id = o.source_drive AND s.path = o.path WHERE o.type IN ('COPY', 'REPLACE')
  UNION ALL SELECT t.drive_id, t.path, t.hash, t.size, t.mtime, o.version_vector, true, t.corrupted, t.inode FROM ops o JOIN fs t ON t.drive_id = o.target_drive AND t.path = o.path WHERE o.type = 'REMOVE'
  UNION ALL SELECT t.drive_id, o.new_path, t.hash, t.size, t.mtime, o.version_vector, t.tombstone, t.corrupted, t.inode FROM ops o JOIN fs t ON t.drive_id = o.target_drive AND t.path = o.path WHERE o.type = 'RENAME'),
after AS (SELECT * FROM applied UNION ALL SELECT drive_id, path, hash, size, mtime, version_vector, tombstone, corrupted, inode FROM fs f
  WHERE NOT EXISTS (SELECT 1 FROM applied p WHERE p.drive_id = f.drive_id AND p.path = f.path)
  AND NOT EXISTS (SELECT 1 FROM ops o WHERE o.type = 'RENAME' AND o.target_drive = f.drive_id AND o.path = f.path))"""

_LISTING = f"""
listing AS (SELECT drive_id, path, size, CASE WHEN doc_id % 13 = 0 THEN mtime + 60 ELSE mtime END AS mtime, hash AS content_hash FROM fs WHERE drive_id = 'drive_b' AND NOT tombstone AND doc_id % 11 <> 0
  UNION ALL SELECT 'drive_b', '.hidden/' || path, size, {BASE_TIME} + doc_id, h1 FROM docs WHERE doc_id % 7 = 0),
visible AS (SELECT * FROM listing WHERE NOT regexp_matches(path, '(^|/)[.]')),
hashed AS (SELECT v.drive_id, v.path, v.size, v.mtime, coalesce(CASE WHEN f.hash <> '' AND f.size = v.size AND f.mtime = v.mtime THEN f.hash END, v.content_hash) AS hash,
  coalesce(f.hash <> '' AND f.size = v.size AND f.mtime = v.mtime, false) AS hit FROM visible v LEFT JOIN fs f ON f.drive_id = v.drive_id AND f.path = v.path),
gone AS (SELECT f.* FROM fs f WHERE f.drive_id = 'drive_b' AND NOT f.tombstone AND NOT EXISTS (SELECT 1 FROM visible v WHERE v.path = f.path))"""

_TOMBED = f"""SELECT drive_id, path, hash, size, mtime, {_json('a', '(b + 1)', 'c')} AS version_vector, true AS tombstone, corrupted, inode FROM gone"""

_DISK = """
disk AS (SELECT drive_id, path, CASE WHEN corrupted THEN sha256(hash || '!') ELSE hash END AS actual FROM fs WHERE NOT tombstone AND (doc_id % 17 <> 0 OR drive_id <> 'drive_c')),
checked AS (SELECT f.drive_id, f.path, coalesce(d.actual = f.hash, false) AS ok, f.corrupted OR NOT coalesce(d.actual = f.hash, false) AS corrupted FROM fs f LEFT JOIN disk d ON d.drive_id = f.drive_id AND d.path = f.path WHERE NOT f.tombstone)"""


def _again() -> str:
    """The plan over the states after the first plan: the same CTEs once more, each name with a 2."""
    text = _ops(fs="fs2") + ",\n" + _PLAN
    names = re.findall(r"(?:^|,\s*|\n)(\w+) AS \(SELECT|\n(fileops|ops|allops|res|ren0) AS", text)
    own = sorted({n for pair in names for n in pair if n})
    clock = ", ".join(f"coalesce(CAST(json_extract(version_vector, '$.drive_{x}') AS BIGINT), 0) AS {x}" for x in "abc")
    return f"fs2 AS (SELECT *, {clock} FROM after),\n" + re.sub(rf"\b({'|'.join(own)})\b", r"\g<1>2", text)


def _merkle() -> str:
    """One aggregation a level: the paths of the fixture are at most four segments deep."""
    out = """
leaf AS (SELECT drive_id, path, 0 AS level, hash, len(string_split(path, '/')) AS depth FROM fs WHERE NOT tombstone)"""
    below = "leaf"
    for depth in (4, 3, 2, 1):
        parent = "'.'" if depth == 1 else "regexp_replace(path, '/[^/]*$', '')"
        extra = f" UNION ALL SELECT * FROM d{depth}" if depth < 4 else ""
        out += f""",
d{depth - 1} AS (SELECT drive_id, {parent} AS path, 1 AS level, sha256(string_agg(hash, '' ORDER BY hash)) AS hash, {depth - 1} AS depth FROM (SELECT * FROM {below} WHERE depth = {depth}{extra}) GROUP BY 1, 2)"""
    return out + """,
nodes AS (SELECT drive_id, path, level, hash FROM leaf UNION ALL SELECT drive_id, path, level, hash FROM d3 UNION ALL SELECT drive_id, path, level, hash FROM d2 UNION ALL SELECT drive_id, path, level, hash FROM d1 UNION ALL SELECT drive_id, path, level, hash FROM d0)"""


def oracle_sql() -> dict[str, str]:
    base = "WITH " + states_sql()
    sel = lambda *ctes, body: ",\n".join([base, *ctes]) + "\n" + body
    log = "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'WRITE' ELSE upper(event_type) END AS operation, 'f/' || event_id AS path, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id % 5 <> 0 AS completed FROM events"
    fnv = "list_reduce(list_prepend(off, list_transform(range(1, length(path) + 1), lambda i: CAST(ascii(path[i]) AS HUGEINT))), lambda h, x: (CAST(xor(h, x) AS HUGEINT) * 1099511628211) % 18446744073709551616)"
    return {
        "drive_status": sel(body="SELECT d.drive_id, count(f.path) AS n_files, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS total_size FROM drives d LEFT JOIN fs f ON f.drive_id = d.drive_id AND NOT f.tombstone GROUP BY d.drive_id"),
        "drive_register": f"SELECT * FROM (VALUES ('drive_a', CAST({BASE_TIME} AS BIGINT)), ('drive_b', {NOW}), ('drive_c', {NOW + 1}), ('drive_z', {NOW})) t(drive_id, last_seen)",
        "manifest_lookup": sel(body=f"SELECT {COLS} FROM fs WHERE path IN (SELECT path FROM docs UNION ALL SELECT path || '.absent' FROM docs)"),
        "manifest_upsert": sel("new AS (SELECT 'drive_b' AS drive_id, path, hash, size, mtime + 1 AS mtime, version_vector, tombstone, corrupted, inode FROM fs WHERE drive_id = 'drive_a')", body=f"SELECT * FROM new UNION ALL SELECT {COLS} FROM fs WHERE drive_id <> 'drive_b' OR path NOT IN (SELECT path FROM new)"),
        "vv_compare": sel(body=f"SELECT x.path, x.drive_id, y.drive_id AS other, CASE WHEN {_conc('x', 'y')} THEN 'CONCURRENT' WHEN {_ahead('x', 'y')} THEN 'DOMINATES' WHEN {_ahead('y', 'x')} THEN 'DOMINATED_BY' ELSE 'EQUAL' END AS ordering FROM fs x JOIN fs y USING (path)"),
        "vv_merge": sel(body=f"SELECT x.path, x.drive_id, y.drive_id AS other, {_json('greatest(x.a, y.a)', 'greatest(x.b, y.b)', 'greatest(x.c, y.c)')} AS merged FROM fs x JOIN fs y USING (path)"),
        "vv_increment": sel("up AS (SELECT *, a + CAST(drive_id = 'drive_a' AS BIGINT) AS na, b + CAST(drive_id = 'drive_b' AS BIGINT) AS nb, c + CAST(drive_id = 'drive_c' AS BIGINT) AS nc FROM fs)", body=f"SELECT path, drive_id, {_json('na', 'nb', 'nc')} AS next, CASE drive_id WHEN 'drive_a' THEN a WHEN 'drive_b' THEN b ELSE c END AS clock FROM up"),
        "vv_canonical_json": sel(body="""SELECT path, drive_id, CASE WHEN version_vector = '{}' THEN '{}' ELSE version_vector[:length(version_vector) - 1] || ',"z\\"k\\\\":3}' END AS canonical FROM fs"""),
        "vv_malformed": sel("""f(drive_id, path, form, t) AS (SELECT drive_id, path, 0, version_vector FROM fs UNION ALL SELECT drive_id, path, 1, version_vector[:length(version_vector) - 1] FROM fs
  UNION ALL SELECT drive_id, path, 2, replace(version_vector, ':', ':-') FROM fs UNION ALL SELECT drive_id, path, 3, replace(version_vector, ':', ':"x",') FROM fs UNION ALL SELECT drive_id, path, 4, '[' || version_vector || ']' FROM fs)""",
            body="""SELECT drive_id, path, form, CASE WHEN NOT json_valid(t) THEN true ELSE json_type(t) <> 'OBJECT' OR contains(CAST(list_transform(json_keys(t), lambda k: json_type(t, '$."' || k || '"') <> 'UBIGINT') AS VARCHAR), 'true') END AS malformed FROM f"""),
        "detect_conflicts": sel(_conflicts(), body="SELECT path, string_agg(drive_id, ',' ORDER BY drive_id) AS drives, count(*) AS n_versions, 'MANUAL_RESOLUTION' AS recommended_strategy FROM cv GROUP BY path"),
        "resolve_conflicts": sel(_resolve(), body="SELECT * FROM res"),
        "quorum_vote": sel(body="SELECT path, hash, count(*) AS votes, min(drive_id) AS first_drive FROM fs WHERE NOT tombstone GROUP BY path, hash HAVING count(*) * 2 > (SELECT count(*) FROM drives)"),
        "last_write_wins": sel(body="SELECT path, drive_id AS winner, mtime FROM fs WHERE mtime > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC, drive_id) = 1"),
        "manual_resolve": sel(_conflicts(), f"v AS (SELECT path, max(a) AS ma, max(b) + 1 AS mb, max(c) AS mc FROM fs GROUP BY path), won AS (SELECT d.drive_id, f.path, hash, size, mtime, {_json('ma', 'mb', 'mc')} AS version_vector, tombstone, corrupted, inode FROM fs f JOIN v USING (path) CROSS JOIN drives d WHERE f.drive_id = 'drive_b' AND f.path IN (SELECT path FROM pairs))", body=f"SELECT * FROM won UNION ALL SELECT {COLS} FROM fs WHERE path NOT IN (SELECT path FROM won)"),
        "hidden_filter": sel(_LISTING, body="SELECT drive_id, path, size, mtime FROM visible"),
        "hash_cache": sel(_LISTING, body="SELECT * FROM hashed"),
        "scan_manifest": sel(_LISTING, body=f"SELECT h.drive_id, h.path, h.hash, h.size, h.mtime, coalesce(f.version_vector, '{{}}') AS version_vector, false AS tombstone, coalesce(f.corrupted, false) AS corrupted, f.inode FROM hashed h LEFT JOIN fs f ON f.drive_id = h.drive_id AND f.path = h.path UNION ALL {_TOMBED} UNION ALL SELECT {COLS} FROM fs f WHERE drive_id <> 'drive_b' OR (tombstone AND NOT EXISTS (SELECT 1 FROM visible v WHERE v.path = f.path))"),
        "tombstone_vanished": sel(_LISTING, body=_TOMBED),
        "scan_errors": sel(_LISTING, body="SELECT drive_id, path, 'hash: cannot read ' || path AS reason FROM visible WHERE size % 7 = 0"),
        "path_normalize": sel(body="SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS parent, true AS hidden FROM docs"),
        "ancestor_dirs": sel(body="SELECT doc_id, CAST(u AS INTEGER) AS up, array_to_string(p[1:len(p) - 1 - u], '/') AS dir FROM (SELECT doc_id, string_split(path, '/') AS p FROM docs), unnest(range(0, len(p) - 1)) AS t(u)"),
        "perm_octal": """WITH m AS (SELECT doc_id, list_transform([doc_id // 100 % 10, doc_id // 10 % 10, doc_id % 10], lambda x: CASE WHEN x > 7 THEN 0 ELSE x END) AS g FROM documents)
SELECT doc_id, CAST(g[1] AS VARCHAR) || g[2] || g[3] AS mode, (g[1] & 2) > 0 AS owner_write, (g[3] & 1) > 0 AS others_exec FROM m""",
        "drive_id_clean": "SELECT doc_id, 'mnt' || source || 'x' AS drive, 'drive' AS fallback FROM documents",
        "format_size": sel(body="""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.2f GB', n / 1073741824) END AS shown FROM (SELECT doc_id, CAST(size * 4 * CAST(pow(1024, doc_id % 3) AS BIGINT) AS BIGINT) AS n FROM docs)"""),
        "merkle_nodes": sel(_merkle(), body="SELECT * FROM nodes"),
        "merkle_diff": sel(_merkle(), """
l AS (SELECT coalesce(x.path, y.path) AS path, x.hash AS h1, y.hash AS h2 FROM (SELECT * FROM nodes WHERE drive_id = 'drive_b' AND level = 0) x FULL JOIN (SELECT * FROM nodes WHERE drive_id = 'drive_c' AND level = 0) y ON x.path = y.path),
same AS (SELECT x.path FROM nodes x JOIN nodes y USING (path) WHERE x.drive_id = 'drive_b' AND y.drive_id = 'drive_c' AND x.level = 1 AND y.level = 1 AND x.hash = y.hash)""", body="SELECT path, CASE WHEN h1 IS NULL THEN 'added' WHEN h2 IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM l WHERE h1 IS DISTINCT FROM h2 AND NOT EXISTS (SELECT 1 FROM same WHERE same.path = '.' OR starts_with(l.path, same.path || '/'))"),
        "detect_renames": sel(_renames(), body="SELECT * FROM ren"),
        "tombstone_quorum": sel(body="SELECT path, count(*) AS n_tombstones FROM fs WHERE tombstone GROUP BY path HAVING count(*) * 2 > (SELECT count(*) FROM drives)"),
        "dominant_source": sel(_ops(), body=f"SELECT f.path, f.drive_id AS source_drive, {_json('s.ma', 's.mb', 's.mc')} AS merged FROM fold f JOIN src s USING (path)"),
        "plan_ops": sel(_ops(), body="SELECT * FROM ops"),
        "plan_ops_path_scope": sel(_ops("path"), body="SELECT * FROM ops"),
        "plan_mkdirs": sel(_ops(), _DIRS, body="SELECT target_drive, dir AS path FROM dirs"),
        "sync_plan": sel(_ops(), _PLAN, body="SELECT * FROM plan"),
        "plan_summary": sel(_ops(), _PLAN, body="SELECT p.type, count(*) AS n_ops, CAST(coalesce(sum(f.size) FILTER (p.type IN ('COPY', 'REPLACE')), 0) AS BIGINT) AS total_bytes FROM plan p LEFT JOIN fs f ON f.drive_id = p.source_drive AND f.path = p.path GROUP BY p.type"),
        "apply_plan": sel(_ops(), _APPLIED, body="SELECT * FROM after"),
        "replan_after_apply": sel(_ops(), _APPLIED, _again(), body="SELECT type, count(*) AS n_ops FROM plan2 GROUP BY type"),
        "verify_files": sel(_DISK, body="SELECT * FROM checked"),
        "corrupt_count": sel(_DISK, body="SELECT drive_id, count(*) FILTER (NOT ok) AS n_corrupt FROM checked GROUP BY drive_id"),
        "restore_candidates": sel(_DISK, body="SELECT w.drive_id, w.path, (SELECT min(o.drive_id) FROM fs o JOIN disk d ON d.drive_id = o.drive_id AND d.path = o.path AND d.actual = o.hash WHERE o.path = w.path AND o.drive_id <> w.drive_id AND NOT o.tombstone AND o.hash = f.hash) AS replica FROM checked w JOIN fs f ON f.drive_id = w.drive_id AND f.path = w.path WHERE NOT w.ok"),
        "incomplete_ops": f"SELECT * FROM ({log}) WHERE NOT completed",
        "recover_log": f"""SELECT id, path, CASE WHEN operation <> 'WRITE' OR id % 3 = 0 THEN 'NONE' WHEN id % 2 = 0 THEN 'PROMOTE' ELSE 'DISCARD' END AS decision FROM ({log}) WHERE NOT completed""",
        "chunk_pages": "SELECT page_id, CAST(0 AS BIGINT) AS offset, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, sha256(coalesce(html, '')) AS hash FROM pages",  # all below the threshold
        "bloom_sizing": """SELECT CAST(n AS BIGINT) AS items, CAST(p AS DOUBLE) AS rate, CAST(CASE WHEN n = 0 THEN 1 ELSE ceil(-n * ln(p) / (ln(2) * ln(2))) END AS BIGINT) AS bits,
CAST(CASE WHEN n = 0 THEN 1 ELSE greatest(1, round(ceil(-n * ln(p) / (ln(2) * ln(2))) / n * ln(2))) END AS BIGINT) AS hashes, CAST(ceil(CASE WHEN n = 0 THEN 1 ELSE ceil(-n * ln(p) / (ln(2) * ln(2))) END / 8) AS BIGINT) AS bytes
FROM (VALUES (0), (1), (500), (1000), (1000000)) a(n), (VALUES (0.001), (0.01), (0.05)) b(p)""",
        "bloom_membership": sel(f"""
z AS (SELECT CAST(ceil(-count(*) * ln({BLOOM_RATE}) / (ln(2) * ln(2))) AS BIGINT) AS m, count(*) AS n FROM fs WHERE drive_id = 'drive_c'),
seeds AS (SELECT i, m, CAST(xor(CAST(14695981039346656037 AS HUGEINT), CAST(i * 2654435761 AS HUGEINT)) AS HUGEINT) AS off FROM z, unnest(range(0, CAST(greatest(1, round(m / n * ln(2))) AS BIGINT))) AS t(i)),
pos AS (SELECT path, {fnv} % m AS p FROM (SELECT DISTINCT path FROM fs), seeds),
bits AS (SELECT DISTINCT p FROM pos WHERE path IN (SELECT path FROM fs WHERE drive_id = 'drive_c'))""", body="SELECT path AS item, bool_and(bits.p IS NOT NULL) AS might_contain FROM pos LEFT JOIN bits USING (p) GROUP BY path"),
    }
