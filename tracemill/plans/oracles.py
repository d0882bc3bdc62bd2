"""DuckDB statements that replay traces independently of Spark: recursive CTEs with list state.

Each recursion step is one access a shard; with unit weights at most one entry
leaves, so evictions have closed forms instead of inner loops.
"""

from __future__ import annotations

import re

SHARDS, CAPACITY = 8, 80
PER_SHARD = CAPACITY // SHARDS

#: Numbered accesses: (shard, i, seq, key, op, w, low, phantom)
TRACE = f"""
t AS (
  SELECT user_id % {SHARDS} AS shard, row_number() OVER (PARTITION BY user_id % {SHARDS} ORDER BY event_id) AS i, event_id AS seq, user_id AS key,
    CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type IN ('purchase', 'signup') THEN 'insert' ELSE 'get_or_fetch' END AS op,
    CAST(ceil(value) AS BIGINT) AS w, event_type IN ('view', 'click') AS low
  FROM events)"""

START = f"FROM range({SHARDS}) r(shard)"
NONE = "CAST([] AS BIGINT[])"


def _walk(state: dict[str, str], out: str, step: str, extra: str = "") -> str:
    """A recursive walk ``w``: state columns with their first values, and the select list of a step from r (state) and t (access)."""
    first = ", ".join(f"{v} AS {k}" for k, v in state.items())
    return f"""
w(shard, i, {", ".join(state)}, {out}) AS (
  SELECT shard, CAST(0 AS BIGINT), {first}, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) {START}
  UNION ALL
  SELECT t.shard, t.i, {step} FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1 {extra})"""


OUT = "seq, hit, evicted"
LOG = "SELECT CAST(shard AS INTEGER) AS shard, seq, key, hit, evicted FROM (SELECT w.*, t.key FROM w JOIN t USING (shard, i))"


def _log(walk: str) -> str:
    return f"WITH RECURSIVE {TRACE}, {walk} {LOG}"


_hit = "list_contains(r.q, t.key)"
_full = f"len(r.q) >= {PER_SHARD}"
FIFO_WALK = _walk(
    {"q": NONE}, OUT,
    f"""CASE WHEN {_hit} THEN r.q WHEN {_full} THEN list_append(r.q[2:], t.key) ELSE list_append(r.q, t.key) END,
      t.seq, {_hit}, CASE WHEN NOT {_hit} AND {_full} THEN r.q[1] END""",
)
LRU_WALK = _walk(
    {"q": NONE}, OUT,
    f"""CASE WHEN {_hit} THEN list_append(list_filter(r.q, lambda x: x <> t.key), t.key) WHEN {_full} THEN list_append(r.q[2:], t.key) ELSE list_append(r.q, t.key) END,
      t.seq, {_hit}, CASE WHEN NOT {_hit} AND {_full} THEN r.q[1] END""",
)

# two pools: a is the low one, b the high one, with room for half the shard
HIGH = PER_SHARD // 2
LRU_PRIORITY_WALK = f"""
w(shard, i, a, b, {OUT}) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) {START}
  UNION ALL
  SELECT shard, i, CASE WHEN len(b2) > {HIGH} THEN list_append(a2, b2[1]) ELSE a2 END, CASE WHEN len(b2) > {HIGH} THEN b2[2:] ELSE b2 END, seq, hit, evicted
  FROM (
    SELECT *, CASE WHEN in_a THEN list_append(list_filter(a, lambda x: x <> key), key) WHEN NOT hit AND low THEN list_append(a1, key) ELSE a1 END AS a2,
      CASE WHEN in_b THEN list_append(list_filter(b, lambda x: x <> key), key) WHEN NOT hit AND NOT low THEN list_append(b1, key) ELSE b1 END AS b2
    FROM (
      SELECT *, in_a OR in_b AS hit, CASE WHEN evict AND len(a) > 0 THEN a[2:] ELSE a END AS a1, CASE WHEN evict AND len(a) = 0 THEN b[2:] ELSE b END AS b1,
        CASE WHEN evict THEN CASE WHEN len(a) > 0 THEN a[1] ELSE b[1] END END AS evicted
      FROM (
        SELECT t.shard, t.i, t.seq, t.key, t.low, r.a, r.b, list_contains(r.a, t.key) AS in_a, list_contains(r.b, t.key) AS in_b,
          NOT list_contains(r.a, t.key) AND NOT list_contains(r.b, t.key) AND len(r.a) + len(r.b) >= {PER_SHARD} AS evict
        FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1))))"""

# q: keys, oldest first; v: visited marks; h: the hand's place, 0 if it is at the start
SIEVE_WALK = f"""
w(shard, i, q, v, h, {OUT}) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, CAST([] AS BOOLEAN[]), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) {START}
  UNION ALL
  SELECT shard, i,
    CASE WHEN hit THEN q WHEN evict THEN list_append(list_concat(q[:j - 1], q[j + 1:]), key) ELSE list_append(q, key) END,
    CASE WHEN hit THEN list_transform(range(1, len(q) + 1), lambda x: v[x] OR q[x] = key)
      WHEN evict THEN list_append(list_transform(list_filter(range(1, len(q) + 1), lambda x: x <> j), lambda x: v[x] AND NOT list_contains(cleared, x)), false)
      ELSE list_append(v, false) END,
    CASE WHEN evict THEN CASE WHEN j < len(q) THEN j ELSE 0 END ELSE h END,
    seq, hit, CASE WHEN evict THEN q[j] END
  FROM (
    SELECT *, coalesce(rot[p], rot[1]) AS j, CASE WHEN p IS NULL THEN rot ELSE rot[:p - 1] END AS cleared
    FROM (
      SELECT *, nullif(list_position(list_transform(rot, lambda x: v[x]), false), 0) AS p
      FROM (
        SELECT t.shard, t.i, t.seq, t.key, r.q, r.v, r.h, list_contains(r.q, t.key) AS hit, NOT list_contains(r.q, t.key) AND len(r.q) >= {PER_SHARD} AS evict,
          list_concat(range(greatest(r.h, 1), len(r.q) + 1), range(1, greatest(r.h, 1))) AS rot
        FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1))))"""

# s and m: small and main queue of (k, f); g: ghosts
SMALL, THRESHOLD = PER_SHARD // 5, 1
_KF = "CAST([] AS STRUCT(k BIGINT, f BIGINT)[])"


def s3fifo_walk(ghosts: int) -> str:
    keep = f"list_append(g, victim)[greatest(1, len(g) + 2 - {ghosts}):]" if ghosts else "g"
    return f"""
w(shard, i, s, m, g, {OUT}) AS (
  SELECT shard, CAST(0 AS BIGINT), {_KF}, {_KF}, {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) {START}
  UNION ALL
  SELECT shard, i,
    CASE WHEN hit THEN list_transform(s, lambda x: {{'k': x.k, 'f': CASE WHEN x.k = key THEN least(3, x.f + 1) ELSE x.f END}})
      WHEN list_contains(g2, key) THEN s3 ELSE list_append(s3, {{'k': key, 'f': CAST(0 AS BIGINT)}}) END,
    CASE WHEN hit THEN list_transform(m, lambda x: {{'k': x.k, 'f': CASE WHEN x.k = key THEN least(3, x.f + 1) ELSE x.f END}})
      WHEN list_contains(g2, key) THEN list_append(m3, {{'k': key, 'f': CAST(0 AS BIGINT)}}) ELSE m3 END,
    g2, seq, hit, CASE WHEN evict THEN gone END
  FROM (
    SELECT *, CASE WHEN evict AND p IS NOT NULL THEN {keep} ELSE g END AS g2,
      CASE WHEN NOT evict OR p IS NOT NULL OR len(m2) > 0 THEN s2 ELSE s2[2:] END AS s3,
      CASE WHEN evict AND p IS NULL AND len(m2) > 0 THEN list_concat(list_transform(m2[mp + 1:], lambda x: {{'k': x.k, 'f': x.f - least_f}}), list_transform(m2[:mp - 1], lambda x: {{'k': x.k, 'f': x.f - least_f - 1}})) ELSE m2 END AS m3,
      CASE WHEN p IS NOT NULL THEN victim WHEN len(m2) > 0 THEN m2[mp].k ELSE s2[1].k END AS gone
    FROM (
      SELECT *, list_position(list_transform(m2, lambda x: x.f), least_f) AS mp, s[p].k AS victim
      FROM (
        SELECT *, list_min(list_transform(m2, lambda x: x.f)) AS least_f
        FROM (
          SELECT *, CASE WHEN NOT small_goes THEN s WHEN p IS NULL THEN s[:0] ELSE s[p + 1:] END AS s2,
            CASE WHEN NOT small_goes THEN m WHEN p IS NULL THEN list_concat(m, s) ELSE list_concat(m, s[:p - 1]) END AS m2
          FROM (
            SELECT *, CASE WHEN small_goes THEN nullif(list_position(list_transform(s, lambda x: x.f < {THRESHOLD}), true), 0) END AS p
            FROM (
              SELECT *, evict AND len(s) > {SMALL} AS small_goes
              FROM (
                SELECT *, NOT hit AND len(s) + len(m) >= {PER_SHARD} AS evict
                FROM (
                  SELECT t.shard, t.i, t.seq, t.key, r.s, r.m, r.g, list_contains(list_transform(list_concat(r.s, r.m), lambda x: x.k), t.key) AS hit
                  FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1)))))))))"""


# a: window, b: probation, c: protected; n: counts; u: updates since the last aging
WINDOW, PROTECTED, WIDTH = PER_SHARD // 10, PER_SHARD * 8 // 10, 2000
LFU_WALK = f"""
w(shard, i, a, b, c, n, u, {OUT}) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, {NONE}, {NONE}, {_KF}, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) {START}
  UNION ALL
  SELECT shard, i,
    CASE WHEN in_a THEN list_append(list_filter(a, lambda x: x <> key), key) WHEN hit THEN a ELSE CASE WHEN len(a1) + 1 > {WINDOW} THEN list_append(a1, key)[2:] ELSE list_append(a1, key) END END,
    CASE WHEN in_b THEN CASE WHEN len(c) + 1 > {PROTECTED} THEN list_append(list_filter(b, lambda x: x <> key), list_append(c, key)[1]) ELSE list_filter(b, lambda x: x <> key) END
      WHEN hit THEN b ELSE CASE WHEN len(a1) + 1 > {WINDOW} THEN list_append(b1, list_append(a1, key)[1]) ELSE b1 END END,
    CASE WHEN in_b THEN CASE WHEN len(c) + 1 > {PROTECTED} THEN list_append(c, key)[2:] ELSE list_append(c, key) END
      WHEN in_c THEN list_append(list_filter(c, lambda x: x <> key), key) WHEN hit THEN c ELSE c1 END,
    CASE WHEN u + 1 >= {WIDTH} THEN list_transform(n1, lambda x: {{'k': x.k, 'f': x.f >> 1}}) ELSE n1 END,
    CASE WHEN u + 1 >= {WIDTH} THEN (u + 1) >> 1 ELSE u + 1 END,
    seq, hit, evicted
  FROM (
    SELECT *, CASE WHEN from_a THEN a[2:] ELSE a END AS a1, CASE WHEN from_b THEN b[2:] ELSE b END AS b1, CASE WHEN from_c THEN c[2:] ELSE c END AS c1,
      CASE WHEN from_a THEN a[1] WHEN from_b THEN b[1] WHEN from_c THEN c[1] END AS evicted,
      CASE WHEN list_contains(list_transform(n, lambda x: x.k), key) THEN list_transform(n, lambda x: {{'k': x.k, 'f': CASE WHEN x.k = key THEN x.f + 1 ELSE x.f END}})
        ELSE list_append(n, {{'k': key, 'f': CAST(1 AS BIGINT)}}) END AS n1
    FROM (
      SELECT *, evict AND len(a) > 0 AND (len(b) = 0 OR fa < fb) AS from_a, evict AND len(b) > 0 AND NOT (len(a) > 0 AND fa < fb) AS from_b, evict AND len(a) = 0 AND len(b) = 0 AS from_c
      FROM (
        SELECT *, in_a OR in_b OR in_c AS hit, NOT (in_a OR in_b OR in_c) AND len(a) + len(b) + len(c) >= {PER_SHARD} AS evict,
          coalesce(list_filter(n, lambda x: x.k = a[1])[1].f, 0) AS fa, coalesce(list_filter(n, lambda x: x.k = b[1])[1].f, 0) AS fb
        FROM (
          SELECT t.shard, t.i, t.seq, t.key, r.a, r.b, r.c, r.n, r.u, list_contains(r.a, t.key) AS in_a, list_contains(r.b, t.key) AS in_b, list_contains(r.c, t.key) AS in_c
          FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1)))))"""

# inserts and removals too: an insert evicts first and replaces then, be it its own old copy
FIFO_MIXED_WALK = f"""
w(shard, i, q, seq, result, evicted) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) {START}
  UNION ALL
  SELECT shard, i,
    CASE WHEN op = 'remove' THEN list_filter(q, lambda x: x <> key) WHEN op = 'get_or_fetch' AND had THEN q ELSE list_append(list_filter(q1, lambda x: x <> key), key) END,
    seq,
    CASE op WHEN 'remove' THEN CASE WHEN had THEN 'removed' ELSE 'absent' END WHEN 'insert' THEN CASE WHEN list_contains(q1, key) THEN 'replace' ELSE 'insert' END ELSE CASE WHEN had THEN 'hit' ELSE 'miss' END END,
    CASE WHEN goes THEN q[1] END
  FROM (
    SELECT *, CASE WHEN goes THEN q[2:] ELSE q END AS q1
    FROM (
      SELECT t.shard, t.i, t.seq, t.key, t.op, r.q, list_contains(r.q, t.key) AS had,
        len(r.q) >= {PER_SHARD} AND (t.op = 'insert' OR t.op = 'get_or_fetch' AND NOT list_contains(r.q, t.key)) AS goes
      FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1)))"""

# weights: p is the least number of front entries whose leaving makes room; an entry too heavy empties the shard and stays
WEIGHTED_CAPACITY = 3200
_WC = WEIGHTED_CAPACITY // SHARDS
WEIGHTED_FIFO_WALK = f"""
w(shard, i, q, z, {OUT}, usage) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) {START}
  UNION ALL
  SELECT shard, i, CASE WHEN hit THEN q ELSE list_append(q[p + 1:], key) END, CASE WHEN hit THEN z ELSE list_append(z[p + 1:], wt) END, seq, hit,
    CASE WHEN hit THEN 0 ELSE p END, CAST(CASE WHEN hit THEN coalesce(list_sum(z), 0) ELSE coalesce(list_sum(z[p + 1:]), 0) + wt END AS BIGINT)
  FROM (
    SELECT *, coalesce(list_filter(range(0, len(q) + 1), lambda x: coalesce(list_sum(z[x + 1:]), 0) <= greatest(0, {_WC} - wt))[1], len(q)) AS p
    FROM (
      SELECT t.shard, t.i, t.seq, t.key, t.w AS wt, r.q, r.z, list_contains(r.q, t.key) AS hit FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1)))"""

WALKS = {
    "fifo": FIFO_WALK, "lru": LRU_WALK, "lru_priority": LRU_PRIORITY_WALK, "lfu": LFU_WALK,
    "s3fifo": s3fifo_walk(PER_SHARD), "s3fifo_no_ghost": s3fifo_walk(0), "sieve": SIEVE_WALK,
}


def access_log(policy: str) -> str:
    return _log(WALKS[policy])


def hit_ratios() -> str:
    parts = [f"SELECT '{p}' AS policy, count(*) FILTER (WHERE hit) AS hits, count(*) AS accesses, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_ratio FROM ({access_log(p)})" for p in WALKS]
    return " UNION ALL ".join(parts)


def mixed_log() -> str:
    return f"WITH RECURSIVE {TRACE}, {FIFO_MIXED_WALK} SELECT CAST(shard AS INTEGER) AS shard, seq, op, key, result, evicted FROM w JOIN (SELECT shard AS s2, i AS i2, op, key FROM t) ON s2 = shard AND i2 = i"


def mixed_residual() -> str:
    return f"WITH RECURSIVE {TRACE}, {FIFO_MIXED_WALK} SELECT CAST(shard AS INTEGER) AS shard, 'queue' AS list, array_to_string(arg_max(q, i), ',') AS keys, CAST(len(arg_max(q, i)) AS BIGINT) AS n FROM w WHERE i > 0 GROUP BY shard"


def weighted_log() -> str:
    return f"WITH RECURSIVE {TRACE}, {WEIGHTED_FIFO_WALK} SELECT CAST(shard AS INTEGER) AS shard, seq, key, hit, evicted AS n_evicted, usage FROM w JOIN (SELECT shard AS s2, i AS i2, key FROM t) ON s2 = shard AND i2 = i"


#: Errors read through with a failing fetch: they hit or fail, and never insert.
FAILING = TRACE.replace("WHEN event_type = 'error' THEN 'remove' WHEN event_type IN ('purchase', 'signup') THEN 'insert'", "WHEN event_type = 'error' THEN 'get_or_fail'")


def failing_log() -> str:
    walk = f"""
w(shard, i, q, seq, result) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) {START}
  UNION ALL
  SELECT t.shard, t.i, CASE WHEN {_hit} OR t.op = 'get_or_fail' THEN r.q WHEN {_full} THEN list_append(r.q[2:], t.key) ELSE list_append(r.q, t.key) END,
    t.seq, CASE WHEN {_hit} THEN 'hit' WHEN t.op = 'get_or_fail' THEN 'error' ELSE 'miss' END FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1)"""
    return f"WITH RECURSIVE {FAILING}, {walk} SELECT CAST(shard AS INTEGER) AS shard, seq, result FROM w WHERE i > 0"


#: A resize to half at a quarter of the trace, evict_all at half and clear at three quarters, on every shard.
STEPS = {1: "resize", 2: "evict_all", 3: "clear"}


def lifecycle_log(on_hit: str = "r.q") -> str:
    """Of FIFO, or of LRU if a hit moves the key to the end."""
    at = "(SELECT max(event_id) + 1 FROM events) // 4"
    extra = " UNION ALL ".join(f"SELECT CAST(range AS BIGINT), 2 * ({at} * {k}) - 1, '{op}' FROM range({SHARDS})" for k, op in STEPS.items())
    return f"""
WITH RECURSIVE e AS (SELECT user_id AS key, 2 * event_id AS seq, 'get_or_fetch' AS op FROM events UNION ALL {extra}),
t AS (SELECT key % {SHARDS} AS shard, row_number() OVER (PARTITION BY key % {SHARDS} ORDER BY seq) AS i, seq, key, op, CASE WHEN seq >= 2 * {at} - 1 THEN {PER_SHARD // 2} ELSE {PER_SHARD} END AS room FROM e),
w(shard, i, q, seq, result) AS (
  SELECT shard, CAST(0 AS BIGINT), {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) {START}
  UNION ALL
  SELECT t.shard, t.i, CASE WHEN t.op IN ('evict_all', 'clear') THEN r.q[:0] WHEN t.op = 'resize' THEN r.q[greatest(1, len(r.q) - t.room + 1):]
      WHEN list_contains(r.q, t.key) THEN {on_hit} WHEN len(r.q) >= t.room THEN list_append(r.q[2:], t.key) ELSE list_append(r.q, t.key) END,
    t.seq, CASE WHEN t.op <> 'get_or_fetch' THEN 'done' WHEN list_contains(r.q, t.key) THEN 'hit' ELSE 'miss' END
  FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1)
SELECT CAST(shard AS INTEGER) AS shard, seq, result, CAST(len(q) AS BIGINT) AS entries FROM w WHERE i > 0"""


def wiped_log(policy: str, lists: str) -> str:
    """A policy's walk where its lists (named by letters) are emptied before the first access from half and from three quarters of the trace on.

    What else the policy knows stays, be it evicted or cleared; a hand goes back to the start.
    """
    walk = re.sub(rf"\br\.([{lists}])\b", r"(CASE WHEN t.wipe THEN r.\1[:0] ELSE r.\1 END)", WALKS[policy])
    named = walk.replace("r.h", "(CASE WHEN t.wipe THEN 0 ELSE r.h END)")
    for name in [*lists, "h"]:
        was = f"(CASE WHEN t.wipe THEN r.{name}[:0] ELSE r.{name} END)" if name != "h" else "(CASE WHEN t.wipe THEN 0 ELSE r.h END)"
        named = named.replace(f", {was},", f", {was} AS {name},").replace(f", {was} FROM", f", {was} AS {name} FROM")
    at = "(SELECT max(event_id) + 1 FROM events) // 4"
    first = " OR ".join(f"event_id = min(CASE WHEN event_id >= {at} * {k} THEN event_id END) OVER (PARTITION BY user_id % {SHARDS})" for k in (2, 3))
    trace = TRACE.replace("event_type IN ('view', 'click') AS low", f"event_type IN ('view', 'click') AS low, {first} AS wipe")
    return f"WITH RECURSIVE {trace}, {named} {LOG}"


LRU_HIT = "list_append(list_filter(r.q, lambda x: x <> t.key), t.key)"


def locations_log() -> str:
    """Signups live in memory only, purchases on disk only; q holds keys and whether they are written when they leave, dsk the disk's keys.

    What is read from the disk is young and not written again; the disk loses nothing.
    """
    kw = "CAST([] AS STRUCT(k BIGINT, w BOOLEAN)[])"
    walk = f"""
w(shard, i, q, dsk, seq, op, source) AS (
  SELECT shard, CAST(0 AS BIGINT), {kw}, {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) {START}
  UNION ALL
  SELECT shard, i,
    CASE WHEN op = 'read' AND had THEN q WHEN op IN ('remove', 'on_disk') THEN list_filter(q, lambda x: x.k <> key)
      ELSE list_append(list_filter(q1, lambda x: x.k <> key), {{'k': key, 'w': op = 'read' AND NOT stored}}) END,
    CASE WHEN op = 'remove' THEN list_filter(dsk, lambda x: x <> key) WHEN op = 'on_disk' THEN list_append(list_filter(dsk, lambda x: x <> key), key)
      WHEN goes AND q[1].w THEN list_append(list_filter(dsk, lambda x: x <> q[1].k), q[1].k) ELSE dsk END,
    seq, op, CASE WHEN op = 'read' THEN CASE WHEN had THEN 'memory' WHEN stored THEN 'disk' ELSE 'outer' END END
  FROM (
    SELECT *, CASE WHEN goes THEN q[2:] ELSE q END AS q1
    FROM (
      SELECT *, len(q) >= {PER_SHARD} AND (op = 'in_mem' OR op = 'read' AND NOT had) AS goes
      FROM (
        SELECT t.shard, t.i, t.seq, t.key, t.kind AS op, r.q, r.dsk, list_contains(list_transform(r.q, lambda x: x.k), t.key) AS had, list_contains(r.dsk, t.key) AS stored
        FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1))))"""
    trace = f"""
t AS (
  SELECT user_id % {SHARDS} AS shard, row_number() OVER (PARTITION BY user_id % {SHARDS} ORDER BY event_id) AS i, event_id AS seq, user_id AS key,
    CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'on_disk' WHEN 'signup' THEN 'in_mem' ELSE 'read' END AS kind FROM events)"""
    return f"WITH RECURSIVE {trace}, {walk} SELECT CAST(shard AS INTEGER) AS shard, seq, source FROM w WHERE i > 0"


def string_key_log() -> str:
    """The FIFO walk over string keys, dealt by the first digits of their MD5."""
    of = f"CAST('0x' || substr(md5('user-' || user_id), 1, 8) AS BIGINT) % {SHARDS}"
    trace = f"""
t AS (SELECT {of} AS shard, row_number() OVER (PARTITION BY {of} ORDER BY event_id) AS i, event_id AS seq, 'user-' || user_id AS key FROM events)"""
    walk = FIFO_WALK.replace("CAST([] AS BIGINT[])", "CAST([] AS VARCHAR[])").replace("CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) FROM", "CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR) FROM")
    return f"WITH RECURSIVE {trace}, {walk} {LOG}"


def hybrid_lifecycle_log() -> str:
    """On a disk that loses nothing, a key that was seen since the last clear is in memory or else on the disk."""
    walk = lifecycle_log()
    cleared = "2 * ((SELECT max(event_id) + 1 FROM events) // 4 * 3) - 1"
    return f"""
WITH l AS ({walk}), x AS (
  SELECT l.*, e.user_id AS key, l.seq > {cleared} AS late FROM l LEFT JOIN events e ON l.seq = 2 * e.event_id)
SELECT shard, seq, result_ AS result, source FROM (
  SELECT shard, seq, CASE WHEN result = 'done' THEN NULL WHEN result = 'hit' THEN 'memory' WHEN seq = min(seq) OVER (PARTITION BY key, late, result = 'done') THEN 'outer' ELSE 'disk' END AS source,
    CASE WHEN result = 'done' THEN 'done' WHEN result = 'hit' OR seq > min(seq) OVER (PARTITION BY key, late, result = 'done') THEN 'hit' ELSE 'miss' END AS result_ FROM x)"""


#: Kinds of the two walks below. q holds keys and whether they are written when they leave; dsk the disk's keys.
def _two_tier(kind: str, ok: str) -> str:
    kw = "CAST([] AS STRUCT(k BIGINT, w BOOLEAN)[])"
    walk = f"""
w(shard, i, q, dsk, seq, op, result, source) AS (
  SELECT shard, CAST(0 AS BIGINT), {kw}, {NONE}, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) {START}
  UNION ALL
  SELECT shard, i,
    CASE WHEN op IN ('read', 'late') AND had OR op = 'written' AND NOT ok THEN q WHEN op IN ('written', 'forced') THEN list_filter(q, lambda x: x.k <> key)
      ELSE list_append(q1, {{'k': key, 'w': op = 'read' AND NOT stored AND ok}}) END,
    CASE WHEN op IN ('written', 'forced') THEN CASE WHEN ok THEN list_append(list_filter(dsk, lambda x: x <> key), key) ELSE dsk END
      WHEN goes AND q[1].w THEN list_append(list_filter(dsk, lambda x: x <> q[1].k), q[1].k) ELSE dsk END,
    seq, op,
    CASE op WHEN 'written' THEN CASE WHEN ok THEN 'phantom' ELSE 'rejected' END WHEN 'forced' THEN 'phantom' ELSE CASE WHEN had OR op = 'read' AND stored THEN 'hit' ELSE 'miss' END END,
    CASE WHEN op IN ('read', 'late') THEN CASE WHEN had THEN 'memory' WHEN op = 'read' AND stored THEN 'disk' ELSE 'outer' END END
  FROM (
    SELECT *, CASE WHEN goes THEN q[2:] ELSE q END AS q1
    FROM (
      SELECT *, len(q) >= {PER_SHARD} AND op IN ('read', 'late') AND NOT had AS goes
      FROM (
        SELECT t.shard, t.i, t.seq, t.key, t.kind AS op, t.ok, r.q, r.dsk, list_contains(list_transform(r.q, lambda x: x.k), t.key) AS had, list_contains(r.dsk, t.key) AS stored
        FROM w r JOIN t ON t.shard = r.shard AND t.i = r.i + 1))))"""
    trace = f"""
t AS (
  SELECT user_id % {SHARDS} AS shard, row_number() OVER (PARTITION BY user_id % {SHARDS} ORDER BY event_id) AS i, event_id AS seq, user_id AS key, {kind} AS kind, {ok} AS ok FROM events)"""
    return f"WITH RECURSIVE {trace}, {walk} SELECT CAST(shard AS INTEGER) AS shard, seq, result, source FROM w WHERE i > 0"


def throttled_log() -> str:
    """Errors' reads of the disk are throttled: they go to the source and what they fetch is not written."""
    return _two_tier("CASE WHEN event_type = 'error' THEN 'late' ELSE 'read' END", "true")


def writer_log() -> str:
    """Purchases go through the storage writer, errors force it; sizes from 20 to 300 are admitted."""
    return _two_tier("CASE event_type WHEN 'purchase' THEN 'written' WHEN 'error' THEN 'forced' ELSE 'read' END", "ceil(value) >= 20 AND ceil(value) < 300")


#: Blocks of 16 pages, one of them the index, and entries of a page each: 15 entries a block. Of 6 blocks one is kept clean, so the
#: open block and the 4 before it hold what can be read.
DISK_WINDOW = f"""
WITH t AS (
  SELECT user_id % {SHARDS} AS shard, event_id AS seq, user_id AS key, event_type IN ('purchase', 'signup') AS writes FROM events),
n AS (SELECT *, count(*) FILTER (WHERE writes) OVER (PARTITION BY shard ORDER BY seq) AS written FROM t),
k AS (
  SELECT *, max(CASE WHEN writes THEN written END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM n)
SELECT CAST(shard AS INTEGER) AS shard, seq, CASE WHEN own IS NOT NULL AND (own - 1) // 15 >= (written - 1) // 15 - 4 THEN 'present' ELSE 'absent' END AS result FROM k WHERE NOT writes"""
