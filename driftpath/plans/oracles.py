"""DuckDB SQL for the same questions, composed of named parts."""

from __future__ import annotations

from ..functions import pickers as P

M = 2147483647
FIRST_TS, LAST_TS = "-9223372036854775808", "9223372036854775807"

EDGES = """e AS (
  SELECT *, row_number() OVER (ORDER BY ts, idx) - 1 AS edge_id FROM (
    SELECT u, lead(u) OVER (ORDER BY stamp, event_id) AS i, epoch_us(stamp) // 3600000000 AS ts, row_number() OVER (ORDER BY stamp, event_id) - 1 AS idx, value
    FROM (SELECT user_id AS u, ts AS stamp, event_id, value FROM events)) WHERE i IS NOT NULL)"""


def ends(side: str, directed: bool = True) -> str:
    """e, ends, grp (groups by node) of a side: out, in."""
    out, back = "SELECT u AS node, i AS nbr, ts, edge_id, 0 AS flip FROM e", "SELECT i AS node, u AS nbr, ts, edge_id, 1 AS flip FROM e"
    body = f"{out} UNION ALL {back}" if not directed else out if side == "out" else back
    return f"""{EDGES}, ends AS ({body}), grp AS (
  SELECT node, ts, n, row_number() OVER (PARTITION BY node ORDER BY ts) - 1 AS g FROM (SELECT node, ts, count(*) AS n FROM ends GROUP BY node, ts))"""


def power(x: str) -> str:
    sq = f"((({x}) * ({x})) % {M})"
    return f"(((({sq} * {sq}) % {M}) * ({x})) % {M})"


def uniform(walk: str, step: int, slot: int, seed: int) -> str:
    x = power(f"({walk} * 48271 + {(step * 69621 + slot * 40692 + seed * 16807 + 12345) % M}) % {M}")
    return f"(CAST({power(f'({x} + {(step * 7919 + slot * 104729 + 1013904223) % M}) % {M}')} AS DOUBLE) / {M}.0)"


def pick(name: str, lo: str, hi: str, r: str, late: bool) -> str:
    n = f"(({hi}) - ({lo}))"
    if name == P.FIRST:
        return f"({lo})"
    if name == P.LAST:
        return f"(({hi}) - 1)"
    if name == P.UNIFORM:
        return f"(({lo}) + CAST(least(floor({r} * {n}), {n} - 1) AS BIGINT))"
    if name == P.LINEAR:
        k = f"CAST(least(floor((sqrt(1.0 + 8.0 * ({r} * (CAST({n} AS DOUBLE) * (CAST({n} AS DOUBLE) + 1.0) / 2.0))) - 1.0) / 2.0), {n} - 1) AS BIGINT)"
    elif name == P.EXPONENTIAL_INDEX:
        k = f"CAST(greatest(least(floor(CASE WHEN {n} < {P.EXP_LIMIT} THEN ln(1.0 + {r} * (exp(CAST(least({n}, {P.EXP_LIMIT - 1}) AS DOUBLE)) - 1.0)) ELSE {n} + ln(greatest({r}, 1e-300)) END), {n} - 1), 0) AS BIGINT)"
    else:
        start = f"(CASE WHEN ({lo}) > 0 THEN cum[({lo})] ELSE 0.0 END)"
        return f"least(({lo}) + len(list_filter(cum[({lo}) + 1:({hi})], lambda c: c < {start} + {r} * (cum[({hi})] - {start}))), ({hi}) - 1)"
    return f"(({lo}) + {k})" if late else f"(({lo}) + {n} - 1 - {k})"


def weights(bound: float, table: str = "grp", part: str = "PARTITION BY node") -> str:
    """wts: table with w_fwd, w_bwd, cum_fwd, cum_bwd; n is the number of edges."""
    scale = f"(CASE WHEN {bound} > 0 AND hi > lo THEN CAST({bound} AS DOUBLE) / (hi - lo) ELSE 1.0 END)"
    over = f"({part})"
    return f"""wts AS (
  SELECT *, sum(w_fwd) OVER ({part} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum_fwd, sum(w_bwd) OVER ({part} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum_bwd FROM (
    SELECT *, rf / sum(rf) OVER {over} AS w_fwd, rb / sum(rb) OVER {over} AS w_bwd FROM (
      SELECT *, n * exp((lo - ts) * {scale}) AS rf, n * exp((ts - hi) * {scale}) AS rb FROM (
        SELECT *, min(ts) OVER {over} AS lo, max(ts) OVER {over} AS hi FROM {table}))))"""


def walks(seeds: str, max_len: int, bias: str, start: str | None = None, forward: bool = True, directed: bool = True, per_node: int = 1, seed: int = 0, bound: float = 50, p: float = 1, q: float = 1) -> str:
    """Rows (walk_id, step, node, ts). seeds: SQL of (pos, node, cutoff)."""
    side = "out" if forward or not directed else "in"
    cum = "cum_fwd" if forward else "cum_bwd"
    parts = [ends(side, directed), weights(bound)]
    parts.append("stats AS (SELECT node, count(*) AS n_groups, list(ts ORDER BY g) AS stamps, list(n ORDER BY g) AS sizes, list(%s ORDER BY g) AS cum FROM wts GROUP BY node)" % cum)
    parts.append(f"""adj AS (
  SELECT a.node, a.nbr, a.ts, a.edge_id, g.g, row_number() OVER (PARTITION BY a.node, a.ts ORDER BY a.edge_id, a.flip) - 1 AS k,
    (SELECT count(*) FROM grp x WHERE x.node = a.nbr AND x.ts {'<=' if forward else '<'} a.ts) AS succ
  FROM ends a JOIN grp g ON a.node = g.node AND a.ts = g.ts)""")
    parts.append(f"seeds AS ({seeds})")
    parts.append("nbrs AS (SELECT DISTINCT u AS a, i AS b FROM e UNION SELECT DISTINCT i, u FROM e)")
    parts.append(f"h0 AS (SELECT pos * {per_node} + j AS walk_id, node, {FIRST_TS if forward else LAST_TS} AS ts, CAST(NULL AS BIGINT) AS rank, cutoff, CAST(NULL AS BIGINT) AS prev FROM seeds, generate_series(0, {per_node - 1}) AS t(j))")
    for step in range(max_len - 1):
        name = bias if step else start or bias
        lo, hi = ("coalesce(h.rank, 0)", "s.n_groups") if forward else ("0", "coalesce(h.rank, s.n_groups)")
        hi = f"CASE WHEN h.cutoff IS NULL THEN {hi} ELSE least({hi}, len(list_filter(s.stamps, lambda t: t < h.cutoff))) END"
        ranged = f"SELECT h.*, s.sizes, s.cum, {lo} AS lo, {hi} AS hi FROM h{step} h JOIN stats s ON h.node = s.node"
        r1, r2 = uniform("walk_id", step, 0, seed), uniform("walk_id", step, 1, seed)
        if name == P.NODE2VEC and step:
            parts.append(f"""v{step} AS (
  SELECT r.walk_id, r.node AS prev_node, r.cutoff, a.nbr, a.ts, a.succ, a.g, a.k,
    (r.cum[a.g + 1] - (CASE WHEN a.g > 0 THEN r.cum[a.g] ELSE 0.0 END)) / r.sizes[a.g + 1]
      * (CASE WHEN a.nbr = r.prev THEN 1.0 / {p} WHEN b.a IS NOT NULL THEN 1.0 ELSE 1.0 / {q} END) AS wt
  FROM ({ranged}) r JOIN adj a ON a.node = r.node AND a.g >= r.lo AND a.g < r.hi LEFT JOIN nbrs b ON b.a = r.prev AND b.b = a.nbr)""")
            parts.append(f"""c{step} AS (SELECT *, max(upto) OVER (PARTITION BY walk_id) AS whole FROM (
  SELECT *, sum(wt) OVER (PARTITION BY walk_id ORDER BY g, k ROWS UNBOUNDED PRECEDING) AS upto FROM v{step}))""")
            parts.append(f"""h{step + 1} AS (SELECT walk_id, nbr AS node, ts, succ AS rank, cutoff, prev_node AS prev FROM (
  SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY g, k) AS nth FROM c{step} WHERE upto >= {r1} * whole) WHERE nth = 1)""")
        else:
            kind = P.EXPONENTIAL_WEIGHT if name == P.NODE2VEC else name
            k = "0" if kind in (P.FIRST, P.LAST) else f"CAST(least(floor({r2} * r.sizes[r.g + 1]), r.sizes[r.g + 1] - 1) AS BIGINT)"
            parts.append(f"""h{step + 1} AS (
  SELECT r.walk_id, a.nbr AS node, a.ts, a.succ AS rank, r.cutoff, r.node AS prev
  FROM (SELECT *, {pick(kind, 'lo', 'hi', r1, not forward)} AS g FROM ({ranged}) WHERE hi > lo) r JOIN adj a ON a.node = r.node AND a.g = r.g AND a.k = {k})""")
    union = " UNION ALL ".join(f"SELECT walk_id, {k} AS step, node, ts FROM h{k}" for k in range(max_len))
    parts.append(f"hops AS ({union}), lens AS (SELECT walk_id, max(step) AS last FROM hops GROUP BY walk_id HAVING max(step) > 0 OR {max_len} = 1)")
    at = "step" if forward else "last - step"
    return f"WITH {', '.join(parts)} SELECT CAST(walk_id AS BIGINT) AS walk_id, CAST({at} AS BIGINT) AS step, node, CAST(ts AS BIGINT) AS ts FROM hops JOIN lens USING (walk_id)"
