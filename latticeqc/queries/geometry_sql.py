"""Self-join SQL for the geometry stages, the independent counterpart of the windowed frame."""

from latticeqc.queries.registry import define
from latticeqc.queries.sql import NAN, above, below, clip, cross, div, dot, fin, unit


def _corner(names: str) -> str:
    return ", ".join(f"{t}.{c} AS p{t}{c}" for t in names for c in "xyz")


# Corners: a = (r,c), b = (r,c+1), c = (r+1,c), d = (r+1,c+1).
define(
    "quad",
    f"""SELECT a.package_id, a.row, a.col, {_corner('abcd')}, a.valid AND b.valid AND c.valid AND d.valid AS ok
    FROM surf a JOIN surf b ON b.package_id=a.package_id AND b.row=a.row AND b.col=a.col+1
    JOIN surf c ON c.package_id=a.package_id AND c.row=a.row+1 AND c.col=a.col
    JOIN surf d ON d.package_id=a.package_id AND d.row=a.row+1 AND d.col=a.col+1""",
)


def _edges(direction: str, dr: int, dc: int) -> str:
    return f"""SELECT package_id, direction, row, col, ex, ey, ez, CASE WHEN both_ok AND {fin('raw')} THEN raw END AS length, both_ok AND {fin('raw')} AS valid
    FROM (SELECT *, sqrt(ex*ex+ey*ey+ez*ez) AS raw FROM (
      SELECT a.package_id, '{direction}' AS direction, a.row, a.col, b.x-a.x AS ex, b.y-a.y AS ey, b.z-a.z AS ez, a.valid AND b.valid AS both_ok
      FROM surf a JOIN surf b ON b.package_id=a.package_id AND b.row=a.row+{dr} AND b.col=a.col+{dc}))"""


define("edge_all", f"{_edges('horizontal', 0, 1)} UNION ALL {_edges('vertical', 1, 0)}")
define(
    "refs",
    """SELECT p.package_id, max(m) FILTER (direction='horizontal') AS obs_h, max(m) FILTER (direction='vertical') AS obs_v
    FROM (SELECT DISTINCT package_id FROM surf) p LEFT JOIN
      (SELECT package_id, direction, quantile_cont(length,0.5) AS m FROM edge_all WHERE valid AND length>1e-12 GROUP BY 1,2) q
      ON q.package_id=p.package_id GROUP BY 1""",
)
define(
    "edge_ratio",
    f"""SELECT *, {above('ratio', '2e0')} AS long, {below('ratio', '5e-1')} AS short FROM (
      SELECT e.*, CASE WHEN direction='horizontal' THEN {div('length', 'obs_h')} ELSE {div('length', 'obs_v')} END AS ratio
      FROM edge_all e JOIN refs r ON r.package_id=e.package_id)""",
)


def _delta(out: str, p: str, q: str) -> str:
    return ", ".join(f"{p}{c}-{q}{c} AS {out}{c}" for c in "xyz")


define(
    "tri0",
    f"""SELECT *, {_delta('u', 'pb', 'pa')}, {_delta('v', 'pc', 'pa')}, {_delta('p', 'pd', 'pb')}, {_delta('q', 'pc', 'pb')}, {_delta('w', 'pd', 'pa')} FROM quad""",
)
define(
    "tri1",
    f"""SELECT *, {cross('ta', 'u', 'v')}, {cross('tb', 'p', 'q')}, {cross('sa', 'u', 'w')}, {cross('sb', 'w', 'v')} FROM tri0""",
)
define(
    "tri2",
    "SELECT *, " + ", ".join(f"sqrt({dot(t, t)}) AS {t}len" for t in ("ta", "tb", "sa", "sb"))
    + f", sqrt({dot('u', 'u')})*sqrt({dot('v', 'v')}) AS basea, sqrt({dot('p', 'p')})*sqrt({dot('q', 'q')}) AS baseb FROM tri1",
)
define("tri3", "SELECT *, " + ", ".join(unit(f"{t}u", t, f"{t}len") for t in ("ta", "tb", "sa", "sb")) + " FROM tri2")
define(
    "tri4",
    f"""SELECT *, CASE WHEN ok THEN {div('talen', 'basea')} END AS sine_a, CASE WHEN ok THEN {div('tblen', 'baseb')} END AS sine_b,
      CASE WHEN ok THEN {dot('tau', 'tbu')} END AS fold_cosine, CASE WHEN ok THEN {dot('sau', 'sbu')} END AS alt_fold_cosine,
      CASE WHEN ok THEN 5e-1*(talen+tblen) END AS area, taux+tbux AS mx, tauy+tbuy AS my, tauz+tbuz AS mz FROM tri3""",
)
define(
    "tri",
    f"""SELECT *, {unit('n', 'm', 'mlen')}, ok AND {fin('mlen')} AND mlen>1e-12 AS normal_ok,
      ok AND (NOT {fin('sine_a')} OR sine_a<=1e-6) AS degenerate_a, ok AND (NOT {fin('sine_b')} OR sine_b<=1e-6) AS degenerate_b,
      ok AND {fin('sine_a')} AND sine_a<=1e-3 AS near_a, ok AND {fin('sine_b')} AND sine_b<=1e-3 AS near_b,
      {below('fold_cosine', '0')} AS folded, {below('alt_fold_cosine', '0')} AS alt_folded
      FROM (SELECT *, sqrt({dot('m', 'm')}) AS mlen FROM tri4)""",
)

_TWIST = {c: f"(t.pd{c}-t.pc{c}-t.pb{c}+t.pa{c})" for c in "xyz"}
define(
    "jac0",
    "SELECT t.*, obs_h, obs_v, "
    + ", ".join(f"coalesce({div(f'(t.pb{c}-t.pa{c}+5e-1*{_TWIST[c]})', 'obs_h')},{NAN}) AS du{c}, coalesce({div(f'(t.pc{c}-t.pa{c}+5e-1*{_TWIST[c]})', 'obs_v')},{NAN}) AS dv{c}" for c in "xyz")
    + " FROM tri t JOIN refs r ON r.package_id=t.package_id",
)
define("jac1", f"SELECT *, {dot('du', 'du')} AS uu, {dot('dv', 'dv')} AS vv, {dot('du', 'dv')} AS uv FROM jac0")
define(
    "jac2",
    "SELECT *, greatest(5e-1*(trace+root),0e0) AS lmax, greatest(5e-1*(trace-root),0e0) AS lmin FROM"
    " (SELECT *, uu+vv AS trace, sqrt(greatest((uu+vv)*(uu+vv)-4*(uu*vv-uv*uv),0e0)) AS root FROM jac1)",
)
define("jac3", "SELECT *, sqrt(lmax) AS smax, sqrt(lmin) AS smin, sqrt(uu*vv) AS guv FROM jac2")
define(
    "jac4",
    f"""SELECT *, CASE WHEN ok THEN {div('smax', 'smin')} END AS condition_number,
      CASE WHEN ok THEN greatest(smax,{div('1e0', 'smin')}) END AS symmetric_stretch, CASE WHEN ok THEN smax*smin END AS area_ratio,
      CASE WHEN ok THEN {div('abs(uv)', 'guv')} END AS shear,
      CASE WHEN ok THEN lmax+lmin+{div('1e0', 'lmax')}+{div('1e0', 'lmin')} END AS symmetric_dirichlet FROM jac3""",
)
define(
    "cells",
    f"""SELECT *, {above('condition_number', '4e0')} AS high_condition, {above('symmetric_stretch', '2e0')} AS high_stretch,
      {below('area_ratio', '25e-2')} AS low_area, {above('area_ratio', '4e0')} AS high_area, {above('shear', 'cos(pi()/6)')} AS high_shear,
      {above('symmetric_dirichlet', '2e1')} AS high_dirichlet, folded AND alt_folded AS folded_both, folded<>alt_folded AS split_sensitive,
      CASE WHEN isnan(fold_cosine) OR isnan(alt_fold_cosine) THEN {NAN} ELSE least(fold_cosine,alt_fold_cosine) END AS sensitive_value FROM jac4""",
)


def _jump(direction: str, dr: int, dc: int) -> str:
    d = clip("(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)")
    return f"""SELECT a.package_id, '{direction}' AS direction, a.row, a.col, {d} AS cosine
    FROM tri a JOIN tri b ON b.package_id=a.package_id AND b.row=a.row+{dr} AND b.col=a.col+{dc} WHERE a.normal_ok AND b.normal_ok"""


define(
    "jumps",
    f"""SELECT *, degrees(acos(cosine)) AS angle, cosine<cos(radians(75e0)) AS jump, cosine<0 AS flip
    FROM ({_jump('horizontal', 0, 1)} UNION ALL {_jump('vertical', 1, 0)})""",
)
# Both cells of every adjacent pair.
define(
    "jump_cells",
    """SELECT package_id, row, col, cosine, angle, jump FROM jumps UNION ALL
    SELECT package_id, CASE WHEN direction='vertical' THEN row+1 ELSE row END, CASE WHEN direction='horizontal' THEN col+1 ELSE col END, cosine, angle, jump FROM jumps""",
)
define(
    "vsum",
    """SELECT package_id, row+i AS row, col+j AS col, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, count(*) AS n
    FROM tri CROSS JOIN (SELECT unnest([0,1]) AS i) ii CROSS JOIN (SELECT unnest([0,1]) AS j) jj WHERE normal_ok GROUP BY 1,2,3""",
)
define(
    "vnormal",
    f"""SELECT package_id, row, col, n, {unit('vn', 's', 'len')}, {fin('len')} AND len>1e-12 AS vn_ok
    FROM (SELECT *, sqrt({dot('s', 's')}) AS len FROM vsum)""",
)


def _step(direction: str, dr: int, dc: int) -> str:
    ref = "obs_h" if direction == "horizontal" else "obs_v"
    return f"""SELECT package_id, '{direction}' AS direction, row, col, {div(f"abs({dot('e', 'k')})", 'ref')} AS score FROM (
      SELECT *, {unit('k', 's', 'len')} FROM (SELECT *, sqrt({dot('s', 's')}) AS len FROM (
        SELECT e.package_id, e.row, e.col, e.ex, e.ey, e.ez, {ref} AS ref, a.vnx+b.vnx AS sx, a.vny+b.vny AS sy, a.vnz+b.vnz AS sz
        FROM edge_all e JOIN refs r ON r.package_id=e.package_id
        JOIN vnormal a ON a.package_id=e.package_id AND a.row=e.row AND a.col=e.col AND a.vn_ok
        JOIN vnormal b ON b.package_id=e.package_id AND b.row=e.row+{dr} AND b.col=e.col+{dc} AND b.vn_ok
        WHERE e.direction='{direction}' AND e.valid)) WHERE {fin('len')} AND len>1e-12)"""


define("steps", f"{_step('horizontal', 0, 1)} UNION ALL {_step('vertical', 1, 0)}")
define("step_hits", f"SELECT * FROM steps WHERE {fin('score')} AND score>=25e-2")


def edge_to_cells(source: str, columns: str) -> str:
    """Both cells beside each edge of ``source`` that lie on the cell lattice."""
    picks = ", ".join(f"e.{c.strip()}" for c in columns.split(","))
    return f"""SELECT e.package_id, CASE WHEN e.direction='horizontal' THEN e.row-k ELSE e.row END AS row,
      CASE WHEN e.direction='vertical' THEN e.col-k ELSE e.col END AS col, {picks} FROM {source} e CROSS JOIN (SELECT unnest([0,1]) AS k) kk"""


define("ratio_cells", edge_to_cells("edge_ratio", "ratio, long, short"))
define("step_cells", f"SELECT DISTINCT s.package_id, s.row, s.col FROM ({edge_to_cells('step_hits', 'score')}) s JOIN quad q ON q.package_id=s.package_id AND q.row=s.row AND q.col=s.col AND q.ok")
define(
    "local_cells",
    f"""SELECT c.*, coalesce(e.cue,false) AS edge_cue, coalesce(j.cue,false) AS jump_cue, e.edge_score, j.jump_score,
      ((coalesce(e.cue,false) OR degenerate_a OR degenerate_b OR folded OR split_sensitive OR high_condition OR high_stretch
        OR low_area OR high_area OR high_shear OR high_dirichlet) AND ok) OR coalesce(j.cue,false) AS local_cue
    FROM cells c
    LEFT JOIN (SELECT package_id, row, col, bool_or(long OR short) AS cue,
        max(CASE WHEN ratio IS NULL OR isnan(ratio) THEN 0 WHEN ratio=0 OR NOT isfinite(ratio) THEN 1 ELSE least(abs(log2(CASE WHEN ratio>0 THEN ratio ELSE 1 END))/2,1e0) END) AS edge_score
        FROM ratio_cells GROUP BY 1,2,3) e ON e.package_id=c.package_id AND e.row=c.row AND e.col=c.col
    LEFT JOIN (SELECT package_id, row, col, bool_or(jump) AS cue, max(least(angle/90,1e0)) AS jump_score FROM jump_cells GROUP BY 1,2,3) j
      ON j.package_id=c.package_id AND j.row=c.row AND j.col=c.col""",
)


def _log_score(ratio: str, scale: str) -> str:
    return f"(CASE WHEN {ratio} IS NULL OR isnan({ratio}) THEN 0e0 WHEN NOT isfinite({ratio}) THEN 1e0 ELSE least(log2(greatest(CASE WHEN isfinite({ratio}) THEN {ratio} ELSE 1e0 END,1e0))/{scale},1e0) END)"


_DEVIATION = f"greatest(area_ratio,{div('1e0', 'area_ratio')})"
define(
    "scored_cells",
    f"""SELECT *, CASE WHEN NOT ok THEN NULL WHEN degenerate_a OR degenerate_b OR folded THEN 1e0 ELSE greatest(coalesce(edge_score,0e0), coalesce(jump_score,0e0),
      {_log_score('condition_number', '2e0')}, {_log_score('symmetric_stretch', '1e0')}, {_log_score(_DEVIATION, '2e0')},
      CASE WHEN isnan(shear) THEN 0e0 ELSE least(shear/cos(pi()/6),1e0) END) END AS local_score FROM local_cells""",
)
