"""SQL of the one-by-one loops that check the operators run in rounds: folds over ordered lists, and components by reachability."""

from __future__ import annotations

from rooftally.plans.area import slab


def pick_pairs(name: str, src: str, keys: str, order: str) -> str:
    """``name``: (keys, gt_id, poly_id, iou) of ``src`` taken one by one in ``order``, each end once."""
    return f"""
{name}_l AS (SELECT {keys}, list_reduce(list({{g: [gt_id], p: [poly_id], iou: [iou]}} ORDER BY {order}), lambda a, x: CASE WHEN list_has_any(a.g, x.g) OR list_has_any(a.p, x.p) THEN a
  ELSE {{g: a.g || x.g, p: a.p || x.p, iou: a.iou || x.iou}} END) AS m FROM {src} GROUP BY {keys}),
{name} AS (SELECT {keys}, unnest(m.g) AS gt_id, unnest(m.p) AS poly_id, unnest(m.iou) AS iou FROM {name}_l)"""


def pick_groups(name: str, g: str, p: str, keys: str, iou: float) -> str:
    """``name``: (keys, gt_id) of the boxes of ``g`` accepted against unions of ``p``; ``name``_hit: (keys, gt_id, poly_id), their predictions."""
    on = " AND ".join(f"g.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    gk = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_n AS (SELECT {gk}, gt_id, poly_id, p.x0, p.y0, p.x1, p.y1 FROM {g} g JOIN {p} p ON {on} AND g.x0 <= p.x1 AND p.x0 <= g.x1 AND g.y0 <= p.y1 AND p.y0 <= g.y1),
{name}_c AS (SELECT {gk}, gt_id, greatest(g.x0, p.x0) AS x0, greatest(g.y0, p.y0) AS y0, least(g.x1, p.x1) AS x1, least(g.y1, p.y1) AS y1 FROM {g} g JOIN {p} p ON {on} AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1),
{slab(f"{name}_w", f"{name}_n", keys + ", gt_id")},
{slab(f"{name}_i", f"{name}_c", keys + ", gt_id")},
{name}_m AS (SELECT {keys}, gt_id, list(poly_id) AS p FROM {name}_n GROUP BY {keys}, gt_id),
{name}_o AS (SELECT {gk}, g.gt_id, i.union_area / CAST(w.union_area + g.area - i.union_area AS DOUBLE) AS iou, m.p FROM {g} g JOIN {name}_w w USING ({keys}, gt_id) JOIN {name}_i i USING ({keys}, gt_id) JOIN {name}_m m USING ({keys}, gt_id)),
{name}_l AS (SELECT {keys}, list_reduce(list({{g: [gt_id], p: p}} ORDER BY iou DESC, gt_id), lambda a, x: CASE WHEN len(list_filter(x.p, lambda y: NOT list_contains(a.p, y))) > 0 THEN {{g: a.g || x.g, p: a.p || x.p}} ELSE a END) AS m
  FROM {name}_o WHERE iou >= {iou} GROUP BY {keys}),
{name} AS (SELECT {keys}, unnest(m.g) AS gt_id FROM {name}_l),
{name}_hit AS (SELECT n.* EXCLUDE (x0, y0, x1, y1) FROM {name}_n n SEMI JOIN {name} USING ({keys}, gt_id))"""


def counted(name: str, g: str, p: str, keys: str, gt: str, hit: str) -> str:
    """``name``: keys, tp, fp, fn, precision, recall, f1, from matched rows ``gt`` and ``hit``."""
    return f"""
{name}_s AS (SELECT {keys}, sum(n_gt) AS n_gt, sum(n_pred) AS n_pred, sum(tp) AS tp, sum(hit) AS hit FROM (SELECT {keys}, count(*) AS n_gt, 0 AS n_pred, 0 AS tp, 0 AS hit FROM {g} GROUP BY {keys}
  UNION ALL SELECT {keys}, 0, count(*), 0, 0 FROM {p} GROUP BY {keys} UNION ALL SELECT {keys}, 0, 0, count(*), 0 FROM {gt} GROUP BY {keys} UNION ALL SELECT {keys}, 0, 0, 0, count(DISTINCT poly_id) FROM {hit} GROUP BY {keys}) GROUP BY {keys}),
{name}_t AS (SELECT {keys}, CAST(tp AS BIGINT) AS tp, CAST(n_pred - hit AS BIGINT) AS fp, CAST(n_gt - tp AS BIGINT) AS fn FROM {name}_s),
{name} AS (SELECT *, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM {name}_t)"""


def suppressed(name: str, edges: str, keys: str, order: str) -> str:
    """``name``: (id) of the nodes that go. edges: (keys, h, l, columns of ``order``), h before l."""
    group, by = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
{name}_d AS (SELECT {group}h, {order} , list(l) AS d FROM {edges} GROUP BY ALL),
{name}_l AS (SELECT {group}list_reduce(list({{k: [h], d: d}} ORDER BY {order}, h), lambda a, x: CASE WHEN list_has_any(a.d, x.k) THEN a ELSE {{k: a.k || x.k, d: a.d || x.d}} END) AS m FROM {name}_d {by}),
{name} AS (SELECT DISTINCT unnest(m.d) AS id FROM {name}_l)"""


def components(name: str, edges: str) -> str:
    """``name``: (node, component) of the nodes of ``edges`` (a, b); needs WITH RECURSIVE."""
    return f"""
{name}_e AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
{name}_r AS (SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM {name}_e) UNION SELECT r.node, e.b FROM {name}_r r JOIN {name}_e e ON r.seen = e.a),
{name} AS (SELECT node, min(seen) AS component FROM {name}_r GROUP BY node)"""


def recursive(views: str) -> str:
    return views.replace("WITH ", "WITH RECURSIVE ", 1)


def larger_stays(name: str, src: str, keys: str) -> str:
    """``name``: (id) of what goes when boxes look at later ones in order: src (keys, i, j, larger)."""
    return f"""
{name}_n AS (SELECT {keys}, i, list({{j: j, larger: larger}} ORDER BY j) AS n FROM {src} GROUP BY ALL),
{name}_l AS (SELECT {keys}, list_reduce(list({{i: i, n: n, d: CAST([] AS BIGINT[])}} ORDER BY i), lambda a, x: CASE WHEN list_contains(a.d, x.i) THEN a ELSE {{i: x.i, n: x.n, d: list_concat(a.d, list_transform(
  list_filter([{{v: list_filter(x.n, lambda y: NOT list_contains(a.d, y.j))}}], lambda z: len(z.v) > 0), lambda z: list_concat(list_transform(list_filter(z.v, lambda y, k: len(list_filter(z.v, lambda q, o: o <= k AND NOT q.larger)) = 0), lambda y: y.j),
  CASE WHEN len(list_filter(z.v, lambda q: NOT q.larger)) > 0 THEN [x.i] ELSE CAST([] AS BIGINT[]) END))[1])}} END, {{i: CAST(-1 AS BIGINT), n: CAST([] AS STRUCT(j BIGINT, larger BOOLEAN)[]), d: CAST([] AS BIGINT[])}}) AS m FROM {name}_n GROUP BY {keys}),
{name} AS (SELECT DISTINCT unnest(m.d) AS id FROM {name}_l)"""
