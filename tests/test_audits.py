"""Greedy queries against plain loops on the smallest tables."""

from rooftally.plans import audits, finals
from rooftally.sources.views import view

SF = "/root/testdata/sf0.001"


def _iou(a, b):
    w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    inter = w * h if w > 0 and h > 0 else 0
    return inter / (a.area + b.area - inter)


def test_spaced_pick_equals_the_loop(spark):
    got = {r.grid_id: r.chosen_by for r in audits.j7_spaced_pick(spark, SF).collect()}
    score = {}
    for r in view(spark, SF, "predictions").select("grid_id", "area").collect():
        score[r.grid_id] = score.get(r.grid_id, 0) + r.area
    order = sorted((r for r in view(spark, SF, "task_grid").collect() if r.grid_id in score), key=lambda r: (-score[r.grid_id], r.grid_id))
    want = {}
    for region in {r.region for r in order}:
        own, chosen = [r for r in order if r.region == region], []
        for g in own:
            if len(chosen) < 12 and all(abs(c.gx - g.gx) > 2 or abs(c.gy - g.gy) > 2 for c in chosen):
                chosen.append(g)
        rest = [g for g in own if g not in chosen][: 12 - len(chosen)]
        want |= {g.grid_id: "spaced" for g in chosen} | {g.grid_id: "fill" for g in rest}
    assert got == want


def test_stable_reindex_keeps_old_order(spark):
    rows = audits.f17_stable_reindex(spark, SF).collect()
    new = {r.poly_id: r for r in view(spark, SF, "predictions").collect()}
    assert len(rows) == len(new)
    free, want = {}, {}
    for r in new.values():
        free.setdefault((r.region, r.model_run, r.grid_id), []).append(r)
    for g in sorted(view(spark, SF, "ground_truth").collect(), key=lambda r: r.gt_id):
        for run in ("run_A", "run_B", "run_C"):
            own = free.get((g.region, run, g.grid_id), [])
            fits = [(-_iou(g, p), p.poly_id, p) for p in own if _iou(g, p) > 0.5]
            if fits:
                best = min(fits, key=lambda x: x[:2])[2]
                own.remove(best)
                want[best.poly_id] = g.gt_id
    assert {r.poly_id: r.old_id for r in rows if r.old_id is not None} == want
    places = {}
    for r in rows:
        places.setdefault((r.region, r.model_run, r.grid_id), []).append((r.place, r.old_id is None, r.old_id or 0, r.poly_id))
    for group in places.values():
        group.sort()
        assert [x[0] for x in group] == list(range(1, len(group) + 1))
        assert [x[1:] for x in group] == sorted(x[1:] for x in group)


def test_duplicates_across_cells_leave_one(spark):
    kept = {r.poly_id for r in audits.f14_dedup_cross_grid(spark, SF).collect()}
    cells = {r.grid_id: r for r in view(spark, SF, "task_grid").collect()}
    boxes = [r for r in view(spark, SF, "predictions").where("review_status <> 'delete'").collect()]
    at = {r.poly_id: (cells[r.grid_id].gx * 3000, cells[r.grid_id].gy * 3000) for r in boxes}
    stay = []
    for p in sorted(boxes, key=lambda r: (-r.area, r.poly_id)):
        px, py = at[p.poly_id]
        for q in stay:
            qx, qy = at[q.poly_id]
            if q.grid_id == p.grid_id or abs(px + p.x0 - qx - q.x0) > 400 or abs(py + p.y0 - qy - q.y0) > 400:
                continue
            w = min(px + p.x1, qx + q.x1) - max(px + p.x0, qx + q.x0)
            h = min(py + p.y1, qy + q.y1) - max(py + p.y0, qy + q.y0)
            inter = w * h if w > 0 and h > 0 else 0
            dx, dy = (px * 2 + p.x0 + p.x1 - qx * 2 - q.x0 - q.x1) / 2, (py * 2 + p.y0 + p.y1 - qy * 2 - q.y0 - q.y1) / 2
            if inter / (p.area + q.area - inter) >= 0.3 and dx * dx + dy * dy <= 22500:
                break
        else:
            stay.append(p)
    assert kept == {p.poly_id for p in stay}


def test_sizes_add_up(spark):
    rows = audits.h9_recall_by_size(spark, SF).collect()
    assert {r.level for r in rows} == {0.3, 0.5, 0.7} and all(0 <= r.tp <= r.n_gt for r in rows)
    by = {(r.model_run, r.size_class, r.level): r.tp for r in rows}
    assert all(by[a, b, 0.3] >= by[a, b, 0.7] for a, b, _ in by)
    assert sum(r.n for r in audits.h8_area_error_by_size(spark, SF).collect()) == sum(r.n for r in audits.h7_footprint_quality(spark, SF).collect())


def test_dissolved_ground_truth_equals_union_find(spark):
    rows = view(spark, SF, "ground_truth").collect()
    up = {r.gt_id: r.gt_id for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a.gt_id < b.gt_id and (a.region, a.grid_id) == (b.region, b.grid_id):
                w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
                if w > 0 and h > 0 and w * h > 100:
                    x, y = sorted((top(a.gt_id), top(b.gt_id)))
                    up[y] = x
    want = {}
    for r in rows:
        want.setdefault(top(r.gt_id), []).append(r.source)
    got = {r.component: (r.n_members, r.source) for r in audits.f10_dissolve_clean_gt(spark, SF).collect()}
    assert got == {k: (len(v), "+".join(sorted(set(v)))) for k, v in want.items()}


def test_composed_ground_truth_has_every_correct_drawn_and_marked_box(spark):
    """Whatever their confidence, and whatever their ids."""
    p, g = view(spark, SF, "predictions"), view(spark, SF, "ground_truth")
    assert p.where("review_status = 'correct' and confidence < 0.9").count() and g.where("source = 'marked' and gt_id % 2 = 1").count()
    rows = finals.k4_compose_clean_gt(spark, SF).collect()
    assert sum(r.n_members for r in rows) == p.where("review_status = 'correct'").count() + g.where("source in ('redrawn', 'marked')").count()
    assert {s for r in rows for s in r.source.split("+")} == {"correct", "added", "marked"}
