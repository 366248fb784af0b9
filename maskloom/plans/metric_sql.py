"""SQL of the composite metrics, by exhaustive search where the queries use algorithms: all ways to assign the items of a
group, and detections taken one by one."""

from __future__ import annotations

import re

THRESHOLD = "(CAST(0.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * {i})"


def matched(pairs: str, keys: list[str], extra: str = "w", suffix: str = "") -> str:
    """CTEs that end in ``matched(keys, l, r, w, x)``, their names with ``suffix``: the assignment of greatest total weight, by trying all. ``pairs``: keys, l, r,
    w > 0 and what ``x`` is. An item needs its n best partners only, where n items compete."""
    k = ", ".join(keys)
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM c.{c}" for c in keys)
    text = f"""pairs0 AS ({pairs}), pairs1 AS (SELECT {k}, l, r, w, {extra} AS x, dense_rank() OVER (PARTITION BY {k} ORDER BY l) AS li, row_number() OVER (PARTITION BY {k}, l ORDER BY w DESC, r) AS k FROM pairs0),
      pairs2 AS (SELECT *, max(li) OVER (PARTITION BY {k}) AS n FROM pairs1),
      choice AS (SELECT {k}, li, n, l, r, w, x FROM pairs2 WHERE k <= n UNION ALL SELECT DISTINCT {k}, li, n, l, NULL, 0.0, NULL FROM pairs2),
      search AS (SELECT DISTINCT {k}, n, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(0 AS DOUBLE) AS total, CAST([] AS STRUCT(l BIGINT, r BIGINT, w DOUBLE, x DOUBLE)[]) AS chosen FROM choice
        UNION ALL SELECT {", ".join(f"s.{c}" for c in keys)}, s.n, s.i + 1, CASE WHEN c.r IS NULL THEN s.used ELSE list_append(s.used, c.r) END, s.total + c.w,
          CASE WHEN c.r IS NULL THEN s.chosen ELSE list_append(s.chosen, struct_pack(l := c.l, r := c.r, w := CAST(c.w AS DOUBLE), x := CAST(c.x AS DOUBLE))) END
        FROM search s JOIN choice c ON {same} AND c.li = s.i + 1 WHERE c.r IS NULL OR NOT list_contains(s.used, c.r)),
      best AS (SELECT {k}, unnest(chosen) AS m FROM (SELECT * FROM search WHERE i = n QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY total DESC) = 1)),
      matched AS (SELECT {k}, m.l AS l, m.r AS r, m.w AS w, m.x AS x FROM best)"""
    return re.sub(r"\b(pairs[012]|choice|search|best|matched)\b", lambda m: m.group() + suffix, text)


def cgf1(by: str | None = None) -> str:
    """CTEs from ``units`` ([by,] n_gt, n_dt, ws: IoUs of the matches) to ``final`` ([by,] metric, threshold, value)."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {g}i, thr" if by else "GROUP BY i, thr"
    both = "n_gt > 0 AND n_dt > 0"
    names = ["precision", "recall", "F1", "positive_micro_precision", "positive_micro_F1", "positive_macro_F1", "cgF1", "cgF1_macro", "perfect"]
    image = {
        "IL_precision": "ip", "IL_recall": "ir", "IL_F1": "2 * ip * ir / (ip + ir + 1e-6)", "IL_FPR": "il_fp / (il_fp + il_tn + 1e-6)", "IL_MCC": "mcc", "J": "sum_iou / nullif(n_matched, 0)",
    }
    union = " UNION ALL ".join(
        [f"SELECT {g}'{m}' AS metric, CAST(NULL AS DOUBLE) AS threshold, CAST({e} AS DOUBLE) AS value FROM il WHERE i = 0" for m, e in image.items()]
        + [f"SELECT {g}'{m}', NULL, avg({m}) FROM each_ {'GROUP BY ' + by if by else ''}" for m in names]
        + [f"SELECT {g}'{m}', thr, {m} FROM each_ WHERE i IN (0, 5)" for m in names]
    )
    return f"""cells AS (SELECT *, len(list_filter(coalesce(ws, []), lambda w: w >= thr)) AS tp FROM (SELECT u.*, i, {THRESHOLD.format(i='i')} AS thr FROM units u, (SELECT unnest(range(10)) AS i))),
      rated AS (SELECT *, 2 * p * r / (p + r + 1e-4) AS f1 FROM (SELECT *, tp / (n_dt + 1e-4) AS p, tp / (n_gt + 1e-4) AS r FROM cells)),
      sums AS (SELECT {g}i, thr, CAST(count(*) FILTER (WHERE {both}) AS DOUBLE) AS il_tp, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt > 0) AS DOUBLE) AS il_fp, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt = 0) AS DOUBLE) AS il_tn,
        CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt = 0) AS DOUBLE) AS il_fn, sum(tp) AS tp, sum(n_gt) AS n_gt, sum(n_dt) AS n_dt, coalesce(sum(n_dt) FILTER (WHERE n_gt > 0), 0) AS n_dt_positive, sum(f1) FILTER (WHERE {both}) AS f1_sum,
        count(*) FILTER (WHERE {both}) AS n_both, count(*) FILTER (WHERE (n_gt > 0 OR n_dt > 0) AND tp = n_gt AND tp = n_dt) AS perfect_, sum(list_sum(coalesce(ws, []))) AS sum_iou, sum(least(n_gt, n_dt)) FILTER (WHERE {both}) AS n_matched FROM rated {group}),
      il AS (SELECT *, il_tp / (il_tp + il_fp + 1e-6) AS ip, il_tp / (il_tp + il_fn + 1e-6) AS ir, (il_tp * il_tn - il_fp * il_fn) / (sqrt(il_tp + il_fp) * sqrt(il_tp + il_fn) * sqrt(il_tn + il_fp) * sqrt(il_tn + il_fn) + 1e-6) AS mcc FROM sums),
      pr AS (SELECT *, tp / (n_dt + 1e-4) AS precision, tp / (n_gt + 1e-4) AS recall, tp / (n_dt_positive + 1e-4) AS positive_micro_precision FROM il),
      pf AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-4) AS F1, 2 * positive_micro_precision * recall / (positive_micro_precision + recall + 1e-4) AS positive_micro_F1, f1_sum / nullif(n_both, 0) AS positive_macro_F1,
        perfect_ / nullif(il_tp + il_fp + il_fn, 0) AS perfect FROM (SELECT * FROM pr)),
      each_ AS (SELECT *, positive_micro_F1 * mcc AS cgF1, positive_macro_F1 * mcc AS cgF1_macro FROM pf),
      final AS ({union})"""


HOTA_METRICS = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA", "OWTA"]


def hota(combined: bool) -> str:
    """CTEs from ``g`` and ``r`` (seq, t, id, box), ``s`` (seq, t, gt, tr, sim), ``a`` (seq, gt, tr, align) and ``matched`` to ``final``."""
    each = f"""alphas AS (SELECT unnest(range(19)) AS i), hit AS (SELECT m.seq, i, m.l AS gt, m.r AS tr, m.x AS sim FROM matched m, alphas WHERE m.x >= CAST(0.05 AS DOUBLE) * (i + 1) - 2.220446049250313e-16),
      ng AS (SELECT seq, id AS gt, count(*) AS n_gt FROM g GROUP BY ALL), nr AS (SELECT seq, id AS tr, count(*) AS n_tr FROM r GROUP BY ALL),
      pt AS (SELECT seq, i, gt, tr, count(*) AS m, sum(sim) AS s FROM hit GROUP BY ALL),
      su AS (SELECT seq, i, sum(m) AS tp, sum(s) AS loc, sum(m * m / greatest(1, n_gt + n_tr - m)) AS a, sum(m * m / greatest(1, n_gt)) AS ar, sum(m * m / greatest(1, n_tr)) AS ap FROM pt JOIN ng USING (seq, gt) JOIN nr USING (seq, tr) GROUP BY seq, i),
      sq AS (SELECT seq, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM (SELECT seq, sum(n_gt) AS n1 FROM ng GROUP BY seq) FULL JOIN (SELECT seq, sum(n_tr) AS n2 FROM nr GROUP BY seq) USING (seq)),
      one AS (SELECT sq.seq, alphas.i, coalesce(tp, 0) AS tp, n1 - coalesce(tp, 0) AS fn, n2 - coalesce(tp, 0) AS fp, coalesce(loc, 0) AS loc, coalesce(a / greatest(1, tp), 0) AS ass, coalesce(ar / greatest(1, tp), 0) AS ar, coalesce(ap / greatest(1, tp), 0) AS ap
        FROM sq CROSS JOIN alphas LEFT JOIN su ON su.seq = sq.seq AND su.i = alphas.i)"""
    units = "cu AS (SELECT i, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(loc) AS loc, sum(ass * tp) / greatest(1, sum(tp)) AS ass, sum(ar * tp) / greatest(1, sum(tp)) AS ar, sum(ap * tp) / greatest(1, sum(tp)) AS ap FROM one GROUP BY i)" if combined else "cu AS (SELECT * FROM one)"
    key = "" if combined else "seq, "
    return f"""{each}, {units}, v AS (SELECT *, tp / greatest(1, tp + fn) AS DetRe, tp / greatest(1, tp + fp) AS DetPr, tp / greatest(1, tp + fn + fp) AS DetA, greatest(1e-10, loc) / greatest(1e-10, tp) AS LocA FROM cu),
      w AS (SELECT *, ass AS AssA, ar AS AssRe, ap AS AssPr, sqrt(DetA * ass) AS HOTA, sqrt(DetRe * ass) AS OWTA FROM v),
      final AS (SELECT {key}{", ".join(f"round(avg({m}), 6) AS {m}" for m in HOTA_METRICS)}, max(HOTA) FILTER (WHERE i = 0) AS h0, max(LocA) FILTER (WHERE i = 0) AS l0 FROM w {'GROUP BY seq' if key else ''})"""


def ap(unit: str, settings: str) -> str:
    """CTEs from ``t`` (unit, category, gt, crowd, area), ``d`` (unit, category, det, score, area) and ``p`` (unit, category, det, gt, iou) to ``final`` (setting, category,
    thr_idx, ap, recall, n_gt). ``settings``: rows (setting, low, high, most), low null: any area."""
    return f"""st(setting, low, high, most) AS (VALUES {settings}),
      t1 AS (SELECT t.*, setting, crowd OR NOT coalesce(low IS NULL OR (area >= low AND area <= high), FALSE) AS ignored FROM t, st),
      d0 AS (SELECT d.*, setting, most, coalesce(low IS NULL OR (area >= low AND area <= high), FALSE) AS inside, row_number() OVER (PARTITION BY setting, {unit}, category ORDER BY score DESC, det) AS k FROM d, st WHERE score IS NOT NULL),
      d1 AS (SELECT * FROM d0 WHERE k <= most), th AS (SELECT unnest(range(10)) AS thr_idx), tv AS (SELECT thr_idx, {THRESHOLD.format(i='thr_idx')} AS thr FROM th),
      near AS (SELECT d1.setting, d1.{unit}, d1.category, d1.det, d1.score, p.gt, p.iou, t1.ignored FROM d1 JOIN p ON p.{unit} = d1.{unit} AND p.category = d1.category AND p.det = d1.det
        JOIN t1 ON t1.setting = d1.setting AND t1.{unit} = p.{unit} AND t1.category = p.category AND t1.gt = p.gt WHERE p.iou >= 0.5),
      cand AS (SELECT setting, {unit}, category, thr_idx, det, score, list(gt ORDER BY iou DESC, gt) AS gts FROM near, tv WHERE NOT ignored AND iou >= thr GROUP BY ALL),
      cand2 AS (SELECT *, row_number() OVER (PARTITION BY setting, {unit}, category, thr_idx ORDER BY score DESC, det) AS k FROM cand),
      walk AS (SELECT DISTINCT setting, {unit}, category, thr_idx, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det, FALSE AS hit FROM cand2
        UNION ALL SELECT c.setting, c.{unit}, c.category, c.thr_idx, c.k, CASE WHEN len(list_filter(c.gts, lambda x: NOT list_contains(w.used, x))) > 0 THEN list_append(w.used, list_filter(c.gts, lambda x: NOT list_contains(w.used, x))[1]) ELSE w.used END,
          c.det, len(list_filter(c.gts, lambda x: NOT list_contains(w.used, x))) > 0 FROM walk w JOIN cand2 c ON c.setting = w.setting AND c.{unit} = w.{unit} AND c.category = w.category AND c.thr_idx = w.thr_idx AND c.k = w.k + 1),
      hits AS (SELECT setting, {unit}, category, thr_idx, det FROM walk WHERE hit), excused AS (SELECT DISTINCT setting, {unit}, category, thr_idx, det FROM near, tv WHERE ignored AND iou >= thr),
      line AS (SELECT d1.setting, d1.{unit}, d1.category, d1.det, d1.score, tv.thr_idx, h.det IS NOT NULL AS hit FROM d1 CROSS JOIN tv LEFT JOIN hits h ON h.setting = d1.setting AND h.{unit} = d1.{unit} AND h.category = d1.category AND h.det = d1.det AND h.thr_idx = tv.thr_idx
        LEFT JOIN excused e ON e.setting = d1.setting AND e.{unit} = d1.{unit} AND e.category = d1.category AND e.det = d1.det AND e.thr_idx = tv.thr_idx WHERE h.det IS NOT NULL OR (inside AND e.det IS NULL)),
      ngt AS (SELECT setting, category, count(*) FILTER (WHERE NOT ignored) AS n_gt FROM t1 GROUP BY ALL),
      run AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER o AS tp, count(*) OVER o AS n FROM line WINDOW o AS (PARTITION BY setting, category, thr_idx ORDER BY score DESC, {unit}, det ROWS UNBOUNDED PRECEDING)),
      pts AS (SELECT setting, category, thr_idx, floor(tp / n_gt * 100 + 1e-9) AS level, tp / n AS p, tp / n_gt AS rec FROM run JOIN ngt USING (setting, category) WHERE hit AND n_gt > 0),
      cell AS (SELECT setting, category, thr_idx, level, max(p) AS p, max(rec) AS rec FROM pts GROUP BY ALL),
      env AS (SELECT setting, category, thr_idx, l, max(p) AS p FROM cell JOIN (SELECT unnest(range(101)) AS l) ON level >= l GROUP BY ALL),
      aps AS (SELECT setting, category, thr_idx, sum(p) / 101 AS ap FROM env GROUP BY ALL), recs AS (SELECT setting, category, thr_idx, max(rec) AS recall FROM cell GROUP BY ALL),
      final AS (SELECT n.setting, n.category, CAST(th.thr_idx AS INTEGER) AS thr_idx, CASE WHEN n_gt > 0 THEN coalesce(ap, 0) END AS ap, CASE WHEN n_gt > 0 THEN coalesce(recall, 0) END AS recall, n_gt
        FROM ngt n CROSS JOIN th LEFT JOIN aps a ON a.setting = n.setting AND a.category = n.category AND a.thr_idx = th.thr_idx LEFT JOIN recs c ON c.setting = n.setting AND c.category = n.category AND c.thr_idx = th.thr_idx)"""


TETA_METRICS = ["LocA", "LocRe", "LocPr", "AssocA", "AssocRe", "AssocPr", "ClsA", "ClsRe", "ClsPr"]


def teta() -> str:
    """CTEs from ``tg`` and ``tr`` (seq, t, id, cls, box) and ``sims`` (seq, t, gt, tr, gcls, rcls, sim) to ``teta`` (cls and the metrics)."""
    align = lambda name, keys, g, r, s: f"""{name}u AS (SELECT *, sum(sim) OVER (PARTITION BY {keys}, t, gt) + sum(sim) OVER (PARTITION BY {keys}, t, tr) - sim AS u FROM {s}),
      {name} AS (SELECT {keys}, gt, tr, p / (n_gt + n_tr - p) AS align FROM (SELECT {keys}, gt, tr, sum(sim / u) AS p FROM {name}u GROUP BY ALL) JOIN (SELECT {keys}, id AS gt, count(*) AS n_gt FROM {g} GROUP BY ALL) USING ({keys}, gt)
        JOIN (SELECT {keys}, id AS tr, count(*) AS n_tr FROM {r} GROUP BY ALL) USING ({keys}, tr))"""  # noqa: E731
    weights = lambda name, keys, s: f"SELECT s.*, s.gt AS l, s.tr AS r, align * sim AS w FROM {s} s JOIN {name} USING ({keys}, gt, tr) WHERE align * sim > 0"
    return f"""near AS (SELECT * FROM sims WHERE sim >= 0.5), used AS (SELECT DISTINCT seq, tr FROM near), tru AS (SELECT * FROM tr WHERE (seq, id) IN (SELECT seq, tr FROM used)), su AS (SELECT * FROM sims WHERE (seq, tr) IN (SELECT seq, tr FROM used)),
      {align("ala", "seq", "tg", "tru", "su")}, {matched(weights("ala", "seq", "su"), ["seq", "t"], "sim", "_a")},
      taken AS (SELECT DISTINCT m.seq, m.t, m.r AS tr, g.cls AS taken FROM matched_a m JOIN tg g ON g.seq = m.seq AND g.t = m.t AND g.id = m.l WHERE m.x >= 0.5 - 2.220446049250313e-16),
      ov AS (SELECT DISTINCT n.seq, n.t, n.tr, n.gcls AS cls FROM near n LEFT JOIN taken k ON k.seq = n.seq AND k.t = n.t AND k.tr = n.tr WHERE k.taken IS NULL OR k.taken = n.gcls),
      pt AS (SELECT DISTINCT seq, tr, cls FROM ov), ot AS (SELECT r.seq, p.cls, r.t, r.id FROM tr r JOIN pt p ON p.seq = r.seq AND p.tr = r.id), os AS (SELECT s.seq, s.gcls AS cls, s.t, s.gt, s.tr, s.rcls, s.sim FROM sims s JOIN pt p ON p.seq = s.seq AND p.tr = s.tr AND p.cls = s.gcls),
      {align("alb", "seq, cls", "tg", "ot", "os")}, {matched(weights("alb", "seq, cls", "os"), ["seq", "cls", "t"], "sim", "_b")},
      mt AS (SELECT m.seq, m.cls, m.t, m.l AS gt, m.r AS tr, m.x AS sim, r.cls AS rcls FROM matched_b m JOIN tr r ON r.seq = m.seq AND r.t = m.t AND r.id = m.r),
      ta AS (SELECT unnest(range(20)) AS i), ht AS (SELECT mt.*, i FROM mt, ta WHERE sim >= CAST(0.05 AS DOUBLE) * i - 2.220446049250313e-16),
      q1 AS (SELECT h.seq, h.cls, h.i, count(*) AS tp, count(o.tr) AS om, count(*) FILTER (WHERE h.i >= 10 AND h.rcls = h.cls) AS ctp, count(*) FILTER (WHERE h.i >= 10 AND h.rcls <> h.cls) AS cfn FROM ht h LEFT JOIN ov o ON o.seq = h.seq AND o.cls = h.cls AND o.t = h.t AND o.tr = h.tr GROUP BY ALL),
      q2 AS (SELECT seq, cls, i, sum(m * m / greatest(1, n_gt + n_tr - m)) AS a, sum(m * m / greatest(1, n_gt)) AS ar, sum(m * m / greatest(1, n_tr)) AS ap FROM (SELECT seq, cls, i, gt, tr, count(*) AS m FROM ht GROUP BY ALL)
        JOIN (SELECT seq, cls, id AS gt, count(*) AS n_gt FROM tg GROUP BY ALL) USING (seq, cls, gt) JOIN (SELECT seq, cls, id AS tr, count(*) AS n_tr FROM ot GROUP BY ALL) USING (seq, cls, tr) GROUP BY seq, cls, i),
      q3 AS (SELECT seq, rcls AS cls, i, count(*) AS wrong FROM ht WHERE i >= 10 AND rcls <> cls GROUP BY ALL), q4 AS (SELECT seq, cls, count(*) AS n_truth FROM tg GROUP BY ALL), q5 AS (SELECT seq, cls, count(*) AS n_ov FROM ov GROUP BY ALL),
      q6 AS (SELECT r.seq, r.cls, count(*) AS n_called FROM tr r WHERE NOT EXISTS (SELECT 1 FROM ov o WHERE o.seq = r.seq AND o.t = r.t AND o.tr = r.id AND o.cls = r.cls) GROUP BY ALL),
      qu AS (SELECT seq, cls FROM q4 UNION SELECT seq, cls FROM q5 UNION SELECT seq, cls FROM q6),
      qa AS (SELECT qu.seq, qu.cls, ta.i, coalesce(tp, 0) AS tp, coalesce(n_truth, 0) - coalesce(tp, 0) AS fn, coalesce(n_ov, 0) - coalesce(om, 0) AS fp, coalesce(ctp, 0) AS ctp, coalesce(cfn, 0) AS cfn, CASE WHEN ta.i >= 10 THEN coalesce(wrong, 0) + coalesce(n_called, 0) ELSE 0 END AS cfp,
        coalesce(a / greatest(1, tp), 0) AS a, coalesce(ar / greatest(1, tp), 0) AS ar, coalesce(ap / greatest(1, tp), 0) AS ap FROM qu CROSS JOIN ta LEFT JOIN q1 ON q1.seq = qu.seq AND q1.cls = qu.cls AND q1.i = ta.i LEFT JOIN q2 ON q2.seq = qu.seq AND q2.cls = qu.cls AND q2.i = ta.i
        LEFT JOIN q3 ON q3.seq = qu.seq AND q3.cls = qu.cls AND q3.i = ta.i LEFT JOIN q4 ON q4.seq = qu.seq AND q4.cls = qu.cls LEFT JOIN q5 ON q5.seq = qu.seq AND q5.cls = qu.cls LEFT JOIN q6 ON q6.seq = qu.seq AND q6.cls = qu.cls),
      qc AS (SELECT cls, i, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(ctp) AS ctp, sum(cfn) AS cfn, sum(cfp) AS cfp, sum(a * tp) / greatest(1, sum(tp)) AS AssocA, sum(ar * tp) / greatest(1, sum(tp)) AS AssocRe, sum(ap * tp) / greatest(1, sum(tp)) AS AssocPr FROM qa GROUP BY cls, i),
      qm AS (SELECT *, tp / greatest(1, tp + fn + fp) AS LocA, tp / greatest(1, tp + fn) AS LocRe, tp / greatest(1, tp + fp) AS LocPr, CASE WHEN i >= 10 THEN ctp / greatest(1, ctp + cfn + cfp) END AS ClsA, CASE WHEN i >= 10 THEN ctp / greatest(1, ctp + cfn) END AS ClsRe, CASE WHEN i >= 10 THEN ctp / greatest(1, ctp + cfp) END AS ClsPr FROM qc),
      teta0 AS (SELECT cls, {", ".join(f"avg({m}) * 100 AS {m}" for m in TETA_METRICS)} FROM qm GROUP BY cls), teta AS (SELECT *, (LocA + AssocA + ClsA) / 3 AS TETA FROM teta0)"""
