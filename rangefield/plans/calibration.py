"""Ground-truth residuals, path-loss fits, auto-apply, pins."""

from __future__ import annotations

LAST = """SELECT node_id, value FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM settings) z WHERE k = 1"""
CURRENT = """current_n AS (SELECT node_id, absorption FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM absorptions) z WHERE k = 1)"""
PIN_BIAS = """biases AS (SELECT p.device_id, p.pin_ts, f.node_id, f.distance / sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)) AS bias,
      sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)) AS true_dist, p.x, p.y, p.z
    FROM pins p JOIN obs f ON p.device_id = f.device_id JOIN nodes n ON f.node_id = n.node_id
    WHERE f.distance IS NOT NULL AND sqrt((p.x-n.x)*(p.x-n.x)+(p.y-n.y)*(p.y-n.y)+(p.z-n.z)*(p.z-n.z)) >= 1.0D),
  kept AS (SELECT * FROM biases WHERE bias >= 0.2D AND bias <= 5.0D)"""

QUERIES: dict[str, str] = {
    "a01_gt_residuals": """SELECT listener_id, count(*) AS n, round(avg(measured - true_dist), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0.0D ELSE stddev_pop(measured - true_dist) END, 6) AS sigma, max(t_ms) AS last_ms FROM gt_samples GROUP BY listener_id""",
    "a03_residual_spread": "SELECT listener_id, transmitter_id, round(avg(measured - true_dist), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0.0D ELSE stddev_pop(measured - true_dist) END, 6) AS sigma FROM gt_samples GROUP BY listener_id, transmitter_id",
    "a06_pair_fits": "SELECT listener_id, transmitter_id, samples, round(w, 5) AS w, round(n, 6) AS n, round(r2, 6) AS r2, round(mean_true, 6) AS mean_true, round(mean_measured, 6) AS mean_measured FROM pair_fits",
    "a07_log_log_fit": """SELECT listener_id, round(least(greatest((w * swxy - swx * swy) / (w * swxx - swx * swx), 1.5D), 8.0D), 6) AS slope, round((swy - (w * swxy - swx * swy) / (w * swxx - swx * swx) * swx) / w, 6) AS offset_k,
        round(CASE WHEN w * swyy - swy * swy > 1e-9 THEN least((w * swxy - swx * swy) * (w * swxy - swx * swy) / ((w * swxx - swx * swx) * (w * swyy - swy * swy)), 1.0D) ELSE 0.0D END, 6) AS r2 FROM (
        SELECT listener_id, sum(w) AS w, sum(w * lx) AS swx, sum(w * ly) AS swy, sum(w * lx * ly) AS swxy, sum(w * lx * lx) AS swxx, sum(w * ly * ly) AS swyy FROM (
          SELECT listener_id, exp(-(last_ms - t_ms) / 3600000.0D) AS w, ln(true_dist) AS lx, absorption * ln(measured) AS ly FROM (SELECT *, max(t_ms) OVER (PARTITION BY listener_id) AS last_ms FROM ring) a) b GROUP BY listener_id) c
        WHERE w >= 5 AND abs(w * swxx - swx * swx) >= 1e-9""",
    "a08_node_fit": "SELECT listener_id, samples, round(n, 6) AS n, round(r2, 6) AS r2, round(2.0D * sqrt(1.0D - r2), 5) AS iqr, samples >= 100 AND r2 >= 0.5D AS confident FROM node_fits",
    "a09_absorption_mode": """SELECT listener_id, absorption, n FROM (SELECT listener_id, absorption, count(*) AS n, row_number() OVER (PARTITION BY listener_id ORDER BY count(*) DESC, min(t_ms), absorption) AS k FROM gt_valid GROUP BY listener_id, absorption) m WHERE k = 1""",
    "a13_rf_sums": """SELECT count(*) AS pairs, round(sum(w), 6) AS w, round(sum(w * x * x), 4) AS sxx, round(sum(w * x * y), 4) AS sxy, round(sum(w * y * y), 4) AS syy FROM (
        SELECT 1.0D / count(*) OVER (PARTITION BY listener_id) AS w, ln(mean_true) AS x, n * ln(mean_measured) AS y FROM pair_fits) p""",
    "a23_pair_deltas": "SELECT listener_id, transmitter_id, round(n - mean_n, 6) AS delta, n < 2 AS sub_physical FROM (SELECT *, avg(n) OVER (PARTITION BY listener_id) AS mean_n FROM pair_fits) p",
    "a18_coverage": "SELECT round(avg(least(1.0D, k / 3.0D)), 6) AS coverage FROM (SELECT n.node_id, count(f.transmitter_id) AS k FROM nodes n LEFT JOIN pair_fits f ON n.node_id = f.listener_id GROUP BY n.node_id) c",
    "a11_pin_bias": f"WITH {PIN_BIAS} SELECT device_id, pin_ts, node_id, count(*) AS n, round(avg(bias), 6) AS mean, round(stddev_pop(bias), 6) AS sigma FROM kept GROUP BY device_id, pin_ts, node_id",
    "a12_reference_rssi": f"""WITH {PIN_BIAS} SELECT device_id, pin_ts, CAST(floor(-59.0D + median(-27.0D * log10(mean)) + 0.5D) AS BIGINT) AS ref_rssi FROM (
        SELECT device_id, pin_ts, node_id, avg(bias) AS mean FROM kept WHERE true_dist >= 2 GROUP BY device_id, pin_ts, node_id) m GROUP BY device_id, pin_ts HAVING count(*) >= 3""",
    "j03_pin_correction": f"""WITH {PIN_BIAS} SELECT q.device_id, q.node_id, round(CASE WHEN sum(g) >= 0.05D THEN sum(g * mean) / sum(g) ELSE 1.0D END, 6) AS bias FROM (
        SELECT m.device_id, m.node_id, m.mean, exp(-((m.x-6.0D)*(m.x-6.0D)+(m.y-5.0D)*(m.y-5.0D)+(m.z-1.0D)*(m.z-1.0D)) / 9.0D) * (0.2D + 0.8D * least(50, m.n) / 50.0D) AS g FROM (
          SELECT device_id, pin_ts, node_id, x, y, z, avg(bias) AS mean, count(*) AS n FROM kept GROUP BY device_id, pin_ts, node_id, x, y, z) m) q GROUP BY q.device_id, q.node_id""",
    "p02_pin_rows": f"WITH {PIN_BIAS} SELECT device_id, pin_ts, count(DISTINCT node_id) AS nodes, count(*) AS samples FROM kept GROUP BY device_id, pin_ts",
    "x10_shrunk_bias": f"WITH {PIN_BIAS} SELECT device_id, node_id, round(1.0D + 0.5D * (avg(bias) - 1.0D), 6) AS shrunk FROM kept GROUP BY device_id, node_id",
    "f09_plausible_bias": f"WITH {PIN_BIAS} SELECT device_id, count(*) AS n FROM kept GROUP BY device_id",
    "f15_auto_apply": f"""WITH {CURRENT} SELECT node_id, round(current_value, 6) AS current_value, round(proposed, 6) AS proposed,
          CASE WHEN NOT confident THEN 'not confident' WHEN current_value <= 0 THEN 'no current' WHEN abs(proposed - current_value) < 0.1D THEN 'small' WHEN proposed < 2 OR proposed > 7 THEN 'range' ELSE 'apply' END AS verdict,
          round(current_value + least(greatest(proposed - current_value, -1.0D), 1.0D), 2) AS stepped
        FROM (SELECT f.listener_id AS node_id, f.n AS proposed, c.absorption AS current_value, f.samples >= 100 AND f.r2 >= 0.5D AS confident FROM node_fits f JOIN current_n c ON f.listener_id = c.node_id) a""",
    "p03_calibration_health": f"""WITH {CURRENT} SELECT f.listener_id AS node_id, CASE WHEN NOT (f.samples >= 100 AND f.r2 >= 0.5D) OR coalesce(c.absorption, 0.0D) <= 0 THEN 'none' WHEN abs(f.n - c.absorption) < 0.1D THEN 'settled'
        WHEN abs(f.n - c.absorption) < 0.3D THEN 'drifting' ELSE 'significant' END AS health FROM node_fits f LEFT JOIN current_n c ON f.listener_id = c.node_id""",
    "p04_residual_colour": "SELECT listener_id, CASE WHEN abs(avg(measured - true_dist)) < 0.5D THEN 'green' WHEN abs(avg(measured - true_dist)) < 1.5D THEN 'amber' ELSE 'red' END AS colour FROM gt_samples GROUP BY listener_id",
    "f11_calibrated_nodes": "SELECT coalesce(n.node_id, g.listener_id) AS node_id, coalesce(g.n, 0) AS gt_count FROM all_nodes n FULL JOIN (SELECT listener_id, count(*) AS n FROM gt_samples GROUP BY listener_id) g ON n.node_id = g.listener_id WHERE n.node_id IS NOT NULL OR g.n > 0",
    "j02_ground_truth": "SELECT listener_id, transmitter_id, count(*) AS n, round(min(true_dist), 6) AS true_dist FROM gt_samples GROUP BY listener_id, transmitter_id",
    "j13_symmetric_r2": "SELECT a.node_id AS a, b.node_id AS b, round(greatest(coalesce(f.r2, 0.0D), coalesce(g.r2, 0.0D)), 6) AS r2 FROM nodes a JOIN nodes b ON a.node_id < b.node_id LEFT JOIN pair_fits f ON f.listener_id = a.node_id AND f.transmitter_id = b.node_id LEFT JOIN pair_fits g ON g.listener_id = b.node_id AND g.transmitter_id = a.node_id",
    "j16_heard_by": "SELECT f.transmitter_id, f.listener_id, n.x, n.y, round(f.n, 6) AS n FROM pair_fits f JOIN nodes n ON f.listener_id = n.node_id",
    "t02_calibration_order": "SELECT listener_id, row_number() OVER (ORDER BY round(abs(avg(measured - true_dist)), 9) DESC, listener_id) AS place FROM gt_samples GROUP BY listener_id",
    "t03_fits_by_samples": "SELECT listener_id, row_number() OVER (ORDER BY samples DESC, listener_id) AS place FROM node_fits",
    "t05_pins_newest": "SELECT device_id, pin_ts, row_number() OVER (PARTITION BY device_id ORDER BY pin_ts DESC) AS place FROM pins",
    "t08_audit_recent": "SELECT node_id, t_ms, seq, value FROM settings ORDER BY t_ms DESC, seq DESC LIMIT 200",
    "m04_pins_after_delete": "SELECT p.device_id, p.pin_ts FROM pins p LEFT JOIN (SELECT device_id, max(pin_ts) AS gone FROM pins GROUP BY device_id) d ON p.device_id = d.device_id AND p.pin_ts = d.gone WHERE d.gone IS NULL",
    "m05_residuals_since_reset": "SELECT g.listener_id, count(*) AS n FROM gt_samples g JOIN (SELECT node_id, max(t_ms) * 7 % 12000000 AS reset_ms FROM settings GROUP BY node_id) r ON g.listener_id = r.node_id WHERE g.t_ms > r.reset_ms GROUP BY g.listener_id",
    "m06_upstream_upsert": "SELECT coalesce(u.device_id, o.device_id) AS device_id, u.seq AS upstream_seq, o.last_seen FROM (SELECT device_id, max(seq) AS seq FROM upstream GROUP BY device_id) u FULL JOIN (SELECT device_id, max(t_ms) AS last_seen FROM obs GROUP BY device_id) o ON u.device_id = o.device_id",
    "m08_manual_apply": "SELECT node_id, 'site/rooms/' || node_id || '/absorption/set' AS topic, round(absorption, 2) AS payload, true AS retain FROM absorptions WHERE absorption > 2.5D",
    "k01_outbox": f"WITH {CURRENT} SELECT 'site/rooms/' || f.listener_id || '/absorption/set' AS topic, round(f.n, 2) AS payload, 1 AS qos, true AS retain FROM node_fits f JOIN current_n c ON f.listener_id = c.node_id WHERE abs(f.n - c.absorption) >= 0.1D",
    "k07_scaled_rooms": "SELECT room_id, v, round(x * 1.1D, 3) AS x, round(y * 1.1D, 3) AS y FROM vertices",
    "w16_cycles": "SELECT {div: t_ms; 300000} AS cycle, listener_id, count(*) AS n FROM gt_samples GROUP BY {div: t_ms; 300000}, listener_id",
    "w17_rebuild": "SELECT listener_id, count(*) AS kept, count(DISTINCT transmitter_id) AS pairs FROM ring WHERE n >= 1.5D AND n <= 8.0D GROUP BY listener_id",
    "a22_recent_audit": "SELECT count(CASE WHEN t_ms >= c.last_ms - 3600 THEN 1 END) AS n FROM settings s CROSS JOIN (SELECT max(t_ms) AS last_ms FROM settings) c",
    "a27_totals": "SELECT (SELECT count(*) FROM gt_samples) AS residuals, (SELECT count(*) FROM pins) AS pins, (SELECT count(DISTINCT node_id) FROM parsed WHERE kind = 'status' AND lower(trim(payload)) = 'online') AS online",
}
