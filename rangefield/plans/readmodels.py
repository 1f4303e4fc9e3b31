"""Messages checked field by field, pins as they are read back, calibration rows of nodes, and settings that are applied by hand.

A message whose field has another JSON type than expected (a number as text, a
null) is dropped as a whole; fields that are absent are not missed, and others
than the known ones are not looked at.
"""

from __future__ import annotations

#: The fields of a node's telemetry, with their JSON types.
TELEMETRY = {
    "uptime": "number", "rssi": "number", "freeHeap": "number", "maxAllocHeap": "number", "memoryFragmentation": "number", "count": "number", "adverts": "number",
    "seen": "number", "reported": "number", "scanHighWater": "number", "ip": "string", "firmware": "string", "version": "string",
}
#: The fields of an observation, in both spellings.
OBSERVED = {
    "distance": "number", "rssi": "number", "ref_rssi": "number", "refRssi": "number", "name": "string", "dist_var": "number", "distVar": "number", "rssi_var": "number", "rssiVar": "number",
}


def sound(fields: dict[str, str]) -> str:
    """That a line is a JSON object whose known fields are absent or of their types."""
    return "{isjson: line} AND " + " AND ".join(f"{{kind: line; {name}}} IN ('absent', '{kind}')" for name, kind in fields.items())


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def read(fields: dict[str, str]) -> str:
    """The fields of a line as columns."""
    return ", ".join((f"{{num: {{json: line; {name}}}}}" if kind == "number" else f"{{json: line; {name}}}") + f" AS {snake(name)}" for name, kind in fields.items())


def number(name: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN {{kind: line; {name}}} = 'number' THEN {{num: {{json: line; {name}}}}} ELSE {otherwise} END"


def text(name: str) -> str:
    return f"CASE WHEN {{kind: line; {name}}} = 'string' THEN {{json: line; {name}}} END"


#: Bias of a pin at a node: the mean of five or more samples if it is plausible, else the distance when the pin was set; null without either, or within a metre.
ESTIMATE = """estimates AS (SELECT *, CASE WHEN true_dist < 1.0D THEN NULL WHEN n >= 5 AND mean >= 0.2D AND mean <= 5.0D THEN mean WHEN measured / true_dist >= 0.2D AND measured / true_dist <= 5.0D THEN measured / true_dist END AS bias,
      CASE WHEN true_dist < 1.0D THEN NULL WHEN n >= 5 AND mean >= 0.2D AND mean <= 5.0D THEN n WHEN measured / true_dist >= 0.2D AND measured / true_dist <= 5.0D THEN 1 END AS bias_samples FROM pin_nodes)"""
#: The reference level that would correct a device: the median over three or more nodes of what each one's ratio asks for.
DELTAS = """chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY CASE WHEN active THEN 0 ELSE 1 END, placed_ms DESC, pin_ts DESC) AS k FROM pin_states) c WHERE k = 1),
    current_n AS (SELECT node_id, absorption FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM absorptions) z WHERE k = 1),
    deltas AS (SELECT p.device_id, p.pin_ts, p.node_id, p.ratio, -10.0D * coalesce(a.absorption, 2.7D) * log10(p.ratio) AS delta FROM (
        SELECT q.device_id, q.pin_ts, q.node_id, CASE WHEN q.n >= 5 THEN q.mean ELSE q.measured / q.true_dist END AS ratio FROM pin_nodes q JOIN chosen c ON q.device_id = c.device_id AND q.pin_ts = c.pin_ts WHERE q.true_dist >= 1.0D) p
      LEFT JOIN current_n a ON p.node_id = a.node_id WHERE p.ratio > 0)"""

QUERIES: dict[str, str] = {
    "s03_checked_messages": f"""SELECT seq, device_id, node_id, distance, rssi, coalesce(ref_rssi_camel, ref_rssi) AS ref_rssi, name, coalesce(dist_var_camel, dist_var) AS dist_var, coalesce(rssi_var_camel, rssi_var) AS rssi_var FROM (
        SELECT seq, device_id, node_id, {read({k: v for k, v in OBSERVED.items() if "V" not in k and "R" not in k})}, {{num: {{json: line; refRssi}}}} AS ref_rssi_camel, {{num: {{json: line; distVar}}}} AS dist_var_camel, {{num: {{json: line; rssiVar}}}} AS rssi_var_camel
        FROM observed_lines WHERE {sound(OBSERVED)}) m""",
    "s05_telemetry_fields": f"""SELECT node_id, t_ms AS telemetry_at, true AS online, {", ".join(snake(x) for x in TELEMETRY)} FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM (
        SELECT node_id, seq, t_ms, {read(TELEMETRY)} FROM telemetry_lines WHERE {sound(TELEMETRY)}) t) l WHERE k = 1""",
    # reports more than a day old when they arrive are left out; without a time of its own a report is as old as its arrival
    "s06_checked_attributes": f"""SELECT device_id, seq, x, y, z, least(greatest(confidence / 100.0D, 0.0D), 1.0D) AS confidence, CAST(floor(fixes + 0.5D) AS BIGINT) AS fixes, scenario, last_seen FROM (
        SELECT device_id, seq, arrived_ms, {number("x")} AS x, {number("y")} AS y, {number("z")} AS z, {number("confidence", "0.0D")} AS confidence, {number("fixes", "0.0D")} AS fixes, {text("best_scenario")} AS scenario,
          coalesce(CAST({{div: {{us: try_cast({text("last_seen")} AS TIMESTAMP)}}; 1000}} AS BIGINT), arrived_ms) AS last_seen
        FROM attribute_lines WHERE {{isjson: line}}) a WHERE x IS NOT NULL AND y IS NOT NULL AND arrived_ms - last_seen <= 86400000""",
    "p02_pin_nodes": f"""WITH {ESTIMATE} SELECT e.device_id, e.pin_ts, s.active, e.node_id, round(e.measured, 6) AS measured, e.n, round(e.mean, 6) AS mean, CASE WHEN e.n > 0 THEN round(sqrt(greatest(e.mean2 - e.mean * e.mean, 0.0D)), 4) END AS sigma, round(e.bias, 6) AS bias, e.bias_samples
        FROM estimates e JOIN pin_states s ON e.device_id = s.device_id AND e.pin_ts = s.pin_ts""",
    "t05_pins_in_order": """SELECT device_id, pin_ts, placed_ms, active, active_until_ms, row_number() OVER (PARTITION BY device_id ORDER BY placed_ms DESC, pin_ts DESC) AS newest,
        row_number() OVER (PARTITION BY device_id ORDER BY CASE WHEN active THEN 0 ELSE 1 END, placed_ms DESC, pin_ts DESC) = 1 AS calibrates FROM pin_states""",
    "a12_pin_reference": f"WITH {DELTAS} SELECT device_id, pin_ts, count(*) AS nodes, CAST(floor(-59.0D + round(median(delta), 9) + 0.5D) AS BIGINT) AS ref_rssi FROM deltas GROUP BY device_id, pin_ts HAVING count(*) >= 3",
    "a12_pin_deltas": f"WITH {DELTAS} SELECT device_id, pin_ts, node_id, round(ratio, 6) AS ratio, round(delta, 6) AS delta FROM deltas",
    # bias at the places that the other system reports, shrunk towards 1 where little of a pin is near; only corrections above 0.1 count
    "x10_bias_at_places": f"""WITH {ESTIMATE} SELECT seq, device_id, node_id, round(w, 6) AS weight, round(CASE WHEN w < 0.05D THEN 1.0D ELSE 1.0D + least(1.0D, w) * (wb / w - 1.0D) END, 6) AS divisor FROM (
        SELECT u.seq, u.device_id, e.node_id, sum(g.g * (0.2D + 0.8D * least(50, e.bias_samples) / 50.0D)) AS w, sum(g.g * (0.2D + 0.8D * least(50, e.bias_samples) / 50.0D) * e.bias) AS wb
        FROM upstream u JOIN (SELECT p.device_id, p.pin_ts, v.seq, exp(-((p.x - v.x) * (p.x - v.x) + (p.y - v.y) * (p.y - v.y)) / 9.0D) AS g FROM pin_states p JOIN upstream v ON p.device_id = v.device_id) g ON u.seq = g.seq AND u.device_id = g.device_id
        JOIN estimates e ON g.device_id = e.device_id AND g.pin_ts = e.pin_ts WHERE e.bias IS NOT NULL GROUP BY u.seq, u.device_id, e.node_id) b
        WHERE CASE WHEN w < 0.05D THEN 1.0D ELSE 1.0D + least(1.0D, w) * (wb / w - 1.0D) END > 0.1D""",
    # nodes of the configuration, and others that have been measured; those with measured distances first, by how far they are off
    "k10_calibration_rows": """WITH off AS (SELECT listener_id, count(*) AS n, avg(measured - true_dist) AS mean, stddev_pop(measured - true_dist) AS sigma, max(t_ms) AS last_ms, {latest: transmitter_id; t_ms; l_orderkey; l_linenumber; l_partkey; l_suppkey} AS last_from,
          {latest: measured; t_ms; l_orderkey; l_linenumber; l_partkey; l_suppkey} AS last_measured, {latest: true_dist; t_ms; l_orderkey; l_linenumber; l_partkey; l_suppkey} AS last_true FROM gt_samples GROUP BY listener_id),
        said AS (SELECT node_id, value FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t_ms DESC, seq DESC) AS k FROM settings) z WHERE k = 1),
        heard AS (SELECT listener_id, count(*) AS pairs, max(r2) AS best_r2 FROM pair_fits GROUP BY listener_id)
        SELECT i.node_id, coalesce(o.n, 0) AS gt_count, round(coalesce(o.mean, 0.0D), 6) AS gt_mean, round(coalesce(o.sigma, 0.0D), 6) AS gt_sigma, o.last_from, round(o.last_measured, 6) AS last_measured, round(o.last_true, 6) AS last_true, coalesce(o.last_ms, 0) AS last_ms, s.value AS absorption_setting,
          coalesce(h.pairs, 0) AS pairs, round(h.best_r2, 6) AS best_r2, round(f.n, 6) AS proposed, coalesce(f.samples >= 100 AND f.r2 >= 0.5D, false) AS confident,
          row_number() OVER (ORDER BY CASE WHEN o.n > 0 THEN 2 ELSE 0 END DESC, round(abs(coalesce(o.mean, 0.0D)), 9) DESC, i.node_id) AS place
        FROM (SELECT listener_id AS node_id FROM off UNION SELECT node_id FROM said) i LEFT JOIN all_nodes c ON i.node_id = c.node_id LEFT JOIN off o ON i.node_id = o.listener_id LEFT JOIN said s ON i.node_id = s.node_id
        LEFT JOIN heard h ON i.node_id = h.listener_id LEFT JOIN node_fits f ON i.node_id = f.listener_id WHERE c.enabled OR o.n > 0""",
    # what a manual update sends: two digits for the exponent, whole numbers for levels, nothing for a value that is no number
    "m08_applied_settings": """SELECT seq, 'site/rooms/' || node_id || '/' || setting || '/set' AS topic, payload, true AS retain FROM (
        SELECT seq, node_id, 'absorption' AS setting, CAST({div: hundredths; 100} AS STRING) || '.' || lpad(CAST(hundredths % 100 AS STRING), 2, '0') AS payload FROM (SELECT seq, node_id, CAST(floor(absorption * 100.0D + 0.5D) AS BIGINT) AS hundredths FROM manual_updates WHERE absorption IS NOT NULL) a
        UNION ALL SELECT seq, node_id, 'rx_adj_rssi', CAST(CAST(floor(rx_adj + 0.5D) AS BIGINT) AS STRING) FROM manual_updates WHERE rx_adj IS NOT NULL
        UNION ALL SELECT seq, node_id, 'tx_ref_rssi', CAST(CAST(floor(tx_ref + 0.5D) AS BIGINT) AS STRING) FROM manual_updates WHERE tx_ref IS NOT NULL) s WHERE node_id <> ''""",
    # residuals of all nodes start anew with every update that does not say otherwise
    "m08_residuals_after_apply": """SELECT g.listener_id, count(*) AS n, round(avg(g.measured - g.true_dist), 6) AS mean FROM gt_samples g CROSS JOIN (
        SELECT max(t_ms) AS reset_ms FROM manual_updates WHERE resets AND node_id <> '') r WHERE g.t_ms > coalesce(r.reset_ms, -1) GROUP BY g.listener_id""",
}
