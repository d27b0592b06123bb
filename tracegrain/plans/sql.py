"""DuckDB SQL of the catalogue, put together from named table expressions.

Each entry of :data:`CTES` may use the ones before it; :func:`query` adds those
that a statement needs. All literals of doubles are written with an exponent,
since others are decimals.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "pings": """
  SELECT event_id AS ping_id, user_id AS deviceid, lat, lon, datetime, CAST(datetime AS DATE) AS day FROM (
    SELECT event_id, user_id,
           (45900000 + 20000 * (user_id % 10) + 2000 * (k % 10) + CASE WHEN event_type = 'error' AND value > 150 THEN 1000000 ELSE 0 END) / 1e6 AS lat,
           (14300000 + 30000 * ((user_id // 10) % 10) + 3000 * (k // 10)) / 1e6 AS lon,
           TIMESTAMP '2023-03-27 00:00:00' + to_seconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 30000000) AS datetime
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "raw": """
  SELECT ping_id, 'dev' || deviceid AS deviceid, strftime(datetime, '%d.%m.%Y') AS date, strftime(datetime, '%H:%M:%S') AS time, lon, lat FROM pings""",
    "towers": """
  SELECT s_suppkey AS tower_id, (45900000 + 6000 * (s_suppkey % 33)) / 1e6 AS lat, (14300000 + 9000 * ((s_suppkey * 7) % 33)) / 1e6 AS lon FROM supplier""",
    "zones": """
  SELECT CAST(15 * i + j AS INTEGER) AS zone_id FROM range(11) a(i), range(11) b(j)""",
    "prev": """
  SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(datetime) OVER w AS pt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon,
         row_number() OVER w AS r
  FROM pings WINDOW w AS (PARTITION BY day, deviceid ORDER BY datetime, ping_id)""",
    "meters": """
  SELECT *, epoch(datetime) - epoch(pt) AS gap,
         2 * 6371000e0 * atan2(sqrt((CASE WHEN a > 1 THEN 1e0 ELSE a END)), sqrt(1 - (CASE WHEN a > 1 THEN 1e0 ELSE a END))) AS hav, 2 * 6371000e0 * asin(sqrt((CASE WHEN a > 1 THEN 1e0 ELSE a END))) AS hav_asin
  FROM (SELECT *, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2) AS a FROM prev)""",
    "deltas": """
  SELECT *, r = 1 AS device_change, CASE WHEN r = 1 THEN 0e0 ELSE hav END AS dist_m, CASE WHEN r = 1 THEN 0 ELSE CAST(greatest(gap, 1) AS BIGINT) END AS dt,
         CASE WHEN r = 1 THEN 0e0 ELSE hav / greatest(gap, 1) END AS speed_m_s FROM meters""",
    "angles": """
  SELECT *, degrees(CASE WHEN abs(b2 - b1) > pi() THEN 2 * pi() - abs(b2 - b1) ELSE abs(b2 - b1) END) AS turn,
    CASE WHEN na = 0 OR nb = 0 THEN 0e0 ELSE degrees(acos(greatest(least(((plat - lat) * (nlat - lat) + (plon - lon) * (nlon - lon)) / (na * nb), 1e0), -1e0))) END AS interior
  FROM (SELECT *, sqrt(pow(plat - lat, 2) + pow(plon - lon, 2)) AS na, sqrt(pow(nlat - lat, 2) + pow(nlon - lon, 2)) AS nb,
    atan2(sin(radians(lon) - radians(plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon) - radians(plon))) AS b1,
    atan2(sin(radians(nlon) - radians(lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon) - radians(lon))) AS b2
    FROM deltas)""",
    "tower_ok": """
  SELECT p.* FROM pings p WHERE NOT EXISTS (
    SELECT 1 FROM towers t WHERE 6371000e0 * sqrt(pow(radians(t.lat) - radians(p.lat), 2) + pow(radians(t.lon) - radians(p.lon), 2)) <= 10)""",
    "repeat_ok": """
  SELECT p.* FROM tower_ok p JOIN (SELECT day, lat, lon, count(*) AS n FROM tower_ok GROUP BY ALL) c USING (day, lat, lon) WHERE n < 6""",
    "c_prev": """
  SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(datetime) OVER w AS pt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon
  FROM repeat_ok WINDOW w AS (PARTITION BY day, deviceid ORDER BY datetime, ping_id)""",
    "c_deltas": """
  SELECT *, greatest(epoch(datetime) - epoch(pt), 1) AS gap, 2 * 6371000e0 * atan2(sqrt(a), sqrt(1 - a)) / greatest(epoch(datetime) - epoch(pt), 1) AS speed_m_s,
    atan2(sin(radians(lon) - radians(plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon) - radians(plon))) AS b1,
    atan2(sin(radians(nlon) - radians(lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon) - radians(lon))) AS b2
  FROM (SELECT *, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2) AS a FROM c_prev)""",
    "zheng_ok": """
  SELECT * FROM c_deltas WHERE plat IS NOT NULL AND nlat IS NOT NULL AND speed_m_s < 30
    AND (degrees(CASE WHEN abs(b2 - b1) > pi() THEN 2 * pi() - abs(b2 - b1) ELSE abs(b2 - b1) END) > 30 OR gap > 10)""",
    "sliding_ok": """
  SELECT * FROM (SELECT *, median(speed_m_s) OVER (PARTITION BY day, deviceid ORDER BY datetime, ping_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM zheng_ok)
  WHERE speed_m_s <= m + 5""",
    "clean": """
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY day, deviceid) AS n FROM sliding_ok) WHERE n > 3""",
    "zoned": """
  SELECT *, CASE WHEN lat < 46.111e0 THEN CAST(floor((lat - 45.891e0) / 0.02e0) * 15 + floor((lon - 14.29e0) / 0.03e0) AS INTEGER) END AS zone_id,
         CAST(hour(datetime) AS INTEGER) AS time_bin FROM pings""",
    "inside": "SELECT * FROM zoned WHERE zone_id IS NOT NULL",
    "moves": """
  SELECT *, 2 * 6371000e0 * atan2(sqrt((CASE WHEN a > 1 THEN 1e0 ELSE a END)), sqrt(1 - (CASE WHEN a > 1 THEN 1e0 ELSE a END))) / greatest(epoch(datetime) - epoch(pt), 1) AS speed_m_s
  FROM (SELECT *, pow(sin((radians(lat) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2) AS a
        FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(datetime) OVER w AS pt, lag(zone_id) OVER w AS prev_zone, lead(zone_id) OVER w AS next_zone,
                     lead(time_bin) OVER w AS next_bin, lead(datetime) OVER w AS nt, row_number() OVER w AS at
              FROM inside WINDOW w AS (PARTITION BY day, deviceid ORDER BY datetime, ping_id)))""",
    "f_speed": """
  SELECT zone_id, time_bin, avg(speed_m_s) AS speed_mean, quantile_cont(speed_m_s, 0.5) AS speed_median, min(speed_m_s) AS speed_min, max(speed_m_s) AS speed_max,
         CASE WHEN count(speed_m_s) > 1 THEN var_samp(speed_m_s) END AS speed_var, quantile_cont(speed_m_s, 0.25) AS speed_q25, quantile_cont(speed_m_s, 0.75) AS speed_q75
  FROM moves GROUP BY zone_id, time_bin""",
    "by_device": """
  SELECT zone_id, time_bin, deviceid, count(*) AS k, CAST(epoch(max(datetime)) - epoch(min(datetime)) AS BIGINT) AS dwell_s FROM moves GROUP BY ALL""",
    "f_density": """
  SELECT zone_id, time_bin, CAST(sum(k) AS BIGINT) AS ping_count, count(*) AS unique_devs, sum(k) / count(*) AS pings_per_dev FROM by_device GROUP BY zone_id, time_bin""",
    "f_entropy": """
  SELECT zone_id, time_bin, greatest(log2(sum(k)) - sum(k * log2(k)) / sum(k), 0e0) AS dev_entropy FROM by_device GROUP BY zone_id, time_bin""",
    "f_dwell": """
  SELECT zone_id, time_bin, avg(dwell_s) AS dwell_mean, quantile_cont(dwell_s, 0.5) AS dwell_median, CAST(min(dwell_s) AS DOUBLE) AS dwell_min, CAST(max(dwell_s) AS DOUBLE) AS dwell_max
  FROM by_device GROUP BY zone_id, time_bin""",
    "f_entries": """
  SELECT zone_id, count(speed_m_s) AS in_count, avg(speed_m_s) AS in_speed_mean FROM moves WHERE prev_zone IS NULL OR prev_zone <> zone_id GROUP BY zone_id""",
    "f_exits": """
  SELECT zone_id, count(speed_m_s) AS out_count, avg(speed_m_s) AS out_speed_mean FROM moves WHERE next_zone IS NULL OR next_zone <> zone_id GROUP BY zone_id""",
    "f_trans": """
  SELECT zone_id, greatest(log2(sum(k)) - sum(k * log2(k)) / sum(k), 0e0) AS trans_entropy
  FROM (SELECT zone_id, next_zone, count(*) AS k FROM moves WHERE next_zone <> zone_id GROUP BY ALL) GROUP BY zone_id""",
    "feats": """
  SELECT s.zone_id, s.time_bin, coalesce(speed_mean, 0) AS speed_mean, coalesce(speed_median, 0) AS speed_median, coalesce(speed_min, 0) AS speed_min,
         coalesce(speed_max, 0) AS speed_max, coalesce(speed_var, 0) AS speed_var, coalesce(speed_q25, 0) AS speed_q25, coalesce(speed_q75, 0) AS speed_q75,
         ping_count, unique_devs, pings_per_dev, dev_entropy, dwell_mean, dwell_median, dwell_min, dwell_max, coalesce(in_count, 0) AS in_count,
         coalesce(in_speed_mean, 0) AS in_speed_mean, coalesce(out_count, 0) AS out_count, coalesce(out_speed_mean, 0) AS out_speed_mean,
         coalesce(trans_entropy, 0) AS trans_entropy, s.time_bin IN (7, 8, 9) AS is_morning_commute, s.time_bin IN (16, 17, 18) AS is_evening_commute,
         s.time_bin <= 5 AS is_late_night, 0.5e0 AS prior_walk, 0.5e0 AS prior_car
  FROM f_speed s JOIN f_density USING (zone_id, time_bin) JOIN f_entropy USING (zone_id, time_bin) JOIN f_dwell USING (zone_id, time_bin)
  LEFT JOIN f_entries USING (zone_id) LEFT JOIN f_exits USING (zone_id) LEFT JOIN f_trans USING (zone_id)""",
    "adjacent": """
  SELECT *, zone_id AS from_zone, next_zone AS to_zone, coalesce(next_bin = time_bin, false) AND next_zone IS NOT NULL AS valid, coalesce(zone_id = next_zone, false) AS same_zone FROM moves""",
    "spent": """
  SELECT day, deviceid, time_bin, zone_id, CAST(sum(gap) AS BIGINT) AS seconds FROM (
    SELECT *, coalesce(epoch(lead(datetime) OVER (PARTITION BY day, deviceid, time_bin ORDER BY datetime, ping_id)) - epoch(datetime), 0) AS gap FROM inside)
  GROUP BY ALL""",
    "dominant": """
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY day, deviceid, time_bin ORDER BY seconds DESC, zone_id) AS r FROM spent) WHERE r = 1""",
    "trans": """
  SELECT time_bin, from_zone, to_zone, count(*) AS n FROM (
    SELECT time_bin, zone_id AS from_zone, lead(zone_id) OVER w AS to_zone, lead(time_bin) OVER w AS nb FROM dominant WINDOW w AS (PARTITION BY day, deviceid ORDER BY time_bin))
  WHERE nb = time_bin + 1 GROUP BY ALL""",
    "od": "SELECT from_zone, to_zone, CAST(sum(n) AS BIGINT) AS n FROM trans GROUP BY ALL",
    "distance": """
  SELECT day, deviceid, sum(coalesce(hav_asin, 0)) AS daily_distance_m, CAST(epoch(max(datetime)) - epoch(min(datetime)) AS BIGINT) AS trip_duration_s FROM meters GROUP BY day, deviceid""",
    "kmh": "SELECT *, CASE WHEN gap > 0 THEN hav / gap * 3.6e0 END AS speed_kmh FROM meters",
    "per_device": "SELECT day, deviceid, count(*) AS k FROM pings GROUP BY ALL",
    "counts": "SELECT deviceid, count(*) AS n FROM pings GROUP BY ALL",
    "intervals": """
  SELECT day, round(avg(gap), 2) AS mean_s, round(quantile_cont(gap, 0.5), 2) AS median_s, round(stddev_samp(gap), 2) AS std_s FROM meters GROUP BY day""",
    "days": """
  SELECT * FROM (SELECT day, CAST(sum(k) AS BIGINT) AS total_points, count(*) AS unique_devices, round(avg(k), 2) AS avg_points_per_device,
         quantile_cont(CAST(k AS DOUBLE), 0.5) AS median_points_per_device, round(stddev_samp(k), 2) AS std_points_per_device FROM per_device GROUP BY day)
  JOIN intervals USING (day)
  JOIN (SELECT day, round(avg(CASE WHEN hour(datetime) BETWEEN 6 AND 20 THEN 1e0 ELSE 0e0 END) * 100, 2) AS day_pct,
               round(100 - avg(CASE WHEN hour(datetime) BETWEEN 6 AND 20 THEN 1e0 ELSE 0e0 END) * 100, 2) AS night_pct FROM pings GROUP BY day) USING (day)
  JOIN (SELECT day, round((epoch(max(datetime)) - epoch(min(datetime))) / 3600, 2) AS hours_covered, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
               round((max(lat) - min(lat)) * (max(lon) - min(lon)) * 12321, 2) AS area_km2 FROM pings GROUP BY day) USING (day)""",
    "stays": """
  SELECT day, deviceid, t0 AS arrival, t1 AS leave, avg(p.lat) AS stay_lat, avg(p.lon) AS stay_lon, (epoch(t1) - epoch(t0)) / 60 AS duration_min
  FROM (SELECT s.day, s.deviceid, s.r AS a, s.nxt AS b, x.datetime AS t0, y.datetime AS t1
        FROM scan s JOIN prev x ON x.day = s.day AND x.deviceid = s.deviceid AND x.r = s.r JOIN prev y ON y.day = s.day AND y.deviceid = s.deviceid AND y.r = s.nxt
        WHERE epoch(y.datetime) - epoch(x.datetime) > 1200) v
  JOIN prev p USING (day, deviceid) WHERE p.r >= v.a AND p.r < v.b GROUP BY ALL""",
}
# The stay-point scan: from each ping the first later one farther than 200 m, followed from the first ping on.
_FAR = """2 * 6371000e0 * atan2(sqrt({a}), sqrt(1 - {a})) > 200""".format(
    a="pow(sin((radians(y.lat) - radians(x.lat)) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin((radians(y.lon) - radians(x.lon)) / 2), 2)"
)
SCAN = f"""
hops AS (SELECT x.day, x.deviceid, x.r, min(y.r) AS nxt FROM prev x JOIN prev y ON x.day = y.day AND x.deviceid = y.deviceid AND y.r > x.r AND {_FAR} GROUP BY ALL),
scan AS (SELECT * FROM hops WHERE r = 1 UNION ALL SELECT h.* FROM scan s JOIN hops h ON h.day = s.day AND h.deviceid = s.deviceid AND h.r = s.nxt)"""


#: DBSCAN labels: cores reach each other from those that have no earlier core near; clusters are numbered by their first core, and a border point is of its first cluster.
CLUSTERS = """place AS MATERIALIZED ({rows}),
near AS MATERIALIZED (SELECT a.g, a.ping_id AS a, b.ping_id AS b FROM place a JOIN place b ON a.g = b.g WHERE {near}),
core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT g, a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (SELECT a AS x, a AS r FROM core WHERE a NOT IN (SELECT a FROM link WHERE b < a) UNION SELECT l.b, reach.r FROM reach JOIN link l ON l.a = reach.x),
root AS (SELECT x, min(r) AS r FROM reach GROUP BY x),
numbered AS (SELECT x, CAST(dense_rank() OVER (PARTITION BY g ORDER BY r) - 1 AS INTEGER) AS k FROM root JOIN place ON ping_id = x),
labels AS (
  SELECT p.ping_id AS a, p.g, coalesce(c.k, e.k, -1) AS cluster FROM place p LEFT JOIN numbered c ON c.x = p.ping_id
  LEFT JOIN (SELECT near.a, min(k) AS k FROM near JOIN numbered ON x = near.b GROUP BY near.a) e ON e.a = p.ping_id)"""


def _vincenty(turns: int = 12) -> str:
    """``ping_id, gap, m``: metres on the ellipsoid from a device's ping to its next, by so many turns of the inverse formula."""
    f, a = "(1 / 298.257223563e0)", "6378137e0"
    at = "*, sin(lam) AS sl, cos(lam) AS cl, sqrt(pow(cos(u2) * sl, 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cl, 2)) AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cl AS c"
    at += ", atan2(s, c) AS sigma, CASE WHEN s = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sl / s END AS sa, 1 - sa * sa AS ca2, CASE WHEN ca2 = 0 THEN 0e0 ELSE c - 2 * sin(u1) * sin(u2) / ca2 END AS cm"
    at += f", {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS k"
    text = f"SELECT ping_id, gap, atan((1 - {f}) * tan(radians(plat))) AS u1, atan((1 - {f}) * tan(radians(lat))) AS u2, radians(lon - plon) AS len, radians(lon - plon) AS lam FROM meters WHERE gap > 0"
    for _ in range(turns):
        text = f"SELECT ping_id, gap, u1, u2, len, len + (1 - k) * {f} * sa * (sigma + k * s * (cm + k * c * (2 * cm * cm - 1))) AS lam FROM (SELECT {at} FROM ({text}))"
    b = f"((1 - {f}) * {a})"
    big = f"*, ca2 * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS u, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big_a, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS big_b"
    d = "big_b * s * (cm + big_b / 4 * (c * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))"
    return f"SELECT ping_id, gap, CASE WHEN s = 0 THEN 0e0 ELSE {b} * big_a * (sigma - {d}) END AS m FROM (SELECT {big} FROM (SELECT {at} FROM ({text})))"


VINCENTY = _vincenty()


def query(select: str, before: str = "") -> str:
    """``select`` with the table expressions that it and ``before``, its own recursive ones, need."""
    needed: set[str] = set()
    todo = [select, before]
    while todo:
        text = todo.pop()
        for name in {*CTES, "scan"} - needed:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\b", text):
                needed.add(name)
                todo.append(SCAN if name == "scan" else CTES[name])
    parts = []
    for name in CTES:
        if name == "stays" and "scan" in needed:
            parts.append(SCAN.strip())
        if name in needed:
            parts.append(f"{name} AS ({CTES[name]}\n)")
    parts += [before] * bool(before)
    return (f"WITH {'RECURSIVE ' if 'scan' in needed or before else ''}" + ",\n".join(parts) + "\n" if parts else "") + select.strip()
