"""The registered queries as SQL for another engine, over the same tables."""

from floeline import schemas

def _zone_rows(zones: dict = schemas.SCORING_ZONES) -> str:
    rows = []
    for cam, points in zones.items():
        for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]]):
            rows.append(f"('{cam}', {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return ", ".join(rows)


# the zones once more, written out: corners in order, each with the next
_WIDE_ZONES = """
    ('cam_a', 0.38::DOUBLE, 0.00::DOUBLE, 1.00::DOUBLE, 0.00::DOUBLE), ('cam_a', 1.00, 0.00, 1.00, 1.00),
    ('cam_a', 1.00, 1.00, 0.64, 1.00), ('cam_a', 0.64, 1.00, 0.46, 0.53), ('cam_a', 0.46, 0.53, 0.38, 0.00),
    ('cam_b', 0.00, 0.00, 0.58, 0.00), ('cam_b', 0.58, 0.00, 0.46, 0.55), ('cam_b', 0.46, 0.55, 0.56, 1.00),
    ('cam_b', 0.56, 1.00, 0.00, 1.00), ('cam_b', 0.00, 1.00, 0.00, 0.00)"""

_CTES = {
    "ev": """
        SELECT event_id AS frame_id, ts, event_type, value, user_id, props,
               CASE WHEN user_id % 2 = 0 THEN 'cam_a' ELSE 'cam_b' END AS cam_id,
               regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k
        FROM events""",
    "mixed": """
        SELECT *, (frame_id * 7919 + k * 104729) % 1000 AS h, (day(ts) * 24 + hour(ts)) % 3 AS g
        FROM ev""",
    "areas": """
        SELECT frame_id, ts, event_type, value, cam_id, k,
               (CASE WHEN g = 0 AND event_type = 'signup' THEN 0 WHEN g = 0 THEN 50 * h
                     WHEN g = 1 THEN 200000 + 200 * h ELSE 500000 + 200 * h END)::INTEGER AS ice_field,
               (CASE WHEN g = 0 AND event_type = 'signup' THEN 0
                     ELSE (frame_id * 31 + k * 17) % 1000 * 100 END)::INTEGER AS broken_ice,
               (CASE WHEN g = 0 AND event_type = 'signup' THEN 0
                     ELSE (frame_id * 13 + k * 7) % 1000 * 100 END)::INTEGER AS slush_ice,
               (CASE WHEN event_type = 'error' THEN 50000 + 100 * h ELSE 0 END)::INTEGER AS vessel
        FROM mixed""",
    "frames": """
        SELECT *, 1000000 AS total_pixels, vessel > 0 AS vessel_present,
               ice_field + broken_ice + slush_ice AS ice_pixels,
               greatest(1, 1000000 - vessel) AS usable_pixels,
               floor((ice_field + broken_ice + slush_ice) / greatest(1, 1000000 - vessel) * 10000.0 + 0.5)
                   / 10000.0 AS ice_conc,
               CASE WHEN ice_field + broken_ice + slush_ice = 0 THEN 0.0::DOUBLE ELSE
                   floor((broken_ice * 0.65::DOUBLE + slush_ice * 0.85::DOUBLE)
                         / (ice_field + broken_ice + slush_ice) * 10000.0 + 0.5) / 10000.0 END AS ice_severity
        FROM areas""",
    "detections": """
        SELECT f.frame_id, f.ts, f.event_type, f.cam_id, c.class_name, f.ice_conc, f.ice_severity,
               ((f.frame_id * 37 + c.i * 11 + f.k) % 100) / 100 AS confidence,
               CASE c.i WHEN 0 THEN ice_field WHEN 1 THEN broken_ice ELSE slush_ice END AS area_pixels,
               ((frame_id * 3 + c.i * 101) % 1280)::INTEGER AS bbox_x1,
               ((frame_id * 5 + c.i * 53) % 720)::INTEGER AS bbox_y1,
               ((frame_id * 3 + c.i * 101) % 1280 + 1 + frame_id % 200)::INTEGER AS bbox_x2,
               ((frame_id * 5 + c.i * 53) % 720 + 1 + frame_id % 150)::INTEGER AS bbox_y2
        FROM frames f
        JOIN (VALUES (0, 'ice_field'), (1, 'broken_ice'), (2, 'slush_ice')) c(i, class_name)
          ON CASE c.i WHEN 0 THEN ice_field WHEN 1 THEN broken_ice ELSE slush_ice END > 0""",
    "copied": """
        SELECT * FROM detections UNION ALL SELECT * FROM detections WHERE event_type = 'purchase'""",
    "unique_detections": """
        SELECT DISTINCT ts, class_name, confidence, area_pixels, bbox_x1, bbox_y1, bbox_x2, bbox_y2,
               ice_conc, ice_severity, strftime(ts, '%Y-%m-%d') AS dt, cam_id
        FROM copied""",
    "cleaned": "SELECT * FROM unique_detections WHERE confidence > 0.3",
    "hours": """
        SELECT date_trunc('hour', ts) AS hour, cam_id, avg(ice_conc) AS avg_ice_conc,
               max(ice_conc) AS max_ice_conc, avg(ice_severity) AS avg_severity,
               count_if(vessel_present) AS vessel_count, count(*) AS total_frames
        FROM frames GROUP BY 1, 2""",
    "hourly": """
        SELECT *, CASE WHEN avg_ice_conc > 0.7 THEN 'danger' WHEN avg_ice_conc > 0.4 THEN 'caution'
                       ELSE 'safe' END AS danger_level
        FROM hours""",
    "covers": """
        SELECT *, ice_pixels / usable_pixels AS ice_cover, ice_field / usable_pixels AS field_cover,
               broken_ice / usable_pixels AS broken_cover, slush_ice / usable_pixels AS slush_cover,
               CASE WHEN ice_pixels > 0 THEN ice_field / ice_pixels ELSE 0.0::DOUBLE END AS field_share,
               CASE WHEN ice_pixels > 0 THEN broken_ice / ice_pixels ELSE 0.0::DOUBLE END AS broken_share,
               CASE WHEN ice_pixels > 0 THEN slush_ice / ice_pixels ELSE 0.0::DOUBLE END AS slush_share,
               CASE WHEN ice_pixels > 0 THEN (broken_ice + slush_ice) / ice_pixels ELSE 0.0::DOUBLE END AS loose_share
        FROM frames""",
    "rough": """
        SELECT *, greatest(0.0, least(0.7 * broken_share + 0.3 * slush_share, 1.0))::DOUBLE AS roughness
        FROM covers""",
    "kpis": """
        SELECT *, greatest(0.0, least(0.72 * field_cover + 0.18 * ice_cover + 0.10 * roughness, 1.0))::DOUBLE
                   AS scene_pressure
        FROM rough""",
    "trends": """
        SELECT *, list_reduce(
                   list(greatest(0.0, least(field_cover, 1.0))::DOUBLE) OVER (
                       PARTITION BY cam_id ORDER BY ts, frame_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
                   lambda a, b: 0.35::DOUBLE * b + (1.0::DOUBLE - 0.35::DOUBLE) * a) AS trend,
               row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC, frame_id DESC) AS age_rank,
               count(*) OVER (PARTITION BY cam_id) AS frame_count,
               (epoch_us((SELECT max(ts) FROM frames)) - epoch_us(ts)) / 1e6 AS age_sec
        FROM kpis""",
    "loads": """
        SELECT *, pow(0.5::DOUBLE, age_sec / 8.0) AS freshness,
               greatest(0.0, least(
                   (0.72 * greatest(0.0, least(field_cover, 1.0))::DOUBLE + 0.18 * scene_pressure + 0.10 * trend)
                   * (0.9 + 0.1 * pow(0.5::DOUBLE, age_sec / 8.0)), 1.0))::DOUBLE AS display_load
        FROM trends""",
    "kinds": """
        SELECT *, CASE WHEN ice_pixels = 0 THEN 'open_water'
                       WHEN field_cover >= 0.35 OR scene_pressure >= 0.45 THEN 'dense_field'
                       WHEN field_cover >= 0.16 THEN 'mixed_ice'
                       WHEN loose_share >= 0.65 THEN 'loose_ice' ELSE 'sparse_ice' END AS scene_kind,
               CASE WHEN ice_pixels = 0 THEN 'open_water'
                    WHEN ice_field >= broken_ice AND ice_field >= slush_ice THEN 'ice_field'
                    WHEN broken_ice >= slush_ice THEN 'broken_ice' ELSE 'slush_ice' END AS dominant_class
        FROM loads""",
    "cards": """
        SELECT cam_id, ts, least(field_cover, 1.0)::DOUBLE AS field_cover, least(ice_cover, 1.0)::DOUBLE AS ice_cover,
               loose_share, field_share, broken_cover, slush_cover, roughness, scene_pressure, trend,
               least(frame_count, 12)::INTEGER AS trend_points, age_sec, freshness, display_load, frame_count,
               scene_kind,
               CASE WHEN field_cover >= 0.35 OR display_load >= 0.45 THEN 'danger'
                    WHEN field_cover >= 0.16 OR display_load >= 0.20 THEN 'caution' ELSE 'ok' END AS scene_level,
               CASE WHEN scene_kind = 'dense_field' THEN 'ice_field' ELSE dominant_class END AS label_class
        FROM kinds WHERE age_rank = 1
        UNION ALL
        SELECT 'cam_c', NULL, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, NULL, 1, 0, 0, 'open_water', 'ok', 'open_water' AS label_class""",
    "result_stream": "SELECT * FROM frames",
    "stored": "SELECT * FROM frames",
    "cams": "SELECT * FROM (VALUES ('cam_a'), ('cam_b'), ('cam_c')) v(cam_id)",
    "status": """
        SELECT c.cam_id, coalesce(f.n, 0)::BIGINT AS frame_stream_len, f.last_ts AS last_frame_ts,
               coalesce(r.n, 0)::BIGINT AS result_stream_len, r.last_ts AS last_result_ts,
               coalesce(s.n, 0)::BIGINT AS db_rows, s.last_ts AS last_db_ts
        FROM cams c
        LEFT JOIN (SELECT cam_id, count(*) AS n, max(ts) AS last_ts FROM frames GROUP BY 1) f
               ON f.cam_id = c.cam_id
        LEFT JOIN (SELECT cam_id, count(*) AS n, max(ts) AS last_ts FROM result_stream GROUP BY 1) r
               ON r.cam_id = c.cam_id
        LEFT JOIN (SELECT cam_id, count(*) AS n, max(ts) AS last_ts FROM stored GROUP BY 1) s
               ON s.cam_id = c.cam_id""",
    "checks": """
        SELECT user_id, count_if(event_type = 'error') = 0 AS ok
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, frame_id DESC) AS r FROM ev)
        WHERE r <= 3 GROUP BY 1""",
    "sent": """
        SELECT *, epoch_us(ts) / 1e6 AS source_ts, epoch_us(ts) / 1e6 + value / 1000 AS processed_ts
        FROM frames""",
    "mask_pixels": """
        SELECT frame_id, cam_id, p.i, (frame_id * 7 + p.i * (1 + k % 5)) % 5 AS code
        FROM frames, (SELECT unnest(range(64)) AS i) p""",
    "elements": """
        SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'cam_a' ELSE 'cam_b' END AS cam_id,
               generate_subscripts(embedding, 1) - 1 AS i,
               floor((unnest(embedding)::DOUBLE + 1.0) * 1000000)::BIGINT AS l
        FROM embeddings""",
    "blocked": f"""
        SELECT c.cam_id, p.i
        FROM (SELECT unnest(range(64)) AS i) p
        JOIN (VALUES {_zone_rows(schemas.DISPLAY_ZONES)}) c(cam_id, x1, y1, x2, y2)
          ON (c.y1 > (p.i // 8 + 0.5) / 8) <> (c.y2 > (p.i // 8 + 0.5) / 8)
         AND (p.i % 8 + 0.5) / 8 < (c.x2 - c.x1) * ((p.i // 8 + 0.5) / 8 - c.y1) / nullif(c.y2 - c.y1, 0) + c.x1
        GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "candidates": """
        SELECT vec_id, cam_id, i % 8 AS x, l // 7 % 256 - 0.18 * (l // 256 % 256)::DOUBLE AS score
        FROM elements e
        WHERE l % 256 > 72 AND l // 256 % 256 < 190 AND i // 8 >= 1 AND i // 8 < 7
          AND NOT EXISTS (FROM blocked b WHERE b.cam_id = e.cam_id AND b.i = e.i)""",
    "cuts": """
        SELECT vec_id, quantile_cont(score, 0.5) AS split, quantile_cont(score, 0.4) AS low,
               quantile_cont(score, 0.6) AS high
        FROM candidates GROUP BY 1""",
    "sides": """
        SELECT e.vec_id, count(c.score) AS candidates, any_value(k.split) AS split, any_value(k.low) AS low,
               any_value(k.high) AS high, count_if(score <= split) AS m_ice, count_if(score > split) AS m_slush,
               count_if(score <= low) AS t_ice, count_if(score >= high) AS t_slush,
               count_if(CASE WHEN e.cam_id = 'cam_a' THEN x < 4 ELSE x > 3 END) AS c_ice
        FROM (SELECT DISTINCT vec_id, cam_id FROM elements) e
        LEFT JOIN candidates c ON c.vec_id = e.vec_id LEFT JOIN cuts k ON k.vec_id = e.vec_id
        GROUP BY 1""",
    "ruled": """
        SELECT *, CASE WHEN candidates = 0 THEN 'none' WHEN m_ice >= 10 AND m_slush >= 10 THEN 'median'
                       WHEN t_ice >= 10 OR t_slush >= 10 THEN 'tails' ELSE 'columns' END AS rule
        FROM sides""",
    "centres": """
        SELECT frame_id, ts, cam_id, class_name, (bbox_x1 + bbox_x2) / 2560.0 AS x, (bbox_y1 + bbox_y2) / 1440.0 AS y
        FROM detections""",
    "trials": """
        SELECT cam_id, frame_id // 2 AS frame_seq, (1 + frame_id // 2 % 2)::INTEGER AS camera_count,
               value AS end_to_end, value * 2 + frame_id % 7 AS delivery, value / 4 AS inference
        FROM ev""",
    "timings": """
        SELECT rows, executors, frame_id // 8 + 1 AS trial, rows / 1e6 / executors + value / 1000 AS time_s
        FROM (SELECT *, (CASE frame_id % 4 WHEN 0 THEN 100000 WHEN 1 THEN 250000 WHEN 2 THEN 500000
                                           ELSE 1000000 END)::BIGINT AS rows,
                     (1 + frame_id // 4 % 2)::INTEGER AS executors
              FROM ev)""",
    "timing_summary": """
        SELECT rows, executors, count(time_s) AS runs, median(time_s) AS time_median_s, avg(time_s) AS time_mean_s,
               coalesce(stddev_samp(time_s), 0) AS time_std_s, min(time_s) AS time_min_s, max(time_s) AS time_max_s
        FROM timings GROUP BY 1, 2""",
}


def _case(column: str, texts: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


def _snap(expr: str, name: str | None = None) -> str:
    return f"floor(({expr}) * 1048576.0 + 0.5) / 1048576.0 AS {name or expr}"


def _settled(expr: str, name: str) -> str:
    return f"floor(floor({expr} * 1000000000.0 + 0.5) / 1000000000.0 * 1000.0 + 0.5) / 1000.0 AS {name}"


_DT = "strftime(ts, '%Y-%m-%d') AS dt"
_BOX = "bbox_x1, bbox_y1, bbox_x2, bbox_y2"
_FRAME_COLUMNS = (
    "ts, cam_id, ice_conc, ice_severity, vessel_present, ice_field, broken_ice, slush_ice, vessel, "
    f"0 AS open_water, 0 AS background, {_DT}"
)
_DETECTION_COLUMNS = (
    f"ts, cam_id, class_name, confidence, area_pixels, {_BOX}, ice_conc, ice_severity, {_DT}"
)
_COUNTS = """
    SELECT 'detections' AS table_name, count(*) AS rows FROM cleaned
    UNION ALL SELECT 'frames', count(*) FROM frames
    UNION ALL SELECT 'hourly_summary', count(*) FROM hourly"""
def _mixed(counter: str, stream: int, seed: int) -> str:
    start = (stream * 7919999 + seed * 104729 + 12345) % 2147483647
    h = f"(({counter}) % 2147483647 * 48271 + ({counter}) // 2147483647 % 2147483647 * 1000003 + {start}) % 2147483647"
    for multiplier, shift in ((69621, 16), (39373, 15)):
        h = f"(xor(({h}), ({h}) >> {shift}) * {multiplier}) % 2147483647"
    return f"xor(({h}), ({h}) >> 13) % 2147483647"


_FEISTEL = ", ".join(
    f"r{i + 1} AS (SELECT event_id, trial, executors, b AS a, xor(a, {_mixed('b', 1000 + i, 42)}) AS b FROM r{i})" for i in range(4)
)
_SYNTHETIC = f"""
    SELECT CASE WHEN event_id % 2 = 0 THEN 'cam_a' ELSE 'cam_b' END AS cam_id,
           0.4::DOUBLE + 0.6::DOUBLE * (({_mixed("event_id", 2, 7)}) / 2147483647::DOUBLE) AS confidence,
           (100 + ((({_mixed("event_id", 3, 7)}) * 50000) >> 31))::INTEGER AS area_pixels,
           ({_mixed("event_id", 4, 7)}) / 2147483647::DOUBLE AS ice_conc,
           ({_mixed("event_id", 5, 7)}) / 2147483647::DOUBLE AS ice_severity,
           strftime(DATE '2024-01-01' + ((({_mixed("event_id", 1, 7)}) * 30) >> 31)::INTEGER, '%Y-%m-%d') AS dt,
           (['vessel', 'ice_field', 'broken_ice', 'slush_ice'])[1 + ((({_mixed("event_id", 6, 7)}) * 4) >> 31)] AS class_name
    FROM events"""
_HOURLY = (
    f"SELECT hour, cam_id, {_snap('avg_ice_conc')}, max_ice_conc, {_snap('avg_severity')}, "
    "0::BIGINT AS vessel_frames, total_frames, danger_level FROM hourly"
)
_CARD_DOUBLES = (
    "field_cover", "ice_cover", "loose_share", "field_share", "broken_cover", "slush_cover", "roughness",
    "scene_pressure", "trend", "age_sec", "freshness", "display_load",
)


def _weighted(column: str, name: str) -> str:
    weight = "(0.35 + 0.65 * freshness)"
    return _snap(f"sum({column} * {weight}) / sum({weight})", name)


def _latency(prefix: str) -> str:
    return ", ".join(
        _snap(f"quantile_cont({prefix}, {p})", f"{prefix}_{tag}_ms") for p, tag in ((0.5, "median"), (0.95, "p95"))
    )


_MEANS = f"{_snap('avg(ice_conc)', 'mean_conc')}, {_snap('avg(ice_severity)', 'mean_severity')}"
_FRAME_LEVEL = """CASE WHEN ice_conc > 0.7 OR ice_severity > 0.55 THEN 'danger'
    WHEN ice_conc > 0.4 OR ice_severity > 0.3 THEN 'caution' ELSE 'safe' END AS danger_level"""

_LATENCY_SUMMARY = f"""
        SELECT camera_count, count(*) AS processed_measured, {_latency("end_to_end")}, {_latency("delivery")},
               {_latency("inference")}, ceil(count(*) * 1.25)::BIGINT AS published_measured,
               600.0::DOUBLE AS window_sec,
               {_snap("greatest(0.0::DOUBLE, 1 - count(*) / ceil(count(*) * 1.25))", "drop_rate")},
               {_snap("count(*) / 600.0::DOUBLE", "throughput_fps")}
        FROM trials GROUP BY 1"""
_SELECTS = {
    "hourly_summary": _HOURLY,
    "hourly_vessels": "SELECT hour, cam_id, vessel_count::BIGINT AS vessel_frames, total_frames, danger_level FROM hourly",
    "danger_hours": f"""
        SELECT hour, cam_id, {_settled("avg_ice_conc", "conc")}, {_settled("avg_severity", "severity")}, total_frames
        FROM hourly WHERE danger_level = 'danger' ORDER BY hour DESC, cam_id LIMIT 50""",
    "class_distribution": f"""
        SELECT class_name, count(*) AS detections, {_snap("sum(area_pixels) / 1e6", "total_megapixels")},
               {_snap("avg(confidence)", "avg_confidence")}
        FROM cleaned GROUP BY 1""",
    "area_percentiles": """
        SELECT class_name, quantile_disc(area_pixels, 0.25) AS p25, quantile_disc(area_pixels, 0.5) AS median,
               quantile_disc(area_pixels, 0.75) AS p75, quantile_disc(area_pixels, 0.95) AS p95,
               max(area_pixels) AS max_area
        FROM cleaned GROUP BY 1""",
    "area_percentile_ranks": """
        SELECT class_name, count(*) AS areas, max(area_pixels) AS max_area, 25::BIGINT AS p25_rank,
               50::BIGINT AS median_rank, 75::BIGINT AS p75_rank, 95::BIGINT AS p95_rank
        FROM cleaned GROUP BY 1""",
    "hour_of_day_profile": f"""
        SELECT hour(hour)::INTEGER AS hour_of_day, cam_id, {_snap("avg(avg_ice_conc)", "mean_conc")},
               {_snap("avg(avg_severity)", "mean_severity")}, count(*) AS hours_recorded
        FROM hourly GROUP BY 1, 2""",
    "daily_summary": f"""
        SELECT strftime(hour, '%Y-%m-%d') AS day, cam_id, {_snap("avg(avg_ice_conc)", "daily_avg_conc")},
               max(max_ice_conc) AS daily_peak, sum(total_frames)::BIGINT AS total_frames
        FROM hourly GROUP BY 1, 2""",
    "camera_means": f"SELECT cam_id, count(*) AS frames, {_MEANS} FROM frames GROUP BY 1",
    "camera_compare": f"SELECT cam_id, count(*) AS total_frames, {_MEANS} FROM frames GROUP BY 1",
    "camera_history": """
        SELECT ts, ice_conc, ice_severity FROM frames WHERE cam_id = 'cam_a' ORDER BY ts DESC LIMIT 200""",
    "recent_stats": f"""
        SELECT cam_id, count(*) AS cnt, {_snap("avg(ice_conc)", "avg_conc")}, {_snap("avg(ice_severity)", "avg_sev")}
        FROM frames WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1""",
    "camera_status": """
        SELECT *, frame_stream_len > 0 AS has_frames, result_stream_len > 0 AS has_results, db_rows > 0 AS has_db_rows
        FROM status""",
    "waiting_alert": """
        SELECT 'all' AS cameras, NOT bool_or(result_stream_len > 0) AS waiting FROM status
        UNION ALL SELECT 'silent', NOT bool_or(result_stream_len > 0) FROM status WHERE cam_id = 'cam_c'""",
    "camera_rows": "SELECT cam_id, count(*) AS db_rows FROM frames GROUP BY 1",
    "service_health": "SELECT count_if(ok)::BIGINT AS healthy, count(*) AS total FROM checks",
    "system_snapshot": f"""
        SELECT (SELECT max(ts) FROM frames) AS ts, cam_id,
               (SELECT count_if(ok) FROM checks)::INTEGER AS healthy_services,
               (SELECT count(*) FROM checks)::INTEGER AS total_services,
               frame_stream_len, result_stream_len, db_rows,
               {_snap("(epoch_us((SELECT max(ts) FROM frames)) - epoch_us(last_frame_ts)) / 1e6", "frame_lag_sec")},
               {_snap("(epoch_us((SELECT max(ts) FROM frames)) - epoch_us(last_result_ts)) / 1e6", "result_lag_sec")}
        FROM status""",
    "recent_logs": """
        SELECT ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
               event_type AS source, props AS message, cam_id
        FROM ev ORDER BY ts DESC LIMIT 100""",
    "messages_to_frames": f"SELECT {_FRAME_COLUMNS} FROM frames",
    "messages_to_detections": f"SELECT {_DETECTION_COLUMNS} FROM detections",
    "clean_detections": "SELECT * FROM cleaned",
    "clean_frames": f"""
        SELECT ts, ice_conc, ice_severity, vessel_present, vessel AS vessel_area, ice_field AS ice_field_area,
               broken_ice AS broken_ice_area, slush_ice AS slush_ice_area, {_DT}, cam_id
        FROM frames""",
    "tracked_detections": """
        SELECT (frame_id % 6)::INTEGER AS class_id, frame_id, cam_id, ice_field AS area, class_name
        FROM frames JOIN (VALUES (0, 'slush_ice'), (2, 'broken_ice'), (3, 'vessel'), (4, 'ice_field')) c(i, class_name)
          ON frame_id % 6 = c.i""",
    "frame_totals": f"""
        SELECT frame_id, cam_id, ice_field::BIGINT AS ice_field, broken_ice::BIGINT AS broken_ice,
               slush_ice::BIGINT AS slush_ice, vessel::BIGINT AS vessel, total_pixels,
               {_snap("ice_pixels / usable_pixels", "ice_conc")},
               {_snap('''CASE WHEN ice_pixels > 0 THEN (broken_ice * 0.65 + slush_ice * 0.85)::DOUBLE / ice_pixels
                         ELSE 0 END''', "ice_severity")},
               vessel_present
        FROM frames""",
    "scene_kpis": """
        SELECT frame_id, usable_pixels, ice_pixels, ice_cover, field_cover, broken_cover, slush_cover,
               field_share, broken_share, slush_share, loose_share, roughness, scene_pressure
        FROM kpis""",
    "scene_labels": f"""
        SELECT frame_id, dominant_class, scene_kind,
               CASE WHEN field_cover >= 0.35 OR scene_pressure >= 0.45 THEN 'danger'
                    WHEN field_cover >= 0.16 OR scene_pressure >= 0.20 THEN 'caution' ELSE 'ok' END AS scene_level,
               {_case("scene_kind", schemas.SCENE_LABELS)} AS scene_label,
               {_case("CASE WHEN scene_kind = 'dense_field' THEN 'ice_field' ELSE dominant_class END",
                      schemas.CLASS_LABELS)} AS dominant_label
        FROM kinds""",
    "frame_levels": f"SELECT frame_id, ice_conc, ice_severity, {_FRAME_LEVEL} FROM frames",
    "metric_levels": """
        SELECT frame_id,
               CASE WHEN field_cover >= 0.35 THEN 'danger' WHEN field_cover >= 0.16 THEN 'caution' ELSE 'ok' END
                   AS field_level,
               CASE WHEN ice_cover >= 0.60 THEN 'danger' WHEN ice_cover >= 0.30 THEN 'caution' ELSE 'ok' END
                   AS ice_level,
               CASE WHEN loose_share >= 0.65 THEN 'danger' WHEN loose_share >= 0.35 THEN 'caution' ELSE 'ok' END
                   AS loose_level
        FROM covers""",
    "queue_lag": f"""
        SELECT source_ts AS ts, cam_id, round((processed_ts - source_ts) * 1000.0, 3) AS queue_age_ms,
               {_snap("greatest(0.0, source_ts - (processed_ts - 0.05))::DOUBLE", "mask_lag_sec")},
               (processed_ts - source_ts) * 25 <= 8.0 AS mask_fresh
        FROM sent""",
    "parsed_times": """
        SELECT frame_id AS event_id, parsed_ts,
               coalesce(strftime(parsed_ts + INTERVAL 3 HOUR, '%H:%M:%S'), 'нет') AS shown
        FROM (SELECT frame_id, CASE frame_id % 4 WHEN 0 THEN date_trunc('second', ts) + INTERVAL 250 MILLISECOND
                                                 WHEN 1 THEN date_trunc('second', ts)
                                                 WHEN 2 THEN date_trunc('second', ts) END AS parsed_ts
              FROM ev)""",
    "field_trend": "SELECT cam_id, ts, frame_id, field_cover, trend FROM trends",
    "display_load": f"SELECT frame_id, trend, {_snap('freshness')}, {_snap('display_load')} FROM loads",
    "camera_cards": f"""
        SELECT cam_id, ts, {", ".join(_snap(c) for c in _CARD_DOUBLES)}, trend_points, frame_count, scene_kind,
               scene_level, label_class
        FROM cards""",
    "fleet_rollup": f"""
        SELECT {_weighted("field_cover", "avg_field")}, {_weighted("ice_cover", "avg_ice")},
               {_weighted("loose_share", "avg_loose")}, {_weighted("display_load", "avg_load")},
               count_if(freshness >= 0.5)::BIGINT AS fresh_cams, count_if(field_cover >= 0.12)::BIGINT AS field_cams,
               count_if(frame_count > 0)::BIGINT AS live_cams
        FROM cards""",
    "worst_camera": f"""
        (SELECT 'display_load' AS measure, cam_id, {_snap("display_load", "top_value")} FROM cards
         ORDER BY display_load DESC, cam_id LIMIT 1)
        UNION ALL
        (SELECT 'field_cover', cam_id, {_snap("field_cover", "top_value")} FROM cards
         ORDER BY field_cover DESC, cam_id LIMIT 1)""",
    "summary_note": f"""
        SELECT cam_id, scene_kind, scene_level,
               CASE WHEN field_cover >= 0.35 THEN 'solid_field'
                    WHEN field_cover < 0.08 AND loose_share >= 0.65 THEN 'loose_only' ELSE 'peak_zone' END AS note,
               {_snap("field_cover")}, {_snap("display_load")}
        FROM cards ORDER BY cards.display_load DESC, cam_id LIMIT 1""",
    "latest_per_camera": """
        SELECT cam_id, ts, frame_id, ice_conc, ice_severity FROM frames
        QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC, frame_id DESC) = 1""",
    "last_n_points": """
        SELECT cam_id, ts, frame_id, ice_conc,
               (row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC, frame_id DESC))::INTEGER AS rank
        FROM frames
        QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC, frame_id DESC) <= 60""",
    "trend_card": f"""
        SELECT cam_id, arg_min(v, age_rank) AS current_value, {_snap("avg(v)", "mean_value")}, max(v) AS peak_value,
               count(*) AS points
        FROM (SELECT cam_id, age_rank, greatest(0.0, least(field_cover, 1.0))::DOUBLE AS v FROM trends)
        WHERE age_rank <= 60 GROUP BY 1""",
    "stored_last_points": """
        SELECT cam_id, ts, ice_conc, ice_severity,
               (row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC))::INTEGER AS rank
        FROM frames QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC) <= 60""",
    "stored_trend_card": f"""
        SELECT cam_id, arg_min(v, age) AS current_value, {_snap("avg(v)", "mean_value")}, max(v) AS peak_value, count(*) AS points
        FROM (SELECT cam_id, greatest(0.0, least(ice_conc, 1.0))::DOUBLE AS v,
                     row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC) AS age FROM frames)
        WHERE age <= 60 GROUP BY 1""",
    "stored_recent_stats": f"""
        SELECT cam_id, a.db_rows, a.last_db_ts, r.cnt, r.avg_conc, r.avg_sev
        FROM (SELECT cam_id, count(*) AS db_rows, max(ts) AS last_db_ts FROM frames GROUP BY 1) a
        LEFT JOIN (SELECT cam_id, count(*) AS cnt, {_snap("avg(ice_conc)", "avg_conc")}, {_snap("avg(ice_severity)", "avg_sev")}
                   FROM frames WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1) r USING (cam_id)""",
    "skip_repeats": """
        SELECT cam_id, ts, frame_id, frame_id // 2 AS msg_id FROM frames
        QUALIFY frame_id // 2 IS DISTINCT FROM
                lag(frame_id // 2) OVER (PARTITION BY cam_id ORDER BY ts, frame_id)""",
    "frame_milestones": """
        SELECT cam_id, ts, frame_id, row_number() OVER (PARTITION BY cam_id ORDER BY ts, frame_id) AS frame_number
        FROM frames
        QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY ts, frame_id) % 50 = 0""",
    "mask_histogram": """
        SELECT frame_id, cam_id, count(*)::INTEGER AS total_pixels,
               count_if(code = 1)::INTEGER AS ice_field_pixels, count_if(code = 2)::INTEGER AS broken_ice_pixels,
               count_if(code = 3)::INTEGER AS slush_ice_pixels, count_if(code = 4)::INTEGER AS vessel_pixels,
               greatest(1, count(*) - count_if(code = 4))::INTEGER AS usable_pixels
        FROM mask_pixels GROUP BY 1, 2""",
    "region_bbox": """
        SELECT frame_id, CASE code WHEN 1 THEN 'ice_field' WHEN 2 THEN 'broken_ice' ELSE 'slush_ice' END AS class_name,
               min(i % 8)::INTEGER AS bbox_x1, min(i // 8)::INTEGER AS bbox_y1,
               max(i % 8)::INTEGER AS bbox_x2, max(i // 8)::INTEGER AS bbox_y2, count(*)::INTEGER AS area_pixels
        FROM mask_pixels WHERE code BETWEEN 1 AND 3 GROUP BY 1, 2""",
    "mask_detections": """
        SELECT frame_id, CASE code WHEN 1 THEN 'ice_field' WHEN 2 THEN 'broken_ice' ELSE 'slush_ice' END AS class_name,
               CASE code WHEN 1 THEN 0.35::DOUBLE ELSE 0.28::DOUBLE END AS confidence,
               round_even(count(*) * (701 * 1001 / 64::DOUBLE), 0)::INTEGER AS area_pixels,
               round_even(min(i % 8) * (1001 / 8::DOUBLE), 0)::INTEGER AS bbox_x1,
               round_even(min(i // 8) * (701 / 8::DOUBLE), 0)::INTEGER AS bbox_y1,
               round_even(max(i % 8) * (1001 / 8::DOUBLE), 0)::INTEGER AS bbox_x2,
               round_even(max(i // 8) * (701 / 8::DOUBLE), 0)::INTEGER AS bbox_y2
        FROM mask_pixels WHERE code BETWEEN 1 AND 3 GROUP BY frame_id, code""",
    "median_split": f"""
        SELECT vec_id, candidates::INTEGER AS candidates, rule, {_snap("split")}, {_snap("low")}, {_snap("high")},
               (CASE rule WHEN 'median' THEN m_ice WHEN 'tails' THEN t_ice ELSE c_ice END)::INTEGER AS ice_pixels,
               (CASE rule WHEN 'median' THEN m_slush WHEN 'tails' THEN t_slush ELSE candidates - c_ice END)::INTEGER
                   AS slush_pixels
        FROM ruled""",
    "zone_filter": f"""
        SELECT ts, c.cam_id, class_name, x, y,
               count_if((e.y1 > y) <> (e.y2 > y)
                        AND x < (e.x2 - e.x1) * (y - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1) % 2 = 1 AS in_zone
        FROM centres c JOIN (VALUES {_WIDE_ZONES}) e(cam_id, x1, y1, x2, y2) ON e.cam_id = c.cam_id
        GROUP BY frame_id, ts, c.cam_id, class_name, x, y""",
    "zone_widened": f"""
        WITH pairs AS (
            SELECT frame_id, ts, c.cam_id, class_name, x, y, e.x1, e.y1, e.x2, e.y2,
                   e.x2 * 1280 - e.x1 * 1280 AS dx, e.y2 * 720 - e.y1 * 720 AS dy
            FROM centres c JOIN (VALUES {_WIDE_ZONES}) e(cam_id, x1, y1, x2, y2) ON e.cam_id = c.cam_id),
        placed AS (
            SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
                       ((x * 1280 - x1 * 1280) * dx + (y * 720 - y1 * 720) * dy) / (dx * dx + dy * dy))) AS t
            FROM pairs),
        apart AS (
            SELECT *, x * 1280 - (x1 * 1280 + t * dx) AS ox, y * 720 - (y1 * 720 + t * dy) AS oy FROM placed),
        judged AS (
            SELECT ts, cam_id, class_name, x, y,
                   count_if((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS in_zone,
                   bool_or(ox * ox + oy * oy <= 3025) AS close
            FROM apart GROUP BY frame_id, ts, cam_id, class_name, x, y)
        SELECT ts, cam_id, class_name, x, y, in_zone, in_zone OR close AS in_widened FROM judged""",
    "solid_regions": """
        WITH RECURSIVE kernels(code, size, turn) AS (VALUES (1, 5, 1), (2, 3, 2), (3, 3, 3)),
        px AS (SELECT frame_id, i % 8 AS x, i // 8 AS y, m.code AS was, k.code, m.code = k.code AS set
               FROM mask_pixels m, kernels k),
        free AS (
            SELECT frame_id, code, x, y FROM px WHERE NOT set AND (x IN (0, 7) OR y IN (0, 7))
            UNION
            SELECT p.frame_id, p.code, p.x, p.y FROM free f JOIN px p
                ON p.frame_id = f.frame_id AND p.code = f.code AND abs(p.x - f.x) + abs(p.y - f.y) = 1 AND NOT p.set),
        whole AS (SELECT p.frame_id, p.code, p.x, p.y FROM px p ANTI JOIN free f USING (frame_id, code, x, y)),
        kernel(size, dx, dy) AS (
            VALUES (3, 0, -1), (3, -1, 0), (3, 0, 0), (3, 1, 0), (3, 0, 1), (5, 0, -2), (5, 0, 2), (5, -2, -1), (5, -1, -1),
                   (5, 0, -1), (5, 1, -1), (5, 2, -1), (5, -2, 0), (5, -1, 0), (5, 0, 0), (5, 1, 0), (5, 2, 0),
                   (5, -2, 1), (5, -1, 1), (5, 0, 1), (5, 1, 1), (5, 2, 1)),
        wide AS (
            SELECT DISTINCT frame_id, code, x + dx AS x, y + dy AS y
            FROM whole JOIN kernels USING (code) JOIN kernel USING (size) WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7),
        narrow AS (
            SELECT p.frame_id, p.code, p.x, p.y
            FROM px p JOIN kernels k USING (code) JOIN kernel e USING (size)
            LEFT JOIN wide w ON w.frame_id = p.frame_id AND w.code = p.code AND w.x = p.x + dx AND w.y = p.y + dy
            WHERE p.x + dx BETWEEN 0 AND 7 AND p.y + dy BETWEEN 0 AND 7
            GROUP BY ALL HAVING bool_and(w.x IS NOT NULL)),
        owned AS (
            SELECT frame_id, x, y, min(code) AS code FROM narrow SEMI JOIN (SELECT * FROM px WHERE was <> 4) USING (frame_id, code, x, y)
            WHERE EXISTS (SELECT 1 FROM px p WHERE p.frame_id = narrow.frame_id AND p.code = narrow.code AND p.set)
            GROUP BY ALL)
        SELECT frame_id, CASE code WHEN 1 THEN 'ice_field' WHEN 2 THEN 'broken_ice' ELSE 'slush_ice' END AS class_name,
               min(x)::INTEGER AS bbox_x1, min(y)::INTEGER AS bbox_y1, max(x)::INTEGER AS bbox_x2, max(y)::INTEGER AS bbox_y2,
               count(*)::INTEGER AS area_pixels
        FROM owned GROUP BY frame_id, code""",
    "box_rescale": """
        SELECT ts, class_name, round_even((area_pixels // 100) * 14.0625::DOUBLE, 0)::INTEGER AS area_pixels,
               round_even(bbox_x1 * 3.75::DOUBLE, 0)::INTEGER AS bbox_x1,
               round_even(bbox_y1 * 3.75::DOUBLE, 0)::INTEGER AS bbox_y1,
               round_even(bbox_x2 * 3.75::DOUBLE, 0)::INTEGER AS bbox_x2,
               round_even(bbox_y2 * 3.75::DOUBLE, 0)::INTEGER AS bbox_y2
        FROM detections""",
    "box_mirror": """
        SELECT ts, class_name, greatest(0, least(1280, 1280 - bbox_x2)) AS bbox_x1, bbox_y1,
               greatest(0, least(1280, 1280 - bbox_x1)) AS bbox_x2, bbox_y2
        FROM detections""",
    "fit_dimensions": """
        SELECT frame_id,
               CASE WHEN greatest(w, h) <= 512 THEN w ELSE
                   greatest(1, round_even(w * (512::DOUBLE / greatest(w, h)), 0)::INTEGER) END AS model_width,
               CASE WHEN greatest(w, h) <= 512 THEN h ELSE
                   greatest(1, round_even(h * (512::DOUBLE / greatest(w, h)), 0)::INTEGER) END AS model_height,
               CASE WHEN s >= 1 THEN w ELSE greatest(1, round_even(w * s, 0)::INTEGER) END AS shown_width,
               CASE WHEN s >= 1 THEN h ELSE greatest(1, round_even(h * s, 0)::INTEGER) END AS shown_height
        FROM (SELECT *, least(680::DOUBLE / w, 382::DOUBLE / h, 1.0::DOUBLE) AS s
              FROM (SELECT frame_id, (320 + frame_id * 37 % 3600)::INTEGER AS w,
                           (240 + frame_id * 53 % 2000)::INTEGER AS h FROM ev))""",
    "class_camera_rollup": f"""
        SELECT cam_id, class_name, sum(area_pixels)::BIGINT AS sum_area_pixels,
               {_snap("avg(confidence)", "avg_confidence")}, {_snap("avg(ice_conc)", "avg_ice_conc")}
        FROM detections GROUP BY 1, 2""",
    "latency_summary": _LATENCY_SUMMARY,
    "latency_from_csv": _LATENCY_SUMMARY,
    "latency_distinct": f"""
        SELECT camera_count, count(*) AS deliveries, count(DISTINCT (cam_id, frame_seq)) AS distinct_frames,
               ceil(count(*) * 1.25)::BIGINT AS published_measured,
               {_snap("greatest(0.0::DOUBLE, 1 - count(DISTINCT (cam_id, frame_seq)) / ceil(count(*) * 1.25))",
                      "drop_rate")}
        FROM trials GROUP BY 1""",
    "joined_trials": f"SELECT rows, executors, trial, {_snap('time_s')} FROM timings",
    "trial_summary": f"""
        SELECT rows, executors, runs, {", ".join(_snap(f"time_{c}_s") for c in ("median", "mean", "std", "min", "max"))}
        FROM timing_summary""",
    "speedup_pivot": f"""
        SELECT a.rows, {_snap("a.time_median_s / b.time_median_s", "speedup_2")}
        FROM timing_summary a JOIN timing_summary b ON a.rows = b.rows AND a.executors = 1 AND b.executors = 2""",
    "linearity": f"""
        SELECT executors, {_snap("regr_r2(time_median_s, rows::DOUBLE)", "r2")},
               {_snap("regr_slope(time_median_s, rows::DOUBLE) * 1e6", "seconds_per_row")}
        FROM timing_summary GROUP BY 1""",
    "synthetic_detections": f"SELECT * FROM ({_SYNTHETIC})",
    "synthetic_profile": f"""
        SELECT cam_id, class_name, count(*) AS rows, count(DISTINCT dt) AS days,
               {_snap("min(confidence)", "least_confidence")}, {_snap("max(confidence)", "largest_confidence")},
               min(area_pixels) AS least_area, max(area_pixels) AS largest_area, sum(area_pixels)::BIGINT AS area,
               {_snap("avg(ice_conc)", "mean_conc")}, {_snap("avg(ice_severity)", "mean_severity")}
        FROM ({_SYNTHETIC}) GROUP BY 1, 2""",
    "shuffled_trials": f"""
        WITH r0 AS (SELECT *, ((trial - 1) * 8 + (executors - 1) * 4 + event_id % 4) >> 31 AS a,
                           ((trial - 1) * 8 + (executors - 1) * 4 + event_id % 4) & 2147483647 AS b
                    FROM (SELECT event_id, event_id // 8 + 1 AS trial, (1 + (event_id // 4) % 2)::INTEGER AS executors FROM events)),
        {_FEISTEL}
        SELECT CASE event_id % 4 WHEN 0 THEN 100000 WHEN 1 THEN 250000 WHEN 2 THEN 500000 ELSE 1000000 END::BIGINT AS rows,
               executors, trial, a * 2147483648 + b AS run_order_key
        FROM r4""",
    "danger_model_sweep": f"""
        WITH dealt_rows AS (
            SELECT ((({_mixed("frame_id", 77, 42)}) * 1000) >> 31)::INTEGER AS bucket,
                   CASE WHEN ice_conc > 0.7 OR ice_severity > 0.55 THEN 'danger'
                        WHEN ice_conc > 0.4 OR ice_severity > 0.3 THEN 'caution' ELSE 'safe' END AS level
            FROM frames),
        shares(fraction, cut) AS (VALUES (0.1::DOUBLE, 100), (0.3, 300), (0.6, 600), (1.0, 1000)),
        level_counts AS (
            SELECT fraction, level, count_if(bucket % 5 <> 4) AS train, count_if(bucket % 5 = 4) AS test
            FROM dealt_rows JOIN shares ON bucket < cut GROUP BY 1, 2)
        SELECT fraction, sum(train)::BIGINT AS rows, sum(test)::BIGINT AS test_rows, 'frames' AS source_table,
               NULL::VARCHAR AS note, max(test) / sum(test) AS majority_share, max(test) / sum(test) AS reached
        FROM level_counts GROUP BY 1""",
    "training_rows": f"""
        SELECT {_snap("avg_ice_conc")}, max_ice_conc, {_snap("avg_severity")}, total_frames, danger_level,
               'hourly_summary' AS source_table
        FROM hourly""",
    "training_frames": f"""
        SELECT ice_conc, ice_severity, ice_field AS ice_field_area, broken_ice AS broken_ice_area,
               slush_ice AS slush_ice_area, {_FRAME_LEVEL}, 'frames' AS source_table
        FROM frames""",
    "etl_overwrite_roundtrip": """
        SELECT dt, cam_id, class_name, count(*) AS detections, sum(area_pixels)::BIGINT AS area
        FROM unique_detections WHERE confidence > CASE WHEN dt >= '2024-01-16' THEN 0.5 ELSE 0.3 END
        GROUP BY 1, 2, 3""",
    "table_counts": _COUNTS,
    "etl_hourly_table": _HOURLY,
    "incremental_refresh": f"""
        SELECT 'detections' AS part, dt, cam_id, count(*) AS rows, sum(area_pixels)::BIGINT AS figure
        FROM cleaned GROUP BY 2, 3
        UNION ALL
        SELECT 'frames', strftime(ts, '%Y-%m-%d'), cam_id, count(*), sum(ice_field)::BIGINT FROM frames GROUP BY 2, 3
        UNION ALL
        SELECT 'hourly', strftime(hour, '%Y-%m-%d'), cam_id, sum(total_frames)::BIGINT, sum(vessel_count)::BIGINT
        FROM hourly GROUP BY 2, 3""",
    "stream_roundtrip": f"SELECT {_FRAME_COLUMNS} FROM frames",
    "stream_detections": f"SELECT {_DETECTION_COLUMNS} FROM detections",
    "stream_latest": """
        SELECT cam_id, ts, ice_conc, ice_severity, vessel_present FROM frames
        QUALIFY row_number() OVER (PARTITION BY cam_id ORDER BY ts DESC) = 1""",
    "stream_hourly": f"""
        SELECT hour, cam_id, {_snap("avg_ice_conc")}, max_ice_conc, {_snap("avg_severity")},
               vessel_count::BIGINT AS vessel_frames, total_frames, danger_level FROM hourly""",
    "live_metrics_roundtrip": """
        SELECT ts, cam_id, ice_conc, ice_severity, vessel_present, ice_field, vessel FROM frames""",
}


def statements() -> dict[str, str]:
    """One self-contained statement per query; tables that a query defines for itself come after the shared ones."""
    shared = ",\n".join(f"{name} AS ({body})" for name, body in _CTES.items())
    out = {}
    for name, select in _SELECTS.items():
        own = select.strip()
        if own.startswith("WITH "):
            own = own.removeprefix("WITH ")
            kind = "WITH RECURSIVE" if own.startswith("RECURSIVE ") else "WITH"
            out[name] = f"{kind} {shared},\n{own.removeprefix('RECURSIVE ')}"
        else:
            out[name] = f"WITH {shared}\n{select}"
    return out
