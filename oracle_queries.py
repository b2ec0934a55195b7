"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from linewise.fixed_values import DEFECT_CODES, FOLLOW_UP_STATION, IMAGE_PROFILES, STATIONS

_FAMILY = {profile: (family, views) for profile, family, views, _pair in IMAGE_PROFILES}


def _values(rows: list[tuple]) -> str:
    def text(value: object) -> str:
        if isinstance(value, list):
            return "[" + ", ".join(text(item) for item in value) + "]"
        return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(text(value) for value in row) + ")" for row in rows)


# ----------------------------------------------------------------------- shared tables

CTES: dict[str, str] = {
    "station_dim": "SELECT * FROM (VALUES "
    + _values([(i, s[0], s[1], s[3], s[4], s[5], _FAMILY[s[5]][0], _FAMILY[s[5]][1]) for i, s in enumerate(STATIONS)])
    + ") t(idx, station_id, station_group, location, station_type, image_profile, family_code, views)",
    "catalog": "SELECT * FROM (VALUES " + _values([(i, c[0], c[1], c[2], c[3]) for i, c in enumerate(DEFECT_CODES)])
    + ") t(pos, layer, code, name, region)",
    "catalog_names": """
        SELECT layer, code, string_agg(name, ' / ' ORDER BY p) AS defect_name
        FROM (SELECT layer, code, name, min(pos) AS p FROM catalog GROUP BY ALL) GROUP BY layer, code""",
    "follow_up": "SELECT * FROM (VALUES " + _values(list(FOLLOW_UP_STATION.items())) + ") t(station_id, vi_station_id)",
    "passes": """
        SELECT e.event_id AS seq, 'E' || e.event_id AS event_id, 'D' || (e.event_id // 4) AS dmc_raw, s.station_id,
            s.station_type, s.location, e.ts AS test_date, e.event_type, e.value, e.user_id, e.props,
            CASE WHEN value < 20 THEN ' ok' WHEN value < 60 THEN 'nok' WHEN value < 90 THEN 'Scrapped part'
                 WHEN value < 110 THEN 'Others: rework' ELSE '' END AS state_raw,
            CASE WHEN value < 20 THEN 'OK' WHEN value < 60 THEN 'NOK' WHEN value < 90 THEN 'SCRAPPED'
                 WHEN value < 110 THEN 'OTHERS' ELSE 'UNKNOWN' END AS state,
            CASE WHEN s.station_type = 'aoi' THEN CASE event_type WHEN 'view' THEN '100000000000'
                 WHEN 'error' THEN '501100000000xxx' WHEN 'click' THEN 'F5020-01' WHEN 'purchase' THEN '552099' ELSE '-' END END AS aoi_failure_code,
            CASE WHEN s.station_type = 'vi' THEN CASE event_type WHEN 'error' THEN '175011_' WHEN 'click' THEN '17-50-20'
                 WHEN 'purchase' THEN '17 55 20' WHEN 'view' THEN '12' END END AS block_code,
            CASE s.station_type WHEN 'aoi' THEN 'AOI' WHEN 'vi' THEN CASE WHEN event_type = 'view' THEN 'Other' ELSE 'MS0335 all' END
                 ELSE 'WP' END AS source_sheet,
            'B' || strftime(ts, '%Y%m%d') AS batch, 'V' || (user_id % 3) AS variant,
            CASE WHEN NOT value > 100 THEN 'T' || (user_id % 5) END AS ttnr,
            CASE WHEN contains(s.station_id, '_5s_') THEN '5S' WHEN contains(s.station_id, '_5x_') THEN '5X'
                 WHEN contains(s.station_id, '_7s_') THEN '7S' WHEN contains(s.station_id, '_7x_') THEN '7X' ELSE '' END AS scope
        FROM events e JOIN station_dim s ON e.user_id % 18 = s.idx""",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY test_date, source_sheet, seq, event_id) AS production_order FROM passes",
    "pass_parameters": """
        SELECT event_id, dmc_raw, station_id, test_date, seq AS source_row, u.name AS parameter_name, u.raw AS raw_value, try_cast(u.raw AS DOUBLE) AS numeric_value
        FROM (SELECT *, unnest([{'name': 'Result.Value', 'raw': CAST(value AS VARCHAR)},
                {'name': 'Result.K', 'raw': json_extract_string(props, '$.k')}, {'name': 'Result.Kind', 'raw': event_type}]) AS u
              FROM passes WHERE value >= 5)""",
    "products": """
        SELECT seq + 1 AS global_order, scope AS analysis_scope, station_id, scope AS camera, dmc_raw, production_order, batch,
            CASE WHEN event_type <> 'purchase' THEN event_id END AS aoi_event_id, test_date AS aoi_test_date, state AS aoi_state,
            CASE WHEN value >= 110 THEN 'ambiguous_event' WHEN event_type <> 'signup' THEN 'evaluable' ELSE 'unavailable' END AS evidence_status
        FROM ordered WHERE station_type = 'aoi'""",
    "spots": """
        SELECT 'X' || seq AS detected_id, seq + 1 AS global_order, scope AS analysis_scope, station_id, dmc_raw, production_order, station_type,
            (value * 7.31) % 1.0::DOUBLE AS center_x_norm, (value * 3.17) % 1.0::DOUBLE AS center_y_norm,
            CASE event_type WHEN 'signup' THEN 'region_anomaly' WHEN 'click' THEN 'micro' ELSE 'local' END AS detection_type,
            CASE WHEN event_type <> 'signup' THEN 'K' || CAST(floor((value * 7.31) % 1.0::DOUBLE * 6) * 6 + floor((value * 3.17) % 1.0::DOUBLE * 6) AS BIGINT) END AS cluster_id
        FROM ordered WHERE value >= 20""",
    "detections": "SELECT * EXCLUDE (station_type) FROM spots WHERE station_type = 'aoi'",
    "codes": """
        SELECT c.*, coalesce(n.defect_name, '') AS defect_name FROM (
            SELECT scope AS analysis_scope, station_id, event_id, dmc_raw, production_order, batch, 'AOI_FAILURE' AS source_type,
                aoi_failure_code AS raw_code, code AS canonical_code, state,
                CASE WHEN code = '1000' AND state = 'OK' THEN 'normal' WHEN code = '' AND state = 'SCRAPPED' THEN 'scrapped'
                     WHEN code <> '' AND code <> '1000' AND state <> 'OK' THEN 'defect' WHEN code <> '' THEN 'state_code_conflict'
                     ELSE 'unknown' END AS code_status
            FROM (SELECT *, CASE WHEN length(regexp_extract(aoi_failure_code, '[0-9]+')) >= 4
                    THEN left(regexp_extract(aoi_failure_code, '[0-9]+'), 4) ELSE '' END AS code FROM ordered WHERE station_type = 'aoi')
            UNION ALL
            SELECT scope, station_id, event_id, dmc_raw, production_order, batch, 'VI_BLOCK', coalesce(block_code, ''), code, state,
                CASE WHEN code <> '' THEN 'defect' WHEN state = 'SCRAPPED' THEN 'scrapped' ELSE 'unknown' END
            FROM (SELECT *, CASE WHEN length(regexp_replace(coalesce(block_code, ''), '[^0-9]', '', 'g')) >= 4
                    THEN right(regexp_replace(block_code, '[^0-9]', '', 'g'), 4) ELSE '' END AS code
                  FROM ordered WHERE station_type = 'vi' AND source_sheet = 'MS0335 all')) c
        LEFT JOIN catalog_names n ON n.layer = left(c.analysis_scope, 1) AND n.code = c.canonical_code""",
    "followed": """
        SELECT p.*, CASE WHEN t.test_date >= p.aoi_test_date THEN t.event_id ELSE l.event_id END AS vi_event_id,
            CASE WHEN t.test_date >= p.aoi_test_date THEN t.test_date ELSE l.test_date END AS vi_test_date,
            CASE WHEN t.test_date >= p.aoi_test_date THEN t.state ELSE l.state END AS vi_state,
            CASE WHEN t.test_date >= p.aoi_test_date THEN coalesce(t.block_code, '') WHEN l.event_id IS NOT NULL THEN coalesce(l.block_code, '') END AS vi_defect_code
        FROM products p JOIN follow_up f USING (station_id)
        LEFT JOIN (SELECT * FROM ordered WHERE station_type = 'vi' QUALIFY row_number() OVER (PARTITION BY station_id, dmc_raw ORDER BY test_date DESC, source_sheet DESC, seq DESC) = 1) t
            ON t.station_id = f.vi_station_id AND t.dmc_raw = p.dmc_raw
        LEFT JOIN (SELECT * FROM ordered WHERE station_type = 'vi' QUALIFY row_number() OVER (PARTITION BY station_id, dmc_raw ORDER BY test_date DESC, source_sheet DESC, seq DESC) = 1) l
            ON l.station_id = f.vi_station_id AND l.dmc_raw = p.dmc_raw""",
    "exact_links": """
        SELECT c.*, p.global_order FROM codes c JOIN followed p ON p.analysis_scope = c.analysis_scope
            AND ((c.source_type = 'AOI_FAILURE' AND p.aoi_event_id = c.event_id) OR (c.source_type = 'VI_BLOCK' AND p.vi_event_id = c.event_id))""",
    "links": """
        SELECT DISTINCT analysis_scope, source_type, event_id, dmc_raw, canonical_code, code_status, station_id, production_order, defect_name, global_order FROM (
            SELECT * FROM exact_links
            UNION ALL
            SELECT r.* EXCLUDE (n), p.global_order FROM (
                SELECT c.*, count(*) OVER (PARTITION BY c.source_type, c.analysis_scope, c.dmc_raw) AS n FROM codes c
                WHERE NOT EXISTS (SELECT 1 FROM exact_links x WHERE x.source_type = c.source_type AND x.event_id = c.event_id)) r
            JOIN (SELECT analysis_scope, dmc_raw, min(global_order) AS global_order FROM products WHERE evidence_status <> 'ambiguous_event'
                  GROUP BY ALL HAVING count(DISTINCT global_order) = 1) p ON p.analysis_scope = r.analysis_scope AND p.dmc_raw = r.dmc_raw
            WHERE r.n = 1)""",
    "defect_links": "SELECT * FROM links WHERE code_status IN ('defect', 'state_code_conflict')",
    "measured": """
        SELECT l_orderkey AS source_row, 'Result.' || p_type AS parameter, l_quantity AS value,
            CASE l_linenumber WHEN 1 THEN '5 ... ' || p_size WHEN 2 THEN '2 ~ ' || p_size WHEN 3 THEN 'bad' WHEN 4 THEN '3 - ' || p_size
                WHEN 5 THEN '−5 … ' || p_size WHEN 6 THEN NULL ELSE '0 to ' || p_size || '.5' END AS tolerance_raw,
            CASE l_linenumber WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN -5 WHEN 7 THEN 0 END AS lo,
            CASE WHEN l_linenumber IN (3, 6) THEN NULL WHEN l_linenumber = 7 THEN p_size + 0.5 ELSE p_size END AS hi
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "judged": """
        SELECT source_row, parameter, value, tolerance_raw, CASE WHEN lo <= hi THEN lo END::DOUBLE AS lower, CASE WHEN lo <= hi THEN hi END::DOUBLE AS upper,
            coalesce(lo <= hi, false) AS evaluated, coalesce(lo <= hi AND (value < lo OR value > hi), false) AS violated FROM measured""",
    "records": """
        SELECT o_orderkey AS source_row, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'NOK' ELSE 'UNKNOWN' END AS state_result,
            o_orderpriority AS variant, strftime(o_orderdate, '%Y-%m') AS batch, 'L' || (o_custkey % 7) AS line, '' AS ttnr, o_orderdate AS timestamp,
            coalesce(e, 0) AS evaluated_parameter_count, coalesce(v, 0) AS tolerance_violation_count,
            CASE WHEN coalesce(e, 0) = 0 THEN 'UNKNOWN' WHEN v > 0 THEN 'NOK' ELSE 'OK' END AS tolerance_result
        FROM orders LEFT JOIN (SELECT source_row, count(*) FILTER (evaluated) AS e, count(*) FILTER (violated) AS v FROM judged GROUP BY 1) c ON c.source_row = o_orderkey""",
    "verdicts": "SELECT *, state_result <> 'UNKNOWN' AND tolerance_result <> 'UNKNOWN' AND state_result <> tolerance_result AS judgement_conflict FROM records",
    "returned": """
        SELECT l_orderkey AS global_order, o_orderstatus AS analysis_scope, p_brand AS defect_type
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'""",
    "cats": "SELECT DISTINCT analysis_scope, global_order, defect_type AS category FROM returned",
    "wide": """
        SELECT o_orderkey AS global_order, o_orderstatus AS analysis_scope, CASE WHEN o_totalprice > 250000 THEN 'NOK' ELSE 'OK' END AS aoi_state,
            p.* EXCLUDE (k), coalesce(d.n, 0) AS detected_defect_count
        FROM orders LEFT JOIN (SELECT l_orderkey AS k, avg(l_quantity) AS quantity, avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_cents,
                avg(CAST(round(l_discount * 100) AS BIGINT)) AS discount_pct, avg(l_linenumber) AS line_number, min(l_shipdate) AS ship_time FROM lineitem GROUP BY 1) p ON p.k = o_orderkey
        LEFT JOIN (SELECT global_order, count(*) AS n FROM returned GROUP BY 1) d ON d.global_order = o_orderkey""",
    "tall": """
        SELECT analysis_scope, global_order, parameter, value FROM (SELECT analysis_scope, global_order, unnest([
            {'p': 'quantity', 'v': quantity}, {'p': 'price_cents', 'v': price_cents}, {'p': 'discount_pct', 'v': discount_pct}, {'p': 'line_number', 'v': line_number}]) AS u
            FROM wide) CROSS JOIN LATERAL (SELECT u.p AS parameter, u.v AS value)""",
    "targets": """
        SELECT DISTINCT analysis_scope, 'DETECTED' AS target, global_order FROM returned
        UNION ALL SELECT analysis_scope, 'AOI_NOK', global_order FROM wide WHERE aoi_state = 'NOK'""",
    "labelled": """
        SELECT t.*, n.target, (g.global_order IS NOT NULL)::INT AS y FROM tall t JOIN (SELECT DISTINCT analysis_scope, target FROM targets) n USING (analysis_scope)
        LEFT JOIN targets g ON g.analysis_scope = t.analysis_scope AND g.target = n.target AND g.global_order = t.global_order""",
    "slots": "SELECT l_linenumber::BIGINT AS place, l_orderkey * 7 + l_linenumber AS position, l_returnflag AS flag FROM lineitem",
    "place_obs": "SELECT DISTINCT place, position AS o FROM slots WHERE flag <> 'A'",
    "place_elig": "SELECT DISTINCT position AS o FROM slots",
}


def _fit(prefix: str, obs: str, keys: list[str], elig: str, elig_keys: list[str], low: int = 2, high: int = 200,
         tolerance: int = 0, coverage: float = 0.65, wide: str = "") -> dict[str, str]:
    """CTEs <prefix>_best: the best period of every group of ``obs`` (keys, o)."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{key} = e.{key}" for key in elig_keys) or "true"
    periods = wide or f"range({low}, {high} + 1) t(p)"
    own = f"""SELECT {k}, n, p, o % p AS r, count(*) AS m, min(o) AS f, max(o) AS l FROM {prefix}_size JOIN {obs} USING ({k}) CROSS JOIN {periods} GROUP BY ALL"""
    if tolerance:  # a class takes in its neighbours, counted residue by residue
        cand = f"""SELECT {', '.join('x.' + key for key in keys)}, x.n, x.p, x.r, CAST(sum(y.m) AS BIGINT) AS m, min(y.f) AS f, max(y.l) AS l FROM ({own}) x JOIN ({own}) y
            ON {' AND '.join(f'y.{key} = x.{key}' for key in keys)} AND y.p = x.p AND least((y.r - x.r + x.p) % x.p, (x.r - y.r + x.p) % x.p) <= {tolerance}
            GROUP BY ALL HAVING sum(y.m) >= 4 AND sum(y.m) / x.n >= 0.75"""
    else:
        cand = f"{own} HAVING count(*) >= 4 AND count(*) / n >= 0.75"
    return {
        f"{prefix}_size": f"SELECT {k}, count(*) AS n, min(o) AS lo, max(o) AS hi FROM {obs} GROUP BY ALL",
        f"{prefix}_cand": cand,
        f"{prefix}_scored": f"""SELECT *, m / n AS precision, least(1.0::DOUBLE, m / s) AS coverage,
            2.0::DOUBLE * (m / n) * least(1.0::DOUBLE, m / s) / ((m / n) + least(1.0::DOUBLE, m / s)) AS confidence
            FROM (SELECT c.*, count(*) AS s FROM {prefix}_cand c JOIN {elig} e ON {on} AND e.o BETWEEN c.f AND c.l AND (e.o - c.f) % c.p = 0 GROUP BY ALL)
            WHERE least(1.0::DOUBLE, m / s) >= {coverage}""",
        f"{prefix}_best": f"SELECT * FROM {prefix}_scored QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY confidence DESC, coverage DESC, precision DESC, p, r) = 1",
    }


def _runs(name: str, obs: str, keys: list[str]) -> dict[str, str]:
    k = ", ".join(keys)
    return {
        f"{name}_all": f"""SELECT {k}, min(o) AS run_start, max(o) AS run_end, count(*) AS run_length FROM (
            SELECT *, o - row_number() OVER (PARTITION BY {k} ORDER BY o) AS g FROM {obs}) GROUP BY {k}, g""",
        name: f"SELECT * FROM {name}_all QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY run_length DESC, run_start) = 1",
    }


_CODE = ["analysis_scope", "station_id", "source_type", "canonical_code"]
CTES["code_obs"] = f"SELECT DISTINCT {', '.join(_CODE)}, production_order AS o FROM codes WHERE code_status IN ('defect', 'state_code_conflict')"
CTES["code_elig"] = "SELECT DISTINCT analysis_scope, station_id, source_type, production_order AS o FROM codes"
CTES["merged_obs"] = """SELECT DISTINCT analysis_scope, station_id, source_type, '5011+5020' AS canonical_code, production_order AS o FROM codes
    WHERE code_status IN ('defect', 'state_code_conflict') AND canonical_code IN ('5011', '5020')"""
CTES["cell_obs"] = "SELECT DISTINCT analysis_scope, station_id, cluster_id, production_order AS o FROM detections WHERE cluster_id IS NOT NULL"
CTES["cell_elig"] = "SELECT DISTINCT analysis_scope, station_id, production_order AS o FROM products"
CTES |= _fit("cf", "code_obs", _CODE, "code_elig", _CODE[:3]) | _runs("code_run", "code_obs", _CODE)
CTES |= _fit("mf", "merged_obs", _CODE, "code_elig", _CODE[:3]) | _runs("merged_run", "merged_obs", _CODE)
CTES |= _fit("pf", "place_obs", ["place"], "place_elig", [])
CTES |= _fit("tf", "place_obs", ["place"], "place_elig", [], tolerance=1, coverage=0.3)
# of three quarters of all orders two neighbours are in the class, so a period divides some gap
CTES["place_gaps"] = "SELECT DISTINCT o - lag(o) OVER (PARTITION BY place ORDER BY o) AS g FROM place_obs"
CTES["gap_periods"] = "SELECT DISTINCT p FROM (SELECT unnest(range(2, g + 1)) AS p, g FROM place_gaps WHERE g >= 2) WHERE g % p = 0 AND p <= 1000000"
CTES |= _fit("wf", "place_obs", ["place"], "place_elig", [], wide="gap_periods")
CTES |= _fit("xf", "cell_obs", ["analysis_scope", "station_id", "cluster_id"], "cell_elig", ["analysis_scope", "station_id"])
CTES |= _runs("cell_run", "cell_obs", ["analysis_scope", "station_id", "cluster_id"])


def _code_patterns(fit: str, run: str, names: str) -> str:
    k = ", ".join(_CODE)
    return f"""SELECT 'code' AS evidence_source, {k}, coalesce(defect_name, '') AS defect_name,
            CASE WHEN p IS NOT NULL THEN 'periodic' WHEN run_length >= 4 THEN 'burst' ELSE 'recurrent' END AS pattern_type,
            z.n AS occurrence_count, z.lo AS first_production_order, z.hi AS last_production_order, p AS period,
            CASE WHEN p IS NOT NULL THEN b.f WHEN run_length >= 4 THEN run_start END AS phase_start_production_order,
            CASE WHEN p IS NOT NULL THEN precision WHEN run_length >= 4 THEN 1.0 END AS precision,
            CASE WHEN p IS NOT NULL THEN coverage WHEN run_length >= 4 THEN 1.0 END AS coverage,
            CASE WHEN p IS NOT NULL THEN confidence WHEN run_length >= 4 THEN 1.0 END AS confidence
        FROM {fit}_size z JOIN {run} USING ({k}) LEFT JOIN {fit}_best b USING ({k}) LEFT JOIN ({names}) d USING ({k}) WHERE z.n >= 4"""


_NAMES = f"""SELECT {', '.join(_CODE)}, string_agg(DISTINCT defect_name, ' / ' ORDER BY defect_name) AS defect_name FROM codes
    WHERE code_status IN ('defect', 'state_code_conflict') AND defect_name <> '' GROUP BY ALL"""
_MERGED_NAMES = """SELECT analysis_scope, station_id, source_type, '5011+5020' AS canonical_code, string_agg(DISTINCT defect_name, ' / ' ORDER BY defect_name) AS defect_name
    FROM codes WHERE code_status IN ('defect', 'state_code_conflict') AND canonical_code IN ('5011', '5020') AND defect_name <> '' GROUP BY ALL"""
CTES["code_pattern_rows"] = _code_patterns("cf", "code_run", _NAMES)
CTES["merged_pattern_rows"] = _code_patterns("mf", "merged_run", _MERGED_NAMES)
_CELL = ["analysis_scope", "station_id", "cluster_id"]
CTES["leader_obs"] = "SELECT DISTINCT analysis_scope, station_id, cluster_id, o FROM leaders"
CTES["prefix_obs"] = """SELECT a.analysis_scope, a.station_id, a.cluster_id, a.o AS c, b.o FROM leader_obs a JOIN leader_obs b
    ON b.analysis_scope = a.analysis_scope AND b.station_id = a.station_id AND b.cluster_id = a.cluster_id AND b.o <= a.o"""
CTES |= _fit("lf", "leader_obs", _CELL, "cell_elig", _CELL[:2]) | _runs("leader_run", "leader_obs", _CELL)
CTES |= _fit("qf", "prefix_obs", [*_CELL, "c"], "cell_elig", _CELL[:2]) | _runs("prefix_run", "prefix_obs", [*_CELL, "c"])
CTES["cell_pattern_rows"] = """SELECT analysis_scope, station_id, cluster_id,
        CASE WHEN p IS NOT NULL THEN 'periodic' WHEN run_length >= 4 THEN 'burst' ELSE 'fixed_position_repeat' END AS pattern_type,
        CASE WHEN p IS NULL AND run_length >= 4 THEN run_length ELSE z.n END AS occurrence_count,
        CASE WHEN p IS NULL AND run_length >= 4 THEN run_start ELSE z.lo END AS first_order,
        CASE WHEN p IS NULL AND run_length >= 4 THEN run_end ELSE z.hi END AS last_order, p AS period,
        CASE WHEN p IS NOT NULL THEN b.f WHEN run_length >= 4 THEN run_start END AS phase_start,
        CASE WHEN p IS NOT NULL THEN precision WHEN run_length >= 4 THEN 1.0 END AS precision,
        CASE WHEN p IS NOT NULL THEN coverage WHEN run_length >= 4 THEN 1.0 END AS coverage,
        CASE WHEN p IS NOT NULL THEN confidence WHEN run_length >= 4 THEN 1.0 END AS confidence
    FROM xf_size z JOIN cell_run USING (analysis_scope, station_id, cluster_id) LEFT JOIN xf_best b USING (analysis_scope, station_id, cluster_id) WHERE z.n >= 4"""
CTES["leader_pattern_rows"] = CTES["cell_pattern_rows"].replace("xf_", "lf_").replace("cell_run", "leader_run")
def _replay(prefix: str, obs: str, elig: str, high: int = 200) -> dict[str, str]:
    """CTEs <prefix>_alerts and <prefix>_active: every alert of the clusters of ``obs`` on the lines of ``elig``, at default settings."""
    c, line = ", ".join(_CELL), ", ".join(_CELL[:2])
    on = lambda a, b, keys=_CELL: " AND ".join(f"{a}.{key} = {b}.{key}" for key in keys)
    none = "NULL::BIGINT"
    return {
        f"{prefix}_line": f"SELECT *, lead(o) OVER (PARTITION BY {line} ORDER BY o) AS later, max(o) OVER (PARTITION BY {line}) AS line_end FROM {elig}",
        f"{prefix}_num": f"SELECT {c}, o, row_number() OVER (PARTITION BY {c} ORDER BY o) AS n, count(*) OVER (PARTITION BY {c}) AS total, min(o) OVER (PARTITION BY {c}) AS lo FROM {obs}",
        f"{prefix}_most": f"SELECT {c}, p, o % p AS r, count(*) AS most FROM {prefix}_num CROSS JOIN range(2, {high} + 1) t(p) WHERE total >= 4 GROUP BY ALL HAVING count(*) >= 4",
        f"{prefix}_touch": f"""SELECT {c}, o, n, total, p, r, row_number() OVER w AS m, min(o) OVER (PARTITION BY {c}, p, r) AS f, lead(n) OVER w AS nx
            FROM {prefix}_num z JOIN {prefix}_most USING ({c}) WHERE z.o % p = r AND n * 0.75 <= most WINDOW w AS (PARTITION BY {c}, p, r ORDER BY o)""",
        f"{prefix}_good": f"SELECT * FROM {prefix}_touch WHERE m >= 4 AND m / n >= 0.75",
        f"{prefix}_rank": f"""SELECT {line}, o, p, row_number() OVER (PARTITION BY {line}, p, o % p ORDER BY o) AS e
            FROM {elig} JOIN (SELECT DISTINCT {line}, p FROM {prefix}_good) USING ({line})""",
        f"{prefix}_opened": f"SELECT g.*, e - 1 AS earlier FROM {prefix}_good g JOIN {prefix}_rank a ON {on('a', 'g', _CELL[:2])} AND a.p = g.p AND a.o = g.f",
        f"{prefix}_cover": f"SELECT g.*, least(1.0::DOUBLE, m / (e - earlier)) AS coverage FROM {prefix}_opened g JOIN {prefix}_rank b ON {on('b', 'g', _CELL[:2])} AND b.p = g.p AND b.o = g.o",
        f"{prefix}_valid": f"""SELECT *, m / k AS precision, 2.0::DOUBLE * (m / k) * coverage / ((m / k) + coverage) AS confidence
            FROM (SELECT *, unnest(range(n, least(coalesce(nx - 1, total), CAST(floor(m / 0.75) AS BIGINT) + 1) + 1)) AS k FROM {prefix}_cover WHERE coverage >= 0.65) WHERE m / k >= 0.75""",
        f"{prefix}_fits": f"""SELECT {c}, z.o, v.k, p, f, confidence FROM {prefix}_valid v JOIN {prefix}_num z USING ({c}) WHERE z.n = v.k
            QUALIFY row_number() OVER (PARTITION BY {c}, v.k ORDER BY confidence DESC, coverage DESC, precision DESC, p, r) = 1""",
        f"{prefix}_first": f"SELECT *, f + ((o - f) // p + 1) * p AS following FROM {prefix}_fits QUALIFY row_number() OVER (PARTITION BY {c} ORDER BY k) = 1",
        f"{prefix}_bursts": f"""SELECT {c}, min(s) AS s FROM (SELECT {c}, min(o) AS s FROM (SELECT {c}, o, o - n AS g FROM {prefix}_num) GROUP BY {c}, g HAVING count(*) >= 4) GROUP BY {c}""",
        f"{prefix}_slots": f"""SELECT a.{', a.'.join(_CELL)}, a.o AS confirmed, a.p, e.o AS slot, s.o IS NOT NULL AS seen, CASE WHEN s.o IS NULL THEN e.later END AS reported
                FROM {prefix}_first a JOIN {prefix}_line e ON {on('e', 'a', _CELL[:2])} AND e.o >= a.following AND (e.o - a.following) % a.p = 0
                LEFT JOIN {obs} s ON {on('s', 'a')} AND s.o = e.o
            UNION ALL SELECT DISTINCT a.{', a.'.join(_CELL)}, a.o, a.p, greatest(a.following, a.following + CAST(ceil((e.line_end + 1 - a.following) / a.p) AS BIGINT) * a.p), false, {none}
                FROM {prefix}_first a JOIN {prefix}_line e ON {on('e', 'a', _CELL[:2])}""",
        f"{prefix}_settled": f"""SELECT *, lag(settled) OVER w AS waited, lag(slot) OVER w AS prior FROM (
            SELECT *, CASE WHEN seen THEN slot ELSE reported END AS settled,
                CASE WHEN seen THEN slot + p ELSE slot + CAST(ceil((reported - slot) / p) AS BIGINT) * p END AS onward FROM {prefix}_slots)
            WINDOW w AS (PARTITION BY {c} ORDER BY slot)""",
        f"{prefix}_due": f"""SELECT {c}, confirmed, reported AS due, 'expected_occurrence_missing' AS alert_type, slot AS predicted FROM {prefix}_settled WHERE reported IS NOT NULL
            UNION ALL SELECT {c}, confirmed, t.slot - 3, 'upcoming_periodic_defect', slot FROM {prefix}_settled t WHERE slot - 3 > confirmed AND (prior IS NULL OR waited < slot - 3)
                AND EXISTS (SELECT 1 FROM {elig} e WHERE {on('e', 't', _CELL[:2])} AND e.o = t.slot - 3)
            UNION ALL SELECT {c}, confirmed, settled, 'upcoming_periodic_defect', onward FROM {prefix}_settled WHERE onward - 3 = settled""",
        f"{prefix}_known": f"""SELECT d.*, f.confidence, l.o AS last_seen, l.lo FROM {prefix}_due d ASOF JOIN {prefix}_fits f ON {on('d', 'f')} AND d.due > f.o
            ASOF JOIN {prefix}_num l ON {on('d', 'l')} AND d.due >= l.o""",
        f"{prefix}_raised": f"""
            SELECT {c}, due, alert_type, confidence, predicted, 'all' AS kind, lo AS a, last_seen AS b, {none} AS period, {none} AS phase, confirmed, CASE alert_type WHEN 'expected_occurrence_missing' THEN 1 ELSE 2 END AS place
                FROM {prefix}_known
            UNION ALL SELECT {c}, s + 3, 'burst_detected', 1.0, NULL, 'run', s, s + 3, NULL, NULL, NULL, 3 FROM {prefix}_bursts
            UNION ALL SELECT {c}, o, 'periodic_pattern_confirmed', confidence, following, 'matched', f, o, p, f, NULL, 4 FROM {prefix}_first
            UNION ALL SELECT {c}, min(z.o), 'fixed_position_repeat_confirmed', 0.5, NULL, 'all', min(lo), min(z.o), NULL, NULL, NULL, 5 FROM {prefix}_num z LEFT JOIN {prefix}_bursts USING ({c})
                WHERE z.n >= 4 AND (s IS NULL OR z.o < s + 3) AND NOT EXISTS (SELECT 1 FROM {prefix}_fits f WHERE {on('f', 'z')} AND f.k = z.n) GROUP BY {c}""",
        f"{prefix}_born": f"SELECT {c}, row_number() OVER (PARTITION BY {line} ORDER BY lo, length(cluster_id), cluster_id) AS no FROM (SELECT DISTINCT {c}, lo FROM {prefix}_num)",
        f"{prefix}_alerts": f"""SELECT regexp_replace(station_id, '[^A-Za-z0-9_-]+', '-', 'g') || '-A' || printf('%04d', row_number() OVER (PARTITION BY {line}
                ORDER BY due, place > 2, confirmed NULLS FIRST, no, place)) AS alert_id, {c}, due AS alert_at_order, alert_type,
            CASE alert_type WHEN 'burst_detected' THEN 'critical' WHEN 'fixed_position_repeat_confirmed' THEN 'notice' ELSE 'warning' END AS severity,
            round(confidence, 6) AS confidence, predicted AS predicted_order, kind AS evidence_kind, a AS evidence_from, b AS evidence_to, period, phase
            FROM {prefix}_raised JOIN {prefix}_born USING ({c})""",
        f"{prefix}_active": f"SELECT {c}, any_value(confirmed) AS confirmed_at_order, min(slot) FILTER (settled IS NULL) AS next_expected_order FROM {prefix}_settled GROUP BY {c}",
    }


CTES["track_places"] = "SELECT '5S' AS analysis_scope, 'K' || l_orderkey % 3 AS station_id, l_orderkey * 7 + l_linenumber AS o, l_linenumber AS place, l_returnflag AS flag, l_suppkey AS supplier FROM lineitem"
CTES["track_obs"] = """SELECT DISTINCT analysis_scope, station_id, 'P' || place AS cluster_id, o FROM track_places WHERE flag <> 'A'
    UNION SELECT analysis_scope, station_id, 'S' || supplier % 5, o FROM track_places"""
CTES["track_elig"] = "SELECT DISTINCT analysis_scope, station_id, o FROM track_places"
CTES |= _replay("tr", "track_obs", "track_elig") | _replay("lr", "leader_obs", "cell_elig") | _replay("cr", "cell_obs", "cell_elig")
CTES |= _fit("kf", "track_obs", _CELL, "track_elig", _CELL[:2]) | _runs("track_run", "track_obs", _CELL)
CTES["track_pattern_rows"] = CTES["cell_pattern_rows"].replace("xf_", "kf_").replace("cell_run", "track_run")


def _patterns(rows: str, run: str, active: str) -> str:
    c = ", ".join(_CELL)
    return f"""SELECT {c}, pattern_type, occurrence_count, period, phase_start, round(precision, 6) AS precision, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, first_order, last_order,
        CASE pattern_type WHEN 'periodic' THEN confirmed_at_order WHEN 'burst' THEN run_end END AS confirmed_at_order,
        CASE pattern_type WHEN 'periodic' THEN next_expected_order END AS next_expected_order FROM {rows} JOIN {run} USING ({c}) LEFT JOIN {active} USING ({c})"""


CTES["place_missing"] = """SELECT b.place, e.o AS missing_order FROM pf_best b JOIN pf_size z USING (place) JOIN place_elig e
    ON e.o BETWEEN b.f AND z.hi AND (e.o - b.f) % b.p = 0 WHERE NOT EXISTS (SELECT 1 FROM place_obs s WHERE s.place = b.place AND s.o = e.o)"""
CTES["code_missing"] = """SELECT b.analysis_scope, b.station_id, b.source_type, b.canonical_code, e.o FROM cf_best b JOIN cf_size z USING (analysis_scope, station_id, source_type, canonical_code)
    JOIN code_elig e ON e.analysis_scope = b.analysis_scope AND e.station_id = b.station_id AND e.source_type = b.source_type AND e.o BETWEEN b.f AND z.hi AND (e.o - b.f) % b.p = 0
    WHERE NOT EXISTS (SELECT 1 FROM code_obs s WHERE s.analysis_scope = b.analysis_scope AND s.station_id = b.station_id AND s.source_type = b.source_type
        AND s.canonical_code = b.canonical_code AND s.o = e.o)"""
CTES["members"] = "SELECT DISTINCT analysis_scope, 'cluster' AS spatial_type, cluster_id AS spatial_id, station_id, global_order FROM detections WHERE cluster_id IS NOT NULL"
CTES["pair_rows"] = """
    SELECT s.analysis_scope, st.station_id, s.source_type, s.canonical_code, coalesce(nm.defect_name, '') AS defect_name, s.spatial_type, s.spatial_id,
        s.n AS support_products, c.n AS code_products, m.n AS spatial_products, s.n / c.n AS p_spatial_given_code, s.n / m.n AS p_code_given_spatial,
        (s.n / t.n) / ((c.n / t.n) * (m.n / t.n)) AS lift
    FROM (SELECT analysis_scope, source_type, canonical_code, spatial_type, spatial_id, count(DISTINCT global_order) AS n FROM defect_links JOIN members USING (analysis_scope, global_order)
          GROUP BY analysis_scope, source_type, canonical_code, spatial_type, spatial_id) s
    JOIN (SELECT analysis_scope, source_type, canonical_code, count(DISTINCT global_order) AS n FROM defect_links GROUP BY ALL) c USING (analysis_scope, source_type, canonical_code)
    JOIN (SELECT analysis_scope, spatial_type, spatial_id, count(DISTINCT global_order) AS n FROM members GROUP BY ALL) m USING (analysis_scope, spatial_type, spatial_id)
    JOIN (SELECT analysis_scope, count(DISTINCT global_order) AS n FROM products GROUP BY ALL) t USING (analysis_scope)
    LEFT JOIN (SELECT analysis_scope, source_type, canonical_code, string_agg(DISTINCT defect_name, ' / ' ORDER BY defect_name) AS defect_name FROM defect_links WHERE defect_name <> '' GROUP BY ALL) nm
        USING (analysis_scope, source_type, canonical_code)
    LEFT JOIN (SELECT analysis_scope, spatial_type, spatial_id, string_agg(DISTINCT station_id, ';' ORDER BY station_id) AS station_id FROM members GROUP BY ALL) st USING (analysis_scope, spatial_type, spatial_id)"""
CTES["pairs"] = """SELECT *, CASE WHEN support_products >= 5 AND least(p_spatial_given_code, p_code_given_spatial) >= 0.7 AND lift >= 1.5 THEN 'strong'
    WHEN support_products >= 4 AND lift >= 1.2 THEN 'medium' ELSE 'weak' END AS association_strength FROM pair_rows"""
CTES["conflicts"] = """
    SELECT c.analysis_scope, c.global_order, p.production_order, c.dmc_raw, aoi_codes, vi_codes,
        CASE WHEN aoi_codes <> '' AND vi_codes = '' THEN 'missing_vi' WHEN vi_codes <> '' AND aoi_codes = '' THEN 'missing_aoi'
             WHEN both_n > 0 THEN 'consistent' ELSE 'label_conflict' END AS comparison_status
    FROM (SELECT analysis_scope, global_order, dmc_raw,
            coalesce(string_agg(DISTINCT canonical_code, ';' ORDER BY canonical_code) FILTER (source_type = 'AOI_FAILURE'), '') AS aoi_codes,
            coalesce(string_agg(DISTINCT canonical_code, ';' ORDER BY canonical_code) FILTER (source_type = 'VI_BLOCK'), '') AS vi_codes,
            len(list_intersect(coalesce(list(canonical_code) FILTER (source_type = 'AOI_FAILURE'), []), coalesce(list(canonical_code) FILTER (source_type = 'VI_BLOCK'), []))) AS both_n
          FROM defect_links GROUP BY ALL) c LEFT JOIN products p USING (global_order)"""
CTES["sites"] = """SELECT seq + 1 AS global_order, dmc_raw, station_id, test_date, CASE WHEN value >= 110 THEN 'ambiguous_event' ELSE 'evaluable' END AS evidence_status FROM passes"""
CTES["tracks"] = "SELECT *, station_id || '-T' || CAST(floor(center_y_norm * 10) AS BIGINT) AS trajectory_id FROM spots"
CTES["upstream"] = """
    SELECT trajectory_id, count(*) AS comparable, count(*) FILTER (NOT hit) AS upstream_clean FROM (
        SELECT t.trajectory_id, t.global_order, m.mean_y,
            EXISTS (SELECT 1 FROM sites u WHERE u.dmc_raw = t.dmc_raw AND u.station_id <> t.station_id AND u.test_date < s.test_date AND u.evidence_status = 'evaluable') AS earlier,
            EXISTS (SELECT 1 FROM sites u JOIN tracks d ON d.global_order = u.global_order WHERE u.dmc_raw = t.dmc_raw AND u.station_id <> t.station_id
                AND u.test_date < s.test_date AND u.evidence_status = 'evaluable' AND abs(d.center_y_norm - m.mean_y) <= 0.02) AS hit
        FROM (SELECT DISTINCT trajectory_id, station_id, global_order, dmc_raw FROM tracks) t JOIN sites s ON s.global_order = t.global_order
        JOIN (SELECT trajectory_id, avg(center_y_norm) AS mean_y FROM tracks GROUP BY 1) m USING (trajectory_id)) WHERE earlier GROUP BY 1"""
CTES["images"] = """
    SELECT *, '/plant/' || station_id || '/U' || user_id || '-' || d1 || d2 || fam || vw || sfx AS path,
        sfx <> '.txt' AND d2 <> '20249901' AS named, 'U' || user_id || '-' || d1 AS dmc_raw, upper(vw) AS view_code
    FROM (SELECT e.event_id, s.station_id, s.image_profile, s.family_code, s.views, e.user_id, e.ts, e.value, strftime(ts, '%Y%m%d') AS d1,
            CASE WHEN value < 2 THEN '20249901' ELSE strftime(ts, '%Y%m%d') END AS d2, CASE WHEN value > 150 THEN 'G' ELSE s.family_code END AS fam,
            CASE event_type WHEN 'view' THEN 'A' WHEN 'error' THEN 'E' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'x' ELSE 'Q' END AS vw,
            CASE WHEN value < 1 THEN '.txt' WHEN value < 30 THEN '.PNG' ELSE '.jpg' END AS sfx
          FROM events e JOIN station_dim s ON e.user_id % 18 = s.idx)"""
CTES["good_images"] = "SELECT * FROM images WHERE named AND fam = family_code AND list_contains(views, view_code)"
CTES["expected"] = "SELECT DISTINCT s.station_id, 'U' || user_id || '-20240105' AS dmc_raw FROM events e JOIN station_dim s ON e.user_id % 18 = s.idx"
CTES["view_files"] = "SELECT station_id, dmc_raw, view_code, count(*) AS n, min(path) AS path, min(CAST(ts AS DATE)) AS capture_date FROM good_images GROUP BY ALL"
CTES["image_rows"] = """
    SELECT coalesce(i.station_id, x.station_id) AS station_id, coalesce(i.dmc_raw, x.dmc_raw) AS dmc_raw, capture_date, x.dmc_raw IS NOT NULL AS has_excel_record,
        pa AS "view_A_path", pb AS "view_B_path", pc AS "view_C_path", pe AS "view_E_path", px AS "view_X_path", py AS "view_Y_path"
    FROM (SELECT station_id, dmc_raw, min(capture_date) AS capture_date, max(path) FILTER (view_code = 'A' AND n = 1) AS pa, max(path) FILTER (view_code = 'B' AND n = 1) AS pb,
            max(path) FILTER (view_code = 'C' AND n = 1) AS pc, max(path) FILTER (view_code = 'E' AND n = 1) AS pe,
            max(path) FILTER (view_code = 'X' AND n = 1) AS px, max(path) FILTER (view_code = 'Y' AND n = 1) AS py FROM view_files GROUP BY ALL) i
    FULL JOIN expected x ON x.station_id = i.station_id AND x.dmc_raw = i.dmc_raw"""
CTES["issue_rows"] = """
    SELECT 'warning' AS level, station_id, CASE WHEN named THEN dmc_raw ELSE '' END AS dmc_raw, path AS file,
        CASE WHEN NOT named THEN 'file name does not follow the naming rule'
             WHEN fam <> family_code THEN 'image family ' || fam || ' does not belong to profile ' || image_profile
             ELSE 'view ' || fam || view_code || ' is not configured' END AS issue
    FROM images WHERE sfx <> '.txt' AND NOT (named AND fam = family_code AND list_contains(views, view_code))
    UNION ALL
    SELECT 'error', g.station_id, g.dmc_raw, g.path, 'view ' || fam || g.view_code || ' has several candidate files' FROM good_images g JOIN view_files v
        ON v.station_id = g.station_id AND v.dmc_raw = g.dmc_raw AND v.view_code = g.view_code WHERE v.n > 1"""
CTES["unpaired"] = """SELECT 'warning' AS level, r.station_id, r.dmc_raw, '' AS file, 'missing primary pair ' || s.family_code || 'A+' || s.family_code || 'E; record kept, image step skipped' AS issue
    FROM image_rows r JOIN station_dim s USING (station_id) WHERE "view_A_path" IS NULL OR "view_E_path" IS NULL"""
CTES["part_catalog"] = """SELECT p_partkey + 2 AS source_row, CASE p_size % 3 WHEN 0 THEN '5' WHEN 1 THEN '7' ELSE '' END AS layer, CAST(5000 + p_partkey % 90 AS VARCHAR) AS code,
    p_name AS name, p_brand AS region, p_size % 5 <> 0 AS enabled FROM part"""
CTES["sheet_events"] = """
    SELECT 'F' || strftime(test_date, '%Y%m%d') AS source_file, 'S' || (user_id % 3) AS source_sheet, seq * 4 + 3 AS source_row,
        'Block ' || (hour(test_date) // 12) AS station_title, p.*,
        string_split(location, '.') AS loc, CASE WHEN value > 120 THEN '9' ELSE string_split(location, '.')[3] END AS si,
        CASE WHEN value > 200 THEN '99' ELSE string_split(location, '.')[5] END AS wp, CASE WHEN value > 200 THEN '' ELSE p.station_id END AS resolved_station,
        date_trunc('second', test_date) AS read_date FROM passes p"""


def sql(body: str) -> str:
    """``body`` below the shared tables it names, directly or through others."""
    used: list[str] = []
    open_names: set[str] = set()

    def need(text: str) -> None:
        for name, definition in CTES.items():
            if name not in open_names and re.search(rf"\b{name}\b", text):
                open_names.add(name)
                need(definition)
                used.append(name)

    need(body)
    once = ("_num", "_good", "_rank", "_opened", "_cover", "_fits", "_first", "_settled", "_known", "_raised")  # read several times and dear
    head = ",\n".join(f"{name} AS {'MATERIALIZED ' * name.endswith(once)}({CTES[name]})" for name in used)
    return f"WITH RECURSIVE {head}\n{body}" if used else body


ORACLES: dict[str, str] = {}


def _add(name: str, body: str) -> None:
    ORACLES[name] = sql(body)


# ------------------------------------------------------------------- scalar functions

_add("scalar_pass_codes", """
    SELECT event_id, CASE source_sheet WHEN 'AOI' THEN 'aoi' WHEN 'Other' THEN 'other' WHEN 'WP' THEN 'wp' ELSE 'ms0335all' END AS sheet_key, state, scope,
        a AS aoi_code, v AS vi_code,
        CASE WHEN a = '1000' AND state = 'OK' THEN 'normal' WHEN a = '' AND state = 'SCRAPPED' THEN 'scrapped' WHEN a <> '' AND a <> '1000' AND state <> 'OK' THEN 'defect'
             WHEN a <> '' THEN 'state_code_conflict' ELSE 'unknown' END AS aoi_status,
        CASE WHEN v <> '' THEN 'defect' WHEN state = 'SCRAPPED' THEN 'scrapped' ELSE 'unknown' END AS vi_status
    FROM (SELECT *, CASE WHEN length(regexp_extract(coalesce(aoi_failure_code, ''), '[0-9]+')) >= 4 THEN left(regexp_extract(aoi_failure_code, '[0-9]+'), 4) ELSE '' END AS a,
        CASE WHEN length(regexp_replace(coalesce(block_code, ''), '[^0-9]', '', 'g')) >= 4 THEN right(regexp_replace(block_code, '[^0-9]', '', 'g'), 4) ELSE '' END AS v FROM passes)""")
_add("scalar_number_text", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity_text,
    CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR) ELSE CAST(l_discount AS VARCHAR) END AS discount_text FROM lineitem""")
_add("scalar_test_state", "SELECT o_orderkey AS source_row, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'NOK' ELSE 'UNKNOWN' END AS state_result FROM orders")
_add("scalar_mixed_dates", """SELECT event_id, CASE user_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
    WHEN 3 THEN date_trunc('second', ts) END AS read_time FROM events""")
_add("scalar_tolerance_bounds", "SELECT parameter, tolerance_raw, lower, upper, value, evaluated, violated, count(*) AS cells FROM judged GROUP BY ALL")
_add("scalar_image_names", """SELECT event_id, CASE WHEN named THEN dmc_raw END AS dmc_raw, CASE WHEN named THEN CAST(ts AS DATE) END AS capture_date,
    CASE WHEN named THEN fam END AS family_code, CASE WHEN named THEN view_code END AS view_code FROM images""")
_BLOB = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['5S', '5X', '7S', '7X'][l_suppkey % 4 + 1] AS camera, CAST(l_quantity AS INT) AS q,
    CAST(floor(l_discount * 100 * l_quantity * l_quantity) AS INT) AS area, 1600 + l_partkey % 40 AS rw FROM lineitem)"""
_add("scalar_blob_types", f"""SELECT camera, q AS width, q * l_linenumber AS height, area AS component_area,
        CASE WHEN q / 100 >= 0.4 AND q * l_linenumber / 120 >= 0.4 THEN 'region_anomaly' WHEN area <= 7 THEN 'micro' ELSE 'local' END AS detection_type, count(*) AS blobs
    FROM {_BLOB} WHERE area >= 1 AND ((q / 100 >= 0.4 AND q * l_linenumber / 120 >= 0.4) OR area <= 5000) GROUP BY ALL""")
_add("scalar_reference_coordinates", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((q + 0.75::DOUBLE) * (rw / 100) - 0.5::DOUBLE, 6) AS center_x, round((q + 1.0::DOUBLE) * (1920 / 120) - 0.5::DOUBLE, 6) AS center_y,
        round((q + 0.75::DOUBLE) / 100, 6) AS center_x_norm, round((q + 1.0::DOUBLE) / 120, 6) AS center_y_norm, CAST(floor(q * (rw / 100)) AS BIGINT) AS bbox_x1, CAST(floor(q * (1920 / 120)) AS BIGINT) AS bbox_y1,
        CAST(least(rw - 1, ceil((q + 4) * (rw / 100)) - 1) AS BIGINT) AS bbox_x2, CAST(least(1919, ceil((q * 2 + 4) * (1920 / 120)) - 1) AS BIGINT) AS bbox_y2
    FROM {_BLOB} WHERE abs((rw / 1920) / (100 / 120) - 1.0::DOUBLE) <= 0.02""")
_add("scalar_registration", """
    SELECT detected_id, round(CASE WHEN ok THEN (a * px + t * py) / (a * a + t * t) / 512 ELSE center_x_norm END, 6) AS aligned_x_norm,
        round(CASE WHEN ok THEN (a * py - t * px) / (a * a + t * t) / 384 ELSE center_y_norm END, 6) AS aligned_y_norm,
        round(CASE WHEN ok THEN score ELSE 0 END, 6) AS registration_score,
        CASE WHEN ok AND score >= 0.8 THEN 'high' WHEN event_type <> 'purchase' THEN 'low' ELSE 'unavailable' END AS registration_quality
    FROM (SELECT d.*, p.event_type, p.value / 10000 AS t, 1 - p.value / 10000 / 8 AS a, center_x_norm * 512 - p.value / 100 AS px, center_y_norm * 384 + 2 AS py,
            1 - p.value / 200 AS score, p.event_type NOT IN ('purchase', 'error') AS ok FROM detections d JOIN passes p ON p.seq + 1 = d.global_order)""")
_add("scalar_detection_verdicts", """SELECT analysis_scope, CASE aoi_state WHEN 'NOK' THEN CASE WHEN d THEN 'hit' ELSE 'miss_candidate' END WHEN 'OK' THEN CASE WHEN d THEN 'false_alarm_candidate' ELSE 'correct' END
        ELSE 'not_evaluable' END AS verdict, count(*) AS products
    FROM (SELECT *, EXISTS (SELECT 1 FROM detections x WHERE x.global_order = p.global_order AND detection_type <> 'region_anomaly') AS d FROM products p) GROUP BY ALL""")
_add("filter_search_parts", """SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%bolt%' OR CAST(p_partkey AS VARCHAR) ILIKE '%red%bolt%' OR p_brand ILIKE '%red%bolt%' OR p_type ILIKE '%red%bolt%'""")
_add("filter_products_and_detections", """SELECT o_orderkey AS global_order, o_orderpriority AS batch, count(*) AS detections FROM orders JOIN returned r ON r.global_order = o_orderkey
    WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderdate BETWEEN '1996-01-01' AND '1999-12-31' AND defect_type = 'Brand#3' GROUP BY ALL""")
_add("filter_order_lists", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey = l_partkey)
    OR EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey = l_suppkey) OR EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey = l_orderkey * 3)
    OR EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey = l_orderkey)""")
_add("remap_order_lists", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(';', a.o_custkey, b.o_custkey, c.o_custkey) AS orders_text FROM lineitem
    LEFT JOIN orders a ON a.o_orderkey = l_partkey LEFT JOIN orders b ON b.o_orderkey = l_suppkey LEFT JOIN orders c ON c.o_orderkey = l_orderkey * 3""")

# ----------------------------------------------------------------------------- sources

_add("station_catalog_checks", """SELECT 'station_count' AS "check", CAST(count(DISTINCT station_id) AS VARCHAR) AS detail FROM passes HAVING count(DISTINCT station_id) <> 17""")
_add("station_usage", "SELECT station_id, station_group, s.location, image_profile, family_code, len(views) AS views, count(*) AS passes FROM passes JOIN station_dim s USING (station_id) GROUP BY ALL")
CTES["builtin_catalog"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({row}, '{layer}', '{code}', '{name}', '{region}', {enabled})" for row, (layer, code, name, region, _, enabled, _) in enumerate(DEFECT_CODES, 2)
) + ") t(source_row, layer, code, name, region, enabled)"
CTES["catalog_all"] = """SELECT * FROM (SELECT 0 AS source, source_row, layer, code, name, region, enabled FROM builtin_catalog
    UNION ALL SELECT 1, source_row, layer, code, name, region, enabled FROM part_catalog WHERE layer <> '')
    QUALIFY row_number() OVER (PARTITION BY layer, code, region ORDER BY source DESC, source_row DESC) = 1"""
_add("catalog_override", "SELECT layer, code, name, region, enabled, source, source_row FROM catalog_all")
_add("catalog_issues", "SELECT 1 AS source, source_row, 'invalid layer/code/name' AS issue FROM part_catalog WHERE layer = ''")
_add("catalog_code_names", """SELECT layer, code, string_agg(name, ' / ' ORDER BY p) AS defect_name
    FROM (SELECT layer, code, name, min(source * 1000000000000 + source_row) AS p FROM catalog_all WHERE enabled GROUP BY ALL) GROUP BY ALL""")
_add("image_product_index", """SELECT row_number() OVER (ORDER BY capture_date NULLS LAST, dmc_raw, station_id) AS global_order, r.*, s.image_profile AS camera, "view_A_path" AS a_image_path, "view_E_path" AS e_image_path,
    "view_A_path" IS NOT NULL AND "view_E_path" IS NOT NULL AS has_primary_pair FROM image_rows r JOIN station_dim s USING (station_id)""")
_add("image_issues", """SELECT level, station_id, issue, count(*) AS files, count(DISTINCT dmc_raw) AS products FROM (SELECT * FROM issue_rows UNION ALL SELECT * FROM unpaired) GROUP BY ALL""")
_LOCATIONS = "[" + ", ".join(f"'{location}'" for location in sorted(row[3] for row in STATIONS)) + "]"
_add("declared_location_mismatches", f"""SELECT source, r.station_id, r.location, coalesce(d.station_id, 'unknown') AS declared_station, CASE WHEN r.location = '' THEN 'warning' ELSE 'error' END AS level
    FROM (SELECT DISTINCT batch || '/' || station_id || '/' || event_type AS source, station_id, CASE WHEN event_type = 'view' THEN '' ELSE {_LOCATIONS}[(user_id * 5) % 18 + 1] END AS location FROM passes) r
    JOIN station_dim s ON s.station_id = r.station_id LEFT JOIN station_dim d ON d.location = r.location WHERE r.location <> s.location""")
_add("worksheet_events", """SELECT source_sheet_ || ':' || station_title || ':' || source_row AS event_id, dmc_raw, station_id, station_title, read_date AS test_date, state, source_file, source_sheet_ AS source_sheet, source_row, ttnr,
        aoi_failure_code, block_code, concat_ws(';', aoi_failure_code, block_code) AS failure_codes, 2 + (aoi_failure_code IS NOT NULL)::INT + (block_code IS NOT NULL)::INT AS parameter_count
    FROM (SELECT * EXCLUDE (source_sheet_1), source_sheet AS source_sheet_ FROM sheet_events)""".replace("* EXCLUDE (source_sheet_1), source_sheet AS source_sheet_", "source_file, source_sheet AS source_sheet_, source_row, station_title, dmc_raw, resolved_station AS station_id, read_date, state, ttnr, aoi_failure_code, block_code"))
_add("worksheet_parameters", """SELECT source_file, 'S' || (user_id % 3) || ':' || station_title || ':' || source_row AS event_id, u.n AS parameter_name, u.v AS raw_value, try_cast(u.v AS DOUBLE) AS numeric_value, u.t AS tolerance_raw,
        CASE WHEN try_cast(u.v AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'categorical' END AS parameter_type
    FROM (SELECT *, unnest([{'n': 'Result.Value', 'v': CAST(value AS VARCHAR), 't': '5 ... 60'}, {'n': 'Result.AOIFailureCode', 'v': aoi_failure_code, 't': NULL},
        {'n': 'Block Code', 'v': block_code, 't': NULL}, {'n': 'Result.Kind', 'v': event_type, 't': NULL}]) AS u FROM sheet_events) WHERE u.v IS NOT NULL""")
_add("worksheet_unresolved", "SELECT loc[1] AS line, loc[2] AS st, wp, count(*) AS passes FROM sheet_events WHERE value > 200 GROUP BY ALL")
_add("measurement_records", """SELECT 'M' || strftime(o_orderdate, '%Y%m') AS file, o_orderkey + 2 AS source_row, 'C' || o_custkey AS dmc_raw, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'NOK' ELSE '' END AS state,
    o_orderpriority AS variant, strftime(o_orderdate, '%Y-%m') AS batch, 'T1' AS ttnr, 'L' || (o_custkey % 7) AS line, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS test_date,
    date_trunc('minute', o_orderdate) AS result_timestamp, date_trunc('minute', o_orderdate) AS timestamp, 'wp' AS profile FROM orders""")
_add("measurement_parameter_specs", """
    SELECT file, 'Result.Total' AS parameter, CASE WHEN good > 0 THEN 1000.0::DOUBLE END AS lower, CASE WHEN good > 0 THEN 300000.0::DOUBLE END AS upper, bad AS unreadable_count,
        CASE WHEN good = 0 THEN 'no_valid_tolerance' WHEN bad > 0 THEN 'partially_invalid' ELSE 'valid' END AS parse_status
    FROM (SELECT 'M' || strftime(o_orderdate, '%Y%m') AS file, count(*) FILTER (o_custkey % 5 = 0) AS bad, count(*) FILTER (o_custkey % 5 <> 0) AS good FROM orders GROUP BY 1)
    UNION ALL SELECT DISTINCT 'M' || strftime(o_orderdate, '%Y%m'), 'Result.Key', 0.0::DOUBLE, 10000.0::DOUBLE, 0, 'valid' FROM orders""")

# ------------------------------------------------------------------- passes and truth

_add("production_order", "SELECT event_id, station_id, test_date, production_order FROM ordered")
_add("scope_and_task_order", """SELECT o_orderkey AS global_order, o_orderstatus AS analysis_scope, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS task_order,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS scope_order FROM orders""")
_add("union_parts_renumbered", """SELECT *, row_number() OVER (ORDER BY part, dmc_raw) AS global_order FROM (SELECT s_name AS dmc_raw, 'supplier' AS part, s_nationkey AS nation, NULL AS segment FROM supplier
    UNION ALL SELECT c_name, 'customer', NULL, c_mktsegment FROM customer)""")
_add("clean_pass_history", """SELECT event_id, dmc_raw, station_id, test_date, parameter_count FROM (
        SELECT *, max(parameter_count) OVER (PARTITION BY dmc_raw, station_id) AS most FROM (
            SELECT p.event_id, dmc_raw, station_id, source_sheet, date_trunc('day', test_date) AS test_date, seq, CASE WHEN value >= 5 THEN 3 ELSE 0 END AS parameter_count FROM passes p))
    WHERE NOT (suffix(station_id, '_aoi') AND most > 0 AND parameter_count = 0)
    QUALIFY row_number() OVER (PARTITION BY dmc_raw, station_id, test_date ORDER BY parameter_count DESC, source_sheet DESC, seq DESC) = 1""")
_add("first_product_fields", """SELECT dmc_raw, arg_min(ttnr, test_date) FILTER (ttnr IS NOT NULL) AS ttnr, arg_min(variant, test_date) AS variant, arg_min(batch, test_date) AS batch FROM passes GROUP BY 1""")
_add("latest_process_values", """SELECT dmc_raw, feature, value FROM (SELECT dmc_raw, station_id || '.' || parameter_name AS feature, numeric_value AS value, test_date, source_row FROM pass_parameters
    WHERE regexp_matches(station_id, '_wp[1-5]$') AND numeric_value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY dmc_raw, feature ORDER BY test_date DESC, source_row DESC) = 1""")
_PIVOT = [(f"{station}_result_{name}".lower(), f"{station}.Result.{name}") for station in [f"{line}_wp{place}" for line in ("35", "57") for place in range(1, 6)] for name in ("Value", "K")]
_add("process_value_pivot", "SELECT dmc_raw, " + ", ".join(f"""max(value) FILTER (feature = '{feature}') AS "{name}" """ for name, feature in _PIVOT) + f" FROM ({ORACLES['latest_process_values']}) GROUP BY 1")
_add("truth_match", """
    SELECT q.station_id, q.dmc_raw, q.capture_date, q.has_primary_pair, e.event_id AS aoi_event_id, e.test_date AS aoi_test_date, e.state AS aoi_state,
        CASE WHEN coalesce(dn, an) = 1 THEN e.production_order END AS production_order, CASE WHEN an IS NULL THEN 'unmatched' ELSE 'matched' END AS truth_match,
        CASE WHEN an IS NULL THEN 'unmatched' WHEN coalesce(dn, an) = 1 THEN 'matched' ELSE 'ambiguous_event' END AS event_match_status,
        CASE WHEN an IS NULL OR coalesce(dn, an) <> 1 THEN 'ambiguous_event' WHEN has_primary_pair THEN 'evaluable' ELSE 'unavailable' END AS evidence_status
    FROM (SELECT DISTINCT station_id, dmc_raw, CAST(test_date AS DATE) + (value > 60)::INT AS capture_date, event_type <> 'signup' AS has_primary_pair FROM passes WHERE station_type = 'aoi') q
    LEFT JOIN (SELECT station_id, dmc_raw, CAST(test_date AS DATE) AS day, count(*) AS dn, arg_max(event_id, test_date) AS de FROM ordered WHERE station_type = 'aoi' GROUP BY ALL) d
        ON d.station_id = q.station_id AND d.dmc_raw = q.dmc_raw AND d.day = q.capture_date
    LEFT JOIN (SELECT station_id, dmc_raw, count(*) AS an, arg_max(event_id, test_date) AS ae FROM ordered WHERE station_type = 'aoi' GROUP BY ALL) a ON a.station_id = q.station_id AND a.dmc_raw = q.dmc_raw
    LEFT JOIN ordered e ON e.event_id = coalesce(de, ae)""")
_add("followup_match", "SELECT global_order, station_id, dmc_raw, vi_event_id, vi_test_date, vi_state, vi_defect_code FROM followed")
_add("normalized_codes", "SELECT analysis_scope, station_id, event_id, dmc_raw, production_order, source_type, raw_code, canonical_code, defect_name, state, code_status FROM codes")
_add("code_product_links", "SELECT analysis_scope, source_type, event_id, dmc_raw, canonical_code, code_status, global_order FROM links")
_add("unsequenced_detections", "SELECT detected_id, global_order, station_id, detection_type FROM detections WHERE global_order NOT IN (SELECT global_order FROM products WHERE evidence_status = 'evaluable')")
_add("product_timelines", "SELECT dmc_raw, row_number() OVER (PARTITION BY dmc_raw ORDER BY test_date, source_sheet, seq, event_id) AS visit, test_date, station_id, state FROM passes")
_add("recent_product_parameters", """SELECT dmc_raw, event_id, parameter_name, numeric_value, row_number() OVER (PARTITION BY dmc_raw ORDER BY test_date DESC, source_row DESC, parameter_name DESC, event_id DESC) AS recency
    FROM pass_parameters WHERE numeric_value IS NOT NULL QUALIFY recency <= 20""")

# -------------------------------------------------------------------------- sequences

_add("longest_code_runs", "SELECT * FROM code_run")
CTES["kind_obs"] = "SELECT DISTINCT station_id, event_type, production_order AS o FROM ordered"
CTES |= _runs("kind_run", "kind_obs", ["station_id", "event_type"])
_add("burst_runs", "SELECT * FROM kind_run_all WHERE run_length >= 4")
_FITTED = "p AS period, f AS phase_start, precision, coverage, confidence, m AS matched_count, n AS occurrence_count"
_add("period_of_carrier_places", f"SELECT place, {_FITTED} FROM pf_best")
_add("period_of_carrier_places_wide", f"SELECT place, {_FITTED} FROM wf_best")
_add("period_of_carrier_places_tolerant", f"SELECT place, {_FITTED} FROM tf_best")
_add("missing_carrier_slots", "SELECT * FROM place_missing")
_add("carrier_slot_schedule", "SELECT b.place, b.p AS period, b.f AS phase_start, e.o AS slot_order, e.o - 3 AS warn_at_order FROM pf_best b JOIN place_elig e ON e.o >= b.f AND (e.o - b.f) % b.p = 0")
_add("carrier_evidence_strip", """SELECT place, position, CASE WHEN n > 3 THEN 'unavailable' WHEN missing THEN 'missing' ELSE 'observed' END AS status
    FROM (SELECT place, o AS position, false AS missing FROM place_obs UNION ALL SELECT place, missing_order, true FROM place_missing)
    JOIN (SELECT position, count(*) AS n FROM slots GROUP BY 1) USING (position)""")
_NUMBER = "'CP' || lpad(CAST(row_number() OVER (ORDER BY analysis_scope, station_id, source_type, canonical_code) AS VARCHAR), 4, '0') AS pattern_id"
_add("code_patterns", f"SELECT {_NUMBER}, * FROM code_pattern_rows")
_add("code_patterns_merged", f"SELECT {_NUMBER}, * FROM merged_pattern_rows")
_add("code_pattern_links", f"""SELECT DISTINCT {', '.join('r.' + k for k in _CODE)}, 'observed' AS role, l.global_order FROM code_pattern_rows r JOIN code_obs s USING ({', '.join(_CODE)})
    JOIN links l ON l.analysis_scope = r.analysis_scope AND l.station_id = r.station_id AND l.source_type = r.source_type AND l.canonical_code = r.canonical_code AND l.production_order = s.o
    UNION SELECT DISTINCT m.analysis_scope, m.station_id, m.source_type, m.canonical_code, 'missing', l.global_order FROM code_missing m
    JOIN links l ON l.analysis_scope = m.analysis_scope AND l.station_id = m.station_id AND l.source_type = m.source_type AND l.production_order = m.o""")
_add("code_order_lists", f"SELECT {', '.join(_CODE)}, o // 65536 AS part, count(*) AS order_count, string_agg(CAST(o AS VARCHAR), ';' ORDER BY o) AS orders FROM code_obs GROUP BY ALL")
_add("neighbour_defects", "SELECT global_order, lag(global_order) OVER (ORDER BY global_order) AS previous_order, lead(global_order) OVER (ORDER BY global_order) AS next_order FROM (SELECT DISTINCT global_order FROM returned)")
_add("nearest_existing_orders", """SELECT a AS asked_order, CASE WHEN hi IS NULL OR a - lo <= hi - a THEN lo ELSE hi END AS global_order FROM (
    SELECT a, lo, (SELECT min(global_order) FROM returned WHERE global_order >= a) AS hi FROM (
        SELECT a, (SELECT max(global_order) FROM returned WHERE global_order <= a) AS lo FROM (SELECT DISTINCT l_partkey * 3 + l_linenumber AS a FROM lineitem)))""")
_add("average_ranks", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS average_rank FROM lineitem""")

# ------------------------------------------------------------------ measurement quality

_STATS = """
    SELECT parameter, count(value) AS valid_count, round(1 - count(value) / count(*), 6) AS missing_rate, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean,
        any_value(ul) AS usual_lower, any_value(uu) AS usual_upper, count(*) FILTER (evaluated) AS evaluable_count, count(*) FILTER (violated) AS violation_count,
        round(count(*) FILTER (violated) / nullif(count(*) FILTER (evaluated), 0), 6) AS violation_rate,
        CASE WHEN count(lower) = 0 THEN 'no_valid_tolerance' WHEN count(*) FILTER (lower IS NULL AND coalesce(tolerance_raw, '') <> '') > 0 THEN 'partially_invalid' ELSE 'valid' END AS tolerance_status
    FROM judged LEFT JOIN (SELECT parameter, lower AS ul, upper AS uu FROM (SELECT parameter, lower, upper, count(*) AS n, min(source_row) AS f FROM judged WHERE evaluated GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY parameter ORDER BY n DESC, f, lower DESC, upper DESC) = 1) USING (parameter) GROUP BY parameter"""
_add("parameter_statistics", _STATS)
_add("tolerance_violations", "SELECT source_row, parameter, value, lower, upper, tolerance_raw FROM judged WHERE violated")
_add("record_verdicts", "SELECT source_row, state_result, tolerance_result, judgement_conflict, evaluated_parameter_count, tolerance_violation_count FROM verdicts")
_RATE = """count(*) FILTER (state_result = 'NOK') AS state_nok_count, count(*) FILTER (state_result = 'NOK') / nullif(count(*) FILTER (state_result <> 'UNKNOWN'), 0) AS state_nok_rate,
    count(*) FILTER (tolerance_result = 'NOK') AS tolerance_nok_count, count(*) FILTER (tolerance_result = 'NOK') / nullif(count(*) FILTER (tolerance_result <> 'UNKNOWN'), 0) AS tolerance_nok_rate"""
_add("group_quality", " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, {dim} AS value, count(*) AS record_count, {_RATE}, count(*) FILTER (judgement_conflict) AS conflict_count FROM verdicts GROUP BY ALL" for dim in ("variant", "batch", "line")))
_SHARE = "count(*) AS records, count(*) FILTER (state_result = 'NOK') / count(*) AS state_nok_rate, count(*) FILTER (tolerance_result = 'NOK') / count(*) AS tolerance_nok_rate"
_add("quality_trend", f"SELECT CAST(timestamp AS DATE) AS day, {_SHARE} FROM verdicts GROUP BY 1")
_add("quality_trend_windows", f"SELECT time_bucket(INTERVAL 7 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, {_SHARE} FROM verdicts GROUP BY 1")
_add("quality_trend_sliding", f"""SELECT window_start, {_SHARE} FROM (SELECT *, unnest([w, w - INTERVAL 7 DAY]) AS window_start
    FROM (SELECT *, time_bucket(INTERVAL 7 DAY, timestamp, TIMESTAMP '1970-01-01') AS w FROM verdicts WHERE timestamp IS NOT NULL)) GROUP BY 1""")
_add("quality_sessions", f"""SELECT variant, line, min(timestamp) AS session_start, max(timestamp) + INTERVAL 10 DAY AS session_end, {_SHARE} FROM (
    SELECT *, sum(opens) OVER (PARTITION BY variant, line ORDER BY timestamp, source_row) AS session FROM (
        SELECT *, CASE WHEN timestamp <= lag(timestamp) OVER (PARTITION BY variant, line ORDER BY timestamp, source_row) + INTERVAL 10 DAY THEN 0 ELSE 1 END AS opens
        FROM verdicts WHERE timestamp IS NOT NULL)) GROUP BY variant, line, session""")
_add("quality_summary", f"SELECT count(*) AS record_count, count(*) FILTER (state_result = 'OK') AS state_ok_count, {_RATE}, CAST(sum(tolerance_violation_count) AS BIGINT) AS violation_event_count, count(*) FILTER (judgement_conflict) AS judgement_conflict_count, min(timestamp) AS date_start, max(timestamp) AS date_end FROM verdicts")
_add("categorical_statistics", " UNION ALL ".join(
    f"SELECT '{field}' AS field, {field} AS value, count(*) AS value_count, count(*) / sum(count(*)) OVER () AS share FROM passes WHERE coalesce({field}, '') <> '' GROUP BY ALL" for field in ("aoi_failure_code", "block_code", "source_sheet", "ttnr")))
_add("top_violated_parameters", """SELECT concat_ws('@', parameter, tolerance_raw) AS parameter, count(*) FILTER (violated) AS violation_count, count(*) FILTER (evaluated) AS evaluable_count FROM judged
    GROUP BY 1 ORDER BY violation_count DESC, concat_ws('@', parameter, tolerance_raw) LIMIT 15""")
_add("validate_products", """
    SELECT u.* FROM (SELECT unnest([{'level': 'error', 'item': 'duplicate_order', 'result': CAST(n - d AS VARCHAR)}, {'level': 'error', 'item': 'order_not_increasing', 'result': CAST(bad AS VARCHAR)},
        {'level': 'warning', 'item': 'empty_cells', 'result': CAST(nulls AS VARCHAR)}, {'level': 'info', 'item': 'order_range', 'result': lo || '~' || hi}, {'level': 'info', 'item': 'product_count', 'result': CAST(n AS VARCHAR)},
        {'level': 'info', 'item': 'column_count', 'result': '4'}, {'level': 'info', 'item': 'null_cells', 'result': CAST(nulls AS VARCHAR)}, {'level': 'info', 'item': 'cameras', 'result': cams}]) AS u
    FROM (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS d, count(*) FILTER (l_linenumber >= 6) AS nulls, min(l_orderkey) AS lo, max(l_orderkey) AS hi,
            string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS cams, count(*) FILTER (a <> b) AS bad
          FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax) AS a,
              row_number() OVER (ORDER BY l_orderkey, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax) AS b FROM lineitem)))""")
_add("validate_parameters", """SELECT u.* FROM (SELECT unnest([{'level': 'warning', 'item': 'duplicate_key', 'result': CAST(n - d AS VARCHAR)}, {'level': 'info', 'item': 'record_count', 'result': CAST(n AS VARCHAR)},
    {'level': 'info', 'item': 'numeric_parameters', 'result': '4'}, {'level': 'info', 'item': 'join_keys', 'result': 'global_order'}, {'level': 'info', 'item': 'null_cells', 'result': '0'}]) AS u
    FROM (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS d FROM lineitem))""")
_add("validate_defects", """SELECT u.* FROM (SELECT unnest([{'level': 'error', 'item': 'missing_columns', 'result': 'center_y, component_area'}, {'level': 'info', 'item': 'defect_count', 'result': CAST(n AS VARCHAR)},
    {'level': 'info', 'item': 'product_count', 'result': CAST(n AS VARCHAR)}]) AS u FROM (SELECT count(*) AS n FROM detections))""".replace("center_y, component_area", "center_y"))
CTES["bare_unpaired"] = """SELECT 'warning' AS level, r.station_id, r.dmc_raw, '' AS file, 'missing primary pair ' || s.family_code || 'A+' || s.family_code || 'E; record kept, image step skipped' AS issue
    FROM image_rows r JOIN station_dim s USING (station_id) WHERE ("view_A_path" IS NULL OR "view_E_path" IS NULL) AND capture_date IS NOT NULL"""
_add("quality_report", f"""SELECT level, item, count(*) AS entries, min(result) AS first_result FROM ({ORACLES['validate_parameters']}
    UNION ALL SELECT level, 'product ' || dmc_raw, CASE WHEN file = '' THEN issue ELSE issue || '; ' || file END FROM (SELECT * FROM issue_rows UNION ALL SELECT * FROM bare_unpaired)) GROUP BY ALL""")

# ---------------------------------------------------------------- relations, evidence


def _cooccurrence(cats: str, totals: str) -> str:
    return f"""SELECT p.analysis_scope, a AS left_category, b AS right_category, p.n AS product_count, p.n / l.n AS p_right_given_left, p.n / r.n AS p_left_given_right, (p.n / t.n) / ((l.n / t.n) * (r.n / t.n)) AS lift
        FROM (SELECT x.analysis_scope, x.category AS a, y.category AS b, count(*) AS n FROM {cats} x JOIN {cats} y ON x.analysis_scope = y.analysis_scope AND x.global_order = y.global_order AND x.category < y.category GROUP BY ALL) p
        JOIN (SELECT analysis_scope, category, count(*) AS n FROM {cats} GROUP BY ALL) l ON l.analysis_scope = p.analysis_scope AND l.category = a
        JOIN (SELECT analysis_scope, category, count(*) AS n FROM {cats} GROUP BY ALL) r ON r.analysis_scope = p.analysis_scope AND r.category = b
        JOIN ({totals}) t ON t.analysis_scope = p.analysis_scope"""


def _transitions(cats: str) -> str:
    return f"""SELECT m.analysis_scope, m.a AS from_category, m.b AS to_category, m.n AS transition_count, m.n / f.n AS probability, m.g / m.n AS mean_gap
        FROM (SELECT x.analysis_scope, x.category AS a, y.category AS b, count(*) AS n, CAST(sum(o.nxt - o.global_order) AS BIGINT) AS g
              FROM (SELECT *, lead(global_order) OVER (PARTITION BY analysis_scope ORDER BY global_order) AS nxt FROM (SELECT DISTINCT analysis_scope, global_order FROM {cats})) o
              JOIN {cats} x ON x.analysis_scope = o.analysis_scope AND x.global_order = o.global_order JOIN {cats} y ON y.analysis_scope = o.analysis_scope AND y.global_order = o.nxt GROUP BY ALL) m
        JOIN (SELECT x.analysis_scope, x.category, count(*) AS n FROM {cats} x WHERE EXISTS (SELECT 1 FROM {cats} z WHERE z.analysis_scope = x.analysis_scope AND z.global_order > x.global_order) GROUP BY ALL) f
            ON f.analysis_scope = m.analysis_scope AND f.category = m.a"""


_add("defect_cooccurrence", _cooccurrence("cats", "SELECT o_orderstatus AS analysis_scope, count(*) AS n FROM orders GROUP BY 1"))
_add("defect_transitions", _transitions("cats"))
_add("code_spatial_associations", "SELECT * FROM pairs")
_add("code_spatial_support", "SELECT DISTINCT analysis_scope, source_type, canonical_code, spatial_type, spatial_id, global_order FROM defect_links JOIN members USING (analysis_scope, global_order)")
_add("label_conflicts", "SELECT *, CASE WHEN comparison_status = 'label_conflict' THEN 'parallel evidence, raw codes unchanged' ELSE '' END AS review_note FROM conflicts")
_add("upstream_checks", "SELECT * FROM upstream")
_add("station_attribution", f"""
    SELECT pattern_id AS evidence_id, analysis_scope, station_id, 'code' AS evidence_source, pattern_type, 'suspected_station' AS association_level, 'equipment cause unconfirmed' AS equipment_conclusion
        FROM (SELECT {_NUMBER}, * FROM code_pattern_rows)
    UNION ALL SELECT t.trajectory_id, analysis_scope, station_id, 'spatial_trajectory', 'linear_drift', CASE WHEN comparable >= 5 AND upstream_clean / comparable >= 0.8 THEN 'strong_station_link' ELSE 'suspected_station' END, 'equipment cause unconfirmed'
        FROM (SELECT DISTINCT trajectory_id, analysis_scope, station_id FROM tracks) t LEFT JOIN upstream u USING (trajectory_id)
    UNION ALL SELECT source_type || ':' || canonical_code || ':' || spatial_id, analysis_scope, station_id, 'code_spatial', spatial_type, 'suspected_station', 'equipment cause unconfirmed'
        FROM pairs WHERE association_strength IN ('strong', 'medium')""")

# ---------------------------------------------------------------- process parameters

_add("exact_process_join", """SELECT global_order, quantity, price_cents, discount_pct, line_number, ship_time, CASE WHEN quantity IS NOT NULL THEN 'exact' ELSE 'unmatched' END AS match_quality,
    detected_defect_count, (detected_defect_count > 0)::INT AS has_detected_defect FROM wide""")
_add("nearest_time_join", """
    SELECT l.event_id, l.t AS timestamp, r.t AS read_at, r.reading_id, r.reading, CASE WHEN r.reading_id IS NOT NULL THEN 'time_nearest' ELSE 'unmatched' END AS match_quality
    FROM (SELECT event_id, date_trunc('minute', ts) AS t FROM events WHERE event_type = 'error') l
    LEFT JOIN (SELECT event_id AS reading_id, value AS reading, date_trunc('minute', ts) AS t FROM events WHERE event_type = 'view') r ON r.t BETWEEN l.t - INTERVAL 300 SECOND AND l.t + INTERVAL 300 SECOND
    QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch(r.t) - epoch(l.t)), (r.t > l.t)::INT, CASE WHEN r.t <= l.t THEN -r.reading_id ELSE r.reading_id END) = 1""")
_add("process_targets", """
    SELECT DISTINCT analysis_scope, 'DETECTED' AS target, global_order FROM detections WHERE detection_type <> 'region_anomaly'
    UNION ALL SELECT analysis_scope, target, global_order FROM (SELECT *, count(*) OVER (PARTITION BY analysis_scope, target) AS n FROM (
        SELECT p.analysis_scope, c.target, p.global_order FROM products p JOIN (SELECT DISTINCT analysis_scope, dmc_raw, source_type || '_' || canonical_code AS target FROM defect_links) c
            ON c.analysis_scope = p.analysis_scope AND c.dmc_raw = p.dmc_raw)) WHERE n >= 4
    UNION ALL SELECT analysis_scope, 'AOI_NOK', global_order FROM products WHERE aoi_state = 'NOK'
    UNION ALL SELECT analysis_scope, 'VI_NOK', global_order FROM followed WHERE vi_state = 'NOK'
    UNION ALL SELECT DISTINCT analysis_scope, target, global_order FROM (SELECT *, count(*) OVER (PARTITION BY analysis_scope, target) AS n FROM (
        SELECT analysis_scope, global_order, 'VI_CODE_' || unnest(string_split(replace(vi_defect_code, ' ', ';'), ';')) AS target FROM followed) WHERE target <> 'VI_CODE_') WHERE n >= 5""")
_add("parameter_metrics", """
    SELECT analysis_scope, target, parameter, count(value) AS sample_count, round(1 - count(value) / count(*), 4) AS missing_rate, round(avg(value) FILTER (y = 1), 4) AS defect_mean,
        round(avg(value) FILTER (y = 0), 4) AS normal_mean, round(CASE WHEN count(DISTINCT value) > 1 AND count(DISTINCT y) FILTER (value IS NOT NULL) > 1 THEN corr(r, y) FILTER (value IS NOT NULL) END, 4) AS spearman,
        round(CASE WHEN stddev_samp(value) > 0 THEN (avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0)) / stddev_samp(value) END, 4) AS effect_size, round(min(value), 4) AS minimum, round(max(value), 4) AS maximum
    FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY analysis_scope, target, parameter, value) - 1) / 2 AS r FROM labelled WINDOW w AS (PARTITION BY analysis_scope, target, parameter ORDER BY value NULLS LAST))
    GROUP BY analysis_scope, target, parameter""")
_add("binned_defect_rates", """
    SELECT analysis_scope, target, parameter, bin, round(edges[bin], 6) AS lower, round(edges[bin + 1], 6) AS upper, count(*) AS sample_count, CAST(sum(y) AS BIGINT) AS defect_count, round(sum(y) / count(*), 6) AS defect_rate
    FROM (SELECT l.*, e.edges, greatest(1, len(list_filter(e.edges, lambda x: x < l.value))) AS bin FROM labelled l JOIN (
        SELECT analysis_scope, parameter, list_sort(list_distinct(quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges FROM tall WHERE value IS NOT NULL GROUP BY ALL
        HAVING count(*) >= 5 AND count(DISTINCT value) >= 5) e USING (analysis_scope, parameter) WHERE l.value IS NOT NULL) GROUP BY ALL""")
_add("score_auc", """SELECT l_linestatus, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc
    FROM (SELECT l_linestatus, (l_returnflag = 'R')::INT AS y, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1) / 2 AS r FROM lineitem) GROUP BY 1""")
_add("relationship_summary", """SELECT 'global_order' AS join_key, count(*) AS product_count, count(quantity) AS matched_count, count(quantity) / count(*) AS match_rate, 4 AS parameter_count,
    count(*) FILTER (detected_defect_count > 0) AS defective_product_count FROM wide""")

# ----------------------------------------------------------- positions, replay, views

CTES["lead_rows"] = """SELECT analysis_scope, station_id, production_order AS o, center_x_norm AS x, center_y_norm AS y, row_number() OVER (PARTITION BY analysis_scope, station_id
    ORDER BY production_order, center_y_norm, center_x_norm, detected_id) AS rn FROM detections WHERE detection_type <> 'region_anomaly'"""
CTES["lead_walk"] = """
    SELECT analysis_scope, station_id, rn, 1::BIGINT AS chosen, [{'sx': x, 'sy': y, 'n': 1::BIGINT}] AS cs FROM lead_rows WHERE rn = 1
    UNION ALL
    SELECT analysis_scope, station_id, rn, chosen, CASE WHEN chosen > len(cs) THEN list_append(cs, {'sx': x, 'sy': y, 'n': 1::BIGINT})
            ELSE list_transform(cs, lambda c, i: CASE WHEN i = chosen THEN {'sx': c.sx + x, 'sy': c.sy + y, 'n': c.n + 1} ELSE c END) END AS cs
    FROM (SELECT *, CASE WHEN list_min(ds) <= 0.03 THEN list_position(ds, list_min(ds))::BIGINT ELSE len(cs) + 1 END AS chosen
          FROM (SELECT w.analysis_scope, w.station_id, r.rn, r.x, r.y, w.cs, list_transform(w.cs, lambda c: sqrt((r.x - c.sx / c.n) ** 2 + (r.y - c.sy / c.n) ** 2)) AS ds
                FROM lead_walk w JOIN lead_rows r ON r.analysis_scope = w.analysis_scope AND r.station_id = w.station_id AND r.rn = w.rn + 1))"""
CTES["leaders"] = """SELECT analysis_scope, station_id, station_id || '-C' || lpad(CAST(chosen AS VARCHAR), 3, '0') AS cluster_id, o, x, y
    FROM lead_walk JOIN lead_rows USING (analysis_scope, station_id, rn)"""
_add("leader_clusters", """SELECT analysis_scope, station_id, cluster_id, round(avg(x), 6) AS center_x_norm, round(avg(y), 6) AS center_y_norm, count(*) AS detection_count,
    count(DISTINCT o) AS product_count, min(o) AS first_order, max(o) AS last_order FROM leaders GROUP BY ALL""")

_add("leader_patterns", "SELECT * FROM leader_pattern_rows")
_add("alert_replay", "SELECT * FROM lr_alerts")
_add("carrier_alerts", "SELECT * FROM tr_alerts")
_add("carrier_active_periods", "SELECT * FROM tr_active")
_add("carrier_patterns", _patterns("track_pattern_rows", "track_run", "tr_active"))
_add("spatial_patterns", _patterns("leader_pattern_rows", "leader_run", "lr_active"))
_add("alert_chart", """SELECT alert_type, dense_rank() OVER (ORDER BY alert_type) AS type_row, alert_at_order, severity
    FROM (SELECT analysis_scope, alert_type, alert_at_order, severity FROM lr_alerts UNION ALL SELECT analysis_scope, alert_type, alert_at_order, severity FROM tr_alerts)""")
_add("pattern_alerts", """
    SELECT analysis_scope, station_id, cluster_id, 'burst_detected' AS alert_type, 'critical' AS severity, min(c) AS alert_at_order, NULL::BIGINT AS predicted_order, 1.0::DOUBLE AS confidence, NULL::BIGINT AS period, NULL::BIGINT AS phase
        FROM prefix_run WHERE run_length >= 4 GROUP BY ALL
    UNION ALL SELECT analysis_scope, station_id, cluster_id, 'periodic_pattern_confirmed', 'warning', c, f + ((c - f) // p + 1) * p, round(confidence, 6), p, f
        FROM qf_best QUALIFY row_number() OVER (PARTITION BY analysis_scope, station_id, cluster_id ORDER BY c) = 1
    UNION ALL SELECT analysis_scope, station_id, cluster_id, 'fixed_position_repeat_confirmed', 'notice', min(c), NULL, 0.5, NULL, NULL
        FROM qf_size z JOIN prefix_run USING (analysis_scope, station_id, cluster_id, c) WHERE z.n >= 4 AND run_length < 4
        AND NOT EXISTS (SELECT 1 FROM qf_best b WHERE b.analysis_scope = z.analysis_scope AND b.station_id = z.station_id AND b.cluster_id = z.cluster_id AND b.c = z.c) GROUP BY ALL""")


def _bands(prefix: str, source: str) -> dict[str, str]:
    """CTE <prefix>_starts: first y of every band of ``source`` (analysis_scope, station_id, y)."""
    return {
        f"{prefix}_sums": f"""SELECT analysis_scope, station_id, y, sum(y * n) OVER w - y * n AS sb, CAST(sum(n) OVER w - n AS DOUBLE) AS cb
            FROM (SELECT analysis_scope, station_id, y, count(*) AS n FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY analysis_scope, station_id ORDER BY y)""",
        f"{prefix}_starts": f"""SELECT analysis_scope, station_id, 1::BIGINT AS band, y, 0::DOUBLE AS sb, 0::DOUBLE AS cb FROM {prefix}_sums WHERE cb = 0
            UNION ALL SELECT * FROM (SELECT b.analysis_scope, b.station_id, b.band + 1 AS band, s.y, s.sb, s.cb FROM {prefix}_starts b JOIN {prefix}_sums s
                ON s.analysis_scope = b.analysis_scope AND s.station_id = b.station_id AND s.y > b.y AND s.y - (s.sb - b.sb) / (s.cb - b.cb) > 0.02
                QUALIFY row_number() OVER (PARTITION BY b.analysis_scope, b.station_id ORDER BY s.y) = 1)""",
    }


CTES["flat_spots"] = "SELECT analysis_scope, station_id, center_y_norm AS y FROM detections WHERE detection_type <> 'region_anomaly'"
CTES |= _bands("flat", "flat_spots")
_add("horizontal_bands", """SELECT analysis_scope, station_id, band, count(*) AS detections, round(min(y), 6) AS lowest, round(max(y), 6) AS highest
    FROM (SELECT *, (SELECT count(*) FROM flat_starts b WHERE b.station_id = f.station_id AND b.y <= f.y) AS band FROM flat_spots f) GROUP BY ALL""")
CTES["aligned_spots"] = """
    SELECT detected_id, analysis_scope, station_id, production_order AS o, cluster_id, CASE WHEN ok THEN (a * px + t * py) / (a * a + t * t) / 512 ELSE center_x_norm END AS x,
        CASE WHEN ok THEN (a * py - t * px) / (a * a + t * t) / 384 ELSE center_y_norm END AS y, CASE WHEN ok THEN score ELSE 0 END AS score
    FROM (SELECT d.*, p.value / 10000 AS t, 1 - p.value / 10000 / 8 AS a, center_x_norm * 512 - p.value / 100 AS px, center_y_norm * 384 + 2 AS py, 1 - p.value / 200 AS score,
            p.event_type NOT IN ('purchase', 'error') AS ok FROM detections d JOIN passes p ON p.seq + 1 = d.global_order WHERE d.detection_type <> 'region_anomaly')"""
CTES |= _bands("track", "aligned_spots")
CTES["track_points"] = """SELECT *, (SELECT count(*) FROM track_starts b WHERE b.station_id = f.station_id AND b.y <= f.y) AS band FROM aligned_spots f"""
CTES["track_ranks"] = """SELECT *, lag(x) OVER o1 AS xp, lead(x) OVER o1 AS xn, row_number() OVER o1 AS ro,
        rank() OVER (PARTITION BY analysis_scope, station_id, band ORDER BY x) + (count(*) OVER (PARTITION BY analysis_scope, station_id, band, x) - 1) / 2 AS rx
    FROM track_points WINDOW o1 AS (PARTITION BY analysis_scope, station_id, band ORDER BY o)"""
CTES["track_rows"] = """
    SELECT analysis_scope, station_id, band, count(*) AS occurrence_count, min(o) AS first_production_order, max(o) AS last_production_order, avg(y) AS mean_y, max(x) - min(x) AS xs, max(y) - min(y) AS ys,
        coalesce(CASE WHEN count(DISTINCT x) > 1 THEN CAST(count(*) * sum(ro * CAST(rx * 2 AS BIGINT)) - sum(ro) * sum(CAST(rx * 2 AS BIGINT)) AS DOUBLE)
            / sqrt(CAST(count(*) * sum(ro * ro) - sum(ro) * sum(ro) AS DOUBLE) * CAST(count(*) * sum(CAST(rx * 2 AS BIGINT) * CAST(rx * 2 AS BIGINT)) - sum(CAST(rx * 2 AS BIGINT)) * sum(CAST(rx * 2 AS BIGINT)) AS DOUBLE)) END, 0) AS rho, count(*) FILTER (xp IS NOT NULL AND xn IS NOT NULL AND sign(x - xp) <> sign(xn - x)) AS turns,
        min(score) AS low, string_agg(DISTINCT cluster_id, ';' ORDER BY cluster_id) AS related_cluster_ids
    FROM track_ranks GROUP BY ALL HAVING count(*) >= 4 AND max(x) - min(x) >= 0.05 AND max(y) - min(y) <= 0.04"""
_add("spatial_trajectories", """SELECT station_id || '-T' || lpad(CAST(row_number() OVER (PARTITION BY analysis_scope, station_id ORDER BY band) AS VARCHAR), 3, '0') AS trajectory_id, analysis_scope, station_id, band,
        CASE WHEN abs(rho) >= 0.8 THEN 'linear_drift' WHEN turns >= 2 THEN 'oscillating_translation' ELSE 'horizontal_translation' END AS pattern_type, occurrence_count, first_production_order, last_production_order,
        round(mean_y, 6) AS mean_y_norm, round(xs, 6) AS x_span_norm, round(ys, 6) AS y_span_norm, round(rho, 6) AS spearman_order_x, CASE WHEN rho > 0 THEN 'right' WHEN rho < 0 THEN 'left' ELSE 'mixed' END AS direction,
        CASE WHEN low >= 0.8 THEN 'high' ELSE 'low' END AS registration_quality, round(low, 6) AS minimum_registration_score, related_cluster_ids
    FROM track_rows""")

_add("cell_cluster_summary", """SELECT analysis_scope, station_id, cluster_id, round(avg(center_x_norm), 6) AS center_x_norm, round(avg(center_y_norm), 6) AS center_y_norm, count(*) AS detection_count,
    count(DISTINCT production_order) AS product_count, min(production_order) AS first_order, max(production_order) AS last_order FROM detections WHERE cluster_id IS NOT NULL GROUP BY ALL""")
_add("cell_patterns", "SELECT * FROM cell_pattern_rows")
CTES["summary_rows"] = """SELECT analysis_scope, 'product' AS kind FROM products UNION ALL SELECT analysis_scope, detection_type FROM detections
    UNION ALL SELECT analysis_scope, 'pattern_' || pattern_type FROM code_pattern_rows UNION ALL SELECT analysis_scope, 'alert' FROM cr_alerts"""
_add("run_summary", """SELECT analysis_scope, count(*) FILTER (kind = 'product') AS product_count, count(*) FILTER (kind = 'micro') AS micro_defect_count, count(*) FILTER (kind = 'local') AS local_defect_count,
    count(*) FILTER (kind = 'region_anomaly') AS region_anomaly_count, count(*) FILTER (kind = 'alert') AS alert_count, count(*) FILTER (kind = 'pattern_periodic') AS periodic_pattern_count,
    count(*) FILTER (kind = 'pattern_burst') AS burst_pattern_count, count(*) FILTER (kind IN ('micro', 'local', 'region_anomaly')) AS defect_count, count(*) FILTER (starts_with(kind, 'pattern_')) AS pattern_count
    FROM summary_rows GROUP BY ROLLUP (analysis_scope)""")
_add("filter_choices", """SELECT DISTINCT 'analysis_scope' AS filter, analysis_scope AS value FROM products UNION ALL SELECT DISTINCT 'camera', camera FROM products UNION ALL SELECT DISTINCT 'batch', batch FROM products
    UNION ALL SELECT DISTINCT 'category', cluster_id FROM detections WHERE cluster_id IS NOT NULL""")
CTES["aoi_links"] = "SELECT * FROM defect_links WHERE source_type = 'AOI_FAILURE' AND global_order IN (SELECT global_order FROM products)"
CTES["seen"] = "SELECT DISTINCT global_order FROM aoi_links WHERE canonical_code = '5020'"
CTES["ties"] = "SELECT DISTINCT spatial_id AS cluster_id FROM pairs WHERE canonical_code = '5020' AND source_type = 'AOI_FAILURE'"
CTES["view_patterns"] = "SELECT pattern_type FROM cell_pattern_rows WHERE cluster_id IN (SELECT cluster_id FROM ties)"
CTES["view_alerts"] = "SELECT 1 AS one FROM cr_alerts WHERE cluster_id IN (SELECT cluster_id FROM ties)"
CTES["view_codes"] = "SELECT 1 AS one FROM code_pattern_rows WHERE canonical_code = '5020' AND source_type = 'AOI_FAILURE'"
CTES["aoi_cats"] = "SELECT DISTINCT analysis_scope, global_order, canonical_code AS category FROM aoi_links"
_SCOPED = "SELECT analysis_scope, count(*) AS n FROM products GROUP BY 1"
CTES["view_pairs"] = f"SELECT * FROM ({_cooccurrence('aoi_cats', _SCOPED)}) WHERE left_category = '5020' OR right_category = '5020'"
CTES["view_moves"] = f"SELECT * FROM ({_transitions('aoi_cats')}) WHERE from_category = '5020' OR to_category = '5020'"
CTES["section_sizes"] = """SELECT 'periodic' AS section, (SELECT count(*) FROM view_patterns WHERE pattern_type = 'periodic') AS row_count UNION ALL SELECT 'burst', (SELECT count(*) FROM view_patterns WHERE pattern_type = 'burst')
    UNION ALL SELECT 'code', (SELECT count(*) FROM view_codes) UNION ALL SELECT 'trajectory', 0 UNION ALL SELECT 'cooccurrence', (SELECT count(*) FROM view_pairs)
    UNION ALL SELECT 'transition', (SELECT count(*) FROM view_moves) UNION ALL SELECT 'other', (SELECT count(*) FROM view_patterns WHERE pattern_type NOT IN ('periodic', 'burst'))"""
_add("view_section_sizes", "SELECT * FROM section_sizes")
_add("view_counts", """SELECT (SELECT count(*) FROM products WHERE global_order IN (SELECT global_order FROM seen)) AS analyzed_product_count, count(*) AS extracted_defect_count,
        count(*) FILTER (detection_type = 'micro') AS micro_defect_count, count(*) FILTER (detection_type = 'local') AS local_defect_count, count(*) FILTER (detection_type = 'region_anomaly') AS region_anomaly_count,
        count(DISTINCT cluster_id) AS spatial_cluster_count, (SELECT count(*) FROM conflicts WHERE global_order IN (SELECT global_order FROM seen)) AS code_label_conflict_count,
        (SELECT count(*) FROM view_alerts) AS alert_count, (SELECT CAST(sum(row_count) AS BIGINT) FROM section_sizes) AS discovered_pattern_count
    FROM detections WHERE global_order IN (SELECT global_order FROM seen)""")
CTES["all_cats"] = "SELECT DISTINCT analysis_scope, global_order, canonical_code AS category FROM defect_links"
_add("view_code_cooccurrence", f"SELECT * FROM ({_cooccurrence('all_cats', _SCOPED)}) WHERE left_category = '5020' OR right_category = '5020'")
_add("view_code_transitions", f"SELECT * FROM ({_transitions('all_cats')}) WHERE from_category = '5020' OR to_category = '5020'")
_add("cluster_timeline", """SELECT cluster_id, dense_rank() OVER (ORDER BY cluster_id) AS cluster_row, global_order, round(center_x_norm, 6) AS center_x_norm, round(center_y_norm, 6) AS center_y_norm,
    count(*) OVER (PARTITION BY cluster_id) >= 4 AS repeated FROM detections WHERE cluster_id IS NOT NULL""")
_add("best_periodic_place", "SELECT CAST(place AS VARCHAR) AS cluster_id, p AS period, f AS phase_start, confidence FROM pf_best ORDER BY confidence DESC, CAST(place AS VARCHAR) DESC LIMIT 1")
_add("preview_orders", "SELECT DISTINCT global_order FROM returned ORDER BY 1 LIMIT 8")
_add("defect_counts", """SELECT p.global_order, count(d.detected_id) AS detected_defect_count, (count(d.detected_id) > 0)::INT AS has_detected_defect FROM products p
    LEFT JOIN detections d ON d.global_order = p.global_order AND d.detection_type <> 'region_anomaly' GROUP BY 1""")
_add("common_orders", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O'")
