"""DuckDB SQL for every registered query, written independently of the operators.

``BASE`` maps the generated tables; the other fragments are common table expressions that
later ones build on. A query lists the fragments it needs and its final SELECT.
"""

AS_OF = "timestamp '2024-01-30 23:59:00'"
START, END = "timestamp '2024-01-01'", "timestamp '2024-01-31'"
# Local midnight of a January day is 05:00 UTC.
LO, HI = "timestamp '2024-01-01 05:00:00'", "timestamp '2024-01-31 05:00:00'"


def _sensor(k):
    return (
        f"(case {k} % 5 when 0 then 'BF' when 1 then 'CB' when 2 then 'DE' when 3 then 'NB' else 'OC' end"
        f" || '_' || lpad(cast({k} as varchar), 2, '0'))"
    )


def _camera(s):
    return (
        f"('CAM_' || {_sensor(f'({s} % 50)')} ||"
        f" case when {s} >= 50 then '_' || cast({s} // 50 as varchar) else '' end)"
    )


def _age(ts):
    return f"cast(floor((epoch_us({AS_OF}) - epoch_us({ts})) / 60000000.0) as bigint)"


def _age_text(age):
    return (
        f"case when {age} < 60 then '<strong>' || {age} || '</strong> minutes ago'"
        f" when {age} < 1440 then 'about <strong>' || cast(round_even({age} / 60.0, 0) as bigint)"
        " || '</strong> hour(s) ago'"
        f" else 'about <strong>' || cast(round_even({age} / 1440.0, 0) as bigint)"
        " || '</strong> day(s) ago' end"
    )


def _clock(ts):
    wall = f"timezone('America/New_York', timezone('UTC', {ts}))"
    zone = f"case when date_diff('hour', {ts}, {wall}) = -4 then ' EDT' else ' EST' end"
    return (
        f"coalesce(strftime({wall}, '%I:%M %p') || {zone}, 'NA') || ' - ' ||"
        f" coalesce(strftime({wall}, '%b %d, %Y'), 'NA')"
    )


def _newest(table, key, ts):
    return (
        f"(select * from {table} qualify rank() over (partition by {key} order by {ts} desc) = 1)"
    )


BASE = {
    "display": f"""
      select n_name as place, {_sensor('k')} as "sensor_ID", ts as date,
        case when k % 17 = 0 then null else 34.0::double + k * 0.01::double end as lat,
        -77.0::double + k * 0.02::double as lng,
        -1.0::double + (k % 4) * 0.25::double as sensor_elevation, road_elevation,
        case when k % 13 = 12 then null else 1.5::double + (k % 3) * 0.25::double end as alert_threshold,
        swl as sensor_water_level, swl - road_elevation as road_water_level,
        swla as sensor_water_level_adj, swla - road_elevation as road_water_level_adj,
        3.2::double + j * 0.02::double as voltage,
        case when event_type = 'error' then true when event_type = 'signup' and j = 0 then null
          else false end as qa_qc_flag
      from (select *, floor(value * 5) / 100 - 0.95::double as swl, floor(value * 5) / 100 - 1.0::double as swla,
              2.0::double + (k % 3) * 0.25::double as road_elevation
            from (select *, cast(user_id % 50 as int) as k,
                    cast(json_extract_string(props, '$.k') as int) as j
                  from events where event_type <> 'view')) e
      join nation on n_nationkey = k % 25""",
    "raw": f"""
      select n_name as place, {_sensor('k')} as "sensor_ID", ts as date,
        3.2::double + j * 0.02::double as voltage, event_type <> 'click' as processed
      from (select *, cast(user_id % 50 as int) as k,
              cast(json_extract_string(props, '$.k') as int) as j from events) e
      join nation on n_nationkey = k % 25""",
    "surveys": f"""
      select {_sensor('k')} as "sensor_ID", o_orderdate as date_surveyed, 'Site ' || k as sensor_label,
        case when k % 17 = 0 then null else 34.0::double + k * 0.01::double end as lat,
        -77.0::double + k * 0.02::double as lng,
        case when o_orderkey % 7 = 0 then null
          else floor(o_totalprice / 5000) / 100 - 1.5::double end as reference_elevation,
        case when o_orderstatus = 'F' then 'drain_bottom' else 'land' end as reference_elevation_type,
        cast(k % 10 as varchar) as wl_id,
        case k % 3 when 0 then 'noaa' when 1 then 'FIMAN' else 'Hohonu' end as wl_src,
        case when k % 3 = 0 then 'obs, pred' else 'obs' end as wl_types,
        case when k % 4 = 3 then null else 'https://example.com/wl/' || (k % 10) end as wl_url,
        cast((k + 1) % 10 as varchar) as alt_wl_id, 'FIMAN' as alt_wl_src, 'obs' as alt_wl_types,
        case k % 3 when 0 then null when 1 then ''
          else 'https://example.com/alt/' || ((k + 1) % 10) end as alt_wl_url,
        case when o_orderpriority = '1-URGENT' then 'NA' else o_orderpriority end as notes
      from (select *, cast(o_custkey % 50 as int) as k from orders) o""",
    "api": """
      select cast(l_suppkey % 10 as varchar) as id,
        timestamp '2024-01-01' + ((l_orderkey * 7 + l_linenumber) % 43200) * interval 1 minute as date,
        round(l_quantity / 10 - 1.0::double, 2) as value,
        case when l_suppkey % 2 = 0 then 'FIMAN' else 'HOHONU' end as api_name,
        case when l_linestatus = 'O' then 'water_level' else 'air_temperature' end as type
      from lineitem""",
    "cams": f"""
      select {_camera('s_suppkey')} as "camera_ID",
        case when s_suppkey % 11 = 10 then null else {_sensor('(s_suppkey % 50)')} end as "sensor_ID",
        'Camera ' || s_suppkey as camera_label,
        case when s_suppkey % 19 = 18 then 'Hawaii' else n_name end as place,
        34.0::double + (s_suppkey % 50) * 0.01::double as lat,
        -77.0::double + (s_suppkey % 50) * 0.02::double as lng
      from supplier join nation on n_nationkey = s_suppkey % 25""",
    "photos": f"""
      select {_camera('(user_id % 100)')} as "camera_ID", ts as "DateTimeOriginalUTC"
      from events where event_type = 'view'""",
}

# Status by (above alert, above road) while current and while silent. Pairs not
# listed, all with an unknown comparison, have no status.
_TRUTH = """
  ('current', true, true, 'FLOODING'), ('current', true, false, 'WARNING'),
  ('current', false, true, 'FLOODING'), ('current', false, false, 'NOT FLOODING'),
  ('silent', true, true, 'FLOODING'), ('silent', true, false, 'FLOODING'),
  ('silent', false, true, 'UNKNOWN'), ('silent', false, false, 'UNKNOWN'),
  ('silent', false, null, 'UNKNOWN')"""

def _judge(columns, table):
    """Age and status of each row of a table of readings."""
    return f"""
      select {columns} age as time_since_measurement,
        {_age_text('age')} as time_since_measurement_text,
        case when age >= 180 then 'UNKNOWN' else known end as flood_status
      from (select *, sensor_water_level_adj >= alert_threshold as a,
              sensor_water_level_adj >= road_elevation as r, age <= 40 as is_current,
              case when age <= 40 then 'current' else 'silent' end as phase
            from (select *, {_age('date')} as age from {table} n) x) y
      left join (values {_TRUTH}) t(stage, alert, road, known)
        on stage = phase and alert is not distinct from a and road is not distinct from r"""


FRAGMENTS = {
    **BASE,
    "judged": _judge(
        '"sensor_ID", date, is_current, ', _newest("display", '"sensor_ID"', "date")
    ),
    "opened": """
      select d.*, nxt, sensor_water_level_adj >= alert_threshold as a,
        sensor_water_level_adj >= road_elevation as r
      from display d join (select "sensor_ID" as i, date as inst,
          lead(date) over (partition by "sensor_ID" order by date) as nxt
        from (select distinct "sensor_ID", date from display) x) n on i = "sensor_ID" and inst = date""",
    "sensors": f"""
      select * from (select * from display where date > timestamp '2023-11-01')
      qualify rank() over (partition by "sensor_ID" order by date desc) = 1""",
    "located_sensors": "select * from sensors where lat is not null and lng is not null",
    "newest_surveys": f"select * from {_newest('surveys', '\"sensor_ID\"', 'date_surveyed')} n",
    "labels": 'select "sensor_ID", min(sensor_label) as site from newest_surveys group by 1',
    "mapped": """
      select s.*, site || ' (' || s."sensor_ID" || ')' as sensor_label,
        site || '<br> (' || s."sensor_ID" || ')' as lines
      from located_sensors s join labels l on s."sensor_ID" = l."sensor_ID" """,
    "mapped_judged": _judge("y.*,", "mapped"),
    "located_cams": f"""
      select c.*, p."DateTimeOriginalUTC" from cams c
      left join {_newest('photos', '"camera_ID"', '"DateTimeOriginalUTC"')} p
        on c."camera_ID" = p."camera_ID" """,
    "cam_health": f"""
      select "camera_ID", place, age, case when age is not null then {_age_text('age')} end as age_text,
        case when age < 10 then 'Good!' else 'Bad!' end as label
      from (select *, {_age('"DateTimeOriginalUTC"')} as age from located_cams) c""",
    "newest_raw": f"""
      select place, "sensor_ID", voltage, processed, date as raw_data_date
      from {_newest('raw', '"sensor_ID"', 'date')} n""",
    "refs": """
      select distinct "sensor_ID", reference_elevation, reference_elevation_type from newest_surveys""",
    "constants": """
      select "sensor_ID", sensor_elevation, road_elevation from located_sensors
      qualify row_number() over (partition by "sensor_ID"
        order by sensor_elevation nulls first, road_elevation nulls first) = 1""",
    "series": f"""
      select * from display where date >= {LO} and date < {HI} and qa_qc_flag = false""",
    "paired": """
      select s."sensor_ID", s.date, d.datum,
        case d.datum when 'Road' then road_water_level_adj else sensor_water_level_adj end as level,
        case d.datum when 'Road' then c.sensor_elevation - c.road_elevation else c.sensor_elevation end as lim
      from series s cross join (values ('Road'), ('NAVD88')) d(datum)
      left join constants c on s."sensor_ID" = c."sensor_ID" """,
    "blanked": """
      select "sensor_ID", date, datum,
        case when level < lim + (1.0::double / 6) and level > lim - (1.0::double / 6) then null
          else level end as wl
      from paired""",
    "line": """
      select *, case when wl is not null then
          sum(case when wl is not null and (pd is null or epoch_us(date) - epoch_us(pd) > 2160000000
                or pw is null) then 1 else 0 end)
            over (partition by "sensor_ID" order by date, wl nulls first rows unbounded preceding)
        end as segment
      from (select *, lag(date) over w as pd, lag(wl) over w as pw from blanked where datum = 'NAVD88'
            window w as (partition by "sensor_ID" order by date, wl nulls first)) b""",
    "meta": """
      select "sensor_ID", wl_id, wl_src, wl_url, alt_wl_id, alt_wl_src, alt_wl_url,
        wl_url is not null as primary_ok, coalesce(alt_wl_url <> '', false) as alt_ok,
        contains("sensor_ID", 'CB_') as default_on,
        coalesce(list_contains(string_split(wl_types, ', '), 'obs'), false) as has_obs,
        coalesce(list_contains(string_split(wl_types, ', '), 'pred'), false) as has_pred,
        coalesce(list_contains(string_split(alt_wl_types, ', '), 'obs'), false) as alt_has_obs
      from newest_surveys""",
    "stored": f"""
      select id, date, value as level, api_name as entity, 'observation' as notes from api
      where type = 'water_level' and date between {START} and {END}""",
    "tide": f"""
      select id, date, value as level, type = 'water_level' as observed,
        case when type = 'water_level' then 'NOAA Observed' else 'NOAA Predictions' end as entity,
        case when type = 'water_level' then 'observation' else 'prediction' end as notes
      from (select id, value, type, date from api
            union all select id, value, type, date + interval 6 minute from api) a where id <> '9'""",
    "tide_range": f"select * from tide where date >= {START} and date < {END} + interval 1 day",
    "views": """
      select place, coalesce(s.zoom_s, c.zoom_c) as zoom,
        case when s.zoom_s is not null then slng else clng end as lng,
        case when s.zoom_s is not null then slat else clat end as lat
      from (select place, avg(lng) as slng, avg(lat) as slat,
              any_value(case when place in ('Down East, North Carolina', 'Hawaii') then 11 else 16 end) as zoom_s
            from mapped group by place) s
      full join (select place, avg(lng) as clng, avg(lat) as clat,
              any_value(case when place in ('Down East, North Carolina', 'Hawaii') then 11 else 16 end) as zoom_c
            from cams group by place) c using (place)""",
    "health": """
      select s.*, r.raw_data_date, r.processed, c.age as camera_age
      from mapped_judged s left join (select distinct * from newest_raw) r on s.place is not distinct from r.place
        and s."sensor_ID" is not distinct from r."sensor_ID" and s.voltage is not distinct from r.voltage
      left join (select distinct place, "camera_ID", age from cam_health) c on c.place = s.place and regexp_replace(c."camera_ID", 'CAM_', '') = s."sensor_ID" """,
    "facts": """
      select "sensor_ID", date,
        case when a is null or r is null then null when r then 'FLOODING' when a then 'WARNING'
          else 'NOT FLOODING' end as current,
        case when not a then 'UNKNOWN' when a is null or r is null then null else 'FLOODING' end as silent
      from (select *, sensor_water_level_adj >= alert_threshold as a,
              sensor_water_level_adj >= road_elevation as r from display) d""",
    # All readings of the minutes that the watermark has passed.
    "closed": """
      select f.*, wm from facts f, (select max(date) - interval 10 minute as wm from facts) m
      where date_trunc('minute', date) + interval 1 minute <= wm""",
    "instants": """
      select *, lead(date) over (partition by "sensor_ID" order by date) as nxt
      from (select distinct "sensor_ID", date, wm from closed) c""",
    "in_force": """
      select "sensor_ID", date as at_, current as flood_status from closed
      union
      select i."sensor_ID", i.date + interval 41 minute, silent
      from instants i join closed c on c."sensor_ID" = i."sensor_ID" and c.date = i.date
      where (nxt is null or i.date + interval 41 minute < nxt)
        and date_trunc('minute', i.date + interval 41 minute) + interval 1 minute <= i.wm
      union
      select "sensor_ID", date + interval 180 minute, 'UNKNOWN' from instants
      where (nxt is null or date + interval 180 minute < nxt)
        and date_trunc('minute', date + interval 180 minute) + interval 1 minute <= wm""",
    "statuses_begun": """
      select f.* from in_force f
      join (select *, lag(at_) over (partition by "sensor_ID" order by at_) as before_
            from (select distinct "sensor_ID", at_ from in_force) d) b
        on b."sensor_ID" = f."sensor_ID" and b.at_ = f.at_
      where not exists (select 1 from in_force p where p."sensor_ID" = f."sensor_ID"
        and p.at_ = b.before_ and p.flood_status is not distinct from f.flood_status)""",
    "gauge_key": """
      select 'Place ' || s_suppkey || ', North Carolina' as place, 'Gauge @ ' || s_suppkey as location,
        case when s_suppkey % 4 = 3 then 'OCAN' else '' end || (s_suppkey % 10) as site_id,
        cast(s_suppkey as int) as or_site_id,
        case when s_suppkey % 3 = 0 then 'Water Elevation' else 'Battery' end as "Sensor",
        case when s_suppkey % 2 = 0 then 'HG' else cast(s_suppkey as varchar) end as gauge_sensor_id,
        cast(null as int) as or_sensor_id
      from supplier where s_suppkey % 10 <> 9""",
}

# Which fragments a fragment reads.
NEEDS = {
    "facts": ["display"],
    "closed": ["facts"],
    "instants": ["closed"],
    "in_force": ["closed", "instants"],
    "statuses_begun": ["in_force"],
    "judged": ["display"],
    "opened": ["display"],
    "sensors": ["display"],
    "located_sensors": ["sensors"],
    "newest_surveys": ["surveys"],
    "labels": ["newest_surveys"],
    "mapped": ["located_sensors", "labels"],
    "located_cams": ["cams", "photos"],
    "cam_health": ["located_cams"],
    "newest_raw": ["raw"],
    "refs": ["newest_surveys"],
    "constants": ["located_sensors"],
    "series": ["display"],
    "paired": ["series", "constants"],
    "blanked": ["paired"],
    "line": ["blanked"],
    "meta": ["newest_surveys"],
    "stored": ["api"],
    "tide": ["api"],
    "tide_range": ["tide"],
    "views": ["mapped", "cams"],
    "mapped_judged": ["mapped"],
    "health": ["mapped_judged", "newest_raw", "cam_health"],
}


def _sql(needs: list[str], final: str) -> str:
    wanted: list[str] = []

    def add(name):
        for inner in NEEDS.get(name, []):
            add(inner)
        if name not in wanted:
            wanted.append(name)

    for name in needs:
        add(name)
    parts = ", ".join(f"{name} as ({FRAGMENTS[name]})" for name in wanted)
    return (f"with {parts} " if parts else "") + final


# Fixed values.
_SENSOR_POPUP = (
    "'<div><h4 align=\"center\"><strong>' || lines || '</h4></strong>'"
    " || '<h5 align=\"center\">Last level:</h5><h4 align=\"center\">' ||"
    " coalesce(regexp_replace(cast(round(road_water_level_adj, 2) + 0.0 as varchar), '\\.0$', ''), 'NA')"
    f" || '</h4><p align=\"center\">' || {_clock('date')} || '</p>'"
)
# Fixed values.
_COLOR = (
    "case flood_status when 'UNKNOWN' then 'grey' when 'FLOODING' then '#dc3545'"
    " when 'WARNING' then '#ffc107' when 'NOT FLOODING' then '#28a745' end"
)
_BANNER = (
    "case flood_status when 'NOT FLOODING' then 'success' when 'UNKNOWN' then 'gray'"
    " when 'WARNING' then 'warning' when 'FLOODING' then 'danger' end"
)
_TOP3 = """(select "sensor_ID", date, rank() over (partition by "sensor_ID" order by date desc) as rnk
  from display qualify rnk <= 3)"""


def _overlay(kind):
    use = {
        "obs": "has_obs and (primary_ok or default_on)",
        "pred": "has_pred and (primary_ok or default_on)",
        "alt": "alt_has_obs and alt_ok",
    }[kind]
    p = "alt_wl" if kind == "alt" else "wl"
    observed = "not observed" if kind == "pred" else "observed"
    return f"""
      select g."sensor_ID", f.date, f.level - g.road_elevation as road_water_level,
        f.level as sensor_water_level, f.entity, f.notes
      from (select distinct m."sensor_ID", {p}_id as id, upper({p}_src) as src, road_elevation
            from meta m join constants c on m."sensor_ID" = c."sensor_ID" where {use}) g
      join (select 'NOAA' as src, id, date, level, entity, notes from tide_range where {observed}
            union all select 'FIMAN', * from stored union all select 'HOHONU', * from stored) f
        on f.src = g.src and f.id = g.id"""


_OVERLAY_NEEDS = ["meta", "constants", "tide_range", "stored"]


def _chart(admin):
    parts = ['select "sensor_ID", datum, \'Water Level\' as series, epoch_us(date) // 1000 as epoch_ms, wl from blanked']
    for kind in ("obs", "pred", "alt"):
        for datum, level in (("Road", "road_water_level"), ("NAVD88", "sensor_water_level")):
            parts.append(
                f"select \"sensor_ID\", '{datum}', entity, epoch_us(date) // 1000, {level} from ({_overlay(kind)}) o"
            )
    if admin:
        for datum, level in (("Road", "road_water_level"), ("NAVD88", "sensor_water_level")):
            parts.append(
                f"select \"sensor_ID\", '{datum}', 'Water Level (unadjusted)', epoch_us(date) // 1000, {level} from series"
            )
            parts.append(
                f"select \"sensor_ID\", '{datum}', 'Battery (Voltage/10)', epoch_us(date) // 1000, voltage / 10 from series"
            )
    return _sql(["blanked", *_OVERLAY_NEEDS], " union all ".join(parts))


_JOINED = """select "sensor_ID", raw_data_date, processed from mapped s left join (
  select distinct place as p, "sensor_ID" as i, voltage as v, processed, raw_data_date from newest_raw) r on s.place is not distinct from r.p
  and s."sensor_ID" is not distinct from r.i"""

# Guide wording.
_ROADSIDE = (
    "This water level sensor is installed on the side of a road just above ground level. "
    "Measurements from our sensor (the blue line on the data plot) above the dashed red line "
    "indicate flooding on the road."
)
_DRAIN = (
    "This water level sensor is installed in a storm drain. Measurements from our sensor "
    "(the blue line) above the red dotted line indicate flooding on the road."
)

ORACLE = {
    "q_flood_status": _sql(
        ["judged"],
        'select "sensor_ID", time_since_measurement, time_since_measurement_text, flood_status from judged',
    ),
    "q_status_banner": _sql(
        ["judged"],
        f"""select "sensor_ID", {_BANNER} as severity, 'Roadway Flood Status: ' || flood_status ||
          case when flood_status = 'WARNING' then ' ' else ', ' end || time_since_measurement_text as title
        from judged""",
    ),
    "q_missing_interval": _sql(
        ["judged", "located_sensors"],
        f"""select distinct "sensor_ID", date as from_ts, {AS_OF} as to_ts from located_sensors
        where "sensor_ID" in (select "sensor_ID" from judged where not is_current)""",
    ),
    "q_status_timeline": _sql(
        ["opened"],
        """select distinct "sensor_ID", f as from_ts,
          case when nxt is null then t when t is null then nxt else least(t, nxt) end as to_ts, flood_status
        from (
          select "sensor_ID", nxt, date as f, date + interval 41 minute as t,
            case when a is null or r is null then null when r then 'FLOODING' when a then 'WARNING'
              else 'NOT FLOODING' end as flood_status from opened
          union all
          select "sensor_ID", nxt, date + interval 41 minute, date + interval 180 minute,
            case when not a then 'UNKNOWN' when a is null or r is null then null else 'FLOODING' end from opened
          union all
          select "sensor_ID", nxt, date + interval 180 minute, null, 'UNKNOWN' from opened) x
        where nxt is null or f < nxt""",
    ),
    "q_top3": _sql(["display"], f"select * from {_TOP3} t"),
    "q_sample_interval": _sql(
        ["display"],
        f"""select "sensor_ID", min(gap) as min_interval from (
          select "sensor_ID", (epoch_us(lag(date) over (partition by "sensor_ID" order by date desc))
            - epoch_us(date)) / 60000000.0::double as gap from {_TOP3} t) g group by 1""",
    ),
    "q_latest_sensor": _sql(
        ["located_sensors"],
        'select "sensor_ID", date, place, lng, lat, road_water_level_adj as road_water_level from located_sensors',
    ),
    "q_latest_survey": _sql(
        ["newest_surveys"], 'select "sensor_ID", date_surveyed, sensor_label from newest_surveys'
    ),
    "q_sensor_labels": _sql(["labels"], 'select "sensor_ID", site as sensor_label from labels'),
    "q_reference_elevations": _sql(["refs"], "select * from refs"),
    "q_latest_photo": _sql(
        ["photos"], f"select * from {_newest('photos', '\"camera_ID\"', '\"DateTimeOriginalUTC\"')} n"
    ),
    "q_latest_raw": _sql(["newest_raw"], "select * from newest_raw"),
    "q_sensor_map": _sql(
        ["mapped_judged"],
        f"""select "sensor_ID", sensor_label, place, flood_status, {_COLOR} as flood_color,
          {_SENSOR_POPUP} || '<p align="center">Click to view data at this site</p></div>' as popup,
          {_SENSOR_POPUP} || '</div>' as view_popup
        from mapped_judged""",
    ),
    "q_camera_locations": _sql(
        ["located_cams"],
        'select "camera_ID", place, "sensor_ID", lng, lat, "DateTimeOriginalUTC" from located_cams',
    ),
    # The markup of the popup.
    "q_camera_map": _sql(
        ["located_cams", "judged"],
        f"""select "camera_ID", camera_label || ' (' || "camera_ID" || ')' as camera_label, flood_status,
          coalesce({_COLOR}, 'grey') as flood_color,
          '<div><h4 align="center"><strong>' || camera_label || '<br> (' || "camera_ID" || ')</h4></strong>'
            || '<h5 align="center">Last picture:</h5><p align="center">' || {_clock('"DateTimeOriginalUTC"')}
            || '</p><p align="center">Click to view this camera</p></div>' as popup
        from located_cams c left join (select distinct "sensor_ID" as i, flood_status from judged) j
          on c."sensor_ID" = j.i""",
    ),
    "q_camera_caption": _sql(
        ["photos"],
        f"""select "camera_ID", {_clock('"DateTimeOriginalUTC"')} as caption
        from {_newest('photos', '"camera_ID"', '"DateTimeOriginalUTC"')} n""",
    ),
    "q_place_list": _sql(
        ["mapped", "cams"],
        """select place, first_sensor is null as camera_only, coalesce(first_sensor, first_camera) as first_id
        from (select place, min("sensor_ID") as first_sensor from mapped group by 1) s
        full join (select place, min("camera_ID") as first_camera from cams group by 1) c using (place)""",
    ),
    "q_place_view": _sql(
        ["views"], "select place, round(lng, 6) as lng, round(lat, 6) as lat, zoom from views"
    ),
    "q_start_view": _sql(
        ["views"],
        """select case when right(place, 1) <> '0' then place end as place,
          case when right(place, 1) <> '0' then round(lng, 6) else -77.360784::double end as lng,
          case when right(place, 1) <> '0' then round(lat, 6) else 34.576053::double end as lat,
          case when right(place, 1) <> '0' then zoom else 8 end as zoom from views""",
    ),
    "q_place_choices": _sql(
        ["mapped", "cams"],
        """select place, "sensor_ID" as id, sensor_label as label,
          "sensor_ID" = min("sensor_ID") over (partition by place) as is_default, 'sensor' as kind from mapped
        union all
        select place, "camera_ID", camera_label || ' (' || "camera_ID" || ')',
          "camera_ID" = min("camera_ID") over (partition by place), 'camera' from cams""",
    ),
    "q_site_rules": _sql(
        ["mapped"],
        f"""select "sensor_ID", place like '%Carolina Beach%' as valve_tab,
          case when "sensor_ID" like '%DE%' then '{_ROADSIDE}' else '{_DRAIN}' end as guide from mapped""",
    ),
    "q_site_notes": _sql(
        ["newest_surveys"],
        """select "sensor_ID", case when notes <> 'NA' then 'Sensor Installation Date: ' || notes end as note
        from newest_surveys""",
    ),
    "q_deeplink": _sql(
        ["newest_surveys", "views"],
        f"""select link_id, case when sid is not null then s.lng else round(v.lng, 6) end as lng,
          case when sid is not null then s.lat else round(v.lat, 6) end as lat,
          case when sid is null then v.zoom when s."sensor_ID" is not null then 20 end as zoom,
          case when sid is null then loc end as place
        from (select c_custkey as link_id,
            case when c_custkey % 6 in (1, 3) then {_sensor('(c_custkey % 50)')}
              when c_custkey % 6 = 4 then 'ZZ_99' end as sid,
            case when c_custkey % 6 in (2, 3) then 'NATION_' || (c_custkey % 25)
              when c_custkey % 6 = 5 then 'Hawaii' end as loc from customer) l
        left join (select "sensor_ID", round(min(lng), 6) as lng, round(min(lat), 6) as lat
          from newest_surveys group by 1 having count(*) = 1) s on s."sensor_ID" = sid
        left join views v on v.place = loc""",
    ),
    "q_sensor_series": _sql(
        ["series"],
        """select "sensor_ID", date, sensor_water_level_adj, road_water_level_adj, sensor_water_level,
          road_water_level from series""",
    ),
    "q_series_picked": _sql(
        ["series", "cams"],
        """select "sensor_ID", date, sensor_water_level_adj, 'list' as picked from series
        where "sensor_ID" in ('CB_01', 'BF_05', 'NB_13', 'ZZ_99')
        union all select "sensor_ID", date, sensor_water_level_adj, 'table' from series
        where "sensor_ID" in (select "sensor_ID" from cams)""",
    ),
    "q_request_guard": """select o_orderkey as request_id, cast(n - 5 as int) as days,
        10 * 24 * (n - 5) <= 7440 or o_orderstatus = 'P' as allowed, abs(n - 5) <= 30 as overlay_allowed
      from (select *, o_custkey % 51 as n from orders) o""",
    "q_blank_dry": _sql(["blanked"], "select * from blanked"),
    "q_gap_segments": _sql(
        ["line"],
        """select "sensor_ID", cast(segment as bigint) as segment, min(date) as start, max(date) as "end",
          count(*) as n from line where segment is not null group by 1, 2""",
    ),
    "q_line_points": _sql(
        ["line"], 'select "sensor_ID", date, wl, cast(segment as bigint) as segment from line'
    ),
    "q_axis_bounds": _sql(
        ["series", "constants", "refs"],
        """select "sensor_ID", d.datum,
          case when reference_elevation is null then sensor_elevation - zero - 1
            when n is null then null
            when low < reference_elevation - zero then low else reference_elevation - zero - 0.25 end as y_min,
          case when n is not null then case when top > lim then top else lim + 0.25 end end as y_max
        from (
          select c.*, r.reference_elevation, e.n, e.low, v.datum,
            case v.datum when 'Road' then c.road_elevation else 0.0 end as zero,
            case v.datum when 'Road' then 0.0 else c.road_elevation end as lim,
            case v.datum when 'Road' then e.top_road else e.top_navd end as top
          from constants c left join refs r on c."sensor_ID" = r."sensor_ID"
          left join (select "sensor_ID", count(*) as n, max(road_water_level_adj) as top_road,
            max(sensor_water_level_adj) as top_navd, min(sensor_water_level_adj) as low
            from series group by 1) e on c."sensor_ID" = e."sensor_ID"
          cross join (values ('Road'), ('NAVD88')) v(datum)) d""",
    ),
    "q_axis_bounds_overlay": _sql(
        ["series", "constants", "refs"],
        """select "sensor_ID", d.datum,
          null::double as y_min,
          case when n is not null then case when top > lim then top else lim + 0.25 end end as y_max
        from (
          select c.*, r.reference_elevation, e.n, e.low, v.datum,
            case v.datum when 'Road' then c.road_elevation else 0.0 end as zero,
            case v.datum when 'Road' then 0.0 else c.road_elevation end as lim,
            case v.datum when 'Road' then e.top_road else e.top_navd end as top
          from constants c left join refs r on c."sensor_ID" = r."sensor_ID"
          left join (select "sensor_ID", count(*) as n, max(road_water_level_adj) as top_road,
            max(sensor_water_level_adj) as top_navd, min(sensor_water_level_adj) as low
            from series group by 1) e on c."sensor_ID" = e."sensor_ID"
          cross join (values ('Road'), ('NAVD88')) v(datum)) d""",
    ),
    "q_ref_lines": _sql(
        ["constants", "refs"],
        f"""select c."sensor_ID", datum, road_elevation - zero as road, sensor_elevation - zero as sensor,
          reference_elevation - zero as reference,
          case when reference_elevation_type = 'drain_bottom' then 'Bottom of Drain'
            when reference_elevation_type is not null then 'Land Elevation' end as reference_label,
          epoch_us({AS_OF}) // 1000 as now_ms
        from (select *, road_elevation as zero, 'Road' as datum from constants
          union all select *, 0.0::double, 'NAVD88' from constants) c
        left join refs r on c."sensor_ID" = r."sensor_ID" """,
    ),
    "q_no_data": _sql(
        ["constants", "series"],
        """select c."sensor_ID", coalesce(n, 0) as n,
          coalesce(n, 0) = 0 and c."sensor_ID" not like '%CB\\_%' escape '\\' as no_data
        from constants c left join (select "sensor_ID", count(*) as n from series group by 1) s
          on c."sensor_ID" = s."sensor_ID" """,
    ),
    "q_download": _sql(
        ["series"],
        """select "sensor_ID", strftime(date, '%m/%d/%Y %H:%M') as "timestamp (UTC)",
          round(sensor_elevation, 2) as "sensor elev. (ft NAVD88)",
          round(road_elevation, 2) as "road elev. (ft NAVD88)",
          round(sensor_water_level_adj, 2) as "water level (ft NAVD88)",
          round(road_water_level_adj, 2) as "water level (ft above or below road elev.)",
          "sensor_ID" || '_20240101_20240131.csv' as file from series""",
    ),
    "q_download_files": _sql(
        ["series"],
        """select strftime(date, '%m/%d/%Y %H:%M') as "timestamp (UTC)",
          round(sensor_elevation, 2) as "sensor elev. (ft NAVD88)",
          round(road_elevation, 2) as "road elev. (ft NAVD88)",
          round(sensor_water_level_adj, 2) as "water level (ft NAVD88)",
          round(road_water_level_adj, 2) as "water level (ft above or below road elev.)",
          "sensor_ID" || '_20240101_20240131.csv' as file from series""",
    ),
    "q_named_files": _sql(
        ["series"],
        """select "sensor_ID" || '_20240101_20240131.csv' as file,
          cast(row_number() over (partition by "sensor_ID" order by date) as int) as line,
          strftime(date, '%m/%d/%Y %H:%M') as time from series""",
    ),
    "q_thirdparty_reversed": _sql(["stored"], "select * from stored"),
    "q_thirdparty_obs": _sql(["stored"], "select * from stored"),
    "q_thirdparty_union": _sql(
        ["newest_surveys", "tide_range", "stored"],
        """select f.id, f.src, count(*) as n, min(level) as low, max(level) as high
        from (select distinct wl_id as id, upper(wl_src) as src from newest_surveys) g
        join (select 'NOAA' as src, id, level from tide_range where observed
          union all select 'FIMAN', id, level from stored
          union all select 'HOHONU', id, level from stored) f on f.id = g.id and f.src = g.src
        group by 1, 2""",
    ),
    "q_tide_json_obs": _sql(
        ["tide"], "select id, date, level, entity, notes from tide where observed"
    ),
    "q_tide_json_pred": _sql(
        ["tide"], "select id, date, level, entity, notes from tide where not observed"
    ),
    "q_tide_rejects": _sql(
        ["api"],
        """select id, case when type = 'water_level' then 'obs' else 'pred' end as type, count(*) as n
        from api where id = '9' group by 1, 2""",
    ),
    "q_gauge_xml": _sql(
        ["api"],
        """select id, date, value as level, 'FIMAN' as entity, 'observation' as notes
        from (select * from api union all select * replace (date + interval 6 minute as date) from api) a
        where api_name = 'FIMAN' and type = 'water_level'""",
    ),
    "q_gauge_key": _sql(["gauge_key"], "select * from gauge_key"),
    "q_gauge_key_file": _sql(["gauge_key"], "select * from gauge_key"),
    "q_gauge_lookup": _sql(
        ["gauge_key", "newest_surveys"],
        """select "sensor_ID", wl_id, gauge_sensor_id from newest_surveys
        join gauge_key on site_id = wl_id and "Sensor" = 'Water Elevation'""",
    ),
    "q_overlay_meta": _sql(["meta"], "select * from meta"),
    "q_overlay_obs": _sql(_OVERLAY_NEEDS, _overlay("obs")),
    "q_overlay_pred": _sql(_OVERLAY_NEEDS, _overlay("pred")),
    "q_overlay_alt": _sql(_OVERLAY_NEEDS, _overlay("alt")),
    "q_chart_series": _chart(admin=False),
    "q_chart_series_admin": _chart(admin=True),
    "q_provider_levels": _sql(
        ["api"],
        "select id, count(*) as n, max(date) as newest from api where type = 'water_level' group by 1",
    ),
    "q_natural_join": _sql(
        ["mapped", "newest_raw"], _JOINED + " and s.voltage is not distinct from r.v"
    ),
    "q_intended_join": _sql(["mapped", "newest_raw"], _JOINED),
    "q_sensor_health": _sql(
        ["health"],
        """select "sensor_ID", case when flood_status = 'NOT FLOODING' then 'Good!' else 'Bad!' end as label,
          flood_status <> 'NOT FLOODING' and raw_data_date = date and camera_age < 10 as no_data_error,
          flood_status <> 'NOT FLOODING' and raw_data_date = date and camera_age > 10 as gateway_error,
          flood_status <> 'NOT FLOODING' and processed = false as processing_error
        from health""",
    ),
    "q_camera_health": _sql(
        ["cam_health"], 'select "camera_ID", age, age_text, label from cam_health'
    ),
    "q_battery": _sql(
        ["mapped"],
        """select "sensor_ID", voltage, greatest(least(voltage, 5.4::double), 3.2::double) as needle,
          case when voltage >= 3.6::double then 'good' when voltage >= 3.4::double then 'low' when voltage is not null
            then 'critical' end as band,
          case when voltage >= 3.6::double then '#55BF3B' when voltage >= 3.4::double then '#DDDF0D'
            when voltage is not null then '#DF5353' end as color from mapped""",
    ),
    "q_place_panel": _sql(
        ["health", "cam_health"],
        """select *, count(*) filter (kind = 'sensor') over (partition by place) as n_sensors,
          count(*) filter (kind = 'camera') over (partition by place) as n_cameras
        from (select place, 'sensor' as kind, "sensor_ID" as id,
            case when flood_status = 'NOT FLOODING' then 'Good!' else 'Bad!' end as label,
            time_since_measurement_text as age_text, flood_status from health
          union all select place, 'camera', "camera_ID", label, age_text, null from cam_health) p""",
    ),
    "q_stream_latest": _sql(["judged"], 'select distinct "sensor_ID", date from judged'),
    "q_stream_status": _sql(
        ["judged"], 'select "sensor_ID", time_since_measurement, flood_status from judged'
    ),
    "q_stream_changes": _sql(
        ["statuses_begun"], 'select "sensor_ID", at_ as "at", flood_status from statuses_begun'
    ),
    "q_stream_changes_resumed": _sql(
        ["statuses_begun"],
        """select "sensor_ID", at_ as "at", flood_status from statuses_begun
        where at_ >= timestamp '2024-01-16'""",
    ),
    "q_stream_counts": _sql(
        ["display"],
        """select "sensor_ID", count(*) as n, min(date) as first_ts, max(date) as last_ts
        from (select distinct * from display) d group by 1""",
    ),
    "q_tide_files": _sql(
        ["api"],
        """select id, case when type = 'water_level' then 'obs' else 'pred' end as type, date, value as level,
          case when type = 'water_level' then 'NOAA Observed' else 'NOAA Predictions' end as entity,
          case when type = 'water_level' then 'observation' else 'prediction' end as notes
        from api where id not in ('8', '9')""",
    ),
    "q_tide_file_rejects": _sql(
        ["api"],
        """select id, case when type = 'water_level' then 'obs' else 'pred' end as type,
          case id when '8' then 'unreadable' else 'empty' end as reason, count(distinct date_trunc('day', date)) as n
        from api where id in ('8', '9') group by 1, 2, 3""",
    ),
    "q_gauge_files": _sql(
        ["api"],
        """select id, date, value as level, 'FIMAN' as entity, 'observation' as notes
        from api where api_name = 'FIMAN' and type = 'water_level' and id <> '8'""",
    ),
    "q_gauge_file_rejects": _sql(
        ["api"],
        """select id, 'unreadable' as reason, count(distinct date_trunc('day', date)) as n
        from api where api_name = 'FIMAN' and type = 'water_level' and id = '8' group by 1""",
    ),
    "q_redelivered_days": _sql(
        ["display"],
        """select "sensor_ID", date,
          round(voltage + case when date >= timestamp '2024-01-16' then 0.1::double else 0 end, 2) as voltage
        from display where qa_qc_flag = false
          and date >= timestamp '2024-01-14 05:00:00' and date < timestamp '2024-01-20 05:00:00'""",
    ),
}

# What is kept beside day folders gives the results of a search through everything.
ORACLE["q_flood_status_days"] = ORACLE["q_flood_status"]
ORACLE["q_top3_days"] = ORACLE["q_top3"]
ORACLE["q_timeline_days"] = ORACLE["q_status_timeline"]
