"""Queries of the data-quality problems that belong to the core (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readings import NameRule, name_rule
from ..operators import anomaly, drift, filling, regrid, trailing
from ..session import table


def _rule(spark: SparkSession, sf: str) -> NameRule:
    return name_rule(table(spark, sf, "smart_attributes"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return filling.filled_cells(table(spark, sf, "train")).select("row_id", "field")


def p1_filled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return filling.fill_cells(table(spark, sf, "train"))


def p1_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    train = table(spark, sf, "train").select("serial_number", "bay", "date", "model", "smart_9", "smart_187")
    rows = filling.with_drive(train)
    pairs = [(("serial",), "bay"), (("serial",), "model"), (("bay",), "serial"), (("bay", "date"), "serial"), (("serial", "date"), "smart_9"), (("serial", "date"), "smart_187")]
    return filling.mine_dependencies(rows, pairs).unionByName(filling.mine_intervals(filling.with_serial(train).select("bay", "date", "serial")))


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    a = filling.train_anomalies(table(spark, sf, "train")).select(F.lit("train").alias("table_name"), "row_key", "field", "value", "status")
    b = anomaly.reading_anomalies(table(spark, sf, "drive_readings"), _rule(spark, sf)).select(F.lit("drive_readings").alias("table_name"), "row_key", "field", "value", "status")
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_flags(spark, sf).select("table_name", "row_key", "field")


def p3_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return trailing.rolling_readings(table(spark, sf, "drive_readings"), _rule(spark, sf))


def p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The rolling totals of two fields, rounded, without the averages (whose last digit is a matter of rounding)."""
    f2 = ["smart_9", "smart_194"]
    r = trailing.rolling_readings(table(spark, sf, "drive_readings"), _rule(spark, sf), f2)
    cols = [F.round(c, 3).alias(c) if c.startswith("total") else F.col(c) for c in r.columns if c != "day" and not c.startswith("avg")]
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *cols)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    thin = p3_rolling(spark, sf).where("complete and n_readings < period_days")
    return thin.select("drive_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "period_days")


def p4_grid(spark: SparkSession, sf: str) -> DataFrame:
    return regrid.regular_grid(table(spark, sf, "drive_readings"), _rule(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    utc = F.to_utc_timestamp("slot_start", F.current_timezone())
    return p4_grid(spark, sf).where("missing").select("drive_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("slot_start"))


def p5_changes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_report(table(spark, sf, "drive_readings"), table(spark, sf, "train"), table(spark, sf, "feed_files"), _rule(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_changes(spark, sf).select("file_name", "field", "change")


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unified(table(spark, sf, "drive_readings"), table(spark, sf, "train"), table(spark, sf, "feed_files"), _rule(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_filled_rows, p1_dependencies, p2_found, p2_flags, p3_found, p3_rolling, p3_totals, p4_found, p4_grid, p5_found, p5_changes, p5_unified)}

_TS = """
  select id, drive_id, case
      when regexp_matches(t, '^[0-9]{9,11}([.][0-9]+)?$') then make_timestamp(cast(cast(t as decimal(20,6)) * 1000000 as bigint))
      when regexp_matches(t, '^[0-9]{8}T[0-9]{6}Z$') then try_strptime(t, '%Y%m%dT%H%M%SZ')
      when regexp_matches(t, '[+-][0-9]{2}:[0-9]{2}$') then
        try_cast(left(replace(t, '/', '-'), length(t) - 6) as timestamp)
          - (case when substr(t, length(t) - 5, 1) = '-' then -1 else 1 end)
            * (cast(substr(t, length(t) - 4, 2) as int) * 60 + cast(right(t, 2) as int)) * interval 1 minute
      else try_cast(rtrim(replace(t, '/', '-'), 'Z') as timestamp) end as ts
  from (select *, trim(reading_ts) as t from drive_readings)
"""

_P5 = """
with names as (select key, coalesce(max(a.field), max(b.field), key) as field from (select distinct key from keys) k
    left join smart_attributes a on a.field = 'smart_' || ltrim(nullif(regexp_extract(trim(k.key), '^(?:smart|attr|attribute|r|id)[ _.-]*0*([0-9]{1,3})(?:[ _.-]*(?:raw|value))?$', 1, 'i'), ''), '0')
    left join smart_attributes b on regexp_replace(lower(b.label), '[^a-z0-9]', '', 'g') = regexp_replace(regexp_replace(lower(k.key), '[^a-z0-9]', '', 'g'), 'raw$', '') group by key),
f as (select target_table, file_name, field, string_agg(distinct k.key, ',' order by k.key) as keys, bit_or(form) as forms from keys k join names n using (key) where target_table <> 'train' or field = 'smart_5' group by 1, 2, 3),
v as (select feed, target_table, file_name, lag(file_name) over (partition by feed, target_table order by file_no) as prev from files where file_name in (select file_name from readable)),
c as (select v.file_name, v.prev, n.field, n.keys, n.forms, o.field as old, o.keys as old_keys, o.forms as old_forms from v join f n using (file_name) left join f o on o.file_name = v.prev and o.field = n.field where v.prev is not null
  union all select v.file_name, v.prev, null, null, null, o.field, o.keys, o.forms from v join f o on o.file_name = v.prev left join f n on n.file_name = v.file_name and n.field = o.field where n.field is null),
w as (select *, case when old is null then 'added' when field is null then 'removed' when keys <> old_keys then 'renamed' end as change from c union all select *, 'retyped' from c where forms > 0 and old_forms > 0 and forms <> old_forms)
"""
_P5_FOUND = "select file_name, coalesce(field, old) as field, change from w where change is not null"
_WORDS = "array_to_string(list_filter([case when {0} & 1 > 0 then 'number' end, case when {0} & 2 > 0 then 'text' end, case when {0} & 4 > 0 then 'object' end], lambda x: x is not null), '+')"
_P5_CHANGES = f"select file_name, prev as prev_file, coalesce(field, old) as field, change, coalesce(old_keys, '') as old_name, coalesce(keys, '') as new_name, {_WORDS.format('coalesce(old_forms, 0)')} as old_form, {_WORDS.format('coalesce(forms, 0)')} as new_form from w where change is not null"
_FIELDS = ("smart_1", "smart_5", "smart_7", "smart_9", "smart_10", "smart_173", "smart_174", "smart_177", "smart_183", "smart_187", "smart_188", "smart_192", "smart_193", "smart_194", "smart_197", "smart_198", "smart_230", "smart_241", "smart_242")
_NUMBER = "case when regexp_full_match(trim({0}), '0[xX][0-9a-fA-F]+') then cast(cast(lower(trim({0})) as bigint) as double) else try_cast(regexp_extract({0}, '^(?:n=)?\\s*([+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?)', 1) as double) end"
_METRICS = f"""
m as (select r.id, n.field, max({_NUMBER.format("case when e.type = 'OBJECT' then coalesce(e.value ->> '$.raw', e.value ->> '$.v', e.value ->> '$.value') else e.value ->> '$' end")}) as x
  from (select id, metrics_json from drive_readings where json_valid(metrics_json) and json_type(metrics_json) = 'OBJECT') r, json_each(r.metrics_json) e join names n on n.key = e.key where e.type not in ('NULL', 'BOOLEAN', 'ARRAY') group by 1, 2)
"""

_P5_KEYS = """
with j as (select file_name, metrics_json from drive_readings where file_name is not null and json_valid(metrics_json) and json_type(metrics_json) = 'OBJECT'),
t as (select file_name, unnest([{'key': 'smart_5_raw', 'v': smart_5_raw}, {'key': 'smart_5', 'v': smart_5}, {'key': 'r_5', 'v': r_5}], recursive := true) from train where file_name is not null),
keys as (select 'drive_readings' as target_table, file_name, e.key, bit_or(case when e.type = 'NULL' then 0 when e.type = 'OBJECT' then 4 when e.type in ('VARCHAR', 'BOOLEAN', 'ARRAY') then 2 else 1 end) as form from j, json_each(j.metrics_json) e group by 1, 2, 3
  union all select 'train', file_name, key, bit_or(case when regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') then 1 when json_valid(v) and v like '{%' then 4 else 2 end) from t where v is not null group by 1, 2, 3),
readable as (select distinct file_name from j union select distinct file_name from train where file_name is not null),
files as (select feed, target_table, file_name, file_no from feed_files),
"""

SQL = {
    "p5_found": _P5_KEYS + _P5.lstrip().removeprefix("with ") + _P5_FOUND,
    "p5_changes": _P5_KEYS + _P5.lstrip().removeprefix("with ") + _P5_CHANGES,
    "p5_unified": _P5_KEYS
    + _P5.lstrip().removeprefix("with ").rstrip() + "," + _METRICS
    + "select 'drive_readings' as table_name, id as row_key, file_name, drive_id as source, " + ", ".join(f"(max(x) filter (field = '{f}')) as {f}" for f in _FIELDS) + " from drive_readings left join m using (id) group by id, file_name, drive_id"
    + " union all select 'train', row_id, file_name, serial_number, " + ", ".join(
        (_NUMBER.format("coalesce(try_cast(x5 as json) ->> '$.raw', try_cast(x5 as json) ->> '$.v', x5)") if f == "smart_5" else f"cast(case when not isnan({f}) then {f} end as double)") + f" as {f}" for f in _FIELDS
    ) + " from (select row_id, file_name, serial_number, trim(coalesce(smart_5_raw, smart_5, r_5)) as x5, " + ", ".join(f for f in _FIELDS if f != "smart_5") + " from train)",
    "p3_totals": _P5_KEYS
    + _P5.lstrip().removeprefix("with ").rstrip() + "," + _METRICS.rstrip() + f""",
r as ({_TS}), d as (select drive_id, ts, {", ".join(f"max(x) filter (field = '{f}') as {f}" for f in ("smart_9", "smart_194"))} from r left join m using (id) where ts is not null and drive_id is not null group by 1, 2),
d2 as (select drive_id, cast(ts as date) as day, count(*) as n, {", ".join(f"count({f}) as c_{f}, sum({f}) as s_{f}, min({f}) as lo_{f}, max({f}) as hi_{f}" for f in ("smart_9", "smart_194"))} from d group by 1, 2),
s as (select drive_id, min(day) as lo, max(day) as hi from d2 group by 1), g as (select drive_id, lo, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from s),
f2 as (select g.drive_id, g.lo, g.day, d2.* exclude (drive_id, day) from g left join d2 on d2.drive_id = g.drive_id and d2.day = g.day)
""" + " union all ".join(
        f"select drive_id, strftime(day, '%Y-%m-%d') as day, cast({p} as bigint) as period_days, cast(coalesce(sum(n) over w, 0) as bigint) as n_readings, day - lo >= {p - 1} as complete, " + ", ".join(f"cast(coalesce(sum(c_{f}) over w, 0) as bigint) as count_{f}, round(coalesce(sum(s_{f}) over w, 0), 3) as total_{f}, min(lo_{f}) over w as min_{f}, max(hi_{f}) over w as max_{f}" for f in ("smart_9", "smart_194"))
        + f" from f2 window w as (partition by drive_id order by day rows between {p - 1} preceding and current row)" for p in (7, 30)
    ),
    "p3_found": f"""
with r as ({_TS}), d as (select distinct drive_id, ts from r where ts is not null and drive_id is not null),
c as (select drive_id, cast(ts as date) as day, count(*) as n from d group by 1, 2),
s as (select drive_id, min(day) as lo, max(day) as hi from c group by 1),
g as (select drive_id, lo, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from s),
f as (select g.drive_id, g.lo, g.day, coalesce(c.n, 0) as n from g left join c on c.drive_id = g.drive_id and c.day = g.day),
w as (select drive_id, lo, day, sum(n) over (partition by drive_id order by day rows between 6 preceding and current row) as n7,
  sum(n) over (partition by drive_id order by day rows between 29 preceding and current row) as n30 from f)
select drive_id, strftime(day, '%Y-%m-%d') as day, cast(7 as bigint) as period_days from w where n7 < 7 and day - lo >= 6
union all select drive_id, strftime(day, '%Y-%m-%d'), cast(30 as bigint) from w where n30 < 30 and day - lo >= 29
""",
    "p4_found": f"""
with r as ({_TS}), k as (select distinct drive_id, cast(floor(epoch(ts) / 21600) as bigint) as slot from r where ts is not null and drive_id is not null),
n as (select drive_id, slot, lead(slot) over (partition by drive_id order by slot) as nxt from k)
select drive_id, strftime(make_timestamp(s * 21600000000), '%Y-%m-%d %H:%M:%S') as slot_start
from (select drive_id, unnest(generate_series(slot + 1, nxt - 1)) as s from n where nxt > slot + 1)
""",
}
