"""Queries of placement, array statistics, codec choice and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arraystats as A
from ..operators import catalog as C
from ..operators import compress as Z
from ..operators import features as E
from ..operators import placement as P
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# name, remaining, score, write MB/s, read us, write us, days to live, persistence, read MB/s
_TARGETS = (
    ("ram0", 1 << 30, 1.0, 8000.0, 1.0, 1.0, 999, 0, 9000.0),
    ("nvme0", 8 << 30, 0.8, 2200.0, 20.0, 25.0, 400, 1, 3000.0),
    ("nvme1", 4 << 20, 0.8, 2100.0, 22.0, 24.0, 5, 1, 2900.0),
    ("ssd0", 64 << 30, 0.6, 480.0, 90.0, 110.0, 6, 2, 520.0),
    ("hdd0", 512 << 30, 0.3, 150.0, 8000.0, 9000.0, 0, 2, 180.0),
    ("s3", 1 << 40, 0.1, 80.0, 30000.0, 40000.0, 3000, 2, 100.0),
)


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TARGETS, "name string, remaining_space bigint, target_score double, write_bw double, read_lat double, write_lat double, ttl_days int, persistence int, read_bw double")


_T = "t(name, remaining_space, target_score, write_bw, read_lat, write_lat, ttl_days, persistence, read_bw) as (values " + ", ".join(f"('{a}', {b}::bigint, {c}::double, {d}::double, {e}::double, {f}::double, {g}, {h}, {i}::double)" for a, b, c, d, e, f, g, h, i in _TARGETS) + ")"


def _order_sql(size: int, score: float) -> str:
    speed = "write_bw" if size >= P.BIG else "-(read_lat + write_lat) / 2"
    return f"with {_T}, g as (select *, case when target_score <= {score} then 1 else 2 end as grp, {speed} as s from t where remaining_space >= {size}) select name, cast(row_number() over (order by grp, case when grp = 1 then -s else s end, name) as int) as place from g"


@query(_order_sql(1 << 20, 0.7))
def placement_order_large(spark, sf):
    return P.place(_targets(spark), "max_bw", 1 << 20, 0.7).select("name", "place")


@query(_order_sql(1000, 0.7))
def placement_order_small(spark, sf):
    return P.placement_order(_targets(spark), 1000, 0.7).select("name", "place")


@query(f"with {_T}, g as (select name, case when target_score <= 0.7 then 1 else 2 end as grp from t where remaining_space >= 1000), i as (select *, row_number() over (partition by grp order by name) - 1 as i, count(*) over (partition by grp) as n from g) select name, cast(row_number() over (order by grp, ((i - 2) % n + n) % n) as int) as place from i")
def placement_round_robin(spark, sf):
    return P.place(_targets(spark), "round_robin", 1000, 0.7, 2).select("name", "place")


@query()
def placement_random(spark, sf):
    return P.place(_targets(spark), "random", 1000, 0.7, 42).select("name", "place")


@query(f"with {_T}, o as (select name, remaining_space, row_number() over (order by case when target_score <= 0.7 then 1 else 2 end, case when target_score <= 0.7 then -write_bw else write_bw end, name) as place from t where remaining_space >= 1048576), b as (select *, coalesce(sum(remaining_space) over (order by place rows between unbounded preceding and 1 preceding), 0) as off from o) select name, cast(off as bigint) as block_offset, cast(least(remaining_space, 100000000000 - off) as bigint) as block_bytes from b where off < 100000000000")
def allocate_blocks(spark, sf):
    o = P.placement_order(_targets(spark), 1 << 20, 0.7)
    return P.allocate(o, 100_000_000_000).select("name", F.col("block_offset").cast("bigint").alias("block_offset"), F.col("block_bytes").cast("bigint").alias("block_bytes"))


@query(f"with {_T} select name, (persistence >= 1) and (ttl_days > 7 or (ttl_days >= 1 and persistence < 2)) as ok, (ttl_days < 1) or (ttl_days <= 7 and persistence >= 2) as drain from t")
def target_health(spark, sf):
    return _targets(spark).select("name", P.eligible(F.col("ttl_days"), F.col("persistence"), 1).alias("ok"), P.to_drain(F.col("ttl_days"), F.col("persistence")).alias("drain"))


@query(f"with {_T} select cast(sum(remaining_space) as bigint) as remaining, count(*) as n, round(max(greatest(0, least(1, ln(greatest(read_bw, write_bw) + 1) / ln(1001.0)))), 6) as best, round(min(greatest(0, least(1, ln(greatest(read_bw, write_bw) + 1) / ln(1001.0)))), 6) as worst from t")
def capacity(spark, sf):
    s = P.bandwidth_score(F.col("read_bw"), F.col("write_bw"))
    return _targets(spark).agg(F.sum("remaining_space").alias("remaining"), F.count("*").alias("n"), F.round(F.max(s), 6).alias("best"), F.round(F.min(s), 6).alias("worst"))


_NOW = 1718668800  # 2024-06-18 UTC


@query(f"""with s as (select doc_id, score, cast(greatest(0, least(1, 5e-1 * pow(2, -greatest({_NOW} - epoch_us(last_modified) / 1e6, 0) / 600) + 5e-1 * n / (n + 10.0))) as float) as new from (select doc_id, last_modified, doc_id % 40 as n, (doc_id % 100) / 100.0::double as score from documents where last_modified is not null))
select doc_id, round(cast(new as double), 4) as frecency, new between 0 and 1 and not (abs(new - score) < 5e-2) as moves from s""")
def frecency_moves(spark, sf):
    d = table(spark, sf, "documents").where("last_modified is not null")
    new = P.frecency(F.lit(float(_NOW)) - F.unix_micros("last_modified") / 1e6, F.col("doc_id") % 40)
    return d.select("doc_id", F.round(new.cast("double"), 4).alias("frecency"), P.moves((F.col("doc_id") % 100) / 100.0, new).alias("moves"))


def _blocks(spark, sf):
    """Every blob cut into up to four blocks over targets, in turns."""
    b = C.blobs_of(table(spark, sf, "documents")).where("size > 0")
    i = F.explode(F.sequence(F.lit(0), F.col("doc_id") % 4))
    names = F.array(*[F.lit(t[0]) for t in _TARGETS], F.lit("gone"))
    e = b.select("tag_name", "blob_name", "doc_id", "size", i.alias("i"))
    return e.select("tag_name", "blob_name", names[(F.col("doc_id") + F.col("i") * 3) % 7].alias("target"), (F.col("size") + F.col("i")).alias("bytes"))


_B = "bl as (select tag_name, blob_name, ['ram0', 'nvme0', 'nvme1', 'ssd0', 'hdd0', 's3', 'gone'][1 + (doc_id + i * 3) % 7] as target, size + i as bytes from (select tag_name, blob_name, doc_id, strlen(text) as size, unnest(range(0, doc_id % 4 + 1)) as i from documents where strlen(text) > 0))"


@query(f"with {_T}, {_B} select tag_name, blob_name, cast(sum(bytes) as bigint) as bytes, count(*) filter (persistence < 2) as volatile_blocks from bl left join t on t.name = bl.target group by 1, 2 having count(*) filter (persistence < 2) > 0")
def flush_candidates(spark, sf):
    return P.flush_candidates(_blocks(spark, sf), _targets(spark).withColumnRenamed("name", "target"), 2)


@query(f"with {_T}, {_B} select distinct tag_name, blob_name from bl where target in (select name from t where ttl_days < 1 or (ttl_days <= 7 and persistence >= 2))")
def drain_candidates(spark, sf):
    return P.drain_candidates(_blocks(spark, sf), _targets(spark).withColumnRenamed("name", "target"))


@query(f"with {_T}, {_B} select tag_name, blob_name, cast(sum(bytes) as bigint) as bytes, (select name from t where persistence >= 2 and ttl_days > 7 order by write_bw desc, name limit 1) as target from bl left join t on t.name = bl.target group by 1, 2 having count(*) filter (persistence < 2) > 0")
def flush_moves(spark, sf):
    return P.flush(_blocks(spark, sf), _targets(spark), 2)


@query(f"with {_T}, {_B} select distinct tag_name, blob_name, 99e-2::double as score from bl where target in (select name from t where ttl_days < 1 or (ttl_days <= 7 and persistence >= 2))")
def drain_moves(spark, sf):
    return P.drain(_blocks(spark, sf), _targets(spark).withColumnRenamed("name", "target"))


@query("select tag_name, blob_name, case when doc_id % 4 = 0 and abs(0.3 - s) >= 5e-2 then 0.3::double else s end as score, case when doc_id % 4 = 0 then 0 when doc_id % 4 = 1 then 1 end as rc from (select *, (doc_id % 100) / 100.0::double as s from documents where tag_name is not null and blob_name is not null) union all select 'none', 'such', null, 3")
def reorganize_blobs(spark, sf):
    b = C.blobs_of(table(spark, sf, "documents")).where("tag_name is not null and blob_name is not null")
    own = b.select("tag_name", "blob_name", ((F.col("doc_id") % 100) / 100.0).alias("score"))
    asked = b.where("doc_id % 4 < 2").select("tag_name", "blob_name", F.when(F.col("doc_id") % 4 == 0, 0.3).otherwise(1.3).alias("score"))
    return P.reorganize(own, asked.unionByName(spark.createDataFrame([("none", "such", 0.5)], asked.schema)))


@query(f"with {_T}, {_B}, p as (select tag_name, blob_name, target, sum(bytes) as bytes, coalesce(max(write_bw), 80) as bw, coalesce(max(write_lat), 1200) as lat from bl left join t on t.name = bl.target group by 1, 2, 3) select tag_name, blob_name, round(max(lat * 1e3 + bytes / (bw * 1048576) * 1e9), 3) as ns from p group by 1, 2")
def io_time_estimate(spark, sf):
    t = _targets(spark).withColumnRenamed("name", "target")
    return P.io_time(_blocks(spark, sf), t, "write_bw", "write_lat", 80.0, 1200.0).withColumn("ns", F.round("ns", 3))


@query("with f as (select event_type, user_id, min(event_id) as first_seen from events group by 1, 2), k as (select *, cast(row_number() over (partition by event_type order by first_seen, user_id) as int) as place from f) select event_type, user_id, first_seen, place, place = max(place) over (partition by event_type) as last from k where place <= 5")
def consumers(spark, sf):
    return P.consumers(table(spark, sf, "events"), "event_type", "user_id", "event_id", 5)


_EMB = "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as a from embeddings)"


@query(_EMB + ", m as (select vec_id, a, len(a) as n, list_sum(a) / len(a) as mean from e), p as (select *, list_sum(list_transform(a, lambda x: pow(x - mean, 2))) / n as m2, list_sum(list_transform(a, lambda x: pow(x - mean, 3))) / n as m3, list_sum(list_transform(a, lambda x: pow(x - mean, 4))) / n as m4 from m) select vec_id, cast(n as int) as n, round(mean, 8) as mean, round(case when n > 1 then sqrt(m2 * n / (n - 1)) else 0 end, 8) as std, round(case when n < 3 or m2 < 1e-10 then 0 else m3 / pow(m2, 15e-1) end, 6) as skew, round(case when n < 4 or m2 < 1e-10 then 0 else m4 / (m2 * m2) - 3 end, 6) as kurt from p")
def array_moments(spark, sf):
    m = A.moments(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return m.select("vec_id", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"))


@query(_EMB + ", m as (select vec_id, a, list_sum(a) / len(a) as mean from e) select vec_id, round(list_sum(list_transform(a, lambda x: abs(x - mean))) / len(a), 8) as mad, round(list_sum(list_transform(range(2, len(a) + 1), lambda i: abs(a[i] - a[i - 1]))) / (len(a) - 1), 8) as d1, round(list_sum(list_transform(range(3, len(a) + 1), lambda i: abs(a[i] - 2 * a[i - 1] + a[i - 2]))) / (len(a) - 2), 8) as d2 from m")
def array_mad_derivatives(spark, sf):
    a = A.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(A.mad(a), 8).alias("mad"), F.round(A.derivative(a), 8).alias("d1"), F.round(A.second_derivative(a), 8).alias("d2"))


@query(_EMB + ", r as (select vec_id, list_transform(a, lambda x: round(x, 1)) as q, a from e), p as (select vec_id, list_sum(list_transform(range(1, len(a) + 1), lambda i: pow(a[i] - q[i], 2))) / len(a) as mse, list_max(a) - list_min(a) as span from r) select vec_id, round(mse, 8) as mse, round(case when mse < 1e-10 then 0 else greatest(0, 10 * log10(span * span / mse)) end, 5) as psnr from p")
def array_psnr(spark, sf):
    a = A.doubles(F.col("embedding"))
    q = F.transform(a, lambda x: F.round(x, 1))
    return table(spark, sf, "embeddings").select("vec_id", F.round(A.mse(a, q), 8).alias("mse"), F.round(A.psnr(a, q), 5).alias("psnr"))


@query(_EMB + ", r as (select vec_id, a, list_transform(a, lambda x: round(x, 1)) as b, len(a) as n from e), m as (select *, list_sum(a) / n as ma, list_sum(b) / n as mb, list_max(a) - list_min(a) as span from r), v as (select *, list_sum(list_transform(a, lambda x: pow(x - ma, 2))) / n as va, list_sum(list_transform(b, lambda x: pow(x - mb, 2))) / n as vb, list_sum(list_transform(range(1, n + 1), lambda i: (a[i] - ma) * (b[i] - mb))) / n as cov, pow(1e-2 * span, 2) as c1, pow(3e-2 * span, 2) as c2 from m) select vec_id, round((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), 6) as ssim, round(list_max(list_transform(range(1, n + 1), lambda i: abs(a[i] - b[i]))), 8) as max_error from v")
def array_ssim(spark, sf):
    a = A.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(A.ssim(a, F.transform(a, lambda x: F.round(x, 1))), 6).alias("ssim"), F.round(A.max_error(a, F.transform(a, lambda x: F.round(x, 1))), 8).alias("max_error"))


@query(_EMB + ", x as (select vec_id, unnest(list_transform(a, lambda x: sign(x))) as s, unnest(range(1, len(a) + 1)) as i from e), g as (select vec_id, s, i - row_number() over (partition by vec_id, s order by i) as g from x), r as (select vec_id, count(*) as n from g group by vec_id, s, g) select vec_id, cast(max(n) as int) as run from r group by 1")
def array_max_run(spark, sf):
    signs = F.transform(A.doubles(F.col("embedding")), F.signum)
    return table(spark, sf, "embeddings").select("vec_id", A.max_run(signs).alias("run"))


@query()
def array_byte_features(spark, sf):
    return A.byte_features(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query()
def array_block_sample(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", A.block_sample(F.col("embedding"), 7, 4, 8).alias("sample"))


@query()
def row_sample(spark, sf):
    return E.row_sample(table(spark, sf, "train").select("row_id", "serial_number", "failure", "smart_9"), "row_id")


@query("select vec_id, list_transform(embedding, lambda x: case when x = 0 then x else cast(trunc(cast(x as double) / pow(2.0, floor(log2(abs(cast(x as double)))) - 9)) * pow(2.0, floor(log2(abs(cast(x as double)))) - 9) as float) end) as groomed from embeddings")
def array_groomed(spark, sf):
    return Z.groomed(table(spark, sf, "embeddings"), "vec_id", "embedding", 3)


@query()
def codec_schedule(spark, sf):
    s = Z.schedule(table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("payload")), "doc_id", "payload")
    return Z.best_codec(s, "doc_id", "ratio", "place", True)


@query("with v as (select l_extendedprice as x from lineitem), o as (select x, row_number() over (order by x) - 1 as i, count(*) over () as n from v), e as (select distinct x from o where i in (select cast(floor(k * n / 15) as bigint) from (select max(n) as n from o), (select unnest(range(1, 15)) as k))) select cast(row_number() over (order by x) - 1 as int) as bin, x as edge from e")
def percentile_bins(spark, sf):
    return Z.percentile_edges(table(spark, sf, "lineitem"), "l_extendedprice").select("bin", "edge")


_OLS = "select l_returnflag, l_linestatus, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 3) as slope, round(avg(l_extendedprice) - regr_slope(l_extendedprice, l_quantity) * avg(l_quantity), 2) as intercept, round(power(corr(l_extendedprice, l_quantity), 2), 6) as r2 from lineitem group by 1, 2 having count(*) >= 10"


@query(_OLS)
def ols_by_group(spark, sf):
    o = Z.ols_by_group(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return o.select("l_returnflag", "l_linestatus", "n", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("with s as (select cast(floor(l_quantity / 5) as bigint) as qb, l_returnflag as rf, avg(l_tax) as tax, count(*) as n from lineitem where l_discount < 0.05 group by 1, 2), g as (select sum(tax * n) / sum(n) as tax from s) select l_orderkey, l_linenumber, round(coalesce(s.tax, g.tax), 8) as tax, s.tax is not null as known from lineitem l left join s on s.qb = cast(floor(l.l_quantity / 5) as bigint) and s.rf = l.l_returnflag cross join g where l.l_discount >= 0.05")
def qtable_predict(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("qb", F.floor(F.col("l_quantity") / 5)).withColumn("rf", F.col("l_returnflag"))
    states = Z.train_states(t.where("l_discount < 0.05D").withColumnRenamed("l_tax", "tax"), ["qb", "rf"], ["tax"])
    p = Z.predict_states(t.where("l_discount >= 0.05D").select("l_orderkey", "l_linenumber", "qb", "rf"), states.select("qb", "rf", "tax", "n"), ["qb", "rf"], ["tax"])
    return p.select("l_orderkey", "l_linenumber", F.round("tax", 8).alias("tax"), "known")


_LOST = "with s as (select cast(floor(l_quantity / 5) as bigint) as qb, l_linenumber as ln, avg(l_tax) as tax, count(*) as n from lineitem where l_discount < 0.05 and floor(l_quantity / 5) % 2 = 0 group by 1, 2), g as (select sum(tax * n) / sum(n) as tax from s), q as (select distinct cast(floor(l_quantity / 5) as bigint) as qb, l_linenumber as ln from lineitem where l_discount >= 0.05), d as (select q.qb, q.ln, s.tax, row_number() over (partition by q.qb, q.ln order by sqrt(pow(q.qb - s.qb, 2) + pow(q.ln - s.ln, 2)), s.qb, s.ln) as place from q cross join s), m as (select qb, ln, avg(tax) as tax from d where place <= 5 group by 1, 2)"


@query(_LOST + " select l_orderkey, l_linenumber, round(coalesce(s.tax, m.tax, g.tax), 8) as tax, s.tax is not null as known from lineitem l left join s on s.qb = cast(floor(l.l_quantity / 5) as bigint) and s.ln = l.l_linenumber left join m on m.qb = cast(floor(l.l_quantity / 5) as bigint) and m.ln = l.l_linenumber cross join g where l.l_discount >= 0.05")
def qtable_neighbours(spark, sf):
    t = table(spark, sf, "lineitem").withColumn("qb", F.floor(F.col("l_quantity") / 5)).withColumn("ln", F.col("l_linenumber"))
    states = Z.train_states(t.where("l_discount < 0.05D and qb % 2 = 0").withColumnRenamed("l_tax", "tax"), ["qb", "ln"], ["tax"])
    p = Z.predict_states(t.where("l_discount >= 0.05D").select("l_orderkey", "l_linenumber", "qb", "ln"), states.select("qb", "ln", "tax", "n"), ["qb", "ln"], ["tax"], 5)
    return p.select("l_orderkey", "l_linenumber", F.round("tax", 8).alias("tax"), "known")


@query("select * from (values " + ", ".join(f"('{n}', {w}, {b}, {str(s).lower()})" for n, w, b, s in Z.REGISTRY) + ") v(name, wire_id, base_id, single_mode)")
def codec_registry(spark, sf):
    return Z.registry(spark).drop("available")


_KNN_S = "st as (select cast(p_size as bigint) * 1000 + cast(floor(p_retailprice / 100) as bigint) as sid, p_size as a, cast(floor(p_retailprice / 100) as int) as b from part group by 1, 2, 3)"


@query(f"with {_KNN_S}, q as (select s_suppkey, s_nationkey as a, cast(floor((s_acctbal + 1000) / 500) as int) as b from supplier), d as (select s_suppkey, sid, sqrt(pow(q.a - st.a, 2) + pow(q.b - st.b, 2)) as distance from q cross join st), k as (select *, cast(row_number() over (partition by s_suppkey order by distance, sid) as int) as place from d) select s_suppkey, place, round(distance, 8) as distance, sid from k where place <= 5")
def knn_states(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").alias("a"), F.floor(F.col("p_retailprice") / 100).cast("int").alias("b")).distinct().withColumn("sid", F.col("a").cast("bigint") * 1000 + F.col("b"))
    q = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a"), F.floor((F.col("s_acctbal") + 1000) / 500).cast("int").alias("b"))
    return Z.nearest_states(q, p, "s_suppkey", ["a", "b"], "sid").withColumn("distance", F.round("distance", 8))


@query("with c as (select o_orderkey, l_linenumber, l_quantity as ratio, l_tax as ct, l_discount as dt, l_extendedprice as size from orders join lineitem on o_orderkey = l_orderkey), w as (select *, ct + dt + size / ratio / 1e6 * 1000 as ms, row_number() over (partition by o_orderkey order by ct + dt + size / ratio / 1e6 * 1000, l_linenumber) as rn from c where ratio > 1) select o_orderkey, l_linenumber, round(ms, 9) as ms from w where rn = 1")
def best_time(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 1")
    ms = Z.workflow_ms(F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_quantity"), F.lit(1e6))
    c = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", ms.alias("ms")).join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return Z.best_codec(c, "o_orderkey", "ms", "l_linenumber", False).select("o_orderkey", "l_linenumber", F.round("ms", 9).alias("ms"))


@query("with t as (select row_id, serial_number, date, coalesce(smart_1, 0) as x, coalesce(smart_193, 0) as y from train where serial_number is not null), l as (select row_id, x - lag(x, 7) over w as x_d7, y - lag(y, 7) over w as y_d7, row_number() over w as i from t window w as (partition by serial_number order by date, row_id)) select row_id, x_d7, y_d7 from l where i > 7")
def lag7_delta(spark, sf):
    t = table(spark, sf, "train").where("serial_number is not null").select("row_id", "serial_number", "date", *[F.coalesce(F.nanvl(c, F.lit(None).cast("float")), F.lit(0.0).cast("float")).alias(n) for c, n in ((F.col("smart_1"), "x"), (F.col("smart_193"), "y"))])
    return E.lag_difference(t, "serial_number", ["date", "row_id"], ["x", "y"]).select("row_id", "x_d7", "y_d7")


@query("with f as (select disk_id, min(coalesce(try_cast(left(replace(failure_time, '/', '-'), 10) as date), null)) as failed from failure_labels where disk_id is not null group by 1) select row_id, case when f.failed - t.date between 0 and 30 then 1 else 0 end as label from train t left join f on f.disk_id = t.serial_number")
def label_window(spark, sf):
    d = F.substring(F.replace("failure_time", F.lit("/"), F.lit("-")), 1, 10).try_cast("date")
    f = table(spark, sf, "failure_labels").where("disk_id is not null").groupBy(F.col("disk_id").alias("serial_number")).agg(F.min(d).alias("failed"))
    return table(spark, sf, "train").select("row_id", "serial_number", "date").join(f, "serial_number", "left").select("row_id", E.failure_label(F.col("date"), F.col("failed")).alias("label"))


@query("with p as (select user_id, least(value / 200, 1.0) as p, case when user_id % 2 = 0 then 'ssd' else 'hdd' end as kind, event_id from events where value is not null), d as (select event_id, case when p >= 2e-2 then greatest(1, case when kind = 'ssd' then 2400 * pow(-ln(1 - least(p, 999e-3)), 1 / 1.8::double) else 1730 * pow(-ln(1 - least(p, 999e-3)), 1 / 2.1::double) end) end as days, kind from p) select event_id, cast(greatest(1, floor(days * case when kind = 'ssd' then 70e-2 else 75e-2 end)) as int) as low, cast(floor(days * case when kind = 'ssd' then 140e-2 else 135e-2 end) as int) as high, round(days, 6) as days, case when days is null then 'healthy' when days <= 14 then 'critical' when days <= 60 then 'high' when days <= 180 then 'moderate' else 'low' end as risk from d")
def weibull_risk(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    p, kind = F.least(F.col("value") / 200, F.lit(1.0)), F.when(F.col("user_id") % 2 == 0, "ssd").otherwise("hdd")
    d = e.select("event_id", kind.alias("kind"), E.weibull_days(p, kind).alias("days"))
    low, high = E.band(F.col("days"), F.col("kind"))
    return d.select("event_id", low.alias("low"), high.alias("high"), F.round("days", 6).alias("days"), E.risk(F.col("days")).alias("risk"))


@query()
def weibull_fit(spark, sf):
    e = table(spark, sf, "events").where("value > 0").select(F.when(F.col("user_id") % 2 == 0, "ssd").otherwise("hdd").alias("kind"), (F.col("value") * 10).alias("days"))
    return E.fit_weibull(e, "kind", "days")


@query("with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events), t as (select * from r where i <= 8) select user_id, count(*) as n_rows, round(max(case when i = 1 then value end) - max(case when i = m then value end), 8) as value_delta from (select *, max(i) over (partition by user_id) as m from t) group by 1")
def tail8_delta(spark, sf):
    return E.last_rows_delta(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["value"]).withColumn("value_delta", F.round("value_delta", 8))


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def latest_per_key(spark, sf):
    return E.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("select serial_number, max(smart_9) as hours from train where failure = 1 and not isnan(smart_9) and smart_9 > 0 and serial_number is not null group by 1")
def failed_hours(spark, sf):
    t = table(spark, sf, "train").where("failure = 1 and not isnan(smart_9) and smart_9 > 0 and serial_number is not null")
    return t.groupBy("serial_number").agg(F.max("smart_9").alias("hours"))


@query("select drive_id, count(*) as n, min(id) as first_id, max(id) as last_id, case when count(*) >= 7 then 'rolling' else 'static' end as model from drive_readings where drive_id is not null group by 1")
def history_stats(spark, sf):
    n = F.count("*")
    return table(spark, sf, "drive_readings").where("drive_id is not null").groupBy("drive_id").agg(n.alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.when(n >= 7, "rolling").otherwise("static").alias("model"))


@query("with recursive e as (select event_type as k, cast(user_id % 50 as double) as c, value as r, row_number() over (partition by event_type order by event_id) as i from events where event_type is not null and value is not null), t as (select k, 0 as i, cast(1 as double) as a, cast(0 as double) as err from (select distinct k from e) union all select t.k, t.i + 1, a - 2e-1 * (a * (c + 1) - r) / (c + 1), case when r > 0 then err + 2e-1 * (abs(a * (c + 1) - r) / r - err) else err end from t join e on e.k = t.k and e.i = t.i + 1) select k, round(arg_max(a, i), 8) as coefficient, round(arg_max(err, i), 8) as error, cast(max(i) as bigint) as n from t group by 1")
def online_cost(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("k"), "event_id", (F.col("user_id") % 50).cast("double").alias("c"), F.col("value").alias("r"))
    return E.online_cost(e, "k", ["event_id"], "c", "r").select("k", F.round("coefficient", 8).alias("coefficient"), F.round("error", 8).alias("error"), "n")


@query("select event_type, user_id % 4 as node, count(*) as tasks, round(sum(value), 4) as load from events group by 1, 2")
def node_load(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("node")).agg(F.count("*").alias("tasks"), F.round(F.sum("value"), 4).alias("load"))


@query("select event_type, round(case when event_type in ('click', 'view') then sum(value) when event_type = 'purchase' then max(value) else avg(value) end, 6) as v, round(min(value), 6) as lo, round(avg(value), 6) as mean from events group by 1")
def metric_fold(spark, sf):
    t = F.col("event_type")
    v = F.when(t.isin("click", "view"), F.sum("value")).when(t == "purchase", F.max("value")).otherwise(F.avg("value"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(v, 6).alias("v"), F.round(F.min("value"), 6).alias("lo"), F.round(F.avg("value"), 6).alias("mean"))


@query("select event_id, user_id, event_type, value from events where event_id >= (select max(event_id) - 500 from events) order by event_id limit 1000")
def telemetry_poll(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_id") >= e.agg(F.max("event_id") - 500).scalar()).select("event_id", "user_id", "event_type", "value").orderBy("event_id").limit(1000)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events) where i <= 3")
def evict_over_cap(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("i", F.row_number().over(w)).where("i <= 3").select("user_id", "event_id")
