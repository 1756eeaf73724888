"""Relational, streaming and ingest queries over the star schema, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..api import Catalog
from ..functions.keys import longest_prefix, prefix_keys
from ..operators import attributes as T
from ..operators import catalog as C
from ..operators import compress as Z
from ..operators import placement as P
from ..session import scratch, table
from ..sources import ingest
from ..streaming import telemetry

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


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(spark, sf):
    t = table(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1")
def nation_revenue(spark, sf):
    c, o, li, s, n, r = (table(spark, sf, x) for x in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    near = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    j = s.join(near, s.s_nationkey == near.n_nationkey).join(li, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') group by 1")
def returned_orders(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(li, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select p_brand, p_size, cast(grouping(p_brand) as int) as g, count(*) as n from part group by cube (p_brand, p_size)")
def part_cube(spark, sf):
    return table(spark, sf, "part").cube("p_brand", "p_size").agg(F.grouping("p_brand").cast("int").alias("g"), F.count("*").alias("n"))


@query("select o_custkey, o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) as r, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running from orders")
def order_windows(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"), F.round(F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 0")
def nation_sets(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).exceptAll(table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query("select event_type, epoch_us(time_bucket(interval 1 day, ts)) as start_us, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having epoch_us(time_bucket(interval 1 day, ts)) + 86400000000 <= (select epoch_us(max(ts)) - 3600000000 from events)")
def stream_daily_counts(spark, sf):
    path = os.path.join(sf, "events.parquet")
    s = telemetry.source(spark, path, table(spark, sf, "events").schema)
    out = telemetry.run_to_table(telemetry.windowed(s, "ts", ["event_type"], "1 day", "1 hour"))
    return out.select("event_type", F.unix_micros("w.start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query("select user_id from events group by 1 having count(*) >= 7")
def stream_promotions(spark, sf):
    s = telemetry.source(spark, os.path.join(sf, "events.parquet"), table(spark, sf, "events").schema)
    return telemetry.run_to_table(telemetry.promotions(s, "user_id")).select("user_id")


@query("with t as (select doc_id, hex(encode(text)) as h, strlen(text) as n from documents where strlen(text) > 0) select doc_id, 'chunk_' || i as blob_name, h[i * 512 + 1 : i * 512 + 512] as bytes from (select doc_id, h, unnest(range(0, cast(ceil(n / 256.0) as bigint))) as i from t) union all select doc_id, 'description', hex(encode('binary<size=' || n || ', offset=0>')) from t")
def binary_chunks(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("tag"), F.col("text").cast("binary").alias("content"))
    c = ingest.chunks(d.withColumn("length", F.length("content")), "tag", "content", "length", 256)
    return c.select(F.col("tag_name").cast("bigint").alias("doc_id"), "blob_name", F.hex("payload").alias("bytes"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 2) as int)) as t from embeddings), c as (select a.vec_id, max(least(32, len(a.t), len(list_filter(range(1, least(len(a.t), len(b.t)) + 1), lambda i: a.t[1:i] = b.t[1:i])))) as matched, any_value(a.t) as t from e a join e b on a.vec_id <> b.vec_id and a.t[1] = b.t[1] group by 1),
k as (select vec_id, matched, list_reduce(list_concat([cast(14695981039346656037 as hugeint)], flatten(list_transform(t[1:matched], lambda x: [cast(x & 255 as hugeint), cast((x >> 8) & 255 as hugeint), cast((x >> 16) & 255 as hugeint), cast((x >> 24) & 255 as hugeint)]))), lambda h, b: (xor(h, b) * cast(1099511628211 as hugeint)) & cast(18446744073709551615 as hugeint)) as h from c where matched > 0)
select vec_id, cast(matched as int) as matched, lower(lpad(to_hex(cast(h as ubigint)), 16, '0')) as key from k""")
def kv_prefix_match(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 2).cast("int")).alias("tokens"))
    stored = e.select(F.col("vec_id").alias("owner"), F.posexplode(prefix_keys(F.col("tokens"))).alias("i", "key")).select("owner", "key", (4 * (F.col("i") + 1)).alias("n"))  # four bytes per element
    return longest_prefix(e, stored, "vec_id", "tokens", "key", "n", 128, "owner")


@query("select 'lineitem' as t, count(*) as rows from lineitem union all select 'orders', count(*) from orders")
def scan_metadata(spark, sf):
    one = lambda t: ingest.parquet_metadata(spark, os.path.join(sf, f"{t}.parquet")).agg(F.sum("rows").alias("rows")).select(F.lit(t).alias("t"), "rows")
    return one("lineitem").unionByName(one("orders"))


@query("select n_nationkey as k, n_name as name, n_regionkey as region from nation")
def csv_round_trip(spark, sf):
    """Written as CSV, read back by header and sampled types; odd characters leave the column names."""
    spot = scratch(spark, "csv")
    ingest.write_csv(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k "), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region#")), spot)
    d = ingest.read_csv(spark, spot)
    return d.select(F.col("k").cast("bigint").alias("k"), "name", F.col("region").cast("bigint").alias("region"))


@query("select tag_name || '/' || blob_name as blob_name, hex(encode(text)) as payload from documents where strlen(text) > 0 and tag_name is not null and blob_name is not null")
def record_round_trip(spark, sf):
    """Exported as record files and read back; blobs without bytes are left out."""
    spot = scratch(spark, "records")
    d = table(spark, sf, "documents").select(F.concat("tag_name", F.lit("/"), "blob_name").alias("blob_name"), F.col("text").cast("binary").alias("payload"))
    ingest.export_records(d, spot)
    return ingest.read_records(spark, spot).select("blob_name", F.hex("payload").alias("payload"))


@query("select 'tag' as kind, tag_name as name, cast(sum(coalesce(strlen(text), 0)) as bigint) as size from documents group by 2 union all select 'blob', blob_name, cast(coalesce(strlen(text), 0) as bigint) from documents")
def snapshot_round_trip(spark, sf):
    spot = scratch(spark, "snapshot")
    b = C.blobs_of(table(spark, sf, "documents"))
    ingest.save_snapshot(C.tags_of(b), b, spot)
    tags, blobs = ingest.load_snapshot(spark, spot)
    return tags.select(F.lit("tag").alias("kind"), F.col("tag_name").alias("name"), F.col("total_size").alias("size")).unionByName(blobs.select(F.lit("blob").alias("kind"), F.col("blob_name").alias("name"), "size"))


_SPEC = """
transfers:
  - src: string::greeting
    dst: tag::notes/${TAGLOOM_UNSET}first
    format: string
    data: "hello there"
  - src: file::%s
    dst: tag::ranges
    format: binary
    range_off: 4
    range_size: 600000
    dataset_filter:
      include:
        - "*.bin"
  - src: string::skipped
    dst: tag::notes
    format: string
    depends_on: other
    data: x
"""


@query("select * from (values ('notes/first', 'greeting', 11::bigint, '68656C6C'), ('ranges', 'chunk_0', 600000, '04050607'), ('ranges', 'description', 29, '62696E61')) v(tag_name, blob_name, n, head)")
def ingest_spec(spark, sf):
    """A YAML spec with an inline string, a range of a file made here, and a transfer that a dependency holds back."""
    spot = scratch(spark, "ingest")
    whole = bytes(range(256)) * 4096
    d = spark.createDataFrame([("whole", bytearray(whole))], "blob_name string, payload binary")

    def put(frames):
        import pyarrow as pa
        from pyarrow import fs

        for b in frames:
            where, root = fs.FileSystem.from_uri(spot) if "://" in spot or spot.startswith("file:") else (fs.LocalFileSystem(), spot)
            where.create_dir(root, recursive=True)
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with where.open_output_stream(f"{root}/{name}.bin") as f:
                    f.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])

    d.mapInArrow(put, "n bigint").count()
    got = ingest.ingest(spark, ingest.load_spec(_SPEC % spot))
    return got.select("tag_name", "blob_name", F.length("payload").cast("bigint").alias("n"), F.hex(F.substring("payload", 1, 4)).alias("head"))


@query("select tag_name, blob_name from documents where not (tag_name is not distinct from 'ops_journal' and blob_name = (select min(blob_name) from documents where tag_name = 'ops_journal'))")
def delete_blob(spark, sf):
    c = Catalog(C.blobs_of(table(spark, sf, "documents")))
    first = c.tag("ops_journal").contained_blobs().agg(F.min("blob_name")).first()[0]
    return c.tag("ops_journal").del_blob(first).blobs.select("tag_name", "blob_name")


@query("select doc_id, doc_id % 2 = 0 as has_a, case when doc_id % 6 = 0 then '6E6577' when doc_id % 2 = 0 then '6F6C64' end as a, doc_id % 5 <> 0 as has_b from documents")
def xattr_changes(spark, sf):
    """a is replaced where it is there (every second) and asked for (every third); b is created everywhere, then removed from every fifth."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(b"old"))).alias("m"))
    d = d.withColumn("m", F.when(F.col("doc_id") % 3 == 0, T.xattr_set(F.col("m"), "a", b"new", "replace")).otherwise(F.col("m")))
    d = d.withColumn("m", T.xattr_set(F.col("m"), "b", b"x", "create")).withColumn("m", F.when(F.col("doc_id") % 5 == 0, T.xattr_remove(F.col("m"), "b")).otherwise(F.col("m")))
    return d.select("doc_id", F.map_contains_key("m", F.lit("a")).alias("has_a"), F.hex(F.try_element_at("m", F.lit("a"))).alias("a"), F.map_contains_key("m", F.lit("b")).alias("has_b"))


@query("select event_id, round(greatest(1e6, least(1e10, pow(1001.0, value / 100) - 1)), 2) as bandwidth, round(value + 15e-1 * user_id / 1000.0 + 1048576 / 2.0 / 1e6 * 1000, 6) as lossy_ms from events where value is not null")
def bandwidth_and_lossy_time(spark, sf):
    e = table(spark, sf, "events").where("value is not null")
    ms = Z.workflow_ms(F.col("value"), F.col("user_id") / 1000.0, F.lit(1048576), F.lit(2.0), F.lit(1e6), F.lit(50.0))
    return e.select("event_id", F.round(P.score_bandwidth(F.col("value") / 100), 2).alias("bandwidth"), F.round(ms, 6).alias("lossy_ms"))
