"""Queries of files, attributes, batches, monitors and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, parity
from ..functions.patterns import mixed, pattern
from ..operators import arraystats as A
from ..operators import attributes as T
from ..operators import catalog as C
from ..operators import compress as Z
from ..operators import monitor as M
from ..operators.labelling import label_blobs
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


def _blobs(spark, sf):
    return C.blobs_of(table(spark, sf, "documents"))


@query("""with p as (select '/' || tag_name as own, coalesce(strlen(text), 0) as size, last_modified from documents where tag_name is not null),
e as (select own, case when i = 0 then '/' else '/' || array_to_string(list_slice(parts, 1, i), '/') end as path, size, last_modified from (select own, size, last_modified, parts, unnest(range(0, len(parts) + 1)) as i from (select *, string_split(own[2:], '/') as parts from p)))
select path, bool_or(own <> path) as is_dir, cast(coalesce(sum(size) filter (own = path), 0) as bigint) as size, epoch_us(max(last_modified) filter (own = path)) as last_us from e group by 1""")
def stat_paths(spark, sf):
    return T.stat(_blobs(spark, sf)).select("path", "is_dir", "size", F.unix_micros("last_modified").alias("last_us"))


@query("select tag_name, count(*) filter (doc_id % 10 = 0) as n_aliases from documents where tag_name is not null group by 1")
def alias_counts(spark, sf):
    d = table(spark, sf, "documents").where("tag_name is not null")
    return T.alias_counts(d.select("tag_name"), d.where("doc_id % 10 = 0").select(F.col("blob_name").alias("alias"), "tag_name"))


@query("select tag_name, cast(sum(n) as bigint) as size, bool_or(n > 100) as found from (select tag_name, coalesce(n_chars, 0) as n from documents) group by 1")
def merge_replicas(spark, sf):
    d = table(spark, sf, "documents").select("tag_name", F.coalesce("n_chars", F.lit(0)).alias("size"), "last_modified")
    return T.merge_replicas(d.withColumn("found", F.col("size") > 100), "tag_name").select("tag_name", "size", "found")


@query("select event_id, round(sum(value) over (partition by event_type, epoch_us(ts) // 3600000000), 5) as batch_sum, count(*) over (partition by event_type, epoch_us(ts) // 3600000000) as batch_size from events")
def collective_batches(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.collective(e, ["event_type"], "ts", 3600, "value").select("event_id", F.round("batch_sum", 5).alias("batch_sum"), "batch_size")


@query("select user_id from events group by 1 having count(distinct event_type) = 5")
def barrier_complete(spark, sf):
    return T.complete_groups(table(spark, sf, "events"), "user_id", "event_type", 5).select("user_id")


@query("select vec_id, cast(i - 1 as int) as index, embedding[i] as value from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) where i - 1 between 2 and 9 and (i - 3) % 3 = 0")
def array_slice(spark, sf):
    return T.slice_array(table(spark, sf, "embeddings"), "vec_id", "embedding", 2, 10, 3)


@query("with h as (select hex(encode(text)) as h from documents where text is not null), c as (select lower(unnest(regexp_extract_all(h, '..'))) as x from h), n as (select x, count(*) as n from c group by 1) select cast(i as int) as byte, cast(coalesce(n, 0) as bigint) as n from range(256) r(i) left join n on x = lower(lpad(to_hex(i), 2, '0'))")
def byte_histogram(spark, sf):
    return A.byte_histogram(_blobs(spark, sf), "payload")


@query("select l_orderkey, l_linenumber from lineitem where l_discount <= 0 or l_discount * 1000 >= 50")
def psnr_candidates(spark, sf):
    return table(spark, sf, "lineitem").where(Z.psnr_ok(F.col("l_discount") * 1000, 50.0)).select("l_orderkey", "l_linenumber")


@query("select event_id, case when event_type = 'click' then 1.0::double else 0.0 end as is_click, case when event_type = 'view' then 1.0::double else 0.0 end as is_view, round(-(pow(value / 100, 2) + 5e-1 * pow(user_id / 100.0, 2) + 1e-1 * 4), 6) as reward from events")
def features_and_reward(spark, sf):
    r = Z.reward(F.col("value") / 100, F.col("user_id") / 100.0, F.lit(2.0))
    return table(spark, sf, "events").select("event_id", *T.one_hot(F.col("event_type"), ["click", "view"], "is"), F.round(r, 6).alias("reward"))


@query("select event_id, 1.0::double as ratio_none, case when value < 1 then 1.0 else round(user_id / value, 6) end as ratio from events where value is not null")
def compression_ratio(spark, sf):
    v = F.when(F.col("value") < 1, 0.0).otherwise(F.col("value"))
    return table(spark, sf, "events").where("value is not null").select("event_id", Z.ratio(F.col("value"), F.lit(0.0)).alias("ratio_none"), F.round(Z.ratio(F.col("user_id"), v), 6).alias("ratio"))


@query("select doc_id, text, 16 + (strlen(text) // 16 + 1) * 16 as cipher_bytes, false as shows from documents where text is not null")
def encrypted_round_trip(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").withColumn("c", keys.encrypt(F.col("text").cast("binary"), "secret"))
    shows = (F.length("text") > 0) & F.contains(F.hex("c"), F.hex(F.col("text").cast("binary")))
    return d.select("doc_id", keys.decrypt(F.col("c"), "secret").cast("string").alias("text"), F.length("c").cast("bigint").alias("cipher_bytes"), shows.alias("shows"))


@query("select doc_id, text, strlen(text) > 0 as packs, true as marked from documents where text is not null")
def codec_round_trip(spark, sf):
    """Of the text and of forty copies of it in a row, which any codec packs; the format's mark comes first."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", Z.compress(F.col("text").cast("binary"), "zlib", "best").alias("c"), Z.compress(F.repeat("text", F.lit(40)).cast("binary"), "zlib").alias("many"))
    return d.select("doc_id", Z.decompress(F.col("c"), "zlib").cast("string").alias("text"), (F.length("many") * 2 < 40 * F.octet_length("text")).alias("packs"), F.hex("c").startswith("78DA").alias("marked"))


@query("select blob_name from documents where epoch_us(last_modified) >= (select max(epoch_us(last_modified)) from documents) - 86400000000 * 3")
def modified_since(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.col("last_modified") >= d.agg(F.max("last_modified") - F.expr("interval 3 days")).scalar()).select("blob_name")


@query("select tag_name, max(doc_id) filter (doc_id % 7 <> 0) as doc_id from documents where tag_name is not null group by 1 having max(doc_id) % 7 <> 0")
def store_and_evict(spark, sf):
    log = table(spark, sf, "documents").where("tag_name is not null").select("tag_name", "doc_id", F.when(F.col("doc_id") % 7 == 0, "evict").otherwise("store").alias("op"))
    return C.replay(log.withColumn("seq", F.col("doc_id")), ["tag_name"], "seq", "op", ("evict",)).select("tag_name", "doc_id")


@query("select event_type, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean, round(sum(value) / count(distinct user_id), 4) as per_thread from events group by 1")
def thread_summary(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value") / F.countDistinct("user_id"), 4).alias("per_thread"))


@query("select serial_number, count(*) as n, sum(case when isnan(smart_198) or smart_198 is null then 0 else smart_198 end) as s198 from train where serial_number is not null group by 1")
def missing_as_zero(spark, sf):
    t = table(spark, sf, "train").where("serial_number is not null")
    v = F.coalesce(F.when(~F.isnan("smart_198"), F.col("smart_198")), F.lit(0.0)).cast("double")
    return t.groupBy("serial_number").agg(F.count("*").alias("n"), F.sum(v).alias("s198"))


@query()
def blob_labels(spark, sf):
    return label_blobs(_blobs(spark, sf), [(r"^chunk_", "summary"), (r"\.md$", "page")])


@query()
def array_families(spark, sf):
    return A.byte_features(table(spark, sf, "embeddings"), "vec_id", "embedding").groupBy("family").agg(F.count("*").alias("n"))


@query()
def synthetic_patterns(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    kinds = ("uniform", "gaussian", "constant", "gradient", "sinusoid", "repeating", "bimodal", "exponential")
    return e.select("event_id", *[F.round(pattern(k, F.col("event_id"), 1000), 6).alias(k) for k in kinds])


@query("select event_id, user_id, value from events where event_id >= greatest((select max(event_id) from events) - 299, 12345)")
def monitor_ring(spark, sf):
    return M.system_stats(table(spark, sf, "events"), "event_id", "system_stats:12345", 300).select("event_id", "user_id", "value")


@query("select event_id, event_type || '.' || user_id % 4 as pool_id from events where user_id % 4 = 3 and event_type = 'view' and user_id % 7 = 2")
def pool_selector(spark, sf):
    e = table(spark, sf, "events")
    e = e.select("event_id", F.concat(F.lit("513."), F.col("user_id") % 4).alias("pool_id"), (F.col("user_id") % 7).alias("host"), F.col("event_type").alias("selector"))
    return M.select_pools(e, "pool_stats://513.3:physical:2:view", host="host").select("event_id", F.replace("pool_id", F.lit("513"), F.lit("view")).alias("pool_id"))


@query("select n.i as node, e.event_id, e.value, e.event_id is not null as alive from range(12) n(i) left join (select user_id % 9 as node, max(event_id) as event_id, arg_max(value, event_id) as value from events where value is not null group by 1) e on e.node = n.i")
def nodes_dashboard(spark, sf):
    e = table(spark, sf, "events").where("value is not null").select((F.col("user_id") % 9).alias("node"), "event_id", "value")
    return M.nodes_view(spark.range(12).withColumnRenamed("id", "node"), e, "node", "event_id")


@query("select vec_id, list_transform([cast(len(embedding) * 4 as double), 50, 0, list_sum(list_transform(a, lambda x: abs(x - m))) / len(a), 0, vec_id % 21, case when vec_id % 3 = 0 then 1 else 0 end, case when vec_id % 3 = 1 then 1 else 0 end, case when vec_id % 3 = 2 then 1 else 0 end, 0, 1], lambda x: round(cast(x as double), 4)) as features from (select *, list_transform(embedding, lambda x: cast(x as double)) as a, list_sum(list_transform(embedding, lambda x: cast(x as double))) / len(embedding) as m from embeddings)")
def codec_features(spark, sf):
    a = A.doubles(F.col("embedding"))
    v = T.feature_vector(F.size("embedding") * 4, F.lit(50), F.lit(0), A.mad(a), F.lit(0), F.col("vec_id") % 21, F.element_at(F.array(F.lit("fast"), F.lit("balanced"), F.lit("best")), (F.col("vec_id") % 3 + 1).cast("int")), F.lit("float"))
    return table(spark, sf, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x.cast("double"), 4)).alias("features"))


@query("with a as (select tag_name, 'alias of ' || tag_name as alias from documents where tag_name is not null group by 1) select 'blob' as kind, blob_name as name from documents where tag_name is null or not (tag_name = 'drive_notes' or starts_with(tag_name, 'drive_notes/')) union all select 'alias', alias from a where not (tag_name = 'drive_notes' or starts_with(tag_name, 'drive_notes/')) and alias <> 'alias of ops_journal'")
def delete_with_aliases(spark, sf):
    b = _blobs(spark, sf)
    a = b.where("tag_name is not null").select("tag_name").distinct().withColumn("alias", F.concat(F.lit("alias of "), "tag_name"))
    b, a = C.delete_tag(*C.delete_tag(b, a, "drive_notes"), "alias of ops_journal")
    return b.select(F.lit("blob").alias("kind"), F.col("blob_name").alias("name")).unionByName(a.select(F.lit("alias").alias("kind"), F.col("alias").alias("name")))


@query("select doc_id, hex(encode(text)) as payload from documents where text is not null")
def parity_recovery(spark, sf):
    """Of four data and two parity shards, any two are lost."""
    d = table(spark, sf, "documents").where("text is not null")
    s = parity.stripes(d, "doc_id", "text", 4, 2)
    lost = F.col("doc_id") % 6
    left = s.where((F.col("shard") != lost) & (F.col("shard") != (lost + 1 + F.col("doc_id") % 5) % 6))
    return parity.restored(left, "doc_id", 4, 2).select("doc_id", F.hex("payload").alias("payload"))


@query("select i as id, case when i < 2000 then 'gradient' when i < 5000 then 'sinusoidal' else 'constant' end as kind, round(case when i < 2000 then i / 1999.0 when i < 5000 then sin(2 * pi() * (i - 2000) / 64) else 1 end, 8) as value from range(10000) r(i)")
def pattern_mix(spark, sf):
    return mixed(spark, "gradient:20,sinusoidal:30,constant:50,unheard:10", 10_000).withColumn("value", F.round("value", 8))
