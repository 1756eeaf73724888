"""Queries of the catalog and its search, over documents as blobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..api import Catalog
from ..functions import text as X
from ..operators import catalog as C
from ..operators import search as S
from ..operators.files import FileTree
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


def _blobs(spark: SparkSession, sf: str) -> DataFrame:
    return C.blobs_of(table(spark, sf, "documents"))


_BLOBS = "with b as (select tag_name, blob_name, doc_id, text as payload, coalesce(strlen(text), 0) as size, last_modified from documents)"


@query("with t as (select distinct tag_name from documents where regexp_full_match(tag_name, '(drive_notes|user_manuals)/.*-00[0-9]')) select tag_name, (select count(*) from t) as total from t order by 1 limit 20")
def tag_query_regex(spark, sf):
    return S.tag_query(_blobs(spark, sf).select("tag_name").distinct(), "(drive_notes|user_manuals)/.*-00[0-9]", 20)


@query("with t as (select distinct tag_name from documents where tag_name = 'ops_journal') select tag_name, (select count(*) from t) as total from t")
def tag_query_literal(spark, sf):
    return S.tag_query(_blobs(spark, sf).select("tag_name").distinct(), "^ops_journal$")


@query("with t as (select distinct tag_name from documents where regexp_full_match(tag_name, '[o]ps_(j|k)ournal|x') or regexp_full_match(tag_name, '\\x6fps_j[\\]xo]+urnal') or regexp_full_match(tag_name, '(?:drive_notes/)[^]x/]+-0[0-9]{2}')) select tag_name from t")
def tag_query_escapes(spark, sf):
    t = _blobs(spark, sf).select("tag_name").distinct()
    p = [X.regex_predicate(F.col("tag_name"), x) for x in ("[o]ps_(j|k)ournal|x", r"\x6fps_j[\]xo]+urnal", r"(?:drive_notes/)[^]x/]+-0[0-9]{2}")]
    return t.where(p[0] | p[1] | p[2])


@query("select distinct tag_name from documents where tag_name is not null order by 1")
def tag_names(spark, sf):
    return _blobs(spark, sf).where("tag_name is not null").select("tag_name").distinct().orderBy("tag_name")


@query("with h as (select tag_name, blob_name from documents where regexp_full_match(tag_name, 'ops_.*') and regexp_full_match(blob_name, 'chunk_[0-9]+\\.(md|txt)')) select tag_name, blob_name, (select count(*) from h) as total from h order by 1, 2 limit 25")
def blob_query_capped(spark, sf):
    return S.blob_query(_blobs(spark, sf), "ops_.*", r"chunk_[0-9]+\.(md|txt)", 25)


@query("with h as (select tag_name, blob_name from documents where regexp_full_match(tag_name, '.*-001') and regexp_full_match(blob_name, '.*7\\.dat')) select tag_name, blob_name, (select count(*) from h) as total from h")
def blob_query_all(spark, sf):
    return S.blob_query(_blobs(spark, sf), ".*-001", r".*7\.dat")


def _bm25_sql(words: list[str], where: str, k: int) -> str:
    terms = ", ".join(f"('{w}')" for w in sorted(set(words)))
    return f"""
with c as (select tag_name, blob_name, list_transform(regexp_extract_all(text, '[A-Za-z0-9]{{2,}}'), lambda x: lower(x)) as t from documents where strlen(text) > 0 and {where}),
l as (select tag_name, blob_name, t, len(t) as dl from c), s as (select cast(count(*) as double) as n, case when avg(dl) > 0 then avg(dl) else 1 end as avgdl from l),
q as (select * from (values {terms}) v(term)),
f as (select tag_name, blob_name, dl, term, cast(len(list_filter(t, lambda x: x = term)) as double) as tf from l cross join q),
d as (select term, cast(count(*) filter (tf > 0) as double) as df from f group by 1)
select tag_name, blob_name, round(sum(ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) as score
from f join d using (term) cross join s group by 1, 2 order by 3 desc, 2, 1 {f'limit {k}' if k else ''}
"""


@query(_bm25_sql(["tensor", "bursty", "drains", "checkpoint"], "true", 10))
def bm25_topk(spark, sf):
    return S.bm25(_blobs(spark, sf), "Bursty tensor drains checkpoint", 10).withColumn("score", F.round("score", 6))


@query(_bm25_sql(["kernel", "anomaly", "shelf"], "regexp_full_match(tag_name, 'ops_journal')", 0))
def bm25_zero_fill(spark, sf):
    b = _blobs(spark, sf).where(X.regex_predicate(F.col("tag_name"), "ops_journal"))
    return S.bm25(b, "anomaly of the kernel shelf".replace("of the ", ""), 0).withColumn("score", F.round("score", 6))


@query("select tag_name, blob_name, epoch_us(last_modified) * 1000 as last_modified_ns from documents where last_modified is not null and epoch_us(last_modified) * 1000 between 1706745600000000000 and 1709251200000000000 order by 3, 1, 2 limit 50")
def temporal_window(spark, sf):
    return S.temporal(_blobs(spark, sf), 1706745600000000000, 1709251200000000000, 50)


@query("select tag_name, blob_name, epoch_us(last_modified) * 1000 as last_modified_ns from documents where epoch_us(last_modified) * 1000 >= 1717200000000000000")
def temporal_open_end(spark, sf):
    return S.temporal(_blobs(spark, sf), begin=1717200000000000000)


@query("select tag_name, blob_name from documents where regexp_full_match(tag_name, 'bench_logs/.*') and last_modified is not null and epoch_us(last_modified) * 1000 <= 1709251200000000000")
def context_query_temporal(spark, sf):
    return S.context_query(_blobs(spark, sf), "bench_logs/.*", ".*", prompt="ignored", end=1709251200000000000)


_RANKED = f"with r as ({_bm25_sql(['aligned', 'rack'], 'true', 1024)}), k as (select row_number() over (order by score desc, blob_name, tag_name) as rank, tag_name, blob_name from r), z as (select k.*, cast(strlen(d.text) as bigint) as size from k join documents d using (tag_name, blob_name))"


@query(_RANKED + ", w as (select *, cast(sum(size) over (order by rank) as bigint) as running from z) select cast(rank as int) as rank, tag_name, blob_name, size, running from w where running <= 20000")
def retrieve_budget(spark, sf):
    return S.context_retrieve(_blobs(spark, sf), ".*", ".*", "aligned rack", 20_000)


@query("""with recursive r as (select row_number() over (order by last_modified, tag_name, blob_name) as rank, tag_name, blob_name, cast(strlen(text) as bigint) as size from documents where strlen(text) > 0 and last_modified is not null order by last_modified, tag_name, blob_name limit 1024),
t as (select 1 as i, case when size <= 60000 then size else 0 end as used, case when size > 60000 then 0 else -1 end as closed, size <= 60000 as kept from r where rank = 1
  union all select i + 1, used + case when closed <> i // 32 and used + size <= 60000 then size else 0 end, case when closed <> i // 32 and used + size > 60000 then i // 32 else closed end, closed <> i // 32 and used + size <= 60000 from t join r on r.rank = t.i + 1)
select cast(r.rank as int) as rank, tag_name, blob_name, size from r join t on t.i = r.rank where kept""")
def retrieve_by_batch(spark, sf):
    hit = _blobs(spark, sf).where("size > 0 and last_modified is not null")
    ranked = hit.orderBy("last_modified", "tag_name", "blob_name").limit(1024).withColumn("rank", F.row_number().over(Window.orderBy("last_modified", "tag_name", "blob_name")))
    return S.packed_by_batch(ranked.select("rank", "tag_name", "blob_name", "size"), "rank", "size", 60_000)


@query(_BLOBS + " select tag_name, count(*) as n_blobs, cast(sum(size) as bigint) as total_size, epoch_us(max(last_modified)) as last_us from b group by 1")
def tag_size(spark, sf):
    return C.tags_of(_blobs(spark, sf)).select("tag_name", "n_blobs", "total_size", F.unix_micros("last_modified").alias("last_us"))


@query("select blob_name from documents where tag_name = 'ops_journal'")
def contained_blobs(spark, sf):
    return _blobs(spark, sf).where("tag_name = 'ops_journal'").select("blob_name")


@query("select blob_name, substr(hex(encode(text)), 21, 80) as part from documents where tag_name = 'ops_journal' and text is not null")
def get_blob_range(spark, sf):
    return _blobs(spark, sf).where("tag_name = 'ops_journal' and payload is not null").select("blob_name", F.hex(C.get_blob(F.col("payload"), F.lit(10), F.lit(40))).alias("part"))


@query("select doc_id, case when n >= 8 then h[1:16] else h || repeat('00', 8 - n) end || '5041544348' || h[27:] as patched, case when n = 0 then 2 else 0 end as rc from (select doc_id, h, length(h) // 2 as n from (select doc_id, coalesce(hex(encode(text)), '') as h from documents))")
def put_blob_overlay(spark, sf):
    b = _blobs(spark, sf).select("doc_id", F.coalesce("payload", F.lit(b"")).alias("t"))
    return b.select("doc_id", F.hex(C.put_blob(F.col("t"), F.lit(b"PATCH"), F.lit(8))).alias("patched"), C.put_status(F.lit("n"), F.col("t"), F.lit(0.5)).alias("rc"))


@query("select doc_id, case when length(h) >= 600 then h[1:600] else h || repeat('00', 300 - length(h) // 2) end as cut from (select doc_id, hex(encode(text)) as h from documents where text is not null)")
def truncate_blob(spark, sf):
    b = _blobs(spark, sf).where("payload is not null").select("doc_id", "payload")
    return b.select("doc_id", F.hex(C.truncate_blob(F.col("payload"), F.lit(300))).alias("cut"))


@query("""with p as (select distinct '/' || tag_name || '/' || blob_name as path from documents where tag_name is not null and blob_name is not null),
e as (select distinct case when i = 0 then '/' else '/' || array_to_string(list_slice(parts, 1, i), '/') end as path from (select parts, unnest(range(0, len(parts) + 1)) as i from (select string_split(path[2:], '/') as parts from p)))
select path, case when path = '/' then null when strpos(path[2:], '/') = 0 then '/' else regexp_replace(path, '/[^/]*$', '') end as parent from e""")
def path_ancestors(spark, sf):
    paths = _blobs(spark, sf).where("tag_name is not null and blob_name is not null").select(F.concat(F.lit("/"), "tag_name", F.lit("/"), "blob_name").alias("path"))
    return C.materialized_paths(paths, "path")


def _paths(spark, sf):
    return _blobs(spark, sf).select("doc_id", F.concat(F.lit("/"), "tag_name").alias("path"))


@query("select doc_id, case when path = '/drive_notes' then '/archive/notes' when starts_with(path, '/drive_notes/') then '/archive/notes' || path[13:] else path end as path from (select doc_id, '/' || tag_name as path from documents)")
def path_rename(spark, sf):
    return C.rename_subtree(_paths(spark, sf), "path", "/drive_notes", "/archive/notes")


@query("select doc_id, path from (select doc_id, '/' || tag_name as path from documents) where not (path = '/bench_logs' or starts_with(path, '/bench_logs/'))")
def subtree_delete(spark, sf):
    return C.delete_subtree(_paths(spark, sf), "path", "/bench_logs")


@query("select distinct path[14:] as name from (select '/' || tag_name as path from documents) where starts_with(path, '/drive_notes/') and strpos(path[14:], '/') = 0")
def directory_children(spark, sf):
    return C.children(_paths(spark, sf).select("path").distinct(), "path", "/drive_notes")


@query("""with recursive n as (select distinct '/' || tag_name as path from documents), t as (select 0 as depth, '/' as path union all
select t.depth + 1, c.path from t join (select distinct path, case when strpos(path[2:], '/') = 0 then '/' else regexp_replace(path, '/[^/]*$', '') end as parent from (select path from n union select regexp_replace(path, '/[^/]*$', '') from n where strpos(path[2:], '/') > 0)) c on c.parent = t.path)
select depth, count(*) as n from t group by 1""")
def tree_depths(spark, sf):
    nodes = C.materialized_paths(_paths(spark, sf).where("path is not null").select("path"), "path")
    return nodes.select((F.size(F.filter(F.split("path", "/"), lambda x: x != ""))).alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))


@query(_BLOBS + ", e as (select doc_id, doc_id * 700 as off, size * 900 as n from b where size > 0), p as (select doc_id, off, n, unnest(range(off // 1048576, (off + n - 1) // 1048576 + 1)) as page from e) select doc_id, page, greatest(off, page * 1048576) - page * 1048576 as page_offset, least(off + n, (page + 1) * 1048576) - greatest(off, page * 1048576) as page_bytes from p")
def page_map(spark, sf):
    e = _blobs(spark, sf).select("doc_id", (F.col("doc_id") * 700).alias("off"), (F.col("size") * 900).alias("n"))
    return C.page_spans(e, "off", "n").select("doc_id", "page", "page_offset", "page_bytes")


@query("select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as seq, cast(coalesce(sum(n) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_ from (select *, cast(floor(value) as bigint) as n from events where value is not null)")
def append_sequence(spark, sf):
    e = table(spark, sf, "events").where("value is not null").select("user_id", "event_id", "ts", F.floor("value").alias("n"))
    return C.append_layout(e, "user_id", ["ts", "event_id"], "n").select("user_id", "event_id", "seq", F.col("offset").cast("bigint").alias("offset_"))


@query("with l as (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) select user_id, event_id, event_type, value from l where rn = 1 and event_type <> 'purchase'")
def wal_replay(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return C.replay(log.withColumn("seq", F.col("event_id")), ["user_id"], "seq", "event_type", ("purchase",)).select("user_id", "event_id", "event_type", "value")


@query("select doc_id, tag_name from documents where (regexp_full_match(tag_name, 'drive_notes/.*') or regexp_full_match(tag_name, '.*manuals/f.*')) and not regexp_full_match(tag_name, '.*-001')")
def glob_filter(spark, sf):
    return _blobs(spark, sf).where(X.glob_filter(F.col("tag_name"), ["drive_notes/*", "*manuals/f*"], ["*-001"])).select("doc_id", "tag_name")


@query("select doc_id, case when regexp_matches(text, 'ERROR|WARN') then 'log' when regexp_matches(text, 'bdev_type:') then 'config' when regexp_matches(text, 'return out') then 'code' end as label from documents where text is not null")
def label_rules_first_match(spark, sf):
    rules = [("ERROR|WARN", "log"), ("(unclosed", "never"), ("bdev_type:", "config"), ("return out", "code")]
    return _blobs(spark, sf).where("payload is not null").select("doc_id", X.first_rule(F.col("payload").cast("string"), rules).alias("label"))


@query("select doc_id, len(list_transform(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))) as n_tokens, list_transform(regexp_extract_all(text, '[A-Za-z0-9]{2,}'), lambda x: lower(x))[1] as first_token from documents where text is not null")
def token_counts(spark, sf):
    t = X.tokens(F.col("payload").cast("string"))
    return _blobs(spark, sf).where("payload is not null").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.try_element_at(t, F.lit(1)).alias("first_token"))


@query("select tag_name from (select distinct tag_name from documents) where contains(tag_name, 'harbor') order by 1")
def trigram_search(spark, sf):
    tags = _blobs(spark, sf).select("tag_name").distinct()
    cand = S.trigram_candidates(S.trigram_index(tags, "tag_name"), "tag_name", "harbor")
    return cand.where(F.col("tag_name").contains("harbor"))


@query("select tag_name, blob_name, doc_id % 3 = 0 as labelled from documents where blob_name like 'chunk%'")
def blob_labels_join(spark, sf):
    """Blobs beside the ``_label`` blobs that were written for them."""
    b = _blobs(spark, sf).where("blob_name like 'chunk%'")
    labels = b.where("doc_id % 3 = 0").select("tag_name", F.concat("blob_name", F.lit("_label")).alias("blob_name"))
    return S.with_labels(b.select("tag_name", "blob_name"), labels).select("tag_name", "blob_name", F.col("label").isNotNull().alias("labelled"))


@query("select d.doc_id, l.doc_id as sibling from documents d left join documents l on l.tag_name = d.tag_name and l.blob_name = replace(d.blob_name, '.dat', '.txt') and d.blob_name <> l.blob_name where d.blob_name like '%.dat'")
def label_sibling_join(spark, sf):
    b = _blobs(spark, sf)
    d = b.where(F.col("blob_name").endswith(".dat")).select("doc_id", "tag_name", F.replace("blob_name", F.lit(".dat"), F.lit(".txt")).alias("blob_name"))
    return d.join(b.select("tag_name", "blob_name", F.col("doc_id").alias("sibling")), ["tag_name", "blob_name"], "left").select("doc_id", "sibling")


@query("""select s, case when lower(s) = 'inf' then 9223372036854775807 when not regexp_matches(s, '^[0-9]') then 0 else cast(cast(regexp_extract(s, '^([0-9]+(\\.[0-9]+)?)', 1) as double) * pow(1024.0, case upper(regexp_extract(s, '^[0-9.]+\\s*([A-Za-z])', 1)) when 'K' then 1 when 'M' then 2 when 'G' then 3 when 'T' then 4 when 'P' then 5 else 0 end) as bigint) end as bytes
from (select distinct regexp_extract(text, 'capacity_limit: (\\S+)', 1) as s from documents where text like '%capacity_limit: %' union select unnest(['10', '4K', '1.5MB', 'inf', 'x', '7Q', '2 G']))""")
def size_parse(spark, sf):
    own = spark.createDataFrame([(x,) for x in ("10", "4K", "1.5MB", "inf", "x", "7Q", "2 G")], "s string")
    got = table(spark, sf, "documents").where(F.col("text").contains("capacity_limit: ")).select(F.regexp_extract("text", r"capacity_limit: (\S+)", 1).alias("s"))
    return got.union(own).distinct().select("s", X.size_bytes(F.col("s")).alias("bytes"))


@query("select * from (values ('1h30m', 5400.0::double), ('2d', 172800.0), ('1.5h', 5400.0), ('90', 90.0), ('x', null), ('3m10s', 190.0), ('', null)) v(s, seconds)")
def duration_parse(spark, sf):
    return spark.createDataFrame([(x,) for x in ("1h30m", "2d", "1.5h", "90", "x", "3m10s", "")], "s string").select("s", X.duration_s(F.col("s")).alias("seconds"))


@query("select * from (values ('5ns', 5::bigint), ('5us', 5120), ('2ms', 2097152), ('1s', 1073741824), ('bad', 0)) v(s, ns)")
def latency_parse(spark, sf):
    return spark.createDataFrame([(x,) for x in ("5ns", "5us", "2ms", "1s", "bad")], "s string").select("s", X.latency_ns(F.col("s")).alias("ns"))


@query("select unnest(['a00-x', 'a01-x', 'a02-x', 'a10-x', 'b', 'n8', 'n9', 'n10']) as host")
def expand_hosts(spark, sf):
    return spark.createDataFrame([(h,) for h in X.expand_hosts("a[00-02,10]-x;b;n[8-10]")], "host string")


@query("select distinct tag_name, regexp_replace(tag_name, '([.\\[\\](){}+*?\\\\^$|])', '\\\\\\1', 'g') as escaped, (cast(doc_id as bigint) << 32) | 7 as packed from documents")
def escaped_and_packed(spark, sf):
    return table(spark, sf, "documents").select("tag_name", X.regex_escape(F.col("tag_name")).alias("escaped"), X.packed_id(F.col("doc_id"), F.lit(7)).alias("packed")).distinct()


def _tree(spark, sf):
    """Every document as a file in pages of 64 bytes."""
    b = _blobs(spark, sf).where("tag_name is not null and blob_name is not null")
    return FileTree.of_blobs(b, F.concat(F.lit("/"), "tag_name", F.lit("/"), "blob_name"), F.col("doc_id"), 64)


_FILES = "with f as (select doc_id, '/' || tag_name || '/' || blob_name as path, coalesce(hex(encode(text)), '') as h from documents where tag_name is not null and blob_name is not null)"


@query(_FILES + ", w as (select *, doc_id % 300 as o, repeat('57', cast(doc_id % 100 + 1 as int)) as d from f where doc_id % 3 = 0), a as (select path, case when length(h) >= o * 2 then h[1:o * 2] else h || repeat('00', cast(o - length(h) // 2 as int)) end || d || h[o * 2 + length(d) + 1:] as h from w), b as (select path, h[1:20] || '2121' || h[25:] as h from a where length(h) >= 24 union all select path, rpad(h, 20, '0') || '2121' from a where length(h) < 24) select path, case when b.path is null then f.h else b.h end as content from f left join b using (path)")
def file_write(spark, sf):
    t = _tree(spark, sf)
    docs = _blobs(spark, sf).where("doc_id % 3 = 0 and tag_name is not null and blob_name is not null").select(F.concat(F.lit("/"), "tag_name", F.lit("/"), "blob_name").alias("path"), "doc_id")
    first = docs.select("path", F.lit(1).alias("seq"), (F.col("doc_id") % 300).alias("offset"), F.repeat(F.lit("W"), (F.col("doc_id") % 100 + 1).cast("int")).cast("binary").alias("data"), F.lit(1).cast("bigint").alias("mtime_us"))
    then = docs.select("path", F.lit(2).alias("seq"), F.lit(10).cast("bigint").alias("offset"), F.lit(b"!!").alias("data"), F.lit(2).cast("bigint").alias("mtime_us"))
    return t.write(first.unionByName(then)).read().select("path", F.hex("payload").alias("content"))


@query(_FILES + " select path, case when doc_id % 2 = 0 then rpad(h[1:300], 300, '0') else h end as content from f")
def file_truncate(spark, sf):
    t = _tree(spark, sf)
    sizes = t.nodes.where("kind = 'file' and ino % 2 = 0").select("path", F.lit(150).alias("size"))
    return t.truncate(sizes).read().select("path", F.hex("payload").alias("content"))


@query(_FILES + " select path, substr(h, 141, 200) as content from f")
def file_read_range(spark, sf):
    return _tree(spark, sf).read(70, 100).select("path", F.hex("payload").alias("content"))


@query("""with p as (select distinct '/' || tag_name || '/' || blob_name as path from documents where tag_name is not null and blob_name is not null), a as (select min(path) as path from p where not starts_with(path, '/drive_notes/')),
n as (select case when starts_with(path, '/drive_notes/') then '/kept/old/notes' || path[13:] else path end as path, 'file' as kind from p union all select '/kept/alias', 'file' union all select '/kept/pointer', 'link'),
e as (select distinct case when i = 0 then '/' else '/' || array_to_string(list_slice(parts, 1, i), '/') end as path from (select parts, unnest(range(0, len(parts))) as i from (select string_split(path[2:], '/') as parts from n)))
select path, kind from n union all select path, 'dir' from e""")
def link_rename(spark, sf):
    t = _tree(spark, sf)
    first = t.nodes.where("kind = 'file' and not startswith(path, '/drive_notes/')").agg(F.min("path")).first()[0]
    moved = t.rename("/drive_notes", "/kept/old/notes").link(first, "/kept/alias").symlink(first, "/kept/pointer")
    return moved.nodes.select("path", "kind")


@query("select tag_name, blob_name, case when doc_id % 3 <> 0 then h when doc_id % 2 = 0 then case when length(h) >= o * 2 then h[1:o * 2] else h || repeat('00', cast(o - length(h) // 2 as int)) end || '505554' else case when length(h) >= o * 2 then h[1:o * 2] else h || repeat('00', cast(o - length(h) // 2 as int)) end || '505554' || h[o * 2 + 7:] end as content, case when doc_id % 3 = 0 and doc_id % 5 <> 0 then 0.25::double else 1.0 end as score, cast(case when doc_id % 3 = 0 then 1 else 0 end as bigint) as access_count from (select *, coalesce(hex(encode(text)), '') as h, doc_id % 50 as o from documents where tag_name is not null and blob_name is not null) union all select 'fresh', 'blob', '0000505554', 1.0, 1")
def put_at_offset(spark, sf):
    b = _blobs(spark, sf).where("tag_name is not null and blob_name is not null")
    puts = b.where("doc_id % 3 = 0").select("tag_name", "blob_name", F.lit(b"PUT").alias("data"), (F.col("doc_id") % 50).cast("int").alias("offset"), F.when(F.col("doc_id") % 5 == 0, -1.0).otherwise(0.25).alias("score"), (F.col("doc_id") % 2 == 0).alias("replace"))
    new = spark.createDataFrame([("fresh", "blob", bytearray(b"PUT"), 2, -1.0, False), ("fresh", "refused", bytearray(b"PUT"), 0, 1.5, False), ("fresh", "", bytearray(b"PUT"), 0, 0.5, False)], puts.schema)
    return C.put_blobs(b, puts.unionByName(new)).select("tag_name", "blob_name", F.hex(F.coalesce("payload", F.lit(b""))).alias("content"), "score", "access_count")


@query("select tag_name, blob_name, epoch_us(last_modified) * 1000 as last_modified_ns from documents where epoch_us(last_modified) * 1000 >= 1717200000000000000 - 129600000000000 order by 3, 1, 2 limit 400")
def search_since(spark, sf):
    return S.temporal_since(_blobs(spark, sf), "1d12h", 1717200000000000000, 400)


@query("""select '{"tag_name":"' || tag_name || '","blob_name":"' || blob_name || '","size":' || coalesce(strlen(text), 0) || '}' as answer from documents where tag_name = 'ops_journal'""")
def tool_list_blobs(spark, sf):
    return Catalog(_blobs(spark, sf)).tag("ops_journal").rows.select(F.to_json(F.struct("tag_name", "blob_name", "size")).alias("answer"))


@query("with n as (select distinct case when tag_name = 'ops_journal' then 'ops_diary' else tag_name end as name from documents where tag_name is not null and not starts_with(tag_name, 'bench_logs') union select 'fresh_tag'), g as (select distinct name, name[i:i + 2] as trigram from (select name, unnest(range(1, length(name) - 1)) as i from n)) select name, trigram from g")
def index_changes(spark, sf):
    tags = _blobs(spark, sf).where("tag_name is not null").select(F.col("tag_name").alias("name")).distinct()
    i = S.trigram_index(tags, "name")
    i = S.index_delete(i, "name", tags.where(F.col("name").startswith("bench_logs")))
    i = S.index_insert(i, "name", spark.createDataFrame([("fresh_tag",), ("ops_journal",)], "name string"))
    return S.index_rename(i, "name", "ops_journal", "ops_diary").select("name", "trigram")


@query("""with p as (select distinct '/' || tag_name || '/' || blob_name as path from documents where tag_name is not null and blob_name is not null and not starts_with(tag_name, 'drive_notes/')),
e as (select distinct case when i = 0 then '/' else '/' || array_to_string(list_slice(parts, 1, i), '/') end as path from (select parts, unnest(range(0, len(parts) + 1)) as i from (select string_split(path[2:], '/') as parts from p)))
select path from e""")
def delete_and_prune(spark, sf):
    paths = _blobs(spark, sf).where("tag_name is not null and blob_name is not null").select(F.concat(F.lit("/"), "tag_name", F.lit("/"), "blob_name").alias("path"))
    nodes = C.materialized_paths(paths, "path").select("path").join(paths.distinct().withColumn("leaf", F.lit(True)), "path", "left")
    left = nodes.where(~(F.col("path").startswith("/drive_notes/") & F.col("leaf")) | F.col("leaf").isNull())
    return C.prune_empty(left, "path", F.coalesce("leaf", F.lit(False))).select("path")
