"""Queries of profiling, encoding, row sets, features and sources over the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import scalar
from timberline.operators import profile, rowsets, targets
from timberline.plans.durable import small
from timberline.plans.registry import query, table

PROFILED = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
NUMBER = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
KIND = f"case when {{v}} is null or {{v}} = '' then 'empty' when not regexp_matches({{v}}, {NUMBER}) then 'string' when try_cast({{v}} as double) = floor(try_cast({{v}} as double)) then 'int' else 'float' end"


@query("column_profile", "with c as (" + " union all ".join(f"select {i} fid, '{c}' as name, cast({c} as varchar) v from lineitem" for i, c in enumerate(PROFILED)) + f"""),
k as (select fid, name, v, {KIND.format(v='v')} k from c),
a as (select fid, name, count(*) filter (k = 'int') n_int, count(*) filter (k = 'float') n_float, count(*) filter (k = 'string') n_string, count(*) filter (k = 'empty') n_empty,
  count(distinct v) filter (k <> 'empty') cardinality from k group by fid, name)
select *, case when n_string > 0 and n_int + n_float > 0 then 'mixed' when cardinality < 2 then 'uniform' when n_string > 0 then 'cat' else 'ord' end kind from a""")
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "lineitem"), PROFILED)


@query("uniform_columns", """
with d as (select 0 fid, 'one' as name, count(distinct one) d from (select 'x' one from customer) c
  union all select 1, 'c_mktsegment', count(distinct c_mktsegment) from customer union all select 2, 'c_custkey', count(distinct c_custkey) from customer)
select fid, name from d where d < 2""")
def uniform_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("one", F.lit("x"))
    return profile.column_profile(c, ["one", "c_mktsegment", "c_custkey"]).where("kind = 'uniform'").select("fid", "name")


@query("cells_long", "select fid, name, count(*) n, count(distinct value) d from (select 0 fid, 'o_orderstatus' as name, o_orderstatus as value from orders union all select 1, 'o_orderpriority', o_orderpriority from orders) c group by fid, name")
def cells_long(spark, sf_dir):
    c = profile.cells(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return c.groupBy("fid", "name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"))


@query("value_histogram", "select event_type, count(*) n from events group by event_type")
def value_histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), "event_type")


@query("value_histogram_sizes", "select p_size, count(*) n from part group by p_size")
def value_histogram_sizes(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "part"), "p_size")


@query("first_samples", "select distinct p_brand from part order by p_brand limit 5")
def first_samples(spark, sf_dir):
    return profile.samples(table(spark, sf_dir, "part"), "p_brand")


@query("category_dictionary", "select event_type v, count(*) n, cast(row_number() over (order by count(*) desc, event_type) - 1 as int) code from events group by event_type")
def category_dictionary(spark, sf_dir):
    return profile.dictionary(table(spark, sf_dir, "events"), "event_type")


@query("category_encode", "with c as (select c_mktsegment v, row_number() over (order by count(*) desc, c_mktsegment) - 1 code from customer group by c_mktsegment) select c_custkey, cast(code as int) code from customer join c on v = c_mktsegment")
def category_encode(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return profile.encode(c, "c_mktsegment", small(profile.dictionary(c, "c_mktsegment")), "code").select("c_custkey", "code")


@query("anonymous_category_encode", """
with t as (select doc_id, case when lang = 'en' then null else lang end v from documents),
c as (select v, row_number() over (order by count(*) desc, v nulls last) - 1 code from t group by v)
select doc_id, cast(code as int) code from t join c on t.v is not distinct from c.v""")
def anonymous_category_encode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("v"))
    return profile.encode(d, "v", small(profile.dictionary(d, "v")), "code").select("doc_id", "code")


@query("rank_breakpoints", "select v, cast(row_number() over (order by v) - 1 as int) \"rank\" from (select distinct l_discount v from lineitem) t")
def rank_breakpoints(spark, sf_dir):
    return profile.breakpoints(table(spark, sf_dir, "lineitem"), "l_discount")


@query("rank_encode", "select l_orderkey, l_linenumber, cast(dense_rank() over (order by l_quantity) - 1 as int) r from lineitem")
def rank_encode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    points = [r["v"] for r in profile.breakpoints(li, "l_quantity").orderBy("v").collect()]
    return profile.rank_encode(li, "l_quantity", points, "r").select("l_orderkey", "l_linenumber", "r")


BOUNDS = [0.0, 1000.0, 2500.0, 5000.0, 7500.0]


@query("rank_encode_bounds", f"select c_custkey, least({' + '.join(f'(case when {b} < c_acctbal then 1 else 0 end)' for b in BOUNDS)}, 4) r from customer")
def rank_encode_bounds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.find_rank(F.array(*map(F.lit, BOUNDS)), F.col("c_acctbal")).alias("r"))


@query("zero_fill_sparse", "select c_custkey, round(coalesce(sum(o_totalprice), 0), 2) spent, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by c_custkey")
def zero_fill_sparse(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


RUNS = """
with s as (select event_id i, event_type v, case when event_type = lag(event_type) over (order by event_id) then 0 else 1 end b from events),
g as (select i, v, sum(b) over (order by i rows between unbounded preceding and current row) g from s)"""


@query("rle_runs", f'{RUNS} select min(i) "start", count(*) length, max(v) as value from g group by g')
def rle_runs(spark, sf_dir):
    return profile.runs(table(spark, sf_dir, "events"), "event_id", "event_type", 1000)


@query("rle_sparse_runs", f"""{RUNS.replace("event_type", "coalesce(k.n, 0)").replace("from events", "from events left join k on event_id = k.i").replace("with s as", "with k as (select event_id i, cast(floor(value) as bigint) n from events where event_type = 'click'), s as")}
select min(i) "start", count(*) length, max(v) as value from g group by g""")
def rle_sparse_runs(spark, sf_dir):
    """The vector of whole values of clicks, 0 at other events, given by its clicks alone."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", F.floor("value").cast("long").alias("n"))
    return profile.sparse_runs(clicks, "event_id", "n", events.count(), F.lit(0).cast("long"), 1000)


@query("rle_expand", "select event_id i, event_type as value from events")
def rle_expand(spark, sf_dir):
    return profile.expand(profile.runs(table(spark, sf_dir, "events"), "event_id", "event_type", 1000))


@query("downsample_histogram")
def downsample_histogram(spark, sf_dir):
    return profile.downsample(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("target_binary", "select doc_id, case when quality = 0 then cast(1 as double) else cast(-1 as double) end y from labels")
def target_binary(spark, sf_dir):
    y, _ = targets.binary_target(table(spark, sf_dir, "labels").withColumn("q", F.col("quality").cast("string")), "q")
    return y.select("doc_id", "y")


@query("target_threshold_gte", "select o_orderkey, case when o_totalprice >= 100000 then cast(1 as double) else cast(-1 as double) end y from orders")
def target_threshold_gte(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", targets.threshold_target(F.col("o_totalprice"), 100000.0).alias("y"))


@query("target_threshold_lte", "select o_orderkey, case when o_totalprice <= 100000 then cast(1 as double) else cast(-1 as double) end y from orders")
def target_threshold_lte(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (-targets.threshold_target(F.col("o_totalprice"), 100000.0, False)).alias("y"))


@query("bit_width", "select p_partkey, cast(case when p_size <= 2 then 1 else ceil(log2(p_size)) end as int) w, cast(ceil(case when p_size <= 2 then 1 else ceil(log2(p_size)) end / 8) as int) b from part")
def bit_width(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.bit_width(n).alias("w"), scalar.byte_width(n).alias("b"))


@query("duration_seconds", "select p_partkey, (p_size + 0.5::double) * (case p_partkey % 5 when 0 then 1 when 1 then 60 when 2 then 3600 when 3 then 86400 else 1 end) s, cast(null as double) bad from part")
def duration_seconds(spark, sf_dir):
    text = F.concat((F.col("p_size") + 0.5).cast("string"), F.get(F.array(*map(F.lit, ["s", "m", "h", "d", ""])), F.pmod("p_partkey", F.lit(5)).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.duration_seconds(text).alias("s"), scalar.duration_seconds(F.lit("soon")).alias("bad"))


@query("parse_descriptor", "select p_partkey, case when p_partkey % 2 = 0 then 'id' else 'name' end kind, case when p_partkey % 2 = 0 then cast(p_partkey as varchar) else p_brand end as value from part")
def parse_descriptor(spark, sf_dir):
    d = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("id:"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("name:"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.descriptor_kind(d).alias("kind"), scalar.descriptor_value(d).alias("value"))


@query("regularize_identifier", "select p_partkey, translate(p_name || '.' || p_brand, '. :-', '____') as name from part")
def regularize_identifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.identifier(F.concat("p_name", F.lit("."), "p_brand")).alias("name"))


@query("quoted_strings", r"""select p_partkey, '"' || replace(replace(p_name || '"\', '\', '\\'), '"', '\"') || '"' q, md5(p_name) m from part""")
def quoted_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.quoted(F.concat("p_name", F.lit('"\\'))).alias("q"), F.md5("p_name").alias("m"))


@query("csv_cell_kind", f"with w as (select doc_id, unnest(string_split(text, ' ')) v from documents) select {KIND.format(v='v')} kind, count(*) n from w group by 1")
def csv_cell_kind(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("v"))
    return w.groupBy(scalar.cell_kind(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


@query("csv_sparse_rows", """
select c_custkey row_id, 0 fid, 'int' kind, cast(c_custkey as varchar) as value from customer
union all select c_custkey, 2, 'string', c_mktsegment from customer
union all select c_custkey, 3, 'int', cast(c_nationkey as varchar) from customer where c_custkey % 2 = 0""")
def csv_sparse_rows(spark, sf_dir):
    from timberline.sources import csvio

    key, even = F.col("c_custkey").cast("string"), F.pmod("c_custkey", F.lit(2)) == 0
    dense = F.concat(key, F.lit(",,'"), "c_mktsegment", F.lit("',"), F.col("c_nationkey").cast("string"), F.lit(" # note"))
    sparse = F.concat(F.lit("{0 "), key, F.lit(', 2 "'), "c_mktsegment", F.lit('"}'))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_no"), F.when(even, dense).otherwise(sparse).alias("line"))
    return csvio.to_cells(csvio.parse(lines)).select("row_id", "fid", "kind", "value")


@query("column_subset_regex", "select l_orderkey, l_quantity, l_extendedprice, l_tax from lineitem")
def column_subset_regex(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*rowsets.select_columns(li.columns, ["i key$", "x ^l_(part|supp)", "i ^l_quantity$", "i price", "i ta", "x status"]))


#: A table's columns as SQL sees them.
HAVE = "(select cast(row_number() over () - 1 as int) fid, column_name as name, case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else lower(column_type) end as type from (describe {t})) h"


@query("feature_lookup", f"select case name when 'p_size' then 'name:p_size' else 'id:5' end descriptor, fid, name, type from {HAVE.format(t='part')} where fid = 5 or name = 'p_size'")
def feature_lookup(spark, sf_dir):
    return rowsets.find_features(rowsets.catalog(table(spark, sf_dir, "part")), ["id:5", "name:p_size"])


@query("feature_exclusion", f"select fid, name from {HAVE.format(t='part')} where not regexp_matches(name, 'brand|type|size')")
def feature_exclusion(spark, sf_dir):
    return rowsets.exclude_features(rowsets.catalog(table(spark, sf_dir, "part")), "brand|type|size").select("fid", "name")


@query("feature_set_ops", "select s_nationkey k, 'both' as what from supplier intersect select c_nationkey, 'both' from customer union select s_nationkey, 'supplier' from (select s_nationkey from supplier except select c_nationkey from customer) e")
def feature_set_ops(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return s.intersect(c).withColumn("what", F.lit("both")).union(s.subtract(c).withColumn("what", F.lit("supplier"))).distinct()


def dear():
    return F.col("o_totalprice") > 100000


def done():
    return F.col("o_orderstatus") == "F"


A_SQL, B_SQL = "o_totalprice > 100000", "o_orderstatus = 'F'"
OPS = {"and": f"({A_SQL}) and ({B_SQL})", "or": f"({A_SQL}) or ({B_SQL})", "xor": f"({A_SQL}) <> ({B_SQL})", "and_not": f"({A_SQL}) and not ({B_SQL})"}


def _bitmap(op: str, sql: str):
    @query(f"bitmap_{op}", f"select o_orderkey, {sql} bit from orders")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", rowsets.combine(dear(), done(), op).alias("bit"))

    return run


for _op, _sql in OPS.items():
    _bitmap(_op, _sql)


@query("bitmap_negate", f"select o_orderkey, not ({A_SQL}) bit from orders")
def bitmap_negate(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (~dear()).alias("bit"))


@query("bitmap_true_rows", f"select o_orderkey from orders where {A_SQL}")
def bitmap_true_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(dear()).select("o_orderkey")


@query("bitmap_from_indexes", "select o_orderkey, o_custkey in (select c_custkey from customer where c_acctbal < 0) bit from orders")
def bitmap_from_indexes(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return rowsets.from_indexes(table(spark, sf_dir, "orders"), "o_custkey", poor, "bit").select("o_orderkey", "bit")


@query("bitmap_density", f"""
with b as (select o_orderkey // 7 b, count(*) n, count(*) filter ({A_SQL}) t from orders group by 1),
k as (select b, n, t, case when t = 0 then '0' when t = n then '1' else 'm' end k from b),
r as (select k, b - row_number() over (partition by k order by b) g from k where k <> 'm')
select cast((select sum(n) from k) as bigint) length, cast((select sum(t) from k) as bigint) n_true, (select count(*) from k where k = 'm') literals, (select count(*) from (select distinct k, g from r) d) uniform_runs""")
def bitmap_density(spark, sf_dir):
    return rowsets.work(table(spark, sf_dir, "orders").withColumn("a", dear()), "o_orderkey", "a").select("length", "n_true", "literals", "uniform_runs")


@query("bitmap_packed_count", f"select count(*) n from orders where {A_SQL}")
def bitmap_packed_count(spark, sf_dir):
    return rowsets.packed(table(spark, sf_dir, "orders").withColumn("a", dear()), "o_orderkey", "a").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query("merge_sorted_streams", "select o_orderdate ts, 'order' src from orders union all select ts, 'event' from events")
def merge_sorted_streams(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    return o.select(F.col("o_orderdate").alias("ts"), F.lit("order").alias("src")).unionAll(e.select("ts", F.lit("event"))).orderBy("ts")


@query("store_decode", "select c_custkey, cast(c_nationkey as varchar) as value from customer")
def store_decode(spark, sf_dir):
    from timberline.sources import store

    catalog, rows = store.build(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")
    return store.decode(catalog, rows, "c_custkey", "c_nationkey").select("c_custkey", "value")


@query("store_brief", """
select '0,c_nationkey,ord,' || count(distinct c_nationkey) line from customer union all select '1,c_mktsegment,cat,' || count(distinct c_mktsegment) from customer""")
def store_brief(spark, sf_dir):
    from timberline.sources import store

    return store.brief(store.build(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")[0])


@query("missing_features", f"select n as name from (values ('c_phone'), ('c_acctbal')) v(n) where n not in (select name from {HAVE.format(t='customer')})")
def missing_features(spark, sf_dir):
    have = rowsets.catalog(table(spark, sf_dir, "customer"))
    return spark.createDataFrame([("c_phone",), ("c_acctbal",)], "name string").join(have, "name", "left_anti")


@query("prediction_lines", "select printf('%.6f', c_acctbal / 10000) line from customer")
def prediction_lines(spark, sf_dir):
    from timberline.sources import csvio

    return csvio.prediction_lines(table(spark, sf_dir, "customer").withColumn("p", F.col("c_acctbal") / 10000), "p").select(F.col("value").alias("line"))


@query("sparse_lines", """
select '{' || concat_ws(', ', case when c_custkey <> 0 then '0 ' || c_custkey end, case when c_nationkey <> 0 then '1 ' || c_nationkey end, '2 "' || c_mktsegment || '"') || '}' line from customer""")
def sparse_lines(spark, sf_dir):
    from timberline.sources import csvio

    c = table(spark, sf_dir, "customer")
    return c.select(csvio.sparse_line(c, ["c_custkey", "c_nationkey", "c_mktsegment"]).alias("line"))


@query("path_basename", "select p_partkey, p_brand as name from part")
def path_basename(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.basename(F.concat(F.lit("/a/b.c/"), "p_brand", F.lit("/"))).alias("name"))


@query("timestamp_text", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as \"at\" from events")
def timestamp_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.timestamp_text(F.col("ts")).alias("at"))


@query("monotone_sets", "select c_nationkey fid, 1 monotone from (select distinct c_nationkey from customer) c where c_nationkey in (select s_nationkey from supplier)")
def monotone_sets(spark, sf_dir):
    """Constraint sets as feature lists: nations of suppliers, as columns, among those of customers."""
    from timberline.operators.splits import Feature, constrained

    nations = [r[0] for r in table(spark, sf_dir, "customer").select("c_nationkey").distinct().collect()]
    up = {f"f_{r[0]}" for r in table(spark, sf_dir, "supplier").select(F.col("s_nationkey")).distinct().collect()} & {f"f_{n}" for n in nations}
    found = constrained([Feature(n, f"f_{n}") for n in nations], up, set())
    return spark.createDataFrame([(f.fid, f.monotone) for f in found if f.monotone], "fid int, monotone int")
