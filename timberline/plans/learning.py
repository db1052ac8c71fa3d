"""Queries of the learning operators over the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.losses import LOSSES
from timberline.functions.scalar import binary_log_loss, probability
from timberline.operators import metrics, splits, targets
from timberline.operators.profile import dictionary, encode
from timberline.operators.splits import Feature, Search
from timberline.operators.tree import Node, Tree, grow
from timberline.plans.durable import small
from timberline.plans.registry import query, table

TARGET = "case when l_returnflag = 'R' then 1.0 else -1.0 end"


def returned(spark, sf_dir: str) -> DataFrame:
    """lineitem with y = +1 for returned rows, one node and the terms of the constant model."""
    li = table(spark, sf_dir, "lineitem").withColumns({"y": F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0), "node": F.lit(1), "q": F.col("l_quantity"), "d": F.col("l_discount"), "t": F.col("l_tax"), "k": F.col("l_linenumber").cast("double")})
    return with_terms(li, "logistic")


def with_terms(df: DataFrame, loss: str) -> DataFrame:
    """df with z, w, l of the constant model; the constant is a one-row aggregate, so its join is a broadcast of one row."""
    base = df.agg(LOSSES[loss].first(F.col("y")).alias("f0")).first()["f0"]
    return df.withColumns(LOSSES[loss].terms(F.col("y"), F.lit(float(base))))


#: Common beginning of SQL for logistic splits: base(node, features, y) must stand before it.
LOGISTIC = """
f0 as (select 0.5 * ln(sum(case when y > 0 then 1.0 else 0.0 end) / sum(case when y < 0 then 1.0 else 0.0 end)) f from base),
zl as (select base.*, 2 * y / (1 + exp(2 * y * f)) z, ln(1 + exp(-2 * y * f)) l from base cross join f0)"""
SCAN = """
agg as (select node, fid, x, count(*) n, sum(z) z, sum(w) w, sum(l) l from u group by node, fid, x),
cum as (select node, fid, x, row_number() over a - 1 pos, sum(n) over a ln_, sum(z) over a lz, sum(w) over a lw, sum(l) over a ll,
  sum(n) over p tn, sum(z) over p tz, sum(w) over p tw, sum(l) over p tl from agg
  window a as (partition by node, fid order by {key} rows between unbounded preceding and current row), p as (partition by node, fid)),
g as (select *, {gl} gl, {gr} gr from cum where ln_ < tn),
sp as (select node, fid, pos, x, ln_, tn, gl, gr, round(ll - {n1}gl * lz + {w1} + (tl - ll) - {n1}gr * (tz - lz) + {w2}, 6) loss from g {where})"""


def scan_sql(loss: str = "logistic", key: str = "x", most: float | None = None, where: str = "") -> str:
    gl, gr = ("lz / lw", "(tz - lz) / (tw - lw)") if loss == "logistic" else ("lz / ln_", "(tz - lz) / (tn - ln_)")
    if most is not None:
        gl, gr = (f"greatest(-{most}, least({most}, {x}))" for x in (gl, gr))
    n1 = "" if loss == "logistic" else "2 * "
    w1, w2 = ("0.5 * gl * gl * lw", "0.5 * gr * gr * (tw - lw)") if loss == "logistic" else ("ln_ * gl * gl", "(tn - ln_) * gr * gr")
    return SCAN.format(key=key, gl=gl, gr=gr, n1=n1, w1=w1, w2=w2, where=where)


U1 = "u as (select node, 0 fid, x, z, abs(z) * (2 - abs(z)) w, l from zl)"
STUMP = "select x, cast(ln_ as bigint) left_n, round(gl, 6) gl, round(gr, 6) gr, round(loss, 3) loss from (select *, row_number() over (order by loss, pos) rk from sp) r where rk = 1"
BASE_Q = f"with base as (select 1 node, cast(l_quantity as double) x, {TARGET} y from lineitem)"


def shown(best: DataFrame, *extra: str) -> DataFrame:
    return best.select(*extra, "x", "left_n", F.round("gl", 6).alias("gl"), F.round("gr", 6).alias("gr"), F.round("loss", 3).alias("loss"))


def stump(obs: DataFrame, feature: Feature, loss: str, most: float | None = None) -> DataFrame:
    return splits.level_best_splits(obs, Search(LOSSES[loss], [feature], most))


@query("best_stump_logistic", f"{BASE_Q}, {LOGISTIC}, {U1}, {scan_sql()} {STUMP}")
def best_stump_logistic(spark, sf_dir):
    return shown(stump(returned(spark, sf_dir), Feature(0, "q"), "logistic"))


@query("best_split_max_gamma", f"{BASE_Q}, {LOGISTIC}, {U1}, {scan_sql(most=0.01)} {STUMP}")
def best_split_max_gamma(spark, sf_dir):
    return shown(stump(returned(spark, sf_dir), Feature(0, "q"), "logistic", 0.01))


@query("best_split_monotone_pos", f"{BASE_Q}, {LOGISTIC}, {U1}, {scan_sql(where='where gr > gl')} {STUMP}")
def best_split_monotone_pos(spark, sf_dir):
    return shown(stump(returned(spark, sf_dir), Feature(0, "q", monotone=1), "logistic"))


@query("best_split_monotone_neg", f"{BASE_Q}, {LOGISTIC}, {U1}, {scan_sql(where='where gr < gl')} {STUMP}")
def best_split_monotone_neg(spark, sf_dir):
    return shown(stump(returned(spark, sf_dir), Feature(0, "q", monotone=-1), "logistic"))


RESIDUAL = "f0 as (select avg(y) f from base), zl as (select base.*, y - f z, (y - f) * (y - f) l from base cross join f0), u as (select node, 0 fid, x, z, 1.0 w, l from zl)"
BASE_O = "with base as (select 1 node, cast(month(o_orderdate) as double) x, o_totalprice y from orders)"


def priced(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("node"), F.month("o_orderdate").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return with_terms(o, "square")


@query("best_stump_square", f"{BASE_O}, {RESIDUAL}, {scan_sql('square')} select x, cast(ln_ as bigint) left_n, round(gl, 4) gl, round(gr, 4) gr from (select *, row_number() over (order by round(loss, -3), pos) rk from sp) r where rk = 1")
def best_stump_square(spark, sf_dir):
    best = splits.level_best_splits(priced(spark, sf_dir), Search(LOSSES["square"], [Feature(0, "x")], digits=-3))
    return best.select("x", "left_n", F.round("gl", 4).alias("gl"), F.round("gr", 4).alias("gr"))


CAT_CODES = "codes as (select v, row_number() over (order by n desc, v) - 1 code from (select {v} v, count(*) n from {t} group by {v}) c)"


def coded(df: DataFrame, column: str, out: str) -> DataFrame:
    return encode(df, column, small(dictionary(df, column)), out)


MEAN_KEY = "round(z / n, 12), x"


@query(
    "best_split_categorical_logistic",
    f"with {CAT_CODES.format(v='o_orderpriority', t='orders')}, base as (select 1 node, cast(code as double) x, case when o_orderstatus = 'F' then 1.0 else -1.0 end y from orders join codes on v = o_orderpriority), {LOGISTIC}, {U1}, {scan_sql(key=MEAN_KEY)} "
    "select cast(ln_ as bigint) left_n, round(gl, 6) gl, round(gr, 6) gr, round(loss, 3) loss from (select *, row_number() over (order by loss, pos) rk from sp) r where rk = 1",
)
def best_split_categorical_logistic(spark, sf_dir):
    o = coded(table(spark, sf_dir, "orders"), "o_orderpriority", "c").withColumns({"node": F.lit(1), "y": F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0)})
    return shown(stump(with_terms(o, "logistic"), Feature(0, "c", "cat"), "logistic")).drop("x")


@query("best_split_categorical_square", """
with base as (select c_mktsegment v, c_acctbal y from customer), f as (select avg(y) f from base),
z as (select v, y - f z, (y - f) * (y - f) l from base cross join f),
a as (select v, count(*) n, sum(z) z, sum(l) l from z group by v),
o as (select v, n, z, l, row_number() over (order by z / n, v) - 1 s from a),
k as (select s, v, sum(n) over w ln_, sum(z) over w lz, sum(n) over () tn, sum(z) over () tz, sum(l) over () tl
  from o window w as (order by s rows between unbounded preceding and current row)),
b as (select *, row_number() over (order by round(tl - lz * lz / ln_ - (tz - lz) * (tz - lz) / (tn - ln_), 3), s) rk from k where ln_ < tn)
select o.v, cast(b.ln_ as bigint) left_n, round(b.lz / b.ln_, 6) gl, round((b.tz - b.lz) / (b.tn - b.ln_), 6) gr from b join o on o.s > b.s where rk = 1""")
def best_split_categorical_square(spark, sf_dir):
    """The categories that go right at the best split, one a row."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("y"), F.lit(1).alias("node"))
    codes = dictionary(c, "c_mktsegment")
    best = splits.level_best_splits(with_terms(encode(c, "c_mktsegment", small(codes), "c"), "square"), Search(LOSSES["square"], [Feature(0, "c", "cat")], digits=3))
    right = best.select("left_n", F.round("gl", 6).alias("gl"), F.round("gr", 6).alias("gr"), F.explode("right_codes").alias("code"))
    return right.join(codes, "code").select("v", "left_n", "gl", "gr")


FOUR = [Feature(0, "q"), Feature(1, "d"), Feature(2, "t"), Feature(3, "k")]
WIDE = "u as (" + " union all ".join(f"select node, {i} fid, {c} x, z, abs(z) * (2 - abs(z)) w, l from zl" for i, c in enumerate("qdtk")) + ")"
BASE_4 = "with base as (select {node} node, {y} y, l_quantity q, l_discount d, l_tax t, cast(l_linenumber as double) k from lineitem)"
ALL = "select node, fid, x, cast(ln_ as bigint) left_n, round(gl, 6) gl, round(gr, 6) gr, round(loss, 3) loss from (select *, row_number() over (partition by node order by loss, fid desc, pos) rk from sp) r where rk = 1"


@query("best_split_all_features", f"{BASE_4.format(node='case when l_linenumber <= 3 then 2 else 3 end', y=TARGET)}, {LOGISTIC}, {WIDE}, {scan_sql()} {ALL}")
def best_split_all_features(spark, sf_dir):
    obs = returned(spark, sf_dir).withColumn("node", F.when(F.col("l_linenumber") <= 3, 2).otherwise(3))
    return shown(splits.level_best_splits(obs, Search(LOSSES["logistic"], FOUR)), "node", "fid")


@query("split_stats_logistic", f"{BASE_Q}, {LOGISTIC} select x, count(*) n, round(sum(z), 4) z, round(sum(abs(z) * (2 - abs(z))), 4) w, round(sum(l), 4) l from zl group by x")
def split_stats_logistic(spark, sf_dir):
    st = splits.stats(returned(spark, sf_dir), [Feature(0, "q")])
    return st.select("x", "n", *(F.round(c, 4).alias(c) for c in "zwl"))


@query("split_stats_square", f"{BASE_O}, {RESIDUAL} select x, count(*) n, round(sum(z), 2) z, round(sum(l) / 1e6, 3) l from u group by x")
def split_stats_square(spark, sf_dir):
    return splits.stats(priced(spark, sf_dir), [Feature(0, "x")]).select("x", "n", F.round("z", 2).alias("z"), F.round(F.col("l") / 1e6, 3).alias("l"))


HASH = "floor(((l_orderkey * 8 + l_linenumber) % 2147483648) * 2654435761 % 4294967296 / 65536)"


def line_key():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


@query("split_stats_half_of_fold", f"""
with h as (select l_quantity x, cast({HASH} as bigint) % 3 fold, cast({HASH.replace('l_linenumber)', 'l_linenumber + 7919)')} as bigint) % 2 half from lineitem)
select x, count(*) n from h where fold <> 0 and half = 0 group by x""")
def split_stats_half_of_fold(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("key", line_key())
    li = targets.random_folds(li, "key", 3).where(F.col("fold") != 0).where(targets.half(F.col("key"), 1))
    return li.groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))


@query("pseudo_response_logistic", """
with base as (select d.doc_id, case when quality = 1 then 1.0 else -1.0 end y from documents d join labels l on d.doc_id = l.doc_id),
f0 as (select 0.5 * ln(sum(case when y > 0 then 1.0 else 0.0 end) / sum(case when y < 0 then 1.0 else 0.0 end)) f from base)
select doc_id, round(2 * y / (1 + exp(2 * y * f)), 6) z, round(ln(1 + exp(-2 * y * f)), 6) l,
  round(abs(2 * y / (1 + exp(2 * y * f))) * (2 - abs(2 * y / (1 + exp(2 * y * f)))), 6) w from base cross join f0""")
def pseudo_response_logistic(spark, sf_dir):
    return with_terms(labelled(spark, sf_dir), "logistic").select("doc_id", *(F.round(c, 6).alias(c) for c in "zlw"))


def labelled(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("y", F.when(F.col("quality") == 1, 1.0).otherwise(-1.0))


@query("residual_square", "select c_custkey, round(c_acctbal - avg(c_acctbal) over (), 4) z from customer")
def residual_square(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("y", F.col("c_acctbal"))
    return with_terms(c, "square").select("c_custkey", F.round("z", 4).alias("z"))


@query("partition_ordinal", "select l_orderkey, l_linenumber, case when l_quantity <= 24 then 2 else 3 end node from lineitem")
def partition_ordinal(spark, sf_dir):
    right = splits.goes_right("ord", F.col("l_quantity"), 24.0, None)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(right, 3).otherwise(2).alias("node"))


@query("partition_categorical", f"with {CAT_CODES.format(v='l_returnflag', t='lineitem')} select l_orderkey, l_linenumber, case when code = 0 then 3 else 2 end node from lineitem join codes on v = l_returnflag")
def partition_categorical(spark, sf_dir):
    right = splits.goes_right("cat", F.col("c"), 0.0, [0])
    return coded(table(spark, sf_dir, "lineitem"), "l_returnflag", "c").select("l_orderkey", "l_linenumber", F.when(right, 3).otherwise(2).alias("node"))


def depth2(spark, sf_dir: str) -> Tree:
    return grow(returned(spark, sf_dir), Search(LOSSES["logistic"], FOUR), 3)


_N0 = f"{BASE_4.format(node='1', y=TARGET)}, {LOGISTIC}, {WIDE}, {scan_sql()}, b1 as (select * from (select *, row_number() over (order by loss, fid desc, pos) rk from sp) r where rk = 1)"
_RIGHT = "(case b1.fid when 0 then q when 1 then d when 2 then t else k end) > b1.x"
_N1 = (
    f"{_N0}, z2 as (select case when {_RIGHT} then 3 else 2 end node, y, q, d, t, k, z, l from zl cross join (select fid, x from b1) b1), "
    + WIDE.replace("u as", "u2 as").replace("from zl", "from z2") + ", "
    + scan_sql().replace("from u ", "from u2 ").replace("agg as", "agg2 as").replace("from agg", "from agg2").replace("cum as", "cum2 as").replace("from cum", "from cum2").replace("g as (select *", "g2 as (select *").replace("from g ", "from g2 ").replace("sp as", "sp2 as")
    + ", b2 as (select * from (select *, row_number() over (partition by node order by loss, fid desc, pos) rk from sp2) r where rk = 1)"
).replace("agg22", "agg2").replace("\nagg2 as", "\nagg2 as")


@query("tree_depth2_nodes", f"{_N1} select node, fid, x, cast(ln_ as bigint) left_n, round(gl, 6) gl, round(gr, 6) gr from (select node, fid, x, ln_, gl, gr from b1 union all select node, fid, x, ln_, gl, gr from b2) n")
def tree_depth2_nodes(spark, sf_dir):
    t = depth2(spark, sf_dir).nodes
    rows = [(i, n.fid, float(n.split), t[2 * i].n, round(t[2 * i].gamma, 6), round(t[2 * i + 1].gamma, 6)) for i, n in t.items() if n.fid is not None]
    return spark.createDataFrame(rows, "node int, fid int, x double, left_n long, gl double, gr double")


@query("tree_score", f"""{_N1}
select cast(y as double) y, round(case when {_RIGHT.replace('b1.', 'b2.')} then b2.gr else b2.gl end, 6) score, count(*) n
from z2 join b2 on z2.node = b2.node group by 1, 2""")
def tree_score(spark, sf_dir):
    obs = returned(spark, sf_dir)
    return obs.groupBy("y", F.round(grow(obs, Search(LOSSES["logistic"], FOUR), 3).column(), 6).alias("score")).agg(F.count("*").alias("n"))


def circle(spark, n: int = 4000) -> DataFrame:
    """row_id, y, fold and two features: inside or outside a circle, from an arithmetic hash."""
    u = lambda s: F.pmod(targets.row_hash(F.col("id") * 17 + s) / 65536, F.lit(41)).cast("int").cast("double")
    df = spark.range(n).select(F.col("id").alias("row_id"), u(1).alias("x1"), u(2).alias("x2"), F.pmod("id", F.lit(2)).cast("int").alias("fold"))
    return df.withColumn("y", F.when((F.col("x1") - 20) * (F.col("x1") - 20) + (F.col("x2") - 20) * (F.col("x2") - 20) <= 100, 1.0).otherwise(-1.0))


def _boosted(folds: int = 2, trees: int = 3, rate: float = 0.3, least: float = 0.001, forget: float = 0.9) -> str:
    """SQL that unrolls boosting of stumps: for each fold a constant and trees - 1 splits, each learned from half of the other
    folds' rows, up to the one whose smoothed gain on the fold is less than `least`. A loss that doubles, and a fold without
    errors, are not in it."""
    h = "cast(floor((doc_id + {seed}) % 2147483648 * 2654435761 % 4294967296 / 65536) as bigint)"
    code = "select {v} v, row_number() over (order by count(*) desc, {v} nulls last) - 1 code from b group by {v}"
    out = [
        "b as (select d.doc_id, lang, source, cast(case when quality = 1 then 1 else -1 end as double) y, floor(ln(greatest(n_chars, 1)) / ln(2) * 4) size from documents d join labels l on d.doc_id = l.doc_id)",
        f"cl as ({code.format(v='lang')})", f"cs as ({code.format(v='source')})",
        f"o as (select doc_id, y, cl.code f0, cs.code f1, size f2, {h.format(seed=0)} % {folds} fold from b join cl on lang is not distinct from cl.v join cs on source is not distinct from cs.v)",
    ]
    for k in range(folds):
        out.append(f"s{k}_0 as (select o.*, (select 0.5 * ln(count(*) filter (y > 0) / count(*) filter (y < 0)) from o where fold <> {k}) f from o)")
        out.append(f"h{k}_0 as (select true kept, cast(0 as double) theta, avg(ln(1 + exp(-2 * y * f))) v from s{k}_0 where fold = {k})")
        weight = 1.0
        for i in range(1, trees):
            at = f"{k}_{i}"
            out += [
                f"z{at} as (select *, 2 * y / (1 + exp(2 * y * f)) z, ln(1 + exp(-2 * y * f)) l from s{k}_{i - 1} where fold <> {k} and {h.format(seed=i * 7919)} % 2 = 0)",
                f"u{at} as (" + " union all ".join(f"select {j} fid, cast(f{j} as double) x, z, abs(z) * (2 - abs(z)) w, l from z{at}" for j in range(3)) + ")",
                f"a{at} as (select fid, x, count(*) n, sum(z) z, sum(w) w, sum(l) l from u{at} group by fid, x)",
                f"""c{at} as (select fid, x, row_number() over a pos, sum(n) over a ln_, sum(z) over a lz, sum(w) over a lw, sum(l) over a ll,
  sum(n) over p tn, sum(z) over p tz, sum(w) over p tw, sum(l) over p tl from a{at}
  window a as (partition by fid order by case when fid < 2 then round(z / n, 12) else x end, x rows between unbounded preceding and current row), p as (partition by fid))""",
                f"g{at} as (select *, lz / lw gl, (tz - lz) / (tw - lw) gr from c{at} where ln_ < tn and lw <> 0 and tw <> lw)",
                f"t{at} as (select * from g{at} order by round(tl - gl * lz + 0.5 * gl * gl * lw - gr * (tz - lz) + 0.5 * gr * gr * (tw - lw), 6), fid desc, pos limit 1)",
                f"r{at} as (select c.x from c{at} c join t{at} t on c.fid = t.fid and c.pos > t.pos)",
                f"""s{at} as (select s.doc_id, y, f0, f1, f2, fold, f + {rate} * case when case t.fid when 2 then f2 > t.x when 0 then f0 in (from r{at}) else f1 in (from r{at}) end then gr else gl end f
  from s{k}_{i - 1} s cross join t{at} t)""",
                f"v{at} as (select avg(ln(1 + exp(-2 * y * f))) v from s{at} where fold = {k})",
                f"""h{at} as (select kept and theta >= {least} kept, theta, v
  from (select kept, theta + {weight!r} * ((h.v - n.v) / n.v - theta) theta, n.v from h{k}_{i - 1} h cross join v{at} n) x)""",
            ]
            weight /= forget + weight
    mean = " + ".join("case " + " ".join(f"when (select kept from h{k}_{i}) then m{k}_{i}.f" for i in reversed(range(trees))) + " end" for k in range(folds))
    joins = " ".join(f"join s{k}_{i} m{k}_{i} on o.doc_id = m{k}_{i}.doc_id" for k in range(folds) for i in range(trees))
    return "with " + ",\n".join(out) + f"\nselect o.doc_id, round(cast(1 / (1 + exp(-2 * ({mean}) / {folds})) as double), 6) p from o {joins}"


@query("boost_3_trees_score", _boosted())
def boost_3_trees_score(spark, sf_dir):
    """Scores of a small ensemble over the labelled documents."""
    from timberline.operators.boost import Config, learn

    d = coded(coded(labelled(spark, sf_dir), "lang", "c_lang"), "source", "c_source")
    d = d.select("doc_id", F.col("doc_id").alias("row_id"), "y", "c_lang", "c_source", F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)) + 0.0) * 4).cast("double").alias("size"))
    obs = targets.random_folds(d, "row_id", 2)
    features = [Feature(0, "c_lang", "cat"), Feature(1, "c_source", "cat"), Feature(2, "size")]
    trees, _ = learn(obs, features, Config(max_trees=3, rate=0.3))
    f = sum((t.column() for t in trees[1:]), trees[0].column())
    return obs.select("doc_id", F.round(probability(f), 6).alias("p"))


@query("folds_random", f"select cast(cast({HASH} as bigint) % 3 as int) fold, count(*) n from lineitem group by 1")
def folds_random(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("key", line_key())
    return targets.random_folds(li, "key", 3).groupBy("fold").agg(F.count("*").alias("n"))


@query("folds_even", "select cast((row_number() over (order by (c_custkey % 2147483648) * 2654435761 % 4294967296, c_custkey) - 1) % 4 as int) fold, c_custkey from customer")
def folds_even(spark, sf_dir):
    return targets.even_folds(table(spark, sf_dir, "customer"), "c_custkey", 4).select("fold", "c_custkey")


@query("folds_by_rank", "with r as (select *, dense_rank() over (order by l_discount) - 1 rk from lineitem) select cast(floor(rk / 5) as int) fold, count(*) n from r group by 1")
def folds_by_rank(spark, sf_dir):
    from timberline.operators.profile import breakpoints, rank_encode

    li = table(spark, sf_dir, "lineitem")
    points = [r["v"] for r in breakpoints(li, "l_discount").orderBy("v").collect()]
    return rank_encode(li, "l_discount", points, "rk").groupBy(targets.rank_folds(F.col("rk"), len(points), 2).alias("fold")).agg(F.count("*").alias("n"))


@query("folds_by_category", f"with {CAT_CODES.format(v='o_orderpriority', t='orders')} select cast(code % 2 as int) fold, count(*) n from orders join codes on v = o_orderpriority group by 1")
def folds_by_category(spark, sf_dir):
    return coded(table(spark, sf_dir, "orders"), "o_orderpriority", "c").groupBy(targets.code_folds(F.col("c"), 5, 2).alias("fold")).agg(F.count("*").alias("n"))


@query("fold_metrics_logistic", """
with s as (select case when l_returnflag = 'R' then 1.0 else -1.0 end y, (l_quantity - 25) / 50 f, l_linenumber % 2 fold from lineitem)
select fold <> 0 working, count(*) n, round(avg(ln(1 + exp(-2 * y * f))), 6) mean_loss,
  round(avg(case when y > 0 and f >= 0 then 1.0 else 0.0 end), 6) tt, round(avg(case when y > 0 and f < 0 then 1.0 else 0.0 end), 6) tf,
  round(avg(case when y <= 0 and f >= 0 then 1.0 else 0.0 end), 6) ft, round(avg(case when y <= 0 and f < 0 then 1.0 else 0.0 end), 6) ff from s group by 1""")
def fold_metrics_logistic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"), ((F.col("l_quantity") - 25) / 50).alias("f"), F.pmod("l_linenumber", F.lit(2)).alias("fold"))
    return metrics.fold_table(li, 0, "logistic").select("working", "n", *(F.round(c, 6).alias(c) for c in ("mean_loss", "tt", "tf", "ft", "ff")))


@query("fold_metrics_square", "select l_linenumber % 2 <> 0 working, count(*) n, round(avg((l_tax - l_discount) * (l_tax - l_discount)), 8) mean_loss from lineitem group by 1")
def fold_metrics_square(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("y"), F.col("l_discount").alias("f"), F.pmod("l_linenumber", F.lit(2)).alias("fold"))
    return metrics.fold_table(li, 0, "square").select("working", "n", F.round("mean_loss", 8).alias("mean_loss"))



def by_length():
    """A made-up probability: longer is better."""
    return F.col("n_chars") / (F.col("n_chars") + 2000)


P_SQL = "(select quality y, cast(n_chars as double) / (n_chars + 2000) p from documents d join labels l on d.doc_id = l.doc_id)"


@query("confusion_marginals", f"with c as (select y, case when p >= 0.5 then 1 else 0 end call from {P_SQL} t) select coalesce(y, -1) y, coalesce(call, -1) call, count(*) n, round(cast(count(*) as double) / (select count(*) from c), 6) share from c group by cube (y, call)")
def confusion_marginals(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir), F.col("quality"), by_length()).select(F.coalesce("y", F.lit(-1)).alias("y"), F.coalesce("call", F.lit(-1)).alias("call"), "n", F.round("share", 6).alias("share"))


@query("auc", f"""
with g as (select p, sum(case when y = 1 then cast(1 as double) else cast(0 as double) end) tp, sum(case when y = 0 then cast(1 as double) else cast(0 as double) end) fp from {P_SQL} t group by p),
w as (select p, tp, fp, sum(tp) over (order by p desc rows between unbounded preceding and current row) ctp from g)
select round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 6) auc from w""")
def auc(spark, sf_dir):
    return metrics.auc(labelled(spark, sf_dir), F.col("quality"), by_length()).select(F.round("auc", 6).alias("auc"))


@query("log_loss", f"""
with p as (select case when y = 1 then case when p > 1e-8 then -ln(p) end else case when p < 1 - 1e-8 then -ln(1 - p) end end l from {P_SQL} t)
select round(avg(l), 6) finite, count(*) filter (l is null) n_infinite, count(*) n from p""")
def log_loss(spark, sf_dir):
    """Certain and wrong predictions cost infinitely much; the mean of the others is beside their number."""
    l = binary_log_loss(by_length(), F.col("quality") == 1)
    rows = labelled(spark, sf_dir).select(l.alias("l"))
    endless = F.col("l") == float("inf")
    return rows.agg(F.round(F.avg(F.when(~endless, F.col("l"))), 6).alias("finite"), F.count_if(endless).alias("n_infinite"), F.count("*").alias("n"))


@query("convergence_ewma", """
with d as (select cast(l_shipdate as date) d, round(sum(l_quantity), 2) q from lineitem group by 1),
t as (select d, q, row_number() over (order by d) - 1 t from d)
select d, round(sum(q * pow(0.9, -t)) over w / sum(pow(0.9, -t)) over w, 3) smoothed from t window w as (order by t rows between unbounded preceding and current row)""")
def convergence_ewma(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy(F.col("l_shipdate").cast("date").alias("d")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return metrics.ewma(d, "d", "q", 0.9).select("d", F.round("smoothed", 3).alias("smoothed"))


FOREST = [
    Tree({1: Node(0.0, fid=0, column="c_acctbal", split=3000.0), 2: Node(-0.3), 3: Node(0, fid=1, column="c_nationkey", split=11.0), 6: Node(0.2), 7: Node(0.4)}),
    Tree({1: Node(0.0, fid=1, column="c_nationkey", split=5.0), 2: Node(0.1), 3: Node(0, fid=1, column="c_nationkey", split=17.0), 6: Node(-0.25), 7: Node(0.05)}),
]

#: Leaves of the tree grown on lineitem: number, gamma, the features on the path (f2: none where a child of the root is a leaf).
LEAVES_SQL = f"""{_N1}, leaves as (
  select 2 * node leaf, gl gamma, (select fid from b1) f1, fid f2 from b2 union all select 2 * node + 1, gr, (select fid from b1), fid from b2
  union all select 2, gl, fid, null from b1 where 2 not in (select node from b2) union all select 3, gr, fid, null from b1 where 3 not in (select node from b2))"""


@query("feature_importance", f"""{LEAVES_SQL},
p as (select gamma g, case when f2 is null then 1 else 2 end k, f1 fid from leaves union all select gamma, 2, f2 from leaves where f2 is not null),
s as (select fid, sum(abs(g) / k) u, sum(case when g > 0 then g / k else 0 end) p, sum(case when g < 0 then -g / k else 0 end) m from p group by fid)
select cast(fid as int) fid, round(cast(u / sum(u) over () as double), 6) unsigned_, round(cast(p / sum(p) over () as double), 6) positive, round(cast(m / sum(m) over () as double), 6) negative from s""")
def feature_importance(spark, sf_dir):
    paths = spark.createDataFrame(depth2(spark, sf_dir).paths(), "leaf int, gamma double, fids array<int>")
    return metrics.importance(paths).select("fid", *(F.round(c, 6).alias(c) for c in ("unsigned_", "positive", "negative")))


#: FOREST, written down by hand.
F_SQL = """case when c_acctbal > 3000 then case when c_nationkey > 11 then 0.4::double else 0.2::double end else -0.3::double end
  + case when c_nationkey > 5 then case when c_nationkey > 17 then 0.05::double else -0.25::double end else 0.1::double end"""


@query("forest_score_case", f"select c_custkey, round(cast(1 / (1 + exp(-2 * ({F_SQL}))) as double), 6) p from customer")
def forest_score_case(spark, sf_dir):
    f = FOREST[0].column() + FOREST[1].column()
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(probability(f), 6).alias("p"))


@query("score_inverted", f"select c_custkey, round(cast(1 - 1 / (1 + exp(-2 * ({F_SQL}))) as double), 6) p from customer")
def score_inverted(spark, sf_dir):
    from timberline.sources.model import Model

    return Model(FOREST, "Y", "N").score(table(spark, sf_dir, "customer"), positive="N").select("c_custkey", F.round("score", 6).alias("p"))


@query("score_logodds", f"select c_custkey, round(cast(2 * ({F_SQL}) as double), 6) p from customer")
def score_logodds(spark, sf_dir):
    from timberline.sources.model import Model

    return Model(FOREST, "Y", "N").score(table(spark, sf_dir, "customer"), link="log_odds").select("c_custkey", F.round("score", 6).alias("p"))


@query("rank_tree_to_values", """
with b as (select v, row_number() over (order by v) - 1 rk from (select distinct l_tax v from lineitem) t)
select cast(case when l_tax > (select v from b where rk = 3) then 0.5 else -0.5 end as double) score, count(*) n from lineitem group by 1""")
def rank_tree_to_values(spark, sf_dir):
    from timberline.operators.profile import breakpoints

    li = table(spark, sf_dir, "lineitem")
    points = {0: [r["v"] for r in breakpoints(li, "l_tax").orderBy("v").collect()]}
    t = Tree({1: Node(0, fid=0, column="f_0", split=3), 2: Node(-0.5), 3: Node(0.5)}).in_values(points, {0: "l_tax"})
    return li.groupBy(F.round(t.column(), 6).alias("score")).agg(F.count("*").alias("n"))


@query("tree_shrunk_leaves", f"{LEAVES_SQL} select cast(leaf as int) leaf, round(cast(gamma * 0.05 as double), 8) gamma from leaves")
def tree_shrunk_leaves(spark, sf_dir):
    return spark.createDataFrame([(i, round(n.gamma, 8)) for i, n in depth2(spark, sf_dir).shrink(0.05).leaves().items()], "leaf int, gamma double")


@query("target_regression", "select l_orderkey, l_linenumber, cast(l_quantity as double) y from lineitem")
def target_regression(spark, sf_dir):
    """A regression target read back from its breakpoints."""
    from timberline.operators.profile import breakpoints, rank_encode

    li = table(spark, sf_dir, "lineitem")
    points = [r["v"] for r in breakpoints(li, "l_quantity").orderBy("v").collect()]
    return rank_encode(li, "l_quantity", points, "r").select("l_orderkey", "l_linenumber", targets.regression_target(F.col("r"), "ord", points).alias("y"))


@query("target_binary_ordinal", "select doc_id, case when quality = 1 then cast(1 as double) else cast(-1 as double) end y from labels")
def target_binary_ordinal(spark, sf_dir):
    return targets.binary_target(table(spark, sf_dir, "labels"), "quality")[0].select("doc_id", "y")
