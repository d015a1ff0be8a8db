"""Registered queries of the engine's operators, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import classify, dictionary, evaluate, images, learn, pooling, preprocess
from ..operators.encode import FeatureEncoder, SparseEncoder, correlations, long_codes, matrix, top_k
from ..operators.encode import grad_step as step_codes
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def r6s(x):
    return F.transform(x, r6)


def exploded(df: DataFrame, x: str = "x", *keys: str) -> DataFrame:
    """One row an element, for comparison."""
    return df.select(*(keys or ("id",)), F.posexplode(x).alias("p", "v")).withColumn("v", r6(F.col("v")))


def sql_exploded(source: str, keys: str = "id") -> str:
    """The same of a source with a list column x."""
    return f"select {keys}, cast(u.p - 1 as integer) as p, round(u.v, 6) + 0.0 as v from (select {keys}, unnest(list_transform(x, lambda v, i: {{'p': i, 'v': v}})) as u from {source})"


def codes_of(name: str, params: dict, spark: SparkSession, d: str) -> DataFrame:
    return long_codes(SparseEncoder(name, params).encode(T.signals(spark, d), T.atoms(spark, d))).withColumn("z", r6(F.col("z")))


W = T.with_

# ---------------------------------------------------------------- vectors


@query(f"{W('a', 's', 'c')} select id, k, round(a, 6) + 0.0 as a from c")
def vec_dot(spark, d):
    return correlations(T.signals(spark, d), T.atoms(spark, d)).withColumn("a", r6(F.col("a")))


@query(f"{W('e')} select cast(i as integer) as i, cast(j as integer) as j, round(sum(x[i + 1] * x[j + 1]), 6) + 0.0 as v from e, (select unnest(range(64)) as i), (select unnest(range(64)) as j) group by all")
def vec_outer(spark, d):
    """The outer products of all vectors with themselves, added up."""
    rows = T.vectors(spark, d).select(F.posexplode(V.outer(F.col("x"), F.col("x"))).alias("i", "row"))
    return rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(r6(F.sum("v")).alias("v"))


@query(f"{W('nn')} select id, round(n, 6) + 0.0 as n from nn")
def vec_norm(spark, d):
    return T.vectors(spark, d).select("id", r6(V.norm(F.col("x"))).alias("n"))


@query("select round(sum(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax) / 1e9, 3) + 0.0 as f from (select cast(l_quantity as double) as l_quantity, cast(l_extendedprice as double) as l_extendedprice, cast(l_discount as double) as l_discount, cast(l_tax as double) as l_tax from lineitem)")
def frobenius(spark, d):
    x = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.agg((F.round(F.sum(V.sqnorm(x)) / 1e9, 3) + F.lit(0.0)).alias("f"))


@query(f"{W('nn')} {sql_exploded('(select id, list_transform(x, lambda v: v / (n + 2.220446049250313e-16)) as x from nn)')}")
def l2_normalize(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "normalization"))


_LONG = "l as (select id, u.p as p, u.v as v from (select id, unnest(list_transform(x, lambda v, i: {'p': i, 'v': v})) as u from e))"


@query(f"{W('e')}, {_LONG} select id, cast(p - 1 as integer) as p, round(v - avg(v) over (partition by p), 6) + 0.0 as v from l")
def global_center(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "global_centering"))


@query(f"{W('e')}, {_LONG} select id, cast(p - 1 as integer) as p, round((v - avg(v) over (partition by p)) / stddev_pop(v) over (partition by p), 6) + 0.0 as v from l")
def global_standardize(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "global_standarization"))


_CENTRED = "m as (select id, list_transform(x, lambda v: v - a) as x from (select id, x, list_avg(x) as a from e))"


@query(f"{W('e')}, {_CENTRED} {sql_exploded('m')}")
def local_center(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "local_centering"))


@query(f"{W('e')}, {_CENTRED}, q as (select id, x, sqrt(list_inner_product(x, x)) as n from m) {sql_exploded('(select id, list_transform(x, lambda v: v / (n + 2.220446049250313e-16)) as x from q)')}")
def contrast_normalize(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "contrast_normalization"))


@query(f"{W('e')} {sql_exploded('(select id, list_transform(x, lambda v: v / 255) as x from e)')}")
def scale255(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "scaling"))


@query(f"{W('e')}, {_CENTRED}, q as (select id, x, sqrt(list_inner_product(x, x) / len(x)) as sd from m), f as (select (2 * min(sd) + avg(sd)) / 3 as f from q) {sql_exploded('(select id, list_transform(x, lambda v: v / g) as x from (select id, x, greatest(sd, f) as g from q, f))')}")
def lcn(spark, d):
    return exploded(preprocess.local_contrast(T.vectors(spark, d)))


def _pairs(spark, d):
    a = T.tiny_images(spark, d).select("img_id", "px")
    b = T.tiny_images(spark, d).select((F.col("img_id") - 1).alias("img_id"), F.col("px").alias("other"))
    return a.join(b, "img_id")


_TINY = "t as (select id as img_id, list_transform(x, lambda v: floor(255 * (v + 1) / 2)) as px from e)"


@query(f"{W('e')}, {_TINY}, p as (select t.img_id, list_transform(t.px, lambda v: v / 255) as a, list_transform(u.px, lambda v: v / 255) as b from t join t u on u.img_id = t.img_id + 1), m as (select img_id, list_inner_product(list_transform(a, lambda v, i: v - b[i]), list_transform(a, lambda v, i: v - b[i])) / 64 as m from p) select img_id, round(m, 6) + 0.0 as mse, round(-10 * log10(m), 6) + 0.0 as psnr from m")
def mse_psnr(spark, d):
    return _pairs(spark, d).select("img_id", r6(V.mse(F.col("px"), F.col("other"))).alias("mse"), r6(V.psnr(F.col("px"), F.col("other"))).alias("psnr"))


@query(f"{W('e')} select id, cast(u.p - 1 as integer) as p, cast(u.v as integer) as v from (select id, unnest(list_transform(x, lambda v, i: {{'p': i, 'v': trunc(least(greatest(v * 400, 0), 255))}})) as u from e)")
def clip_u8(spark, d):
    return T.vectors(spark, d).select("id", F.posexplode(V.to_uint8(F.transform("x", lambda v: v * 400))).alias("p", "v"))


@query(f"{W('e')}, {_TINY} select img_id, cast(p as integer) as p, px[p - p % 8 + 8 - p % 8] as v from t, (select unnest(range(64)) as p)")
def hflip(spark, d):
    return T.tiny_images(spark, d).select("img_id", F.posexplode(V.flip_horizontal(F.col("px"), 8)).alias("p", "v"))


@query(f"{W('e')} {sql_exploded('(select id, list_transform(x, lambda v: sign(v) * greatest(abs(v) - 0.05, 0)) as x from e)')}")
def soft_threshold(spark, d):
    return exploded(T.vectors(spark, d).withColumn("x", V.soft_threshold(F.col("x"), 0.05)))


# ---------------------------------------------------------------- filters


@query(f"{W('e')} select id from e where list_inner_product(x, x) > 1e-6")
def nonzero_signals(spark, d):
    return dictionary.nonzero(T.vectors(spark, d)).select("id")


@query("select vec_id as id from embeddings where label = 3")
def class_filter(spark, d):
    return T.vectors(spark, d).where(F.col("label") == 3).select("id")


_TOP2 = "t as (select id, k, a from (select *, row_number() over (partition by id order by a desc, k) as r from c) where r <= 2)"


@query(f"{W('a', 's', 'c')}, {_TOP2} select id from t where k = 5")
def atom_support(spark, d):
    codes = SparseEncoder("thresh", {"n_nonzero_coefs": 2}).encode(T.signals(spark, d), T.atoms(spark, d))
    return dictionary.support(codes, 5).select("id")


@query(f"{W('a', 's', 'c')}, t as (select id, k from (select *, row_number() over (partition by id order by a desc, k) as r from c) where r <= 1) select k from a where k not in (select k from t)")
def unused_atoms(spark, d):
    codes = SparseEncoder("thresh", {"n_nonzero_coefs": 1}).encode(T.signals(spark, d), T.atoms(spark, d))
    return dictionary.unused_atoms(T.atoms(spark, d), codes).select("k")


@query(f"{W('ca')} select k from ca where cls = 4")
def class_atom_range(spark, d):
    sizes = [r["count"] for r in T.class_atoms(spark, d).groupBy("cls").count().orderBy("cls").collect()]
    return spark.createDataFrame([(k,) for k in dictionary.class_atoms(sizes, 4)], "k int")


# ---------------------------------------------------------------- grids


@query("select cast(i as bigint) as i, cast(((64 - 8) // i + 1) * ((48 - 8) // i + 1) as bigint) as n, cast(least(((64 - 8 + 4) // i + 1) * ((48 - 8 + 4) // i + 1), 100) as bigint) as capped from (select unnest(range(1, 20)) as i)")
def n_patches(spark, d):
    count = lambda padding: V.n_patches(F.lit(64), F.lit(48), (8, 8), (F.col("i"), F.col("i")), padding)
    return spark.range(1, 20).select(F.col("id").alias("i")).select("i", count(False).alias("n"), F.least(count(True), F.lit(100).cast("long")).alias("capped"))


@query("select cast(row_number() over (order by y, x) - 1 as integer) as pos, cast(y as integer) as py, cast(x as integer) as px from (select unnest(range(0, 57, 6)) as y), (select unnest(range(0, 41, 6)) as x)")
def grid_loc(spark, d):
    one = spark.range(1).select(F.posexplode(V.grid_places(F.lit(64), F.lit(48), (8, 8), (6, 6))).alias("pos", "at"))
    return one.select("pos", "at.py", "at.px")


_PATCH = """pt as (select img_id, y, x, px from t, (select unnest(range(0, 6, 2)) as y), (select unnest(range(0, 6, 2)) as x))
    select img_id, cast((y // 2) * 3 + x // 2 as integer) as pos, cast(p as integer) as p, px[(y + p // 3) * 8 + x + p % 3 + 1] as v from pt, (select unnest(range(9)) as p)"""


@query(f"{W('e')}, {_TINY}, {_PATCH}")
def grid_patches(spark, d):
    out = images.grid_patches(T.tiny_images(spark, d), (3, 3), (2, 2))
    return out.select("img_id", "pos", F.posexplode("x").alias("p", "v"))


@query("select vec_id as id, cast((row_number() over (order by vec_id) - 1) // 64 as integer) as batch from embeddings")
def batch_ids(spark, d):
    return learn.batches(T.vectors(spark, d).select("id"), 64)[0].select("id", F.col("batch").cast("int").alias("batch"))


# ---------------------------------------------------------------- coders


@query(f"{W('a', 'g')} select k1, k2, round(g, 6) + 0.0 as g from g")
def gram(spark, d):
    return dictionary.gram(T.atoms(spark, d)).withColumn("g", r6(F.col("g")))


@query(f"{W('a', 's', 'c')} select id, k, round(a, 6) + 0.0 as a from c")
def alpha(spark, d):
    return correlations(T.signals(spark, d), T.atoms(spark, d)).withColumn("a", r6(F.col("a")))


@query(f"{W('a', 's', 'c')} select id, k, round(a, 6) + 0.0 as z from (select *, row_number() over (partition by id order by a desc, k) as r from c) where r <= 3")
def thresh_topk(spark, d):
    return top_k(correlations(T.signals(spark, d), T.atoms(spark, d)), 3).withColumn("z", r6(F.col("z")))


@query(f"{W('a', 's', 'c')} select id, k, round(a, 6) + 0.0 as z from (select *, row_number() over (partition by id order by a desc, k) as r from c) where r <= 3")
def feature_encode(spark, d):
    out = FeatureEncoder("soft_thresholding", {"n_nonzero_coefs": 3}).encode(T.signals(spark, d), T.atoms(spark, d))
    return long_codes(out).withColumn("z", r6(F.col("z")))


_ONE = "f as (select id, k, a from (select *, row_number() over (partition by id order by abs(a) desc, k) as r from c) where r = 1)"


@query(f"{W('a', 's', 'c')}, {_ONE} select id, k, round(a, 6) + 0.0 as z from f")
def omp_k1(spark, d):
    return codes_of("omp", {"n_nonzero_coefs": 1}, spark, d)


_TWO = """r2 as (select c.id, c.k, f.k as k1, f.a as a1, c.a as a2, g.g, c.a - g.g * f.a as res from c join f on c.id = f.id join g on g.k1 = f.k and g.k2 = c.k where c.k <> f.k),
    b2 as (select * from (select *, row_number() over (partition by id order by {score} desc, k) as r from r2) where r = 1)
    select id, k1 as k, round((a1 - g * a2) / (1 - g * g), 6) + 0.0 as z from b2 union all select id, k, round((a2 - g * a1) / (1 - g * g), 6) + 0.0 from b2"""
_OMP2 = f"{W('a', 's', 'c', 'g')}, {_ONE}, {_TWO.format(score='abs(res)')}"


@query(_OMP2)
def omp_k2(spark, d):
    return codes_of("omp", {"n_nonzero_coefs": 2}, spark, d)


@query(_OMP2)
def bomp_k2(spark, d):
    """Batch-OMP with two atoms a signal."""
    return codes_of("bomp", {"n_nonzero_coefs": 2}, spark, d)


@query(f"{W('a', 's', 'c', 'g')}, {_ONE}, {_TWO.format(score='abs(res) / sqrt(1 - g * g)')}")
def ormp_k2(spark, d):
    return codes_of("ormp", {"n_nonzero_coefs": 2}, spark, d)


@query(f"{W('a', 's', 'c')}, {_ONE} select f.id, f.k, round(f.a, 6) + 0.0 as z from f join s on s.id = f.id where sqrt(list_inner_product(s.x, s.x)) >= 0.9999995")
def omp_tol(spark, d):
    """OMP under a tolerance that one atom reaches: signals below it stay without a code."""
    out = SparseEncoder("omp", {"tol": 0.9999995}).encode(T.signals(spark, d), T.atoms(spark, d))
    return long_codes(out).withColumn("z", r6(F.col("z")))


def _recurrence(k: int) -> str:
    """OMP with k atoms of unit norm, by the Cholesky recurrence written out."""
    q = f"{W('a', 's', 'c', 'g')}, x1 as (select id, k, a from c)"
    sel = []
    for t in range(1, k + 1):
        prev = " and ".join(f"x{t}.k <> p{u}.k" for u in range(1, t)) or "true"
        joins = " ".join(f"join p{u} on p{u}.id = x{t}.id" for u in range(1, t))
        q += f", p{t} as (select id, k, a from (select x{t}.id, x{t}.k, x{t}.a, row_number() over (partition by x{t}.id order by abs(x{t}.a) desc, x{t}.k) as r from x{t} {joins} where {prev}) where r = 1)"
        terms = "".join(f" - w{u}p.w * w{u}c.w" for u in range(1, t))
        own = "".join(f" - w{u}p.w * w{u}p.w" for u in range(1, t))
        wj = " ".join(f"join w{u} w{u}p on w{u}p.id = p{t}.id and w{u}p.k = p{t}.k join w{u} w{u}c on w{u}c.id = p{t}.id and w{u}c.k = g.k2" for u in range(1, t))
        q += f", w{t} as (select p{t}.id, g.k2 as k, (g.g{terms}) / sqrt(1{own}) as w, p{t}.a / sqrt(1{own}) as v from p{t} join g on g.k1 = p{t}.k {wj})"
        q += f", x{t + 1} as (select x{t}.id, x{t}.k, x{t}.a - w{t}.w * w{t}.v as a from x{t} join w{t} on w{t}.id = x{t}.id and w{t}.k = x{t}.k)"
    for t in range(k, 0, -1):
        # z_t = (v_t - sum over later u of L[u, t] z_u) / L[t, t], with L[u, t] the t-th w at the u-th atom
        later = "".join(f" - lu{u}.w * z{u}.z" for u in range(t + 1, k + 1))
        lj = " ".join(f"join p{u} on p{u}.id = p{t}.id join w{t} lu{u} on lu{u}.id = p{t}.id and lu{u}.k = p{u}.k join z{u} on z{u}.id = p{t}.id" for u in range(t + 1, k + 1))
        q += f", z{t} as (select p{t}.id, p{t}.k, (d.v{later}) / d.w as z from p{t} join w{t} d on d.id = p{t}.id and d.k = p{t}.k {lj})"
        sel.append(f"select id, k, round(z, 6) + 0.0 as z from z{t}")
    return q + " " + " union all ".join(sel)


@query(_recurrence(3))
def omp_k3(spark, d):
    return codes_of("omp", {"n_nonzero_coefs": 3}, spark, d)


@query(_recurrence(3))
def bomp_k3(spark, d):
    return codes_of("bomp", {"n_nonzero_coefs": 3}, spark, d)


_IHT = """z0 as (select id, k, a as z from (select *, row_number() over (partition by id order by a desc, k) as r from c) where r <= 3)"""


def _iht_sql(steps: int) -> str:
    q = f"{W('a', 's', 'c', 'g')}, {_IHT}"
    for i in range(steps):
        q += f""", n{i} as (select c.id, c.k, coalesce(z.z, 0) + 0.5 * (c.a - coalesce(b.b, 0)) as z from c left join z{i} z on z.id = c.id and z.k = c.k
                 left join (select z{i}.id, g.k2 as k, sum(z{i}.z * g.g) as b from z{i} join g on g.k1 = z{i}.k group by all) b on b.id = c.id and b.k = c.k),
             z{i + 1} as (select id, k, z from (select *, row_number() over (partition by id order by abs(z) desc, k) as r from n{i}) where r <= 3)"""
    return q + f" select id, k, round(z, 6) + 0.0 as z from z{steps}"


@query(_iht_sql(4))
def iht(spark, d):
    return codes_of("iht", {"n_nonzero_coefs": 3, "eta": 0.5, "n_iter": 4}, spark, d)


@query(f"""{W('a', 's', 'c')}, best as (select grp, k from (select id // 8 as grp, k, row_number() over (partition by id // 8 order by sum(a * a) desc, k) as r from c group by 1, 2) where r = 1)
    select c.id, c.k, round(c.a, 6) + 0.0 as z from c join best on best.grp = c.id // 8 and best.k = c.k""")
def somp_k1(spark, d):
    rows = T.signals(spark, d).withColumn("grp", F.floor(F.col("id") / 8))
    return long_codes(SparseEncoder("somp", {"n_nonzero_coefs": 1}).encode(rows, T.atoms(spark, d))).withColumn("z", r6(F.col("z")))


@query(f"""{W('a', 's')}, dd as (select s.id, a.k, list_transform(a.d, lambda v, i: v - s.x[i]) as e from s, a),
    near as (select *, row_number() over (partition by id order by list_inner_product(e, e), k) as r from dd),
    p as (select u.id, u.k as k1, v.k as k2, list_inner_product(u.e, u.e) as c11, list_inner_product(v.e, v.e) as c22, list_inner_product(u.e, v.e) as c12 from near u join near v on u.id = v.id where u.r = 1 and v.r = 2),
    q as (select id, k1, k2, c12, c11 + 1e-4 * (c11 + c22) as a, c22 + 1e-4 * (c11 + c22) as b from p)
    select id, k1 as k, round((b - c12) / (a + b - 2 * c12), 6) + 0.0 as z from q union all select id, k2, round((a - c12) / (a + b - 2 * c12), 6) + 0.0 from q""")
def llc_knn2(spark, d):
    return codes_of("llc", {"knn": 2}, spark, d)


@query(f"{W('a', 's', 'c', 'g')}, {_ONE} select c.id, c.k, round(case when c.k = f.k then f.a else 0 end + 0.1 * (c.a - f.a * g.g), 6) + 0.0 as z from c join f on f.id = c.id join g on g.k1 = f.k and g.k2 = c.k")
def grad_step(spark, d):
    """One gradient step from the one-atom code: z + 0.1 D (x - z D)."""
    first = top_k(correlations(T.signals(spark, d), T.atoms(spark, d)), 1, by_abs=True)
    return step_codes(T.signals(spark, d), T.atoms(spark, d), first, 0.1).withColumn("z", r6(F.col("z")))


@query(f"{W('a', 's', 'c')}, {_ONE} select id, case when a < 0 then k + 32 else k end as k, round(abs(a), 6) + 0.0 as z from f")
def sign_split(spark, d):
    out = FeatureEncoder("sign_splitting", sparse_coder=SparseEncoder("omp", {"n_nonzero_coefs": 1})).encode(T.signals(spark, d), T.atoms(spark, d))
    return long_codes(out).withColumn("z", r6(F.col("z")))


_GROUPS = [list(range(4 * g, 4 * g + 4)) for g in range(8)]


@query()
def group_omp_1(spark, d):
    return codes_of("group_omp", {"groups": _GROUPS, "n_groups": 1}, spark, d)


@query(f"""{W('a', 's', 'c')}, best as (select id, grp from (select id, k // 4 as grp, row_number() over (partition by id order by sum(a * a) desc, k // 4) as r from c group by id, k // 4) where r = 1),
    f as (select id, k, a from (select c.id, c.k, c.a, row_number() over (partition by c.id order by abs(c.a) desc, c.k) as r from c join best on best.id = c.id and best.grp = c.k // 4) where r = 1)
    select id, k, round(a, 6) + 0.0 as z from f""")
def sparse_group_omp(spark, d):
    return codes_of("sparse_group_omp", {"groups": _GROUPS, "n_groups": 1, "n_nonzero_coefs": 1}, spark, d)


@query(f"{W('a', 's', 'c')} select id, k, round(a, 6) + 0.0 as z from (select *, row_number() over (partition by id order by a desc, k) as r from c where a > 0) where r = 1")
def nnomp_k1(spark, d):
    return codes_of("nnomp", {"n_nonzero_coefs": 1}, spark, d)


@query()
def nnomp(spark, d):
    return codes_of("nnomp", {"n_nonzero_coefs": 3}, spark, d)


@query()
def lasso(spark, d):
    return codes_of("lasso", {"lambda": 0.1}, spark, d)


# ---------------------------------------------------------------- dictionaries


@query(f"{W('nn')} {sql_exploded('(select cast(row_number() over (order by id) - 1 as integer) as k, list_transform(x, lambda v: v / (n + 2.220446049250313e-16)) as x from nn where n * n > 1e-6 order by id limit 10)', 'k')}")
def init_first(spark, d):
    return exploded(dictionary.init_dictionary(T.vectors(spark, d), 10, "first"), "d", "k")


@query(f"{W('a', 'g')} select round(avg(abs(g)), 6) + 0.0 as coherence from g where k1 <> k2")
def mutual_coherence(spark, d):
    return dictionary.mutual_coherence(T.atoms(spark, d)).select(r6(F.col("coherence")).alias("coherence"))


@query(f"{W('a', 's', 'c')}, {_ONE} select round(sum(list_inner_product(s.x, s.x) - f.a * f.a), 6) + 0.0 as error from s join f on f.id = s.id")
def approx_error(spark, d):
    codes = SparseEncoder("omp", {"n_nonzero_coefs": 1}).encode(T.signals(spark, d), T.atoms(spark, d))
    return dictionary.approx_error(T.signals(spark, d), codes, T.atoms(spark, d)).select(r6(F.col("error")).alias("error"))


@query(f"{W('ca')} select p.k, q.k as l, round(abs(list_inner_product(p.d, q.d)), 6) + 0.0 as g from ca p, ca q where p.cls = 0 and q.cls = 1 and abs(list_inner_product(p.d, q.d)) > 0.1")
def coherent_pairs(spark, d):
    a = T.class_atoms(spark, d)
    return dictionary.coherent_pairs(a.where("cls = 0"), a.where("cls = 1"), thresh=0.1).withColumn("g", r6(F.col("g")))


@query(f"{W('ca')} select k from ca q where not exists (select 1 from ca p where p.cls < q.cls and abs(list_inner_product(p.d, q.d)) > 0.3)")
def drop_coherent(spark, d):
    return dictionary.drop_coherent(T.class_atoms(spark, d), 0.3).select("k")


@query(f"""{W('a', 's', 'c')}, {_ONE}, l as (select f.a as z, unnest(list_transform(s.x, lambda v, i: {{'p': i, 'v': v}})) as u from f join s on s.id = f.id where f.k = 0),
    b as (select u.p as p, sum(u.v * z) as v from l group by 1) select cast(p - 1 as integer) as p, round(v / sqrt((select sum(v * v) from b)), 6) + 0.0 as v from b""")
def approx_ksvd_first_atom(spark, d):
    """The first atom after one approximate K-SVD update from one-atom codes: R_0 z is then the weighted sum of its signals."""
    learner = learn.KSVD(32, SparseEncoder("omp", {"n_nonzero_coefs": 1}), max_iter=1, method="approx", init=matrix(T.atoms(spark, d)))
    return exploded(learner.fit(T.signals(spark, d)).atoms(spark).where("k = 0"), "d", "k").drop("k")


def _odl_sql(steps: int) -> str:
    """Online learning with one-atom codes over equal ranges of all ids, written out."""
    size = f"(((select count(*) from s) + {steps - 1}) // {steps})"
    q = f"{W('a', 's')}, sb as (select id, x, (row_number() over (order by id) - 1) // {size} as batch from s), d0 as (select k, d from a)"
    for i in range(steps):
        before_a = f" + coalesce((select v from aa{i - 1} o where o.k = d.k), 0)" if i else ""
        q += f""", c{i} as (select s.id, d.k, list_inner_product(s.x, d.d) as a from sb s, d{i} d where s.batch = {i}),
          f{i} as (select id, k, a from (select *, row_number() over (partition by id order by abs(a) desc, k) as r from c{i}) where r = 1),
          aa{i} as (select d.k, coalesce((select sum(a * a) from f{i} f where f.k = d.k), 0){before_a} as v from d{i} d),
          ll{i} as (select f.k, u.p, sum(f.a * u.v) as v from f{i} f join (select id, unnest(list_transform(x, lambda v, j: {{'p': j, 'v': v}})) as u from s) t on t.id = f.id group by all),
          bs{i} as (select d.k, p.p, coalesce(l.v, 0){' + coalesce(o.v, 0)' if i else ''} as v from d{i} d cross join (select unnest(range(1, 65)) as p) p left join ll{i} l on l.k = d.k and l.p = p.p {f'left join bs{i - 1} o on o.k = d.k and o.p = p.p' if i else ''}),
          n{i} as (select b.k, b.p, d.d[b.p] + (b.v - a.v * d.d[b.p]) / (a.v + 2.220446049250313e-16) as v from bs{i} b join d{i} d on d.k = b.k join aa{i} a on a.k = b.k),
          d{i + 1} as (select k, list(v / n order by p) as d from (select *, sqrt(sum(v * v) over (partition by k)) as n from n{i}) group by k)"""
    return q + f" select k, cast(u.p - 1 as integer) as p, round(u.v, 6) + 0.0 as v from (select k, unnest(list_transform(d, lambda v, j: {{'p': j, 'v': v}})) as u from d{steps})"


def _odl(spark, d, steps):
    rows = T.signals(spark, d)
    learner = learn.OnlineLearner(32, SparseEncoder("omp", {"n_nonzero_coefs": 1}), batch_size=-(-rows.count() // steps), beta=1.0, init=matrix(T.atoms(spark, d)))
    return exploded(learner.fit(rows).atoms(spark), "d", "k")


@query(_odl_sql(1))
def odl_one_batch(spark, d):
    return _odl(spark, d, 1)


@query(_odl_sql(2))
def odl_two_batches(spark, d):
    return _odl(spark, d, 2)


@query(f"""{W('a', 's', 'c')}, {_ONE}, aa as (select k, sum(a * a) as v from f group by 1),
    bs as (select f.k, u.p, sum(f.a * u.v) as v from f join (select id, unnest(list_transform(x, lambda v, j: {{'p': j, 'v': v}})) as u from s) t on t.id = f.id group by all),
    n as (select a.k, p.p, a.d[p.p] - 0.01 * (coalesce(aa.v, 0) * a.d[p.p] - coalesce(bs.v, 0)) as v from a cross join (select unnest(range(1, 65)) as p) p left join aa on aa.k = a.k left join bs on bs.k = a.k and bs.p = p.p)
    select k, cast(p - 1 as integer) as p, round(v / sqrt(sum(v * v) over (partition by k)), 6) + 0.0 as v from n""")
def pgd_one_step(spark, d):
    learner = learn.GradientLearner(32, SparseEncoder("omp", {"n_nonzero_coefs": 1}), eta=0.01, init=matrix(T.atoms(spark, d)))
    return exploded(learner.fit(T.signals(spark, d)).atoms(spark), "d", "k")


def _ksvd(spark, d, method):
    learner = learn.KSVD(16, SparseEncoder("nnomp" if method == "nn" else "bomp", {"n_nonzero_coefs": 2}), max_iter=2, method=method)
    return exploded(learner.fit(T.signals(spark, d)).atoms(spark), "d", "k")


@query()
def ksvd(spark, d):
    return _ksvd(spark, d, "ksvd")


@query()
def approx_ksvd(spark, d):
    return _ksvd(spark, d, "approx")


@query()
def nn_ksvd(spark, d):
    return _ksvd(spark, d, "nn")


@query()
def distributed_ksvd(spark, d):
    learner = learn.KSVD(16, SparseEncoder("bomp", {"n_nonzero_coefs": 2}), max_iter=3, mode="distributed")
    return exploded(learner.fit(T.signals(spark, d)).atoms(spark), "d", "k")


@query()
def class_ksvd(spark, d):
    atoms = learn.ClassKSVD(4, SparseEncoder("bomp", {"n_nonzero_coefs": 2}), max_iter=2).fit(T.signals(spark, d))
    return exploded(atoms, "d", "k", "cls")


@query()
def lc_ksvd(spark, d):
    model = learn.LCKSVD(3, SparseEncoder("omp", {"n_nonzero_coefs": 3}), max_iter=2).fit(T.signals(spark, d))
    return model.predict(T.signals(spark, d))


# ---------------------------------------------------------------- classification


_REST = "t as (select id, x, label from e where id not in (select id from ca))"
_CC = f"{W('ca')}, {_REST}, cc as (select t.id, ca.k, ca.cls, list_inner_product(t.x, ca.d) as a from t, ca)"
_CONE = "f as (select id, k, cls, a from (select *, row_number() over (partition by id order by abs(a) desc, k) as r from cc) where r = 1)"
_GERR = "ge as (select t.id, cast(c.cls as integer) as cls, list_inner_product(t.x, t.x) - case when f.cls = c.cls then f.a * f.a else 0 end as err, case when f.cls = c.cls then 1 else 0 end as nnz from t cross join (select distinct cls from ca) c join f on f.id = t.id)"
_LERR = "le as (select t.id, cast(m.cls as integer) as cls, list_inner_product(t.x, t.x) - max(m.a * m.a) as err from t join cc m on m.id = t.id group by t.id, t.x, m.cls)"


def _rest(spark, d):
    return T.vectors(spark, d).join(T.class_atoms(spark, d).select("id"), "id", "left_anti")


def _table(spark, d, local=False):
    return classify.class_table(_rest(spark, d), T.class_atoms(spark, d), SparseEncoder("omp", {"n_nonzero_coefs": 1}), local)


@query(f"{_CC}, {_CONE}, {_GERR} select id, cls, round(err, 6) + 0.0 as err from ge")
def src_global_errors(spark, d):
    return _table(spark, d).select("id", "cls", r6(F.col("err")).alias("err"))


@query(f"{_CC}, {_LERR} select id, cls, round(err, 6) + 0.0 as err from le")
def src_local_errors(spark, d):
    return _table(spark, d, True).select("id", "cls", r6(F.col("err")).alias("err"))


@query(f"{_CC}, {_CONE} select id, cast(cls as integer) as pred from f")
def src_predict_global(spark, d):
    return classify.src_predict(_rest(spark, d), T.class_atoms(spark, d), SparseEncoder("omp", {"n_nonzero_coefs": 1}))


@query(f"{_CC}, {_CONE} select id, cast(cls as integer) as pred from f")
def src_predict_local(spark, d):
    """With one atom a class the smallest local error is that of the most correlated atom."""
    return classify.src_predict(_rest(spark, d), T.class_atoms(spark, d), SparseEncoder("omp", {"n_nonzero_coefs": 1}), "local")


@query(f"{_CC}, {_CONE}, {_GERR} select id, cls as pred from (select *, row_number() over (partition by id order by nnz, cls) as r from ge) where r = 1")
def src_sparsest(spark, d):
    return classify.predict(_table(spark, d), "nnz")


@query(f"{_CC}, {_CONE}, {_GERR} select id, cls, round(err / sqrt(sum(err * err) over (partition by id)), 6) + 0.0 as f from ge")
def src_features(spark, d):
    return classify.features(_table(spark, d)).withColumn("f", r6(F.col("f")))


_T3 = "t3 as (select id, cls, a from (select *, row_number() over (partition by id order by a desc, k) as r from cc) where r <= 3)"


def _sci(spark, d, reg):
    codes = SparseEncoder("thresh", {"n_nonzero_coefs": 3}).encode(_rest(spark, d), T.class_atoms(spark, d))
    return classify.sci(codes, T.class_atoms(spark, d), reg).withColumn("sci", r6(F.col("sci")))


def _sci_sql(size: str) -> str:
    return f"{_CC}, {_T3}, b as (select id, cls, sum({size}) as s from t3 group by 1, 2), n as (select count(distinct cls) as n from ca) select id, round((max(n.n) * max(s) / sum(s) - 1) / (max(n.n) - 1), 6) + 0.0 as sci from b, n group by id"


@query(_sci_sql("cast(1 as double)"))
def sci_l0(spark, d):
    return _sci(spark, d, "l0")


@query(_sci_sql("abs(a)"))
def sci_l1(spark, d):
    return _sci(spark, d, "l1")


# ---------------------------------------------------------------- features


_CELLS = "pc as (select id // 64 as img_id, cast(id % 64 as integer) as pos, id, x from e)"


def _pool_codes(spark, d):
    """One-atom codes of each vector, taken as 64 places (8 x 8) of an image."""
    codes = long_codes(SparseEncoder("thresh", {"n_nonzero_coefs": 4}).encode(T.vectors(spark, d), T.atoms(spark, d)))
    return codes.select(F.floor(F.col("id") / 64).alias("img_id"), (F.col("id") % 64).cast("int").alias("pos"), "k", "z")


_PC = f"{W('a', 'e')}, c as (select e.id, a.k, list_inner_product(e.x, a.d) as a from e, a), p as (select id // 64 as img_id, cast(id % 64 as integer) as pos, k, a as z from (select *, row_number() over (partition by id order by a desc, k) as r from c) where r <= 4), m as (select id // 64 as img_id, count(*) as n from e group by 1)"


def _pool(spark, d, how):
    members = T.vectors(spark, d).groupBy(F.floor(F.col("id") / 64).alias("img_id")).agg(F.count("*").alias("n"))
    return pooling.pool(_pool_codes(spark, d), ["img_id"], how, members).withColumn("v", r6(F.col("v")))


@query(f"{_PC} select img_id, k, round(max(abs(z)), 6) + 0.0 as v from p group by 1, 2")
def pool_absmax(spark, d):
    return _pool(spark, d, "absmax")


@query(f"{_PC} select p.img_id, k, round(case when count(*) < max(n) then greatest(max(z), 0) else max(z) end, 6) + 0.0 as v from p join m on m.img_id = p.img_id group by 1, 2")
def pool_max(spark, d):
    return _pool(spark, d, "max")


@query(f"{_PC} select img_id, k, round(sum(z), 6) + 0.0 as v from p group by 1, 2")
def pool_sum(spark, d):
    return _pool(spark, d, "sum")


@query(f"{_PC} select p.img_id, k, round(sum(z) / max(n), 6) + 0.0 as v from p join m on m.img_id = p.img_id group by 1, 2")
def pool_avg(spark, d):
    return _pool(spark, d, "avg")


def _places(spark, d):
    rows = T.vectors(spark, d).select(F.floor(F.col("id") / 64).alias("img_id"), (F.col("id") % 64).cast("int").alias("pos"))
    return rows.withColumn("py", F.floor(F.col("pos") / 8).cast("int")).withColumn("px", F.col("pos") % 8).withColumn("h", F.lit(8)).withColumn("w", F.lit(8))


_CELL = "cl as (select img_id, pos, lev as level, cast(floor((pos // 8) / (8.0 / lev)) * lev + floor((pos % 8) / (8.0 / lev)) as integer) as cell from (select id // 64 as img_id, cast(id % 64 as integer) as pos from e), (select unnest([1, 2, 4]) as lev))"


@query(f"{W('e')}, {_CELL} select * from cl")
def spm_cells(spark, d):
    return pooling.cells(_places(spark, d), (1, 2, 4)).select("img_id", "pos", "level", "cell")


_SPP = f"{_PC}, {_CELL}, sp as (select p.img_id, level, cell, k, max(abs(z)) as v from p join cl on cl.img_id = p.img_id and cl.pos = p.pos group by all)"


@query(f"{_SPP} select img_id, level, cell, k, round(v / sqrt(sum(v * v) over (partition by img_id, level, cell)), 6) + 0.0 as v from sp")
def spm_features(spark, d):
    return pooling.pyramid(_pool_codes(spark, d), _places(spark, d)).withColumn("v", r6(F.col("v")))


@query(f"{_SPP} select img_id, level, cell, k, round(v, 6) + 0.0 as v from sp")
def hmp_spp(spark, d):
    return pooling.pyramid(_pool_codes(spark, d), _places(spark, d), normalise=False).withColumn("v", r6(F.col("v")))


@query(f"{_PC} select img_id, cast(oy as integer) as oy, cast(ox as integer) as ox, k, round(max(abs(z)), 6) + 0.0 as v from p, (select unnest(range(3)) as oy), (select unnest(range(3)) as ox) where pos // 8 between oy * 2 and oy * 2 + 2 and pos % 8 between ox * 2 and ox * 2 + 2 group by all")
def conv_pool(spark, d):
    codes = _pool_codes(spark, d).withColumn("py", F.floor(F.col("pos") / 8).cast("int")).withColumn("px", F.col("pos") % 8)
    return pooling.conv_pool(codes, 8, 8, 3, 2).withColumn("v", r6(F.col("v")))


@query(f"{W('e')}, y as (select id, list_transform(x, lambda v: abs(v) * case when id % 2 = 0 then 2 else 0.9 end) as x from e), n as (select id, x, sqrt(list_inner_product(x, x)) as n from y), c as (select id, n, list_transform(x, lambda v: least(v / greatest(n, 1), 0.2)) as x from n), z as (select id, x, case when n >= 1 then sqrt(list_inner_product(x, x)) else 1 end as m from c) {sql_exploded('(select id, list_transform(x, lambda v: v / m) as x from z)')}")
def sift_normalize(spark, d):
    return exploded(images.normalize_sift(T.vectors(spark, d).withColumn("x", F.transform("x", lambda v: F.abs(v) * F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.9)))).select("id", "x"))


@query()
def dsift(spark, d):
    return exploded(images.sift(T.images(spark, d), 8, 16), "x", "img_id", "pos", "py", "px")


@query()
def spatial_pyramid(spark, d):
    coder = SparseEncoder("thresh", {"n_nonzero_coefs": 3})
    sp = pooling.SpatialPyramid("patches", 8, 8, coder, (1, 2))
    learner = sp.learn(T.images(spark, d), learn.KSVD(8, SparseEncoder("bomp", {"n_nonzero_coefs": 2}), max_iter=1))
    return exploded(sp.extract(T.images(spark, d), learner.D))


@query()
def hmp_one_layer(spark, d):
    layer = pooling.HMPLayer(8, 8, learn.KSVD(8, SparseEncoder("bomp", {"n_nonzero_coefs": 2}), max_iter=1), FeatureEncoder("soft_thresholding", {"n_nonzero_coefs": 2}), ("local_centering",))
    return exploded(pooling.HMPNetwork([layer], (1, 2)).build(T.images(spark, d), 64, 64))


@query()
def whiten(spark, d):
    return exploded(preprocess.preprocess(T.vectors(spark, d), "whitening"))


@query()
def pepper(spark, d):
    return images.pepper(T.tiny_images(spark, d), 0.25).select("img_id", F.posexplode("mask").alias("p", "kept"))


@query()
def add_noise(spark, d):
    return exploded(images.add_noise(T.tiny_images(spark, d), 5.0), "px", "img_id")


@query()
def resize(spark, d):
    return images.resize(T.images(spark, d), maxdim=32).select("img_id", "h", "w", F.posexplode("px").alias("p", "v")).withColumn("v", r6(F.col("v")))


@query(f"{W('e')}, {_TINY} select img_id, cast(y as integer) as y, cast(x as integer) as x, cast(0 as integer) as ch, px[y * 8 + x + 1] as v from t, (select unnest(range(8)) as y), (select unnest(range(8)) as x)")
def rebuild_patches(spark, d):
    rows = T.tiny_images(spark, d)
    return images.rebuild(images.grid_patches(rows, (4, 4), (2, 2)), rows, (4, 4))


@query(f"{W('e')} select id as row, cast(u.p - 1 as integer) as col, u.v as data from (select id, unnest(list_transform(x, lambda v, i: {{'p': i, 'v': v}})) as u from e) where u.v <> 0")
def sparse_triplets(spark, d):
    from ..sources.images import from_triplets, to_triplets

    return to_triplets(from_triplets(to_triplets(T.vectors(spark, d)), 64))


# ---------------------------------------------------------------- evaluation


_NEAR = f"{W('ca')}, {_REST}, cc as (select t.id, t.label, ca.k, ca.cls, list_inner_product(t.x, ca.d) as a from t, ca), pr as (select id, label as y, cls as y_pred, a from (select *, row_number() over (partition by id order by a desc, k) as r from cc) where r = 1)"


def _predicted(spark, d):
    """Labels and those of the nearest class atom."""
    corr = correlations(_rest(spark, d), T.class_atoms(spark, d))
    best = top_k(corr, 1).select("id", "k", F.col("z").alias("a"))
    return best.join(F.broadcast(T.class_atoms(spark, d).select("k", F.col("cls").alias("y_pred"))), "k").join(_rest(spark, d).select("id", F.col("label").alias("y")), "id")


@query(f"{_NEAR} select round(avg(case when y = y_pred then 1.0 else 0.0 end), 6) + 0.0 as accuracy from pr".replace("1.0 else 0.0 end", "cast(1 as double) else cast(0 as double) end"))
def class_accuracy(spark, d):
    return evaluate.class_accuracy(_predicted(spark, d)).select(r6(F.col("accuracy")).alias("accuracy"))


@query(f"{_NEAR} select round(avg(a), 6) + 0.0 as accuracy from (select y, avg(case when y = y_pred then cast(1 as double) else cast(0 as double) end) as a from pr group by y)")
def avg_class_accuracy(spark, d):
    return evaluate.avg_class_accuracy(_predicted(spark, d)).select(r6(F.col("accuracy")).alias("accuracy"))


@query(f"{_NEAR}, rk as (select row_number() over (order by a desc, id) as rank, case when y = y_pred then 1 else 0 end as tp from pr), np as (select sum(tp) as n from rk), cu as (select rank, cast(sum(tp) over (order by rank) as double) as ct, rank as n from rk), rp as (select rank, ct / np.n as recall, ct / cu.n as prec from cu, np), en as (select recall, max(prec) over (order by rank rows between current row and unbounded following) as top, coalesce(lag(recall) over (order by rank), 0) as before from rp) select round(sum((recall - before) * top), 6) + 0.0 as ap from en")
def average_precision(spark, d):
    rows = _predicted(spark, d).select("id", "a", F.coalesce(F.col("y") == F.col("y_pred"), F.lit(False)).cast("int").alias("tp"))
    rows = rows.withColumn("fp", 1 - F.col("tp"))
    return evaluate.average_precision(rows, backwards=(F.asc("a"), F.desc("id"))).select(r6(F.col("ap")).alias("ap"))


@query("select vec_id as id, cast((row_number() over (partition by label order by vec_id) - 1) % 5 as integer) as fold from embeddings")
def stratified_folds(spark, d):
    return evaluate.folds(T.vectors(spark, d), 5).select("id", "fold")


@query("select id, case when r <= 20 then 'train' else 'test' end as part from (select vec_id as id, row_number() over (partition by label order by vec_id) as r from embeddings) where r <= 30")
def class_split(spark, d):
    return evaluate.split(T.vectors(spark, d), 20, 10, seed=None).select("id", "part")


@query()
def svm(spark, d):
    return evaluate.LinearSVM(1.0).train(T.vectors(spark, d)).predict(T.vectors(spark, d))


@query("select vec_id as id, cast(dense_rank() over (order by label) - 1 as integer) as label from embeddings")
def folder_labels(spark, d):
    """Labels as ordinals of the sorted class names."""
    from ..sources.images import class_labels

    return class_labels(T.vectors(spark, d).select("id", F.col("label").alias("cls"))).select("id", "label")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
