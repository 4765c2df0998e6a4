"""Vector algebra, prototypes, motif features and cluster diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import motifs as M
from ..sources import table
from . import query

LENGTH, WIDTH = 4, 16

# Pieces of SQL that the queries below share.
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
POOLED = "v as (select vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings), pool as (select vec_id, label, list_transform(range(1, 17), lambda i: (v[i] + v[i + 16] + v[i + 32] + v[i + 48]) / 4) as z from v)"
CENTRES = "cen as (select label, i, avg(z[i]) as c from pool, (select unnest(range(1, 17)) as i) group by label, i), cenv as (select label, list(c order by i) as c from cen group by label)"
PROTOS = "dist as (select pool.label, vec_id, z, round(list_sum(list_transform(range(1, 17), lambda i: (z[i] - c[i]) * (z[i] - c[i]))), 9) as d from pool join cenv on pool.label = cenv.label), proto as (select label as k, vec_id, z as p from (select *, row_number() over (partition by label order by d, vec_id) as r from dist) where r = 1)"
FRAMES = "fr as (select vec_id, t, list_slice(v, 16 * t + 1, 16 * t + 16) as f from v, (select unnest(range(0, 4)) as t))"
SIM = "sim as (select fr.vec_id as vec_id, t, k, " + DOT.format(a="f", b="p") + " / (greatest(sqrt(" + DOT.format(a="f", b="f") + "), 1e-8) * greatest(sqrt(" + DOT.format(a="p", b="p") + "), 1e-8)) / 0.1::DOUBLE as s from fr, proto)"
DIST = "sim as (select fr.vec_id as vec_id, t, k, -list_sum(list_transform(range(1, 17), lambda i: (f[i] - p[i]) * (f[i] - p[i]))) / 0.1::DOUBLE as s from fr, proto)"
SOFT = "ex as (select *, exp(s - max(s) over (partition by vec_id, t)) as e from sim), w as (select vec_id, t, k, e / sum(e) over (partition by vec_id, t) as w from ex)"
FEATURES = "feat as (select vec_id, k, sum(w) as hist, max(w) as mx, stddev_pop(w) as spread from w group by vec_id, k)"
DOMINANT = "dom as (select vec_id, k from (select vec_id, k, row_number() over (partition by vec_id order by round(hist, 6) desc, k) as r from feat) where r = 1)"
TABLE = "n as (select dom.k, e.label as species, count(*)::DOUBLE as n from dom join embeddings e on e.vec_id = dom.vec_id group by dom.k, e.label), ct as (select k, species, n, n / greatest(sum(n) over (partition by k), 1e-10) as p from n)"
PURITY = "pq as (select ks.k, s.species, coalesce(ct.p, 0) + 1e-10 as q from (select distinct k from ct) ks cross join (select distinct label as species from embeddings) s left join ct on ct.k = ks.k and ct.species = s.species), pn as (select k, q / sum(q) over (partition by k) as q from pq), pur as (select pn.k, 1 + sum(q * ln(q)) / ln((select count(distinct label) from embeddings)) as purity from pn group by pn.k)"
BASE = f"with {POOLED}, {CENTRES}, {PROTOS}, {FRAMES}, {SIM}, {SOFT}, {FEATURES}, {DOMINANT}, {TABLE} "


def segments(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", "label", M.frames_of(F.col("embedding"), LENGTH, WIDTH).alias("frames"))
    return x.withColumn("z", M.mean_pool(F.col("frames")))


def prototypes(spark, d):
    return M.medoids(segments(spark, d).select("vec_id", "label", "z"), "vec_id", "label", "z").select(F.col("label").alias("k"), "vec_id", "p")


def features(spark, d):
    return M.motif_features(segments(spark, d), "vec_id", "frames", prototypes(spark, d))


def counts(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("species"), F.lit(1.0).alias("y"))
    return M.contingency(M.dominant(features(spark, d), "vec_id"), labels, "vec_id", "species")


def purities(spark, d):
    n = table(spark, d, "embeddings").select("label").distinct().count()
    return M.purity(counts(spark, d), n)


@query(f"with {POOLED}, {CENTRES}, {PROTOS} select k, i::INTEGER as i, round(p[i + 1], 6) as x from proto, (select unnest(range(0, 16)) as i)")
def proto_scan(spark, d):
    return prototypes(spark, d).select("k", F.posexplode("p").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) as len from embeddings")
def l2_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.doubles(F.col("embedding"))), 6).alias("len"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings) select a.vec_id as a, b.vec_id as b, round(" + DOT.format(a="a.v", b="b.v") + " / (sqrt(" + DOT.format(a="a.v", b="a.v") + ") * sqrt(" + DOT.format(a="b.v", b="b.v") + ")), 6) as cos from v a join v b on a.vec_id = b.vec_id - 1")
def cosine_pairs(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    y = x.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("u"))
    return x.join(y, F.col("vec_id") == F.col("a")).select("a", "b", F.round(V.cosine(F.col("v"), F.col("u")), 6).alias("cos"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings), p as (select vec_id, list_transform(range(0, 8), lambda j: list_sum(list_transform(range(1, 65), lambda i: v[i] * (((i * (j + 3)) % 7) - 3)::DOUBLE))) as z from v) select vec_id, j::INTEGER as j, round(z[j + 1] / greatest(sqrt(list_sum(list_transform(z, lambda x: x * x))), 1e-8), 6) as x from p, (select unnest(range(0, 8)) as j)")
def linear_project(spark, d):
    w = [[float((i * (j + 3)) % 7 - 3) for i in range(1, 65)] for j in range(8)]
    v = V.doubles(F.col("embedding"))
    z = F.array(*(V.dot(v, F.array(*map(F.lit, row))) for row in w))
    x = table(spark, d, "embeddings").select("vec_id", z.alias("z"))
    return x.select("vec_id", F.posexplode(V.unit(F.col("z"))).alias("j", "x")).withColumn("x", F.round("x", 6))


@query(f"with {POOLED} select vec_id, i::INTEGER as i, round(z[i + 1], 6) as x from pool, (select unnest(range(0, 16)) as i)")
def mean_pool(spark, d):
    return segments(spark, d).select("vec_id", F.posexplode("z").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("select vec_id, 5 as n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) as total from embeddings")
def frames_pad(spark, d):
    x = segments(spark, d).select("vec_id", F.expr("frames").alias("f")).withColumn("f", V.pad(F.col("f"), 5, WIDTH))
    return x.select("vec_id", F.size("f").alias("n"), F.round(F.aggregate(F.flatten("f"), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"with {POOLED}, {CENTRES} select label, (i - 1)::INTEGER as i, round(c, 6) as c from cen")
def centroids(spark, d):
    return M.centroids(segments(spark, d), "label", "z").withColumn("c", F.round("c", 6))


@query(f"with {POOLED}, {CENTRES}, {PROTOS} select k, vec_id from proto")
def medoids(spark, d):
    return prototypes(spark, d).select("k", "vec_id")


@query(f"with {POOLED}, {CENTRES}, {PROTOS}, {FRAMES}, {SIM}, {SOFT} select vec_id, t::INTEGER as t, k, round(w, 6) as w from w")
def soft_assign(spark, d):
    return M.soft_assign(segments(spark, d), "vec_id", "frames", prototypes(spark, d)).withColumn("w", F.round("w", 6))


@query(f"with {POOLED}, {CENTRES}, {PROTOS}, {FRAMES}, {DIST}, {SOFT} select vec_id, t::INTEGER as t, k, round(w, 6) as w from w")
def soft_assign_euclid(spark, d):
    return M.soft_assign(segments(spark, d), "vec_id", "frames", prototypes(spark, d), metric="euclid").withColumn("w", F.round("w", 6))


@query(f"with {POOLED}, {CENTRES}, {PROTOS}, {FRAMES}, {SIM}, {SOFT} select vec_id, t, k, w from (select vec_id, t::INTEGER as t, k, round(w, 6) as w, row_number() over (partition by vec_id, t order by round(w, 6) desc, k) as r from w) where r <= 3")
def assign_topk(spark, d):
    x = soft_assign(spark, d)
    return x.withColumn("r", F.row_number().over(Window.partitionBy("vec_id", "t").orderBy(F.desc("w"), "k"))).where("r <= 3").drop("r")


@query(BASE + "select vec_id, k, round(hist, 6) as hist, round(mx, 6) as mx, round(spread, 6) as spread from feat")
def motif_features(spark, d):
    return features(spark, d).select("vec_id", "k", *(F.round(c, 6).alias(c) for c in ("hist", "mx", "spread")))


@query(BASE + ", fl as (select vec_id, t, k, w > 0.1 as f from w), g as (select *, t - row_number() over (partition by vec_id, k, f order by t) as g from fl), r as (select vec_id, k, count(*) as n from g where f group by vec_id, k, g) select a.vec_id, a.k, a.density, coalesce(b.n_runs, 0)::INTEGER as n_runs, coalesce(b.longest, 0)::INTEGER as longest from (select vec_id, k, round(avg(f::INTEGER), 6) as density from fl group by vec_id, k) a left join (select vec_id, k, count(*) as n_runs, max(n) as longest from r group by vec_id, k) b on b.vec_id = a.vec_id and b.k = a.k")
def motif_runs(spark, d):
    x = M.traces(segments(spark, d), "vec_id", "frames", prototypes(spark, d)).select("vec_id", "k", M.runs(F.col("w"), 0.1).alias("r"))
    return x.select("vec_id", "k", F.round("r.density", 6).alias("density"), "r.n_runs", "r.longest")


@query(BASE + "select vec_id, round(avg(h) / ln(10), 6) as noise from (select vec_id, t, -sum(w * ln(w + 1e-10)) as h from w group by vec_id, t) group by vec_id")
def noise_fraction(spark, d):
    return features(spark, d).groupBy("vec_id").agg(F.round(F.max("noise"), 6).alias("noise"))


@query(BASE + "select vec_id, k from dom")
def dominant_motif(spark, d):
    return M.dominant(features(spark, d), "vec_id")


@query(BASE + "select k, species, n, round(p, 6) as p from ct")
def cluster_species(spark, d):
    return counts(spark, d).withColumn("p", F.round("p", 6))


@query(BASE + "select k, species, p from (select k, species, round(p, 6) as p, row_number() over (partition by k order by n desc, species) as r from ct) where r <= 3 and p > 0.01")
def top_species(spark, d):
    r = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "species"))
    return counts(spark, d).withColumn("r", r).where("r <= 3 and p > 0.01").select("k", "species", F.round("p", 6).alias("p"))


@query(BASE + "select k, count(*) as n from dom group by k")
def cluster_sizes(spark, d):
    return dominant_motif(spark, d).groupBy("k").agg(F.count("*").alias("n"))


@query(BASE + f", {PURITY} select k, round(purity, 6) as purity from pur")
def purity(spark, d):
    return purities(spark, d).select("k", F.round("purity", 6).alias("purity"))


@query(BASE + f", {PURITY} select k, round(purity, 6) as purity from pur where k in (select k from ct group by k having sum(n) >= 20)")
def purity_active(spark, d):
    return purities(spark, d).where("n >= 20").select("k", F.round("purity", 6).alias("purity"))


@query(BASE + f", {PURITY} select k, round(purity, 6) as purity from pur order by round(purity, 6) desc, k limit 5")
def purity_top(spark, d):
    return purity(spark, d).orderBy(F.desc("purity"), "k").limit(5)


@query(BASE + f", {PURITY} select count(*) filter (where purity > 0.9) as over_9, count(*) filter (where purity > 0.7) as over_7, count(*) filter (where purity > 0.5) as over_5, count(*) filter (where purity > 0.3) as over_3, count(*) filter (where purity <= 0.3) as rest from pur")
def purity_buckets(spark, d):
    over = [F.count_if(F.col("purity") > x / 10).alias(f"over_{x}") for x in (9, 7, 5, 3)]
    return purities(spark, d).agg(*over, F.count_if(F.col("purity") <= 0.3).alias("rest"))


@query(BASE + f", {PURITY} select round(avg(purity), 6) as mean, round(median(purity), 6) as middle from pur")
def purity_stats(spark, d):
    return purities(spark, d).agg(F.round(F.avg("purity"), 6).alias("mean"), F.round(F.median("purity"), 6).alias("middle"))


@query(BASE + ", own as (select k, species from (select k, species, row_number() over (partition by k order by n desc, species) as r from ct) where r = 1) select s.species, count(own.k) as n from (select distinct label as species from embeddings) s left join own on own.species = s.species group by s.species")
def species_ownership(spark, d):
    own = counts(spark, d).groupBy("k").agg(F.max_by("species", F.struct("n", -F.col("species"))).alias("species"))
    every = table(spark, d, "embeddings").select(F.col("label").alias("species")).distinct()
    return every.join(own, "species", "left").groupBy("species").agg(F.count("k").alias("n"))


@query("select vec_id, idx, val from (select vec_id, (i - 1)::INTEGER as idx, round(embedding[i]::DOUBLE, 6) as val, row_number() over (partition by vec_id order by embedding[i] desc, i) as r from embeddings, (select unnest(range(1, 65)) as i)) where r <= 5")
def topk_logits(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.inline(V.top_k(V.doubles(F.col("embedding")), 5)))
    return x.withColumn("val", F.round("val", 6))


@query("select vec_id, list_sum(list_transform(embedding, lambda x: (x <> 0)::INTEGER)) > 0 as filled from embeddings")
def nonzero_row(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.exists("embedding", lambda x: x != 0).alias("filled"))


@query("with l as (select vec_id, list_transform(embedding, lambda x: 10 * log10(greatest(x::DOUBLE * x::DOUBLE, 1e-10))) as l from embeddings), c as (select vec_id, list_transform(l, lambda x: greatest(x, list_max(l) - 80)) as c from l) select vec_id, round(list_sum(list_transform(c, lambda x: (x - list_min(c)) / greatest(list_max(c) - list_min(c), 1e-8))), 4) as total from c")
def db_normalize(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda v: 10 * F.log10(F.greatest(v * v, F.lit(1e-10)))).alias("l"))
    x = x.withColumn("top", F.array_max("l")).withColumn("c", F.transform("l", lambda v: F.greatest(v, F.col("top") - 80)))
    x = x.withColumn("lo", F.array_min("c")).withColumn("hi", F.array_max("c"))
    total = F.aggregate("c", F.lit(0.0), lambda s, v: s + (v - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)))
    return x.select("vec_id", F.round(total, 4).alias("total"))


@query(BASE + "select vec_id, i::INTEGER as i, x from (select vec_id, i - 1 as i, round(v[i], 6) as x from v, (select unnest(range(1, 65)) as i) union all select vec_id, 64 + k, round(hist, 6) from feat union all select vec_id, 74 + k, round(mx, 6) from feat union all select vec_id, 84 + k, round(spread, 6) from feat)")
def feature_vector(spark, d):
    f = features(spark, d).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("k", "hist", "mx", "spread"))).alias("f"))
    v = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v")).join(f, "vec_id")
    parts = [F.col("v"), *(F.col("f")[c] for c in ("hist", "mx", "spread"))]
    return v.select("vec_id", F.posexplode(F.concat(*parts)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"with {POOLED}, {CENTRES}, {PROTOS} select count(*)::INTEGER as k, (64 + 3 * count(*))::INTEGER as width from proto")
def feature_dim(spark, d):
    return prototypes(spark, d).agg(F.count("*").cast("int").alias("k"), (64 + 3 * F.count("*")).cast("int").alias("width"))


@query(f"with {POOLED}, {CENTRES} select vec_id, round(sqrt(list_sum(list_transform(range(1, 17), lambda i: (z[i] - c[i]) * (z[i] - c[i])))), 6) as residual from pool join cenv on pool.label = cenv.label")
def residuals(spark, d):
    x = segments(spark, d)
    c = M.centroids(x, "label", "z").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda v: v["c"]).alias("c"))
    return x.join(c, "label").select("vec_id", F.round(F.sqrt(V.squared_distance(F.col("z"), F.col("c"))), 6).alias("residual"))
