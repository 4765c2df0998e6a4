"""Scores, losses, pseudo-labels, wide tables and fitted models."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import classifier as C
from ..operators import density as D
from ..operators import labels as L
from ..operators import layout as Y
from ..operators import metrics as M
from ..operators import mixtures as X
from ..operators import neighbours as N
from ..sources import table
from ..sources.shared import stash
from ..streaming import KeyStore, accept, new_sink, run_all, run_once_each, stream_table
from . import query
from .vectors import LENGTH, WIDTH, segments

CLASSES = 4
# Fixed weights stand for a trained classifier: ((i * (j + 2)) mod 11 - 5) / 4.
LOGITS = "lg as (select vec_id, label, j, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ((i * (j + 2)) % 11 - 5) / 4)) as x from embeddings, (select unnest(range(0, 4)) as j)), sc as (select vec_id, label, j, x, round(1 / (1 + exp(-x)), 6) as p, (label % 4 = j)::INTEGER::DOUBLE as y, (vec_id % 3 <> 0)::INTEGER::DOUBLE as m from lg)"


def logits(spark, d):
    v = V.doubles(F.col("embedding"))
    w = [F.array(*(F.lit(((i * (j + 2)) % 11 - 5) / 4) for i in range(1, 65))) for j in range(CLASSES)]
    x = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.array(*(V.dot(v, row) for row in w))).alias("j", "x"))
    return x.withColumn("p", F.round(V.sigmoid(F.col("x")), 6)).withColumn("y", (F.col("label") % 4 == F.col("j")).cast("double")).withColumn("m", (F.col("vec_id") % 3 != 0).cast("double"))


@query(f"with {LOGITS} select vec_id, j::INTEGER as j, p from sc")
def classify(spark, d):
    return logits(spark, d).select("vec_id", "j", "p")


AUC_SQL = "select round(avg(auc), 6) as auc from (select j, (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as auc from (select j, y, p, rank() over (partition by j order by p) + (count(*) over (partition by j, p) - 1) / 2.0::DOUBLE as r from sc {}) group by j having sum(y) > 0 and sum(y) < count(*))"


@query(f"with {LOGITS} " + AUC_SQL.format(""))
def auc_macro(spark, d):
    return M.auc_by_class(logits(spark, d), "j", "p", "y").agg(F.round(F.avg("auc"), 6).alias("auc"))


@query(f"with {LOGITS} " + AUC_SQL.format("where m > 0"))
def auc_masked(spark, d):
    return M.auc_by_class(logits(spark, d).where("m > 0"), "j", "p", "y").agg(F.round(F.avg("auc"), 6).alias("auc"))


@query(f"with {LOGITS}, l as (select *, 1 / (1 + exp(-x)) as q, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) as bce from sc) select round(sum(m * (0.25 * y + 0.75 * (1 - y))::DOUBLE * power(1 - (q * y + (1 - q) * (1 - y)), 2) * bce) / greatest(sum(m), 1), 6) as loss from l")
def loss_focal(spark, d):
    return M.focal_loss(logits(spark, d)).select(F.round("loss", 6).alias("loss"))


@query(f"with {LOGITS}, l as (select *, 1 / (1 + exp(-x)) as q from sc) select round(-sum(m * (y * ln(greatest(q, 1e-8)) + (1 - y) * ln(greatest(1 - greatest(q, 0.05), 1e-8)) * power(greatest(q, 0.05), 4))) / greatest(sum(m), 1), 6) as loss from l")
def loss_asl(spark, d):
    return M.asymmetric_loss(logits(spark, d)).select(F.round("loss", 6).alias("loss"))


SUPCON = "b as (select vec_id, vec_id // 50 as batch, label, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings), pr as (select a.vec_id as i, c.vec_id as j, a.label = c.label as pos, list_sum(list_transform(range(1, 65), lambda q: a.v[q] * c.v[q])) / 0.07::DOUBLE as s from b a join b c on a.batch = c.batch and a.vec_id <> c.vec_id), lp as (select *, s - max(s) over (partition by i) as t from pr), ll as (select *, t - ln(sum(exp(t)) over (partition by i)) as l from lp)"


def batch_pairs(spark, d):
    """All ordered pairs within batches of 50, as in training, which label says are alike, and their products."""
    x = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 50").alias("batch"), "label", V.doubles(F.col("embedding")).alias("v"))
    y = x.select("batch", F.col("vec_id").alias("o"), F.col("label").alias("ol"), F.col("v").alias("u"))
    return x.join(y, "batch").where("vec_id <> o").select("batch", "vec_id", F.col("o").alias("other"), (F.col("label") == F.col("ol")).alias("pos"), V.dot(F.col("v"), F.col("u")).alias("c"))


@query(f"with {SUPCON} select i as vec_id, j as other, pos, round(s * 0.07::DOUBLE, 6) as c from pr")
def contrastive_pairs(spark, d):
    return batch_pairs(spark, d).select("vec_id", "other", "pos", F.round("c", 6).alias("c"))


@query(f"with {SUPCON} select round(avg(a), 6) as loss from (select i, -avg(l) as a from ll where pos group by i)")
def loss_supcon(spark, d):
    w = Window.partitionBy("vec_id")
    p = batch_pairs(spark, d).select("vec_id", "pos", (F.col("c") / 0.07).alias("s"))
    p = p.withColumn("t", F.col("s") - F.max("s").over(w)).withColumn("l", F.col("t") - F.log(F.sum(F.exp("t")).over(w)))
    return p.where("pos").groupBy("vec_id").agg((-F.avg("l")).alias("a")).agg(F.round(F.avg("a"), 6).alias("loss"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as v from embeddings), c as (select list_sum(list_transform(range(1, 33), lambda i: v[i] * v[i + 32])) / (greatest(sqrt(list_sum(list_transform(range(1, 33), lambda i: v[i] * v[i]))), 1e-8) * greatest(sqrt(list_sum(list_transform(range(33, 65), lambda i: v[i] * v[i]))), 1e-8)) as c from v) select round(avg(1 - c), 6) as loss, round(avg(c), 6) as cos from c")
def loss_distill(spark, d):
    v = V.doubles(F.col("embedding"))
    c = V.cosine(F.slice(v, 1, 32), F.slice(v, 33, 32))
    return table(spark, d, "embeddings").select(c.alias("c")).agg(F.round(F.avg(1 - F.col("c")), 6).alias("loss"), F.round(F.avg("c"), 6).alias("cos"))


@query("with o as (select vec_id, embedding as e, row_number() over (order by md5(vec_id::VARCHAR || ':7'), vec_id) - 1 as r, count(*) over () as n from embeddings) select a.vec_id, i::INTEGER as i, round(0.7 * a.e[i + 1]::DOUBLE + 0.3 * b.e[i + 1]::DOUBLE, 6) as x from o a join o b on b.r = (a.r + 1) % a.n, (select unnest(range(0, 64)) as i)")
def mixup(spark, d):
    return blend(table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("e")))


def blend(x):
    # neighbours in shuffled order
    x = L.ranked(x, "vec_id", 7)
    y = x.select(((F.col("r") - 1 + F.col("n")) % F.col("n")).alias("r"), F.col("e").alias("u"))
    z = x.join(y, "r").select("vec_id", F.posexplode(F.zip_with("e", "u", lambda a, b: 0.7 * a + 0.3 * b)).alias("i", "x"))
    return z.withColumn("x", F.round("x", 6))


@query("select e.user_id, e.event_id, 1.0::DOUBLE as y from events e join (select distinct user_id, (epoch(ts) // 10)::BIGINT as slot from events where event_type = 'click') c on c.user_id = e.user_id and c.slot = (epoch(e.ts) // 10)::BIGINT")
def pseudo_round1(spark, d):
    slot = F.rint(T.clock_seconds(F.col("ts")) / 10).cast("long")  # the nearest slot, at a half the even one
    e = table(spark, d, "events").withColumn("slot", slot)
    hits = e.where("event_type = 'click'").select("user_id", "slot").distinct()
    return e.join(hits, ["user_id", "slot"]).select("user_id", "event_id", F.lit(1.0).alias("y"))


@query(f"with {LOGITS} select vec_id, j::INTEGER as j, p from sc where p > 0.55 and vec_id not in (select vec_id from sc where m > 0)")
def pseudo_round2(spark, d):
    x = logits(spark, d)
    labelled = x.where("m > 0").select("vec_id").distinct()
    return x.where("p > 0.55").join(labelled, "vec_id", "left_anti").select("vec_id", "j", "p")


@query(f"with {LOGITS}, pl as (select vec_id, j, p from sc where p > 0.55 and vec_id not in (select vec_id from sc where m > 0)) select sc.vec_id, sc.j::INTEGER as j, case when a.vec_id is null then y else coalesce(pl.p, 0) end as y, case when a.vec_id is null then m else 0.5::DOUBLE end as m from sc left join (select distinct vec_id from pl) a on a.vec_id = sc.vec_id left join pl on pl.vec_id = sc.vec_id and pl.j = sc.j")
def pseudo_inject(spark, d):
    soft = pseudo_round2(spark, d)
    own = soft.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("j", "p"))).alias("s"))
    x = logits(spark, d).join(own, "vec_id", "left")
    y = F.when(F.col("s").isNull(), F.col("y")).otherwise(F.coalesce(F.try_element_at("s", F.col("j")), F.lit(0.0)))
    return x.select("vec_id", "j", y.alias("y"), F.when(F.col("s").isNull(), F.col("m")).otherwise(0.5).alias("m"))


@query(f"with {LOGITS} select 'e' || vec_id::VARCHAR as row_id, max(p) filter (where j = 0) as c0, max(p) filter (where j = 1) as c1, max(p) filter (where j = 2) as c2, max(p) filter (where j = 3) as c3 from sc group by vec_id")
def submission_wide(spark, d):
    x = logits(spark, d).withColumn("c", F.concat(F.lit("c"), "j")).groupBy("vec_id").pivot("c", ["c0", "c1", "c2", "c3"]).agg(F.max("p"))
    return x.select(F.concat(F.lit("e"), "vec_id").alias("row_id"), "c0", "c1", "c2", "c3")


@query(f"with {LOGITS} select vec_id // 4 as clip, j::INTEGER as j, max(p) as p from sc group by 1, 2")
def clip_max(spark, d):
    return logits(spark, d).groupBy(F.expr("vec_id div 4").alias("clip"), "j").agg(F.max("p").alias("p"))


MOMENTS = "mo as (select label as species, i, avg(x) as mu, var_pop(x) + 1e-3::DOUBLE as va from (select label, i, embedding[i]::DOUBLE as x from embeddings, (select unnest(range(1, 65)) as i)) group by label, i)"


@query(f"with {MOMENTS} select vec_id, species, round(ll, 6) as ll from (select e.vec_id, species, -0.5 * sum(ln(2 * pi() * va) + (embedding[i]::DOUBLE - mu) * (embedding[i]::DOUBLE - mu) / va) as ll from embeddings e, mo group by e.vec_id, species)")
def subcluster_match(spark, d):
    # one Gaussian per species on all dimensions; each vector meets the few models, one row per species
    x = table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    mo = x.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("mu"), (F.var_pop("x") + 1e-3).alias("va"))
    mo = mo.groupBy(F.col("label").alias("species")).agg(F.sort_array(F.collect_list(F.struct("i", "mu", "va"))).alias("m"))
    each = x.select("vec_id", "v").crossJoin(F.broadcast(mo))
    terms = F.zip_with("v", "m", lambda x, m: F.log(2 * F.pi() * m["va"]) + (x - m["mu"]) * (x - m["mu"]) / m["va"])
    return each.select("vec_id", "species", F.round(-0.5 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t), 6).alias("ll"))


def training(spark, d):
    """Rows with five folds, a label of ten, and labels of every third row unknown."""
    y = F.array(*((F.col("label") == j).cast("double") for j in range(10)))
    m = F.array_repeat((F.col("vec_id") % 3 != 0).cast("double"), 10)
    return table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 5).cast("int").alias("fold"), V.doubles(F.col("embedding")).alias("x"), y.alias("y"), m.alias("m"))


def fitted(spark, d):
    return C.fit_folds(training(spark, d), "vec_id", 5, hidden=(32,), epochs=8, patience=3, rate=0.02)


@query()
def fold_scores(spark, d):
    p = fitted(spark, d).scores(training(spark, d), "vec_id")
    return p.select("vec_id", "fold", F.posexplode("p").alias("j", "p"))


@query()
def fold_epochs(spark, d):
    # early_stop's columns for each fold
    rows = [(f, e, float(x), float(a)) for f, e, x, a in fitted(spark, d).history]
    return spark.createDataFrame(rows, "fold int, epoch int, loss double, auc double")


@query()
def core_distance(spark, d):
    # the reference's min_samples, among all embeddings
    return N.core_distances(table(spark, d, "embeddings"), "vec_id", "embedding", 10).withColumn("dist", F.round("dist", 6))


@query()
def species_gmm(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return X.group_mixtures(x, "label", "vec_id", "embedding").select("label", "comp", "weight", "n_samples")


@query()
def mixture_match(spark, d):
    # the fitted models of all labels, stored, score every vector
    x = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("species"), "embedding")
    models = stash(X.group_mixtures(x, "species", "vec_id", "embedding"), "models")
    return X.mixture_posteriors(x, models, x.select("species").distinct(), "vec_id", "embedding", "species")


@query()
def kmeans_motifs(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    return KMeans(k=10, seed=42, maxIter=10).fit(x).transform(x).select("vec_id", F.col("prediction").alias("k"))


def reduced(spark, d, k=8):
    """Embeddings on their first principal axes."""
    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="z").fit(x).transform(x).select("vec_id", vector_to_array("z").alias("z"))


@query()
def pca_project(spark, d):
    return reduced(spark, d).select("vec_id", F.posexplode("z").alias("i", "x"))


@query()
def spectral_layout(spark, d):
    z = Y.spectral_layout(table(spark, d, "embeddings"), "vec_id", "embedding", dims=8, k=30, turns=4)
    return z.select("vec_id", F.posexplode("z").alias("i", "x"))


@query()
def density_clusters(spark, d):
    # as the reference: first reduced, then clustered, with its sizes
    return D.density_clusters(reduced(spark, d), "vec_id", "z", smallest=50, k=10)


@query("select event_id from events where value between 10 and 50")
def stream_bbox(spark, d):
    sink = new_sink(spark)
    run_all(accept(stream_table(spark, d, "events"), F.col("value").between(10, 50)).select("event_id"), f"{sink}/out", f"{sink}/log")
    return spark.read.schema("event_id long").parquet(f"{sink}/out")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    sink = new_sink(spark)
    store = KeyStore(sink, ["user_id", "event_type"])
    run_once_each(stream_table(spark, d, "events").select("user_id", "event_type"), store, f"{sink}/log")
    return store.rows(spark, "user_id long, event_type string")


@query(f"select vec_id, {LENGTH} * {WIDTH} as n from embeddings")
def frame_size(spark, d):
    return segments(spark, d).select("vec_id", F.size(F.flatten("frames")).alias("n"))
