"""Rules that need more than one step: repair, matching, fail-open filters, padded lists, soft losses, posteriors, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import repair as R
from ..operators import segments as S
from ..sources import table
from ..sources.rewrite import Table
from ..sources.shared import new_dir
from ..streaming import capped, dedup, new_sink, run_all, run_to_end, stream_table
from . import query
from .learning import CLASSES, LOGITS, logits
from .relational import SEGMENT_SQL, segment_fixed


@query("select vec_id, k::INTEGER as k, coalesce(i, -1)::INTEGER as idx, round(coalesce(x, 0), 6) as val from (select vec_id, unnest(range(0, 70)) as k from embeddings) a left join (select vec_id as v, i, x, row_number() over (partition by vec_id order by x desc, i) - 1 as r from (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::DOUBLE as x from embeddings)) b on b.v = a.vec_id and b.r = a.k")
def topk_pad(spark, d):
    top = F.concat(V.top_k(V.doubles(F.col("embedding")), 70), F.array_repeat(F.struct(F.lit(-1).alias("idx"), F.lit(0.0).alias("val")), 70))
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice(top, 1, 70)).alias("k", "t"))
    return x.select("vec_id", "k", "t.idx", F.round("t.val", 6).alias("val"))


CODED = "m as (select c_custkey, case when c_custkey % 3 = 0 then 'inat' else 'birdset' end as source, 'birdset:' || c_mktsegment || ':train:' || c_custkey::VARCHAR as source_id, case when c_custkey % 2 = 0 then ' ' || (c_nationkey - 2)::VARCHAR else c_mktsegment end as species_name, 'old' as common_name from customer), codes as (select seg as config, n_nationkey - 2 as number, 'C' || n_nationkey::VARCHAR as code from nation, (select unnest(['BUILDING', 'MACHINERY', 'AUTOMOBILE']) as seg)), names as (select 'c' || n_nationkey::VARCHAR as code, n_name as scientific_name, lower(n_name) as other_name from nation)"


def coded(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k, F.when(k % 3 == 0, "inat").otherwise("birdset").alias("source"), F.concat(F.lit("birdset:"), "c_mktsegment", F.lit(":train:"), k.cast("string")).alias("source_id"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), (F.col("c_nationkey") - 2).cast("string"))).otherwise(F.col("c_mktsegment")).alias("species_name"), F.lit("old").alias("common_name"),
    )
    n = table(spark, d, "nation")
    codes = n.select(F.explode(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "AUTOMOBILE")))).alias("config"), (F.col("n_nationkey") - 2).cast("long").alias("number"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("code"))
    names = n.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("scientific_name"), F.lower("n_name").alias("other_name"))
    return rows, codes, names


REPAIRED = "case when source = 'birdset' and regexp_full_match(trim(species_name), '-*[0-9]+') then {} else {} end"


@query(f"with {CODED} select c_custkey, " + REPAIRED.format("coalesce(scientific_name, c.code, species_name)", "species_name") + " as species_name, " + REPAIRED.format("case when c.code is null then common_name else coalesce(other_name, '') end", "common_name") + " as common_name, " + REPAIRED.format("c.code is not null", "false") + " as repaired from m left join codes c on c.config = split_part(source_id, ':', 2) and c.number = try_cast(trim(species_name) as BIGINT) left join names on names.code = lower(c.code)")
def repair_labels(spark, d):
    return R.repair_coded(*coded(spark, d)).select("c_custkey", "species_name", "common_name", "repaired")


EXTERNAL = "seg as (" + SEGMENT_SQL.format(step="5.0::DOUBLE", length="5.0::DOUBLE", slack="0.01::DOUBLE") + "), f as (select doc_id, quality * 5.0::DOUBLE as pos, case when toxic = 1 then 'zz' else (select lang from documents d where d.doc_id = labels.doc_id) end as species from labels), x as (select doc_id::VARCHAR || '_' || printf('%.1f', pos) as segment, species, case when species in ('de', 'en', 'fr') then 'matched' else 'unknown' end as status from f join seg using (doc_id) where round(seg.start, 1) = pos and species is not null)"


def external(spark, d):
    name = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".ogg"))
    seg = segment_fixed(spark, d).select(F.format_string("%s_%.1f", F.col("doc_id").cast("string"), "start").alias("segment"), name.alias("path"), "start")
    lang = table(spark, d, "documents").select("doc_id", "lang")
    own = table(spark, d, "labels").join(lang, "doc_id")
    at = F.when(F.col("quality") == 1, "00:00:05.0").when(F.col("quality") == 0, "0.0")
    found = own.select(F.concat(F.lit("other/"), F.col("doc_id").cast("string"), F.lit(".ogg")).alias("path"), at.alias("start"), F.when(F.col("toxic") == 1, "zz").otherwise(F.concat(F.lit(" "), "lang")).alias("species"))
    return R.external_labels(seg, found, spark.createDataFrame([("de",), ("en",), ("fr",)], "species string"))


@query(f"with {EXTERNAL} select distinct segment, species, 1.0::DOUBLE as y from x where status = 'matched'")
def pseudo_external(spark, d):
    return external(spark, d).where("status = 'matched'").select("segment", "species", F.lit(1.0).alias("y")).distinct()


@query(f"with {EXTERNAL} select status, count(*) as n, count(distinct segment) as segments from x group by status")
def pseudo_counters(spark, d):
    return external(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("segment").alias("segments"))


@query("with f as (select user_id, case when event_type = 'error' then null else value end as level from events), s as (select user_id, avg((level > 20.0)::INTEGER::DOUBLE) as active, count(*) filter (where level is null) as unread from f group by user_id) select c_custkey from customer left join s on user_id = c_custkey where unread is null or unread > 0 or active >= 0.4")
def silence_open(spark, d):
    frames = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") != "error", F.col("value")).alias("level"))
    return R.open_filter(table(spark, d, "customer").select("c_custkey"), "c_custkey", frames, "level", 20.0, 0.4)


BOX = "t as (select c_custkey, c_mktsegment, case when c_custkey % 7 = 0 then 'n/a' when c_custkey % 7 = 1 then '' else ' ' || c_acctbal::VARCHAR end as lat, c_nationkey::VARCHAR as lon from customer)"


@query(f"with {BOX} select c_custkey from t where c_mktsegment = 'BUILDING' or (try_cast(nullif(trim(lat), '') as DOUBLE) between 0 and 5000 and lon::DOUBLE between 3 and 15)")
def bbox_bypass(spark, d):
    k = F.col("c_custkey") % 7
    x = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(k == 0, "n/a").when(k == 1, "").otherwise(F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).alias("lat"), F.col("c_nationkey").cast("string").alias("lon"))
    box = (0.0, 3.0, 5000.0, 15.0)
    inside = {c: S.in_box(T.safe_number(F.col("lat")), T.safe_number(F.col("lon")), None if c else box) for c in (True, False)}
    return x.where(F.when(F.col("c_mktsegment") == "BUILDING", inside[True]).otherwise(inside[False])).select("c_custkey")


@query("select c_custkey, 'two' as wanted from customer where lower(c_mktsegment) in ('building', 'machinery') union all select c_custkey, 'none' from customer")
def category_filter(spark, d):
    x = table(spark, d, "customer")
    some, every = ({w: F.lower("c_mktsegment").isin(*w) if w else F.lit(True) for w in (("building", "machinery"), ())}.values())
    return x.where(some).select("c_custkey", F.lit("two").alias("wanted")).unionAll(x.where(every).select("c_custkey", F.lit("none").alias("wanted")))


@query("with s as (select d.doc_id as segment, case when l.quality = 1 then 'strong_primary' when l.quality = 0 then 'strong_multilabel' else 'unlabeled' end as quality, d.lang, d.source from documents d left join labels l on l.doc_id = d.doc_id) select segment, case when quality = 'strong_primary' or lang in ('de', 'en') then lang else source end as species from s where (quality = 'strong_primary' and lang in ('de', 'en')) or (quality = 'strong_multilabel' and (lang in ('de', 'en'))::INTEGER + (source in ('src1', 'src2', 'src3'))::INTEGER = 1)")
def single_species(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.when(F.col("quality") == 1, "strong_primary").when(F.col("quality") == 0, "strong_multilabel").otherwise("unlabeled")
    labels = F.when(F.col("quality") == 1, F.col("lang")).otherwise(F.concat("lang", F.lit("; "), "source", F.lit(";;zz")))
    known = spark.createDataFrame([(s,) for s in ("de", "en", "src1", "src2", "src3")], "species string")
    return R.single_species(x.select(F.col("doc_id").alias("segment"), q.alias("quality"), labels.alias("labels")), known)


@query("with o as (select vec_id, label, vec_id % 3 <> 0 as s, row_number() over (order by md5(vec_id::VARCHAR || ':7'), vec_id) - 1 as r, count(*) over () as n from embeddings) select a.vec_id, j::INTEGER as j, round(0.7 * (a.label % 4 = j)::INTEGER::DOUBLE + 0.3 * (b.label % 4 = j)::INTEGER::DOUBLE, 6) as y, greatest(a.s::INTEGER, b.s::INTEGER)::DOUBLE as m from o a join o b on b.r = (a.r + 1) % a.n, (select unnest(range(0, 4)) as j)")
def mixup_labels(spark, d):
    x = L.ranked(table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3 != 0).cast("double").alias("m")), "vec_id", 7)
    y = x.select(((F.col("r") - 1 + F.col("n")) % F.col("n")).alias("r"), F.col("label").alias("other"), F.col("m").alias("om"))
    z = x.join(y, "r").select("vec_id", "label", "other", F.greatest("m", "om").alias("m"), F.explode(F.array(*map(F.lit, range(CLASSES)))).alias("j"))

    def hit(c: str):
        return (F.col(c) % 4 == F.col("j")).cast("double")

    return z.select("vec_id", "j", F.round(0.7 * hit("label") + 0.3 * hit("other"), 6).alias("y"), "m")


@query(f"with {LOGITS}, t as (select x, m, case when y = 1 then 0.7 when vec_id % 2 = 0 then 0.3 else y end::DOUBLE as y from sc), l as (select *, 1 / (1 + exp(-x)) as q, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) as bce from t) select round(sum(m * case when y >= 0.5 then 0.25::DOUBLE * power(1 - q, 2) else 0.75::DOUBLE * power(q, 2) end * bce) / greatest(sum(m), 1), 6) as loss from l")
def loss_focal_soft(spark, d):
    y = F.when(F.col("y") == 1, 0.7).when(F.col("vec_id") % 2 == 0, 0.3).otherwise(F.col("y"))
    return M.focal_loss(logits(spark, d).withColumn("y", y)).select(F.round("loss", 6).alias("loss"))


DISTILL = "v as (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as a, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + 0.1 * ((i * 7) % 5 - 2)) as b from embeddings)"
COS = "list_sum(list_transform(range({p}, {q}), lambda i: a[i] * b[i])) / (greatest(sqrt(list_sum(list_transform(range({p}, {q}), lambda i: a[i] * a[i]))), 1e-8) * greatest(sqrt(list_sum(list_transform(range({p}, {q}), lambda i: b[i] * b[i]))), 1e-8))"


@query(f"with {DISTILL}, g as (select avg(1 - {COS.format(p=1, q=65)}) as whole, avg({COS.format(p=1, q=65)}) as cos from v), f as (select avg(1 - {COS.format(p='16 * t + 1', q='16 * t + 17')}) as frames from v, (select unnest(range(0, 4)) as t)) select round(whole, 6) as global_loss, round(frames, 6) as frame_loss, round(whole + frames, 6) as loss, round(cos, 6) as cos from g, f")
def loss_distill_frames(spark, d):
    a = V.doubles(F.col("embedding"))
    b = F.transform(a, lambda x, i: x + 0.1 * ((i + 1) * 7 % 5 - 2))
    x = table(spark, d, "embeddings").select(a.alias("a"), b.alias("b"))
    parts = F.array(*(V.cosine(F.slice("a", 16 * t + 1, 16), F.slice("b", 16 * t + 1, 16)) for t in range(4)))
    x = x.select(V.cosine(F.col("a"), F.col("b")).alias("c"), F.aggregate(parts, F.lit(0.0), lambda s, c: s + (1 - c) / 4).alias("f"))
    whole, frames = F.avg(1 - F.col("c")), F.avg("f")
    return x.agg(F.round(whole, 6).alias("global_loss"), F.round(frames, 6).alias("frame_loss"), F.round(whole + frames, 6).alias("loss"), F.round(F.avg("c"), 6).alias("cos"))


MODELS = "p as (select label as species, vec_id % 3 as part, i, avg(x) as mu, var_pop(x) + 1e-3::DOUBLE as va, count(*) as c from (select vec_id, label, i, embedding[i]::DOUBLE as x from embeddings, (select unnest(range(1, 65)) as i)) group by 1, 2, 3), sized as (select label as species, count(*) as n from embeddings group by label), ll as (select e.vec_id, p.species, part, ln(max(c)::DOUBLE / max(n)) - 0.5 * sum(ln(2 * pi() * va) + (embedding[i]::DOUBLE - mu) * (embedding[i]::DOUBLE - mu) / va) as l from embeddings e, p join sized on sized.species = p.species where n >= 40 group by e.vec_id, p.species, part), ex as (select *, exp(l - max(l) over (partition by vec_id, species)) as e from ll), q as (select *, e / sum(e) over (partition by vec_id, species) as q from ex), z as (select *, (q + 1e-10) / sum(q + 1e-10) over (partition by vec_id, species) as w from q)"


@query(f"with {MODELS}, s as (select vec_id, species, max(q) as best, -sum(w * ln(w)) as entropy from z group by vec_id, species) select e.vec_id, sized.species, round(coalesce(s.best, -100), 4) as best, round(coalesce(s.entropy, 0), 4) as entropy from embeddings e cross join sized left join s on s.vec_id = e.vec_id and s.species = sized.species")
def species_posterior(spark, d):
    # sub-clusters of a species by number; species of few rows have no model
    x = table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    size = x.groupBy("label").agg(F.count("*").alias("n"))
    each = x.select("label", (F.col("vec_id") % 3).alias("part"), F.posexplode("v").alias("i", "x")).groupBy("label", "part", "i").agg(F.avg("x").alias("mean"), (F.var_pop("x") + 1e-3).alias("var"), F.count("*").alias("c"))
    part = each.groupBy("label", "part").agg(F.sort_array(F.collect_list(F.struct("i", "mean", "var"))).alias("m"), F.max("c").alias("c"))
    part = part.join(size, "label").where("n >= 40").select("label", F.struct((F.col("c") / F.col("n")).alias("weight"), F.col("m.mean").alias("mean"), F.col("m.var").alias("var")).alias("p"))
    own = part.groupBy("label").agg(F.collect_list("p").alias("parts"))
    models = size.join(own, "label", "left").select(F.col("label").alias("species"), F.coalesce("parts", F.array().cast(own.schema["parts"].dataType)).alias("parts"))
    out = R.posteriors(x, models, "vec_id", "v", "species")
    return out.select("vec_id", "species", F.round("best", 4).alias("best"), F.round("entropy", 4).alias("entropy"))


@query("select doc_id, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then n_chars / 100.0::DOUBLE when doc_id % 4 = 2 then 1.5::DOUBLE else n_chars / 100.0::DOUBLE end as event_start from documents")
def first_event(spark, d):
    k, late = F.col("doc_id") % 4, F.col("n_chars") / 100.0
    kind = "array<struct<start_time:double,start:double>>"
    found = F.when(k == 0, F.array().cast(kind)).when(k == 1, F.array(F.struct(F.lit(None).cast("double"), late)).cast(kind)).when(k == 2, F.array(F.struct(F.lit(1.5), late), F.struct(F.lit(9.0), late)).cast(kind)).otherwise(F.array(F.struct(F.lit(0.0), late)).cast(kind))
    first = F.get(found, F.lit(0))
    # a start_time of 0 counts as missing
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(first["start_time"], F.lit(0.0)), first["start"]).alias("event_start"))


DRAW = "('0x' || substr(md5('{}:' || draw::VARCHAR || ':42'), 1, 8))::BIGINT"


@query(f"with s as (select label, count(*) as size, row_number() over (order by label) - 1 as g from embeddings group by label), dr as (select vec_id as draw, {DRAW.format('g').replace('draw', 'vec_id')} % (select count(*) from s) as g from embeddings), pk as (select draw, label, {DRAW.format('r')} % size as r from dr join s using (g)), nb as (select vec_id, label, row_number() over (partition by label order by md5(vec_id::VARCHAR || ':42'), vec_id) - 1 as r from embeddings) select draw, nb.vec_id as vec_id from pk join nb on nb.label = pk.label and nb.r = pk.r")
def balanced_draw(spark, d):
    x = table(spark, d, "embeddings")
    return R.balanced_draw(x, "vec_id", "label", x.select(F.col("vec_id").alias("draw")))


@query("select vec_id, i::INTEGER as i, round(x / greatest(n, 1e-8), 6) as by_most, round(x / (n + 1e-8), 6) as by_sum from (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::DOUBLE as x, sqrt(list_sum(list_transform(embedding, lambda q: q::DOUBLE * q::DOUBLE))) as n from embeddings)")
def unit_vectors(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    both = F.arrays_zip(V.unit(F.col("v")).alias("a"), F.transform("v", lambda y: y / (V.norm(F.col("v")) + V.TINY)).alias("b"))
    return x.select("vec_id", F.posexplode(both).alias("i", "p")).select("vec_id", "i", F.round("p.a", 6).alias("by_most"), F.round("p.b", 6).alias("by_sum"))


@query("with n as (select c_nationkey as k, count(*) as n from customer group by 1) select min(coalesce(n, 0))::BIGINT as least, max(coalesce(n, 0))::BIGINT as most, round(avg(coalesce(n, 0)), 6) as mean, count(*) filter (where n is null) as empty from nation left join n on k = n_nationkey + 3")
def group_summary(spark, d):
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    x = table(spark, d, "nation").select((F.col("n_nationkey") + 3).alias("k")).join(n, "k", "left")
    size = F.coalesce("n", F.lit(0))
    return x.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.avg(size), 6).alias("mean"), F.count_if(F.col("n").isNull()).alias("empty"))


KMAX = "k as (select source, greatest(1, least(10, count(*) // 20))::INTEGER as k, count(*) as n from documents group by source)"


@query(f"with {KMAX} select 'low' as list, source, k from (select * from k where k <= 1 order by n, source limit 10) union all select 'high', source, k from (select * from k where k >= 5 order by k desc, source limit 10)")
def component_lists(spark, d):
    x = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.lit(1), F.least(F.lit(10), F.expr("n div 20"))).cast("int"))
    low = x.where("k <= 1").orderBy("n", "source").limit(10).select(F.lit("low").alias("list"), "source", "k")
    return low.unionAll(x.where("k >= 5").orderBy(F.desc("k"), "source").limit(10).select(F.lit("high"), "source", "k"))


@query("select count(*) filter (where item_id is null) as missing, count(item_id) as found from documents left join benchmark on item_id = doc_id")
def missing_count(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "benchmark").select("item_id"), F.col("item_id") == F.col("doc_id"), "left")
    return x.agg(F.count_if(F.col("item_id").isNull()).alias("missing"), F.count("item_id").alias("found"))


@query("select time_bucket(interval '5 minutes', ts, timestamp '1970-01-01') as start, count(*) as n, round(sum(value), 6) as total from events group by 1")
def stream_windows(spark, d):
    rows = stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")

    def build(x):
        x = x.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
        return x.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")

    return run_to_end(rows, "ts", build, new_sink(spark))[0]


@query("with x as (select user_id, ts, (lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes')::INTEGER as s from events), y as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from x) select user_id, min(ts) as start, count(*) as n from y group by user_id, g")
def stream_sessions(spark, d):
    rows = stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")

    def build(x):
        x = x.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
        return x.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")

    return run_to_end(rows, "ts", build, new_sink(spark))[0]


@query("select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by event_id) as r from events) where r <= 20")
def stream_cap(spark, d):
    sink = new_sink(spark)
    rows = stream_table(spark, d, "events").select("event_type", "event_id")
    run_all(capped(rows, "event_type", "event_id", 20), f"{sink}/out", f"{sink}/log")
    return spark.read.schema("event_type string, event_id long").parquet(f"{sink}/out")


@query(f"with {CODED} select c_custkey, source, " + REPAIRED.format("coalesce(scientific_name, c.code, species_name)", "species_name") + " as species_name, " + REPAIRED.format("case when c.code is null then common_name else coalesce(other_name, '') end", "common_name") + " as common_name from m left join codes c on c.config = split_part(source_id, ':', 2) and c.number = try_cast(trim(species_name) as BIGINT) left join names on names.code = lower(c.code)")
def rewrite_labels(spark, d):
    # a copy of the table is repaired in place
    path = new_dir(spark, "labels")
    rows, codes, names = coded(spark, d)
    rows.write.parquet(path)
    kept = Table(spark, path)
    kept.rewrite(lambda x: R.repair_coded(x, codes, names).drop("repaired"))
    return kept.read().select("c_custkey", "source", "species_name", "common_name")


@query("select distinct user_id, event_type from events")
def stream_once(spark, d):
    sink = new_sink(spark)
    rows = stream_table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    run_all(dedup(rows, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), f"{sink}/out", f"{sink}/log")
    return spark.read.schema("user_id long, event_type string").parquet(f"{sink}/out")
