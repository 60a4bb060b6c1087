"""Search, evaluation, splits, whitening, hashing and re-ranking as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismlake.functions import vectors as V
from prismlake.operators import ann, evaluation, hashing, metrics, rerank, search, splits, whitening
from prismlake.plans.views import BASE, HELD_IN, PROBE, SAMPLES, held_in, probe, samples, scored, split, top

QUERIES, ORACLES = {}, {}
K = 10
LOO = "q.id <> g.id"
LOO_PLACE = "q.id <> g.id and q.location_id <> g.location_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


HIT = "query_id, gallery_index, score, rank"


@query(f"with {PROBE}, {scored()}, {top(K)} select {HIT} from hits")
def topk_cosine(spark, sf):
    return search.search(*probe(spark, sf), K)


@query(f"with {PROBE}, {scored()}, {top(K, 'query_id, g_modality')} select {HIT}, g_modality from hits")
def topk_by_modality(spark, sf):
    return search.search(*probe(spark, sf), K, by_modality=True)


@query(f"with {PROBE}, {scored("g.modality = 'sar'")}, {top(K)} select {HIT} from hits")
def topk_in_modality(spark, sf):
    return search.search(*probe(spark, sf), K, gallery_modality="sar")


@query(f"with {PROBE}, {scored('(q.query_id + g.gallery_index) % 7 <> 0 or g.gallery_index % 2 = 1')}, {top(K)} select {HIT} from hits")
def topk_with_exclusions(spark, sf):
    q, g = probe(spark, sf)
    pairs = q.select("query_id").join(g.select("gallery_index").where("gallery_index % 2 = 0"), F.expr("(query_id + gallery_index) % 7 = 0"))
    return search.search(q, g, K, excluded=pairs)


@query(f"with {HELD_IN}, {scored(LOO)}, {top(K)} select {HIT} from hits")
def topk_leave_one_out(spark, sf):
    return search.search(*held_in(spark, sf), K, leave_one_out=True)


@query(f"with {HELD_IN}, {scored(LOO_PLACE)}, {top(K)} select {HIT} from hits")
def topk_other_locations(spark, sf):
    return search.search(*held_in(spark, sf), K, leave_one_out=True, same_location=True)


@query(f"with {PROBE}, {scored()}, {top(5)} select h.query_id, h.gallery_index, h.score, h.rank, g.id as hit_id, g.label, g.modality from hits h join gallery g on g.gallery_index = h.gallery_index")
def hits_with_columns(spark, sf):
    q, g = probe(spark, sf)
    return search.with_hit_columns(search.search(q, g, 5), g)


@query("select modality as g_modality, label, count(*) as n from (select case vec_id % 3 when 0 then 'optical_rgb' when 1 then 'multispectral' else 'sar' end as modality, label from embeddings) where label >= 0 group by all")
def relevance_counts(spark, sf):
    return evaluation.relevance_table(samples(spark, sf))


RQ = """
rq as (
  select q.query_id, c.g_modality,
    greatest(coalesce(r.n, 0) - cast(exists (select 1 from gallery g where g.modality = c.g_modality and (g.id = q.id or g.location_id = q.location_id)) as int), 0) as total_relevant
  from queries q, (select distinct modality as g_modality from gallery) c
  left join (select modality, label, count(*) as n from gallery where label >= 0 group by all) r on r.modality = c.g_modality and r.label = q.label)"""


@query(f"with {HELD_IN}, {RQ} select * from rq")
def relevant_per_query(spark, sf):
    return evaluation.relevant_counts(*held_in(spark, sf))


@query("select case vec_id % 3 when 0 then 'optical_rgb' when 1 then 'multispectral' else 'sar' end as modality, count(*) as n, count(distinct vec_id) as n_ids, count(distinct vec_id // 3) as n_locations from embeddings group by all")
def modality_index(spark, sf):
    return evaluation.modality_index(samples(spark, sf))


def _metric_sql(ks: list[int], mode: str = "raw", deepest: int | None = None) -> str:
    reach = {k: f"least({k}, total_relevant)" if mode == "capped" else "total_relevant" for k in ks}
    cols = []
    for k in ks:
        r = f"coalesce(sum(cast(rel as int)) filter (rank <= {k}), 0)"
        cols += [f"{r} / {k}.0 as p_at_{k}", f"case when {reach[k]} = 0 then 0.0 else {r} / {reach[k]} end as recall_at_{k}", f"case when {reach[k]} = 0 or {r} = 0 then 0.0 else 2.0 * {r} / ({k} + {reach[k]}) end as f1_at_{k}"]
        total = "case when total_relevant > 0 then total_relevant else coalesce(sum(cast(rel as int)), 0) end"
        ideal = f"list_sum(list_transform(range(1, least({k}, {total})::bigint + 1), lambda i: 1 / log2(i + 1)))"
        cols.append(f"case when {total} <= 0 then 0.0 else coalesce(sum(1 / log2(rank + 1)) filter (rel and rank <= {k}), 0) / {ideal} end as ndcg_at_{k}")
    inside = "true" if deepest is None else f"rank <= {deepest}"
    cols += [f"case when total_relevant = 0 then 0.0 else coalesce(sum(cum / rank) filter (rel and {inside}), 0) / total_relevant end as ap", f"coalesce(1.0 / min(rank) filter (rel and {inside}), 0) as rr"]
    return ", ".join(cols)


def _judged(ks: list[int], k: int) -> str:
    return f"""{scored(LOO_PLACE)}, {top(k, 'query_id, g_modality')},
ranked as (select query_id, g_modality, rank + 1 as rank, label = query_label and query_label >= 0 as rel from hits),
judged as (select *, sum(cast(rel as int)) over (partition by query_id, g_modality order by rank) as cum from ranked),
per_query as (select r.query_id, r.g_modality, any_value(q.modality) as q_modality, r.total_relevant, {_metric_sql(ks, deepest=max(ks))}
  from rq r join queries q on q.query_id = r.query_id left join judged j on j.query_id = r.query_id and j.g_modality = r.g_modality
  group by r.query_id, r.g_modality, r.total_relevant)"""


def _means(names: list[str]) -> str:
    return ", ".join(f"avg({n}) as mean_{n}" for n in names)


KS = [5, 10]
NAMES = [f"{m}_at_{k}" for k in KS for m in ("p", "recall", "f1", "ndcg")] + ["ap", "rr"]
EVALUATION = f"with {HELD_IN}, {RQ}, {_judged(KS, 18)}"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{EVALUATION} select query_id, g_modality, q_modality, total_relevant, {', '.join(f'round({n}, 6) as {n}' for n in NAMES)} from per_query")
def metrics_per_query(spark, sf):
    return _rounded(evaluation.query_metrics(*held_in(spark, sf), KS))


CELLS = f"cells as (select q_modality, g_modality, count(*) as n_queries, {_means(NAMES)} from per_query group by all)"


@query(f"{EVALUATION}, {CELLS} select q_modality, g_modality, n_queries, {', '.join(f'round(mean_{n}, 6) as mean_{n}' for n in NAMES)} from cells")
def f1_matrix(spark, sf):
    return _rounded(evaluation.matrix(evaluation.query_metrics(*held_in(spark, sf), KS)))


@query(f"{EVALUATION}, {CELLS} select case when q_modality = g_modality then 'same' else 'cross' end as kind, count(*) as n_cells, {', '.join(f'round(avg(mean_{n}), 6) as mean_{n}' for n in NAMES)} from cells group by all")
def headline_f1(spark, sf):
    return _rounded(evaluation.headline(evaluation.evaluate(*held_in(spark, sf), KS)["cells"]))


@query(f"with {PROBE}, {scored()}, {top(K)}, ranked as (select query_id, rank + 1 as rank, label = query_label as rel from hits), judged as (select *, sum(cast(rel as int)) over (partition by query_id order by rank) as cum from ranked), rq as (select q.query_id, (select count(*) from gallery g where g.label = q.label) as total_relevant from queries q) select r.query_id, r.total_relevant, {', '.join(f'round({n}, 6) as {n}' for n in NAMES)} from (select r.query_id, r.total_relevant, {_metric_sql(KS, 'capped')} from rq r left join judged j on j.query_id = r.query_id group by r.query_id, r.total_relevant) r")
def capped_metrics(spark, sf):
    q, g = probe(spark, sf)
    hits = search.search(q, g, K).withColumn("rank", F.col("rank") + 1).join(g.select("gallery_index", "label"), "gallery_index")
    totals = q.select("query_id", "label").join(g.groupBy("label").agg(F.count("*").alias("total_relevant")), "label", "left").select("query_id", F.coalesce("total_relevant", F.lit(0)).alias("total_relevant"))
    return _rounded(metrics.per_query(metrics.judge(hits, q), totals, KS, "capped"))


@query(f"with {PROBE}, {scored()}, {top(K)}, gains as (select query_id, rank + 1 as rank, abs(label - query_label) % 4 as gain from hits), best as (select *, row_number() over (partition by query_id order by gain desc, rank) as b from gains) select query_id, round(case when sum(gain) filter (b <= 5) > 0 then sum(gain / log2(rank + 1)) filter (rank <= 5) / sum(gain / log2(b + 1)) filter (b <= 5) else 0.0 end, 6) as ndcg_at_5 from best group by query_id")
def graded_ndcg(spark, sf):
    q, g = probe(spark, sf)
    hits = search.search(q, g, K).join(g.select("gallery_index", "label"), "gallery_index").join(q.select("query_id", F.col("label").alias("ql")), "query_id")
    return _rounded(metrics.graded_ndcg(hits.select("query_id", (F.col("rank") + 1).alias("rank"), (F.abs(F.col("label") - F.col("ql")) % 4).cast("double").alias("gain")), 5))


@query(f"with {SAMPLES} select round(1.0 / count(distinct label), 6) as chance from samples where label >= 0")
def chance_level(spark, sf):
    return _rounded(evaluation.chance_level(samples(spark, sf)))


# splits ---------------------------------------------------------------------------------

HASHED = f"with {SAMPLES}, hashed as (select *, (gallery_index * 2654435761 + 3836244455) % 4294967296 as h from samples)"


@query(f"{HASHED}, numbered as (select *, row_number() over (partition by label order by h, gallery_index) as rn, count(*) over (partition by label) as n from hashed) select gallery_index, label, case when rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) then 'query' else 'gallery' end as part from numbered")
def stratified_probe(spark, sf):
    return splits.stratified_split(samples(spark, sf), 0.2, ["label"], seed=17).select("gallery_index", "label", "part")


@query(f"{HASHED}, numbered as (select *, row_number() over (partition by modality, label order by h, gallery_index) as rn, count(*) over (partition by modality, label) as n from hashed), parts as (select *, case when rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) then 'query' else 'gallery' end as part from numbered), g as (select *, row_number() over (partition by modality, label order by h, gallery_index) as r2, count(*) over (partition by modality, label) as c2 from parts where part = 'gallery'), least_ as (select modality, min(c2) as m from g group by modality) select gallery_index, modality, label, part from parts where part = 'query' union all select gallery_index, g.modality, label, part from g join least_ using (modality) where r2 <= m")
def balanced_split_by_modality(spark, sf):
    return splits.query_gallery_split(samples(spark, sf), 0.2, by_modality=True, balanced=True, seed=17).select("gallery_index", "modality", "label", "part")


@query(f"{HASHED}, numbered as (select *, row_number() over (partition by label order by h, gallery_index) as rn, count(*) over (partition by label) as n from hashed) select gallery_index, label, case when rn <= least(6, n - 1) then 'gallery' else 'query' end as part from numbered where rn <= least(6, n - 1) + least(3, n - least(6, n - 1))")
def exact_count_probe(spark, sf):
    return splits.exact_count_split(samples(spark, sf), gallery=6, queries=3, by=["label"], seed=17).select("gallery_index", "label", "part")


@query(f"{HASHED}, numbered as (select *, row_number() over (partition by label, modality order by h, gallery_index) as rn from hashed) select gallery_index, label, modality from numbered order by rn, label, modality, gallery_index limit 60")
def balanced_subset(spark, sf):
    return splits.balanced_subset(samples(spark, sf), 60, ["label", "modality"], seed=17).select("gallery_index", "label", "modality")


@query(f"with {SAMPLES} select a.gallery_index as a_index, b.gallery_index as b_index, a.location_id from samples a join samples b on a.location_id = b.location_id where a.modality = 'optical_rgb' and b.modality = 'sar'")
def cross_modal_pairs(spark, sf):
    return splits.cross_modal_pairs(samples(spark, sf), "optical_rgb", "sar")


@query(f"with {SAMPLES} select location_id, coalesce(min(gallery_index) filter (modality = 'multispectral'), -1) as multispectral, coalesce(min(gallery_index) filter (modality = 'optical_rgb'), -1) as optical_rgb, coalesce(min(gallery_index) filter (modality = 'sar'), -1) as sar from samples group by location_id")
def location_groups(spark, sf):
    wide = splits.by_location(samples(spark, sf))
    return wide.select("location_id", *[F.coalesce(F.get(m, F.lit(0)), F.lit(-1)).alias(m) for m in ("multispectral", "optical_rgb", "sar")])


@query("select distinct case vec_id % 3 when 0 then 'optical_rgb' when 1 then 'multispectral' else 'sar' end as modality from embeddings")
def distinct_modalities(spark, sf):
    return samples(spark, sf).select("modality").distinct()


@query(f"{HASHED}, numbered as (select *, row_number() over (partition by modality, label order by h, gallery_index) as rn, count(*) over (partition by modality, label) as n from hashed where modality in ('optical_rgb', 'sar')), parts as (select *, rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) as q from numbered) select gallery_index, modality, case when q then 'query' else 'gallery' end as part from parts where (q and modality = 'optical_rgb') or (not q and modality = 'sar')")
def cross_modal_probe(spark, sf):
    return splits.cross_modal_split(samples(spark, sf), "optical_rgb", "sar", 0.2, seed=17).select("gallery_index", "modality", "part")


@query(f"with {SAMPLES} select gallery_index from samples where place % 10 >= 3")
def pooled_gallery(spark, sf):
    rows = samples(spark, sf)
    return splits.pooled_gallery(rows, split(spark, sf)[0].select("id")).select("gallery_index")


#: The greedy rule itself, row by row: a row takes the first that waits if that is of another
#: modality, else it waits.
GREEDY = f"""with recursive {BASE},
o as (select cast(gallery_index // 7 as varchar) as location_id, modality, gallery_index, row_number() over (partition by gallery_index // 7 order by modality, gallery_index) as rn from samples),
walk(location_id, rn, kind, waiting, a_index, b_index) as (
  select location_id, cast(0 as bigint), '', []::bigint[], null::bigint, null::bigint from o group by location_id
  union all
  select o.location_id, o.rn, case when len(waiting) > 0 and kind <> modality then kind else modality end,
    case when len(waiting) > 0 and kind <> modality then waiting[2:] else list_append(waiting, gallery_index) end,
    case when len(waiting) > 0 and kind <> modality then waiting[1] end, case when len(waiting) > 0 and kind <> modality then gallery_index end
  from walk w join o on o.location_id = w.location_id and o.rn = w.rn + 1)
select location_id, a_index, b_index from walk where a_index is not null"""


@query(GREEDY)
def disjoint_pairs(spark, sf):
    """Locations of seven rows, so that modalities have several."""
    return splits.disjoint_pairs(samples(spark, sf).withColumn("location_id", F.expr("cast(gallery_index div 7 as string)")))


def _drawn_sql(seed: int, *columns: str) -> str:
    return f"(({seed * splits.SEED_STEP % splits.MODULUS} + " + " + ".join(f"({c} % 65536) * {splits.MULTIPLIER * (2 * k + 1) % splits.MODULUS}" for k, c in enumerate(columns)) + f") % {splits.MODULUS})"


@query(f"""with {BASE},
multi as (select label, count(distinct modality) as kinds from samples group by label having count(*) >= 2),
classes as (select label, row_number() over (order by {_drawn_sql(5, 'label')}, label) - 1 as c, count(*) over () as n from multi where kinds >= 2 or not exists (select 1 from multi where kinds >= 2)),
chosen as (select t.r // 4 as batch, label from range(12) t(r) join classes on c = t.r % n where t.r % 4 < n),
members as (select label, modality, gallery_index, row_number() over (partition by label, modality order by (gallery_index * {splits.MULTIPLIER} + {5 * splits.SEED_STEP % splits.MODULUS}) % {splits.MODULUS}, gallery_index) - 1 as pick from samples),
kinds as (select label, modality, count(*) as pool, row_number() over (partition by label order by modality) - 1 as m, count(*) over (partition by label) as mods from samples group by label, modality),
slots as (select batch, label, modality, p.place, m, mods, pool from chosen join kinds using (label) cross join range(6) p(place) where (p.place + {_drawn_sql(5, 'batch', 'label')}) % mods = m)
select cast(batch as int) as batch, label, cast(place as int) as place, modality, gallery_index from slots join members using (label, modality) where pick = ({_drawn_sql(5, 'label', 'batch', 'm')} + place // mods) % pool""")
def pk_batches(spark, sf):
    return splits.pk_batches(samples(spark, sf), p=4, k=6, batches=3, seed=5)


# whitening and scalar functions -----------------------------------------------------------


@query(f"with {SAMPLES} select gallery_index, [round(x, 6) for x in u] as u from samples")
def unit_vectors(spark, sf):
    return samples(spark, sf).select("gallery_index", V.rounded("embedding").alias("u"))


@query(f"with {SAMPLES}, long as (select gallery_index, modality, unnest(u) as x, generate_subscripts(u, 1) as k from samples), means as (select modality, k, avg(x) as m from long group by all), c as (select gallery_index, k, x - m as x from long join means using (modality, k)), n as (select gallery_index, sqrt(sum(x * x)) as s from c group by all) select gallery_index, cast(k - 1 as int) as k, round(x / greatest(s, 1e-12), 6) as x from c join n using (gallery_index)")
def centred_by_modality(spark, sf):
    out = whitening.centre_by_modality(samples(spark, sf))
    return out.select("gallery_index", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query(f"with {SAMPLES} select a.gallery_index as a_index, round(1 - list_sum([(x[1] - x[2]) ** 2 for x in list_zip(a.u, b.u)]) / 2, 6) as l2_score from samples a join samples b on b.gallery_index = a.gallery_index + 1")
def l2_scores(spark, sf):
    rows = samples(spark, sf)
    b = rows.select((F.col("gallery_index") - 1).alias("a_index"), F.col("embedding").alias("other"))
    return rows.withColumnRenamed("gallery_index", "a_index").join(b, "a_index").select("a_index", F.round(V.l2_similarity("embedding", "other"), 6).alias("l2_score"))


@query(f"with {SAMPLES}, w as (select gallery_index, list_concat([x * 0.75 for x in u], [x * 0.25 for x in u]) as v from samples) select gallery_index, [round(x / sqrt(list_inner_product(v, v)), 6) for x in v] as v from w")
def concatenated_vectors(spark, sf):
    return samples(spark, sf).select("gallery_index", V.rounded(V.concat_renorm(["embedding", "embedding"], [0.75, 0.25])).alias("v"))


def _product(a: str, b: str) -> str:
    return f"list_transform({a}, lambda r: list_transform({b}, lambda c: list_inner_product(r, c)))"


def _whitened(by: str, shrinkage: float = 0.0) -> str:
    """Samples whose ``u`` is whitened within each ``by``: the inverse root of the covariance by
    coupled Newton-Schulz steps, with no decomposition."""
    return f"""{BASE.replace("samples as", "raw as", 1)},
long as (select {by} as grp, gallery_index, unnest(u) as x, generate_subscripts(u, 1) as k from raw),
centred as (select grp, gallery_index, k, x - avg(x) over (partition by grp, k) as x from long),
moments as (select a.grp, a.k as i, b.k as j, sum(a.x * b.x) / (count(*) - 1) as v from centred a join centred b using (grp, gallery_index) group by all),
cov as (select grp, i, j, {1 - shrinkage} * v + case when i = j then 1e-6 + {shrinkage} * avg(v) filter (i = j) over (partition by grp) else 0 end as v from moments),
rows_ as (select grp, i, list(v order by j) as r from (select grp, i, j, v / sqrt(sum(v * v) over (partition by grp)) as v from cov) group by all),
steps as (select grp, 0 as n, list(r order by i) as y, list(list_transform(r, lambda x, j: case when i = j then 1.0::double else 0 end) order by i) as z from rows_ group by grp
  union all select grp, n + 1, {_product("y", "t")}, {_product("t", "z")} from (select grp, n, y, z, list_transform(list_zip({_product("z", "y")}, {_product("y", "z")}), lambda r, i: list_transform(list_zip(r[1], r[2]), lambda x, j: (case when i = j then 3 else 0 end - (x[1] + x[2]) / 2) / 2)) as t from steps where n < 40)),
vectors as (select grp, gallery_index, list(x order by k) as c from centred group by all),
whitened as (select gallery_index, list_transform(z, lambda r: list_inner_product(r, c)) as w from vectors join steps using (grp) where n = 40),
samples as (select raw.* exclude (u), list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-12)) as u from raw join whitened using (gallery_index))"""


def _four_digits(df):
    return df.select("gallery_index", F.transform("embedding", lambda x: F.round(x, 4) + 0.0).alias("embedding"))


FOUR_DIGITS = "select gallery_index, [round(x, 4) + 0.0 for x in u] as embedding from samples"


@query(ORACLES["headline_f1"].replace(f"with {BASE}", f"with recursive {_whitened('modality')}"))
def whitened_headline(spark, sf):
    q, g = held_in(spark, sf)
    model = whitening.fit(g)
    return _rounded(evaluation.headline(evaluation.evaluate(whitening.transform(q, model), whitening.transform(g, model), KS)["cells"]))


@query(f"""with recursive {_whitened("''")} {FOUR_DIGITS}""")
def globally_whitened(spark, sf):
    rows = samples(spark, sf)
    return _four_digits(whitening.transform(rows, whitening.fit(rows, by_modality=False)))


@query(f"with recursive {_whitened('modality', 0.1)} {FOUR_DIGITS}")
def whitened_with_shrinkage(spark, sf):
    return _four_digits(whitening.fit_transform(samples(spark, sf), shrinkage=0.1))


# hashing ----------------------------------------------------------------------------------

BITS = "[case when x >= 0 then '1' else '0' end for x in u]"
CODES = f"codes as (select *, cast(array_to_string({BITS}, '') as bit) as code from samples)"


def _codes(df):
    return df.withColumn("code", V.pack_bits(V.sign_bits("embedding")))


@query(f"with {SAMPLES}, {CODES} select gallery_index, bit_count(code) as ones, cast(substr(array_to_string({BITS}, ''), 1, 8) as varchar) as head from codes")
def sign_codes(spark, sf):
    rows = _codes(samples(spark, sf))
    return rows.select("gallery_index", F.bit_count(F.col("code")[0]).cast("long").alias("ones"), F.array_join(F.slice(V.unpack_bits("code", 64), 1, 8), "").alias("head"))


@query(f"with {SAMPLES}, {CODES}, d as (select q.gallery_index as query_id, g.gallery_index, bit_count(xor(q.code, g.code)) as distance from codes q, codes g where q.gallery_index % 100 = 0) select * from (select *, row_number() over (partition by query_id order by distance, gallery_index) - 1 as rank from d) where rank < 10")
def hamming_topk(spark, sf):
    q, g = probe(spark, sf)
    return hashing.hamming_topk(_codes(q), _codes(g), K)


@query(f"with {SAMPLES}, {CODES} select q.gallery_index as query_id, g.gallery_index, bit_count(xor(q.code, g.code)) as distance from codes q, codes g where q.gallery_index % 100 = 0 and bit_count(xor(q.code, g.code)) <= 11")
def hamming_within(spark, sf):
    q, g = probe(spark, sf)
    return hashing.hamming_within(_codes(q), _codes(g), radius=11)


@query(f"with {SAMPLES}, {CODES}, d as (select q.gallery_index as query_id, g.gallery_index, bit_count(xor(q.code, g.code)) as distance from codes q, codes g where q.gallery_index % 100 = 0) select * from (select *, row_number() over (partition by query_id order by distance, gallery_index) - 1 as rank from d) where rank < 10")
def binary_index_search(spark, sf):
    q, g = probe(spark, sf)
    return hashing.binary_search(_codes(q), _codes(g), K)


@query()
def itq_codes(spark, sf):
    rows = samples(spark, sf)
    return hashing.itq_transform(rows, hashing.itq_fit(rows, n_bits=32, iterations=20)).select("gallery_index", "code")


# re-ranking -------------------------------------------------------------------------------

POOL = 30


@query(f"with {PROBE}, {scored()}, {top(POOL)}, {top(K).replace('hits as', 'best as').replace('from scored', 'from hits').replace('select *,', 'select * exclude (rank),')} select {HIT} from best")
def exact_refine(spark, sf):
    q, g = probe(spark, sf)
    return rerank.exact_refine(q, g, search.search(q, g, POOL), K)


def _expanded(alpha: float, n: int) -> str:
    weight = f"power(least(greatest(list_inner_product(q.u, g.u), 0), 1), {alpha})" if alpha else "1"
    return f"""with {PROBE}, {scored()}, {top(n)},
w as (select h.query_id, {weight} as w, g.u from hits h join gallery g on g.gallery_index = h.gallery_index join queries q on q.query_id = h.query_id),
long as (select query_id, w * unnest(u) as x, generate_subscripts(u, 1) as k from w union all select query_id, unnest(u), generate_subscripts(u, 1) from queries),
summed as (select query_id, k, sum(x) as x from long group by all), n as (select query_id, sqrt(sum(x * x)) as s from summed group by all)
select query_id, cast(k - 1 as int) as k, round(x / greatest(s, 1e-12), 5) as x from summed join n using (query_id)"""


def _exploded(df):
    return df.select("query_id", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.round("x", 5) + 0.0)


@query(_expanded(3, 5))
def alpha_expansion(spark, sf):
    q, g = probe(spark, sf)
    return _exploded(rerank.alpha_expansion(q, g, search.search(q, g, 5), alpha=3))


@query(_expanded(0, 5))
def average_expansion(spark, sf):
    q, g = probe(spark, sf)
    return _exploded(rerank.average_expansion(q, g, search.search(q, g, 5)))


def _reciprocal(pool: int, k1: int = 20, k2: int = 6, weight: float = 0.3) -> str:
    """Re-ranking as relations: node 0 is the query, node n the hit of rank n - 1."""
    return f"""with {PROBE}, {scored()}, {top(pool)},
nodes as (select query_id, 0 as n, -1 as gallery_index, u from queries union all select h.query_id, h.rank + 1, h.gallery_index, g.u from hits h join gallery g on g.gallery_index = h.gallery_index),
far as (select a.query_id, a.n as i, b.n as j, b.gallery_index, round(list_inner_product(a.u, b.u), 6) as c, 1 - least(greatest(c, -1), 1) as d from nodes a join nodes b on a.query_id = b.query_id),
placed as (select *, row_number() over (partition by query_id, i order by d, j) - 1 as place from far),
mutual as (select a.query_id, a.i, a.j, greatest(a.place, b.place) <= {round(k1 / 2) + 1} as tight from placed a join placed b on b.query_id = a.query_id and b.i = a.j and b.j = a.i where a.place <= {k1} and b.place <= {k1}),
tight as (select query_id, i, j, count(*) over (partition by query_id, i) as size from mutual where tight),
grown as (select w.query_id, w.i, w.j from mutual w join tight t on t.query_id = w.query_id and t.i = w.j left join mutual o on o.query_id = w.query_id and o.i = w.i and o.j = t.j
  group by w.query_id, w.i, w.j having 3 * count(o.j) > 2 * any_value(t.size)),
member as (select query_id, i, j from mutual union select g.query_id, g.i, t.j from grown g join tight t on t.query_id = g.query_id and t.i = g.j),
weights as (select m.query_id, m.i, m.j, exp(-f.d) / sum(exp(-f.d)) over (partition by m.query_id, m.i) as v from member m join far f using (query_id, i, j)),
spread as (select p.query_id, p.i, w.j, sum(w.v) / {k2} as v from placed p join weights w on w.query_id = p.query_id and w.i = p.j where p.place < {k2} group by all),
total as (select query_id, i, sum(v) as v from spread group by all),
shared as (select b.query_id, b.i, sum(least(a.v, b.v)) as low from spread a join spread b on b.query_id = a.query_id and b.j = a.j where a.i = 0 and b.i > 0 group by all),
mixed as (select f.query_id, f.j, f.gallery_index, f.c, round({1 - weight} * (1 - coalesce(s.low, 0) / greatest(z.v + t.v - coalesce(s.low, 0), 1e-12)) + {weight} * f.d, 9) as mix
  from far f join total z on z.query_id = f.query_id and z.i = 0 join total t on t.query_id = f.query_id and t.i = f.j left join shared s on s.query_id = f.query_id and s.i = f.j where f.i = 0 and f.j > 0)
select query_id, gallery_index, c as score, rank from (select *, row_number() over (partition by query_id order by mix, j) - 1 as rank from mixed) where rank < {K}"""


@query(_reciprocal(POOL))
def k_reciprocal(spark, sf):
    q, g = probe(spark, sf)
    return rerank.k_reciprocal(q, g, search.search(q, g, POOL), K)


@query(_reciprocal(40))
def search_and_rerank(spark, sf):
    return rerank.search_with_rerank(*probe(spark, sf), K, pool=40, method="kreciprocal")


@query()
def ivf_search(spark, sf):
    q, g = probe(spark, sf)
    index = ann.build(g, cells=16)
    return ann.search(q, index, K, ann.enough_probes(q, index, K, least=8))


@query("select true as enough")
def ivf_recall(spark, sf):
    """Whether the cells of ``ivf_search`` find 0.9 of the exact hits."""
    return ann.recall(ivf_search(spark, sf), topk_cosine(spark, sf)).select((F.col("recall") >= 0.9).alias("enough"))


@query("select true as enough")
def ivf_codes_recall(spark, sf):
    """Whether cells with codes of 16 bytes, a 16th of a vector of 64 floats, find 0.9 of the exact hits."""
    q, g = probe(spark, sf)
    index = ann.with_codes(ann.build(g, cells=16), parts=16)
    probes = ann.enough_probes(q, index, K, least=8)
    found = ann.search(q, index, K, probes, pool=ann.enough_pool(q, index, K, probes))
    return ann.recall(found, topk_cosine(spark, sf)).select((F.col("recall") >= 0.9).alias("enough"))


@query(f"with {PROBE}, {scored()}, {top(K)} select {HIT} from hits")
def ivf_all_probes(spark, sf):
    q, g = probe(spark, sf)
    return ann.search(q, ann.build(g, cells=16), K, probes=16)


@query(f"with {PROBE}, {scored("g.modality = 'sar' and q.location_id <> g.location_id")}, {top(K)} select {HIT} from hits")
def ivf_with_filters(spark, sf):
    q, g = probe(spark, sf)
    return ann.search(q, ann.build(g, cells=16), K, probes=16, gallery_modality="sar", same_location=True)


@query(f"with {PROBE}, {scored()}, {top(K)}, other as (select *, row_number() over (partition by query_id order by gallery_index) - 1 as r2 from hits) select query_id, gallery_index, round(1.0 / (60 + rank) + 1.0 / (60 + r2), 9) as fused from other")
def fused_ranks(spark, sf):
    hits = search.search(*probe(spark, sf), K)
    other = search.ranked(hits.select("query_id", "gallery_index", (-F.col("gallery_index")).cast("double").alias("score")), K, ["query_id"])
    return rerank.fuse([hits, other]).withColumn("fused", F.round("fused", 9))


@query(f"""with {HELD_IN}, {RQ}, {scored(LOO_PLACE)}, {top(18)},
ranked as (select query_id, rank + 1 as rank, label = query_label and query_label >= 0 as rel from hits),
judged as (select *, sum(cast(rel as int)) over (partition by query_id order by rank) as cum from ranked),
totals as (select query_id, sum(total_relevant) as total_relevant from rq group by query_id),
per_query as (select r.query_id, r.total_relevant, {_metric_sql(KS, deepest=10)} from totals r left join judged j on j.query_id = r.query_id group by r.query_id, r.total_relevant)
select count(*) as n_queries, {', '.join(f'round(avg({n}), 6) as mean_{n}' for n in NAMES)} from per_query""")
def mixed_gallery_cell(spark, sf):
    q, g = held_in(spark, sf)
    hits = search.search(q, g, 18, leave_one_out=True, same_location=True).withColumn("rank", F.col("rank") + 1).join(g.select("gallery_index", "label"), "gallery_index")
    totals = evaluation.relevant_counts(q, g).groupBy("query_id").agg(F.sum("total_relevant").alias("total_relevant"))
    return _rounded(metrics.means(metrics.per_query(metrics.judge(hits, q), totals, KS, ap_k=10)))


