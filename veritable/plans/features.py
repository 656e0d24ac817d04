"""Registered queries of pictures, random masks, gated fusion and attributions, with DuckDB SQL.

Importing this module adds them to the catalog's dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritable.functions import masks, pictures
from veritable.operators import attributions, audits, compare, gated, metrics, splits, tabular
from veritable.plans import bindings as b
from veritable.plans.bindings import with_ctes
from veritable.plans.catalog import query

# --- pictures: the 64 numbers of a vector are 8 rows of 8 pixels ---------------------------

_EYES = {"lx": "2 + vec_id % 3", "ly": "2 + vec_id % 4", "rx": "5 + vec_id % 2", "ry": "2 + (vec_id // 4) % 4"}


@query(f"""with e as (select vec_id, embedding::double[] as v, {", ".join(f"case when vec_id % 10 = 0 then null else ({x})::double end as {k}" for k, x in _EYES.items())} from embeddings),
  a as (select *, atan2(ry - ly, rx - lx) as t, (lx + rx) / 2 as cx, (ly + ry) / 2 as cy from e),
  p as (select vec_id, i, v, t, cos(t) * (i % 8 - cx) - sin(t) * (i // 8 - cy) + cx as x, sin(t) * (i % 8 - cx) + cos(t) * (i // 8 - cy) + cy as y from a, range(64) r(i)),
  q as (select *, floor(x) as x0, floor(y) as y0 from p),
  n as (select *, greatest(0, least(7, x0))::int as xa, greatest(0, least(7, x0 + 1))::int as xb, greatest(0, least(7, y0))::int as ya, greatest(0, least(7, y0 + 1))::int as yb from q)
  select vec_id, list(round(case when t is null then v[i + 1] else (v[ya * 8 + xa + 1] * (1 - x + x0) + v[ya * 8 + xb + 1] * (x - x0)) * (1 - y + y0) + (v[yb * 8 + xa + 1] * (1 - x + x0) + v[yb * 8 + xb + 1] * (x - x0)) * (y - y0) end, 6) order by i) as aligned
  from n group by 1""")
def v16_align(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    eye = {k: F.when(F.col("vec_id") % 10 != 0, F.expr(x.replace("vec_id // 4", "floor(vec_id / 4)")).cast("double")) for k, x in _EYES.items()}
    return rows.select("vec_id", F.transform(pictures.align_by_eyes("v", 8, 8, eye["lx"], eye["ly"], eye["rx"], eye["ry"]), lambda v: b.rounded(v)).alias("aligned"))


def _reflected(at: str) -> str:
    return f"(case when {at} < 0 then 1 when {at} > 7 then 6 else {at} end)"


def _near(x: str, y: str) -> str:
    return f"g[{_reflected(y)} * 8 + {_reflected(x)} + 1]"


@query(f"""with e as (select vec_id, [floor(greatest(0, least(255, 128 + 600 * x::double))) for x in embedding] as v from embeddings),
  c as (select vec_id, i, v[i + 1] as r, least(255, v[i + 1] + 10 * (vec_id % 3)) as gr, greatest(0, v[i + 1] - 5 * (vec_id % 5)) as b from e, range(64) t(i)),
  s as (select *, case when greatest(r, gr, b) > 0 then 255 * (greatest(r, gr, b) - least(r, gr, b)) / greatest(r, gr, b) else 0 end as sat, 0.299::double * r + 0.587::double * gr + 0.114::double * b as gray from c),
  f as (select vec_id, avg((sat < 50 and greatest(r, gr, b) > 140)::int) as paper, avg(sat) as saturation, list(gray order by i) as g from s group by 1),
  l as (select vec_id, i % 8 as x, i // 8 as y, g from f, range(64) t(i)),
  z as (select vec_id, var_pop({_near("x", "y - 1")} + {_near("x", "y + 1")} + {_near("x - 1", "y")} + {_near("x + 1", "y")} - 4 * g[y * 8 + x + 1]) as sharpness from l group by 1),
  edge as (select vec_id, x, y from l where x between 1 and 6 and y between 1 and 6 and abs(g[(y + 1) * 8 + x + 1] - g[(y - 1) * 8 + x + 1]) + abs(g[y * 8 + x + 2] - g[y * 8 + x]) > 100),
  cell as (select vec_id, k, floor(y * cos(radians(2.0::double * k - 4)) - x * sin(radians(2.0::double * k - 4)) + 0.5) as rho, count(*) as n from edge, range(5) t(k) group by all),
  line as (select vec_id, count(*) as n from cell a where n >= 2 and not exists (from cell o where o.vec_id = a.vec_id and abs(o.k - a.k) <= 1 and abs(o.rho - a.rho) <= 1 and (o.n > a.n or o.n = a.n and (o.k < a.k or o.k = a.k and o.rho < a.rho))) group by 1)
  select f.vec_id, round(paper, 6) as paper, round(saturation, 6) as saturation, floor(sharpness * 100 + 0.3) / 100 as sharpness, coalesce(line.n, 0)::int as lines, paper > 0.20 and (coalesce(line.n, 0) >= 3 or sharpness > 1500) as artwork
  from f join z using (vec_id) left join line on line.vec_id = f.vec_id""")
def y14_picture_facts(spark, sf):
    level = lambda x: F.floor(F.greatest(F.lit(0), F.least(F.lit(255), 128 + 600 * x.cast("double")))).cast("double")
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", level).alias("red"))
    green = F.transform("red", lambda v: F.least(F.lit(255.0), v + 10 * (F.col("vec_id") % 3)))
    blue = F.transform("red", lambda v: F.greatest(F.lit(0.0), v - 5 * (F.col("vec_id") % 5)))
    facts = rows.select("vec_id", pictures.picture_facts("red", green, blue, F.lit(8)).alias("f")).select("vec_id", "f.*")
    art = audits.artwork_rule(F.col("paper"), F.col("lines"), F.col("sharpness")).alias("artwork")
    return facts.select("vec_id", F.round("paper", 6).alias("paper"), F.round("saturation", 6).alias("saturation"), (F.floor(F.col("sharpness") * 100 + 0.3) / 100).alias("sharpness"), "lines", art)


@query("""with o as (select o_orderkey, o_orderkey % 13 = 0 as art, [{'x': 10, 'y': 12, 'w': (o_orderkey % 90)::int, 'h': (o_custkey % 70)::int}, {'x': 30, 'y': 5, 'w': (o_custkey % 80)::int, 'h': 40}, {'x': 0, 'y': 0, 'w': 20, 'h': 20}] as faces from orders),
  l as (select o_orderkey, art, list_filter(faces, lambda f: f.w >= 25 and f.h >= 20) as large from o),
  m as (select *, list_max(list_transform(large, lambda f: f.w * f.h)) as area from l),
  p as (select *, list_filter(large, lambda f: f.w * f.h = area)[1] as f from m)
  select o_orderkey, case when not art and area / 8000.0 < 0.5 then greatest(0, f.x - f.w // 4) end as x0, case when not art and area / 8000.0 < 0.5 then greatest(0, f.y - f.h // 4) end as y0,
    case when not art and area / 8000.0 < 0.5 then least(100, f.x + f.w + f.w // 4) end as x1, case when not art and area / 8000.0 < 0.5 then least(80, f.y + f.h + f.h // 4) end as y1 from p""")
def y15_face_crop(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    face = lambda x, y, w, h: F.struct(*(v.cast("int").alias(n) for v, n in zip((x, y, w, h), "xywh")))
    faces = F.array(face(F.lit(10), F.lit(12), k % 90, c % 70), face(F.lit(30), F.lit(5), c % 80, F.lit(40)), face(F.lit(0), F.lit(0), F.lit(20), F.lit(20)))
    box = pictures.face_crop("faces", F.lit(100), F.lit(80), k % 13 == 0)
    rows = b.table(spark, sf, "orders").withColumn("faces", faces).withColumn("box", box)
    return rows.select("o_orderkey", *(F.col(f"box.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")))


# --- random masks ------------------------------------------------------------------------


def _uniform_sql(seed: int, row: str, draw: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {row} || ':' || ({draw})), 1, 13))::ubigint::double / 4503599627370496)"


def _frames(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8))).alias("frames"))


def _flat(frames: Column) -> Column:
    return F.transform(F.flatten(frames), lambda v: b.rounded(v))


@query(f"select vec_id, [case when {_uniform_sql(11, 'vec_id', 'i // 8')} > 0.25 then round(embedding[i + 1]::double, 6) else 0 end for i in range(64)] as masked from embeddings")
def v03_dropped_frames(spark, sf):
    rows = _frames(spark, sf)
    return rows.select("vec_id", _flat(masks.drop_frames("frames", "vec_id", 0.25, seed=11)).alias("masked"))


def _mask_sql() -> str:
    stretch = lambda k, name, widest: f"floor({_uniform_sql(5, 'vec_id', 2 * k)} * {widest + 1})::int as n{k}, {_uniform_sql(5, 'vec_id', 2 * k + 1)} as u{k}"
    hidden = lambda k, at: f"(n{k} between 1 and 7 and {at} >= floor(u{k} * (8 - n{k})) and {at} < floor(u{k} * (8 - n{k})) + n{k})"
    return f"""with r as (select vec_id, embedding, {", ".join(stretch(k, "n", w) for k, w in ((0, 3), (1, 3), (2, 9)))} from embeddings)
      select vec_id, [case when {hidden(0, "i // 8")} or {hidden(1, "i // 8")} or {hidden(2, "i % 8")} then 0 else round(embedding[i + 1]::double, 6) end for i in range(64)] as masked from r"""


@query(_mask_sql())
def v11_masked_bands(spark, sf):
    rows = _frames(spark, sf)
    return rows.select("vec_id", _flat(masks.mask_bands("frames", "vec_id", (2, 3), (1, 9), seed=5)).alias("masked"))


# --- gated fusion ------------------------------------------------------------------------

MODALITIES = ("image", "audio", "video")


#: Added before numbers are cut to six places: sums of these weights and inputs have few digits,
#: so no such sum lies on the edge that this makes.
_EDGE = 0.3141592653


def _six(c: Column) -> Column:
    return F.floor(c * 1000000 + _EDGE) / 1000000


def _six_sql(c: str) -> str:
    return f"floor({c} * 1000000 + {_EDGE}::double) / 1000000"


def _layer(rows: int, columns: int, shift: int) -> gated.Layer:
    """Weights by a rule: quarters from -1/2 to 1/2."""
    return [[((7 * i + 3 * j + shift) % 5 - 2) / 4 for j in range(columns)] for i in range(rows)], [((i + shift) % 3 - 1) / 8 for i in range(rows)]


_GATES = {m: [_layer(4, 3, k), _layer(1, 4, k + 1)] for k, m in enumerate(MODALITIES)}
_FUSION = [_layer(6, 9, 0), _layer(3, 6, 1), _layer(1, 3, 4)]
_CLASSIFIER = [_layer(6, 9, 2), _layer(1, 6, 3)]


def _dense_sql(x: str, layer: gated.Layer, relu: bool) -> str:
    rows = [f"list_dot_product({x}, {w}::double[]) + {bias}" for w, bias in zip(*layer)]
    return "[" + ", ".join(f"greatest(0, {r})" if relu else r for r in rows) + "]"


def _network_sql(x: str, layers: list[gated.Layer]) -> str:
    for layer in layers[:-1]:
        x = _dense_sql(x, layer, True)
    return f"({_dense_sql(x, layers[-1], False)})[1]"


#: Each modality's features, zeros where it is absent, and whether it is there.
_WIDE = ", wide as (select sample_id, " + ", ".join(f"max(prob) filter (modality = '{m}') as {m}" for m in MODALITIES) + " from probs group by 1), f as (select sample_id, " + ", ".join(f"{m} is not null as has_{m}, [coalesce({m}, 0), coalesce({m} * {m}, 0), coalesce(1 - {m}, 0)]::double[] as {m}" for m in MODALITIES) + " from wide)"
_ALL = "list_concat(" + ", ".join(MODALITIES) + ")"


def _features(spark, sf):
    rows = b.fusion_rows(spark, sf)
    return rows, {m: F.when(F.col(m).isNotNull(), F.array(F.col(m), F.col(m) * F.col(m), 1 - F.col(m))) for m in MODALITIES}


@query(with_ctes("probs", f"{_WIDE} select sample_id, {_six_sql(_network_sql(_ALL, _FUSION))} as logit from f"))
def f05_feature_fusion(spark, sf):
    rows, features = _features(spark, sf)
    return rows.select("sample_id", _six(gated.feature_fusion(features, dict.fromkeys(MODALITIES, 3), _FUSION)).alias("logit"))


@query(with_ctes("probs", f"""{_WIDE}, g as (select *, {", ".join(f"1 / (1 + exp(-({_network_sql(m, _GATES[m])}))) as gate_{m}" for m in MODALITIES)} from f),
  w as (select sample_id, {", ".join(f"case when has_{m} then round(gate_{m}, 6) end as {m}_gate, [x * gate_{m} for x in {m}] as {m}" for m in MODALITIES)} from g)
  select sample_id, {_six_sql(_network_sql(_ALL, _CLASSIFIER))} as logit, {", ".join(f"{m}_gate" for m in MODALITIES)} from w"""))
def f06_gated_fusion(spark, sf):
    rows, features = _features(spark, sf)
    out = rows.select("sample_id", gated.gated_fusion(features, dict.fromkeys(MODALITIES, 3), _GATES, _CLASSIFIER).alias("g"))
    return out.select("sample_id", _six(F.col("g.logit")).alias("logit"), *(F.round(f"g.{m}", 6).alias(f"{m}_gate") for m in MODALITIES))


@query(with_ctes("probs", f"""{_WIDE.split(", f as (")[0]}, t as (select sample_id, 0.4::double * image + 0.3::double * audio + 0.3::double * video as p from wide)
  select sample_id, round(p, 6) as prob, case when p >= 0.5 then 'FAKE' when p < 0.5 then 'REAL' end as label, round(case when p >= 0.5 then p else 1 - p end, 6) as confidence from t"""))
def f08_triad(spark, sf):
    rows, _ = _features(spark, sf)
    out = rows.select("sample_id", compare.triad(*(F.col(m) for m in MODALITIES)).alias("t"))
    return out.select("sample_id", F.round("t.prob", 6).alias("prob"), "t.label", F.round("t.confidence", 6).alias("confidence"))


# --- attributions ------------------------------------------------------------------------


@query()
def u14_attributions(spark, sf):
    """What each feature of a tree ensemble, fitted on the earliest 70 % of events, adds to the margin of
    every event: values that add up, for which SQL has no words. Tested against all subsets."""
    e = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = splits.time_aware(e, "ts", "event_id").withColumn("y", (F.col("value") > 50).cast("double")).withColumn("hour", F.hour("ts").cast("double")).withColumn("user", F.col("user_id").cast("double"))
    model = tabular.fit(rows.where("subset = 'train'"), ["hour", "user"], ["event_type"], model="gbt")
    return attributions.shapley(model, rows.select("event_id", "hour", "user", "event_type")).select("event_id", "shapley", "base", "margin")


# --- ranking metrics of scores that hardly repeat ----------------------------------------

_SMOOTH = """smooth as (select l_orderkey % 3 as model, (l_returnflag = 'R')::int as y,
  (0.6::double * ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8))::ubigint::double / 4294967295::double + case when l_returnflag = 'R' then 0.4 else 0.2 end) as prob from lineitem)"""


def _smooth(spark, sf):
    li = b.table(spark, sf, "lineitem")
    fraction = splits.md5_fraction(F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return li.select((F.col("l_orderkey") % 3).alias("model"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.lit(0.6) * fraction + F.when(F.col("l_returnflag") == "R", 0.4).otherwise(0.2)).alias("prob"))


@query(f"""with {_SMOOTH}, d as (select model, prob, sum(y)::double as pos, sum(1 - y)::double as neg from smooth group by 1, 2),
  r as (select *, coalesce(sum(pos) over (w rows between unbounded preceding and 1 preceding), 0) as bp, coalesce(sum(neg) over (w rows between unbounded preceding and 1 preceding), 0) as bn, sum(pos) over (partition by model) as np, sum(neg) over (partition by model) as nn from d window w as (partition by model order by prob)),
  t as (select *, (nn - bn) / nn as far, bp / np as frr from r),
  e as (select model, far, frr, prob from t qualify row_number() over (partition by model order by abs(far - frr), prob) = 1)
  select t.model, round(sum(pos * (bn + neg / 2)) / max(np) / max(nn), 9) as roc_auc, round(sum(pos * (np - bp) / (np - bp + nn - bn)) / max(np), 9) as pr_auc, round(max((e.far + e.frr) / 2), 9) as eer, round(max(e.prob), 9) as eer_threshold
  from t join e on t.model = e.model group by 1""")
def e07_continuous_ranking(spark, sf):
    rows = metrics.ranking(_smooth(spark, sf), ["model"])
    return rows.select("model", *(F.round(c, 9).alias(c) for c in ("roc_auc", "pr_auc", "eer", "eer_threshold")))


@query(f"""with {_SMOOTH}, t as (select i / 100.0::double as threshold from range(5, 96) r(i)), n as (select model, threshold, count(*) filter (y = 1 and prob >= threshold) as tp, count(*) filter (y = 1) as p, count(*) filter (y = 0 and prob < threshold) as tn, count(*) filter (y = 0) as q from smooth, t group by 1, 2),
  v as (select *, round(tp::double / p + tn::double / q - 1, 12) as value from n)
  select model, round(threshold, 6) as threshold, round(value, 9) as value from v qualify row_number() over (partition by model order by value desc, threshold) = 1""")
def y11_youden_threshold(spark, sf):
    grid = [i / 100 for i in range(5, 96)]
    rows = metrics.best_balanced_threshold(_smooth(spark, sf), ["model"], grid, near=None, criterion="youden")
    return rows.select("model", F.round("threshold", 6).alias("threshold"), F.round("value", 9).alias("value"))


@query(with_ctes("scores", """, s as (select split || (l = 1)::varchar as key, y, prob from (select *, case when y = 1 and model = 'm_qty' then 1 else 0 end as l from scores)),
  r as (select key, y, prob, rank() over (partition by key order by prob) + (count(*) over (partition by key, prob) - 1) / 2 as rk from s)
  select key, case when count(*) filter (y = 1) = 0 or count(*) filter (y = 0) = 0 then 0.5 else round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / count(*) filter (y = 1) / count(*) filter (y = 0), 9) end as roc_auc from r group by 1"""))
def y13_single_class_auc(spark, sf):
    """Two of four keys have positives alone: their AUC is one half by definition."""
    alone = (F.col("y") == 1) & (F.col("model") == "m_qty")
    rows = b.scores_big(spark, sf).withColumn("key", F.concat("split", alone.cast("string")))
    return metrics.roc_auc(rows, ["key"], single_class=0.5).select("key", F.round("roc_auc", 9).alias("roc_auc"))
