"""Registered queries: every operator applied to the bound relations, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.functions import arrays, normalize
from veritable.operators import audits, compare, leakage, manifest, metrics, registry, splits, tabular
from veritable.plans import bindings as b
from veritable.plans.bindings import with_ctes
from veritable.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["model", "split"]


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l06_check_splits(spark, sf_dir)


# --- manifest ----------------------------------------------------------------------------


@query(with_ctes("manifest", "select doc_id, sample_id, path, label, upstream_split, generator, identity_key, source_image_key, file_size, file_hash from manifest"))
def a01_manifest(spark, sf):
    return b.manifest(spark, sf)


@query(with_ctes("manifest", """select count(*) as n_rows, count(*) filter (label = 'real') as n_real, count(*) filter (label = 'fake') as n_fake, count(*) filter (label is null) as n_unlabelled,
  sum(file_size)::bigint as total_bytes, min(file_size) as min_bytes, max(file_size) as max_bytes, round(avg(file_size), 6) as mean_bytes from manifest"""))
def a07_manifest_summary(spark, sf):
    return manifest.summary(b.manifest(spark, sf)).withColumn("mean_bytes", F.round("mean_bytes", 6))


@query(with_ctes("manifest", """select 'label' as facet, label as value, count(*) as n from manifest group by label
  union all select 'upstream_split', upstream_split, count(*) from manifest group by upstream_split
  union all select 'generator', generator, count(*) from manifest group by generator"""))
def a15_manifest_facets(spark, sf):
    return manifest.facet_counts(b.manifest(spark, sf), ["label", "upstream_split", "generator"])


@query(with_ctes("manifest", "select file_hash, count(*) as n, min(path) as first_path, max(path) as last_path, (list(path order by path))[1:5] as paths from manifest group by file_hash having count(*) > 1"))
def a04_duplicate_content(spark, sf):
    return manifest.duplicate_content(b.manifest(spark, sf))


@query(with_ctes("manifest split", """, roles(split_role) as (values ('train'), ('val'), ('test_seen'), ('test_unseen')),
  c as (select r.split_role, count(*) filter (label = 'real') as n_real, count(*) filter (label = 'fake') as n_fake from roles r left join split s on r.split_role = s.split_role group by r.split_role)
  select split_role, n_real, n_fake, n_real + n_fake as n, coalesce(round_even(n_real::double / nullif(n_real + n_fake, 0), 6), 0) as real_share, coalesce(round_even(n_fake::double / nullif(n_real + n_fake, 0), 6), 0) as fake_share from c"""))
def a08_class_balance(spark, sf):
    rows = b.split(spark, sf)
    return manifest.class_balance(rows, "split_role", splits.role_table(rows))


@query(with_ctes("manifest split", "select split_role, label, generator, count(*) as n, (grouping(split_role, label, generator))::int as level from split group by rollup (split_role, label, generator)"))
def a16_split_statistics(spark, sf):
    return manifest.split_statistics(b.split(spark, sf))


@query(with_ctes("clips", "select label as split_role, count(*) as n_clips, count(distinct speaker) as n_speakers, round_even(avg(duration_sec), 6) as avg_duration from clips group by label"))
def a17_speaker_statistics(spark, sf):
    rows = manifest.speaker_statistics(b.clips(spark, sf), "label")
    return rows.withColumnRenamed("label", "split_role")


@query(with_ctes("manifest", "select generator, count(*) as n, min(doc_id) as first_seen from manifest group by generator order by n desc, first_seen limit 10"))
def r11_top_values(spark, sf):
    return manifest.top_values(b.manifest(spark, sf), "generator", 10, "doc_id")


@query(with_ctes("manifest", "select * exclude (rn) from (select *, row_number() over (partition by file_hash order by doc_id) as rn from manifest) where rn = 1"))
def r08_first_wins(spark, sf):
    return manifest.first_wins(b.manifest(spark, sf), "file_hash", ["doc_id"])


@query(with_ctes("manifest", "select file_hash, max(doc_id) as doc_id, arg_max(sample_id, doc_id) as sample_id from manifest group by file_hash"))
def j23_last_wins(spark, sf):
    return manifest.last_wins(b.manifest(spark, sf).select("file_hash", "doc_id", "sample_id"), "file_hash", "doc_id")


@query(with_ctes("manifest", "select doc_id, case when rn = 1 then 'kept' else 'duplicate_path' end as decision from (select doc_id, row_number() over (partition by file_hash order by doc_id) as rn from manifest)"))
def r06_deduplicate(spark, sf):
    rows = b.manifest(spark, sf).select("doc_id", "file_hash", "sample_id")
    if spark.sparkContext.getCheckpointDir() is None:
        b.set_checkpoint_dir(spark)
    return manifest.deduplicate(rows, "file_hash", "sample_id", "doc_id").select("doc_id", "decision")


@query(with_ctes("manifest", """, holes as (select sample_id, label, case when doc_id % 7 = 0 then '' when doc_id % 11 = 0 then null else path end as path, case when doc_id % 13 = 0 then null else generator end as generator from manifest)
  select sample_id, 'bad_label' as rule from holes where label is null union all select sample_id, 'empty:path' from holes where coalesce(path, '') = '' union all select sample_id, 'empty:generator' from holes where coalesce(generator, '') = ''"""))
def p09_violations(spark, sf):
    path = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("path"))
    rows = b.manifest(spark, sf).withColumn("path", path).withColumn("generator", F.when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("generator")))
    return manifest.violations(rows, ["sample_id", "path", "generator"], "sample_id")


# --- projections -------------------------------------------------------------------------


@query("""select doc_id, case quality when 1 then 'real' when 0 then 'fake' end as label, case when quality = 1 and toxic = 1 then 'bad' else 'ok' end as strict from labels""")
def p01_image_label(spark, sf):
    rows = b.table(spark, sf, "labels")
    text = F.when(F.col("toxic") == 1, "fake").otherwise(F.when(F.col("quality") == 1, "real").otherwise("fake"))
    strict = normalize.image_label_error(F.col("quality").cast("string"), text)
    return rows.select("doc_id", normalize.image_label(F.col("quality").cast("string"), F.lit(" ")).alias("label"), F.when(strict.isNotNull(), "bad").otherwise("ok").alias("strict"))


@query("""select p_partkey, coalesce(nullif(lower(regexp_extract(p_name || '.' || p_type, '[^/](\\.[^./]+)$', 1)), ''), '<none>') as ext, lower(replace(coalesce(nullif(trim(p_brand), ''), 'unknown'), '\\', '/')) as source_key, replace(p_brand || ':' || p_size, ':', '__') as safe from part""")
def p20_part_keys(spark, sf):
    rows = b.table(spark, sf, "part")
    return rows.select("p_partkey", normalize.extension(F.concat_ws(".", "p_name", "p_type")).alias("ext"), normalize.source_key("p_brand").alias("source_key"), normalize.safe_name(F.concat_ws(":", "p_brand", "p_size")).alias("safe"))


@query(with_ctes("manifest", "select sample_id, case when label = 'real' then 'real_' when label is null then 'fake_' else 'fake_' end || split_part(sample_id, ':', 3) as identity, replace(sample_id, ':', '__') as name, sample_id as back from manifest"))
def p18_identity(spark, sf):
    rows = b.manifest(spark, sf)
    return rows.select("sample_id", normalize.identity_key("sample_id", "label").alias("identity"), normalize.safe_name("sample_id").alias("name"), normalize.name_to_sample_id(normalize.safe_name("sample_id")).alias("back"))


#: Paths that take every branch of the path rules, dealt to the parts by key.
PATHS = [
    "a/b/c/FlickrFacesHQ/1.jpg", "a/x/ffhq/2.JPEG", "k/1-million-fake-faces/3.png", "k/1m_faces/4.gif", "k/FaceForensics/5.m4v", "a/b/c/own_source/6.flv", "a/b/7.wmv", "", "   ",
    "x\\StyleGAN\\8.tif", "x/Deepfakes/9.mp4", "x/face2face/10.avi", "x/faceswap/11.mov", "x/neuraltextures/12.mkv", "x/faceshifter/13.webm", "x/deepfake_detection/14.bmp",
    "d/ASVspoof2019/15.flac", "d/asvspoof2021/16.wav", "d/coqui_tts/17.mp3", "m/18.yaml", "m/19.ipynb", "m/20.cu", "m/21.7z", "m/LICENSE", "m/readme", "m/22.pdf", "m/23", "m/.hidden", "m/24.xyz", "m.d/25", "m/26.a.tar", "m/27.m4a", "m/28.aac",
]
LABELS_OF_PATHS, NAMES_OF_PATHS = ["fake", "real", None], ["", "unknown", "StarGAN", "stylegan", None]


def _listed_sql(values: list, key: str) -> str:
    """A DuckDB list of these values, and the one that the key picks."""
    return "[" + ", ".join("null" if v is None else "'" + v + "'" for v in values) + f"][({key} % {len(values)} + 1)::int]"


def _picked(values: list, key: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def _in_sql(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_PATHS_SQL = f"""with t as (select p_partkey, {_listed_sql(PATHS, "p_partkey")} as path, {_listed_sql(LABELS_OF_PATHS, "(p_partkey // 33)")} as label, {_listed_sql(NAMES_OF_PATHS, "(p_partkey // 99)")} as generator from part),
  u as (select *, lower(replace(path, '\\', '/')) as q, replace(path, '\\', '/') as whole, coalesce(nullif(lower(regexp_extract(replace(path, '\\', '/'), '[^/](\\.[^./]+)$', 1)), ''), '<none>') as ext from t)"""


def _paths(spark, sf):
    rows = b.table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 33).alias("k33"), F.floor(F.col("p_partkey") / 99).alias("k99"))
    return rows.select("p_partkey", _picked(PATHS, "p_partkey").alias("path"), _picked(LABELS_OF_PATHS, "k33").alias("label"), _picked(NAMES_OF_PATHS, "k99").alias("generator"))


@query(_PATHS_SQL + """ select p_partkey, case
    when ext in ('.jpg', '.jpeg', '.png', '.bmp', '.webp', '.gif', '.tif', '.tiff') then 'image'
    when ext in ('.mp4', '.avi', '.mov', '.mkv', '.webm', '.flv', '.wmv', '.m4v') then 'video'
    when ext in ('.wav', '.mp3', '.flac', '.ogg', '.m4a') then 'audio'
    when ext in ('.json', '.csv', '.tsv', '.txt', '.md', '.yaml', '.yml', '.xml') then 'metadata'
    when ext in ('.py', '.ipynb', '.sh', '.bat', '.ps1', '.cpp', '.c', '.h', '.hpp', '.java', '.js', '.ts', '.html', '.css', '.cu') then 'code'
    when ext in ('.zip', '.tar', '.gz', '.bz2', '.7z', '.rar') then 'archive'
    when split_part(q, '/', -1) in ('license', 'copying', 'readme') or ext in ('.pdf', '.doc', '.docx') then 'documentation'
    when ext = '<none>' then 'no_extension' else 'other' end as category from u""")
def p21_category(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.category("path").alias("category"))


_BUCKET_SQL = """case when q like '%flickrfaceshq%' or q like '%/ffhq%' then 'ffhq_flickrfaceshq'
    when q like '%1-million-fake-faces%' or contains(q, '1m_faces') then '1_million_fake_faces_stylegan'
    when q like '%faceforensics%' then 'faceforensics' when trim(whole) = '' then 'unknown'
    when len(string_split(whole, '/')) >= 4 then split_part(whole, '/', 4) else 'unknown' end"""


@query(_PATHS_SQL + f" select p_partkey, {_BUCKET_SQL} as bucket from u")
def p23_source_bucket(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.source_bucket("path").alias("bucket"))


@query(_PATHS_SQL + f""" select p_partkey, case when label = 'real' then 'none_authentic' when {_BUCKET_SQL} = '1_million_fake_faces_stylegan' then 'stylegan_1m_fake_faces'
    when lower(path) like '%deepfake%' then 'deepfakes_unspecified' when lower(path) like '%faceswap%' then 'faceswap_unspecified'
    when lower(path) like '%face2face%' then 'face2face_unspecified' when lower(path) like '%neuraltextures%' then 'neuraltextures_unspecified'
    when label = 'fake' then 'unknown_generator' else 'none_authentic' end as bucket from u""")
def p24_generator_bucket(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.generator_bucket("path", "label").alias("bucket"))


@query(_PATHS_SQL + """ select p_partkey, case when label = 'real' then 'unknown'
    when q like '%1-million-fake-faces%' or contains(q, '1m_faces') or q like '%stylegan%' then 'stylegan' else 'unknown' end as generator from u""")
def p05_image_generator(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.image_generator_of("path", "label").alias("generator"))


@query(_PATHS_SQL + """ select p_partkey, case when label = 'real' then 'none' when q like '%deepfakes%' then 'deepfakes' when q like '%face2face%' then 'face2face' when q like '%faceswap%' then 'faceswap'
    when q like '%neuraltextures%' then 'neuraltextures' when q like '%faceshifter%' then 'faceshifter' else 'unknown' end as method from u""")
def p06_manipulation(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.manipulation_of("path", "label").alias("method"))


@query(_PATHS_SQL + """ select p_partkey, case when q like '%asvspoof2019%' then 'asvspoof2019_la' when q like '%asvspoof2021%' then 'asvspoof2021_la' when contains(q, 'coqui_tts') then 'coqui_tts_unseen' else 'unknown' end as dataset from u""")
def p14_dataset(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.dataset_of("path").alias("dataset"))


@query(_PATHS_SQL + """ select p_partkey, case when label = 'real' then 'ffhq_authentic' when generator = 'stylegan' or q like '%1-million-fake-faces%' or q like '%stylegan%' then 'stylegan'
    when q like '%deepfakes%' then 'deepfakes' when q like '%face2face%' then 'face2face' when q like '%faceswap%' then 'faceswap' when q like '%neuraltextures%' then 'neuraltextures' when q like '%faceshifter%' then 'faceshifter'
    when q like '%deepfake%' and q like '%detection%' then 'deepfake_detection' when coalesce(generator, '') not in ('', 'unknown') then generator else 'unknown_forgery' end as generator from u""")
def p17_split_generator(spark, sf):
    return _paths(spark, sf).select("p_partkey", normalize.split_generator("generator", "path", "label").alias("generator"))


#: Suffixes and types of uploads, right and wrong, dealt to the events by their ids.
SUFFIXES = ["jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif", "gif", "mp4", "avi", "mov", "wmv", "webm", "mkv", "flv", "wav", "mp3", "ogg", "flac", "aac", "m4a", "exe"]
TYPES = ["image/jpeg", "image/gif", "image/tiff", "video/mp4", "video/mkv", "video/x-msvideo", "audio/mpeg", "audio/aac", "audio/x-wav", "text/plain", None, "image/jpg", "image/png", "image/webp", "image/bmp", "video/avi", "video/mov", "video/wmv", "video/webm", "audio/wav", "audio/mp3", "audio/ogg", "audio/flac"]
MODALITIES = ["image", "video", "audio", "text", None]


@query(f"""with t as (select event_id, value, {_listed_sql(SUFFIXES, "event_id")} as ext, {_listed_sql(TYPES, "(event_id // 5)")} as mime, {_listed_sql(MODALITIES, "event_id")} as m from events),
  r(m, exts, types) as (values ('image', ['jpg', 'jpeg', 'png', 'webp', 'bmp', 'tiff', 'tif'], ['image/jpeg', 'image/jpg', 'image/png', 'image/webp', 'image/bmp', 'image/tiff']),
    ('video', ['mp4', 'avi', 'mov', 'wmv', 'webm', 'mkv'], ['video/mp4', 'video/avi', 'video/mov', 'video/wmv', 'video/webm', 'video/mkv']),
    ('audio', ['wav', 'mp3', 'ogg', 'flac', 'aac'], ['audio/wav', 'audio/mp3', 'audio/mpeg', 'audio/ogg', 'audio/flac', 'audio/aac']))
  select event_id, case when value = 0 then 'empty_file' when value > case when t.m = 'image' then 200 when t.m = 'audio' then 52428800 when t.m = 'video' then 209715200 else 104857600 end then 'file_too_large'
    when not coalesce(list_contains(exts, ext), false) then 'bad_extension' when not coalesce(list_contains(types, mime), false) then 'bad_mime_type' end as error from t left join r on t.m = r.m""")
def p33_upload_errors(spark, sf):
    rows = b.table(spark, sf, "events").withColumn("k5", F.floor(F.col("event_id") / 5))
    return rows.select("event_id", normalize.file_error(F.col("value"), F.concat(F.lit("f."), _picked(SUFFIXES, "event_id")), _picked(TYPES, "k5"), _picked(MODALITIES, "event_id"), {"image": 200}).alias("error"))


#: Feature objects with every kind of error and none, and what is wrong with each.
PAYLOADS = ['{"k": 1.5, "x": 2, "modality_tag": "image"}', '{"k": "bad", "modality_tag": "audio"}', '{"x": 1, "z": 3, "modality_tag": "video"}', '{}', '{"k": 1, "x": 1, "modality_tag": "text"}', None]


@query("""select event_id, case event_id % 6 when 0 then '' when 1 then 'missing:x,not_numeric:k' when 2 then 'missing:k,unknown:z' when 4 then 'bad_modality' else 'missing:k,missing:x,bad_modality' end as errors from events""")
def p46_feature_errors(spark, sf):
    rows = b.table(spark, sf, "events")
    return rows.select("event_id", F.array_join(normalize.feature_errors(_picked(PAYLOADS, "event_id"), ["k", "x"]), ",").alias("errors"))


@query(with_ctes("small", """select doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) / 1.5::double))), 6) as calibrated, case when 1 / (1 + exp(-(ln(p / (1 - p)) / 1.5::double))) >= 0.4 then 'fake' else 'real' end as label
  from (select doc_id, greatest(1e-6, least(1 - 1e-6, prob)) as p from small)"""))
def p41_prediction(spark, sf):
    rows = b.scores_small(spark, sf).withColumn("p", normalize.prediction("logit", 1.5, 0.4))
    return rows.select("doc_id", F.round(normalize.scaled_probability("logit", 1.5), 6).alias("calibrated"), "p.label")


# --- joins -------------------------------------------------------------------------------


@query(with_ctes("registry artifacts metadata", """select o_orderkey, r.status, case when m.o_orderkey is null then 'missing_metadata' when a.o_orderkey is null then 'missing_file' else 'resolved' end as resolution
  from registry r left join (select o_orderkey from metadata where status = 'success' and preprocessing_version = 'v2') m using (o_orderkey) left join artifacts a using (o_orderkey)"""))
def j01_resolve_samples(spark, sf):
    rows = registry.resolve_samples(b.registry(spark, sf), b.metadata(spark, sf), b.artifacts(spark, sf), "o_orderkey", "v2")
    return rows.select("o_orderkey", "status", "resolution")


@query(with_ctes("registry artifacts metadata", """select o_orderkey, case when m.status is null then 'RAW' when m.status = 'success' and a.o_orderkey is not null then 'PROCESSED' else 'FAILED' end as status, coalesce(s.split_role, r.split) as split
  from registry r left join metadata m using (o_orderkey) left join artifacts a using (o_orderkey) left join (select o_orderkey, 'held' as split_role from orders where o_orderkey % 11 = 0) s using (o_orderkey)"""))
def j03_merge_registry(spark, sf):
    roles = b.table(spark, sf, "orders").where("o_orderkey % 11 = 0").select("o_orderkey", F.lit("held").alias("split_role"))
    rows = registry.merge_registry(b.registry(spark, sf).drop("status"), b.metadata(spark, sf), roles, "o_orderkey", b.artifacts(spark, sf))
    return rows.select("o_orderkey", "status", "split")


@query(with_ctes("artifacts metadata", "select o_orderkey from artifacts anti join metadata using (o_orderkey)"))
def j05_orphans(spark, sf):
    return registry.orphans(b.artifacts(spark, sf), b.metadata(spark, sf), "o_orderkey")


@query(with_ctes("artifacts metadata", "select o_orderkey, status from metadata anti join artifacts using (o_orderkey)"))
def j06_missing(spark, sf):
    return registry.missing(b.metadata(spark, sf), b.artifacts(spark, sf), "o_orderkey").select("o_orderkey", "status")


@query(with_ctes("artifacts metadata", "select count(*) as n from artifacts semi join metadata using (o_orderkey)"))
def j07_matched(spark, sf):
    return registry.matched(b.artifacts(spark, sf), b.metadata(spark, sf), "o_orderkey").agg(F.count("*").alias("n"))


@query(with_ctes("registry artifacts metadata", """, j as (select coalesce(r.o_orderkey, a.o_orderkey, m.o_orderkey) as o_orderkey, r.status, r.o_orderkey is not null as in_registry, a.o_orderkey is not null as in_artifacts, m.o_orderkey is not null as in_metadata
    from registry r full join artifacts a on r.o_orderkey = a.o_orderkey full join metadata m on coalesce(r.o_orderkey, a.o_orderkey) = m.o_orderkey)
  select in_registry, in_artifacts, in_metadata, case when in_artifacts and not in_metadata then case when status = 'RAW' then 'stale_output' else 'orphaned_file' end when in_metadata and not in_artifacts then 'lost_file' end as cause, count(*) as n from j group by all"""))
def j08_reconcile(spark, sf):
    rows = registry.reconcile(b.registry(spark, sf), b.artifacts(spark, sf), b.metadata(spark, sf), "o_orderkey")
    return rows.groupBy("in_registry", "in_artifacts", "in_metadata", "cause").agg(F.count("*").alias("n"))


@query(with_ctes("registry artifacts", """select case when status = 'FAILED' then 'registry_failed' when status = 'RAW' then 'registry_raw' when a.o_orderkey is null then 'missing_file' when m.label <> r.label then 'label_mismatch' end as reason, count(*) as n
  from (select o_orderkey, case when o_orderkey % 13 = 0 then 'fake' else label end as label from registry) m join registry r using (o_orderkey) left join artifacts a using (o_orderkey) group by 1"""))
def j09_reconcile_split(spark, sf):
    reg = b.registry(spark, sf)
    rows = reg.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "fake").otherwise(F.col("label")).alias("label"))
    return registry.reconcile_split(rows, reg, b.artifacts(spark, sf), "o_orderkey").groupBy("reason").agg(F.count("*").alias("n"))


@query(with_ctes("registry artifacts", """select status, case when a.o_orderkey is not null then 'PROCESSED' when status = 'PROCESSED' then 'RAW' else status end as new_status, count(*) as n, count(*) filter ((case when a.o_orderkey is not null then 'PROCESSED' when status = 'PROCESSED' then 'RAW' else status end) <> status) as n_changed
  from registry left join artifacts a using (o_orderkey) group by 1, 2"""))
def j10_promote(spark, sf):
    rows = registry.promote(b.registry(spark, sf), b.artifacts(spark, sf), "o_orderkey")
    return rows.groupBy("status", "new_status").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


@query(with_ctes("registry artifacts metadata", """select array_to_string(list_filter([case when r.status = 'RAW' then 'raw' end, case when a.o_orderkey is null then 'no_file' end, case when m.status = 'failed' then 'failed' end], lambda x: x is not null), '; ') as reasons, count(*) as n
  from registry r left join artifacts a using (o_orderkey) left join metadata m using (o_orderkey) group by 1"""))
def j11_all_reasons(spark, sf):
    rows = b.registry(spark, sf).join(b.artifacts(spark, sf).withColumn("f", F.lit(True)), "o_orderkey", "left").join(b.metadata(spark, sf).select("o_orderkey", F.col("status").alias("m")), "o_orderkey", "left")
    reasons = registry.all_reasons([("raw", F.col("status") == "RAW"), ("no_file", F.col("f").isNull()), ("failed", F.col("m") == "failed")])
    return rows.groupBy(reasons.alias("reasons")).agg(F.count("*").alias("n"))


@query(with_ctes("registry artifacts metadata", """select case when a.o_orderkey is not null and m.status = 'success' then 'keep' when a.o_orderkey is not null then 'recover' else 'no_crop' end as action, count(*) as n
  from registry r left join metadata m using (o_orderkey) left join artifacts a using (o_orderkey) group by 1"""))
def j12_rebuild_metadata(spark, sf):
    rows = registry.rebuild_metadata(b.registry(spark, sf), b.metadata(spark, sf), b.artifacts(spark, sf), "o_orderkey")
    return rows.groupBy("action").agg(F.count("*").alias("n"))


@query(with_ctes("registry metadata", "select o_orderkey, status from registry anti join (select o_orderkey from metadata where status = 'success') using (o_orderkey)"))
def j21_held_out(spark, sf):
    return registry.held_out_rows(b.registry(spark, sf).select("o_orderkey", "status"), b.metadata(spark, sf).where("status = 'success'"), "o_orderkey")


@query(with_ctes("registry artifacts metadata", """select coalesce(m.retry_count, 0) + case when m.status <> 'success' then 1 else 0 end as retry_count, count(*) as n from registry r left join metadata m using (o_orderkey) left join artifacts a using (o_orderkey)
  where not coalesce(m.preprocessing_version = 'v2' and ((m.status = 'success' and a.o_orderkey is not null) or m.status <> 'success'), false) group by 1"""))
def p28_eligible(spark, sf):
    rows = registry.eligible(b.registry(spark, sf).select("o_orderkey"), b.metadata(spark, sf), b.artifacts(spark, sf), "o_orderkey", "v2")
    return rows.groupBy("retry_count").agg(F.count("*").alias("n"))


@query(with_ctes("registry", "select split, count(*) filter (status = 'RAW') as RAW, count(*) filter (status = 'PROCESSED') as PROCESSED, count(*) filter (status = 'FAILED') as FAILED, count(*) filter (status = 'EXCLUDED') as EXCLUDED from registry group by split"))
def a20_status_table(spark, sf):
    return registry.status_table(b.registry(spark, sf))


@query(with_ctes("registry", """, c as (select count(*) as total, count(*) filter (status = 'RAW') as raw, count(*) filter (status = 'PROCESSED') as processed, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'EXCLUDED') as excluded from registry)
  select *, round_even(processed::double / total, 6) as completion, round_even(processed::double / (processed + failed), 6) as success_rate, round_even(raw / 3.5::double / 3600, 6) as eta_hours, raw = 0 as complete from c"""))
def a22_progress(spark, sf):
    return registry.progress(b.registry(spark, sf))


@query(with_ctes("registry artifacts", """select count(*) as n_rows, 0::bigint as null_ids, 0::bigint as null_labels, count(*) filter (status not in ('RAW', 'PROCESSED', 'FAILED', 'EXCLUDED')) as bad_status, count(*) filter (status = 'PROCESSED' and a.o_orderkey is null) as processed_without_file from registry left join artifacts a using (o_orderkey)"""))
def a34_audit(spark, sf):
    return registry.audit(b.registry(spark, sf), b.artifacts(spark, sf), "o_orderkey")


@query(with_ctes("manifest split", """, c as (select split_role, count(distinct generator) as k, case when count(distinct generator) < 2 then 'WARN' else 'PASS' end as level from split group by 1)
  select count(*) filter (level = 'PASS') as n_pass, count(*) filter (level = 'WARN') as n_warn, 0::bigint as n_fail, 0::bigint as n_critical, case when count(*) filter (level = 'WARN') > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as overall from c"""))
def a28_readiness(spark, sf):
    per = b.split(spark, sf).groupBy("split_role").agg(F.count_distinct("generator").alias("k"))
    return registry.readiness(per.select(F.col("split_role").alias("check"), F.when(F.col("k") < 2, "WARN").otherwise("PASS").alias("level")))


# --- leakage -----------------------------------------------------------------------------

_PAIRS = """pairs(left_role, right_role) as (values ('train', 'val'), ('train', 'test_seen'), ('train', 'test_unseen'), ('val', 'test_seen'), ('val', 'test_unseen'))"""


def _overlap_sql(key: str) -> str:
    return with_ctes("manifest split", f""", {_PAIRS}, k as (select distinct {key} as key, split_role from split where {key} is not null and {key} not in ('', 'unknown')),
  s as (select a.split_role as left_role, b.split_role as right_role, a.key from k a join k b on a.key = b.key)
  select p.left_role, p.right_role, count(s.key) as n_shared, min(s.key) as first_example, max(s.key) as last_example from pairs p left join s using (left_role, right_role) group by 1, 2""")


@query(_overlap_sql("identity_key"))
def l01_identity_overlap(spark, sf):
    return leakage.overlaps(b.split(spark, sf), "identity_key")


@query(_overlap_sql("file_hash"))
def l02_hash_overlap(spark, sf):
    return leakage.overlaps(b.split(spark, sf), "file_hash")


@query(_overlap_sql("source_image_key"))
def l03_source_overlap(spark, sf):
    return leakage.overlaps(b.split(spark, sf), "source_image_key")


@query(with_ctes("manifest split", f""", {_PAIRS}, k as (select distinct file_hash as key, split_role from split),
  s as (select a.split_role as left_role, b.split_role as right_role, a.key as example, row_number() over (partition by a.split_role, b.split_role order by a.key)::int as rank from k a join k b on a.key = b.key)
  select left_role, right_role, example, rank from s semi join pairs using (left_role, right_role) where rank <= 5"""))
def l02_hash_examples(spark, sf):
    return leakage.overlap_examples(b.split(spark, sf), "file_hash")


@query(with_ctes("manifest split", """, t as (select generator, count(*) as n from split where split_role = 'train' group by 1)
  select 'generator_leakage' as kind, generator, n from t where generator in ('src3', 'src18') union all select 'generator_policy', generator, n from t where generator not in ('authentic', 'src0', 'src1', 'src2')"""))
def l04_generator_leakage(spark, sf):
    return leakage.generator_leakage(b.split(spark, sf), ["src3", "src18"], ["authentic", "src0", "src1", "src2"])


@query(with_ctes("manifest", """select generator, count(*) filter (upstream_split = 'train') as n_train, count(*) filter (upstream_split = 'test') as n_unseen from manifest where generator <> 'authentic' group by 1 having n_train > 0 and n_unseen > 0"""))
def j25_generators_in_common(spark, sf):
    rows = b.manifest(spark, sf).withColumn("split_role", F.when(F.col("upstream_split") == "test", "test_unseen").otherwise(F.col("upstream_split")))
    return leakage.generators_in_common(rows)


@query(with_ctes("manifest split", f""", {_PAIRS}, t as (select generator, count(*) as n from split where split_role = 'train' group by 1),
  hk as (select distinct file_hash as key, split_role from split), ik as (select distinct identity_key as key, split_role from split where identity_key not in ('', 'unknown')),
  c as (select split_role, count(*) filter (label = 'real') as r, count(*) filter (label = 'fake') as f from split group by 1)
  select 'generator_policy' as kind, generator as subject, n from t where generator not in ('authentic')
  union all select 'hash_leakage', a.split_role || '_x_' || b.split_role, count(*) from hk a join hk b on a.key = b.key join pairs p on p.left_role = a.split_role and p.right_role = b.split_role group by 2
  union all select 'identity_leakage', a.split_role || '_x_' || b.split_role, count(*) from ik a join ik b on a.key = b.key join pairs p on p.left_role = a.split_role and p.right_role = b.split_role group by 2
  union all select 'class_balance', split_role, least(r, f) from c where r + f > 0 and least(r, f)::double / (r + f) < 0.1"""))
def l06_check_splits(spark, sf):
    rows = b.split(spark, sf)
    keys = {"hash_leakage": ("file_hash", F.col("file_hash").isNotNull() & (F.col("file_hash") != "")), "identity_leakage": ("identity_key", normalize.meaningful("identity_key"))}
    balance = manifest.class_balance(rows, "split_role", splits.role_table(rows))
    return leakage.check_splits(rows, keys, b.UNSEEN, ["authentic"], balance)


@query(with_ctes("manifest split", "select 'exact_duplicate' as violation_type, a.sample_id as sample_id_1, b.sample_id as sample_id_2, a.split_role as split_1, b.split_role as split_2 from split a join split b on a.file_hash = b.file_hash and a.doc_id < b.doc_id and a.split_role <> b.split_role"))
def j15_exact_duplicates(spark, sf):
    return leakage.pairwise(b.split(spark, sf), "file_hash", "exact_duplicate", "sample_id", "doc_id")


@query(with_ctes("manifest", """, r as (select *, row_number() over (partition by generator, upstream_split order by doc_id) as rn from manifest)
  select a.generator, a.sample_id as sample_id_1, b.sample_id as sample_id_2 from r a join r b on a.generator = b.generator and a.upstream_split = 'train' and b.upstream_split = 'test' and a.rn <= 10 and b.rn <= 10"""))
def j19_generator_pairs(spark, sf):
    rows = b.manifest(spark, sf).withColumn("split_role", F.when(F.col("upstream_split") == "test", "test_unseen").otherwise(F.col("upstream_split")))
    return leakage.generator_pairs(rows, "sample_id", "doc_id")


@query(with_ctes("hash24", "select a.vec_id as id_1, b.vec_id as id_2, a.split_role as role_1, b.split_role as role_2, bit_count(xor(a.hash, b.hash))::int as distance from hash24 a join hash24 b on a.vec_id < b.vec_id and a.split_role <> b.split_role and bit_count(xor(a.hash, b.hash)) between 1 and 5"))
def j16_near_duplicates(spark, sf):
    return leakage.near_duplicates(b.hash24(spark, sf), "hash", "vec_id", "split_role", 24, 5)


@query(with_ctes("hash32", """, s as (select hash, min(vec_id) as first_seen from hash32 group by 1)
  select a.first_seen as anchor, count(*) as n_near, min(b.first_seen) as first_member, max(b.first_seen) as last_member from s a join s b on a.first_seen < b.first_seen and bit_count(xor(a.hash, b.hash)) between 1 and 5 group by 1"""))
def j20_near_clusters(spark, sf):
    return leakage.near_clusters(b.hash32(spark, sf), "hash", "vec_id", 32, 5)


@query(with_ctes("manifest split", """, c as (select file_hash, split_role as role, count(*) as n, min(sample_id) as first_id from split where file_hash is not null and split_role is not null group by 1, 2)
  select file_hash, role, n, first_id from c where file_hash in (select file_hash from c group by 1 having count(*) > 1)"""))
def j15_duplicate_classes(spark, sf):
    return leakage.duplicate_classes(b.split(spark, sf), "file_hash", "sample_id")


@query(with_ctes("manifest split", """, v as (select a.split_role as s1, b.split_role as s2 from split a join split b on a.file_hash = b.file_hash and a.doc_id < b.doc_id and a.split_role <> b.split_role)
  select count(*) as n_violations, count(*) filter (s2 = 'test_unseen' or s1 = 'test_unseen') as n_critical, count(*) filter (not (s2 = 'test_unseen' or s1 = 'test_unseen')) as n_warning,
  case when count(*) filter (s2 = 'test_unseen' or s1 = 'test_unseen') > 0 then 'FAIL' when count(*) > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as status from v"""))
def l23_verdict(spark, sf):
    return leakage.count_pairs(leakage.duplicate_classes(b.split(spark, sf), "file_hash", "sample_id"), "file_hash")


# --- split assignment --------------------------------------------------------------------


@query("select doc_id, case when x < 0.7 then 'train' when x < 0.8 then 'val' when x < 0.9 then 'test_seen' else 'test_unseen' end as split_role from (select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 8))::ubigint::double / 4294967295::double as x from documents)")
def x03_md5_split(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", splits.md5_role("doc_id").alias("split_role"))


@query(with_ctes("clips", """, s as (select speaker, bool_or(generator = 'unseen') as tainted, count(*) filter (generator <> 'unseen') as n,
    ((((('0x' || substr(md5(speaker), 1, 16))::ubigint % 100) * 16 + ('0x' || substr(md5(speaker), 17, 16))::ubigint % 100)) % 100)::int as roll from clips group by 1)
  select clip_id, speaker, case when tainted then 'test_unseen' when n < 55 then 'train' when roll < 70 then 'train' when roll < 85 then 'val' else 'test_seen' end as split_role from clips join s using (speaker)"""))
def x02_speaker_split(spark, sf):
    rows = splits.speaker_roles(b.clips(spark, sf), "speaker", F.col("generator") == "unseen", 55)
    return rows.select("clip_id", "speaker", "split_role")


@query(with_ctes("manifest split", "select doc_id, split_role from split where split_role <> 'train' or generator in ('authentic', 'src1', 'src2')"))
def x04_allowed_rows(spark, sf):
    return splits.allowed_rows(b.split(spark, sf), {"train": ["authentic", "src1", "src2"]}).select("doc_id", "split_role")


@query(with_ctes("manifest split", "select split_role, generator, count(*) as n from split where split_role = 'train' and generator not in ('authentic', 'src1') group by 1, 2"))
def x01_policy_errors(spark, sf):
    return splits.policy_errors(b.split(spark, sf), {"train": ["authentic", "src1"]})


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by md5('s' || doc_id), doc_id) as r, count(*) over (partition by lang) as n from documents)
  select doc_id, lang, case when r <= floor(n * 0.70::double) then 'train' when r <= floor(n * 0.70::double) + floor(n * 0.15::double) then 'val' else 'test' end as subset from r""")
def x08_hashed_shares(spark, sf):
    return splits.hashed_shares(b.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", stratum="lang")


@query(with_ctes("manifest", """, q as (select least(1400, count(*) filter (label = 'fake'), count(*) filter (label = 'real')) as q from manifest), r as (select doc_id, label, row_number() over (partition by label order by md5('s' || doc_id), doc_id) as r from manifest where label is not null)
  select doc_id, label, case when r <= floor(q * 0.70::double) then 'train' when r <= floor(q * 0.70::double) + floor(q * 0.15::double) then 'val' else 'test' end as subset from r, q where r <= q"""))
def x09_balanced_subset(spark, sf):
    return manifest.balanced_subset(b.manifest(spark, sf).select("doc_id", "label"), "doc_id", 1400)


@query(with_ctes("clips", """, f as (select *, row_number() over (partition by generator order by md5('s' || clip_id), clip_id) as r, md5('s' || clip_id) as h from clips where label = 'real'),
  s as (select (select count(*) from clips where label = 'fake') as need, (select count(distinct generator) from clips where label = 'real') as kinds),
  c as (select f.*, row_number() over (order by r > need // greatest(kinds, 1), h, clip_id) as k, need from f, s)
  select clip_id, label, generator from clips where label = 'fake' union all select clip_id, label, generator from c where k <= need"""))
def x10_generator_quota(spark, sf):
    rows = b.clips(spark, sf).select("clip_id", "generator", F.when(F.col("label") == "fake", "real").otherwise("fake").alias("label"))
    out = manifest.generator_quota(rows, "clip_id")
    return out.select("clip_id", F.when(F.col("label") == "fake", "real").otherwise("fake").alias("label"), "generator")


@query("""with r as (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n from events)
  select event_id, case when r <= floor(n * 0.70::double) then 'train' when r <= floor(n * 0.70::double) + floor(n * 0.15::double) then 'val' else 'test' end as subset from r""")
def x14_time_aware(spark, sf):
    return splits.time_aware(b.table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "subset")


@query(with_ctes("manifest", "select label, count(*) as n, 1.0::double / count(*) as weight from manifest group by label"))
def x11_class_weights(spark, sf):
    return splits.class_weights(b.manifest(spark, sf))


@query(with_ctes("manifest", "select round(count(*) filter (label = 'real')::double / count(*) filter (label = 'fake'), 9) as pos_weight from manifest"))
def x12_pos_weight(spark, sf):
    return splits.pos_weight(b.manifest(spark, sf)).select(F.round("pos_weight", 9).alias("pos_weight"))


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by md5('s' || event_id), event_id) as r from events) where r <= 5")
def x16_first_n_per_group(spark, sf):
    return splits.first_n_per_group(b.table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 5)


# --- evaluation --------------------------------------------------------------------------

_COUNTS = "model, split, count(*) filter (prob >= 0.5 and y = 1) as tp, count(*) filter (prob >= 0.5 and y = 0) as fp, count(*) filter (prob < 0.5 and y = 0) as tn, count(*) filter (prob < 0.5 and y = 1) as fn"
_DISTINCT = "g as (select model, split, prob, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from scores group by 1, 2, 3)"


@query(with_ctes("scores", f""", c as (select {_COUNTS} from scores group by 1, 2)
  select *, tp + fp + tn + fn as support, round((tp + tn)::double / (tp + fp + tn + fn), 6) as accuracy, round(coalesce(tp::double / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp::double / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
  round((coalesce(tp::double / nullif(tp + fn, 0), 0) + coalesce(tn::double / nullif(tn + fp, 0), 0)) / ((tp + fn > 0)::int + (tn + fp > 0)::int), 6) as balanced_accuracy from c"""))
def e01_classification(spark, sf):
    rows = metrics.classification(metrics.confusion(b.scores_big(spark, sf), KEYS), KEYS)
    return rows.select(*KEYS, "tp", "fp", "tn", "fn", "support", *map(r6, ("accuracy", "precision", "recall", "f1", "balanced_accuracy")))


@query(with_ctes("scores", f""", {_DISTINCT}, w as (select *, coalesce(sum(neg) over (partition by model, split order by prob rows between unbounded preceding and 1 preceding), 0) as below from g)
  select model, split, round(sum(pos * (2 * below + neg))::double / (2.0::double * sum(pos) * sum(neg)), 9) as roc_auc, sum(pos)::bigint as n_pos, sum(neg)::bigint as n_neg from w group by 1, 2"""))
def e07_roc_auc(spark, sf):
    return metrics.roc_auc(b.scores_big(spark, sf), KEYS).withColumn("roc_auc", F.round("roc_auc", 9))


@query(with_ctes("scores", f""", {_DISTINCT}, w as (select *, sum(pos) over v as tp, sum(pos + neg) over v as np from g window v as (partition by model, split order by prob desc rows unbounded preceding))
  select model, split, round(sum(pos * tp::double / np) / sum(pos), 9) as pr_auc from w group by 1, 2"""))
def e08_pr_auc(spark, sf):
    return metrics.pr_auc(b.scores_big(spark, sf), KEYS).withColumn("pr_auc", F.round("pr_auc", 9))


@query(with_ctes("scores", f""", {_DISTINCT}, w as (select model, split, prob, (sum(neg) over k - coalesce(sum(neg) over b, 0))::double / sum(neg) over k as far, coalesce(sum(pos) over b, 0)::double / sum(pos) over k as frr from g
    window k as (partition by model, split), b as (partition by model, split order by prob rows between unbounded preceding and 1 preceding))
  select model, split, round((far + frr) / 2, 9) as eer, round(prob, 6) as eer_threshold from w qualify row_number() over (partition by model, split order by abs(far - frr), prob) = 1"""))
def e09_eer(spark, sf):
    return metrics.eer(b.scores_big(spark, sf), KEYS).select(*KEYS, F.round("eer", 9).alias("eer"), r6("eer_threshold"))


@query(with_ctes("scores", f""", {_DISTINCT}, w as (select model, split, prob, (sum(neg) over k - coalesce(sum(neg) over b, 0))::double / sum(neg) over k as far, coalesce(sum(pos) over b, 0)::double / sum(pos) over k as frr from g
    window k as (partition by model, split), b as (partition by model, split order by prob rows between unbounded preceding and 1 preceding)), u as (select * from w union all select distinct model, split, 'infinity'::double, 0.0::double, 1.0::double from w)
  select model, split, round((far + frr) / 2, 9) as eer from u qualify row_number() over (partition by model, split order by abs(far - frr), prob desc) = 1"""))
def e10_curve_eer(spark, sf):
    return metrics.curve_eer(b.scores_big(spark, sf), KEYS).withColumn("eer", F.round("eer", 9))


_EDGES = "[" + ", ".join(repr(e) + "::double" for e in metrics.bin_edges()) + "]"
_BINNED = f"bn as (select *, least(len(list_filter({_EDGES}, lambda e: prob >= e)), 10)::int - 1 as bin from scores where prob between 0 and 1)"


@query(with_ctes("scores", f", {_BINNED} select model, split, bin, count(*) as n, round(avg(y), 9) as accuracy, round(avg(prob), 9) as confidence from bn group by 1, 2, 3"))
def e19_reliability(spark, sf):
    rows = metrics.reliability(b.scores_big(spark, sf), KEYS)
    return rows.select(*KEYS, "bin", "n", F.round("accuracy", 9).alias("accuracy"), F.round("confidence", 9).alias("confidence"))


@query(with_ctes("scores", f", {_BINNED}, r as (select model, split, bin, count(*) as n, avg(y) as a, avg(prob) as c from bn group by 1, 2, 3) select model, split, round(sum(n * abs(a - c)) / sum(n), 9) as ece from r group by 1, 2"))
def e11_ece(spark, sf):
    return metrics.ece(b.scores_big(spark, sf), KEYS).withColumn("ece", F.round("ece", 9))


@query(with_ctes("scores", "select model, split, round(avg((prob - y) * (prob - y)), 9) as brier, round(avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, prob))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, prob))))), 9) as nll from scores group by 1, 2"))
def e15_proper_scores(spark, sf):
    return metrics.proper_scores(b.scores_big(spark, sf), KEYS).select(*KEYS, F.round("brier", 9).alias("brier"), F.round("nll", 9).alias("nll"))


_GRID = metrics.threshold_grid(0.10, 0.90, 0.01)
_SWEEP = f""", t as (select unnest([{", ".join(repr(t) + "::double" for t in _GRID)}]) as threshold),
  c as (select model, split, threshold, count(*) filter (prob >= threshold and y = 1)::double as tp, count(*) filter (prob >= threshold and y = 0)::double as fp, count(*) filter (y = 1)::double as p, count(*) filter (y = 0)::double as n from scores, t group by 1, 2, 3)"""


@query(with_ctes("scores", _SWEEP + " select model, split, round(threshold, 6) as threshold, round(round((tp / p + (n - fp) / n) / 2, 12), 9) as value from c qualify row_number() over (partition by model, split order by round((tp / p + (n - fp) / n) / 2, 12) desc, abs(threshold - 0.5), threshold) = 1"))
def e26_best_threshold(spark, sf):
    rows = metrics.best_balanced_threshold(b.scores_big(spark, sf), KEYS, _GRID)
    return rows.select(*KEYS, r6("threshold"), F.round("value", 9).alias("value"))


_GRID_F1 = [float(x) for x in __import__("numpy").linspace(0.05, 0.95, 19)]


@query(with_ctes("scores", f""", t as (select unnest([{", ".join(repr(t) + "::double" for t in _GRID_F1)}]) as threshold),
  c as (select model, split, threshold, count(*) filter (prob >= threshold and y = 1) as tp, count(*) filter (prob >= threshold and y = 0) as fp, count(*) filter (prob < threshold and y = 1) as fn from scores, t group by 1, 2, 3)
  select model, split, round(threshold, 6) as threshold, round(2 * tp::double / (2 * tp + fp + fn), 9) as f1 from c qualify row_number() over (partition by model, split order by 2 * tp::double / (2 * tp + fp + fn) desc, threshold) = 1"""))
def e27_best_f1(spark, sf):
    return metrics.best_f1_threshold(b.scores_big(spark, sf), KEYS).select(*KEYS, r6("threshold"), F.round("f1", 9).alias("f1"))


@query()
def e21_fit_temperature(spark, sf):
    """Iterative: the fitted temperature and the NLL before and after."""
    scores = b.scores_small(spark, sf)
    t, before, after = metrics.fit_temperature(scores)
    return spark.createDataFrame([(t, before, after)], "temperature double, nll_before double, nll_after double")


@query(with_ctes("small", """, z as (select split, y, ln(greatest(1e-6, least(1 - 1e-6, prob)) / (1 - greatest(1e-6, least(1 - 1e-6, prob)))) as logit from small), s as (select split, stage, y, 1 / (1 + exp(-logit / t)) as prob from z, (values ('before', 1.0::double), ('after', 1.7::double)) v(stage, t))
  select split, stage, round(avg((prob - y) * (prob - y)), 6) as brier, round(avg(-(y * ln(greatest(1e-7, least(1 - 1e-7, prob))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, prob))))), 6) as nll from s group by 1, 2"""))
def e23_before_after(spark, sf):
    rows = metrics.before_after(b.scores_small(spark, sf), ["split"], 1.7)
    return rows.select("split", "stage", "brier", "nll")


@query(with_ctes("scores", f""", c as (select {_COUNTS} from scores group by 1, 2), m as (select *, (tp + tn)::double / (tp + fp + tn + fn) as accuracy, coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0) as f1 from c)
  select model, round(max(accuracy) filter (split = 'test_seen') - max(accuracy) filter (split = 'test_unseen'), 5) as accuracy_gap, round(max(f1) filter (split = 'test_seen') - max(f1) filter (split = 'test_unseen'), 5) as f1_gap, null::varchar as note from m group by 1"""))
def e28_generalization_gap(spark, sf):
    rows = metrics.classification(metrics.confusion(b.scores_big(spark, sf), KEYS), KEYS)
    gaps = compare.generalization_gap(rows, ["accuracy", "f1"])
    return gaps.select("model", F.round("accuracy_gap", 5).alias("accuracy_gap"), F.round("f1_gap", 5).alias("f1_gap"), "note")


@query()
def e32_all_metrics(spark, sf):
    """Every metric at once; each part has a query of its own with SQL."""
    return metrics.all_metrics(b.scores_big(spark, sf), KEYS)


# --- comparison and fusion ---------------------------------------------------------------

_F1 = f"c as (select {_COUNTS} from scores group by 1, 2), m as (select model, split, coalesce(2 * tp::double / nullif(2 * tp + fp + fn, 0), 0) as f1, case model when 'm_disc' then 0 else 1 end as ord from c)"


def _f1_table(spark, sf):
    rows = metrics.classification(metrics.confusion(b.scores_big(spark, sf), KEYS), KEYS)
    return rows.select(*KEYS, "f1", "accuracy", F.when(F.col("model") == "m_disc", 0).otherwise(1).alias("ord"))


@query(with_ctes("scores", f", {_F1} select model as label, round(f1, 6) as value from m where split = 'test_seen' order by f1 desc, ord limit 1"))
def r01_best_model(spark, sf):
    return compare.best_by(_f1_table(spark, sf).where("split = 'test_seen'"), "f1").select("label", r6("value"))


@query(with_ctes("scores", f", {_F1}, g as (select model, ord, max(f1) filter (split = 'test_seen') - max(f1) filter (split = 'test_unseen') as gap from m group by 1, 2) select model as label, round(gap, 5) as value from g order by abs(round(gap, 6)), ord limit 1"))
def r02_smallest_gap(spark, sf):
    rows = _f1_table(spark, sf).withColumn("support", F.lit(1))
    gaps = compare.generalization_gap(rows, ["f1"]).withColumn("ord", F.when(F.col("model") == "m_disc", 0).otherwise(1))
    return compare.best_by(gaps, "f1_gap", smallest_abs=True).select("label", F.round("value", 5).alias("value"))


@query(with_ctes("scores", f""", {_F1}, v as (select max(f1) filter (model = 'm_disc' and split = 'test_seen') as bs, max(f1) filter (model = 'm_disc' and split = 'test_unseen') as bu, max(f1) filter (model = 'm_qty' and split = 'test_seen') as vs, max(f1) filter (model = 'm_qty' and split = 'test_unseen') as vu from m)
  select vs > bs as improves_seen, vu > bu as improves_unseen, abs(vs - vu) < abs(bs - bu) as narrows_gap from v"""))
def r03_compare_models(spark, sf):
    return compare.compare_models(_f1_table(spark, sf), "m_disc", "m_qty")


@query(with_ctes("scores", f", {_F1} select model, split, 'f1' as metric, round(f1, 6) as value from m"))
def k12_comparison_table(spark, sf):
    return compare.comparison_table(_f1_table(spark, sf), ["f1"]).withColumn("value", F.round("value", 6))


@query(with_ctes("probs", """, w(modality, w) as (values ('image', 0.4::double), ('audio', 0.3::double), ('video', 0.3::double)),
  p as (select sample_id, w, 1 / (1 + exp(-ln(prob / (1 - prob + 1e-7) + 1e-7) / 1.2::double)) as p from probs join w using (modality) where prob is not null)
  select sample_id, round(sum(w * p) / sum(w), 6) as prob, count(*)::int as n_modalities from p group by 1"""))
def f01_fuse(spark, sf):
    t = {"image": 1.2, "audio": 1.2, "video": 1.2}
    return compare.fuse(b.fusion_probs(spark, sf), "sample_id", {"image": 0.4, "audio": 0.3, "video": 0.3}, t).select("sample_id", r6("prob"), "n_modalities")


@query("""with s as (select user_id, event_id, value, max(value) over (partition by user_id order by event_id rows unbounded preceding) as best, value > coalesce(max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), '-infinity'::double) as better from events),
  e as (select *, max(case when better then event_id end) over (partition by user_id order by event_id rows unbounded preceding) as best_epoch from s)
  select user_id, event_id, best, best_epoch, event_id - best_epoch as stale, coalesce(max((event_id - best_epoch >= 400)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) = 1 as stopped from e""")
def r14_early_stopping(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", "event_id", "value")
    return compare.early_stopping(e, "user_id", "event_id", "value", 400).drop("value")


# --- streams -----------------------------------------------------------------------------


@query(with_ctes("stream", """, w as (select *, avg(x) over (partition by user_id order by pos rows between 15 preceding and current row) as raw from stream)
  select user_id, ((pos - 16) // 8)::int as window_idx, pos as frame_idx, raw from w where pos >= 16 and (pos - 16) % 8 = 0"""))
def t07_sliding_windows(spark, sf):
    rows = windows.sliding_windows(b.stream(spark, sf), "user_id", 16, windows.step_size(16, 0.5))
    return rows


@query(with_ctes("stream", "select user_id, list_reduce(list(x order by pos), lambda a, v: 0.3::double * v + 0.7::double * a) as smoothed from stream group by 1"))
def t05_ema(spark, sf):
    return windows.ema_last(b.stream(spark, sf), "user_id", "pos", "x", 0.3)


@query(with_ctes("stream", """, w as (select *, avg(x) over (partition by user_id order by pos rows between 15 preceding and current row) as raw from stream), k as (select user_id, ((pos - 16) // 8)::int as window_idx, pos as frame_idx, raw from w where pos >= 16 and (pos - 16) % 8 = 0),
  l as (select user_id, window_idx, frame_idx, raw, list(raw) over (partition by user_id order by window_idx rows unbounded preceding) as xs from k)
  select user_id, window_idx, frame_idx, raw, list_reduce(xs, lambda a, v: 0.3::double * v + 0.7::double * a) as smoothed from l"""))
def t07_smoothed_windows(spark, sf):
    rows = windows.sliding_windows(b.stream(spark, sf), "user_id", 16, 8)
    return windows.ema_series(rows, "user_id", 0.3).select("user_id", "window_idx", "frame_idx", "raw", "smoothed")


def _sweep_sql() -> str:
    parts = []
    for size in (8, 16, 32, 64):
        for overlap in (0.0, 0.25, 0.5, 0.75):
            step = windows.effective_step(size, overlap)
            parts.append(f"""select {size} as window_size, {overlap}::double as overlap, u.user_id, coalesce(s, 0.5) as final_score from (select distinct user_id from stream) u left join
      (select user_id, list_reduce(list(raw order by pos), lambda a, v: 0.3::double * v + 0.7::double * a) as s from (select *, avg(x) over (partition by user_id order by pos rows between {size - 1} preceding and current row) as raw from stream) where pos >= {size} and (pos - {size}) % {step} = 0 group by 1) k on u.user_id = k.user_id""")
    return with_ctes("stream", " union all ".join(parts))


@query(_sweep_sql())
def t11_sweep(spark, sf):
    configs = [(size, overlap) for size in (8, 16, 32, 64) for overlap in (0.0, 0.25, 0.5, 0.75)]
    return windows.sweep(b.stream(spark, sf), "user_id", configs, 0.3)


# --- arrays ------------------------------------------------------------------------------


@query("select event_id, case when n <= 8 then range(n) else [i * (n - 1) // 7 for i in range(8)] end as frames from (select event_id, 1 + event_id % 40 as n from events)")
def v01_frame_indices(spark, sf):
    return b.table(spark, sf, "events").select("event_id", arrays.frame_indices(F.lit(1) + F.col("event_id") % 40, 8).alias("frames"))


_VEC = "e as (select vec_id, embedding::double[] as v from embeddings)"


@query(f"with {_VEC} select vec_id, round(list_sum([abs(v[i + 1] - v[i]) for i in range(1, 64)]) / 63, 6) as step, round(list_sum(v) / 64, 6) as mean from e")
def v04_mean_step(spark, sf):
    rows = b.table(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(arrays.mean_step("embedding"), 6).alias("step"), F.round(arrays.mean_of("embedding"), 6).alias("mean"))


@query(f"with {_VEC} select vec_id, round(list_sum([(greatest(-80.0::double, least(0.0::double, x * 100 - 40)) + 80) / 80 for x in v]), 6) as total from e")
def v08_decibels(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100 - 40).alias("db"))
    unit = arrays.decibels_to_unit("db")
    return rows.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {_VEC} select vec_id, [round(x, 6) for x in v[13:52]] as cropped, len(v) + 36 as padded from e")
def v09_center_fit(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", F.transform(arrays.center_fit("v", 40), lambda x: b.rounded(x)).alias("cropped"), F.size(arrays.center_fit("v", 100)).cast("long").alias("padded"))


@query(f"with {_VEC} select vec_id, round(list_sum([(x - list_min(v)) / (list_max(v) - list_min(v)) for x in v]), 6) as total from e")
def y17_min_max(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate(arrays.min_max("v"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {_VEC} select vec_id, round(list_sum([((x / 255 - 0.5::double) / 0.25::double) for x in v]), 6) as total from e")
def v14_standardize(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate(arrays.standardize("v", 0.5, 0.25), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""select o_orderkey, case when x1 > x0 and y1 > y0 then x0 end as x0, case when x1 > x0 and y1 > y0 then y1 end as y1 from (
  select o_orderkey, greatest(0, x - 8) as x0, greatest(0, y - 8) as y0, least(100, x + 48) as x1, least(80, y + 48) as y1 from (select o_orderkey, (o_orderkey % 150)::int as x, (o_custkey % 120)::int as y from orders))""")
def v15_crop_box(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 150).cast("int").alias("x"), (F.col("o_custkey") % 120).cast("int").alias("y"))
    box = arrays.crop_box("x", "y", F.lit(40), F.lit(40), F.lit(100), F.lit(80))
    return rows.select("o_orderkey", box["x0"].alias("x0"), box["y1"].alias("y1"))


@query(f"with {_VEC} select vec_id, (bit_count(list_sum([case when v[i + 1] > 0 then 1::bigint << i else 0 end for i in range(24)])::bigint))::int as ones from e")
def v18_hash_bits(spark, sf):
    return b.table(spark, sf, "embeddings").select("vec_id", F.bit_count(arrays.sign_bits("embedding", 24)).alias("ones"))


@query()
def v05_spectrum(spark, sf):
    """Fourier magnitudes, Laplacian variance and perceptual hash of 8x8 pictures (numpy in Arrow batches)."""
    rows = b.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", arrays.picture_features("v").alias("f")).select("vec_id", "f.magnitude", "f.sharpness", "f.phash")


# --- features over time ------------------------------------------------------------------


@query("""select event_id, avg(case when value < 50 then 1.0::double else 0 end) over (partition by user_id, event_type order by ts, event_id rows between 5 preceding and 1 preceding) as recent_success,
  row_number() over (partition by user_id, event_type order by ts, event_id)::int - 1 as attempts from events""")
def x15_behaviour_features(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    success = F.when(F.col("value") < 50, 1.0).otherwise(0.0)
    return b.table(spark, sf, "events").select("event_id", F.avg(success).over(w.rowsBetween(-5, -1)).alias("recent_success"), (F.row_number().over(w) - 1).alias("attempts"))


@query("""with r as (select l_orderkey, (l_returnflag = 'R') as rf, l_quantity from lineitem) select rf as y, count(*) as n, round(avg(l_quantity), 6) as mean_quantity from r group by 1""")
def a32_group_accuracy(spark, sf):
    return b.table(spark, sf, "lineitem").groupBy((F.col("l_returnflag") == "R").alias("y")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


# --- audits ------------------------------------------------------------------------------


@query(with_ctes("manifest", """, p(l, r) as (values ('train', 'valid'), ('train', 'test'), ('valid', 'test')), k as (select distinct file_hash as key, upstream_split as s from manifest), k2 as (select distinct source_image_key as key, upstream_split as s from manifest),
  b as (select doc_id % 97 as b, min(upstream_split) as lo, max(upstream_split) as hi from manifest group by 1 having lo <> hi), t as (select file_hash, min(label) as lo, max(label) as hi from manifest where upstream_split = 'train' group by 1 having lo <> hi)
  select 'id_' || l || '_' || r as check, (select count(*) from k a join k c on a.key = c.key and a.s = l and c.s = r) as n from p
  union all select 'path_' || l || '_' || r, (select count(*) from k2 a join k2 c on a.key = c.key and a.s = l and c.s = r) from p
  union all select 'name_in_several_splits', (select count(*) from (select source_image_key, min(upstream_split) lo, max(upstream_split) hi from (select split_part(source_image_key, '/', 2) as source_image_key, upstream_split from manifest) group by 1 having lo <> hi))
  union all select 'train_id_with_both_labels', (select count(*) from t)"""))
def l18_split_leakage(spark, sf):
    return audits.split_leakage(b.manifest(spark, sf), "file_hash", "source_image_key", "upstream_split")


@query(with_ctes("manifest split registry", """, r(role) as (values ('train'), ('val'), ('test_seen'), ('test_unseen')), c as (select role, count(s.doc_id) as n, count(distinct generator) as k from r left join split s on s.split_role = role group by 1)
  select 'rows' as check, role as subject, case when n > 0 then 'PASS' when role = 'test_unseen' then 'CRITICAL' else 'FAIL' end as level, n::double as value from c
  union all select 'generators', role, case when k >= 2 then 'PASS' else 'WARN' end, k::double from c where n > 0
  union all select 'coverage', 'registry', case when v >= 0.9 then 'PASS' else 'FAIL' end, v from (select count(*) filter (status = 'PROCESSED')::double / count(*) as v from registry)"""))
def y29_readiness_checks(spark, sf):
    return audits.readiness_checks(b.split(spark, sf), b.registry(spark, sf))


@query(with_ctes("manifest", "select file_hash, sample_id, n from manifest join (select file_hash, count(*) as n from manifest group by 1 having count(*) > 1) using (file_hash)"))
def y26_content_audit(spark, sf):
    return audits.content_audit(b.manifest(spark, sf), "file_hash", "sample_id")


@query(with_ctes("manifest", """select doc_id, label from (select *, row_number() over (partition by label order by md5('s' || doc_id), doc_id) as r from manifest where upstream_split <> 'test' and label is not null) where r <= case label when 'real' then 60 else 20 end"""))
def y05_stratified_quota(spark, sf):
    rows = b.manifest(spark, sf).select("doc_id", "label", "upstream_split")
    return audits.stratified_quota(rows, "label", "doc_id", {"real": 60, "fake": 20}, excluded=rows.where("upstream_split = 'test'")).select("doc_id", "label")


@query(with_ctes("registry", """, f as (select count(*) filter (status = 'RAW') as raw, count(*) filter (status = 'FAILED') as failed, count(*) as n from registry)
  select recommendation from (select 'process the raw rows' as recommendation from f where raw > 0 union all select 'look into failures' from f where failed::double / n > 0.01 union all select 'nothing is registered' from f where n = 0)"""))
def y22_recommendations(spark, sf):
    facts = registry.progress(b.registry(spark, sf))
    return audits.recommendations(facts, [("process the raw rows", F.col("raw") > 0), ("look into failures", F.col("failed") / F.col("total") > 0.01), ("nothing is registered", F.col("total") == 0)])


@query()
def u12_tabular_classifier(spark, sf):
    """Fitted on the earliest 70 % of events, scored on the rest: event_id and probability."""
    e = b.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = splits.time_aware(e, "ts", "event_id").withColumn("y", (F.col("value") > 50).cast("double")).withColumn("hour", F.hour("ts").cast("double")).withColumn("user", F.col("user_id").cast("double"))
    model = tabular.fit(rows.where("subset = 'train'"), ["hour", "user"], ["event_type"])
    return tabular.score(model, rows.where("subset <> 'train'")).select("event_id", "subset", "prob")
