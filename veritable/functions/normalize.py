"""Column expressions that clean labels, names, paths and keys.

Every function takes columns (or names) and returns a column, so it stays inside generated
code. Where a value breaks a rule the result is null and the matching ``*_error`` expression
tells why; callers keep such rows in a quarantine rather than fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tidy(c: ColumnOrName) -> Column:
    """Trimmed lower case; null stays null."""
    return F.lower(F.trim(col(c)))


def meaningful(c: ColumnOrName) -> Column:
    """Neither null, empty nor ``unknown``."""
    return col(c).isNotNull() & ~col(c).isin("", "unknown")


def or_unknown(c: ColumnOrName) -> Column:
    return F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("unknown"))


def posix(c: ColumnOrName) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


# --- labels ------------------------------------------------------------------------------


def image_label(label: ColumnOrName, label_text: ColumnOrName) -> Column:
    """real / fake from a text and a number that must not contradict it (1 real, 0 fake)."""
    number, text = F.coalesce(tidy(label), F.lit("")), F.coalesce(tidy(label_text), F.lit(""))
    return (
        F.when((text == "real") & number.isin("", "1"), "real")
        .when((text == "fake") & number.isin("", "0"), "fake")
        .when(text.isin("real", "fake"), F.lit(None))
        .when(number == "1", "real")
        .when(number == "0", "fake")
    )


def image_label_error(label: ColumnOrName, label_text: ColumnOrName) -> Column:
    return F.when(image_label(label, label_text).isNull(), F.concat(F.lit("inconsistent label: "), F.coalesce(col(label), F.lit("")), F.lit("/"), F.coalesce(col(label_text), F.lit(""))))


def audio_label(label: ColumnOrName) -> Column:
    text = tidy(label)
    return F.when(text.isin("bonafide", "genuine", "real"), "real").when(text.isin("spoof", "fake"), "fake")


def joined_id(*parts: ColumnOrName) -> Column:
    """Trimmed parts joined by colons; null if one is null or empty."""
    clean = [F.trim(col(p)) for p in parts]
    whole = clean[0] != ""
    for p in clean[1:]:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws(":", *clean))


# --- provenance --------------------------------------------------------------------------

#: Manipulation methods in order of precedence, path markers and attack codes.
METHODS = ("deepfakes", "face2face", "faceswap", "neuraltextures", "faceshifter")
STYLEGAN_MARKERS = ("1-million-fake-faces", "1m_faces", "stylegan")
STYLEGAN_SOURCES = ("1-million-fake-faces", "stylegan")
SEEN_ATTACKS = ("A01", "A02", "A03", "A04", "A05", "A06")
UNSEEN_ATTACKS = ("A07", "A08", "A09", "A10", "A11", "A12", "A13", "A14", "A15", "A16", "A17", "A18", "A19")
DATASETS = {"asvspoof2019": "asvspoof2019_la", "asvspoof2021": "asvspoof2021_la", "coqui_tts": "coqui_tts_unseen"}


def _contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | text.contains(m)
    return found


def image_generator_of(path: ColumnOrName, label: ColumnOrName) -> Column:
    text = F.lower(posix(path))
    return F.when(col(label) == "real", "unknown").when(_contains_any(text, STYLEGAN_MARKERS), "stylegan").otherwise("unknown")


def manipulation_of(path: ColumnOrName, label: ColumnOrName) -> Column:
    text = F.lower(posix(path))
    chain = F.when(col(label) == "real", "none")
    for m in METHODS:
        chain = chain.when(text.contains(m), m)
    return chain.otherwise("unknown")


def audio_generator(name: ColumnOrName, label: ColumnOrName) -> Column:
    """bonafide, an attack code, coqui, or unknown."""
    code = F.upper(F.trim(col(name)))
    return F.when(col(label) == "real", "bonafide").when(code.isin(*SEEN_ATTACKS, *UNSEEN_ATTACKS), code).when(code == "COQUI", "coqui").when(code.isNull() | code.isin("", "-"), "unknown").otherwise("unknown")


def seen_generator(c: ColumnOrName) -> Column:
    return col(c).isin("bonafide", *SEEN_ATTACKS)


def unseen_generator(c: ColumnOrName) -> Column:
    return col(c).isin("coqui", *UNSEEN_ATTACKS)


def split_generator(generator: ColumnOrName, path: ColumnOrName, label: ColumnOrName) -> Column:
    """The generator name that split policies use: a real image counts as authentic; a fake one
    goes by what its own name or its path says, else by its own name as it is written."""
    text, own = F.lower(posix(path)), F.coalesce(col(generator), F.lit(""))
    chain = F.when(col(label) == "real", "ffhq_authentic").when((own == "stylegan") | _contains_any(text, STYLEGAN_SOURCES), "stylegan")
    for m in METHODS:
        chain = chain.when(text.contains(m), m)
    chain = chain.when(text.contains("deepfake") & text.contains("detection"), "deepfake_detection")
    return chain.when(~own.isin("", "unknown"), own).otherwise("unknown_forgery")


def dataset_of(path: ColumnOrName) -> Column:
    """The audio corpus that a path names, or ``unknown``."""
    text, chain = F.lower(posix(path)), None
    for marker, name in DATASETS.items():
        chain = F.when(text.contains(marker), name) if chain is None else chain.when(text.contains(marker), name)
    return chain.otherwise("unknown")


def source_id(sample_id: ColumnOrName) -> Column:
    """The last of at least three colon-separated parts, if not empty."""
    parts = F.split(col(sample_id), ":")
    return F.when(F.size(parts) >= 3, F.nullif(F.element_at(parts, -1), F.lit("")))


def identity_key(sample_id: ColumnOrName, label: ColumnOrName) -> Column:
    return F.concat(F.when(col(label) == "real", "real_").otherwise("fake_"), source_id(sample_id))


def source_key(c: ColumnOrName) -> Column:
    return F.lower(posix(or_unknown(c)))


# --- files -------------------------------------------------------------------------------

#: File categories by extension, in order of precedence; names and extensions of
#: documentation, which come after them.
CATEGORIES = {
    "image": (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".gif", ".tif", ".tiff"),
    "video": (".mp4", ".avi", ".mov", ".mkv", ".webm", ".flv", ".wmv", ".m4v"),
    "audio": (".wav", ".mp3", ".flac", ".ogg", ".m4a"),
    "metadata": (".json", ".csv", ".tsv", ".txt", ".md", ".yaml", ".yml", ".xml"),
    "code": (".py", ".ipynb", ".sh", ".bat", ".ps1", ".cpp", ".c", ".h", ".hpp", ".java", ".js", ".ts", ".html", ".css", ".cu"),
    "archive": (".zip", ".tar", ".gz", ".bz2", ".7z", ".rar"),
}
DOCUMENT_NAMES, DOCUMENT_EXTENSIONS = ("license", "copying", "readme"), (".pdf", ".doc", ".docx")
#: Extensions and types of uploads.
UPLOADS = {
    "image": (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif"),
    "video": (".mp4", ".avi", ".mov", ".wmv", ".webm", ".mkv"),
    "audio": (".wav", ".mp3", ".ogg", ".flac", ".aac"),
}
UPLOAD_TYPES = {
    "image": ("image/jpeg", "image/jpg", "image/png", "image/webp", "image/bmp", "image/tiff"),
    "video": ("video/mp4", "video/avi", "video/mov", "video/wmv", "video/webm", "video/mkv"),
    "audio": ("audio/wav", "audio/mp3", "audio/mpeg", "audio/ogg", "audio/flac", "audio/aac"),
}
#: Source buckets by path markers, and generator buckets by markers in the path.
SOURCES = {"ffhq_flickrfaceshq": ("flickrfaceshq", "/ffhq"), "1_million_fake_faces_stylegan": ("1-million-fake-faces", "1m_faces"), "faceforensics": ("faceforensics",)}
GENERATORS = {"deepfakes_unspecified": "deepfake", "faceswap_unspecified": "faceswap", "face2face_unspecified": "face2face", "neuraltextures_unspecified": "neuraltextures"}


def extension(path: ColumnOrName) -> Column:
    """Lower-case suffix with its dot, or ``<none>``; a leading dot begins a name, not a suffix."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(posix(path), r"[^/](\.[^./]+)$", 1)), F.lit("")), F.lit("<none>"))


def category(path: ColumnOrName) -> Column:
    """image, video, audio, metadata, code, archive, documentation, no_extension or other."""
    suffix, chain = extension(path), None
    for name, suffixes in CATEGORIES.items():
        chain = F.when(suffix.isin(*suffixes), name) if chain is None else chain.when(suffix.isin(*suffixes), name)
    named = F.lower(F.element_at(F.split(posix(path), "/"), -1)).isin(*DOCUMENT_NAMES)
    return chain.when(named | suffix.isin(*DOCUMENT_EXTENSIONS), "documentation").when(suffix == "<none>", "no_extension").otherwise("other")


def source_bucket(path: ColumnOrName) -> Column:
    """The corpus that a path names, else the path's fourth part."""
    whole = posix(path)
    chain = F.when(F.coalesce(F.trim(whole), F.lit("")) == "", "unknown")
    for name, markers in SOURCES.items():
        chain = chain.when(_contains_any(F.lower(whole), markers), name)
    return F.coalesce(chain, F.get(F.split(whole, "/"), F.lit(3)), F.lit("unknown"))


def generator_bucket(path: ColumnOrName, label: ColumnOrName) -> Column:
    """What made an image, as far as its path tells."""
    text = F.lower(F.coalesce(col(path), F.lit("")))
    chain = F.when(col(label) == "real", "none_authentic").when(source_bucket(path) == "1_million_fake_faces_stylegan", "stylegan_1m_fake_faces")
    for name, marker in GENERATORS.items():
        chain = chain.when(text.contains(marker), name)
    return chain.when(col(label) == "fake", "unknown_generator").otherwise("none_authentic")


def safe_name(sample_id: ColumnOrName) -> Column:
    return F.replace(col(sample_id), F.lit(":"), F.lit("__"))


def name_to_sample_id(stem: ColumnOrName) -> Column:
    """Undo safe_name: the first two separators become colons, later ones stay part of the id."""
    parts = F.split(col(stem), "__")
    tail = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "__")
    return F.when(F.size(parts) >= 3, F.concat_ws(":", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), tail)).otherwise(F.replace(col(stem), F.lit("__"), F.lit(":")))


def relative_to(path: ColumnOrName, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(posix(path).startswith(prefix), F.substr(posix(path), F.lit(len(prefix) + 1))).otherwise(posix(path))


def file_error(size: ColumnOrName, path: ColumnOrName, mime: ColumnOrName, modality: ColumnOrName, max_bytes: dict[str, int] | None = None) -> Column:
    """The first rule that an upload breaks: present, size, extension, type; null if none."""
    limits = {"image": 10 << 20, "audio": 50 << 20, "video": 200 << 20} | (max_bytes or {})
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), col(modality)), F.lit(100 << 20))
    return F.coalesce(
        F.when(col(size).isNull(), "missing_file"),
        F.when(col(size) == 0, "empty_file"),
        F.when(col(size) > most, "file_too_large"),
        F.when(~_listed(modality, extension(path), UPLOADS), "bad_extension"),
        F.when(~_listed(modality, col(mime), UPLOAD_TYPES), "bad_mime_type"),
    )


def _listed(modality: ColumnOrName, value: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    found = F.lit(False)
    for name, values in lists.items():
        found = found | ((col(modality) == name) & value.isin(*values))
    return F.coalesce(found, F.lit(False))


def expired(modified: ColumnOrName, now: ColumnOrName, hours: float) -> Column:
    return F.unix_timestamp(col(now)) - F.unix_timestamp(col(modified)) > F.lit(hours * 3600)


# --- model outputs -----------------------------------------------------------------------


def sigmoid(x: ColumnOrName) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def scaled_probability(logit: ColumnOrName, temperature: ColumnOrName | float) -> Column:
    t = F.lit(temperature) if isinstance(temperature, float) else col(temperature)
    return sigmoid(col(logit) / F.greatest(t, F.lit(1e-4)))


def prediction(logit: ColumnOrName, temperature: float = 1.0, threshold: float = 0.5) -> Column:
    """Label, probability, calibrated probability and confidence, rounded to 6 places."""
    raw, p = sigmoid(logit), scaled_probability(logit, temperature)
    fake = p >= threshold
    return F.struct(F.when(fake, "fake").otherwise("real").alias("label"), F.bround(raw, 6).alias("raw_probability"), F.bround(p, 6).alias("probability"), F.bround(F.when(fake, p).otherwise(1 - p), 6).alias("confidence"))


def imbalanced(n_real: ColumnOrName, n_fake: ColumnOrName, threshold: float = 0.05) -> Column:
    """Whether training needs class weights: the smaller share is over ``threshold`` off one half."""
    n = col(n_real) + col(n_fake)
    return F.coalesce(F.abs(0.5 - F.try_divide(F.least(col(n_real), col(n_fake)), n)) > threshold, F.lit(False))


def csv_row(columns: list[str]) -> list[Column]:
    """Columns as the text that a CSV row holds: null is empty."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def split_metrics(result: ColumnOrName) -> Column:
    """One split's metrics from a JSON result: missing numbers stay null, missing support is 0
    and a missing matrix is all zeros; the note falls back to that of the ROC-AUC."""
    r = F.from_json(col(result), "accuracy double, f1 double, roc_auc double, balanced_accuracy double, precision double, recall double, support bigint, confusion_matrix array<array<bigint>>, note string, roc_auc_note string")
    zeros = F.array(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))
    kept = [r[c].alias(c) for c in ("accuracy", "f1", "roc_auc", "balanced_accuracy", "precision", "recall")]
    return F.struct(*kept, F.coalesce(r["support"], F.lit(0)).cast("long").alias("support"), F.coalesce(r["confusion_matrix"], zeros).alias("confusion_matrix"), F.coalesce(r["note"], r["roc_auc_note"], F.lit("")).alias("note"))


def response(label: ColumnOrName, probability: ColumnOrName, latency_ms: ColumnOrName, modality: str, version: str = "unknown", temperature: float | None = None) -> Column:
    """A prediction as the service answers it."""
    p = F.bround(col(probability), 6)
    return F.struct(col(label).alias("prediction"), p.alias("probability"), p.alias("calibrated_probability"), F.lit(modality).alias("modality"), F.lit(version).alias("model_version"), F.bround(col(latency_ms), 2).alias("inference_latency_ms"), F.lit(temperature is not None).alias("calibrated"), F.bround(F.lit(temperature).cast("double"), 6).alias("temperature"))


def text_bar(value: ColumnOrName, width: int = 20) -> Column:
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.round(F.coalesce(col(value), F.lit(0.0)) * width).cast("int")))
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), width - full))


def feature_errors(payload: ColumnOrName, required: list[str], modalities: tuple[str, ...] = ("image", "audio", "video")) -> Column:
    """What is wrong with a JSON object of features: missing, unknown or non-numeric keys and
    an unknown modality; an empty array if nothing."""
    m = F.from_json(col(payload), "map<string,string>")
    keys, wanted = F.coalesce(F.map_keys(m), F.array().cast("array<string>")), F.array(*map(F.lit, required))
    bad = F.filter(F.array_intersect(wanted, keys), lambda k: F.element_at(m, k).try_cast("double").isNull())
    tag = F.element_at(m, "modality_tag")
    return F.concat(
        F.transform(F.array_except(wanted, keys), lambda k: F.concat(F.lit("missing:"), k)),
        F.transform(F.array_except(keys, F.concat(wanted, F.array(F.lit("modality_tag")))), lambda k: F.concat(F.lit("unknown:"), k)),
        F.transform(bad, lambda k: F.concat(F.lit("not_numeric:"), k)),
        F.when(F.coalesce(tag.isin(*modalities), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("bad_modality"))),
    )
