"""Model catalog normalisation and cohort selection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

# --- fixed values -----------------------------------------------------------
# Family key: trailing date snapshots, version tokens, parameter-size tokens
# and trailing size-tier words are removed from the slug's model name.
DATE_SUFFIX = r"-(20\d{6}|20\d{2}-\d{2}-\d{2}|\d{2}-\d{2}|\d{4})$"
VERSION_TOKEN = r"[-]?v?\d+(\.\d+)*(-exp|-instruct)?(?=($|-))"
PARAM_SIZE_TOKEN = r"-a?\d+(?:\.\d+)?x?\d*b(?:-a\d+b)?\b"
SIZE_TIER_TOKENS = [
    "mini", "nano", "flash", "lite", "air", "turbo", "plus", "max", "pro",
    "micro", "small", "medium", "large", "xl", "xxl", "edge", "ultra", "super",
    "base", "fast", "chat", "instruct", "it", "hf", "opus", "sonnet", "haiku",
]
# Providers trusted for discovery.
DISCOVERY_PROVIDERS = [
    "openai", "anthropic", "google", "meta-llama", "mistralai", "deepseek",
    "x-ai", "qwen", "alibaba", "cohere", "amazon", "moonshotai", "baidu",
    "allenai", "microsoft", "liquid", "ibm-granite", "nvidia", "rekaai",
    "stepfun", "tencent", "z-ai", "bytedance-seed", "ai21", "nousresearch",
    "perplexity", "arcee-ai", "deepcogito", "prime-intellect", "writer",
    "upstage",
]
# Substrings that exclude a slug from discovery.
DISCOVERY_SKIP_TAGS = [
    "-preview", "-beta", "-experimental", ":free", "-latest",
    "-vision", "-vl", "-image", "-audio", "-tts", "-stt", "-embed",
    "-asr", "-transcribe", "-search", "rerank", "-ocr", "-edit",
    "-voice", "voice", "-build",
    "coder", "codex", "devstral", "codestral",
    "-thinking", "-reasoning", "-think", "-deep-research", "deepresearch",
    "-multi-agent", "safeguard",
]
# Product names (lower-cased substrings) that are not text models.
DISCOVERY_SKIP_PRODUCTS = [
    "whisper", "voxtral", "chirp", "kokoro", "orpheus", "zonos", "csm-",
    "parakeet", "canary",
    "sora", "veo-", "wan-", "seedance", "seedream", "flux.", "imagine",
    "kling", "hailuo", "riverflow", "recraft", "morph-",
    "bge-", "gte-", "e5-", "multilingual-e5",
]
# Bare-"v" vision variants such as "-4.5v" or "5v-turbo".
VISION_SUFFIX = r"\d+(\.\d+)?v(-|$)"
# Name clean-up of catalog short names.
NAME_MARKERS = [" (free)", " (self-moderated)"]
TRAILING_PARENS = r"\s*\([^)]*\)\s*$"
# ---------------------------------------------------------------------------


def _escape(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\-/" else ch for ch in s)


def family_key(slug: Column) -> Column:
    """Vendor plus base product name of a slug."""
    has_vendor = F.instr(slug, "/") > 0
    vendor = F.when(has_vendor, F.substring_index(slug, "/", 1)).otherwise(slug)
    name = F.when(has_vendor, F.regexp_replace(slug, r"^[^/]*/", "")).otherwise(F.lit(""))
    # Repeated trailing date snapshots are stripped as one anchored run.
    no_dates = F.regexp_replace(name, r"(" + DATE_SUFFIX[:-1] + r")+$", "")
    no_version = F.regexp_replace(no_dates, VERSION_TOKEN, "")
    stripped = F.regexp_replace(no_version, PARAM_SIZE_TOKEN, "")
    parts = F.regexp_replace(F.regexp_replace(stripped, "-+", "-"), "^-|-$", "")
    tiers = "|".join(SIZE_TIER_TOKENS)
    # Trailing tier words go, but never the first part.
    base = F.regexp_replace(parts, rf"(-({tiers}))+$", "")
    return F.when(base != "", F.concat(vendor, F.lit("/"), base)) \
        .otherwise(F.concat(vendor, F.lit("/"), stripped))


def normalise_catalog(catalog: DataFrame) -> DataFrame:
    """Typed catalog rows.

    ``price_text`` becomes ``cost`` per 1M tokens (NULL when unparsable,
    C11); free = price 0; provider is the part of ``name`` before ": " and
    the short name the part after it, cleaned of markers and a trailing
    parenthesis (C10); creation date is the repository's (column
    ``repository_created``) where there is one, else the catalog's (C12).
    """
    price = F.col("price_text").try_cast("double")
    has_sep = F.instr(F.col("name"), ": ") > 0
    short = F.when(has_sep, F.expr("substr(name, instr(name, ': ') + 2)")).otherwise(F.col("name"))
    clean = short
    for marker in NAME_MARKERS:
        clean = F.replace(clean, F.lit(marker), F.lit(""))
    clean = F.regexp_replace(clean, TRAILING_PARENS, "")
    return catalog.select(
        "slug",
        F.substring_index(F.col("name"), ": ", 1).alias("provider_name"),
        clean.alias("name"),
        F.coalesce(price == 0, F.lit(False)).alias("is_free"),
        F.bround(price * 1_000_000, 2).alias("cost"),
        F.col("trains_on_prompts").alias("train_on_prompts"),
        creation_date(catalog).alias("creation_date"))


def creation_date(catalog: DataFrame) -> Column:
    """Repository date, else catalog date; either may be text that isn't a date."""
    dates = [F.col(c).try_cast("date") for c in ("repository_created", "created") if c in catalog.columns]
    return F.coalesce(*dates)


#: A catalog entry as the service sends it.
CATALOG_ENTRY = ("id string, canonical_slug string, name string, created bigint, hugging_face_id string, "
                 "pricing struct<completion: string>")


def normalise_nested(raw: DataFrame, entry: str = "entry") -> DataFrame:
    """Catalog entries from JSON text (A8): entries without an id go; the name
    falls back to the id, the permanent slug to the id; unix seconds become a
    timestamp; an unparsable price is not free."""
    e = F.from_json(F.col(entry), CATALOG_ENTRY)
    some = lambda c: F.nullif(c, F.lit(""))
    m = raw.select(e.alias("m")).where(some(F.col("m.id")).isNotNull()).select("m.*")
    name = F.coalesce(some(F.col("name")), F.col("id"))
    short = F.when(F.instr(name, ": ") > 0, F.substring(name, F.instr(name, ": ") + 2, F.length(name))).otherwise(name)
    price = F.col("pricing.completion")
    return m.select(F.col("id").alias("slug"), F.coalesce(some(F.col("canonical_slug")), F.col("id")).alias("permaslug"),
                    short.alias("short_name"), name.alias("name"), F.timestamp_seconds("created").alias("created_at"),
                    some(F.col("hugging_face_id")).alias("hf_slug"),
                    F.coalesce(price.try_cast("double") == 0, F.lit(False)).alias("is_free"), price.alias("completion"))


def lookup_by_slug(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """The paid catalog entry of each wanted id, by slug or permanent slug
    (C1): two equi-joins, and of several matches the smallest slug."""
    paid = catalog.where(~F.col("is_free"))
    ids = wanted.select("id").distinct()
    rest = [F.col(c) for c in catalog.columns]
    by = [ids.join(paid, F.col("id") == F.col(c)).select("id", F.struct(*rest).alias("m")) for c in ("slug", "permaslug")]
    return by[0].unionByName(by[1]).groupBy("id").agg(F.min("m").alias("m")).select("id", "m.*")


def lookup_rows(norm: DataFrame) -> DataFrame:
    """Catalog rows usable for evaluation: paid, no training; first row per
    slug (C1).  "First" is the smallest (name, creation date)."""
    ok = norm.where(~F.col("is_free") & (F.col("train_on_prompts") == F.lit(False)))
    cols = [c for c in ok.columns if c != "slug"]
    first = F.min(F.struct(*[F.col(c) for c in ["name", "creation_date"]
                             + [c for c in cols if c not in ("name", "creation_date")]]))
    return (ok.groupBy("slug").agg(first.alias("_r"))
            .select("slug", *[F.col(f"_r.{c}").alias(c) for c in cols]))


def license_text(raw: Column) -> Column:
    """Repository license as display text (C13): '-' becomes a space and
    'mit' is upper-cased before title-casing, so 'mit' ends up as 'Mit'.
    A letter after anything but a letter starts a word ('gemma2b': 'Gemma2B')."""
    c = F.replace(F.replace(raw, F.lit("-"), F.lit(" ")), F.lit("mit"), F.lit("MIT"))
    words = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(words, F.initcap), "")


def cost_capped(models: DataFrame, cap: float = K.COST_CAP_PER_1M) -> DataFrame:
    """Models within the cost cap; NULL cost is dropped too (C14)."""
    return models.where(F.col("cost") <= cap)


def dropped_by_cap(models: DataFrame, curated: DataFrame, cap: float = K.COST_CAP_PER_1M) -> DataFrame:
    """Curated models the cap removes (report of C14)."""
    return models.where(F.col("cost") > cap).join(curated.select("slug"), "slug", "left_semi")


def discovery_candidates(norm: DataFrame, curated: DataFrame, blocked: DataFrame,
                         auto_blocked: DataFrame, as_of: dt.date,
                         providers: Sequence[str] = DISCOVERY_PROVIDERS,
                         window_days: int = K.DISCOVERY_WINDOW_DAYS,
                         cap: float = K.COST_CAP_PER_1M) -> DataFrame:
    """Catalog rows that pass every discovery rule.

    ``curated``, ``blocked`` and ``auto_blocked`` are one-column (``slug``)
    tables.  Rules: provider allow-list, skip tags and products, bare-v
    vision suffix, alias prefix '~', paid, no training, priced within the
    cap, created inside the window, newer than the newest curated model of
    its family, family and slug not blocked.
    """
    slug = F.col("slug")
    lower = F.lower(slug)
    provider = F.when(F.instr(slug, "/") > 0, F.substring_index(slug, "/", 1)).otherwise(F.lit(""))
    skip_tags = "|".join(_escape(t) for t in DISCOVERY_SKIP_TAGS)
    skip_products = "|".join(_escape(p) for p in DISCOVERY_SKIP_PRODUCTS)
    cutoff = F.date_sub(F.lit(as_of), window_days)
    base = (norm.withColumn("family", family_key(slug))
            .where(provider.isin(list(providers)) & ~slug.startswith("~")
                   & ~slug.rlike(skip_tags) & ~lower.rlike(skip_products)
                   & ~lower.rlike(VISION_SUFFIX)
                   & ~F.col("is_free") & (F.col("train_on_prompts") == F.lit(False))
                   & F.col("cost").isNotNull() & (F.col("cost") <= cap)
                   & F.col("creation_date").isNotNull() & (F.col("creation_date") >= cutoff)))
    blocked_all = blocked.select("slug").unionByName(auto_blocked.select("slug"))
    base = base.join(blocked_all, "slug", "left_anti")
    # Newest curated release per family.
    cur = (norm.join(curated.select("slug"), "slug", "left_semi")
           .where(F.col("creation_date").isNotNull())
           .groupBy(family_key(F.col("slug")).alias("family"))
           .agg(F.max("creation_date").alias("curated_date")))
    # Families of manually blocked slugs.
    blocked_fam = blocked.select(family_key(F.col("slug")).alias("family")).distinct()
    return (base.join(cur, "family", "left")
            .where(F.col("curated_date").isNull() | (F.col("creation_date") > F.col("curated_date")))
            .join(blocked_fam, "family", "left_anti")
            .select("slug", "family", "cost", "creation_date"))


def flagship_per_family(candidates: DataFrame) -> DataFrame:
    """One slug per family: highest cost, then newest, then smallest slug.

    An aggregate (``min`` of a struct key), so a large family is combined
    map-side instead of being sorted in one window partition.
    """
    key = F.struct(-F.col("cost"), -F.datediff(F.col("creation_date"), F.lit("1970-01-01")),
                   F.col("slug"))
    return (candidates.groupBy("family").agg(F.min(key).alias("_k"))
            .select("family", F.col("_k.slug").alias("slug")))


def cohort_ids(curated: DataFrame, found: DataFrame, auto_blocked: DataFrame,
               blocked: DataFrame) -> DataFrame:
    """(curated ∪ (found − auto-blocked)) − blocked, with the curated ∩
    auto-blocked overrides flagged (C8)."""
    cur = curated.select("slug").distinct()
    auto = auto_blocked.select("slug").distinct()
    disc = found.select("slug").distinct().subtract(auto)
    ids = cur.union(disc).distinct().subtract(blocked.select("slug"))
    overrides = cur.intersect(auto).withColumn("override", F.lit(True))
    return (ids.join(overrides, "slug", "left")
            .select(F.col("slug").alias("id"),
                    F.coalesce(F.col("override"), F.lit(False)).alias("override")))


def validated_models(ids: DataFrame, lookup: DataFrame, cap: float = K.COST_CAP_PER_1M) -> DataFrame:
    """Cohort ids (with their other columns) that have a usable catalog row,
    and its metadata, capped (C9, C14)."""
    return cost_capped(lookup.withColumnRenamed("slug", "id").join(ids, "id"), cap)


def with_tasks(models: DataFrame, tasks: Sequence[str] = K.TASKS) -> DataFrame:
    """Every model gets all tasks; the translation model is appended with its
    two tasks (C15)."""
    spark = models.sparkSession
    m = models.withColumn("tasks", F.array(*[F.lit(t) for t in tasks]))
    tm = K.TRANSLATION_MODEL
    extra = spark.createDataFrame(
        [(tm["id"], tm["name"], tm["provider_name"], float(tm["cost"]), tm["train_on_prompts"],
          tm["type"], list(K.TRANSLATION_TASKS))],
        "id string, name string, provider_name string, cost double, train_on_prompts boolean, "
        "type string, tasks array<string>")
    return m.unionByName(extra, allowMissingColumns=True)


def auto_excluded(strikes: DataFrame, min_runs: int = K.HEALTH_MIN_RUNS) -> DataFrame:
    """Models with at least ``min_runs`` consecutive strikes."""
    return strikes.where(F.col("strikes") >= min_runs).select("model", "strikes")
