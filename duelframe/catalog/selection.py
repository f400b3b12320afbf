"""Queries over shards, samples, splits and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import K
from duelframe.operators import candidates, slicing

MIXER = {"documents": 0.29, "pages": 0.57, "benchmark": 1.0}
LANG_MIXER = {"en": 0.29, "fr": 0.57, "de": 1.0, "es": 0.85}


@query(
    "shard_slice",
    "SELECT page_id AS prompt_idx, url AS prompt FROM pages WHERE page_id >= 30 AND page_id < 60",
)
def shard_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.shard_slice(views.prompts(spark, sf_dir), frac_len=30, data_frac=1)


@query("shard_ids", "SELECT page_id AS prompt_idx, page_id // 30 AS shard_id FROM pages")
def shard_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.shard_ids(views.prompts(spark, sf_dir), 30).select("prompt_idx", "shard_id")


@query(
    "shard_plan",
    """SELECT page_id // 50 AS shard_id, count(*) AS n_rows, page_id // 50 < 4 AS covered
    FROM pages GROUP BY page_id // 50""",
)
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.shard_plan(views.prompts(spark, sf_dir), n_shards=4, round_rows=200)


@query("head_n", "SELECT page_id AS prompt_idx, url AS prompt FROM pages WHERE page_id < 8")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.head_n(views.prompts(spark, sf_dir), 8)


def _mix_sql(mixer: dict[str, float], tables: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {place} AS source_pos, '{name}' AS source, {tables[name][0]} AS row_idx,
        {tables[name][1]} AS prompt FROM {name}
        WHERE {tables[name][0]} < floor(CAST({frac} AS DOUBLE) * (SELECT count(*) FROM {name}))"""
        for place, (name, frac) in enumerate(mixer.items())
    )


_MIX_TABLES = {"documents": ("doc_id", "text"), "pages": ("page_id", "html"), "benchmark": ("item_id", "text")}


@query("mix_datasets", _mix_sql(MIXER, _MIX_TABLES))
def mix_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {
        name: {
            "train": views.load(spark, sf_dir, name).select(
                F.col(index).alias("row_idx"), F.col(text).alias("prompt")
            )
        }
        for name, (index, text) in _MIX_TABLES.items()
    }
    return slicing.mix_datasets(frames, MIXER)["train"]


_LANG_PLACE = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(LANG_MIXER))
_LANG_FRAC = " ".join(f"WHEN '{name}' THEN {frac}" for name, frac in LANG_MIXER.items())


@query(
    "mix_by_source",
    f"""SELECT doc_id, lang, CASE lang {_LANG_PLACE} END AS source_pos, source_row FROM (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS source_row,
             count(*) OVER (PARTITION BY lang) AS n FROM documents)
    WHERE source_row < floor(CAST(CASE lang {_LANG_FRAC} END AS DOUBLE) * n)""",
)
def mix_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = views.load(spark, sf_dir, "documents").select("doc_id", "lang")
    return slicing.mix_by_source(table, "lang", LANG_MIXER, "doc_id", position="source_row")


@query(
    "validate_fractions",
    """SELECT lang, count(*) AS n_rows, CAST(floor(CAST(0.29 AS DOUBLE) * count(*)) AS BIGINT) AS kept_29,
      CAST(floor(CAST(0.57 AS DOUBLE) * count(*)) AS BIGINT) AS kept_57 FROM documents GROUP BY lang""",
)
def validate_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    slicing.validate_fractions(LANG_MIXER)
    counts = slicing.dataset_counts(views.load(spark, sf_dir, "documents"), "lang")
    return counts.withColumns(
        {f"kept_{round(frac * 100)}": slicing.kept_rows(frac, F.col("n_rows")) for frac in (0.29, 0.57)}
    )


@query(
    "sample_n",
    """SELECT event_id, event_type, value FROM events
    ORDER BY md5('42:' || event_id), event_id LIMIT 500""",
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = views.load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return slicing.sample_n(table, slicing.TEST_ROWS, ["event_id"])


@query(
    "seeded_shuffle",
    """SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place
    FROM documents""",
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = views.load(spark, sf_dir, "documents").select("doc_id")
    return slicing.seeded_shuffle(table, ["doc_id"], position="place")


@query(
    "random_rows",
    """SELECT conv_id, turn, role, text AS content FROM conversations
    ORDER BY md5('7:' || conv_id || ':' || turn), conv_id, turn LIMIT 3""",
)
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.random_rows(views.turns(spark, sf_dir), 3, ["conv_id", "turn"], seed=7)


@query(
    "route_split",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def route_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 10 == 0, "test_").otherwise("train_")
    named = views.load(spark, sf_dir, "documents").select(
        "doc_id", F.concat(kind, F.col("source")).alias("name")
    )
    return named.select("doc_id", slicing.route_split(F.col("name")).alias("split"))


@query(
    "coverage_check",
    """WITH have AS (
      SELECT doc_id // 5 AS prompt_idx, count(*) AS n FROM labels GROUP BY doc_id // 5)
    SELECT page_id AS prompt_idx, coalesce(n, 0) AS n_candidates,
      CASE WHEN n IS NULL THEN 'no candidates' ELSE 'wrong count' END AS problem
    FROM pages LEFT JOIN have ON page_id = prompt_idx WHERE n IS NULL OR n <> 5
    UNION ALL
    SELECT prompt_idx, n, 'no prompt' FROM have WHERE prompt_idx NOT IN (SELECT page_id FROM pages)""",
)
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents as scores: only some candidates of a prompt have one."""
    scored = views.load(spark, sf_dir, "labels").select(
        F.call_function("div", F.col("doc_id"), F.lit(K)).alias("prompt_idx"),
        (F.col("doc_id") % K).cast("int").alias("sample_id"),
        F.col("quality").cast("double").alias("score"),
    )
    return candidates.coverage_check(views.prompts(spark, sf_dir), scored, K)


@query(
    "prompt_schedule",
    """SELECT page_id AS prompt_idx, CAST(page_id + 1 AS INTEGER) AS iteration,
      CAST(page_id % 3 + 1 AS INTEGER) AS prompt_set, CAST(page_id % 3 + 1 AS INTEGER) AS reference_set
    FROM pages""",
)
def prompt_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one round, its output named by the round number."""
    rounds = views.prompts(spark, sf_dir).select(
        "prompt_idx", F.concat(F.lit("checkpoints/run-Iter"), F.col("prompt_idx") + 1).alias("output_dir")
    )
    iteration = slicing.iteration_of(F.col("output_dir"))
    return rounds.select(
        "prompt_idx",
        iteration.alias("iteration"),
        slicing.prompt_schedule(iteration).alias("prompt_set"),
        slicing.reference_set(F.col("output_dir")).alias("reference_set"),
    )


@query("fixed_prompt_schedule", "SELECT page_id AS prompt_idx, 1 AS prompt_set FROM pages")
def fixed_prompt_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prompts(spark, sf_dir).select(
        "prompt_idx", slicing.fixed_prompt_schedule(F.col("prompt_idx") + 1).alias("prompt_set")
    )


@query(
    "dataset_counts",
    """SELECT lang, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows
    FROM documents GROUP BY ALL""",
)
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = views.load(spark, sf_dir, "documents").select(
        "lang", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split")
    )
    return slicing.dataset_counts(table, "lang", "split")


@query(
    "batch_assign",
    "SELECT doc_id // 64 AS batch_id, count(*) AS n_rows, min(doc_id) AS first_doc FROM documents GROUP BY doc_id // 64",
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows per device, four accumulation steps, four processes."""
    table = views.load(spark, sf_dir, "documents").select(
        "doc_id", slicing.batch_assign(F.col("doc_id"), 4, 4, 4).alias("batch_id")
    )
    return table.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc")
    )
