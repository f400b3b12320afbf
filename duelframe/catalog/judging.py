"""Queries over scorers, judges, win rates, diversity and the metric stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import CAND, K, candidates, r6, s6
from duelframe.operators import diversity, judges
from duelframe.operators.candidates import join_prompt_responses
from duelframe.streaming import metrics

WORKERS = 8
REPORT_EVERY = 1000
ITERATIONS = 6


def _length_scorer():
    return lambda batch: [math.log(1 + len(text)) for text in batch["response"]]


@query(
    "score_candidates",
    f"""WITH {CAND} SELECT prompt_idx, sample_id, {s6("ln(1 + length(response))")} AS score
    FROM cand JOIN pages ON page_id = prompt_idx""",
)
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = join_prompt_responses(views.prompts(spark, sf_dir), views.responses(spark, sf_dir))
    return judges.score_candidates(rows, _length_scorer).withColumn("score", r6("score"))


@query(
    "rank_to_prob",
    """SELECT doc_id, 1 - quality AS rank, CASE WHEN 1 - quality = 0 THEN 1.0::DOUBLE
      WHEN 1 - quality = 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS prob FROM labels""",
)
def rank_to_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = views.load(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("rank"))
    return ranked.withColumn("prob", judges.rank_to_prob(F.col("rank")))


def _length_judge():
    def judge(batch):
        first, second = batch["first"].str.len(), batch["second"].str.len()
        return [0 if a > b else 1 if a < b else -1 for a, b in zip(first, second)]

    return judge


@query(
    "regroup_judgements",
    f"""WITH {CAND}, req AS (
      SELECT a.prompt_idx % {WORKERS} AS worker_id, a.prompt_idx, a.sample_id AS i, b.sample_id AS j,
        length(a.response) AS first, length(b.response) AS second
      FROM cand a JOIN cand b ON a.prompt_idx = b.prompt_idx JOIN pages ON page_id = a.prompt_idx
      WHERE a.sample_id < b.sample_id)
    SELECT worker_id, prompt_idx, i, j, CASE WHEN first > second THEN 0 WHEN first < second THEN 1 ELSE -1 END AS rank,
      CASE WHEN first > second THEN 1.0::DOUBLE WHEN first < second THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS prob FROM req""",
)
def regroup_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two candidates of a prompt, in one order: k is fixed, so a row makes k(k-1)/2."""
    return judges.regroup_judgements(_requests(spark, sf_dir), _length_judge, REQUEST_KEYS)


REQUEST_KEYS = ("worker_id", "prompt_idx", "i", "j")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(K) for j in range(i + 1, K)])
    known = candidates(spark, sf_dir).join(views.prompts(spark, sf_dir), "prompt_idx")
    requests = known.select("prompt_idx", "prompt", "candidates", F.inline(two)).select(
        (F.col("prompt_idx") % WORKERS).alias("worker_id"),
        "prompt_idx",
        "i",
        "j",
        "prompt",
        F.get("candidates", F.col("i")).alias("first"),
        F.get("candidates", F.col("j")).alias("second"),
    )
    return requests.filter(F.col("first").isNotNull() & F.col("second").isNotNull())


JUDGE_SEED = 42
# Characters the judges below give to the response they see first.
FIRST_BONUS = 40

_SHOWN = f"""{CAND}, req AS (
      SELECT a.prompt_idx % {WORKERS} AS worker_id, a.prompt_idx, a.sample_id AS i, b.sample_id AS j,
        length(a.response) AS n, length(b.response) AS m,
        substr(md5(concat_ws(':', '{JUDGE_SEED}', a.prompt_idx % {WORKERS}, a.prompt_idx, a.sample_id, b.sample_id)), 1, 1) < '8' AS swapped
      FROM cand a JOIN cand b ON a.prompt_idx = b.prompt_idx JOIN pages ON page_id = a.prompt_idx
      WHERE a.sample_id < b.sample_id),
    shown AS (
      SELECT *, CASE WHEN swapped THEN m ELSE n END + {FIRST_BONUS} AS first, CASE WHEN swapped THEN n ELSE m END AS second FROM req)"""


def _partial_judge():
    def judge(batch):
        first, second = batch["first"].str.len() + FIRST_BONUS, batch["second"].str.len()
        return [0 if a > b else 1 if a < b else -1 for a, b in zip(first, second)]

    return judge


def _soft_judge():
    def judge(batch):
        first, second = batch["first"].str.len() + FIRST_BONUS, batch["second"].str.len()
        return first / (first + second)

    return judge


@query(
    "judge_in_shuffled_order",
    f"""WITH {_SHOWN}, judged AS (
      SELECT *, CASE WHEN first > second THEN 0 WHEN first < second THEN 1 ELSE -1 END AS seen FROM shown),
    ranked AS (SELECT *, CASE WHEN swapped AND seen >= 0 THEN 1 - seen ELSE seen END AS rank FROM judged)
    SELECT worker_id, prompt_idx, i, j, swapped, rank,
      CASE WHEN rank = 0 THEN 1.0::DOUBLE WHEN rank = 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS prob FROM ranked""",
)
def judge_in_shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that favors the response it sees first, asked in shuffled order."""
    return judges.regroup_judgements(_requests(spark, sf_dir), _partial_judge, REQUEST_KEYS, shuffle_seed=JUDGE_SEED)


@query(
    "judge_with_scores",
    f"""WITH {_SHOWN}
    SELECT worker_id, prompt_idx, i, j, swapped,
      {s6("CASE WHEN swapped THEN 1 - first / (first + second) ELSE first / (first + second) END")} AS prob FROM shown""",
)
def judge_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a probability for each verdict."""
    found = judges.regroup_judgements(_requests(spark, sf_dir), _soft_judge, REQUEST_KEYS, shuffle_seed=JUDGE_SEED, return_scores=True)
    return found.withColumn("prob", r6("prob"))


JUDGED = """judged AS (
  SELECT d.doc_id, lang, source, length(text) AS output_length,
    CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 ELSE 0.5 END AS prob
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.judgements(spark, sf_dir).withColumn("prob", judges.rank_to_prob(F.col("rank")))


@query(
    "win_rate",
    f"""WITH {JUDGED} SELECT source AS generator, count(*) AS n_judged, {s6("avg(prob)")} AS win_rate,
      {s6("stddev_samp(prob)")} AS win_stddev, {s6("avg(output_length)")} AS mean_length
    FROM judged GROUP BY source""",
)
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = judges.win_rate(_judged(spark, sf_dir).withColumnRenamed("source", "generator"))
    return rates.select(
        "generator", "n_judged", *[r6(c).alias(c) for c in ("win_rate", "win_stddev", "mean_length")]
    )


@query(
    "result_series",
    f"""WITH {JUDGED}, points AS (
      SELECT lang AS run, CAST(doc_id % {ITERATIONS} + 1 AS INTEGER) AS iteration, avg(prob) * 100 AS rate,
        100.0 * count(*) FILTER (prob > 0.5) / count(*) AS win_share, avg(output_length) AS mean_length
      FROM judged GROUP BY lang, doc_id % {ITERATIONS})
    SELECT run, iteration, {s6("rate")} AS rate, {s6("win_share")} AS win_share, {s6("mean_length")} AS mean_length,
      {s6("rate - lag(rate) OVER (PARTITION BY run ORDER BY iteration)")} AS rate_change,
      first_value(iteration) OVER (PARTITION BY run ORDER BY round(rate, 6) DESC, iteration) AS best_iteration
    FROM points""",
)
def result_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir).select(
        F.col("lang").alias("run"),
        (F.col("doc_id") % ITERATIONS + 1).cast("int").alias("iteration"),
        "prob",
        "output_length",
    )
    return judges.result_series(judged).select(
        "run",
        "iteration",
        *[r6(c).alias(c) for c in ("rate", "win_share", "mean_length", "rate_change")],
        "best_iteration",
    )


@query(
    "generation_summary",
    f"""SELECT event_type AS generator, count(*) AS n_outputs, {s6("avg(length(props))")} AS mean_length,
      {s6("sum(value)")} AS total_seconds, {s6("avg(value)")} AS seconds_per_item FROM events GROUP BY event_type""",
)
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generated outputs, their value as the seconds taken."""
    log = views.load(spark, sf_dir, "events").select(
        F.col("event_type").alias("generator"), F.length("props").alias("length"), F.col("value").alias("seconds")
    )
    return judges.generation_summary(log).select(
        "generator", "n_outputs", *[r6(c).alias(c) for c in ("mean_length", "total_seconds", "seconds_per_item")]
    )


@query(
    "generation_progress",
    f"""WITH b AS (
      SELECT event_id // {REPORT_EVERY} AS report, sum(value) AS s, count(*) AS n FROM events GROUP BY 1),
    r AS (
      SELECT report, sum(n) OVER w AS n_done, sum(s) OVER w AS elapsed FROM b
      WINDOW w AS (ORDER BY report ROWS UNBOUNDED PRECEDING))
    SELECT report, CAST(n_done AS BIGINT) AS n_done, {s6("elapsed")} AS elapsed,
      {s6("elapsed / n_done")} AS seconds_per_item,
      {s6("elapsed / n_done * ((SELECT count(*) FROM events) - n_done)")} AS eta FROM r""",
)
def generation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_idx"), F.col("value").alias("seconds")
    )
    return judges.generation_progress(log, REPORT_EVERY).select(
        "report", "n_done", *[r6(c).alias(c) for c in ("elapsed", "seconds_per_item", "eta")]
    )


_BLEU = f"""{CAND},
w AS (
  SELECT prompt_idx, sample_id,
    list_filter(regexp_split_to_array(response, '\\s+'), lambda x: x <> '') AS words FROM cand),
runs AS (
  SELECT prompt_idx, sample_id, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4
  FROM (SELECT prompt_idx, sample_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w)
  WINDOW s AS (PARTITION BY prompt_idx, sample_id ORDER BY i)),
grams AS (
  SELECT prompt_idx, sample_id, 1 AS n, w1 AS gram FROM runs
  UNION ALL SELECT prompt_idx, sample_id, 2, w1 || chr(1) || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT prompt_idx, sample_id, 3, w1 || chr(1) || w2 || chr(1) || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT prompt_idx, sample_id, 4, w1 || chr(1) || w2 || chr(1) || w3 || chr(1) || w4 FROM runs WHERE w4 IS NOT NULL),
cnt AS (SELECT prompt_idx, sample_id, n, gram, count(*) AS c FROM grams GROUP BY ALL),
oth AS (
  SELECT a.prompt_idx, a.sample_id, a.n, a.gram, a.c, max(b.c) AS m
  FROM cnt a LEFT JOIN cnt b
    ON a.prompt_idx = b.prompt_idx AND a.n = b.n AND a.gram = b.gram AND a.sample_id <> b.sample_id
  GROUP BY ALL),
clip AS (
  SELECT prompt_idx, sample_id, n, sum(least(c, coalesce(m, 0))) AS clip FROM oth GROUP BY ALL),
prec AS (
  SELECT c.prompt_idx, c.sample_id, sum(ln(greatest(clip, 1) / greatest(len(words) - n + 1, 1))) AS logs,
    count(*) FILTER (clip > 0) AS hits
  FROM clip c JOIN w ON w.prompt_idx = c.prompt_idx AND w.sample_id = c.sample_id GROUP BY ALL),
ref AS (
  SELECT a.prompt_idx, a.sample_id, len(a.words) AS own, len(b.words) AS ref
  FROM w a JOIN w b ON a.prompt_idx = b.prompt_idx AND a.sample_id <> b.sample_id
  QUALIFY row_number() OVER (PARTITION BY a.prompt_idx, a.sample_id
    ORDER BY abs(len(a.words) - len(b.words)), len(b.words)) = 1),
bleu AS (
  SELECT r.prompt_idx, r.sample_id,
    CASE WHEN hits = 4 THEN exp(CASE WHEN own > ref THEN 0 ELSE 1 - ref / own END + logs / 4) ELSE 0.0 END AS bleu
  FROM ref r LEFT JOIN prec p ON p.prompt_idx = r.prompt_idx AND p.sample_id = r.sample_id)"""


@query("self_bleu", f"WITH {_BLEU} SELECT prompt_idx, sample_id, {s6('bleu')} AS bleu FROM bleu")
def self_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.self_bleu(views.responses(spark, sf_dir), K).withColumn("bleu", r6("bleu"))


@query(
    "self_bleu_mean",
    f"WITH {_BLEU} SELECT prompt_idx, {s6('avg(bleu)')} AS self_bleu FROM bleu GROUP BY prompt_idx",
)
def self_bleu_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = diversity.self_bleu(views.responses(spark, sf_dir), K)
    return diversity.mean_self_bleu(scored).withColumn("self_bleu", r6("self_bleu"))


@query(
    "metric_stream",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS key, {s6("avg(value)")} AS value,
      count(*) AS n_values FROM events GROUP BY date_trunc('day', ts), event_type
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = views.load(spark, sf_dir, "events")
    stream = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parquet*")
    log = stream.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value"
    )
    closed = metrics.run_to_table(metrics.windowed_means(log, "1 day", "1 hour"))
    return closed.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "key", r6("value").alias("value"), "n_values"
    )
