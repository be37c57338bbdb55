"""Readers of the file formats that curation and studies exchange: JSON lines, JSON trees, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folders import hadoop_path

POOL = "prompt_id string, category string, subcategory string, source string, license string, task string, suffix string, leaf string, seed_doc_id string, persona_id string, audience string, passage string, verifiable boolean, mcq boolean, gold string, format_spec string, constraints array<struct<type: string, value: string>>, meta string"
GENERATION = "example_id string, prompt_id string, category string, prompt_source string, teacher string, student_prompt string, response string, finish_reason string, tokens_teacher_prompt long, tokens_teacher_response long, tokens_student long, response_len_student long, word_count long, cum_logprob double, gold string, verifiable boolean, flags map<string, string>, retained boolean"
BENCHMARK = "benchmark string, split string, item_id string, text string, question string, options array<string>, answer string"
PASSAGE = "doc_id string, text string, topic string, cluster int, license string"
LOG = "step long, tokens long, loss double, lr double, grad_norm double, held_out_nll map<string, double>"


def pool(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Prompt records in key order; blank lines are skipped."""
    rows = spark.read.schema(POOL).json(path).where("prompt_id IS NOT NULL").orderBy("prompt_id")
    return rows.limit(limit) if limit else rows


def generations(spark: SparkSession, path: str, retained_only: bool = False) -> DataFrame:
    """Generation shards with the file each row came from."""
    rows = spark.read.schema(GENERATION).json(path).where("prompt_id IS NOT NULL").withColumn("shard", F.col("_metadata.file_name"))
    return rows.where("retained") if retained_only else rows


def benchmark_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with one text each: the text, or question, options and answer that are not empty."""
    rows = spark.read.schema(BENCHMARK).json(path)
    joined = F.concat_ws(" ", F.nullif("question", F.lit("")), F.array_join("options", " "), F.nullif("answer", F.lit("")))
    return rows.select(F.coalesce("benchmark", F.lit("unknown")).alias("benchmark"), F.coalesce("split", F.lit("test")).alias("split"), "item_id", F.coalesce(F.nullif("text", F.lit("")), F.regexp_replace(F.trim(joined), " +", " ")).alias("text"))


def passages(spark: SparkSession, path: str, low: int = 20, high: int = 400) -> DataFrame:
    """Passages within a band of words; the licence has a default."""
    rows = spark.read.schema(PASSAGE).json(path)
    return rows.withColumn("license", F.coalesce("license", F.lit("ODC-BY"))).where(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).between(low, high))


def loss_curves(spark: SparkSession, path: str, eval_set: str, replay: float = 0.0) -> DataFrame:
    """(run, d, loss) from append-only logs; broken lines and lines of the other shape are passed over."""
    rows = spark.read.schema(LOG).option("mode", "PERMISSIVE").json(path).withColumn("run", F.col("_metadata.file_path"))
    loss, d = F.element_at("held_out_nll", eval_set), F.col("tokens") * (1 - replay)
    return rows.select("run", d.alias("d"), loss.alias("loss")).where("d > 0 AND loss IS NOT NULL AND NOT isnan(loss) AND abs(loss) < 1e300")


def metrics_index(spark: SparkSession, path: str, metrics: dict[str, str]) -> DataFrame:
    """A wide row a run from a tree of metric files: for each task its metric, else acc_norm, else acc."""
    rows = spark.read.schema("tasks map<string, map<string, double>>, nll map<string, double>").option("multiLine", True).json(path).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/eval/[^/]+$", 1))
    at = lambda t, m: F.try_element_at(F.try_element_at("tasks", F.lit(t)), F.lit(m))
    return rows.select("run", *(F.coalesce(at(t, m), at(t, "acc_norm"), at(t, "acc")).alias(f"{t}_{m}") for t, m in metrics.items()), "nll")


def harness_results(spark: SparkSession, path: str) -> DataFrame:
    """(file, task, metric, value): `name,none` loses its filter, other filters stay, aliases go."""
    rows = spark.read.schema("results map<string, map<string, string>>").option("multiLine", True).json(path)
    long = rows.select(F.col("_metadata.file_name").alias("file"), F.explode("results").alias("task", "m")).select("file", "task", F.explode("m").alias("metric", "value")).where("metric <> 'alias'")
    return long.select("file", "task", F.regexp_replace("metric", ",none$", "").alias("metric"), F.expr("try_cast(value AS double)").alias("value"))


def newest(files: DataFrame, key: str, modified: str = "modificationTime") -> DataFrame:
    """The latest file of each key."""
    return files.groupBy(key).agg(F.max_by(F.struct(*files.columns), modified).alias("f")).select("f.*")


def harness_samples(spark: SparkSession, path: str) -> DataFrame:
    """Per item of a multiple-choice log: gold, log-likelihoods, greedy flags, lengths of the choices, and both accuracies.

    Answers are filtered ones, else raw ones, however deeply nested; choices come from argument maps or pairs. The first
    of equal maxima counts; an empty choice never wins by length.
    """
    fields = "doc_id long, target string, arguments string, resps string, filtered_resps string"
    rows = spark.read.schema(fields).json(path).where("doc_id IS NOT NULL").withColumn("r", F.coalesce("filtered_resps", "resps"))
    lls = F.transform(F.regexp_extract_all("r", F.lit(r'\[\s*"?(-?(?:[0-9][0-9.eE+-]*|inf|Infinity))"?\s*,'), 1), lambda x: F.regexp_replace(x, "^-inf$", "-Infinity").cast("double"))
    greedy = F.transform(F.regexp_extract_all("r", F.lit(r'(?i),\s*"?(true|false)"?\s*\]'), 1), lambda x: F.lower(x) == "true")
    maps = F.transform(F.map_values(F.from_json("arguments", "map<string, struct<arg_0: string, arg_1: string>>")), lambda x: x["arg_1"])
    pairs = F.transform(F.from_json("arguments", "array<array<string>>"), lambda x: F.element_at(x, -1))
    choices = F.transform(F.when(F.col("arguments").startswith("{"), maps).otherwise(pairs), lambda x: F.trim(x))
    parsed = rows.select("doc_id", "target", lls.alias("lls"), greedy.alias("is_greedy"), choices.alias("choices"))
    place = F.expr("CAST(array_position(choices, trim(target)) - 1 AS int)")
    out = parsed.withColumn("gold", F.coalesce(F.expr("try_cast(target AS int)"), F.when(place >= 0, place)))
    out = out.withColumn("choice_chars", F.transform("choices", lambda x: F.length(x))).withColumn("choice_bytes", F.transform("choices", lambda x: F.octet_length(x)))
    by_length = F.zip_with("lls", "choice_chars", lambda a, n: F.when(n > 0, a / n).otherwise(-1e9))
    first = lambda c: (F.array_position(c, F.array_max(c)) - 1) == F.col("gold")
    return out.select("doc_id", "gold", "lls", "is_greedy", "choice_chars", "choice_bytes", first(F.col("lls")).cast("double").alias("acc"), first(by_length).cast("double").alias("acc_norm"))


HARVESTED = "prompt_id string, text string, source string, license string, url string"
PERSONA = "persona_id string, persona string, source string"
FIXTURE = "context string, options array<string>, gold int, item_id string"
RUN = "run_id string, arm string, student string, teacher string, seed int, data struct<d_syn: double, replay: double>, train struct<tokens: double>"


def harvested(spark: SparkSession, path: str) -> DataFrame:
    """Harvested prompts with a text; licence and source have defaults."""
    rows = spark.read.schema(HARVESTED).json(path).where("trim(text) <> ''")
    return rows.withColumn("license", F.coalesce("license", F.lit("unknown"))).withColumn("source", F.coalesce("source", F.lit("harvested")))


def personas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PERSONA).json(path).where("trim(persona) <> ''")


def choice_items(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice fixtures, one list a file or one item a line: context, options, gold; items whose gold is no option go."""
    rows = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    return rows.withColumn("item_id", F.coalesce("item_id", F.concat_ws("-", F.col("_metadata.file_name"), F.sha2(F.concat_ws("|", "context", F.array_join("options", "|")), 256).substr(1, 8)))).where("gold >= 0 AND gold < size(options)")


def run_covariates(spark: SparkSession, path: str, arms: dict[str, str], points: DataFrame | None = None, least: int = 4) -> DataFrame:
    """A row a run's manifest: condition by its arm, replayed share (a quarter unless it says otherwise), data of its own.

    Runs of the base alone are left out, and, given curves (run_id, d, loss), runs with fewer points than `least`.
    """
    rows = spark.read.schema(RUN).option("multiLine", True).json(path)
    cond = F.coalesce(*(F.when(F.col("arm") == a, F.lit(c)) for a, c in sorted(arms.items()))) if arms else F.col("arm")
    out = rows.where("run_id IS NOT NULL AND arm <> 'base_only'").select("run_id", "student", "teacher", "seed", cond.alias("cond"), F.coalesce("data.replay", F.lit(0.25)).alias("replay"), F.coalesce("data.d_syn", "train.tokens").alias("d_syn"))
    if points is not None:
        out = out.join(points.groupBy("run_id").agg(F.count("*").alias("n_points")).where(F.col("n_points") >= least), "run_id")
    return out


def load_index(spark: SparkSession, uri: str) -> DataFrame:
    """An index by its name without ending: Parquet if it is there, else CSV with a header."""
    path, fs = hadoop_path(spark, f"{uri}.parquet")
    return spark.read.parquet(f"{uri}.parquet") if fs.exists(path) else spark.read.option("header", True).option("inferSchema", True).csv(f"{uri}.csv")


def harness_likelihoods(spark: SparkSession, path: str) -> DataFrame:
    """Items of a log of single continuations: doc_id, log-likelihood, whether it is greedy."""
    rows = spark.read.schema("doc_id long, resps string, filtered_resps string").json(path).where("doc_id IS NOT NULL").withColumn("r", F.coalesce("filtered_resps", "resps"))
    return rows.select("doc_id", F.regexp_replace(F.regexp_extract("r", r'\[\s*"?(-?(?:[0-9][0-9.eE+-]*|inf|Infinity))"?\s*,', 1), "^-inf$", "-Infinity").cast("double").alias("ll"), (F.lower(F.regexp_extract("r", r'(?i),\s*"?(true|false)"?\s*\]', 1)) == "true").alias("is_greedy"))


def harness_generations(spark: SparkSession, path: str) -> DataFrame:
    """Items of a log of generated answers: doc_id, target, the first answer however deeply nested, and whether they match."""
    rows = spark.read.schema("doc_id long, target string, resps string, filtered_resps string").json(path).where("doc_id IS NOT NULL").withColumn("r", F.coalesce("filtered_resps", "resps"))
    nested = F.element_at(F.flatten(F.from_json("r", "array<array<string>>")), 1)
    answer = F.when(F.col("r").rlike(r"^\s*\[\s*\["), nested).otherwise(F.element_at(F.from_json("r", "array<string>"), 1))
    return rows.select("doc_id", "target", F.trim(answer).alias("answer"), (F.lower(F.trim(answer)) == F.lower(F.trim("target"))).alias("matched"))
