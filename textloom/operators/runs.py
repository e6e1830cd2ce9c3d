"""Run tables: matrix expansion, resume by lookup, summaries over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.scale import salted_join


def resolve_algorithms(algorithms: DataFrame, classes: DataFrame) -> DataFrame:
    """Algorithms (name, config map) with inherited entries and their class.

    An entry ``_base`` names the parent; one level is followed. An unknown parent or class
    stops the job.
    """
    base = algorithms.select(F.col("name").alias("base"), F.col("config").alias("base_config"))
    known = classes.select("name", "algo_class")
    joined = (
        algorithms.withColumn("base", F.col("config").getItem("_base"))
        .join(base, "base", "left")
        .join(known, "name", "left")
        .join(known.select(F.col("name").alias("base"), F.col("algo_class").alias("base_class")), "base", "left")
    )
    stop = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), "name")).cast("string")
    algo_class = F.coalesce("algo_class", "base_class", stop("unknown algorithm"))
    checked = F.when(F.col("base").isNotNull() & F.col("base_config").isNull(), stop("unknown base of")).otherwise(
        algo_class
    )
    return joined.select(
        F.col("name").alias("algo_name"),
        checked.alias("algo_class"),
        tx.inherit(F.col("config"), F.col("base_config")).alias("algo_kwargs"),
    )


def expand_matrix(
    groups: DataFrame,
    algorithms: DataFrame,
    incompatible: DataFrame,
    n_seeds: int,
    total_timesteps: int,
    log_dir: str,
) -> DataFrame:
    """One row per group, problem, algorithm and seed, minus incompatible pairs.

    ``groups`` has name, problems (array of struct env_id, total_timesteps) and algorithms
    (array of names). The expansion explodes the arrays of each group, so nothing is crossed.
    """
    asked = (
        groups.select(F.col("name").alias("experiment_name"), F.explode("problems").alias("p"), "algorithms")
        .select("experiment_name", "p.env_id", "p.total_timesteps", F.explode("algorithms").alias("algo_name"))
    )
    allowed = salted_join(asked, incompatible, ["env_id", "algo_name"], "left_anti")
    rows = salted_join(allowed, algorithms, ["algo_name"])
    seeds = F.sequence(F.lit(0), F.lit(n_seeds - 1))
    return rows.withColumn("seed", F.explode(seeds)).select(
        "experiment_name",
        "env_id",
        "algo_name",
        "algo_class",
        "algo_kwargs",
        "seed",
        F.coalesce("total_timesteps", F.lit(total_timesteps)).cast("long").alias("total_timesteps"),
        tx.run_name(
            F.lit(log_dir), F.col("experiment_name"), F.col("algo_name"), F.col("env_id"), F.col("seed")
        ).alias("log_dir"),
    )


def pending(wanted: DataFrame, logged: DataFrame, on=("env_id", "algo_name", "seed")) -> DataFrame:
    """Runs that have not been logged."""
    return salted_join(wanted, logged.select(*on).distinct(), list(on), "left_anti")


def seed_summary(runs: DataFrame, value: str = "mean_reward", keys=("env_id", "algo_name")) -> DataFrame:
    """Mean, sample deviation and count over seeds; environment up, mean down."""
    return (
        runs.groupBy(*keys)
        .agg(
            F.avg(value).alias("reward_mean"),
            F.stddev_samp(value).alias("reward_std"),
            F.count(value).alias("n_seeds"),
        )
        .orderBy(F.asc(keys[0]), F.desc("reward_mean"), *keys[1:])
    )


def evaluation_summary(rewards: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population mean and deviation of the rewards of each evaluation."""
    return rewards.groupBy(*keys).agg(
        F.avg(value).alias("mean_reward"), F.stddev_pop(value).alias("std_reward")
    )
