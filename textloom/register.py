"""Names of the queries, with their Spark form and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.dialect import DUCK, SPARK, Plan
from .operators import custom
from .plans import analytics, curation, formats, prompts, studies
from .sources.tables import views

PLANS: dict[str, Plan] = curation.PLANS | analytics.PLANS | studies.PLANS | formats.PLANS | prompts.PLANS


def of_plan(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = plan(SPARK)
        views(spark, sf_dir, text)
        return spark.sql(text)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: of_plan(p) for name, p in PLANS.items()} | custom.QUERIES
ORACLE_SQL: dict[str, str] = {name: p(DUCK) for name, p in PLANS.items()} | custom.ORACLE_SQL
