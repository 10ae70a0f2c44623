"""Registered queries: a name, a DataFrame over the domain relations, and the same in SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plenum.sources.projection import Civic, sql

Plan = Callable[[Civic], DataFrame]
_plans: dict[str, Plan] = {}
_sql: dict[str, str] = {}


def query(name: str, select: str | None = None, plain: bool = False) -> Callable[[Plan], Plan]:
    """Register a plan; ``select`` may use the domain relations, or (``plain``) the tables alone."""

    def add(plan: Plan) -> Plan:
        if name in _plans:
            raise ValueError(f"two plans are named {name}")
        _plans[name] = plan
        if select:
            _sql[name] = select if plain else sql(select)
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Civic(spark, sf_dir))) for name, plan in _plans.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
