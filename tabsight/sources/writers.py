"""Sinks: cleaned table, step results, documents of one scope."""

from pyspark.sql import DataFrame


def write_cleaned(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """The cleaned table; every task writes its own part."""
    out = df.write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).option("escape", '"').csv(path)
    else:
        out.format(fmt).save(path)
    return path


def write_diagnostics(results: dict[str, DataFrame], path: str) -> str:
    """Step results as JSON lines, one folder per result."""
    for name, df in results.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    return path


def replace_scope(docs: DataFrame, path: str, scope: str = "scope_id") -> str:
    """Rebuilds the documents of the scopes in ``docs`` and leaves all other scopes as they are."""
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path))
    return path
