"""Writing results: catalogs, atoms, graphs, rule catalogs, reports, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite", fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Each table in a folder of its own."""
    for name, rows in tables.items():
        writer = rows.write.mode(mode).format(fmt)
        (writer.partitionBy(*by) if by else writer).save(f"{path}/{name}")


def write_atoms(atoms: DataFrame, path: str, by: str | None = None) -> None:
    """Classified atoms."""
    writer = atoms.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    reports.write.mode("overwrite").json(path)


def write_statements(statements: DataFrame, path: str) -> None:
    """One exported statement per line."""
    statements.select("statement").write.mode("overwrite").text(path)
