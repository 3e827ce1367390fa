"""A documentation run end to end: a stored scan and a corpus in, prompts out; responses in, suggestions,
descriptions, comment statements and the run's row out, all stored; then diff and portal on what is stored.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.moments import moment
from ..operators import retrieval, rollups, runs, suggest
from ..operators.profile import TABLE_KEY
from ..sources import store
from ..sources.documents import read_documents, read_mapping
from .audit import Scan


def grounding(scan: Scan, documents: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """What the corpus (system, text) says about each mapped table: table key, system, context,
    citations, matched_terms."""
    names = scan.inventory.select(F.concat_ws(".", *TABLE_KEY).alias("query_id"), *TABLE_KEY)
    queries = retrieval.table_queries(scan.inventory, scan.profile, rules)
    return retrieval.retrieve(queries, retrieval.corpus_chunks(documents)).join(names, "query_id").drop("query_id")


def grounding_from_files(scan: Scan, root: str, mapping: str) -> DataFrame:
    """`grounding` by the documents below a folder and a mapping file."""
    spark = scan.inventory.sparkSession
    rules = read_mapping(spark, mapping)
    return grounding(scan, read_documents(spark, root, rules), rules)


def prompts(scan: Scan, grounded: DataFrame | None = None) -> DataFrame:
    """(table key, prompt) for a model of the caller's choice."""
    return suggest.prompts(_columns(scan), grounded)


def _columns(scan: Scan) -> DataFrame:
    stamp = F.lit("scan").alias("scan_id")
    return suggest.load_scan(
        scan.profile.drop("scan_id").select("*", stamp), scan.inventory.drop("scan_id").select("*", stamp)
    ).drop("scan_id")


@dataclass(frozen=True)
class Run:
    suggestions: DataFrame
    descriptions: DataFrame
    statements: DataFrame

    def counters(self, keys: tuple[str, ...] = ("table_catalog",)) -> DataFrame:
        return runs.counters(self.suggestions, self.statements, list(keys))


def read_responses(scan: Scan, responses: DataFrame, grounded: DataFrame | None = None, apply: bool = False) -> Run:
    """What a model's responses (table key, response) say about the scanned columns and tables."""
    columns = _columns(scan)
    return Run(
        suggest.ingest(columns, responses, grounded, apply),
        suggest.table_descriptions(scan.inventory, responses, apply),
        suggest.comment_statements(columns, scan.inventory, responses),
    )


def save(
    run: Run, root: str, run_id: str, scan_id: str, model: str, started_at: datetime, finished_at: datetime,
    prompt_tokens: int = 0, completion_tokens: int = 0, cost: float | None = None, applied: bool = False,
) -> None:
    """Adds a run to the meta tables; its counters are taken from the suggestions. The run's row is written last,
    and saving the same run again leaves one copy."""
    stamp = {"run_id": F.lit(run_id), "scan_id": F.lit(scan_id), "generated_at": moment(finished_at)}
    store.append(run.suggestions.withColumns(stamp | {"model": F.lit(model)}), root, "suggestions")
    store.append(run.descriptions.withColumns(stamp), root, "table_descriptions")
    counted = run.counters(()).withColumns(
        {
            "run_id": F.lit(run_id), "scan_id": F.lit(scan_id), "model": F.lit(model), "started_at": moment(started_at), "finished_at": moment(finished_at),
            "prompt_tokens": F.lit(prompt_tokens), "completion_tokens": F.lit(completion_tokens),
            "est_cost_usd": F.lit(cost).cast("double"), "applied": F.lit(applied),
        }
    )
    store.append(counted, root, "model_runs")


def curate(rows: DataFrame, condition: Column, columns: list[str], table: str) -> DataFrame:
    """Writes the curated rows as a table of the session's catalog, and returns it."""
    rollups.create_table_as(rollups.curated(rows, condition, columns), table)
    return rows.sparkSession.table(table)


def portal(spark: SparkSession, root: str, scan: Scan, written: str, newest: str) -> tuple[DataFrame, DataFrame]:
    """(columns, tables) of the portal: labels of the run that wrote comments, texts of the newest one."""
    said, latest = store.read(spark, root, "suggestions", written), store.read(spark, root, "suggestions", newest)
    grounded = suggest.provenance(said)
    columns = suggest.portal_columns(scan.profile, said, latest, grounded)
    return columns, suggest.portal_tables(scan.inventory, columns, store.read(spark, root, "table_descriptions", newest), grounded)
