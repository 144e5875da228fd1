"""The steps of a screening, each from tables to a table, and a run of those that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.cleaning import potency
from siftstone.operators.clean import clean_activity
from siftstone.operators.frames import lookup, rank_rows
from siftstone.operators.ranking import COMPOSITE, rank_candidates, top
from siftstone.operators.similarity import novel


def activity_step(t: dict[str, DataFrame]) -> DataFrame:
    raw = t["raw_activity"].withColumnRenamed("canonical_smiles", "smiles")
    clean = clean_activity(raw, "molecule_chembl_id", "standard_value", "standard_units", "standard_type", structure="smiles")
    return clean.withColumn("pIC50", potency(F.col("nanomolar")))


def novelty_step(t: dict[str, DataFrame]) -> DataFrame:
    return novel(t["generated"], t["known"], "smiles", "known_smiles")


def ranking_step(t: dict[str, DataFrame]) -> DataFrame:
    return top(rank_candidates(t["descriptors"]), 5, COMPOSITE, "id_ligand")


def hits_step(t: dict[str, DataFrame]) -> DataFrame:
    scored = t["scores"].filter(F.col("docking_score").isNotNull())
    ranked = rank_rows(scored, [F.col("docking_score"), F.col("id_ligand")])
    return lookup(ranked, t["ligand_ids"], "id_ligand", "smiles").select(F.col("id_ligand").alias("molecule_id"), "smiles", "docking_score", "rank")


STEPS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {"activity": activity_step, "novel": novelty_step, "ranked": ranking_step, "final_hits": hits_step}


def run(tables: dict[str, DataFrame], *steps: str) -> dict[str, DataFrame]:
    """tables and the results of the steps, in order; a step finds the results of those before it."""
    out = dict(tables)
    for name in steps or STEPS:
        out[name] = STEPS[name](out)
    return out
