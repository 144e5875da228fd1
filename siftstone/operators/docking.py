"""Result texts of docking runs as tables, and the calls of outside programs, one process for each row."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text_results import atom_fields, clean_receptor, file_stem, has_atoms, line_tag, result_score, single_root, standard_residues


def parse_results(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """id_ligand (file name without _dock or _out) and docking_score of each whole file; null where it has none."""
    return files.select(file_stem(F.col(path), "_dock", "_out").alias("id_ligand"), result_score(F.col(text)).alias("docking_score"))


def atom_table(lines: DataFrame, key: str, line: str = "value") -> DataFrame:
    """key and the fields of each ATOM or HETATM line."""
    return lines.filter(line_tag(F.col(line)).isin("ATOM", "HETATM")).select(key, *atom_fields(F.col(line)))


def prepare_ligands(files: DataFrame, text: str = "value") -> DataFrame:
    """Files with atoms, each with one root and a line of torsions."""
    return files.filter(has_atoms(F.col(text))).withColumn(text, single_root(F.col(text)))


def prepare_receptors(files: DataFrame, text: str = "value", standard_only: bool = False) -> DataFrame:
    """Files with only the lines that a receptor keeps; standard_only: without hetero atoms."""
    return files.withColumn(text, (standard_residues if standard_only else clean_receptor)(F.col(text)))


def join_scores(ids: DataFrame, scores: DataFrame, key: str = "id_ligand") -> DataFrame:
    """All ids, with a null score where there is none."""
    return ids.join(scores, key, "left")


def dock(ligands: DataFrame, program: str, receptor: str, center: tuple[float, float, float], size: tuple[float, float, float], exhaustiveness: int = 8, modes: int = 9, energy_range: int = 3, timeout: int = 600) -> DataFrame:
    """id_ligand and docking_score by running program on each ligand text (columns id_ligand, value). A run that fails or takes too long gives null.

    The receptor's text goes with the task, and each run has a folder of its own that ends with it.
    """
    if shutil.which(program) is None:
        raise RuntimeError(f"{program} is not installed here")

    def run(batches):
        for batch in batches:
            out = []
            for ligand in batch["value"]:
                with tempfile.TemporaryDirectory() as folder:
                    where = Path(folder)
                    (where / "receptor.pdbqt").write_text(receptor)
                    (where / "ligand.pdbqt").write_text(ligand or "")
                    numbers = [x for axis, c, s in zip("xyz", center, size) for x in (f"--center_{axis}", str(c), f"--size_{axis}", str(s))]
                    call = [program, "--receptor", "receptor.pdbqt", "--ligand", "ligand.pdbqt", "--out", "out.pdbqt", *numbers, "--exhaustiveness", str(exhaustiveness), "--num_modes", str(modes), "--energy_range", str(energy_range)]
                    try:
                        done = subprocess.run(call, cwd=where, capture_output=True, text=True, timeout=timeout)
                        result = where / "out.pdbqt"
                        out.append((done.stdout, result.read_text() if result.exists() else ""))
                    except (OSError, subprocess.TimeoutExpired):
                        out.append(("", ""))
            yield pd.DataFrame({"id_ligand": batch["id_ligand"], "stdout": [x for x, _ in out], "output": [y for _, y in out]})

    from siftstone.functions.text_results import cascade_score

    texts = ligands.select("id_ligand", "value").mapInPandas(run, "id_ligand string, stdout string, output string")
    return texts.select("id_ligand", cascade_score(F.lit(None).cast("string"), F.col("stdout"), F.col("output")).alias("docking_score"))
