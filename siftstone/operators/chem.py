"""Molecule functions, if a toolkit is installed. Without it, pass tables that have the columns already."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from rdkit import Chem
except ImportError:  # optional
    Chem = None

#: Columns that describe() gives.
DESCRIPTORS = ("qed", "tpsa", "molwt", "logp", "hbd", "hba", "rotb", "ring_count")


def available() -> bool:
    return Chem is not None


def _need() -> None:
    if Chem is None:
        raise RuntimeError("this needs a molecule toolkit, which is not installed here; pass precomputed columns")


def canonical(smiles: Column) -> Column:
    """The canonical form, null if the text is no molecule."""
    _need()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(s):
            mol = Chem.MolFromSmiles(s) if s else None
            return Chem.MolToSmiles(mol) if mol is not None else None

        return texts.map(one)

    return run(smiles)


def fingerprint(smiles: Column, bits: int = 2048, radius: int = 2) -> Column:
    """Circular fingerprint packed in longs, null if the text is no molecule."""
    _need()

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        from rdkit.Chem import rdFingerprintGenerator

        maker = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=bits)

        def one(s):
            mol = Chem.MolFromSmiles(s) if s else None
            return None if mol is None else np.packbits(maker.GetFingerprintAsNumPy(mol).astype(np.uint8), bitorder="little").view(np.int64).tolist()

        for texts in batches:
            yield texts.map(one)

    return run(smiles)


def scaffold(smiles: Column, missing: str | None = None) -> Column:
    """The scaffold of a molecule; missing if the text is none."""
    _need()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        from rdkit.Chem.Scaffolds import MurckoScaffold

        def one(s):
            mol = Chem.MolFromSmiles(s) if s else None
            return missing if mol is None else MurckoScaffold.MurckoScaffoldSmiles(mol=mol)

        return texts.map(one)

    return run(smiles)


def describe(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """df with the columns of DESCRIPTORS, all from one parse of each molecule; null where the text is none."""
    _need()

    @F.pandas_udf("qed double, tpsa double, molwt double, logp double, hbd int, hba int, rotb int, ring_count int")
    def run(texts: pd.Series) -> pd.DataFrame:
        from rdkit.Chem import QED, Crippen, Descriptors, rdMolDescriptors

        def one(s):
            mol = Chem.MolFromSmiles(s) if s else None
            if mol is None:
                return (None,) * len(DESCRIPTORS)
            calc = rdMolDescriptors
            return QED.qed(mol), calc.CalcTPSA(mol), Descriptors.MolWt(mol), Crippen.MolLogP(mol), calc.CalcNumHBD(mol), calc.CalcNumHBA(mol), calc.CalcNumRotatableBonds(mol), calc.CalcNumRings(mol)

        return pd.DataFrame([one(s) for s in texts], columns=list(DESCRIPTORS))

    return df.withColumn("__d", run(F.col(smiles))).select("*", *(F.col(f"__d.{c}").alias(c) for c in DESCRIPTORS)).drop("__d")
