"""Schemas of the tables that the stages of a screening hand on."""

from __future__ import annotations

RAW_ACTIVITY = "molecule_chembl_id string, canonical_smiles string, standard_value string, standard_units string, standard_type string"
ACTIVITY = "molecule_chembl_id string, smiles string, nanomolar double, kind string, unit string"
GENERATED = "smiles string, final_score double, predicted_pIC50 double, qed double, logp double, sa_score double, bbbp_prob double"
LIGAND_IDS = "id_ligand string, smiles string"
SCORES = "id_ligand string, docking_score double"
FINAL_HITS = "molecule_id string, smiles string, docking_score double, rank long"
PREFERENCES = "chosen string, rejected string, chosen_score double, rejected_score double"
METRICS = "model string, rmse_test double, r2_test double, rmse_train double, r2_train double, n_train long, n_test long"
