"""Desirability, risk and permeability scores as column expressions: one projection, within code generation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.cleaning import clamp

TINY = 1e-9


def less_is_better(x: Column, target: float, high: float) -> Column:
    """1 up to target, 0 from high on, a line between. Null stays null; NaN counts as very large."""
    return F.when(x <= target, 1.0).when(x >= high, 0.0).otherwise((F.lit(high) - x) / (high - target))


def more_is_better(x: Column, low: float, target: float) -> Column:
    """0 up to low, 1 from target on, a line between."""
    return F.when(x >= target, 1.0).when(x <= low, 0.0).otherwise((x - low) / (target - low))


def near_is_best(x: Column, low: float, best: float, high: float) -> Column:
    """A triangle: 0 up to low, 1 at best, 0 from high on."""
    return F.when(x <= best, more_is_better(x, low, best)).otherwise(less_is_better(x, best, high))


@dataclass(frozen=True)
class Desirability:
    """A named component: shape(metric, *edges), and its weight in the composite. negate turns the metric's sign."""

    name: str
    metric: str
    shape: Callable[..., Column]
    edges: tuple[float, ...]
    weight: int
    negate: bool = False

    def column(self, metric: Column | None = None) -> Column:
        x = F.col(self.metric) if metric is None else metric
        return self.shape(-x if self.negate else x, *self.edges)


#: The 25 components (fixed values).
COMPONENTS = (
    Desirability("d_mpo", "CNS_MPO", more_is_better, (3, 5), 3),
    Desirability("d_logBB", "logBB_est", more_is_better, (-1, -0.3), 3),
    Desirability("d_pgp", "pgp_efflux", less_is_better, (1, 2), 3),
    Desirability("d_bcrp", "bcrp_efflux", less_is_better, (1, 2), 3),
    Desirability("d_kp_brain", "Kp_uu_brain", more_is_better, (0.3, 0.8), 3),
    Desirability("d_mw", "MW", near_is_best, (250, 350, 400), 1),
    Desirability("d_logp", "LogP", near_is_best, (1, 2.8, 4), 1),
    Desirability("d_clogd", "cLogD_74", near_is_best, (1, 2.5, 3.5), 1),
    Desirability("d_tpsa", "TPSA", near_is_best, (40, 60, 80), 1),
    Desirability("d_hbd", "HBD", less_is_better, (0, 2), 1),
    Desirability("d_hba", "HBA", less_is_better, (2, 7), 1),
    Desirability("d_rotb", "RotB", less_is_better, (0, 7), 1),
    Desirability("d_dock", "docking_score", more_is_better, (6, 8), 2, negate=True),
    Desirability("d_le", "LE", more_is_better, (0.2, 0.35), 2),
    Desirability("d_lle", "LLE", more_is_better, (3, 5), 2),
    Desirability("d_bei", "BEI", more_is_better, (15, 25), 2),
    Desirability("d_herg", "herg_blocker", less_is_better, (0.2, 0.3), 2),
    Desirability("d_cyp3a4", "cyp3a4_inhib", less_is_better, (0.3, 0.5), 2),
    Desirability("d_cyp2d6", "cyp2d6_inhib", less_is_better, (0.3, 0.5), 2),
    Desirability("d_hepatotox", "hepatotox", less_is_better, (0.2, 0.3), 2),
    Desirability("d_ames", "ames_mutagen", less_is_better, (0.2, 0.3), 2),
    Desirability("d_gsh", "GSH_reactivity", less_is_better, (0.1, 0.2), 2),
    Desirability("d_maob", "MAOB_inhib", less_is_better, (0.2, 0.3), 1),
    Desirability("d_ht2a", "HT2A_binding", less_is_better, (0.2, 0.3), 1),
    Desirability("d_bace1", "BACE1_selectivity", less_is_better, (0.3, 0.5), 1),
)
#: Metrics that a row must have to be ranked.
REQUIRED = ("docking_score", "LE", "LLE", "BEI")


def weighted_geometric_mean(parts: list[tuple[Column, float]], epsilon: float = TINY) -> Column:
    """exp of the weighted mean of ln(part + epsilon); NaN if a part is null or NaN."""
    total = float(sum(w for _, w in parts))
    logs = sum(F.ln(p + F.lit(epsilon)) * F.lit(float(w)) for p, w in parts)
    return F.coalesce(F.exp(logs / F.lit(total)), F.lit(float("nan")))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def barrier_probability(logp: Column, tpsa: Column, molwt: Column, hbd: Column, hba: Column) -> Column:
    return logistic(F.lit(-1.436) + logp * 0.345 - tpsa * 0.0123 - molwt * 0.014 - hbd * 0.026 - hba * 0.047)


#: The isoforms that have a column each; the model is one and the same for all of them (fixed values).
ISOFORMS = ("1A2", "2C9", "2C19", "2D6", "3A4")


def inhibition_probability(logp: Column, molwt: Column, rings: Column) -> Column:
    return logistic(F.lit(-5.0) + logp * 1.2 + molwt * 0.02 + rings * 0.6)


def liver_risk(logp: Column, molwt: Column, hba: Column, rings: Column) -> Column:
    return logistic(F.lit(-3.0) + logp * 0.8 + molwt * 0.01 + hba * 0.05 + rings * 0.5)


def _tiers(*tiers: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, points in reversed(tiers):
        out = F.when(condition, points).otherwise(out)
    return out


def barrier_rules(tpsa: Column, logp: Column, molwt: Column, hbd: Column, hba: Column, rotb: Column) -> Column:
    """Points for permeability from 0 to 1, by tiers on five groups of properties."""
    egan = _tiers(((tpsa <= 132) & (logp <= 5.9), 0.4), ((tpsa <= 140) & (logp <= 5.0), 0.3), ((tpsa <= 150) & (logp <= 4.0), 0.2))
    veber = _tiers(((rotb <= 10) & (tpsa <= 140), 0.2))
    weight = _tiers(((molwt >= 150) & (molwt <= 500), 0.2), ((molwt >= 100) & (molwt <= 600), 0.1))
    bonds = _tiers(((hbd <= 3) & (hba <= 7), 0.1), ((hbd <= 5) & (hba <= 10), 0.05))
    lipophilic = _tiers(((logp >= 1) & (logp <= 4), 0.1), ((logp >= 0.5) & (logp <= 5), 0.05))
    return clamp(egan + veber + weight + bonds + lipophilic, 0.0, 1.0)


def activity_score(potency: Column) -> Column:
    return clamp((potency - 5.0) / 3.0, 0.0, 1.0)


def ease_score(difficulty: Column) -> Column:
    return F.when(difficulty.isNotNull(), F.greatest(F.lit(0.0), (F.lit(5.0) - difficulty) / 4.0))


def generation_score(potency: Column, qed: Column, difficulty: Column, barrier: Column) -> Column:
    """Weights .35 activity, .20 qed, .15 ease, .25 permeability, .05 selectivity; 0 for a row without them all."""
    activity = activity_score(potency)
    selectivity = F.least(F.lit(1.0), activity * 0.8)
    return F.coalesce(activity * 0.35 + qed * 0.20 + ease_score(difficulty) * 0.15 + barrier * 0.25 + selectivity * 0.05, F.lit(0.0))


def difficulty_by_groups(atoms: Column, rings: Column, large_rings: Column, rotb: Column, spiro: Column, bridges: Column, stereo: Column, hetero: Column, groups: Column) -> Column:
    """Difficulty of a synthesis from 1 to 10 by counts; 5 for a row that lacks one. large_rings: those of more than six atoms."""
    size = _tiers((atoms > 50, 2.0), (atoms > 30, 1.5), (atoms > 20, 1.0))
    total = F.lit(1.0) + size + rings * 0.5 + large_rings * 0.8 + rotb * 0.3 + spiro * 1.0 + bridges * 0.8 + stereo * 0.4 + hetero * 0.2 + groups * 0.3
    return F.coalesce(clamp(total, 1.0, 10.0), F.lit(5.0))


def difficulty_by_share(atoms: Column, rings: Column, hetero: Column, stereo: Column, aromatic: Column) -> Column:
    """Difficulty from 1 to 6 by counts; 10 for a row that lacks one."""
    total = F.lit(1.5) + rings * 0.4 + hetero * 0.3 / F.greatest(F.lit(1), atoms) + stereo * 0.5 + aromatic * 0.2 + F.when(atoms > 30, (atoms - 30) * 0.1 / 10).otherwise(0.0)
    return F.coalesce(clamp(total, 1.0, 6.0), F.lit(10.0))


#: The score of a fragment that the table of fragments lacks (fixed value).
RARE_FRAGMENT = -4.0


def published_difficulty(fragments: Column, atoms: Column, kinds: Column, stereo: Column, spiro: Column, bridges: Column, macrocycles: Column) -> Column:
    """Difficulty of a synthesis from 1 to 10 by the published formula.

    fragments: the mean score of a molecule's fragments; kinds: how many different ones it has; the
    others are counts. Penalties for size and rare structures are taken off, symmetry (more atoms than
    kinds) is added, and the sum is put on the scale, its upper end smoothed. Null if a value is null
    or there is no atom or no fragment.
    """
    penalties = (F.pow(atoms.cast("double"), F.lit(1.005)) - atoms) + F.log10(stereo + F.lit(1.0)) + F.log10(spiro + F.lit(1.0)) + F.log10(bridges + F.lit(1.0)) + F.when(macrocycles > 0, F.log10(F.lit(2.0))).when(macrocycles <= 0, 0.0)
    symmetry = F.when(atoms > kinds, F.ln(atoms / kinds) * 0.5).when(atoms <= kinds, 0.0)
    scaled = F.lit(11.0) - (fragments - penalties + symmetry + 5.0) / 6.5 * 9.0
    smooth = F.when(scaled > 8, F.lit(8.0) + F.ln(scaled - 8.0)).otherwise(scaled)
    return F.when((atoms > 0) & (kinds > 0) & scaled.isNotNull(), clamp(smooth, 1.0, 10.0))


#: The score of rows that cannot be scored.
INVALID = -1000.0


def preference_score(qed: Column, complexity: Column, potency: Column, logp: Column) -> Column:
    simple = F.greatest(F.lit(0.0), F.lit(1.0) - complexity / 100.0)
    return F.coalesce(qed * 0.2 + F.when(complexity.isNotNull(), simple) * 0.1 + potency * 0.3 + F.lit(0.4) / (F.abs(logp - 2.5) + 1.0), F.lit(INVALID))


def binding_reward(docking: Column, potency: Column, qed: Column) -> Column:
    return F.coalesce(F.when(docking.isNotNull(), F.greatest(F.lit(0.0), -docking / 10.0)) * 0.4 + potency * 0.3 + qed * 0.2 + 0.1, F.lit(INVALID))


@dataclass(frozen=True)
class Tier:
    """Names for ranges of a metric, best last; down: smaller is better."""

    metric: str
    edges: tuple[float, ...]
    down: bool = False

    def column(self, x: Column, names: tuple[str, ...] = ("low", "fair", "good", "best")) -> Column:
        out = F.lit(names[0])
        for edge, name in zip(self.edges, names[1:]):
            out = F.when(x <= edge if self.down else x >= edge, name).otherwise(out)
        return F.when(x.isNotNull(), out)


#: Edges of the tiers of each metric (fixed values).
TIERS = {t.metric: t for t in (Tier("pIC50", (5, 6, 7)), Tier("qed", (0.3, 0.5, 0.7)), Tier("sa", (6, 4, 3), True), Tier("bbb", (0.3, 0.5, 0.7)), Tier("docking", (-6, -7, -8), True))}


def rule_set(kind: str) -> dict[str, Column]:
    """The predicates of a rule set by name, over columns of the usual names: lipinski, cns or strict (fixed values)."""
    c = F.col
    sets = {
        "lipinski": {"MW": c("MW") <= 500, "LogP": c("LogP") <= 5, "HBD": c("HBD") <= 5, "HBA": c("HBA") <= 10, "TPSA": c("TPSA") <= 140},
        "cns": {"MW": c("MW") <= 450, "LogP": c("LogP") <= 3, "TPSA": c("TPSA") <= 90, "RotB": c("RotB") <= 3, "CNS_MPO": c("CNS_MPO") >= 4},
        "strict": {
            "MW": c("MW") <= 450, "LogP": c("LogP").between(1, 4), "TPSA": c("TPSA") < 70, "HBD": c("HBD") <= 3, "HBA": c("HBA") <= 7, "RotB": c("RotB") <= 8, "QED": c("QED").between(0.4, 0.8),
            "CNS_MPO": c("CNS_MPO") >= 4, "logBB": c("logBB_est") > -0.3, "pgp": c("pgp_efflux") < 2, "docking": c("docking_score") < -8, "herg": c("herg_blocker") < 0.3, "SA": c("SA") < 5,
        },
    }
    return sets[kind]


def criteria_passed(predicates: dict[str, Column]) -> Column:
    """How many of the predicates hold; a null one does not."""
    return sum(F.coalesce(p, F.lit(False)).cast("int") for p in predicates.values())
