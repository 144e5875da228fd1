"""Queries that apply the operators to whole tables. Their SQL is in plans/oracle.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import cleaning, reporting, sampling, scoring, similarity, text_results
from siftstone.operators import clean, docking, fragments, frames, graphs, linear, molecules, ranking, stats, tokens
from siftstone.operators import similarity as search
from siftstone.operators.vector_index import VectorIndex
from siftstone.plans.lineage import shared_folder
from siftstone.plans.oracle import LINE, PART
from siftstone.sources import tables
from siftstone.sources.cache import TableCache

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
CORRELATED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(names: dict[str, str], *only: str) -> dict[str, Column]:
    """Metrics of a table as doubles, all of them or those named."""
    return {k: F.expr(v).cast("double") for k, v in names.items() if not only or k in only}


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _lines(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", *(c.alias(k) for k, c in metrics(LINE, *only).items()))


def _parts(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", *(c.alias(k) for k, c in metrics(PART, *only).items()))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


@query
def desirability_components(spark, sf_dir):
    scored = ranking.with_desirability(_lines(spark, sf_dir))
    return scored.select("l_orderkey", "l_linenumber", *(r6(c).alias(c) for c in frames.select_prefix(scored, "d_")))


@query
def desirability_composite(spark, sf_dir):
    return ranking.with_desirability(_lines(spark, sf_dir)).select("l_orderkey", "l_linenumber", r6(ranking.COMPOSITE).alias("composite"))


def _top_parts(spark, sf_dir):
    return ranking.top(ranking.rank_candidates(_parts(spark, sf_dir)), 5, ranking.COMPOSITE, "p_partkey")


@query
def desirability_composite_top5(spark, sf_dir):
    return _top_parts(spark, sf_dir).select("p_partkey", r6(ranking.COMPOSITE).alias("composite"))


@query
def desirability_breakdown(spark, sf_dir):
    top = _top_parts(spark, sf_dir)
    return ranking.breakdown(top, "p_partkey", frames.select_prefix(top, "d_")).withColumn("value", r6("value"))


@query
def iqr_outlier_fence(spark, sf_dir):
    return stats.quartile_fence(read(spark, sf_dir, "events").select("event_id", "value"), "value")


def _units() -> Column:
    names, out = ("nM", "NM", "uM", "μM", "µM"), F.lit("%")
    for i, name in enumerate(names):
        out = F.when(F.col("event_id") % 6 == i, name).otherwise(out)
    return out


@query
def clean_activity(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "value", _units().alias("unit"), F.col("event_type").alias("kind"))
    return clean.clean_activity(rows, "user_id", "value", "unit", "kind", kinds=None)


@query
def unit_normalise(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("unit", _units())
    return rows.select("event_id", cleaning.plain_unit(F.col("unit")).alias("unit"), cleaning.to_nanomolar(F.col("value"), F.col("unit")).alias("nanomolar"))


@query
def pic50_transform(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_totalprice > 0").select("o_orderkey", r6(cleaning.potency(F.col("o_totalprice"))).alias("pic50"))


@query
def dedupe_keep_min(spark, sf_dir):
    return frames.keep_least(read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), "o_custkey", "o_totalprice", "o_orderkey")


@query
def dedupe_keep_first(spark, sf_dir):
    return frames.keep_least(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query
def not_null_conjunction(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumns({"seg": F.nullif("c_mktsegment", F.lit("BUILDING")), "nat": F.nullif("c_nationkey", F.lit(3))})
    return rows.filter(clean.present("seg", "nat")).select("c_custkey", "c_name")


@query
def in_list_filter(spark, sf_dir):
    return clean.in_list(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query
def positive_filter(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")


@query
def left_join_scores(spark, sf_dir):
    scores = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("docking_score"))
    return docking.join_scores(read(spark, sf_dir, "customer").select("c_custkey"), scores, "c_custkey")


@query
def lookup_default(spark, sf_dir):
    names = read(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return frames.lookup(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey", "n_name").drop("s_nationkey")


@query
def semi_join_keep(spark, sf_dir):
    wanted = read(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", "p_name").join(wanted, "p_partkey", "left_semi")


@query
def inner_lookup(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query
def union_distinct_capped(spark, sf_dir):
    second = read(spark, sf_dir, "supplier").orderBy("s_suppkey").limit(1000).select(F.col("s_nationkey").alias("nationkey"))
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(second).distinct()


@query
def override_union(spark, sf_dir):
    score = lambda factor: lambda df: df.select("p_partkey", (F.col("p_retailprice") * factor).alias("score"))
    return frames.cascade(read(spark, sf_dir, "part"), "p_partkey", score(1), score(2))


@query
def top_fraction(spark, sf_dir):
    return frames.top_fraction(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 0.1)


@query
def rank_hits(spark, sf_dir):
    return frames.rank_rows(read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal"), F.col("s_suppkey")])


@query
def top_hits(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey").limit(10)


@query
def positional_ids(spark, sf_dir):
    return frames.positional_ids(read(spark, sf_dir, "part").select("p_partkey"), [F.col("p_partkey")], "lig_", "id_ligand")


@query
def bbb_probability(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", r6(scoring.barrier_probability(*map(F.col, ("LogP", "TPSA", "MW", "HBD", "HBA")))).alias("bbb"))


@query
def cyp_probability(spark, sf_dir):
    p = r6(scoring.inhibition_probability(F.col("LogP"), F.col("MW"), F.col("rings")))
    return _parts(spark, sf_dir).select("p_partkey", *(p.alias(f"cyp{i}_prob") for i in scoring.ISOFORMS))


@query
def hepatotox_probability(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", r6(scoring.liver_risk(F.col("LogP"), F.col("MW"), F.col("HBA"), F.col("rings"))).alias("hepatotox_prob"))


def _rules() -> Column:
    return scoring.barrier_rules(*map(F.col, ("TPSA", "LogP", "MW", "HBD", "HBA", "RotB")))


@query
def bbbp_rule_score(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(_rules()).alias("bbbp"))


@query
def generation_score(spark, sf_dir):
    score = scoring.generation_score(F.col("l_quantity") / 5.0, F.col("QED"), F.col("SA"), _rules())
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", r6(score).alias("score"))


@query
def sa_heuristic_a(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", r6(scoring.difficulty_by_groups(F.col("p_size"), k % 9, k % 8 % 3, k % 5, k % 2, k % 3, k % 4, k % 6, k % 7)).alias("sa"))


@query
def sa_heuristic_b(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", r6(scoring.difficulty_by_share(F.col("p_size"), k % 9, k % 6, k % 4, k % 3)).alias("sa"))


@query
def sa_published(spark, sf_dir):
    table = read(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("fragment"), (F.col("p_size") / 10 - 2).alias("score"))
    scores = fragments.fragment_scores(read(spark, sf_dir, "lineitem"), table, "l_orderkey", "l_partkey", "l_quantity")
    k = F.col("l_orderkey")
    return scores.select("l_orderkey", "kinds", r6(scoring.published_difficulty(F.col("fragment_score"), k % 60, F.col("kinds"), k % 4, k % 3, k % 2, k % 5)).alias("sa"))


@query
def dpo_score(spark, sf_dir):
    score = scoring.preference_score(F.col("QED"), F.col("p_retailprice") / 10, F.col("p_size") / 8.0, F.col("LogP"))
    return _parts(spark, sf_dir).select("p_partkey", r6(score).alias("score"))


@query
def docking_reward(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", r6(scoring.binding_reward(F.col("docking_score"), F.col("p_size") / 8.0, F.col("QED"))).alias("reward"))


@query
def rule_pass_rates(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    rates = [stats.pass_rates(lines, {f"{kind}_{k}": p for k, p in scoring.rule_set(kind).items()}, f"{kind}_all") for kind in ("lipinski", "cns")]
    return frames.union_tables(rates).withColumn("percent", r6("percent"))


@query
def criteria_passed(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(scoring.criteria_passed(scoring.rule_set("strict")).alias("passed")).agg(F.count("*").alias("n"))


@query
def hit_tiers(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(scoring.TIERS["pIC50"].column(F.col("p_size") / 6.0).alias("tier")).agg(F.count("*").alias("n"))


@query
def tier_counts(spark, sf_dir):
    size = F.col("p_size")
    values = {"pIC50": size / 6.0, "qed": size / 50.0, "sa": size / 6.0, "bbb": size / 50.0, "docking": -(size / 5.0)}
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), scoring.TIERS[m].column(x).alias("tier")) for m, x in values.items())))
    return read(spark, sf_dir, "part").select(long.alias("x")).groupBy("x.metric", "x.tier").agg(F.count("*").alias("n"))


@query
def outcome_counts(spark, sf_dir):
    return stats.outcome_counts(read(spark, sf_dir, "orders"), F.nullif("o_orderstatus", F.lit("P")) == "F", "o_orderpriority")


@query
def alternative_names(spark, sf_dir):
    rows = [read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("smiles")), read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ID"), F.col("r_name").alias("canonical"))]
    return frames.union_tables([frames.first_of(frames.first_of(df, "id", "mol_id", "ID"), "smiles", "canonical") for df in rows])


@query
def mean_vectors(spark, sf_dir):
    means = stats.mean_vector(read(spark, sf_dir, "embeddings").withColumn("v", F.slice("embedding", 1, 3)), "label", "v")
    return means.select("label", *(r6(F.get("mean", F.lit(i))).alias(f"m{i}") for i in range(3)))


@query
def docking_summary(spark, sf_dir):
    out = stats.score_summary(read(spark, sf_dir, "orders"), -(F.col("o_totalprice") / 30000))
    return out.withColumns({"mean_score": r6("mean_score"), "best_score": r6("best_score")})


@query
def parse_score_text(spark, sf_dir):
    score = F.format_string("%.3f", -(F.col("p_size") / 10.0))
    remark = F.when(F.col("p_size") % 5 == 0, F.lit("REMARK  no result")).otherwise(F.concat(F.lit("REMARK VINA RESULT:    "), score, F.lit("      0.000      0.000\nREMARK VINA RESULT:  -0.1 1.0 2.0")))
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("/run/lig_"), F.col("p_partkey").cast("string"), F.lit("_dock.pdbqt")).alias("path"), F.concat(F.lit("MODEL 1\n"), remark, F.lit("\nENDMDL\n")).alias("value"))
    return docking.parse_results(files)


@query
def cascade_scores(spark, sf_dir):
    part, kind = read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    shown = lambda by, text: F.format_string(text, -(F.col("p_size") / by))
    log = F.when(kind == 0, shown(10.0, "mode | affinity\n   1   %.1f  0.000  0.000\n"))
    stdout = F.when(kind <= 1, shown(5.0, "   1   %.1f  0.000  0.000\n")).otherwise("no modes\n")
    return part.select("p_partkey", text_results.cascade_score(log, stdout, shown(2.0, "REMARK VINA RESULT:  %.1f  0.000\n")).alias("docking_score"))


@query
def prepared_ligands(spark, sf_dir):
    kind, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("ROOT\nATOM "), key, F.lit("\nENDROOT\nROOT\nENDROOT\nTORSDOF 2"))).when(kind == 1, F.concat(F.lit("ROOT\nATOM "), key, F.lit("\nENDROOT\nTORSDOF 3"))).otherwise("REMARK no atoms")
    return docking.prepare_ligands(read(spark, sf_dir, "part").select("p_partkey", text.alias("value")))


@query
def prepared_receptors(spark, sf_dir):
    text = F.concat(F.lit("ATOM  "), F.col("s_suppkey").cast("string"), F.lit("\nROOT\nTER\nHETATM 1\nBRANCH 1 2\nEND"))
    return docking.prepare_receptors(read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value")))


def _molecules(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as molecules: their lines are bonds between six atoms."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol"), (F.col("l_partkey") % 6 + 1).cast("int").alias("a"), (F.col("l_suppkey") * 7 % 6 + F.col("l_linenumber") % 3 + 1).cast("int").alias("b"), (F.col("l_linenumber") % 3 + 1).alias("kind")).repartition("mol")
    bonds = lines.filter("a <> b").groupBy("mol", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("kind").cast("int").alias("kind"))
    atoms = graphs.both_ways(lines, ["mol"]).select("mol", F.col("node").alias("atom")).distinct()
    return atoms.withColumns({"element": F.element_at(F.array(*map(F.lit, "CNOS")), F.col("atom") % 4 + 1), "x": F.col("atom") / 4, "y": -(F.col("atom") / 2), "z": F.lit(0.5)}), bonds


@query
def ring_counts(spark, sf_dir):
    return molecules.ring_counts(*_molecules(spark, sf_dir))


@query
def scaffold_bonds(spark, sf_dir):
    return molecules.scaffold_bonds(_molecules(spark, sf_dir)[1])


@query
def scaffold_groups(spark, sf_dir):
    keys = molecules.scaffold_keys(*_molecules(spark, sf_dir))
    first = keys.groupBy("scaffold").agg(F.min("mol").alias("first_mol"), F.count("*").alias("n"))
    return keys.join(first, "scaffold").select("mol", "first_mol", "n", (F.col("scaffold") == "").alias("no_ring"))


@query
def atom_surroundings(spark, sf_dir):
    atoms, bonds = _molecules(spark, sf_dir)
    return graphs.surrounding_kinds(atoms, bonds, ["mol"], F.col("element"), 3, "atom", kind="kind")


@query
def molecule_records(spark, sf_dir):
    path = _scratch(spark, "molecules")
    atoms, bonds = _molecules(spark, sf_dir)
    texts = molecules.format_records(atoms.select("mol").distinct().withColumn("name", F.col("mol").cast("string")), atoms, bonds, "mol", "name")
    tables.write_lines(texts.select(F.concat("value", F.lit("\n>  <ID>\n"), F.col("mol").cast("string"), F.lit("\n\n$$$$")).alias("value")), "value", path)
    parsed = molecules.parse_records(tables.read_records(spark, path)).withColumn("mol", F.element_at("fields", "ID").cast("long"))
    a = molecules.atom_rows(parsed, "mol").groupBy("mol").agg(F.count("*").alias("n_atoms"), F.count_if(F.col("element") == "C").alias("n_carbon"), r6(F.sum("x")).alias("sum_x"), r6(F.sum("y")).alias("sum_y"))
    b = molecules.bond_rows(parsed, "mol").groupBy("mol").agg(F.count("*").alias("n_bonds"), F.sum(F.col("a") * 100 + F.col("b") * 10 + F.col("kind")).alias("bond_sum"))
    return a.join(b, "mol", "left")


@query
def columns_side_by_side(spark, sf_dir):
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return frames.concat_columns([nations.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), regions.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))], "k")


@query
def records_roundtrip(spark, sf_dir):
    path = _scratch(spark, "records")
    tables.write_lines(read(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("\nM  END\n$$$$")).alias("record")), "record", path)
    return tables.read_records(spark, path)


@query
def parse_atom_lines(spark, sf_dir):
    place = lambda i: F.format_string("%8.3f", F.floor(F.get("embedding", F.lit(i)).cast("double") * 1000) / 1000)
    name = F.format_string("ATOM  %5d  CA  R%02d A   1    ", (F.col("vec_id") % 100000).cast("int"), (F.col("label") % 100).cast("int"))
    lines = read(spark, sf_dir, "embeddings").select("vec_id", F.concat(name, place(0), place(1), place(2), F.lit("  1.00  0.00    +0.000 C ")).alias("value"))
    return stats.centroid(docking.atom_table(lines, "vec_id"), "residue").select("residue", "n", *(r6(c).alias(c) for c in ("cx", "cy", "cz")))


def _bits(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", similarity.pack_signs(F.col("embedding"), 64).alias("bits"))


@query
def tanimoto_pairs(spark, sf_dir):
    x = _bits(spark, sf_dir)
    pairs = search.similar_pairs(x.withColumnRenamed("vec_id", "id_a"), x.withColumnRenamed("vec_id", "id_b"), "id_a", "id_b", least=0.6)
    return pairs.filter("id_a < id_b").withColumn("similarity", r6("similarity"))


@query
def novelty_filter(spark, sf_dir):
    x = _bits(spark, sf_dir)
    return search.novel(x.filter("vec_id % 2 = 1"), x.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "known"), "vec_id", "known", most=0.6).select("vec_id")


@query
def diversity_mean(spark, sf_dir):
    return search.diversity(_bits(spark, sf_dir), "vec_id").withColumn("mean_similarity", r6("mean_similarity"))


@query
def cosine_nearest(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(x.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "query_id"), x.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "row_id"), "query_id", "row_id", "embedding")


@query
def cosine_nearest_whole(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(x.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), x.withColumnRenamed("vec_id", "row_id"), "query_id", "row_id", "embedding", skip_same=True)


@query
def cosine_nearest_index(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return VectorIndex.build(x, "vec_id", "embedding").search(x.filter("vec_id % 50 = 0"), "vec_id", "embedding", exact=True, skip_same=True)


@query
def novelty_filter_whole(spark, sf_dir):
    x = _bits(spark, sf_dir)
    return search.novel(x.filter("vec_id % 50 = 0"), x.withColumnRenamed("vec_id", "known"), "vec_id", "known", most=0.6, skip_same=True).select("vec_id")


@query
def valid_novel_percent(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").select("vec_id", "label", similarity.pack_signs(F.col("embedding"), 64).alias("bits"), (F.get("embedding", F.lit(0)) > 0).alias("valid"))
    known = x.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("known"), "bits")
    kept = search.novel(x.filter("valid"), known, "vec_id", "known", most=0.5)
    return stats.kept_percent(x, kept, "label").withColumn("percent", r6("percent"))


@query
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(read(spark, sf_dir, "lineitem"), CORRELATED).withColumn("corr", r6("corr"))


def _wide(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """The places of the vectors as columns, and near copies of some of them."""
    rows = read(spark, sf_dir, "embeddings")
    place = lambda i: F.get("embedding", F.lit(i)).cast("double")
    columns = {f"e{i}": place(i) for i in range(64)} | {f"f{i}": place(i) * 3 + place((i + 1) % 64) / 4 for i in range(0, 64, 4)}
    return rows.select(*(c.alias(k) for k, c in columns.items())), list(columns)


@query
def correlation_blocks(spark, sf_dir):
    rows, names = _wide(spark, sf_dir)
    return stats.correlation_matrix(rows, names).select("column_a", "column_b", r6("corr").alias("corr"))


@query
def uncorrelated_columns(spark, sf_dir):
    rows, names = _wide(spark, sf_dir)
    kept = stats.select_uncorrelated(rows, names, 0.9)
    return rows.select(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")).alias(c) for c in kept)).select(F.explode(F.array(*kept)).alias("x")).groupBy("x.feature").agg(r6(F.avg("x.value")).alias("mean"))


@query
def greedy_feature_select(spark, sf_dir):
    kept = stats.select_uncorrelated(read(spark, sf_dir, "lineitem"), CORRELATED, 0.9)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "position int, feature string")


@query
def group_budget_split(spark, sf_dir):
    return frames.group_budget_split(read(spark, sf_dir, "part"), "p_brand")


@query
def hash_split_80_20(spark, sf_dir):
    return frames.hash_split(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query
def hash_sample_n(spark, sf_dir):
    return frames.hash_sample(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query
def quartile_pairs(spark, sf_dir):
    return frames.preference_pairs(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice")


@query
def regression_metrics(spark, sf_dir):
    out = stats.regression_metrics(read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return out.select("n", r6("rmse").alias("rmse"), r6("r2").alias("r2"))


@query
def standardise_pop(spark, sf_dir):
    return stats.standardise(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", r6("z").alias("z"))


@query
def generation_metrics(spark, sf_dir):
    out = stats.generation_metrics(read(spark, sf_dir, "documents"), "text", F.col("n_chars") > 200, ["n_chars"])
    return out.withColumns({c: r6(c) for c in ("validity", "uniqueness", "diversity", "mean_n_chars")})


@query
def ordered_distinct_cap(spark, sf_dir):
    return frames.ordered_distinct(read(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id", 100)


@query
def dataset_fingerprint(spark, sf_dir):
    return stats.table_fingerprint(read(spark, sf_dir, "nation"), "n_name")


@query
def sorted_digest(spark, sf_dir):
    return stats.sorted_digest(read(spark, sf_dir, "part"), "p_name")


@query
def token_sampling(spark, sf_dir):
    rows, key = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    pick = lambda seed, **how: sampling.choose(F.col("embedding"), sampling.seeded_uniform(key, seed), **how)
    return rows.select("vec_id", pick(1).alias("plain"), pick(2, temperature=0.1).alias("cold"), pick(3, top_k=5).alias("top_k"), pick(4, temperature=0.5, top_p=0.3).alias("top_p"))


@query
def standard_residues(spark, sf_dir):
    text = F.concat(F.lit("HEADER x\nATOM  "), F.col("s_suppkey").cast("string"), F.lit("\nHETATM 1 HOH\nANISOU 1\nTER\nATOM  2\nEND"))
    return docking.prepare_receptors(read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value")), standard_only=True)


@query
def log_scores(spark, sf_dir):
    size = F.col("p_size")
    log = F.when(size % 4 == 0, F.format_string("mode\n   1   -%d   0.0 0.0\n", size)).when(size % 4 == 1, F.format_string("10 -1\n 1 none\n1 -%d.5 1 2\n1 -3", size)).when(size % 4 == 2, "1\t-4 0 0\n 1")
    return read(spark, sf_dir, "part").select("p_partkey", text_results.log_score(log).alias("docking_score"))


@query
def vocabulary(spark, sf_dir):
    return tokens.vocabulary(read(spark, sf_dir, "documents"), F.split(F.lower("text"), " "))


@query
def token_encode(spark, sf_dir):
    parts, words = read(spark, sf_dir, "part"), F.split(F.lower("p_name"), " ")
    encoded = tokens.encode(parts, "p_partkey", words, tokens.vocabulary(parts, words), 6)
    return encoded.select("p_partkey", F.array_join("ids", ",").alias("ids"))


@query
def clean_text_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", cleaning.strip_short(F.col("html")).alias("text"))


@query
def histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "part"), "p_retailprice", 900, 10)


@query
def report_format(spark, sf_dir):
    top = read(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(40).select("p_partkey", (F.col("p_partkey") % 10 / 10.0).alias("QED"), (F.col("p_partkey") % 7).alias("HBD"), (-(F.col("p_size") / 7.0)).alias("docking_score"), F.nullif(F.col("p_size") % 9, F.lit(4)).alias("LLE"), F.col("p_size").alias("other"))
    return ranking.parameter_table(top, "p_partkey", {"QED": 2, "HBD": None, "docking_score": 1, "LLE": 1, "other": 2})


@query
def metrics_union(spark, sf_dir):
    one = lambda name, table, **columns: read(spark, sf_dir, table).agg(F.count("*").alias("n_train"), *(F.round(f, 4).alias(k) for k, f in columns.items())).withColumn("model", F.lit(name))
    return frames.union_tables([one("orders", "orders", rmse_train=F.avg("o_totalprice")), one("part", "part", r2_test=F.avg("p_retailprice")), one("supplier", "supplier", rmse_train=F.avg("s_acctbal"), r2_test=F.max("s_acctbal"))])


@query
def linear_fit_score(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    model = linear.fit_linear(rows, FEATURES, "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", model.column().alias("predicted"))


@query
def coef_top20(spark, sf_dir):
    return linear.fit_linear(read(spark, sf_dir, "lineitem"), FEATURES, "l_extendedprice").importance(spark)


@query
def bulk_predict(spark, sf_dir):
    folder = _scratch(spark, "models")
    linear.LinearModel(FEATURES, (2.0, -30.0, 10.0, 0.5), 4.0).save(spark, f"{folder}/linear")
    rows = read(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(3)))
    scored = linear.predict(rows.select("l_orderkey", "l_partkey", "l_suppkey", *FEATURES), linear.load_model(spark, f"{folder}/boosted", f"{folder}/linear"))
    return scored.select("l_orderkey", "l_partkey", "l_suppkey", F.isnan("predicted").alias("invalid"), F.when(~F.isnan("predicted"), r6("predicted")).alias("predicted"))


@query
def bit_model_scores(spark, sf_dir):
    model = linear.BitModel(tuple((i % 7 - 3) / 2 for i in range(64)), 0.25)
    return model.score(_bits(spark, sf_dir), "bits").select("vec_id", "predicted")


@query
def bit_model_fit(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(similarity.pack_signs(F.slice("embedding", 1, 1), 64).alias("bits"), F.col("label"))
    model = linear.BitModel.fit(rows, "bits", "label", 64, l2=0.0001)
    return spark.createDataFrame([(model.weights[0], model.bias)], "weight double, bias double").select(r6("weight").alias("weight"), r6("bias").alias("bias"))


@query
def group_split_fit(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("step", F.col("p_partkey") % 1000)
    side = frames.group_budget_split(parts, "p_brand")
    dealt = parts.join(side.select("p_brand", "in_test"), "p_brand")
    _, judged = linear.fit_and_judge(dealt.filter("NOT in_test"), dealt.filter("in_test"), ("p_size", "step"), "p_retailprice")
    return judged.select("part", "n")


@query
def cached_scores(spark, sf_dir):
    cache = TableCache(spark, _scratch(spark, "cache"))
    sizes = lambda df: df.select("p_partkey", (F.col("p_size") * 2).alias("twice"))
    parts = read(spark, sf_dir, "part")
    cache.fetch(parts, "p_partkey", "sizes", sizes)
    return cache.fetch(parts.orderBy("p_size"), "p_partkey", "sizes", lambda df: sizes(df).limit(0))  # the same values in another order: read, not computed


@query
def cache_inventory(spark, sf_dir):
    cache = TableCache(spark, _scratch(spark, "cache"))
    for kind, table, key in (("names", "nation", "n_name"), ("names", "region", "r_name"), ("sizes", "part", "p_partkey")):
        cache.fetch(read(spark, sf_dir, table), key, kind, lambda df: df)
    return cache.inventory().select("kind", "entries", (F.col("bytes") > 0).alias("has_bytes"))


@query
def csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "nation.csv")
    tables.write_table(read(spark, sf_dir, "nation"), path)
    return tables.read_table(spark, path, ["n_name"], "n_nationkey int, n_name string, n_regionkey int")


@query
def text_roundtrip(spark, sf_dir):
    path = _scratch(spark, "nation_names")
    tables.write_lines(read(spark, sf_dir, "nation"), "n_name", path)
    return tables.read_lines(spark, path)


@query
def json_roundtrip(spark, sf_dir):
    path = _scratch(spark, "regions")
    tables.write_json(read(spark, sf_dir, "region"), path)
    return spark.read.json(path).select("r_regionkey", "r_name")


@query
def annealing_schedule(spark, sf_dir):
    step = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(step)
    return rows.select(step.alias("step"), r6(reporting.cyclical(step, 2000)).alias("cyclical"), r6(reporting.monotonic(step, 1000)).alias("monotonic"), r6(reporting.sigmoid(step, 1000)).alias("logistic"), r6(reporting.after_warmup(step, 3000, 1000)).alias("after_warmup"), r6(reporting.rising(step, 3000, 0.0025)).alias("rising"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desirability_composite_top5(spark, sf_dir)
