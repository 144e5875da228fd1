"""The queries of plans/queries.py as SQL for DuckDB, written on their own: they share with them only the metrics, which are plain SQL expressions."""

from __future__ import annotations

#: Metrics of line items: expressions that reach every branch of the scores.
LINE = {
    "CNS_MPO": "l_quantity / 8", "logBB_est": "l_quantity / 25 - 1.5", "pgp_efflux": "l_quantity / 20", "bcrp_efflux": "l_tax * 25 + 0.5", "Kp_uu_brain": "l_discount * 12", "MW": "l_extendedprice / 100",
    "LogP": "l_quantity / 10", "cLogD_74": "l_quantity / 12", "TPSA": "l_quantity * 2", "HBD": "l_tax * 50", "HBA": "l_discount * 100", "RotB": "l_quantity / 5", "docking_score": "-(l_quantity / 5)",
    "LE": "l_discount * 4", "LLE": "l_quantity / 8", "BEI": "l_quantity * 1", "herg_blocker": "l_discount * 4", "cyp3a4_inhib": "l_discount * 6", "cyp2d6_inhib": "l_tax * 8", "hepatotox": "l_tax * 5",
    "ames_mutagen": "l_discount * 3.5", "GSH_reactivity": "l_discount * 2.5", "MAOB_inhib": "l_tax * 4", "HT2A_binding": "l_discount * 4.5", "BACE1_selectivity": "l_tax * 9", "QED": "l_tax * 12", "SA": "l_quantity / 7", "rings": "l_linenumber * 1",
}
#: The same of parts.
PART = {k: v.replace("l_quantity", "p_size").replace("l_extendedprice", "p_retailprice").replace("l_discount", "(p_partkey % 11) / 100").replace("l_tax", "(p_partkey % 9) / 100").replace("l_linenumber", "(p_partkey % 7)") for k, v in LINE.items()}


def _more(x: str, low: float, target: float) -> str:
    return f"CASE WHEN {x} >= {target}::DOUBLE THEN 1.0::DOUBLE WHEN {x} <= {low}::DOUBLE THEN 0.0::DOUBLE ELSE ({x} - ({low}::DOUBLE)) / {target - low}::DOUBLE END"


def _less(x: str, target: float, high: float) -> str:
    return f"CASE WHEN {x} <= {target}::DOUBLE THEN 1.0::DOUBLE WHEN {x} >= {high}::DOUBLE THEN 0.0::DOUBLE ELSE ({high}::DOUBLE - {x}) / {high - target}::DOUBLE END"


def _near(x: str, low: float, best: float, high: float) -> str:
    return f"CASE WHEN {x} <= {best}::DOUBLE THEN {_more(x, low, best)} ELSE {_less(x, best, high)} END"


def _parts(m: dict[str, str]) -> dict[str, tuple[str, int]]:
    x = {k: f"(({v})::DOUBLE)" for k, v in m.items()}
    return {
        "d_mpo": (_more(x["CNS_MPO"], 3, 5), 3), "d_logBB": (_more(x["logBB_est"], -1, -0.3), 3), "d_pgp": (_less(x["pgp_efflux"], 1, 2), 3), "d_bcrp": (_less(x["bcrp_efflux"], 1, 2), 3),
        "d_kp_brain": (_more(x["Kp_uu_brain"], 0.3, 0.8), 3), "d_mw": (_near(x["MW"], 250, 350, 400), 1), "d_logp": (_near(x["LogP"], 1, 2.8, 4), 1), "d_clogd": (_near(x["cLogD_74"], 1, 2.5, 3.5), 1),
        "d_tpsa": (_near(x["TPSA"], 40, 60, 80), 1), "d_hbd": (_less(x["HBD"], 0, 2), 1), "d_hba": (_less(x["HBA"], 2, 7), 1), "d_rotb": (_less(x["RotB"], 0, 7), 1),
        "d_dock": (_more(f"(-{x['docking_score']})", 6, 8), 2), "d_le": (_more(x["LE"], 0.2, 0.35), 2), "d_lle": (_more(x["LLE"], 3, 5), 2), "d_bei": (_more(x["BEI"], 15, 25), 2),
        "d_herg": (_less(x["herg_blocker"], 0.2, 0.3), 2), "d_cyp3a4": (_less(x["cyp3a4_inhib"], 0.3, 0.5), 2), "d_cyp2d6": (_less(x["cyp2d6_inhib"], 0.3, 0.5), 2), "d_hepatotox": (_less(x["hepatotox"], 0.2, 0.3), 2),
        "d_ames": (_less(x["ames_mutagen"], 0.2, 0.3), 2), "d_gsh": (_less(x["GSH_reactivity"], 0.1, 0.2), 2), "d_maob": (_less(x["MAOB_inhib"], 0.2, 0.3), 1), "d_ht2a": (_less(x["HT2A_binding"], 0.2, 0.3), 1),
        "d_bace1": (_less(x["BACE1_selectivity"], 0.3, 0.5), 1),
    }


def _composite(m: dict[str, str]) -> str:
    return "exp((" + " + ".join(f"{w} * ln({sql} + 1e-9)" for sql, w in _parts(m).values()) + ") / 45.0::DOUBLE)"


def _m(name: str, table: dict[str, str] = PART) -> str:
    return f"(({table[name]})::DOUBLE)"


_SIGMOID = "1.0::DOUBLE / (1.0::DOUBLE + exp(-({})))"
_BBB = _SIGMOID.format(f"-1.436::DOUBLE + {_m('LogP')} * 0.345::DOUBLE - {_m('TPSA')} * 0.0123::DOUBLE - {_m('MW')} * 0.014::DOUBLE - {_m('HBD')} * 0.026::DOUBLE - {_m('HBA')} * 0.047::DOUBLE")
_CYP = _SIGMOID.format(f"-5.0::DOUBLE + {_m('LogP')} * 1.2::DOUBLE + {_m('MW')} * 0.02::DOUBLE + {_m('rings')} * 0.6::DOUBLE")
_LIVER = _SIGMOID.format(f"-3.0::DOUBLE + {_m('LogP')} * 0.8::DOUBLE + {_m('MW')} * 0.01::DOUBLE + {_m('HBA')} * 0.05::DOUBLE + {_m('rings')} * 0.5::DOUBLE")


def _line(name: str) -> str:
    return _m(name, LINE)


_RULES = f"""least(1.0::DOUBLE, greatest(0.0::DOUBLE,
  CASE WHEN {_line("TPSA")} <= 132 AND {_line("LogP")} <= 5.9 THEN 0.4::DOUBLE WHEN {_line("TPSA")} <= 140 AND {_line("LogP")} <= 5.0 THEN 0.3::DOUBLE WHEN {_line("TPSA")} <= 150 AND {_line("LogP")} <= 4.0 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN {_line("RotB")} <= 10 AND {_line("TPSA")} <= 140 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN {_line("MW")} BETWEEN 150 AND 500 THEN 0.2::DOUBLE WHEN {_line("MW")} BETWEEN 100 AND 600 THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN {_line("HBD")} <= 3 AND {_line("HBA")} <= 7 THEN 0.1::DOUBLE WHEN {_line("HBD")} <= 5 AND {_line("HBA")} <= 10 THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN {_line("LogP")} BETWEEN 1 AND 4 THEN 0.1::DOUBLE WHEN {_line("LogP")} BETWEEN 0.5 AND 5 THEN 0.05::DOUBLE ELSE 0 END))"""
_ACT = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (l_quantity / 5.0::DOUBLE - 5) / 3.0::DOUBLE))"
_BITS = "(SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
_TANIMOTO = "list_sum(list_transform(list_zip(a.b, c.b), lambda z: z[1] * z[2])) / list_sum(list_transform(list_zip(a.b, c.b), lambda z: greatest(z[1], z[2])))::DOUBLE"
_UNIT = "CASE event_id % 6 WHEN 0 THEN 'nM' WHEN 1 THEN 'NM' WHEN 2 THEN 'uM' WHEN 3 THEN 'μM' WHEN 4 THEN 'µM' ELSE '%' END"
_NM = "CASE translate(lower(unit), 'μµ', 'uu') WHEN 'nm' THEN value WHEN 'um' THEN value * 1000 END"
_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")


def _quartile(q: float, table: str, column: str) -> str:
    return f"(SELECT {column} FROM (SELECT {column}, row_number() OVER (ORDER BY {column}) - 1 AS rn, count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL) WHERE rn = floor((n - 1) * {q} + 0.5))"


def _pass(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) FILTER ({sql}) AS passed, round(100.0::DOUBLE * count(*) FILTER ({sql}) / count(*), 6) AS percent FROM lineitem"


_LIPINSKI = {"MW": f"{_line('MW')} <= 500", "LogP": f"{_line('LogP')} <= 5", "HBD": f"{_line('HBD')} <= 5", "HBA": f"{_line('HBA')} <= 10", "TPSA": f"{_line('TPSA')} <= 140"}
_CNS = {"MW": f"{_line('MW')} <= 450", "LogP": f"{_line('LogP')} <= 3", "TPSA": f"{_line('TPSA')} <= 90", "RotB": f"{_line('RotB')} <= 3", "CNS_MPO": f"{_line('CNS_MPO')} >= 4"}
_STRICT = [f"{_line(k)} {c}" for k, c in (("MW", "<= 450"), ("LogP", "BETWEEN 1 AND 4"), ("TPSA", "< 70"), ("HBD", "<= 3"), ("HBA", "<= 7"), ("RotB", "<= 8"), ("QED", "BETWEEN 0.4 AND 0.8"), ("CNS_MPO", ">= 4"), ("logBB_est", "> -0.3"), ("pgp_efflux", "< 2"), ("docking_score", "< -8"), ("herg_blocker", "< 0.3"), ("SA", "< 5"))]

SQL = {
    "desirability_components": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({s}, 6) AS {n}" for n, (s, _) in _parts(LINE).items()) + " FROM lineitem",
    "desirability_composite": f"SELECT l_orderkey, l_linenumber, round({_composite(LINE)}, 6) AS composite FROM lineitem",
    "desirability_composite_top5": f"SELECT p_partkey, round({_composite(PART)}, 6) AS composite FROM part WHERE p_retailprice IS NOT NULL ORDER BY {_composite(PART)} DESC, p_partkey LIMIT 5",
    "desirability_breakdown": f"WITH t AS (SELECT *, {_composite(PART)} AS s FROM part ORDER BY s DESC, p_partkey LIMIT 5) " + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS component, round({s}, 6) AS value FROM t" for n, (s, _) in _parts(PART).items()),
    "iqr_outlier_fence": f"WITH f AS (SELECT {_quartile(0.25, 'events', 'value')} AS a, {_quartile(0.75, 'events', 'value')} AS b) SELECT event_id, value FROM events, f WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
    "clean_activity": f"""WITH r AS (SELECT user_id, value, {_UNIT} AS unit, event_type AS kind FROM events),
m AS (SELECT user_id, {_NM} AS nanomolar, kind, lower(unit) AS unit FROM r),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nanomolar, kind, unit) AS rn FROM m WHERE nanomolar IS NOT NULL) WHERE rn = 1 AND nanomolar > 0),
f AS (SELECT {_quartile(0.25, 'k', 'nanomolar')} AS a, {_quartile(0.75, 'k', 'nanomolar')} AS b)
SELECT user_id, nanomolar, kind, unit FROM k, f WHERE nanomolar BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
    "unit_normalise": f"WITH r AS (SELECT event_id, value, {_UNIT} AS unit FROM events) SELECT event_id, translate(lower(unit), 'μµ', 'uu') AS unit, {_NM} AS nanomolar FROM r",
    "pic50_transform": "SELECT o_orderkey, round(9 - log10(o_totalprice), 6) AS pic50 FROM orders WHERE o_totalprice > 0",
    "dedupe_keep_min": "SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "dedupe_keep_first": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "not_null_conjunction": "SELECT c_custkey, c_name FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND nullif(c_nationkey, 3) IS NOT NULL",
    "in_list_filter": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "positive_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
    "left_join_scores": "SELECT c_custkey, docking_score FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS docking_score FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "lookup_default": "SELECT s_suppkey, coalesce(n_name, '') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON s_nationkey = n_nationkey",
    "semi_join_keep": "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)",
    "union_distinct_capped": "SELECT c_nationkey AS nationkey FROM customer UNION SELECT * FROM (SELECT s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 1000)",
    "override_union": """WITH f AS (SELECT p_partkey, p_retailprice AS score FROM part), n AS (SELECT greatest(1, floor(count(*) * 0.1)) AS n FROM f),
b AS (SELECT p_partkey, score * 2 AS score FROM (SELECT *, row_number() OVER (ORDER BY score, p_partkey) AS rn FROM f) WHERE rn <= (SELECT n FROM n))
SELECT coalesce(f.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.score, f.score) AS score FROM f FULL JOIN b ON f.p_partkey = b.p_partkey""",
    "inner_lookup": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000",
    "top_fraction": "SELECT p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER () AS n FROM part) WHERE rn <= greatest(1, floor(n * 0.1))",
    "rank_hits": "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rank FROM supplier",
    "top_hits": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10",
    "positional_ids": "SELECT p_partkey, 'lig_' || (row_number() OVER (ORDER BY p_partkey) - 1) AS id_ligand FROM part",
    "bbb_probability": f"SELECT p_partkey, round({_BBB}, 6) AS bbb FROM part",
    "cyp_probability": "SELECT p_partkey, " + ", ".join(f"round({_CYP}, 6) AS cyp{i}_prob" for i in ("1A2", "2C9", "2C19", "2D6", "3A4")) + " FROM part",
    "hepatotox_probability": f"SELECT p_partkey, round({_LIVER}, 6) AS hepatotox_prob FROM part",
    "bbbp_rule_score": f"SELECT l_orderkey, l_linenumber, round({_RULES}, 6) AS bbbp FROM lineitem",
    "generation_score": f"SELECT l_orderkey, l_linenumber, round(0.35::DOUBLE * {_ACT} + 0.2::DOUBLE * {_line('QED')} + 0.15::DOUBLE * greatest(0.0::DOUBLE, (5 - {_line('SA')}) / 4) + 0.25::DOUBLE * {_RULES} + 0.05::DOUBLE * least(1.0::DOUBLE, 0.8::DOUBLE * {_ACT}), 6) AS score FROM lineitem",
    "sa_heuristic_a": "SELECT p_partkey, round(least(10.0::DOUBLE, greatest(1.0::DOUBLE, 1.0::DOUBLE + CASE WHEN p_size > 50 THEN 2 WHEN p_size > 30 THEN 1.5 WHEN p_size > 20 THEN 1 ELSE 0 END::DOUBLE + 0.5::DOUBLE * (p_partkey % 9) + 0.8::DOUBLE * (p_partkey % 8 % 3) + 0.3::DOUBLE * (p_partkey % 5) + (p_partkey % 2) + 0.8::DOUBLE * (p_partkey % 3) + 0.4::DOUBLE * (p_partkey % 4) + 0.2::DOUBLE * (p_partkey % 6) + 0.3::DOUBLE * (p_partkey % 7))), 6) AS sa FROM part",
    "sa_heuristic_b": "SELECT p_partkey, round(least(6.0::DOUBLE, greatest(1.0::DOUBLE, 1.5::DOUBLE + 0.4::DOUBLE * (p_partkey % 9) + 0.3::DOUBLE * (p_partkey % 6) / greatest(1, p_size) + 0.5::DOUBLE * (p_partkey % 4) + 0.2::DOUBLE * (p_partkey % 3) + CASE WHEN p_size > 30 THEN 0.1::DOUBLE * (p_size - 30) / 10 ELSE 0 END)), 6) AS sa FROM part",
    "dpo_score": f"SELECT p_partkey, round(0.2::DOUBLE * {_m('QED')} + 0.1::DOUBLE * greatest(0.0::DOUBLE, 1 - p_retailprice / 100 / 10) + 0.3::DOUBLE * (p_size / 8.0::DOUBLE) + 0.4::DOUBLE / (1 + abs({_m('LogP')} - 2.5)), 6) AS score FROM part",
    "docking_reward": f"SELECT p_partkey, round(0.4::DOUBLE * greatest(0.0::DOUBLE, -{_m('docking_score')} / 10) + 0.3::DOUBLE * (p_size / 8.0::DOUBLE) + 0.2::DOUBLE * {_m('QED')} + 0.1::DOUBLE, 6) AS reward FROM part",
    "rule_pass_rates": " UNION ALL ".join(_pass(f"{kind}_{k}", v) for kind, rules in (("lipinski", _LIPINSKI), ("cns", _CNS)) for k, v in (rules | {"all": " AND ".join(rules.values())}).items()),
    "criteria_passed": "SELECT passed, count(*) AS n FROM (SELECT " + " + ".join(f"({c})::INT" for c in _STRICT) + " AS passed FROM lineitem) GROUP BY 1",
    "hit_tiers": "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN p_size / 6.0 >= 7 THEN 'best' WHEN p_size / 6.0 >= 6 THEN 'good' WHEN p_size / 6.0 >= 5 THEN 'fair' ELSE 'low' END AS tier FROM part) GROUP BY 1",
    "docking_summary": "SELECT count(*) AS n, round(avg(-(o_totalprice / 30000)), 6) AS mean_score, round(min(-(o_totalprice / 30000)), 6) AS best_score, count(*) FILTER (-(o_totalprice / 30000) <= -7) AS at_cut FROM orders",
    "parse_score_text": "SELECT 'lig_' || p_partkey AS id_ligand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE -(p_size / 10.0::DOUBLE) END AS docking_score FROM part",
    "cascade_scores": "SELECT p_partkey, -(p_size / CASE p_partkey % 3 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 5.0 ELSE 2.0 END) AS docking_score FROM part",
    "prepared_ligands": "SELECT p_partkey, 'ROOT' || chr(10) || 'ATOM ' || p_partkey || chr(10) || 'ENDROOT' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN 'TORSDOF 0' || chr(10) ELSE 'TORSDOF 3' END AS value FROM part WHERE p_partkey % 3 < 2",
    "prepared_receptors": "SELECT s_suppkey, 'ATOM  ' || s_suppkey || chr(10) || 'TER' || chr(10) || 'HETATM 1' || chr(10) || 'END' AS value FROM supplier",
    "columns_side_by_side": "SELECT n_nationkey AS k, n_name AS name, r_name AS t2_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
    "records_roundtrip": "SELECT n_name || chr(10) || 'M  END' || chr(10) AS value FROM nation",
    "parse_atom_lines": "SELECT residue, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM (SELECT 'R' || lpad((label % 100)::VARCHAR, 2, '0') AS residue, floor(embedding[1]::DOUBLE * 1000) / 1000 AS x, floor(embedding[2]::DOUBLE * 1000) / 1000 AS y, floor(embedding[3]::DOUBLE * 1000) / 1000 AS z FROM embeddings) GROUP BY 1",
    "tanimoto_pairs": f"SELECT a.vec_id AS id_a, c.vec_id AS id_b, round({_TANIMOTO}, 6) AS similarity FROM {_BITS} a JOIN {_BITS} c ON a.vec_id < c.vec_id WHERE {_TANIMOTO} >= 0.6",
    "novelty_filter": f"SELECT vec_id FROM embeddings WHERE vec_id % 2 = 1 AND vec_id NOT IN (SELECT a.vec_id FROM {_BITS} a JOIN {_BITS} c ON a.vec_id % 2 = 1 AND c.vec_id % 2 = 0 WHERE {_TANIMOTO} >= 0.6)",
    "diversity_mean": f"WITH s AS (SELECT * FROM {_BITS} ORDER BY md5('42|' || vec_id), vec_id LIMIT 500) SELECT count(*) AS n_pairs, round(coalesce(avg({_TANIMOTO}), 0), 6) AS mean_similarity FROM s a JOIN s c ON md5('42|' || a.vec_id) <> md5('42|' || c.vec_id) AND a.vec_id < c.vec_id",
    "cosine_nearest": "SELECT query_id, arg_max(row_id, (s, -row_id)) AS row_id, max(s) AS similarity FROM (SELECT a.vec_id AS query_id, c.vec_id AS row_id, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings c ON a.vec_id % 2 = 1 AND c.vec_id % 2 = 0) GROUP BY 1",
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr({a}, {b}), 0), 6) AS corr FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]),
    "group_budget_split": """WITH RECURSIVE s AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY md5('42|' || p_brand), p_brand) AS rn FROM part GROUP BY 1),
b AS (SELECT floor(sum(n) * 0.2) AS budget FROM s),
w AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS p_brand, 0::BIGINT AS n, 0::BIGINT AS used, false AS in_test UNION ALL
  SELECT s.rn, s.p_brand, s.n, CASE WHEN w.used + s.n <= budget THEN w.used + s.n ELSE w.used END, w.used + s.n <= budget FROM w JOIN s ON s.rn = w.rn + 1, b)
SELECT p_brand, n, in_test FROM w WHERE rn > 0""",
    "hash_split_80_20": "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM orders",
    "hash_sample_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100",
    "quartile_pairs": """WITH n AS (SELECT *, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part)
SELECT h.p_partkey AS chosen, h.p_retailprice AS chosen_score, l.p_partkey AS rejected, l.p_retailprice AS rejected_score FROM n h JOIN n l ON l.rn < l.n // 4 AND h.rn - 3 * h.n // 4 = l.rn WHERE h.rn >= 3 * h.n // 4 AND h.p_retailprice > l.p_retailprice""",
    "regression_metrics": "SELECT count(*) AS n, round(sqrt(avg((1000 * l_quantity - l_extendedprice) ** 2)), 6) AS rmse, round(1 - avg((1000 * l_quantity - l_extendedprice) ** 2) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem",
    "standardise_pop": "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / ((SELECT stddev_pop(p_retailprice) FROM part) + 1e-8), 6) AS z FROM part",
    "generation_metrics": "SELECT count(*) AS total, count(*) FILTER (n_chars > 200) AS valid, count(DISTINCT text) FILTER (n_chars > 200) AS unique, round(count(*) FILTER (n_chars > 200) / count(*)::DOUBLE, 6) AS validity, round(count(DISTINCT text) FILTER (n_chars > 200) / count(*)::DOUBLE, 6) AS uniqueness, round(count(DISTINCT text) FILTER (n_chars > 200) / count(*) FILTER (n_chars > 200)::DOUBLE, 6) AS diversity, round(avg(n_chars) FILTER (n_chars > 200), 6) AS mean_n_chars FROM documents",
    "ordered_distinct_cap": "SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 100",
    "dataset_fingerprint": "WITH v AS (SELECT sha256(n_name || chr(10) || count(*)::VARCHAR) AS d, count(*) AS n FROM nation GROUP BY n_name), g AS (SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS d, sum(n) AS n FROM v GROUP BY substr(v.d, 1, 2)) SELECT sha256(string_agg(d, chr(10) ORDER BY d)) AS fingerprint, sum(n)::BIGINT AS n FROM g",
    "vocabulary": "WITH t AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM documents) SELECT token, row_number() OVER (ORDER BY token) + 2 AS index FROM t UNION ALL VALUES ('<pad>', 0), ('<bos>', 1), ('<eos>', 2)",
    "token_encode": """WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ')[1:4] AS t FROM part), v AS (SELECT token, row_number() OVER (ORDER BY token) + 2 AS index FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part)),
u AS (SELECT p_partkey, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM t), w AS (SELECT p_partkey, string_agg(index::VARCHAR, ',' ORDER BY pos) AS s, count(*) AS n FROM u JOIN v USING (token) GROUP BY 1)
SELECT p_partkey, '1,' || s || ',2' || repeat(',0', (4 - n)::INT) AS ids FROM w""",
    "clean_text_tags": "SELECT page_id, CASE WHEN length(t) < 3 THEN '' ELSE t END AS text FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' ') AS t FROM pages)",
    "histogram": "SELECT floor((p_retailprice - 900) / 10)::BIGINT AS bucket, count(*) AS n FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1",
    "report_format": """WITH t AS (SELECT p_partkey, p_partkey % 10 / 10.0::DOUBLE AS qed, p_partkey % 7 AS hbd, -(p_size / 7.0::DOUBLE) AS dock, nullif(p_size % 9, 4) AS lle, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40)
      SELECT p_partkey, 'QED' AS parameter, printf('%.2f', qed) AS text, CASE WHEN qed >= 0.35 THEN 'green' ELSE 'red' END AS colour FROM t UNION ALL SELECT p_partkey, 'HBD', hbd::VARCHAR, CASE WHEN hbd BETWEEN 0 AND 2 THEN 'green' ELSE 'red' END FROM t
      UNION ALL SELECT p_partkey, 'docking_score', printf('%.1f', dock), CASE WHEN dock <= -7 THEN 'green' ELSE 'red' END FROM t UNION ALL SELECT p_partkey, 'LLE', CASE WHEN lle IS NULL THEN 'NA' ELSE printf('%.1f', lle::DOUBLE) END, CASE WHEN lle IS NULL THEN 'gray' WHEN lle >= 5 THEN 'green' ELSE 'red' END FROM t
      UNION ALL SELECT p_partkey, 'other', printf('%.2f', p_size::DOUBLE), 'black' FROM t""",
    "metrics_union": "SELECT 'orders' AS model, count(*) AS n_train, round(avg(o_totalprice), 4) AS rmse_train, NULL::DOUBLE AS r2_test FROM orders UNION ALL SELECT 'part', count(*), NULL, round(avg(p_retailprice), 4) FROM part UNION ALL SELECT 'supplier', count(*), round(avg(s_acctbal), 4), round(max(s_acctbal), 4) FROM supplier",
    "cosine_nearest_whole": "SELECT query_id, arg_max(row_id, (s, -row_id)) AS row_id, max(s) AS similarity FROM (SELECT a.vec_id AS query_id, c.vec_id AS row_id, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id) GROUP BY 1",
    "novelty_filter_whole": f"SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0 AND vec_id NOT IN (SELECT a.vec_id FROM {_BITS} a JOIN {_BITS} c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id WHERE {_TANIMOTO} >= 0.6)",
    "valid_novel_percent": f"WITH k AS (SELECT count(DISTINCT label) AS kept FROM embeddings WHERE embedding[1] > 0 AND vec_id NOT IN (SELECT a.vec_id FROM {_BITS} a JOIN {_BITS} c ON c.vec_id % 50 = 0 WHERE {_TANIMOTO} >= 0.5)) SELECT (SELECT count(*) FROM embeddings) AS total, kept, round(100.0::DOUBLE * kept / (SELECT count(*) FROM embeddings), 6) AS percent FROM k",
    "sa_published": """WITH c AS (SELECT l_orderkey, l_partkey, sum(l_quantity)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, count(*) AS kinds, sum(coalesce(p_size / 10.0::DOUBLE - 2, -4) * n) / sum(n) AS s FROM c LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey GROUP BY 1),
p AS (SELECT *, (l_orderkey % 60)::DOUBLE AS a, s - (power(l_orderkey % 60, 1.005::DOUBLE) - l_orderkey % 60) - log10(l_orderkey % 4 + 1) - log10(l_orderkey % 3 + 1) - log10(l_orderkey % 2 + 1) - CASE WHEN l_orderkey % 5 > 0 THEN log10(2) ELSE 0 END AS raw FROM f),
r AS (SELECT *, 11 - (raw + CASE WHEN a > kinds THEN 0.5::DOUBLE * ln(a / kinds) ELSE 0 END + 5) / 6.5::DOUBLE * 9 AS x FROM p WHERE a > 0)
SELECT l_orderkey, f.kinds, CASE WHEN x IS NOT NULL THEN round(greatest(1, least(10, CASE WHEN x > 8 THEN 8 + ln(x - 8) ELSE x END)), 6) END AS sa FROM f LEFT JOIN r USING (l_orderkey)""",
    "tier_counts": "SELECT metric, tier, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CASE WHEN {x} {c} {best} THEN 'best' WHEN {x} {c} {good} THEN 'good' WHEN {x} {c} {fair} THEN 'fair' ELSE 'low' END AS tier FROM part WHERE p_size IS NOT NULL" for m, x, c, fair, good, best in (("pIC50", "p_size / 6.0", ">=", 5, 6, 7), ("qed", "p_size / 50.0", ">=", 0.3, 0.5, 0.7), ("sa", "p_size / 6.0", "<=", 6, 4, 3), ("bbb", "p_size / 50.0", ">=", 0.3, 0.5, 0.7), ("docking", "-(p_size / 5.0)", "<=", -6, -7, -8))) + ") GROUP BY 1, 2",
    "outcome_counts": "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS failed FROM orders GROUP BY 1",
    "alternative_names": "SELECT n_nationkey AS id, n_name AS smiles FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "mean_vectors": "SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS m0, round(avg(embedding[2]::DOUBLE), 6) AS m1, round(avg(embedding[3]::DOUBLE), 6) AS m2 FROM embeddings GROUP BY 1",
    "bulk_predict": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber = 3 AS invalid, CASE WHEN l_linenumber <> 3 THEN round(4 + l_quantity::DOUBLE * 2 - l_discount::DOUBLE * 30 + l_tax::DOUBLE * 10 + l_linenumber * 0.5::DOUBLE, 6) END AS predicted FROM lineitem",
    "cached_scores": "SELECT p_partkey, p_size * 2 AS twice FROM part",
    "cache_inventory": "SELECT * FROM (VALUES ('names', 2::BIGINT, true), ('sizes', 1, true)) AS t(kind, entries, has_bytes)",
    "csv_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "text_roundtrip": "SELECT n_name AS smiles FROM nation",
    "json_roundtrip": "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region",
    "annealing_schedule": "SELECT o_orderkey AS step, round(least((o_orderkey % 500) / 500.0::DOUBLE / 0.5, 1), 6) AS cyclical, round(least(o_orderkey / 500.0::DOUBLE, 1), 6) AS monotonic, round(1 / (1 + exp(-10 * (o_orderkey / 1000.0::DOUBLE - 0.5))), 6) AS logistic, round(CASE WHEN o_orderkey < 1000 THEN 0 ELSE least(1.0::DOUBLE, (o_orderkey - 1000) / 2000.0::DOUBLE) END, 6) AS after_warmup, round(1 / (1 + exp(-0.0025::DOUBLE * (o_orderkey - 750))), 6) AS rising FROM orders",
}
SQL["group_split_fit"] = f"""WITH g AS ({SQL["group_budget_split"]}) SELECT CASE WHEN in_test THEN 'test' ELSE 'train' END AS part, sum(n)::BIGINT AS n FROM g GROUP BY 1"""

SQL["cosine_nearest_index"] = SQL["cosine_nearest_whole"]

#: Orders as molecules of six atoms: raw lines, atoms, bonds, and bonds in both directions.
_MOLECULES = """raw AS (SELECT l_orderkey AS mol, CAST(l_partkey % 6 + 1 AS INT) AS a, CAST(l_suppkey * 7 % 6 + l_linenumber % 3 + 1 AS INT) AS b, l_linenumber % 3 + 1 AS kind FROM lineitem),
atoms AS (SELECT mol, a AS atom, substr('CNOS', a % 4 + 1, 1) AS element FROM raw UNION SELECT mol, b, substr('CNOS', b % 4 + 1, 1) FROM raw),
bonds AS (SELECT mol, least(a, b) AS a, greatest(a, b) AS b, CAST(min(kind) AS INT) AS kind FROM raw WHERE a <> b GROUP BY ALL),
links AS (SELECT mol, a AS node, b AS other, kind FROM bonds UNION ALL SELECT mol, b, a, kind FROM bonds)"""

SQL["ring_counts"] = f"""WITH RECURSIVE {_MOLECULES},
reach(mol, node, far) AS (SELECT mol, atom, atom FROM atoms UNION SELECT r.mol, r.node, l.other FROM reach r JOIN links l ON l.mol = r.mol AND l.node = r.far),
n AS (SELECT mol, count(*) AS n_nodes, count(*) FILTER (node = label) AS n_components FROM (SELECT mol, node, min(far) AS label FROM reach GROUP BY ALL) GROUP BY mol),
e AS (SELECT mol, count(*) AS n_edges FROM bonds GROUP BY mol)
SELECT mol, n_nodes, coalesce(n_edges, 0) AS n_edges, n_components, coalesce(n_edges, 0) - n_nodes + n_components AS n_cycles FROM n LEFT JOIN e USING (mol)"""


def _pruned(rounds: int = 7) -> str:
    """core0, core1, ...: bonds whose ends both have another bond, again and again; more often than six atoms need."""
    step = lambda k: f"inner{k} AS (SELECT mol, node FROM (SELECT mol, a AS node FROM core{k} UNION ALL SELECT mol, b FROM core{k}) GROUP BY ALL HAVING count(*) > 1), core{k + 1} AS (SELECT c.* FROM core{k} c JOIN inner{k} x ON x.mol = c.mol AND x.node = c.a JOIN inner{k} y ON y.mol = c.mol AND y.node = c.b)"
    return "core0 AS (SELECT * FROM bonds), " + ", ".join(map(step, range(rounds))) + f", inside AS (SELECT mol, a AS node FROM core{rounds} UNION SELECT mol, b FROM core{rounds}), scaffold AS (SELECT * FROM core{rounds} UNION SELECT b.* FROM bonds b WHERE kind = 2 AND ((mol, a) IN (SELECT (mol, node) FROM inside) OR (mol, b) IN (SELECT (mol, node) FROM inside)))"


def _coloured(edges: str, radius: int) -> str:
    """colour0, colour1, ...: of each atom a digest of its own colour and of those beside it."""
    step = lambda r: f"colour{r} AS (SELECT c.mol, c.atom, md5(c.colour || '[' || coalesce(string_agg(l.kind || ':' || d.colour, ',' ORDER BY l.kind, d.colour), '') || ']') AS colour FROM colour{r - 1} c LEFT JOIN {edges} l ON l.mol = c.mol AND l.node = c.atom LEFT JOIN colour{r - 1} d ON d.mol = l.mol AND d.atom = l.other GROUP BY c.mol, c.atom, c.colour)"
    return ", ".join(map(step, range(1, radius + 1)))


SQL["scaffold_bonds"] = f"WITH {_MOLECULES}, {_pruned()} SELECT mol, a, b, kind FROM scaffold"
SQL["scaffold_groups"] = f"""WITH {_MOLECULES}, {_pruned()}, held AS (SELECT mol, a AS node, b AS other, kind FROM scaffold UNION ALL SELECT mol, b, a, kind FROM scaffold),
colour0 AS (SELECT DISTINCT a.mol, a.atom, a.element AS colour FROM atoms a JOIN held h ON h.mol = a.mol AND h.node = a.atom), {_coloured("held", 4)},
keys AS (SELECT mol, coalesce(k, '') AS k FROM (SELECT DISTINCT mol FROM atoms) LEFT JOIN (SELECT mol, string_agg(colour, ',' ORDER BY colour) AS k FROM colour4 GROUP BY mol) USING (mol))
SELECT mol, min(mol) OVER (PARTITION BY k) AS first_mol, count(*) OVER (PARTITION BY k) AS n, k = '' AS no_ring FROM keys"""
SQL["atom_surroundings"] = f"""WITH {_MOLECULES}, colour0 AS (SELECT mol, atom, element AS colour FROM atoms), {_coloured("links", 3)}
{" UNION ALL ".join(f"SELECT mol, {r} AS radius, count(DISTINCT colour) AS kinds FROM colour{r} GROUP BY mol" for r in range(4))}"""
SQL["molecule_records"] = f"""WITH {_MOLECULES},
x AS (SELECT mol, count(*) AS n_atoms, count(*) FILTER (element = 'C') AS n_carbon, round(sum(atom / 4.0::DOUBLE), 6) AS sum_x, round(sum(-(atom / 2.0::DOUBLE)), 6) AS sum_y FROM atoms GROUP BY mol),
y AS (SELECT mol, count(*) AS n_bonds, CAST(sum(a * 100 + b * 10 + kind) AS BIGINT) AS bond_sum FROM bonds GROUP BY mol)
SELECT x.*, n_bonds, bond_sum FROM x LEFT JOIN y USING (mol)"""

SQL["sorted_digest"] = "SELECT sha256(string_agg(p_name, chr(10) ORDER BY p_name)) AS digest, count(p_name) AS n FROM part"


def _picked(seed: int, name: str, temperature: float = 1.0, top_k: int = 1000, top_p: float = 2.0) -> str:
    """The choice of each vector as a table: shares in falling order, those that are kept, and the first whose running sum is over the draw."""
    return f"""{name} AS (SELECT vec_id, arg_min(slot, place) AS {name} FROM (
  SELECT *, sum(w) FILTER (kept) OVER (PARTITION BY vec_id) AS whole FROM (
    SELECT *, sum(w) OVER (PARTITION BY vec_id ORDER BY place) AS upto, sum(w) OVER (PARTITION BY vec_id ORDER BY place) - w < {top_p} * sum(w) OVER (PARTITION BY vec_id) AS kept FROM (
      SELECT vec_id, slot - 1 AS slot, place, exp((x - max(x) OVER (PARTITION BY vec_id)) / {temperature}::DOUBLE) AS w FROM (
        SELECT vec_id, slot, embedding[slot]::DOUBLE AS x, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[slot] DESC, slot) AS place FROM embeddings, range(1, 65) r(slot)) WHERE place <= {top_k})))
  WHERE kept AND upto > whole * (CAST('0x' || substr(md5('{seed}|' || vec_id), 1, 13) AS UBIGINT) / 4503599627370496.0::DOUBLE) GROUP BY vec_id)"""


SQL["token_sampling"] = f"""WITH {_picked(1, "plain")}, {_picked(2, "cold", 0.1)}, {_picked(3, "top_k", top_k=5)}, {_picked(4, "top_p", 0.5, top_p=0.3)}
SELECT * FROM plain JOIN cold USING (vec_id) JOIN top_k USING (vec_id) JOIN top_p USING (vec_id)"""
SQL["standard_residues"] = "SELECT s_suppkey, 'ATOM  ' || s_suppkey || chr(10) || 'TER' || chr(10) || 'ATOM  2' || chr(10) || 'END' AS value FROM supplier"
SQL["log_scores"] = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN -p_size::DOUBLE WHEN 1 THEN -(p_size + 0.5::DOUBLE) END AS docking_score FROM part"

_PLACES = {f"e{i}": f"embedding[{i + 1}]::DOUBLE" for i in range(64)}
_PLACES |= {f"f{i}": f"{_PLACES[f'e{i}']} * 3 + {_PLACES[f'e{(i + 1) % 64}']} / 4" for i in range(0, 64, 4)}
_WIDE = f"wide AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _PLACES.items())} FROM embeddings)"
SQL["correlation_blocks"] = f"""WITH {_WIDE}, numbered AS (SELECT row_number() OVER () AS n, * FROM wide), long AS (UNPIVOT numbered ON COLUMNS(* EXCLUDE n) INTO NAME k VALUE v),
place AS (SELECT k, p FROM (VALUES {", ".join(f"('{k}', {p})" for p, k in enumerate(_PLACES))}) t(k, p)), long2 AS (SELECT n, k, p, v FROM long JOIN place USING (k))
SELECT a.k AS column_a, b.k AS column_b, round(corr(a.v, b.v), 6) AS corr FROM long2 a JOIN long2 b ON a.n = b.n AND a.p < b.p GROUP BY ALL"""
#: Each f is a near copy of the e it is made of, which stands before it.
SQL["uncorrelated_columns"] = f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT 'e{i}' AS feature, round(avg(e{i}), 6) AS mean FROM wide" for i in range(64))

SQL["bit_model_scores"] = "SELECT vec_id, 0.25::DOUBLE + coalesce(sum((i - 1) % 7 - 3) FILTER (embedding[i] > 0), 0) / 2.0::DOUBLE AS predicted FROM embeddings, range(1, 65) r(i) GROUP BY vec_id"
SQL["bit_model_fit"] = """WITH x AS (SELECT CASE WHEN embedding[1] > 0 THEN 1.0::DOUBLE ELSE 0 END AS x, label::DOUBLE AS y FROM embeddings), s AS (SELECT covar_pop(y, x) / (var_pop(x) + 0.0001::DOUBLE) AS w, avg(x) AS mx, avg(y) AS my FROM x)
SELECT round(w, 6) AS weight, round(my - mx * w, 6) AS bias FROM s"""
