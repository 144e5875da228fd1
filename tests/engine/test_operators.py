"""Edges of scores and operators, with values worked out by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from siftstone.functions import cleaning, reporting, scoring, similarity, text_results
from siftstone.operators import chem, clean, docking, fragments, frames, linear, ranking, stats, tokens
from siftstone.operators import similarity as search
from siftstone.plans import screening
from siftstone.sources import tables
from siftstone.sources.activities import ActivityPages
from siftstone.sources.cache import TableCache
from siftstone.streaming import scores

NAN = float("nan")


def column(spark, values, expr, kind="double"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(expr(F.col("x"))).collect()]


def test_desirability_edges(spark):
    x = [None, NAN, 0.0, 1.0, 1.5, 2.0, 3.0]
    assert column(spark, x, lambda c: scoring.less_is_better(c, 1, 2)) == [None, 0.0, 1.0, 1.0, 0.5, 0.0, 0.0]
    assert column(spark, x, lambda c: scoring.more_is_better(c, 1, 2)) == [None, 1.0, 0.0, 0.0, 0.5, 1.0, 1.0]
    assert column(spark, x, lambda c: scoring.near_is_best(c, 1, 1.5, 2)) == [None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert sum(c.weight for c in scoring.COMPONENTS) == 45 and len(scoring.COMPONENTS) == 25


def test_composite_is_nan_without_a_part_and_nan_ranks_first_unless_told(spark):
    rows = [(1, 0.5, 0.5), (2, None, 0.5), (3, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double").withColumn("s", scoring.weighted_geometric_mean([(F.col("a"), 3), (F.col("b"), 1)]))
    found = {r.id: r.s for r in df.collect()}
    assert found[1] == pytest.approx(0.5) and math.isnan(found[2]) and found[3] == pytest.approx(1e-9**0.75)
    assert [r.id for r in ranking.top(df, 2, "s", "id").collect()] == [2, 1]
    assert [r.id for r in ranking.top(df, 2, "s", "id", nan_last=True).collect()] == [1, 3]


def test_units_and_numbers(spark):
    units = ["nM", "NM", "uM", "μM", "µM", "%", None]
    assert column(spark, units, lambda c: cleaning.to_nanomolar(F.lit(2.0), c), "string") == [2.0, 2.0, 2000.0, 2000.0, 2000.0, None, None]
    assert column(spark, [1e3, 0.0, -1.0, None], cleaning.potency) == [6.0, None, None, None]
    assert column(spark, ["1.5", "-2", "1e3", "x", None, "1-2"], cleaning.lenient_number, "string") == [1.5, -2.0, None, None, None, None]
    assert column(spark, ["<b>ab</b>", " <i>long</i> text ", None], cleaning.strip_short, "string") == ["", "long text", None]
    assert column(spark, [NAN, None, 2.0], cleaning.nan_or_null_to_zero) == [0.0, 0.0, 2.0]
    assert column(spark, [NAN, None, 2.0], cleaning.nan_to_null) == [None, None, 2.0]


def test_a_structure_with_a_zero_goes_as_a_whole(spark):
    rows = [(f"m{i}", "A", str(v), "nM", "IC50") for i, v in enumerate((0, 5, 9))]
    rows += [(f"k{i}", f"S{i}", "10", "uM" if i == 0 else "nM", "Ki") for i in range(9)] + [("far", "F", "1e9", "nM", "Ki"), ("other", "O", "1", "nM", "GI50"), ("none", None, "1", "nM", "Ki"), ("odd", "P", "1", "%", "Ki")]
    df = spark.createDataFrame(rows, "id string, s string, v string, u string, k string")
    found = clean.clean_activity(df, "id", "v", "u", "k", structure="s").collect()
    assert {r.s for r in found} == {f"S{i}" for i in range(1, 9)} and all(r.nanomolar == 10 for r in found)
    assert clean.clean_activity(df.limit(0), "id", "v", "u", "k", structure="s").collect() == []


@pytest.mark.parametrize("exact", [0, 3, 1000])
def test_nth_value_by_narrowing(spark, exact):
    values = [float(x * 7919 % 1009) for x in range(3000)] + [5.0] * 4000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (0, 20, 2000, 4100, 6999):
        assert stats.nth_value(df, "v", k, exact) == sorted(values)[k]
    assert stats.nth_value(df, "v", 7000, exact) is None and stats.nearest_quantile(df.limit(0), "v", 0.5) is None


def test_correlations_keep_nulls_and_constants(spark):
    rows = [(float(i), 2.0 * i, 1.0, None if i == 3 else float(i), float(i * i % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert stats.select_uncorrelated(df, list("abcde")) == ["a", "c", "d", "e"]


def test_regression_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    assert stats.regression_metrics(df, F.col("y"), F.col("p")).first() == (2, 1.0, 0.0)
    assert stats.generation_metrics(df.limit(0), "y", F.col("p") > 0, ["p"]).first() == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_budget_split_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([(g,) for g, n in zip("abcd", (3, 4, 2, 1)) for _ in range(n)], "g string")
    found = {r.g: (r.n, r.in_test) for r in frames.group_budget_split(df, "g", 0.6).collect()}
    import hashlib

    used, wanted = 0, {}
    for g in sorted("abcd", key=lambda g: hashlib.md5(f"42|{g}".encode()).hexdigest()):
        n = found[g][0]
        wanted[g] = (n, used + n <= 6)
        used += n if wanted[g][1] else 0
    assert found == wanted


def test_numbers_are_dense_on_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("k"))
    found = frames.number_rows(df, [F.col("k")], "n", 0).collect()
    assert len(found) == 1000 and all(r.k == r.n for r in found)
    assert frames.number_rows(df.limit(0), [F.col("k")], "n").collect() == []
    assert frames.top_fraction(df.filter("k < 5"), [F.col("k")], 0.1).collect()[0].k == 0


def test_clashing_names_and_positional_parts(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    assert frames.concat_columns([a, a, a], "k").columns == ["k", "x", "t2_x", "t3_x"]
    assert frames.lookup(a, spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string"), "k", "v").first().v == "a"
    with pytest.raises(ValueError):
        frames.union_tables([])


def test_similar_pairs_lose_none(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(15)]
    sets = [0, 0] + base + [b ^ (1 << rng.randrange(128)) for b in base for _ in range(3)] + base[:3]
    rows = [(i, [(s & (2**64 - 1)) - (2**64 if s >> 63 & 1 else 0), (s >> 64) - (2**64 if s >> 127 else 0)]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, bits array<long>")
    found = {(r.i, r.j) for r in search.similar_pairs(df, df.withColumnRenamed("i", "j"), "i", "j", least=0.9).collect()}
    wanted = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a | b and (a & b).bit_count() / (a | b).bit_count() >= 0.9}
    assert found == wanted and len(wanted) > len(sets)
    assert spark.createDataFrame(rows[:1], "i int, bits array<long>").select(similarity.tanimoto(F.col("bits"), F.col("bits"))).first()[0] == 0.0


def test_nearest_brings_no_vectors_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "id long, v array<double>")
    for name in ("toPandas", "collect", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda *_: 1 / 0)
    found = search.nearest(df.withColumnRenamed("id", "q"), df, "q", "id", "v", block_rows=8)
    monkeypatch.undo()
    assert sorted((r.q, r.id, r.similarity) for r in found.collect()) == [(i, i % 21, 1.0) for i in range(40)]


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    one = search.nearest(df.withColumnRenamed("id", "q"), df, "q", "id", "v").collect()
    many = search.nearest(df.withColumnRenamed("id", "q"), df, "q", "id", "v", block_rows=8).collect()
    assert sorted(one) == sorted(many) and len(one) == 40 and all(r.id == r.q % 15 for r in one)
    assert search.nearest(df.limit(0).withColumnRenamed("id", "q"), df, "q", "id", "v").collect() == []


RESULT = "MODEL 1\nREMARK VINA RESULT:    -7.1      0.000      0.000\nATOM      1  C   UNL     1      11.104   6.134  -6.504  1.00  0.00     0.101 C \nENDMDL\nMODEL 2\nREMARK VINA RESULT:    -6.9 1 2\nENDMDL\n"


def test_result_texts(spark):
    texts = [RESULT, "", "REMARK VINA RESULT: x", None]
    assert column(spark, texts, text_results.result_score, "string") == [-7.1, None, None, None]
    assert column(spark, texts, text_results.has_atoms, "string") == [True, False, False, False]
    assert column(spark, ["mode\n   1   -7.1  0.000  0.000\n   1 -3.0"], text_results.table_score, "string") == [-7.1]
    roots = "ROOT\nATOM a\nENDROOT\nBRANCH\nROOT\nENDROOT\nTORSDOF 2"
    assert column(spark, [roots, "ROOT\nENDROOT"], text_results.single_root, "string") == ["ROOT\nATOM a\nENDROOT\nTORSDOF 0\n", "ROOT\nENDROOT\nTORSDOF 0\n"]
    assert column(spark, ["ATOM  1\nROOT\nTER\nENDROOT"], text_results.clean_receptor, "string") == ["ATOM  1\nTER"]
    atom = docking.atom_table(spark.createDataFrame([(1, x) for x in RESULT.split("\n")], "k int, value string"), "k").collect()
    assert len(atom) == 1 and (atom[0].x, atom[0].y, atom[0].z, atom[0].residue, atom[0].charge) == (11.104, 6.134, -6.504, "UNL", 0.101)
    files = spark.createDataFrame([("/a/lig_7_dock.pdbqt", RESULT)], "path string, value string")
    assert docking.parse_results(files).first() == ("lig_7", -7.1)
    with pytest.raises(RuntimeError):
        docking.dock(files, "no-such-program", "", (0, 0, 0), (1, 1, 1))


def test_formats(spark):
    assert column(spark, [None, NAN, float("inf"), 2.25, -1.9], reporting.number_text) == ["NA", "NA", "NA", "2.25", "-1.90"]
    assert column(spark, [None, 1.0, 2.0, 3.0], lambda c: reporting.colour(c, 1, 2)) == ["gray", "green", "black", "red"]
    assert column(spark, [None, -5.0, -6.0, -8.5], scoring.TIERS["docking"].column) == [None, "low", "fair", "best"]


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (2, []), (3, ["a", "b", "c", "a"])], "k int, t array<string>")
    words = tokens.vocabulary(df, F.col("t"))
    assert sorted((r["index"], r.token) for r in words.collect())[3:] == [(3, "a"), (4, "b"), (5, "c")]
    encoded = tokens.encode(df, "k", F.col("t"), words, 5)
    assert {r.k: r.ids for r in encoded.collect()} == {1: [1, 4, 3, 2, 0], 2: [1, 2, 0, 0, 0], 3: [1, 3, 4, 5, 2]}
    assert {r.k: r.tokens for r in tokens.decode(encoded, "k", "ids", words).collect()} == {1: ["b", "a"], 2: [], 3: ["a", "b", "c"]}


def test_linear_model(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + 1) for i in range(60)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    model = linear.fit_linear(df, ["a", "b"], "y", l1=0.0, l2=0.0)
    assert model.weights == pytest.approx((3, -2), abs=1e-4) and model.bias == pytest.approx(1, abs=1e-3)
    assert [r.feature for r in model.importance(spark, 1).collect()] == ["a"]
    model.save(spark, str(tmp_path / "m"))
    assert linear.LinearModel.load(spark, str(tmp_path / "m")) == model
    assert linear.fit_boosted(df, ["a", "b"], "y", depth=3, rounds=3).getNumTrees == 3


def test_published_difficulty(spark):
    names = "fragments double, atoms int, kinds int, stereo int, spiro int, bridges int, macrocycles int"
    rows = [(-1.0, 10, 5, 0, 0, 0, 0), (-4.0, 200, 200, 3, 1, 1, 2), (-1.0, 0, 5, 0, 0, 0, 0), (None, 10, 5, 0, 0, 0, 0), (2.5, 1, 1, 0, 0, 0, 0)]
    c = [F.col(x.split()[0]) for x in names.split(", ")]
    got = [r[0] for r in spark.createDataFrame(rows, names).coalesce(1).select(scoring.published_difficulty(*c)).collect()]
    penalty = 10**1.005 - 10
    assert got[0] == pytest.approx(11 - (-1 - penalty + math.log(2) / 2 + 5) / 6.5 * 9)
    raw = -4 - (200**1.005 - 200) - math.log10(4) - 3 * math.log10(2)
    assert got[1] == pytest.approx(min(10, 8 + math.log(11 - (raw + 5) / 6.5 * 9 - 8)))
    assert got[2:] == [None, None, 1.0]


def test_fragment_scores(spark):
    table = fragments.fragment_table(spark.createDataFrame([(1.0, [7, 8]), (2.0, [8])], "score double, fragments array<long>"))
    counts = spark.createDataFrame([("a", 7, 1), ("a", 7, 2), ("a", 8, 1), ("b", 9, 5), ("c", None, 1), ("d", 7, 0), (None, 7, 1)], "k string, fragment long, count int")
    found = {r.k: (r.fragment_score, r.kinds) for r in fragments.fragment_scores(counts, table, "k").collect()}
    assert found == {"a": ((3 * 1.0 + 2.0) / 4, 2), "b": (-4.0, 1)}
    assert fragments.fragment_scores(counts.limit(0), table, "k").collect() == []


def test_counts_names_and_percents(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, False, None), (3, None, "x")], "id int, ok boolean, smiles string")
    assert stats.outcome_counts(df, F.col("ok")).first() == (3, 1, 2)
    assert stats.outcome_counts(df.limit(0), F.col("ok")).first() == (0, 0, 0)
    one = stats.kept_percent(df, df.filter("id <> 2"), "smiles").first()
    assert (one.total, one.kept, one.percent) == (3, 1, pytest.approx(100 / 3))
    assert stats.kept_percent(df.limit(0), df.limit(0), "smiles").first() == (0, 0, 0.0)
    both = df.withColumn("SMARTS", F.lit("y"))
    assert [r.smiles for r in frames.first_of(both, "smiles", "SMARTS").orderBy("id").collect()] == ["x", "y", "x"]
    assert frames.first_of(df, "name", "smiles").columns == ["id", "ok", "name"]
    with pytest.raises(ValueError):
        frames.first_of(df, "none", "nothing")


def test_searches_pass_over_the_row_itself(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    near = search.nearest(vectors.withColumnRenamed("id", "q"), vectors, "q", "id", "v", skip_same=True)
    assert {r.q: r.id for r in near.collect()} == {1: 2, 2: 1, 3: 2}
    alone = vectors.filter("id = 1")
    assert search.nearest(alone.withColumnRenamed("id", "q"), alone, "q", "id", "v", skip_same=True).collect() == []
    bits = spark.createDataFrame([(1, [7]), (2, [7]), (3, [1 << 40])], "id long, bits array<long>")
    assert [r.id for r in search.novel(bits, bits.withColumnRenamed("id", "known"), "id", "known", skip_same=True).collect()] == [3]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_similar_pairs_lose_none(spark, least):
    rng = random.Random(3)
    rows = [(i, [sum(1 << b for b in rng.sample(range(20), rng.randint(0, 8)))]) for i in range(120)]
    df = spark.createDataFrame(rows, "a long, bits array<long>")
    alike = lambda x, y: (x & y).bit_count() / (x | y).bit_count() if x | y else 0.0
    want = {(i, j) for i, (x,) in rows for j, (y,) in rows if alike(x, y) >= least}
    assert {(r.a, r.b) for r in search.similar_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", least=least).collect()} == want


def test_bulk_prediction_by_the_model_that_is_there(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(40)] + [(None, 1.0), (NAN, 1.0)], "a double, y double")
    paths = str(tmp_path / "boosted"), str(tmp_path / "linear")
    linear.LinearModel(("a",), (2.0,), 0.0).save(spark, paths[1])
    model = linear.load_model(spark, *paths)
    rows = linear.predict(df, model).collect()
    assert isinstance(model, linear.LinearModel) and len(rows) == 42 and sum(math.isnan(r.predicted) for r in rows) == 2
    linear.BoostedModel(("a",), linear.fit_boosted(df.limit(40), ["a"], "y", depth=2, rounds=2)).save(spark, paths[0])
    model = linear.load_model(spark, *paths)
    out = linear.predict(df, model)
    assert isinstance(model, linear.BoostedModel) and out.columns == ["a", "y", "predicted"]
    assert sum(math.isnan(r.predicted) for r in out.collect()) == 2 and out.count() == 42
    _, judged = linear.fit_and_judge(df.filter("a < 30"), df.filter("a >= 30 AND NOT isnan(a)"), ["a"], "y")
    assert {r.part: r.n for r in judged.collect()} == {"train": 30, "test": 10}


def test_cache(spark, tmp_path):
    cache, calls = TableCache(spark, str(tmp_path / "kept")), []
    df = spark.createDataFrame([("CC", 1), ("N", 2)], "smiles string, n int")
    compute = lambda d: calls.append(1) or d.select("smiles", (F.col("n") + 1).alias("m"))
    assert cache.inventory().collect() == [] and cache.get("sizes", "no") is None
    for rows in (df, df.orderBy(F.desc("n")), df.filter("n = 1")):
        assert cache.fetch(rows, "smiles", "sizes", compute).count() == rows.count()
    assert len(calls) == 2
    cache.put(df, "other", "key")
    found = {r.kind: r for r in cache.inventory().collect()}
    assert found["sizes"].entries == 2 and found["other"].entries == 1 and found["sizes"]["bytes"] > 0
    (tmp_path / "kept/kind=other/key=key/_SUCCESS").unlink()
    assert cache.get("other", "key") is None
    cache.clear("sizes")
    assert [r.kind for r in cache.inventory().collect()] == ["other"]
    cache.clear()
    assert cache.inventory().collect() == []


def test_files_by_name(spark, tmp_path):
    df = spark.createDataFrame([("CC", 1)], "smiles string, n int")
    for name in ("a.csv", "b.tsv", "c.parquet", "d.pq"):
        tables.write_table(df, str(tmp_path / name))
        assert tables.read_table(spark, str(tmp_path / name), ["smiles"]).first().smiles == "CC"
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "x.doc"))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "a.csv"), ["other"])
    (tmp_path / "m.json").write_text('{"rmse_test": 1.0}')
    assert tables.read_metrics(spark, {"a": str(tmp_path / "m.json"), "b": str(tmp_path / "none.json")}).count() == 1
    with pytest.raises(ValueError):
        tables.read_metrics(spark, {"b": str(tmp_path / "none.json")})
    assert tables.only_new(df, df.limit(0), "smiles").count() == 1


def test_activity_pages(spark, tmp_path):
    for page in (0, 2):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"activities": [{"molecule_chembl_id": f"M{page}", "standard_value": 5, "standard_type": "Ki"}, {"standard_type": "IC50"}]}))
    spark.dataSource.register(ActivityPages)
    df = spark.read.format("activity_pages").option("url", f"file://{tmp_path}/p{{offset}}.json").option("pages", 2).option("limit", 2).load()
    assert sorted(r.molecule_chembl_id for r in df.filter("standard_type = 'Ki'").collect()) == ["M0", "M2"]
    assert df.count() == 4


def test_streams_parse_what_arrives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/lig_1_dock.pdbqt").write_text(RESULT)
    (tmp_path / "in/lig_1.pdbqt").write_text("ROOT")
    scores.run_once(scores.result_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect() == [("lig_1", -7.1)]


def test_final_hits(spark):
    t = {"scores": spark.createDataFrame([("b", -8.0), ("a", -8.0), ("c", None), ("d", -9.0)], "id_ligand string, docking_score double"), "ligand_ids": spark.createDataFrame([("a", "CC"), ("d", "N")], "id_ligand string, smiles string")}
    found = screening.run(t, "final_hits")["final_hits"]
    assert sorted(found.collect(), key=lambda r: r.rank) == [("d", "N", -9.0, 1), ("a", "CC", -8.0, 2), ("b", "", -8.0, 3)]


@pytest.mark.skipif(chem.available(), reason="a toolkit is installed")
def test_molecules_need_a_toolkit():
    with pytest.raises(RuntimeError):
        chem.canonical(F.col("smiles"))


def test_both_quartiles_from_one_sketch(spark):
    import random

    rng = random.Random(11)
    for values in ([rng.gauss(0, 5) for _ in range(20000)], [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(9000)], [float(i % 7) for i in range(50)], [-1.5]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "v double").repartition(4)
        want = [sorted(values)[int((len(values) - 1) * q + 0.5)] for q in (0.25, 0.5, 0.75, 1.0)]
        for exact in (10, 500, 200_000):
            assert stats.nearest_quantiles(df, "v", [0.25, 0.5, 0.75, 1.0], exact) == want
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (2.0,)], "v double")
    assert stats.nearest_quantiles(nan, "v", [0.0, 0.5]) == [1.0, 3.0]
    assert stats.nearest_quantiles(nan.limit(0), "v", [0.25, 0.75]) == [None, None] and stats.quartile_fence(nan.limit(0), "v").collect() == []


def test_sorted_digest_in_small_chunks(spark):
    import hashlib

    values = ["b", "a", "é", "a", "", "C\nC", None] + [f"v{i}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    known = sorted(v.encode() for v in values if v is not None)
    for size in (1, 100, 1 << 20):
        row = stats.sorted_digest(df, "v", chunk_bytes=size).first()
        assert row.digest == hashlib.sha256(b"\n".join(known)).hexdigest() and row.n == len(known)
    assert tuple(stats.sorted_digest(df.limit(0), "v").first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_fingerprints_of_more_groups(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("v"))
    first = stats.table_fingerprint(df, "v", group_values=1).first()
    assert first == stats.table_fingerprint(df.orderBy(F.rand(1)), "v", group_values=1).first() and first.n == 3000
    assert first.fingerprint != stats.table_fingerprint(df.filter("v <> '7'"), "v", group_values=1).first().fingerprint


def test_repeated_keys_keep_their_own_tokens(spark):
    from siftstone.operators import tokens

    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (None, ["b"]), (2, None)], "k long, t array<string>")
    words = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, index long")
    got = sorted(((r.k, tuple(r.ids)) for r in tokens.encode(df, "k", F.col("t"), words, 4).collect()), key=str)
    assert got == sorted([(1, (1, 3, 4, 2)), (1, (1, 5, 2, 0)), (None, (1, 4, 2, 0)), (2, (1, 2, 0, 0))], key=str)
    back = sorted(((r.k, tuple(r.tokens)) for r in tokens.decode(tokens.encode(df, "k", F.col("t"), words, 4), "k", "ids", words).collect()), key=str)
    assert back == sorted([(1, ("a", "b")), (1, ("c",)), (None, ("b",)), (2, ())], key=str)


def test_scores_follow_the_published_tiers(spark):
    rules = lambda tpsa, logp: spark.range(1).select(scoring.barrier_rules(*(F.lit(float(x)) for x in (tpsa, logp, 50, 9, 20, 20))).alias("s")).first().s
    assert [rules(*x) for x in ((132, 5.9), (138, 5.5), (138, 5.0), (149, 4.5), (149, 4.0), (151, 4.0))] == pytest.approx([0.4, 0.0, 0.35, 0.05, 0.3, 0.1])
    one = lambda c: spark.range(1).select(c.alias("s")).first().s
    count = lambda *xs: [F.lit(x) for x in xs]
    assert one(scoring.difficulty_by_groups(*count(31, 2, 1, 3, 1, 1, 2, 4, 2))) == pytest.approx(1 + 1.5 + 1.0 + 0.8 + 0.9 + 1 + 0.8 + 0.8 + 0.8 + 0.6)
    assert one(scoring.difficulty_by_groups(*count(5, 0, 0, 0, 0, 0, 0, 0, 0))) == 1.0
    assert one(scoring.difficulty_by_share(*count(50, 1, 10, 1, 1))) == pytest.approx(1.5 + 0.4 + 0.06 + 0.5 + 0.2 + 0.2)


def test_colours_by_range(spark):
    colours = lambda name, *values: [spark.range(1).select(reporting.parameter_colour(F.lit(v).cast("double"), name).alias("c")).first().c for v in values]
    assert colours("MW", 199, 200, 450, 451, None, float("nan")) == ["red", "green", "green", "red", "gray", "gray"]
    assert colours("docking_score", -12, -7, -6.9) == ["green", "green", "red"] and colours("QED", 0.34, 0.35, 2) == ["red", "green", "green"]
    assert colours("SA", 3, None) == ["black", "gray"]


def test_scores_in_logs(spark):
    texts = ["1   -7   0.0 0.0", "mode\n   1   -7.25 0 0\n   1 -9", "10 -1\n1 x\n1 -2", "1\t-3", "1", "", None, " 1 -1e1 2"]
    assert column(spark, texts, text_results.log_score, "string") == [-7.0, -7.25, -2.0, None, None, None, None, -10.0]
    assert column(spark, ["ATOM  1\nHETATM 2\nTER\nCONECT 1\nEND"], text_results.standard_residues, "string") == ["ATOM  1\nTER\nEND"]


def test_metrics_that_cannot_be_read_are_no_silence(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1, "A": 2}')
    with pytest.raises(Exception, match="A"):
        tables.read_metrics(spark, {"x": str(tmp_path / "bad.json")}).collect()


def test_choices_from_logits(spark):
    from siftstone.functions import sampling

    rows = [(i, [0.0, 2.0, 1.0, None, 2.0]) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, x array<double>")
    u = sampling.seeded_uniform(F.col("k"), 5)
    shares = lambda **how: {r.c: r["count"] / 4000 for r in df.select(sampling.choose(F.col("x"), u, **how).alias("c")).groupBy("c").count().collect()}
    whole = 1 + 2 * math.exp(2) + math.exp(1)
    assert shares() == pytest.approx({0: 1 / whole, 1: math.exp(2) / whole, 2: math.exp(1) / whole, 4: math.exp(2) / whole}, abs=0.03)
    assert set(shares(top_k=1)) == {1} and set(shares(top_k=2)) == {1, 4} and set(shares(top_p=0.5)) == {1, 4} and set(shares(top_p=0.3)) == {1}
    assert shares(temperature=0.01) == pytest.approx({1: 0.5, 4: 0.5}, abs=0.03)
    odd = spark.createDataFrame([([],), (None,), ([None],), ([float("nan"), 1.0],), ([-1e308, 1e308],)], "x array<double>")
    assert [r.c for r in odd.select(sampling.choose(F.col("x"), F.lit(0.5)).alias("c")).collect()] == [None, None, None, 1, 1]
    with pytest.raises(ValueError):
        sampling.choose(F.col("x"), u, top_k=0)


def test_correlations_by_blocks_of_columns(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 40)) * 10.0 ** rng.integers(-3, 6, 40) + 1e6
    x = np.column_stack([base, base[:, :10] * -2 + rng.normal(size=(300, 10)) * 1e-6, np.full((300, 1), 7.1), base[:, :1]])
    names = [f"v{i}" for i in range(x.shape[1])]
    rows = [tuple(map(float, r)) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).withColumns({"nul": F.when(F.col("v0") > 1e6, F.col("v0")), "nan": F.lit(float("nan"))}).repartition(7)
    names += ["nul", "nan"]
    want = np.corrcoef(x[:, :50].T)
    got = {(r.column_a, r.column_b): r["corr"] for r in stats.correlation_matrix(df, names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    assert all(abs(got[f"v{i}", f"v{j}"] - want[i, j]) < 1e-6 for i in range(50) for j in range(i + 1, 50))
    assert all(c == 0 for (a, b), c in got.items() if {"v50", "nul", "nan"} & {a, b})
    few = {(r.column_a, r.column_b): r["corr"] for r in stats.correlation_matrix(df, names[35:45]).collect()}
    assert all(abs(got[k] - c) < 1e-6 for k, c in few.items())
    for block in (7, 512):
        assert stats.select_uncorrelated(df, names, 0.95, block) == [f"v{i}" for i in range(40)] + ["v50", "nul", "nan"]
    wide = spark.range(200).select(*(F.rand(i if i < 900 else i - 900).alias(f"w{i}") for i in range(1000)))
    assert stats.select_uncorrelated(wide.coalesce(1), wide.columns, 0.99) == [f"w{i}" for i in range(900)]


def test_models_on_packed_bits_equal_those_on_columns(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (400, 128))
    y = x @ rng.normal(size=128) + 3 + rng.normal(size=400) * 0.1
    words = np.packbits(x.astype(bool), axis=1, bitorder="little").view(np.int64)
    rows = [(i, w.tolist(), float(v)) for i, (w, v) in enumerate(zip(words, y))]
    odd = [(900, None, 1.0), (901, [1], 1.0), (902, [1, None], 1.0), (903, [1, 2], None)]
    df = spark.createDataFrame(rows + odd, "k long, bits array<long>, y double").repartition(5)
    model = linear.BitModel.fit(df, "bits", "y", 128, l2=0.01)
    centred, mean = x - x.mean(axis=0), x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred / 400 + 0.01 * np.eye(128), centred.T @ (y - y.mean()) / 400)
    assert np.allclose(model.weights, want, atol=1e-9) and model.bias == pytest.approx(y.mean() - mean @ want)
    got = {r.k: r.predicted for r in model.score(df, "bits").collect()}
    assert np.allclose([got[i] for i in range(400)], x @ want + model.bias) and all(math.isnan(got[k]) for k in (900, 901, 902)) and not math.isnan(got[903])
    columns = spark.createDataFrame([(*map(float, r[:64]), float(v)) for r, v in zip(x, y)], ", ".join(f"b{i} double" for i in range(64)) + ", y double")
    one = linear.fit_linear(columns, [f"b{i}" for i in range(64)], "y", l1=0.0, l2=0.0)  # the fitter of columns takes l2 relative to the label's deviation, so without it
    half = linear.BitModel.fit(df.filter("k < 900").withColumn("bits", F.slice("bits", 1, 1)), "bits", "y", 64, l2=0.0)
    assert np.allclose(one.weights, half.weights, atol=1e-6)
    with pytest.raises(ValueError):
        linear.BitModel.fit(df, "bits", "y", 100)


def test_a_stream_started_again_repeats_nothing(spark, tmp_path):
    source, out, done = tmp_path / "in", tmp_path / "out", spark.createDataFrame([(99,)], "id long")
    source.mkdir()
    for n, ids in enumerate([[1, 2, 2, 99], [2, 3, None], [1, 3, 4, None]]):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "n": n}) for i in ids))
        rows = spark.readStream.schema("id long, n int").json(str(source))
        scores.run_once(scores.new_stream(rows, "id", done), str(out), str(tmp_path / "cp")).awaitTermination()
        want = [[1, 2], [None, 1, 2, 3], [None, 1, 2, 3, 4]][n]
        assert sorted((r.id for r in spark.read.parquet(str(out)).collect()), key=lambda i: i or 0) == want
