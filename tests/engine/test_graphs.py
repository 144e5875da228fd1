"""Components, cycles, scaffolds, surroundings and records against plain Python on random graphs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftstone.operators import frames, graphs, molecules

BONDS = "mol long, a int, b int, kind int"


def plain(mols):
    """{mol: {node: {other: kind}}} without loops; the least kind of repeated bonds."""
    out = {m: {n: {} for n in nodes} for m, (nodes, _) in mols.items()}
    for m, (_, bonds) in mols.items():
        for a, b, k in bonds:
            if a != b:
                k = min(k, out[m][a].get(b, k))
                out[m][a][b] = out[m][b][a] = k
    return out


def brute_labels(adjacent):
    label = {}
    for start in sorted(adjacent):
        todo = [start] if start not in label else []
        while todo:
            n = todo.pop()
            if n not in label:
                label[n] = start
                todo += adjacent[n]
    return label


def brute_core(adjacent, keep_double):
    inside = set(adjacent)
    while gone := {n for n in inside if sum(o in inside for o in adjacent[n]) < 2}:
        inside -= gone
    edge = lambda n, o: n in inside and o in inside or keep_double and adjacent[n][o] == 2 and (n in inside or o in inside)
    return {(min(n, o), max(n, o), k) for n in adjacent for o, k in adjacent[n].items() if edge(n, o)}


def brute_colours(adjacent, element, radius):
    colour = {n: (element[n],) for n in adjacent}
    for _ in range(radius):
        colour = {n: (colour[n], tuple(sorted((k, colour[o]) for o, k in adjacent[n].items()))) for n in adjacent}
    return colour


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(7)
    mols = {}
    for m in range(60):
        nodes = list(range(1, rng.randint(1, 14) + 1))
        mols[m] = (nodes, [(rng.choice(nodes), rng.choice(nodes), 1) for _ in range(rng.randint(0, int(len(nodes) * 1.3)))])
    ring = [(i, i % 6 + 1, 1) for i in range(1, 7)]
    mols[100] = (list(range(1, 20)), ring + [(i, i + 1, 1) for i in range(6, 18)])  # a ring with a long tail
    mols[101] = (list(range(1, 10)), [*ring, (1, 7, 2), (7, 8, 1), (8, 9, 1)])  # an atom held by a double bond
    mols[102] = (list(range(1, 13)), [*ring, *((a + 6, b + 6, k) for a, b, k in ring), (3, 8, 1), (3, 8, 1), (8, 3, 1)])  # two rings and a linker, bonds repeated
    mols[103] = (list(range(1, 7)), [(b, a, k) for a, b, k in ring])
    atoms = spark.createDataFrame([(m, n, "CNO"[n % 3]) for m, (nodes, _) in mols.items() for n in nodes], "mol long, atom int, element string").repartition(3)
    bonds = spark.createDataFrame([(m, *b) for m, (_, bonds) in mols.items() for b in bonds], BONDS).repartition(3)
    return mols, atoms, bonds


def test_components_and_cycles(spark, some):
    mols, atoms, bonds = some
    got = {r.mol: (r.n_nodes, r.n_edges, r.n_components, r.n_cycles) for r in molecules.ring_counts(atoms, bonds).collect()}
    for m, adjacent in plain(mols).items():
        n_edges, parts = sum(map(len, adjacent.values())) // 2, len(set(brute_labels(adjacent).values()))
        assert got[m] == (len(adjacent), n_edges, parts, n_edges - len(adjacent) + parts)
    labels = {(r.mol, r.node): r.label for r in graphs.component_labels(atoms, bonds, ["mol"], "atom").collect()}
    assert labels == {(m, n): x for m, adjacent in plain(mols).items() for n, x in brute_labels(adjacent).items()}


def test_components_of_one_long_path(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(301)], "node int")
    got = {r.node: r.label for r in graphs.component_labels(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 300: 300}
    assert graphs.component_labels(nodes.limit(0), edges.limit(0)).collect() == []


@pytest.mark.parametrize("keep_double", [True, False])
def test_scaffolds(some, keep_double):
    mols, _, bonds = some
    got = {(r.mol, r.a, r.b, r.kind) for r in molecules.scaffold_bonds(bonds, keep_double=keep_double).collect()}
    assert got == {(m, *e) for m, adjacent in plain(mols).items() for e in brute_core(adjacent, keep_double)}


def test_scaffold_keys_feed_a_group_split(some):
    mols, atoms, bonds = some
    keys = {r.mol: r.scaffold for r in molecules.scaffold_keys(atoms, bonds, missing="none").collect()}
    want = {}
    for m, adjacent in plain(mols).items():
        core = brute_core(adjacent, True)
        held = defaultdict(dict)
        for a, b, k in core:
            held[a][b] = held[b][a] = k
        want[m] = tuple(sorted(brute_colours(held, {n: "CNO"[n % 3] for n in held}, 4).values()))
    assert set(keys) == set(mols) and all((keys[m] == "none") == (not want[m]) for m in mols)
    assert all((keys[m] == keys[n]) == (want[m] == want[n]) for m in mols for n in mols)
    assert keys[100] == keys[103] != keys[101]
    side = frames.group_budget_split(molecules.scaffold_keys(atoms, bonds), "scaffold", 0.3).collect()
    assert sum(r.n for r in side) == len(mols) and len({r.scaffold for r in side}) == len(side)


def test_surroundings_are_equal_where_they_look_alike(some):
    mols, atoms, bonds = some
    got = {(r.mol, r.node): r.hash for r in graphs.surroundings(atoms, bonds, ["mol"], F.col("element"), 2, "atom", kind="kind").filter("radius = 2").collect()}
    want = {(m, n): c for m, adjacent in plain(mols).items() for n, c in brute_colours(adjacent, {n: "CNO"[n % 3] for n in adjacent}, 2).items()}
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values())) == len(set(zip(got.values(), (want[k] for k in got))))


def test_fingerprints_fold_the_surroundings(some):
    mols, atoms, bonds = some
    got = {r.mol: r.bits for r in molecules.circular_fingerprints(atoms, bonds, bits=256).collect()}
    degree = {(m, n): len(o) for m, adjacent in plain(mols).items() for n, o in adjacent.items()}
    known = atoms.sparkSession.createDataFrame([(m, n, f"{'CNO'[n % 3]}|{d}") for (m, n), d in degree.items()], "mol long, atom int, start string")
    want = defaultdict(set)
    for r in graphs.surroundings(known, bonds, ["mol"], F.col("start"), 2, "atom", kind="kind").collect():
        want[r.mol].add(r.hash % 256)
    assert {m: {64 * w + i for w, x in enumerate(bits) for i in range(64) if x >> i & 1} for m, bits in got.items()} == want
    twins = {m: got[m] for m in (100, 103)}
    assert twins[100] != twins[103] and all(len(b) == 4 for b in got.values())


def test_a_hub_is_counted_in_parts(spark):
    bonds = spark.range(1, 3001).select(F.lit(1).cast("long").alias("mol"), F.lit(0).alias("a"), F.col("id").cast("int").alias("b"), F.lit(1).alias("kind"))
    atoms = spark.range(3001).select(F.lit(1).cast("long").alias("mol"), F.col("id").cast("int").alias("atom"), F.lit("C").alias("element"))
    kinds = graphs.surroundings(atoms, bonds, ["mol"], F.col("element"), 1, "atom", kind="kind").groupBy("radius").agg(F.count_distinct("hash").alias("n")).collect()
    assert {r.radius: r.n for r in kinds} == {0: 1, 1: 2}
    assert molecules.scaffold_bonds(bonds).collect() == [] and molecules.ring_counts(atoms, bonds).first().n_cycles == 0


RECORD = """caffeine-like
  made here

  3  2  0  0  0  0  0  0  0  0999 V2000
    1.0000   -2.5000    0.0000 C   0  0
    0.1250    0.0000    3.0000 Cl  0  0
 -100.0000    0.0000    0.0000 N   0  0
  1  2  1  0
  2  3  2  0
M  END
>  <ID>
mol-7

>  <NOTE> (3)
two
lines

>  <ID>
mol-8

"""


def test_records(spark):
    rows = [(1, RECORD, "old"), (2, RECORD.replace("\n", "\r\n"), ""), (3, "", ""), (4, "a\nb\nc\n  x  y\n", ""), (5, "a\nb\nc\n  2  0  0\n", ""), (6, None, ""), (7, "\n\n\n  0  0\nM  END", "")]
    parsed = molecules.parse_records(spark.createDataFrame(rows, "k long, value string, name string"))
    got = {r.k: r for r in parsed.collect()}
    assert (got[1].name, got[1].n_atoms, got[1].n_bonds, got[1].fields) == ("caffeine-like", 3, 2, {"NOTE": "two\nlines", "ID": "mol-8"})
    assert got[2].fields == got[1].fields and got[2].atom_lines == got[1].atom_lines
    assert all(got[k].n_atoms is None and not got[k].atom_lines for k in (3, 4, 5, 6)) and got[7].n_atoms == 0
    atoms = [(r.atom, r.x, r.y, r.z, r.element) for r in molecules.atom_rows(parsed, "k").filter("k = 1").orderBy("atom").collect()]
    assert atoms == [(1, 1.0, -2.5, 0.0, "C"), (2, 0.125, 0.0, 3.0, "Cl"), (3, -100.0, 0.0, 0.0, "N")]
    assert sorted((r.a, r.b, r.kind) for r in molecules.bond_rows(parsed, "k").filter("k = 2").collect()) == [(1, 2, 1), (2, 3, 2)]


def test_record_round_trip(spark, some):
    mols, atoms, _ = some
    once = spark.createDataFrame([(m, a, b, k) for m, adjacent in plain(mols).items() for a in adjacent for b, k in adjacent[a].items() if a < b], BONDS)
    placed = atoms.withColumns({"x": F.col("atom") * 1.5, "y": F.lit(-0.25), "z": F.lit(None).cast("double")})
    texts = molecules.format_records(atoms.select("mol").distinct(), placed, once, "mol")
    parsed = molecules.parse_records(texts)
    back = Counter((r.mol, r.atom, r.x, r.y, r.z, r.element) for r in molecules.atom_rows(parsed, "mol").collect())
    assert back == Counter((m, n, n * 1.5, -0.25, 0.0, "CNO"[n % 3]) for m, (nodes, _) in mols.items() for n in nodes)
    assert sorted(map(tuple, molecules.bond_rows(parsed, "mol").collect())) == sorted(map(tuple, once.collect()))
    many = spark.range(1000).select(F.lit(1).alias("mol"), (F.col("id") + 1).alias("atom"), F.lit("C").alias("element"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert molecules.format_records(many.select("mol").distinct(), many, once.limit(0), "mol").first().value is None
