"""Molecules as tables of atoms (mol, atom, element) and bonds (mol, a, b, kind): records, rings, scaffolds, fingerprints. No toolkit is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators import small_graphs as small
from siftstone.operators.graphs import both_ways, cycle_counts, folded_bits, surroundings, surroundings_by_rounds, without_leaves

#: First character and width of the fields of an atom line and of a bond line of a record (fixed values).
ATOM_LINE = (("x", 1, 10, "double"), ("y", 11, 10, "double"), ("z", 21, 10, "double"), ("element", 32, 3, "string"))
BOND_LINE = (("a", 1, 3, "int"), ("b", 4, 3, "int"), ("kind", 7, 3, "int"))
DOUBLE = 2


def _fields(line: Column, fields: tuple) -> list[Column]:
    cut = lambda at, n: F.trim(F.substring(line, at, n))
    return [(cut(at, n) if kind == "string" else cut(at, n).try_cast(kind)).alias(name) for name, at, n, kind in fields]


def parse_records(records: DataFrame, text: str = "value") -> DataFrame:
    """records with name, n_atoms, n_bonds, atom_lines, bond_lines and fields (a map of the data items) of each record.

    A record is a header of three lines, the line of counts, as many atom and bond lines as that says, and
    after a line that begins with M  END data items: a line >  <name>, then lines up to an empty one.
    A record whose counts cannot be read, or that has fewer lines than they say, has null counts and
    empty arrays. Of two items with one name the last one counts. Columns of records with the new names are replaced.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    rows = records.withColumn("__lines", lines).withColumn("__counts", F.get("__lines", F.lit(3)))
    count = lambda at: F.trim(F.substring("__counts", at, 3)).try_cast("int")
    rows = rows.withColumns({"n_atoms": count(1), "n_bonds": count(4)})
    fits = (F.col("n_atoms") >= 0) & (F.col("n_bonds") >= 0) & (F.size("__lines") >= F.col("n_atoms") + F.col("n_bonds") + 4)
    part = lambda start, n: F.when(fits, F.slice("__lines", start, n)).otherwise(F.array().cast("array<string>"))
    items = F.regexp_extract_all(F.regexp_replace(F.col(text), r"\r\n?", "\n"), F.lit(r"(?m)^>[^<\n]*<([^>\n]*)>[^\n]*\n((?:[^\n]+(?:\n|\z))*)"), F.lit(0))
    entry = lambda item: F.struct(F.regexp_extract(item, r"<([^>\n]*)>", 1).alias("key"), F.rtrim(F.regexp_extract(item, r"(?s)^[^\n]*\n(.*)", 1), F.lit("\n")).alias("value"))
    last = F.aggregate(F.transform(items, entry), F.array().cast("array<struct<key:string,value:string>>"), lambda done, x: F.concat(F.filter(done, lambda y: y["key"] != x["key"]), F.array(x)))
    return rows.withColumns(
        {
            "name": F.trim(F.get("__lines", F.lit(0))),
            "atom_lines": part(F.lit(5), F.col("n_atoms")),
            "bond_lines": part(F.lit(5) + F.col("n_atoms"), F.col("n_bonds")),
            "fields": F.map_from_entries(last),
            "n_atoms": F.when(fits, F.col("n_atoms")),
            "n_bonds": F.when(fits, F.col("n_bonds")),
        }
    ).drop("__lines", "__counts")


def atom_rows(parsed: DataFrame, key: str) -> DataFrame:
    """key, atom (from 1), x, y, z and element of parsed records."""
    # explode without _outer would add a filter on the lines that parses each record again for every field it reads
    return parsed.select(key, F.posexplode_outer("atom_lines").alias("at", "line")).filter("line IS NOT NULL").select(key, (F.col("at") + 1).alias("atom"), *_fields(F.col("line"), ATOM_LINE))


def bond_rows(parsed: DataFrame, key: str) -> DataFrame:
    """key, a, b and kind of parsed records; a bond line that cannot be read is left out."""
    return parsed.select(key, F.explode_outer("bond_lines").alias("line")).filter("line IS NOT NULL").select(key, *_fields(F.col("line"), BOND_LINE)).filter("a IS NOT NULL AND b IS NOT NULL")


def _place(c: str) -> Column:
    """A coordinate as %10.4f gives it; decimals are much quicker, and what they cannot say (-0.0000, very large, NaN) is left to it."""
    x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    size = F.abs(x)
    plain = F.lpad(F.when((size >= 0.001) & (size < 9999), x).cast("decimal(9,4)").cast("string"), 10, " ")
    return F.coalesce(plain, F.when(x.cast("string") == "0.0", F.lit("    0.0000")), F.format_string("%10.4f", x))


def format_records(molecules: DataFrame, atoms: DataFrame, bonds: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """key and value: a record of each molecule, without its separator. A record has up to 999 atoms and bonds, which is all that its counts can say; one with more is null."""
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    atom = F.concat(_place("x"), _place("y"), _place("z"), F.lit(" "), F.rpad("element", 3, " "), F.lit(" 0  0"))
    bond = F.concat(number("a", 3), number("b", 3), number("kind", 3), F.lit("  0"))
    lines = atoms.select(key, F.lit(True).alias("is_atom"), F.col("atom").cast("long").alias("first"), F.lit(0).cast("long").alias("second"), atom.alias("line"))
    lines = lines.union(bonds.select(key, F.lit(False), F.col("a").cast("long"), F.col("b").cast("long"), bond))
    in_order = lambda of: F.transform(F.sort_array(F.collect_list(F.when(of, F.struct("first", "second", "line")))), lambda s: s["line"])
    is_atom = F.col("is_atom")
    texts = lines.groupBy(key).agg(F.count_if(is_atom).alias("na"), F.count_if(~is_atom).alias("nb"), in_order(is_atom).alias("la"), in_order(~is_atom).alias("lb"))
    rows = molecules.select(key, (F.col(name) if name else F.lit("")).cast("string").alias("title")).join(texts, key, "left")
    na, nb = (F.coalesce(c, F.lit(0)) for c in ("na", "nb"))
    none = F.array().cast("array<string>")
    counts = F.concat(F.lpad(na.cast("string"), 3, " "), F.lpad(nb.cast("string"), 3, " "), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    text = F.array_join(F.concat(F.array(F.coalesce("title", F.lit("")), F.lit(""), F.lit(""), counts), F.coalesce("la", none), F.coalesce("lb", none), F.array(F.lit("M  END"))), "\n")
    return rows.select(key, F.when((na <= 999) & (nb <= 999), text).alias("value"))


def ring_counts(atoms: DataFrame, bonds: DataFrame, mol: str = "mol") -> DataFrame:
    """mol, n_nodes (atoms), n_edges (bonds), n_components and n_cycles (rings) of each molecule with an atom."""
    return cycle_counts(atoms, bonds, [mol], "atom")


#: Stands for a kind that is null; it is larger than any other.
NO_KIND = (1 << 63) - 1


def _kinds(kind: str) -> Column:
    return F.coalesce(F.col(kind).cast("long"), F.lit(NO_KIND))


def scaffold_bonds(bonds: DataFrame, mol: str = "mol", kind: str = "kind", keep_double: bool = True) -> DataFrame:
    """The bonds of rings and of the linkers between them: side chains are taken off from their ends. keep_double: an atom held to these by a double bond stays too. A molecule without a ring has none.

    Of repeated bonds the least kind counts. Molecules of up to small_graphs.WHOLE bonds are done whole in a task, larger ones by rounds of joins.
    """
    if not small.can_be_small([mol], (bonds, "a"), (bonds, "b"), (bonds, kind)):
        return _scaffold_bonds_by_rounds(bonds, mol, kind, keep_double)
    types = {c: bonds.schema[c].dataType for c in ("a", "b", kind)}
    rows = small.graph_rows([mol], bonds.withColumn("value", _kinds(kind)), "a", "b", more=["value"])
    done, rest = small.through_tasks(rows, [mol], small.scaffolds(DOUBLE if keep_double else None))
    found = done if rest is None else done.select(mol, "a", "b", "value").union(_scaffold_bonds_by_rounds(rest, mol, "value", keep_double))
    return found.select(mol, *(F.col(c).cast(types[c]) for c in ("a", "b")), F.nullif("value", F.lit(NO_KIND)).cast(types[kind]).alias(kind))


def _scaffold_bonds_by_rounds(bonds: DataFrame, mol: str, kind: str, keep_double: bool) -> DataFrame:
    once = bonds.filter("a <> b").groupBy(mol, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(kind).alias(kind))
    core = without_leaves(once, [mol], kept=[kind])
    if not keep_double:
        return core
    inside = both_ways(core, [mol]).select(mol, "node").distinct()
    double = once.filter(F.col(kind) == DOUBLE)
    held = [double.join(inside.withColumnRenamed("node", end), [mol, end], "left_semi").select(mol, "a", "b", kind) for end in ("a", "b")]
    return core.union(held[0]).union(held[1]).dropDuplicates([mol, "a", "b"])


def scaffold_keys(atoms: DataFrame, bonds: DataFrame, mol: str = "mol", element: str = "element", kind: str = "kind", radius: int = 4, missing: str = "") -> DataFrame:
    """mol and scaffold: a text that is the same for equal scaffolds; missing for a molecule without a ring.

    It is made of the numbers of atoms and bonds and of the bag of hashed surroundings up to radius, so
    scaffolds that differ only farther away than that from every atom share a key. Molecules of up to small_graphs.WHOLE
    atoms and bonds are done whole in a task, larger ones by rounds of joins.
    """
    begun = atoms.select(mol, F.col("atom").alias("node"), F.xxhash64(element).alias("value"))
    if not small.can_be_small([mol], (atoms, "atom"), (bonds, "a"), (bonds, "b"), (bonds, kind)):
        return _scaffold_keys_by_rounds(begun, bonds, mol, kind, radius, missing)
    rows = small.graph_rows([mol], bonds.withColumn("value", _kinds(kind)), "a", "b", begun, "node", ["value"])
    done, rest = small.through_tasks(rows, [mol], small.scaffold_bags(radius, DOUBLE), dict.fromkeys(("n", "low", "high", "x"), "long"))
    done = done.select(mol, F.when(F.col("n") > 0, _scaffold_key()).otherwise(F.lit(missing)).alias("scaffold"))
    return done if rest is None else done.union(_scaffold_keys_by_rounds(*small.taken_apart(rest, [mol], "value"), mol, "value", radius, missing))


def _scaffold_key() -> Column:
    return F.concat_ws("-", F.col("n").cast("string"), F.hex(F.xxhash64("low", "high", "x")))


def _scaffold_keys_by_rounds(begun: DataFrame, bonds: DataFrame, mol: str, kind: str, radius: int, missing: str) -> DataFrame:
    """begun: mol, node and value, the hash that it begins with."""
    core = _scaffold_bonds_by_rounds(bonds, mol, kind, True)
    inside = both_ways(core, [mol]).select(mol, "node").distinct()
    own = begun.join(inside, [mol, "node"], "left_semi")
    linked = core.select(mol, "a", "b", F.xxhash64(kind).alias("value"))
    last = surroundings_by_rounds(own, linked, [mol], radius).filter(F.col("radius") == radius)
    h = F.col("hash")
    bags = last.groupBy(mol).agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))).alias("low"), F.sum(F.shiftrightunsigned(h, 33)).alias("high"), F.bit_xor(h).alias("x"))
    keys = bags.select(mol, _scaffold_key().alias("scaffold"))
    return begun.select(mol).distinct().join(keys, mol, "left").withColumn("scaffold", F.coalesce("scaffold", F.lit(missing)))


def circular_fingerprints(atoms: DataFrame, bonds: DataFrame, mol: str = "mol", element: str = "element", kind: str = "kind", radius: int = 2, bits: int = 2048) -> DataFrame:
    """mol and bits: hashed surroundings of each atom up to radius bonds away, folded to bits.

    An atom begins as its element and its number of bonds. The hashes are this library's own: a bit
    does not mean what the same bit of another toolkit means.
    """
    once = bonds.filter("a <> b").select(mol, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = both_ways(once, [mol]).groupBy(mol, F.col("node").alias("atom")).agg(F.count("*").alias("__degree"))
    known = atoms.join(degree, [mol, "atom"], "left")
    start = F.concat_ws("|", F.coalesce(F.col(element), F.lit("")), F.coalesce("__degree", F.lit(0)).cast("string"))
    return folded_bits(surroundings(known, bonds, [mol], start, radius, "atom", kind=kind), [mol], bits=bits)
