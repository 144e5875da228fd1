"""Parsing of fixed-width and log-style result texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of lines that a cleaned receptor keeps (fixed values).
KEPT_TAGS = ("ATOM", "HETATM", "TER", "REMARK", "ENDMDL", "MODEL", "END")
#: Name, first column and width of the fields of an atom line (fixed values).
ATOM_FIELDS = (("serial", 7, 5, "int"), ("name", 13, 4, "string"), ("residue", 18, 3, "string"), ("residue_no", 23, 4, "int"), ("x", 31, 8, "double"), ("y", 39, 8, "double"), ("z", 47, 8, "double"), ("charge", 71, 6, "double"), ("atom_type", 78, 2, "string"))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def result_score(text: Column) -> Column:
    """The score of the first result remark: the fourth word of its line; null if there is none or it is no number."""
    return _first(text, r"(?m)^REMARK VINA RESULT:[ \t]*(\S+)")


def table_score(text: Column) -> Column:
    """The score of the first mode in a result table."""
    return _first(text, r"(?m)^\s*1\s+(-?\d+\.\d+)")


def log_score(text: Column) -> Column:
    """The score of the first mode in a log: the second word of the first line that begins with 1 and a space and has a number there, whole or not."""
    words = F.regexp_extract_all(text, F.lit(r"(?m)^[^\S\n]*1 [^\S\n]*(\S+)"), F.lit(1))
    return F.get(F.filter(F.transform(words, lambda w: w.try_cast("double")), lambda v: v.isNotNull()), F.lit(0))


def cascade_score(log: Column, stdout: Column, output: Column) -> Column:
    """The first score that the log, the standard output or the output file gives."""
    return F.coalesce(log_score(log), table_score(stdout), result_score(output))


def word_number(line: Column, k: int) -> Column:
    """Word k (from 0) of a line as a double, null if there is none or it is no number."""
    return F.get(F.split(F.trim(line), r"\s+"), F.lit(k)).try_cast("double")


def has_atoms(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"(?m)^(ATOM|HETATM)")), F.lit(False))


def line_tag(line: Column) -> Column:
    return F.trim(F.substring(line, 1, 6))


def atom_fields(line: Column) -> list[Column]:
    """The fields of an atom line; those that cannot be read are null."""
    cut = lambda at, n: F.trim(F.substring(line, at, n))
    return [line_tag(line).alias("tag"), *((cut(at, n) if kind == "string" else cut(at, n).try_cast(kind)).alias(name) for name, at, n, kind in ATOM_FIELDS)]


def single_root(text: Column) -> Column:
    """A text with more than one ROOT line is cut after its first ENDROOT line; one without TORSDOF gets a line of it, always at its end (also behind an ENDROOT, and where several ROOT lines have no ENDROOT)."""
    lines = F.split(text, "\n")
    roots = F.size(F.filter(lines, lambda x: F.trim(x) == "ROOT"))
    end = F.array_position(F.transform(lines, F.trim), "ENDROOT").cast("int")
    cut = F.when((roots > 1) & (end > 0), F.array_join(F.slice(lines, F.lit(1), end), "\n")).otherwise(text)
    return F.when(cut.contains("TORSDOF"), cut).otherwise(F.concat(F.rtrim(cut), F.lit("\nTORSDOF 0\n")))


def clean_receptor(text: Column) -> Column:
    """Only lines with one of the tags that a receptor keeps."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(F.substring(x, 1, 6)).isin(*KEPT_TAGS)), "\n")


#: Tags of what is left of a structure when only standard residues are kept (fixed values).
STANDARD_TAGS = ("ATOM", "TER", "MODEL", "ENDMDL", "END")


def standard_residues(text: Column) -> Column:
    """Only atoms of standard residues, and the lines that part chains and models: water, ligands and other hetero atoms go."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: F.trim(F.substring(x, 1, 6)).isin(*STANDARD_TAGS)), "\n")


def file_stem(path: Column, *suffixes: str) -> Column:
    """The name of a file without folder, extension and one of the suffixes."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.regexp_replace(stem, f"({'|'.join(suffixes)})$", "") if suffixes else stem
