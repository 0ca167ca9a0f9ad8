"""Column functions over residue strings; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlattice.functions.alphabet import ALPHABET, GENETIC_CODES


def residues(seq: Column) -> Column:
    """The letters of an aligned sequence in upper case; gap signs, end marks and blanks go. Null stays null."""
    return F.upper(F.regexp_replace(seq, "[^A-Za-z]", ""))


def aligned(seq: Column) -> Column:
    """An aligned row in one spelling: upper case, ``-`` for every gap sign, no end mark, X for J, O and U. Null stays null."""
    return F.translate(F.upper(F.regexp_replace(seq, "[*]+$", "")), "JOU*~.", "XXX---")


def illegal_symbols(seq: Column) -> Column:
    """The symbols of a sequence that the alphabet lacks, in order: all but its letters in any case, ``-`` and ``@``."""
    return F.regexp_replace(seq, f"[{ALPHABET[:-2]}{ALPHABET[:-2].lower()}@\\s-]", "")


def without_lower_case(seq: Column) -> Column:
    """The sequence with every lower-case letter masked as a gap, so that columns keep their places."""
    return F.regexp_replace(seq, "[a-z]", "-")


def position_map(row: Column) -> Column:
    """The columns, from 1, of the residues of an aligned row."""
    return F.filter(F.transform(F.split(row, ""), lambda x, i: F.when(x != "-", i + 1)), lambda x: x.isNotNull())


def _spread(source: Column, runs: Column, width: int, moves: Callable[[Column], Column]) -> Column:
    """``source`` cut along ``runs``: a run that moves takes ``width`` signs for each of its own, another gives gaps.

    The source travels in the accumulator, so that it is computed once however it came about.
    """

    def step(acc: Column, run: Column) -> Column:
        n = F.length(run) * width
        moved = moves(run)
        return F.struct(
            F.concat(acc["out"], F.when(moved, F.substring(acc["source"], acc["at"], n)).otherwise(F.repeat(F.lit("-"), n))).alias("out"),
            (acc["at"] + F.when(moved, n).otherwise(0)).alias("at"),
            acc["source"].alias("source"),
        )

    return F.aggregate(runs, F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), source.alias("source")), step, lambda acc: acc["out"])


def gapped(seq: Column, script: Column, side: str) -> Column:
    """``seq`` spread by an edit script of B (both), X (first only) and Y (second only): a gap where the other side alone moves."""
    return _spread(seq, F.regexp_extract_all(script, F.lit("B+|X+|Y+"), F.lit(0)), 1, lambda run: F.substring(run, 1, 1).isin("B", side))


def translated(dna: Column, genetic_code: int | Column = 0) -> Column:
    """The protein of a coding sequence; codons with a sign other than A, C, G, T, U, and an incomplete last one, give X.

    ``genetic_code`` is the number of one code, or a column of such, one for each sequence; one beyond the codes gives null.
    """
    table = F.lit(GENETIC_CODES[genetic_code]) if isinstance(genetic_code, int) else F.get(F.array(*map(F.lit, GENETIC_CODES)), genetic_code)
    codons = F.regexp_extract_all(F.translate(F.upper(dna), "UTCAG", "00123"), F.lit("(?s).{1,3}"), F.lit(0))

    def residue(codon: Column) -> Column:
        place = [F.instr(F.lit("0123"), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3)]
        whole = (F.length(codon) == 3) & (F.least(*place) >= 0)
        return F.when(whole, F.substring(table, place[0] * 16 + place[1] * 4 + place[2] + 1, F.lit(1))).otherwise("X")

    joined = F.array_join(F.transform(codons, residue), "")
    return joined if isinstance(genetic_code, int) else F.when(table.isNotNull(), joined)


def back_mapped(row: Column, dna: Column) -> Column:
    """An aligned protein row as DNA: each residue takes the next three bases (the last may be short), each gap is ``---``."""
    return _spread(dna, F.regexp_extract_all(row, F.lit("-+|[^-]+"), F.lit(0)), 3, lambda run: ~run.startswith("-"))


def sccs(name: Column) -> Column:
    """The family token of a header, one letter and three one-digit numbers as in ``b.1.2.1``; null if there is none."""
    found = F.regexp_extract(name, r"([a-z]\.\d\.\d\.\d)(?!\d)", 1)
    return F.when(found != "", found)
