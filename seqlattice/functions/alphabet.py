"""Residue codes and genetic codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: 23 residues, the gap sign and the mark before a sequence; a letter's place is its code.
ALPHABET = "ARNDCQEGHILKMFPSTWYVBZX-@"
RANK, GAP, PRE = 23, 23, 24
#: Residues that are counted when frequencies of pure pairs are estimated.
PURE = 20

#: Amino acids by codon in the order TTT, TTC, TTA, TTG, TCT ... GGG (bases T C A G), X for a stop.
GENETIC_CODES = (
    "FFLLSSSSYYXXCCXWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "FFLLSSSSYYXXCCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSXXVVVVAAAADDEEGGGG",
    "FFLLSSSSYYXXCCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    "FFLLSSSSYYXXCCXWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
)

_CODES = np.full(256, RANK - 1, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _CODES[ord(_c.lower())] = _i


def code(letter: Column) -> Column:
    """The code of a letter; letters beyond the alphabet have none (null)."""
    at = F.instr(F.lit(ALPHABET), F.upper(letter))
    return F.when((F.length(letter) == 1) & (at > 0), at - 1)


def encoded(text: bytes) -> np.ndarray:
    """Codes of the letters of an ASCII text; letters beyond the alphabet count as X."""
    return _CODES[np.frombuffer(text, np.uint8)]
