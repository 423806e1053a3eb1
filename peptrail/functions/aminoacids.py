"""The twenty standard residues and Grantham's distances between them (Science 185:862-864, 1974)."""

from __future__ import annotations

import numpy as np

#: fixed values: residues in the order of the published table, and its upper triangle row by row
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
_DISTANCES = """
112 111 126 195 91 107 60 86 94 96 106 84 113 27 99 58 148 112 64
86 96 180 43 54 125 29 97 102 26 91 97 103 110 71 101 77 96
23 139 46 42 80 68 149 153 94 142 158 91 46 65 174 143 133
154 61 45 94 81 168 172 101 160 177 108 65 85 181 160 152
154 170 159 174 198 198 202 196 205 169 112 149 215 194 192
29 87 24 109 113 53 101 116 76 68 42 130 99 96
98 40 134 138 56 126 140 93 80 65 152 122 121
98 135 138 127 127 153 42 56 59 184 147 109
94 99 32 87 100 77 89 47 115 83 84
5 102 10 21 95 142 89 61 33 29
107 15 22 98 145 92 61 36 32
95 102 103 121 78 110 85 97
28 87 135 81 67 36 21
114 155 103 40 22 50
74 38 147 110 68
58 177 144 124
128 92 69
37 88
55
"""
UNKNOWN = 255


def _table() -> np.ndarray:
    out = np.zeros((20, 20), np.int16)
    rows = [r.split() for r in _DISTANCES.strip().splitlines()]
    for i, row in enumerate(rows):
        for j, value in enumerate(row, start=i + 1):
            out[i, j] = out[j, i] = int(value)
    return out


DISTANCE = _table()
CODE = np.full(256, UNKNOWN, np.uint8)
CODE[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(20)


def distance(a: str, b: str) -> int:
    """Distance of two standard residues; others are an error."""
    i, j = RESIDUES.find(a), RESIDUES.find(b)
    if min(i, j) < 0 or len(a) != 1 or len(b) != 1:
        raise ValueError(f"no distance between {a!r} and {b!r}")
    return int(DISTANCE[i, j])


def encoded(sequence: str) -> np.ndarray:
    """Residue codes 0..19; any other character is ``UNKNOWN``."""
    return CODE[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]
