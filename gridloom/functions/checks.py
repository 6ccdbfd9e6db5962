"""Checksum and range tests as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The dihedral-group multiplication table and the position permutation table of the Verhoeff scheme.
VERHOEFF_MULTIPLY = ("0123456789", "1234067895", "2340178956", "3401289567", "4012395678",
                     "5987604321", "6598710432", "7659821043", "8765932104", "9876543210")
VERHOEFF_PERMUTE = ("0123456789", "1576283094", "5803796142", "8916043527",
                    "9453126870", "4286573901", "2793806415", "7046913258")


def verhoeff_ok(c: Column) -> Column:
    """True when the digits of a text pass the Verhoeff check (other characters are ignored)."""
    digits = F.split(F.reverse(F.regexp_replace(c, r"\D", "")), "")
    mult, perm = F.lit("".join(VERHOEFF_MULTIPLY)), F.lit("".join(VERHOEFF_PERMUTE))

    def at(table, row, col):
        return F.substring(table, row * 10 + col + 1, F.lit(1)).cast("int")

    steps = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: at(perm, i % 8, d.cast("int")))
    return (F.size(steps) > 0) & (F.aggregate(steps, F.lit(0), lambda acc, p: at(mult, acc, p)) == 0)


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)
