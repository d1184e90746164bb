"""RCC-8: relation sets as bit masks, composition, converse, and the sets that a network can reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. Relation i of n has bit n - i, so DC, the first of eight, is 128 and EQ is 1.
NAMES = ("DC", "EC", "PO", "TPP", "NTPP", "TPPi", "NTPPi", "EQ")
DC, EC, PO, TPP, NTPP, TPPI, NTPPI, EQ = 128, 64, 32, 16, 8, 4, 2, 1
UNIVERSAL = 255
CONVERSES = (1, 2, 3, 6, 7, 4, 5, 8)

# The composition of relation (row) and relation (column), as lists of relation numbers.
COMPOSITIONS = """
12345678 12345 12345 12345 12345 1 1 1
12367 123468 12345 2345 345 12 1 2
12367 12367 12345678 345 345 12367 12367 3
1 12 12345 45 5 123468 12367 4
1 1 12345 5 5 12345 12345678 5
12367 2367 367 3468 345 67 7 6
12367 367 367 367 345678 7 7 7
1 2 3 4 5 6 7 8
"""

#: What a query relation asks of the relation from the query's object to the answer.
WITHIN, TOUCHES, CONTAINS = TPPI | NTPPI, EC, TPP | NTPP


def mask(relations) -> int:
    """The mask of relation numbers, which may come as text."""
    return sum({1 << (8 - int(r)) for r in relations})


def numbers(m: int) -> list[int]:
    return [r for r in range(1, 9) if m >> (8 - r) & 1]


class Calculus:
    """The tables of the calculus. A cell that is missing is an error."""

    def __init__(self, rows: str = COMPOSITIONS, converses: tuple[int, ...] = CONVERSES):
        table = [[mask(c) for c in line.split()] for line in rows.strip().splitlines()]
        if len(table) != 8 or any(len(r) != 8 for r in table):
            raise ValueError("a composition table has eight rows of eight cells")
        self.basic, self.opposite = table, converses

    @classmethod
    def parse(cls, text: str) -> Calculus:
        """From a file: relations, converses, then a line ``r1 r2 set`` for each cell."""
        lines = text.strip().splitlines()
        cells = {(int(a), int(b)): s.replace(",", "") for a, b, s in (x.split() for x in lines[2:])}
        missing = [(a, b) for a in range(1, 9) for b in range(1, 9) if (a, b) not in cells]
        if missing:
            raise ValueError(f"the calculus has no composition of {missing}")
        return cls("\n".join(" ".join(cells[a, b] for b in range(1, 9)) for a in range(1, 9)), tuple(map(int, lines[1].split())))

    def converse(self, m: int) -> int:
        return mask(self.opposite[r - 1] for r in numbers(m))

    def compose(self, a: int, b: int) -> int:
        out = 0
        for r in numbers(a):
            for s in numbers(b):
                out |= self.basic[r - 1][s - 1]
        return out

    def reachable(self, start) -> set[int]:
        """All sets that composition and intersection make of ``start``; composition never adds the universal set."""
        found: set[int] = set(start)
        new = set(found)
        while new:
            made = {self.compose(*p) for a in new for b in found for p in ((a, b), (b, a))} - {UNIVERSAL}
            made |= {a & b for a in new for b in found}
            new = made - found
            found |= new
        return found

    def compositions(self, spark: SparkSession, sets=None) -> DataFrame:
        """``r1, r2, comp`` over ``sets``, or all; at most 255 x 255 rows."""
        sets = sorted(sets if sets is not None else range(1, 256))
        return spark.createDataFrame([(a, b, self.compose(a, b)) for a in sets for b in sets if a and b], "r1 int, r2 int, comp int")

    def converses_of(self, rel: Column) -> Column:
        """The converse of a mask column: one look into a constant array."""
        return F.get(F.array(*[F.lit(self.converse(m)) for m in range(256)]), rel).cast("int")


def parse_set(c: Column) -> Column:
    """A mask from a comma list such as ``4,5,``."""
    parts = F.filter(F.split(c, ","), lambda x: F.length(x) > 0)
    return F.aggregate(parts, F.lit(0), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.lit(8) - x.cast("int"))))


def format_set(rel: Column) -> Column:
    """A comma list with a comma at its end."""
    return F.concat(*[F.when(rel.bitwiseAND(F.lit(1 << (8 - r))) != 0, F.lit(f"{r},")).otherwise("") for r in range(1, 9)])


def entails(rel: Column, asked: int) -> Column:
    """Whether every relation that ``rel`` leaves open is one of those asked for."""
    return (rel.bitwiseAND(F.lit(UNIVERSAL & ~asked)) == 0) & (rel != 0)


def overlaps(rel: Column, asked: int) -> Column:
    """The laxer test: some relation is asked for, and the set is no larger."""
    return (rel.bitwiseAND(F.lit(asked)) != 0) & (F.bit_count(rel) <= bin(asked).count("1"))
