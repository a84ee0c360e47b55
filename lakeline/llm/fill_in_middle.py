"""Fill-in-the-middle rewriting: texts cut at two token ranks found in an indexable skip list.

A text is a row of units: a run of A-Z and a-z, or any other single code point.  The
skip list's lowest lane has one node a unit, with the unit's width in code points; each
express lane above keeps about one node in four (by a fixed mix of the node's place, so
every run builds the same list) and on each of its links the units and the code points
it passes over.  A rank is reached from the top lane down: a link is taken while the
units passed stay within the rank, and the code points passed add up along the way.  The
sums are integers over whole units, so a cut is exact at any length.

Only the cut places come out of Python; the parts, the rewritten text and its
restoration are Spark expressions on the text itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE = 1 << 20  # code points split into units at a time
CUTS = "n long, prefix_chars long, middle_chars long"


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit, in order."""
    starts, inside = [], False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32)
        letter = (codes | 32) - np.uint32(97) < 26
        goes_on = letter & np.concatenate([[inside], letter[:-1]])
        starts.append(np.flatnonzero(~goes_on) + at)
        inside = bool(letter[-1])
    return np.diff(np.concatenate([*starts, [len(text)]])) if starts else np.zeros(0, np.int64)


class SkipList:
    """Units by rank: ``chars(rank)`` is the number of code points before unit ``rank``.

    ``lanes[0]`` is the lowest; a lane is (units, chars, down): what each link passes
    over, and where its node stands in the lane below.  All lanes begin with the first unit.
    """

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        units, chars, place = np.ones(len(widths), np.int64), widths, np.arange(len(widths))
        self.lanes = [(units, chars, None)]
        mixed = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        while len(place) > 8:
            mixed >>= np.uint64(2)
            tall = mixed & np.uint64(3) == 0
            tall[0] = True
            down = np.flatnonzero(tall)
            if len(down) == len(place):
                break
            units, chars = np.add.reduceat(units, down), np.add.reduceat(chars, down)
            place, mixed = place[down], mixed[down]
            self.lanes.append((units, chars, down))

    def chars(self, rank: int) -> int:
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = passed = total = 0
        for units, chars, down in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed, total, node = passed + int(units[node]), total + int(chars[node]), node + 1
            if passed == rank:
                break
            node = int(down[node]) if down is not None else node
        return total


def cuts_of(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Units, and code points of prefix and middle, cut at the two draws modulo units + 1."""
    units = SkipList(unit_widths(text))
    low, high = sorted((first % (units.size + 1), second % (units.size + 1)))
    end = units.chars(low)
    return units.size, end, units.chars(high) - end


def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    rows = map(cuts_of, texts, first.tolist(), second.tolist())
    return pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"]).astype("int64")


def fill_in_middle(
    docs: DataFrame, seed: int = 1, rewritten: int = 90, suffix_first: int = 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Struct ``doc`` (all columns), n, form, prefix_chars, middle_chars, output; a row per row.

    Four draws come from the first 32 hex digits of sha256("seed:id").  The first two
    cut the text, modulo n + 1; of every hundred values of the third ``rewritten`` give a
    rewritten text, and of the fourth ``suffix_first`` give the form spm instead of psm.
    A text that is empty or holds a mark stays as it is (form plain, no lengths).

    A null text counts as empty, a null id as an empty string; repeated rows and ties each
    get their own row with the same answer; an empty table gives an empty result.  All
    columns travel in the struct, so none can clash.  Memory is about 25 bytes a code point
    of the longest text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), *draws)
    marked = F.col("body").contains(PREFIX) | F.col("body").contains(SUFFIX) | F.col("body").contains(MIDDLE)
    plain = (F.col("body") == "") | marked | (F.col("h3") % 100 >= rewritten)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc", "body", form.alias("form"), F.pandas_udf(cuts, CUTS)("body", "h1", "h2").alias("cut"))
    head, mid = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    whole = F.length("body")
    prefix, middle = F.substring("body", F.lit(1), head), F.substring("body", head + 1, mid)
    suffix = F.substring("body", head + mid + 1, whole)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body"))
    cut = F.col("form") != "plain"
    return rows.select(
        "doc", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.prefix_chars")).alias("prefix_chars"),
        F.when(cut, F.col("cut.middle_chars")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    A rewritten text holds no mark, so the first of each mark is the one that was put in.
    """
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    width, whole = len(PREFIX), F.length(output)
    tail = F.substring(output, m + width, whole)
    psm = F.concat(F.substring(output, p + width, s - p - width), tail, F.substring(output, s + width, m - s - width))
    spm = F.concat(F.substring(output, p + width, m - p - width), tail, F.substring(output, s + width, p - s - width))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
