"""Multiple alignments as rows (alignment, row, first residue, text), and what can be done with them.

Columns are ``ali`` (any type), ``rid`` (any orderable type), ``s`` and ``e`` (residues before the row's first
and up to its last) and ``aligned``; further columns stay. Positions are 0-based. Column statistics of an
alignment are partial aggregates by (alignment, position) that meet the rows in a join, so no alignment is
gathered in one task. A null text has no characters and stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GAPS = "-."
GAP = "-"


def chars(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def text_of(parts: Column) -> Column:
    return F.array_join(parts, "")


def is_gap(c: Column) -> Column:
    return c.isin(list(GAPS))


def residues(text: Column | str) -> Column:
    """How many characters are no gaps."""
    return F.length(F.translate(text, GAPS, ""))


def _cells(mali: DataFrame) -> DataFrame:
    return mali.select("ali", "rid", F.posexplode(chars("aligned")).alias("pos", "ch"))


def _each(f: Callable[[Column, Column], Column]) -> Column:
    return text_of(F.transform(chars("aligned"), f))


def columns(mali: DataFrame) -> DataFrame:
    """(ali, pos, column): the characters of every column, in the order of the rows."""
    cells = _cells(mali).groupBy("ali", "pos").agg(F.array_sort(F.collect_list(F.struct("rid", "ch"))).alias("c"))
    return cells.select("ali", "pos", text_of(F.transform("c", lambda x: x["ch"])).alias("column"))


def consensus(mali: DataFrame, mark_with_gaps: bool = False) -> DataFrame:
    """(ali, consensus): the commonest character of each column that is no gap, the smallest of equals; a column
    of gaps alone is a gap, and with ``mark_with_gaps`` any column with a gap is."""
    counted = _cells(mali).groupBy("ali", "pos", "ch").agg(F.count("*").alias("n"))
    best = F.max_by("ch", F.when(F.col("ch") != GAP, F.struct("n", -F.ascii("ch"))))
    any_gap = F.max((F.col("ch") == GAP).cast("int")) == 1
    one = counted.groupBy("ali", "pos").agg(F.when(any_gap if mark_with_gaps else F.lit(False), GAP).otherwise(F.coalesce(best, F.lit(GAP))).alias("ch"))
    whole = one.groupBy("ali").agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("c"))
    return whole.select("ali", text_of(F.transform("c", lambda x: x["ch"])).alias("consensus"))


def remove_unaligned_ends(mali: DataFrame) -> DataFrame:
    """Lower-case ends become gaps, and first and last residue move. At the end of a row as many gaps are put as
    the row has characters before the end."""
    lower = lambda x: F.length(F.regexp_replace(x, "[^a-z]", ""))
    first = F.regexp_extract("aligned", "^[- .a-z]+", 0)
    out = mali.withColumn("_f", first).withColumn("s", F.col("s") + lower(F.col("_f")))
    out = out.withColumn("aligned", F.concat(F.repeat(F.lit(GAP), F.length("_f")), F.substring("aligned", F.length("_f") + 1, F.length("aligned"))))
    out = out.withColumn("_f", F.regexp_extract(F.reverse("aligned"), "^[- .a-z]+", 0)).withColumn("e", F.col("e") - lower(F.col("_f")))
    keep = F.length("aligned") - F.length("_f")
    cut = F.concat(F.substring("aligned", F.lit(1), keep), F.repeat(F.lit(GAP), keep))
    return out.withColumn("aligned", F.when(F.length("_f") > 0, cut).otherwise(F.col("aligned"))).drop("_f")


def _with(mali: DataFrame, found: DataFrame) -> DataFrame:
    return mali.join(found.withColumnRenamed("ali", "_ali"), F.col("ali").eqNullSafe(F.col("_ali")), "left").drop("_ali")


def remove_end_gaps(mali: DataFrame) -> DataFrame:
    """Cut the columns before the shortest run of gaps at a row's start and behind the longest row that ends in
    gaps; rows without such gaps have no say."""
    first, last = F.regexp_extract("aligned", "^[- ]+", 0), F.regexp_extract(F.reverse("aligned"), "^[- ]+", 0)
    ends = mali.groupBy("ali").agg(
        F.coalesce(F.min(F.when(F.length(first) > 0, F.length(first))), F.max(F.length("aligned"))).alias("_a"),
        F.coalesce(F.max(F.when(F.length(last) > 0, F.length("aligned") - F.length(last))), F.lit(0)).alias("_b"),
    )
    cut = F.when(F.col("_b") > F.col("_a"), F.substring("aligned", F.col("_a") + 1, F.col("_b") - F.col("_a"))).otherwise(F.lit(""))
    return _with(mali, ends).withColumn("aligned", F.when(F.col("aligned").isNotNull(), cut)).drop("_a", "_b")


def insert_columns(mali: DataFrame, position: int, number: int, keep_fixed: Sequence = (), char: str = GAP) -> DataFrame:
    """Gaps at a position; rows in ``keep_fixed`` get them behind the inserted stretch instead."""
    width = mali.groupBy("ali").agg(F.max(F.length("aligned")).alias("_w"))
    at = F.when(F.col("rid").isin(list(keep_fixed)), F.least(F.col("_w"), F.lit(position + number))).otherwise(F.lit(position))
    put = F.concat(F.substring("aligned", F.lit(1), at), F.lit(char * number), F.substring("aligned", at + 1, F.length("aligned")))
    return _with(mali, width).withColumn("aligned", put).drop("_w")


def take_columns(mali: DataFrame, which: Sequence[int] | Column) -> DataFrame:
    """The columns with these positions, in their order."""
    which = which if isinstance(which, Column) else F.array(*map(F.lit, which)).cast("array<int>")
    return mali.withColumn("aligned", F.when(F.col("aligned").isNotNull(), text_of(F.transform(which, lambda x: F.substring(F.col("aligned"), x + 1, F.lit(1))))))


def remove_pattern(mali: DataFrame, pattern: str, allowed: int = 0, minimum: int = 1, delete_frame: int = 1, search_frame: int = 1) -> DataFrame:
    """Keep the columns at which at least ``allowed`` and less than ``minimum`` rows match the pattern. Rows are
    compared in steps of ``search_frame`` characters; a removed column takes its ``delete_frame`` along."""
    starts = F.filter(F.sequence(F.lit(0), F.length("aligned") - 1), lambda x: (x % search_frame == 0) & F.substring(F.col("aligned"), x + 1, F.lit(search_frame)).rlike(f"^(?:{pattern})$"))
    hits = mali.where(F.length("aligned") > 0).select("ali", F.explode(starts).alias("x")).groupBy("ali", "x").agg(F.count("*").alias("n"))
    hits = hits.groupBy("ali").agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("_n"))
    width = mali.groupBy("ali").agg(F.max(F.length("aligned")).alias("_w"))
    every = F.when(F.col("_w") > 0, F.sequence(F.lit(0), F.col("_w") - 1)).otherwise(F.array().cast("array<int>"))
    good = lambda x: F.coalesce(F.try_element_at(F.col("_n"), x), F.lit(0)).between(allowed, minimum - 1)
    kept = F.filter(every, good)
    if delete_frame > 1:
        lost = F.transform(F.filter(every, lambda x: ~good(x)), lambda x: F.floor(x / delete_frame))
        kept = F.filter(kept, lambda x: ~F.array_contains(lost, F.floor(x / delete_frame)))
    return take_columns(_with(_with(mali, width), hits), kept).drop("_w", "_n")


def remove_gaps(mali: DataFrame, allowed: int = 0, minimum: int = 1, frame: int = 1) -> DataFrame:
    """Without the columns of ``minimum`` gaps and more; whole frames go with them."""
    return remove_pattern(mali, "[-.]", allowed, minimum, frame)


def remove_empty(mali: DataFrame) -> DataFrame:
    return mali.where(residues("aligned") > 0)


def shift(mali: DataFrame, offsets: DataFrame) -> DataFrame:
    """First and last residue moved by the offset of the row's id (rid, o); rows without one stay."""
    moved = mali.join(offsets.select(F.col("rid").alias("_r"), "o"), F.col("rid") == F.col("_r"), "left").drop("_r")
    return moved.withColumn("s", F.col("s") + F.coalesce("o", F.lit(0))).withColumn("e", F.col("e") + F.coalesce("o", F.lit(0))).drop("o")


def mark_codons(mali: DataFrame) -> DataFrame:
    """Codons in upper and lower case by turns; a row of another length is an error."""
    marked = _each(lambda x, i: F.when(F.floor(i / 3) % 2 == 0, F.upper(x)).otherwise(F.lower(x)))
    return mali.withColumn("aligned", F.when(F.length("aligned") % 3 == 0, marked).otherwise(F.raise_error(F.lit("a row's length is no multiple of 3"))))


def mark_transitions(mali: DataFrame, transitions: Column, mode: str = "case", by_residue: bool = False, mask: str = "x") -> DataFrame:
    """Mark exons: the case changes at each transition, or every other exon becomes gaps (``keep-odd``,
    ``keep-even``). ``transitions`` are columns of the alignment, or residue numbers of the row; lower-case
    characters are masked first. Residue transitions leave gaps alone."""
    before = lambda i: residues(F.substring(F.col("aligned"), F.lit(1), i))
    at = (lambda i: F.col("s") + before(i)) if by_residue else (lambda i: i)
    low = F.col("s") if by_residue else F.lit(0)
    odd = lambda i: F.size(F.filter(F.array_distinct(transitions), lambda t: (t >= low) & (t <= at(i)))) % 2 == 1

    def mark(x: Column, i: Column) -> Column:
        bare = F.when(x.rlike("^[a-z]$"), F.lit(mask)).otherwise(x)
        done = {"case": F.when(odd(i), F.lower(bare)).otherwise(F.upper(bare)), "keep-even": F.when(odd(i), bare).otherwise(GAP), "keep-odd": F.when(odd(i), GAP).otherwise(bare)}[mode]
        return F.when(is_gap(x), x).otherwise(done) if by_residue else done

    return mali.withColumn("aligned", F.when(F.col("aligned").isNotNull(), _each(mark)))


def residue_columns(text: Column) -> Column:
    """Positions of the characters that are no gaps."""
    return F.filter(F.transform(chars(text), lambda x, i: F.when(~is_gap(x), i)), lambda x: x.isNotNull())


def column_map(this: Column, other: Column) -> Column:
    """For every column of ``this`` the column of ``other`` with the same residue, null for gaps. Both have to be
    rows of one sequence."""
    places = residue_columns(other)
    return F.transform(chars(this), lambda x, i: F.when(~is_gap(x), F.get(places, residues(F.substring(this, F.lit(1), i)))))


def copy_annotation(annotation: Column, mapped: Column) -> Column:
    """An annotation of another alignment, put into this one's columns by a column map."""
    return text_of(F.transform(mapped, lambda m: F.when(m.isNull(), GAP).otherwise(F.substring(annotation, m + 1, F.lit(1)))))


def _where_rows(mali: DataFrame, match: Callable[[Column], Column], least: int) -> DataFrame:
    found = _cells(mali).where(match(F.col("ch"))).groupBy("ali", "pos").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _with(mali, found.groupBy("ali").agg(F.collect_set("pos").alias("_c"))).withColumn("_c", F.coalesce("_c", F.array().cast("array<int>")))


def map_columns(mali: DataFrame, which: Sequence[int] | Column, f: Callable[[Column], Column]) -> DataFrame:
    """Apply ``f`` to all residues in the columns."""
    which = which if isinstance(which, Column) else F.array(*map(F.lit, which)).cast("array<int>")
    return mali.withColumn("aligned", F.when(F.col("aligned").isNotNull(), _each(lambda x, i: F.when(F.array_contains(which, i) & ~is_gap(x), f(x)).otherwise(x))))


def mask_columns(mali: DataFrame, which: Sequence[int] | Column, mask: str = "x") -> DataFrame:
    return map_columns(mali, which, lambda x: F.lit(mask))


def propagate_masks(mali: DataFrame, least: int = 1, mask: str = "x") -> DataFrame:
    """Mask the columns in which ``least`` rows are masked."""
    return mask_columns(_where_rows(mali, lambda c: F.lower(c) == mask, least), F.col("_c"), mask).drop("_c")


def propagate_transitions(mali: DataFrame) -> DataFrame:
    """Lower case in a column for all of its residues."""
    return map_columns(_where_rows(mali, lambda c: c.rlike("^[a-z]$"), 1), F.col("_c"), F.lower).drop("_c")


def recount(mali: DataFrame, reset_first: bool = False) -> DataFrame:
    first = F.lit(0) if reset_first else F.col("s")
    return mali.withColumn("s", first).withColumn("e", F.col("s") + residues("aligned"))


def clip_by_annotation(mali: DataFrame, annotation: Column, letters: str) -> DataFrame:
    """The columns whose annotation is one of ``letters``; without letters all."""
    if not letters:
        return mali
    which = F.filter(F.transform(chars(annotation), lambda x, i: F.when(x.isin(list(letters)), i)), lambda x: x.isNotNull())
    return take_columns(mali, which)


def truncate(mali: DataFrame, first: int, last: int) -> DataFrame:
    return mali.withColumn("aligned", F.substring("aligned", first + 1, max(0, last - first)))


def map_identifiers(mali: DataFrame, names: DataFrame | None = None, pattern: str = "ID%06d") -> DataFrame:
    """Rows with the new names of (rid, name), or numbered names within their alignment."""
    if names is not None:
        return mali.join(names, "rid")
    return mali.withColumn("name", F.format_string(pattern, F.row_number().over(W.partitionBy("ali").orderBy("rid"))))


def alphabet(mali: DataFrame) -> DataFrame:
    """(ali, alphabet): na if less than a tenth of the residues are other than acgtxn, else aa."""
    bare = F.lower(F.translate("aligned", GAPS, ""))
    sums = mali.groupBy("ali").agg(F.sum(F.length(bare)).alias("n"), F.sum(F.length(F.regexp_replace(bare, "[acgtxn]", ""))).alias("k"))
    return sums.select("ali", F.when(F.col("k") < F.col("n") * 0.1, "na").otherwise("aa").alias("alphabet"))


def same_length(mali: DataFrame) -> DataFrame:
    return mali.groupBy("ali").agg((F.min(F.length("aligned")).eqNullSafe(F.max(F.length("aligned")))).alias("consistent"))


def apply(mali: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return mali.withColumn("aligned", f(F.col("aligned")))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get _1, _2, ... in order."""
    nth = F.row_number().over(W.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn(name, F.when(nth > 0, F.concat(F.col(name), F.lit("_"), nth.cast("string"))).otherwise(F.col(name)))


def ruler(length: Column, prefix: str = "", start: int = 0, bottom: bool = False) -> Column:
    """Two lines that show the positions of an alignment of this width."""
    marks = F.concat(F.lit(prefix), F.repeat(F.lit("----.----|"), F.floor(length / 10).cast("int")), F.substring(F.lit("----.----|"), F.lit(1), (length % 10).cast("int")), F.lit("\n"))
    tens = F.when(length > 50, F.sequence(F.lit(50), length - 1, F.lit(50))).otherwise(F.array().cast("array<int>"))
    numbers = F.transform(tens, lambda i: F.rpad((i + start).cast("string"), 50, " "))
    line = F.when(length > 50, F.concat(F.lit(prefix + " " * 49), text_of(numbers), F.lit("\n"))).otherwise(F.lit(prefix))
    return F.concat(marks, line) if bottom else F.concat(line, marks)


def residue_number(first: Column, text: Column, position: Column | int) -> Column:
    """The number of the residue at a column."""
    return first + residues(F.substring(text, F.lit(1), position if isinstance(position, Column) else F.lit(position)))
