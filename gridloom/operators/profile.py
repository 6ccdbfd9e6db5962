"""Column profiles and catalogues. Everything starts from value counts per column (one expand and one aggregate with a
map-side partial), so each distinct value is tested once however many rows hold it."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.numbers import money_number
from gridloom.operators.scale import top_per_key


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n): rows per distinct value, as text; blank text counts as NULL."""
    pairs = [F.struct(F.lit(c).alias("column"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count("*").alias("n"))


def _share(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")


def profile(df: DataFrame, cols: Sequence[str], values: bool = True) -> DataFrame:
    """Type, blanks, distinct values, numeric range, and the admitted values of columns with 30 or fewer."""
    types = F.create_map(*[x for f in df.schema if f.name in cols for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    vc = value_counts(df, cols)
    num = F.col("value").try_cast("double")
    stats = vc.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("blank"), F.count("value").alias("distinct"),
        F.min(num).alias("low"), F.max(num).alias("high"), F.sum("n").alias("rows")).withColumn("type", F.get(F.array(types), F.lit(0))[F.col("column")])
    if not values:
        return stats
    lists = _lists(vc, 30)
    return stats.join(lists, "column", "left")


def _lists(vc: DataFrame, most: int) -> DataFrame:
    """Sorted value list of columns with at most `most` values; longer columns are dropped before anything is gathered."""
    few = vc.filter("value is not null").groupBy("column").agg(F.count("*").alias("d")).filter(F.col("d") <= most)
    kept = vc.filter("value is not null").join(few, "column", "left_semi")
    return kept.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("values"))


def categories(df: DataFrame, cols: Sequence[str], most: int = 50) -> DataFrame:
    return _lists(value_counts(df, cols), most)


def sheet_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Blank, distinct and three most frequent examples per column."""
    vc = value_counts(df, cols)
    base = vc.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("blank"), F.count("value").alias("distinct"))
    top = top_per_key(vc.filter("value is not null"), ["column"], [F.desc("n"), F.col("value")], 3)
    ex = top.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]), " | ").alias("examples"))
    return base.join(ex, "column", "left")


def spelling_groups(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, members, rows) of the near-equal spellings in each of the columns."""
    from gridloom.operators.match import variant_groups
    each = [variant_groups(df.select(F.col(c).cast("string").alias("value")), "value").select(F.lit(c).alias("column"), "members", "rows") for c in cols]
    return reduce(DataFrame.unionByName, each)


def sheet_profile_with_spellings(df: DataFrame, cols: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """`sheet_profile` with the spelling groups of the text columns, the largest first; NULL for columns without any."""
    groups = spelling_groups(df, texts).groupBy("column").agg(F.sort_array(F.collect_list(F.struct((-F.col("rows")).alias("m"), "members"))).alias("g"))
    return sheet_profile(df, cols).join(groups.select("column", F.array_join(F.transform("g", lambda s: s["members"]), "; ").alias("spellings")), "column", "left")


def describe_table(df: DataFrame, order: Sequence[Column], cols: Sequence[str], rows: int = 500, examples: int = 5) -> DataFrame:
    """Filled, distinct and sample values on the first `rows` rows (the sample is the operator)."""
    vc = value_counts(df.orderBy(*order).limit(rows), cols)
    top = top_per_key(vc.filter("value is not null"), ["column"], [F.col("value")], examples)
    ex = top.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]), ", ").alias("samples"))
    base = vc.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("value").alias("distinct"))
    return base.join(ex, "column", "left")


def value_lists(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Menu lists: ten or fewer values, none over 24 characters, at least three rows per value on average."""
    vc = value_counts(df, cols).filter("value is not null")
    ok = vc.groupBy("column").agg(F.count("*").alias("d"), F.max(F.length("value")).alias("len"), F.sum("n").alias("rows"))
    ok = ok.filter((F.col("d") <= 10) & (F.col("len") <= 24) & (F.col("rows") >= 3 * F.col("d")))
    return vc.join(ok, "column", "left_semi").groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("values"))


def manifest(cells: DataFrame) -> DataFrame:
    """Per table of a long cell table (table, row_no, column, value): rows, columns and the sum of each column that is
    at least 80% numeric."""
    num = money_number(F.col("value"))
    per = cells.groupBy("table", "column").agg(F.count("value").alias("filled"), F.count(num).alias("numeric"), F.sum(num).alias("total"),
                                               F.count("*").alias("rows"))
    return per.select("table", "column", "rows", F.when(F.col("numeric") >= 0.8 * F.col("filled"), F.col("total")).alias("total"))


def schema_brief(df: DataFrame, cols: Sequence[str], codes: DataFrame | None = None, most: int = 25) -> DataFrame:
    """What may be shared about a column: number range, or up to 25 values (known private ones shown as their code), and
    the blank count. `codes(norm, code)` is the vault."""
    vc = value_counts(df, cols)
    num = F.col("value").try_cast("double")
    base = vc.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("blank"), F.count("value").alias("d"),
        F.min(num).alias("lo"), F.max(num).alias("hi"), _share(num.isNotNull() | F.col("value").isNull()).alias("numeric"))
    shown = vc.filter("value is not null")
    if codes is not None:
        from gridloom.functions.text import norm
        k = codes.select(F.col("norm").alias("_n"), "code")
        shown = shown.join(k, norm(F.col("value")) == F.col("_n"), "left").withColumn("value", F.coalesce("code", "value")).drop("code", "_n")
    top = top_per_key(shown, ["column"], [F.desc("n"), F.col("value")], most)
    lists = top.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("vals"))
    brief = F.when(F.col("numeric") == 1, F.concat(F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string"))).otherwise(F.col("vals"))
    return base.join(lists, "column", "left").select("column", brief.alias("brief"), "blank")


def masked_rows(df: DataFrame, cols: Sequence[str], codes: DataFrame, order: Sequence[Column], first: int = 3) -> DataFrame:
    """The first rows as they may be shared: known private values are their codes, by `codes(norm, code)`."""
    from gridloom.operators.vault import coded
    return coded(df.orderBy(*order).limit(first).select(*[F.col(c).cast("string").alias(c) for c in cols]), cols, codes)


def join_candidates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns worth matching across tables: 15 or more values, 6 to 80 characters on average."""
    vc = value_counts(df, cols).filter("value is not null")
    got = vc.groupBy("column").agg(F.count("*").alias("distinct"), (F.sum(F.length("value") * F.col("n")) / F.sum("n")).alias("avg_length"))
    return got.filter((F.col("distinct") >= 15) & F.col("avg_length").between(6, 80))


MONTH_COLUMN = (r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s'\-/]*\d{2,4}$|^\d{4}[\-/](0?[1-9]|1[0-2])$"
                r"|^(0?[1-9]|1[0-2])[\-/]\d{4}$")


def table_flags(columns: DataFrame) -> DataFrame:
    """Structural flags per table from a columns catalogue (table, column): wide months, ledger, chat."""
    c = F.lower("column")
    return columns.groupBy("table").agg(
        (F.count_if(F.col("column").rlike(MONTH_COLUMN)) >= 4).alias("wide_months"),
        (F.bool_or(c.rlike("balance")) & F.bool_or(c.rlike("date")) & F.bool_or(c.rlike(r"\b(in|out|qty|received|issued|quantity)\b|_in$|_out$"))).alias("ledger"),
        (F.bool_or(c == "sender") & F.bool_or(c == "message")).alias("chat"))


def protected_values(df: DataFrame, cols: Sequence[str], most: int = 50) -> DataFrame:
    """Distinct text values of columns with more than `most` values: four or more characters, not numeric."""
    vc = value_counts(df, cols).filter("value is not null")
    wide = vc.groupBy("column").agg(F.count("*").alias("d")).filter(F.col("d") > most)
    return (vc.join(wide, "column", "left_semi").filter((F.length("value") >= 4) & F.col("value").try_cast("double").isNull())
            .select("value").distinct())


def artefact_leaks(artefacts: DataFrame, protected: DataFrame, first: int | None = 5) -> DataFrame:
    """(id, value): protected values that stand in an artefact's text, in any case; the `first` ones of each in order (None:
    all). artefacts(id, text), protected(value)."""
    from gridloom.operators.match import contained
    a = artefacts.select("id", F.lower("text").alias("r"))
    p = protected.select("value", F.lower("value").alias("l")).filter(F.length("value") >= 4)
    hits = contained(p.select("l"), a.select("r")).join(p, "l").join(a, "r").select("id", "value").distinct()
    return hits if first is None else top_per_key(hits, ["id"], [F.col("value")], first).drop("rn")


def check_key(df: DataFrame, key: str, audit: Sequence[str] = ()) -> DataFrame:
    """Key test as one row: rows, NULL keys, keys used twice, and blank counts of the audited columns."""
    per = df.groupBy(key).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"_b_{c}") for c in audit])
    return per.agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col(key).isNull(), F.col("_n")).otherwise(0)).alias("null_keys"),
                   F.count_if(F.col(key).isNotNull() & (F.col("_n") > 1)).alias("repeated_keys"),
                   *[F.sum(f"_b_{c}").alias(f"blank_{c}") for c in audit])


def summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, range and exact quartiles per numeric column; a column without values has NULL figures."""
    from gridloom.operators.scale import attach, quantiles
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]
    long = df.select(F.inline(F.array(*pairs)))
    base = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    return attach(base, quantiles(long, ["column"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}), ["column"])
