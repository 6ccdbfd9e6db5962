"""Cell rules, problems with suggested fixes, lookup integrity, drift contracts, and checks on results."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.dates import DATE_FORMATS, parse_date, parse_one
from gridloom.functions.numbers import PLACEHOLDERS, money_number, numbers_in
from gridloom.functions.text import blank_to_null, norm, slug
from gridloom.operators.match import closest_value
from gridloom.operators.tidy import EMAIL, PHONE, layout_rows


# ------------------------------------------------------------------ cell rules
def rule_ok(c: Column, rule: str, arg=None, today: Column | None = None) -> Column:
    """True when a cell keeps a rule; a blank cell breaks only `required`."""
    v = blank_to_null(c.cast("string"))
    if rule == "required":
        return v.isNotNull()
    if rule == "number":
        ok = money_number(v).isNotNull()
    elif rule == "date":
        ok = parse_date(v, arg or ("dd/MM/yyyy",)).isNotNull()
    elif rule == "email":
        ok = v.rlike(EMAIL)
    elif rule == "phone":
        ok = F.regexp_replace(v, r"[\s-]", "").rlike(PHONE) | v.rlike(PHONE)
    elif rule == "in_list":
        ok = norm(v).isin([" ".join(str(x).split()).lower() for x in arg])
    elif rule == "range":
        lo, hi = arg
        n = money_number(v)
        ok = n.isNotNull() & (n >= lo if lo is not None else F.lit(True)) & (n <= hi if hi is not None else F.lit(True))
    elif rule == "regex":
        ok = v.rlike(f"^(?:{arg})$")
    elif rule == "not_future":
        d = parse_date(v, arg or ("dd/MM/yyyy",))
        ok = d.isNull() | (d <= (today if today is not None else F.current_date()))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return v.isNull() | F.coalesce(ok, F.lit(False))


def validate(df: DataFrame, row: str, rules: Sequence[Mapping], today: Column | None = None) -> DataFrame:
    """Long problems table: (row_no, column, value, rule, message). All rules run in one pass over the rows; only broken
    cells leave it. rules: {column, rule, arg?, message?}."""
    cells = [F.when(~rule_ok(F.col(r["column"]), r["rule"], r.get("arg"), today), F.struct(
        F.lit(r["column"]).alias("column"), F.col(r["column"]).cast("string").alias("value"), F.lit(r["rule"]).alias("rule"),
        F.lit(r.get("message") or f"{r['column']}: {r['rule']}").alias("message"))) for r in rules]
    return df.select(F.col(row).alias("row_no"), F.inline(F.array_compact(F.array(*cells))))


def column_letter(place: int) -> str:
    out = ""
    while place:
        place, r = divmod(place - 1, 26)
        out = chr(65 + r) + out
    return out


def problems(df: DataFrame, row: str, columns: Sequence[str], rules: Sequence[Mapping], lookups: Sequence[Mapping] = (),
             today: Column | None = None, skip: Sequence[str] = ("repeated_header",), table: str = "table") -> DataFrame:
    """Every problem of a table with its cell address and suggestion. Layout rows are reported once per row and are not
    checked; kinds in `skip` are left out altogether. lookups: {column, other, key} checks a column against a table."""
    marked = layout_rows(df, columns)
    rows = marked.filter("layout is null")
    found = validate(rows, row, rules, today)
    for lk in lookups:
        found = found.unionByName(missing_lookups(rows, row, lk["column"], lk["other"], lk["key"]).select("row_no", "column", "value", "rule", "message"))
    notes = marked.filter(F.col("layout").isNotNull() & ~F.col("layout").isin(list(skip))).select(
        F.col(row).alias("row_no"), F.lit("").alias("column"), F.lit(None).cast("string").alias("value"), F.lit("layout").alias("rule"), F.col("layout").alias("message"))
    letters = F.create_map(*[x for i, c in enumerate(columns, 1) for x in (F.lit(c), F.lit(column_letter(i)))])
    out = suggest_fix(found, {r["column"]: r.get("arg") for r in rules if r["rule"] in ("date", "not_future")}, today)
    out = out.unionByName(notes.withColumns({"fix": F.lit(None).cast("string"), "why": F.lit(None).cast("string")}))
    return out.withColumns({"table": F.lit(table), "cell": F.concat(F.coalesce(F.get(F.array(letters), F.lit(0))[F.col("column")], F.lit("")), F.col("row_no").cast("string"))})


# ------------------------------------------------------------------ suggestions
# Letters read as digits beside a digit, how a number and its hedges are written, words for an unknown date,
# the first day of spreadsheet dates and the years they are believed in.
LOOKALIKES = {"0": r"(?<=\d)[oO]|[oO](?=\d)", "1": r"(?<=\d)[lI]|[lI](?=\d)"}
NUMBER, HEDGES = r"-?[\d,]+(?:\.\d+)?", r"approx\.?|about|around|~|c\.|ca\.?"
UNKNOWN_DATES = ("tba", "unknown", "not known")
SERIAL_START, SERIAL_YEARS = "1899-12-30", (1990, 2100)


def _fix(to: Column, why: str) -> Column:
    return F.struct(to.cast("string").alias("fix"), F.lit(why).alias("why"))


def _ruled(rules: Sequence[tuple[Column, Column, str]], otherwise: str) -> Column:
    """struct<fix, why> of the first rule that applies; without one a person must decide."""
    return F.coalesce(*[F.when(applies, _fix(to, why)) for applies, to, why in rules], _fix(F.lit(None), otherwise))


def number_fix(c: Column) -> Column:
    """struct<fix, why> for a cell that should be a number: the cell is parted into its number and what stands before and
    after it, and both sides decide what the number may be taken for."""
    cell = F.trim(c)
    as_digits = cell
    for digit, letters in LOOKALIKES.items():
        as_digits = F.regexp_replace(as_digits, letters, digit)
    before, number, after = (F.regexp_extract(cell, rf"^([^\d,-]*?)\s*({NUMBER})\s*(\D*)$", i) for i in (1, 2, 3))
    ungrouped = F.when(cell.rlike(r"^[\d,.\s]+$"), F.replace(cell, F.lit(","), F.lit(""))).otherwise(cell)
    hedged_before = before.rlike(rf"(?i)^(?:{HEDGES})$") & after.isin("", "?")
    hedged_after = (before == "") & after.rlike(r"^(?:\?|\+|approx\.?)$")
    bare = F.replace(number, F.lit(","), F.lit(""))
    return _ruled([
        (F.lower(cell).isin(*PLACEHOLDERS), F.lit(""), "a word for an empty cell"),
        ((as_digits != cell) & money_number(as_digits).isNotNull(), as_digits, "O or l typed for a digit"),
        (F.regexp_count(ungrouped, F.lit(r"-?\d+(?:\.\d+)?")) > 1, F.lit(None), "more than one number"),
        (hedged_before | hedged_after, bare, "a rough figure"),
        ((before == "") & after.rlike(r"^[a-zA-Z%]{1,6}$"), bare, "number and unit together")], "no number in it")


def _redated(readings: Sequence[tuple[Column, str]], fmt: str) -> list[tuple[Column, Column, str]]:
    """One rule per reading of a cell as a day."""
    return [(day.isNotNull(), F.date_format(day, fmt), why) for day, why in readings]


def date_fix(c: Column, fmt: str = "dd/MM/yyyy") -> Column:
    """struct<fix, why> for a cell that should be a date: words for an unknown one, spreadsheet day numbers, other formats."""
    cell = F.trim(c)
    serial = F.date_add(F.lit(SERIAL_START).cast("date"), F.when(cell.rlike(r"^\d{5}$"), cell.try_cast("int")))
    unknown = (F.lower(cell).isin(*PLACEHOLDERS, *UNKNOWN_DATES), F.lit(""), "no date yet")
    return _ruled([unknown, *_redated([(F.when(F.year(serial).between(*SERIAL_YEARS), serial), "day number of a spreadsheet"),
                                       (parse_date(cell, DATE_FORMATS), "written in another format")], fmt)], "no date in it")


def future_fix(c: Column, today: Column, fmt: str = "dd/MM/yyyy") -> Column:
    """struct<fix, why> for a day after today: the day with month and day exchanged, if there is one up to today."""
    day = parse_one(c, fmt)
    other = F.to_date(F.try_make_timestamp(F.year(day), F.day(day), F.month(day), F.lit(0), F.lit(0), F.lit(0)))
    return _ruled(_redated([(F.when((other != day) & (other <= today), other), "month typed before day")], fmt), "later than today")


def email_fix(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\.+$", ""), r"\(at\)|\[at\]", "@")
    t = F.when(t.contains("@"), t).otherwise(F.regexp_replace(t, r"(?i)\bat\b", "@"))
    return F.when(t.rlike(EMAIL) & (t != c), _fix(t, "spaces or a spelled-out at")).when(~c.contains("@"), _fix(F.lit(None), "no @")).otherwise(_fix(F.lit(None), "no domain after the @"))


def phone_fix(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"[^\d+]", ""), r"^(\+?91|0)(?=\d{10}$)", "")
    return F.when(t.rlike(r"^\d{10}$") & (t != c), _fix(t, "extra characters or a country code")).otherwise(_fix(F.lit(None), "a mobile number has 10 digits"))


def suggest_fix(found: DataFrame, date_formats: Mapping[str, Sequence[str] | None] | None = None, today: Column | None = None) -> DataFrame:
    """Adds `fix` (a value, blank to clear, NULL when a person must decide) and `why` by rule. List values are matched in
    `suggest_list_fix`."""
    v, r = F.col("value"), F.col("rule")
    fmt = next((f[0] for f in (date_formats or {}).values() if f), "dd/MM/yyyy")
    got = (F.when(r.isin("number", "range"), number_fix(v)).when(r == "date", date_fix(v, fmt))
           .when(r == "not_future", future_fix(v, today if today is not None else F.current_date(), fmt)).when(r == "email", email_fix(v)).when(r == "phone", phone_fix(v))
           .when(r == "required", _fix(F.lit(None), "must be filled in")))
    return found.withColumn("_f", got).withColumns({"fix": F.col("_f.fix"), "why": F.col("_f.why")}).drop("_f")


def suggest_list_fix(found: DataFrame, options: DataFrame, option: str) -> DataFrame:
    """Closest list value for `in_list` and `lookup` problems; each distinct value is matched once."""
    near = closest_value(found, "value", options, option).select("value", F.col("closest").alias("fix"), "why")
    return found.drop("fix", "why").join(near, "value", "left")


def missing_lookups(df: DataFrame, row: str, column: str, other: DataFrame, key: str, value_map: Mapping[str, str] | None = None,
                    accept: Sequence[str] = ()) -> DataFrame:
    """Cells whose folded value is not a key of the other table, after the value map and apart from accepted patterns. A
    value missing three or more times is reported as a possible code, a first name shared by several keys as ambiguous,
    a first name of exactly one key is fine."""
    v = norm(F.col(column).cast("string"))
    for old, new in (value_map or {}).items():
        v = F.when(v == old.lower(), new.lower()).otherwise(v)
    cells = df.select(F.col(row).alias("row_no"), F.lit(column).alias("column"), F.col(column).cast("string").alias("value"), v.alias("_k")).filter("_k <> ''")
    for p in accept:
        cells = cells.filter(~F.col("_k").rlike(p))
    keys = other.select(norm(F.col(key).cast("string")).alias("_k")).filter("_k <> ''").distinct()
    firsts = keys.filter(F.contains("_k", F.lit(" "))).groupBy(F.split("_k", " ")[0].alias("_k")).agg(F.count("*").alias("_names"))
    lost = cells.join(keys, "_k", "left_anti").join(firsts, "_k", "left").filter(F.coalesce("_names", F.lit(0)) != 1)
    times = lost.groupBy("_k").agg(F.count("*").alias("_times"))
    why = F.when(F.col("_names") > 1, "several people have this first name").when(F.col("_times") >= 3, "not found; used often, maybe a code").otherwise("not found")
    return lost.join(times, "_k").select("row_no", "column", "value", F.lit("lookup").alias("rule"), why.alias("message"), F.col("_times").alias("times"))


# ------------------------------------------------------------------ drift
def parse_rates(df: DataFrame, columns: Mapping[str, str], least: int = 5, floor: float = 0.8) -> DataFrame:
    """Share of filled cells that parse as their kind (number or date): (column, kind, filled, parsed, rate, drift)."""
    aggs = []
    for c, k in columns.items():
        v = blank_to_null(F.col(c).cast("string"))
        ok = money_number(v) if k == "number" else parse_date(v)
        aggs += [F.count(v).alias(f"n_{c}"), F.count(F.when(ok.isNotNull(), 1)).alias(f"p_{c}")]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(f"n_{c}").alias("filled"), F.col(f"p_{c}").alias("parsed")) for c, k in columns.items()]
    got = df.agg(*aggs).select(F.inline(F.array(*rows))).filter(F.col("filled") >= least)
    return got.withColumn("rate", F.col("parsed") / F.col("filled")).withColumn("drift", F.col("rate") < floor)


def contract(df: DataFrame, family: Mapping, used: Sequence[str] = (), pairs: Mapping[str, str] | None = None) -> DataFrame:
    """Findings against a taught family: (what, name, detail, severity); 0 ok, 1 changed, 2 drift. family: {columns:
    {name: kind}, values: {name: [known]}}. Column differences come from the two header lists (or from `pairs`, known column
    to present one), the rest from one aggregate and one anti join on known values."""
    import re
    spark = df.sparkSession

    def s(c):
        return re.sub("[^a-z0-9]+", "_", c.strip().lower()).strip("_")
    have, want = {s(c): c for c in df.columns}, {s(c): c for c in family["columns"]}
    if pairs is None:
        pair = {w: next((h for h in have if h == w or h.endswith("_" + w) or w.endswith("_" + h)), None) for w in want}
    else:
        pair = {w: s(pairs[c]) if c in pairs else None for w, c in want.items()}
    taken = {h for h in pair.values() if h}
    notes = [("missing column", want[w], "used" if want[w] in used else "", 2 if want[w] in used else 1) for w, h in pair.items() if h is None]
    notes += [("renamed column", want[w], have[h], 1) for w, h in pair.items() if h and h != w]
    notes += [("new column", have[h], "", 1) for h in have if h not in taken]
    out = spark.createDataFrame(notes, "what string, name string, detail string, severity int")
    kinds = {have[pair[s(c)]]: k for c, k in family["columns"].items() if k in ("number", "date") and pair.get(s(c))}
    if kinds:
        r = parse_rates(df, kinds).filter("drift")
        out = out.unionByName(r.select(F.lit("parse rate").alias("what"), F.col("column").alias("name"), F.format_number(F.col("rate"), 2).alias("detail"), F.lit(2).alias("severity")))
    for c, known in (family.get("values") or {}).items():
        col = pair.get(s(c))
        if col:
            seen = df.select(F.trim(F.col(have[col])).alias("v")).filter("v <> ''").groupBy("v").agg(F.count("*").alias("n"))
            new = seen.filter(~F.lower("v").isin([str(k).strip().lower() for k in known]))
            out = out.unionByName(new.select(F.lit("new value").alias("what"), F.lit(have[col]).alias("name"), F.col("v").alias("detail"), F.lit(1).alias("severity")))
    return out


def status(findings: DataFrame) -> DataFrame:
    worst = findings.agg(F.coalesce(F.max("severity"), F.lit(0)).alias("s"))
    return worst.select(F.element_at(F.array(F.lit("ok"), F.lit("changed"), F.lit("drift")), F.col("s") + 1).alias("status"))


# ------------------------------------------------------------------ result checks
def plausibility(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Suspicious columns of a result: percent-like names outside -100.5..100.5 (ratios excepted), one value in more than
    three rows."""
    aggs = [x for c in columns for x in (F.min(F.col(c).try_cast("double")).alias(f"a_{c}"), F.max(F.col(c).try_cast("double")).alias(f"b_{c}"),
                                         F.min(F.col(c).cast("string")).alias(f"c_{c}"), F.max(F.col(c).cast("string")).alias(f"d_{c}"))]
    rows = []
    for c in columns:
        low = c.lower()
        pct = any(x in low for x in ("percent", "pct", "rate", "share")) and "ratio" not in low
        out_of = (F.col(f"a_{c}") < -100.5) | (F.col(f"b_{c}") > 100.5) if pct else F.lit(False)
        flat = (F.col("_rows") > 3) & (F.col(f"c_{c}") == F.col(f"d_{c}"))
        rows.append(F.struct(F.lit(c).alias("column"), F.when(out_of, "outside percent range").when(flat, "one value in every row").alias("issue")))
    return df.agg(F.count("*").alias("_rows"), *aggs).select(F.inline(F.array(*rows))).filter("issue is not null")


def check_result(df: DataFrame, keys: Sequence[str], entity: str, requested: DataFrame, ranking: bool = False) -> DataFrame:
    """One row: chart keys used twice, requested entities not shown, shown ones not requested (a ranking may show fewer)."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    shown, asked = df.select(norm(F.col(entity)).alias("e")).distinct(), requested.select(norm(F.col(entity)).alias("e")).distinct()
    not_shown = asked.join(shown, "e", "left_anti").agg(F.count("*").alias("not_shown"))
    extra = shown.join(asked, "e", "left_anti").agg(F.count("*").alias("not_requested"))
    one = twice.crossJoin(not_shown).crossJoin(extra)  # one row each
    fine = (F.col("repeated_keys") == 0) & (F.col("not_requested") == 0) & (F.lit(ranking) | (F.col("not_shown") == 0))
    return one.withColumn("ok", fine)


def completeness(result: DataFrame, columns: Sequence[str], expected: DataFrame) -> DataFrame:
    """Expected names (categories or periods) that stand in no cell and no column name of a result."""
    cells = result.select(F.explode(F.array(*[norm(F.col(c).cast("string")) for c in columns])).alias("k")).filter("k is not null").distinct()
    names = [slug(F.lit(c)) for c in result.columns]
    want = expected.select(F.col("name"), norm(F.col("name")).alias("k"))
    left = want.join(cells, "k", "left_anti")
    in_header = F.lit(False)
    for n in names:
        in_header = in_header | n.contains(slug(F.col("name")))
    return left.filter(~in_header).select("name")


# Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def ungrounded_numbers(texts: DataFrame, key: str, text: str, allowed: DataFrame) -> DataFrame:
    """Numbers in a text that are not among its allowed values (key, value), to two decimals. Number words count, list
    numbering at the start of a line does not."""
    clean = F.regexp_replace(F.col(text), r"(?m)^\s*\d{1,2}[.)]\s+", "")
    spoken = F.filter(F.transform(F.regexp_extract_all(F.lower(clean), F.lit(r"\b(" + "|".join(NUMBER_WORDS) + r")\b"), F.lit(1)),
                                  lambda w: F.get(F.array(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])), F.lit(0))[w].cast("double")), lambda x: x.isNotNull())
    said = texts.select(key, F.explode(F.concat(numbers_in(clean), spoken)).alias("value")).filter("value is not null").withColumn("value", F.round("value", 2)).distinct()
    ok = allowed.select(key, F.round(F.col("value").cast("double"), 2).alias("value")).distinct()
    return said.join(ok, [key, "value"], "left_anti")


def results_match(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], relative: float = 1e-6, absolute: float = 1e-9) -> DataFrame:
    """Rows that differ between two results in any order, extra columns ignored: numbers within tolerance (currency text
    read as numbers), dates in any format, other text folded. Empty when they match."""
    def plain(c):
        s = F.col(c).cast("string")
        d = F.coalesce(F.date_format(parse_date(s), "yyyy-MM-dd"), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), F.substring(s, 1, 10)))
        return F.coalesce(d, norm(s))
    x = a.select(*[plain(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(v).cast("string").alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    y = b.select(*[plain(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(v).cast("string").alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    j = x.join(y, [f"k{i}" for i in range(len(keys))], "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for v in values:
        p, q = F.col(f"a_{v}"), F.col(f"b_{v}")
        n, m = money_number(p), money_number(q)
        near = F.abs(n - m) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(n), F.abs(m)))
        same = same & (p.isNull() & q.isNull() | F.coalesce(near, F.lit(False)) | F.coalesce(norm(p) == norm(q), F.lit(False)))
    return j.filter(~same).drop("_a", "_b")


def expect(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """One row of violation counts per named condition (SQL); a NULL result counts as a violation."""
    return df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in checks.items()])


def enforce(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """The rows, failing the job when any condition is violated."""
    for n, c in checks.items():
        df = df.filter(F.assert_true(F.coalesce(F.expr(c), F.lit(False)), F.lit(f"check failed: {n}")).isNull())
    return df
