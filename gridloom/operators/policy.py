"""Which columns and values are private: the column classifier, heading rules, safe columns, text-matching policy."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators import detect as D
from gridloom.operators.profile import value_counts
from gridloom.operators.places import matched_in_text
from gridloom.operators.scale import top_per_key

# Words of protected categories; classes that identify a person directly.
SENSITIVE = ("sc", "st", "obc", "general", "nt", "vjnt", "sbc", "ews", "hindu", "muslim", "christian", "buddhist", "sikh", "jain", "dalit",
             "adivasi", "open")
DIRECT = ("person_name", "address", "village", "email", "phone", "aadhaar", "pan", "bank_account", "ifsc", "upi_id", "ration_card", "voter_id",
          "vehicle_number")
# How numbers, codes, exact measurements, sentences and names are written.
DIGITS, CODE = r"(?U)^[\d\s-]{8,}$", r"^(?:[A-Za-z]{1,5}[-_/]?\d{1,8}|[0-9a-f]{8}-[0-9a-f-]{27,})$"
PRECISE, SENTENCE = r"\.\d{4,}$", r"(?U)[,.;!?]\s|\s\w+\s\w+\s\w+\s\w+"
NAME = r"^[A-Za-z][A-Za-z.'-]*(?:\s[A-Za-z][A-Za-z.'-]*){0,4}$"


def cell_features(value: Column, spans: Column) -> Column:
    """What one cell looks like, from its text and the spans found in it: validators that cover 60% of it, its shapes, the
    direct class that covers most of it (half at least, ties to the class named first) and whether anything was found."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")

    def holds(label: str, pattern: str) -> Column:
        m = F.regexp_extract(v, f"(?U){pattern}", 0)
        return F.when((m != "") & D.passes(F.lit(label), m) & (F.length(m) >= 0.6 * F.length(v)), F.lit(label))

    def width(label: str) -> Column:
        return F.aggregate(F.filter(spans, lambda x: x["label"] == label), F.lit(0), lambda acc, x: acc + x["end"] - x["start"])
    widths = [F.struct(width(k).alias("width"), F.lit(-i).alias("place"), F.lit(k).alias("label")) for i, k in enumerate(DIRECT)]
    most, total = F.greatest(*widths), sum((w["width"] for w in widths), F.lit(0))
    return F.struct(
        F.array_compact(F.array(*[holds(k, p) for k, p in D.PATTERNS.items()])).alias("validator"),
        (v.rlike(DIGITS) & (F.length(F.regexp_replace(v, r"(?U)\D", "")) >= 8)).alias("digits"), v.rlike(CODE).alias("code"), v.rlike(PRECISE).alias("precise"),
        v.rlike(SENTENCE).alias("sentence"), v.rlike(NAME).alias("name"),
        F.when((total > 0) & (total >= 0.5 * F.length(v)), most["label"]).alias("covered"), (F.size(spans) > 0).alias("any"))


def classify_columns(df: DataFrame, columns: Sequence[str], sample: int = 40) -> DataFrame:
    """Class, rule and confidence per column. Whole-column shares (numeric, uniqueness, range, sensitive words) come from
    value counts; shape tests run on up to 40 distinct values per column, the sample being the operator's own rule."""
    vc = value_counts(df, columns).filter("value is not null")
    num = F.col("value").try_cast("double")
    n = F.col("n")
    whole = vc.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct"), (F.sum(F.when(num.isNotNull(), n).otherwise(0)) / F.sum("n")).alias("numeric"),
        (F.sum(F.when(num.between(-180, 180), n).otherwise(0)) / F.nullif(F.sum(F.when(num.isNotNull(), n).otherwise(0)), F.lit(0))).alias("in_range"),
        F.count_if(F.lower("value").isin(*SENSITIVE)).alias("sensitive"))
    picked = top_per_key(vc, ["column"], [F.xxhash64("value"), F.col("value")], sample).repartition("column", "value")
    f = picked.withColumn("spans", D.detector("text")(F.col("value"))).withColumn("f", cell_features(F.col("value"), F.col("spans")))
    shares = f.groupBy("column").agg(
        *[F.avg(F.array_contains("f.validator", k).cast("int")).alias(f"v_{k}") for k in D.PATTERNS],
        *[F.avg(F.col(f"f.{k}").cast("int")).alias(k) for k in ("digits", "code", "precise", "sentence", "name", "any")],
        F.avg(F.col("f.covered").isNotNull().cast("int")).alias("coverage"), F.mode("f.covered").alias("top"),
        F.avg(F.coalesce((F.col("f.covered") == "person_name").cast("int"), F.lit(0))).alias("people"), F.avg(F.length("value")).alias("mean_len"))
    best = F.greatest(*[F.col(f"v_{k}") for k in D.PATTERNS])
    label = F.coalesce(*[F.when(F.col(f"v_{k}") == best, F.lit(k)) for k in D.PATTERNS])
    j = whole.join(shares, "column").withColumns({"best": best, "label": label, "unique": F.col("distinct") / F.col("rows")})
    c = F.col

    def as_(cls, rule, conf):
        return F.struct((F.lit(cls) if isinstance(cls, str) else cls).alias("class"), F.lit(rule).alias("rule"), F.round(conf, 2).cast("double").alias("confidence"))
    long_text = (c("mean_len") > 40) | (c("sentence") >= 0.5)
    few = (c("distinct") <= 30) & (c("rows") >= 50) & (c("sentence") < 0.5)
    age = F.when(F.lower("column").rlike(r"\bage\b|umar|\bumr\b"), "age").otherwise("none")
    verdict = (F.when((c("best") >= 0.5) & ~((c("label") == "dob") & (c("numeric") > 0.9)), as_(c("label"), "validator", c("best")))
               .when((c("digits") >= 0.8) & (c("unique") >= 0.9), as_("bank_account", "long-unique-number", c("digits")))
               .when((c("code") >= 0.9) & (c("unique") >= 0.9), as_("record_id_non_pii", "code-like-id", c("code")))
               .when((c("numeric") >= 0.95) & (c("precise") >= 0.8) & (c("in_range") >= 0.99) & (c("unique") >= 0.5), as_("gps", "precise-coordinate", c("precise")))
               .when(c("numeric") >= 0.95, as_(age, "numeric", F.lit(0.9)))
               .when(few & (c("sensitive") >= 2), as_("caste_category", "sensitive-vocabulary", F.lit(0.8)))
               .when(few & (c("name") >= 0.8) & (c("people") >= 0.5), as_("person_name", "categorical-names", c("people")))
               .when(few, as_("none", "categorical", F.lit(0.7)))
               .when(long_text & (c("any") > 0), as_("free_text_with_pii", "free-text", c("coverage")))
               .when(long_text, as_("none", "free-text", c("coverage")))
               .when((c("coverage") >= 0.5) & c("top").isNotNull(), as_(c("top"), "span-coverage", c("coverage")))
               .otherwise(as_("none", "span-coverage", 1 - c("coverage"))))
    empty = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in columns])).alias("column"))
    got = j.select("column", verdict.alias("v"))
    return empty.join(got, "column", "left").select("column", F.coalesce("v.class", F.lit("none")).alias("class"), F.coalesce("v.rule", F.lit("empty")).alias("rule"),
                                                    F.coalesce("v.confidence", F.lit(1.0)).alias("confidence"))


# Heading words.
_PEOPLE = r"beneficiary|employee|(^|_)head($|_)|owner|respondent|farmer|guardian|father|mother|spouse|husband|wife|contact_person"
_LAND = r"(^|_)(species|spp\w*|sp|taxon|genus|plants?|trees?|crops?|birds?|animals?|habit)($|_)"
_LAND_PERSON = r"owner|farmer|worker|recorder|collector|observer|surveyor|enumerator|head|member|person|staff|contact"
_GROUP = r"ward|village|district|block|town|place|organi[sz]ation|programme|program|scheme|categor|company|institution|agency"
_IDENTIFIER = (r"phone|mobile|email|address|aadhaar|aadhar|voter|account|ifsc|upi|(^|_)(pan|ration|bank|id|lat|latitude|lon|lng|longitude|gps"
               r"|coordinates?)($|_)")
_ID_HEADING = r"(?i)\b(id|ids|phone|mobile|contact|aadha?r|pan|account|acct|ifsc|pin|pincode|no|number|ration|voter|card)\b|_id\b"


def _slugged(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def land_heading(c: Column) -> Column:
    """A heading about plants, animals or crops, not about the person who recorded them."""
    s = _slugged(c)
    return s.rlike(_LAND) & ~s.rlike(_LAND_PERSON)


def names_person(c: Column) -> Column:
    s = _slugged(c)
    return s.rlike(_PEOPLE) | (~land_heading(c) & ~s.rlike(_GROUP) & s.rlike("name"))


def heading_class(c: Column) -> Column:
    """Reveal policy of a heading: identifiers and people personal, land and groups contextual, unknown personal."""
    s = _slugged(c)
    return (F.when(s.rlike(_IDENTIFIER), "personal").when(land_heading(c), "contextual").when(names_person(c), "personal")
            .when(s.rlike(_GROUP), "contextual").otherwise("personal"))


def value_heading(c: Column) -> Column:
    """False for headings that name people, places, addresses, phones or e-mails."""
    s = _slugged(c)
    return ~(s.rlike(_PEOPLE) | (~land_heading(c) & (s.rlike(_GROUP) | s.rlike("name|address|phone|mobile|email"))))


def suggest_masks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mask suggestion and reason per column: the classifier's verdict, the heading, numeric measures and name shapes."""
    vc = value_counts(df, columns).filter("value is not null")
    num, n = F.col("value").try_cast("double"), F.col("n")
    s = vc.groupBy("column").agg((F.sum(F.when(num.isNotNull(), n).otherwise(0)) / F.sum("n")).alias("numeric"),
                                 F.bool_or(matched_in_text(F.col("value"))).alias("long_numbers"),
                                 (F.sum(F.when(F.col("value").rlike(r"^[A-Z][a-z'.-]+( [A-Z][a-z'.-]*){1,3}$"), n).otherwise(0)) / F.sum("n")).alias("names"))
    c = classify_columns(df, columns).join(s, "column", "left")
    base = ~F.col("class").isin("none", "age", "record_id_non_pii")
    head = F.col("rule").isin("no-model", "span-coverage", "categorical") & ~value_heading(F.col("column"))
    money = F.lower("column").rlike("income|amount|salary|revenue|expense|price|cost|balance")
    is_num = F.col("numeric") >= 0.95
    pick = (F.when(is_num & money, F.struct(F.lit(False).alias("mask"), F.lit("numeric measure").alias("reason")))
            .when(is_num & F.col("column").rlike(_ID_HEADING), F.struct(F.lit(True).alias("mask"), F.lit("identifier column heading").alias("reason")))
            .when(is_num & ~F.col("long_numbers"), F.struct(F.lit(False).alias("mask"), F.lit("counts or measures (small numbers)").alias("reason")))
            .when(base, F.struct(F.lit(True).alias("mask"), F.col("rule").alias("reason")))
            .when(head, F.struct(F.lit(True).alias("mask"), F.lit("identifier column heading").alias("reason")))
            .when(F.col("names") >= 0.6, F.struct(F.lit(True).alias("mask"), F.lit("looks like people's names").alias("reason")))
            .otherwise(F.struct(F.lit(False).alias("mask"), F.col("rule").alias("reason"))))
    return c.select("column", "class", pick["mask"].alias("mask"), pick["reason"].alias("reason"))


def safe_columns(cells: DataFrame) -> DataFrame:
    """Columns that may stay visible. cells(column, row_no, value): all values are numbers (currency, percent, grouped) or
    marks of up to two characters, except heading cells among the first three values, which must be under half; runs of
    eight or more digits are never safe. The first three places per column come from a partial top-k."""
    v = cells.filter(F.trim("value") != "").withColumn("v", F.trim("value"))
    bare = F.regexp_replace(F.regexp_replace(F.lower("v"), r"^(?:rs\.?|inr|₹)\s*|\s*%$", ""), "[, ]", "")
    ok = (F.length("v") <= 2) | (~F.col("v").rlike(r"^\+?\d[\d -]{7,}$") & bare.rlike(r"^[-+]?\d+(?:\.\d+)?$"))
    v = v.withColumn("bad", (~ok).cast("int"))
    base = v.groupBy("column").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    first = top_per_key(v, ["column"], [F.col("row_no")], 3).groupBy("column").agg(F.sum("bad").alias("head_bad"))
    return base.join(first, "column").select("column", ((F.col("bad") == F.col("head_bad")) & (F.col("bad") * 2 < F.col("n"))).alias("safe"))


def apply_decisions(tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """Earlier choices reused by header signature. tables(table, headers), decisions(headers, choice)."""
    from gridloom.functions.text import header_key
    t = tables.withColumn("key", header_key(F.col("headers")))
    d = decisions.groupBy(header_key(F.col("headers")).alias("key")).agg(F.max("choice").alias("choice"))
    return t.join(d, "key", "left")
