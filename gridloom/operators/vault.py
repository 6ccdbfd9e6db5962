"""The vault (norm, value, class, prefix, code): building it, coding tables and texts, restoring, and leak checks.
Values are found in texts by one scan (`places`), so neither the vault nor a text is bounded by one regex."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.text import norm
from gridloom.operators.places import known_places, matched_in_text
from gridloom.operators.scale import numbered
from gridloom.session import cut, dealt

# Code prefixes by class.
PREFIX = {"person_name": "NAME", "phone": "PHONE", "email": "EMAIL", "aadhaar": "AADHAAR", "pan": "PAN", "bank_account": "ACCOUNT",
          "ifsc": "IFSC", "upi_id": "UPI", "ration_card": "RATION", "voter_id": "VOTER", "vehicle_number": "VEHICLE", "address": "ADDRESS",
          "village": "PLACE", "long_number": "NUMBER"}
CODE = r"(?=[A-Z])(?:(?<!\w)|(?<=\\[ntr]))[A-Z][A-Z_]{1,24}\\?_\d{3,}\b"  # a capital is looked for first
WORD = r"(?U)\w+"
VAULT = "norm string, value string, class string, prefix string, number bigint, code string"


def prefix_of(cls: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in PREFIX.items():
        out = out.when(cls == k, v)
    return out.otherwise(F.upper(cls))


def empty_vault(spark) -> DataFrame:
    return spark.createDataFrame([], VAULT)


def build_vault(values: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New vault rows for values(value, class, pos), `pos` being any orderable place. One code per normal form; the class
    seen first wins; texts that are codes already, and forms with a code, are left out. Codes count on per prefix in order
    of first place, numbered by a distributed sort."""
    v = values.filter(F.trim("value") != "").select(norm(F.col("value")).alias("norm"), F.trim("value").alias("value"), "class", "pos")
    v = v.filter(~F.upper(F.regexp_replace("value", "^['\"`]+|['\"`]+$", "")).rlike(r"^[A-Z][A-Z_]{1,24}\\?_\d{3,}$"))
    first = v.groupBy("norm").agg(F.min("pos").alias("pos"), F.min_by(F.struct("value", "class"), F.struct("pos", "class", "value")).alias("f"))
    new = first.select("norm", "f.value", "f.class", "pos").withColumn("prefix", prefix_of(F.col("class")))
    if existing is not None:
        new = new.join(existing.select("norm"), "norm", "left_anti")
    out = numbered(new, ["prefix"], [F.col("pos"), F.col("norm")], "number")
    if existing is not None:
        top = existing.groupBy("prefix").agg(F.max("number").alias("_top"))
        out = out.join(top, "prefix", "left").withColumn("number", F.col("number") + F.coalesce("_top", F.lit(0)))
    code = F.concat(F.col("prefix"), F.lit("_"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0")))
    return out.select("norm", "value", "class", "prefix", "number", code.alias("code"))


# ------------------------------------------------------------------ rewriting texts
def _parts(c: Column) -> tuple[Column, Column]:
    """Words of a text and the gaps around them (one more gap than words)."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.split(c, WORD, -1)


def _interleaved(text: Column) -> Column:
    """gap, word, gap, word, ..., gap: the whole text as an array; word i stands at place 2 i + 2 (1-based)."""
    w, g = _parts(text)
    return F.flatten(F.zip_with(g, F.concat(w, F.array(F.lit(""))), lambda a, b: F.array(a, b)))


def _located(text: Column, runs: Column) -> Column:
    """Word runs as character spans (start, end, code)."""
    def place(x: Column) -> Column:
        def one(r: Column) -> Column:
            lead = F.length(F.array_join(F.slice(x, F.lit(1), 2 * r["at"] + 1), ""))
            body = F.length(F.array_join(F.slice(x, 2 * r["at"] + 2, 2 * r["size"] - 1), ""))
            return F.struct((lead - F.length(r["pre"])).alias("start"), (lead + body + F.length(r["suf"])).alias("end"), r["code"].alias("code"))
        return F.transform(runs, one)
    return F.get(F.transform(F.array(_interleaved(text)), place), F.lit(0))


def _resolved(spans: Column) -> Column:
    """Non-overlapping spans: by start, longest first."""
    order = F.sort_array(F.transform(spans, lambda e: F.struct(e["start"].alias("start"), (-e["end"]).alias("m"), e["code"].alias("code"))))

    def chosen(o: Column) -> Column:
        return F.aggregate(o, F.struct(F.lit(0).alias("free"), F.slice(o, 1, 0).alias("out")), lambda acc, e: F.when(
            e["start"] >= acc["free"], F.struct((-e["m"]).alias("free"), F.concat(acc["out"], F.array(e)).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    return F.get(F.transform(F.array(order), chosen), F.lit(0))  # sorted once


def _rewritten(text: Column, chosen: Column) -> Column:
    """The text with every chosen span replaced by its code."""
    def step(acc: Column, e: Column) -> Column:
        return F.struct((-e["m"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["code"]).alias("out"))
    return F.aggregate(chosen, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _apply(docs: DataFrame, key: str, text: str, runs: DataFrame | None, exact: DataFrame | None) -> DataFrame:
    """Rewrite texts by word runs and by exact character spans (key, start, end, code). A text's spans are gathered next
    to the text that already holds them; texts without any span pass unchanged."""
    out, pieces = docs, []
    if runs is not None:
        per = runs.groupBy(key).agg(F.collect_list(F.struct("at", "size", "code", "pre", "suf")).alias("_runs"))
        out = out.join(per, key, "left")
        pieces.append(F.when(F.col("_runs").isNotNull(), _located(F.col(text), F.col("_runs"))))
    if exact is not None:
        per = exact.groupBy(key).agg(F.collect_list(F.struct("start", "end", "code")).alias("_exact"))
        out = out.join(per, key, "left")
        pieces.append(F.col("_exact"))
    out = out.withColumn("_spans", F.flatten(F.array_compact(F.array(*pieces))))
    out = out.withColumn("_chosen", F.when(F.size("_spans") > 0, _resolved(F.col("_spans"))))
    return out.withColumns({"redacted": F.when(F.col("_chosen").isNotNull(), _rewritten(F.col(text), F.col("_chosen"))).otherwise(F.col(text)),
                            "changes": F.coalesce(F.size("_chosen"), F.lit(0))}).drop("_runs", "_exact", "_spans", "_chosen")


def redact(docs: DataFrame, key: str, text: str, vault: DataFrame, kept: DataFrame | None = None, code: str = "code", least: int = 1,
           exact: DataFrame | None = None, never: Sequence[str] = ()) -> DataFrame:
    """Known values replaced by their codes: whole words, any case, longest first, in web links also joined by _ + - or %20,
    decimals also with more zeros. Short numbers, years and the words of `never` stay, and `kept(norm)` values stay clear.
    `exact` spans (key, start, end, code), as a detector found them, are replaced wherever they stand. Adds `redacted`,
    `changes`."""
    v = vault.join(kept.select("norm").distinct(), "norm", "left_anti") if kept is not None else vault
    v = v if code == "code" else v.withColumn("code", F.col(code))
    spans = known_places(docs, key, text, v, least, never)
    return _apply(docs, key, text, None, spans if exact is None else spans.unionByName(exact.select(*spans.columns)))


def leaks(docs: DataFrame, key: str, text: str, vault: DataFrame, never: Sequence[str] = ()) -> DataFrame:
    """Known values still in outgoing texts, codes taken out and JSON escapes undone first; must be empty. A text without _ and
    backslash holds neither, so it is looked through as it is."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), CODE, " "), r"\\[nrt]", " ")
    plain = F.replace(F.replace(plain, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))
    plain = F.when(F.col(text).contains("_") | F.col(text).contains("\\"), plain).otherwise(F.col(text))
    return known_places(docs.select(key, plain.alias("_t")), key, "_t", vault, never=never).groupBy(key, "code").agg(F.count("*").alias("n"))


def replace_codes(docs: DataFrame, key: str, text: str, codes: DataFrame) -> DataFrame:
    """Every code token replaced by its value from codes(code, value); an escaped underscore is accepted, unknown codes
    stay. Adds `restored`. Only texts with a known code are rebuilt. The texts are read twice, so they are cut first: what made
    them, such as a redaction, runs once."""
    docs = cut(docs)
    tokens = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(CODE), F.lit(0))).alias("i", "tok"))
    known = tokens.withColumn("code", F.replace("tok", F.lit("\\_"), F.lit("_"))).join(codes.select("code", "value"), "code")
    per = known.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("tok", "value")))).alias("m"))
    out = docs.join(per, key, "left")
    gaps, toks = F.split(F.col(text), CODE, -1), F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    filled = F.transform(toks, lambda x: F.coalesce(F.col("m")[x], x))
    made = F.array_join(F.flatten(F.zip_with(gaps, F.concat(filled, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return out.withColumn("restored", F.when(F.col("m").isNotNull(), made).otherwise(F.col(text))).drop("m")


def restore(docs: DataFrame, key: str, text: str, vault: DataFrame) -> DataFrame:
    return replace_codes(docs, key, text, vault)


# ------------------------------------------------------------------ tables
def cells(df: DataFrame, key: str, columns: Mapping[str, str | Sequence[str]], table: str = "") -> DataFrame:
    """Direct values of a table as (value, class, pos) with pos = (table, column place, key). A column of several classes is
    mixed: its cells are classed by their shape, the first class being that of the rest."""
    rows = [F.struct(F.col(c).cast("string").alias("value"), (F.lit(k) if isinstance(k, str) else mixed_class(F.col(c).cast("string"), k[0]) if len(k) > 1 else F.lit(k[0])).alias("class"),
                     F.struct(F.lit(table).alias("t"), F.lit(i).alias("c"), F.col(key).alias("k")).alias("pos")) for i, (c, k) in enumerate(columns.items())]
    return df.select(F.inline(F.array(*rows))).filter(F.col("value").isNotNull())


def mixed_class(c: Column, primary: str) -> Column:
    """Class of a cell in a column that mixes e-mail addresses and phone numbers, by its shape."""
    return F.when(c.contains("@"), "email").when(c.rlike(r"\d{6,}"), "phone").otherwise(primary)


def coded(df: DataFrame, columns: Sequence[str], vault: DataFrame) -> DataFrame:
    """Whole cells replaced by their code, column by column (equi-join on the normal form)."""
    for c in columns:
        v = vault.select(F.col("norm").alias("_n"), F.col("code").alias("_c"))
        df = df.join(v, norm(F.col(c).cast("string")) == F.col("_n"), "left").withColumn(c, F.coalesce("_c", F.col(c).cast("string"))).drop("_n", "_c")
    return df


NOT_CODED = ("none", "record_id_non_pii", "age", "dob", "gps", "free_text_with_pii")


def main_class(k: str | Sequence[str] | None) -> str:
    """What decides how a column is treated: free text, birth dates and positions before all, else its first class."""
    many = [k] if isinstance(k, str) else list(k or ())
    return next((x for x in ("free_text_with_pii", "dob", "gps") if x in many), many[0] if many else "none")


def direct_columns(classes: Mapping[str, str | Sequence[str] | None]) -> dict[str, str | Sequence[str]]:
    """Columns whose cells are coded whole, with their classes."""
    return {c: k for c, k in classes.items() if main_class(k) not in NOT_CODED}


def pseudonymise(df: DataFrame, key: str, classes: Mapping[str, str | Sequence[str] | None], vault: DataFrame) -> DataFrame:
    """Table coded by column class: direct columns whole, birth dates to the year, positions to two decimals, free text by
    known values; other columns unchanged. A column of several classes (e-mail or phone) is coded cell by cell. The vault must
    already hold the `cells` of all direct columns."""
    direct = list(direct_columns(classes))
    classes = {c: main_class(k) for c, k in classes.items()}
    out = coded(df, direct, vault)
    for c, k in classes.items():
        if k == "dob":
            from gridloom.functions.dates import parse_stamp
            out = out.withColumn(c, F.when(F.trim(c) != "", F.year(parse_stamp(F.col(c))).cast("string")).otherwise(F.col(c)))
        elif k == "gps":
            out = out.withColumn(c, F.round(F.col(c).try_cast("double"), 2))
        elif k == "free_text_with_pii":
            out = redact(out, key, c, vault).withColumn(c, F.col("redacted")).drop("redacted", "changes")
    return out


def shelter(docs: DataFrame, key: str, text: str, existing: DataFrame | None = None, kind: str = "regex+digits") -> tuple[DataFrame, DataFrame]:
    """Detect everything, build the vault, then code every text: what is hidden in one text is hidden in all. Returns the
    coded texts and the whole vault (cut, so that codes stay fixed)."""
    from gridloom.operators.detect import detect, exploded
    found = cut(exploded(detect(docs, text, kind, clean=True), [key], text))
    new = build_vault(found.select("value", F.col("label").alias("class"), F.struct(F.col(key).alias("k"), "start").alias("pos")), existing)
    vault = cut(new if existing is None else existing.unionByName(new))
    exact = found.withColumn("norm", norm(F.col("value"))).join(vault.select("norm", "code"), "norm").select(key, "start", "end", "code")
    return redact(docs, key, text, vault, exact=exact), vault


def code_index(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], vault: DataFrame) -> DataFrame:
    """Where each code comes from: (code, file, column, class). A named column beats an unnamed one, personal beats
    contextual; identifier codes are personal wherever they stand."""
    from gridloom.operators.policy import heading_class, land_heading
    out = None
    for file, (df, cols) in tables.items():
        rows = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
        one = df.select(F.inline(F.array(*rows))).filter("value is not null").select("column", norm(F.col("value")).alias("norm")).distinct().withColumn("file", F.lit(file))
        out = one if out is None else out.unionByName(one)
    named = ~F.lower(F.trim("column")).rlike(r"^(column_\d+|unnamed(: ?\d+)?|\d+)$")
    hit = out.filter(F.col("norm") != norm(F.col("column"))).join(vault.select("norm", "code"), "norm").withColumn("class", heading_class(F.col("column")))
    rank = F.when(named, F.when(F.col("class") == "personal", 2).otherwise(1)).otherwise(0)
    best = hit.groupBy("code").agg(F.max_by(F.struct("file", "column", "class"), F.struct(rank.alias("r"), "file", "column")).alias("b"))
    got = best.select("code", "b.file", "b.column", "b.class")
    forced = F.col("code").rlike(r"^(PHONE|EMAIL|AADHAAR|PAN|VOTER|RATION|ACCOUNT|IFSC|UPI|ADDRESS|GPS)_") | (F.col("code").startswith("NAME_") & ~land_heading(F.col("column")))
    return got.withColumn("class", F.when(forced, "personal").otherwise(F.col("class")))


def reveal_requests(requests: DataFrame, lineage: DataFrame, limit: int = 3, column_limit: int = 80, seconds: int = 120) -> DataFrame:
    """Decision per request(workspace, at, code, whole_column): only contextual codes, `limit` per workspace in time order,
    a whole column only up to 80 codes; granted reveals end after 120 s. Places in the queue come from the distributed
    numbering, since one workspace may send most requests."""
    sizes = lineage.groupBy("file", "column").agg(F.count("*").alias("codes"))
    r = requests.join(lineage.join(sizes, ["file", "column"]).select("code", "class", "codes"), "code", "left")
    fine = (F.col("class") == "contextual") & (~F.col("whole_column") | (F.col("codes") <= column_limit))
    r = r.withColumn("allowed", F.coalesce(fine, F.lit(False)))
    n = numbered(r.filter("allowed"), ["workspace"], [F.col("at"), F.col("code")], "nth")
    decided = n.withColumn("decision", F.when(F.col("nth") <= limit, "granted").otherwise("over limit")).drop("nth")
    why = F.when(F.col("class").isNull(), "unknown code").when(F.col("class") != "contextual", "personal").otherwise("column too long")
    out = decided.unionByName(r.filter("not allowed").withColumn("decision", why))
    return out.withColumn("expires", F.when(F.col("decision") == "granted", F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))).drop("allowed", "codes")


def mask_copy(df: DataFrame, key: str, chosen: Mapping[str, str], texts: Sequence[str], vault: DataFrame) -> DataFrame:
    """Copy for sharing: chosen columns coded (`code`) or `HIDDEN` (`hide`), text columns through known-value masking, a
    repeated heading kept; `changed` and `hidden` count the cells of the row that differ."""
    before = {c: F.col(c).cast("string") for c in [*chosen, *texts]}
    out = df.withColumns({f"_o_{c}": e for c, e in before.items()})
    out = coded(out, [c for c, how in chosen.items() if how == "code"], vault)
    out = out.withColumns({c: F.when(F.trim(f"_o_{c}") != "", "HIDDEN").otherwise(F.col(f"_o_{c}")) for c, how in chosen.items() if how == "hide"})
    for c in texts:
        out = redact(out, key, c, vault).withColumn(c, F.col("redacted")).drop("redacted", "changes")
    out = out.withColumns({c: F.when(norm(F.col(f"_o_{c}")) == c.strip().lower(), F.col(f"_o_{c}")).otherwise(F.col(c)) for c in before})
    diff = [F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), 1).otherwise(0) for c in before]
    hid = [F.when(F.col(c) == "HIDDEN", 1).otherwise(0) for c, how in chosen.items() if how == "hide"]
    out = out.withColumns({"changed": sum(diff[1:], diff[0]), "hidden": sum(hid[1:], hid[0]) if hid else F.lit(0)})
    return out.drop(*[f"_o_{c}" for c in before])


def resolve_partials(questions: DataFrame, vault: DataFrame) -> DataFrame:
    """Capitalised words of questions(q, text) inside known names and places: one code found is a replacement, several an
    ambiguity. Words meet the vault's words in an equi-join; codes are counted per word before the join."""
    stop = ("What", "Which", "Show", "Give", "List", "Tell", "The", "And", "For", "How", "Who", "Now", "Only", "Compare", "Make", "Dashboard",
            "Table", "Download", "Source", "Average", "Total")
    w = questions.select("q", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0)))).alias("word"))
    w = w.filter(~F.col("word").isin(*stop)).withColumn("k", F.lower("word"))
    known = (vault.filter(F.col("prefix").isin("NAME", "PLACE")).select("code", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(WORD), F.lit(0)))).alias("k"))
             .groupBy("k").agg(F.count_distinct("code").alias("options"), F.min("code").alias("code")))
    return w.join(known, "k").select("q", "word", "options", F.when(F.col("options") == 1, F.col("code")).alias("code"))


def cores(vault: DataFrame) -> DataFrame:
    """Each known value and its distinctive part without generic words (a place's name without `ward`)."""
    generic = ("ward", "village", "block", "district", "taluka", "taluk", "gram", "nagar", "colony", "area", "zone", "the", "of")
    words_ = F.filter(F.regexp_extract_all("value", F.lit(r"(?U)[^\W\d_]+"), F.lit(0)), lambda x: ~F.lower(x).isin(*generic))
    core = F.lower(F.array_join(words_, " "))
    full = F.lower("value")
    return vault.select("code", F.explode(F.array_distinct(F.array(full, core))).alias("form")).filter(F.length("form") >= 5)


def redact_near(docs: DataFrame, key: str, text: str, vault: DataFrame, floor: float = 0.85) -> DataFrame:
    """Fragments of one to five words and five or more characters that nearly equal one known value: within two
    characters of its length and a ratio of 0.85, from a unique code. Distinct fragments meet the forms through exact
    similarity keys, then the spans are chosen and the text rebuilt as for known values. All fragments are many times the
    texts that Spark's size estimate sees, so they are never the broadcast side."""
    from gridloom.operators.match import similar_pairs
    d = dealt(docs).select(key, _parts(F.col(text))[0].alias("w"), _interleaved(F.col(text)).alias("x")).filter(F.size("w") > 0)

    def run_of(n: int) -> Column:
        many = F.size("w") - n + 1
        made = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"),
                           F.lower(F.array_join(F.slice("x", 2 * i + 2, F.lit(2 * n - 1)), "")).alias("frag")))
        return F.when(many > 0, made)
    longest = F.array_compact(F.array(*[run_of(n) for n in range(1, 6)]))
    frags = d.select(key, F.inline(F.flatten(longest))).filter((F.length("frag") >= 5) & F.col("frag").rlike(r"(?U)^[^\W\d_]+(?:[\s-]+[^\W\d_]+)*$"))
    forms = cores(vault.filter(matched_in_text(F.col("value")))).filter(F.col("form").rlike(r"(?U)^[^\d]+$"))
    pairs = similar_pairs(frags.select("frag"), forms.select("form"), "ratio", floor)
    pairs = pairs.filter(F.abs(F.length("l") - F.length("r")) <= 2).join(forms, F.col("r") == F.col("form"))
    only = pairs.groupBy("l").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).filter("n = 1")
    spans = frags.hint("merge").join(only, F.col("frag") == F.col("l")).select(key, "at", "size", "code", F.lit("").alias("pre"), F.lit("").alias("suf"))
    return _apply(docs, key, text, spans, None)


def build_extract(texts: DataFrame, key: str, text: str, vault: DataFrame, budget: int = 150_000, lines: int = 80, chars: int = 8000) -> DataFrame:
    """What may go out: items in key order while they fit the budget whole; tables past it as their first 80 lines, texts as
    their first 8000 characters (the extract's own caps); then a last known-value pass and the leak gate. Items(key, kind,
    text). Running sizes use the distributed prefix sum. `leaks` must be 0 in every row that is sent."""
    from gridloom.operators.scale import running, sorted_positions
    placed = running(sorted_positions(texts, [F.col(key)]), [], "_g", sums={"used": F.length(text)})
    short = F.when(F.col("kind") == "table", F.substring_index(text, "\n", lines)).otherwise(F.substring(F.col(text), 1, chars))
    sent = placed.withColumns({"whole": F.col("used") <= budget, "_out": F.when(F.col("used") <= budget, F.col(text)).otherwise(short)})
    done = cut(redact(sent, key, "_out", vault))
    left = leaks(done, key, "redacted", vault).groupBy(key).agg(F.sum("n").alias("leaks"))
    n_lines = F.length("redacted") - F.length(F.replace("redacted", F.lit("\n"), F.lit(""))) + 1
    return done.join(left, key, "left").select(key, "kind", "whole", F.col("redacted").alias("sent"), n_lines.alias("lines_sent"), "changes", F.coalesce("leaks", F.lit(0)).alias("leaks"))
