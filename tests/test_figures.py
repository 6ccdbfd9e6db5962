"""Work that must stay bounded: join sides, tasks and batches, on small rows."""
from pyspark.sql import functions as F

from gridloom.functions.similarity import sequence_ratio
from gridloom.operators import match as M
from gridloom.operators import vault as V


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_candidate_keys_are_not_broadcast(spark):
    """The rows of keys are many times the strings, which is what the size estimate sees (lab6, prv17)."""
    names = spark.createDataFrame([(i // 100, f"street number {i} north") for i in range(300)], "g int, s string")
    for by in ((), ("g",)):
        pairs = M.candidate_pairs(names.select(*by, "s"), names.select(*by, "s"), "ratio", 0.9, by)
        assert "BroadcastHashJoin" not in plan_of(pairs)


def test_small_and_large_groups_give_the_same_pairs(spark):
    rows = [(g, f"lane {i * 7 % 90} of ward {i % 4}") for g, n in (("few", 5), ("many", M.TOGETHER + 20)) for i in range(n)] + [(None, "lane 1 of ward 1"), ("lone", "lane 2")]
    a = spark.createDataFrame(rows, "g string, s string")
    b = a.filter("g is null or g <> 'lone'").withColumn("s", F.concat("s", F.lit("s")))
    want = (a.distinct().select("g", F.col("s").alias("l")).join(b.distinct().select("g", F.col("s").alias("r")), "g")
            .withColumn("score", F.round(sequence_ratio("l", "r"), 12)).filter("score >= 0.8"))
    got = M.similar_pairs(a, b, "ratio", 0.8, by=["g"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and {r.g for r in got.collect()} == {"few", "many"}


def test_fragments_are_not_broadcast(spark):
    vault = V.build_vault(spark.createDataFrame([("north ring", "village", 1), ("south gate", "village", 2)], "value string, class string, pos int"))
    docs = spark.createDataFrame([(i, f"visit to nort ring {i} tomorrow") for i in range(20)], "id int, text string")
    got = V.redact_near(docs, "id", "text", vault)
    plan = plan_of(got)
    assert "BroadcastHashJoin [frag" not in plan and {r.redacted for r in got.filter("id = 3").collect()} == {"visit to PLACE_001 3 tomorrow"}


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """A batch of a stream may be one file that Spark cannot split (st4)."""
    from gridloom.session import dealt
    spark.range(400).coalesce(1).write.parquet(str(tmp_path / "one"))
    got = dealt(spark.read.parquet(str(tmp_path / "one"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in got) == 400


def test_spread_sees_empty_splits(spark, tmp_path):
    """A file of one row group has many splits by its bytes, of which one holds all rows (prv20, prv12b)."""
    from gridloom.session import spread
    spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = spark.read.parquet(str(tmp_path / "one"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        got = spread(df).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in got) == 20_000


def test_responses_share_groups_and_state(spark, tmp_path):
    """Many replies in two waves, one code split between the waves: as many Python calls as buckets at most (st3)."""
    from gridloom.streaming import jobs as ST
    n = 300
    text = "see NAME_001 ok"
    rows = [(f"r{i}", s, text[a:b], s == 2) for i in range(n) for s, (a, b) in enumerate(((0, 7), (7, 10), (10, len(text))))] + [(None, 0, "NAME_0", False), (None, 1, "01", True)]
    path = str(tmp_path / "in")
    schema = "response string, seq long, delta string, done boolean"
    for wave in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] > 0) == bool(wave)], schema).coalesce(1).write.mode("append").parquet(path)
    vault = spark.createDataFrame([("ann", "Ann", "person_name", "NAME", 1, "NAME_001")], V.VAULT)
    old, ST.BUCKETS = ST.BUCKETS, 4
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        assert "pmod(xxhash64" in ST.whole_pieces(stream)._jdf.queryExecution().analyzed().toString()
        got = ST.stream_restore(stream, vault, str(tmp_path / "out")).collect()
    finally:
        ST.BUCKETS = old
    whole = {}
    for r in sorted(got, key=lambda r: r.seq):
        whole[r.response] = whole.get(r.response, "") + (r.restored or "")
    assert len(got) == len(rows) and len(whole) == n + 1
    assert {v for k, v in whole.items() if k} == {"see Ann ok"}


def test_bm25_shuffles_no_scores(spark):
    """Scores of queries and chunks stay in the tasks; repeated keys count as one chunk per length (txt4)."""
    from math import log
    from gridloom.operators import search as S
    rows = [(i, i % 3, f"word{i % 5} common common{i % 2} x") for i in range(60)] + [(1, 1, "word1 common common1 x"), (2, 2, None), (None, 0, "common")]
    q = spark.createDataFrame([("a", "common word1"), ("b", "common0 Word3 common"), ("none", "absent"), (None, "x")], "q string, query string")
    for some in (rows, rows[:60]):
        got = S.bm25(spark.createDataFrame(some, "doc int, part int, t string"), ["doc", "part"], "t", q, 7)
        assert "MapInArrow" in plan_of(got)
        post, n = {}, len(some)
        for d, p, t in some:
            for w in (t or "").split():
                at = post.setdefault((d, p, len(t)), {})
                at[w] = at.get(w, 0) + 1
        sizes = [len(t) for _, _, t in some if t is not None]
        al, df = sum(sizes) / len(sizes), {}
        for f in post.values():
            for w in f:
                df[w] = df.get(w, 0) + 1
        want = []
        for name, words in (("a", ["common", "word1"]), ("b", ["common0", "word3", "common"]), (None, ["x"])):
            score = {}
            for (d, p, size), f in post.items():
                s = sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f[w] * 2.2 / (f[w] + 1.2 * (0.25 + 0.75 * size / al)) for w in words if w in f)
                if s:
                    score[d, p] = score.get((d, p), 0) + s
            best = sorted(score, key=lambda k: (-round(score[k], 9), k[0] is not None, k[0] or 0, k[1]))[:7]
            want += [(name, d, p, round(score[d, p], 6), i + 1) for i, (d, p) in enumerate(best)]
        key = lambda r: (str(r[0]), r[4])
        assert sorted(((r.q, r.doc, r.part, round(r.score, 6), r.place) for r in got.collect()), key=key) == sorted(want, key=key)


def test_arrow_batches_are_small(spark):
    """A worker holds a batch several times over; a size that the session sets itself stays (prv8, prv30, prv6)."""
    from gridloom.session import BATCH_BYTES, small_batches
    assert spark.conf.get(BATCH_BYTES) == "8m"
    spark.conf.set(BATCH_BYTES, "16m")
    small_batches(spark)
    kept = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "8m")
    assert kept == "16m"
