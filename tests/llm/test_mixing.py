from pyspark.sql import functions as F

from quern.llm.mixing import copies, mix_documents, mix_rates, mix_shares, source_name
from quern.llm.tokens import TOKENIZER, count_tokens

TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_token_counts_are_those_of_the_vocabulary(spark):
    import base64

    import tiktoken

    from quern.llm.tokens import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello world, 1234!", "naïve <|endoftext|> 東京", "a" * 5000, " \n\t "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").withColumn("_text", F.lit("clash"))
    got = {r.k: r.n_tokens for r in count_tokens(df, {"k": F.col("doc_id")}).collect()}
    assert got == {k: len(own.encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}


def test_source_names(spark):
    names = [" Run-Reports ", "run_reports", "RUN  REPORTS", "run__reports_", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").select(source_name(F.col("s"))).collect()]
    assert got == ["run_reports"] * 4 + [None, ""]


def test_rates(spark):
    sizes = spark.createDataFrame([("a", 600), ("a", 400), ("b", 50), ("x", 9)], "source string, n_tokens bigint")
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.3, 3), ("none", 0.2, 5), ("zero", None, None), (None, 0.1, 1)], TARGETS)
    got = {r.source: r for r in mix_rates(sizes, targets).collect()}
    # b binds: 3 x 50 tokens are 0.3 / 0.8 of the mix
    assert got["b"].rate == 3 and abs(got["a"].rate - 0.25) < 1e-12 and got["none"].rate == 0 and got["zero"].rate == 0 and set(got) == {"a", "b", "none", "zero"}
    assert abs(got["a"].aim_share - 0.625) < 1e-12
    big = {r.source: r.rate for r in mix_rates(sizes, targets, total_tokens=10_000).collect()}
    assert big["a"] == 2 and big["b"] == 3


def test_copies_are_fixed_and_unbiased(spark):
    df = spark.range(20_000).select(copies(F.col("id"), F.lit(2.3), 7).alias("n"), copies(F.col("id"), F.lit(2.3), 8).alias("m"), copies(F.col("id"), F.lit(2.0), 7).alias("k"))
    row = df.agg(F.min("n"), F.max("n"), F.avg("n"), F.sum((F.col("n") != F.col("m")).cast("int")), F.min("k"), F.max("k")).first()
    assert (row[0], row[1]) == (2, 3) and abs(row[2] - 2.3) < 0.02 and row[3] > 5000 and (row[4], row[5]) == (2, 2)


def test_mix_reaches_its_shares(spark):
    rows = [(k, "Big", f"word {k} " * 20) for k in range(1500)] + [(10_000 + k, "small ", "tiny text") for k in range(300)] + [(99_999, "other", "x"), (99_998, None, "x"), (99_997, "big", None)]
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3)], TARGETS)
    d = documents(spark, rows).withColumn("rate", F.lit(9)).withColumn("n_tokens", F.lit(9)).withColumn("copy", F.lit(9))
    shares = {r.source: r for r in mix_shares(d, targets).collect()}
    assert abs(shares["small"].reached_share - 0.1) < 0.01 and shares["small"].most_copies <= 3 and shares["big"].most_copies <= 1
    mix = mix_documents(d, targets)
    again = mix_documents(d, targets)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, again.collect()))
    by = {r[0]: r[1] for r in mix.groupBy("source").count().collect()}
    assert by == {s: shares[s].mixed_documents for s in ("big", "small")}


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    none = documents(spark, [])
    assert mix_documents(none, targets).count() == 0
    assert [(r.source, r.reached_share) for r in mix_shares(none, targets).collect()] == [("a", 0.0)]
    assert mix_documents(documents(spark, [(1, "a", "x")]), targets.limit(0)).count() == 0
    assert mix_shares(documents(spark, [(1, "a", "x")]), targets.limit(0)).count() == 0
    only = mix_documents(documents(spark, [(1, "a", "x y"), (1, "a", "x y")]), targets)
    assert only.count() == 2
