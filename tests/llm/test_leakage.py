import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm.leakage import ItemIndex, find_leaks, myers_distance, piece_length

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def distance(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abc"), max_size=14), st.integers(0, 4))
def test_myers(pattern, text, limit):
    assert myers_distance(pattern, text, limit) == (distance(pattern, text) <= limit)


def test_pieces_make_up_a_stretch():
    for words in range(4, 16):
        for edits in range(3):
            assert words - edits <= piece_length(words, edits) * (edits + 1) <= words
    with pytest.raises(ValueError):
        piece_length(3, 5)


def leaks(spark, documents, items, **options):
    d = spark.createDataFrame(documents, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, passage string, question string")
    return sorted(map(tuple, find_leaks(d, i, **options).collect()))


def test_whole_part_and_altered(spark):
    ten, nine = " ".join(ITEM.split()[3:13]), " ".join(ITEM.split()[3:12])
    documents = [
        (1, f"before {ITEM.upper()} after"), (2, f"x {ten.replace(' ', ' | ')} y"), (3, f"{nine} y"), (4, ten.replace("seven", "se-\nven").replace("nine", "<b>ni</b>ne")),
        (5, ten.replace(" eight", " very eight")), (6, None), (7, ""), (8, " ".join(ITEM.split()[3:8]) + " " + ITEM), (9, f"{nine}\n\n"), (1, ten),
    ]
    items = [(10, ITEM, "short question"), (11, None, ITEM), (12, "other words " * 3, None), (13, ITEM, ITEM), (None, ITEM, None)]
    got = leaks(spark, documents, items)
    assert got == sorted((d, i) for d in (1, 2, 4, 8) for i in (10, 11, 13))
    near = leaks(spark, documents, items[:1], max_edits=1)
    assert near == [(d, 10) for d in (1, 2, 3, 4, 5, 8, 9)]


def test_unlike_hyphens_in_one_stretch(spark):
    item = "one two three four well known five six computer seven"
    documents = [(1, "x one two three four well-\nknown five six compu-\nter seven"), (2, "one two three four well-\nknown five six com-\nputer seven y"), (3, "one two three four wellknown five six computer seven")]
    assert leaks(spark, documents, [(5, item, "unrelated wellknown known com puter words that make every form of each break possible here")]) == [(1, 5), (2, 5)]
    assert leaks(spark, documents, [(5, item, None)], max_edits=1) == [(1, 5), (2, 5)]
    assert leaks(spark, [(1, "head-\none two three four five six seven eight nine ten-\ntail")], [(5, ITEM, None)]) == [(1, 5)]


def test_documents_do_not_run_into_each_other(spark):
    half = ITEM.split()
    assert leaks(spark, [(1, " ".join(half[:8])), (2, " ".join(half[8:]))], [(5, ITEM, None)]) == []


def test_empty_tables_blocks_long_texts_and_clashing_columns(spark):
    assert leaks(spark, [], [(5, ITEM, None)]) == [] and leaks(spark, [(1, ITEM)], []) == []
    long = "filler words " * 100_000 + ITEM
    assert leaks(spark, [(1, long)], [(k, ITEM, None) for k in range(40)], block_words=20) == [(1, k) for k in range(40)]
    d = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("item", F.lit(2))
    i = spark.createDataFrame([(5, ITEM, None)], "item_id bigint, passage string, question string").withColumn("text", F.lit("x")).withColumn("doc_id", F.lit(1))
    assert sorted(map(tuple, find_leaks(d, i).collect())) == [(1, 5)]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_random_against_brute_force(edits):
    draw = random.Random(edits)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(draw.choices(vocabulary, k=20))) for k in range(15)]
    index = ItemIndex(8, edits).build(items)
    documents = []
    for _ in range(120):
        words = draw.choices(vocabulary, k=30)
        source = draw.choice(items)[1].split()
        at, size = draw.randrange(15), draw.randrange(5, 14)
        part = source[at : at + size]
        for _ in range(draw.randrange(3)):
            part.insert(draw.randrange(len(part) + 1), "zz") if draw.random() < 0.5 else part.pop(draw.randrange(len(part))) if len(part) > 1 else None
        documents.append(" ".join(words[:10] + part + words[10:]))
    bounds = [0]
    for text in documents:
        bounds.append(bounds[-1] + len(text) + 1)
    import numpy as np

    got = set(index.leaks("\n".join(documents) + "\n", np.array(bounds)))
    want = set()
    for d, text in enumerate(documents):
        words = text.split()
        for k, item in items:
            pattern = item.split()
            if any(distance(pattern[s : s + 8], words) <= edits for s in range(len(pattern) - 7)):
                want.add((d, k))
    assert got == want and want
