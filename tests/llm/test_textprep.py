import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.textprep import WORD, gram_hashes, hash_words, joined, readings, undressed


def words(text):
    return WORD.findall(joined(undressed(text)))


def read(text, known, reach=10, edits=False):
    return {" ".join(WORD.findall(t)) for t in readings(undressed(text), set(known.split()), reach, edits)}


def test_markup_references_and_invisible_characters():
    assert words("<p>A <b>red</b> fox&#39;s &amp; dens<br>x</p>") == ["a", "red", "fox", "s", "dens", "x"]
    assert words("in<b>si</b>de") == ["inside"] and words("one<p>two") == ["one", "two"]
    assert words("thri\u200bfty mi\u00adller \ufeffglass&shy;es &zwnj;x") == ["thrifty", "miller", "glasses", "x"]
    assert words("<!-- a\nb -->kept a < b and c > d") == ["kept", "a", "b", "and", "c", "d"]
    assert words("STRASSE Café x_y **out.**") == ["strasse", "café", "x", "y", "out"]
    assert words("a <!-- b") == ["a", "b"] and words("<!--x--><!--y-->z<!--") == ["z"]


def test_openings_without_an_end_cost_one_pass():
    began = time.perf_counter()
    assert len(words("<!-- a " * 200_000)) == 200_000 and words("<a " * 200_000) == ["a"] * 200_000
    assert time.perf_counter() - began < 10


def test_words_broken_at_line_ends():
    assert words("a stu-\nbborn one") == ["a", "stubborn", "one"]
    assert words("rat-\r\n> tles") == ["rattles"]
    assert words("mea\u00ad\nsure") == ["measure"]
    assert words("- item\n- item") == ["item", "item"]
    assert read("well-\nknown", "well known") == {"well known"}
    assert read("com-\nputer", "computer") == {"computer"} and read("com-\nputer", "") == {"computer"}
    assert read("in-\nside", "in inside") == {"inside", "in side"}
    assert read("a-\nb-\nc x", "ab c x") == {"ab c x"} and read("q-\nb-\nr x", "b") == {"q b r x"}
    assert read("well-\nknown", "well", edits=True) == {"wellknown", "well known"}
    assert read("a\x1eb", "ab a b") == {"a b"}


def test_many_breaks_end():
    began = time.perf_counter()
    assert read("a-\n" * 500 + "a", "a aa aaa") == {"a" * 501, " ".join("a" * 501)}
    assert len(read("x in-\nside " * 3000, "x in inside")) < 10_000
    assert time.perf_counter() - began < 20


def test_each_break_is_read_by_itself():
    known = "in inside to today x y"
    got = read("x in-\nside y to-\nday x", known)
    for mixture in ("x inside y today x", "x in side y today x", "x inside y to day x", "x in side y to day x"):
        assert mixture in got
    far = read("in-\nside " + "x " * 30 + "to-\nday", known)
    assert len(far) == 2  # no stretch of ten words holds both


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.text(max_size=20))
def test_hashes_name_words(a, b):
    text = f"{a} {b}"
    value, start, end = hash_words(text)
    found = [text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    assert all(w and all(c.isalnum() for c in w) for w in found)
    by_hash = {}
    for h, w in zip(value.tolist(), found, strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(set(by_hash.values())) == len(by_hash)
    alone = [int(hash_words(w)[0][0]) for w in found]
    assert alone == value.tolist()


def test_gram_hashes():
    value, _, _ = hash_words("a b c a b c a")
    grams = gram_hashes(value, 3)
    assert len(grams) == 5 and grams[0] == grams[3] and grams[1] == grams[4] and len(np.unique(grams)) == 3
    assert len(gram_hashes(value[:2], 3)) == 0
