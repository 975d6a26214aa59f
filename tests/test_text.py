"""Golden values of the text functions."""

import random

import pytest
from pyspark.sql import functions as F

from shellac.functions import text


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i long, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_trunc_counts_code_points(spark):
    assert values(spark, lambda c: text.trunc(c, 5), "abcde", "abcdef", "ééééé", "éééééé", "", None) == ["abcde", "abcd…", "ééééé", "éééé…", "", None]


def test_trim_bytes_counts_bytes(spark):
    got = values(spark, text.trim_bytes, "a" * 100, "a" * 101, "é" * 50, "é" * 60, "", None, "a" * 5000)
    assert got == ["a" * 100, "a" * 99 + "…", "é" * 50, "é" * 49 + "…", "", None, "a" * 99 + "…"]
    assert values(spark, lambda c: text.trim_bytes(c, 1), "abc", "", None) == ["…", "…", None]


def test_meta_line(spark):
    df = spark.createDataFrame([("x" * 41, "No origin provided", ""), ("a", "b", "c"), ("No artist provided", "", None), ("a", "No tags", None)], "a string, b string, c string")
    got = [r[0] for r in df.select(text.meta_line(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x" * 39 + "…", "a · b · c", "", "a"]


def test_search_folds_ascii_on_the_stored_side(spark):
    assert values(spark, lambda c: text.matches(c, "école"), "École", "école", "ÉCOLE") == [False, True, False]
    assert values(spark, lambda c: text.matches(c, "école", "unicode"), "École", "école", "ÉCOLE") == [True, True, True]
    assert values(spark, lambda c: text.matches(c, "BOSS"), "the Boss", "bos", None) == [True, False, None]


def test_search_wildcards(spark):
    assert values(spark, lambda c: text.matches(c, "a_c"), "abc", "ac", "xaxcx") == [True, False, True]
    assert values(spark, lambda c: text.matches(c, "a%c"), "abbbc", "ac", "ca") == [True, True, False]
    assert values(spark, lambda c: text.matches(c, "%\\b"), "a\\b", "ab") == [True, False]
    assert values(spark, lambda c: text.matches(c, "a\\b"), "a\\b", "ab") == [True, False]
    assert values(spark, lambda c: text.matches(c, ""), "a", "", None) == [True, True, None]


def test_video_id(spark):
    table = {
        "https://youtu.be/abc?t=1": "abc", "https://youtu.be/": "", "https://youtu.be": "", "https://www.youtube.com/watch?v=abc&t=1": "abc", "https://youtube.com/watch?t=1&v=a%20b": "a b",
        "https://m.youtube.com/embed/xyz/more": "xyz", "https://YouTube.com/watch?v=Q": "Q", "https://www.youtube.com/channel/1": None, "https://example.com/watch?v=abc": None, "abc": None, "": None,
        "not a url at all": None, "https://youtube.com/x/embed/yy": "yy",
    }
    assert values(spark, text.video_id, *table) == list(table.values())
    assert values(spark, text.normalise_input, "abc", "https://youtu.be/x", None) == ["abc", "x", None]


def fitted(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, fields array<string>")
    return [r[0] for r in df.orderBy("i").select(text.fit_fields(F.col("fields"))).collect()]


def test_fit_fields_examples(spark):
    same, cut, accents, two, all_four, none = fitted(spark, [["a", "b", "c", "d"], ["a" * 200, "b", "c", "d"], ["é" * 100, "b"], ["a" * 60, "b" * 60, "c", ""], ["a" * 90, "b" * 90, "c" * 90, "d" * 90], [None, "x"]])
    assert same == "a | b | c | d" and cut == "a" * 83 + "… | b | c | d" and len(cut.encode()) <= 100
    assert accents.endswith("… | b") and none == " | x"
    assert two == f"{'a' * 60} | {'b' * 25}… | c | "
    assert all_four == f"{'a' * 86}… | … | … | …"


def test_fit_fields_equals_a_loop(spark):
    r = random.Random(1)
    rows = [["".join(r.choice("aé日😀 ") for _ in range(r.choice([0, 1, 3, 20, 60, 200]))) for _ in range(4)] for _ in range(300)]

    def loop(fields):
        parts = [(len(f.encode()), i, f) for i, f in enumerate(fields)]
        give, out = sum(p[0] for p in parts) - 89, dict(enumerate(fields))
        for size, i, f in sorted(parts, reverse=True):
            if give > 0:
                rest = max(size - give, 0)
                out[i] = f.encode()[: rest - 3 if rest > 3 else rest].decode(errors="ignore") + "…"
            give -= size
        return " | ".join(out[i] for i in range(4))

    assert fitted(spark, rows) == [loop(x) for x in rows]


def test_audio_path_and_changes(spark):
    df = spark.createDataFrame([("x", None, "y")], "a string, b string, c string")
    assert df.select(text.audio_path(F.col("a"))).first()[0] == "audio/x.mp3"
    assert df.select(text.changed_fields(title=F.col("a"), artist=F.col("b"), origin=F.col("c"))).first()[0] == "title, origin"


@pytest.mark.parametrize("needle", ["\u0001%", "a"])
def test_needle_may_hold_the_escape_character(spark, needle):
    assert values(spark, lambda c: text.matches(c, needle), "\u0001 a") == [True]
