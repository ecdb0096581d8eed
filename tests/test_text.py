from pyspark.sql import functions as F

from breakweave.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_strip_ansi_and_bom(spark):
    assert one(spark, T.strip_ansi(F.col("t")), t="\x1b[31merror\x1b[0m \x1b]8;;http://x\x07link") == "error link"
    assert one(spark, T.strip_bom(F.col("t")), t="\ufeffa") == "a"


def test_unix_lines_and_redraws(spark):
    assert one(spark, T.unix_lines(F.col("t")), t="a\r\nb\rc") == "a\nb\nc"
    assert one(spark, T.drop_redraws(F.col("t")), t="a\n\x1b[2Ab\nc") == "a\n\nc"


def test_once(spark):
    assert one(spark, T.once(F.col("t"), "\n\n"), t="x y\n\nx y") == "x y"
    assert one(spark, T.once(F.col("t"), "\n"), t="x y") == "x y"
    assert one(spark, T.once(F.col("t"), "\n"), t="") == ""


def test_collapse_repeats(spark):
    assert one(spark, T.collapse_repeats(F.col("t")), t="a\nb\nb\nb\nc\nc") == "a\nb (x3)\nc\nc"
    assert one(spark, T.collapse_repeats(F.col("t")), t="") == ""


def test_skeleton_and_fingerprint(spark):
    a = one(spark, T.skeleton(F.col("t")), t="cannot find 'x' in /a/b.c at 12")
    assert a == one(spark, T.skeleton(F.col("t")), t="cannot find 'yy'  in /q/r.c at 7") == "cannot find <str> in <path> at <num>"
    assert len(one(spark, T.fingerprint(F.col("t")), t=a)) == 24


def test_file_url_path(spark):
    assert one(spark, T.file_url_path(F.col("t")), t="file:///a%20b+c") == "/a b+c"
    assert one(spark, T.file_url_path(F.col("t")), t="file:///C:/x") == "C:/x"
    assert one(spark, T.clip(F.col("t"), 5), t="abcdefgh") == "abcd…"
