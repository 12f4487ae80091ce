import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tickloom.llm.skeleton import classes, lookalikes, prototypes, skeleton, sql_form


def test_alike_and_different():
    same = [("café", "café"), ("ＡＢ１，", "AB1,"), ("ﬁn", "fin"), ("Мoscow", "Moscow"), ("a b c", "a b c"), ("a​b﻿­", "ab"), ("ΑΒ", "AB"), ("ё", "ë"), ("", "​")]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)
    same += [("𝐀𝑏𝒞𝟙", "AbC1"), ("Ⅳ ⅻ", "IV xii"), ("αυ", "au"), ("ꓮꓐ", "AB"), ("ᎪᏴ", "AB"), ("ո", "n"), ("ɑɡ", "ag"), ("ı", "i"), ("a\U000e0041b\U000e0100", "ab"), ("ⲞⲢ", "OP"), ("ĳ", "ij"), ("Ү", "Y"), ("aㅤ\u115fb", "ab"), ("a\u2028b", "a\nb"), ("a\u2800b", "a b"), ("ỳ", "y\u0300"), ("Ӑ", "Ă")]
    for a, b in same:
        assert skeleton(a) == skeleton(b), (a, b)
    other = [("№", "No"), ("₨", "Rs"), ("café", "cafe"), ("A", "a"), ("½", "1/2"), ("²", "2"), ("“a”", '"a"'), ("—", "-"), ("a\nb", "a b"), ("a\r\nb", "a\nb"), ("a  b", "a b"), ("0", "O"), ("l", "1"), ("rn", "m"), ("Δ", "A"), ("Я", "R"), ("ß", "ss")]
    for a, b in other:
        assert skeleton(a) != skeleton(b), (a, b)
    assert skeleton(skeleton("Кафé ﬁ")) == skeleton("Кафé ﬁ")


def frame(spark, *texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id bigint, body string, doc string").withColumn("form", F.lit(1))


def test_pairs_and_classes(spark):
    long = "word " * 200_000
    df = frame(spark, "Аbc", "Abc", "Abc", "abc", None, "", "", "​", long, long + "­")
    got = sorted((r.doc_a, r.doc_b) for r in lookalikes(df, "id", "body").collect())
    assert got == [(0, 1), (0, 2), (5, 7), (6, 7), (8, 9)]
    by = {r.doc: (r.class_id, r.variants) for r in classes(df, "id", "body").collect()}
    assert by == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 1), 5: (5, 2), 6: (5, 2), 7: (5, 2), 8: (8, 2), 9: (8, 2)}


def test_empty_and_repeated_rows(spark):
    df = frame(spark, "Аb", "Ab")
    assert lookalikes(df.limit(0), "id", "body").count() == 0 and classes(df.limit(0), "id", "body").count() == 0
    assert lookalikes(df.where("id = 0").union(df.where("id = 0")), "id", "body").count() == 0


def test_a_large_class_is_paired_in_parts(spark):
    texts = ["Аbc"] * 700 + ["Abc"] * 3 + ["Αbc"] * 2 + ["abc"] * 500
    df = frame(spark, *texts)
    want = sorted((a, b) for a in range(705) for b in range(a + 1, 705) if texts[a] != texts[b])
    for size in (10, 10**6):
        assert sorted((r.doc_a, r.doc_b) for r in lookalikes(df, "id", "body", size=size).collect()) == want


def test_prototypes_from_a_file(spark, tmp_path):
    file = tmp_path / "more.txt"
    file.write_text("\ufeff# a comment\n00DF ; 03B2 ; MA # not alike to all eyes\n1E9E 0041 ; 0042 ; MA\n", "utf-8")
    assert skeleton("ß", prototypes(str(file))) == "β" and skeleton("ß") == "ß"
    got = lookalikes(frame(spark, "aß", "aβ"), "id", "body", str(file)).collect()
    assert [(r.doc_a, r.doc_b) for r in got] == [(0, 1)] and lookalikes(frame(spark, "aß", "aβ"), "id", "body").count() == 0


def test_sql_has_the_same_forms():
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    odd = [chr(c) for c in prototypes()] + list("abcXYZ éßüйё\u0300\u0308\n")
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(12))) for _ in range(3000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    forms = dict(con.execute(f"SELECT k, {sql_form('text')} FROM t").fetchall())
    for k, t in enumerate(texts):
        assert forms[k] == unicodedata.normalize("NFC", skeleton(t)), ascii(t)
