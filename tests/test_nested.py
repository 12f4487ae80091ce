import json

from pyspark.sql import functions as F

from tickloom.operators.shred import children, entities, objects, shred


def nodes(spark, *texts, labels=None):
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    return shred(spark.createDataFrame(rows, "id bigint, body string, node string"), "id", "body", labels)


def rebuilt(rows):
    """The document from its nodes, but for lists of one entry, which look like the entry."""
    below = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r)

    def of(r):
        if r.kind == "object":
            keys = {}
            for c in below.get(r.node, []):
                keys.setdefault(c.label, []).append((c.ordinal, of(c)))
            return {k: [v for _, v in sorted(x, key=lambda p: p[0])] for k, x in keys.items()}
        return r.scalar

    return [of(r) for r in sorted(below.get(None, []), key=lambda r: r.ordinal)]


def test_round_trip(spark):
    doc = {"a": [{"b": ["1", None]}, {"c": ["x", "y"]}], "d": "z"}
    got = rebuilt(nodes(spark, json.dumps(doc)).collect())
    assert got == [{"a": [{"b": ["1", None]}, {"c": ["x", "y"]}], "d": ["z"]}]


def test_dirt_gives_no_rows_or_the_document(spark):
    wrapped = json.dumps(json.dumps({"a": 1}))
    got = nodes(spark, None, "", "{\"a\": [1", wrapped, "null", "[]", "5", json.dumps(wrapped)).collect()
    by = {k: [(r.label, r.scalar) for r in got if r.doc == k] for k in range(8)}
    assert by[0] == by[1] == by[2] == by[5] == []
    assert by[3] == [("$", None), ("a", "1")] == by[7]
    assert by[4] == [("$", None)] and by[6] == [("$", "5")]


def test_single_values_and_nested_lists(spark):
    got = nodes(spark, '{"q": {"c": 1.50}, "n": [[1, 2], null]}')
    assert got.where("label = 'c'").first().scalar == "1.50"
    q = children(objects(got, "$"), got, "q")
    assert [(r.ordinal, r.kind) for r in q.collect()] == [(0, "object")]
    assert got.where("label = 'n' and kind = 'list'").count() == 1 and got.where("label = 'n' and kind = 'scalar'").count() == 2


def test_entities(spark):
    got = nodes(spark, '{"q": [{"a": ["1", "x", null], "b": [2.5]}, {}, null]}')
    q = children(objects(got, "$"), got, "q").where("kind = 'object'")
    rows = {r.ordinal: (r.a, r.b) for r in entities(q, got, {"a": "bigint", "b": "double"}, by=["ordinal"]).collect()}
    assert rows == {0: (1, 2.5), 1: (None, None), 2: (None, None)}


def test_labels_long_texts_empty_and_repeated(spark):
    long = json.dumps({"a": list(range(50_000)), "skip": {"a": [1]}})
    assert nodes(spark, long, labels=["a"]).count() == 50_001
    deep = "[" * 20_000 + "]" * 20_000
    assert nodes(spark, deep).count() == 0
    assert nodes(spark).count() == 0
    df = spark.createDataFrame([(1, '{"a": [1]}')] * 2, "id bigint, body string")
    n = shred(df, "id", "body")
    assert children(objects(n, "$"), n, "a").count() == 2
    assert shred(df.select(F.lit(None).cast("bigint").alias("id"), "body"), "id", "body").count() == 0
