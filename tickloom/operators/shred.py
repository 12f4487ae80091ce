"""Nested JSON documents as an adjacency table, and entity tables made from it.

A document becomes rows ``(doc, node, parent, label, ordinal, kind, scalar)``. Lists have no node
of their own: an entry carries the label of its list and its place in it, so that a single value
in place of a list is the entry at place 0. Entity tables join object nodes with their scalar
children on ``(doc, parent)`` and pivot the labels into columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOT = "$"
NODES = "doc bigint, node bigint, parent bigint, label string, ordinal bigint, kind string, scalar string"
_ARROW = pa.schema(
    [("doc", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("ordinal", pa.int64()), ("kind", pa.string()), ("scalar", pa.string())]
)
_MISSING = object()


def parse(text: str | None) -> object:
    """The document in ``text``; ``_MISSING`` where there is none.

    A document that was wrapped as a JSON string, once or more, counts as the document itself.
    Incomplete text and nulls give ``_MISSING``.
    """
    if text is None:
        return _MISSING
    try:
        value = json.loads(text, parse_float=str, parse_int=str)
    except (ValueError, RecursionError):
        return _MISSING
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            break
    return value


def document_nodes(text: str | None, keep: frozenset[str] | None) -> list[tuple]:
    """The nodes ``(node, parent, label, ordinal, kind, scalar)`` of the document in ``text``."""
    document = parse(text)
    if document is _MISSING:
        return []
    out: list[tuple] = []
    count = 0
    # (value, parent node, label, ordinal); a list entry that is a list keeps its own node
    stack = [(x, None, ROOT, i) for i, x in reversed(list(enumerate(document)))] if isinstance(document, list) else [(document, None, ROOT, 0)]
    while stack:
        value, parent, label, ordinal = stack.pop()
        node, count = count, count + 1
        if isinstance(value, dict):
            kind, scalar = "object", None
            below: list = []
            for key, x in value.items():
                if keep is not None and key not in keep:
                    continue
                if isinstance(x, list):
                    below += [(y, node, key, i) for i, y in enumerate(x)]
                else:
                    below.append((x, node, key, 0))
            stack += reversed(below)
        elif isinstance(value, list):
            kind, scalar = "list", None
            stack += [(y, node, label, i) for i, y in reversed(list(enumerate(value)))]
        elif value is None:
            kind, scalar = "null", None
        elif isinstance(value, bool):
            kind, scalar = "boolean", "true" if value else "false"
        else:
            kind, scalar = "scalar", str(value)
        out.append((node, parent, label, ordinal, kind, scalar))
    return out


def shred(df: DataFrame, doc: str, text: str, labels: Iterable[str] | None = None) -> DataFrame:
    """The adjacency table of the JSON documents in column ``text``, keyed by the bigint ``doc``.

    Store the result where it is used more than once: labels are then read by pushed filters.

    ``labels`` names the keys of interest: other keys are left out with all below them. Numbers
    stay as they are written. One pass without a shuffle; a document is handled by itself, so no
    key gathers rows of others. A null, empty or incomplete text gives no node, as does a null
    ``doc``; an empty list gives none for its entries; of a key that occurs twice in an object the
    last counts. Other columns of ``df`` are ignored. Repeated rows give their nodes again.
    """
    keep = None if labels is None else frozenset(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _ARROW]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ARROW)], schema=_ARROW)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = document_nodes(content, keep) if key is not None else []
                if not rows:
                    continue
                for column, x in zip(out, zip(*[(key, *row) for row in rows])):
                    column.extend(x)
                if len(out[0]) >= 20_000:
                    yield flush()
        if out[0]:
            yield flush()

    return df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(run, NODES)


def objects(nodes: DataFrame, label: str) -> DataFrame:
    """Object nodes with this label: ``(doc, node, parent, ordinal)``."""
    return nodes.where((F.col("label") == label) & (F.col("kind") == "object")).select("doc", "node", "parent", "ordinal")


def children(parents: DataFrame, nodes: DataFrame, label: str, carry: Sequence[str] = ()) -> DataFrame:
    """The nodes with this label below ``parents``, with the parents' columns ``carry``.

    An equi-join on ``(doc, parent)``. Repeated parents count once, repeated children each.
    """
    above = parents.select("doc", F.col("node").alias("parent"), *carry).dropDuplicates(["doc", "parent"])
    return nodes.where(F.col("label") == label).join(above, ["doc", "parent"])


def entities(parents: DataFrame, nodes: DataFrame, fields: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Pivot the scalar children of ``parents`` into one row per parent.

    ``fields`` maps labels to Spark types (``try_cast``: a text number counts as a number, text
    that is none becomes null). ``by=["ordinal"]`` makes a row per place instead: parallel lists
    below one object become rows. Objects without any of the fields give no row; a field that is
    absent or null is null; of repeated children the greatest counts.
    """
    above = parents.select("doc", F.col("node").alias("parent")).dropDuplicates()
    low = nodes.where(F.col("label").isin(list(fields)) & F.col("kind").isin("scalar", "boolean", "null")).select("doc", "parent", "label", "ordinal", "scalar")
    picked: list[Column] = [F.max(F.when(F.col("label") == name, F.col("scalar"))).try_cast(kind).alias(name) for name, kind in fields.items()]
    return low.join(above, ["doc", "parent"]).groupBy("doc", F.col("parent").alias("node"), *by).agg(*picked)
