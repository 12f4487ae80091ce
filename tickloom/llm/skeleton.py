"""One form for texts that look the same.

A text is decomposed, every character is replaced by the prototype of those that look like it,
and the result is decomposed again. Texts with equal skeletons look the same.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialize

# Letters of other scripts and the Latin letters they look like.
_LIKE = {
    "Cyrillic": ("АВЕКМНОРСТУХЅІЈԚԜҮӀѴԌаеорсухѕіјһԛԝԁӏѵү", "ABEKMHOPCTYXSIJQWYIVGaeopcyxsijhqwdlvy"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϜοϳναυιργϲ", "ABEZHIKMNOPTYXCFojvauipyc"),
    "Armenian": ("ՕՍՏԼսօհոցզյա", "OUSLuohngqjw"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Coptic": ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc"),
    "Latin": ("ɑɡıȷɩ", "agiji"),
}
#: Blocks that hold characters with a prototype; the rest are ideographs, syllables and private use.
_PARTS = ((0x20, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0xE0000, 0xE0200))
# Characters without ink that are no formats by category; the last one is as wide as a space.
_INKLESS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
_BLANK = 0x2800


def prototypes(confusables: str | None = None) -> dict[int, str | None]:
    """What replaces each character, from the character database where it has a rule, and from the letters above.

    ``confusables`` names a file in the public form ``source ; prototype ; class`` with hexadecimal
    code points, whose entries are added.
    """
    table: dict[int, str | None] = {}
    for odd, usual in _LIKE.values():
        table.update(zip(map(ord, odd), usual))
    if confusables:
        for line in Path(confusables).read_text("utf-8-sig").splitlines():
            fields = line.split("#")[0].split(";")
            if len(fields) > 1 and len(fields[0].split()) == 1 and int(fields[0], 16) > 0x7F:
                table.setdefault(int(fields[0], 16), "".join(chr(int(c, 16)) for c in fields[1].split()))
    for first, last in _PARTS:
        for code in range(first, last):
            ch = chr(code)
            category = unicodedata.category(ch)
            kind, _, rest = unicodedata.decomposition(ch).partition(" ")
            if category == "Zs" or code == _BLANK:
                table[code] = " "
            elif category in ("Zl", "Zp"):
                table[code] = "\n"
            elif category == "Cf" or code in _INKLESS:
                table[code] = None  # formats, fillers, variation selectors and joiners have no ink
            elif kind in ("<wide>", "<narrow>", "<font>", "<noBreak>") or (kind == "<compat>" and _letters(ch)):
                table[code] = unicodedata.normalize("NFKD", ch).translate(table)
    del table[0x20]
    return table


def _letters(ch: str) -> bool:
    """Whether a compatible form is written with the letters it stands for: ligatures, digraphs and Roman numerals, but no long s alone."""
    parts = unicodedata.normalize("NFKC", ch)
    return parts.isalpha() and (unicodedata.category(ch) == "Nl" or (len(parts) > 1 and ch.isalpha()))


_TABLE = prototypes()


def skeleton(text: str, table: dict[int, str | None] = _TABLE) -> str:
    """The skeleton of a text. Case, accents, digits, punctuation and line ends stay."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def with_skeletons(df: DataFrame, doc: str, text: str, confusables: str | None = None) -> DataFrame:
    """``(doc, form, original)``: 128-bit digests of each text's skeleton and of the text itself.

    Whole texts are read, only digests leave the task. A null text gives no row; an empty text is
    a text like another. Other columns are ignored. ``confusables`` names a file with further
    prototypes, read on the driver.
    """
    table = prototypes(confusables) if confusables else _TABLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            originals = [_digest(t) for t in texts]
            forms = [o if t.isascii() else _digest(skeleton(t, table)) for t, o in zip(texts, originals)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.binary()), pa.array(originals, pa.binary())], names=["doc", "form", "original"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc bigint, form binary, original binary")


def classes(df: DataFrame, doc: str, text: str, confusables: str | None = None) -> DataFrame:
    """One row per text: ``(doc, class_id, variants)``, the least id that looks the same and the number of different strings there."""
    forms = materialize(with_skeletons(df, doc, text, confusables))
    groups = forms.groupBy("form", "original").agg(F.min("doc").alias("first")).groupBy("form").agg(F.min("first").alias("class_id"), F.count("*").alias("variants"))
    return forms.join(groups, "form").select("doc", "class_id", "variants")


def lookalikes(df: DataFrame, doc: str, text: str, confusables: str | None = None, size: int = 1000) -> DataFrame:
    """Pairs ``(doc_a, doc_b)``, ``doc_a < doc_b``, of rows whose texts look the same but differ.

    The digests are written once and counted by skeleton and text before the shuffle. Skeletons
    written in one way only go no further. Of the others the different texts are paired, and then
    their rows, so that no two rows meet that are no result; a class of many rows is cut
    into parts of about ``size``, each of which meets the rows of the other text on its own. Equal
    texts, nulls and a repeated id make no pair.
    """
    forms = materialize(with_skeletons(df, doc, text, confusables))
    variants = forms.groupBy("form", "original").agg(F.count("*").alias("n"))
    several = variants.groupBy("form").agg(F.count("*").alias("texts"), F.ceil(F.sum("n") / size).cast("int").alias("parts")).where("texts > 1").select("form", "parts")
    rows = forms.where("doc IS NOT NULL").join(several, "form")
    texts = rows.select("form", "original", "parts").distinct()
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part")
    pairs = texts.withColumnRenamed("original", "one").join(texts.select("form", F.col("original").alias("other")), "form").where("one < other")
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part")
    left = rows.select("form", F.col("original").alias("one"), part, F.col("doc").alias("a")).join(pairs.select("form", "one", "other", every), ["form", "one", "part"])
    right = rows.select("form", F.col("original").alias("other"), every, F.col("doc").alias("b"))
    return left.join(right, ["form", "other", "part"]).where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def sql_form(text: str) -> str:
    """SQL for one form of a text, equal where skeletons are: the same prototypes, composed in the end."""
    composed = {c: unicodedata.normalize("NFC", skeleton(chr(c))) for first, last in _PARTS for c in range(first, last)}
    odd = {c: form for c, form in composed.items() if form != unicodedata.normalize("NFC", chr(c))}
    for c, form in odd.items():
        if len(form) > 1:
            text = f"replace({text}, '{chr(c)}', '{form}')"
    single = {c: form for c, form in odd.items() if len(form) == 1}
    gone = "".join(chr(c) for c, form in odd.items() if not form)
    usual = "".join(single.values()).replace("'", "''")
    return f"nfc_normalize(translate({text}, '{''.join(map(chr, single)) + gone}', '{usual}'))"
