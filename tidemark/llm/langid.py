"""Language ID by compression: the language whose raw-content zstandard dictionary makes a text smallest.

One dictionary for each non-null lang: a hash-chosen sample of training texts, up to SAMPLE_DOCS of
SAMPLE_CHARS each and DICT_BYTES in all, and with many languages fewer, so that all together stay below ALL_DOCS
texts and ALL_BYTES (these bound the fit only). Every text is encoded whole, in
pieces of PIECE bytes so that a long text does not come to live on its own history. The smallest sum of
sizes names the language; the relative margin to the second smallest makes the score, and a margin under
MARGIN is rejected (`rejected` is true; the smallest is still named).

Cases: null texts and texts without a letter (general category L: not digits, fractions or Roman numeral signs) are `und`
with score 0; very long texts are encoded whole, piece by piece; ties go to the first language in
code-point order; without a training row everything is `und`; repeated rows give repeated rows; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import is_held_out, over_batches, prepare

SAMPLE_DOCS = 128
SAMPLE_CHARS = 4_096
DICT_BYTES = 112_640
ALL_DOCS, ALL_BYTES = 16_384, 32 << 20
LEVEL = 9
PIECE = 1_024
#: Margins, as a part of the smaller size, below which a prediction is rejected.
MARGIN = 0.01
#: The margin at which the score is 0.88 (tanh 1 lies half-way between 0.5 and 1).
SCALE = 0.05
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """A text's words of letters and their combining marks in lower case, a space between them: case, digits and signs tell little of a language."""
    return _OTHER.sub(" ", text.lower())


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from at most about 2 * SAMPLE_DOCS texts of each."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return {}
    most = max(1, min(SAMPLE_DOCS, ALL_DOCS // len(sizes)))
    shares = known.sparkSession.createDataFrame([(lang, 2 * most / n) for lang, n in sizes.items()], "lang string, part double")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("lang-1"), F.col("doc_id").cast("string"), F.md5("text"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rows = known.join(F.broadcast(shares), "lang").withColumn("draw", draw).filter(F.col("draw") < F.col("part")).select("lang", "draw", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        texts.setdefault(r["lang"], []).extend(letters(line) for line in r["text"].split("\n"))
    return contents({k: list(dict.fromkeys(t for t in v if t.strip())) for k, v in sorted(texts.items())})


def contents(texts: dict[str, list[str]]) -> dict[str, bytes]:
    """Dictionary content from each language's lines. Either half of them is first read by the other half's dictionaries: lines that those take for another language are likely foreign passages and left out."""
    halves = [{k: v[h::2] for k, v in texts.items() if v[h::2]} for h in range(2)]
    kept: dict[str, list[str]] = {k: [] for k in texts}
    for own, other in (halves, halves[::-1]):
        judge = Classifier(_joined(other))
        for lang, some in own.items():
            kept[lang] += [t for t in some if lang not in judge.langs or judge.predict(t)[0] == lang]
    return _joined({k: kept[k] or v for k, v in texts.items()})


def _joined(texts: dict[str, list[str]]) -> dict[str, bytes]:
    """Words in an order of their own, so that a text matches by its words and not by a passage that it shares with the sample."""
    out = {}
    for lang, lines in texts.items():
        words = " ".join(lines).split()
        order = np.random.default_rng(1).permutation(len(words))
        if words:
            out[lang] = " ".join(words[i] for i in order).encode()[-min(DICT_BYTES, ALL_BYTES // len(texts)) :]
    return out


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.encoders = []
        for lang in self.langs:
            shared = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        raw = letters(text).encode()
        sizes = [0] * len(self.langs)
        for a in range(0, len(raw), PIECE):
            piece = raw[a : a + PIECE]
            for k, e in enumerate(self.encoders):
                sizes[k] += len(e.compress(piece))
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        margin = (min(s for k, s in enumerate(sizes) if k != best) - sizes[best]) / sizes[best]
        return self.langs[best], 0.5 + 0.5 * math.tanh(margin / SCALE), margin < MARGIN


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(content)  # at most DICT_BYTES a language

    def made():
        own = Classifier(shared.value)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.predict(t) for t in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return f

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over_batches(made), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
