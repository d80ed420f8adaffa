"""Personal data in documents: spans, counts, redacted texts.

Method: candidate gradient boosting. Generators of high recall propose overlapping spans, boosted trees score
them by format and context, isotonic calibration turns scores into chances and a threshold for each kind selects.
Spans by the fixed patterns always stay; the model adds spans of the same kinds that those patterns miss. The model
is fitted on generated texts (private_spans.py) once, on the driver, and is broadcast: some 80 small trees.

Texts are independent, so there is no shuffle and nothing is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .private_spans import KINDS, Span, added_spans, base_spans, trained
from .words import slices
from .workers import lean


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with <KIND> in place of each span; of spans that overlap, the first hides the others' rest too."""
    out, at = [], 0
    for s in sorted(spans):
        if s.start >= at:
            out += [text[at : s.start], f"<{KINDS[s.kind].upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def find_private(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans),
    spans (base and added ones as kind:start:end in code points, end exclusive, by start and kind, joined by commas), and
    redacted if with_text.

    A base span is never dropped; base spans of different kinds may overlap, added ones overlap none. Null and empty
    texts have none (redacted: empty). Rows of one id and with a null id are documents of their own; an empty table
    gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch, texts in slices(batches):
            rows = []
            for raw in texts:
                text = raw.decode()
                base = base_spans(text)
                every = sorted([*base, *added_spans(text, base, own)])
                counts = [sum(s.kind == k for s in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), *[redacted(text, every)] * with_text))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (6 + with_text)
            types = [pa.int64()] * 4 + [pa.string()] * (2 + with_text)
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["redacted"] * with_text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(lean(find), schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    return find_private(table(spark, sf_dir, "documents"))
