"""Sentences of TEI XML files, with the section each stands in."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_END = re.compile(r"(?<=[.!?])\s+")
SENTENCE = "path string, sentence_id string, text string, section string, `order` int"


def _plain(element) -> str:
    return " ".join(x.strip() for x in element.itertext() if x).strip()


def tei_sentences(xml: str) -> list[tuple[str, str, str | None, int]]:
    """(sentence_id, text, section, order): paragraphs in document order, numbered anew from each non-empty head."""
    out, section, title, number = [], 0, None, 0
    for _, e in ElementTree.iterparse(io.BytesIO(xml.encode())):
        name = e.tag.rpartition("}")[2]
        if name not in ("head", "p"):
            continue
        body = _plain(e)
        e.clear()
        if name == "head" and body:
            section, title, number = section + 1, body, 0
        elif name == "p":
            for s in filter(None, map(str.strip, _END.split(body))):
                number += 1
                out.append((f"s{section:04d}-{number:04d}", s, title, len(out)))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, *s) for p, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in tei_sentences(xml)]
        cols = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()))], ["path", "sentence_id", "text", "section", "order"])


def tei_rows(files: DataFrame) -> DataFrame:
    """One row per sentence of ``files(path, xml)``."""
    return files.select("path", "xml").where("xml is not null").mapInArrow(_run, SENTENCE)


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """One row per sentence of every file under ``path``. A file is one task's text, as XML can't be cut; malformed XML raises."""
    files = spark.read.option("wholetext", True).text(path).selectExpr("_metadata.file_path as path", "value as xml")
    return tei_rows(files)
