"""Files as rows: a binary scan, and decoders that turn a file into pages.

A decoder is a function of a file's bytes that yields pages' texts. Those for
DOCX, HTML and plain text need only the standard library; one for PDF or
images can be registered where its libraries are installed.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[bytes], Iterator[str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_docx(content: bytes) -> Iterator[str]:
    """The pages of a DOCX file, as its page breaks part them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines: list[str] = []
    for p in body.iter(f"{_W}p"):
        line = ""
        for e in p.iter():
            if e.tag == f"{_W}t":
                line += e.text or ""
            elif e.tag == f"{_W}tab":
                line += "\t"
            elif e.tag == f"{_W}br" and e.get(f"{_W}type") == "page" or e.tag == f"{_W}lastRenderedPageBreak":
                lines.append(line)
                yield "\n".join(lines).strip()
                lines, line = [], ""
        lines.append(line)
    yield "\n".join(lines).strip()


def decode_html(content: bytes) -> Iterator[str]:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", content.decode("utf-8", "replace"))
    text = re.sub(r"(?i)<(?:/?(?:p|div|li|tr|h[1-6])|br)\b[^>]*>", "\n", text)
    yield re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", html.unescape(re.sub(r"<[^>]*>", "", text)))).strip()


def decode_text(content: bytes) -> Iterator[str]:
    for page in content.decode("utf-8-sig", "replace").split("\f"):
        yield page.strip()


DECODERS: dict[str, Decoder] = {"docx": decode_docx, "html": decode_html, "htm": decode_html, "txt": decode_text}
#: Bytes of a file at most, as uploads are limited.
MOST_BYTES = 100 * 1024 * 1024


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, ext, length, content of the files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "length", "content")


def pages(files: DataFrame, decoders: dict[str, Decoder] = DECODERS) -> DataFrame:
    """path, page, text, status for files (path, ext, length, content): a row for each page, or one that says why there is none."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, ext, length, content in zip(frame.path, frame.ext, frame.length, frame.content, strict=True):
                if ext not in decoders:
                    out.append((path, 0, None, "unsupported"))
                elif length > MOST_BYTES:
                    out.append((path, 0, None, "too large"))
                else:
                    try:
                        out += [(path, k, text, "ok") for k, text in enumerate(decoders[ext](bytes(content)), 1)]
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        out.append((path, 0, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "status"])

    return files.select("path", "ext", "length", "content").mapInPandas(decode, "path string, page int, text string, status string")


def save_text(docs: DataFrame, folder: str) -> None:
    """doc_id, text as text files, a folder for each doc_id."""
    docs.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(folder)


def save_corrections(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def load_corrections(spark: SparkSession, folder: str) -> DataFrame:
    schema = "original string, font string, domain string, corrected string, n long, confidence double, last_seen timestamp"
    return spark.read.schema(schema).json(folder)
