"""Binary files as a source, decoded by a function that the user gives."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import sanitize_filename, validate_file_size, validate_filename
from quarry.operators.common import broadcast_if_small

PAGE_SCHEMA = "path string, page int, text string, _corrupt string"
#: A box as decoders give it: x0, y0, x1, y1, or None.
Box = tuple[float, float, float, float] | None


@dataclass
class Decoded:
    """What a decoder reads from a file. pages: (page, text); blocks: (page, text, box) in page order;
    images: (page, format, box, bytes); tables: (page, cells, box), the first row being the headers."""

    pages: list[tuple[int, str]] = field(default_factory=list)
    blocks: list[tuple[int, str, Box]] = field(default_factory=list)
    images: list[tuple[int, str, Box, bytes]] = field(default_factory=list)
    tables: list[tuple[int, list[list[str | None]], Box]] = field(default_factory=list)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length and content of the files below path that fit the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def guarded(rows: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """files() with filename (clean), doc_id (of the clean name) and refused: why a file isn't taken, or null."""
    name = F.element_at(F.split("path", "/"), -1)
    size = validate_file_size(F.col("length"))
    refused = F.when(~validate_filename(name, extensions), "Invalid file name").when(~size["ok"], size["message"])
    return rows.withColumn("filename", sanitize_filename(name)).withColumns({"doc_id": F.xxhash64("filename"), "refused": refused})


def decode(rows: DataFrame, decoder: Callable[[bytes], Iterator[tuple[int, str]]]) -> DataFrame:
    """(path, page, text, _corrupt): pages of each file; a file that fails is one row with its error."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(path, page, text, None) for page, text in decoder(bytes(content))]
                except Exception as e:
                    out.append((path, None, None, str(e)))
            import pandas as pd

            yield pd.DataFrame(out, columns=["path", "page", "text", "_corrupt"]).astype({"page": "Int32"})

    return rows.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
#: A row for each thing that is read from a file; which columns it has depends on its part.
ITEMS = (
    "doc_id long, path string, page int, idx int, name string, text string, format string, "
    f"headers array<string>, rows array<array<string>>, bbox {_BOX}, content binary, _corrupt string, part string"
)
#: The parts, the columns of each, and what its local names are made of.
PARTS = {
    "pages": ("doc_id", "page", "text"),
    "blocks": ("doc_id", "page", "idx", "text", "bbox"),
    "images": ("doc_id", "page", "name AS image_id", "format", "bbox", "content"),
    "tables": ("doc_id", "page", "name AS table_id", "headers", "rows", "bbox"),
}
ERRORS = "errors"
_NAMES = {"images": "img", "tables": "table"}
#: Bytes and rows that a task gathers before it hands them on.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1024
#: Row groups of tables with images: bytes as they are stored, and rows, since stored bytes may be a small part.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.row.count.limit": "256"}


def _box(box: Box) -> dict | None:
    return None if box is None else dict(zip(("x0", "y0", "x1", "y1"), map(float, box), strict=True))


def items(decoded: Decoded | Iterator[tuple], wanted: frozenset[str]) -> Iterator[dict]:
    """Rows of what a decoder gives: a Decoded, or one by one (part, then what Decoded lists for it)."""
    if isinstance(decoded, Decoded):
        decoded = ((name, *x) for name in PARTS for x in getattr(decoded, name))
    seen: dict[tuple[str, int], int] = {}
    blocks = 0
    for name, page, *rest in decoded:
        row = {"part": name, "page": page}
        if name == "blocks":
            row |= {"idx": blocks, "text": rest[0], "bbox": _box(rest[1])}
            blocks += 1
        elif name == "pages":
            row["text"] = rest[0]
        elif name == "tables" and not rest[0]:
            continue
        else:
            n = seen[name, page] = seen.get((name, page), -1) + 1
            row |= {"name": f"p{page}_{_NAMES[name]}{n}", "bbox": _box(rest[1])}
            row |= {"format": rest[0], "content": rest[2]} if name == "images" else {"headers": rest[0][0], "rows": rest[0][1:]}
        if name in wanted:
            yield row


def _weight(row: dict) -> int:
    return 200 + sum(len(row.get(c) or "") for c in ("text", "content")) + 50 * sum(map(len, row.get("rows") or []))


def decode_documents(rows: DataFrame, decoder: Callable[[bytes], Decoded | Iterator[tuple]], parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """ITEMS of files (doc_id, path, content): a row for each page, block, image and table of the parts asked
    for. A decoder that yields one thing after another is never ahead of what has been handed on, so a
    file of thousands of pages and images takes the memory of the file and a batch. A file that fails has
    a row of part ERRORS with its error, and whatever rows came before that; part() leaves these out."""
    wanted = frozenset(parts)

    def run(batches):
        held, weight = [], 0
        for batch in batches:
            for doc_id, path, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = {"doc_id": doc_id.as_py(), "path": path.as_py()}
                found = _safe(lambda: items(decoder(content.as_py()), wanted))  # noqa: B023
                for row in found:
                    held.append(own | row)
                    weight += _weight(row)
                    if weight >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ITEMS))
    return rows.select("doc_id", "path", "content").mapInArrow(run, ITEMS)


def _safe(start: Callable[[], Iterator[dict]]) -> Iterator[dict]:
    try:
        yield from start()
    except Exception as e:
        yield {"part": ERRORS, "_corrupt": str(e) or type(e).__name__}


def write(decoded: DataFrame, path: str) -> None:
    """Items by part. Row groups are small, since a reader takes thousands of rows of one at a time, and an
    image may have megabytes."""
    decoded.write.partitionBy("part").options(**SMALL_GROUPS).parquet(path)


def part(decoded: DataFrame, name: str) -> DataFrame:
    """The pages, blocks, images or tables of decode_documents(), without those of files that failed. Of
    items that were written by part, only the files of that part and of the errors are read."""
    broken = broadcast_if_small(decoded.filter(F.col("part") == ERRORS).select("doc_id"))
    return decoded.filter(F.col("part") == name).join(broken, "doc_id", "left_anti").selectExpr(*PARTS[name])


def plain_text(content: bytes) -> Iterator[tuple[int, str]]:
    """Default decoder: UTF-8 text with form feeds between pages."""
    for i, text in enumerate(content.decode("utf-8").split("\f"), 1):
        yield i, text


def plain_document(content: bytes) -> Decoded:
    return Decoded(pages=list(plain_text(content)))


_DATA_URI = re.compile(r"data:image/([\w.+-]+);base64,(.*)", re.S)


class _WebPage(HTMLParser):
    """Text blocks, embedded images and tables of a web page; <hr class=page> begins a new page."""

    _TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre figcaption caption".split())
    _SILENT = frozenset(("script", "style", "head", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.page = Decoded(), 1
        self.run: list[str] = []
        self.cells: list[list[list[str]]] | None = None
        self.silent = 0

    def end_block(self):
        text = " ".join("".join(self.run).split())
        if text:
            self.out.blocks.append((self.page, text, None))
        self.run = []

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        self.silent += tag in self._SILENT
        if tag in self._TEXT and self.cells is None:
            self.end_block()
        elif tag == "table":
            self.end_block()
            self.cells = []
        elif tag == "tr" and self.cells is not None:
            self.cells.append([])
        elif tag in ("td", "th") and self.cells:
            self.cells[-1].append([])
        elif tag == "hr" and "page" in (have.get("class") or "").split():
            self.end_block()
            self.page += 1
        elif tag == "img" and (m := _DATA_URI.match(have.get("src") or "")):
            try:
                self.out.images.append((self.page, m[1], None, base64.b64decode(m[2], validate=True)))
            except binascii.Error:
                pass  # one broken image doesn't cost the page

    def handle_endtag(self, tag):
        self.silent -= tag in self._SILENT and self.silent > 0
        if tag in self._TEXT and self.cells is None:
            self.end_block()
        elif tag == "table" and self.cells is not None:
            rows = [[" ".join("".join(c).split()) or None for c in r] for r in self.cells if r]
            self.cells = None
            if rows:
                self.out.tables.append((self.page, rows, None))

    def handle_data(self, data):
        if self.silent:
            return
        if self.cells is None:
            self.run.append(data)
        elif self.cells and self.cells[-1]:
            self.cells[-1][-1].append(data)


def web_document(content: bytes, step: int = 1 << 16) -> Iterator[tuple]:
    """Decoder of web pages, one thing after another; a page's text is its blocks, with blank lines between them."""
    reader, text = _WebPage(), content.decode("utf-8", "replace")
    page, held = 1, []
    for at in range(0, len(text) + step, step):
        if at < len(text):
            reader.feed(text[at : at + step])
        else:
            reader.close()
            reader.end_block()
        for block in reader.out.blocks:
            for page in range(page, block[0]):  # noqa: B020
                yield "pages", page, "\n\n".join(held)
                held = []
            page = block[0]
            held.append(block[1])
            yield "blocks", *block
        yield from (("images", *x) for x in reader.out.images)
        yield from (("tables", *x) for x in reader.out.tables)
        reader.out = Decoded()
    for last in range(page, reader.page + 1):
        yield "pages", last, "\n\n".join(held)
        held = []


def errors(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("_corrupt").isNotNull()).select("path", F.col("_corrupt").alias("error"))
