"""Files of any format as parsed documents, and objects of a store."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.errors import InvalidArgument
from tarnlake.functions.text import COMPRESSED, COMPRESSIBLE, HEADING_NOISE, NOISE_BLOCKS, clean_text, extension, is_txt_heading

#: What a parser gives: text with marks, metadata, and tables (rows of cells).
PARSED = "path string, content string, metadata map<string,string>, file_type string, tables array<array<array<string>>>, error string"
Parser = Callable[[bytes, str], tuple[str, list]]


def parse_txt(data: bytes, path: str) -> tuple[str, list]:
    try:
        return data.decode("utf-8"), []
    except UnicodeDecodeError:
        return data.decode("latin-1"), []


def pdf_lines(elements: Iterable[tuple[str, list[float], list[str]]]) -> list[str]:
    """Lines of layout elements (text, font sizes and font names of its characters): furniture goes, headings are marked.
    The rules of is_noise_block, is_pdf_heading and is_valid_heading."""
    lines = []
    for text, sizes, fonts in elements:
        text = text.strip()
        if not text or re.search("|".join(NOISE_BLOCKS), " ".join(text.split()), re.I):
            continue
        large = bool(sizes) and (sum(sizes) / len(sizes) > 14 or any("B" in f for f in fonts))
        valid = len(text) <= 100 and not any(w in text.lower() for w in HEADING_NOISE) and text.count(",") <= 1 and "." not in text
        lines.append(f"[HEADING]{text}[/HEADING]" if large and valid else text)
    return lines


def _layout(data: bytes) -> Iterator[tuple[str, list[float], list[str]]]:
    from pdfminer.high_level import extract_pages  # pdfplumber is built on it
    from pdfminer.layout import LAParams, LTChar, LTTextContainer

    params = LAParams(line_overlap=0.5, char_margin=2.0, line_margin=0.5, word_margin=0.1, boxes_flow=0.5, detect_vertical=True, all_texts=False)
    for page in extract_pages(io.BytesIO(data), laparams=params):
        for e in page:
            if isinstance(e, LTTextContainer):
                chars = [c for line in e for c in (line if hasattr(line, "__iter__") else [line]) if isinstance(c, LTChar)]
                yield e.get_text(), [c.size for c in chars if c.size], [c.fontname for c in chars if c.fontname]


def parse_pdf(data: bytes, path: str) -> tuple[str, list]:
    """Tables, each with a [TABLE] mark, then the pages' layout text with headings marked; needs pdfplumber."""
    import pdfplumber  # an optional library

    tables = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for page in pdf.pages:
            tables += [[[c or "" for c in row] for row in t] for t in page.extract_tables()]
    return "\n".join(["[TABLE]"] * len(tables) + pdf_lines(_layout(data))), tables


def parse_docx(data: bytes, path: str) -> tuple[str, list]:
    """Tables, then paragraphs with headings marked; needs python-docx."""
    import docx  # an optional library

    document = docx.Document(io.BytesIO(data))
    tables = [[[c.text for c in row.cells] for row in t.rows] for t in document.tables]
    lines = ["[TABLE]"] * len(tables)
    for p in document.paragraphs:
        text, style = p.text.strip(), p.style.name if p.style else ""
        if text:
            heading = style.startswith("Heading") or style == "Title" or (len(text) < 100 and text.isupper() and text.isalpha())
            lines.append(f"[HEADING]{text}[/HEADING]" if heading else text)
    return "\n".join(lines), tables


def parse_html(data: bytes, path: str) -> tuple[str, list]:
    text = data.decode("utf-8", errors="replace")
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
    return re.sub(r"(?s)<[^>]+>", " ", text), []


PARSERS: dict[str, Parser] = {".txt": parse_txt, ".md": parse_txt, ".pdf": parse_pdf, ".docx": parse_docx, ".html": parse_html}


def register_parser(suffix: str, parser: Parser) -> None:
    if not suffix.startswith("."):
        raise InvalidArgument("BAD_SUFFIX", suffix)
    PARSERS[suffix.lower()] = parser


def supported_extensions() -> list[str]:
    return sorted(PARSERS)


def parser_for(path: str) -> Parser:
    name = re.split(r"[?#]", path)[0]
    suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    if suffix not in PARSERS:
        raise InvalidArgument("UNSUPPORTED_FORMAT", path)
    return PARSERS[suffix]


def objects(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """path, modificationTime, length (and content) of every file below the path; without content no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df if content else df.drop("content")


def parse_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `objects` parsed by suffix, with the columns in `keep`; what can't be parsed gets an error instead of text."""
    parsers = dict(PARSERS)
    kept = [f"{c} {files.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                name = re.split(r"[?#]", path)[0]
                suffix = "." + name.rsplit(".", 1)[1].lower() if "." in name.rsplit("/", 1)[-1] else ""
                try:
                    if suffix not in parsers:
                        raise InvalidArgument("UNSUPPORTED_FORMAT", path)
                    text, tables = parsers[suffix](bytes(data), path)
                    rows.append((path, text, {"size": str(len(data))}, suffix, tables, None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((path, None, {}, suffix, [], f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "content", "metadata", "file_type", "tables", "error"])
            yield out.assign(**{c: batch[c].to_numpy() for c in keep})

    return files.select("path", "content", *keep).mapInPandas(run, ", ".join([PARSED, *kept]))


def marked_lines(text: Column, per_line: bool = False) -> Column:
    """Cleaned text with heading lines marked. The reference rule cleans first, which leaves one line; per_line cleans each line."""
    if per_line:
        lines = F.transform(F.split(text, "\n"), lambda x: clean_text(x, compose=False))
    else:
        lines = F.array(clean_text(text, compose=False))
    kept = F.filter(lines, lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.when(is_txt_heading(x), F.concat(F.lit("[HEADING]"), x, F.lit("[/HEADING]"))).otherwise(x)), "\n")


def with_format(df: DataFrame, path: str = "path") -> DataFrame:
    """extension of each path, and whether a parser is known for it."""
    e = extension(F.col(path))
    return df.withColumn("extension", e).withColumn("supported", e.isin(supported_extensions()))


class Bucket:
    """Put, get and delete of objects below a root of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def ensure(self) -> None:
        fs, path = self._fs()
        fs.mkdirs(path)

    def put(self, name: str, data: bytes) -> None:
        fs, path = self._fs(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, name: str) -> bytes:
        fs, path = self._fs(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def chunks(self, name: str, size: int = 64 * 1024, start: int = 0, length: int | None = None):
        """The bytes from `start` on (`length` of them, or all), `size` at a time: never more of an object is held."""
        fs, path = self._fs(name)
        left = max(0, fs.getFileStatus(path).getLen() - start)
        left = left if length is None else min(left, length)
        stream = fs.open(path)
        try:
            stream.seek(min(start, fs.getFileStatus(path).getLen()))
            while left > 0:
                part = bytes(stream.readNBytes(min(size, left)))
                if not part:
                    break
                left -= len(part)
                yield part
        finally:
            stream.close()

    def download(self, name: str, accept: str = "", size: int = 64 * 1024) -> dict:
        """stat() with encoding (gzip, br or None) and the stream of chunks, compressed on the way if the reader accepts it
        and the file is of a kind and size that gains by it; br where the brotli library is installed."""
        out = self.stat(name)
        suffix = "." + name.rsplit(".", 1)[-1].lower()
        gains = "." in name and suffix in COMPRESSIBLE and suffix not in COMPRESSED and 1024 <= out["size"] <= 100 * 1024 * 1024
        low, encoder = accept.lower(), None
        if gains and "br" in low:
            try:
                import brotli  # an optional library

                work = brotli.Compressor()
                encoder = ("br", work.process, work.finish)
            except ImportError:
                pass
        if gains and encoder is None and "gzip" in low:
            work = zlib.compressobj(6, zlib.DEFLATED, 31)
            encoder = ("gzip", work.compress, work.flush)

        def encoded():
            for part in self.chunks(name, size):
                if piece := encoder[1](part):
                    yield piece
            yield encoder[2]()

        return out | {"encoding": encoder[0] if encoder else None, "stream": encoded() if encoder else self.chunks(name, size)}

    def delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, False)

    def stat(self, name: str) -> dict:
        """Size, base name and content type, as a download's head has them."""
        import mimetypes

        fs, path = self._fs(name)
        size = fs.getFileStatus(path).getLen()
        return {"size": size, "name": path.getName(), "content_type": mimetypes.guess_type(name)[0] or "application/octet-stream"}
