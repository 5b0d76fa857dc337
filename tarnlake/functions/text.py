"""Text rules as Column functions; all but nfc() run in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- cleaning -------------------------------------------------------------------------------------------------------

# Rules of clean_text after NFC, in order: (pattern, replacement).
CLEANING = [
    (r"(?U)https?://[^\s]+", ""),
    (r"(?U)\d{1,2}:\d{2} [AP]M.*?Wikipedia", ""),
    (r"(?U)\[\s*\d+\s*\]", ""),
    (r"(?U)/\d{1,3},?\s*\d{1,2}:\d{2}", ""),
    (r"(?U)(\w+)-\n(\w+)", "$1$2"),
    (r"([a-z])\n([a-z])", "$1 $2"),
    (r"(?U)\s+", " "),
]


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition (NFC); there is no built-in function for it."""
    return text.str.normalize("NFC")


def composed(c: Column) -> Column:
    """NFC. ASCII text, told by its byte count, is composed already and is not sent to Python: it goes as null."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.coalesce(F.when(plain, c), nfc(F.when(~plain, c)))


def clean_text(c: Column, compose: bool = True) -> Column:
    """URLs, print marks and footnotes removed, broken words and lines joined, white space collapsed; null gives ""."""
    start = composed(c) if compose else c
    return F.trim(reduce(lambda x, rule: F.regexp_replace(x, *map(F.lit, rule)), CLEANING, F.coalesce(start, F.lit(""))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def char_count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def is_noisy(c: Column) -> Column:
    """Under ten words, many pipes for its words, or a bare mention of the encyclopedia."""
    n = word_count(c)
    return (n < 10) | (char_count(c, "|") / (n + 1) > 0.3) | (F.contains(c, F.lit("Wikipedia")) & ~F.contains(c, F.lit("://")))


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether the lower-cased text has any of the terms as a substring."""
    low = F.lower(c)
    return reduce(lambda x, t: x | F.contains(low, F.lit(t)), terms, F.lit(False))


def cut(c: Column, most: int) -> Column:
    return F.substring(F.trim(c), 1, most)


# ---- paths and files ------------------------------------------------------------------------------------------------


def bucket_of(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def object_of(path: Column) -> Column:
    return F.regexp_replace(path, "^[^/]*/?", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, before any ?query or #fragment; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^.?#/]+)(?:[?#].*)?$", 1))


# Extensions that downloads may compress, and those that never are.
COMPRESSIBLE = [".txt", ".json", ".xml", ".html", ".css", ".js", ".csv", ".md", ".log", ".py"]
COMPRESSED = [".zip", ".rar", ".gz", ".jpg", ".png", ".pdf", ".mp4", ".mp3"]


def should_compress(name: Column, size: Column) -> Column:
    last = F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))
    fits = size.between(1024, 100 * 1024 * 1024) & F.contains(name, F.lit("."))
    return fits & last.isin(COMPRESSIBLE) & ~last.isin(COMPRESSED)


def best_compression(accept: Column, preferred: str) -> Column:
    low = F.lower(accept)
    br, gzip = F.contains(low, F.lit("br")), F.contains(low, F.lit("gzip"))
    out = F.when(gzip, "gzip") if preferred == "gzip" else F.when(br, "br")
    return out.when(br, "br").when(gzip, "gzip")


# ---- structure ------------------------------------------------------------------------------------------------------

# What a text is split at, and what the tags become in Markdown.
SEPARATOR = r"\[PAGE_BREAK\]|\[HEADING\][^\[]*\[/HEADING\]"
MARKDOWN_TAGS = [("[HEADING]", "### "), ("[/HEADING]", "\n"), ("[SUBHEADING]", "#### "), ("[/SUBHEADING]", "\n")]


def strip(c: Column) -> Column:
    """White space of any kind removed from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def to_markdown_tags(c: Column) -> Column:
    return reduce(lambda x, tag: F.replace(x, *map(F.lit, tag)), MARKDOWN_TAGS, c)


def strip_heading_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\[/?HEADING\]", ""))


def blocks(c: Column) -> Column:
    """array<struct<kind, content>> of page breaks, headings and paragraphs in order; blank paragraphs are left out. A
    heading's text has no bracket within; other text that begins with a heading tag is a heading as a whole."""
    pieces = F.regexp_extract_all(c, F.lit(rf"{SEPARATOR}|(?s:.+?)(?={SEPARATOR}|\z)"), F.lit(0))
    parts = F.filter(F.transform(pieces, strip), lambda p: p != "")
    kind = lambda p: F.when(p == "[PAGE_BREAK]", "page_break").when(p.startswith("[HEADING]"), "heading").otherwise("paragraph")
    content = lambda p: F.when(kind(p) == "heading", strip_heading_tags(p)).when(kind(p) == "page_break", "").otherwise(p)
    return F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), content(p).alias("content")))


def sentences(c: Column) -> Column:
    """Sentences of more than three characters after white space is collapsed."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?…])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 3)  # F.trim itself would get the index as what to trim


def table_markdown(table: Column) -> Column:
    """A table (array of rows of cells, the first being the header) as Markdown. Rows without cells are left out; without a
    table, or a header with cells, it is an empty text; a cell that is null gives a mark instead of the table."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    some = lambda row: F.coalesce(F.size(row), F.lit(0)) > 0
    head, rows = F.get(table, 0), F.filter(table, some)
    broken = F.exists(rows, lambda row: F.exists(row, lambda x: x.isNull()))
    lines = F.concat(F.array(line(head), line(F.transform(head, lambda x: F.lit("---")))), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(~(some(table) & some(head)), "").when(broken, "[BẢNG]").otherwise(F.array_join(lines, "\n"))


def inject_tables(c: Column, tables: Column, token: str = "[TABLE]") -> Column:
    """The first token replaced by the first table's Markdown, the second by the second's; tokens left over stay."""
    parts = F.split(c, r"\[TABLE\]")
    fill = lambda i: F.when(i < F.size(tables), table_markdown(F.get(tables, i))).otherwise(F.lit(token))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, fill(i))).otherwise(p)), "")


def is_txt_heading(line: Column) -> Column:
    return ((F.length(line) < 100) & (line == F.upper(line))) | line.endswith(":")


def sections(lines: Column, is_head: Callable[[Column], Column]) -> Column:
    """array<struct<section, first, lines>>: an array of lines cut before each heading, which is the section of its own line and of those
    up to the next; null before the first. first is the number of a section's first line, from 0. Each line is copied once."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.coalesce(is_head(x), F.lit(False)), i)), lambda i: i.isNotNull())
    starts = F.when(F.coalesce(F.get(at, 0), F.lit(-1)) == 0, at).otherwise(F.concat(F.array(F.lit(0)), at))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
    first_is_head = F.get(at, 0) == 0
    section = lambda a: F.when((a > 0) | F.coalesce(first_is_head, F.lit(False)), F.get(lines, a))
    return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(section(a).alias("section"), a.alias("first"), F.slice(lines, a + 1, b - a).alias("lines"))), lambda s: F.size(s["lines"]) > 0)


def is_docx_heading(style: Column, text: Column) -> Column:
    letters = text.rlike(r"^\p{L}+$")
    return style.startswith("Heading") | (style == "Title") | ((F.length(text) < 100) & (text == F.upper(text)) & letters)


def is_pdf_heading(sizes: Column, fonts: Column) -> Column:
    """Mean font size above 14, or a font name with a capital B; no sizes, no heading."""
    mean = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)
    return (F.size(sizes) > 0) & ((mean > 14) | F.exists(fonts, lambda f: F.contains(f, F.lit("B"))))


# Words that rule a heading out, and patterns of page furniture.
HEADING_NOISE = ["là một", "được", "sinh", "mất", "năm", "với", "tại", "khi"]
NOISE_BLOCKS = [r"\[.*Đọc tiếp.*\]", r"Mới chọn:", r"Ấn phẩm:", r"Từ những bài viết mới của Wikipedia", r"Wikipedia là dự án bách khoa toàn thư mở"]


def is_valid_heading(c: Column) -> Column:
    return (F.trim(c) != "") & (F.length(c) <= 100) & ~contains_any(c, HEADING_NOISE) & (char_count(c, ",") <= 1) & (char_count(c, ".") == 0)


def is_noise_block(c: Column) -> Column:
    return c.rlike("(?iu)(" + "|".join(NOISE_BLOCKS) + ")")


# Terms that a chunk must not end within.
MEDICAL_TERMS = [
    "đái tháo đường", "bệnh tiểu đường", "tăng huyết áp", "kháng insulin", "rối loạn chuyển hóa", "hội chứng buồng trứng đa nang",
    "tăng triglyceride", "tiểu đường thai kỳ", "huyết áp tâm thu", "huyết áp tâm trương", "chỉ số khối cơ thể", "béo phì", "mỡ máu",
    "đường huyết", "insulin đề kháng", "tổn thương thần kinh", "bệnh võng mạc",
]


def cuts_phrase(before: Column, after: Column, terms: list[str] = MEDICAL_TERMS) -> Column:
    """Whether a term ends the first text in part and begins the second with its rest, cut 3 or more characters from its
    ends. Nothing is stripped: a term cut beside a space counts only if one of the texts has that space."""
    low, high = F.lower(before), F.lower(after)
    found = F.lit(False)
    for t in terms:
        for i in range(3, len(t) - 2):
            found = found | (low.endswith(t[:i]) & high.startswith(t[i:]))
    return found


# ---- dialogue text --------------------------------------------------------------------------------------------------

# Texts and words of the output guard.
GUARD_EMPTY = "Tôi chưa thể tạo câu trả lời phù hợp."
GUARD_CODE = "Hiện tôi chưa có tài liệu liên quan đến câu hỏi này.\nHãy hỏi về đường huyết, insulin, chế độ ăn để tôi hỗ trợ tốt hơn."
GUARD_ENGLISH = "Xin lỗi, tôi chỉ hỗ trợ bằng tiếng Việt."
GUARD_NOTHING = "Tôi chưa có thông tin để trả lời."
CODE_WORDS = ["import ", "def ", "class ", "from ", "os.", "dotenv"]
THINKING = ["hãy suy nghĩ", "phân tích", "let me think", "step by step"]
ENGLISH_STARTS = ["I ", "You ", "Sorry", "cannot"]


def guard_answer(c: Column) -> Column:
    """An answer fit to show: code and English answers are refused, thinking is dropped up to the next ### heading."""
    start = F.struct(F.lit(False).alias("thinking"), F.array().cast("array<string>").alias("lines"))

    def step(a, line):
        begins = contains_any(line, THINKING)
        thinking = F.when(begins, True).when(line.startswith("### "), False).otherwise(a["thinking"])
        keep = ~thinking & (F.trim(line) != "")
        return F.struct(thinking.alias("thinking"), F.when(keep, F.concat(a["lines"], F.array(line))).otherwise(a["lines"]).alias("lines"))

    text = F.trim(F.array_join(F.aggregate(F.split(c, "\n"), start, step)["lines"], "\n"))
    english = reduce(lambda x, p: x | text.startswith(p), ENGLISH_STARTS, F.lit(False))
    return (
        F.when(F.trim(F.coalesce(c, F.lit(""))) == "", GUARD_EMPTY)
        .when(contains_any(c, CODE_WORDS), GUARD_CODE)
        .when(english, GUARD_ENGLISH)
        .when(text == "", GUARD_NOTHING)
        .otherwise(text)
    )


def history_line(role: Column, *texts: Column) -> Column:
    """"Role: text" from the first text that isn't null."""
    return F.concat(F.initcap(role), F.lit(": "), F.coalesce(*texts, F.lit("")))


def role_of(c: Column) -> Column:
    return F.when(F.lower(c) == "user", "user").otherwise("ai")


@F.pandas_udf(StringType())
def format_number(value: pd.Series, digits: pd.Series) -> pd.Series:
    """As Python formats: exact binary value, ties to even; format_string() rounds half up."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(d)}f}" for v, d in zip(value, digits, strict=True)], dtype=object)
