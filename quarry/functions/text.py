"""Column functions on text: tokens, similarity, headings, guards, names, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
#: Words that don't count when images are matched by text.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would should could may might must can"
).split()
#: A query with one of these inside asks for tables.
TABLE_WORDS = "table tables data dataset results comparison performance metrics statistics".split()
#: A query with one of these is refused.
INJECTIONS = [r"ignore\s+previous", r"forget\s+everything", r"system\s*:", r"assistant\s*:", r"you\s+are\s+now", r"disregard\s+instructions"]
MAX_QUERY = 1000
MAX_FILE = 100 * 1024 * 1024
EXTENSIONS = (".pdf",)


def tokens(text: Column) -> Column:
    """Words of lower-case text: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / any_)


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_heading(line: Column) -> Column:
    """A short line in capitals, numbered, or in title case."""
    x = strip(line)
    shape = ((F.upper(x) == x) & (F.lower(x) != x)) | x.rlike(r"^\d+\.?\s+[A-Z]") | x.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$")
    return F.length(x).between(1, 99) & shape


def is_table_query(query: Column) -> Column:
    low = F.lower(query)
    out = F.lit(False)
    for word in TABLE_WORDS:
        out = out | F.contains(low, F.lit(word))
    return out


def is_injection(query: Column) -> Column:
    return F.lower(query).rlike("|".join(f"(?:{p})" for p in INJECTIONS))


def sanitize_query(query: Column) -> Column:
    """The query cut to MAX_QUERY and with single spaces; empty if it is refused."""
    cut = F.substring(query, 1, MAX_QUERY)
    clean = strip(F.regexp_replace(cut, r"\s+", " "))
    return F.when(query.isNull() | is_injection(query), F.lit("")).otherwise(clean)


def expand_query(query: Column) -> Column:
    """Place for query expansion; the identity by default."""
    return query


def _suffix(name: Column) -> Column:
    """From the last dot of the last path part, unless the part begins with it."""
    return F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1)


def validate_filename(name: Column, extensions: tuple[str, ...] | None = None) -> Column:
    """Whether a name is an allowed file name: extension, plain characters, no paths."""
    known = F.lower(_suffix(name)).isin(*(extensions or EXTENSIONS))
    return F.coalesce((name != "") & known & ~name.rlike(r"\.\./|\.\.\\") & name.rlike(r"^[a-zA-Z0-9._-]+$") & ~name.startswith("/"), F.lit(False))


def sanitize_filename(name: Column) -> Column:
    """The last path part with other characters as _, at most 100 before the lower-case suffix."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    suffix = _suffix(base)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(suffix))
    return F.concat(F.substring(F.regexp_replace(stem, r"[^a-zA-Z0-9._-]", "_"), 1, 100), F.lower(suffix))


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal place, for n of 0 or more, in whole numbers: a tie goes to the even digit, as printf has
    it and format_string has not, which rounds it up."""
    whole, rest = F.call_function("div", n, F.lit(unit)), (n % unit) * 10
    tenths, left = F.call_function("div", rest, F.lit(unit)), rest % unit
    up = (left * 2 > unit) | ((left * 2 == unit) & (tenths % 2 == 1))
    all_ = whole * 10 + tenths + up.cast("long")
    return F.concat(F.call_function("div", all_, F.lit(10)).cast("string"), F.lit("."), (all_ % 10).cast("string"))


def validate_file_size(size: Column, most: int | None = None) -> Column:
    """struct(ok, message): too large, empty, or fine with a null message; of a null size ok is null too."""
    most = most or MAX_FILE
    mb = _tenths(size.cast("long"), 1024 * 1024)
    # fixed values: the messages
    large = F.concat(F.lit("File too large: "), mb, F.lit(f" MB. Maximum: {most / 1024 / 1024:.0f} MB"))
    message = F.when(size > most, large).when(size == 0, F.lit("File is empty"))
    return F.struct(((size <= most) & (size != 0)).alias("ok"), message.alias("message"))


def is_safe_path(path: Column, base: str) -> Column:
    """Whether an absolute path without .. stays below base; a longer name beside base doesn't pass."""
    base = base.rstrip("/")
    return F.coalesce(((path == base) | path.startswith(base + "/")) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def sentences(text: Column) -> Column:
    """Parts between white space that follows . ! or ?."""
    return F.split(text, r"(?<=[.!?])\s+")


def pack(parts: Column, limit: int, joiner: str) -> Column:
    """Neighbouring parts joined while their lengths together stay within limit; joiners don't count."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (a["n"] + F.length(x) > limit)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(a["open"], joiner)))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(a["open"], F.array(x))).alias("open"),
            F.when(full, F.length(x)).otherwise(a["n"] + F.length(x)).alias("n"),
        )

    done = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], joiner)))).otherwise(a["done"])
    return F.aggregate(parts, start, step, done)


def paragraphs(text: Column, limit: int = 1000) -> Column:
    """Split before lines in title case and at blank lines; longer ones into packed sentences."""
    marked = F.split(text, r"\n(?=[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*[ \t]*(?:\n|$))")
    parts = F.flatten(F.transform(marked, lambda x: F.split(x, r"\n\s*\n")))
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > limit, pack(sentences(x), limit, " ")).otherwise(F.array(x))))
