"""Text as Column expressions: ids, tokens, cleaning, caps. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval leaves out, compared before case is folded.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "have", "has", "but", "not", "all", "any", "you", "use", "uses", "using", "MODULE", "EXTENDS", "VARIABLES", "VARIABLE", "CONSTANTS", "CONSTANT", "Init", "Next", "Spec", "TypeOK", "Invariant", "TLA")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used; inside another function's lambda an expression would be computed anew each time."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_id(text: Column) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(strip(text), 256)


def short_hash(text: Column, digits: int, kind: str = "sha256") -> Column:
    """The first hex digits of a digest."""
    return F.substring(F.md5(text.cast("binary")) if kind == "md5" else F.sha2(text, 256), 1, digits)


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def phrases(words: Column, n: int) -> Column:
    """Distinct runs of n words joined by spaces; none for fewer words."""
    runs = let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))
    return F.array_distinct(runs)


def search_terms(text: Column) -> Column:
    """Identifiers of two characters or more, stop words out before case is folded, repeats kept."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9_]+)"), 1)
    return F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), F.lower)


def row_terms(text: Column) -> Column:
    """Distinct parts of a ;-, comma- or space-separated row, of two characters or more, case kept."""
    return F.array_distinct(F.filter(F.split(text, r"[;, ]+"), lambda w: F.length(w) > 1))


def clean_markup(text: Column) -> Column:
    """Tags out, white space to one space, no full stops or spaces at the ends."""
    flat = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"[ \t\n\r\f]+", " ")
    return F.regexp_replace(flat, r"^[ .]+|[ .]+$", "")


def collapse_blank_lines(text: Column) -> Column:
    """Spaces before line ends out, three or more line ends to two."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def capped(text: Column, limit: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def tail(text: Column, limit: int) -> Column:
    """The last characters, with an ellipsis before them if any are left out."""
    return F.when(F.length(text) > limit, F.concat(F.lit("..."), F.right(text, F.lit(limit)))).otherwise(text)


def preview(text: Column, limit: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, limit)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    """Lines, a last line end not counted as one more; 0 for empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n")))


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def dir_titles(markdown: Column) -> Column:
    """Table rows `| [title](specifications/dir) | ...` -> array of struct(dir, title)."""
    pattern = F.lit(r"\|\s*\[([^\]]+)\]\(([^)]+)\)")
    return F.transform(F.arrays_zip(F.regexp_extract_all(markdown, pattern, 1), F.regexp_extract_all(markdown, pattern, 2)), lambda x: F.struct(F.regexp_replace(x["1"], r"^.*/", "").alias("dir"), F.trim(x["0"]).alias("title")))


def humanised(name: Column) -> Column:
    """CamelCase and snake_case as lower-cased words; runs of capitals stay together."""
    parts = F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), 1)
    return F.lower(F.array_join(parts, " "))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def config_fingerprint(*columns: str) -> Column:
    """First 8 hex digits of the MD5 of the columns as JSON, names sorted."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(columns))).cast("binary")), 1, 8)


def drop_repeated_tail(text: Column, block: int = 5) -> Column:
    """A text whose last block of lines comes twice or more in a row at its end keeps it once."""
    rows = lines(text)
    n = F.size(rows)
    last = F.array_join(F.slice(rows, F.greatest(n - block + 1, F.lit(1)), F.lit(block)), "\n")
    again = F.array_join(F.slice(rows, F.greatest(n - 2 * block + 1, F.lit(1)), F.lit(block)), "\n")
    # Blocks are taken off one after another for as many times as they can come.
    taken = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (n >= (i + 1) * block) & (F.array_join(F.slice(rows, F.greatest(n - (i + 1) * block + 1, F.lit(1)), F.lit(block)), "\n") == last), i).otherwise(k))
    return F.when((n < 2 * block) | (again != last), text).otherwise(F.array_join(F.slice(rows, F.lit(1), F.greatest(n - taken * block, F.lit(0))), "\n"))
