"""Rewriting of generated text: reasoning marks out, one module kept, symbols in ASCII. Columns only, but for nested comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Unicode operators and their ASCII forms, padded so that neighbours stay apart.
ASCII_OPERATORS = (
    ("∧", " /\\ "), ("∨", " \\/ "), ("¬", " ~"), ("⇒", " => "), ("⇔", " <=> "), ("∈", " \\in "), ("∉", " \\notin "), ("⊆", " \\subseteq "),
    ("∪", " \\union "), ("∩", " \\intersect "), ("×", " \\X "), ("∅", " {} "), ("∀", " \\A "), ("∃", " \\E "), ("≠", " # "), ("≤", " <= "),
    ("≥", " >= "), ("÷", " \\div "), ("→", " -> "), ("↦", " |-> "), ("◻", " []"), ("◇", " <>"), ("⊢", " |- "), ("·", " \\cdot "),
)
FINAL = r"(?is)^.*<\|channel\|>final<\|message\|>"
TAG = r"<\|[^|>]*\|>"
THINK = r"(?is)<think>.*?</think>"
OPEN_THINK = r"(?is)<think>.*?(?=-{4}\s*MODULE)"
FENCE = r"(?m)^\s*```[A-Za-z+]*\s*$"
HEADER = r"(?m)^-{2,}\s*MODULE\s+\w+\s*-{2,}[ \t]*$"
END_LINE = r"(?m)^[ \t]*END[ \t]*$"
TERMINATOR = "=" * 78


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def without_reasoning(text: Column) -> Column:
    """What follows the last final-channel mark, without tags, reasoning blocks and fences."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, FINAL, ""), TAG, ""), THINK, "")
    out = F.when(out.rlike("(?i)<think>") & out.rlike(r"----\s*MODULE"), F.regexp_replace(out, OPEN_THINK, "")).otherwise(out)
    return F.regexp_replace(out, FENCE, "")


def module_block(text: Column) -> Column:
    """From the first module header to its terminator, or to the end without one; null without a header."""
    whole = F.regexp_extract(text, r"(?s)(-{2,}\s*MODULE\b.*?={3,})", 1)
    rest = F.regexp_extract(text, r"(?s)(-{2,}\s*MODULE\b.*)", 1)
    return F.when(whole != "", whole).when(rest != "", F.regexp_replace(rest, r"\s+$", ""))


def ascii_operators(text: Column) -> Column:
    return reduce(lambda t, op: F.replace(t, F.lit(op[0]), F.lit(op[1])), ASCII_OPERATORS, text)


def operator_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "".join(a for a, _ in ASCII_OPERATORS), ""))


def _by_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def without_semicolons(text: Column) -> Column:
    """No ; before a line comment; lines that open a block comment stay."""

    def change(line: Column) -> Column:
        at = F.instr(line, "\\*")
        head = F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line)
        rest = F.when(at > 0, F.substring(line, at, F.length(line))).otherwise("")
        return F.when(F.contains(head, F.lit("(*")) & ~F.contains(head, F.lit("*)")), line).otherwise(F.concat(F.replace(head, F.lit(";"), F.lit("")), rest))

    return _by_line(text, change)


def without_backticks(text: Column) -> Column:
    """No backticks but in lines with a comment."""
    return _by_line(text, lambda line: F.when(F.contains(line, F.lit("\\*")) | F.contains(line, F.lit("(*")), line).otherwise(F.replace(line, F.lit("`"), F.lit(""))))


def one_header(text: Column) -> Column:
    """Module headers after the first are taken out."""
    first = F.regexp_instr(text, F.lit(HEADER))
    end = first - 1 + F.length(F.regexp_extract(text, f"({HEADER[4:]})".replace("^", "(?m)^", 1), 1))
    return F.when(first == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), end), F.regexp_replace(F.substring(text, end + 1, F.length(text)), HEADER, "")))


def terminated(text: Column) -> Column:
    return F.when(text.rlike("(?m)^={4,}"), text).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n{TERMINATOR}\n")))


def normalised(text: Column) -> Column:
    """struct(text, counts per rule, flags, clean): the whole ordered pipeline. Counts are of the text before the rule is applied."""

    def steps(raw: Column) -> Column:
        return let(without_reasoning(raw), lambda bare: let(F.struct(module_block(bare).alias("block"), F.regexp_replace(bare, r"^\s+|\s+$", "").alias("trimmed")), lambda b: from_block(raw, b["block"], b["trimmed"])))

    def from_block(raw: Column, block: Column, trimmed: Column) -> Column:
        headless = block.isNull() & trimmed.rlike(r"(?m)^VARIABLES?\b|^Init\s*==")
        spec = F.coalesce(block, F.when(headless, F.concat(F.lit("---- MODULE GeneratedSpec ----\n"), trimmed)).otherwise(trimmed))
        return let(spec, lambda spec: let(ascii_operators(spec), lambda plain: let(without_backticks(plain), lambda ticks: let(without_semicolons(ticks), lambda semis: let(F.regexp_replace(semis, END_LINE, ""), lambda ended: let(one_header(ended), lambda headers: report(raw, headless, spec, plain, ticks, semis, ended, headers)))))))

    def report(raw: Column, headless: Column, spec: Column, plain: Column, ticks: Column, semis: Column, ended: Column, headers: Column) -> Column:
        full = raw != ""
        out = F.concat(F.regexp_replace(F.regexp_replace(terminated(headers), "\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))
        counts = {
            "tags": count(F.regexp_replace(raw, FINAL, ""), TAG), "thinks": count(raw, THINK), "fences": count(raw, FENCE), "operators": operator_count(spec),
            "backticks": F.length(plain) - F.length(ticks), "semicolons": F.length(ticks) - F.length(semis), "ends": count(semis, END_LINE), "headers": F.greatest(count(ended, HEADER) - 1, F.lit(0)),
        }
        flags = {"final_taken": raw.rlike(FINAL), "header_added": headless, "terminator_added": full & ~headers.rlike("(?m)^={4,}")}
        cells = [F.when(full, c).otherwise(0).alias(k) for k, c in counts.items()] + [f.alias(k) for k, f in flags.items()]
        return let(F.struct(F.when(full, out).otherwise("").alias("text"), *cells), lambda r: F.struct(*[r[k].alias(k) for k in ("text", *counts, *flags)], reduce(lambda x, y: x & y, [r[k] == 0 for k in counts] + [~r[k] for k in flags]).alias("clean")))

    return let(F.coalesce(text, F.lit("")), steps)


#: Rules of the syntax fixer, in order: name, pattern, replacement.
FIX_RULES = (
    ("assign", r"(?m)^(\s*\w+)\s*:=\s*", "$1 == "),
    ("double_and", r"&&", "/\\\\"),
    ("double_or", r"\|\|", "\\\\/"),
    ("not_equal", r"!=", "#"),
    ("true", r"\btrue\b", "TRUE"),
    ("false", r"\bfalse\b", "FALSE"),
    ("forall", r"\\forall\b", "\\\\A"),
    ("exists", r"\\exists\b", "\\\\E"),
    ("line_comment", r"(?m)//", "\\\\*"),
    ("tab", r"\t", "    "),
    ("trailing", r"(?m)[ \t]+$", ""),
)


def fixed_syntax(text: Column) -> Column:
    """struct(text, rules): common slips of other languages' syntax put right, and the names of the rules that applied."""
    names = []
    for name, pattern, to in FIX_RULES:
        names.append(F.when(text.rlike(pattern), name))
        text = F.regexp_replace(text, pattern, to)
    return F.struct(text.alias("text"), F.array_compact(F.array(*names)).alias("rules"))


JUNCTION = r"^\s*(/\\|\\/)"
#: A line end before a line that a list doesn't go over: neither a junction nor an indented line that begins with no keyword.
LIST_END = r"\n(?![^\S\n]*(?:/\\|\\/)|[^\S\n]++(?!(?:ELSE|IN|THEN|LET|IF|CASE|OTHER)\b)\S)"


def indented_junctions(text: Column) -> Column:
    """The junctions of a list are brought to the column of its first.

    A list goes on over junctions and indented lines; an empty or any other line, or one that begins with a keyword, closes it.
    So the text is cut before such lines, and each piece has a first line, which stays, and at most one list.
    """

    def moved(lines: Column, column: Column) -> Column:
        rest = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda line: F.when(line.rlike(JUNCTION), F.concat(column, F.regexp_replace(line, r"^\s+", ""))).otherwise(line))
        return F.array_join(F.concat(F.slice(lines, 1, 1), rest), "\n")

    def aligned(piece: Column) -> Column:
        # The lines and the column are computed once a piece, not once a line.
        first = lambda lines: F.get(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda line: line.rlike(JUNCTION)), F.lit(0))
        return let(F.split(piece, "\n"), lambda lines: let(F.regexp_extract(first(lines), r"^(\s*)", 1), lambda column: moved(lines, column)))

    return F.array_join(F.transform(F.split(text, LIST_END), aligned), "\n")


def with_helpers(text: Column) -> Column:
    """Max and Min get a definition before the terminator if they are used without one."""
    for name, op in (("Max", ">="), ("Min", "<=")):
        body = f"{name}(S) == CHOOSE x \\in S : \\A y \\in S : x {op} y\n"
        missing = text.rlike(rf"\b{name}\(") & ~text.rlike(rf"(?m)^{name}\s*\(\w+\)\s*==")
        at = F.regexp_instr(text, F.lit(r"(?m)^={4,}"))
        text = F.when(missing & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(body), F.substring(text, at, F.length(text)))).when(missing, F.concat(text, F.lit("\n" + body))).otherwise(text)
    return text


def typed_variables(text: Column, kind: str = "Int") -> Column:
    """Each declared variable on a line of its own, after a type note for a symbolic checker."""
    names = F.split(F.regexp_extract(text, r"(?m)^VARIABLES?\s+([^\n]*)", 1), r"\s*,\s*")
    body = F.array_join(F.transform(names, lambda n: F.concat(F.lit(f"    \\* @type: {kind};\n    "), n)), ",\n")
    return F.when(text.rlike(r"(?m)^VARIABLES?\s+\w"), F.concat(F.regexp_extract(text, r"(?s)^(.*?)(?m:^VARIABLES?\s)", 1), F.lit("VARIABLES\n"), body, F.regexp_extract(text, r"(?s)(?m:^VARIABLES?\s[^\n]*)(.*)$", 1))).otherwise(text)
