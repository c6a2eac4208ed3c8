"""Ordered rules that make a generated module readable for a parser, on the engine of `fixer`: comments and strings stay as they are.

Narrower than the plain rules where these would break valid text: branches of algorithm statements are known by their lower
case, `[a, b]` is a range only where nothing is applied to it, `==` behind LET stays. The
order of added variables is that of their code points. Case rules are those of `fixer`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixer
from .fixer import Change, _by_line, _plain, replaced_first
from .rewrite import with_helpers
from .text import let

#: Primed or bound words that aren't variables.
NOT_VARIABLES = ("TRUE", "FALSE", "BOOLEAN", "Nat", "Int", "STRING", "SUBSET", "UNION", "DOMAIN", "ENABLED", "UNCHANGED", "EXCEPT", "IF", "THEN", "ELSE", "LET", "IN", "CASE", "OTHER", "CHOOSE", "WITH")
STATEMENTS = r"begin|end\s+(?:algorithm|define|process|while|if|do|macro|procedure)|macro|procedure|process|do|await|goto|call|return|with\b[^=\n]*\bdo"
MARK = f"(?:{fixer.MARK})?"


def one_declaration(text: Column, errors: Column) -> Column:
    """Declarations of variables behind the first go."""

    def kept(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda line: line.rlike(r"^VARIABLES?\s+\w")), F.lit(True))
        return let(first, lambda first: F.array_join(F.filter(lines, lambda line, i: ~line.rlike(r"^VARIABLES?\s+\w") | (i < first)), "\n"))

    return let(F.split(text, "\n"), kept)


def integers_extended(text: Column, errors: Column) -> Column:
    needed = text.rlike(r"\bInt\b|\\div\b|[{,|>\s=]\s*-\d|\.\.\s*-\d") & ~text.rlike(r"EXTENDS\s+[^\n]*Integers")
    return F.when(needed, replaced_first(text, r"EXTENDS\s+[\w, \t]*\w", lambda m: F.concat(m, F.lit(", Integers")))).otherwise(text)


def ranges(text: Column, errors: Column) -> Column:
    return F.when(text.rlike(r"Range\s*\("), text).otherwise(F.regexp_replace(text, r"\bRANGE\s+(\w+)", r"{($1)[x] : x \\in DOMAIN $1}"))


def on_one_line(word: str) -> Change:
    """A block of indented names under the word becomes one line of them, without sets and comments; it ends at a definition."""

    def names(block: Column) -> Column:
        lines = F.filter(F.split(F.regexp_replace(block, r"(?s)^\w+[ \t]*\n", ""), "\n"), lambda line: line.rlike(r"^\s*\w"))
        each = F.flatten(F.transform(lines, lambda line: F.split(F.regexp_replace(F.regexp_replace(line, fixer.MARK, ""), r"\s*\\in\b.*$", ""), ",")))
        found = F.filter(F.transform(each, lambda n: F.trim(n)), lambda n: n.rlike(r"^\w+$"))
        return let(found, lambda found: F.when(F.size(found) == 0, block).otherwise(F.concat(F.regexp_extract(block, r"^\w+", 0), F.lit(" "), F.array_join(found, ", "), F.lit("\n"))))

    return lambda text, errors: replaced_first(text, rf"(?m)^{word}S?[ \t]*\n(?:[ \t]+(?!\w+\s*==)[^\n]+\n)++", names)


def variables_declared(text: Column, errors: Column) -> Column:
    """Primed names, and names that Init binds, are declared: behind the first declaration's names, or on a new line."""
    init = F.regexp_extract(text, r"(?sm)^Init\s*==\s*(.*?)(?=^\w+(?:\([^)\n]*\))?\s*==|\z)", 1)
    used = F.array_union(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)'"), 1), F.regexp_extract_all(init, F.lit(r"/\\\s*([A-Za-z_]\w*)\s*(?:=|\\in)\s*"), 1))
    line = r"(?m)^VARIABLES?[ \t]+\w[\w, \t]*"
    declared = F.transform(F.split(F.regexp_replace(F.regexp_extract(text, line, 0), r"^VARIABLES?\s+", ""), ","), lambda n: F.trim(n))
    missing = F.array_sort(F.array_except(F.array_except(used, declared), F.array(*map(F.lit, NOT_VARIABLES))))

    def added(missing: Column) -> Column:
        names = F.array_join(missing, ", ")
        behind = next_line(text, names)
        known = replaced_first(text, line, lambda m: F.concat(F.regexp_replace(m, r"[,\s]+$", ""), F.lit(", "), names))
        return F.when(F.size(missing) == 0, text).when(text.rlike(line), known).otherwise(behind)

    def next_line(text: Column, names: Column) -> Column:
        out = text
        for pattern in (r"(?md)^----\s*MODULE[^\n]*$", r"(?md)^EXTENDS\s[^\n]*$", r"(?md)^CONSTANTS?\s[^\n]*$"):
            out = F.when(text.rlike(pattern), replaced_first(text, pattern, lambda m: F.concat(m, F.lit("\nVARIABLES "), names, F.lit("\n")))).otherwise(out)
        return out

    return let(missing, added)


def nested_quantifiers(text: Column, errors: Column) -> Column:
    """`\\E x \\in S, y \\in T :` becomes one quantifier for each name, as a later set may name an earlier one."""
    bound = r"^\\[EA]\s+(?:\w+\s*\\in\s*[^:,]+,\s*)+\w+\s*\\in\s*[^:]+:"

    def spread(piece: Column) -> Column:
        head = F.regexp_extract(piece, bound, 0)
        each = F.regexp_replace(head, F.lit(r",\s*(?=\w+\s*\\in\b)"), F.concat(F.lit(" : \\\\"), F.substring(piece, 2, 1), F.lit(" ")))
        return F.when(head == "", piece).otherwise(F.concat(each, F.substring(piece, F.length(head) + 1, F.length(piece))))

    return F.array_join(F.transform(F.split(text, r"(?=\\[EA]\s)"), spread), "")


def bare_initials(text: Column, errors: Column) -> Column:
    """Variables without the values that they are declared with."""

    def names(line: Column) -> Column:
        each = F.transform(F.split(F.regexp_replace(line, r"^VARIABLES?\s+", ""), ","), lambda p: F.regexp_extract(p, r"^\s*(\w+)", 1))
        return F.concat(F.regexp_extract(line, "^VARIABLES?", 0), F.lit(" "), F.array_join(F.filter(each, lambda n: n != ""), ", "))

    return _by_line(text, lambda line: F.when(line.rlike(r"^VARIABLES?\s+[^=]+=[^=]"), names(line)).otherwise(line))


def module_only(text: Column, errors: Column) -> Column:
    """From the first header to its terminator; without a terminator, up to the last line that begins a definition or ends a tuple."""
    last = F.regexp_extract(text, r"(?s)^(.*(?<![^\n])[ \t]*(?:\w+[ \t]*==[^\n]*|[^\n]*>>[ \t]*))(?:\n.*)?$", 1)
    closed = F.when(F.contains(text, F.lit("====")), text).otherwise(F.concat(F.when(last == "", text).otherwise(last), F.lit("\n\n====")))
    found = F.regexp_extract(closed, r"(?s)----\s*MODULE\b.*?====", 0)
    return F.when(found == "", closed).otherwise(found)


WHOLE_RULES: tuple[tuple[str | None, Change], ...] = (
    ("algorithm_block", _plain(rf"(?is)\(\*\s*{fixer.ALGORITHM}.*?end\s+algorithm\s*;?\s*\*\)", "")),
    ("spec_block", _plain(r"(?is)\(\*\s*--spec\b.*?end\s+spec\s*;?\s*\*\)", "")),
    ("algorithm_note", _plain(r"(?i)\(\*\s*--(?:(?:fair\s+)?algorithm|spec|operator)\b[^)]*\*\)", "")),
    ("fences", _plain(r"(?md)^```\w*\s*$", "")),
    ("open_comment", _plain(r"(?s)\(\*(?!.*\*\))([^\n]*)", "(*$1 *)")),
)
CODE_RULES: tuple[tuple[str | None, Change], ...] = (
    ("one_declaration", one_declaration),
    ("define_block", _plain(r"(?imsd)^define\b.*?^end\s+define\b[^\n]*", "")),
    ("statements", _plain(rf"(?md)^\s*(?:{STATEMENTS})\b.*$", "")),
    ("local_variables", _plain(r"(?m)^variables[ \t]*\n(?:[ \t]+\w+[^\n]*\n)++", "")),
    ("assignments", _plain(r"(?md)^[ \t]+\w[^\n]*:=[^\n]*$", "")),
    ("branches", _plain(r"(?md)^[ \t]*(?:while\b.*\bdo|if\b.*\bthen|(?:else|elsif)\b.*|end\s*;|skip\s*;?|print\b.*;)[ \t]*$", "")),
    ("integers", integers_extended),
    ("division", _plain(r"(?<=[)\w]) / (?=[(\w])", r" \\div ")),
    ("range_of", ranges),
    ("constant_set", _plain(r"(?m)^(CONSTANTS?\s+\w+)\s*\\in\b[^\n]*$", "$1")),
    ("constants_then_variables", _plain(r"(?md)^(CONSTANTS?[ \t]+[^\n]*?),[ \t]*VARIABLES?[ \t]*,?[ \t]*([^\n]+)$", "$1\nVARIABLES $2")),
    ("constants_on_one_line", on_one_line("CONSTANT")),
    ("variables_on_one_line", on_one_line("VARIABLE")),
    ("initial_values", bare_initials),
    ("variable_set", _plain(r"(?m)^(VARIABLES?\s+\w+)\s*\\in\s*\[[^\]]*\]\s*$", "$1")),
    ("variables_declared", variables_declared),
    ("not_equal", _plain(r"\\neq\b", "#")),
    ("double_backslash", _plain(r"\\\\(notin|in|cup|cap|subseteq)\b", r"\\$1")),
    ("empty_call", _plain(r"\b([A-Z]\w+)\(\)", "$1")),
    ("modulo", _plain(r"\b(?:bmod|Mod)\b|\\%", "%")),
    ("prime_before_index", _plain(r"(\b\w+)(\[[^\]]+\])'", "$1'$2")),
    ("quantified_subset", _plain(r"(\\[EA])\s+(\w+)\s*\\subseteq\s+", r"$1 $2 \\in SUBSET ")),
    ("nested_quantifiers", nested_quantifiers),
    ("function_arrow", _plain(r"\[(\w+)\s*\\in\s*([^\]]*?)\s*:\s*(?!:)", r"[$1 \\in $2 |-> ")),
    ("equality_in_junction", _plain(r"(?md)^(\s*(?:/\\|\\/)\s+(?!LET\b)\w+[^\n]*?)==", "$1=")),
    ("sequence_of_one", _plain(r"\bSeq\(([^,)]+),[^)]+\)", "Seq($1)")),
    ("sequence_brackets", _plain(r"\bSeq\[([^\]]+)\]", "Seq($1)")),
    ("range_brackets", _plain(r"(?<![\w'\]!)])\[(-?\w+),\s*(-?\w+)\]", "$1..$2")),
    ("subset", _plain(r"\\subset\b", r"\\subseteq")),
    ("sum", _plain(r"\\sum\b", "Sum")),
    ("max_min", lambda text, errors: F.regexp_replace(F.regexp_replace(text, r"\\max\b", "Max"), r"\\min\b", "Min")),
    ("any", _plain(r"\bAny\b", "STRING")),
    ("endif", _plain(r"(?md)^\s*ENDIF\s*$", "")),
    ("let_definition", _plain(r"\bLET\s+(\w+)\s*=\s*(?!=)", "LET $1 == ")),
    ("open_quantifier", _plain(r"(?md)(\\[EA]\s+\w+\s*\\in\s*\w+)[ \t]*$", "$1 :")),
    ("double_junction", _plain(rf"/\\\s*{MARK}\s+/\\", r"/\\")),
    ("select", _plain(r"\b(?:Filter|Select)\(", "SelectSeq(")),
    ("select_lambda", _plain(r"(SelectSeq\([^,\n]+,\s*)(\w+)'?\s*\|->\s*", "$1LAMBDA $2 : ")),
    ("helpers", lambda text, errors: with_helpers(text)),
    ("module_only", module_only),
    ("blank_lines", _plain(r"\n[ \t]+(?=\n)", "\n")),
)


def with_sanitised(df: DataFrame, text: Column, name: str = "sanitised") -> DataFrame:
    """df with a column struct(text, rules): the sanitised module and the names of the rules that changed it, in order."""
    return fixer.with_rules(df, text, WHOLE_RULES, CODE_RULES, None, name)
