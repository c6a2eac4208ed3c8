"""Ordered rules that put right the common slips of generated modules, as Column expressions.

The state (text, names of the rules that changed it) is folded over the rules; each rule is a Column of the text before it,
bound once, so the expressions grow with the number of rules only. Rules about algorithm blocks, fences and quotes see the
whole text. Before all others, comments and strings are taken out and marks are left in their places, so no other rule
rewrites what stands in them; at the end the marks that are left are filled again.

Case rules: null is as empty; an empty text becomes a terminator only. Block comments end at the first closing mark. The two
characters used as marks (Unicode noncharacters) are taken out of the text. A rule is named once, however often it applies.
Where the plain rule would turn the meaning round, a narrower one is used: a non-membership keeps its own operand only, and
is left alone where the operand isn't a name, a call or a set; `!` is added only before `[..] =`; a translation keeps what
stood before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewrite import indented_junctions
from .text import let

Change = Callable[[Column, Column], Column]

#: Modules that a parser knows, words that begin a configuration line, operators written with one backslash.
KNOWN_MODULES = ("Naturals", "Integers", "Reals", "Sequences", "FiniteSets", "TLC", "Bags", "RealTime", "Toolbox", "TLAPS", "Apalache")
CONFIG_WORDS = ("SPECIFICATION", "INVARIANT", "INVARIANTS", "PROPERTY", "PROPERTIES", "CONSTANTS", "CONSTANT", "CONSTRAINT", "SYMMETRY", "VIEW")
OPERATORS = ("in", "cup", "cap", "subseteq", "union", "notin", "times", "leq", "geq", "div", "o", "circ", "land", "lor", "lnot", "equiv", "neg", "A", "E")
SUM_DEFINITION = r"""
SUM(S) == LET __SumHelper[ss \in SUBSET S] ==
            IF ss = {} THEN 0
            ELSE LET x == CHOOSE x \in ss : TRUE
                 IN x + __SumHelper[ss \ {x}]
          IN __SumHelper[S]
"""

LINE_MARK, SPAN_MARK, MARK_END = "\ufdd0", "\ufdd1", "\ufdd2"
MARK = f"[{LINE_MARK}{SPAN_MARK}][0-9]+{MARK_END}"
PROTECTED = r'(?s)\\\*[^\n]*+|\(\*.*?\*\)|"[^"\n]*+"'
ALGORITHM = r"--(?:fair\s+)?algorithm\b"
DECLARED = r"(?s)VARIABLES?\s+.+?(?=\n\n|\n[A-Z])"
TERMINATOR = "===="
#: Rules of a projection.
GROUP = 5


def masked(text: Column) -> Column:
    """struct(code, kept): comments and strings in an array, and the text with their numbered marks."""
    code = F.translate(text, LINE_MARK + SPAN_MARK + MARK_END, "")

    def marks(code: Column, kept: Column) -> Column:
        def mark(piece: Column, i: Column) -> Column:
            sign = F.when(F.startswith(F.get(kept, i), F.lit("\\*")), LINE_MARK).otherwise(SPAN_MARK)
            return F.when(i < F.size(kept), F.concat(piece, sign, i.cast("string"), F.lit(MARK_END))).otherwise(piece)

        return F.struct(F.array_join(F.transform(F.split(code, PROTECTED), mark), "").alias("code"), kept.alias("kept"))

    return let(code, lambda code: let(F.regexp_extract_all(code, F.lit(PROTECTED), 0), lambda kept: marks(code, kept)))


def unmasked(code: Column, kept: Column) -> Column:
    def filled(piece: Column, i: Column) -> Column:
        number = F.substring_index(piece, MARK_END, 1)
        return F.when(i == 0, piece).otherwise(F.concat(F.get(kept, number.cast("int")), F.substring(piece, F.length(number) + 2, F.length(piece))))

    return F.array_join(F.transform(F.split(code, f"[{LINE_MARK}{SPAN_MARK}]"), filled), "")


def before(text: Column, pattern: str) -> Column:
    """What stands before the first match; null without one. Lengths are of code points, as substring counts them."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, rf"\A([\s\S]*?)(?:{pattern})", 1))


def replaced_first(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The first match replaced by a Column of it; the text itself where there is none."""

    def put(head: Column) -> Column:
        found = F.regexp_extract(text, pattern, 0)
        return F.when(head.isNull(), text).otherwise(let(found, lambda m: F.concat(head, change(m), F.substring(text, F.length(head) + F.length(m) + 1, F.length(text)))))

    return let(before(text, pattern), put)


def _plain(pattern: str, to: str) -> Change:
    return lambda text, errors: F.regexp_replace(text, pattern, to)


def _by_line(text: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def _rtrim(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def terminated(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(TERMINATOR)), text).otherwise(F.concat(_rtrim(text), F.lit(f"\n\n{TERMINATOR}")))


def cut_from(pattern: str) -> Change:
    """What stands before the pattern, terminated."""
    return lambda text, errors: let(before(text, pattern), lambda head: F.when(head.isNull(), text).otherwise(terminated(_rtrim(head))))


def translation_kept(text: Column, errors: Column) -> Column:
    """Header, translation and footer of a translated algorithm, without the translator's marks."""
    at = r"(?sd)^(.*?)(?:\\\*)?[ \t]*BEGIN TRANSLATION[^\n]*\n(.*?)(?:\\\*)?[ \t]*END TRANSLATION[^\n]*(.*)$"
    parts = [F.regexp_replace(F.regexp_extract(text, at, i), r"^\s+|\s+$", "") for i in (1, 2, 3)]
    return F.when(text.rlike(at), F.array_join(F.array(*parts[:2], F.when(parts[2] == "", F.lit(TERMINATOR)).otherwise(parts[2])), "\n\n")).otherwise(text)


def commas_in_variables(text: Column, errors: Column) -> Column:
    """Names on lines of their own under VARIABLES get a comma between them, before a comment."""
    name = rf"[ \t]+\w+[ \t]*,?[ \t]*(?:{MARK})?[ \t]*"
    return replaced_first(text, rf"VARIABLES?[ \t]*\n(?:{name}(?:\n|\z))++", lambda block: F.regexp_replace(block, rf"(?<=\n)([ \t]+\w+)([ \t]*(?:{MARK})?[ \t]*\n)(?=[ \t]+\w)", "$1,$2"))


def bare_constants(text: Column, errors: Column) -> Column:
    """CONSTANTS without the sets that they are taken from."""

    def names(block: Column) -> Column:
        word = F.regexp_extract(block, "^CONSTANTS?", 0)
        each = F.transform(F.split(F.regexp_replace(block, r"^CONSTANTS?\s+", ""), r",\s*(?=\w)"), lambda p: F.regexp_extract(p, r"^\s*(\w+)", 1))
        return F.when(block.rlike(r"\\in\b|\\setminus|\\subseteq|\\cup|\\cap"), F.concat(word, F.lit(" "), F.array_join(F.filter(each, lambda n: n != ""), ", "))).otherwise(block)

    return replaced_first(text, r"(?sm)^CONSTANTS?\s+.+?(?=\n\n|\n[A-Z])", names)


def variables(text: Column) -> Column:
    """Names of the first declaration."""
    block = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, DECLARED, 0), r"^VARIABLES?\s+", ""), MARK, "")
    return F.filter(F.transform(F.split(block, "[,\n]"), lambda n: F.trim(n)), lambda n: n.rlike(r"^\w+$"))


def constant_assumptions(text: Column, errors: Column) -> Column:
    """Assumptions that name a variable are emptied; all of one line if the checker found a wrong level."""
    level = F.contains(F.lower(errors), F.lit("level error")) | F.contains(errors, F.lit("otin"))

    def kept(names: Column) -> Column:
        named = lambda line: F.exists(names, lambda n: F.regexp_like(line, F.concat(F.lit(r"\b"), n, F.lit(r"\b"))))
        return _by_line(text, lambda line: F.when(line.rlike(r"^\s*ASSUME\b") & (level | named(line)), "").otherwise(line))

    return let(variables(text), kept)


def no_assumptions(text: Column, errors: Column) -> Column:
    """Assumptions over several lines go if the checker complains of them."""
    told = F.contains(errors, F.lit("otin")) | F.contains(errors, F.lit("ASSUME"))
    return F.when(told, F.regexp_replace(text, r"(?md)^[ \t]*ASSUME[ \t]*\n(?:[ \t]+[^\n]*+\n)*+", "\n")).otherwise(text)


def dashes(text: Column, errors: Column) -> Column:
    short = r"^(-{1,3}\s*MODULE\s+\w+\s*-|-+\s*MODULE\s+\w+\s*-{1,3}(?!-))"
    return replaced_first(text, r"(?m)^-+\s*MODULE\s+\w+\s*-+", lambda m: F.when(m.rlike(short), F.concat(F.lit("---- MODULE "), F.regexp_extract(m, r"MODULE\s+(\w+)", 1), F.lit(" ----"))).otherwise(m))


def tail_of_configuration(text: Column, errors: Column) -> Column:
    """Behind the terminator only empty lines, line comments and configuration lines stay."""
    module = F.regexp_extract(text, r"(?s)^(.*?----\s*MODULE\b.*?====)", 1)

    def kept(module: Column) -> Column:
        rest = F.split(F.substring(text, F.length(module) + 1, F.length(text)), "\n")
        lines = F.filter(rest, lambda line: line.rlike(rf"^\s*(?:$|{LINE_MARK}|(?i:{'|'.join(CONFIG_WORDS)}))"))
        # What the module's last line has behind the terminator goes, its line end stays.
        return F.concat(module, F.when(F.size(rest) > 1, F.lit("\n")).otherwise(""), F.array_join(F.filter(lines, lambda line, i: (i > 0) | (line != "")), "\n"))

    return let(module, lambda module: F.when(module == "", text).otherwise(kept(module)))


def aligned(text: Column, errors: Column) -> Column:
    told = F.lower(errors).rlike("not properly indented|alignment")
    return F.when(told, indented_junctions(text)).otherwise(text)


EXTENDS = r"(?md)^EXTENDS\s+[^\n]+$"


def _modules(line: Column, known: bool) -> Column:
    names = F.transform(F.split(F.regexp_replace(F.regexp_replace(line, r"^EXTENDS\s+", ""), MARK, ""), ","), lambda n: F.trim(n))
    return F.filter(names, lambda n: n.isin(*KNOWN_MODULES)) if known else names


def known_extends(text: Column, errors: Column) -> Column:
    def change(line: Column) -> Column:
        return let(_modules(line, True), lambda known: F.when((F.size(known) > 0) & (F.size(known) < F.size(_modules(line, False))), F.concat(F.lit("EXTENDS "), F.array_join(known, ", "))).otherwise(line))

    return replaced_first(text, EXTENDS, change)


def no_unknown_extends(text: Column, errors: Column) -> Column:
    return replaced_first(text, EXTENDS, lambda line: F.when(F.size(_modules(line, True)) == 0, "").otherwise(line))


def _tuple(text: Column) -> Column:
    return F.concat(F.lit("<<"), F.array_join(variables(text), ", "), F.lit(">>"))


def _undefined_vars(text: Column) -> Column:
    return ~text.rlike(r"(?m)^\s*vars\s*==") & (F.size(variables(text)) > 0)


def vars_defined(text: Column, errors: Column) -> Column:
    """A tuple of all variables before the first empty line behind their declaration."""
    missing = text.rlike(r"\bvars\b") & _undefined_vars(text)
    return F.when(missing, let(_tuple(text), lambda names: replaced_first(text, DECLARED + r"(?:.*?(?=\n\n))?", lambda block: F.concat(block, F.lit("\n\nvars == "), names, F.lit("\n"))))).otherwise(text)


def vars_inlined(text: Column, errors: Column) -> Column:
    missing = text.rlike(r"[WS]F_vars\b") & _undefined_vars(text)
    return F.when(missing, F.regexp_replace(text, F.lit(r"([WS]F_)vars\b"), F.concat(F.lit("$1"), _tuple(text)))).otherwise(text)


def no_bare_memberships(text: Column, errors: Column) -> Column:
    """Lines `x \\in S` before the first definition go."""
    bare = r"^\s*\w[\w\[\]]*(?:\[[\w, ]+\])?\s*\\in\s+\S"

    def kept(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda line: line.rlike(r"^\s*\w+\s*==")), F.lit(True))
        return let(first, lambda first: F.array_join(F.filter(lines, lambda line, i: ~line.rlike(bare) | ((first > 0) & (i >= first - 1))), "\n"))

    return let(F.split(text, "\n"), kept)


def sum_defined(text: Column, errors: Column) -> Column:
    missing = text.rlike(r"\bSUM\b") & ~text.rlike(r"(?m)^\s*SUM\s*(?:\([^)\n]*\))?\s*==")
    return F.when(missing, replaced_first(text, EXTENDS, lambda line: F.concat(line, F.lit(SUM_DEFINITION)))).otherwise(text)


#: Rules of the whole text, in order: the name that is reported (None: not reported), the change. The second and third wait for the first not to apply.
BLOCK = "removed PlusCal block"
WHOLE_RULES: tuple[tuple[str | None, Change], ...] = (
    (BLOCK, _plain(rf"(?is)\(\*\s*{ALGORITHM}.*?end\s+algorithm\s*;?\s*\*\)", "")),
    ("removed incomplete PlusCal block", cut_from(rf"(?i)\(\*\s*{ALGORITHM}")),
    ("removed bare PlusCal algorithm block", cut_from(rf"(?im)^{ALGORITHM}")),
    ("extracted TLA+ translation from PlusCal", translation_kept),
    ("removed PlusCal keywords", _plain(r"(?imd)^\s*(?:begin|end\s+algorithm|macro|procedure)\b.*$", "")),
    ("removed markdown fences", _plain(r"(?md)^```\w*\s*$", "")),
    ("unescaped quotes", lambda text, errors: F.replace(text, F.lit('\\"'), F.lit('"'))),
)
#: Rules of what is neither comment nor string, in order.
CODE_RULES: tuple[tuple[str | None, Change], ...] = (
    ("added commas to VARIABLES declaration", commas_in_variables),
    ("stripped inline constraints from CONSTANTS", bare_constants),
    ("fixed double-prime to single-prime", _plain(r"(\w)''", "$1'")),
    ("fixed vars set to tuple", lambda text, errors: replaced_first(text, r"\bvars\s*==\s*\{[^}]+\}", lambda m: F.regexp_replace(m, r"\{([^}]+)\}", "<<$1>>"))),
    ("wrapped UNCHANGED multi-variable in tuple", _plain(r"UNCHANGED\s+(\w+(?:\s*,\s*\w+)+)", "UNCHANGED <<$1>>")),
    ("removed CONSTANT value assignment", _plain(r"(?m)^(\s*CONSTANTS?\s+\w+)\s*=\s*\S+", "$1")),
    (None, _plain(rf"\\\\({'|'.join(OPERATORS)})\b", r"\\$1")),
    ("replaced \\notin with ~(\\in)", _plain(r"(\b\w+(?:\[\w+\])?)\s*\\notin\s+(\w+(?:\([^)\n]*\))?|\{[^}\n]*\})", r"~($1 \\in $2)")),
    ("removed ASSUME referencing variable", constant_assumptions),
    ("removed problematic ASSUME block", no_assumptions),
    ("added missing ==== delimiter", lambda text, errors: terminated(text)),
    ("fixed MODULE header dashes", dashes),
    ("cleaned after ==== (preserved TLC config)", tail_of_configuration),
    (None, _plain(r"(\n\s*/\\[^\n]+)\n\s*\n(\s*/\\)", "$1\n$2")),
    ("normalized conjunction/disjunction alignment", aligned),
    ("removed unknown EXTENDS modules", known_extends),
    ("removed EXTENDS with all unknown modules", no_unknown_extends),
    (None, _plain(r"(?m)^\s*ASSUME\s*~?\s*\(\s*\)\s*$", "")),
    ("auto-defined vars", vars_defined),
    ("inlined vars tuple in WF/SF", vars_inlined),
    ("removed bare module-level \\in expressions", no_bare_memberships),
    ("replaced EXISTS with \\E", _plain(r"\bEXISTS\s+(\w)", r"\\E $1")),
    ("replaced FORALL with \\A", _plain(r"\bFORALL\s+(\w)", r"\\A $1")),
    ("replaced ALL with \\A", _plain(r"\bALL\s+(\w+)\s*\\in\b", r"\\A $1 \\in")),
    ("replaced SOME with \\E", _plain(r"\bSOME\s+(\w+)\s*\\in\b", r"\\E $1 \\in")),
    ("auto-defined SUM operator", sum_defined),
    ("removed UNCHANGED <<>> (empty tuple)", _plain(r"(?md)^\s*/\\.*UNCHANGED\s*<<\s*>>\s*$", "")),
    ("fixed EXCEPT missing ! before [", _plain(r",\s*\[(\w[^\]\n]*\]\s*=)", ", ![$1")),
)


def _step(state: Column, rule: tuple[str | None, Change], errors: Column) -> Column:
    name, change = rule

    def report(old: Column, new: Column) -> Column:
        rules = old["rules"] if name is None else F.when(new == old["text"], old["rules"]).otherwise(F.array_append(old["rules"], F.lit(name)))
        return F.struct(new.alias("text"), rules.alias("rules"))

    def applied(old: Column) -> Column:
        new = change(old["text"], errors)
        if name is not None and change in WAITING:
            new = F.when(F.array_contains(old["rules"], BLOCK), old["text"]).otherwise(new)
        return let(new, lambda new: report(old, new))

    return let(state, applied)


WAITING = tuple(change for _, change in WHOLE_RULES[1:3])


def with_fixed(df: DataFrame, text: Column, errors: Column | None = None, name: str = "fixed") -> DataFrame:
    """df with a column struct(text, rules): the module with its slips put right, and the names of the rules that changed it, in order.

    errors is the checker's message for the text, if there was one; a few rules apply only to what it complains of.
    """
    return with_rules(df, text, WHOLE_RULES, CODE_RULES, errors, name)


def with_rules(df: DataFrame, text: Column, whole_rules: tuple, code_rules: tuple, errors: Column | None, name: str) -> DataFrame:
    """The fold over rules of the whole text and then of its code, cut into projections of GROUP rules, as the analyser takes some rounds for each rule inside another."""
    state, told, kept = (f"__{c}_{name}" for c in ("state", "told", "kept"))
    start = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<string>").alias("rules"))
    df = df.withColumns({state: start, told: F.lit("") if errors is None else F.coalesce(errors, F.lit(""))})

    def folded(df: DataFrame, rules: tuple) -> DataFrame:
        for i in range(0, len(rules), GROUP):
            df = df.withColumn(state, reduce(lambda s, rule: _step(s, rule, F.col(told)), rules[i : i + GROUP], F.col(state)))
        return df

    df = folded(df, whole_rules).withColumn(kept, masked(F.col(state)["text"]))
    df = folded(df.withColumn(state, F.struct(F.col(kept)["code"].alias("text"), F.col(state)["rules"].alias("rules"))), code_rules)
    whole = F.regexp_replace(unmasked(F.col(state)["text"], F.col(kept)["kept"]), r"^\s+|\s+$", "")
    return df.withColumn(name, F.struct(whole.alias("text"), F.col(state)["rules"].alias("rules"))).drop(state, told, kept)
