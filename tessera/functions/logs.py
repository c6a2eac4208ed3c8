"""Reading what external checkers print. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(log: Column) -> Column:
    return F.transform(F.split(F.coalesce(log, F.lit("")), "\n"), lambda line: F.trim(line))


def last_number(log: Column, pattern: str) -> Column:
    """The group of the pattern's last match as a long, 0 without a match."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(log, F.lit(pattern), 1), F.lit(-1)).cast("long"), F.lit(0))


def parser_result(log: Column) -> Column:
    """struct(valid, errors) of a parser's output."""
    errors = F.filter(_lines(log), lambda line: line.rlike("(?i)error|could not find module|unknown operator|was not expected"))
    return F.struct((~log.rlike("Semantic errors|Lexical error|Parse Error|Could not find module")).alias("valid"), errors.alias("errors"))


def check_succeeded(log: Column) -> Column:
    return log.rlike("(?i)no error has been found")


def violations(log: Column) -> Column:
    """Lines that tell a violation; harmless and closing lines aside."""
    quiet = r"(?i)warning.*(garbage collector|useparallelgc)|no error has been found"
    closing = "^(Finished|The depth|The average|calculated)"
    return F.filter(_lines(log), lambda line: line.rlike("(?i)invariant|property|error|violation|is violated") & ~line.rlike(quiet) & ~line.rlike(closing))


COVERAGE = r"(?m)^\s*<(\w+)\s+line\s+\d+[^>]*>:\s*(\d+):(\d+)"


def coverage(log: Column) -> Column:
    """array<struct(action, distinct, total)>, without the initial one."""
    part = lambda k: F.regexp_extract_all(log, F.lit(COVERAGE), k)
    rows = F.transform(F.arrays_zip(part(1), part(2), part(3)), lambda x: F.struct(x["0"].alias("action"), x["1"].cast("long").alias("distinct"), x["2"].cast("long").alias("total")))
    return F.filter(rows, lambda x: x["action"] != "Init")


def dead_actions(log: Column) -> Column:
    return F.transform(F.filter(coverage(log), lambda x: x["distinct"] == 0), lambda x: x["action"])


def state_counts(log: Column) -> Column:
    return F.struct(last_number(log, r"(\d+)\s+distinct\s+state").alias("distinct"), last_number(log, r"(\d+)\s+states?\s+generated").alias("total"))


def proof_result(log: Column) -> Column:
    """struct(tier, total, proved, failed): sums over all summary lines of a proof checker."""
    add = lambda pattern, k: F.aggregate(F.regexp_extract_all(log, F.lit(pattern), k), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    all_proved, some_failed = r"All (\d+) obligations? proved", r"(\d+)/(\d+) obligations? failed"
    done, failed, tried = add(all_proved, 1), add(some_failed, 1), add(some_failed, 2)
    proved = done + F.greatest(tried - failed, F.lit(0))
    broken = log.rlike("(?i)parse error|could not parse|syntax error")
    tier = F.when(broken, "parse_error").when(failed > 0, F.when(proved > 0, "partial").otherwise("unproved")).when(proved > 0, "proved").otherwise("unproved")
    zero = lambda c: F.when(broken, 0).otherwise(c)
    return F.struct(tier.alias("tier"), zero(done + tried).alias("total"), zero(proved).alias("proved"), zero(failed).alias("failed"))


def bounded_result(log: Column) -> Column:
    """struct(outcome, errors) of a bounded checker: ok, violation or error, and the lines that tell errors if it is one."""
    outcome = F.when(log.rlike("EXITCODE: OK|No error has been found"), "ok").when(log.rlike(r"EXITCODE: ERROR \(12\)|(?i:violated)"), "violation").otherwise("error")
    told = F.filter(_lines(log), lambda line: line.rlike("Error|ERROR|Type checker"))
    return F.struct(outcome.alias("outcome"), F.when(outcome == "error", F.slice(told, 1, 5)).otherwise(F.array().cast("array<string>")).alias("errors"))


# The wording of feedback.
NOT_ENUMERABLE = "FIX: State space is not enumerable. Use finite sets and bounded constants. Replace Int with a bounded range like 0..N, replace SUBSET with explicit enumeration."
NOT_ASSIGNED = "FIX: A CONSTANT is declared but not assigned a value in the .cfg file. Either remove the CONSTANT or provide a default value."
TRACE = "STATE TRACE (the execution that led to the violation):"


def trace(log: Column, most: int = 20) -> Column:
    """Steps and states of the behaviour that led to a violation: from the line that announces it to the count of states."""
    rows = _lines(log)
    begin = F.array_position(F.transform(rows, lambda line: F.contains(F.lower(line), F.lit("behavior up to this point"))), F.lit(True)).cast("int")
    after = F.slice(rows, begin + 1, F.size(rows))
    end = F.array_position(F.transform(after, lambda line: line.rlike(r"^\d+ state")), F.lit(True)).cast("int")
    shown = F.filter(F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after), lambda line: line.startswith("/\\") | line.startswith("State ") | line.startswith("->"))
    return F.when(begin > 0, F.slice(shown, 1, most)).otherwise(F.array().cast("array<string>"))


def feedback(log: Column, found: Column) -> Column:
    """What a writer can act on, a line each: the invariant violated, the trace, other errors among those found, evaluation errors, and what to do; empty without log and errors."""
    log, steps = F.coalesce(log, F.lit("")), trace(log)
    broken = F.regexp_extract(log, r"(?i)Invariant (\w+) is violated", 1)
    first = F.when(broken != "", F.array(F.concat(F.lit("INVARIANT VIOLATION: "), broken, F.lit(" was violated."))))
    states = F.when(F.size(steps) > 0, F.concat(F.array(F.lit(TRACE)), F.transform(steps, lambda s: F.concat(F.lit("  "), s))))
    other = F.transform(F.filter(found, lambda v: ~F.contains(F.lower(v), F.lit("violated")) & F.contains(F.lower(v), F.lit("error"))), lambda v: F.concat(F.lit("TLC ERROR: "), v))
    evaluating = F.transform(F.slice(F.regexp_extract_all(log, F.lit(r"(?s)Error evaluating.*?(?=\n\n|\z)"), F.lit(0)), 1, 3), lambda e: F.concat(F.lit("EVALUATION ERROR: "), F.substring(F.trim(e), 1, 200)))
    low = F.lower(log)
    advice = F.array_compact(F.array(F.when(F.contains(low, F.lit("not enumerable")) | F.contains(low, F.lit("cannot enumerate")), NOT_ENUMERABLE), F.when(F.contains(log, F.lit("CONSTANT")) & F.contains(low, F.lit("is not assigned")), NOT_ASSIGNED)))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(first, none), F.coalesce(states, none), other, evaluating, advice), "\n")


def hints(errors: Column) -> Column:
    """Hints by what the parser says, in order."""
    rules = (("(?i)unknown operator", "Define the operator or extend the module that has it."), ("(?i)was expecting|parse error", "Check the line's brackets and junctions."), ("(?i)multiple declarations|already defined", "Define each name once."), ("(?i)could not find module", "Extend only modules that are there."))
    return F.array_compact(F.array(*[F.when(errors.rlike(p), h) for p, h in rules]))
