"""Exit codes and signals in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: POSIX signal numbers and names.
SIGNALS = {1: "SIGHUP", 2: "SIGINT", 3: "SIGQUIT", 4: "SIGILL", 6: "SIGABRT", 7: "SIGBUS", 8: "SIGFPE", 9: "SIGKILL", 11: "SIGSEGV", 13: "SIGPIPE", 14: "SIGALRM", 15: "SIGTERM", 24: "SIGXCPU"}
CODES = {126: "the command could not be run", 127: "the command was not found", 124: "the command timed out"}


def status(code: Column, signal: Column) -> Column:
    """struct(signal, code, says) or null: a signal as given, or as 128 and its number in the exit code."""
    names = F.create_map(*(F.lit(x) for n, s in SIGNALS.items() for x in (n + 128, s)))
    says = F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv))
    name = F.coalesce(signal, F.try_element_at(names, code))
    words = F.when(name.isNotNull(), F.concat(F.lit("killed by "), name)).otherwise(F.try_element_at(says, code))
    return F.when(words.isNotNull(), F.struct(name.alias("signal"), code.alias("code"), words.alias("says")))
