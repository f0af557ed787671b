"""Prompt assembly and answer post-processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark import params as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prompt_plain(question) -> Column:
    """Template without a context block."""
    return F.concat(F.lit(P.SYSTEM_PROMPT + " " + P.PLAIN_INSTRUCTION + P.PLAIN_QUESTION_HEAD),
                    _c(question), F.lit(P.QUESTION_TAIL))


def prompt_with_context(question, context) -> Column:
    """Template with the retrieved document as context."""
    return F.concat(F.lit(P.SYSTEM_PROMPT + " " + P.CONTEXT_INSTRUCTION_HEAD), _c(context),
                    F.lit(P.CONTEXT_INSTRUCTION_TAIL + P.CONTEXT_QUESTION_HEAD), _c(question),
                    F.lit(P.QUESTION_TAIL))


def prompt_for(question, context) -> Column:
    """P20: plain template when the context is empty, context template otherwise (null context -> null)."""
    ctx = _c(context)
    return F.when(ctx == "", prompt_plain(question)).otherwise(prompt_with_context(question, ctx))


def strip_echo(output, prompt, offset: int = P.ECHO_OFFSET) -> Column:
    """``output[len(prompt) - offset:]`` with Python slice semantics (code points).

    A negative start counts from the end of the output, as in Python.
    """
    o = _c(output)
    start = F.length(_c(prompt)) - F.lit(offset)
    pos = F.when(start >= 0, start).otherwise(F.greatest(F.length(o) + start, F.lit(0))) + 1
    return F.substr(o, pos)


def strip_exact_prefix(output, prompt) -> Column:
    """P21 variant: drop the prompt only when the output really starts with it."""
    o, p = _c(output), _c(prompt)
    return F.when(o.startswith(p), F.substr(o, F.length(p) + 1)).otherwise(o)
