"""Governance: which results may be shown, and what in them is hidden."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import text


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** spans folders, * and ? stay inside one, [..] and {a,b} as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[":
            end = glob.find("]", i + 1)
            if end < 0:
                raise ValueError(f"unclosed class in glob: {glob}")
            out.append("[" + glob[i + 1 : end].replace("!", "^", 1) + "]")
            i = end + 1
            continue
        depth += (c == "{") - (c == "}")
        out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c, re.escape(c)))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob: {glob}")
    return "^" + "".join(out) + "$"


def compile_globs(globs: tuple[str, ...], strict: bool) -> tuple[list[str], list[str]]:
    """(regular expressions, warnings). An invalid glob is an error if strict, else it is left out."""
    patterns, warnings = [], []
    for g in globs:
        try:
            patterns.append(glob_regex(g))
        except ValueError as problem:
            if strict:
                raise
            warnings.append(str(problem))
    return patterns, warnings


@dataclass(frozen=True)
class Policy:
    """off, audit_only, balanced or strict; empty allow lists allow all."""

    mode: str = "balanced"
    deny_paths: tuple[str, ...] = ()
    allow_paths: tuple[str, ...] = ()
    deny_types: tuple[str, ...] = ()
    allow_types: tuple[str, ...] = ()
    deny_kinds: tuple[str, ...] = ()
    allow_kinds: tuple[str, ...] = ()
    redact: bool = True
    entropy_length: int = 20
    entropy_bits: float = 3.5
    overrides: tuple[str, ...] = ("balanced", "off", "audit_only")
    #: A Column of decisions by an outside engine: False blocks.
    decision: Column | None = field(default=None, compare=False)

    def resolved(self, request: str | None) -> tuple[str, list[str]]:
        """The mode of a request, and warnings. What isn't allowed is an error in strict mode."""
        if request is None or request == self.mode:
            return self.mode, []
        if request in self.overrides:
            return request, []
        if self.mode == "strict":
            raise ValueError(f"policy mode {request} isn't allowed")
        return self.mode, [f"policy mode {request} isn't allowed; {self.mode} stays"]


def _any(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(p)
    return found


def block_reason(policy: Policy) -> Column:
    """Why a row (path, result_type, kind) is blocked, by the first rule that fits; null if it isn't."""
    deny, _ = compile_globs(policy.deny_paths, policy.mode == "strict")
    allow, _ = compile_globs(policy.allow_paths, policy.mode == "strict")
    kind, result_type, path = F.lower("kind"), F.col("result_type"), F.col("path")
    symbol = result_type == "symbol"
    reason = F.when(_any(path, deny), "path_denied")
    if allow:
        reason = reason.when(~_any(path, allow), "path_not_allowed")
    if policy.deny_types:
        reason = reason.when(result_type.isin(*policy.deny_types), "type_denied")
    if policy.allow_types:
        reason = reason.when(~result_type.isin(*policy.allow_types), "type_not_allowed")
    if policy.deny_kinds or policy.allow_kinds:
        reason = reason.when(symbol & kind.isNull(), "kind_missing")
    if policy.deny_kinds:
        reason = reason.when(symbol & kind.isin(*policy.deny_kinds), "kind_denied")
    if policy.allow_kinds:
        reason = reason.when(symbol & ~kind.isin(*policy.allow_kinds), "kind_not_allowed")
    if policy.decision is not None:
        reason = reason.when(~policy.decision, "external_denied")
    return reason


def apply(results: DataFrame, policy: Policy, snippet: str = "snippet") -> DataFrame:
    """off: all rows as they are. audit_only: all rows, with the reason they would be blocked for. Else blocked rows go and snippets are redacted."""
    if policy.mode == "off":
        return results.withColumn("block_reason", F.lit(None).cast("string"))
    rows = results.withColumn("block_reason", block_reason(policy))
    if policy.mode == "audit_only":
        return rows
    rows = rows.where("block_reason is null")
    if not policy.redact:
        return rows
    return rows.withColumn(snippet, text.redact_high_entropy(text.redact(F.col(snippet)), policy.entropy_length, policy.entropy_bits))


def counters(results: DataFrame, policy: Policy) -> DataFrame:
    """Blocked rows by reason."""
    return results.select(block_reason(policy).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("blocked"))
