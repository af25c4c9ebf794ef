"""Robots rules: parsing one agent's group, and the decision for a path as a column function."""

from __future__ import annotations

import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import once

POLICY = "struct<rules: array<struct<allow: boolean, path: string>>, delay_ms: double>"
#: A record of the file (RFC 9309): field, colon, value up to a comment; other lines say nothing.
_RECORD = re.compile(r"^[^\S\n]*([A-Za-z-]+)[^\S\n]*:([^#\n]*)", re.M)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)", re.A)


def sections(text: str) -> list[list[tuple[str, str]]]:
    """The file's groups as slices of its (field, value) records: a group starts at an agent line that no other
    agent line, but for records that are no rules, comes right before. What stands before the first is left out."""
    records = [(m[1].lower(), m[2].strip()) for m in _RECORD.finditer(text)]
    agents = {i for i, (field, _) in enumerate(records) if field == "user-agent"}
    ruled = {i for i, (field, value) in enumerate(records) if field == "disallow" or (field == "allow" and value)}
    starts = [i for before, i in pairwise([-1, *sorted(agents | ruled)]) if i in agents and before not in agents]
    return [records[a:b] for a, b in pairwise([*starts, len(records)])]


def group_for(text: str, agent: str) -> dict:
    """rules and delay_ms (None: not said) of the agent's group: the first of which an agent's name is within the
    agent (kept as it is: neither whole names nor merged groups), else the first for all, else no rules."""
    named = {"own": [], "all": []}
    for section in sections(text):
        names = {value.lower() for field, value in section if field == "user-agent"}
        named["all"] += [section] * ("*" in names)
        named["own"] += [section] * any(name in agent.lower() for name in names - {"*"})
    chosen = next(iter(named["own"] + named["all"]), [])
    rules = [{"allow": field == "allow", "path": value} for field, value in chosen if field == "disallow" or (field == "allow" and value)]
    numbers = [_NUMBER.match(value) for field, value in chosen if field == "crawl-delay"]
    delays = [1000 * float(n[0]) for n in numbers if n and float(n[0]) >= 0]
    return {"rules": rules, "delay_ms": delays[-1] if delays else None}


def policy(text: Column, agent: str) -> Column:
    """The group of a robots file for an agent; texts are few and short."""

    @F.arrow_udf(POLICY)
    def parsed(texts: pa.Array) -> pa.Array:
        rule = pa.struct([("allow", pa.bool_()), ("path", pa.string())])
        kind = pa.struct([("rules", pa.list_(rule)), ("delay_ms", pa.float64())])
        return pa.array([group_for(t or "", agent) for t in texts.to_pylist()], kind)

    return parsed(text)


def policy_of_answer(status: Column, text: Column, agent: str) -> Column:
    """2xx: the file's group; 404: everything; any other status, or none: nothing."""
    nothing = F.struct(F.array(F.struct(F.lit(False).alias("allow"), F.lit("/").alias("path"))).alias("rules"), F.lit(None).cast("double").alias("delay_ms"))
    everything = F.struct(F.array().cast("array<struct<allow: boolean, path: string>>").alias("rules"), F.lit(None).cast("double").alias("delay_ms"))
    return F.when((status >= 200) & (status < 300), policy(text, agent)).when(status == 404, everything).otherwise(nothing)


def rule_pattern(rule: Column) -> Column:
    """A pattern for the start of a path: * is anything, a final $ is the end."""
    open_end = F.regexp_replace(rule, r"\$$", "")
    quoted = F.regexp_replace(open_end, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(F.endswith(rule, F.lit("$")), "$").otherwise(""))


def allows(rules: Column, path: Column) -> Column:
    """By the longest rule that fits; of equals an allowing one; true without any. Empty rules don't count."""
    return once(path, lambda p: _allowed(rules, p))


def _allowed(rules: Column, path: Column) -> Column:
    fitting = F.filter(rules, lambda r: (r.path != "") & F.rlike(path, rule_pattern(r.path)))
    ranked = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r.path).alias("n"), r.allow.alias("allow"))))
    return F.coalesce(ranked.allow, F.lit(True))
