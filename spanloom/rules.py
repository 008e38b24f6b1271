"""User rules: patterns to keep or to mask."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import regex_spans
from spanloom.model import no_spans

#: Terms kept by the rules a first run starts with.
STOP_TERMS = ("service client", "client", "clients", "fournisseur", "fournisseurs", "divers", "la société", "société", "monsieur", "madame", "banque")
RULE_TYPE = "REGLE_INTERNE"


def java_pattern(mode: str, pattern: str) -> str:
    """simple: # is a digit, ? any character, * any run, all else itself; regex: as it is."""
    if mode != "simple":
        return pattern
    wild = {"#": r"\d", "?": ".", "*": ".*"}
    return "".join(wild.get(c) or (c if c.isalnum() else "\\" + c if ord(c) < 128 and not c.isspace() else c) for c in pattern)


@dataclass(frozen=True)
class Rule:
    mode: str = "simple"
    pattern: str = ""
    action: str = "keep"
    enabled: bool = True
    note: str = ""

    @property
    def java(self) -> str:
        return java_pattern(self.mode, self.pattern)

    def is_valid(self, spark: SparkSession | None = None) -> bool:
        """Whether Java compiles it; empty ones and unknown modes and actions aren't valid."""
        if not self.pattern or self.mode not in ("simple", "regex") or self.action not in ("keep", "mask"):
            return False
        spark = spark or SparkSession.active()
        try:
            spark._jvm.java.util.regex.Pattern.compile(self.java)
        except IllegalArgumentException:
            return False
        return True


@dataclass(frozen=True)
class Rules:
    rules: tuple[Rule, ...] = ()

    @classmethod
    def starting(cls) -> Rules:
        return cls(tuple(Rule("simple", t, "keep", True, "") for t in STOP_TERMS))

    @classmethod
    def from_json(cls, text: str) -> Rules:
        known = Rule.__dataclass_fields__
        return cls(tuple(Rule(**{k: v for k, v in x.items() if k in known}) for x in json.loads(text).get("rules", [])))

    def to_json(self) -> str:
        return json.dumps({"rules": [asdict(r) for r in self.rules]}, ensure_ascii=False, indent=2)

    def add(self, rule: Rule) -> Rules:
        if not rule.is_valid():
            raise ValueError(f"not a valid rule: {rule}")
        return Rules((*self.rules, replace(rule, enabled=True)))

    def remove(self, index: int) -> Rules:
        return Rules(self.rules[:index] + self.rules[index + 1 :])

    def invalid(self) -> list[Rule]:
        return [r for r in self.rules if not r.is_valid()]

    def live(self, action: str) -> list[Rule]:
        return [r for r in self.rules if r.enabled and r.action == action and r.is_valid()]

    def keeps(self, value: Column) -> Column:
        """Whether a whole value matches an enabled keep rule, whatever its case."""
        patterns = [r.java for r in self.live("keep")]
        if not patterns:
            return F.lit(False)
        return reduce(lambda a, b: a | b, (value.rlike(rf"(?iuU)\A(?:{p})\z") for p in patterns))

    def forced_spans(self, text: Column) -> Column:
        """All places that enabled mask rules match, rule by rule."""
        found = [regex_spans(text, f"(?iuU)(?:{r.java})", RULE_TYPE, "rule") for r in self.live("mask")]
        return F.concat(*found) if found else no_spans()
