"""Redaction by tiers, review flags, validation; injection detection; trust. Column expressions, evaluated in the JVM.

Null texts and paths count as empty; patterns follow Unicode classes, as "(?U)" states.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Redaction patterns, in the order in which they apply.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "url": r"https?://[^\s]+",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "domain": r"\b[a-zA-Z0-9][a-zA-Z0-9-]{1,61}[a-zA-Z0-9]\.[a-zA-Z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "azure_key": r"[a-zA-Z0-9+/]{88}==",
    "api_key": r"[\"']?api[_-]?key[\"']?\s*[:=]\s*[\"']?([a-zA-Z0-9_\-]{32,})[\"']?",
}
# Client patterns, client indicators, categories of the tiers.
CLIENT_PATTERNS = {"hospital_bella_vista": r"(?i)hospital\s+bella\s+vista", "uaa": r"(?i)university\s+of\s+alaska\s+anchorage"}
CLIENT_INDICATORS = ["/client-work/", "/cooperton/", "ttx", "hospital", "uaa", "client", "engagement"]
PII = ["email", "phone"]
IOC = ["ipv4", "ipv6", "mac_address", "domain", "url"]
SECRETS = ["ssn", "credit_card", "aws_key", "azure_key", "api_key"]
TIERS = {"strict": PII + IOC, "standard": PII, "intel": []}
STRICTNESS = {"intel": 0, "standard": 1, "strict": 2}
HIGH_RISK = ["hospital", "university", "client", "engagement", "ssn", "credit_card"]
VALIDATION = [(r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "Email addresses", "email"), (r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", "Phone", "phone"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "IP address", "ipv4")] + [
    (PATTERNS[c], d, c) for c, d in (("ssn", "SSN"), ("credit_card", "Credit card"), ("aws_key", "AWS key"), ("azure_key", "Azure key"), ("api_key", "API key"))
]
NEVER = "(?!)"


def java(pattern: str) -> str:
    return "(?U)" + pattern


def _active(category: str, tier: Column) -> Column:
    if category in SECRETS:
        return F.lit(True)
    return tier.isin([t for t, cs in TIERS.items() if category in cs]) | ~tier.isin(list(TIERS))


def redact(text: Column, tier: Column) -> Column:
    """The text after all active patterns; each applies only if it matches the original text, and occurs once in the expression."""
    t = F.coalesce(text, F.lit(""))
    out = t
    for c, p in [*PATTERNS.items(), *CLIENT_PATTERNS.items()]:
        on = F.regexp_like(t, F.lit(java(p)))
        on = on & _active(c, tier) if c in PATTERNS else on
        tag = f"[REDACTED_{c.upper()}]" if c in PATTERNS else "[REDACTED_CLIENT]"
        out = F.regexp_replace(out, F.when(on, java(p)).otherwise(NEVER), F.lit(tag))
    return out


def detections(text: Column, tier: Column) -> Column:
    """["<category>: <n> occurrences", ...] counted on the original text."""
    t = F.coalesce(text, F.lit(""))
    items = []
    for c, p in [*PATTERNS.items(), *CLIENT_PATTERNS.items()]:
        n = F.regexp_count(t, F.lit(java(p)))
        on = n > 0
        items.append(F.when(on & _active(c, tier) if c in PATTERNS else on, F.concat(F.lit(c + ": "), n.cast("string"), F.lit(" occurrences"))))
    return F.array_compact(F.array(*items))


def resolve_tier(path: Column, rules: list[dict], default: str = "strict") -> Column:
    """Tier of the longest rule whose path occurs in the file path; of equally long ones the stricter; malformed rules are dropped."""
    good = [r for r in rules if isinstance(r, dict) and isinstance(r.get("path"), str) and r["path"] and r.get("tier") in TIERS] if isinstance(rules, list) else []
    good.sort(key=lambda r: (-len(r["path"]), -STRICTNESS[r["tier"]]))
    out = F.lit(default if default in TIERS else "strict")
    for r in reversed(good):
        out = F.when(F.contains(path, F.lit(r["path"])), r["tier"]).otherwise(out)
    return out


def is_client_data(path: Column, text: Column) -> Column:
    low = [F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))]
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(i)) for c in low for i in CLIENT_INDICATORS])


def requires_review(path: Column, text: Column, found: Column) -> Column:
    risky = F.exists(found, lambda d: reduce(lambda a, b: a | b, [F.contains(F.lower(d), F.lit(h)) for h in HIGH_RISK]))
    return is_client_data(path, text) | (F.size(found) > 10) | risky


def failures(text: Column, tier: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(_active(c, tier) & F.regexp_like(t, F.lit(java(p))), d) for p, d, c in VALIDATION]))


def redact_entities(text: Column, entities: Column) -> Column:
    """Replace every entity struct<text, label>, longest first, everywhere in the text."""
    ordered = F.array_sort(F.filter(entities, lambda e: e["text"] != ""), lambda a, b: F.when(F.length(a["text"]) != F.length(b["text"]), F.length(b["text"]) - F.length(a["text"])).when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))
    return F.aggregate(ordered, F.coalesce(text, F.lit("")), lambda acc, e: F.replace(acc, e["text"], F.concat(F.lit("[REDACTED_"), e["label"], F.lit("]"))))


def not_allowlisted(entities: DataFrame, allow: DataFrame) -> DataFrame:
    """Entities (text, ...) whose text is no allowed term, exactly or in lower case. Allow lists are small; Catalyst decides on a broadcast by size."""
    terms = allow.where("term is not null").select("term").distinct()
    out = entities.join(terms, entities["text"] == terms["term"], "left_anti")
    low = terms.select(F.lower("term").alias("low")).distinct()
    return out.join(low, F.lower(out["text"]) == low["low"], "left_anti")


# Injection patterns with severity and description; homoglyphs.
INJECTIONS = {
    "instruction_override": ("CRITICAL", "Direct instruction override attempt", [
        r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context)",
        r"(?i)disregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?)",
        r"(?i)forget\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?)",
        r"(?i)override\s+(system|previous|prior)\s+(prompt|instructions?)",
        r"(?i)new\s+instructions?\s*[:;]\s*ignore",
        r"(?i)\[?\s*system\s*\]?\s*[:;]?\s*you\s+are\s+now",
    ]),
    "role_hijack": ("CRITICAL", "Role/identity hijacking attempt", [
        r"(?i)you\s+are\s+now\s+(?:a|an|the)\s+\w+\s+(?:assistant|agent|bot)",
        r"(?i)act\s+as\s+(?:a|an|the)\s+\w+\s+(?:assistant|agent|bot)",
        r"(?i)pretend\s+(?:you'?re?|to\s+be)\s+(?:a|an|the)",
        r"(?i)your\s+new\s+(?:role|identity|persona)\s+is",
        r"(?i)from\s+now\s+on[,]?\s+you\s+(?:are|will)",
    ]),
    "prompt_extraction": ("HIGH", "System prompt extraction attempt", [
        r"(?i)(?:reveal|show|display|print|output)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions)",
        r"(?i)what\s+(?:are|is)\s+your\s+(?:system\s+)?(?:prompt|instructions)",
        r"(?i)repeat\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions)",
        r"(?i)echo\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions)",
    ]),
    "delimiter_injection": ("HIGH", "Chat delimiter injection", [
        r"<\s*\/?\s*(?:system|user|assistant|instruction|prompt)\s*>",
        r"\[\s*(?:INST|SYS|USER|ASSISTANT)\s*\]",
        r"###\s*(?:System|User|Assistant|Instruction)",
        r"(?i)<<\s*(?:SYS|INST|USER)\s*>>",
    ]),
    "indirect_manipulation": ("MEDIUM", "Indirect manipulation attempt", [
        r"(?i)(?:please\s+)?(?:do\s+)?(?:not\s+)?follow\s+(?:these|the)\s+(?:instructions?|rules?)",
        r"(?i)(?:important|urgent|critical)\s*[:!]\s*(?:you\s+must|always|never)",
        r"(?i)(?:admin|administrator|sudo|root)\s*[:;]\s*",
        r"(?i)developer\s+mode\s+(?:enabled?|activated?|on)",
    ]),
    "encoded_injection": ("MEDIUM", "Potentially encoded payload", [
        r"(?i)base64\s*[:;]\s*[A-Za-z0-9+/=]{20,}",
        r"(?i)hex\s*[:;]\s*[0-9A-Fa-f]{20,}",
        r"(?i)rot13\s*[:;]\s*[A-Za-z]{10,}",
    ]),
    "suspicious_context": ("LOW", "Suspicious context pattern", [
        r"(?i)(?:execute|run|eval)\s+(?:this|the\s+following)\s+(?:code|command)",
        r"(?i)output\s+(?:the\s+following|this)\s+exactly",
        r"(?i)respond\s+(?:only\s+)?with\s+(?:the\s+following|this)",
    ]),
}
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x", "\u0443": "y", "\u0456": "i", "\u0131": "i",
    "\u1d00": "a", "\u1d07": "e", "\u1d0f": "o", "\u00a0": " ", **{chr(c): " " for c in range(0x2000, 0x200B)}, "\u202f": " ", "\u205f": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
}
SEVERITIES = ["CLEAN", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
PENALTIES = {"CRITICAL": 0.5, "HIGH": 0.3, "MEDIUM": 0.15, "LOW": 0.05}
# Path parts of the trust levels.
TRUST = [("TRUSTED", 1.0, [".claude/", "docs/", ".md"]), ("VERIFIED", 0.75, ["output/research/", ".py", ".ts", ".yml"]), ("UNTRUSTED", 0.5, ["external/", "downloads/", "temp/"])]


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(text: Column) -> Column:
    """Compatibility form, then look-alike letters to ASCII and zero-width characters removed."""
    return F.translate(nfkc(F.coalesce(text, F.lit(""))), "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def injection_counts(text: Column) -> Column:
    """struct<category: matches, ...> over a normalised text."""
    return F.struct(*[sum((F.regexp_count(text, F.lit("(?m)" + java(p))) for p in ps), F.lit(0)).alias(c) for c, (_, _, ps) in INJECTIONS.items()])


def risk_level(counts: Column) -> Column:
    rank = F.greatest(*[F.when(counts[c] > 0, SEVERITIES.index(s)).otherwise(0) for c, (s, _, _) in INJECTIONS.items()])
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def matches_of(text: str) -> list[tuple[str, str, str, str, int]]:
    """(category, severity, description, matched text up to 100 characters, position) of a normalised text."""
    import re

    return [(c, s, d, m[0][:100], m.start()) for c, (s, d, ps) in INJECTIONS.items() for p in ps for m in re.finditer(p, text, re.M)]


def neutralize(text: str) -> str:
    """Quote every match, last first, at the first occurrence of its text in the unnormalised text."""
    clean = unicodedata.normalize("NFKC", text).translate({ord(k): v for k, v in HOMOGLYPHS.items()})
    out = text
    for _, _, _, found, _ in sorted(matches_of(clean), key=lambda m: -m[4]):
        out = out.replace(found, f'[QUOTED_CONTENT: "{found}"]', 1)
    return out


@F.pandas_udf(T.StringType())
def neutralized(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else neutralize(x))


def trust_level(path: Column, source_type: Column | None = None) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit("VERIFIED")
    for level, _, parts in reversed(TRUST):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), level).otherwise(out)
    return out if source_type is None else F.when(source_type.isin("URL", "API"), "UNTRUSTED").otherwise(out)


def trust_score(level: Column, risk: Column) -> Column:
    base = F.when(level == "TRUSTED", 1.0).when(level == "UNTRUSTED", 0.5).otherwise(0.75)
    penalty = F.lit(0.0)
    for s, x in PENALTIES.items():
        penalty = F.when(risk == s, x).otherwise(penalty)
    return F.round(F.greatest(F.lit(0.1), base - penalty), 4)
