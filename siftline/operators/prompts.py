"""Texts of the review requests.

Member names and enum values of the reply shapes are fixed values, since replies
are parsed by them.  Everything else is built here from the shapes.
"""

from __future__ import annotations

# Members of the replies and what they may hold; "?" marks those that may be left out.
_SEVERITY = "low|medium|high|critical"
_LEVEL = "low|medium|high"
_DISCOVERY = {
    "title": "text", "category": "text", "severity": _SEVERITY, "confidence": _LEVEL, "needsReview": "boolean",
    "evidenceLineStart?": "integer", "evidenceLineEnd?": "integer", "evidenceSummary?": "text",
    "attackScenario?": "text", "fix?": "text", "safeAlternative?": "text",
}
_REVIEW = {
    "index": "integer", "category": "text", "severity": _SEVERITY, "confidence": _LEVEL, "needsReview": "boolean",
    "falsePositive?": "boolean", "summary?": "text", "attackScenario?": "text", "fix?": "text",
    "safeAlternative?": "text",
}
_CHUNK = {
    "ruleId": "text", "description": "text", "severity": _SEVERITY, "lineOffset": "integer", "suggestion": "text",
    "confidence": "number",
}
_INTENT = {
    "stated_intent": "text", "actual_intent": "text", "intent_mismatch": "boolean", "deception_detected": "boolean",
    "social_engineering": "boolean", "external_code_execution.downloads": "boolean",
    "external_code_execution.executes_downloads": "boolean", "external_code_execution.sources": "texts",
    "data_exfiltration.sensitive_files": "texts", "data_exfiltration.env_vars_access": "boolean",
    "data_exfiltration.external_connections": "texts", "persistence.creates_services": "boolean",
    "persistence.modifies_cron": "boolean", "persistence.install_files": "texts",
    "verdict": "safe|suspicious|malicious", "confidence": "number", "reasoning": "text", "recommendation": "text",
}


def _members(shape: dict[str, str]) -> str:
    return "; ".join(f"{name} ({kind})" for name, kind in shape.items())


def _reply(list_name: str, shape: dict[str, str]) -> str:
    return (
        f"Reply format: a JSON object with the array \"{list_name}\", and no text around it. "
        f"Members of each entry, optional ones with a question mark: {_members(shape)}."
    )


DISCOVERY_SYSTEM = "Task: name what could do damage in the quoted lines of one file. " + _reply("findings", _DISCOVERY)
REVIEW_SYSTEM = "Task: judge numbered scanner hits of one file, each on its own. " + _reply("analyses", _REVIEW)
CHUNK_SYSTEM = "Task: report weak spots in a piece of a program. The reply is parsed as JSON."

PATH_LABEL = "File: "
TYPE_LABEL = "\nType: "
SIZE_LABEL = "\nBytes: "
BLOCKS_LABEL = "\n\nQuoted lines:\n\n"
BLOCK_LABEL = "Block %d, lines %d-%d:"
ITEMS_LABEL = "\n\nHits, by index:\n"

CHUNK_HEAD = "Rules in force:\n{rules}\n\nThe piece:\n```\n"
CHUNK_TAIL = "\n```\n\n" + _reply("findings", _CHUNK) + " An empty array says that no rule is broken."

INTENT_HEAD = "Task: tell what this program is said to be for, and what it is built to do.\n\nThe program:\n```\n"
INTENT_TAIL = (
    "\n```\n\n"
    + _reply("findings", _CHUNK)
    + " Next to the array stands the object intent_analysis, nested where a name has a dot: "
    + _members(_INTENT)
    + "."
)
