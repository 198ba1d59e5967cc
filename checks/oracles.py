"""DuckDB counterparts of the registered queries.

They start from the tables, build the planted corpus in SQL and match rules with
DuckDB's own regex engine, so they share only fixed values with the library.
"""

from __future__ import annotations

import re

from checks import planted as P
from checks.queries import INLINE_RULES, LIMIT
from siftline import catalogue as C
from siftline.operators import prompts as T

SPACE = r"\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def suppressed(line: str, rule_id: str) -> str:
    return (
        f"CASE WHEN contains(lower({line}), 'scan-ignore:') THEN contains(lower({line}), 'scan-ignore:' || lower({rule_id}))"
        f" ELSE contains(lower({line}), 'scan-ignore') END"
    )


def lines(corpus: str, name: str, crlf: bool = False) -> str:
    text = "replace(content, chr(13) || chr(10), chr(10))" if crlf else "content"
    return (
        f"{name} AS MATERIALIZED (SELECT path, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line"
        f" FROM (SELECT path, string_split({text}, chr(10)) AS l FROM {corpus}))"
    )


def rule_rows(rules: list[dict], name: str = "rules") -> str:
    rows = ", ".join(
        f"({k}, {q(r['id'])}, {q(r['description'])}, {q(r['severity'])}, {q(r['type'])}, {q(r.get('pattern'))},"
        f" {q((r.get('selector') or '').removeprefix('call:') or None)}, CAST({q(r.get('fix'))} AS VARCHAR), {q(r.get('group'))})"
        for k, r in enumerate(rules)
    )
    return f"{name}(rule_no, id, description, severity, engine, pattern, target, fix, grp) AS (VALUES {rows})"


FINDING = (
    'r.id AS rule_id, r.description, r.severity, h.path, h.line_no AS line, CAST(NULL AS INTEGER) AS "column", '
    + trim("h.line")
    + " AS snippet, r.fix AS suggestion, CAST(NULL AS DOUBLE) AS confidence, 0 AS phase"
)
PUBLIC = "rule_id, description, severity, path, line, snippet, suggestion"


def regex_part(rules: list[dict], source: str = "lines", name: str = "regex_findings", marker: bool = True, table="rules") -> str:
    hits = " UNION ALL ".join(
        f"SELECT {k} AS rule_no, path, line_no, line FROM {source} WHERE regexp_matches(line, {q(r['pattern'])}, 'i')"
        for k, r in enumerate(rules)
        if r["type"] == "regex"
    )
    where = f"WHERE NOT ({suppressed('h.line', 'r.id')})" if marker else ""
    return (
        f"{name} AS MATERIALIZED (SELECT {FINDING}, 0 AS engine, CAST(r.rule_no AS INTEGER) AS k1, h.line_no AS k2"
        f" FROM ({hits}) h JOIN {table} r USING (rule_no) {where})"
    )


def listed_calls(source: str = "lines") -> str:
    """Calls of script files on single lines, in order: strings and comments are cut, then names before a parenthesis."""
    code = "regexp_replace(regexp_replace(line, '\"[^\"]*\"|''[^'']*''', '\"\"', 'g'), '//.*', '')"
    calls = "regexp_extract_all(" + code + r", '(?:new\s+)?[A-Za-z0-9_$.?]*[A-Za-z0-9_$]\s*\(')"
    callee = r"regexp_replace(c, '\s*\($', '')"
    return (
        f"SELECT path, line_no, line, {callee} AS callee, line_no * 1000 + place AS place FROM"
        f" (SELECT path, line_no, line, unnest({calls}) AS c, generate_subscripts({calls}, 1) AS place FROM {source}"
        r" WHERE regexp_matches(path, '[^/]\.(ts|tsx|js|jsx)$', 'i')) WHERE NOT starts_with(c, 'new ')"
    )


def call_part(source: str = "lines", name: str = "call_findings", marker: bool = True) -> str:
    where = f"AND NOT ({suppressed('h.line', 'r.id')})" if marker else ""
    return (
        f"{name} AS MATERIALIZED (SELECT {FINDING}, 1 AS engine, CAST(h.place AS INTEGER) AS k1, CAST(r.rule_no AS INTEGER) AS k2"
        f" FROM ({listed_calls(source)}) h"
        f" JOIN rules r ON r.target IS NOT NULL AND (h.callee = r.target OR ends_with(h.callee, '.' || r.target)) {where})"
    )


def corpus() -> str:
    return f"corpus AS MATERIALIZED ({P.corpus_sql()})"


def long_corpus() -> str:
    return f"long_corpus AS MATERIALIZED ({P.long_corpus_sql()})"


def with_(*parts: str) -> str:
    names = [part.split(" AS ", 1)[0].split("(")[0].strip() for part in parts]
    recursive = any(re.search(rf"\b{name}\b", part.split(" AS ", 1)[1]) for name, part in zip(names, parts, strict=True))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def static(rules: list[dict] = C.BUILTIN_RULES, marker: bool = True) -> list[str]:
    return [
        corpus(),
        lines("corpus", "lines"),
        rule_rows(rules),
        regex_part(rules, marker=marker),
        call_part(marker=marker),
        "findings AS MATERIALIZED (SELECT * FROM regex_findings UNION ALL SELECT * FROM call_findings)",
    ]


def long_static() -> list[str]:
    return [
        long_corpus(),
        lines("long_corpus", "long_lines"),
        rule_rows(C.BUILTIN_RULES),
        regex_part(C.BUILTIN_RULES, "long_lines", "long_findings"),
    ]


def suspicious(source: str, mode: str, name: str) -> str:
    lowered = "lower(line)"
    manifest = " OR ".join(f"contains({lowered}, {q(w)})" for w in C.MANIFEST_WORDS)
    code = " OR ".join(f"regexp_matches(line, {q(p)}, 'i')" for p in C.SUSPICIOUS_PATTERNS)
    wanted = f"CASE WHEN ends_with(path, 'package.json') THEN {manifest} ELSE {code} END"
    if mode != "targeted":
        wanted = f"(({wanted}) OR ((line_no - 1) % 80 = 0 AND {trim('line')} <> ''))"
    if mode != "full":
        starts = " OR ".join(f"starts_with({trim('line')}, {q(s)})" for s in C.SAFE_LINE_STARTS)
        wanted = f"({wanted}) AND NOT ({trim('line')} = '' OR {starts})"
    return (
        f"{name} AS MATERIALIZED (SELECT path, list(line_no ORDER BY line_no) AS nums FROM {source}"
        f" WHERE NOT contains(lower(line), 'scan-ignore') AND ({wanted}) GROUP BY path)"
    )


def blocks(source: str, mode: str, radius: int, name: str, wanted: str = "wanted") -> list[str]:
    """Greedy choice of spans that do not overlap, as a recursive query."""
    most = {"targeted": 6, "balanced": 8, "full": 12}[mode]
    following = f"list_filter(nums, lambda x: greatest(1, x - {radius}) > last_end)[1]"
    return [
        f"texts AS (SELECT path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {source})",
        f"picked AS (SELECT path, nums, 0 AS block_no, 0 AS line_no, 0 AS last_end FROM {wanted}"
        f" UNION ALL SELECT p.path, nums, block_no + 1, {following}, {following} + {radius} FROM picked p"
        f" WHERE block_no < {most} AND {following} IS NOT NULL)",
        f"{name} AS MATERIALIZED (SELECT path, CAST(block_no AS INTEGER) AS block_no,"
        f" CAST(greatest(1, line_no - {radius}) AS INTEGER) AS start_line,"
        f" CAST(least(len(l), line_no + {radius}) AS INTEGER) AS end_line,"
        f" array_to_string(l[greatest(1, line_no - {radius}):least(len(l), line_no + {radius})], chr(10)) AS text"
        " FROM picked JOIN texts USING (path) WHERE block_no > 0)",
    ]


def block_parts(mode: str, radius: int = 8, source: str = "corpus") -> list[str]:
    return [lines(source, "crlf_lines", crlf=True), suspicious("crlf_lines", mode, "wanted"), *blocks(source, mode, radius, "blocks")]


def both_corpora() -> list[str]:
    return [corpus(), long_corpus(), "both_files AS MATERIALIZED (SELECT * FROM corpus UNION ALL SELECT * FROM long_corpus)"]


def redacted(text: str) -> str:
    for pattern, flags, replacement in C.REDACTIONS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(replacement.replace('$1', chr(92) + '1'))}, {q('g' + flags)})"
    return text


def changed(text: str) -> str:
    """Some rewrite changed the text: it no longer reads the same after one of them."""
    tests = []
    for i in range(len(C.REDACTIONS)):
        before, after = text, None
        for pattern, flags, replacement in C.REDACTIONS[: i + 1]:
            after = f"regexp_replace({before}, {q(pattern)}, {q(replacement.replace('$1', chr(92) + '1'))}, {q('g' + flags)})"
            before, last = after, before
        tests.append(f"({last}) <> ({after})")
    return " OR ".join(tests)


EXT = "CASE WHEN contains(path, '.') THEN regexp_extract(path, '[^.]*$') ELSE '' END"


def request_parts(mode: str = "targeted", radius: int = 8, model: str = "", redact: bool = True, source: str = "corpus") -> list[str]:
    block = f"'Block ' || block_no || ', lines ' || start_line || '-' || end_line || ':' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10)"
    user = (
        f"{q(T.PATH_LABEL)} || path || {q(T.TYPE_LABEL)} || coalesce(nullif({EXT}, ''), 'unknown') || {q(T.SIZE_LABEL)}"
        f" || octet_length(encode(any_value(content))) || {q(T.BLOCKS_LABEL)} || string_agg({block}, chr(10) ORDER BY block_no)"
    )
    text = redacted("raw_prompt") if redact else "raw_prompt"
    return [
        *block_parts(mode, radius, source),
        f"prompts AS (SELECT path, {user} AS raw_prompt FROM blocks JOIN {source} USING (path) GROUP BY path)",
        f"requests AS MATERIALIZED (SELECT sha256('compatible|{model}|' || system_prompt || '|' || user_prompt) AS prompt_hash, *"
        f" FROM (SELECT path, 'discovery' AS kind, {q(T.DISCOVERY_SYSTEM)} AS system_prompt, {text} AS user_prompt FROM prompts))",
    ]


def numbered(source: str, kind: str, name: str) -> str:
    number, body, around = P.REPLIES[kind]
    return (
        f"{name} AS MATERIALIZED (SELECT *, {around} AS raw_text FROM (SELECT *, {body} AS body FROM"
        f" (SELECT *, {number} AS n FROM {source})))"
    )


REQUEST = "prompt_hash, path, kind, system_prompt, user_prompt"

SLUG = "coalesce(nullif(regexp_replace(regexp_replace(upper(category), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'UNKNOWN')"
OR_LOW = "CASE WHEN severity IN ('low', 'medium', 'high', 'critical') THEN severity ELSE 'low' END"


def discovery_items() -> list[str]:
    """What the planted replies say, computed from the request number."""
    item = f"""
      SELECT path, prompt_hash, 0 AS ord, 'T' || n AS title, {P.CATEGORY} AS category, {P.SEVERITY} AS severity,
             CASE WHEN n % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, n % 2 <> 0 AS needs_review,
             CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN 9000 WHEN 2 THEN 2 END AS s,
             CASE n % 5 WHEN 0 THEN 3 WHEN 1 THEN 9001 WHEN 3 THEN 5 END AS e,
             'S' AS summary, CASE WHEN n % 4 = 1 THEN 'A {{ "q"' END AS attack,
             CASE WHEN n % 4 = 2 THEN 'F' END AS fix, CASE WHEN n % 4 = 2 THEN 'L' END AS safe FROM usable
      UNION ALL SELECT path, prompt_hash, 1, 'U', 'Second one', 'low', 'low', true, NULL, NULL, NULL, NULL, NULL, NULL
      FROM usable WHERE n % 7 = 0"""
    evidence = """
      SELECT i.*, CASE WHEN i.s IS NULL AND i.e IS NULL THEN (SELECT text FROM blocks b WHERE b.path = i.path AND b.block_no = 1)
        ELSE (SELECT arg_min(text, block_no) FROM blocks b WHERE b.path = i.path
              AND coalesce(i.e, i.s) >= b.start_line AND coalesce(i.s, i.e) <= b.end_line) END AS block_text
      FROM items i"""
    return [
        corpus(),
        *request_parts(),
        numbered("requests", "discovery", "asked"),
        "usable AS MATERIALIZED (SELECT * FROM asked WHERE n % 3 <> 0 AND n % 11 <> 0 AND n % 13 <> 0)",
        f"items AS MATERIALIZED ({item})",
        f"evidence AS MATERIALIZED ({evidence})",
        f"""discovered AS MATERIALIZED (SELECT 'LLM-DISC-' || {SLUG} AS rule_id,
          title || CASE WHEN attack IS NOT NULL THEN '：' || attack ELSE '' END AS description, {OR_LOW} AS severity, path,
          CAST(s AS INTEGER) AS line, CAST(NULL AS INTEGER) AS "column", block_text AS snippet, fix AS suggestion,
          CAST(NULL AS DOUBLE) AS confidence, 1 AS phase, 2 AS engine, CAST(ord AS INTEGER) AS k1, 0 AS k2 FROM evidence)""",
        f"""discovery_reviews AS MATERIALIZED (SELECT
          sha1(path || '|' || category || '|' || title || '|' || coalesce(CAST(s AS VARCHAR), '') || '|' || coalesce(CAST(e AS VARCHAR), '')) AS id,
          title, category, {OR_LOW} AS severity, confidence, needs_review, path, CAST(s AS INTEGER) AS line,
          CAST(NULL AS INTEGER) AS "column", coalesce(block_text, summary) AS evidence, attack AS attack_scenario, fix,
          safe AS safe_alternative, CAST(NULL AS VARCHAR[]) AS related_rule_ids, 'compatible' AS provider, 'm1' AS model, prompt_hash, 0 AS stage, CAST(ord AS INTEGER) AS ord
          FROM evidence)""",
    ]


REVIEW = (
    "id, title, category, severity, confidence, needs_review, path, line, evidence, attack_scenario, fix, "
    "safe_alternative, provider, model, prompt_hash, stage, ord"
)


def review_request_parts() -> list[str]:
    return [
        *long_static(),
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY path ORDER BY phase, engine, k1, k2) - 1 AS ordinal FROM long_findings)",
        """review_lists AS (SELECT path, to_json(list({'index': CAST(ordinal AS INTEGER), 'ruleId': rule_id, 'severity': severity,
          'line': line, 'description': description, 'snippet': snippet} ORDER BY ordinal)) AS items FROM placed WHERE ordinal < 8 GROUP BY path)""",
        f"""review_requests AS MATERIALIZED (SELECT sha256('compatible||' || system_prompt || '|' || user_prompt) AS prompt_hash, * FROM
          (SELECT path, 'review' AS kind, {q(T.REVIEW_SYSTEM)} AS system_prompt,
           {redacted(f"{q(T.PATH_LABEL)} || path || {q(T.ITEMS_LABEL)} || items")} AS user_prompt FROM review_lists))""",
    ]


def review_items() -> list[str]:
    item = f"""
      SELECT path, prompt_hash, 0 AS ord, {P.REVIEW_INDEX} AS idx, CASE WHEN n % 2 = 0 THEN 'C' END AS category,
             CASE WHEN n % 2 = 0 THEN 'medium' END AS confidence, CASE WHEN n % 2 = 0 THEN false END AS needs_review,
             CASE WHEN n % 3 = 1 THEN {P.SEVERITY} END AS severity, CASE WHEN n % 4 = 1 THEN 'Sum' END AS summary,
             CASE WHEN n % 4 = 1 THEN 'Better' END AS fix, CASE WHEN n % 4 = 1 THEN 'Way' END AS attack FROM review_usable
      UNION ALL SELECT path, prompt_hash, 1, 0, 'Later', NULL, NULL, 'low', NULL, NULL, NULL FROM review_usable WHERE n % 2 = 1"""
    return [
        *review_request_parts(),
        numbered("review_requests", "review", "review_asked"),
        "review_usable AS MATERIALIZED (SELECT * FROM review_asked WHERE n % 3 <> 0 AND n % 11 <> 0)",
        f"review_items AS MATERIALIZED ({item})",
        """review_records AS MATERIALIZED (SELECT p.rule_id || '|' || p.path || '|' || p.line AS id,
          '复核：' || coalesce(i.summary, p.rule_id) AS title, coalesce(i.category, 'review') AS category,
          CASE WHEN coalesce(i.severity, p.severity) IN ('low', 'medium', 'high', 'critical') THEN coalesce(i.severity, p.severity) ELSE 'low' END AS severity,
          coalesce(i.confidence, 'low') AS confidence, coalesce(i.needs_review, true) AS needs_review, p.path, p.line,
          p."column", p.snippet AS evidence, i.attack AS attack_scenario, coalesce(i.fix, p.suggestion) AS fix,
          CAST(NULL AS VARCHAR) AS safe_alternative, [p.rule_id] AS related_rule_ids, 'compatible' AS provider, 'm1' AS model, i.prompt_hash, 1 AS stage,
          CAST(i.ord AS INTEGER) AS ord, p.rule_id AS about
          FROM review_items i JOIN placed p ON p.path = i.path AND p.ordinal = i.idx AND p.ordinal < 8)""",
        """last_reviews AS MATERIALIZED (SELECT about AS key_rule, path AS key_path, line AS key_line, arg_max(title, ord) AS title,
          arg_max(category, ord) AS category, arg_max(severity, ord) AS severity, arg_max(fix, ord) AS fix,
          arg_max(confidence, ord) AS confidence, arg_max(needs_review, ord) AS needs_review, arg_max(prompt_hash, ord) AS prompt_hash,
          arg_max({'v': attack_scenario}, ord).v AS attack_scenario, max(ord) AS ord FROM review_records GROUP BY ALL)""".replace(
            "GROUP BY ALL", "GROUP BY about, path, line"
        ),
    ]


def chunk_parts(kind: str) -> list[str]:
    return [
        long_corpus(),
        """chunks AS MATERIALIZED (SELECT path, CAST(i AS INTEGER) AS chunk_no, CAST(i * 100 + 1 AS INTEGER) AS start_line, l[i * 100 + 1:i * 100 + 100] AS chunk_lines,
          array_to_string(l[i * 100 + 1:i * 100 + 100], chr(10)) AS text
          FROM (SELECT path, l, unnest(range(CAST(ceil(len(l) / 100.0) AS BIGINT))) AS i FROM
                (SELECT path, string_split(content, chr(10)) AS l FROM long_corpus)))""",
        numbered("chunks", kind, "chunk_asked"),
    ]


def chunk_requests(kind: str, source: str = "chunks") -> str:
    if kind == "intent":
        head, tail = T.INTENT_HEAD, T.INTENT_TAIL
    else:
        summary = "\n".join(f"- {r['id']}: {r['name']} - {r['description']}" for r in C.BUILTIN_RULES)
        head, tail = T.CHUNK_HEAD.format(rules=summary), T.CHUNK_TAIL
    return (
        f"SELECT *, sha256('compatible||' || system_prompt || '|' || user_prompt) AS prompt_hash FROM (SELECT *, {q(kind)} AS kind,"
        f" {q(T.CHUNK_SYSTEM)} AS system_prompt, {q(head)} || text || {q(tail)} AS user_prompt FROM {source})"
    )


def simple_lines(select: str, rules: list[dict] = C.BUILTIN_RULES) -> str:
    return (
        with_(f"corpus AS MATERIALIZED ({select})", lines("corpus", "lines"), rule_rows(rules), regex_part(rules))
        + f"SELECT {PUBLIC} FROM regex_findings"
    )


KEPT_PATHS = (
    r"regexp_matches(path, '\.(js|ts|py|json)$') AND NOT regexp_matches(path, '(^|/)(node_modules|dist|test)/')"
)
SIGNATURE = "rule_id || '|' || path || '|' || line || '|' || snippet"


def rank(severity: str) -> str:
    return f"CASE {severity} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


def presets_sql() -> str:
    rows = []
    for p in C.PRESETS:
        groups = ", ".join(q(g) for g in p["enabled_groups"])
        test = "true" if "*" in p["enabled_groups"] else f"grp IN ({groups})"
        rows.append(
            f"SELECT {q(p['name'])} AS preset, (SELECT count(*) FROM rules WHERE {test}) AS rules,"
            f" (SELECT count(*) FROM findings f JOIN rules r ON f.rule_id = r.id WHERE {test}) AS findings"
        )
    return " UNION ALL ".join(rows)


def gate_sql() -> str:
    some = "(SELECT * FROM findings WHERE severity <> 'critical')"
    rows = [f"SELECT 'any' AS fail_on, count(*) > 0 AS failed FROM {some}"]
    rows += [
        f"SELECT {q(level)}, coalesce(bool_or({rank('severity')} >= {i + 1}), false) FROM {some}"
        for i, level in enumerate(C.SEVERITIES)
    ]
    return " UNION ALL ".join(rows)


ALL_RULES = [*C.BUILTIN_RULES, *INLINE_RULES]
FILTERED = [r for r in ALL_RULES if r.get("group") in ("secrets", "tls", "docs") and r["id"] not in ("SEC-210", "SEC-206")]
BALANCED = [r for r in C.BUILTIN_RULES if r["group"] in C.PRESETS[1]["enabled_groups"] and r["id"] != "SEC-002"]

JSON_FINDING = (
    "to_json({'ruleId': rule_id, 'description': description, 'severity': severity, 'file': path, 'line': line,"
    " 'codeSnippet': snippet, 'suggestion': suggestion})"
)
SARIF_PROPERTIES = (
    "json_merge_patch('{}', to_json({'confidence': v.confidence, 'needsReview': v.needs_review, 'category': v.category, 'fix': v.fix,"
    " 'attackScenario': v.attack_scenario, 'provider': 'compatible', 'model': 'm1', 'promptHash': v.prompt_hash}))"
)
LEVEL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END"


def optional_json(members: dict[str, str]) -> str:
    """A JSON object without the members that are null."""
    parts = [f"CASE WHEN {v} IS NULL THEN NULL ELSE '\"{k}\":' || to_json({v}) END" for k, v in members.items()]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


SARIF_RESULT = (
    "'{\"ruleId\":' || to_json(f.rule_id) || ',\"level\":' || to_json(" + LEVEL.replace("severity", "f.severity") + ") || ',\"message\":{\"text\":' ||"
    " to_json(f.description) || '},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":' || to_json(f.path) ||"
    " '},\"region\":{\"startLine\":' || coalesce(nullif(f.line, 0), 1) || '}}}]' ||"
    " CASE WHEN v.key_rule IS NULL THEN '' ELSE ',\"properties\":{\"llm\":' || "
    + optional_json(
        {
            "confidence": "v.confidence", "needsReview": "v.needs_review", "category": "v.category", "fix": "v.fix",
            "attackScenario": "v.attack_scenario", "provider": "'compatible'", "model": "'m1'", "promptHash": "v.prompt_hash",
        }
    )
    + " || '}' END || '}'"
)
JSON_REVIEW = optional_json(
    {
        "id": "id", "title": "title", "category": "category", "severity": "severity", "confidence": "confidence",
        "needsReview": "needs_review", "file": "path", "line": "line", "column": '"column"', "evidence": "evidence",
        "attackScenario": "attack_scenario", "fix": "fix", "safeAlternative": "safe_alternative",
        "relatedRuleIds": "related_rule_ids", "provider": "provider", "model": "model", "promptHash": "prompt_hash",
    }
)
NL = "chr(10)"


def md_part(before: str, column: str, after: str = "") -> str:
    return f"CASE WHEN coalesce({column}, '') <> '' THEN {q(before)} || {column} || {q(after)} || {NL} || {NL} ELSE '' END"


MD_FINDING = (
    "'### [' || upper(severity) || '] ' || rule_id || chr(10) || '**Description**: ' || description || chr(10) || chr(10) ||"
    " '**Place**: `' || path || ':' || line || '`' || chr(10) || chr(10) || '**Code**:' || chr(10) || '```' || chr(10) || snippet"
    " || chr(10) || '```' || chr(10) || chr(10) || '**Fix**: ' || suggestion || chr(10) || chr(10) || '---' || chr(10)"
)
MD_REVIEW = (
    "'### [' || upper(severity) || '] ' || title || chr(10) || '**Category**: ' || category || chr(10) || chr(10) ||"
    " '**Confidence**: ' || confidence || '; **Needs review**: ' || CASE WHEN needs_review THEN 'yes' ELSE 'no' END || chr(10) || chr(10) ||"
    " '**Place**: `' || path || ':' || coalesce(line, 0) || '`' || chr(10) || chr(10) || "
    + md_part("**Evidence**:\n```\n", "evidence", "\n```")
    + " || "
    + md_part("**Attack**: ", "attack_scenario")
    + " || "
    + md_part("**Fix**: ", "fix")
    + " || "
    + md_part("**Safer way**: ", "safe_alternative")
    + " || '---' || chr(10)"
)

DOCS = "SELECT 'docs/' || doc_id || '.py' AS path, text AS content FROM documents"
PAGES = "SELECT CAST(page_id AS VARCHAR) AS path, url || chr(10) || html AS content FROM pages"
TALKS = "SELECT conv_id || '/' || turn AS path, text AS content FROM conversations"


def all_review_parts() -> list[str]:
    parts = discovery_items()
    return [*parts, *review_items()]


def reviews_union() -> str:
    columns = REVIEW + ', "column", related_rule_ids'
    return f"(SELECT {columns} FROM discovery_reviews UNION ALL SELECT {columns} FROM review_records)"


BAD_DISCOVERY = "n % 3 <> 0 AND (n % 11 = 0 OR n % 13 = 0)"
BAD = "n % 3 <> 0 AND n % 11 = 0"

ORACLES: dict[str, str] = {
    "corpus_lines": with_(corpus(), lines("corpus", "lines")) + "SELECT path, line_no, line FROM lines",
    "corpus_lines_crlf": with_(corpus(), lines("corpus", "lines", crlf=True)) + "SELECT path, line_no, line FROM lines",
    "path_filtered_corpus": with_(corpus())
    + f"SELECT path, CAST(octet_length(encode(content)) AS INTEGER) AS n_bytes FROM corpus WHERE {KEPT_PATHS}",
    "deduped_paths": with_(corpus())
    + "SELECT path, CAST(octet_length(encode(content)) AS INTEGER) AS n_bytes FROM corpus WHERE ends_with(path, '.js') OR starts_with(path, 'src/')",
    "limited_files": with_(corpus()) + f"SELECT path FROM corpus ORDER BY path LIMIT {LIMIT}",
    "rules_by_preset": with_(*static()) + presets_sql(),
    "rules_by_engine": with_(*static())
    + "SELECT r.id, r.engine AS type, coalesce(r.pattern, r.target) AS looks_for, count(f.rule_id) AS n"
    " FROM rules r LEFT JOIN findings f ON f.rule_id = r.id GROUP BY ALL",
    "rules_filtered": with_(*static(FILTERED)) + f"SELECT {PUBLIC} FROM findings",
    "rule_pack_union": with_(corpus(), lines("corpus", "lines"), rule_rows(ALL_RULES), regex_part(ALL_RULES))
    + "SELECT rule_id, description, k1, count(*) AS n FROM regex_findings GROUP BY ALL",
    "regex_findings": with_(corpus(), lines("corpus", "lines"), rule_rows(C.BUILTIN_RULES), regex_part(C.BUILTIN_RULES))
    + "SELECT * FROM regex_findings",
    "regex_findings_raw_docs": simple_lines(DOCS),
    "regex_findings_conversations": simple_lines(TALKS, ALL_RULES),
    "http_urls_in_pages": simple_lines(PAGES),
    "suppressed_lines": with_(*static(marker=False))
    + f"SELECT rule_id, path, line, snippet, engine FROM findings WHERE {suppressed('snippet', 'rule_id')}",
    "call_sites": with_(corpus(), lines("corpus", "lines"))
    + "SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY place) - 1 AS INTEGER) AS call_no, line_no, callee,"
    f" line AS text FROM ({listed_calls()})",
    "call_findings": with_(*static()) + f"SELECT {PUBLIC} FROM call_findings",
    "static_findings": with_(*static()) + f"SELECT {PUBLIC}, phase, engine, k2 FROM findings",
    "first_findings_per_file": with_(*static())
    + "SELECT path, CAST(ordinal AS INTEGER) AS ordinal, rule_id, line, engine FROM (SELECT *, row_number() OVER"
    " (PARTITION BY path ORDER BY phase, engine, k1, k2) - 1 AS ordinal FROM findings) WHERE ordinal < 8",
    "findings_by_file": with_(*review_request_parts())
    + "SELECT path, CAST(count(*) AS INTEGER) AS n, string_agg(ordinal || ':' || rule_id || ':' || line, ' ' ORDER BY ordinal) AS items"
    " FROM placed WHERE ordinal < 8 GROUP BY path",
    "findings_by_group": with_(*static())
    + 'SELECT grp AS "group", f.severity, count(*) AS n FROM findings f JOIN rules r ON f.rule_id = r.id GROUP BY ALL',
    "custom_rules": with_(corpus(), lines("corpus", "lines"), rule_rows(P.CUSTOM_RULES_RE2), regex_part(P.CUSTOM_RULES_RE2))
    + "SELECT rule_id, path, line FROM regex_findings",
    "wide_rule_pack": with_(
        "corpus AS (SELECT 'docs/' || doc_id || '.py' AS path, text AS content FROM documents)",
        lines("corpus", "lines"),
        "kept AS MATERIALIZED (SELECT * FROM lines WHERE NOT contains(lower(line), 'scan-ignore'))",
        "words AS (SELECT DISTINCT path, line_no, lower(unnest(regexp_extract_all(line, '[A-Za-z0-9_]+'))) AS word FROM kept)",
        "rules(word) AS (SELECT unnest([" + ", ".join(q(r["id"][2:]) for r in P.WIDE_PACK[:-1]) + "]))",
    )
    + "SELECT 'W-' || word AS rule_id, path, line_no AS line FROM words JOIN rules USING (word)"
    + " UNION ALL SELECT 'TWICE', path, line_no FROM kept WHERE contains(lower(line), 'of o')",
    "file_scanner": with_(
        "corpus AS (SELECT 'docs/' || doc_id || '.py' AS path, text AS content FROM documents)",
        lines("corpus", "lines"),
        "failed AS (SELECT DISTINCT path FROM lines WHERE starts_with(line, 'Is '))",
    )
    + "SELECT path, 'T' AS rule_id, line_no AS line, line AS snippet, NULL AS reason FROM lines WHERE starts_with(line, 'T')"
    + " AND path NOT IN (SELECT path FROM failed) UNION ALL SELECT path, NULL, NULL, NULL, 'a line with Is' FROM failed",
    "parsed_baselines": "SELECT doc_id, 'S' || doc_id AS signature FROM documents WHERE doc_id % 5 < 3"
    " UNION ALL SELECT doc_id, 'T' FROM documents WHERE doc_id % 5 = 0",
    "parsed_rule_files": "SELECT CAST(doc_id AS VARCHAR) AS file, 'R' || doc_id AS id, 'low' AS severity, 'x' AS pattern,"
    " CAST(0 AS INTEGER) AS rule_ord FROM documents WHERE doc_id % 3 = 0"
    " UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Q', NULL, NULL, 2 FROM documents WHERE doc_id % 3 = 0",
    "stored_responses": "SELECT CAST(doc_id AS VARCHAR) AS prompt_hash, md5(text) AS raw_text, 'p' AS provider, 'new' AS model"
    " FROM documents WHERE length(text) % 5 <> 0",
    "iso_timestamps": "SELECT doc_id, strftime(make_timestamp(doc_id * 86461001000), '%Y-%m-%dT%H:%M:%S.%gZ') AS text FROM documents",
    "rejected_rule_files": "SELECT CAST(doc_id AS VARCHAR) AS file, CASE doc_id % 3 WHEN 0 THEN 'holds entries that are no rules' WHEN 1 THEN 'not JSON' ELSE 'no JSON array' END AS reason"
    " FROM documents",
    "latest_responses": "SELECT source AS prompt_hash, md5(arg_max(text, doc_id)) AS raw_text, 'p' AS provider,"
    " arg_max(lang, doc_id) AS model FROM documents GROUP BY source",
    "completed_requests": "SELECT CAST(doc_id AS VARCHAR) AS prompt_hash, CASE WHEN length(text) % 7 <> 0"
    " THEN lang || ':' || length(text) END AS raw_text, 'p' AS provider, 'm' AS model FROM documents",
    "baseline_signatures": with_(*static()) + f"SELECT {SIGNATURE} AS signature FROM findings",
    "new_since_baseline": with_(*static())
    + f"SELECT {PUBLIC} FROM (SELECT *, {SIGNATURE} AS known FROM findings) f"
    f" WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {SIGNATURE} AS old FROM findings WHERE severity <> 'high') b WHERE b.old = f.known)",
    "gate_by_threshold": with_(*static()) + gate_sql(),
    "gate_with_discovered": with_(*discovery_items())
    + "SELECT false AS counts_discovered, false AS failed UNION ALL SELECT true, count(*) > 0 FROM discovered",
    "scan_stats": with_(*static())
    + "SELECT (SELECT count(*) FROM documents) AS files_scanned, (SELECT count(*) FROM findings) AS issues_found",
    **{
        f"suspicious_lines_{m}": with_(*both_corpora(), lines("both_files", "crlf_lines", crlf=True), suspicious("crlf_lines", m, "wanted"))
        + "SELECT path, array_to_string(nums, ',') AS line_nos FROM wanted"
        for m in C.MAX_BLOCKS
    },
    **{
        f"evidence_blocks_{m}": with_(*both_corpora(), *block_parts(m, source="both_files")) + "SELECT * FROM blocks"
        for m in C.MAX_BLOCKS
    },
    "line_context": with_(corpus(), lines("corpus", "lines"), rule_rows(C.BUILTIN_RULES), regex_part(C.BUILTIN_RULES))
    + "SELECT rule_id, path, line, array_to_string(l[greatest(1, line - 2):least(len(l), line + 2)], chr(10)) AS around"
    " FROM regex_findings JOIN (SELECT path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM corpus) USING (path)",
    "finding_context": with_(corpus(), lines("corpus", "lines"), rule_rows(C.BUILTIN_RULES), regex_part(C.BUILTIN_RULES))
    + "SELECT rule_id, path, line, CASE WHEN line % 2 = 0 THEN snippet ELSE"
    " array_to_string(l[greatest(1, line - 2):least(len(l), line + 2)], chr(10)) END AS context"
    " FROM regex_findings JOIN (SELECT path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM corpus) USING (path)",
    "line_chunks": with_(*chunk_parts("chunk")) + "SELECT path, chunk_no, start_line, text FROM chunks",
    "discovery_requests": with_(corpus(), *request_parts()) + f"SELECT {REQUEST} FROM requests",
    "discovery_requests_unredacted": with_(corpus(), *request_parts("balanced", 2, "m1", False)) + f"SELECT {REQUEST} FROM requests",
    "discovery_requests_first_files": with_(
        corpus(),
        f"first_files AS MATERIALIZED (SELECT * FROM corpus WHERE {KEPT_PATHS} ORDER BY path LIMIT {LIMIT})",
        *request_parts("full", source="first_files"),
    )
    + "SELECT prompt_hash, path, user_prompt FROM requests",
    "review_requests": with_(*review_request_parts()) + f"SELECT {REQUEST} FROM review_requests",
    **{
        f"{kind}_requests": with_(*chunk_parts(kind)) + f"SELECT {REQUEST} FROM ({chunk_requests(kind)})"
        for kind in ("chunk", "intent")
    },
    "redacted_documents": with_(corpus())
    + f"SELECT path, {redacted('content')} AS content, {changed('content')} AS changed FROM corpus",
    "redacted_raw_documents": f"WITH corpus AS ({DOCS}) SELECT path, md5({redacted('content')}) AS content_md5, {changed('content')} AS changed FROM corpus",
    "pending_requests": with_(corpus(), *request_parts(), numbered("requests", "discovery", "asked"))
    + f"SELECT {REQUEST} FROM asked WHERE n % 3 = 0",
    "matched_responses": with_(corpus(), *request_parts(), numbered("requests", "discovery", "asked"))
    + "SELECT prompt_hash, path, CASE WHEN n % 3 <> 0 THEN raw_text END AS raw_text, n % 3 <> 0 AS cache_hit FROM asked",
    "discovered_findings": with_(*discovery_items()) + "SELECT * FROM discovered",
    "discovery_reviews": with_(*discovery_items()) + f"SELECT {REVIEW} FROM discovery_reviews",
    "review_records": with_(*review_items()) + f"SELECT {REVIEW} FROM review_records",
    "reviews_kept": with_(*discovery_items())
    + f"SELECT {REVIEW} FROM discovery_reviews v WHERE EXISTS (SELECT 1 FROM discovered f WHERE f.severity <> 'low' AND f.path = v.path"
    f" AND f.rule_id = 'LLM-DISC-' || {SLUG.replace('category', 'v.category')} AND coalesce(f.line, 0) = coalesce(v.line, 0))",
    "last_reviews": with_(*review_items()) + "SELECT key_rule, key_path, key_line, title, category, severity, ord FROM last_reviews",
    "attached_reviews": with_(*review_items())
    + "SELECT f.rule_id, f.path, f.line, v.category, v.ord FROM long_findings f LEFT JOIN last_reviews v"
    " ON v.key_rule = f.rule_id AND v.key_path = f.path AND v.key_line = f.line",
    "review_stats": with_(corpus(), *request_parts(), numbered("requests", "discovery", "asked"))
    + f"SELECT count(*) AS calls, count(*) AS cache_hits, count(*) FILTER ({BAD_DISCOVERY}) AS failures FROM asked WHERE n % 3 <> 0",
    "summed_stats": with_(*review_request_parts(), numbered("review_requests", "review", "review_asked"), *chunk_parts("chunk")[1:])
    + "SELECT count(*) AS calls, count(*) AS cache_hits, count(*) FILTER (n % 11 = 0) AS failures FROM"
    " (SELECT n FROM review_asked UNION ALL SELECT n FROM chunk_asked) WHERE n % 3 <> 0",
    "chunk_findings": with_(*chunk_parts("chunk"))
    + """SELECT rule_id, description, severity, path, CAST(start_line + off AS INTEGER) AS line, CAST(NULL AS INTEGER) AS "column",
      array_to_string(chunk_lines[greatest(0, off - 3) + 1:least(len(chunk_lines), off + 4)], chr(10)) AS snippet, suggestion,
      confidence, 0 AS phase, 2 AS engine, chunk_no AS k1, k2 FROM
      (SELECT *, 'SEC-X' AS rule_id, 'D' || n AS description, 'high' AS severity, n % 50 AS off, 'S' AS suggestion,
         CASE n % 3 WHEN 1 THEN 0.25 ELSE 0.5 END :: DOUBLE AS confidence, 0 AS k2 FROM chunk_asked
       UNION ALL SELECT *, 'SEC-Y', 'E', 'low', 0, NULL, 0.7 :: DOUBLE, 1 FROM chunk_asked WHERE n % 4 = 0)
      WHERE n % 3 <> 0 AND n % 11 <> 0""",
    "intent_verdicts": with_(*chunk_parts("intent"))
    + f"""SELECT path, chunk_no, start_line, upper({P.VERDICT}) AS verdict, n % 2 = 0 AS intent_mismatch, false AS deception_detected,
      CAST(NULL AS BOOLEAN) AS social_engineering, CASE WHEN n % 3 <> 0 THEN 'R' || n END AS reasoning
      FROM chunk_asked WHERE n % 3 <> 0 AND n % 11 <> 0""",
    "bad_replies": with_(
        corpus(), *request_parts(), numbered("requests", "discovery", "asked"),
        *review_request_parts(), numbered("review_requests", "review", "review_asked"), *chunk_parts("chunk")[1:],
        f"chunk_hashed AS ({chunk_requests('chunk', 'chunk_asked')})",
    )
    + f"SELECT prompt_hash, path, kind, substr(raw_text, 1, 500) AS raw_start FROM asked WHERE {BAD_DISCOVERY}"
    f" UNION ALL SELECT prompt_hash, path, kind, substr(raw_text, 1, 500) FROM review_asked WHERE {BAD}"
    f" UNION ALL SELECT prompt_hash, path, kind, substr(raw_text, 1, 500) FROM chunk_hashed WHERE {BAD}",
    "sarif_results": with_(*review_items())
    + f"SELECT f.phase, f.path, f.engine, f.k1, f.k2, {SARIF_RESULT} AS json FROM long_findings f LEFT JOIN last_reviews v"
    " ON v.key_rule = f.rule_id AND v.key_path = f.path AND v.key_line = f.line",
    "sarif_rules": with_(*discovery_items(), *static()[1:])
    + """SELECT rule_id, description, '{"id":' || to_json(rule_id) || ',"name":' || to_json(rule_id) || ',"shortDescription":{"text":' ||
      to_json(description) || '}}' AS json FROM (SELECT rule_id, arg_min(description, row(phase, path, engine, k1, k2)) AS description FROM
      (SELECT * FROM findings UNION ALL SELECT * FROM discovered) GROUP BY rule_id)""",
    "json_findings": with_(*static()) + f"SELECT path, CAST({JSON_FINDING} AS VARCHAR) AS json FROM findings",
    "json_reviews": with_(*all_review_parts())
    + f"SELECT stage AS phase, path, 0 AS engine, ord AS k1, 0 AS k2, {JSON_REVIEW} AS json FROM {reviews_union()}",
    "markdown_rows": with_(*static()) + f"SELECT path, {MD_FINDING} AS markdown FROM findings",
    "markdown_reviews": with_(*all_review_parts())
    + f"SELECT stage AS phase, path, 0 AS engine, ord AS k1, 0 AS k2, {MD_REVIEW} AS markdown FROM {reviews_union()}",
    "report_counts": with_(*discovery_items(), *static()[1:])
    + "SELECT (SELECT count(*) FROM findings) + (SELECT count(*) FROM discovered) AS issues_found,"
    " (SELECT count(*) FROM discovery_reviews) AS reviews",
    "severity_functions": f"""SELECT event_type, n, severity, {rank('severity')} AS rank, {OR_LOW} AS or_low,
      CASE WHEN severity IN ('low', 'medium', 'high', 'critical') THEN severity END AS or_null, {LEVEL} AS sarif,
      {rank('severity')} >= 3 AS at_least_high, 'LLM-DISC-' || upper(event_type) AS slug
      FROM (SELECT event_type, count(*) AS n, ['low', 'medium', 'high', 'critical', 'odd'][count(*) % 5 + 1] AS severity FROM events GROUP BY 1)""",
    "path_functions": with_(corpus())
    + f"""SELECT path, page_id, {EXT} AS extension, regexp_matches(path, '[^/]\\.(ts|tsx|js|jsx)$', 'i') AS script,
      sha1(path || '|c|T|' || coalesce(CAST(page_id AS VARCHAR), '') || '|') AS id FROM
      (SELECT url AS path, page_id FROM pages UNION ALL SELECT path, NULL FROM corpus)""",
    "reviewed_scan": with_(*discovery_items(), *static()[1:])
    + """SELECT 'finding' AS kind, rule_id, severity, count(*) AS n FROM (SELECT rule_id, severity FROM findings
      UNION ALL SELECT rule_id, severity FROM discovered) GROUP BY ALL
      UNION ALL SELECT 'record', 'LLM-DISC-' || """
    + SLUG
    + """ AS rule_id, severity, count(*) FROM discovery_reviews GROUP BY ALL""",
    "full_scan": with_(
        f"corpus AS MATERIALIZED (SELECT * FROM ({P.corpus_sql()}) WHERE {KEPT_PATHS})", *static(C.BUILTIN_RULES)[1:],
    )
    + f"""SELECT rule_id, severity, count(*) AS n FROM findings f WHERE f.severity = 'high'
      AND rule_id IN ({', '.join(q(r['id']) for r in BALANCED)}) GROUP BY ALL""",
}
