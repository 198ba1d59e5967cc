"""Call sites of scripts and the rules that name them."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import catalogue as C
from siftline.functions.script import calls_in, line_of, line_starts
from siftline.functions.text import is_script
from siftline.operators.match import CALL_ENGINE, findings_of
from siftline.sources.local import table_of

SEARCHED = 500  # names that texts are searched for before they are read; with more all scripts are read
_CALLS = "array<struct<call_no:int,line_no:int,callee:string,text:string,tests:array<int>>>"


def find_sites(content: Column, script: Column, names: list[str] | None) -> Column:
    """Calls in the texts that are scripts, as ``array<struct<call_no, line_no, callee, text, tests>>``.

    With ``names`` those whose callee is one of them or ends in one after a dot;
    ``tests`` are the places of these names in the list.
    """
    wanted, by_last = r"\(", {}
    for i, name in enumerate(names or []):
        by_last.setdefault(name.rsplit(".", 1)[-1], []).append((i, name))
    if 0 < len(by_last) <= SEARCHED:  # a name as a word of its own, then what may stand between it and its arguments
        wanted = r"(?:^|[^A-Za-z0-9_$#])(?:" + "|".join(re.escape(n) for n in by_last) + r")\s*[(?<!/]"

    @F.arrow_udf(_CALLS)
    def find(texts: pa.Array, scripts: pa.Array) -> pa.Array:
        worth = pc.and_(scripts, pc.match_substring_regex(texts, wanted)).to_pylist()
        sites = [_sites(t.as_py()) if w else [] for t, w in zip(texts, worth)]
        return pa.array(sites, pa.list_(_SITE))

    def _sites(text: str) -> list[dict]:
        starts = line_starts(text)
        lines: dict[int, str] = {}
        rows = []
        for number, call in enumerate(calls_in(text)):
            tests = [] if names is None else [i for i, n in by_last.get(call.last_name, ()) if call.targets(n)]
            if names is None or tests:
                line = line_of(starts, call.start)
                if line not in lines:  # calls on one line share its text
                    end = text.find("\n", call.start)
                    lines[line] = text[starts[line - 1] : end if end >= 0 else len(text)]
                rows.append({"call_no": number, "line_no": line, "callee": call.callee, "text": lines[line], "tests": tests})
        return rows

    return find.asNondeterministic()(content, script)  # see find_lines


_SITE = pa.struct([("call_no", pa.int32()), ("line_no", pa.int32()), ("callee", pa.string()), ("text", pa.string()), ("tests", pa.list_(pa.int32()))])


def call_sites(corpus: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, call_no, line_no, callee, text) of the calls in script files.

    ``call_no`` counts the calls of a file, outer before inner; ``line_no`` and
    ``text`` give the line the call expression starts on.  With ``names`` only
    calls whose callee is one of them or ends in one after a dot are listed, and texts
    without any are passed over unread.
    """
    scripts = corpus.filter(is_script(F.col("path")))
    return scripts.select("path", F.inline(find_sites(F.col("content"), F.lit(True), names))).drop("tests")


def calls_target(callee: Column, target: Column) -> Column:
    """The callee is the target or ends in it after a dot."""
    return (callee == target) | callee.endswith(F.concat(F.lit("."), target))


def call_rules(rules: list[dict]) -> list[tuple[int, dict, str]]:
    """(rule number, rule, target) of the rules that name a call."""
    calls = [(k, r) for k, r in enumerate(rules) if r["type"] == "ast" and (r.get("selector") or "").startswith("call:")]
    return [(k, r, target) for k, r in calls if (target := r["selector"].removeprefix("call:"))]


def with_selectors(sites: DataFrame, targets: list[str]) -> DataFrame:
    """``sites`` with ``test``, the number of a target that the callee is or ends in; a row for each such target.

    Callees meet targets by their last name; the rest of a dotted target is compared then.
    """
    rows = [{"last": t.rsplit(".", 1)[-1], "target": t, "test": i} for i, t in enumerate(targets)]
    # the selectors of a rule pack, whose size the caller bounds
    named = F.broadcast(table_of(sites.sparkSession, rows, "last string, target string, test int"))
    found = sites.withColumn("last", F.substring_index("callee", ".", -1)).join(named, "last")
    return found.where(calls_target(F.col("callee"), F.col("target"))).drop("last", "target")


def match_calls(sites: DataFrame, rules: list[dict], marker: str = C.IGNORE_MARKER) -> DataFrame:
    """Findings of call rules on call sites; the marker is looked for on the start line."""
    selectors = call_rules(rules)
    found = with_selectors(sites, [t for _, _, t in selectors]).select("path", "call_no", "line_no", "text", "test")
    numbered = [(k, r) for k, r, _ in selectors]
    return findings_of(found, numbered, marker, F.lit(CALL_ENGINE), F.col("call_no"), F.col("rule_no"))


def scan_calls(corpus: DataFrame, rules: list[dict], marker: str = C.IGNORE_MARKER) -> DataFrame:
    """Findings of all call rules: one per call and rule."""
    targets = sorted({t for _, _, t in call_rules(rules)})
    if not targets:
        return match_calls(call_sites(corpus.limit(0)), [{"id": "", "type": "ast", "selector": "call:x"}], marker)
    return match_calls(call_sites(corpus, targets), rules, marker)
