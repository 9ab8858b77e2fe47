"""Rule files: recording rules of the usual YAML files and of dashboard exports, and previews of exported expression graphs.

Nothing is written: an import gives groups that `rules.record_group` takes, and a list of what it left out and why.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.units import duration_ns
from ..plans.promql_parser import QueryError, parse
from .rules import evaluate_graph

MOST_BYTES, MOST_GROUPS, MOST_RULES = 262_144, 64, 1024
MINUTE = 60 * 10**9
_GROUP_FIELDS = {"name", "interval", "query_offset", "limit", "labels", "rules"}


class ImportError_(ValueError):
    """A file that holds no rule groups."""


@dataclass
class Group:
    name: str
    cadence: int  # ns
    rules: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)  # name, query, labels: as record_group takes them


def _document(text: str) -> dict:
    if len(text.encode()) > MOST_BYTES:
        raise ImportError_("too large")
    try:
        out = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ImportError_("YAML needs a YAML parser") from e
        try:
            out = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ImportError_("neither JSON nor YAML") from e
    if not isinstance(out, dict) or not isinstance(out.get("groups"), list) or len(out["groups"]) > MOST_GROUPS:
        raise ImportError_("no groups")
    return out


def import_rules(text: str) -> tuple[list[Group], list[dict]]:
    """Groups of recording rules, and what was skipped: {group, rule, reason}."""
    groups, skipped = [], []
    for g in _document(text)["groups"]:
        if not isinstance(g, dict) or not isinstance(g.get("name"), str) or not isinstance(g.get("rules"), list) or len(g["rules"]) > MOST_RULES:
            raise ImportError_("a group needs a name and rules")
        exported = any(isinstance(r, dict) and (isinstance(r.get("record"), dict) or "data" in r) for r in g["rules"])
        found = []
        for r in g["rules"]:
            rule, reason = (_exported if exported else _plain)(r, g)
            if reason:
                skipped.append({"group": g["name"], "rule": _title(r), "reason": reason})
            else:
                found.append(rule)
        reason = None if exported else _unsupported(g)
        if found and reason:
            skipped.append({"group": g["name"], "rule": None, "reason": reason})
        elif found:
            groups.append(Group(g["name"], _cadence(g.get("interval")), found))
    if len({g.name for g in groups}) != len(groups):
        raise ImportError_("groups need names of their own")
    return groups, skipped


def _title(r) -> str | None:
    return next((str(r[k]) for k in ("alert", "title", "record") if isinstance(r, dict) and isinstance(r.get(k), str)), None)


def _cadence(interval) -> int:
    try:
        return MINUTE if interval is None else int(interval * 10**9) if isinstance(interval, int | float) else duration_ns(str(interval))
    except ValueError as e:
        raise ImportError_("bad interval") from e


def _unsupported(g: dict) -> str | None:
    if set(g) - _GROUP_FIELDS:
        return "unsupported_group_field"
    if g.get("query_offset", "0s") not in ("0s", "0", 0):
        return "query_offset_unsupported"
    return "limit_unsupported" if g.get("limit", 0) else None


def _checked(name: str, query: str, labels: dict) -> tuple[tuple | None, str | None]:
    try:
        parse(query)
    except (QueryError, ValueError):
        return None, "invalid_expression"
    return (name, query, {str(k): str(v) for k, v in labels.items()}), None


def _plain(r, g: dict) -> tuple[tuple | None, str | None]:
    if not isinstance(r, dict) or "alert" in r:
        return None, "alerting_rule"
    if not isinstance(r.get("record"), str) or "expr" not in r or set(r) - {"record", "expr", "labels"}:
        return None, "unsupported_rule_field"
    return _checked(r["record"], str(r["expr"]), {**(g.get("labels") or {}), **(r.get("labels") or {})})


def _exported(r, g: dict) -> tuple[tuple | None, str | None]:
    """A recording rule of an export: a single instant query whose result is recorded."""
    if not isinstance(r, dict) or not isinstance(r.get("record"), dict):
        return None, "alerting_rule"
    data = r.get("data") or []
    if len(data) != 1 or data[0].get("refId") != r["record"].get("from"):
        return None, "not_a_single_query"
    model = data[0].get("model") or {}
    if not isinstance(model.get("expr"), str) or model.get("range") or model.get("instant") is False:
        return None, "not_an_instant_query"
    return _checked(str(r["record"].get("metric")), model["expr"], r.get("labels") or {})


#: The datasource of expressions in exports; a fixed value.
EXPRESSIONS = "__expr__"


def graph_nodes(rule: dict) -> tuple[dict[str, dict], str]:
    """Nodes for `rules.evaluate_graph`, and the name of the condition, of an exported alert rule."""
    nodes: dict[str, dict] = {}
    for d in rule.get("data") or []:
        name, model = d["refId"], d.get("model") or {}
        if d.get("datasourceUid") != EXPRESSIONS:
            nodes[name] = {"kind": "source", "language": d.get("datasourceUid"), "query": model.get("expr")}
        elif model.get("type") == "reduce" and model.get("reducer") == "last":
            nodes[name] = {"kind": "reduce", "of": model["expression"].strip("${}")}
        elif model.get("type") == "math":
            nodes[name] = {"kind": "math", "expression": model["expression"]}
        elif model.get("type") == "threshold":
            test = model["conditions"][0]["evaluator"]
            nodes[name] = {"kind": "threshold", "of": model["expression"].strip("${}"), "op": test["type"], "limit": float(test["params"][0])}
        else:
            raise ImportError_(f"node {name} is of an unknown kind")
    if rule.get("condition") not in nodes:
        raise ImportError_("the condition is no node")
    return nodes, rule["condition"]


def preview(rule: dict, sources: Callable[[str, str], DataFrame]) -> DataFrame:
    """labels, key, value of an exported rule's condition, evaluated once; sources(datasource, query) gives its inputs. Nothing is stored or fired."""
    nodes, condition = graph_nodes(rule)
    return evaluate_graph(nodes, sources)[condition]
