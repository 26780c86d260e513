"""One context bundle as Markdown, JSON or plain text, on the driver."""

from __future__ import annotations

import json
import re

_HINTS = {"cpp": "cpp", "java": "java"}


def confidence_label(c: float) -> str:
    return "resolved/high" if c >= 0.9 else "strong heuristic" if c >= 0.6 else "weak heuristic" if c >= 0.3 else "low confidence"


def fence(text: str) -> str:
    """Longer than any run of backticks inside."""
    return "`" * max(3, 1 + max((len(r) for r in re.findall("`+", text)), default=0))


def _place(item: dict) -> str:
    if not item.get("file"):
        return item["kind"]
    lines = item.get("line_range")
    return item["file"] + (f":{lines[0]}" + (f"-{lines[1]}" if lines[1] != lines[0] else "") if lines else "")


def _mapping(m: dict) -> list[str]:
    return [f"- {k}: {f'{v:g}' if isinstance(v, float) else v}" for k, v in sorted(m.items())] or ["- none"]


def to_markdown(bundle: dict) -> str:
    out = ["# Context", "", "## Query", *_mapping(bundle["query"]), "", "## Anchor", *_mapping(bundle["anchor"]), "", "## Index", *_mapping(bundle["index_health"]), "", "## Items"]
    for i in bundle["items"]:
        mark = fence(i["text"])
        hint = _HINTS.get(i.get("language") or "", "")
        out += ["", f"### {i['rank']}. {i['kind']}: {_place(i)}", f"- score: {i['score']:g}, tokens: {i['token_estimate']}, confidence: {i['confidence']:g} ({confidence_label(i['confidence'])})", f"{mark}{hint}", i["text"].rstrip("\n"), mark]
    out += ["", "## Scores"]
    for i in bundle["items"]:
        out += [f"- {i['rank']}: " + ", ".join(f"{k} {v:g}" for k, v in sorted(i["score_trace"].items()))]
    out += ["", "## Omitted", *([f"- {o['name']}: {o['reason']} ({o['score']:g})" for o in bundle["omitted"]] or ["- none"])]
    out += ["", "## Uncertainty", *([f"- {n}" for n in bundle["uncertainty_notes"]] or ["- none"]), "", "## Trace", *([f"- {json.dumps(t, sort_keys=True)}" for t in bundle["trace"]] or ["- none"])]
    return "\n".join(out) + "\n"


def to_json(bundle: dict) -> str:
    return json.dumps(bundle, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def to_text(bundle: dict) -> str:
    out = [f"Context for {bundle['anchor'].get('file')}", ""]
    for i in bundle["items"]:
        out += [f"[{i['rank']}] {i['kind']} {_place(i)} score={i['score']:g} tokens={i['token_estimate']}", i["text"].rstrip("\n"), ""]
    out += [f"omitted {o['name']}: {o['reason']}" for o in bundle["omitted"]] + [f"note: {n}" for n in bundle["uncertainty_notes"]]
    return "\n".join(out).rstrip("\n") + "\n"


RENDERERS = {"markdown": to_markdown, "json": to_json, "text": to_text}
