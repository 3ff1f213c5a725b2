"""robots.txt: groups of rules, and the decision for one agent and path."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.text import trim, units

_COMMENT = re.compile(r"#[^\n\r\u2028\u2029]*\Z")
_ANY = r"[^\n\r\u2028\u2029]*"


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    #: ("allow" or "disallow", path pattern)
    rules: list[tuple[str, str]] = field(default_factory=list)


def parse_robots(body: str) -> list[Group]:
    groups: list[Group] = []
    for raw in body.split("\n"):
        name, colon, value = trim(_COMMENT.sub("", raw, count=1)).partition(":")
        if not colon:
            continue
        name, value = trim(name).lower(), trim(value)
        if name == "user-agent":
            # agents gather until the first rule of their group
            if not groups or groups[-1].rules:
                groups.append(Group())
            groups[-1].agents.append(value.lower())
        elif name in ("allow", "disallow"):
            if not groups:
                groups.append(Group(["*"]))
            if value:
                groups[-1].rules.append((name, value))
    return groups


def group_for(groups: list[Group], agent: str) -> Group | None:
    """The first group that names the agent, either name within the other; else the last group for all."""
    agent = agent.lower()
    for g in groups:
        if any(a != "*" and (a in agent or agent in a) for a in g.agents):
            return g
    return next((g for g in reversed(groups) if "*" in g.agents), None)


def path_regex(pattern: str) -> str:
    """'*' stands for anything, a final '$' for the end; otherwise a prefix.

    Each piece between stars is taken at its first place and kept (an atomic group), which loses no match
    and never backtracks; only a piece before the end is tried at the last place.
    """
    end = pattern.endswith("$")
    first, *rest = (pattern[:-1] if end else pattern).split("*")
    out = "^" + re.escape(first)
    last = [rest.pop()] if end and rest else []
    out += "".join(f"(?>{_ANY}?{re.escape(x)})" for x in rest if x)
    return out + "".join(_ANY + re.escape(x) for x in last) + (r"\Z" if end else "")


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(path_regex(pattern))


def specificity(pattern: str) -> int:
    return units(pattern.replace("*", "").replace("$", ""))


def is_allowed(groups: list[Group], agent: str, path: str) -> bool:
    """The longest fitting pattern decides; an allow wins a tie; without any, access is free."""
    g = group_for(groups, agent)
    fitting = [(specificity(p), kind == "allow") for kind, p in (g.rules if g else []) if _compiled(p).search(path)]
    return max(fitting)[1] if fitting else True
