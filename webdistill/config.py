"""Options, configuration files and their merging."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from .kernel.distill import ExtractOptions
from .kernel.render import MarkdownOptions

DEFAULT_FILE = "webdistill.config.json"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class SiteRule:
    """Applies to pages whose URL contains `url`, or that the regular expression finds."""

    url: str | re.Pattern
    remove: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    select: str | None = None

    def fits(self, url: str) -> bool:
        return self.url in url if isinstance(self.url, str) else bool(self.url.search(url))


@dataclass(frozen=True)
class Options:
    """None is unset everywhere."""

    char_threshold: int | None = None
    top_candidates: int | None = None
    keep_images: bool | None = None
    respect_robots: bool | None = None
    force: bool | None = None
    remove: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    select: str | None = None
    markdown: dict[str, str] = field(default_factory=dict)
    site_rules: tuple[SiteRule, ...] = ()

    def extract(self) -> ExtractOptions:
        given = {k: getattr(self, k) for k in ("char_threshold", "top_candidates", "keep_images") if getattr(self, k) is not None}
        return ExtractOptions(**given, remove=self.remove, include=self.include, select=self.select or None, markdown=MarkdownOptions.of(**self.markdown))


#: Keys of the file and what they are called here.
_KEYS = {
    "charThreshold": "char_threshold", "nTopCandidates": "top_candidates", "keepImages": "keep_images",
    "respectRobotsTxt": "respect_robots", "remove": "remove", "include": "include", "select": "select",
}
_STYLE_KEYS = {re.sub(r"_(\w)", lambda m: m[1].upper(), n): n for n in MarkdownOptions.names()}


def read_config(path: str | Path | None = None, folder: str | Path = ".") -> dict[str, Any] | None:
    """The file's object; without a path that of the default file in folder, or None if there is none."""
    file = Path(path) if path else Path(folder) / DEFAULT_FILE
    file = file.resolve()
    if not path and not file.exists():
        return None
    try:
        text = file.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"Failed to read config file: {file}") from e
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ConfigError(f"Invalid JSON in config file: {file}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"Config file must contain a JSON object: {file}")
    return found


def options_of(config: dict[str, Any] | None) -> Options:
    """A configuration file's object as options; unknown keys are ignored."""
    config = config or {}
    given: dict[str, Any] = {ours: config[k] for k, ours in _KEYS.items() if config.get(k) is not None}
    for k in ("remove", "include"):
        given[k] = tuple(given.get(k, ()))
    given["markdown"] = {_STYLE_KEYS[k]: v for k, v in (config.get("converter") or {}).items() if k in _STYLE_KEYS and v is not None}
    given["site_rules"] = tuple(
        SiteRule(r["url"], tuple(r.get("remove") or ()), tuple(r.get("include") or ()), r.get("select") or None) for r in config.get("siteRules") or ()
    )
    return Options(**given)


def merge(config: Options, options: Options) -> Options:
    """Options win; lists are joined, options first; styles are merged one by one."""
    out = {}
    for f in fields(Options):
        low, high = getattr(config, f.name), getattr(options, f.name)
        if f.name == "markdown":
            out[f.name] = {**low, **high}
        elif isinstance(low, tuple):
            out[f.name] = (*high, *low)
        else:
            out[f.name] = low if high is None else high
    return Options(**out)


def resolve_for(url: str | None, options: Options) -> Options:
    """Options for one page: what all fitting site rules add, and the first selection among them."""
    fitting = [r for r in options.site_rules if url is not None and r.fits(url)]
    select = options.select or next((r.select for r in fitting if r.select), None)
    return replace(
        options, select=select, remove=options.remove + tuple(x for r in fitting for x in r.remove),
        include=options.include + tuple(x for r in fitting for x in r.include), site_rules=(),
    )


def write_config(path: str | Path, changes: dict[str, Any]) -> dict[str, Any]:
    """Merge changes over the file's present object and write it; an unreadable file is started afresh."""
    try:
        present = read_config(path) or {}
    except ConfigError:
        present = {}
    present.update({k: v for k, v in changes.items() if v is not None})
    Path(path).write_text(json.dumps(present, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return present
