"""The four tools for single pages: convert, select, select as Markdown, configuration.  Plain functions, fetch injected."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import urlsplit

from .config import Options, merge, options_of, read_config, resolve_for, write_config
from .kernel.distill import Page, distill
from .kernel.dom import parse
from .kernel.render import MarkdownOptions, Renderer
from .kernel.robots import is_allowed, parse_robots
from .kernel.select import select_all
from .kernel.serialize import to_html
from .sources.pages import AGENT, Fetch, fetch_one, fetch_robots, urllib_fetch


class Blocked(RuntimeError):
    pass


def robots_allow(url: str, fetch: Fetch = urllib_fetch) -> bool:
    at = urlsplit(url)
    path = (at.path or "/") + (f"?{at.query}" if at.query else "")
    return is_allowed(parse_robots(fetch_robots(f"{at.scheme}://{at.netloc}", fetch)), AGENT, path)


def to_markdown(url: str, options: Options | None = None, *, config: str | None = None, fetch: Fetch = urllib_fetch) -> tuple[Page, bool]:
    """The distilled page and whether robots.txt forbids it; forbidden pages raise unless forced."""
    o = merge(options_of(read_config(config)), options or Options())
    blocked = bool(o.respect_robots) and not robots_allow(url, fetch)
    if blocked and not o.force:
        raise Blocked(f"Blocked by robots.txt: {url}\nUse force to override.")
    return distill(fetch_one(url, fetch), resolve_for(url, o).extract()), blocked


def convert(url: str, options: Options | None = None, *, config: str | None = None, fetch: Fetch = urllib_fetch) -> str:
    page, _ = to_markdown(url, options, config=config, fetch=fetch)
    lines = [head + value for head, value in (("# ", page.title), ("Author: ", page.byline), ("Site: ", page.site_name)) if value]
    return "\n".join(lines) + "\n\n---\n\n" + page.markdown if lines else page.markdown


def _listed(parts: list[str], selector: str, gap: str) -> str:
    return f'Found {len(parts)} element(s) matching "{selector}":\n\n' + gap.join(parts) if parts else f"No elements matched selector: {selector}"


def select(url: str, selector: str, *, fetch: Fetch = urllib_fetch) -> str:
    tree = parse(fetch_one(url, fetch))
    return _listed([f"[{i}] {to_html(tree, x)}" for i, x in enumerate(select_all(tree, 0, selector), 1)], selector, "\n\n")


def select_markdown(url: str, selector: str, markdown: MarkdownOptions | None = None, *, fetch: Fetch = urllib_fetch) -> str:
    tree, renderer = parse(fetch_one(url, fetch)), Renderer(markdown)
    return _listed([f"[{i}]\n{renderer.render(tree, x)}" for i, x in enumerate(select_all(tree, 0, selector), 1)], selector, "\n\n---\n\n")


def configure(path: str | Path, changes: dict | None = None) -> str:
    """The configuration as JSON, after the changes if there are any."""
    return json.dumps(write_config(path, changes) if changes else read_config(path) or {}, indent=2, ensure_ascii=False)
