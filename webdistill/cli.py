"""python -m webdistill: one page from a URL, a file or standard input to Markdown."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__
from .config import Options, merge, options_of, read_config
from .kernel.distill import distill
from .kernel.render import MarkdownOptions
from .sources.pages import Fetch, urllib_fetch
from .tools import to_markdown


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webdistill", description=__doc__)
    p.add_argument("input", nargs="?")
    p.add_argument("-v", "--version", action="version", version=__version__)
    p.add_argument("-o", "--output")
    p.add_argument("-c", "--config")
    p.add_argument("--heading-style")
    p.add_argument("--bullet-marker")
    p.add_argument("--stdin", action="store_true")
    p.add_argument("--respect-robots-txt", action="store_true", default=None)
    p.add_argument("-f", "--force", action="store_true", default=None)
    p.add_argument("--remove", action="append", default=[])
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--select")
    return p


def main(argv: list[str] | None = None, fetch: Fetch = urllib_fetch) -> int:
    p = parser()
    a = p.parse_args(argv)
    styles = {"heading_style": a.heading_style, "bullet_list_marker": a.bullet_marker}
    allowed = MarkdownOptions._ALLOWED
    # values outside the lists are ignored
    styles = {k: v for k, v in styles.items() if v in allowed[k]}
    given = Options(remove=tuple(a.remove), include=tuple(a.include), select=a.select, markdown=styles, respect_robots=a.respect_robots_txt, force=a.force)
    try:
        if a.input and a.input.startswith(("http://", "https://")) and not a.stdin:
            page, blocked = to_markdown(a.input, given, config=a.config, fetch=fetch)
            if blocked:
                print(f"webdistill: robots.txt disallows access to {a.input} (proceeding with --force)", file=sys.stderr)
        elif a.input or a.stdin:
            html = sys.stdin.buffer.read().decode("utf-8", "replace") if a.stdin else Path(a.input).read_text(encoding="utf-8", errors="replace")
            page = distill(html, merge(options_of(read_config(a.config)), given).extract())
        else:
            p.print_help()
            return 1
        if a.output:
            Path(a.output).write_text(page.markdown, encoding="utf-8")
        else:
            sys.stdout.write(page.markdown)
    except Exception as e:
        print(f"webdistill: {e}", file=sys.stderr)
        return 1
    return 0
