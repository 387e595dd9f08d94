"""Text helpers that run on the driver: URL templates of online tools, tree labels."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class OnlineTool:
    label: str
    url: str
    formats: tuple[str, ...]


def parse_online_tool(setting: str) -> OnlineTool:
    """label;url;formats, the formats separated by commas; label and formats may be missing."""
    parts = [p.strip() for p in setting.split(";")]
    if len(parts) == 1:
        return OnlineTool(parts[0], parts[0], ())
    formats = tuple(f.strip() for f in parts[2].split(",") if f.strip()) if len(parts) > 2 else ()
    return OnlineTool(parts[0] or parts[1], parts[1], formats)


def expand_url(template: str, files: list[str]) -> str | None:
    """Fill each {ext1|ext2} with the first of the files that has one of the extensions, in their order.

    A query parameter whose placeholder no file fits is left out; where another placeholder isn't met, there is no URL.
    """

    def fill(text: str) -> str | None:
        for m in re.findall(r"\{([^{}]*)\}", text):
            found = next((f for ext in m.split("|") for f in files if f.endswith("." + ext.strip().lstrip("."))), None)
            if found is None:
                return None
            text = text.replace("{" + m + "}", found, 1)
        return text

    head, mark, query = template.partition("?")
    head = fill(head)
    if head is None:
        return None
    kept = [p for p in map(fill, query.split("&")) if p is not None] if mark else []
    return head + ("?" + "&".join(kept) if kept else "")
