"""Walks of nested data of any depth: generators that yield strings or other generators, run with a stack of their own."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

#: Fixed value: the schemes that an address may have.
SCHEMES = {"http", "https", "ftp", "ftps", "mailto", "news", "irc", "irc6", "ircs", "gopher", "nntp", "feed", "telnet", "mms", "rtsp", "sms", "svn", "tel", "fax", "xmpp", "webcal", "urn"}
_UNSEEN = re.compile(r"[\x00-\x20\x7f-\xa0\xad\u200b-\u200f\u2028-\u202e\u2060\ufeff]+")
_SCHEME = re.compile(r"([^/?#:]*):")


def flat(walk: Iterator) -> Iterator:
    """What a generator and the generators that it yields yield, in order."""
    stack = [walk]
    while stack:
        for x in stack[-1]:
            if isinstance(x, Iterator):
                stack.append(x)
                break
            yield x
        else:
            stack.pop()


def joined(walk: Iterator) -> str:
    return "".join(flat(walk))


def safe_address(address: str) -> bool:
    """Whether an address is relative or has one of SCHEMES, once what browsers don't see in it is taken out."""
    found = _SCHEME.match(_UNSEEN.sub("", address))
    return found is None or found[1].lower() in SCHEMES


def parsed(text: str | None) -> dict | None:
    """The object that a JSON text is; None for what isn't one, or is nested too deep to be read."""
    try:
        tree = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    return tree if isinstance(tree, dict) else None


def within(tree: Any, *names: str) -> Any:
    """A value below names; None where something on the way isn't an object."""
    for name in names:
        tree = tree.get(name) if isinstance(tree, dict) else None
    return tree


def objects(found: Any) -> list[dict]:
    """The objects of a list; none of what isn't a list."""
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def words(found: Any) -> str:
    """A string or number as text; empty for anything else."""
    return found if isinstance(found, str) else str(found) if isinstance(found, (int, float)) and not isinstance(found, bool) else ""
