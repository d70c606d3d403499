"""Chat message made from a rendered report, and its delivery."""

from __future__ import annotations

import argparse
import json
import os
import re
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path

from litquarry.functions.text import py_shorten, py_truncate
from litquarry.operators.report import QA_HEADING
from litquarry.sources.report_reader import HEADINGS

# Wording and sizes of the message.
MESSAGE_LIMIT, TAKEAWAY_LIMIT = 3_900, 420
PARTS = (("pathology", "Top pathology", 3), ("gp", "GP-useful highlight", 1), ("preprints", "Preprint highlight", 1))
GLANCE = (("GP", "GP-useful digest items", "gp"), ("Preprints", "Preprint watch items", "preprints"), ("Watchlist", "Watchlist items", "watchlist"))
NOTHING = "No items met the threshold today."
DISCLAIMER = "Research surveillance only; verify full text before changing practice."
SEND_URL = "https://api.telegram.org/bot{}/sendMessage"


def read_report(markdown: str) -> tuple[str, dict[str, list[dict[str, str]]], dict[str, str]]:
    """(date, entries by section, counts by label) of one report."""
    day, sections, counts = "", {}, {}
    heading, blocks = "", re.split(r"(?m)^\s*(?=## )", markdown)
    for block in blocks:
        lines = [x.strip() for x in block.splitlines()]
        heading = lines[0][3:].strip() if lines and lines[0].startswith("## ") else ""
        if not day:
            day = next((x[5:].strip() for x in block.splitlines() if x.startswith("Date:")), "")
        if heading == QA_HEADING:
            counts |= {k.strip(): v.strip() for x in lines if x.startswith("- ") and ":" in x for k, v in [x[2:].split(":", 1)]}
        elif name := HEADINGS.get(heading):
            own = sections.setdefault(name, [])
            for x in lines[1:]:
                if x.startswith("### "):
                    own.append({"title": re.sub(r"^\d+\. ", "", x[4:].strip())})
                elif own and (m := re.match(r"\*\*(.+?):\*\*(.*)", x)):
                    own[-1][m[1].strip()] = m[2].strip()
    return day, sections, counts


def _entry(number: int, paper: dict[str, str]) -> list[str]:
    facts = [paper.get("Journal"), paper.get("Source"), f"Score {paper['Score']}" if paper.get("Score") else ""]
    takeaway = py_shorten(paper.get("Takeaway", ""), TAKEAWAY_LIMIT)
    lines = [f"{number}. {paper.get('title', 'Untitled')}", " | ".join(filter(None, facts))]
    lines += [f"{label}: {value}" for label, value in (("Takeaway", takeaway), ("Link", paper.get("Link"))) if value]
    return [*filter(None, lines), ""]


def build_message(markdown: str, url: str = "") -> str:
    """Short message: the first entries of three sections, counts, address, disclaimer."""
    day, sections, counts = read_report(markdown)
    out = [f"Daily Pathology Digest - {day or 'today'}", ""]
    for name, label, most in PARTS:
        listed = sections.get(name, [])[:most]
        out += [f"{label}:", *(x for k, p in enumerate(listed, 1) for x in _entry(k, p)), *([] if listed else [NOTHING]), ""]
    out.append("At a glance: " + " | ".join(f"{short} {counts.get(label, len(sections.get(name, [])))}" for short, label, name in GLANCE))
    out += [f"Full digest: {url}"] if url else []
    return py_truncate("\n".join([*out, "", DISCLAIMER]), MESSAGE_LIMIT)


def post(url: str, form: dict[str, str]) -> dict:
    request = urllib.request.Request(url, data=urllib.parse.urlencode(form).encode(), method="POST")
    with urllib.request.urlopen(request, timeout=30) as answer:
        return json.loads(answer.read().decode("utf-8"))


def send(token: str, chat: str, text: str, transport: Callable[[str, dict[str, str]], dict] = post) -> dict:
    return transport(SEND_URL.format(token), {"chat_id": chat, "text": text, "disable_web_page_preview": "true"})


def main(argv: list[str] | None = None, transport: Callable[[str, dict[str, str]], dict] = post) -> int:
    """Send a report's message. Without credentials there is nothing to do, which is no failure."""
    parser = argparse.ArgumentParser(description="Send the message of a report")
    parser.add_argument("--digest", default="digests/latest.md")
    parser.add_argument("--url", default="")
    args = parser.parse_args(argv)
    token, chat = os.environ.get("TELEGRAM_BOT_TOKEN", ""), os.environ.get("TELEGRAM_CHAT_ID", "")
    if not (token and chat):
        print("Credentials missing; no message sent.")
        return 0
    answer = send(token, chat, build_message(Path(args.digest).read_text(encoding="utf-8"), args.url), transport)
    if not answer.get("ok"):
        raise SystemExit(f"Sending failed: {answer}")
    print("Message sent.")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
