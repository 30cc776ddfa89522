"""Markdown and console reports of one answer."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from chronokg.plans.pipeline import Answer


def _cell(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def _table(rows: list[dict], columns: dict[str, str]) -> list[str]:
    """Rows as a numbered table; ``columns``: heading to field."""
    if not rows:
        return ["none", ""]
    body = [f"| {n} | " + " | ".join(_cell(r.get(f, "")) for f in columns.values()) + " |" for n, r in enumerate(rows, 1)]
    return ["| # | " + " | ".join(columns) + " |", "|" + " --- |" * (len(columns) + 1), *body, ""]


def _card(values: dict) -> list[str]:
    return ["| Attribute | Value |", "| --- | --- |", *(f"| {k} | {_cell(v)} |" for k, v in values.items()), ""]


EDGE = {"Source": "source", "Target": "target", "Description": "description", "Type": "type", "Weight": "weight", "Book": "book_number", "Chapter": "chapter", "Text Units": "n_units"}


def _entities(found: Answer) -> list[str]:
    out = []
    for n, e in enumerate(found.entities, 1):
        out += [f"### Entity {n}: {e['name']}", ""]
        out += _card({"Name": e["name"], "Type": e["type"], "Book": e["book_number"], "Chapter": e["chapter"], "Description": e["description"], "Text Units": e.get("n_units", "")})
        own = sorted((x for x in found.edges if x["entity"] == e["entity"]), key=lambda x: (x["book_number"], x["chapter"]))
        out += [f"**Relationships of {e['name']}**", "", *_table(own, EDGE)] if own else []
    return out or ["none", ""]


def _sources(found: Answer) -> list[str]:
    """The sources as the context has them, under the entity that each was taken for."""
    names, out, above = {e.get("entity"): e["name"] for e in found.entities}, [], None
    for n, s in enumerate(found.sources, 1):
        owner = names.get(s.get("entity"))
        if owner and owner != above:
            out += [f"### Sources of {owner}", ""]
            above = owner
        position = f"{100 * s['relative_position']:.2f}%" if "relative_position" in s else ""
        values = {"ID": s.get("unit_id", s.get("id")), "Book": s.get("book_number", ""), "Book Title": s.get("book_title", ""), "Chapter": s.get("chapter", ""), "Chunk Index": s.get("chunk_index", ""), "Relative Position": position, "Text Tokens": s.get("text_tokens", "")}
        out += [f"**Source {n}: {values['ID']}**", "", *_card(values), s["text"].strip(), ""]
    return out or ["none", ""]


def detailed(found: Answer) -> str:
    books = [f"**Books:** {', '.join(map(str, found.books))}", ""] if found.books else []
    counts = [f"- **{name}:** {len(rows)}" for name, rows in (("Entities", found.entities), ("Relationships", found.edges), ("Communities", found.communities), ("Sources", found.sources))]
    return "\n".join([
        f"# {found.query}", "", f"*{datetime.now():%Y-%m-%d %H:%M:%S}*", "", *books, "## Answer", "", found.answer, "", "## Context statistics", "", *counts, "",
        "## Communities", "", *_table(found.communities, {"Title": "title", "Summary": "summary"}), "## Entities", "", *_entities(found), "## Sources", "", *_sources(found),
    ])


def prompts(found: Answer) -> str:
    return "\n".join([f"# {found.query}", "", "## System prompt", "```", found.system, "```", "", "## Prompt", "```", found.prompt, "```", "", "## Answer", found.answer, ""])


def save(found: Answer, path: str) -> list[Path]:
    """Two files beside ``path``: the report and the prompt."""
    at = Path(path)
    files = [at.with_name(f"{at.stem}_detailed_report_llm.md"), at.with_name(f"{at.stem}_report_llm.md")]
    at.parent.mkdir(parents=True, exist_ok=True)
    for file, body in zip(files, (detailed(found), prompts(found))):
        file.write_text(body, encoding="utf-8")
    return files


def summary(found: Answer, preview: int = 200) -> str:
    return "\n".join([
        f"Question: {found.query}", f"Answer: {found.answer}",
        f"Entities: {len(found.entities)}, communities: {len(found.communities)}, relationships: {len(found.edges)}, sources: {len(found.sources)}",
        *(f"- {s.get('unit_id', s.get('id'))}: {s['text'][:preview]}" for s in found.sources),
    ])
