"""Rendering of ranked results: detailed, compact or as a Markdown table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("detailed", "compact", "markdown")


def marker(rank: Column, doc_id: Column, relevant: Column, answer: str = "CAVAB", hit: str = "HIT", miss: str = "") -> Column:
    return F.when(rank == 1, F.lit(answer)).when(F.array_contains(relevant, doc_id), F.lit(hit)).otherwise(F.lit(miss))


@dataclass
class Presenter:
    """Options of a rendering; ``max_text_chars`` 0 hides the text and None shows all of it."""

    style: str = "detailed"
    max_text_chars: int | None = 220
    show_score: bool = True
    show_doc_id: bool = True
    show_chunk_id: bool = True
    show_heading: bool = True
    metadata_fields: Sequence[str] = ()
    answer_label: str = "CAVAB"
    hit_label: str = "HIT"
    miss_label: str = ""
    mark_answer: bool = True

    def __post_init__(self):
        if self.style not in STYLES:
            raise ValueError(f"style {self.style!r} is none of {STYLES}")

    def label(self, r: dict, relevant: set[str]) -> str:
        if self.mark_answer and r["rank"] == 1:
            return self.answer_label
        return self.hit_label if r["doc_id"] in relevant else self.miss_label

    def text(self, r: dict) -> str:
        if self.max_text_chars == 0:
            return ""
        t = r["text"].replace("\n", " ").strip()
        n = self.max_text_chars
        return t if n is None or len(t) <= n else t[: n - 1] + "…"

    def fields(self, r: dict) -> list[str]:
        meta = r.get("metadata") or {}
        out = [f"score={r['score']:.4f}"] * self.show_score + [f"doc={r['doc_id']}"] * self.show_doc_id + [f"chunk={r['chunk_id']}"] * self.show_chunk_id
        out += [f"[{meta['section_heading']}]"] if self.show_heading and meta.get("section_heading") else []
        return out + [f"{k}={meta[k]}" for k in self.metadata_fields if meta.get(k) is not None]

    def format_result(self, r: dict, relevant: set[str]) -> list[str]:
        """The lines of one hit; a subclass may lay it out otherwise."""
        width = max(map(len, (self.answer_label, self.hit_label, self.miss_label)))
        head = f"  {self.label(r, relevant):<{width}} #{r['rank']}  {'  '.join(self.fields(r))}"
        text = self.text(r)
        if self.style == "compact":
            return [f"{head}  {text}" if text else head]
        return [head, *([f"        {text}"] if text else [])]

    def _markdown(self, results: list[dict], relevant: set[str]) -> list[str]:
        cols = [("", lambda r: self.label(r, relevant)), ("rank", lambda r: str(r["rank"]))]
        cols += [("score", lambda r: f"{r['score']:.4f}")] * self.show_score + [("doc", lambda r: r["doc_id"])] * self.show_doc_id + [("chunk", lambda r: r["chunk_id"])] * self.show_chunk_id
        cols += [(k, lambda r, k=k: str((r.get("metadata") or {}).get(k, ""))) for k in self.metadata_fields]
        cols += [("text", lambda r: self.text(r).replace("|", "\\|"))] * (self.max_text_chars != 0)
        rows = [[n for n, _ in cols], *([f(r) for _, f in cols] for r in results)]
        lines = [f"| {' | '.join(row)} |" for row in rows]
        return [lines[0], "|" + "---|" * len(cols), *lines[1:]]

    def render(self, question: str, results: Iterable, relevant_ids: Iterable[str] = ()) -> str:
        rows = [r if isinstance(r, dict) else r.asDict(recursive=True) for r in results]
        relevant = set(relevant_ids or ())
        body = self._markdown(rows, relevant) if self.style == "markdown" else [line for r in rows for line in self.format_result(r, relevant)]
        return "\n".join([*([f"Q: {question}"] if question else []), *body])

    def show(self, question: str, results: Iterable, relevant_ids: Iterable[str] = ()) -> None:
        print("\n" + self.render(question, results, relevant_ids))


def show_results(question: str, results: Iterable, relevant_ids: Iterable[str] = (), **options) -> None:
    Presenter(**options).show(question, results, relevant_ids)
