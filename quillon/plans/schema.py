"""What the planner knows of an entity table and its texts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EntityTextSchema:
    """id_col names entities; text_id_col in the text table refers to them; numeric_cols are compared as numbers."""

    id_col: str
    text_id_col: str
    text_col: str
    structured_cols: tuple[str, ...] = ()
    numeric_cols: tuple[str, ...] = ()


DOCUMENTS = EntityTextSchema("doc_id", "doc_id", "text", ("lang", "source", "n_chars"), ("n_chars",))


def pick_column(names, *aliases: str) -> str:
    """The first of names that equals one of aliases, in the order of the aliases; case doesn't count."""
    by = {n.lower(): n for n in reversed(list(names))}
    for a in aliases:
        if a.lower() in by:
            return by[a.lower()]
    raise KeyError(f"none of {aliases} among {list(names)}")
