"""Channel selection by name, number or keyword."""

from __future__ import annotations


def normalize_selector(selector: str | int | None) -> str | int | None:
    """Text made of digits means a position, other text a name; both without blanks around."""
    match selector:
        case str() as text if text.strip().isdigit():
            return int(text)
        case str() as text:
            return text.strip()
        case other:
            return other


def resolve_channel(labels: list[str], selector: str | int | None, keyword: str,
                    required: bool) -> int | None:
    """Index of a channel: by number, else the best of those that hold the name or the keyword.

    A channel of just the wanted name ranks before one that holds it in part, then the first one counts.
    """
    wanted = normalize_selector(selector)
    if isinstance(wanted, int):
        if wanted in range(len(labels)):
            return wanted
        raise ValueError(f"EDF channel index {wanted} is out of range.")
    text = (keyword if wanted is None else wanted).lower()
    ranked = [(wanted is None or name.lower() != text, i) for i, name in enumerate(labels) if text in name.lower()]
    if ranked:
        return min(ranked)[1]
    if wanted is not None:
        raise ValueError(f"EDF channel '{wanted}' was not found.")
    return 0 if required and labels else None
