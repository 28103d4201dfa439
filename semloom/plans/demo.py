"""A small corpus with planted bridges: words that no document has keep the company of words that one does."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

OFFICE = ["ledger", "stamp", "clerk", "filing", "bureau"]
BRIDGES = [("dismissal",), ("layoff",), ("reshuffle",), ("shown", "door"), ("sacked",)]
OTHERS = [
    ["breeze", "harbour", "sail", "anchor", "tide"],
    ["dough", "yeast", "crust", "baker", "loaf"],
    ["orbit", "probe", "comet", "lander", "rover"],
]
DOCUMENTS = [
    (1, "A stiff breeze let every sail leave the harbour"),
    (2, "The baker folds dough while yeast works on the loaf"),
    (3, "The lander lost its orbit before the comet passed"),
    (4, "At low tide the anchor shows in the harbour"),
    (5, "A hot oven gives the loaf its crust"),
    (6, "The rover sent what the probe had measured"),
    (7, "Dismissal filed by a clerk under the stamp of the bureau"),
    (8, "Sail with the tide and mind the breeze"),
]


def sentences(seed: int = 42, repeats: int = 40) -> list[str]:
    """In each round every bridge among three office words, and three rounds of other company; shuffled."""
    rng, out = random.Random(seed), []
    for _ in range(repeats):
        for bridge in BRIDGES:
            company = rng.sample(OFFICE, 3)
            out.append(" ".join([company[0], *bridge, *company[1:]]))
        out += [" ".join(rng.sample(other, 4)) for other in OTHERS]
    rng.shuffle(out)
    return out


def write(folder: str, seed: int = 42, repeats: int = 40) -> tuple[str, str]:
    """(chat log, documents file)."""
    os.makedirs(folder, exist_ok=True)
    chat, docs = os.path.join(folder, "chat.jsonl"), os.path.join(folder, "documents.json")
    Path(chat).write_text("".join(json.dumps(dict(content=s, role="user")) + "\n" for s in sentences(seed, repeats)))
    Path(docs).write_text(json.dumps([dict(zip(("id", "text"), d)) for d in DOCUMENTS]))
    return chat, docs
