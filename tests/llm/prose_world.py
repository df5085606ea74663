"""Prose for the tests of text quality."""

from __future__ import annotations

import random

PEOPLE = ("the farmers", "two clerks", "an old teacher", "some visitors", "the baker's daughter", "nobody", "every student", "the harbour master")
DEEDS = ("repaired", "painted", "forgot", "measured", "described", "sold", "visited", "drew")
THINGS = ("the wooden bridge", "a pale lantern", "the winter road", "three maps of the valley", "the notebook with the prices", "an empty barrel", "the north gate")
TIMES = ("before dawn", "while it rained", "because the ferry was late", "in the second week of May", "and then went home", "although it was cold", "for the last time")


def prose(rng: random.Random, n: int | None = None) -> str:
    s = [f"{rng.choice(PEOPLE).capitalize()} {rng.choice(DEEDS)} {rng.choice(THINGS)} {rng.choice(TIMES)}." for _ in range(n or rng.randint(3, 12))]
    at = rng.randint(1, len(s))
    return " ".join(s[:at]) + ("\n\n" + " ".join(s[at:]) if s[at:] else "")
