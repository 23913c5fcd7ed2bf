"""One pass over texts for a whole library of patterns, hundreds of them, whatever their number.

Most patterns cannot match without some literal text. Those literals, of all patterns, are searched at once by an
automaton; only the patterns whose literals a text shows are then run on it, or, for patterns that are counted by line,
only on the lines that show them. Patterns without such a literal run everywhere. Contexts (counted over a whole text)
and insights (found line by line) come from the same pass. Letters and digits are those of ASCII to the patterns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from re import _constants as op
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.patterns import PatternSet

#: Shorter literals show nearly everywhere and would not spare anything.
SHORTEST = 3


def _choices(tree) -> list[frozenset[str]]:
    """Sets of literals, in lower case, of each of which every match of a parsed pattern shows one at least."""
    found, run = [], ""

    def close():
        nonlocal run
        if run:
            found.append(frozenset([run.lower()]))
        run = ""

    for kind, value in tree:
        if kind is op.LITERAL and value < 128:
            run += chr(value)
            continue
        if kind is op.AT:
            continue
        close()
        if kind is op.SUBPATTERN:
            found += _choices(value[-1])
        elif kind is op.ATOMIC_GROUP:
            found += _choices(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _choices(value[2])
        elif kind is op.BRANCH:
            each = [_best(_choices(branch)) for branch in value[1]]
            if all(each):
                found.append(frozenset().union(*each))
    close()
    return found


def _best(choices: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest literal is longest; the smallest of several."""
    return max(choices, key=lambda c: (min(map(len, c)), -len(c), sorted(c)), default=None)


def literals(pattern: str) -> frozenset[str] | None:
    """Literals, in lower case, one of which every match of the pattern shows; None where there are none of use."""
    best = _best(_choices(parser.parse(pattern, re.ASCII)))
    return best if best and min(map(len, best)) >= SHORTEST else None


class Scanner:
    """Scans texts for sets of patterns whose matches are counted, and for others that are looked for line by line."""

    def __init__(self, counted: list[PatternSet], by_line: list[PatternSet] = ()):
        import ahocorasick

        self.sets = [(s, False) for s in counted] + [(s, True) for s in by_line]
        #: (set number, place in the set, compiled pattern) of every pattern.
        self.patterns = [(n, i, re.compile(p, re.ASCII)) for n, (s, _) in enumerate(self.sets) for i, p in enumerate(s.patterns)]
        owners: dict[str, list[int]] = {}
        self.always = []
        for k, (n, i, _) in enumerate(self.patterns):
            wanted = literals(self.sets[n][0].patterns[i])
            for x in wanted or ():
                owners.setdefault(x, []).append(k)
            if wanted is None:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for x, ks in owners.items():
            self.automaton.add_word(x, ks)
        if owners:
            self.automaton.make_automaton()

    def shown(self, text: str) -> dict[int, list[int]]:
        """Patterns whose literals the text shows, with the places where one of them ends."""
        out: dict[int, list[int]] = {}
        # Only ASCII letters change, so that places stay.
        low = text.translate(LOWER)
        for end, ks in self.automaton.iter(low) if len(self.automaton) else ():
            for k in ks:
                out.setdefault(k, []).append(end)
        return out

    def scan(self, text: str, ext: str | None = None) -> list[tuple[str, int | None, int, str | None]]:
        """(type_id, line, n, matched line): a set's count over the text with line None; or 1 and the line, once per line."""
        places, out = self.shown(text), []
        breaks = [m.start() for m in re.finditer("\n", text)] if any(line for _, line in self.sets) else []
        counts: dict[int, int] = {}
        lines: dict[int, set[int]] = {}
        for k in [*places, *self.always]:
            n, _, pattern = self.patterns[k]
            s, by_line = self.sets[n]
            if ext and s.extensions and ext not in s.extensions:
                continue
            if not by_line:
                counts[n] = counts.get(n, 0) + sum(1 for _ in pattern.finditer(text))
                continue
            for at in sorted({bisect_right(breaks, e - 1) for e in places[k]}) if k in places else range(len(breaks) + 1):
                start, end = (breaks[at - 1] + 1 if at else 0), (breaks[at] if at < len(breaks) else len(text))
                if pattern.search(text[start:end]):
                    lines.setdefault(n, set()).add(at)
        out += [(self.sets[n][0].type_id, None, c, None) for n, c in sorted(counts.items()) if c]
        for n, ats in sorted(lines.items()):
            out += [(self.sets[n][0].type_id, at + 1, 1, text[(breaks[at - 1] + 1 if at else 0) : (breaks[at] if at < len(breaks) else len(text))]) for at in sorted(ats)]
        return out


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def scan_library(docs: DataFrame, counted: list[PatternSet], by_line: list[PatternSet] = (), least: int = 2, key: str = "key", content: str = "content", ext: str | None = None, most: int = 100) -> DataFrame:
    """key, type_id, line, n, text: contexts with at least `least` matches (line and text null), and each line of an insight.

    A narrow pass over the texts; null texts show nothing. Lines are trimmed of blanks and cut to `most` characters.
    """
    kind = dict(docs.dtypes)[key]
    scanners: list[Scanner] = []

    def run(frames):
        if not scanners:
            scanners.append(Scanner(counted, by_line))
        for f in frames:
            rows = [(k, *hit) for k, text, x in zip(f["key"], f["content"], f["ext"], strict=True) for hit in scanners[0].scan(text, x or None)]
            rows = [(k, t, line, n, None if x is None else x.strip(" ")[:most]) for k, t, line, n, x in rows if line is not None or n >= least]
            if rows:
                yield pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(("key", "type_id", "line", "n", "text"), zip(*rows, strict=True), strict=True)})

    texts = docs.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"), (F.coalesce(F.col(ext), F.lit("")) if ext else F.lit("")).alias("ext"))
    return texts.mapInPandas(run, f"key {kind}, type_id string, line int, n bigint, text string")
