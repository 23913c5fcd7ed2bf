"""One pass for a whole library of patterns against each pattern by itself."""

import itertools
import random
import re
import time

import pytest

pytest.importorskip("ahocorasick")

from skein.operators.library import Scanner, literals, scan_library  # noqa: E402
from skein.operators.patterns import CONTEXTS, INSIGHTS, PatternSet  # noqa: E402


def test_literals_that_every_match_shows():
    assert literals(r"(?i)\bTODO\b") == {"todo"}
    assert literals(r"foo(?:bar|bazaar)+qux") in ({"foo"}, {"bar", "bazaar"}, {"qux"})
    assert literals(r"(?:alpha|beta)?x") is None and literals(r"[abc]+\d{3}") is None and literals(r"(?:alpha|b)") is None
    assert literals(r"\b(?:decided|chose) to\b") == {"decided", "chose"} and literals(r"é+password") == {"password"}
    assert literals(r"(abc)*xy") is None and literals(r"(?:abc){0,2}wxyz") == {"wxyz"}


def brute(text, ext, counted, by_line):
    out = []
    for s in counted:
        n = sum(len(list(re.finditer(p, text, re.ASCII))) for p in s.patterns)
        if n and not (ext and s.extensions and ext not in s.extensions):
            out.append((s.type_id, None, n, None))
    for s in by_line:
        out += [(s.type_id, i, 1, line) for i, line in enumerate(text.split("\n"), 1) if any(re.search(p, line, re.ASCII) for p in s.patterns)]
    return sorted(out, key=str)


def test_one_pass_equals_every_pattern_by_itself():
    rng = random.Random(6)
    words = ["TODO", "todo", "fixme", "decided to", "Chose to", "must not", "select x from y", "login", "LOGIN", "@app.get(", "app.post(", "assert", "def test_x", "FROM ", "RUN x", "services:\n  web:", "Ünder", "ﬁxme", "K", "\n", "\n", " ", "constraint:", "İ"]
    odd = [PatternSet("odd", (r"[0-9]+", r"(?i)x|y", r"^$", r"(?i)kelvin|ſ"))]
    for _ in range(300):
        text, ext = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))), rng.choice([None, "py", "rs"])
        assert sorted(Scanner(CONTEXTS + odd, INSIGHTS + odd).scan(text, ext), key=str) == brute(text, ext, CONTEXTS + odd, INSIGHTS + odd)


def library(n):
    parts = ["th", "er", "on", "in", "re", "an", "st", "le"]
    names = ["".join(x) for x in itertools.islice(itertools.product(parts, repeat=4), n)]
    return [PatternSet(f"set:{i}", (rf"(?i)\b{w}\w*",)) for i, w in enumerate(names)]


def test_time_is_nearly_flat_in_the_number_of_patterns():
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("therinoaslx") for _ in range(rng.randint(3, 9))) for _ in range(2000)) for _ in range(20)]

    def took(n):
        scanner, start = Scanner(library(n)), time.perf_counter()
        for t in texts:
            scanner.scan(t)
        return time.perf_counter() - start

    took(10)
    assert min(took(400) for _ in range(3)) < 4 * min(took(20) for _ in range(3))


def test_scan_of_a_table(spark):
    docs = spark.createDataFrame([("a", "py", "# TODO: login\nlogin login"), ("b", None, None), ("c", "", ""), ("d", "md", "  we must not x  \n")], "key string, ext string, content string")
    got = sorted((tuple(r) for r in scan_library(docs, CONTEXTS, INSIGHTS, ext="ext").collect()), key=str)
    assert got == [("a", "context:auth", None, 3, None), ("a", "insight:todo", 1, 1, "# TODO: login"), ("d", "insight:constraint", 1, 1, "we must not x")]
