"""Spelling variants, personal data and phrases against brute force in plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

RNG = random.Random(11)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Spelling variants.


def near(a, b):
    """Whether one inserted, deleted or replaced code point parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(n):
    """Rows of spelling_groups() over a dict of words."""
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in links.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n)


def words_like(base, count, seed):
    rng, out = random.Random(seed), {}
    for _ in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "e", "ss"])
        if w:
            out["".join(w)] = rng.choice([5, 5, 6, 25, 26, 125, 700])
    return out


@pytest.mark.parametrize("crowd", [1 << 12, 4])
def test_near_words_equal_brute_force_however_often_segments_are_halved(spark, monkeypatch, crowd):
    from skein.llm import spelling

    monkeypatch.setattr(spelling, "CROWD", crowd)
    n = words_like(["standing", "understanding", "überstehen", "aaaaaaaa", "abababab", "ÿÿÿÿÿÿ", "qwertz"], 300, 1)
    out = spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == brute_groups(n)


def test_word_counts_plant_slips_and_take_whole_texts(spark, docs):
    from skein.llm.spelling import word_counts

    vocabulary = ["Wonder", "wonder", "Éclair", "straße", "naïve", "abcdef", "somewhere", "a" * 70_000]
    rows = [(i, " ".join(RNG.choice(vocabulary[:7]) for _ in range(60)) + "1" + vocabulary[7] * (i % 40 == 0), "s") for i in range(200)]
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "wonder " * 30, "s"), (3, rows[3][1], "s"), (4, "x" * 2_000_000 + " wonder 日本wonder😀", None)]
    want = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    got = {r.word: r.n for r in word_counts(docs(rows), slips_every=199).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5 and len(w) >= 6}
    assert word_counts(docs([])).count() == 0


def test_stretches_never_tear_a_run():
    from skein.llm.phrases import END
    from skein.llm.spelling import OUTSIDE, RUN
    from skein.llm.stretches import stretches

    text = "".join(RNG.choice(["ab", "cde", " ", "é", ". ", "1"]) for _ in range(5000))
    for size in (1, 7, 100, 10**6):
        assert "".join(stretches(text, OUTSIDE, size)) == text
        assert [w for part in stretches(text, OUTSIDE, size) for w in RUN.findall(part)] == RUN.findall(text)
        assert [p for part in stretches(text, END, size) for p in END.split(part) if p] == [p for p in END.split(text) if p]


def test_a_chain_of_forms_ends_at_its_root(spark):
    from skein.llm.spelling import spelling_groups

    n = {"abcdefgh"[:k] + "x" * (12 - k): 5 ** (k + 1) for k in range(9)}
    rows = spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r.root for r in rows} == {"abcdefghxxxx"} and sorted(map(tuple, rows)) == brute_groups(n) if None not in {r.form for r in rows} else {r.root for r in rows} == {"abcdefghxxxx"}
    assert spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0


# Personal data.

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


PIECES = ["a@b.c", "x", "@", ".", "..", "1", "12", "255", "256", "0", " ", "-", "+", "+49", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "😀", "_", "%", "a.b", "\n", "10.0.0.1", "007.1.2.3", "日"]


def test_base_spans_equal_python_on_odd_texts(spark, docs):
    from skein.llm.personal import BASE as KINDS
    from skein.llm.personal import find_personal

    texts = ["", None, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b" + ".c" * 20_000, "9" * 100_000, "+1" + "-" * 50_000 + "2", "a" * 200_000 + "@b.c", ". " * 1000 + "0" * 500 + "1.0.0.1"]
    texts += ["".join(RNG.choice(PIECES) for _ in range(RNG.randint(1, 60))) for _ in range(600)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, "a@b.c", "s"), (0, "a@b.c", "s"), (None, "a@b.c", None)]
    found = find_personal(docs(rows).withColumnRenamed("score", "personal_spans"))
    assert {"doc_id", "text", "lang", "source", "n_chars", "taken", "personal_spans"} == set(found.columns)
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.doc_id, r.text].append(sorted((s["start"], s["rank"], s["end"]) for s in r.personal_spans if s["rank"] < len(KINDS)))
    for i, t, _ in rows:
        assert got[i, t][0] == base_spans(t), t[:100]
    assert len(got[0, "a@b.c"]) == 2 and got[None, "a@b.c"] == [[(0, 0, 5)]]
    assert find_personal(docs([])).count() == 0


def test_runs_without_an_end_take_linear_time(spark, docs):
    import time

    from skein.llm.personal import personal_digest

    start = time.time()
    texts = ["a" * 3_000_000, "a." * 1_000_000, "a..b" * 500_000, "1" * 3_000_000, "1-" * 1_000_000, "+1 " * 1_000_000, "a@" * 1_000_000, "1.2.3 " * 300_000]
    assert personal_digest(docs([(i, t, "s") for i, t in enumerate(texts)])).count() == len(texts)
    assert time.time() - start < 120


def test_contexts_of_seeds_find_unseen_identifiers_and_leave_common_words_alone(spark, docs):
    from skein.llm.personal import personal_digest

    noise = lambda: " ".join(RNG.choice("of the and then where word".split()) for _ in range(20))
    rows = [(i, f"{noise()} kundenmail: user{i}@mail.example.com, {noise()} the user{i}@x.example.org {noise()}", "s") for i in range(20)]
    rows += [(100, f"{noise()} kundenmail: user77(at)mail2024x {noise()}", "s"), (101, f"{noise()} the R2D2-C3PO-99 {noise()}", "s"), (102, f"{noise()} kundenmail: K-554433 {noise()} rufzeichen K-554433", "s")]
    # A second round: what the first one found makes another word a pattern.
    rows += [(200 + i, f"{noise()} kundenmail: Q-90{i}00{i} {noise()} vertragsnummer Q-90{i}00{i} {noise()}", "s") for i in range(5)] + [(300, f"{noise()} vertragsnummer V-123456 {noise()}", "s")]
    out = {r.doc_id: r for r in personal_digest(docs(rows)).collect()}
    assert all(out[i].n_email == 2 and out[i].n_found == 0 for i in range(20))
    assert out[101].spans == "" and out[102].n_found == 2 and out[102].spans.startswith("like_email:")
    assert all(out[200 + i].n_found == 2 for i in range(5)) and out[300].n_found == 1


# Phrases.


def brute_phrases(rows, least, first):
    f = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    total = collections.Counter()
    for g, n in f.items():
        total[g[0]] += n * (len(g) == 2)
    by_lang = collections.defaultdict(list)
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for (lang, *w), a in candidates.items():
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        longer = [b for (other, *v), b in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 50 * a for b in longer):
            score, _, left, right = min(cuts)
            by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, all_of in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(all_of)[:first]))


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["New", "new", "york", "city", "hall", "the", "of", "É", "é", "日本", "x\x00y", "a" * 300] + [f"w{i}" for i in range(30)]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " - "]) for _ in range(rng.randint(0, 80)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " \t "), ("fr", "new york city hall. " * 40), ("fr", "new york city hall. " * 40)]


@pytest.mark.parametrize("cells", [1 << 14, 64, 1 << 22])
def test_phrases_equal_brute_force_for_any_sketch(spark, cells):
    from skein.llm.phrases import collocations

    rows = phrase_rows(3, 200)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = collocations(docs.selectExpr("*", "1 as rank", "2 as score", "3 as n"), least=4, first=50, cells=cells).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 4, 50)
    assert collocations(docs.where("false")).count() == 0


def test_sketches_never_count_too_little_and_scores_pass_64_bits(spark):
    from skein.llm import phrases

    rng = np.random.default_rng(1)
    sketch, true = np.zeros(1 << 10, np.uint8), collections.Counter()
    for _ in range(20):
        h = rng.zipf(1.5, 500).astype(np.uint64) % np.uint64(400)
        keys, counts = np.unique(h, return_counts=True)
        true.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        for row in range(phrases.DEPTH):
            phrases.add(sketch, phrases.cells_of(keys, len(sketch), row), counts)
    small = phrases.packed(sketch)
    assert (phrases.unpacked(small) == sketch).all() and (phrases.expand(phrases.squeeze(small), len(small)) == small).all()
    keys = np.array(sorted(true), np.uint64)
    for least in (1, 5, 10, 15):
        passed = phrases.at_least(small, keys, least)
        assert all(p for p, k in zip(passed, keys.tolist(), strict=True) if true[k] >= least)
    big = spark.range(1).selectExpr("cast(1000000 as decimal(7, 0)) * (cast(900000000000000L as decimal(15, 0)) * cast(900000000000000L as decimal(15, 0))) div (cast(900000000000001L as decimal(15, 0)) * cast(999999999999999L as decimal(15, 0))) as s").first().s
    assert big == 1000000 * 900000000000000**2 // (900000000000001 * 999999999999999)
