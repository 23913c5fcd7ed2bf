"""Text expressions for code and identifiers: tokens, snippets, titles, keys and redaction. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators between code words, and the pieces of a word in mixed case.
SEPARATORS = r"[_\-.\s/\\:]+"
PIECES = r"[A-Z]{2,}(?=[A-Z][a-z])|[A-Z]{2,}$|[A-Z][a-z]+|[a-z]+|[0-9]+"


# One pattern for a whole text: pieces of two characters or more, or a part without any piece as it is.
_INSIDE = SEPARATORS.removesuffix("+").replace("[", "[^", 1)
_END = f"(?!{_INSIDE})"
_ANY_PIECE = PIECES.replace("$", _END)
TOKENS = _ANY_PIECE.replace("[a-z]+|[0-9]+", "[a-z]{2,}|[0-9]{2,}") + f"|(?<!{_INSIDE})(?!{_INSIDE}*?(?:{_ANY_PIECE})){_INSIDE}{{2,}}"


def raw_tokens(text: Column) -> Column:
    """array<string>: words of identifiers in any case style, as they are written; single characters are dropped.

    A part without a word of ASCII letters or digits is one token.
    """
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def code_tokens(text: Column) -> Column:
    """raw_tokens() in lower case."""
    return F.transform(raw_tokens(text), F.lower)


def index_text(text: Column) -> Column:
    """Tokens and the lower-case original, as one searchable string."""
    return F.concat(F.array_join(code_tokens(text), " "), F.lit(" "), F.lower(text))


def flexible_pattern(query: str) -> str | None:
    """A pattern that finds a phrase in any case style; None for a single word."""
    words = query.lower().split()
    return "(?i)" + r"[\s_\-.]*".join(map(re.escape, words)) if len(words) > 1 else None


def dedupe_key(text: Column) -> Column:
    """Text without case, punctuation . , ! ? ; : and runs of white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[.,!?;:]", ""), r"\s+", " "))


def title(text: Column, most: int = 50) -> Column:
    """First sentence of the first line, cut with an ellipsis."""
    line = F.substring_index(F.trim(text), "\n", 1)
    sentence = F.substring_index(line, ". ", 1)
    return F.when(F.length(sentence) > most, F.concat(F.substring(sentence, 1, most - 3), F.lit("..."))).otherwise(sentence)


def snippet(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    """What lies around [start, end) in code points, on one line, with ellipses where it is cut."""
    low, high = F.greatest(start - around, F.lit(0)), F.least(end + around, F.length(text))
    body = F.translate(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), "\n", " ")
    return F.concat(F.when(low > 0, "...").otherwise(""), F.trim(body), F.when(high < F.length(text), "...").otherwise(""))


# Openings that say nothing and are taken off, one after the other, and openings of mere narration.
NARRATION_PREFIXES = [
    r"^found it!?\s*",
    r"^here's (the|what)[^.!?]*[.!?]\s*",
    r"^(ok|okay|alright)[\s,]+so\s+",
    r"^(ok|okay|alright)[,.]?\s+",
    r"^(ah|aha|ahh)[,!]?\s+",
    r"^(oh|ohh)[,!]?\s+",
    r"^(yep|yup|yeah)[,.]?\s+",
    r"^nice[,!]?\s+",
]
NARRATION = [
    r"^let me\b",
    r"^now (let me|I'll|I'm going to)\b",
    r"^(ok|okay|alright)[\s,]+(so|let me|now)\b",
    r"^checking\b",
    r"^looking (at|for|into)\b",
    r"^searching\b",
    r"^reading\b",
    r"^I('ll| will| am going to)\b",
    r"^first,?\s+(let me|I'll)\b",
    r"^lemme\b",
    r"^on it\b",
    r"^running\b",
    r"^executing\b",
    r"^starting\b",
]
NARRATION_BELOW = 30
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
SNIPPET_MOST = 300


def without_narration(text: Column) -> Column:
    """text without the openings of NARRATION_PREFIXES, trimmed."""
    for prefix in NARRATION_PREFIXES:
        text = F.regexp_replace(text, "(?i)" + prefix, "")
    return F.trim(text)


def is_narration(text: Column) -> Column:
    """True where hardly anything is left without its openings, or the rest opens like narration."""
    rest = without_narration(F.trim(text))
    return (F.length(rest) < NARRATION_BELOW) | rest.rlike("(?i)" + "|".join(f"(?:{p})" for p in NARRATION))


def sentences(text: Column) -> Column:
    """array<string>: sentences, which end before white space and a capital; blank ones are left out."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def sentence_snippet(text: Column, at: Column, most: int = SNIPPET_MOST) -> Column:
    """The sentence that holds the code point offset at, and those beside it, cut at a word to most characters.

    Sentences are laid end to end without the white space between them; an offset beyond them counts as the first.
    """
    each = F.transform(sentences(text), F.length)
    # One running sum: the first sentence whose end lies behind the offset, from 1; 0 for none.
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("i"), F.lit(0).alias("found"))

    def step(s: Column, x: Column) -> Column:
        here = F.when((s["found"] == 0) & (s["total"] + x > at), s["i"] + 1).otherwise(s["found"])
        return F.struct((s["total"] + x).alias("total"), (s["i"] + 1).alias("i"), here.alias("found"))

    index = F.aggregate(each, start, step, lambda s: s["found"])
    first = F.greatest(F.when(index == 0, F.lit(1)).otherwise(index).cast("int") - 1, F.lit(1))
    last = F.when(index == 0, F.lit(1)).otherwise(index).cast("int") + 1
    near = F.array_join(F.filter(F.transform(F.slice(sentences(text), first, last - first + 1), F.trim), lambda s: s != ""), " ")
    cut = F.concat(F.regexp_replace(F.substring(near, 1, most), r"(?s)^(.*) .*$", "$1"), F.lit("..."))
    return F.trim(F.when(F.length(near) > most, cut).otherwise(near))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a code point offset."""
    before = F.substring(text, 1, at.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def hex_key(key: Column) -> Column:
    """0x and sixteen lower-case digits of a 64-bit key."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(key)), 16, "0"))


def key_of_hex(text: Column) -> Column:
    """The 64-bit key (two's complement) of its hex form."""
    digits = F.lpad(F.regexp_replace(text, "^0x", ""), 16, "0")
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def file_key(path: Column) -> Column:
    """Key text of a file."""
    return F.concat(F.lit("file:"), path)


def symbol_key(path: Column, name: Column, kind: Column, start: Column, end: Column) -> Column:
    """Key text of a symbol; the end defaults to the start."""
    return F.concat(F.lit("sym:"), path, F.lit("#"), name, F.lit(":"), kind, F.lit(":"), start.cast("string"), F.lit(":"), F.coalesce(end, start).cast("string"))


def remote_slug(url: Column) -> Column:
    """host/owner/name of a git remote in any spelling, lower case."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^([^/:]+):(?:[0-9]+/)?", "$1/"), r"(?:\.git)?/*$", "")


def project_id(slug: Column) -> Column:
    """A version-4 shaped UUID from the sha256 of a slug."""
    h = F.sha2(slug, 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def route_of_file(path: Column) -> Column:
    """Route of a file by its place: what follows app/ or pages/, without the file, [x] as :x."""
    inner = F.regexp_extract(path, r"(?:^|/)(?:app|pages)(/.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, r"/(?:route|page|index)\.[A-Za-z]+$", ""), r"\.[A-Za-z]+$", "")
    return F.when(inner == "", F.lit(None)).otherwise(F.coalesce(F.nullif(F.regexp_replace(bare, r"\[(?:\.\.\.)?([^\]]+)\]", ":$1"), F.lit("")), F.lit("/")))


# What a path tells of its context, and what a tool tells of the task.
CONTEXT_OF_PATH = [
    (r"\.(tsx|jsx)$", "context:frontend"),
    (r"components?/", "context:frontend"),
    (r"(pages|views|screens)/", "context:frontend"),
    (r"(server|api|routes|handlers)/", "context:backend"),
    (r"(controllers?|services?)/", "context:backend"),
    (r"(api|endpoints?|routes?)/", "context:api"),
    (r"\.(graphql|proto)$", "context:api"),
    (r"(auth|login|session|oauth|jwt)/", "context:auth"),
    (r"(auth|login|session|password)", "context:auth"),
    (r"(models?|schemas?|migrations?)/", "context:data"),
    (r"(database|db|orm)/", "context:data"),
    (r"test[s_]?/", "context:testing"),
    (r"(test_|_test\.|\.test\.|\.spec\.)", "context:testing"),
    (r"(docker|k8s|kubernetes|helm)/", "context:infra"),
    (r"(Dockerfile|docker-compose)", "context:infra"),
    (r"\.(tf|tfvars)$", "context:infra"),
    (r"(\.github|\.gitlab|jenkins|circleci)/", "context:cicd"),
    (r"(workflows?|pipelines?)/", "context:cicd"),
]
TASK_OF_TOOL = {
    "Bash": "task:debug",
    "mcp__acp__Bash": "task:debug",
    "Write": "task:implement_feature",
    "Edit": "task:implement_feature",
    "mcp__acp__Write": "task:implement_feature",
    "mcp__acp__Edit": "task:implement_feature",
    "Read": "task:review",
    "Grep": "task:review",
    "Glob": "task:review",
    "mcp__acp__Read": "task:review",
}


def contexts_of_path(path: Column) -> Column:
    """Sorted contexts that a path suggests."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(path.rlike(f"(?i){p}"), F.lit(c)) for p, c in CONTEXT_OF_PATH]))))


def task_of_tools(tools: Column) -> Column:
    """The task that most of an array of tools suggest, of equals the first in the alphabet; null where none does."""
    tasks = sorted(set(TASK_OF_TOOL.values()))

    def vote(task: str) -> Column:
        names = [k for k, v in TASK_OF_TOOL.items() if v == task]
        return F.size(F.filter(tools, lambda x: x.isin(*names)))

    votes = [vote(t) for t in tasks]
    most = F.greatest(*votes)
    return F.when(most > 0, F.coalesce(*[F.when(v == most, F.lit(t)) for v, t in zip(votes, tasks, strict=True)]))


# Signs of regular expressions that backtrack badly, with their risk.
REGEX_RISKS = {
    "nested": (r"\((?!\?:)[^)]*[+*][^)]*\)[+*]", 40),
    "overlapping": (r"\(([^|)]+)\|(\1)", 20),
    "unbounded": (r"\.\*[^?].*\.\*|\.+[^?].*\.+", 30),
    "class_run": (r"\[[\^]?[^\]]*\][+*]\s*\[", 15),
}
UNSAFE_FROM = 40


def safe_rlike(text: Column, pattern: Column) -> Column:
    """Whether text matches; null for patterns that may backtrack badly, which are never tried."""
    return F.when(regex_risk(pattern) < UNSAFE_FROM, F.rlike(text, pattern))


def _if_safe(pattern: Column, result: Column) -> Column:
    return F.when(regex_risk(pattern) < UNSAFE_FROM, result)


def safe_match(text: Column, pattern: Column) -> Column:
    """Whether text begins with a match; null for unsafe patterns."""
    return _if_safe(pattern, F.rlike(text, F.concat(F.lit(r"\A(?:"), pattern, F.lit(")"))))


def safe_findall(text: Column, pattern: Column, group: int = 0) -> Column:
    """All matches, or what a group of each holds; null for unsafe patterns."""
    return _if_safe(pattern, F.regexp_extract_all(text, pattern, F.lit(group)))


def safe_sub(text: Column, pattern: Column, by: Column) -> Column:
    """text with every match put as by, in which $1 stands for the first group; null for unsafe patterns."""
    return _if_safe(pattern, F.regexp_replace(text, pattern, by))


def regex_risk(pattern: Column) -> Column:
    """Risk score of a regular expression; unsafe from UNSAFE_FROM on."""
    total = F.lit(0)
    for sign, risk in REGEX_RISKS.values():
        total = total + F.when(pattern.rlike(sign), risk).otherwise(0)
    return total


# Patterns of our own for personal data and keys.
REDACTIONS = [
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ipv4", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"),
    ("hex_key", r"\b[0-9a-f]{32,}\b"),
]


def redacted(text: Column) -> Column:
    """text with e-mail addresses, addresses and long keys as [REDACTED:kind]."""
    for kind, pattern in REDACTIONS:
        clean = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
        # Most texts have no such sign and are spared the search.
        text = F.when(F.contains(text, F.lit("@")), clean).otherwise(text) if kind == "email" else clean
    return text


def has_secret(text: Column) -> Column:
    return text.rlike("|".join(p for _, p in REDACTIONS))
