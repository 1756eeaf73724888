"""Text functions of the catalog: tokens, regular expressions, globs, sizes, durations, host lists, paths."""

from __future__ import annotations

import re

try:
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_parse as _parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(c: Column, pattern: str) -> Column:
    """Whether the whole string matches; ``$`` would also match before a final newline, ``\\z`` doesn't."""
    return c.rlike(f"\\A(?:{pattern})\\z")


def literal_of(pattern: str) -> str | None:
    """The one string that an anchored or plain pattern without operators matches, else None."""
    body = pattern[1:] if pattern.startswith("^") else pattern
    body = body[:-1] if body.endswith("$") and not body.endswith("\\$") else body
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            if i + 1 >= len(body) or body[i + 1].isalnum():
                return None
            out.append(body[i + 1])
            i += 2
        elif c in ".[](){}+*?^$|":
            return None
        else:
            out.append(c)
            i += 1
    return "".join(out)


def required_literals(pattern: str, least: int = 3) -> list[str]:
    """Literal runs that every match contains, read off the pattern's parse tree.

    Only of patterns that mean the same to this parser and to the one that runs them: none with inline flags or
    look-around, escapes by number, ``\\v``, classes within classes, or anything the parser refuses.
    """
    if "(?" in pattern.replace("(?:", "") or re.search(r"\\[0-9vQE]|&&|\[[^\]]*\[", pattern):
        return []
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    runs: list[str] = []
    run: list[str] = []

    def close() -> None:
        if len(run) >= least:
            runs.append("".join(run))
        run.clear()

    def walk(nodes) -> None:
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(arg))
            elif name == "SUBPATTERN":
                walk(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                walk(arg[2])  # the first time round it follows what stands before it
                if arg[:2] != (1, 1):
                    close()
            elif name != "AT":  # anchors take no room
                close()

    walk(tree)
    close()
    return runs


def regex_predicate(c: Column, pattern: str) -> Column:
    """Full match, planned: an equality for a literal, else substring tests that the scan can use, and the regex."""
    lit = literal_of(pattern)
    if lit is not None:
        return c == F.lit(lit)
    p = full_match(c, pattern)
    for r in required_literals(pattern):
        p = c.contains(r) & p
    return p


def glob_regex(glob: str) -> str:
    """Regular expression of an fnmatch pattern in which ``*`` and ``?`` also match ``/``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_filter(c: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes win; no include pattern means all."""
    inc = F.lit(not include)
    for g in include:
        inc = inc | full_match(c, glob_regex(g))
    for g in exclude:
        inc = inc & ~full_match(c, glob_regex(g))
    return inc


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern occurs anywhere; rules that don't compile are skipped."""
    out = None
    for pattern, label in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return F.lit(None).cast("string") if out is None else out


def tokens(c: Column) -> Column:
    """Runs of at least two ASCII letters or digits, taken before they are put in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)


def regex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([.\[\](){}+*?\\^$|])", r"\\$1")


def size_bytes(c: Column) -> Column:
    """Bytes of ``10``, ``4K``, ``1.5MB``...: powers of 1024, ``inf`` the largest, 0 for no number; an unknown suffix counts 1."""
    t = F.trim(c)
    n = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)", 1)
    u = F.upper(F.regexp_extract(t, r"^[0-9.]+\s*([A-Za-z])", 1))
    power = F.when(u == "K", 1).when(u == "M", 2).when(u == "G", 3).when(u == "T", 4).when(u == "P", 5).otherwise(0)
    return F.when(F.lower(t) == "inf", F.lit(9223372036854775807)).when(n == "", F.lit(0).cast("bigint")).otherwise((n.try_cast("double") * F.pow(F.lit(1024.0), power)).cast("bigint"))


def latency_ns(c: Column) -> Column:
    """Nanoseconds of ``5us``...; the units are powers of 1024, as the configuration format has it."""
    n = F.regexp_extract(F.trim(c), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    u = F.lower(F.regexp_extract(F.trim(c), r"^[0-9.]+\s*([A-Za-z])", 1))
    return F.coalesce((n * F.pow(F.lit(1024.0), F.when(u == "u", 1).when(u == "m", 2).when(u == "s", 3).otherwise(0))).cast("bigint"), F.lit(0).cast("bigint"))


def duration_s(c: Column) -> Column:
    """Seconds of ``1h30m``, ``2d``, ``1.5h`` or a bare number; null for anything else."""
    part = r"([0-9]+(?:\.[0-9]+)?)([dhms])"
    of = lambda x: F.regexp_extract(x, part, 1).cast("double") * F.when(x.endswith("d"), 86400).when(x.endswith("h"), 3600).when(x.endswith("m"), 60).otherwise(1)
    total = F.aggregate(F.regexp_extract_all(c, F.lit(part), F.lit(0)), F.lit(0.0), lambda a, x: a + of(x))
    return F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double")).when(c.rlike(rf"^(?:{part})+$"), total)


def seconds_of(text: str) -> float:
    """duration_s of one text."""
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?", text):
        return float(text)
    if not re.fullmatch(r"(?:[0-9]+(?:\.[0-9]+)?[dhms])+", text):
        raise ValueError(f"no duration: {text!r}")
    return sum(float(n) * {"d": 86400, "h": 3600, "m": 60, "s": 1}[u] for n, u in re.findall(r"([0-9]+(?:\.[0-9]+)?)([dhms])", text))


def expand_hosts(text: str) -> list[str]:
    """``a[00-02,10]-x;b`` -> a00-x a01-x a02-x a10-x b; numbers keep their width where both ends have the same."""
    out: list[str] = []
    for item in filter(None, (p.strip() for p in text.split(";"))):
        m = re.match(r"^(.*?)\[([^\]]*)\](.*)$", item)
        if not m:
            out.append(item)
            continue
        for part in m[2].split(","):
            lo, _, hi = part.strip().partition("-")
            hi = hi or lo
            width = len(lo) if len(lo) == len(hi) else 0
            for k in range(int(lo), int(hi) + 1):
                out += expand_hosts(f"{m[1]}{k:0{width}d}{m[3]}")
    return out


def parent_path(c: Column) -> Column:
    """Parent of an absolute path; that of ``/a`` is ``/``."""
    p = F.regexp_replace(c, "/+$", "")
    return F.when(F.instr(F.substring(p, 2, 1 << 30), "/") == 0, F.lit("/")).otherwise(F.regexp_replace(p, "/[^/]*$", ""))


def ancestors(c: Column) -> Column:
    """The path itself and every directory above it: /a/b -> [/, /a, /a/b]."""
    parts = F.filter(F.split(c, "/"), lambda x: x != "")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(F.size(parts) > 0, F.concat(F.array(F.lit("/")), deeper)).otherwise(F.array(F.lit("/")))


def packed_id(major: Column, minor: Column) -> Column:
    return F.shiftleft(major.cast("bigint"), 32).bitwiseOR(minor.cast("bigint"))
