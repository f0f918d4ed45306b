"""Secret scans with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must contain
(lower-cased, so one index serves both kinds of letters). The index has a posting list for each trigram that
some query asks for: the hashes of the texts that hold it. ``ask`` intersects and unites the lists for all queries in one shuffle of these
hashes, and only the candidates of a rule are verified with its expression. Equal hashes of different texts would only add candidates.
Rules without a mandatory trigram scan every text.

DataFrame functions only. Two passes over the texts, which don't move while there are at most ``MOST_KEYS`` different candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm._common import MOST_KEYS, bounded, free_name, recovery_point

#: Literal alternatives that are followed at a time while a query is derived.
MOST = 64
WORD_BITS = 60


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match must have. ``base``: one of the rules that always apply."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES: tuple[Rule, ...] = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # Runs are matched whole, so asking for 24 digits in the pattern is the same as dropping shorter runs, and cheaper.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
    # Of a scheme of more than 21 characters the last 21 are taken: an open end would take time in the square of a long word.
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x09-\x0D\x20/@:]+:[^\x09-\x0D\x20/@]+@"),
)

# A query is True, a trigram, or ("and" | "or", a tuple of queries).


def _both(kind: str, parts: list) -> object:
    flat: list = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "and":
        flat = [p for p in flat if p is not True]
    elif any(p is True for p in flat):
        return True
    flat = list(dict.fromkeys(flat))
    if kind == "or":  # what asks for more than another alternative adds nothing
        asked = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in flat]
        flat = [p for p, a in zip(flat, asked, strict=True) if not any(b < a for b in asked)]
    return True if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> object:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _chars(items) -> set[str] | None:
    """What a class matches, or None where that's many."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """All strings that a sequence matches (None where they are many), and a query that its matches meet.

    Strings of neighbouring pieces are joined; at a piece that matches many, what was joined so far goes into the query.
    """
    joined: set[str] = {""}
    query: list = []
    exact = True
    for op, arg in nodes:
        strings, inner = None, True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _chars(arg)
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                inner = _both("or", [q if s is None else _of_strings(s) for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            once, q = _walk(body)
            if once is not None and high == 1:
                strings = once | ({""} if low == 0 else set())
            elif once is not None and low == high and len(once) ** low <= MOST:
                strings = {""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in once}
            elif low > 0:
                inner = q if once is None else _of_strings(once)
        elif op is sre.AT:
            strings = {""}
        if strings is not None and len(joined) * len(strings) <= MOST:
            joined = {a + b for a in joined for b in strings}
            continue
        exact = False
        query.append(_of_strings(joined))
        query.append(inner)
        joined = strings if strings is not None else {""}
    if exact:
        return joined, True
    return None, _both("and", [*query, _of_strings(joined)])


def trigram_query(pattern: str) -> object:
    """A query that every text with a match of the pattern meets; True if no trigram is mandatory."""
    strings, query = _walk(sre_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))


def _sum(columns: list[Column]) -> Column:
    while len(columns) > 1:
        columns = [a + b for a, b in zip(columns[::2], columns[1::2], strict=False)] + columns[len(columns) & ~1 :]
    return columns[0]


def posting_lists(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index as a table (trigram, number, text_hash): the texts, by their xxhash64, that hold the trigram of that number in ``vocabulary``. A text without any isn't listed."""
    grams = vocabulary(rules)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    # Bits in words of WORD_BITS are computed in one projection, where the lower-cased text is shared; only then are they made rows.
    held = lambda g, i: F.when(F.contains(low, F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    words = [_sum([held(g, i) for i, g in enumerate(grams[at : at + WORD_BITS])]) for at in range(0, len(grams), WORD_BITS)] or [F.lit(0).cast("bigint")]
    marked = docs.select(F.xxhash64(text_col).alias("text_hash"), F.array(*words).alias("words"))
    numbers = F.expr(f"filter(sequence(0, {max(1, len(grams)) - 1}), i -> getbit(words[i div {WORD_BITS}], i % {WORD_BITS}) = 1)")
    return marked.select("text_hash", F.explode(numbers).alias("number")).select(F.element_at(F.lit(grams or [""]), F.col("number") + 1).alias("trigram"), "number", "text_hash")


def _met(words: list[Column], query: object, grams: list[str]) -> Column:
    """Whether a text is in the intersections and unions of posting lists that the query asks for; bit i of the words says whether it is in list i."""
    kind, parts = ("and", (query,)) if isinstance(query, str) else query
    masks: dict[int, int] = {}
    tests = []
    for p in parts:
        if isinstance(p, str):
            at = grams.index(p)
            masks[at // WORD_BITS] = masks.get(at // WORD_BITS, 0) | 1 << at % WORD_BITS
        else:
            tests.append(_met(words, p, grams))
    for w, mask in masks.items():
        held = words[w].bitwiseAND(F.lit(mask))
        tests.append(held == F.lit(mask) if kind == "and" else held != 0)
    out = tests[0]
    for t in tests[1:]:
        out = out & t if kind == "and" else out | t
    return out


def ask(lists: DataFrame, queries: list[object], grams: list[str]) -> DataFrame:
    """``(text_hash, met)``: for each text that meets one of the queries, the numbers of those it meets. Queries that are True have no list and aren't reported.

    ``grams``: the vocabulary that numbers the lists. One shuffle for all queries: the lists are merged by text, after each task has merged its own part.
    """
    asked = [(n, q) for n, q in enumerate(queries) if q is not True]
    if not asked:
        return lists.groupBy("text_hash").agg(F.first(F.array().cast("array<int>")).alias("met")).limit(0)
    width = -(-len(grams) // WORD_BITS)
    bit = lambda w: F.expr(f"if(number div {WORD_BITS} = {w}, shiftleft(1L, number % {WORD_BITS}), 0L)")
    merged = lists.groupBy("text_hash").agg(*(F.bit_or(bit(w)).alias(f"w{w}") for w in range(width)))
    words = [F.col(f"w{w}") for w in range(width)]
    met = F.filter(F.array(*(F.when(_met(words, q, grams), F.lit(n)) for n, q in asked)), lambda n: n.isNotNull())
    return merged.select("text_hash", met.alias("met")).where(F.size("met") > 0)


SPANS = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"


def match_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of a rule with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        value = x["m"] if rule.group == 0 else F.regexp_extract(x["m"], rule.pattern, rule.group)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        more = F.when(F.length(value) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` with the spans of all rules appended: an array of (start, rank, end, kind) by start, then rank of the rule.

    Places are code points, ends exclusive. Null and empty texts have no spans; long ones are scanned whole; spans of different rules that start at one place are
    all kept, in the rules' order; rows are independent of each other, so repeated rows repeat. ``name`` gets an underscore if ``docs`` has it. An empty table gives an empty result.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    found = recovery_point(ask(posting_lists(docs, text_col, rules), queries, vocabulary(rules)))
    own, met = free_name(docs, name), free_name(docs, "met")
    joined = docs.alias("a").join(bounded(found, MOST_KEYS).alias("b"), F.xxhash64(F.col(f"a.`{text_col}`")) == F.col("b.text_hash"), "left")
    out = joined.select(*(F.col(f"a.`{c}`") for c in docs.columns), F.col("b.met").alias(met))
    text, none = F.coalesce(F.col(text_col), F.lit("")), F.array().cast(SPANS)
    each = []
    for rank, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        gate = text.rlike(rule.pattern)
        each.append(F.when(gate if query is True else F.coalesce(F.array_contains(met, rank), F.lit(False)) & gate, match_spans(text, rule, rank)).otherwise(none))
    return out.withColumn(own, F.array_sort(F.concat(*each))).drop(met)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
