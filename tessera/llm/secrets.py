"""Secret scans: trigram inverted index, Boolean trigram queries, verification.

Each rule's regular expression is parsed on the driver into a Boolean query
over trigrams of the lower-cased text that every match must satisfy. The
postings of the trigrams that occur in a query are rows (trigram, row key);
they are intersected by a grouped set per row key, the queries are evaluated
on the set, and only candidate rows are verified with the rule's expression.
Rules without a mandatory trigram scan every text. All of it is DataFrame
expressions; spans come from the lengths of matches and the pieces between.
Running places along a text's matches are found in two levels (blocks of about
the root of their number), so a text with very many matches costs little more
than its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base kinds, in their listed order. A run of hex digits or of AKIA[A-Z0-9]+
#: shorter than the limit holds no longer match inside, so the limit may stand
#: in the expression; that of assignments can't, and is checked afterwards.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the library adds. A private key runs to its END line; where that is
#: missing, over the lines of base64 digits below the header.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x20\t\r\n]*Proc-Type:[^\n]*\n[\x20\t\r\n]*DEK-Info:[^\n]*\n)?"
                r"(?:[^-]*+-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x20\t\r\n]++[A-Za-z0-9+/]{40,}+={0,2})*+(?:[\x20\t\r\n]+[A-Za-z0-9+/]+={1,2})?)"),
)
MARK = "[SECRET]"


# ---------------------------------------------------------------- trigram queries

def trigram_query(regex: str):
    """Boolean query that the lower-cased text of any match satisfies: True,
    a trigram, ("and", ...) or ("or", ...)."""
    _, query = _analyse(P.parse(regex))
    return query


def _all(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings):
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(items):
    """(all strings it can be, or None; query) of a parsed sequence."""
    exact, now, must = True, {""}, []

    def flush():
        nonlocal exact, now
        must.append(_of_strings(now))
        exact, now = False, {""}

    for op, arg in items:
        if op is C.LITERAL:
            own, query = {chr(arg).lower()}, True
        elif op is C.IN:
            own, query = _members(arg), True
        elif op is C.SUBPATTERN:
            own, query = _analyse(arg[3])
        elif op is C.BRANCH:
            found = [_analyse(x) for x in arg[1]]
            own = None if any(x is None for x, _ in found) else set().union(*[x for x, _ in found])
            query = _any([q if x is None else _all([_of_strings(x), q]) for x, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            own, query = _analyse(sub)
            if (low, high) == (0, 1) and own is not None:
                own, query = own | {""}, True
            elif low == 0:
                own, query = None, True
            elif not (low == high == 1):
                if own is not None:
                    query = _of_strings({x * min(low, 3) for x in own}) if len(own) == 1 else True
                own = None
        elif op is C.AT:
            own, query = {""}, True
        else:
            own, query = None, True
        if own is not None and len(now) * len(own) <= 16:
            now = {a + b for a in now for b in own}
        else:
            flush()
            must.append(query if own is None else _of_strings(own))
    if exact:
        return now, True
    flush()
    return None, _all(must)


def _members(arg):
    out = set()
    for op, x in arg:
        if op is C.LITERAL:
            out.add(chr(x).lower())
        elif op is C.RANGE and x[1] - x[0] < 8:
            out |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def rule_query(regex: str):
    exact, query = _analyse(P.parse(regex))
    return _of_strings(exact) if exact is not None else query


def trigrams_of(query) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else sorted({t for q in query[1:] for t in trigrams_of(q)})


def _holds(query, grams: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(grams, query)
    parts = [_holds(q, grams) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# ---------------------------------------------------------------- postings

def _key() -> Column:
    """Key of a row's content. Rows that share one only share their candidates."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, row_key)``: the inverted index of ``docs`` for the given trigrams."""
    low = F.lower("text")
    present = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in trigrams]))
    return docs.select(F.explode(present).alias("trigram"), _key().alias("row_key"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(row_key, kinds)``: rows whose trigrams satisfy the query of a rule that has one."""
    queries = {r.kind: q for r in rules if (q := rule_query(r.regex)) is not True}
    trigrams = sorted({t for q in queries.values() for t in trigrams_of(q)})
    if not trigrams:
        return docs.select(_key().alias("row_key"), F.lit(None).cast("array<string>").alias("kinds")).filter("false")
    # At most len(trigrams) values meet in a group's set.
    grams = postings(docs, trigrams).groupBy("row_key").agg(F.collect_set("trigram").alias("grams"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("grams")), F.lit(k)) for k, q in queries.items()]))
    return grams.select("row_key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


# ---------------------------------------------------------------- spans

SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """A non-empty array cut into about as many blocks as a block has items (picked by
    index: a slice would copy the whole array for each block)."""
    size, last = F.ceil(F.sqrt(F.size(items))).cast("int"), F.size(items) - 1
    return F.transform(F.sequence(F.lit(0), last, size), lambda k: F.transform(
        F.sequence(k, F.least(k + size - 1, last)), lambda i: F.get(items, i)))


def _carried(blocks: Column, first: Column, after) -> Column:
    """The running value before each block, and after the last: ``after(value, block)``
    is the value that a block leaves."""
    return F.aggregate(blocks, F.array(first), lambda acc, b: F.concat(acc, F.array(after(F.element_at(acc, -1), b))))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches, in code points."""
    regex = F.lit(rule.regex)
    pieces, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    tested = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(found, F.length).alias("size"),
                        F.transform(tested, F.length).alias("tested"))
    none = F.array().cast(SPANS)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end"))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"),
                        F.when(x["tested"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def of_block(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("spans")), step, lambda a: a["spans"])

    def ends(at, block):
        return F.aggregate(block, at, lambda n, x: n + x["gap"] + F.coalesce(x["size"], F.lit(0)))

    return _let(rows, lambda r: _let(_blocks(r), lambda b: F.flatten(F.zip_with(
        b, F.slice(_carried(b, F.lit(0), ends), F.lit(1), F.size(b)), of_block))))


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(row, spans)``: each row of ``docs`` as a struct (so none of its columns can
    clash with another) and its spans."""
    found = candidates(docs, rules).toDF("candidate_key", "kinds")
    rows = docs.select(F.struct("*").alias("row"), _key().alias("own_key")).join(found, F.col("own_key") == F.col("candidate_key"), "left")
    parts = []
    for k, r in enumerate(rules):
        text = F.col("row.text")
        test = F.array_contains("kinds", r.kind) if rule_query(r.regex) is not True else text.rlike(r.regex)
        parts.append(F.when(F.coalesce(test, F.lit(False)), _spans(r, k, text)).otherwise(F.array().cast(SPANS)))
    return rows.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """``docs``, all columns, with ``secret_spans``: the spans of all rules in order of
    start and then of the rules, ``struct<start, order, kind, end>``.

    Null and empty texts have no spans; repeated rows each have theirs; a null
    doc_id is a value like any other. A column named ``secret_spans`` is replaced.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c != "secret_spans"]
    return _scanned(docs, base + added).select(*own, F.col("spans").alias("secret_spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per input row."""
    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return _scanned(docs, BASE + ADDED).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), *[of(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with every span (overlapping ones as one) replaced by
    ``MARK``; ``n_chars``, if there, follows where the text changed."""
    text = F.col("row.text")

    def of_block(block, reach):
        """The text from where the spans before the block end to where its own do."""
        first, last = reach["first"], reach["last"]

        def cut(own):
            def step(acc, s):
                gap = F.concat(acc["out"], F.substring(own, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(MARK))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

            return F.aggregate(block, F.struct(first.alias("at"), F.lit("").alias("out")), step, lambda a: a["out"])

        return _let(F.substring(text, first + 1, last - first), cut)

    def after(at, block):
        return F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))

    def hidden(blocks, reached):
        reach = F.arrays_zip(F.slice(reached, F.lit(1), F.size(blocks)).alias("first"), F.slice(reached, F.lit(2), F.size(blocks)).alias("last"))
        return F.concat(F.array_join(F.zip_with(blocks, reach, of_block), ""), F.substring(text, F.element_at(reached, -1) + 1, F.length(text)))

    done = _let(_blocks(F.col("spans")), lambda b: _let(_carried(b, F.lit(0), after), lambda reached: hidden(b, reached)))
    changed = F.size("spans") > 0
    rows = _scanned(docs, BASE + ADDED).select("row", "spans", F.when(changed, done).otherwise(text).alias("new_text"))
    columns = []
    for field in docs.schema:
        own = F.col("row")[field.name]
        if field.name == "text":
            own = F.col("new_text")
        elif field.name == "n_chars":
            own = F.when(changed, F.length("new_text").cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return rows.select(*columns)
