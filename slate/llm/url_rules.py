"""URL filters: pattern rules indexed by their rarest literal token; DataFrame functions only.

One pass counts in how many URLs each literal of the rules occurs; each rule is filed under its rarest one, a whole token of
[a-z0-9] or, where a pattern doesn't bound its literal, four signs of it. A URL's tokens then fetch the rules filed under
them, and only those run their regular expression. Up to ``IN_PLAN`` rules the index is part of the plan, so pages are
neither shuffled nor joined, whatever host is hot; more rules are a table that the pages' tokens are joined with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.common import save

#: Rules that fit into a plan; bytes of a rule table that is broadcast; signs of a literal that isn't a whole token.
IN_PLAN, BROADCAST, GRAM = 64, 16 << 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@dataclass(frozen=True)
class Rule:
    """A host and path prefix (``pattern`` none), or a pattern of the method's own, over host and path together."""

    name: str
    verdict: str
    pattern: str | None = None

    @property
    def regex(self) -> str:
        if self.pattern is not None:
            return self.pattern
        host, slash, path = self.name.partition("/")
        quoted = "(?s)^(?:[^/]*\\.)?" + re.escape(host)
        return quoted + (re.escape(slash + path) if slash else "(?:/|$)")

    @property
    def literals(self) -> list[frozenset[str]]:
        """Sets of terms: of each set any URL that the rule fits holds one. Terms are tokens, or ``*`` and four signs."""
        found = _required(_parser.parse(self.regex))
        if not found:
            raise ValueError(f"rule {self.name!r} holds no literal token, and no literal of {GRAM} letters or digits")
        return found


def _edge(op: str, value) -> bool:
    """Whether a part of a pattern matches no letter or digit next to it: a sign, a class of signs, or an anchor."""
    if op == "AT":
        return True
    if op == "LITERAL":
        return chr(value).lower() not in _TOKEN
    if op == "IN":
        return all(str(o) == "LITERAL" and chr(v).lower() not in _TOKEN for o, v in value)
    if op == "SUBPATTERN":
        return len(value[3]) == 1 and _edge(str(value[3][0][0]), value[3][0][1])
    if op == "BRANCH":
        return all(len(b) == 1 and _edge(str(b[0][0]), b[0][1]) for b in value[1])
    return False


def _left_edge(parts: list, k: int) -> bool:
    """Whether what stands before part ``k`` ends in a sign, or is the beginning; repeats may be left out."""
    if k == 0:
        return False
    op, value = parts[k - 1]
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, _, inner = value
        inner = _flat(inner)
        return bool(inner) and _edge(*inner[-1]) and (least > 0 or _left_edge(parts, k - 1))
    return _edge(op, value)


def _flat(parsed) -> list[tuple[str, object]]:
    """The parts of a pattern in a row, plain groups opened."""
    out = []
    for op, value in parsed:
        op = str(op)
        if op == "SUBPATTERN" and not _edge(op, value):
            out += _flat(value[3])
        else:
            out.append((op, value))
    return out


def _required(parsed) -> list[frozenset[str]]:
    parts = _flat(parsed)
    found, run, bounded = [], "", False
    for k, (op, value) in enumerate([*parts, ("END", None)]):
        sign = chr(value).lower() if op == "LITERAL" else ""
        if sign in _TOKEN and sign:
            if not run:
                bounded = _left_edge(parts, k)
            run += sign
            continue
        if run and bounded and op != "END" and _edge(op, value):
            found.append(frozenset([run]))
        elif len(run) >= GRAM:
            found += [frozenset(["*" + run[i : i + GRAM]]) for i in range(len(run) - GRAM + 1)]
        if op == "BRANCH" and not _edge(op, value):  # each branch goes on with what stands before it
            before = parts[max(0, k - len(run) - 1) : k]
            each = [_required([*before, *branch]) for branch in value[1]]
            if all(each):
                found.append(frozenset().union(*[min(e, key=lambda s: (len(s), sorted(s))) for e in each]))
        run = ""
    return found


def literal(word: str) -> str:
    """Pattern of a word that stands between dots or slashes."""
    return f"(?:^|[./]){word}(?:[./]|$)"


#: What the method blocks where no rule is given.
OWN_RULES = tuple(Rule(w, "block", literal(w)) for w in ("spam-farm", "ads-track", "casino", "malware", "phishing", "warez"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(`__url`, instr(`__url`, '://') + 3)"))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def _terms(lowered: Column, grams: bool) -> Column:
    """The tokens of a URL and, if asked for, their runs of four signs."""
    tokens = F.array_distinct(F.split(lowered, "[^a-z0-9]+"))
    if not grams:
        return tokens
    ends = F.filter(tokens, lambda t: F.length(t) >= GRAM)
    each = F.transform(ends, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - GRAM + 1), lambda i: F.concat(F.lit("*"), F.substring(t, i, F.lit(GRAM)))))
    return F.array_distinct(F.concat(tokens, F.flatten(each)))


def judge(pages: DataFrame, rules: list[Rule], own: tuple[Rule, ...] = OWN_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (the longest that fits, else null), verdict, own_rule.

    Where no rule fits, the verdict is block if one of the method's own patterns fits (own_rule names it), else
    allow. A null url, or one without ``://``, has empty host and path. Repeated rows are judged alike. A rule whose
    pattern holds no usable literal is refused.
    """
    every = [*rules, *own]
    urls = pages.select("page_id", F.col("url").cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    lowered = F.translate(target, UPPER, LOWER)
    sets = [r.literals for r in every]
    names = sorted({t for s in sets for terms in s for t in terms})
    terms = _terms(lowered, any(n.startswith("*") for n in names))
    if len(every) > IN_PLAN:
        urls = save(urls.withColumn("__id", F.monotonically_increasing_id()))
        listed = pages.sparkSession.createDataFrame([(n,) for n in names], "term string")
        held = urls.select(F.explode(terms).alias("term")).join(_side(listed, len(names)), "term")
    else:
        held = urls.select(F.explode(F.filter(terms, lambda t: t.isin(names))).alias("term"))
    counts = {r["term"]: r["count"] for r in held.groupBy("term").count().collect()}  # a row for each term of the rules
    filed = [min(s, key=lambda terms: (sum(counts.get(t, 0) for t in terms), sorted(terms))) for s in sets]
    # The longest given rule first, own rules after all of them.
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i)) + list(range(len(rules), len(every)))
    choose = _best_in_table if len(every) > IN_PLAN else _best_in_plan
    best = choose(urls, every, len(rules), filed, ranked, terms, target)
    given = F.col("__given")
    return best.select("page_id", "host", "path", F.when(given, F.col("__name")).alias("rule"), F.coalesce("__verdict", F.lit("allow")).alias("verdict"), F.when(~given, F.col("__name")).alias("own_rule"))


def _best_in_plan(urls: DataFrame, every: list[Rule], n: int, filed: list[frozenset[str]], ranked: list[int], terms: Column, target: Column) -> DataFrame:
    """Each URL with the first rule by rank (the first ``n`` are given ones) that its terms fetch and whose pattern, compiled once, fits."""
    wanted = sorted({t for terms_ in filed for t in terms_})
    hit = urls.withColumn("__hits", F.filter(terms, lambda t: t.isin(wanted)) if wanted else F.array())

    def found(i: int) -> Column:
        fetched = F.lit(False)
        for t in sorted(filed[i]):
            fetched = fetched | F.array_contains("__hits", t)
        return F.when(fetched, F.when(F.regexp_like(target, F.lit(every[i].regex)), F.struct(F.lit(every[i].name).alias("name"), F.lit(every[i].verdict).alias("verdict"), F.lit(i < n).alias("given"))))

    best = F.coalesce(*[found(i) for i in ranked], F.lit(None))
    return hit.withColumn("__best", best).select("page_id", "host", "path", F.col("__best.name").alias("__name"), F.col("__best.verdict").alias("__verdict"), F.col("__best.given").alias("__given"))


def _side(table: DataFrame, rows: int) -> DataFrame:
    """A table of rules or terms (256 bytes a row) to be broadcast, unless it is too large for that."""
    return F.broadcast(table) if rows * 256 <= BROADCAST else table


def _best_in_table(urls: DataFrame, every: list[Rule], n: int, filed: list[frozenset[str]], ranked: list[int], terms: Column, target: Column) -> DataFrame:
    """The same by a join of the URLs' terms with a table of rules; what a URL fetches is put together by its number."""
    place = {i: k for k, i in enumerate(ranked)}
    rows = [(t, place[i], r.regex, r.name, r.verdict, i < n) for i, r in enumerate(every) for t in sorted(filed[i])]
    index = urls.sparkSession.createDataFrame(rows, "term string, place int, regex string, __name string, __verdict string, __given boolean")
    met = urls.select("__id", target.alias("target"), F.explode(terms).alias("term")).join(_side(index, len(rows)), "term").where(F.regexp_like("target", F.col("regex")))
    best = met.groupBy("__id").agg(F.min_by(F.struct("__name", "__verdict", "__given"), "place").alias("b")).select(F.col("__id").alias("__of"), "b.*")
    return urls.join(best, F.col("__id") == F.col("__of"), "left")
