"""URL filter whose pattern rules are indexed by their rarest literal token.

A rule is a pattern over ``host + path`` plus an action. Literal characters stand for themselves, ``*`` for any run of
characters, ``^`` for a separator or the end, and a leading ``||`` for the start of the host or of one of its labels. The
literal tokens of a rule (runs of a-z0-9 with a boundary on both sides in every match) must all occur as tokens of a matching
URL, so a rule is filed under the one that fewest URLs hold. Each URL looks its own tokens up and runs the regular expressions
of the rules found, and of no others. Rules without such a token are tried on every URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed

#: Rule sets of up to so many tokens are looked up in a literal map within the scan; larger ones by a join.
MAP_TOKENS = 256


@dataclass(frozen=True)
class Rule:
    pattern: str
    action: str
    #: host/path rules outrank plain patterns; among them the longest wins, then the first.
    name: str | None = None

    def regex(self) -> str:
        body, out = self.pattern, ""
        if body.startswith("||"):
            body, out = body[2:], r"^(?:[^/]*\.)?"
        for ch in body:
            out += {"*": "[\\s\\S]*", "^": "(?:[^a-zA-Z0-9_.%-]|\\z)"}.get(ch) or (ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch)
        return out

    def tokens(self) -> list[str]:
        """Tokens that each matching URL holds whole."""
        anchored, body = self.pattern.startswith("||"), self.pattern.removeprefix("||")
        found = []
        for m in re.finditer("[a-z0-9]+", body.lower()):
            starts = (m.start() > 0 and body[m.start() - 1] != "*") or (m.start() == 0 and anchored)
            ends = m.end() < len(body) and body[m.end()] != "*"
            if starts and ends and body.isascii():
                found.append(m[0])
        return found


#: Fixed values of the contract: (host/path, action).
HOST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: The method's own patterns, for URLs that no host rule fits.
PATTERNS = (
    Rule("||spam-farm.", "block"),
    Rule("||cheap-pills.", "block"),
    Rule("||casino-*.", "block"),
    Rule("||adult-*.", "block"),
    Rule("||warez.", "block"),
    Rule("/wp-login.php^", "block"),
    Rule("/xmlrpc.php^", "block"),
    Rule("/cgi-bin/", "block"),
    Rule("/ads/banner^", "block"),
    Rule("/tracking/pixel^", "block"),
    Rule("/affiliate/*/click^", "block"),
    Rule("/search/*/page/", "block"),
)


def rules_of(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (pattern, action, name): name is null for plain patterns. Rows without pattern or action are left out."""
    rows = table.filter("pattern is not null and action is not null").select("pattern", "action", "name").distinct().collect()
    return tuple(Rule(r["pattern"], r["action"], r["name"]) for r in sorted(rows, key=lambda r: (r["pattern"], r["action"], r["name"] or "")))


def host_rules(pairs=HOST_RULES) -> tuple[Rule, ...]:
    return tuple(Rule(f"||{name}", action, name) for name, action in pairs)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(target), F.lit("[a-z0-9]+"), F.lit(0)))


def index_rules(targets: DataFrame, rules: tuple[Rule, ...]) -> tuple[dict[str, list[int]], list[int]]:
    """Files each rule under its token of the least URL frequency; also the rules that have no token.

    targets has one column, target. The counts cover all its rows; one count for each token of a rule reaches the driver.
    """
    wanted = sorted({t for r in rules for t in r.tokens()})
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        seen = targets.select(F.explode(F.array_intersect(url_tokens(F.col("target")), F.array(*map(F.lit, wanted)))).alias("token"))
        counts |= {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[int]] = {}
    loose = []
    for i, r in enumerate(rules):
        if tokens := r.tokens():
            index.setdefault(min(tokens, key=lambda t: (counts[t], t)), []).append(i)
        else:
            loose.append(i)
    return index, loose


def _rank(rules: tuple[Rule, ...]) -> list[int]:
    """Position of each rule in order of precedence."""
    order = sorted(range(len(rules)), key=lambda i: (rules[i].name is None, -len(rules[i].name or ""), i))
    return [order.index(i) for i in range(len(rules))]


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", default: str = "allow", map_tokens: int = MAP_TOKENS) -> DataFrame:
    """All columns of pages in one struct ``row_``, with host, path, rule (name of the host rule that won, else null) and verdict.

    Null URLs and URLs without ``://`` have empty host and path, and the default verdict. Repeated rows are judged each. An
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    base = pages.select(packed(pages), host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    index, loose = index_rules(base.select(target.alias("target")), rules)
    rank = _rank(rules)
    fields = lambda i: F.struct(F.lit(rank[i]).alias("rank"), F.lit(rules[i].regex()).alias("regex"), F.lit(rules[i].name).cast("string").alias("name"), F.lit(rules[i].action).alias("action"))
    kind = "array<struct<rank:int,regex:string,name:string,action:string>>"
    always = F.array(*map(fields, loose)) if loose else F.array().cast(kind)
    if len(index) <= map_tokens:
        base = base.withColumn("tokens_", url_tokens(target))
        fetched = F.array().cast(kind)
        if index:
            # Each token of the URL is looked up in a hash set of the indexed ones; those found fetch their rules.
            hits = F.filter("tokens_", lambda t: t.isin(sorted(index)))
            table = F.create_map(*[c for t, at in sorted(index.items()) for c in (F.lit(t), F.array(*map(fields, at)))])
            fetched = F.flatten(F.transform(hits, lambda t: F.element_at(table, t)))
        best = F.array_min(F.filter(F.concat(fetched, always), lambda c: F.regexp_like(target, c["regex"])))
        judged = base.withColumn("best_", best)
    else:
        judged = _by_join(base, index, rules, rank, always)
    return judged.select(
        "row_",
        "host",
        "path",
        F.col("best_")["name"].alias("rule"),
        F.coalesce(F.col("best_")["action"], F.lit(default)).alias("verdict"),
    )


def _by_join(base: DataFrame, index: dict[str, list[int]], rules: tuple[Rule, ...], rank: list[int], always: Column) -> DataFrame:
    """Many rules: distinct targets meet the rules on the token, the winner of each target comes back by an ordinary join."""
    spark = base.sparkSession
    rows = [(t, rank[i], rules[i].regex(), rules[i].name, rules[i].action) for t, at in index.items() for i in at]
    by_token = spark.createDataFrame(rows, "token string, rank int, regex string, name string, action string")
    base = base.withColumn("target_", F.concat("host", "path"))
    targets = base.select("target_").distinct()
    hits = targets.select("target_", F.explode(url_tokens(F.col("target_"))).alias("token")).join(by_token, "token")
    hits = hits.filter("regexp_like(target_, regex)").groupBy("target_").agg(F.min(F.struct("rank", "regex", "name", "action")).alias("hit_"))
    best = F.least(F.col("hit_"), F.array_min(F.filter(always, lambda c: F.regexp_like(F.col("target_"), c["regex"]))))
    return base.join(hits, "target_", "left").withColumn("best_", best)


def oracle(rules: tuple[Rule, ...], default: str = "allow") -> str:
    """The same verdicts by plain regular expressions, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    order = sorted(range(len(rules)), key=_rank(rules).__getitem__)
    fits = lambda i: f"regexp_matches(host || path, {quote(rules[i].regex().replace(chr(92) + 'z', chr(36)))})"
    name = " ".join(f"WHEN {fits(i)} THEN {quote(rules[i].name)}" for i in order if rules[i].name)
    action = " ".join(f"WHEN {fits(i)} THEN {quote(rules[i].action)}" for i in order)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT page_id, host, path, CASE {name} ELSE NULL END AS rule, CASE {action} ELSE '{default}' END AS verdict FROM parts"""
