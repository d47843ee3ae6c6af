"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the matches of the base patterns and of wider ones. Regular-expression, gazetteer and context labelers vote +1,
-1 or 0 on each. Expectation-maximisation over the counts of vote patterns in all documents estimates how reliable each labeler
is, and its posteriors are the soft labels on which a logistic span classifier is trained, with shape features besides the
votes. Base matches always stay; other candidates become spans where the classifier accepts them and no base match overlaps.

Everything that touches texts is built-in column functions. Only the table of distinct (kind, votes, shape) patterns, whose size
is bounded by the product of the features' values, reaches the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a candidate that the context labelers see.
CONTEXT = 32
EM_ROUNDS = 50
TRAIN_ROUNDS = 400
ACCEPT = 0.5

# Possessive forms of the contract's patterns: the same leftmost matches, without deep recursion or quadratic retries.
_LOCAL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + "@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[ -]?[0-9]){12,}+",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of the gate has no match of the pattern.
BASE_GATE = {"email": "@", "ip": "[0-9]\\.[0-9]++\\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){12}", "phone": "\\+[0-9]"}
WIDE = {
    "email": _LOCAL + " ?[\\[({](?i:at)[\\])}] ?[A-Za-z0-9-]++(?: ?(?:\\.|[\\[({](?i:dot)[\\])}]) ?[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "phone": "(?<![0-9+().-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
WIDE_GATE = {"email": "(?i)[\\[({]at[\\])}]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "phone": "[0-9]{3}[ .-][0-9]{4}"}

#: Top-level domains, first octets that no host has, leading digits of card issuers, country calling codes.
TOP_DOMAINS = (
    "com org net edu gov mil int info biz name pro io ai app dev co me tv cc xyz online site shop blog cloud eu "
    "de fr es it pt nl be lu ch at uk ie dk se no fi is pl cz sk hu ro bg gr hr si rs ru ua tr us ca mx br ar cl pe ve au nz jp cn tw hk kr in id my sg th vn ph za eg ng ke il ae sa"
).split()
NO_HOST = ["0", *map(str, range(224, 256))]
ISSUERS = "4 51 52 53 54 55 2221 2222 2223 2224 2225 2226 2227 2228 2229 223 224 225 226 23 24 25 26 270 271 2720 34 37 300 301 302 303 304 305 36 38 39 6011 644 645 646 647 648 649 65 62 35".split()
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "211 212 213 216 218 233 234 254 255 256 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 "
    "502 503 504 505 506 507 591 593 595 598 852 853 855 856 880 886 961 962 963 964 965 966 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998"
).split()
#: Gazetteers and cues, by kind.
KNOWN = {
    "email": f"(?i)[.)\\]}} ](?:{'|'.join(TOP_DOMAINS)})$",
    "ip": f"^(?!(?:{'|'.join(NO_HOST)})\\.)",
    "card": f"^(?:{'|'.join(ISSUERS)})",
    "phone": f"^(?:\\+(?:{'|'.join(CALLING)})|\\(?[2-9])",
}
SHAPE = {
    "email": "^[A-Za-z0-9][^@]{0,63}(?:@|\\W+at\\W+)[A-Za-z0-9][A-Za-z0-9 .\\[\\](){}-]*[A-Za-z]{2,}$",
    "ip": "^(?:(?:0|[1-9][0-9]{0,2})(?:\\.(?:0|[1-9][0-9]{0,2})){3}|[0-9A-Fa-f:]+)$",
    "card": "^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{5})$",
    "phone": "^(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,}){1,4}$",
}
CUE = {
    "email": "(?i)\\b(?:e-?mail|mail|correo|courriel|contact|contacto|kontakt|write|reach)\\b",
    "ip": "(?i)\\b(?:ip|host|server|addr|address|client|gateway|router|login|from)\\b",
    "card": "(?i)\\b(?:card|carte|karte|tarjeta|visa|mastercard|amex|credit|debit|pay|paid)\\b",
    "phone": "(?i)\\b(?:phone|tel|telephone|telefon|teléfono|téléphone|mobile|cell|call|fax|sms)\\b",
}
AGAINST = "(?i)(?:\\b(?:version|build|release|isbn|issn|order|invoice|serial|sku|section|figure|token|hash|commit|uuid)\\b|[=/#&_]$)"
LABELERS = ("regex", "shape", "gazetteer", "check", "cue", "against", "edge")


#: Matches that are folded at once, so that long lists aren't copied for each match.
FOLD = 64


def _matches(text: Column, kind: str, pattern: str, gate: str, origin: str) -> Column:
    """Array of candidates with positions in code points: text between matches and matches alternate, so lengths add up.

    What a candidate has before it are the last CONTEXT characters of the text, earlier matches included.
    """
    some = F.regexp_like(text, F.lit(gate)) if gate != "@" else F.contains(text, F.lit("@"))
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    n = F.size(found)
    rows = F.arrays_zip(F.slice(gaps, 1, n).alias("before"), found.alias("match"), F.slice(gaps, 2, n).alias("after"))
    item = "struct<kind:string,start:int,end:int,origin:string,match:string,before:string,after:string>"
    none = F.array().cast(f"array<{item}>")
    tail = lambda *parts: F.substring(F.concat(*parts), -CONTEXT, CONTEXT)
    begin = lambda at, seen, out: F.struct(at.alias("at"), seen.alias("seen"), out.alias("out"))

    def step(acc, r):
        first = acc["at"] + F.length(r["before"])
        last = first + F.length(r["match"])
        before, after = tail(acc["seen"], r["before"]), F.substring(r["after"], 1, 1)
        new = F.struct(F.lit(kind).alias("kind"), first.alias("start"), last.alias("end"), F.lit(origin).alias("origin"), r["match"].alias("match"), before.alias("before"), after.alias("after"))
        return begin(last, tail(acc["seen"], r["before"], r["match"]), F.concat(acc["out"], F.array(new)))

    def block(acc, own):
        folded = F.aggregate(own, begin(acc["at"], acc["seen"], none), step)
        return F.get(F.transform(F.array(folded), lambda x: begin(x["at"], x["seen"], F.concat(acc["out"], F.array(x["out"])))), F.lit(0))

    blocks = F.transform(F.array(rows), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda b: F.slice(all_, b * FOLD + 1, F.lit(FOLD))))
    every = F.aggregate(F.get(blocks, F.lit(0)), begin(F.lit(0), F.lit(""), F.array().cast(f"array<array<{item}>>")), block, lambda acc: F.flatten(acc["out"]))
    # Behind the gate, so that the gate alone is evaluated for a text without any.
    return F.when(some & (n > 0), every).otherwise(none)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


_OCTETS = "^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"


def _valid(kind: str, match: Column) -> Column:
    """The contract's test of a base match."""
    digits = _digits(match)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.regexp_like(match, F.lit(_OCTETS)),
        "card": lambda: F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
        "phone": lambda: F.length(digits).between(9, 15),
    }[kind]()


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(None)
    for k in KINDS:
        out = F.when(kind == k, make(k)).otherwise(out)
    return out


def _voted(c: Column) -> Column:
    """A candidate with its votes and shape features."""
    kind, match = c["kind"], c["match"]
    yes = lambda cond, against=0: F.when(cond, 1).otherwise(against)
    base = (c["origin"] == "base") & _by_kind(kind, lambda k: _valid(k, match))
    check = {
        "email": lambda: F.when(F.contains(match, F.lit("..")), -1).otherwise(0),
        "ip": lambda: yes(F.regexp_like(match, F.lit(_OCTETS)) | F.contains(match, F.lit(":")), -1),
        "card": lambda: yes(F.call_function("luhn_check", _digits(match)), -1),
        "phone": lambda: yes(F.length(_digits(match)).between(9, 15), -1),
    }
    votes = {
        "regex": yes(base),
        "shape": yes(_by_kind(kind, lambda k: F.regexp_like(match, F.lit(SHAPE[k]))), -1),
        "gazetteer": yes(_by_kind(kind, lambda k: F.regexp_like(match, F.lit(KNOWN[k]))), -1),
        "check": _by_kind(kind, lambda k: check[k]()),
        "cue": yes(_by_kind(kind, lambda k: F.regexp_like(c["before"], F.lit(CUE[k])))),
        "against": F.when(F.regexp_like(c["before"], F.lit(AGAINST)), -1).otherwise(0),
        "edge": F.when(F.regexp_like(c["before"], F.lit("[\\p{L}\\p{N}]$")) | F.regexp_like(c["after"], F.lit("^[\\p{L}\\p{N}]")), -1).otherwise(1),
    }
    return F.struct(
        kind.alias("kind"),
        c["start"].alias("start"),
        c["end"].alias("end"),
        base.alias("base"),
        (c["origin"] == "base").alias("plain"),
        F.least(F.floor(F.length(match) / 4), F.lit(8)).cast("int").alias("size"),
        *[votes[x].cast("int").alias(x) for x in LABELERS],
    )


def candidates(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = [_matches(text, k, BASE[k], BASE_GATE[k], "base") for k in KINDS] + [_matches(text, k, WIDE[k], WIDE_GATE[k], "wide") for k in KINDS if k in WIDE]
    return F.transform(F.concat(*found), _voted)


def patterns(docs: DataFrame, text_col: str = "text") -> list[dict]:
    """How often each (kind, shape, votes) occurs in all documents: at most 4 x 2 x 9 x 3^7 rows."""
    keys = ["kind", "plain", "size", *LABELERS]
    rows = docs.select(F.explode(candidates(F.col(f"`{text_col}`"))).alias("c")).select("c.*").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return [r.asDict() for r in rows.collect()]


def reliabilities(rows: list[dict], rounds: int = EM_ROUNDS) -> tuple[float, dict[tuple[str, int, int], float]]:
    """EM for one kind: the share of true candidates, and P(vote | truth) for each labeler. Starts from the majority vote."""
    post = [1 / (1 + math.exp(-1.5 * sum(r[x] for x in LABELERS))) for r in rows]
    prior, chance = 0.5, {}
    for _ in range(rounds):
        total = sum(r["n"] for r in rows)
        true = sum(r["n"] * p for r, p in zip(rows, post, strict=True))
        prior = (true + 1) / (total + 2)
        for x in LABELERS:
            for y, mass in ((1, true), (0, total - true)):
                for v in (-1, 0, 1):
                    # One pseudo-count; for true candidates a vote for, and for others a vote against, has two.
                    agree = 2.0 if v == (1 if y else -1) else 1.0
                    hit = sum(r["n"] * (p if y else 1 - p) for r, p in zip(rows, post, strict=True) if r[x] == v)
                    chance[x, y, v] = (hit + agree) / (mass + 4)
        post = [posterior(r, prior, chance) for r in rows]
    return prior, chance


def posterior(row: dict, prior: float, chance: dict) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(chance[x, 1, row[x]] / chance[x, 0, row[x]]) for x in LABELERS)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def _features(row: dict) -> list[str]:
    return ["bias", f"plain:{str(bool(row['plain'])).lower()}", f"size:{row['size']}", *[f"{x}:{row[x]}" for x in LABELERS]]


@dataclass(frozen=True)
class SpanModel:
    """Weights by (kind, feature)."""

    weights: dict[tuple[str, str], float]

    def score(self, kind: str, row: dict) -> float:
        return 1 / (1 + math.exp(-sum(self.weights.get((kind, f), 0.0) for f in _features(row))))

    def accepts(self, c: Column) -> Column:
        names = {"bias": F.lit("bias"), "plain": F.concat(F.lit("plain:"), c["plain"].cast("string")), "size": F.concat(F.lit("size:"), c["size"].cast("string"))}
        names |= {x: F.concat(F.lit(f"{x}:"), c[x].cast("string")) for x in LABELERS}
        if not self.weights:
            return F.lit(False)
        table = F.create_map(*[F.lit(x) for (k, f), w in sorted(self.weights.items()) for x in (f"{k} {f}", float(w))])
        total = F.lit(0.0)
        for name in names.values():
            total = total + F.coalesce(F.element_at(table, F.concat(c["kind"], F.lit(" "), name)), F.lit(0.0))
        return 1 / (1 + F.exp(-total)) >= ACCEPT


def train(rows: list[dict], rounds: int = TRAIN_ROUNDS) -> SpanModel:
    """A logistic regression for each kind, on the EM posteriors as soft labels, weighted by count; L2 of one row."""
    weights: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        prior, chance = reliabilities(own)
        soft = [posterior(r, prior, chance) for r in own]
        names = [_features(r) for r in own]
        total, w = sum(r["n"] for r in own), defaultdict(float)
        squares: dict[str, float] = defaultdict(lambda: 1e-8)
        for _ in range(rounds):
            slope: dict[str, float] = defaultdict(float)
            for r, fs, y in zip(own, names, soft, strict=True):
                p = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(w[f] for f in fs)))))
                for f in fs:
                    slope[f] += r["n"] * (p - y) / total
            for f, g in slope.items():
                g += w[f] / total
                squares[f] += g * g
                w[f] -= 0.5 * g / math.sqrt(squares[f])
        weights |= {(kind, f): x for f, x in w.items()}
    return SpanModel(weights)


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    return train(patterns(docs, text_col))


def spans_of(text: Column, model: SpanModel) -> Column:
    """struct<base, all>: arrays of struct<rank, start, end>, in order of kind and start."""
    seen = candidates(text)

    def chosen(all_: Column) -> Column:
        base = F.filter(all_, lambda c: c["base"])
        clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        more = F.filter(all_, lambda c: ~c["base"] & model.accepts(c) & clear(c))
        rank = lambda c: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"))
        return F.struct(F.array_sort(F.transform(base, rank)).alias("base"), F.array_sort(F.array_distinct(F.transform(F.concat(base, more), rank))).alias("all"))

    # Bound once through a one-element array, so that the candidates are found once for each text.
    return F.get(F.transform(F.array(seen), chosen), F.lit(0))


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"].cast("int"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null text counts as empty: no spans, sha256 of empty text. Repeated rows each have a row; an empty table gives an empty
    result. Other columns of docs are not read.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), spans_of(F.col(text_col), model).alias("s"))
    count = lambda k: F.size(F.filter("s.base", lambda c: c["rank"] == KINDS.index(k) + 1)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("s.base")), 256).alias("base_sha256"), _joined(F.col("s.all")).alias("spans"))


def redacted(text: Column, model: SpanModel) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first and longest, as [EMAIL]. Null stays null."""
    order = F.array_sort(F.transform(spans_of(text, model)["all"], lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["rank"].alias("rank"))))
    kind = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["rank"].cast("int"))
    # What each span leaves out depends only on how far the spans before it reach; a block's pieces are joined to one text.
    begin = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(acc, s):
        fresh = F.array(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), kind(s))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"])
        return begin(F.greatest(acc["at"], s["end"]), out)

    none = F.array().cast("array<string>")

    def block(acc, own):
        folded = F.aggregate(own, begin(acc["at"], none), step)
        return F.get(F.transform(F.array(folded), lambda x: begin(x["at"], F.concat(acc["out"], F.array(F.array_join(x["out"], ""))))), F.lit(0))

    blocks = F.transform(F.array(order), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda b: F.slice(all_, b * FOLD + 1, F.lit(FOLD))))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(order) > 0, F.aggregate(F.get(blocks, F.lit(0)), begin(F.lit(0), none), block, end)).otherwise(text)


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with their columns, text redacted; n_chars, where there is one, follows.

    Null texts stay null with their n_chars; repeated rows are each redacted; an empty table gives an empty result.
    """
    out = docs.withColumn("text", redacted(F.col("text"), model))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
