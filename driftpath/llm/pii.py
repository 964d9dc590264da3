"""Personal data by weak supervision, in DataFrame operations alone.

Candidates are spans of patterns: those of the agreed base rules, and looser ones (obfuscated addresses, numbers
without a plus, digits that fail their check, secrets and social security numbers). Four labelers vote on each
candidate, 1, 0 or -1: the base rule, a gazetteer (top-level domains, calling codes, issuers, reserved networks), the
words around it, and its shape. Expectation-maximisation over the counts of vote patterns (a table of fixed size)
estimates how far each labeler can be trusted; the posteriors are soft labels for a span classifier (naive Bayes over
votes, length, neighbouring characters and share of digits), whose tables are sums over all candidates. Base spans
stay whatever it says; other candidates are added where it gives `threshold` or more and no base span overlaps.

Positions are code points, ends exclusive; matches are leftmost and do not overlap within a pattern. The patterns are
written so that Java's engine runs them in linear time and without recursion; they match what the plain ones match.

Null and empty texts have no spans. Rows stand for themselves (null doc_id, repeated rows); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

# The base rules' patterns, kinds in their order.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "account": r"(?<![0-9+.-])[0-9]{13,19}(?![0-9])",
    "phone_local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)\b(?:token|password|passwd|api[_-]?key|secret)\b ?[=:] ?\"[^\"\n]{8,200}\"",
}
#: A text that lacks this has no match (none: always search).
NEEDS = {"email": "@", "phone": "+", "secret": '"'}
KINDS = [*BASE, *LOOSE]
CONTEXT = 40
TLDS = "com org net edu gov mil info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be se no dk fi pl pt mx ar".split()
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split()
NEAR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|kontakt|correo|courriel)\b", "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|tarjeta|carte)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    "email_spelled": r"(?i)\b(?:e-?mail|mail|contact|write|address)\b", "account": r"(?i)\b(?:card|account|iban|visa|credit|payment|konto|cuenta|compte)\b",
    "phone_local": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon)\b", "ssn": r"(?i)\b(?:ssn|social|security|tax)\b", "secret": r"(?i)\b(?:key|login|auth|credential)\b",
}
LABELERS = ("rule", "gazetteer", "context", "shape")


def _found(text: Column, kind: str) -> Column:
    """array<struct<kind, start, stop, m, left, right>> of the pattern's matches."""
    pattern = BASE.get(kind) or LOOSE[kind]
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pieces: Column, matches: Column) -> Column:
        ends = F.aggregate(
            F.sequence(F.lit(0), F.size(matches) - 1), F.array(F.lit(0)),
            lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + F.length(F.get(pieces, i)) + F.length(F.get(matches, i)))),
        )
        return F.transform(
            F.sequence(F.lit(0), F.size(matches) - 1),
            lambda i: F.struct(
                F.lit(kind).alias("kind"), (F.get(ends, i) + F.length(F.get(pieces, i))).alias("start"), F.get(ends, i + 1).alias("stop"),
                F.get(matches, i).alias("m"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("right"),
            ),
        )

    # A one-element array binds both to a name, so that they are worked out once.
    once = F.transform(F.array(F.struct(pieces.alias("p"), matches.alias("m"))), lambda x: placed(x.p, x.m))[0]
    has = text.rlike(pattern)
    if kind in NEEDS:
        has = F.contains(text, F.lit(NEEDS[kind])) & has
    return F.when(has, once).otherwise(F.array().cast("array<struct<kind:string,start:int,stop:int,m:string,left:string,right:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = F.regexp_replace(m, "[ -]", "")
        return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind in ("email", "email_spelled"):
        return _vote(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(TLDS))
    if kind in ("card", "account"):
        return _vote(m.rlike("^[3-6]"))
    if kind == "ip":
        return _vote(~m.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\."), m.rlike(r"^(?:0|127|255)\."))
    if kind == "phone":
        return _vote(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1).isin(CODES) | F.substring(m, 2, 2).isin(CODES) | F.substring(m, 2, 1).isin(CODES))
    if kind == "ssn":
        return _vote(~m.rlike("^(?:000|666|9)"))
    return _vote(m.rlike(r"(?i)^(?:token|password|api)"), F.lit(False)) if kind == "secret" else _vote(m.rlike(r"^\(?[2-9]"))


def _shape(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind in ("card", "account"):
        return _vote(n.isin(15, 16), ~n.between(13, 19))
    if kind in ("phone", "phone_local"):
        return _vote(n.between(10, 13), n.between(1, 8))
    if kind in ("email", "email_spelled"):
        return _vote(F.length(m).between(6, 60), F.length(m) > 100)
    if kind == "secret":
        return _vote(m.rlike(r'"[0-9A-Za-z+/=_-]{16,}"'), m.rlike(" "))
    return _vote(F.length(m).between(7, 15))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands: all candidates in order, with `base` (a base rule's span), four votes and three features."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def judged(kind: str):
        def one(x: Column) -> Column:
            ok, around = _passes(kind, x.m), F.concat_ws(" | ", x.left, x.right)
            return F.struct(
                x.kind.alias("kind"), x.start.alias("start"), x.stop.alias("stop"), (ok & F.lit(kind in BASE)).alias("base"),
                _vote(ok).cast("int").alias("rule"), _gazetteer(kind, x.m).cast("int").alias("gazetteer"),
                _vote(around.rlike(NEAR[kind]), F.lit(False)).cast("int").alias("context"), _shape(kind, x.m).cast("int").alias("shape"),
                F.least(F.length(x.m) / 4, F.lit(12)).cast("int").alias("size"),
                F.when(F.right(x.left, F.lit(1)).rlike(r"^\s?$"), 0).when(F.right(x.left, F.lit(1)).rlike(r"[\w]"), 1).otherwise(2).alias("edge"),
                (4 * F.length(_digits(x.m)) / F.length(x.m)).cast("int").alias("digits"),
            )

        return one

    arrays = [F.transform(_found(F.col("_dp_text"), k), judged(k)) for k in KINDS]
    return docs.select("doc_id", text.alias("_dp_text")).select("doc_id", F.concat(*arrays).alias("cands"))


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns: the share of true spans, and by labeler and vote its probability if (true, false).

    Starts from the majority; sums are smoothed by prior counts that trust a labeler a little.
    """
    m = len(counts[0][0]) if counts else 0
    prior, table = 0.5, [{1: (0.6, 0.2), 0: (0.2, 0.3), -1: (0.2, 0.5)} for _ in range(m)]
    for _ in range(rounds):
        post = [posterior(v, prior, table) for v, _ in counts]
        yes = sum(n * p for (_, n), p in zip(counts, post, strict=True))
        no = sum(n for _, n in counts) - yes
        new = []
        for k in range(m):
            held = {x: [sum(n * p for (v, n), p in zip(counts, post, strict=True) if v[k] == x), sum(n * (1 - p) for (v, n), p in zip(counts, post, strict=True) if v[k] == x)] for x in (1, 0, -1)}
            new.append({x: ((t + 10 * table0[0]) / (yes + 10), (f + 10 * table0[1]) / (no + 10)) for (x, (t, f)), table0 in zip(held.items(), ((0.6, 0.2), (0.2, 0.3), (0.2, 0.5)), strict=True)})
        next_prior = (yes + 5) / (yes + no + 10)
        done = abs(next_prior - prior) < 1e-9
        prior, table = next_prior, new
        if done:
            break
    return prior, table


def posterior(votes: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    t, f = math.log(prior), math.log(1 - prior)
    for v, x in zip(votes, table, strict=True):
        t, f = t + math.log(x[v][0]), f + math.log(x[v][1])
    return 1 / (1 + math.exp(max(-700, min(700, f - t))))


def _lookup(values: dict, key: Column, otherwise: float) -> Column:
    if not values:
        return F.lit(otherwise)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(otherwise))


def trained(cands: DataFrame):
    """The span classifier: a function from a candidate's struct to the log odds that it is personal data."""
    flat = cands.select(F.explode("cands").alias("x")).select("x.*")
    votes = flat.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    post: dict[str, float] = {}
    for kind in sorted({r.kind for r in votes}):
        counts = [(tuple(r[x] for x in LABELERS), float(r.n)) for r in votes if r.kind == kind]
        prior, table = reliabilities(counts)
        post |= {":".join([kind, *map(str, v)]): posterior(v, prior, table) for v, _ in counts}
    name = F.concat_ws(":", "kind", *LABELERS)
    feats = (*LABELERS, "size", "edge", "digits")
    soft = flat.withColumn("p", _lookup(post, name, 0.5)).select("kind", "p", F.explode(F.array(*[F.concat_ws("=", F.lit(x), F.col(x)) for x in feats])).alias("f"))
    sums = soft.groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    weight: dict[str, float] = {}
    base: dict[str, float] = {}
    for kind in {r.kind for r in sums}:
        own = [r for r in sums if r.kind == kind]
        yes, no = (sum(r[x] for r in own) / len(feats) for x in ("yes", "no"))
        base[kind] = math.log((yes + 1) / (no + 1))
        weight |= {f"{kind}:{r.f}": math.log((r.yes + 1) / (yes + 4)) - math.log((r.no + 1) / (no + 4)) for r in own}

    def odds(x: Column) -> Column:
        total = _lookup(base, x["kind"], 0.0)
        for f in feats:
            total = total + _lookup(weight, F.concat(x["kind"], F.lit(f":{f}="), x[f].cast("string")), 0.0)
        return total

    return odds


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and added: arrays of struct<kind, start, stop> (kinds in order, then start), for each row of docs."""
    cands = staged(candidates(docs))
    odds = trained(cands)
    base = F.filter("cands", lambda x: x.base)
    cut = math.log(threshold / (1 - threshold))
    out = cands.withColumn("b", base).withColumn(
        "a", F.filter("cands", lambda x: (~x.base) & (odds(x) >= cut) & ~F.exists("b", lambda y: (x.start < y.stop) & (y.start < x.stop)))
    )
    short = lambda c: F.transform(c, lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.stop.alias("stop")))
    return out.select("doc_id", short("b").alias("base"), short("a").alias("added"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x.kind)
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(rank(x).alias("r"), x.start.alias("start"), x.stop.alias("stop"), x.kind.alias("kind"))))
    return find(docs, **kw).select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"),
    )
